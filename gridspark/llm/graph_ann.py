"""Approximate nearest neighbours by inner product: a robust-pruned directed graph per shard.

Vectors are lengthened by one component so that the largest inner product is
the smallest distance.  A graph grows in batches: greedy searches from the entry
point propose neighbours, and of those an edge is kept only if no kept one is
closer to it by the factor ``ALPHA`` (relaxed pruning keeps diverse edges);
reverse edges follow, and nodes with too many are pruned again.  A beam search
over each shard answers the queries, and the shards' answers are merged.

Equal vectors are one node, which lists its smallest ids: one more than are
asked for, and no query can get others.  They are folded before the shuffle, so
a vector of a third of all rows is one row per task.  A shard holds about
``SHARD`` distinct vectors, queries come in blocks of ``QUERIES``, and a task has
one shard and one block.

Cases: vectors that are null, empty, zero or hold null or non-finite components
take no part, nor do rows with a null id; vectors are compared with those of
equal length only; a repeated id is not its own neighbour; an empty table
gives no rows.  Only id and vector are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.session import cut_lineage

SHARD = 8192
QUERIES = 16_384
DEGREE = 32
BEAM = 64
SEARCH_BEAM = 128
EXPAND = 4
ALPHA = 1.2
GROW = 1024


def _distances(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Squared distances (less the query's norm) of each query to its row of ids."""
    return norms[ids] - 2 * np.einsum("qrd,qd->qr", vectors[ids], queries)


def beam_search(vectors: np.ndarray, norms: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest nodes that greedy searches reach, nearest first, with their distances; -1 where there are fewer.

    All queries step together; each step expands the nearest ``EXPAND`` nodes of a beam that are not yet expanded.
    """
    n, q = len(vectors), len(queries)
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True  # the missing edge
    ids = np.full((q, beam), n)
    far = np.full((q, beam), np.inf, np.float32)
    done = np.ones((q, beam), bool)
    ids[:, 0] = entry
    far[:, 0] = _distances(vectors, np.full((q, 1), entry), queries, norms)[:, 0]
    done[:, 0] = False
    seen[:, entry] = True
    live = np.arange(q)
    while len(live):
        open_far = np.where(done[live], np.inf, far[live])
        pick = np.argsort(open_far, axis=1)[:, :EXPAND]
        ready = np.isfinite(np.take_along_axis(open_far, pick, 1))
        keep = ready.any(axis=1)
        live, pick, ready = live[keep], pick[keep], ready[keep]
        if not len(live):
            break
        nodes = np.where(ready, ids[live[:, None], pick], n)
        done[live[:, None], pick] = True
        near = edges[nodes].reshape(len(live), -1)
        near = np.sort(near, axis=1)
        fresh = ~seen[live[:, None], near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        seen[live[:, None], near] = True
        near = np.where(fresh, near, n)
        d = _distances(vectors, np.minimum(near, n - 1), queries[live], norms).astype(np.float32)
        d[~fresh] = np.inf
        all_far = np.concatenate([far[live], d], axis=1)
        best = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
        order = np.argsort(np.take_along_axis(all_far, best, 1), axis=1, kind="stable")
        best = np.take_along_axis(best, order, 1)
        far[live] = np.take_along_axis(all_far, best, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], near], axis=1), best, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], np.zeros(near.shape, bool)], axis=1), best, 1)
    ids[~np.isfinite(far)] = -1
    return ids, far


def robust_prune(vectors: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """For each node at most ``degree`` of its candidates (-1: none): the nearest, then the nearest that no kept one covers."""
    m, c = candidates.shape
    own = (candidates == nodes[:, None]) | (candidates < 0)
    picked = vectors[np.maximum(candidates, 0)]
    to_node = ((picked - vectors[nodes][:, None]) ** 2).sum(axis=2)
    squares = (picked**2).sum(axis=2)
    between = squares[:, :, None] + squares[:, None] - 2 * np.matmul(picked, picked.transpose(0, 2, 1))
    to_node[own] = np.inf
    kept = np.full((m, degree), -1)
    at = np.arange(m)
    for k in range(degree):
        best = to_node.argmin(axis=1)
        ok = np.isfinite(to_node[at, best])
        if not ok.any():
            break
        kept[ok, k] = candidates[at, best][ok]
        covered = alpha**2 * between[at, best] <= to_node
        to_node[covered & ok[:, None]] = np.inf
        to_node[at, best] = np.inf
    return kept


def build_graph(vectors: np.ndarray, seed: int = 3) -> tuple[np.ndarray, int]:
    """Edges ``(n, DEGREE)``, padded by n, and the entry point."""
    n = len(vectors)
    edges = np.full((n + 1, DEGREE), n)
    norms = (vectors**2).sum(axis=1)
    middle = vectors.mean(axis=0)
    entry = int(((vectors - middle) ** 2).sum(axis=1).argmin())
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    done, batch = 1, 1
    while done < n:
        new = order[done : done + batch]
        near, _ = beam_search(vectors, norms, edges, entry, vectors[new], min(BEAM, max(8, done)))
        kept = robust_prune(vectors, new, near)
        edges[new] = np.where(kept < 0, n, kept)
        _add_reverse(vectors, edges, new, kept)
        done += len(new)
        batch = min(GROW, max(1, done))
    return edges, entry


def _add_reverse(vectors: np.ndarray, edges: np.ndarray, new: np.ndarray, kept: np.ndarray) -> None:
    """Edges back to the new nodes; a node without room is pruned over its old and new edges."""
    n = len(vectors)
    source = np.repeat(new, kept.shape[1])[kept.ravel() >= 0]
    target = kept.ravel()[kept.ravel() >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    at, first, count = np.unique(target, return_index=True, return_counts=True)
    wide = np.full((len(at), DEGREE + int(count.max())), -1)
    old = edges[at]
    wide[:, :DEGREE] = np.where(old == n, -1, old)
    wide[np.repeat(np.arange(len(at)), count), DEGREE + np.arange(len(target)) - np.repeat(first, count)] = source
    have = (wide >= 0).sum(axis=1)
    packed = np.take_along_axis(wide, np.argsort(wide < 0, axis=1, kind="stable"), 1)
    roomy = have <= DEGREE
    edges[at[roomy]] = np.where(packed[roomy, :DEGREE] < 0, n, packed[roomy, :DEGREE])
    # nodes with like numbers of candidates together: the pair distances are quadratic in the widest
    full = np.flatnonzero(~roomy)
    full = full[np.argsort(have[full], kind="stable")]
    for a in range(0, len(full), 256):
        part = full[a : a + 256]
        pruned = robust_prune(vectors, at[part], packed[part, : have[part].max()])
        edges[at[part]] = np.where(pruned < 0, n, pruned)


def _lengthened(vectors: np.ndarray) -> np.ndarray:
    norms = (vectors.astype(np.float64) ** 2).sum(axis=1)
    rest = np.sqrt(np.maximum(0, norms.max() - norms))
    return np.column_stack([vectors, rest]).astype(np.float32)


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(sound & F.exists("v", lambda x: x != 0.0))


def _folded(rows: DataFrame, listed: int) -> DataFrame:
    """``dim, h, v, ids``: per task one row of each distinct vector, with its ``listed`` smallest ids."""

    def run(batches):
        ids: dict[bytes, list[int]] = {}
        for batch in batches:
            for vec_id, v in zip(batch.column("vec_id").to_pylist(), batch.column("v")):
                key = (np.asarray(v.values) + 0.0).tobytes()  # -0.0 is 0.0
                have = ids.setdefault(key, [])
                have.append(vec_id)
                if len(have) > 4 * listed:
                    have[:] = sorted(set(have))[:listed]
        keys = list(ids)
        for a in range(0, len(keys), 5000):
            part = keys[a : a + 5000]
            columns = [
                pa.array([len(k) // 8 for k in part], pa.int32()),
                pa.array(part, pa.binary()),
                pa.array([sorted(set(ids[k]))[:listed] for k in part], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["dim", "v", "ids"])

    return rows.mapInArrow(run, "dim int, v binary, ids array<long>")


def nearest(vectors: DataFrame, query_every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for every row whose id is divisible by ``query_every``."""
    listed = k + 1
    usable = _usable(vectors, id_col, vector_col)
    folded = cut_lineage(_folded(usable, listed), "ann-vectors")
    # rows of a vector in several tasks count once each: shards come out smaller, never larger
    shards = max(1, -(-folded.count() // shard))
    at = F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int")
    graphs = folded.withColumn("shard", at).groupBy("dim", "shard").applyInPandas(
        _shard_graph(listed), "dim int, shard int, vectors binary, edges binary, entry int, ids array<array<long>>"
    )
    graphs = cut_lineage(graphs, "ann-graphs")

    asked = usable.where(F.col("vec_id") % query_every == 0)
    blocks = max(1, -(-asked.count() // QUERIES))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    asked = asked.select("vec_id", "v", F.size("v").alias("dim"), block.alias("block"))
    # the stated query set against all shards, block by block
    sent = asked.join(graphs.select("dim", "shard"), "dim").select("dim", "shard", "block", "vec_id", "v")
    renamed = graphs.select(*[F.col(c).alias(f"g_{c}") for c in graphs.columns])
    spread = renamed.withColumn("g_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = sent.groupBy("dim", "shard", "block").cogroup(spread.groupBy("g_dim", "g_shard", "g_block")).applyInPandas(
        _answers(k), "query_id long, vec_id long, score double"
    )
    # ids that repeat: one row each, best score first
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _shard_graph(listed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids: dict[bytes, list[int]] = {}
        for key, have in zip(pdf["v"], pdf["ids"]):
            ids.setdefault(bytes(key), []).extend(int(i) for i in have)
        keys = sorted(ids)
        original = np.frombuffer(b"".join(keys), np.float64).reshape(len(keys), -1)
        edges, entry = build_graph(_lengthened(original))
        return pd.DataFrame(
            {
                "dim": pdf["dim"].iloc[:1].to_list(),
                "shard": pdf["shard"].iloc[:1].to_list(),
                "vectors": [original.tobytes()],
                "edges": [edges.astype("<i4").tobytes()],
                "entry": [entry],
                "ids": [[sorted(set(ids[x]))[:listed] for x in keys]],
            }
        )

    return run


def _answers(k: int):
    def run(asked: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if asked.empty or graph.empty:
            return empty
        g = graph.iloc[0]
        original = np.frombuffer(g["g_vectors"], np.float64).reshape(-1, int(g["g_dim"]))
        edges = np.frombuffer(g["g_edges"], "<i4").reshape(len(original) + 1, -1)
        longer = _lengthened(original)
        norms = (longer**2).sum(axis=1)
        query_ids = asked["vec_id"].to_numpy()
        queries = np.stack(asked["v"].to_list())
        out = []
        for a in range(0, len(queries), 512):
            part = queries[a : a + 512]
            padded = np.column_stack([part, np.zeros(len(part))]).astype(np.float32)
            near, _ = beam_search(longer, norms, edges, int(g["g_entry"]), padded, SEARCH_BEAM)
            for query_id, q, nodes in zip(query_ids[a : a + 512], part, near):
                nodes = nodes[nodes >= 0]
                scores = (original[nodes] * q).sum(axis=1)
                hits = []
                for j in np.argsort(-scores, kind="stable"):
                    hits += [(query_id, i, scores[j]) for i in g["g_ids"][nodes[j]] if i != query_id]
                    if len(hits) > k and scores[j] < hits[k - 1][2]:
                        break
                out += sorted(hits, key=lambda x: (-x[2], x[1]))[:k]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype(empty.dtypes.to_dict())

    return run
