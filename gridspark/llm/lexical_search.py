"""Best documents for each query item by weighted terms, where documents with equal bags are scored once.

What a score depends on is a document's length class m and how often it holds each term that any item has.  So texts
are reduced to that: the counts of their terms in the items' vocabulary, written in order.  Documents with the same
counts and the same m are one class: they meet by a hash, and the counts themselves are compared.  Every class is
scored once against all items, block by block of items, and only the best classes of each item are opened again, by
ascending doc_id.

The vocabulary reaches the texts as a bit set of fixed width over a hash of the terms.  A term that merely shares a bit
makes classes finer, never wrong.  Ten classes per item are enough: each class before the class of a document, by score
and smallest doc_id, holds a document before it.

Cases: a null text has no terms; a document without terms counts for nothing and is never returned.  Rows of documents
with equal doc_id are documents of their own; a null doc_id comes last among equal scores.  Rows of items with equal
item_id (null included) are one item whose terms add up; an item without terms gets no rows.  Empty tables give no rows.
Only ids and texts are read, so other columns may have any name.
"""

from __future__ import annotations

from collections import Counter
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.session import cut_lineage

TOP = 10
BITS = 1 << 22  # of the vocabulary's bit set: 512 KB
BLOCK_TERMS = 1 << 18  # (item, term) entries that are scored together
BATCH_CELLS = 1 << 21  # scores of classes and items, and terms that enter them, held at once
FLUSH = 1 << 18

#: Every byte of a term, A-Z as a-z; all other bytes as a space.  Bytes of 0x80 and above are letters of terms.
_TERM = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms_of(text: str) -> list[bytes]:
    """The terms of a text as UTF-8."""
    return text.encode().translate(_TERM).split()


def _item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item_id, term, times``: the terms of each item, pre-aggregated per row."""

    def run(batches):
        for batch in batches:
            ids, terms, times = [], [], []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                counted = Counter(terms_of(text or ""))
                ids += [item] * len(counted)
                terms += [t.decode() for t in counted]
                times += counted.values()
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(terms, pa.string()), pa.array(times, pa.int64())], ["item_id", "term", "times"])

    texts = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    counted = texts.mapInArrow(run, "item_id long, term string, times long")
    return counted.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def _bit(term: Column) -> Column:
    return F.crc32(term) % BITS


def _bit_set(terms: DataFrame) -> np.ndarray:
    """One byte per bit position: 1 where a term of the items falls.  At most BITS / 64 rows come to the driver."""
    words = terms.select(_bit(F.col("term")).alias("at")).groupBy(F.floor(F.col("at") / 64).cast("int").alias("word"))
    held = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).toPandas()
    out = np.zeros(BITS // 64, np.int64)
    out[held["word"].to_numpy(np.int64)] = held["bits"].to_numpy(np.int64)
    return np.unpackbits(out.view(np.uint8), bitorder="little")


def _bags(docs: DataFrame, id_col: str, text_col: str, wanted: np.ndarray) -> DataFrame:
    """``doc_id, n, bag``: number of terms and the counts of those in the vocabulary, as ``term:times`` in order."""
    from zlib import crc32

    packed = np.packbits(wanted)

    def run(batches):
        held = np.unpackbits(packed).tobytes()
        for batch in batches:
            sizes, bags = [], []
            for value in batch.column("text"):
                terms = terms_of(value.as_py() or "")
                counted = Counter(terms)
                own = sorted((t, c) for t, c in counted.items() if held[crc32(t) % BITS])
                sizes.append(len(terms))
                bags.append(b" ".join(b"%b:%d" % e for e in own).decode())
            yield pa.record_batch([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(bags, pa.string())], ["doc_id", "n", "bag"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "doc_id long, n long, bag string")


def length_class(total_docs: int, total_terms: int) -> Column:
    """m of a document with ``n`` terms; in decimals, so that the product overflows at no size."""
    product = f"cast(n as decimal(19,0)) * cast({75 * total_docs} as decimal(19,0))"
    return F.expr(f"25 + ({product}) div cast({max(total_terms, 1)} as decimal(19,0))")


def _held_terms(bag: str):
    for entry in bag.split(" ") if bag else ():
        term, _, times = entry.rpartition(":")
        yield term, int(times)


def _document_counts(classes: DataFrame) -> DataFrame:
    """``term, df`` over all documents, from one row per class and its number of members."""

    def run(batches):
        held: Counter[str] = Counter()

        def flushed():
            out = pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["term", "df"])
            held.clear()
            return out

        for batch in batches:
            for bag, members in zip(batch.column("bag").to_pylist(), batch.column("members").to_pylist()):
                for term, _ in _held_terms(bag):
                    held[term] += members
                if len(held) > FLUSH:
                    yield flushed()
        yield flushed()

    found = classes.select("bag", "members").mapInArrow(run, "term string, df long")
    return found.groupBy("term").agg(F.sum("df").alias("df"))


class _Best:
    """The best classes of each item so far: highest score first, then the smallest doc_id."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.least = np.zeros(items, np.int64)  # the score of the last of ``top``, 0 while there are fewer
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, scores: np.ndarray, *classes: np.ndarray) -> None:
        at, item = np.nonzero((scores > 0) & (scores >= self.least))
        self.rows.append((item, scores[at, item], *(c[at] for c in classes)))
        self.waiting += len(at)
        if self.waiting > 4 * self.top * len(self.least) + 4096:
            self.prune()

    def prune(self) -> tuple[np.ndarray, ...]:
        """``item, score, first_doc, h, m`` of the best."""
        rows = [np.concatenate([r[k] for r in self.rows] or [np.empty(0, np.int64)]) for k in range(5)]
        order = np.lexsort((rows[2], -rows[1], rows[0]))
        rows = [r[order] for r in rows]
        item = rows[0]
        begins = np.flatnonzero(np.diff(item, prepend=-1))
        rank = np.arange(len(item)) - np.repeat(begins, np.diff(np.append(begins, len(item))))
        last = rank == self.top - 1
        self.least[item[last]] = rows[1][last]
        kept = tuple(r[rank < self.top] for r in rows)
        self.rows, self.waiting = [kept], len(kept[0])
        return kept


NO_DOC = np.iinfo(np.int64).max


def _best_classes(classes: DataFrame, weights, top: int) -> DataFrame:
    """``item, score, first_doc, h, m`` of each task's best classes; ``weights`` has the rows of one block of items."""
    terms, at = np.unique(weights["term"].to_numpy(object).astype(str), return_inverse=True)
    order = np.argsort(at, kind="stable")
    begins = np.searchsorted(at[order], np.arange(len(terms) + 1))
    names, columns = np.unique(weights["item"].to_numpy(np.int64), return_inverse=True)
    plan = classes.sparkSession.sparkContext.broadcast(
        {"terms": terms.tolist(), "begins": begins, "item": columns[order], "weight": weights["weight"].to_numpy(np.int64)[order], "names": names}
    )

    def run(batches):
        p = plan.value
        number = {t: i for i, t in enumerate(p["terms"])}
        begins, items = p["begins"], len(p["names"])
        sizes = np.diff(begins).tolist()
        best = _Best(items, top)
        most = max(1, BATCH_CELLS // max(1, items))

        def score(row, term, gain, classes):
            row, term, gain = (np.array(x, np.int64) for x in (row, term, gain))
            size = begins[term + 1] - begins[term]
            within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            entry = np.repeat(begins[term], size) + within
            scores = np.zeros((len(classes[0]), items), np.int64)
            np.add.at(scores.reshape(-1), np.repeat(row, size) * items + p["item"][entry], np.repeat(gain, size) * p["weight"][entry])
            best.add(scores, *classes)

        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("first_doc", "h", "m")]
            bags, ms = batch.column("bag").to_pylist(), batch.column("m").to_pylist()
            row, term, gain, begun, cost = [], [], [], 0, 0
            for i, (bag, m) in enumerate(zip(bags, ms)):
                for t, times in _held_terms(bag):
                    if (k := number.get(t)) is not None:
                        row.append(i - begun)
                        term.append(k)
                        gain.append(1_000_000_000 * times // (1000 * times + 8 * m))
                        cost += sizes[k]
                if cost >= BATCH_CELLS or i + 1 - begun >= most or i + 1 == len(bags):
                    score(row, term, gain, [c[begun : i + 1] for c in columns])
                    row, term, gain, begun, cost = [], [], [], i + 1, 0
        item, *found = best.prune()
        arrays = [pa.array(p["names"][item]), *map(pa.array, found)]
        yield pa.RecordBatch.from_arrays(arrays, ["item", "score", "first_doc", "h", "m"])

    read = classes.select(F.coalesce("first_doc", F.lit(NO_DOC)).alias("first_doc"), "h", "m", "bag")
    return read.mapInArrow(run, "item long, score long, first_doc long, h long, m long")


def _weighted(items: DataFrame, counts: DataFrame, total_docs: int) -> DataFrame:
    """``item, item_id, term, weight``: each item's terms with weight times repeats, items numbered by a hash."""

    def run(batches):
        for batch in batches:
            df, times = batch.column("df").to_pylist(), batch.column("times").to_pylist()
            weight = [floor(1000 * log((2 * total_docs + 2) / (2 * d + 1))) * t for d, t in zip(df, times)]
            yield pa.record_batch([batch.column("item_id"), batch.column("term"), pa.array(weight, pa.int64())], ["item_id", "term", "weight"])

    held = items.join(counts, "term")  # a term that no document holds scores nothing
    return held.select("item_id", "term", "df", "times").mapInArrow(run, "item_id long, term string, weight long")


def search(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of each item with a score above 0."""
    spark = docs.sparkSession
    wanted = cut_lineage(_item_terms(items, item_col, item_text), "item-terms")
    bags = cut_lineage(_bags(docs, id_col, text_col, _bit_set(wanted)).where("n > 0"), "bags")
    total_docs, total_terms = bags.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    out = "item_id long, rank int, doc_id long, score long"
    if not total_docs:
        return spark.createDataFrame([], out)
    keyed = bags.select("doc_id", F.xxhash64("bag").alias("h"), length_class(total_docs, total_terms).alias("m"), "bag")
    same = keyed.groupBy("h", "m", "bag").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("members"))
    classes = cut_lineage(same, "bag-classes")
    weighted = cut_lineage(_weighted(wanted, _document_counts(classes), total_docs), "weighted-items")
    # a null item is one item of its own; items are numbered by a hash and dealt into blocks of bounded expected size
    total = weighted.count()
    blocks = max(1, -(-total // block_terms))
    dealt = weighted.withColumn("block", F.pmod(F.xxhash64("item_id", F.col("item_id").isNull()), F.lit(blocks)))
    found = None
    for k in range(blocks):
        rows = dealt.where(F.col("block") == k).select("item_id", "term", "weight").toPandas()
        if not len(rows):
            continue
        ids = rows["item_id"].drop_duplicates().reset_index(drop=True)
        number = {None if v != v else int(v): i for i, v in enumerate(ids)}
        rows["item"] = [number[None if v != v else int(v)] for v in rows["item_id"]]
        names = spark.createDataFrame([(i, v) for v, i in number.items()], "item long, item_id long")
        part = _best_classes(classes, rows, top).join(F.broadcast(names), "item").drop("item")
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], out)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "first_doc"))
    best = found.withColumn("place", place).where(F.col("place") <= top).drop("place")
    # the bags come back only now; (h, m, first_doc) is one class
    named = classes.select("h", "m", F.coalesce("first_doc", F.lit(NO_DOC)).alias("first_doc"), "bag")
    return _expanded(keyed, cut_lineage(best.join(named, ["h", "m", "first_doc"]).drop("first_doc"), "best-classes"), top)


def _expanded(keyed: DataFrame, best: DataFrame, top: int) -> DataFrame:
    """The documents of the best classes, by score and ascending doc_id."""
    chosen = best.select("h", "m", "bag").distinct()
    members = keyed.join(chosen, ["h", "m", "bag"], "left_semi")
    by_doc = Window.partitionBy("h", "m", "bag").orderBy(F.asc_nulls_last("doc_id"))
    few = members.withColumn("place", F.row_number().over(by_doc)).where(F.col("place") <= top).drop("place")
    ranked = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    opened = best.join(few, ["h", "m", "bag"]).withColumn("rank", F.row_number().over(ranked))
    return opened.where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
