"""N-gram Jaccard join with token-combination prefixes, and the groups that its links form.

A text's set holds its distinct word n-grams.  Sets are ordered by (frequent?,
hash), rare tokens first.  A set with enough rare tokens indexes each of the
first ``n - ceil(t n) + 1``: two sets with Jaccard >= t share one of those.
Where the rare ones run out, pairs of neighbouring frequent tokens are indexed
over an extended prefix: two such sets differ in at most ``e`` tokens, so among
the first ``e + 1`` blocks of their merged order (a rare token, or two frequent
ones) one is whole in both.  Which tokens count as frequent only moves work, it
never decides a link; a sketch of all tokens (a fixed 2^SKETCH_BITS counters)
tells, and one bit of it per counter is broadcast.

Equal sets are one node.  A bucket of n nodes is not expanded into pairs: its
smallest node is compared with the others; afterwards only pairs in different
groups matter, and of those the nodes of rank 1 to 63, then 64 to 4095, ... of
the bucket are compared with the later ones, until every bucket lies in one
group or has had all its pairs.  So no link between groups is lost and a bucket of near copies
costs one comparison per node.  Tokens of one passage fill buckets of the very
same nodes; of such buckets one stays, found by their extremes, sizes and two
sums of node hashes.  Only pairs that can link by their sizes and parities get
as far as the sets, be they of a smallest node or from the join that meets
nodes of a bucket: each token flips one bit of a set's PARITY_BITS, so two sets
differ in at least as many tokens as their bits differ.  A pair that shares
many buckets is emitted once by that join: each node knows the FIRST lowest tokens of its open buckets, and where two such lists meet, their
lowest common token is the lowest bucket of the pair.  Sets that may differ in more tokens than these bits can show have a
second parity, about four bits for each such token and 2^WIDE_BITS at most; of
two widths the wider one is folded.  Pairs are then refuted on their prefixes
where these already differ too much; the rest is compared on the whole sets,
each of which meets the smaller node of its pairs in slices of about SLICE nodes.

Cases: null and empty texts have an empty set, are linked with nothing and keep
their own id; a text of fewer words than n is one token.  Rows that repeat an
id are nodes by their texts.  A null id takes part and is never the smallest;
a group of null ids only has a null component.  Only id and text are read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.components import connected
from gridspark.llm.text import may_hold, mix, small_arrow_batches, small_batches, tidy, utf8_views, window_hashes, word_hashes, word_spans
from gridspark.session import cut_lineage

SKETCH_BITS = 22
SKETCH_BLOCKS = 16
WANTED_BITS = 24
COMBINATION = 2
STEP = 64
FIRST = 8
PARITY_BITS = 512
WIDE_BITS = 16
SLICE = 512
_U = np.uint64


@dataclass(frozen=True)
class Rule:
    """Link when ``100 * |x & y| >= percent * |x | y|`` over ``words``-grams."""

    words: int = 4
    percent: int = 85

    def __post_init__(self):
        if not 70 <= self.percent <= 100:
            raise ValueError("the pair blocks are complete from 70 % on")

    def prefix(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1

    def errors(self, n: int) -> int:
        """The most tokens in which a set of ``n`` differs from one that it links with."""
        return (100 - self.percent) * (100 * n // self.percent) // 100


def shingles(buf: np.ndarray, words: int) -> np.ndarray:
    """Sorted distinct n-grams of a text; a shorter text is one token."""
    starts, ends = word_spans(buf)
    if len(starts) == 0:
        return np.empty(0, dtype=_U)
    hashes = word_hashes(buf, starts, ends, fold_case=True)
    if len(hashes) >= words:
        return np.unique(window_hashes(hashes, words))
    return mix(window_hashes(hashes, len(hashes)) + _U(len(hashes)))


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _slots(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> _U(64 - SKETCH_BITS)).astype(np.int64)


def _heads(tokens: np.ndarray) -> np.ndarray:
    """The upper halves: enough to refute a pair, since distinct heads on one side never outnumber the tokens there."""
    return (tokens >> _U(32)).astype(np.uint32)


def _features(texts: DataFrame, rule: Rule) -> DataFrame:
    """``doc_id, text_key, digest, n`` per row, and rows ``block, counts`` of each task's sketch."""
    names = (("doc_id", pa.int64()), ("text_key", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("block", pa.int32()), ("counts", pa.binary()))
    out = pa.schema(names)

    def run(batches):
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in small_batches(batches, "text"):
            sizes, digests = [], []
            for buf in utf8_views(batch.column("text")):
                tokens = shingles(buf, rule.words)
                np.add.at(sketch, _slots(tokens), 1)
                sizes.append(len(tokens))
                digests.append(_digest(tokens))
            empty = pa.nulls(len(sizes))
            known = [batch.column("doc_id"), batch.column("text_key")]
            columns = [*known, pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), empty.cast(pa.int32()), empty.cast(pa.binary())]
            yield pa.record_batch(columns, schema=out)
        if not sketch.any():
            return
        for block, part in enumerate(np.split(sketch, SKETCH_BLOCKS)):
            row = [[None], [None], [None], [None], [block], [zlib.compress(part.tobytes(), 1)]]
            yield pa.record_batch([pa.array(v, f.type) for v, f in zip(row, out)], schema=out)

    rows = texts.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(tidy(run), "doc_id long, text_key long, digest binary, n long, block int, counts binary")


def _frequent_bits(sketches: DataFrame, total: int) -> np.ndarray:
    """One flag per counter: it stands well above the mean of all counters."""
    mean = total / (1 << SKETCH_BITS)
    limit = mean + 8 * math.sqrt(mean) + 16

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                part = np.frombuffer(zlib.decompress(counts), np.uint32).astype(np.int64)
                sums[block] = sums[block] + part if block in sums else part
        for block, counts in sums.items():
            bits = np.packbits(counts > limit).tobytes()
            yield pa.record_batch([pa.array([block], pa.int32()), pa.array([bits], pa.binary())], names=["block", "bits"])

    merged = sketches.repartition(SKETCH_BLOCKS, "block").mapInArrow(tidy(run), "block int, bits binary")
    flags = np.zeros((SKETCH_BLOCKS, (1 << SKETCH_BITS) // SKETCH_BLOCKS), bool)
    for row in merged.collect():  # SKETCH_BLOCKS rows, 2^SKETCH_BITS bits together
        flags[row["block"]] = np.unpackbits(np.frombuffer(row["bits"], np.uint8)).astype(bool)
    return flags.ravel()


def parity(tokens: np.ndarray, bits: int = PARITY_BITS) -> np.ndarray:
    """Bit i tells whether an odd number of tokens fall on i, in words of 64 bits."""
    odd = np.bincount((tokens % _U(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def wide_parity(tokens: np.ndarray, rule: Rule) -> np.ndarray | None:
    """The parity of a set for which PARITY_BITS are too few to tell a stranger; None for others."""
    bits = 1 << min(WIDE_BITS, (4 * rule.errors(len(tokens))).bit_length())
    return parity(tokens, bits) if bits > PARITY_BITS else None


def prefix_tokens(tokens: np.ndarray, frequent: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """What a set is indexed under, and its first tokens in the common order."""
    n = len(tokens)
    often = frequent[_slots(tokens)]
    rare, common = tokens[~often], tokens[often]
    p = rule.prefix(n)
    first = np.concatenate([rare, common])[: 2 * p]
    if len(rare) >= p:
        return rare[:p], first
    reach = COMBINATION * (rule.errors(n) + 1 - len(rare))
    run = common[: max(0, reach)]
    pairs = mix(run[:-1] * _U(0x9E3779B97F4A7C15) + mix(run[1:]))
    return np.concatenate([rare, pairs]), first


def _prefixes(texts: DataFrame, rule: Rule, bits) -> DataFrame:
    """``doc_id, digest, n, tokens, first, parity, wide``: index tokens, the leading part of the ordered set and its parities."""
    longs = pa.list_(pa.int64())
    names = (("doc_id", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("tokens", longs), ("first", pa.binary()), ("parity", longs), ("wide", longs))
    out = pa.schema(names)

    def run(batches):
        frequent = np.unpackbits(np.frombuffer(bits.value, np.uint8)).astype(bool)
        for batch in small_batches(batches, "text"):
            rows = []
            for doc, buf in zip(batch.column("doc_id").to_pylist(), utf8_views(batch.column("text"))):
                tokens = shingles(buf, rule.words)
                if len(tokens):
                    index, first = prefix_tokens(tokens, frequent, rule)
                    known = doc, _digest(tokens), len(tokens), np.unique(index).view(np.int64)
                    rows.append((*known, _heads(first).tobytes(), parity(tokens), wide_parity(tokens, rule)))
            columns = list(zip(*rows)) if rows else [[]] * len(out)
            yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, out)], schema=out)

    return texts.mapInArrow(tidy(run), "doc_id long, digest binary, n long, tokens array<long>, first binary, parity array<long>, wide array<long>")


def _wanted_bits(ids: DataFrame) -> np.ndarray:
    """One bit per slot of crc32(id): some wanted id falls there.  2^WANTED_BITS bits, whatever the number of ids."""
    width = (1 << WANTED_BITS) // SKETCH_BLOCKS

    def run(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot in batch.column("slot").to_pylist():
                found.setdefault(slot // width, np.zeros(width, bool))[slot % width] = True
        for block, flags in found.items():
            yield pa.record_batch([pa.array([block], pa.int32()), pa.array([np.packbits(flags).tobytes()], pa.binary())], names=["block", "bits"])

    slots = ids.select((F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % (1 << WANTED_BITS)).alias("slot")).distinct()
    by_block = slots.withColumn("block", F.floor(F.col("slot") / width)).repartition(SKETCH_BLOCKS, "block").select("slot")
    flags = np.zeros((SKETCH_BLOCKS, width), bool)
    for row in by_block.mapInArrow(tidy(run), "block int, bits binary").collect():  # SKETCH_BLOCKS rows
        flags[row["block"]] = np.unpackbits(np.frombuffer(row["bits"], np.uint8)).astype(bool)
    return np.packbits(flags.ravel())


def _sets(texts: DataFrame, rule: Rule, wanted) -> DataFrame:
    """Whole sets of the rows whose id falls in a wanted slot; the rest costs one look at its id."""
    out = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("set", pa.binary())])

    def run(batches):
        bits = np.unpackbits(np.frombuffer(wanted.value, np.uint8)).astype(bool)
        for batch in small_batches(batches, "text"):
            ids = batch.column("doc_id").to_pylist()
            slots = [zlib.crc32(b"" if i is None else str(i).encode()) % (1 << WANTED_BITS) for i in ids]
            chosen = batch.filter(pa.array(bits[slots] if slots else [], pa.bool_()))
            sets = [shingles(buf, rule.words) for buf in utf8_views(chosen.column("text"))]
            columns = [chosen.column("doc_id"), pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.record_batch(columns, schema=out)

    return texts.mapInArrow(tidy(run), "doc_id long, digest binary, set binary")


def _refuted(first_a: bytes, first_b: bytes, n_a: int, n_b: int, frequent: np.ndarray, rule: Rule) -> bool:
    """The leading tokens alone differ in more places than a link allows."""

    def ordered(first: bytes) -> np.ndarray:
        heads = np.frombuffer(first, np.uint32).astype(np.int64)
        return heads + (frequent[heads >> (32 - SKETCH_BITS)].astype(np.int64) << 32)

    a, b = ordered(first_a), ordered(first_b)
    end = min(a[-1], b[-1])
    a, b = a[a <= end], b[b <= end]
    return len(np.setxor1d(a, b)) > min(rule.errors(n_a), rule.errors(n_b))


def _possible(pairs: DataFrame, firsts: DataFrame, rule: Rule, bits) -> DataFrame:
    """The pairs that their leading tokens do not refute."""

    def run(batches):
        frequent = np.unpackbits(np.frombuffer(bits.value, np.uint8)).astype(bool)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("first_a", "first_b", "n_a", "n_b")]
            keep = pa.array([not _refuted(*row, frequent, rule) for row in zip(*columns)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    # only the leading tokens of nodes that may be in a pair are shuffled
    ends = pairs.select(F.col("a").cast("string").cast("binary").alias("end")).union(pairs.select(F.col("b").cast("string").cast("binary")))
    firsts = may_hold(firsts.withColumn("end", F.col("node").cast("string").cast("binary")), ends, "end", "met").where("met")
    side_a = firsts.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("first").alias("first_a"))
    side_b = firsts.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("first").alias("first_b"))
    fits = (100 * F.col("n_a") >= rule.percent * F.col("n_b")) & (100 * F.col("n_b") >= rule.percent * F.col("n_a"))
    return pairs.join(side_a, "a").join(side_b, "b").where(fits).mapInArrow(tidy(run), "a long, b long")


def _sends(pairs: DataFrame) -> DataFrame:
    """``node, a, slice``: the meetings of each node of the pairs ``a, b`` (a < b); about SLICE nodes meet ``a`` in a slice, to which ``a`` itself goes too."""
    slices = pairs.groupBy("a").agg(F.ceil(F.count("*") / SLICE).alias("slices"))
    dealt = pairs.join(slices, "a").select(F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), F.col("slices")).alias("slice"))
    leads = slices.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"))
    return dealt.union(leads)


def _links(meetings: DataFrame, rule: Rule) -> DataFrame:
    """The pairs ``a, b`` whose whole sets link, from rows ``a, slice, node, set``."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        at, lead = None, None
        for batch in batches:
            found = []
            for a, part, node, data in zip(batch.column("a").to_pylist(), batch.column("slice").to_pylist(), batch.column("node").to_pylist(), batch.column("set")):
                tokens = np.frombuffer(data.as_buffer(), _U)
                if node == a:  # the smallest node of its slices, so it comes first
                    at, lead = (a, part), tokens.copy()
                    continue
                if at != (a, part):
                    raise RuntimeError("a slice came without its first set")
                shared = len(np.intersect1d(lead, tokens, assume_unique=True))
                if 100 * shared >= rule.percent * (len(lead) + len(tokens) - shared):
                    found.append((a, node))
            columns = list(zip(*found)) if found else [[], []]
            yield pa.record_batch([pa.array(list(c), pa.int64()) for c in columns], schema=out)

    dealt = meetings.repartition("a", "slice").sortWithinPartitions("a", "slice", "node")
    return dealt.mapInArrow(tidy(run), "a long, b long")


def jaccard_groups(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_key, n, root, lowest`` per row; rows of one root are linked, the smallest id there is ``lowest``; a row without words has none."""
    with small_arrow_batches(docs.sparkSession):  # every stage that reads texts runs in here
        return _grouped(docs, rule, id_col, text_col)


def _grouped(docs: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = cut_lineage(_features(texts, rule), "jaccard-features")
    members = rows.where(F.col("block").isNull()).select("doc_id", "text_key", "digest", "n")
    total = members.agg(F.sum("n").alias("total")).first()["total"] or 0
    frequent = _frequent_bits(rows.where(F.col("block").isNotNull()).select("block", "counts"), total)
    bits = spark.sparkContext.broadcast(np.packbits(frequent).tobytes())

    # one node per distinct set, numbered once and written
    nodes = members.where(F.col("n") > 0).groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    nodes = cut_lineage(nodes.withColumn("node", F.monotonically_increasing_id()), "jaccard-nodes")
    # the id without its nulls, so that the join's partitions serve to take each node once, however often its row is repeated
    place = [F.coalesce("doc_id", F.lit(0)).alias("id0"), F.col("doc_id").isNull().alias("no_id"), "digest"]
    found = _prefixes(texts, rule, bits).select(*place, "n", "tokens", "first", "parity", "wide").join(nodes.select("node", *place), ["id0", "no_id", "digest"])
    found = found.dropDuplicates(["id0", "no_id", "digest"])
    prefixes = cut_lineage(found.select("node", "n", "tokens", "first", "parity", "wide"), "jaccard-prefixes")

    # dealt once by token: the bounds of a bucket and its rows come from the same exchange
    index = prefixes.select("node", F.explode("tokens").alias("token")).where(F.col("token").isNotNull()).repartition("token")
    marks = F.bit_xor(F.xxhash64("node")).alias("mark"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("mark1")
    buckets = index.groupBy("token").agg(F.min("node").alias("hub"), F.max("node").alias("top"), F.count("*").alias("size"), *marks)
    # of the buckets that hold the same nodes one stays
    buckets = buckets.where("hub < top").groupBy("hub", "top", "size", "mark", "mark1").agg(F.min("token").alias("token"))
    shared = cut_lineage(index.join(buckets, "token").select("token", "node", "hub"), "jaccard-buckets")
    firsts = prefixes.select("node", "n", "first")
    traits = prefixes.select("node", "n", "parity", "wide")
    pairs = _fitting(shared.where("node > hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), traits, rule)
    with_node = nodes.select("node", "doc_id", "digest")

    def verified(pairs: DataFrame) -> DataFrame | None:
        pairs = cut_lineage(pairs, "jaccard-pairs")
        possible = cut_lineage(_possible(pairs, firsts, rule, bits), "jaccard-possible")
        if possible.isEmpty():
            return None
        sends = cut_lineage(_sends(possible).join(with_node, "node"), "jaccard-sends")
        slots = spark.sparkContext.broadcast(_wanted_bits(sends.select("doc_id")).tobytes())
        # one exchange by id and digest serves to take each set once and to meet its sends, one brings a slice together
        chosen = _sets(texts, rule, slots).select(*place, "set").dropDuplicates(["id0", "no_id", "digest"])
        meetings = chosen.join(sends.select("node", "a", "slice", *place), ["id0", "no_id", "digest"])
        return cut_lineage(_links(meetings.select("a", "slice", "node", "set"), rule), "jaccard-links")

    groups = nodes.select("node", F.col("node").alias("root")).limit(0)
    low, high = 0, 1
    while True:
        links = verified(pairs)
        if links is not None:
            # links between the groups so far join them; a group's root is its smallest node
            moved = _rooted(_rooted(links, "a", groups), "b", groups)
            merged = connected(moved)
            joined = groups.select("node", F.col("root").alias("at")).union(merged.select("node", F.col("node").alias("at")))
            joined = joined.groupBy("node").agg(F.min("at").alias("root"))
            groups = cut_lineage(_rooted(joined, "root", merged), "jaccard-groups")
        low, high = high, high * STEP
        open_rows = _open(shared, groups, traits, low)
        if open_rows is None:
            break
        pairs = _between(open_rows, low, high, rule)

    rooted = nodes.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = rooted.groupBy("root").agg(F.min("doc_id").alias("lowest"))
    rooted = rooted.join(lowest, "root").select("digest", "root", "lowest")
    return members.join(rooted, "digest", "left").select("doc_id", "text_key", "n", "root", "lowest")


def jaccard_components(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row; the component is the smallest id reachable by links."""
    found = jaccard_groups(docs, rule, id_col, text_col)
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("lowest"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, rule: Rule = Rule(5, 80), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group, that of the smallest id (null last); rows without words all stay."""
    groups = jaccard_groups(docs, rule, id_col, text_col).where(F.col("root").isNotNull())
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    chosen = groups.groupBy("root").agg(first).select(F.col("first.doc_id").alias("__id"), F.col("first.text_key").alias("__key"))
    chosen = cut_lineage(chosen, "jaccard-chosen")
    has_words = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.where(has_words).withColumn("__text", F.xxhash64(text_col))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__key"))
    kept = keyed.join(chosen, same, "left_semi")
    # equal rows are one group as well
    order = Window.partitionBy(F.col(id_col), "__text").orderBy(F.lit(0))
    kept = kept.withColumn("__place", F.row_number().over(order)).where("__place = 1").drop("__place", "__text")
    return kept.unionByName(docs.where(~has_words))


def _rooted(rows: DataFrame, column: str, groups: DataFrame) -> DataFrame:
    """``rows`` with the nodes of ``column`` replaced by the roots of their groups."""
    up = groups.select(F.col("node").alias(column), F.col("root").alias("__root"))
    return rows.join(up, column, "left").withColumn(column, F.coalesce("__root", column)).drop("__root")


def _open(shared: DataFrame, groups: DataFrame, traits: DataFrame, done: int) -> DataFrame | None:
    """Rows of the buckets that hold several groups and still have uncompared pairs, with each node's rank, traits and first buckets; None if none."""
    rows = shared.select("token", "node").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rows.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("size"))
    mixed = mixed.where((F.col("r0") < F.col("r1")) & (F.col("size") > done + 1)).select("token")
    ranked = rows.join(mixed, "token").withColumn("rank", F.row_number().over(Window.partitionBy("token").orderBy("node")) - 1)
    ranked = cut_lineage(_with_first(ranked).join(traits, "node"), "jaccard-open")
    return None if ranked.isEmpty() else ranked


def _with_first(rows: DataFrame) -> DataFrame:
    """``rows`` with the FIRST lowest tokens of each node and its ranks in those buckets."""
    place = F.row_number().over(Window.partitionBy("node").orderBy("token"))
    first = F.collect_list(F.when(F.col("place") <= FIRST, F.struct("token", "rank"))).over(Window.partitionBy("node"))
    found = rows.withColumn("place", place).withColumn("first", first)
    return found.select(*rows.columns, F.col("first.token").alias("lowest"), F.col("first.rank").alias("ranks"))


def _wide_difference(x: str, y: str) -> Column:
    """Bits in which two wide parities differ, the wider one folded to the other's width; null if one is missing."""
    words = F.least(F.size(x), F.size(y))

    def folded(name: str) -> Column:
        def word(i: Column) -> Column:
            places = F.sequence(i, F.size(name) - 1, words)
            return F.aggregate(places, F.lit(0).cast("long"), lambda total, j: total.bitwiseXOR(F.get(F.col(name), j)))

        return F.when(F.size(name) == words, F.col(name)).otherwise(F.transform(F.sequence(F.lit(0), words - 1), word))

    odd = F.zip_with(folded(x), folded(y), lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    counted = F.aggregate(odd, F.lit(0), lambda total, bits: total + bits)
    return F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), counted)


def _same_size(rule: Rule) -> Column:
    """Sets of ``n_a`` and ``n_b`` tokens can link by their sizes."""
    return (100 * F.col("n_a") >= rule.percent * F.col("n_b")) & (100 * F.col("n_b") >= rule.percent * F.col("n_a"))


def _alike(rule: Rule) -> Column:
    """Sets of ``n_a, parity_a, wide_a`` and ``n_b, ...`` can link by their parities: no more bits differ than a link allows tokens."""
    words = range(PARITY_BITS // 64)
    differ = sum((F.bit_count(F.col("parity_a")[i].bitwiseXOR(F.col("parity_b")[i])) for i in words), F.lit(0))
    allowed = F.expr(f"({100 - rule.percent} * ((100 * least(n_a, n_b)) div {rule.percent})) div 100")
    stranger = F.coalesce(_wide_difference("wide_a", "wide_b") > allowed, F.lit(False))
    return (differ <= allowed) & ~stranger


def _fitting(pairs: DataFrame, traits: DataFrame, rule: Rule) -> DataFrame:
    """The pairs ``a, b`` that can link by their sizes and parities; only pairs of fitting sizes meet parities."""

    def met(pairs: DataFrame, *columns: str) -> DataFrame:
        for end in "ab":  # every column renamed, so that both ends share one exchange
            pairs = pairs.join(traits.select(F.col("node").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in columns)), end)
        return pairs

    sized = met(pairs, "n").where(_same_size(rule)).select("a", "b")
    return met(sized, "n", "parity", "wide").where(_alike(rule)).select("a", "b")


def _between(rows: DataFrame, low: int, high: int, rule: Rule) -> DataFrame:
    """Distinct pairs of different groups that can link, with the bucket's nodes of rank ``low`` to ``high`` - 1 on one side."""
    return _meetings(rows, low, high, rule).distinct()


def _meetings(rows: DataFrame, low: int, high: int, rule: Rule) -> DataFrame:
    """These pairs; one whose lists of lowest buckets do not meet comes from each bucket that it shares."""
    lead = rows.where((F.col("rank") >= low) & (F.col("rank") < high))
    # of a node's lowest buckets, only those below the row's own can tell that another one emits the pair; a lead needs those in which it leads
    led = F.filter("lowest", lambda token, i: (token < F.col("token")) & (F.get("ranks", i) >= low) & (F.get("ranks", i) < high))
    known = "node", "root", "rank", "n", "parity", "wide"
    lead = lead.select("token", led.alias("led"), *(F.col(c).alias(f"{c}_a") for c in known))
    lower = F.filter("lowest", lambda token: token < F.col("token"))
    later = rows.select("token", lower.alias("lower"), *(F.col(c).alias(f"{c}_b") for c in known))
    uncompared = (F.col("rank_b") > F.col("rank_a")) & (F.col("root_b") != F.col("root_a"))
    # a lower bucket that both lists name has the pair as well: there, too, the smaller node leads
    elsewhere = F.arrays_overlap("lower", "led")
    both = later.join(lead, "token").where(uncompared & _same_size(rule) & _alike(rule) & ~elsewhere)
    return both.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
