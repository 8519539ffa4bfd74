"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

A source's target is a share of all words by weight, at most ``max_epochs``
times its own words; what a full source leaves is reshared by weight among the
others.  Whole epochs take every document; the rest of the target is filled
with the documents of smallest key ``-ln(u) / quality`` (``u`` a hash of the id),
summed in that order until the budget is reached.  The document at the budget
is taken when that brings the sum nearer.

Only the bucket of keys in which a source's budget ends needs an order.  Keys
are cut into ``BUCKETS`` ranges and each of those into as many again; both
levels are partial sums, so a source with a third of all rows never meets in
one task: a window sorts about a millionth of it.

Rows that are equal in id and text have equal keys.  Where the budget ends among
them, the plan says how many of them come in, and a number that every row gets as
it is read picks them: the partitions before the border's as a whole, a prefix
inside it.

Cases: null texts have size 0 and are taken 0 times; a null source is a source
of its own, last in order; of equal rows at the border any may be taken, which
gives equal results; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.text import unit_interval
from gridspark.session import cut_lineage

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BUCKETS = 1024
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Number of words; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(size: Column, chars: Column) -> Column:
    """Between 0.1 and 1: how near the mean length of a word with its space is to 6.5 characters."""
    mean = chars.cast("double") / F.greatest(size, F.lit(1)).cast("double")
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), 1.0 - F.abs(mean - 6.5) / 10.0))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``src, source_size, target`` from ``src, source_size`` (one row per source).

    With cap ``c`` and weight ``w``, sources are filled in the order of c / w; one
    is full when it gets no more than its share of what the fuller ones leave.
    """
    everything = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.col("src").isNull(), "src")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("w", weight.cast("long")).withColumn("cap", F.lit(max_epochs) * F.col("source_size"))
    filled = Window.orderBy(F.col("cap").cast("double") / F.col("w"), F.col("src").isNull(), "src")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight_left = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    rows = rows.withColumn("rest", rest).withColumn("weight_left", weight_left)
    rows = rows.withColumn("full", F.col("cap") * F.col("weight_left") <= F.col("rest") * F.col("w"))
    # the first source that is not full has the most weight left and fixes the share of all that are not
    level = F.max(F.when(~F.col("full"), F.struct("weight_left", "rest"))).over(everything)
    share = (level["rest"] * F.col("w")).cast("double") / level["weight_left"].cast("double")
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share)
    return rows.select("src", "source_size", target.alias("target"))


def _cut(rows: DataFrame, by: list[str], bucket: str) -> DataFrame:
    """The bucket of each source in which the budget ends, with the words before it."""
    sums = rows.groupBy(*by, "budget", bucket).agg(F.sum("size").alias("words"))
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    return sums.where((F.col("before") < F.col("budget")) & (F.col("before") + F.col("words") >= F.col("budget"))).select(
        *by, F.col(bucket).alias("cut"), F.col("before").alias("spent")
    )


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, buckets: int) -> DataFrame:
    """``docs`` with the size, the sampling key and the two buckets of every row."""
    size = size_of(F.col(text_col))
    weight = quality_weight(F.col("__size"), F.coalesce(F.length(text_col), F.lit(0)))
    # 1 - exp(-key) is monotone in the key and lies in [0, 1): its leading digits are the two levels of buckets
    even = (1 - F.exp(-F.col("__key"))) * buckets
    second = (F.col("__even") - F.floor("__even")) * buckets
    return (
        docs.withColumn("__size", size)
        .withColumn("__key", -F.log(unit_interval(F.col(id_col), "mix")) / weight)
        .withColumn("__even", even)
        .withColumn("__b1", F.least(F.floor("__even"), F.lit(buckets - 1)).cast("int"))
        .withColumn("__b2", F.least(F.floor(second), F.lit(buckets - 1)).cast("int"))
        .withColumn("__src", F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")))
        .withColumn("__at", F.struct(F.col("__key"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text")))
        .withColumn("__row", F.monotonically_increasing_id())
        .drop("__even")
    )


def plan_mix(keyed: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """One row per source: its size, target, whole epochs, and where its keys are cut."""
    names = F.when(F.col("__src") != "", F.substring("__src", 2, 1 << 30)).alias("src")
    sizes = keyed.groupBy("__src").agg(F.sum("__size").alias("source_size")).select(names, "source_size")
    targets = source_targets(sizes, weights, max_epochs)
    ratio = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = targets.withColumn("epochs", F.least(ratio, F.lit(max_epochs)).cast("long"))
    plan = plan.withColumn("budget", F.col("target") - (F.col("epochs") * F.col("source_size")).cast("double"))
    plan = cut_lineage(plan.withColumn("__src", F.coalesce(F.concat(F.lit("="), "src"), F.lit(""))).drop("src"), "mix-plan")

    rows = keyed.select("__src", "__b1", "__b2", "__at", F.col("__size").alias("size"))
    active = rows.join(plan.where(F.col("budget") > 0).select("__src", "budget"), "__src")
    cut1 = _cut(active, ["__src"], "__b1").withColumnsRenamed({"cut": "cut1", "spent": "spent1"})
    cut1 = cut_lineage(cut1, "mix-cut1")
    inside = active.join(cut1, "__src").where(F.col("__b1") == F.col("cut1")).withColumn("budget", F.col("budget") - F.col("spent1"))
    cut2 = _cut(inside, ["__src"], "__b2").withColumnsRenamed({"cut": "cut2", "spent": "spent2"})
    cut2 = cut_lineage(cut2, "mix-cut2")
    last = inside.join(cut2, "__src").where(F.col("__b2") == F.col("cut2"))
    # equal rows count as one step of the order, so a window sorts distinct keys only
    steps = last.groupBy("__src", "__at").agg(
        F.count(F.lit(1)).alias("rows"), F.max("size").alias("size"), F.max(F.col("budget") - F.col("spent2")).alias("left")
    )
    order = Window.partitionBy("__src").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("before", F.coalesce(F.sum(F.col("rows") * F.col("size")).over(order), F.lit(0)))
    # the document at the budget comes in when more than half of it lies below: before + k * size - size / 2 < left
    fits = F.ceil((F.col("left") - F.col("before")) / F.greatest(F.col("size"), F.lit(1)) + 0.5) - 1
    steps = steps.withColumn("fits", F.least(F.when(F.col("size") > 0, fits).otherwise(F.col("rows")), F.col("rows")).cast("long"))
    chosen = steps.where((F.col("fits") > 0) & (F.col("before") - F.col("size") / 2.0 < F.col("left")))
    end = F.max(F.struct("__at", "fits", "rows")).alias("end")
    border = chosen.groupBy("__src").agg(end).select("__src", F.col("end.__at").alias("border"), "end.fits", "end.rows")
    border = cut_lineage(border, "mix-border")
    cuts = cut1.select("__src", "cut1").join(cut2.select("__src", "cut2"), "__src").join(border.drop("fits", "rows"), "__src", "left")
    cuts = cuts.join(_last_row(keyed, border.where("fits < rows")), "__src", "left")
    return cut_lineage(plan.join(cuts, "__src", "left"), "mix-ends")


def _last_row(keyed: DataFrame, border: DataFrame) -> DataFrame:
    """``__src, last_row``: the number of the last row to take among the equal ones at the border, where only some fit."""
    at_border = keyed.select("__src", "__at", "__row").join(border.withColumnRenamed("border", "__at"), ["__src", "__at"])
    part = F.shiftright("__row", 33)  # the partition a row was numbered in
    counts = at_border.groupBy("__src", "fits", part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("__src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    ends = counts.where((F.col("before") < F.col("fits")) & (F.col("before") + F.col("n") >= F.col("fits")))
    ends = ends.select("__src", "part", (F.col("fits") - F.col("before")).alias("take"))
    inside = at_border.select("__src", "__row", part.alias("part")).join(ends, ["__src", "part"])
    numbered = inside.withColumn("k", F.row_number().over(Window.partitionBy("__src", "part").orderBy("__row")))
    return numbered.where("k = take").select("__src", F.col("__row").alias("last_row"))


def copies(max_epochs: int) -> Column:
    """How often the mix takes a row of ``_keyed`` joined with its source's plan."""
    early = (F.col("__b1") < F.col("cut1")) | ((F.col("__b1") == F.col("cut1")) & (F.col("__b2") < F.col("cut2")))
    at_cut = (F.col("__b1") == F.col("cut1")) & (F.col("__b2") == F.col("cut2"))
    among = F.col("last_row").isNull() | (F.col("__row") <= F.col("last_row"))
    upto = (F.col("__at") < F.col("border")) | ((F.col("__at") == F.col("border")) & among)
    extra = F.coalesce(early | (at_cut & F.coalesce(upto, F.lit(False))), F.lit(False))
    return F.least(F.col("epochs") + extra.cast("long"), F.lit(max_epochs).cast("long"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` per row; ``taken`` counts words, repeats included."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    keyed = cut_lineage(_keyed(narrow, "doc_id", "text", "source", buckets).drop("text", "source"), "mix-keys")
    rows = keyed.join(plan_mix(keyed, weights, max_epochs), "__src")
    return rows.select("doc_id", F.col("__size").alias("size"), "source_size", "target", (F.col("__size") * copies(max_epochs)).alias("taken"))


def mix_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """The mix itself: every column of ``docs``, each row as often as it is taken (texts without words never).

    The plan is one row per source, so the texts are repeated where they are read.
    """
    keyed = _keyed(docs, id_col, text_col, source_col, buckets)
    small = cut_lineage(keyed.select("__src", "__b1", "__b2", "__at", "__size", "__row"), "mix-keys")
    rows = keyed.join(plan_mix(small, weights, max_epochs), "__src")
    times = F.when(F.col("__size") > 0, copies(max_epochs)).otherwise(0).cast("int")
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.array_repeat(F.lit(1), times)).alias("__copy")).drop("__copy")
