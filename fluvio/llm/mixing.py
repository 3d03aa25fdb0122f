"""Mixing sources to target weights by entropy balancing; DataFrame operations only.

Of all rates w >= 0 of documents that give every source its target number of
words, the one nearest to the base rates q in relative entropy (each document
counting once) and not above ``cap`` is the exponential tilt
``w = min(cap, q * exp(lambda * u))``, where lambda is the dual variable of the
source's constraint and u a document's size over the source's mean. So a source
that is to grow takes its long documents more often than its short ones, and
one that is to shrink keeps its short ones. Documents of one size class (16 to
a doubling) have its mean as their size here, and so one rate. Newton's method
solves the dual: every step is one aggregate over (source, size class) cells
giving gradient and curvature, joined back to the sources, and stays between
the bounds found so far. The rates are then rounded into whole copies.

Rounding keeps each source near its target: from the largest size class of a
source down, a class gets the whole number of copies nearest to the words its
rates ask for plus what larger classes left over, and deals them evenly over
its documents in hash order. Ranks are counted without holding a source in one
task: counts of small cells (source, size class, hash bucket) are cumulated
and only inside a cell are rows numbered.

Defined results: null text has size 0; a null source is a source of its own,
the last; a source without words has target 0 and its documents rate 0;
repeated rows are rounded each, the copies of the group depend on the rows
only; an empty table gives an empty result; further columns play no part in the
choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluvio.llm.common import WORD, need, table, write_table

#: Hash buckets of a size class of a source.
BUCKETS = 256
#: Size classes for a doubling of the size.
CLASSES = 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running(df: DataFrame, order: list[Column], sums: list[str], name: str) -> DataFrame:
    """``df`` with ``nth`` (from 0) and, for each column of ``sums``, ``before_<column>``, its sum over the rows before.

    Rows are dealt in ranges of ``order``; only a row for a range is cumulated in one task.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    ranged = write_table(ranged, name)
    inside = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = ranged.groupBy("_range").agg(F.count("*").alias("_rows"), *[F.sum(c).alias(f"_all_{c}") for c in sums])
    whole = whole.select("_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_b{c}") for c in ("_rows", *[f"_all_{c}" for c in sums])])
    out = ranged.withColumn("_n", F.count("*").over(inside)).withColumns({f"_s_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums}).join(whole, "_range")
    return out.select(*df.columns, (F.col("_n") + F.col("_b_rows")).alias("nth"), *[(F.col(f"_s_{c}") + F.col(f"_b_all_{c}")).alias(f"before_{c}") for c in sums])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """``source, source_size, target`` from rows ``source, size``.

    Sources in code point order (null last) weigh ``weights``, repeating, and
    share all words; a target stops at ``cap`` times its source's size and the
    excess is shared again. Those that stop are the ones with the least
    cap-to-weight ratio, so one cumulated sum over the ordered sources finds the
    level that the others share.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = running(total, [F.col("source").isNull(), F.col("source")], [], "mixing-named")
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    s = named.withColumn("weight", F.element_at(kinds, (F.col("nth") % len(weights) + 1).cast("int"))).drop("nth")
    s = s.withColumn("most", F.col("source_size") * float(cap)).withColumn("ratio", F.col("most") / F.col("weight"))
    s = running(s, [F.col("ratio"), F.col("source").isNull(), F.col("source")], ["most", "weight"], "mixing-ratios")
    all_ = s.agg(F.sum("source_size"), F.sum("weight")).first()
    s = s.withColumn("level", (F.lit(float(all_[0] or 0)) - F.col("before_most")) / (F.lit(float(all_[1] or 1)) - F.col("before_weight")))
    # The first source whose ratio reaches its level sets the level of all after it.
    first = s.where("ratio >= level").agg(F.min(F.struct("ratio", "level")).alias("m")).first().m
    level = F.lit(first.level) if first else F.col("level")
    return s.select("source", "source_size", F.least("most", level * F.col("weight")).alias("target"))


def solve_dual(cells: DataFrame, targets: DataFrame, cap: float = 3.0, steps: int = 200, tolerance: float = 1e-12) -> DataFrame:
    """``targets`` with ``dual``: per source the lambda at which ``sum(size * min(cap, base * exp(lambda * u)))`` is the target.

    ``cells`` has ``source, base, size`` and ``u`` (1 if absent; all above 0),
    pre-aggregated. A source whose target is ``cap`` times its size gets the
    least lambda at which all its rates are at the cap. Newton's step is taken
    where it stays between the bounds known so far, else their middle, or four
    times as far while there is no bound.
    """
    cells = cells if "u" in cells.columns else cells.withColumn("u", F.lit(1.0))
    cells = write_table(cells.where("size > 0"), "mixing-cells")
    top = cells.groupBy("source").agg(F.max(F.log(F.lit(cap) / F.col("base")) / F.col("u")).alias("top"), F.sum("size").alias("all")).withColumnRenamed("source", "s")
    state = targets.join(top, F.col("source").eqNullSafe(F.col("s")), "left")
    full = F.col("target") >= F.col("all") * cap * (1 - tolerance)
    live = (F.col("target") > 0) & F.col("all").isNotNull()
    state = state.select("source", "source_size", "target", F.when(live, F.when(full, F.col("top")).otherwise(F.lit(0.0))).alias("dual"),
                         F.lit(None).cast("double").alias("low"), F.when(live, F.col("top")).alias("high"), (~live | full).alias("done"))
    state = write_table(state, "mixing-dual")
    for step in range(steps):
        open_ = state.where(~F.col("done"))
        if not open_.limit(1).count():
            return state.select("source", "source_size", "target", "dual")
        rate = F.col("base") * F.exp(F.col("dual") * F.col("u"))
        now = open_.select(F.col("source").alias("s"), "dual")
        at = cells.join(now, cells.source.eqNullSafe(now.s)).groupBy("s").agg(
            F.sum(F.col("size") * F.least(F.lit(cap), rate)).alias("got"), F.sum(F.when(rate < cap, F.col("size") * rate * F.col("u")).otherwise(0.0)).alias("slope"))
        j = state.join(at, state.source.eqNullSafe(at.s), "left")
        gap = F.col("target") - F.col("got")
        low = F.when(gap > 0, F.col("dual")).otherwise(F.col("low"))
        high = F.when(gap < 0, F.col("dual")).otherwise(F.col("high"))
        newton = F.col("dual") + F.try_divide(gap, F.col("slope"))
        j = j.select("source", "source_size", "target", "dual", low.alias("low"), high.alias("high"), newton.alias("newton"), gap.alias("gap"), "done")
        far = F.col("dual") - F.lit(4.0) * F.greatest(F.abs("dual"), F.lit(0.25))
        bounded = F.when(F.coalesce((F.col("newton") > F.coalesce("low", far)) & (F.col("newton") < F.col("high")), F.lit(False)), F.col("newton")).otherwise(
            (F.coalesce("low", far) + F.col("high")) / 2)
        ended = F.col("done") | (F.abs("gap") <= F.lit(tolerance) * F.col("target")) | F.coalesce(F.abs(F.col("high") - F.col("low")) <= F.lit(1e-15) * F.abs("high"), F.lit(False))
        state = write_table(j.select("source", "source_size", "target", F.when(ended, F.col("dual")).otherwise(bounded).alias("dual"), "low", "high", ended.alias("done")), f"mixing-dual-{step}")
    raise RuntimeError(f"the dual was not solved in {steps} steps")


def class_copies(classes: DataFrame, cap: float) -> DataFrame:
    """``no_source, source_name, class, n, m``: the copies ``m`` that the ``n`` documents of a size class get together.

    ``classes`` has a row for a source's class with ``n``, ``words`` and
    ``wanted`` words. From the largest class down, each gets the whole number
    of average documents nearest to what is wanted so far and not yet given.
    """
    row = F.struct("class", "n", "words", "wanted")
    lists = classes.groupBy("no_source", "source_name").agg(F.sort_array(F.collect_list(row), asc=False).alias("classes"))
    start = F.struct(F.lit(0.0).alias("left"), F.array().cast("array<struct<class:int,n:bigint,m:bigint>>").alias("out"))

    def give(state: Column, c: Column) -> Column:
        mean = c["words"] / c["n"]
        owed = state["left"] + c["wanted"]
        m = F.when(mean > 0, F.least(c["n"] * F.lit(cap), F.greatest(F.lit(0.0), F.round(owed / mean)))).otherwise(0.0).cast("bigint")
        return F.struct((owed - m * mean).alias("left"), F.concat(state["out"], F.array(F.struct(c["class"].alias("class"), c["n"].alias("n"), m.alias("m")))).alias("out"))

    given = F.aggregate("classes", start, give, lambda state: state["out"])
    return lists.select("no_source", "source_name", F.inline(given))


def size_class(size: Column) -> Column:
    return F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")) * CLASSES).cast("int")


def copies(docs: DataFrame, rates: DataFrame, cap: float = 3.0) -> DataFrame:
    """``docs`` with ``source_size, target, rate, copies``; ``docs`` has ``source, size, key`` (a long that differs between documents).

    ``rates`` has ``source, source_size, target, class, rate``.
    """
    source, cell = ["no_source", "source_name"], ["no_source", "source_name", "class", "bucket"]
    named = lambda df: df.withColumn("no_source", F.col("source").isNull()).withColumn("source_name", F.coalesce("source", F.lit("")))
    rows = named(docs).withColumn("class", size_class(F.col("size"))).withColumn("bucket", F.pmod("key", F.lit(BUCKETS)).cast("int"))
    rates = named(rates).drop("source")
    cells = rows.groupBy(*cell).agg(F.count("*").alias("rows"), F.sum("size").alias("words"))
    classes = cells.groupBy(*source, "class").agg(F.sum("rows").alias("n"), F.sum("words").alias("words")).join(rates, [*source, "class"])
    given = class_copies(classes.withColumn("wanted", F.col("words") * F.col("rate")), cap)
    before = Window.partitionBy(*source, "class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))).drop("rows", "words")
    cells = cells.join(given, [*source, "class"]).join(rates, [*source, "class"])
    inside = Window.partitionBy(*cell).orderBy("size", "key", *[c for c in ("doc_id",) if c in docs.columns])
    rows = rows.withColumn("nth", F.row_number().over(inside)).join(cells, cell).withColumn("k", F.col("before") + F.col("nth"))
    return rows.select(*docs.columns, "source_size", "target", "rate", F.expr("(k * m) div n - ((k - 1) * m) div n").alias("copies"))


def choose(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """``rows`` (``source, size, key`` and others) with ``source_size, target, rate, copies``."""
    cells = rows.groupBy("source", size_class(F.col("size")).alias("class")).agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    cells = write_table(cells, "mixing-classes")
    targets = write_table(source_targets(cells.select("source", "size"), weights, cap), "mixing-targets")
    # A class's mean size over its source's.
    whole = cells.groupBy("source").agg(F.sum("n").alias("all_n"), F.sum("size").alias("all_size")).withColumnRenamed("source", "s")
    u = F.try_divide(F.col("size") * F.col("all_n").cast("double"), F.col("n") * F.col("all_size"))
    tilted = cells.join(whole, cells.source.eqNullSafe(whole.s)).select("source", "class", F.lit(1.0).alias("base"), F.col("size").cast("double").alias("size"), u.alias("u"))
    dual = solve_dual(tilted.drop("class"), targets, float(cap)).withColumnRenamed("source", "s")
    rate = F.coalesce(F.least(F.lit(float(cap)), F.exp(F.col("dual") * F.col("u"))), F.lit(0.0))
    rates = tilted.join(dual, tilted.source.eqNullSafe(dual.s)).select("source", "source_size", "target", "class", rate.alias("rate"))
    return copies(rows, write_table(rates, "mixing-rates"), cap=cap)


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` (``doc_id, text``) with ``size`` and ``key``."""
    return docs.withColumn("size", word_count(F.col("text"))).withColumn("key", F.xxhash64("doc_id", "text"))


def repeat_to_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Every row of ``docs`` as often as the mix takes it, columns unchanged."""
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text", "source")
    taken = choose(measured(inner).drop("text"), weights, cap).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def op3_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = need(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text", source="source")
    rows = write_table(measured(docs).drop("text"), "mixing-rows")
    return choose(rows).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate")
