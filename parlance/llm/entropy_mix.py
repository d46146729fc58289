"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the expected number of its copies. Of all rates
that give each source its target of tokens, and none above ``cap``, those
nearest to one copy each are taken, by relative entropy over documents. Their
convex dual has one multiplier per source, and the rates are exponentially
tilted by it: ``least(cap, exp(lambda * size / scale))``. A source that has
to shrink therefore gives up words of its long documents first, one that has
to grow repeats them first.

1. Sizes are added up per source, and targets shared out by weight; a target
   stops at ``cap`` times its source's size, the excess is shared again.
2. The dual needs only the histogram (source, size, rows). Newton's method,
   on the logarithm of the tilted sum, takes one aggregate of it per step for
   all sources at once; a step that leaves its bracket becomes a bisection.
   Terms are added up as decimals, so their order does not matter.
3. Rates become copies. Every document gets the whole part of its rate; the
   words still missing come from the fractions, by sequential Poisson
   sampling: documents are taken by the hash of their id over their fraction,
   lowest first, until the target is reached, and the last in part. Sums per
   (source, bin of that order) find the bin of the cut, and only the
   documents of that bin are ranked. So every source meets its target to the
   word.

Rows of equal id, source and size are one unit of ``m`` rows until the end,
so copies of one row spread. Everything is DataFrame code. Tables with a row
per source are joined by the planner's choice.

Null and empty texts have size 0 and give no words. A null source is a source
of its own, the last; null ids are ids. Without words every target is 0. An
empty table gives no rows. Reruns agree: nothing depends on the order or
partition of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.tables import written
from parlance.plans.ranks import with_global_rank

#: Rows of one unit that a task writes at most, and units of a source that a task ranks, on average.
UNIT_ROWS, CUT_ROWS = 50_000, 100_000
#: A source's tilted sum may miss its target by this share, or by this many words.
SHARE, WORDS = 1e-9, 0.01

# Words are runs between space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def _same_source(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join on the source, nulls equal; ``right`` has one row per source."""
    right = right.withColumnRenamed("source", "_source")
    return left.join(right, left["source"].eqNullSafe(right["_source"])).drop("_source")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """(source, source_size) with ``target``. Sources by code point, null last, weigh ``weights``, repeating."""
    ranked = with_global_rank(sizes, [F.col("source").asc_nulls_last()], "_at")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_at") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = written(ranked.select("source", "source_size", weight.alias("weight"), (F.lit(float(cap)) * F.col("source_size")).alias("most")), "mix-sources")
    level, n_full = 0.0, -1
    while True:
        above = F.col("most") < F.lit(level) * F.col("weight")
        row = ranked.agg(F.sum("source_size").alias("all"), F.sum(F.when(above, F.col("most"))).alias("full"),
                         F.sum(F.when(~above, F.col("weight"))).alias("open"), F.count(F.when(above, 1)).alias("n")).first()
        if not row["all"] or row["n"] == n_full:
            break
        level, n_full = (row["all"] - (row["full"] or 0.0)) / row["open"], row["n"]
    return ranked.select("source", "source_size", F.least(F.col("most"), F.lit(level) * F.col("weight")).alias("target"))


def dual_multipliers(histogram: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """(source, source_size, target, scale, lam) from (source, size, n) with sizes above 0; ``lam`` is null for a source at its cap."""
    shape = histogram.groupBy("source").agg(
        F.min("size").alias("least"), (F.sum(F.col("n").cast("decimal(38,0)") * F.col("size") * F.col("size")).cast("double") / F.sum(F.col("n") * F.col("size"))).alias("scale"))
    first = F.col("least") / F.col("scale")
    shrinks = F.col("target") < F.col("source_size")
    # The tilted sum is at most the target at lo and at least the target at hi.
    state = _same_source(targets, shape).select(
        "source", "source_size", "target", "scale", F.when(F.col("target") < F.lit(float(cap)) * F.col("source_size"), F.lit(0.0)).alias("lam"),
        F.when(shrinks, F.log(F.col("target") / F.col("source_size")) / first).otherwise(F.lit(0.0)).alias("lo"),
        F.when(shrinks, F.lit(0.0)).otherwise(F.log(F.lit(float(cap))) / first).alias("hi"),
        (F.col("target") >= F.lit(float(cap)) * F.col("source_size")).alias("done"))
    state = written(state, "mix-dual")
    while not state.where(~F.col("done")).isEmpty():
        x = F.col("size") / F.col("scale")
        tilt = F.least(F.lit(float(cap)), F.exp(F.col("lam") * x))
        words = (F.col("n") * F.col("size") * tilt).cast("decimal(38,6)")
        slope = F.when(tilt < cap, F.col("n") * F.col("size") * x * tilt).otherwise(F.lit(0.0)).cast("decimal(38,6)")
        sums = (_same_source(histogram, state.where(~F.col("done"))).groupBy("source")
                .agg(F.sum(words).cast("double").alias("_f"), F.sum(slope).cast("double").alias("_h")))
        held = _same_source(state.where(~F.col("done")), sums)
        lo = F.when(F.col("_f") <= F.col("target"), F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(F.col("_f") >= F.col("target"), F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - F.when(F.col("_h") > 0, F.col("_f") / F.col("_h") * F.log(F.col("_f") / F.col("target")))
        met = F.abs(F.col("_f") - F.col("target")) <= F.greatest(F.lit(WORDS), F.lit(SHARE) * F.col("target"))
        moved = F.when((step > lo) & (step < hi), step).otherwise((lo + hi) / 2)
        held = held.select("source", "source_size", "target", "scale", F.when(met, F.col("lam")).otherwise(moved).alias("lam"), lo.alias("lo"), hi.alias("hi"),
                           (met | (moved <= lo) | (moved >= hi)).alias("done"))
        state = written(held.unionByName(state.where("done")), "mix-dual")
    return state.select("source", "source_size", "target", "scale", "lam")


def balance(docs: DataFrame, id_col: str, source_col: str, size: Column, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3, seed: int = 0) -> DataFrame:
    """One row per document: ``id_col``, ``source``, ``size``, ``source_size``,
    ``target`` (its source's tokens), ``rate``, ``copies`` (whole ones),
    ``part`` (words of one more copy) and ``taken`` (copies * size + part)."""
    units = written(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))
        .groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("m")), "mix-units")
    histogram = written(units.where("size > 0").groupBy("source", "size").agg(F.sum("m").alias("n")), "mix-histogram")
    targets = written(source_targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size")), weights, cap), "mix-targets")
    dual = dual_multipliers(histogram, targets, cap)

    # Sources without words have no multiplier and no words to take.
    state = targets.join(dual.select(F.col("source").alias("_s"), "scale", "lam"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    state = written(state, "mix-state")
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("lam").isNull(), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(F.col("lam") * F.col("size") / F.col("scale"))))
    name = F.coalesce(F.col("id").cast("string"), F.lit(""))
    chance = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("id").isNull(), name, "source", "size"), 11) + 1) / F.lit(float(1 << 53))
    rated = (
        _same_source(units, state).withColumn("rate", rate).withColumn("whole", F.floor("rate"))
        .withColumn("_extra", F.col("m") * (F.col("rate") - F.col("whole")))
        # Rows of the unit that surely get one copy more, and the fraction of one further row.
        .withColumn("more", F.floor("_extra")).withColumn("fraction", F.col("_extra") - F.col("more"))
        .withColumn("order", F.when((F.col("fraction") > 0) & (F.col("size") > 0), F.struct((chance / F.col("fraction")).alias("key"), "size", F.col("id").isNull().alias("no_id"), name.alias("name"))))
        .drop("_extra", "scale", "lam")
    )

    bins = max(1024, -(-units.count() // CUT_ROWS))
    binned = rated.withColumn("bin", F.floor(F.col("order.key") / (1 + F.col("order.key")) * bins))
    per_bin = binned.groupBy("source", "target", "bin").agg(
        F.sum(F.when(F.col("order").isNotNull(), F.col("size"))).alias("words"), F.sum((F.col("m") * F.col("whole") + F.col("more")) * F.col("size")).alias("sure"))
    up_to = Window.partitionBy("source").orderBy(F.col("bin").asc_nulls_first())
    per_bin = per_bin.withColumn("missing", F.col("target") - F.sum("sure").over(Window.partitionBy("source"))).withColumn("total", F.sum("words").over(up_to))
    cut_bins = per_bin.where((F.col("total") >= F.col("missing")) & (F.col("total") - F.col("words") < F.col("missing"))).select(
        "source", F.col("bin").alias("cut_bin"), (F.col("missing") - F.col("total") + F.col("words")).alias("missing"))
    none_missing = per_bin.groupBy("source").agg((F.max("missing") <= 0).alias("_none"))

    in_cut = _same_source(binned.select("source", "size", "bin", "order"), cut_bins).where(F.col("bin") == F.col("cut_bin"))
    in_cut = in_cut.withColumn("total", F.sum("size").over(Window.partitionBy("source").orderBy("order").rowsBetween(Window.unboundedPreceding, 0)))
    last = in_cut.where((F.col("total") >= F.col("missing")) & (F.col("total") - F.col("size") < F.col("missing"))).select(
        F.col("source").alias("_s"), F.col("order").alias("last"), F.round(F.col("missing") - F.col("total") + F.col("size")).cast("bigint").alias("rest"))
    cuts = written(none_missing.join(last, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"), "mix-cuts")

    chosen = F.col("order").isNotNull() & ~F.col("_none") & F.coalesce(F.col("order") < F.col("last"), F.lit(True))
    at_cut = F.col("order").isNotNull() & ~F.col("_none") & F.coalesce(F.col("order") == F.col("last"), F.lit(False))
    decided = _same_source(rated, cuts).select(
        "id", "source", "size", "m", "source_size", "target", "rate", F.col("whole").alias("copies"),
        (F.col("more") + F.when(chosen, 1).otherwise(0)).alias("more"), F.when(at_cut, F.col("rest")).otherwise(F.lit(0)).cast("bigint").alias("rest"))

    # Rows of a unit again, a large unit's by many tasks.
    small = decided.where(F.col("m") <= UNIT_ROWS).withColumn("j", F.explode(F.sequence(F.lit(1).cast("bigint"), "m")))
    chunk = decided.where(F.col("m") > UNIT_ROWS).withColumn("_c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("m") - 1) / UNIT_ROWS))))
    chunk = chunk.repartition("id", "source", "_c")
    large = chunk.withColumn("j", F.explode(F.sequence(F.col("_c") * UNIT_ROWS + 1, F.least(F.col("m"), (F.col("_c") + 1) * UNIT_ROWS)))).drop("_c")
    copies = F.col("copies") + F.when(F.col("j") <= F.col("more"), 1).otherwise(0)
    part = F.when(F.col("j") == F.col("more") + 1, F.col("rest")).otherwise(F.lit(0)).cast("bigint")
    return (
        small.unionByName(large)
        .select("id", "source", "size", "source_size", "target", "rate", copies.cast("bigint").alias("copies"), part.alias("part"))
        .withColumn("taken", F.col("copies") * F.col("size") + F.col("part"))
        .withColumnRenamed("id", id_col)
    )
