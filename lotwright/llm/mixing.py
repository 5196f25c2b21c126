"""Mixing sources to target weights by entropy balancing.

A mix gives every document a rate, the expected number of copies of it that the
mix holds. Among all rates that meet the token target of each source and lie
between 0 and `cap`, entropy balancing takes those nearest to 1 in relative
entropy. By convex duality these are exponentially tilted and clipped,

    rate(document) = min(cap, exp(lambda(source) * size / mean size of the source)),

with one dual variable a source, the root of a monotone equation. Newton steps
run as distributed aggregations over the histogram (source, size, documents);
each step halves a bracket instead where it would leave it.

The rates become copies by systematic rounding in order of size within a source:
with C the running sum of rates, a document gets floor(C) - floor(C before it)
copies. Copies then miss a target by less than one longest document; a few repair
rounds, each giving or taking one copy of the best fitting document of each
source, close most of the rest. Everything is DataFrame code.

Defined cases: a null or empty text has size 0, takes 0 and has no say in its
source's target; null is a source of its own, last in order; equal rows are
separate documents; documents of one source and size are in order of id, then of a
hash of the text, and those alike in both stand for each other; a very long text is
one document like any other, so a source may miss its target by part of it; an empty
table gives an empty mix. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

CAP = 3
NEWTON_STEPS = 24
TOLERANCE = 1e-7
REPAIR_ROUNDS = 5
#: Documents of a source and size are dealt to buckets of about this many.
BUCKET_ROWS = 200_000
LEAST_BUCKETS = 64
BRACKET = 400.0


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and mark (a hash of the text) of every document."""
    return docs.select("doc_id", "source", common.word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("mark"))


def targets(totals: DataFrame, cap: int = CAP) -> DataFrame:
    """Add `target` to rows (source, docs, total), one row a source.

    Sources by code point, null last, weigh 1, 2, 3, repeating. Water filling in
    order of cap * total / weight: a source is at its cap when its share by weight
    of what the sources before it left exceeds the cap.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("room", F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = totals.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long"))
    ranked = ranked.withColumn("most", (cap * F.col("total")).cast("double")).withColumn("room", F.col("most") / F.col("weight"))
    left = F.sum("total").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weights_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    ranked = ranked.withColumn("level", left / weights_left)
    ranked = ranked.withColumn("level", F.min(F.when(F.col("level") <= F.col("room"), F.struct("room", "level"))).over(everything)["level"])
    share = F.coalesce(F.col("weight") * F.col("level"), F.col("most"))
    return ranked.withColumn("target", F.least(share, F.col("most"))).select("source", "docs", "total", "target")


def _tilt(dual: Column, cap: int) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(dual * F.col("size") / F.col("mean"), F.lit(700.0))))


def dual_variables(histogram: DataFrame, goals: DataFrame, cap: int = CAP) -> DataFrame:
    """Solve the dual for rows (source, size, docs) and (source, docs, total, target).

    Returns (source, mean, total, target, dual); dual is null where every document
    is at the cap or the source has no words, and no equation needs solving.
    """
    free = (F.col("total") > 0) & (F.col("target") < cap * F.col("total") * (1 - 1e-9))
    start = F.when(free, F.log(F.greatest(F.col("target"), F.lit(1e-9)) / F.col("total")))
    state = goals.select(
        "source", (F.col("total") / F.col("docs")).alias("mean"), "total", "target",
        start.alias("dual"), F.lit(-BRACKET).alias("low"), F.lit(BRACKET).alias("high"), F.lit(False).alias("done"),
    )
    state = common.store(state, "mix-dual")
    same_source = histogram.source.eqNullSafe(F.col("state_source"))
    for _ in range(NEWTON_STEPS):
        joined = histogram.join(state.withColumnRenamed("source", "state_source").filter("dual is not null"), same_source)
        rate = _tilt(F.col("dual"), cap)
        words = F.col("docs") * F.col("size") * rate
        slope = F.when(rate < cap, words * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = joined.groupBy("state_source").agg(F.sum(words).alias("words"), F.sum(slope).alias("slope"))
        both = state.join(sums, state.source.eqNullSafe(sums.state_source), "left")
        over = F.col("words") > F.col("target")
        low, high = F.when(over, F.col("low")).otherwise(F.col("dual")), F.when(over, F.col("dual")).otherwise(F.col("high"))
        # a Newton step on the logarithm of the equation, which is nearly linear
        step = F.col("dual") - F.try_divide((F.log("words") - F.log("target")) * F.col("words"), F.col("slope"))
        inside = F.coalesce((step > low) & (step < high), F.lit(False))
        met = F.abs(F.col("words") - F.col("target")) <= TOLERANCE * F.col("target")
        moved = F.when(met, F.col("dual")).when(inside, step).otherwise((low + high) / 2)
        last, state = state, common.store(
            both.select(
                "source", "mean", "total", "target",
                F.when(F.col("words").isNotNull(), moved).otherwise(F.col("dual")).alias("dual"),
                F.when(F.col("words").isNotNull(), low).otherwise(F.col("low")).alias("low"),
                F.when(F.col("words").isNotNull(), high).otherwise(F.col("high")).alias("high"),
                F.coalesce(met, F.lit(True)).alias("done"),
            ),
            "mix-dual",
        )
        common.discard(last)
        if state.filter("not done").isEmpty():
            break
    return state.select("source", "mean", "total", "target", "dual")


def _rounded(rows: DataFrame, histogram: DataFrame, duals: DataFrame, buckets: int, cap: int) -> DataFrame:
    """Copies of each row by systematic rounding in order of (size, bucket, rank)."""
    left = histogram.withColumnRenamed("source", "h_source")
    rated = left.join(duals, left.h_source.eqNullSafe(duals.source)).withColumn(
        "rate", F.when(F.col("dual").isNull(), F.when(F.col("total") > 0, float(cap)).otherwise(1.0)).otherwise(_tilt(F.col("dual"), cap))
    )
    by_size = Window.partitionBy("h_source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    rated = rated.withColumn("before", F.coalesce(F.sum(F.col("docs") * F.col("rate")).over(by_size), F.lit(0.0)))
    cells = rows.groupBy("source", "size", "bucket").agg(F.count("*").alias("n"))
    by_bucket = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("offset", F.coalesce(F.sum("n").over(by_bucket), F.lit(0)))
    cells = cells.join(
        rated.select("h_source", F.col("size").alias("h_size"), "rate", "before", "target", F.col("total").alias("source_size")),
        F.col("source").eqNullSafe(F.col("h_source")) & (F.col("size") == F.col("h_size")),
    ).select(
        F.col("source").alias("c_source"), F.col("size").alias("c_size"), F.col("bucket").alias("c_bucket"),
        "rate", "target", "source_size", (F.col("before") + F.col("offset") * F.col("rate")).alias("before"),
    )
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("doc_id", "mark"))
    placed = rows.withColumn("rank", rank).join(
        cells,
        F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size")) & (F.col("bucket") == F.col("c_bucket")),
    )
    # a running sum within 1e-6 of a whole number is that number, whatever the order of the additions
    whole = lambda n: F.floor(F.col("before") + n * F.col("rate") + 0.5 + 1e-6)
    copies = F.least(F.greatest(whole(F.col("rank")) - whole(F.col("rank") - 1), F.lit(0)), F.lit(cap)).cast("long")
    return placed.select("doc_id", "source", "size", "mark", "bucket", "rank", "source_size", "target", "rate", copies.alias("copies"))


def _repaired(placed: DataFrame, rounds: int, cap: int) -> DataFrame:
    """Give or take a copy of one document a source and round, the largest that the gap holds."""
    key = ["source", "size", "bucket", "rank"]
    gaps = placed.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
    gaps = common.store(gaps, "mix-gap")
    moves = None
    for _ in range(rounds):
        if gaps.filter(F.abs("gap") >= 1).isEmpty():
            break
        g = gaps.withColumnRenamed("source", "g_source")
        open_rows = placed.join(g, placed.source.eqNullSafe(g.g_source))
        if moves is not None:
            m = moves.select(*[F.col(c).alias(f"m_{c}") for c in key])
            same = F.col("source").eqNullSafe(F.col("m_source"))
            for c in key[1:]:
                same &= F.col(c) == F.col(f"m_{c}")
            open_rows = open_rows.join(m, same, "left_anti")
        able = F.when(F.col("gap") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0)
        fits = able & (F.col("size") > 0) & (F.col("size") <= F.abs("gap"))
        best = open_rows.filter(fits).groupBy("source").agg(F.max(F.struct("size", "bucket", "rank")).alias("pick"), F.first("gap").alias("gap"))
        best = common.store(best.select("source", "pick.*", F.when(F.col("gap") > 0, 1).otherwise(-1).cast("long").alias("more")), "mix-move")
        moves = best if moves is None else moves.unionByName(best)
        b = best.select(F.col("source").alias("b_source"), (F.col("size") * F.col("more")).alias("given"))
        gaps = gaps.join(b, gaps.source.eqNullSafe(b.b_source), "left").select("source", (F.col("gap") - F.coalesce("given", F.lit(0))).alias("gap"))
        gaps = common.store(gaps, "mix-gap")
    if moves is None:
        return placed
    m = moves.select(*[F.col(c).alias(f"m_{c}") for c in key], "more")
    same = F.col("source").eqNullSafe(F.col("m_source"))
    for c in key[1:]:
        same &= F.col(c) == F.col(f"m_{c}")
    return placed.join(m, same, "left").withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0))).drop("more", *[f"m_{c}" for c in key])


def mix(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """doc_id, source, size, mark, source_size, target, rate, copies and taken of every document.

    `copies` is how often the mix holds the document, 0 to `cap`; `taken` the words
    of those copies. The result is a table in the shared folder read again.
    """
    sized = common.store(sizes(docs), "mix-size")
    histogram = common.store(sized.groupBy("source", "size").agg(F.count("*").alias("docs")), "mix-histogram")
    totals = histogram.groupBy("source").agg(F.sum("docs").alias("docs"), F.sum(F.col("docs") * F.col("size")).alias("total"))
    goals = common.store(targets(totals, cap), "mix-target")
    duals = dual_variables(histogram, goals, cap)
    rows = histogram.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    buckets = max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))
    bucketed = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(buckets)).cast("long"))
    placed = common.store(_rounded(bucketed, histogram, duals, buckets, cap), "mix-copies")
    done = _repaired(placed, REPAIR_ROUNDS, cap)
    return done.select("doc_id", "source", "size", "mark", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents.

    Reads doc_id, text and source of the whole table; the module's defined cases hold.
    """
    return mix(common.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def resampled(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """The documents of the mix, each as often as it has copies, with the columns of `docs`.

    A document of no words keeps its place: its source's target says nothing of it.
    Rows alike in id, source and text stand for each other: one is repeated as often as
    all of them are taken.
    """
    size, mark, times = (common.fresh(docs, c) for c in ("size", "mark", "times"))
    mixed = mix(docs, cap)
    taken = mixed.groupBy(F.col("doc_id").alias("k_id"), F.col("source").alias("k_source"), F.col("size").alias("k_size"), F.col("mark").alias("k_mark")).agg(
        F.sum("copies").alias("k_copies"), F.count("*").alias("k_rows")
    )
    taken = common.store(taken, "mix-taken")
    sized = docs.withColumn(size, common.word_count(F.col("text"))).withColumn(mark, F.xxhash64("text"))

    def joined(rows: DataFrame, keys: DataFrame) -> DataFrame:
        same = rows["doc_id"].eqNullSafe(keys["k_id"]) & rows["source"].eqNullSafe(keys["k_source"]) & (rows[size] == keys["k_size"]) & (rows[mark] == keys["k_mark"])
        return rows.join(keys, same)

    def repeated(rows: DataFrame, copies: Column) -> DataFrame:
        out = rows.withColumn(times, F.explode(F.sequence(F.lit(1), copies)))
        return out.select(*[out[c] for c in docs.columns])

    one = joined(sized, taken.filter("k_rows = 1"))
    one = one.select(*[sized[c] for c in docs.columns], F.when(taken["k_size"] == 0, 1).otherwise(taken["k_copies"]).cast("int").alias(times))
    one = repeated(one.filter(F.col(times) > 0).withColumnRenamed(times, size), F.col(size))
    several = common.store(taken.filter("k_rows > 1"), "mix-several")
    if several.isEmpty():
        return one
    alike = joined(sized, several).select(F.struct(*[sized[c] for c in docs.columns]).alias("best"), *[several[c] for c in several.columns])
    alike = alike.groupBy(*several.columns).agg(F.first("best").alias("best"))
    alike = alike.withColumn("k_times", F.when(F.col("k_size") == 0, F.col("k_rows")).otherwise(F.col("k_copies")).cast("int")).filter("k_times > 0")
    return one.unionByName(alike.select("best", F.explode(F.sequence(F.lit(1), F.col("k_times")))).select("best.*"))
