"""Operators over ordered sequences of passes. Keys: flower_id and a gapless order ord; windows are per flower."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from passlake.functions.vectors import lerp, vec_rms
from passlake.operators.ranks import percentiles, values_at


def flower() -> WindowSpec:
    return Window.partitionBy("flower_id")


def by_ord() -> WindowSpec:
    return flower().orderBy("ord")


def whole() -> WindowSpec:
    return by_ord().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def so_far() -> WindowSpec:
    return by_ord().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def transitions(passes: DataFrame) -> DataFrame:
    """Changes from a pass to the next: width, height, and the sorted list of classes (changes over 0.25; else STABLE)."""
    nxt = passes.withColumn("next", F.lead(F.struct("width", "height", "kind")).over(by_ord())).where("next is not null")
    dw, dh = F.col("next.width") - F.col("width"), F.col("next.height") - F.col("height")
    classes = F.array_compact(
        F.array(
            F.when(F.abs(dh) > 0.25, F.lit("HEIGHT")), F.when(F.col("next.kind") != F.col("kind"), F.lit("KIND")), F.when(F.abs(dw) > 0.25, F.lit("WIDTH"))
        )
    )
    return nxt.select(
        "flower_id",
        "ord",
        dw.alias("width_change"),
        dh.alias("height_change"),
        F.when(F.size(classes) == 0, F.lit("STABLE")).otherwise(F.array_join(classes, "+")).alias("classes"),
    )


def filter_outliers(passes: DataFrame, share: float = 0.25, jump: float = 0.75) -> DataFrame:
    """The passes that stay: at least share of the median width, and (in sequences of three or more) not
    different by more than jump, relative to itself, from both neighbours. The median is exact and comes from range partitions, not from a whole sequence's buffer."""
    middle = percentiles(passes.where(F.col("flower_id").isNotNull()), ["flower_id"], "width", {"__median": 0.5})
    passes = passes.join(middle, "flower_id", "left")
    near = lambda other: F.abs(F.col("width") - other) <= jump * F.abs(F.col("width"))
    before, after = F.lag("width").over(by_ord()), F.lead("width").over(by_ord())
    marked = passes.select(
        "*",
        (F.col("width") >= share * F.col("__median")).alias("long"),
        ((F.count(F.lit(1)).over(flower()) < 3) | before.isNull() | after.isNull() | near(before) | near(after)).alias("fits"),
    )
    return marked.where("long and fits").drop("long", "fits", "__median")


def length_progression(passes: DataFrame) -> DataFrame:
    """Deviation in percent from the upper median of the sequence, and its class. The median is found once for each sequence, from range partitions."""
    upper = values_at(passes, ["flower_id"], "width", {"upper": F.floor(F.col("total") / 2)})
    out = passes.join(upper, "flower_id", "left")
    out = out.withColumn("percent", 100 * F.abs(F.try_divide(F.col("width") - F.col("upper"), F.col("upper"))))
    ladder = F.when(F.col("percent") <= 0.25, "CONSISTENT").when(F.col("percent") <= 1, "MINOR").when(F.col("percent") <= 5, "REVIEW")
    return out.select("flower_id", "ord", "percent", ladder.otherwise("INVALID").alias("progression"))


def split_sequences(passes: DataFrame, position: str = "x", factor: float = 2.5, least: float = 120.0) -> DataFrame:
    """group number: a new group starts at gaps over max(factor * smallest positive gap, least)."""
    gap = F.col(position) - F.lag(position).over(by_ord())
    gaps = passes.withColumn("gap", gap)
    limit = F.greatest(factor * F.min(F.when(F.col("gap") > 0, F.col("gap"))).over(flower()), F.lit(least))
    marked = gaps.withColumn("limit", limit)
    start = F.when(F.col("gap") > F.col("limit"), 1).otherwise(0)
    return marked.select("flower_id", "ord", F.sum(start).over(so_far()).cast("long").alias("group_no"))


def sequence_features(passes: DataFrame) -> DataFrame:
    """Deltas to the previous and first pass, ratio to the last one, progress in [0, 1]."""
    last = F.last("width").over(whole())
    return passes.select(
        "flower_id",
        "ord",
        (F.col("width") - F.lag("width").over(by_ord())).alias("delta_previous"),
        (F.col("width") - F.first("width").over(whole())).alias("delta_first"),
        F.try_divide(F.col("width"), last).alias("ratio_final"),
        F.coalesce(F.try_divide(F.col("ord").cast("double"), F.last("ord").over(whole())), F.lit(0.0)).alias("progress"),
    )


def progress_schedule(passes: DataFrame) -> DataFrame:
    """Cumulative share of absolute width steps; by order where nothing moves."""
    step = F.coalesce(F.abs(F.col("width") - F.lag("width").over(by_ord())), F.lit(0.0))
    out = passes.select("flower_id", "ord", step.alias("step"))
    total = F.sum("step").over(flower())
    linear = F.coalesce(F.try_divide(F.col("ord").cast("double"), F.max("ord").over(flower())), F.lit(0.0))
    return out.select(
        "flower_id", "ord", F.when(total > 1e-12, F.sum("step").over(so_far()) / total).otherwise(linear).alias("progress")
    )


def subsequences(passes: DataFrame, n: int = 3) -> DataFrame:
    """Windows of n passes: first ord, members' kinds, mean width."""
    frame = by_ord().rowsBetween(Window.currentRow, n - 1)
    out = passes.select(
        "flower_id", "ord", F.collect_list("kind").over(frame).alias("kinds"), F.avg("width").over(frame).alias("mean_width")
    )
    return out.where(F.size("kinds") == n).select("flower_id", "ord", F.array_join("kinds", ">").alias("members"), "mean_width")


def smoothness(passes: DataFrame) -> DataFrame:
    """100 * (1 - min(1, largest jump / (2.5 * mean jump))); 100 for fewer than three passes."""
    jumps = passes.select("flower_id", F.abs(F.col("width") - F.lag("width").over(by_ord())).alias("jump"))
    score = 100 * (1 - F.least(F.lit(1.0), F.coalesce(F.try_divide(F.max("jump"), 2.5 * F.avg("jump")), F.lit(0.0))))
    return jumps.groupBy("flower_id").agg(
        F.count(F.lit(1)).alias("n_passes"),
        F.when(F.count(F.lit(1)) < 3, F.lit(100.0)).otherwise(score).alias("smoothness"),
    )


def monotone_order(passes: DataFrame, matched: Column) -> DataFrame:
    """Matched passes get max(previous + 1, own): with k their number, k + running max of own - k. Others get null."""
    by = Window.partitionBy("flower_id", "matched").orderBy("ord")
    rows = passes.withColumn("matched", matched).withColumn("k", F.row_number().over(by) - 1)
    placed = F.col("k") + F.max(F.col("wanted") - F.col("k")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("flower_id", "ord", F.when(F.col("matched"), placed).cast("long").alias("station"))


def reconstruction(passes: DataFrame, offset: int = 1, accept: float = 0.15) -> DataFrame:
    """Each inner pass predicted as the middle of its neighbours at offset: RMS error and verdict."""
    rows = passes.select(
        "flower_id", "ord", "shape", F.lag("shape", offset).over(by_ord()).alias("a"), F.lead("shape", offset).over(by_ord()).alias("b")
    ).where("a is not null and b is not null")
    out = rows.withColumn("rms", vec_rms(F.col("shape"), lerp(F.col("a"), F.col("b"))))
    return out.select("flower_id", "ord", "rms", (F.col("rms") <= accept).alias("accepted"))


def bend_features(bends: DataFrame) -> DataFrame:
    """Spacing to the previous and next bend of a pass in the order of angle, and severity."""
    w = Window.partitionBy("flower_id", "pass").orderBy("angle", "bend_id")
    size = F.abs("angle")
    return bends.select(
        "flower_id",
        "pass",
        "bend_id",
        (F.col("angle") - F.lag("angle").over(w)).alias("to_previous"),
        (F.lead("angle").over(w) - F.col("angle")).alias("to_next"),
        F.when(size < 10, "LOW").when(size < 25, "MEDIUM").otherwise("HIGH").alias("severity"),
    )


def bend_events(bends: DataFrame, step: float = 1.0) -> DataFrame:
    """What happened to each bend between a pass and the next day's pass."""
    a = bends.select("flower_id", (F.col("pass") + 1).alias("pass"), "bend_id", F.col("angle").alias("before"))
    b = bends.select("flower_id", "pass", "bend_id", F.col("angle").alias("after"))
    both = a.join(b, ["flower_id", "pass", "bend_id"], "full_outer")
    days = bends.select("flower_id", "pass").distinct()
    both = both.join(days, ["flower_id", "pass"], "left_semi")
    change = F.abs(F.col("after")) - F.abs(F.col("before"))
    ladder = (
        F.when(F.col("before").isNull(), "NEW")
        .when(F.col("after").isNull(), "DEACTIVATED")
        .when(F.col("before") * F.col("after") < 0, "REVERSED")
        .when(change > step, "INCREASED")
        .when(change < -step, "DECREASED")
        .otherwise("UNCHANGED")
    )
    return both.select("flower_id", "pass", "bend_id", ladder.alias("event"))


def bend_grid(bends: DataFrame) -> DataFrame:
    """Every bend of a flower at every pass of it, 0 where inactive. Keys of one flower meet by an equi-join."""
    passes, ids = bends.select("flower_id", "pass").distinct(), bends.select("flower_id", "bend_id").distinct()
    grid = passes.join(ids, "flower_id")
    return grid.join(bends, ["flower_id", "pass", "bend_id"], "left").select(
        "flower_id", "pass", "bend_id", F.coalesce("angle", F.lit(0.0)).alias("angle"), F.col("angle").isNotNull().alias("active")
    )


def bend_history(bends: DataFrame) -> DataFrame:
    """First and last pass, largest and final angle, largest step and reversals of each bend."""
    w = Window.partitionBy("flower_id", "bend_id").orderBy("pass")
    before = F.lag("angle").over(w)
    rows = bends.withColumn("step", F.abs(F.col("angle") - before)).withColumn("turned", before * F.col("angle") < 0)
    return rows.groupBy("flower_id", "bend_id").agg(
        F.min("pass").alias("first_pass"),
        F.max("pass").alias("last_pass"),
        F.max(F.abs("angle")).alias("max_angle"),
        F.max_by("angle", "pass").alias("final_angle"),
        F.max("step").alias("largest_step"),
        F.count_if("turned").alias("reversals"),
    )


def topology_change(bends: DataFrame) -> DataFrame:
    """Whether a pass has the same set of bends as the flower's previous pass; false without one."""
    sets = bends.groupBy("flower_id", "pass").agg(F.array_sort(F.collect_set("bend_id")).alias("ids"))
    w = Window.partitionBy("flower_id").orderBy("pass")
    return sets.select("flower_id", "pass", F.coalesce(F.col("ids") == F.lag("ids").over(w), F.lit(False)).alias("same"))


def segment_events(segments: DataFrame) -> DataFrame:
    """seq, pos, before, after, event: segments by position against those of the sequence before: ADDED, REMOVED, CHANGED (over 0.1) or UNCHANGED."""
    a = segments.select((F.col("seq") + 1).alias("seq"), "pos", F.col("size").alias("before"))
    b = segments.select("seq", "pos", F.col("size").alias("after"))
    ladder = (
        F.when(F.col("before").isNull(), "ADDED").when(F.col("after").isNull(), "REMOVED")
        .when(F.abs(F.col("after") - F.col("before")) > 0.1, "CHANGED").otherwise("UNCHANGED")
    )
    return a.join(b, ["seq", "pos"], "full_outer").select("seq", "pos", "before", "after", ladder.alias("event"))


def candidate_score(passes: DataFrame, matched: Column) -> DataFrame:
    """.45 mean + .20 least + .15 last + .10 smoothness + .10 matched share of pass scores in [0, 1]."""
    agg = passes.groupBy("flower_id").agg(
        F.avg("score").alias("mean"), F.min("score").alias("least"), F.max_by("score", "ord").alias("last"), F.avg(F.when(matched, 1.0).otherwise(0.0)).alias("share")
    )
    smooth = smoothness(passes).select("flower_id", (F.col("smoothness") / 100).alias("smooth"))
    total = 0.45 * F.col("mean") + 0.2 * F.col("least") + 0.15 * F.col("last") + 0.1 * F.col("smooth") + 0.1 * F.col("share")
    return agg.join(smooth, "flower_id").select("flower_id", total.alias("score"))
