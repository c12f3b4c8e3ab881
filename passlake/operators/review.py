"""Resolution of projects, direct evidence, threshold evaluation and quality of an extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passlake.operators.spatial import meeting_boxes
from passlake.folders import shared_folder


def resolve_project(rows: DataFrame, projects: DataFrame, codes: DataFrame, pattern: str = r"[A-Za-z][0-9]{4}") -> DataFrame:
    """row_id, project_id, way: by drawing id, else by a mapped code, else by a code that stands in the drawing id of exactly one project.

    rows: row_id, drawing_id, code; projects: project_id, drawing_id; codes: code, project_id. Codes are upper-cased. Nothing found: null and NONE.
    """
    asked = rows.select("row_id", "drawing_id", F.upper("code").alias("code"))
    named = projects.groupBy("drawing_id").agg(F.min("project_id").alias("by_id"))
    mapped = codes.groupBy(F.upper("code").alias("code")).agg(F.min("project_id").alias("by_code"))
    inside = projects.select("project_id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("drawing_id", F.lit(f"({pattern})"), 1), lambda c: F.upper(c)))).alias("code"))
    only = inside.groupBy("code").agg(F.count_distinct("project_id").alias("n"), F.min("project_id").alias("by_name")).where("n = 1").drop("n")
    out = asked.join(named, "drawing_id", "left").join(mapped, "code", "left").join(only, "code", "left")
    way = F.when(F.col("by_id").isNotNull(), "DRAWING").when(F.col("by_code").isNotNull(), "CODE").when(F.col("by_name").isNotNull(), "NAME").otherwise("NONE")
    return out.select("row_id", F.coalesce("by_id", "by_code", "by_name").alias("project_id"), way.alias("way"))


def direct_evidence(candidates: DataFrame, confirmed: DataFrame) -> DataFrame:
    """The eligible candidates (score from 0.55, coverage from 0.40) of each occurrence with state and whether their use is confirmed.

    candidates: occurrence, rank, design_id, revision_id, score, coverage, state; confirmed: occurrence, design_id. An occurrence whose best two eligible ones are
    closer than 0.05, or whose best is ambiguous, is AMBIGUOUS as a whole. Equal ranks go by score, coverage, then ids.
    """
    able = candidates.where((F.col("score") >= 0.55) & (F.col("coverage") >= 0.40))
    by_rank = Window.partitionBy("occurrence").orderBy("rank", F.desc("score"), F.desc("coverage"), "design_id", "revision_id")
    able = able.withColumn("place", F.row_number().over(by_rank)).withColumn("gap", F.col("score") - F.lead("score").over(by_rank))
    doubt = F.max(F.when(F.col("place") == 1, (F.col("state") == "AMBIGUOUS") | F.coalesce(F.col("gap") < 0.05, F.lit(False)))).over(Window.partitionBy("occurrence"))
    known = confirmed.select("occurrence", "design_id", F.lit(True).alias("known")).distinct()
    out = able.withColumn("doubt", doubt).join(known, ["occurrence", "design_id"], "left")
    return out.select(
        "occurrence", "design_id", "revision_id", "place", "score", F.when(F.col("doubt"), "AMBIGUOUS").otherwise(F.col("state")).alias("state"),
        F.when(F.col("known"), "CONFIRMED").otherwise("UNCONFIRMED").alias("confirmation"),
    )


def threshold_evaluation(cases: DataFrame, candidates: DataFrame, high: float = 0.90, least: int = 20) -> DataFrame:
    """One row of metrics of the first candidates of adjudicated cases, with a warning under `least` matches.

    cases: case_id, outcome, expected; candidates: case_id, rank, design_id, revision_id, score, coverage, state. Equal ranks go by score,
    coverage, then ids.
    """
    best = candidates.groupBy("case_id").agg(F.min_by(F.struct("design_id", "score", "state"), F.struct("rank", -F.col("score"), -F.col("coverage"), "design_id", "revision_id")).alias("top"))
    rows = cases.join(best, "case_id", "left")
    match, right = F.col("outcome") == "MATCH_DESIGN", F.coalesce(F.col("top.design_id") == F.col("expected"), F.lit(False))
    taken = F.col("top.design_id").isNotNull() & (F.col("top.state") != "AMBIGUOUS")
    share = lambda hit, of: F.round(F.coalesce(F.avg(F.when(of, F.when(hit, 1.0).otherwise(0.0))), F.lit(0.0)), 6)
    out = rows.agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(match).alias("matches"), share(right, match).alias("top1"), share(taken, F.lit(True)).alias("coverage"),
        share(right, taken).alias("accuracy"), F.count_if(match & (F.col("top.score") >= high) & ~right).alias("false_high_confidence"),
    )
    return out.withColumn("warning", F.when(F.col("matches") < least, "INSUFFICIENT SAMPLE SIZE"))


def _iou(a: str, b: str) -> Column:
    wide, high = (F.greatest(F.lit(0.0), F.least(F.col(f"{a}max_{c}"), F.col(f"{b}max_{c}")) - F.greatest(F.col(f"{a}min_{c}"), F.col(f"{b}min_{c}"))) for c in "xy")
    area = lambda s: (F.col(f"{s}max_x") - F.col(f"{s}min_x")) * (F.col(f"{s}max_y") - F.col(f"{s}min_y"))
    return F.coalesce(F.try_divide(wide * high, area(a) + area(b) - wide * high), F.lit(0.0))


def match_boxes(truth: DataFrame, found: DataFrame, cell: float = 4.0) -> DataFrame:
    """drawing, truth_id, found_id, iou: greedy one-to-one matches of overlapping boxes of a drawing, the largest overlap first.

    Both: drawing, id and the box. In each round the pairs that are the best of both their boxes match and leave; that gives what taking pairs
    one by one in order of overlap gives. Ties go to smaller ids. Pairs come from a grid; cell is about the size of a box.
    """
    spark = truth.sparkSession
    root = shared_folder(spark, "matches")
    pairs = meeting_boxes(truth, found, cell).select("drawing", F.col("a_id").alias("truth_id"), F.col("b_id").alias("found_id"), _iou("a_", "b_").alias("iou")).where("iou > 0")
    pairs.write.parquet(f"{root}/pairs")
    left = spark.read.parquet(f"{root}/pairs")
    schema, turn = left.schema, 0
    while True:
        order = [F.desc("iou"), "truth_id", "found_id"]
        placed = left.withColumn("i", F.row_number().over(Window.partitionBy("drawing", "truth_id").orderBy(*order)))
        placed = placed.withColumn("j", F.row_number().over(Window.partitionBy("drawing", "found_id").orderBy(*order)))
        placed.where("i = 1 and j = 1").drop("i", "j").write.parquet(f"{root}/found/{turn:04d}")
        won = spark.read.schema(schema).parquet(f"{root}/found/{turn:04d}")
        if won.isEmpty():
            return spark.read.schema(schema).parquet(*[f"{root}/found/{k:04d}" for k in range(turn + 1)])
        rest = left.join(won.select("drawing", "truth_id"), ["drawing", "truth_id"], "left_anti").join(won.select("drawing", "found_id"), ["drawing", "found_id"], "left_anti")
        rest.write.parquet(f"{root}/left/{turn:04d}")
        left, turn = spark.read.schema(schema).parquet(f"{root}/left/{turn:04d}"), turn + 1


#: Least (True) or most (False) allowed value of the metrics of an extraction.
TARGETS = {"count_accuracy": (0.95, True), "mean_iou": (0.90, True), "recall": (0.95, True), "role_accuracy": (0.95, True), "false_claim_rate": (0.05, False), "size_error_pct": (0.10, False)}


def quality_report(truth: DataFrame, found: DataFrame) -> DataFrame:
    """metric, value, target, status (PASS, FAIL, or NONE without a value) of an extraction against the truth.

    Both: drawing, id, role and a box; found also automatic. Metrics: drawings with the right number of boxes; mean IoU over true boxes, 0 where unmatched; true boxes
    matched from an IoU of 0.5 on; right roles among these; automatic boxes without such a match; mean error of the longer side in percent.
    """
    size = lambda s: F.greatest(F.col(f"{s}max_x") - F.col(f"{s}min_x"), F.col(f"{s}max_y") - F.col(f"{s}min_y"))
    pairs = match_boxes(truth, found)
    t = truth.select("drawing", F.col("id").alias("truth_id"), F.col("role").alias("true_role"), size("").alias("true_size"))
    f = found.select("drawing", F.col("id").alias("found_id"), F.col("role").alias("found_role"), "automatic", size("").alias("found_size"))
    good = F.coalesce(F.col("iou") >= 0.5, F.lit(False))
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    error = 100 * F.abs(F.try_divide(F.col("found_size") - F.col("true_size"), F.col("true_size")))
    both = t.withColumn("true", F.lit(True)).join(pairs.hint("merge"), ["drawing", "truth_id"], "left").join(f.hint("merge"), ["drawing", "found_id"], "full")
    true = lambda x: F.when(F.col("true"), x)
    one = both.agg(
        F.avg(true(F.coalesce("iou", F.lit(0.0)))).alias("mean_iou"), F.avg(true(flag(good))).alias("recall"), F.avg(F.when(good, flag(F.col("true_role") == F.col("found_role")))).alias("role_accuracy"),
        F.avg(F.when(good, error)).alias("size_error_pct"), F.avg(F.when(F.col("automatic"), flag(~good))).alias("false_claim_rate"),
    )
    counts = truth.groupBy("drawing").agg(F.count(F.lit(1)).alias("a")).join(found.groupBy("drawing").agg(F.count(F.lit(1)).alias("b")), "drawing", "full")
    same = counts.agg(F.avg(flag(F.col("a").eqNullSafe(F.col("b")))).alias("count_accuracy"))
    row = one.crossJoin(same)  # one row each
    metrics = row.unpivot([], list(TARGETS), "metric", "value")
    limit = F.create_map(*[F.lit(x) for k, (v, _) in TARGETS.items() for x in (k, v)])
    more = F.create_map(*[F.lit(x) for k, (_, up) in TARGETS.items() for x in (k, up)])
    target = F.element_at(limit, F.col("metric"))
    ok = F.when(F.element_at(more, F.col("metric")), F.col("value") >= target).otherwise(F.col("value") <= target)
    return metrics.select("metric", F.round("value", 6).alias("value"), target.alias("target"), F.when(F.col("value").isNull(), "NONE").when(ok, "PASS").otherwise("FAIL").alias("status"))
