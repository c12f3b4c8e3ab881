"""Rules over rows: classification, eligibility, flags, overrides, import checks and case states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hits(rules: dict[str, Column]) -> Column:
    """Sorted names of the rules that hold; a rule that is null does not."""
    return F.array_sort(F.array_compact(F.array(*[F.when(c, name) for name, c in rules.items()])))


def classify_support(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rule names, whether any holds, and 0.45 plus 0.15 for each, at most 0.95 (0 without)."""
    n = F.size("rules")
    confidence = F.when(n > 0, F.least(F.lit(0.95), 0.45 + 0.15 * n)).otherwise(0.0)
    return df.withColumn("rules", hits(rules)).withColumn("support", n > 0).withColumn("confidence", confidence)


def assign_stage(df: DataFrame, key: str, order: str, composite: Column) -> DataFrame:
    """ENTRY and EXIT at the ends of a sequence, COMPOSITE by rule, SINGLE alone, else FORM."""
    w = Window.partitionBy(key)
    first, last = F.min(order).over(w), F.max(order).over(w)
    stage = (
        F.when(composite, "COMPOSITE")
        .when(first == last, "SINGLE")
        .when(F.col(order) == first, "ENTRY")
        .when(F.col(order) == last, "EXIT")
        .otherwise("FORM")
    )
    return df.withColumn("stage", stage)


def extract_codes(text: Column) -> Column:
    """Codes of a letter and four digits in upper case, each once, in the order of the text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z][0-9]{4})"), F.lit(1)), F.upper))


def eligible(units: Column, verified: Column, superseded: Column, fingerprint: Column, shape: Column) -> Column:
    """State of a candidate revision."""
    return (
        F.when(superseded, "SUPERSEDED")
        .when(verified & fingerprint.isNull(), "NO_FINGERPRINT")
        .when(units == "CONFIRMED", "ELIGIBLE")
        .when(shape.isNotNull(), "SHAPE_ONLY")
        .otherwise("UNKNOWN_UNITS")
    )


def with_mm(df: DataFrame, columns: list[str], status: Column, factor: Column) -> DataFrame:
    """A twin in mm of each column, null unless units are confirmed."""
    return df.withColumns({f"{c}_mm": F.when(status == "CONFIRMED", F.col(c) * factor) for c in columns})


def quality(df: DataFrame, flags: dict[str, Column], evidence: list[Column]) -> DataFrame:
    """Sorted flags, and the least of the evidence that is there."""
    return df.withColumn("flags", hits(flags)).withColumn("confidence", F.least(*evidence))


def apply_overrides(auto: DataFrame, manual: DataFrame, key: str, value: str) -> DataFrame:
    """Manual values before automatic ones, with their origin. Keys may stand on either side only."""
    chosen = manual.select(key, F.col(value).alias("__manual"))
    origin = F.when(F.col("__manual").isNotNull(), "MANUAL").otherwise("AUTO")
    return auto.select(key, value).join(chosen, key, "full_outer").select(key, F.coalesce("__manual", value).alias(value), origin.alias("origin"))


def import_inventory(feed: DataFrame, keys: list[str], order: list[str], review: Column) -> DataFrame:
    """ACCEPTED, REVIEW_REQUIRED or REJECTED with reasons; of rows with one key the first in order is no duplicate."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    out = feed.withColumn("__turn", turn)
    out = out.withColumn("reasons", hits({"MISSING_ID": missing, "DUPLICATE": F.col("__turn") > 1, "REVIEW": review}))
    status = (
        F.when(F.arrays_overlap("reasons", F.array(F.lit("MISSING_ID"), F.lit("DUPLICATE"))), "REJECTED")
        .when(F.size("reasons") > 0, "REVIEW_REQUIRED")
        .otherwise("ACCEPTED")
    )
    return out.withColumn("status", status).drop("__turn")


def validate_sequences(passes: DataFrame) -> DataFrame:
    """Issues (code, key) of passes: repeated ids, vectors that are odd or not finite, sequences of one pass."""
    def issue(df: DataFrame, code: str, key: str) -> DataFrame:
        return df.select(F.lit(code).alias("code"), F.col(key).cast("long").alias("key"))

    twice = passes.groupBy("pass_id").count().where("count > 1")
    odd = passes.where((F.size("shape") % 2 != 0) | F.exists("shape", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    short = passes.groupBy("flower_id").count().where("count < 2")
    return issue(twice, "DUPLICATE_PASS", "pass_id").union(issue(odd, "BAD_VECTOR", "pass_id")).union(issue(short, "TOO_FEW_PASSES", "flower_id"))


def case_state(assertions: DataFrame, least: int = 2) -> DataFrame:
    """Of each case: reviewers, its latest outcome and LOCKABLE (enough reviewers, one outcome), OPEN or DISPUTED."""
    found = assertions.groupBy("case_id").agg(
        F.count_distinct("reviewer").alias("reviewers"), F.count_distinct("outcome").alias("outcomes"), F.max_by("outcome", F.struct("seen", "event_id")).alias("latest")
    )
    state = F.when(F.col("reviewers") < least, "OPEN").when(F.col("outcomes") == 1, "LOCKABLE").otherwise("DISPUTED")
    return found.select("case_id", "reviewers", "latest", state.alias("state"))


def promote(cases: DataFrame, held: DataFrame, key: str, match: Column) -> DataFrame:
    """Matched cases that are not held yet, each once."""
    return cases.where(match).select(key).distinct().join(held.select(key), key, "left_anti")


def apply_reviews(passes: DataFrame, decisions: DataFrame, key: str, group: str) -> DataFrame:
    """Of each group: its passes, those decided, accepted, and whether all are decided."""
    done = decisions.select(key, F.col("decision"))
    joined = passes.select(key, group).join(done, key, "left")
    return joined.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("decision").alias("decided"),
        F.count_if(F.col("decision") == "ACCEPT").alias("accepted"),
        (F.count("decision") == F.count(F.lit(1))).alias("complete"),
    )


def build_master(children: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The latest row of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return children.withColumn("__turn", F.row_number().over(w)).where("__turn = 1").drop("__turn")
