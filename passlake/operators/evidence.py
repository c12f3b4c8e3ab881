"""Joins and roll-ups of evidence: usages, assets, reviews, ledgers, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passlake.operators.ranks import bin_of, cumulative, percentiles


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Children without a parent, counted by key."""
    return child.join(parent, key, "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def with_assets(designs: DataFrame, assets: DataFrame) -> DataFrame:
    """Number of assets of each design and VERIFIED, EXIST or NONE."""
    held = assets.groupBy("design_id").agg(F.count(F.lit(1)).alias("n_assets"), F.max("verified").alias("verified"))
    state = F.when(F.col("verified"), "VERIFIED").when(F.col("n_assets") > 0, "EXIST").otherwise("NONE")
    return designs.join(held, "design_id", "left").select("design_id", F.coalesce("n_assets", F.lit(0)).alias("n_assets"), state.alias("state"))


def attach_evidence(matches: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence of each match by its own key; NO_EVIDENCE where there is none."""
    held = evidence.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value"))
    return matches.join(held, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"), "value", F.when(F.col("n") > 0, "ATTACHED").otherwise("NO_EVIDENCE").alias("state"))


def usage_relationships(usages: DataFrame) -> DataFrame:
    """Confirmed usages by design and role: occurrences and distinct projects."""
    return usages.where("confirmation = 'confirmed'").groupBy("design_id", "role").agg(
        F.count(F.lit(1)).alias("occurrences"), F.count_distinct("project_id").alias("projects"), F.min("project_id").alias("first_project")
    )


def rank_evidence(usages: DataFrame, k: int = 3) -> DataFrame:
    """Designs of a role by tier (1 confirmed, 3 open, 4 else), support and id; the k best."""
    tier = F.when(F.col("confirmation") == "confirmed", 1).when(F.col("confirmation") == "open", 3).otherwise(4)
    grouped = usages.withColumn("tier", tier).groupBy("role", "design_id").agg(
        F.min("tier").cast("long").alias("tier"), F.count_distinct("project_id").alias("support"), F.max("confirmed_at").alias("latest")
    )
    w = Window.partitionBy("role").orderBy("tier", F.desc("support"), F.desc("latest"), "design_id")
    return grouped.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("role", "rank", "design_id", "tier", "support")


def station_status(usages: DataFrame) -> DataFrame:
    """Of each project: SUPPORTED if any usage is confirmed, AMBIGUOUS if all are open, else INSUFFICIENT."""
    return usages.groupBy("project_id").agg(
        F.when(F.bool_or(F.col("confirmation") == "confirmed"), "SUPPORTED")
        .when(F.every(F.col("confirmation") == "open"), "AMBIGUOUS")
        .otherwise("INSUFFICIENT")
        .alias("status"),
        F.count(F.lit(1)).alias("n"),
    )


def agreement(assertions: DataFrame) -> DataFrame:
    """PENDING under two reviewers, AGREED with one distinct outcome of the latest assertions, else ADJUDICATION."""
    latest = assertions.groupBy("case_id", "reviewer").agg(F.max_by("outcome", F.struct("seen", "event_id")).alias("outcome"))
    return latest.groupBy("case_id").agg(F.count(F.lit(1)).alias("reviewers"), F.count_distinct("outcome").alias("outcomes")).select(
        "case_id", "reviewers", F.when(F.col("reviewers") < 2, "PENDING").when(F.col("outcomes") == 1, "AGREED").otherwise("ADJUDICATION").alias("state")
    )


def latest(log: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Latest value of each key of an append-only log."""
    return log.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def plan_batch(manifest: DataFrame, ledger: DataFrame) -> DataFrame:
    """Action for each path: PROCESS new or changed sources, SKIP unchanged successes, STALE vanished ones."""
    both = manifest.join(ledger.select("path", F.col("sha256").alias("old"), "status"), "path", "full_outer")
    action = F.when(F.col("sha256").isNull(), "STALE").when((F.col("old") == F.col("sha256")) & (F.col("status") == "SUCCESS"), "SKIP").otherwise("PROCESS")
    return both.select("path", action.alias("action"))


def verify_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Issues by kind: MISSING, UNEXPECTED, HASH_MISMATCH."""
    both = manifest.join(files.select("path", F.col("sha256").alias("found")), "path", "full_outer")
    issue = F.when(F.col("found").isNull(), "MISSING").when(F.col("sha256").isNull(), "UNEXPECTED").when(F.col("found") != F.col("sha256"), "HASH_MISMATCH")
    return both.select("path", issue.alias("issue")).where("issue is not null")


def merge_review(old: DataFrame, new: DataFrame, key: str, done: Column) -> DataFrame:
    """Completed items stay, and new ones come in only where the key is absent from them."""
    kept = old.where(done)
    return kept.unionByName(new.join(kept.select(key), key, "left_anti"))


def upsert_metadata(rows: DataFrame, store: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row for each key and field: UPSERT where nothing is stored, SAME or CONFLICT (stored value stays)."""
    long = lambda df: df.select(key, *[F.col(f).cast("string") for f in fields]).unpivot(key, fields, "field", "value")
    both = long(rows).where("value is not null").join(long(store).withColumnRenamed("value", "stored"), [key, "field"], "left")
    state = F.when(F.col("stored").isNull(), "UPSERT").when(F.col("stored") == F.col("value"), "SAME").otherwise("CONFLICT")
    return both.select(key, "field", F.coalesce("stored", "value").alias("value"), state.alias("state"))


def grouped_split(group: Column) -> Column:
    """train, validation or test by the first 8 hex digits of the group's SHA-256 modulo 100: 70 / 15 / 15."""
    bucket = F.conv(F.substring(F.sha2(group.cast("string"), 256), 1, 8), 16, 10).cast("long") % 100
    return F.when(bucket < 70, "train").when(bucket < 85, "validation").otherwise("test")


def content_hash(rows: DataFrame, group: str, fields: list[str], digits: int = 2) -> DataFrame:
    """Hash of each group's rows in any order: hashes of rows, sorted within buckets, then over bucket hashes.

    A group has 16 ** digits buckets: take a digit more where groups have 16 times the rows, so that neither list grows.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("~")) for f in fields])
    hashed = rows.select(group, F.sha2(text, 256).alias("h"))
    by = hashed.groupBy(group, F.substring("h", 1, digits).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    return by.groupBy(group).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("b", "h"))), ""), 256).alias("hash"))


def collision_key(rows: DataFrame, path: str) -> DataFrame:
    """Stem of the path, with 12 hex digits of the path's hash where several paths share it."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")
    w = Window.partitionBy("stem")
    out = rows.withColumn("stem", stem).withColumn("n", F.count(F.lit(1)).over(w))
    suffix = F.substring(F.sha2(path, 256), 1, 12)
    return out.select(path, F.when((F.col("n") > 1) | (F.col("stem") == "master"), F.concat_ws("-", "stem", suffix)).otherwise(F.col("stem")).alias("key"))


def calibration(rows: DataFrame, support: str, error: str, bins: int = 5) -> DataFrame:
    """Near-equal bins by support, then error: range of support, mean, median and 90th percentile of error.

    A bin is a row's place in that order, the first bins taking the remainder. Places and percentiles are exact and come from range partitions;
    rows equal in both values are counted, not moved. Rows with nulls take no part.
    """
    given = rows.select(support, error).dropna()
    pair = F.struct(support, error)
    counted = cumulative(given.select(pair.alias("pair")), [], "pair")
    total = counted.agg(F.sum("n").alias("total"))
    placed = counted.crossJoin(F.broadcast(total))  # one row
    first, last = (bin_of(F.col("low") + k, F.col("total"), bins) for k in (F.lit(0), F.col("n") - 1))
    # Equal rows may lie over a border of bins: each bin gets its share of them.
    split = placed.withColumn("bin", F.explode(F.sequence(first, last)))
    size, more = F.floor(F.col("total") / bins), F.col("total") % bins
    start = lambda b: b * size + F.least(b, more)
    inside = F.least(F.col("low") + F.col("n"), start(F.col("bin") + 1)) - F.greatest(F.col("low"), start(F.col("bin")))
    split = split.select("bin", F.col(f"pair.{support}").alias("s"), F.col(f"pair.{error}").alias("e"), inside.alias("k"))
    told = split.groupBy("bin").agg(
        F.sum("k").alias("n"), F.min("s").alias("low"), F.max("s").alias("high"), (F.sum(F.col("e") * F.col("k")) / F.sum("k")).alias("mean_error")
    )
    share = percentiles(split, ["bin"], "e", {"median_error": 0.5, "p90_error": 0.9}, weight="k")
    return told.join(share, "bin").select(F.col("bin").cast("long").alias("bin"), "n", "low", "high", "mean_error", "median_error", "p90_error")


def ood_thresholds(rows: DataFrame, distance: str) -> DataFrame:
    """p95, and p99 or 1.05 times p95 if that is more; exact, from range partitions."""
    got = percentiles(rows, [], distance, {"near": 0.95, "p99": 0.99})
    return got.select("near", F.greatest(F.col("p99"), 1.05 * F.col("near")).alias("far"))


def corpus_report(rows: DataFrame, *dims: str) -> DataFrame:
    """Counts by each dimension on its own, in one pass (grouping sets by unpivoting)."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims])
    return rows.select(F.explode(pairs).alias("x")).groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("n"))


def leakage(rows: DataFrame, group: str, split: str) -> DataFrame:
    """group, splits: the parent groups that stand in more than one split."""
    found = rows.groupBy(group).agg(F.array_sort(F.collect_set(split)).alias("splits"))  # a set of a few split names
    return found.where(F.size("splits") > 1)


def detect_stale(usages: DataFrame, inputs: DataFrame) -> DataFrame:
    """Usages whose input is missing or has another hash, with the reason."""
    both = usages.join(inputs.select("key", F.col("hash").alias("now")), "key", "left")
    reason = F.when(F.col("now").isNull(), "INPUT_MISSING").when(F.col("now") != F.col("hash"), "HASH_CHANGED")
    return both.select("key", reason.alias("reason")).where("reason is not null")


def unique_warnings(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First warning of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def _member(fields: list[str]) -> Column:
    return F.sha2(F.concat_ws(":", *[F.coalesce(F.col(f).cast("string"), F.lit("~")) for f in fields]), 256)


def group_hash(members: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """group, n, hash: a hash of each group's rows, whatever their order and partitions.

    It is made of the count and the sums of the four quarters of the rows' hashes: partial sums merge, so a group of any size needs no list and no task of its own.
    """
    number = lambda k: F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("long")
    # A quarter has 60 bits; sums of its halves stay whole longs up to 2 ** 33 rows, where decimals would be an object for each row and sum.
    halves = [F.sum(half).alias(f"{name}{k}") for k in range(4) for name, half in (("a", F.shiftright(f"q{k}", 30)), ("b", F.col(f"q{k}").bitwiseAND(F.lit(2**30 - 1))))]
    hashed = members.select(group, _member(fields).alias("h")).select(group, *[number(k).alias(f"q{k}") for k in range(4)])
    sums = hashed.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *halves)
    whole = [F.col(f"a{k}").cast("decimal(20,0)") * F.lit(2**30).cast("decimal(10,0)") + F.col(f"b{k}").cast("decimal(20,0)") for k in range(4)]
    return sums.select(group, "n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), *[x.cast("string") for x in whole]), 256).alias("hash"))


def assembly_template(members: DataFrame) -> DataFrame:
    """project_id, template: an order-free hash of each project's members; projects with one hash share a template."""
    return group_hash(members, "project_id", ["role", "design_id"]).select("project_id", F.col("hash").alias("template"))


def register_templates(members: DataFrame, registry: DataFrame) -> DataFrame:
    """project_id, template, template_id, action and collision of each project's assembly: REUSED where the registry (template, template_id) has its hash, else CREATED.

    Ids follow from the hash, so projects of one run that share an assembly create one, and a second run creates none. collision: projects of this hash differ in
    a member; each (hash, member, times) must then stand in all projects of the hash. Repeated registry rows count once, with their least id.
    """
    members = members.select("project_id", "role", "design_id").repartition("project_id")  # once, for hashes and times
    told = assembly_template(members)
    known = registry.groupBy("template").agg(F.min("template_id").alias("held"))
    times = members.groupBy("project_id", "role", "design_id").agg(F.count(F.lit(1)).alias("k"))
    # Members stand by their fields and hashes as 32 bytes: hex strings of both were most of what moved.
    told = told.withColumn("t", F.coalesce(F.unhex("template"), F.col("template").cast("binary")))
    short = told.select("project_id", "t")
    projects = short.groupBy("t").agg(F.count(F.lit(1)).alias("projects"))
    stands = times.join(short.hint("merge"), "project_id").groupBy("t", "role", "design_id", "k").agg(F.count(F.lit(1)).alias("c")).join(projects.hint("merge"), "t")
    clash = stands.groupBy("t").agg(F.max(F.col("c") < F.col("projects")).alias("collision"))
    out = told.join(known, "template", "left").join(clash, "t")
    fresh = F.concat(F.lit("tpl-"), F.substring("template", 1, 16))
    return out.select("project_id", "template", F.coalesce("held", fresh).alias("template_id"), F.when(F.col("held").isNull(), "CREATED").otherwise("REUSED").alias("action"), "collision")


def normalise_dims(designs: DataFrame, factors: dict[str, float]) -> DataFrame:
    """Millimetres where the unit is known; else null and UNKNOWN."""
    factor = F.create_map(*[F.lit(x) for kv in factors.items() for x in kv])[F.col("unit")]
    return designs.select("design_id", (F.col("diameter") * factor).alias("diameter_mm"), F.when(factor.isNull(), "UNKNOWN").otherwise("CONFIRMED").alias("unit_status"))
