"""Operator 6: mixing sources to target weights by Poisson replication, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passlake.llm.common import Workspace, small

#: Without given weights a source's target share is its size to this power: small sources gain, large ones lose.
POWER = 0.5
SEED = "mix-1"


def uniform(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) of 52 bits of the md5 of seed and keys."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_cdf(mean: Column) -> Column:
    """Poisson probabilities summed from 0 up, as an array that reaches all numbers of 52 bits below 1."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    start = F.struct(
        (-mean).alias("log"), F.exp(-mean).alias("total"), F.array(F.exp(-mean)).alias("sums")
    )

    def step(acc: Column, k: Column) -> Column:
        log = acc["log"] + F.log(mean) - F.log(k.cast("double"))
        total = acc["total"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("total"), F.array_append(acc["sums"], total).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["sums"])


def source_rates(docs: DataFrame, group: str = "source", weights: dict[str, float] | None = None, power: float = POWER) -> DataFrame:
    """group, n_docs, rate: the mean number of copies that gives each group its target share of as many rows.

    weights: target shares by group, in any scale; groups that aren't named get none. None: n_docs ** power.
    """
    sizes = docs.groupBy(F.col(group).alias("__group")).agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        weight = F.pow(F.col("n_docs").cast("double"), F.lit(float(power)))
    else:
        given = F.create_map(*[F.lit(x) for item in weights.items() for x in (item[0], float(item[1]))])
        weight = F.coalesce(F.element_at(given, F.coalesce("__group", F.lit(""))), F.lit(0.0))
    weighted = sizes.withColumn("__w", weight)
    rows, total = weighted.agg(F.sum("n_docs"), F.sum("__w")).first()  # two numbers
    rate = F.col("__w") / F.lit(total) * F.lit(float(rows)) / F.col("n_docs") if total else F.lit(0.0)
    return weighted.select("__group", "n_docs", rate.alias("rate"))


def _mixed(spark: SparkSession, docs: DataFrame, group: str, weights: dict[str, float] | None, power: float, seed: str) -> DataFrame:
    """docs with __n, __copy and __key, in the order of __key."""
    work = Workspace(spark, "mix")
    rates = work.save(source_rates(docs, group, weights, power), "rates")
    rates = rates.select("__group", poisson_cdf(F.col("rate")).alias("__cdf"), F.col("rate").alias("__rate"))
    # One row for each source, behind a count; more sources than that are joined by shuffle.
    joined = docs.join(small(rates, rates.count(), 1000), F.col(group).eqNullSafe(F.col("__group")))
    # The hash is repeated as a value: inside the lambda it would be computed for each step of the distribution.
    u = F.array_repeat(uniform(seed, F.col("doc_id")), F.size("__cdf"))
    passed = F.filter(F.zip_with("__cdf", u, lambda c, x: c <= x), lambda x: x)
    drawn = F.when(F.col("__rate") > 0, F.size(passed)).otherwise(F.lit(0))
    copies = joined.withColumn("__n", drawn.cast("long")).where("__n > 0").drop("__group", "__cdf", "__rate")
    copies = copies.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    keyed = copies.withColumn("__key", uniform(f"{seed}-order", F.col("doc_id"), F.col("__copy")))
    # Keys are even over [0, 1): equal parts of that range are partitions of even size, without a sample.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartitionById(parts, F.floor(F.col("__key") * parts).cast("int"))
    return dealt.sortWithinPartitions("__key", "doc_id", "__copy")


def mix(
    spark: SparkSession,
    docs: DataFrame,
    group: str = "source",
    weights: dict[str, float] | None = None,
    power: float = POWER,
    seed: str = SEED,
) -> DataFrame:
    """docs repeated to target weights in a global random order, with n_copies, copy (from 0) and mix_key.

    Each row gets a number of copies with the Poisson distribution of its group's rate, by inverting
    it at a hash of seed and doc_id: the same row gets the same number in every run and on every
    executor. Rows of one doc_id share the number. All copies are dealt over equal parts of the range of mix_key, a hash of
    doc_id and copy, and sorted by it. Null groups are one group, null doc_ids hash as 'null', texts are not
    looked at, an empty table gives an empty result. Sums run over all rows. Columns of docs named n_copies, copy or mix_key
    give way to these.
    """
    new = {"n_copies": "__n", "copy": "__copy", "mix_key": "__key"}
    out = _mixed(spark, docs, group, weights, power, seed)
    return out.select(*[c for c in docs.columns if c not in new], *[F.col(x).alias(c) for c, x in new.items()])


def mix_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs mixed to the default weights, in their own columns, whatever their names."""
    return _mixed(spark, docs, "source", None, POWER, SEED).select(*docs.columns)


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(spark, docs.select("doc_id", "source", "text"))


OP6_SQL = f"""
with sizes as (select source, count(*) n_docs from documents group by source),
weighted as (select source, n_docs, pow(n_docs, {POWER}) w from sizes),
rates as (select source, w / (select sum(w) from weighted) * (select sum(n_docs) from weighted)::double / n_docs rate from weighted),
steps as (select source, rate, unnest(range(0, cast(ceil(rate + 12 * sqrt(rate) + 30) as bigint) + 1)) k from rates),
logs as (select source, rate, k, -rate + sum(case when k = 0 then 0 else ln(rate) - ln(k) end)
    over (partition by source order by k) log_p from steps),
cdf as (select source, k, sum(exp(log_p)) over (partition by source order by k) c from logs),
lists as (select source, list(c) cs from cdf group by source),
drawn as (select d.doc_id, d.source, d.text, len(list_filter(cs, lambda c:
    c <= cast('0x' || substr(md5('{SEED}:' || d.doc_id), 1, 13) as bigint) / {1 << 52}.0::double)) n_copies
    from documents d join lists l on d.source is not distinct from l.source),
copies as (select *, unnest(range(0, n_copies)) copy from drawn where n_copies > 0)
select doc_id, source, text, cast(n_copies as bigint) n_copies, cast(copy as bigint) copy,
    cast('0x' || substr(md5('{SEED}-order:' || doc_id || ':' || copy), 1, 13) as bigint) / {1 << 52}.0::double mix_key
from copies
"""
