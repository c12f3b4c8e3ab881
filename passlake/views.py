"""Domain views over the base tables. A template reads the same in Spark SQL and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "pass_series": """select user_id as flower_id,
        cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as ord,
        value as width, cast(regexp_extract(props, '([0-9]+)', 1) as double) as height, event_type as kind, ts, event_id
        from {events}""",
    "bend_series": """select user_id as flower_id, event_type as bend_id, cast(datediff({day}) as bigint) as pass,
        round(avg(value) - 50, 6) as angle from {events} group by 1, 2, 3""",
    "designs": """select p_partkey as design_id, p_type as role, p_brand as family, cast(p_size as double) as diameter,
        p_retailprice as width from {part}""",
    "occurrences": """select l_orderkey as project_id, cast(l_linenumber as bigint) as occurrence, l_partkey as design_id,
        l_suppkey as supplier_id, l_quantity as diameter, l_extendedprice as width, l_returnflag as role, l_linestatus as status,
        l_discount, l_tax, l_shipdate from {lineitem}""",
    "usages": """select l_orderkey as project_id, cast(l_linenumber as bigint) as occurrence, l_partkey as design_id, l_returnflag as role,
        case o_orderstatus when 'F' then 'confirmed' when 'O' then 'open' else 'stale' end as confirmation,
        o_orderdate as confirmed_at from {lineitem} join {orders} on l_orderkey = o_orderkey""",
    "assertions": """select user_id as case_id, event_id % 3 as reviewer, event_type as outcome, ts as seen, event_id from {events}""",
}
#: Tables that meet in a view on a key that most rows hold once or a few times.
MET_ON = {"usages": {"lineitem": "l_orderkey", "orders": "o_orderkey"}}
#: The same day count in either dialect.
DAYS = {"spark": "cast(ts as date), date'2024-01-01'", "duckdb": "'day', date '2024-01-01', ts::date"}


def _tables(name: str) -> set[str]:
    return set(re.findall(r"\{(\w+)\}", VIEWS[name])) - {"day"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain view as a DataFrame.

    Tables that meet are dealt by their key over all shuffle partitions: sorted keys are so small in bytes that Spark would else merge the
    partitions to a few, whose rows (and the aggregates over them, which stay in the same task) grow with the tables.
    """
    sql = VIEWS[name].replace("{day}", DAYS["spark"])
    parts, keys = int(spark.conf.get("spark.sql.shuffle.partitions")), MET_ON.get(name, {})
    given = {t: table(spark, sf_dir, t) for t in _tables(name)}
    return spark.sql(sql, **{t: df.repartition(parts, keys[t]) if t in keys else df for t, df in given.items()})


def duckdb_view(name: str) -> str:
    """A domain view as a DuckDB query in brackets."""
    return f"({VIEWS[name].replace('{day}', DAYS['duckdb']).format(**{t: t for t in _tables(name)})})"


def pass_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass for each embedding: 64 values are 32 points x, y."""
    from pyspark.sql.window import Window

    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("pass_id"),
        F.col("label").cast("long").alias("flower_id"),
        F.col("embedding").cast("array<double>").alias("shape"),
    )
    order = Window.partitionBy("flower_id").orderBy("pass_id")
    return rows.withColumn("ord", (F.row_number().over(order) - 1).cast("long"))


DUCKDB_PASS_VECTORS = """(select vec_id as pass_id, cast(label as bigint) as flower_id,
    list_transform(embedding, lambda x: x::double) as shape,
    row_number() over (partition by label order by vec_id) - 1 as ord from embeddings)"""
