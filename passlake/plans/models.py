"""Registered queries of linear models, nested readers, resolution of projects and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from passlake.operators import model as md
from passlake.operators import review as rv
from passlake.operators.evidence import ood_thresholds
from passlake.plans.queries import PV, query, rounded
from passlake.plans.spatial import BOXES, duck, rows
from passlake.sources import bundles as bd
from passlake.folders import shared_folder
from passlake.views import pass_vectors, table

_K = "cast(regexp_extract(props, '([0-9]+)', 1) as double)"


def inputs(s, d):
    """Events with three inputs of a model of their value."""
    sql = f"select event_id, user_id, {_K} as k, cast(event_id % 24 as double) as h, cast(length(event_type) as double) as n, value from {{events}}"
    return s.sql(sql, events=table(s, d, "events"))


@query("m1_pca")
def _(s, d):
    mean, parts, share = md.fit_pca(pass_vectors(s, d), "shape", most=8, variance=0.9)
    found = [(k, j, float(x), float(share[k])) for k, row in enumerate(parts) for j, x in enumerate(row)]
    return rounded(s.createDataFrame(found, "component int, place int, loading double, share double"))


@query("m2_ridge", """
with m as (select avg(l_quantity) mx, avg(l_extendedprice) mp, avg(l_tax) mt from lineitem),
s as (select sum((l_quantity - mx) ** 2) + 10 xx, sum((l_quantity - mx) * (l_extendedprice - mp)) xp, sum((l_quantity - mx) * (l_tax - mt)) xt, any_value(mx) mx, any_value(mp) mp, any_value(mt) mt from lineitem, m)
select 'price' output, round(xp / xx, 4) slope, round(mp - xp / xx * mx, 2) intercept from s union all select 'tax', round(xt / xx, 4), round(mt - xt / xx * mx, 2) from s""")
def _(s, d):
    w = md.fit_ridge(table(s, d, "lineitem"), ["l_quantity"], ["l_extendedprice", "l_tax"], 10.0)
    found = [(name, round(float(w[1, k]), 4) + 0.0, round(float(w[0, k]), 2)) for k, name in enumerate(("price", "tax"))]
    return s.createDataFrame(found, "output string, slope double, intercept double")


@query("m3_ensemble")
def _(s, d):
    penalty, members = md.fit_ensemble(inputs(s, d), ["k", "h", "n"], ["value"], "user_id")
    return rounded(s.createDataFrame([(k, j, penalty, float(x)) for k, w in enumerate(members) for j, x in enumerate(w[:, 0])], "member int, place int, penalty double, weight double"))


@query("m5_score_ensemble")
def _(s, d):
    given, x = inputs(s, d), ["k", "h", "n"]
    _, members = md.fit_ensemble(given, x, ["value"], "user_id")
    told = given.agg(*[f(c).alias(f"{n}_{c}") for c in x for n, f in (("m", F.avg), ("s", F.stddev))]).first()
    centre = {c: (told[f"m_{c}"], told[f"s_{c}"]) for c in x}
    far = given.select(F.sqrt(sum((((F.col(c) - m) / max(v, 1e-9)) ** 2 for c, (m, v) in centre.items()), F.lit(0.0)) / len(x)).alias("z"))
    out = md.score_ensemble(given, x, members, ood_thresholds(far, "z"), centre)
    return rounded(out.select("event_id", "predicted", "disagreement", "distance", "ood", F.size("reasons").alias("n_reasons")))


_BLEND = f"""select event_id, value as baseline, case when event_id % 11 <> 0 then {_K} end as predicted, cast(event_id % 100 as double) / 40 as distance,
    cast(event_id % 7 as double) / 10 as disagreement, cast(2.0 as double) as far from {{events}}"""


@query("m6_blend", f"""
with b as (select *, case when predicted is null or distance > 2 then 0.0 when distance > 1 then 0.5 else 0.85 end alpha from {duck(_BLEND)})
select event_id, alpha::double alpha, round(case when alpha > 0 then alpha * predicted + (1 - alpha) * baseline else baseline end, 6) blended,
  round(greatest(0.0, 1 - distance / 2) / (1 + disagreement), 6) support from b""")
def _(s, d):
    given = rows(s, d, _BLEND)
    return rounded(md.blend(given.withColumn("ood", md.ood_class(F.col("distance"), F.lit(1.0), F.col("far")))).select("event_id", "alpha", "blended", "support"))


_METRICS = """select user_id, case when user_id % 9 <> 0 then avg(value) / 1000 end as improvement, cast(user_id % 10 as double) / 12 as fallback,
    cast(user_id % 7 as double) / 6 as ood_found, cast(user_id % 6 as double) / 15 as rejected from {events} group by user_id"""


@query("m7_quality_gate", f"""
select user_id, coalesce(improvement >= 0.05, false) improvement_ok, fallback <= 0.5 fallback_ok, ood_found >= 0.75 ood_ok, rejected <= 0.2 rejected_ok,
  case when improvement >= 0.05 and fallback <= 0.5 and ood_found >= 0.75 and rejected <= 0.2 then 'PASS' else 'NO_MEANINGFUL_IMPROVEMENT' end status from {duck(_METRICS)}""")
def _(s, d):
    return md.quality_gate(rows(s, d, _METRICS)).drop("improvement", "fallback", "ood_found", "rejected")


# Readers of nested documents: written from the tables, then read back


@query("a3_project_bundles", f"""
select drawing::varchar project_id, id::varchar station_id, round(min_x, 6) min_x, round(max_y, 6) max_y, kind "method" from {duck(BOXES)}""")
def _(s, d):
    box = F.struct("min_x", "min_y", "max_x", "max_y").alias("bbox")
    one = F.struct(F.col("id").cast("string").alias("station_id"), box, F.col("kind").alias("method"), F.lit(1.0).alias("confidence"))
    root = shared_folder(s, "bundles")
    docs = rows(s, d, BOXES).groupBy(F.col("drawing").cast("string").alias("project_id")).agg(F.collect_list(one).alias("stations"))
    docs.write.json(root)  # a document holds one drawing
    found = bd.read_bundles(s, root, lines=True)["stations"]
    return rounded(found.select("project_id", "station_id", F.col("bbox.min_x").alias("min_x"), F.col("bbox.max_y").alias("max_y"), "method"))


@query("a5_metadata", """
select c_custkey row_number, 'C' || c_custkey customer_name, case when c_custkey % 3 = 0 then null else c_mktsegment end market_segment from customer""")
def _(s, d):
    key = F.col("c_custkey")
    dirty = F.when(key % 3 == 0, " N/A ").otherwise(F.concat(F.lit(" "), "c_mktsegment"))
    root = shared_folder(s, "metadata")
    table(s, d, "customer").select(key.alias("row_number"), F.concat(F.lit("C"), key.cast("string")).alias("Customer Name"), dirty.alias("Market-Segment")).write.option("header", True).csv(root)
    return bd.read_metadata(s, root)


@query("a6_sequence_dataset", f"select flower_id::varchar flower_id, ord, pass_id::varchar pass_id, round(list_sum(shape), 6) total from {PV}")
def _(s, d):
    one = F.struct("ord", F.col("pass_id").cast("string").alias("pass_id"), "shape")
    passes = pass_vectors(s, d).groupBy(F.col("flower_id").cast("string").alias("flower_id")).agg(F.array_sort(F.collect_list(one)).alias("p"))
    passes = passes.select("flower_id", F.lit("OPEN").alias("topology"), F.transform("p", lambda x: F.struct(x["pass_id"].alias("pass_id"), x["shape"].alias("shape"))).alias("passes"))
    root = shared_folder(s, "dataset")
    passes.select(F.concat(F.lit("set-"), "flower_id").alias("dataset_id"), F.array(F.struct("flower_id", "topology", "passes")).alias("flowers")).write.json(root)
    found = bd.read_sequence_dataset(s, root, lines=True)["passes"]
    return found.select("flower_id", "ord", "pass_id", F.round(F.aggregate("shape", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("a7_training_corpus", f"select pass_id::varchar sample_id, cast(pass_id % 7 + 2 as integer) station_count, pass_id % 5 <> 0 valid from {PV}")
def _(s, d):
    from passlake.functions.vectors import points

    pts = F.transform(points(F.col("shape")), lambda p: F.array(p["x"], p["y"]))
    short = F.when(F.col("pass_id") % 5 == 0, F.array(pts)).otherwise(F.array(pts, pts))
    root = shared_folder(s, "corpus")
    pass_vectors(s, d).select(
        F.col("pass_id").cast("string").alias("sample_id"), F.lit("train").alias("split"), F.lit("f").alias("family"), (F.col("pass_id") % 7 + 2).cast("int").alias("station_count"),
        F.array(pts, pts).alias("teacher"), short.alias("baseline"),
    ).write.parquet(root)
    return bd.read_corpus(s, root, stations=2, points=32).select("sample_id", "station_count", "valid")


@query("a11_inventory_designs", """
select p_partkey design_id, p_name "name", p_type design_type, p_brand manufacturer, cast(null as varchar) status, p_partkey % 3 = 0 verified from part""")
def _(s, d):
    key = F.col("p_partkey")
    rows = table(s, d, "part").select(
        key.alias("design_id"), F.col("p_name").alias("name"), F.col("p_type").alias("design_type"), F.col("p_brand").alias("manufacturer"), (key % 3 == 0).alias("verified"), "p_size"
    )
    return bd.inventory_view({"designs": rows}, "designs")


@query("a11_inventory_locations", """
select n_nationkey location_id, n_name "name", cast(null as varchar) location_type, n_regionkey parent_location_id from nation""")
def _(s, d):
    rows = table(s, d, "nation").select(F.col("n_nationkey").alias("location_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent_location_id"))
    return bd.inventory_view({"locations": rows}, "locations")


@query("a11_inventory_audit_events", """
select event_id id, 'user' entity_type, user_id entity_key, event_type "action", cast(null as varchar) actor, cast(null as varchar) source from events""")
def _(s, d):
    rows = table(s, d, "events").select(F.col("event_id").alias("id"), F.lit("user").alias("entity_type"), F.col("user_id").alias("entity_key"), F.col("event_type").alias("action"))
    return bd.inventory_view({"audit_events": rows}, "audit_events")


# Resolution and evaluation


@query("e7_resolve_project", """
with r as (select c_custkey row_id, case when c_custkey % 4 = 0 then 'plan_A' || (1000 + c_custkey % 30) || '_x' end drawing_id, case when c_custkey % 4 in (1, 2) then 'A' || (1000 + c_custkey % 40) end code from customer),
p as (select n_nationkey project_id, 'plan_A' || (1000 + n_nationkey) || '_x' drawing_id, 'A' || (1000 + n_nationkey) code from nation),
c as (select 'A' || (1000 + n_nationkey) code, n_nationkey + 100 project_id from nation where n_nationkey % 5 = 0)
select row_id, coalesce(p.project_id, c.project_id, n.project_id) project_id, case when p.project_id is not null then 'DRAWING' when c.project_id is not null then 'CODE'
  when n.project_id is not null then 'NAME' else 'NONE' end way from r left join p on r.drawing_id = p.drawing_id left join c on r.code = c.code left join p n on r.code = n.code""")
def _(s, d):
    key, n = F.col("c_custkey"), F.col("n_nationkey")
    named = lambda x: F.concat(F.lit("plan_A"), (1000 + x).cast("string"), F.lit("_x"))
    asked = table(s, d, "customer").select(
        key.alias("row_id"), F.when(key % 4 == 0, named(key % 30)).alias("drawing_id"), F.when((key % 4).isin(1, 2), F.concat(F.lit("a"), (1000 + key % 40).cast("string"))).alias("code")
    )
    nation = table(s, d, "nation")
    codes = nation.where(n % 5 == 0).select(F.concat(F.lit("A"), (1000 + n).cast("string")).alias("code"), (n + 100).alias("project_id"))
    return rv.resolve_project(asked, nation.select(n.alias("project_id"), named(n).alias("drawing_id")), codes)


CANDIDATES = """select l_orderkey as occurrence, cast(l_linenumber as bigint) * 10000000 + l_partkey * 100 + l_suppkey % 100 as rank, l_partkey as design_id, l_suppkey as revision_id,
    l_discount * 5 + 0.5 as score, 0.3 + l_tax * 5 as coverage, case when l_linestatus = 'O' then 'AMBIGUOUS' else 'HIGH' end as state from {lineitem}"""


@query("e9_direct_evidence", f"""
with c as (select distinct * from ({CANDIDATES.format(lineitem="lineitem")})), f as (select distinct l_orderkey occurrence, l_partkey design_id from lineitem where l_returnflag = 'R'),
a as (select *, row_number() over w place, score - lead(score) over w gap from c where score >= 0.55 and coverage >= 0.40 window w as (partition by occurrence order by rank, score desc, coverage desc, design_id, revision_id, state)),
b as (select *, bool_or(place = 1 and (state = 'AMBIGUOUS' or coalesce(gap < 0.05, false))) over (partition by occurrence) doubt from a)
select b.occurrence, b.design_id, revision_id, cast(place as integer) place, round(score, 6) score, case when doubt then 'AMBIGUOUS' else state end state, case when f.design_id is not null then 'CONFIRMED' else 'UNCONFIRMED' end confirmation
from b left join f on b.occurrence = f.occurrence and b.design_id = f.design_id""")
def _(s, d):
    lines = table(s, d, "lineitem")
    used = lines.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("occurrence"), F.col("l_partkey").alias("design_id"))
    return rounded(rv.direct_evidence(s.sql(CANDIDATES, lineitem=lines).distinct(), used))


@query("g2_threshold_evaluation", f"""
with t as (select * from (select distinct * from ({CANDIDATES.format(lineitem="lineitem")})) qualify row_number() over (partition by occurrence order by rank, score desc, coverage desc, design_id % 40, revision_id) = 1),
r as (select case o_orderstatus when 'F' then 'MATCH_DESIGN' else 'NO_DESIGN' end outcome, o_orderkey % 40 expected, t.design_id % 40 design_id, score, state,
  t.design_id is not null and state <> 'AMBIGUOUS' taken, coalesce(t.design_id % 40 = o_orderkey % 40, false) hit from orders left join t on o_orderkey = occurrence)
select count(*) cases, count(*) filter (outcome = 'MATCH_DESIGN') matches, round(coalesce(avg(hit::int) filter (outcome = 'MATCH_DESIGN'), 0), 6) top1, round(avg(taken::int), 6) coverage,
  round(coalesce(avg(hit::int) filter (taken), 0), 6) accuracy, count(*) filter (outcome = 'MATCH_DESIGN' and score >= 0.9 and not hit) false_high_confidence,
  case when count(*) filter (outcome = 'MATCH_DESIGN') < 20 then 'INSUFFICIENT SAMPLE SIZE' end warning from r""")
def _(s, d):
    found = s.sql(CANDIDATES, lineitem=table(s, d, "lineitem")).distinct().withColumnRenamed("occurrence", "case_id").withColumn("design_id", F.col("design_id") % 40)
    outcome = F.when(F.col("o_orderstatus") == "F", "MATCH_DESIGN").otherwise("NO_DESIGN")
    cases = table(s, d, "orders").select(F.col("o_orderkey").alias("case_id"), outcome.alias("outcome"), (F.col("o_orderkey") % 40).alias("expected"))
    return rv.threshold_evaluation(cases, found)


@query("g6_quality_report")
def _(s, d):
    truth = rows(s, d, BOXES).withColumnRenamed("kind", "role")
    shift = (F.col("id") % 5) * 0.2
    found = truth.where("id % 17 <> 0").withColumn("role", F.when(F.col("id") % 23 == 0, "other").otherwise(F.col("role"))).withColumn("automatic", F.col("id") % 2 == 0)
    return rv.quality_report(truth, found.withColumn("min_x", F.col("min_x") + shift).withColumn("max_x", F.col("max_x") + shift))
