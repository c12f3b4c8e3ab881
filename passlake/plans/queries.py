"""Registered queries of the library's own operators, each with DuckDB SQL for the same rows.

Doubles are rounded to six digits in the query and in its SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passlake.functions import vectors as v
from passlake.operators import evidence as ev
from passlake.operators import matching as m
from passlake.operators import sequence as sq
from passlake.views import DUCKDB_PASS_VECTORS, duckdb_view, pass_vectors, table, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PS, BS, DS, OC, US, AS = (duckdb_view(x) for x in ("pass_series", "bend_series", "designs", "occurrences", "usages", "assertions"))
PV = DUCKDB_PASS_VECTORS
#: Points, their steps and box in DuckDB.
PTS = f"""(select *, list_transform(range(0, 32), lambda i: shape[2 * i + 1]) xs, list_transform(range(0, 32), lambda i: shape[2 * i + 2]) ys from {PV})"""
LEN = "list_sum(list_transform(range(1, 32), lambda i: sqrt((xs[i + 1] - xs[i]) ** 2 + (ys[i + 1] - ys[i]) ** 2)))"


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def series(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "pass_series")


def bends(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "bend_series")


# Sequences


@query("h1_transitions", f"""
with n as (select *, lead(width) over w nw, lead(height) over w nh, lead(kind) over w nk from {PS} window w as (partition by flower_id order by ord))
select flower_id, ord, round(nw - width, 6) width_change, round(nh - height, 6) height_change,
  coalesce(nullif(concat_ws('+', case when abs(nh - height) > 0.25 then 'HEIGHT' end, case when nk <> kind then 'KIND' end,
    case when abs(nw - width) > 0.25 then 'WIDTH' end), ''), 'STABLE') classes from n where nw is not null""")
def _(s, d):
    return rounded(sq.transitions(series(s, d)))


@query("c4_filter_outliers", f"""
with n as (select *, median(width) over (partition by flower_id) med, count(*) over (partition by flower_id) c,
  lag(width) over w a, lead(width) over w b from {PS} window w as (partition by flower_id order by ord))
select flower_id, ord, width from n where width >= 0.25 * med and (c < 3 or a is null or b is null
  or abs(width - a) <= 0.75 * abs(width) or abs(width - b) <= 0.75 * abs(width))""")
def _(s, d):
    return sq.filter_outliers(series(s, d)).select("flower_id", "ord", "width")


@query("c6_length_progression", f"""
with n as (select *, list_sort(list(width) over (partition by flower_id))[cast(floor(count(*) over (partition by flower_id) / 2) as bigint) + 1] u from {PS}),
p as (select flower_id, ord, 100 * abs((width - u) / nullif(u, 0)) percent from n)
select flower_id, ord, round(percent, 6) percent, case when percent <= 0.25 then 'CONSISTENT' when percent <= 1 then 'MINOR'
  when percent <= 5 then 'REVIEW' else 'INVALID' end progression from p""")
def _(s, d):
    return rounded(sq.length_progression(series(s, d)))


@query("d3_split_sequences", f"""
with g as (select *, epoch(ts) - lag(epoch(ts)) over (partition by flower_id order by ord) gap from {PS}),
l as (select *, greatest(2.5 * min(gap) filter (where gap > 0) over (partition by flower_id), 120) lim from g)
select flower_id, ord, cast(sum(case when gap > lim then 1 else 0 end) over (partition by flower_id order by ord) as bigint) group_no from l""")
def _(s, d):
    return sq.split_sequences(series(s, d).withColumn("x", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6))


@query("h4_sequence_features", f"""
select flower_id, ord, round(width - lag(width) over w, 6) delta_previous, round(width - first(width) over f, 6) delta_first,
  round(width / nullif(last(width) over f, 0), 6) ratio_final, round(coalesce(ord / nullif(last(ord) over f, 0), 0), 6) progress from {PS}
window w as (partition by flower_id order by ord), f as (partition by flower_id order by ord rows between unbounded preceding and unbounded following)""")
def _(s, d):
    return rounded(sq.sequence_features(series(s, d)))


@query("h7_progress_schedule", f"""
with n as (select flower_id, ord, coalesce(abs(width - lag(width) over (partition by flower_id order by ord)), 0) step from {PS}),
t as (select *, sum(step) over (partition by flower_id) tot, max(ord) over (partition by flower_id) mo from n)
select flower_id, ord, round(case when tot > 1e-12 then sum(step) over (partition by flower_id order by ord) / tot
  else coalesce(ord / nullif(mo, 0), 0) end, 6) progress from t""")
def _(s, d):
    return rounded(sq.progress_schedule(series(s, d)))


@query("h8_subsequences", f"""
with n as (select flower_id, ord, list(kind) over w k, avg(width) over w a from {PS}
  window w as (partition by flower_id order by ord rows between current row and 2 following))
select flower_id, ord, array_to_string(k, '>') members, round(a, 6) mean_width from n where len(k) = 3""")
def _(s, d):
    return rounded(sq.subsequences(series(s, d)))


SMOOTH = f"""(select flower_id, count(*) n_passes, case when count(*) < 3 then 100.0::double
  else 100 * (1 - least(1.0, coalesce(max(j) / nullif(2.5 * avg(j), 0), 0))) end smoothness
  from (select flower_id, abs(width - lag(width) over (partition by flower_id order by ord)) j from {PS}) group by flower_id)"""


@query("h9_smoothness", f"select flower_id, n_passes, round(smoothness, 6) smoothness from {SMOOTH}")
def _(s, d):
    return rounded(sq.smoothness(series(s, d)))


@query("h10_monotone_order", f"""
with r as (select *, kind <> 'error' m, cast(height as bigint) % 7 wanted from {PS}),
k as (select *, row_number() over (partition by flower_id, m order by ord) - 1 k from r)
select flower_id, ord, case when m then cast(k + max(wanted - k) over (partition by flower_id, m order by ord
  rows between unbounded preceding and current row) as bigint) end station from k""")
def _(s, d):
    rows = series(s, d).withColumn("wanted", F.col("height").cast("long") % 7)
    return sq.monotone_order(rows, F.col("kind") != "error")


@query("h11_reconstruction", f"""
with n as (select *, lag(shape) over w a, lead(shape) over w b from {PV} window w as (partition by flower_id order by ord)),
r as (select flower_id, ord, sqrt(list_sum(list_transform(range(1, 65), lambda i: (shape[i] - (a[i] + b[i]) / 2) ** 2)) / 64) rms
  from n where a is not null and b is not null)
select flower_id, ord, round(rms, 6) rms, rms <= 0.15 accepted from r""")
def _(s, d):
    return rounded(sq.reconstruction(pass_vectors(s, d)))


@query("b13_bend_features", f"""
select flower_id, pass, bend_id, round(angle - lag(angle) over w, 6) to_previous, round(lead(angle) over w - angle, 6) to_next,
  case when abs(angle) < 10 then 'LOW' when abs(angle) < 25 then 'MEDIUM' else 'HIGH' end severity from {BS}
window w as (partition by flower_id, pass order by angle, bend_id)""")
def _(s, d):
    return rounded(sq.bend_features(bends(s, d)))


@query("h2_bend_events", f"""
with b as (select * from {BS}), j as (select coalesce(x.flower_id, y.flower_id) flower_id, coalesce(x.pass + 1, y.pass) pass,
  coalesce(x.bend_id, y.bend_id) bend_id, x.angle p, y.angle q from b x full join b y
  on x.flower_id = y.flower_id and x.pass + 1 = y.pass and x.bend_id = y.bend_id)
select flower_id, pass, bend_id, case when p is null then 'NEW' when q is null then 'DEACTIVATED' when p * q < 0 then 'REVERSED'
  when abs(q) - abs(p) > 1 then 'INCREASED' when abs(q) - abs(p) < -1 then 'DECREASED' else 'UNCHANGED' end event
from j where exists (select 1 from b where b.flower_id = j.flower_id and b.pass = j.pass)""")
def _(s, d):
    return sq.bend_events(bends(s, d))


@query("h5_bend_grid", f"""
with b as (select * from {BS}), g as (select * from (select distinct flower_id, pass from b) join (select distinct flower_id, bend_id from b) using (flower_id))
select g.flower_id, g.pass, g.bend_id, coalesce(angle, 0.0) angle, angle is not null active from g left join b using (flower_id, pass, bend_id)""")
def _(s, d):
    return sq.bend_grid(bends(s, d))


@query("h6_bend_history", f"""
with n as (select *, lag(angle) over (partition by flower_id, bend_id order by pass) a from {BS})
select flower_id, bend_id, min(pass) first_pass, max(pass) last_pass, max(abs(angle)) max_angle, max_by(angle, pass) final_angle,
  round(max(abs(angle - a)), 6) largest_step, count(*) filter (where a * angle < 0) reversals from n group by 1, 2""")
def _(s, d):
    return rounded(sq.bend_history(bends(s, d)))


@query("i2_topology_change", f"""
with n as (select flower_id, pass, list_sort(list(distinct bend_id)) ids from {BS} group by 1, 2)
select flower_id, pass, coalesce(ids = lag(ids) over (partition by flower_id order by pass), false) same from n""")
def _(s, d):
    return sq.topology_change(bends(s, d))


LINES = "(select l_orderkey seq, l_linenumber pos, max(l_quantity) size from lineitem group by 1, 2)"


@query("h3_segment_events", f"""
with s as (select * from {LINES}), j as (select coalesce(x.seq + 1, y.seq) seq, coalesce(x.pos, y.pos) pos, x.size p, y.size q from s x full join s y on x.seq + 1 = y.seq and x.pos = y.pos)
select seq, pos, p before, q after, case when p is null then 'ADDED' when q is null then 'REMOVED' when abs(q - p) > 0.1 then 'CHANGED' else 'UNCHANGED' end event from j""")
def _(s, d):
    rows = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("pos"))
    return sq.segment_events(rows.agg(F.max("l_quantity").alias("size")))


@query("f15_candidate_score", f"""
with p as (select *, width / 100 score from {PS}), a as (select flower_id, avg(score) mean, min(score) least, max_by(score, ord) last,
  avg(case when kind <> 'error' then 1.0 else 0.0 end) share from p group by 1)
select a.flower_id, round(0.45 * mean + 0.2 * least + 0.15 * last + 0.1 * smoothness / 100 + 0.1 * share, 6) score from a join {SMOOTH} using (flower_id)""")
def _(s, d):
    rows = series(s, d).withColumn("score", F.col("width") / 100)
    return rounded(sq.candidate_score(rows, F.col("kind") != "error"))


# Vectors


@query("b1_affine_points", f"""
select pass_id, round(list_sum(list_transform(range(1, 33), lambda i: (0.5 * xs[i] - 0.25 * ys[i] + 1) * 25.4)), 6) sum_x,
  round(list_sum(list_transform(range(1, 33), lambda i: (0.25 * xs[i] + 0.5 * ys[i] - 2) * 25.4)), 6) sum_y from {PTS}""")
def _(s, d):
    moved = v.affine(v.points(F.col("shape")), [[0.5, -0.25, 1.0], [0.25, 0.5, -2.0]], 25.4)
    rows = pass_vectors(s, d).select("pass_id", moved.alias("p"))
    return rounded(rows.select("pass_id", v.total(F.col("p.x")).alias("sum_x"), v.total(F.col("p.y")).alias("sum_y")))


@query("b2_path_length", f"select pass_id, round({LEN}, 6) length from {PTS}")
def _(s, d):
    return rounded(pass_vectors(s, d).select("pass_id", v.path_length(v.points(F.col("shape"))).alias("length")))


@query("b3_bbox_features", f"""
select pass_id, round(list_min(xs), 6) min_x, round(list_max(xs), 6) max_x, round(list_min(ys), 6) min_y, round(list_max(ys), 6) max_y,
  round(list_max(xs) - list_min(xs), 6) width, round(list_max(ys) - list_min(ys), 6) height,
  round((list_max(xs) - list_min(xs)) / nullif(list_max(ys) - list_min(ys), 0), 6) aspect, round((list_max(xs) - list_min(xs)) * (list_max(ys) - list_min(ys)), 6) area,
  round(2 * (list_max(xs) - list_min(xs) + list_max(ys) - list_min(ys)), 6) perimeter, round(sqrt((list_max(xs) - list_min(xs)) ** 2 + (list_max(ys) - list_min(ys)) ** 2), 6) diagonal,
  round((list_min(xs) + list_max(xs)) / 2, 6) center_x, round((list_min(ys) + list_max(ys)) / 2, 6) center_y from {PTS}""")
def _(s, d):
    return rounded(pass_vectors(s, d).select("pass_id", v.bbox(v.points(F.col("shape"))).alias("b")).select("pass_id", "b.*"))


@query("b15_feature_vector", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity + l_extendedprice + coalesce(l_tax, 0), 6) total,
  cast(case when l_discount = 0 then 1 else 0 end as bigint) missing from lineitem""")
def _(s, d):
    rate = F.when(F.col("l_discount") != 0, F.col("l_discount"))
    values, mask = v.vector_with_mask(F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_tax"), rate)
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", values.alias("v"), mask.alias("m"))
    return rounded(
        rows.select(
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            "l_suppkey",
            v.total(F.slice("v", 1, 3)).alias("total"),
            F.size(F.filter("m", lambda x: x)).cast("long").alias("missing"),
        )
    )


PAIRS = f"(select *, lead(shape) over (partition by flower_id order by ord) nxt from {PV})"


@query("b20_vector_rms", f"""
select pass_id, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (shape[i] - nxt[i]) ** 2)) / 64), 6) rms,
  round(list_sum(list_transform(range(1, 65), lambda i: 1 - least(1.0, abs(shape[i] - nxt[i])))) / 64, 6) similarity
from {PAIRS} where nxt is not null""")
def _(s, d):
    rows = pass_vectors(s, d).withColumn("nxt", F.lead("shape").over(sq.by_ord())).where("nxt is not null")
    a, b = F.col("shape"), F.col("nxt")
    return rounded(rows.select("pass_id", v.vec_rms(a, b).alias("rms"), v.seq_sim(a, b).alias("similarity")))


@query("b23_roughness", f"""
with f as (select pass_id, list_transform(range(1, 64), lambda i: shape[i + 1] - shape[i]) a from {PV}),
g as (select pass_id, a, list_transform(range(1, 63), lambda i: a[i + 1] - a[i]) b from f),
r as (select pass_id, sqrt(list_sum(list_transform(b, lambda x: x * x)) / 62) / nullif(sqrt(list_sum(list_transform(a, lambda x: x * x)) / 63), 0) roughness from g)
select pass_id, round(roughness, 6) roughness, coalesce(roughness > 0.8, true) rejected from r""")
def _(s, d):
    rows = pass_vectors(s, d).select("pass_id", v.roughness(F.col("shape")).alias("roughness"))
    return rounded(rows.withColumn("rejected", F.coalesce(F.col("roughness") > 0.8, F.lit(True))))


# Matching and ranking

FINALS = f"""(select flower_id, pass_id, shape, list_max(xs) - list_min(xs) w, list_max(ys) - list_min(ys) h, {LEN} len, pass_id % 2 topology
  from {PTS} qualify row_number() over (partition by flower_id order by ord desc) = 1)"""


@query("f5_retrieve_sequences", f"""
with t as (select pass_id target_id, shape ts, list_max(xs) - list_min(xs) tw, list_max(ys) - list_min(ys) th, {LEN} tl, pass_id % 2 topology from {PTS}),
s as (select target_id, flower_id, 0.40 * greatest(0.0, 1 - sqrt(list_sum(list_transform(range(1, 65), lambda i: (shape[i] - ts[i]) ** 2)) / 64))
  + 0.15 * greatest(0.0, 1 - abs(w - tw) / greatest(abs(w), abs(tw), 1e-9)) + 0.15 * greatest(0.0, 1 - abs(h - th) / greatest(abs(h), abs(th), 1e-9))
  + 0.10 * greatest(0.0, 1 - abs(len - tl) / greatest(abs(len), abs(tl), 1e-9)) + 0.05 x from t join {FINALS} f using (topology)),
r as (select target_id, flower_id, round(x / 0.85, 6) score from s),
k as (select *, row_number() over (partition by target_id order by score desc, flower_id) rank from r)
select target_id, flower_id, cast(rank as integer) rank, score, 1.0::double coverage, case when score >= 0.995 then 'EXACT' when score >= 0.9 then 'HIGH'
  when score >= 0.7 then 'MEDIUM' else 'LOW' end band from k where rank <= 3""")
def _(s, d):
    rows = pass_vectors(s, d)
    return m.retrieve_sequences(rows, rows)


@query("e1_catalog_match", f"""
with o as (select o_orderkey occ_id, case when o_orderkey % 5 = 0 then o_orderkey % 2500 end design_id, case when o_orderkey % 5 = 1 then 'dr' || (o_orderkey % 1000) end drawing,
  case when o_orderkey % 5 = 2 then 'f' || (o_orderkey % 1200) end print, (o_orderkey % 50)::double diameter, 900 + (o_orderkey % 1000) / 10 width from orders),
c as (select design_id, 'dr' || (design_id % 700) drawing, 'f' || (design_id % 900) print, diameter, width from {DS}),
h as (select occ_id, 0 place, 'ID' tier, c.design_id from o join c on o.design_id = c.design_id union all select occ_id, 1, 'DRAWING', c.design_id from o join c on o.drawing = c.drawing
  union all select occ_id, 2, 'FINGERPRINT', c.design_id from o join c on o.print = c.print union all select occ_id, 3, 'DIMENSIONS', c.design_id from o join c
  on floor(c.diameter) = floor(o.diameter) and abs(c.diameter - o.diameter) <= 0.1 and abs(c.width - o.width) <= 0.1),
n as (select occ_id, place, tier, count(distinct design_id) n, min(design_id) match from h group by 1, 2, 3 qualify place = min(place) over (partition by occ_id))
select o.occ_id, case when n = 1 then match end match, case when n > 1 then 'REVIEW' else coalesce(tier, 'NONE') end tier from o left join n using (occ_id)""")
def _(s, d):
    key = F.col("o_orderkey")
    occ = table(s, d, "orders").select(
        key.alias("occ_id"), F.when(key % 5 == 0, key % 2500).alias("design_id"), F.when(key % 5 == 1, F.concat(F.lit("dr"), (key % 1000).cast("string"))).alias("drawing"),
        F.when(key % 5 == 2, F.concat(F.lit("f"), (key % 1200).cast("string"))).alias("fingerprint"), (key % 50).cast("double").alias("diameter"), (900 + (key % 1000) / 10).alias("width"),
    )
    key = F.col("design_id")
    names = {"drawings": F.array(F.concat(F.lit("dr"), (key % 700).cast("string"))), "fingerprint": F.concat(F.lit("f"), (key % 900).cast("string"))}
    return m.catalog_match(occ, view(s, d, "designs").select("design_id", "diameter", "width", *[c.alias(n) for n, c in names.items()]))


@query("d9_near_duplicates", f"""
with i as (select role grp, design_id id, diameter length, width, (design_id % 7 + 5)::double height from {DS}),
p as (select b.id, a.id canonical, round(0.5 * greatest(0.0, 1 - abs(a.length - b.length) / greatest(a.length, b.length)) + 0.25 * greatest(0.0, 1 - abs(a.width - b.width) / greatest(a.width, b.width))
  + 0.25 * greatest(0.0, 1 - abs(a.height - b.height) / greatest(a.height, b.height)), 9) score from i a join i b on a.grp = b.grp and a.id < b.id)
select id, canonical, round(score, 6) score, case when score >= 0.995 then 'EXACT' when score >= 0.94 then 'PROFILE' else 'NONE' end link from p where score >= 0.985
qualify row_number() over (partition by id order by canonical) = 1""")
def _(s, d):
    rows = view(s, d, "designs").select(
        F.col("role").alias("grp"), F.col("design_id").alias("id"), F.col("diameter").alias("length"), "width", (F.col("design_id") % 7 + 5).cast("double").alias("height")
    )
    return rounded(m.near_duplicates(rows))


@query("e4_nearest_progress", f"""
with l as (select flower_id key, event_id lid, width lp from {PS} where kind = 'purchase'), r as (select flower_id key, event_id rid, width rp from {PS} where kind = 'signup'),
p as (select key, lid, rid, abs(lp - rp) d from l join r using (key))
select key, lid, rid, round(d, 6) d from p qualify d <= min(d) over (partition by key, lid) + 1e-12""")
def _(s, d):
    rows = series(s, d)
    left = rows.where("kind = 'purchase'").select(F.col("flower_id").alias("key"), F.col("event_id").alias("lid"), F.col("width").alias("lp"))
    right = rows.where("kind = 'signup'").select(F.col("flower_id").alias("key"), F.col("event_id").alias("rid"), F.col("width").alias("rp"))
    return rounded(m.nearest_progress(left, right))


# Evidence, governance, incremental work


@query("e6_orphans", "select l_orderkey, count(*) n from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderkey % 17 <> 0) group by 1")
def _(s, d):
    parents = table(s, d, "orders").where("o_orderkey % 17 <> 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return ev.orphans(table(s, d, "lineitem").select("l_orderkey"), parents, "l_orderkey")


@query("e6_duplicate_keys", "select l_orderkey, l_linenumber, count(*) n from lineitem group by 1, 2 having count(*) > 1")
def _(s, d):
    return ev.duplicate_keys(table(s, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("e8_with_assets", """
with a as (select distinct l_partkey, l_suppkey from lineitem where l_partkey % 5 <> 0),
h as (select l_partkey, count(*) n, bool_or(s_acctbal > 0) v from a join supplier on l_suppkey = s_suppkey group by 1)
select p_partkey design_id, coalesce(n, 0) n_assets, case when v then 'VERIFIED' when n > 0 then 'EXIST' else 'NONE' end state from part left join h on p_partkey = l_partkey""")
def _(s, d):
    pairs = table(s, d, "lineitem").where("l_partkey % 5 <> 0").select(F.col("l_partkey").alias("design_id"), F.col("l_suppkey").alias("s_suppkey")).distinct()
    assets = pairs.join(table(s, d, "supplier"), "s_suppkey").select("design_id", (F.col("s_acctbal") > 0).alias("verified"))
    return ev.with_assets(view(s, d, "designs"), assets)


@query("e3_attach_evidence", """
with e as (select l_orderkey, count(*) n, round(sum(l_extendedprice), 2) v from lineitem where l_returnflag = 'R' group by 1)
select o_orderkey "key", coalesce(n, 0) n, v "value", case when n > 0 then 'ATTACHED' else 'NO_EVIDENCE' end state from orders left join e on o_orderkey = l_orderkey""")
def _(s, d):
    held = table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("key"), F.col("l_extendedprice").alias("value"))
    return ev.attach_evidence(table(s, d, "orders").select(F.col("o_orderkey").alias("key")), held)


@query("g4_usage_relationships", f"""
select design_id, role, count(*) occurrences, count(distinct project_id) projects, min(project_id) first_project from {US} where confirmation = 'confirmed' group by 1, 2""")
def _(s, d):
    return ev.usage_relationships(view(s, d, "usages"))


@query("f12_rank_evidence", f"""
with g as (select role, design_id, min(case confirmation when 'confirmed' then 1 when 'open' then 3 else 4 end) tier, count(distinct project_id) support, max(confirmed_at) latest from {US} group by 1, 2)
select role, row_number() over (partition by role order by tier, support desc, latest desc, design_id) rank, design_id, cast(tier as bigint) tier, support from g qualify rank <= 3""")
def _(s, d):
    return ev.rank_evidence(view(s, d, "usages"))


@query("f13_station_status", f"""
select project_id, case when bool_or(confirmation = 'confirmed') then 'SUPPORTED' when bool_and(confirmation = 'open') then 'AMBIGUOUS' else 'INSUFFICIENT' end status, count(*) n from {US} group by 1""")
def _(s, d):
    return ev.station_status(view(s, d, "usages"))


@query("g3_agreement", f"""
with l as (select case_id, reviewer, max_by(outcome, {{'a': seen, 'b': event_id}}) outcome from {AS} group by 1, 2)
select case_id, count(*) reviewers, case when count(*) < 2 then 'PENDING' when count(distinct outcome) = 1 then 'AGREED' else 'ADJUDICATION' end state from l group by 1""")
def _(s, d):
    return ev.agreement(view(s, d, "assertions"))


@query("k13_latest_review", "select conv_id, max_by(text, {'a': turn, 'b': role, 'c': text}) \"text\" from conversations group by 1")
def _(s, d):
    return ev.latest(table(s, d, "conversations"), ["conv_id"], ["turn", "role", "text"], "text")


FILES = "(select source || '/' || doc_id as path, sha256(text) sha256, doc_id from documents)"
LEDGER = f"(select path, case when doc_id % 10 = 0 then 'old' else sha256 end sha256, case when doc_id % 13 = 0 then 'FAILED' else 'SUCCESS' end status from {FILES} where doc_id % 7 <> 0)"


def files(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"), "doc_id"
    )


def ledger(rows: DataFrame) -> DataFrame:
    return rows.where("doc_id % 7 <> 0").select(
        "path",
        F.when(F.col("doc_id") % 10 == 0, "old").otherwise(F.col("sha256")).alias("sha256"),
        F.when(F.col("doc_id") % 13 == 0, "FAILED").otherwise("SUCCESS").alias("status"),
    )


@query("a1_source_manifest", f"select path, sha256 from {FILES}")
def _(s, d):
    return files(s, d).select("path", "sha256")


@query("k1_plan_batch", f"""
with m as (select path, sha256 from {FILES} where doc_id % 17 <> 0), l as (select * from {LEDGER})
select coalesce(m.path, l.path) path, case when m.path is null then 'STALE' when l.sha256 = m.sha256 and status = 'SUCCESS' then 'SKIP' else 'PROCESS' end action from m full join l on m.path = l.path""")
def _(s, d):
    rows = files(s, d)
    return ev.plan_batch(rows.where("doc_id % 17 <> 0").select("path", "sha256"), ledger(rows))


@query("k7_verify_manifest", f"""
with m as (select path, sha256 from {FILES} where doc_id % 17 <> 0), l as (select * from {LEDGER}),
j as (select coalesce(m.path, l.path) path, case when l.path is null then 'MISSING' when m.path is null then 'UNEXPECTED' when l.sha256 <> m.sha256 then 'HASH_MISMATCH' end issue from m full join l on m.path = l.path)
select * from j where issue is not null""")
def _(s, d):
    rows = files(s, d)
    return ev.verify_manifest(rows.where("doc_id % 17 <> 0").select("path", "sha256"), ledger(rows))


@query("i4_merge_review", """
with o as (select o_orderkey, o_orderstatus from orders where o_orderkey % 3 <> 0 and o_orderstatus = 'F'), n as (select o_orderkey, 'P' o_orderstatus from orders where o_orderkey % 2 = 0)
select * from o union all select * from n where o_orderkey not in (select o_orderkey from o)""")
def _(s, d):
    rows = table(s, d, "orders").select("o_orderkey", "o_orderstatus")
    new = rows.where("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("P"))
    return ev.merge_review(rows.where("o_orderkey % 3 <> 0"), new, "o_orderkey", F.col("o_orderstatus") == "F")


@query("k5_upsert_metadata", """
with a as (select c_custkey, c_name, case when c_custkey % 10 = 0 then 'CHANGED' else c_mktsegment end c_mktsegment from customer),
b as (select c_custkey, case when c_custkey % 4 <> 0 then c_name end c_name, c_mktsegment from customer),
x as (unpivot a on c_name, c_mktsegment into name field value v), y as (unpivot b on c_name, c_mktsegment into name field value v)
select x.c_custkey, x.field, coalesce(y.v, x.v) "value", case when y.v is null then 'UPSERT' when y.v = x.v then 'SAME' else 'CONFLICT' end state from x left join y using (c_custkey, field)""")
def _(s, d):
    store = table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    rows = store.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 10 == 0, "CHANGED").otherwise(F.col("c_mktsegment")))
    held = store.withColumn("c_name", F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")))
    return ev.upsert_metadata(rows, held, "c_custkey", ["c_name", "c_mktsegment"])


@query("k8_grouped_split", """
with b as (select c_custkey, ('0x' || substr(sha256(c_custkey::varchar), 1, 8))::bigint % 100 b from customer)
select c_custkey, case when b < 70 then 'train' when b < 85 then 'validation' else 'test' end split from b""")
def _(s, d):
    return table(s, d, "customer").select("c_custkey", ev.grouped_split(F.col("c_custkey")).alias("split"))


@query("k9_content_hash", """
with h as (select p_brand, sha256(concat_ws('|', p_partkey::varchar, coalesce(p_type, '~'), coalesce(p_size::varchar, '~'))) h from part),
b as (select p_brand, substr(h, 1, 2) b, sha256(string_agg(h, '' order by h)) h from h group by 1, 2)
select p_brand, sha256(string_agg(b || h, '' order by b || h)) hash from b group by 1""")
def _(s, d):
    return ev.content_hash(table(s, d, "part"), "p_brand", ["p_partkey", "p_type", "p_size"])


@query("a2_collision_key", """
with p as (select page_id, regexp_replace(url, '[?#].*$', '') url from pages),
n as (select page_id, url, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\\.[^.]*$', '') stem from p), u as (select distinct url, stem from n)
select url, case when count(*) over (partition by stem) > 1 or stem = 'master' then stem || '-' || substr(sha256(url), 1, 12) else stem end "key" from u""")
def _(s, d):
    return ev.collision_key(table(s, d, "pages").select(F.regexp_replace("url", "[?#].*$", "").alias("url")).distinct(), "url")


@query("g9_calibration", """
with b as (select value, abs(value - 50) err, cast(ntile(5) over (order by value, abs(value - 50)) - 1 as bigint) bin from events)
select bin, count(*) n, min(value) low, max(value) high, round(avg(err), 6) mean_error, round(median(err), 6) median_error, round(quantile_cont(err, 0.9), 6) p90_error from b group by 1""")
def _(s, d):
    rows = table(s, d, "events").select("value", F.abs(F.col("value") - 50).alias("err"))
    return rounded(ev.calibration(rows, "value", "err"))


@query("m4_ood_thresholds", f"""
with r as (select sqrt(list_sum(list_transform(shape, lambda x: x * x)) / 64) x from {PV})
select round(quantile_cont(x, 0.95), 6) near, round(greatest(quantile_cont(x, 0.99), 1.05 * quantile_cont(x, 0.95)), 6) far from r""")
def _(s, d):
    norm = F.sqrt(v.total(F.transform("shape", lambda x: x * x)) / F.size("shape"))
    return rounded(ev.ood_thresholds(pass_vectors(s, d).select(norm.alias("x")), "x"))


@query("g8_corpus_report", """
select 'lang' "dimension", lang "value", count(*) n from documents group by lang union all select 'source', source, count(*) from documents group by source""")
def _(s, d):
    return ev.corpus_report(table(s, d, "documents"), "lang", "source")


@query("g8_leakage", """
select md5(text) "group", list_sort(list(distinct doc_id % 3)) splits from documents group by 1 having count(distinct doc_id % 3) > 1""")
def _(s, d):
    rows = table(s, d, "documents").select(F.md5("text").alias("group"), (F.col("doc_id") % 3).alias("split"))
    return ev.leakage(rows, "group", "split")


@query("k12_detect_stale", """
with u as (select o_orderkey k, o_orderstatus h from orders where o_orderstatus = 'F'), i as (select o_orderkey k, case when o_orderkey % 10 = 0 then 'X' else o_orderstatus end h from orders where o_orderkey % 17 <> 0)
select u.k "key", case when i.k is null then 'INPUT_MISSING' else 'HASH_CHANGED' end reason from u left join i on u.k = i.k where i.k is null or i.h <> u.h""")
def _(s, d):
    rows = table(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("hash"))
    inputs = rows.where("key % 17 <> 0").withColumn("hash", F.when(F.col("key") % 10 == 0, "X").otherwise(F.col("hash")))
    return ev.detect_stale(rows.where("hash = 'F'"), inputs)


@query("i3_unique_warnings", f"select flower_id, kind, event_id, width from {PS} qualify row_number() over (partition by flower_id, kind order by ord) = 1")
def _(s, d):
    return ev.unique_warnings(series(s, d), ["flower_id", "kind"], ["ord"]).select("flower_id", "kind", "event_id", "width")


def group_hash_sql(rows: str, group: str, fields: list[str]) -> str:
    """Query in brackets: group, n, hash as `evidence.group_hash` makes it."""
    text = " || ':' || ".join(f"coalesce({f}::varchar, '~')" for f in fields)
    sums = ", ".join(f"sum(cast('0x' || substr(h, {1 + 15 * k}, 15) as bigint)::hugeint) s{k}" for k in range(4))
    return f"""(select {group}, n, sha256(n || '|' || s0 || '|' || s1 || '|' || s2 || '|' || s3) hash from
      (select {group}, count(*) n, {sums} from (select {group}, sha256({text}) h from {rows}) group by 1))"""


@query("e2_assembly_template", f"select project_id, hash template from {group_hash_sql(OC, 'project_id', ['role', 'design_id'])}")
def _(s, d):
    return ev.assembly_template(view(s, d, "occurrences"))


@query("e2_register_templates", f"""
with t as (select project_id, hash template from {group_hash_sql(OC, 'project_id', ['role', 'design_id'])}), r as (select distinct template from t where project_id % 3 = 0)
select project_id, t.template, case when r.template is null then 'tpl-' || substr(t.template, 1, 16) else 'old-' || substr(t.template, 1, 8) end template_id,
  case when r.template is null then 'CREATED' else 'REUSED' end action, false collision from t left join r using (template)""")
def _(s, d):
    rows = view(s, d, "occurrences")
    held = ev.assembly_template(rows.where("project_id % 3 = 0")).select("template", F.concat(F.lit("old-"), F.substring("template", 1, 8)).alias("template_id"))
    return ev.register_templates(rows, held)


@query("k4_normalise_dims", f"""
with u as (select design_id, diameter, case design_id % 4 when 0 then 'mm' when 1 then 'in' when 2 then 'cm' end unit from {DS})
select design_id, round(diameter * case unit when 'mm' then 1 when 'in' then 25.4 when 'cm' then 10 end, 6) diameter_mm, case when unit is null then 'UNKNOWN' else 'CONFIRMED' end unit_status from u""")
def _(s, d):
    unit = F.when(F.col("design_id") % 4 == 0, "mm").when(F.col("design_id") % 4 == 1, "in").when(F.col("design_id") % 4 == 2, "cm")
    return rounded(ev.normalise_dims(view(s, d, "designs").withColumn("unit", unit), {"mm": 1.0, "in": 25.4, "cm": 10.0}))


@query("g5_totals", "select o_orderstatus, count(*) n, round(sum(o_totalprice), 2) total from orders group by 1")
def _(s, d):
    return table(s, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
