"""Registered queries of spatial grouping, over boxes, paths and circles that events place in the drawing of their user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passlake.operators import spatial as sp
from passlake.plans.queries import query, rounded
from passlake.views import table

_K = "cast(regexp_extract(props, '([0-9]+)', 1) as double)"
BOXES = f"""select user_id as drawing, event_id as id, event_type as kind, value as min_x, {_K} as min_y,
    value + 1 + event_id % 5 as max_x, {_K} + 1 + event_id % 3 as max_y from {{events}}"""
PATHS = f"""select drawing, id, x0, y0, x0 + id % 3 - 1 as x1, y0 + cast(floor(id / 3) as bigint) % 3 - 1 as y1
    from (select user_id as drawing, event_id as id, floor(value / 4) as x0, floor({_K} / 4) as y0 from {{events}}) p"""
CIRCLES = f"select user_id as drawing, event_id as id, round(value / 10) as x, round({_K} / 10) as y, cast(1 + event_id % 4 as double) / 4 as radius from {{events}}"
LINES = f"""select drawing, x0, y0, x0 + cast(id % 7 as double) / 10 as x1, y0 as y1
    from (select user_id as drawing, event_id as id, value / 10 as x0, {_K} / 10 as y0 from {{events}}) p"""
VERTICES = f"select user_id as profile, cast({_K} as varchar(20)) as id, value as x, {_K} as y from {{events}}"
SEGMENTS = f"""select user_id as profile, cast(event_id % 900 as varchar(20)) as id, cast({_K} as varchar(20)) as start,
    cast({_K} + event_id % 4 as varchar(20)) as "end" from {{events}}"""
DISTANCE = "sqrt(greatest(a.min_x - b.max_x, b.min_x - a.max_x, 0.0) ** 2 + greatest(a.min_y - b.max_y, b.min_y - a.max_y, 0.0) ** 2)"


def rows(s: SparkSession, d: str, sql: str) -> DataFrame:
    return s.sql(sql.replace('"end"', "`end`"), events=table(s, d, "events"))


def duck(sql: str) -> str:
    return "(" + sql.format(events="events") + ")"


def reach(nodes: str, links: str) -> str:
    """CTEs of components (id, component) over nodes (id) and links (u, v)."""
    return f"""pairs_ as (select u, v from {links} union select v, u from {links}),
reach as (select id, id other from {nodes} union select reach.id, pairs_.v from reach join pairs_ on reach.other = pairs_.u),
comp as (select id, min(other) component from reach group by id)"""


@query("d1_gap_components", f"""
with recursive b as (select * from {duck(BOXES)}), s as (select drawing, greatest(max_x - min_x, max_y - min_y) size from b),
g as (select drawing, list_sort(list(size))[count(*) // 4 + 1] * 1.5 gap from s group by drawing),
l as (select a.id u, b.id v from b a join b on a.drawing = b.drawing and a.id < b.id join g on g.drawing = a.drawing where {DISTANCE} < gap), {reach("b", "l")},
r as (select b.*, component from b join comp on b.id = comp.id),
t as (select drawing, component, count(*) n, min(min_x) min_x, min(min_y) min_y, max(max_x) max_x, max(max_y) max_y from r group by 1, 2)
select r.drawing, r.id, r.component, n, round(t.min_x, 6) min_x, round(t.min_y, 6) min_y, round(t.max_x, 6) max_x, round(t.max_y, 6) max_y
from r join t on r.drawing = t.drawing and r.component = t.component""")
def _(s, d):
    return rounded(sp.gap_components(rows(s, d, BOXES)))


@query("d2_endpoint_chains", f"""
with recursive p as (select * from {duck(PATHS)}), e as (select drawing, id, 0 k, x0 x, y0 y from p union all select drawing, id, 1, x1, y1 from p),
m as (select a.drawing, a.id u, a.k, b.id v from e a join e b on a.drawing = b.drawing and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.05), {reach("p", "m")},
g as (select drawing, u, k, count(*) degree from m group by 1, 2, 3)
select drawing, component chain, count(distinct u) n, count(*) filter (degree = 1) n_ends, max(degree) > 2 branched, min(degree) = 2 and max(degree) = 2 closed
from g join comp on g.u = comp.id group by 1, 2""")
def _(s, d):
    return sp.endpoint_chains(rows(s, d, PATHS))


@query("d4_attach_labels")
def _(s, d):
    boxes = rows(s, d, BOXES)
    labels = boxes.where("kind = 'signup'").withColumn("number", F.col("id") % 10)
    return sp.attach_labels(boxes.where("kind = 'purchase'").withColumn("ord", F.col("id")), labels, 15.0)


@query("d6_box_contains", f"""
with b as (select * from {duck(BOXES)}), o as (select drawing, id, min_x - 5 min_x, min_y - 5 min_y, max_x + 5 max_x, max_y + 5 max_y from b where kind = 'purchase')
select a.drawing, a.id outer_id, b.id inner_id from o a join b on a.drawing = b.drawing and b.kind = 'click'
and a.min_x <= b.min_x and a.min_y <= b.min_y and a.max_x >= b.max_x and a.max_y >= b.max_y""")
def _(s, d):
    return sp.box_join(*_outer_inner(s, d), cell=4.0)


@query("d6_box_meets", f"""
with b as (select * from {duck(BOXES)}), o as (select drawing, id, min_x - 5 min_x, min_y - 5 min_y, max_x + 5 max_x, max_y + 5 max_y from b where kind = 'purchase')
select a.drawing, a.id outer_id, b.id inner_id from o a join b on a.drawing = b.drawing and b.kind = 'click' and {DISTANCE} = 0""")
def _(s, d):
    return sp.box_join(*_outer_inner(s, d), cell=4.0, mode="meets")


def _outer_inner(s, d):
    boxes = rows(s, d, BOXES)
    grown = boxes.where("kind = 'purchase'").selectExpr("drawing", "id", "min_x - 5 as min_x", "min_y - 5 as min_y", "max_x + 5 as max_x", "max_y + 5 as max_y")
    return grown, boxes.where("kind = 'click'")


@query("d7_roller_candidates", f"""
with recursive c as (select * from {duck(CIRCLES)}), n as (select a.id u, b.id v from c a join c b on a.drawing = b.drawing and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.01),
{reach("c", "n")}, r as (select drawing, component roller, count(*) n, avg(x) x, avg(y) y, max(radius) r, count(distinct round(radius, 6)) k, min(radius) low from c join comp using (id) group by 1, 2),
w as (select distinct r.drawing, roller from r join {duck(LINES)} l on r.drawing = l.drawing and sqrt((x0 - x) ** 2 + (y0 - y) ** 2) <= r and sqrt((x1 - x) ** 2 + (y1 - y) ** 2) <= r)
select r.drawing, r.roller, n, round(x, 6) x, round(y, 6) y, round(2 * r, 6) "outer", case when k > 1 then round(2 * low, 6) end bore, w.roller is not null keyway
from r left join w on r.drawing = w.drawing and r.roller = w.roller""")
def _(s, d):
    return rounded(sp.roller_candidates(rows(s, d, CIRCLES), rows(s, d, LINES)))


@query("c8_validate_topology", f"""
with recursive v as (select * from {duck(VERTICES)}), s as (select profile, id, start a, "end" b from {duck(SEGMENTS)}),
dv as (select profile, count(*) n from (select profile, id from v group by 1, 2 having count(*) > 1) group by 1),
ds as (select profile, count(*) n from (select profile, id from s group by 1, 2 having count(*) > 1) group by 1),
u as (select distinct profile, id from v), e as (select profile, a id from s union all select profile, b from s),
mi as (select profile, count(*) n from e anti join u using (profile, id) group by 1),
zl as (select s.profile, count(*) n from s join u on u.profile = s.profile and u.id = s.a where s.a = s.b group by 1),
dg as (select u.profile, u.id, count(e.id) n from u left join e using (profile, id) group by 1, 2),
bd as (select profile, count(*) filter (n = 1) ones, count(*) filter (n not in (1, 2)) n from dg group by 1),
nodes as (select concat_ws('/', profile, id) id, profile from u), l as (select concat_ws('/', profile, a) u, concat_ws('/', profile, b) v from s), {reach("nodes", "l")},
dc as (select profile, count(distinct component) n from nodes join comp using (id) group by 1)
select profile, 'DUPLICATE_VERTEX' issue, n from dv union all select profile, 'DUPLICATE_SEGMENT', n from ds union all select profile, 'MISSING_VERTEX', n from mi
union all select profile, 'ZERO_LENGTH', n from zl union all select profile, 'BAD_DEGREE', case when n > 0 then n else ones end from bd where not (n = 0 and ones in (0, 2))
union all select profile, 'DISCONNECTED', n from dc where n > 1""")
def _(s, d):
    return sp.validate_topology(rows(s, d, VERTICES), rows(s, d, SEGMENTS))
