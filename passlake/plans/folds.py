"""Registered queries of ordered folds: chains of the stations of a user's days, bends of a user's kinds of events through the days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passlake.operators import folds
from passlake.plans.queries import query, rounded
from passlake.views import table

_K = "cast(regexp_extract(props, '([0-9]+)', 1) as double)"
#: An event is a chain of entities at the station of its day.
CHAINS = f"""select user_id as drawing, cast(day(ts) as bigint) as station, event_id as chain, value + 1 as length, cast(1 + event_id % 5 as bigint) as n,
    case event_type when 'click' then cast(1.0 as double) when 'error' then cast(0.1 as double) else cast(0.5 as double) end as layer, event_id % 11 = 0 as reference,
    value as min_x, {_K} as min_y, value + 1 + event_id % 50 as max_x, {_K} + cast(event_id % 7 as double) as max_y from {{events}}"""
#: A kind of event is a bend of the pass of its day; its place is the kind's, moved by its sizes.
BENDS = f"""select user_id as flower_id, cast(day(ts) as bigint) as pass, event_type as bend_id,
    cast(floor((case event_type when 'click' then 0.1 when 'error' then 0.3 when 'purchase' then 0.5 when 'view' then 0.7 else 0.9 end + (avg({_K}) - 50) / 400) * 1000000) as double) / 1000000 as u,
    cast(floor((avg(value) - 20) * 1000000) as double) / 1000000 as angle from {{events}} group by 1, 2, 3"""


#: The average of an order that no partition or task changes: angles are cut to whole millionths, where the last digit of a sum of doubles decides.
_IN_ORDER = "transform(filter(array_sort(collect_list(struct(event_id, value))), x -> x.value is not null), x -> x.value)"
ORDERED_BENDS = BENDS.replace("avg(value)", f"aggregate({_IN_ORDER}, cast(0.0 as double), (a, x) -> a + x) / nullif(count(value), 0)")


def rows(s: SparkSession, d: str, sql: str) -> DataFrame:
    return s.sql(sql, events=table(s, d, "events"))


_B = f"""b as (select c.*, low, high, longest, entities, n_plain from ({CHAINS.format(events="events")}) c
    join (select drawing, station, min(min_y) low, max(max_y) high, max(length) longest, sum(n) entities, count(*) filter (not reference) n_plain
    from ({CHAINS.format(events="events")}) group by all) using (drawing, station)),
base as (select *, case when longest > 0 then 0.15::double * (length / longest) else 0 end + 0.2::double * layer + case when n > 1 then 0.02::double else 0 end
    + case when greatest(max_y - min_y, 0) <= greatest(greatest(high - low, 1.0) * 0.35::double, greatest(max_x - min_x, 1e-9) * 0.25::double) and (max_y - min_y > 0.02 or n > 1) then 0.15::double else 0 end
    + greatest(0, 0.35::double * (1 - least(abs((min_y + max_y) / 2 - (low + high) / 2) / greatest((high - low) / 2, 1.0::double), 1.0::double))) + case when layer >= 0.9 then 0.3::double else 0 end base,
    case when n >= 4 and max_x - min_x > 30 and max_y - min_y > 5 and max_y - min_y < greatest(high - low, 1.0) * 0.25::double then 0.25::double else 0.0::double end penalty from b),
st as (select drawing, station, row_number() over (partition by drawing order by station) k, entities, bare, cs from
    (select drawing, station, max(entities) entities, max(n_plain) = 0 bare, list(struct_pack(chain := chain, length := length, n := n, base := base, penalty := penalty)) cs
    from base where n_plain = 0 or not reference group by drawing, station))"""
_SCORE = """case when s.bare then 0.2::double else greatest(0.0::double, least(1.0::double, c.base + case when c.n = f.n then 0.1::double else 0.0::double end
    + case when f.length > 0 then greatest(0.0::double, 0.15::double * (1 - least(abs(c.length - f.length) / f.length, 1.0::double))) else 0.0::double end - c.penalty)) end"""


@query("c5_score_profiles", f"""
with recursive {_B},
fold as (select distinct drawing, 0::bigint k, null::double length, null::bigint n, null::bigint station, null::bigint chain, null::double score, null::double margin, null::bigint n_candidates, false single, 0::bigint entities from st
  union all
  select drawing, k, case when ok then best.length else before end, case when ok then best.n else n_before end, station, case when ok then best.chain end, best.score,
    best.score - coalesce(next.score, 0.0::double), cast(m as bigint), best.n = 1, entities from
  (select drawing, k, before, n_before, station, entities, r[1] best, r[2] next, len(r) m, r[1].score >= 0.6 ok from
   (select f.drawing, s.k, f.length before, f.n n_before, s.station, cast(s.entities as bigint) entities,
     list_sort(list_transform(s.cs, lambda c: struct_pack(a := -({_SCORE}), b := -c.length, chain := c.chain, score := {_SCORE}, length := c.length, n := c.n))) r
    from fold f join st s on s.drawing = f.drawing and s.k = f.k + 1)))
select drawing, station, chain, round(score, 6) score, round(margin, 6) margin, n_candidates, chain is not null and ((single and entities > 1) or margin < 0.15) review,
  array_to_string(list_filter([case when chain is null then 'LOW_SCORE' end, case when chain is not null and single and entities > 1 then 'BROKEN_CONTOUR' end,
    case when chain is not null and n_candidates > 1 and margin < 0.15 then 'AMBIGUOUS' end], lambda x: x is not null), ',') warnings
from fold where k > 0""")
def _(s, d):
    return rounded(folds.score_profiles(rows(s, d, CHAINS)).withColumn("warnings", F.array_join("warnings", ",")))


_TRACKS = f"""
with recursive b as (select *, row_number() over (partition by flower_id order by pass, u, bend_id) k from ({BENDS.format(events="events")})),
fold as (select distinct flower_id, 0::bigint k, []::struct(u double, angle double, last bigint)[] tracks, 0::bigint track from b
  union all
  select flower_id, k, case when spot > len(tracks) then list_append(tracks, struct_pack(u := u, angle := angle, last := pass))
      else list_transform(tracks, lambda t, i: case when i = spot then struct_pack(u := t.u * 0.6::double + u * (1 - 0.6::double), angle := angle, last := pass) else t end) end, spot from
  (select *, cast(case when list_min(costs) <= 0.075 then list_position(costs, list_min(costs)) else len(tracks) + 1 end as bigint) spot from
   (select b.*, f.tracks, list_transform(f.tracks, lambda t: case when t.last = b.pass then 999.0::double
       else abs(t.u - b.u) + case when t.angle * b.angle < 0 then 0.03::double else 0.0::double end end) costs
    from fold f join b on b.flower_id = f.flower_id and b.k = f.k + 1))),
tracked as (select b.flower_id, pass, bend_id, u, angle, track from fold join b on b.flower_id = fold.flower_id and b.k = fold.k)"""


@query("d10_track_bends", f"{_TRACKS} select flower_id, pass, bend_id, u, angle, cast(track as integer) track from tracked")
def _(s, d):
    return folds.track_bends(rows(s, d, ORDERED_BENDS))


@query("d10_pass_signatures", f"""{_TRACKS} select flower_id, pass, string_agg('BZ' || lpad(track::varchar, 2, '0') || ':' || cast(floor(angle * 10 + 0.5) as bigint), ';' order by u, bend_id) signature,
  count(*) n_bends, count(*) filter (abs(angle) >= 1) n_active, round(sum(abs(angle)), 3) total_angle from tracked group by flower_id, pass""")
def _(s, d):
    return folds.pass_signatures(folds.track_bends(rows(s, d, ORDERED_BENDS)))
