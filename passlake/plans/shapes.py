"""Registered queries of shapes and of sequences of at most 25 passes, over the embeddings: 64 values are 32 points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passlake.functions import shapes as sh
from passlake.functions.vectors import points, rel_sim
from passlake.functions.vectors import turns as turn_angles
from passlake.operators import alignment as al
from passlake.operators import shape_rules as sr
from passlake.plans.queries import PTS, query, rounded
from passlake.views import pass_vectors, table

BLOCK = 25
#: Passes with points, headings and turns; a sequence is a block of a label's passes.
SEQ = f"""(select pass_id, label * 1000 + block flower_id, label, block, o % {BLOCK} ord, shape, xs, ys, pass_id % 2 topology, h,
    list_transform(range(1, 31), lambda i: abs(h[i + 1] - h[i] - 2 * pi() * round((h[i + 1] - h[i]) / (2 * pi())))) t,
    case when count(*) over w > 1 then (o % {BLOCK})::double / (count(*) over w - 1) else 0.0 end progress
    from (select pass_id, flower_id as label, ord o, cast(floor(ord / {BLOCK}) as bigint) block, shape, xs, ys,
    list_transform(range(1, 32), lambda i: atan2(ys[i + 1] - ys[i], xs[i + 1] - xs[i])) h from {PTS}) p window w as (partition by label, block))"""
_FAR = "list_min(list_transform(range(1, 33, 4), lambda k: sqrt(({0}.xs[i] - {1}.xs[k]) ** 2 + ({0}.ys[i] - {1}.ys[k]) ** 2)))"
_NEAREST = "list_transform(range(1, 33, 4), lambda i: " + _FAR + ")"
_ASPECT = "((list_max({0}.xs) - list_min({0}.xs)) / nullif(list_max({0}.ys) - list_min({0}.ys), 0))"
#: CTE `scored` over `met`, pairs of passes a and b of SEQ.
METRICS = f"""metrics as (select a, b, sqrt(list_sum(list_transform(range(1, 33), lambda i: (a.xs[i] - b.xs[i]) ** 2 + (a.ys[i] - b.ys[i]) ** 2)) / 32) rms,
    {_NEAREST.format("a", "b")} n1, {_NEAREST.format("b", "a")} n2,
    list_avg(list_transform(range(1, 32), lambda i: 1 - abs(a.h[i] - b.h[i] - 2 * pi() * round((a.h[i] - b.h[i]) / (2 * pi()))) / pi())) tangent,
    greatest(0.0, 1 - list_sum(list_transform(range(1, 31), lambda i: abs(a.t[i] - b.t[i]))) / (30 * pi())) corner, {_ASPECT.format("a")} aa, {_ASPECT.format("b")} ab from met),
parts as (select *, 0.25 * greatest(0.0, 1 - rms) + 0.20 * (1 - least(1.0, (list_avg(n1) + list_avg(n2)) / 2)) + 0.15 * tangent + 0.25 * corner
    + 0.05 * coalesce(greatest(0.0, 1 - abs(aa - ab) / greatest(abs(aa), abs(ab), 1e-9)), 0) + 0.05 * (a.topology = b.topology)::int
    + 0.05 * greatest(0.0, 1 - abs(a.progress - b.progress)) total,
    0.90 + 0.05 * (aa is not null and ab is not null)::int + 0.05 * (a.topology = b.topology)::int weight from metrics),
scored as (select a, b, round(total / weight, 6) score, round(weight, 6)::double coverage, round(greatest(list_max(n1), list_max(n2)), 6) hausdorff from parts)"""
HELD = "s a join s b on a.block = 0 and b.label = (a.label + 1) % 10"


def sequences(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    rows = pass_vectors(s, d).withColumn("block", F.floor(F.col("ord") / BLOCK)).withColumn("label", F.col("flower_id"))
    n = F.count(F.lit(1)).over(Window.partitionBy("label", "block"))
    at = (F.col("ord") % BLOCK).cast("long")
    progress = F.when(n > 1, at.cast("double") / (n - 1)).otherwise(0.0)
    return rows.select(
        "pass_id", (F.col("label") * 1000 + F.col("block")).alias("flower_id"), "label", "block", progress.alias("progress"), at.alias("ord"), "shape", (F.col("pass_id") % 2).alias("topology")
    )


def held(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The first sequence of each label, all sequences, and links with those of the next label."""
    rows = sequences(s, d)
    names = rows.select("flower_id", "label", "block").distinct()
    links = names.where("block = 0").select("flower_id", ((F.col("label") + 1) % 10).alias("label")).join(names.select(F.col("flower_id").alias("history_id"), "label"), "label")
    return rows.where("block = 0"), rows, links


def neighbours(s: SparkSession, d: str) -> DataFrame:
    """Each pass beside the one of the same place in the next label."""
    rows = sequences(s, d)
    side = lambda x: rows.select(*[F.col(c).alias(f"{x}_{c}") for c in ("pass_id", "label", "block", "ord", "shape", "topology", "progress")])
    on = [(F.col("a_label") + 1) % 10 == F.col("b_label"), F.col("a_block") == F.col("b_block"), F.col("a_ord") == F.col("b_ord")]
    return side("a").join(side("b"), on)


def unpacked(df: DataFrame, keys: list[str], flat: str = "shape") -> DataFrame:
    """A row for each point of a flat shape."""
    out = df.select(*keys, F.posexplode(points(F.col(flat))).alias("k", "p"))
    return rounded(out.select(*keys, F.col("k").cast("long").alias("k"), (F.col("p.x") + 0.0).alias("x"), (F.col("p.y") + 0.0).alias("y")))


NEXT = "s a join s b on (a.label + 1) % 10 = b.label and a.block = b.block and a.ord = b.ord"
LENGTHS = "list_transform(range(1, 32), lambda i: sqrt((xs[i + 1] - xs[i]) ** 2 + (ys[i + 1] - ys[i]) ** 2))"


@query("b4_resample", f"""
with p as (select pass_id, xs, ys, {LENGTHS} d from {PTS}), c as (select *, list_transform(range(0, 32), lambda i: coalesce(list_sum(d[1:i]), 0.0)) cum from p),
k as (select *, unnest(range(0, 16)) k from c), t as (select *, k * cum[32] / 15 far from k),
i as (select *, greatest(1, least(31, len(list_filter(cum, lambda x: x <= far)))) i from t)
select pass_id, k, round(xs[i] + case when d[i] > 0 then (far - cum[i]) / d[i] else 0 end * (xs[i + 1] - xs[i]), 6) x,
  round(ys[i] + case when d[i] > 0 then (far - cum[i]) / d[i] else 0 end * (ys[i + 1] - ys[i]), 6) y from i""")
def _(s, d):
    return unpacked(pass_vectors(s, d).select("pass_id", sh.resample(F.col("shape"), 16).alias("shape")), ["pass_id"])


@query("b6_canonical_closed", f"""
with m as (select pass_id, xs, ys, list_avg(xs) mx, list_avg(ys) my from {PTS}),
r as (select *, sqrt(list_sum(list_transform(range(1, 33), lambda i: (xs[i] - mx) ** 2 + (ys[i] - my) ** 2)) / 32) r from m),
g as (select pass_id, list_transform(range(1, 33), lambda i: [round((xs[i] - mx) / r, 6) + 0.0, round((ys[i] - my) / r, 6) + 0.0]) ring from r),
b as (select pass_id, list_sort(list_concat(list_transform(range(1, 33), lambda i: list_concat(ring[i:], ring[1:i - 1])),
  list_transform(range(1, 33), lambda i: list_concat(list_reverse(ring)[i:], list_reverse(ring)[1:i - 1]))))[1] best from g)
select pass_id, k, best[k + 1][1] x, best[k + 1][2] y from (select *, unnest(range(0, 32)) k from b)""")
def _(s, d):
    return unpacked(pass_vectors(s, d).select("pass_id", sh.canonical_closed(F.col("shape")).alias("shape")), ["pass_id"])


@query("b10_outline", f"""
with p as (select pass_id, xs, ys, list_transform(range(1, 33), lambda i: xs[i] * ys[i % 32 + 1] - xs[i % 32 + 1] * ys[i]) c,
  list_sum(list_transform(range(1, 33), lambda i: sqrt((xs[i % 32 + 1] - xs[i]) ** 2 + (ys[i % 32 + 1] - ys[i]) ** 2))) n from {PTS}),
a as (select *, list_sum(c) / 2 a from p)
select pass_id, round(abs(a), 6) area, round(n, 6) perimeter, round(4 * pi() * abs(a) / n ** 2, 6) compactness,
  round(case when abs(a) > 1e-12 then list_sum(list_transform(range(1, 33), lambda i: (xs[i] + xs[i % 32 + 1]) * c[i])) / (6 * a) else list_avg(xs) end, 4) x,
  round(case when abs(a) > 1e-12 then list_sum(list_transform(range(1, 33), lambda i: (ys[i] + ys[i % 32 + 1]) * c[i])) / (6 * a) else list_avg(ys) end, 4) y from a""")
def _(s, d):
    rows = pass_vectors(s, d).select("pass_id", sh.outline(F.col("shape")).alias("o"))
    at = dict(zip(sh.OUTLINE, range(len(sh.OUTLINE)), strict=True))
    return rows.select("pass_id", *[F.round(F.get("o", F.lit(at[c])), 4 if c in "xy" else 6).alias(c) for c in ("area", "perimeter", "compactness", "x", "y")])


@query("b10_hull")
def _(s, d):
    rows = pass_vectors(s, d).select("pass_id", sh.outline(F.col("shape")).alias("o"))
    return rounded(rows.select("pass_id", *[F.get("o", F.lit(k)).alias(c) for k, c in enumerate(sh.OUTLINE) if c in ("hull_area", "solidity", "valid")]))


_MIRROR = "list_avg(list_transform(range(1, 33), lambda i: list_min(list_transform(range(1, 33), lambda k: sqrt(({0}) ** 2 + ({1}) ** 2)))))"


@query("b11_symmetry", f"""
with p as (select pass_id, xs, ys, (list_min(xs) + list_max(xs)) cx, (list_min(ys) + list_max(ys)) cy,
  greatest(list_max(xs) - list_min(xs), list_max(ys) - list_min(ys), 1e-9) w from {PTS}),
m as (select pass_id, greatest(0.0, 1 - {_MIRROR.format("xs[i] - (cx - xs[k])", "ys[i] - ys[k]")} / w) sx, greatest(0.0, 1 - {_MIRROR.format("xs[i] - xs[k]", "ys[i] - (cy - ys[k])")} / w) sy from p)
select pass_id, round(sx, 6) sx, round(sy, 6) sy, round(greatest(sx, sy), 6) best from m""")
def _(s, d):
    rows = pass_vectors(s, d).select("pass_id", sh.symmetry(F.col("shape")).alias("o"))
    return rounded(rows.select("pass_id", *[F.get("o", F.lit(k)).alias(c) for k, c in enumerate(("sx", "sy", "best"))]))


@query("b12_segment_features", f"""
with p as (select pass_id, xs, ys, {LENGTHS} d, list_transform(range(1, 32), lambda i: atan2(ys[i + 1] - ys[i], xs[i + 1] - xs[i])) h from {PTS}),
t as (select *, list_transform(list_transform(range(1, 31), lambda i: degrees(h[i + 1] - h[i])), lambda x: case when x > 180 then x - 360 when x <= -180 then x + 360 else x end) t from p),
c as (select *, list_concat(list_concat([0], list_filter(range(1, 31), lambda i: abs(t[i]) >= 60)), [31]) cuts from t),
e as (select *, unnest(list_transform(range(1, len(cuts)), lambda k: [cuts[k], cuts[k + 1]])) e from c),
s as (select *, e[1] a, e[2] b, list_sum(d[e[1] + 1:e[2]]) n, t[e[1] + 1:e[2] - 1] inside from e)
select pass_id, cast(a as bigint) "first", cast(b as bigint) "last", round(n / list_sum(d), 6) span, round(n, 6) length, round(sqrt((xs[b + 1] - xs[a + 1]) ** 2 + (ys[b + 1] - ys[a + 1]) ** 2), 6) chord,
  round(degrees(atan2(ys[b + 1] - ys[a + 1], xs[b + 1] - xs[a + 1])), 4) orientation, round(coalesce(list_sum(inside), 0) / n, 3) curvature,
  case when n <= 1e-9 then 'DEGENERATE' when len(list_filter(inside, lambda x: abs(x) > 2)) = 0 then 'STRAIGHT' else 'CURVED' end kind from s""")
def _(s, d):
    rows = pass_vectors(s, d).select("pass_id", F.explode(sh.segments(F.col("shape"), 60.0)).alias("p"))
    part = {c: F.get("p", F.lit(k)) for k, c in enumerate(sh.SEGMENT)}
    digits = {"span": 6, "length": 6, "chord": 6, "orientation": 4, "curvature": 3}
    kind = F.get(F.array(*[F.lit(k) for k in sh.KINDS]), part["kind"].cast("int"))
    return rows.select("pass_id", *[part[c].cast("long").alias(c) for c in ("first", "last")], *[F.round(part[c], n).alias(c) for c, n in digits.items()], kind.alias("kind"))


@query("b22_length_rebuild", f"""
with s as (select * from {SEQ}), m as (select a.pass_id, a.xs px, a.ys py, a.h ph, b.xs rx, b.ys ry from {NEXT}),
w as (select *, list_transform(range(1, 32), lambda i: sqrt((rx[i + 1] - rx[i]) ** 2 + (ry[i + 1] - ry[i]) ** 2)) l from m),
c as (select *, list_transform(range(0, 32), lambda i: coalesce(list_sum(list_transform(range(1, i + 1), lambda k: l[k] * cos(ph[k]))), 0)) x,
  list_transform(range(0, 32), lambda i: coalesce(list_sum(list_transform(range(1, i + 1), lambda k: l[k] * sin(ph[k]))), 0)) y from w)
select pass_id, k, round(x[k + 1] - list_avg(x) + list_avg(px), 6) x, round(y[k + 1] - list_avg(y) + list_avg(py), 6) y from (select *, unnest(range(0, 32)) k from c)""")
def _(s, d):
    return unpacked(neighbours(s, d).select(F.col("a_pass_id").alias("pass_id"), sh.rebuilt(F.col("a_shape"), F.col("b_shape")).alias("shape")), ["pass_id"])


@query("f6_compare_passes", f"""
with s as (select * from {SEQ}), met as (select a, b from {NEXT}), {METRICS}
select a.pass_id a_pass_id, b.pass_id b_pass_id, score, coverage, hausdorff from scored""")
def _(s, d):
    return al.compare_passes(neighbours(s, d)).select("a_pass_id", "b_pass_id", "score", "coverage", "hausdorff")


@query("f8_pass_top3", f"""
with s as (select * from {SEQ}), met as (select a, b from {HELD} and a.topology = b.topology), {METRICS},
r as (select a.pass_id pass_id, b.pass_id match_id, row_number() over (partition by a.pass_id order by score desc, b.pass_id) rank, score, coverage,
  round(100 * score * (0.5 + 0.5 * coverage) * (case when score >= 0.9 then 1.0 else 0.75 end) * (case when coverage < 1 then 0.8 else 1.0 end), 6) support from scored qualify rank <= 3)
select pass_id, match_id, cast(rank as integer) rank, score, coverage, support, case when support >= 85 then 'HIGH' when support >= 70 then 'GOOD' when support >= 50 then 'LIMITED' else 'LOW' end band from r""")
def _(s, d):
    return al.pass_top3(*held(s, d))


@query("f9_best_subsequence", f"""
with s as (select * from {SEQ}), met as (select a, b from {HELD}), {METRICS},
g as (select a.flower_id f, b.flower_id h, a.ord - b.ord dg, a.ord i, b.ord j, score, greatest(0.0, 1 - abs(a.progress - b.progress)) near from scored),
n as (select flower_id f, count(*) n from s group by 1),
r as (select x.f, x.h, x.i start, x.j other, y.i e, count(*) over w length, avg(y.score) over w mean, min(y.score) over w least, avg(y.near) over w near
  from g x join g y on x.f = y.f and x.h = y.h and x.dg = y.dg and y.i >= x.i window w as (partition by x.f, x.h, x.dg, x.i order by y.i)),
q as (select r.f, h, start, other, length, round(mean, 6) mean, least, round(0.60 * mean + 0.15 * least + 0.20 * length / n + 0.05 * near, 6) alignment, mean raw
  from r join n on r.f = n.f where length = e - start + 1 and length >= case when n < 3 then 2 else 3 end),
k as (select *, row_number() over (partition by f order by alignment desc, length desc, mean desc, least desc, h, other, start) rank from q where raw >= 0.35 and alignment >= 0.40 qualify rank <= 3)
select f flower_id, h source_id, cast(rank as integer) rank, start, other source_start, length, alignment, mean, least from k""")
def _(s, d):
    return al.best_subsequence(*held(s, d))


@query("f10_align_sequences")
def _(s, d):
    generated, history, links = held(s, d)
    bends = F.size(F.filter(turn_angles(points(F.col("shape"))), lambda t: F.abs(t) >= 60))
    side = lambda df, x: df.withColumn("bends", bends).select(*[F.col(c).alias(f"{x}_{c}") for c in ("flower_id", "ord", "shape", "progress", "bends")])
    named = links.select(F.col("flower_id").alias("a_flower_id"), F.col("history_id").alias("b_flower_id"))
    costs = al.match_costs(side(generated, "a").join(named, "a_flower_id").join(side(history, "b"), "b_flower_id"))
    return rounded(al.align_sequences(costs.withColumnRenamed("a_flower_id", "a_id").withColumnRenamed("b_flower_id", "b_id")))


_FOOT = "greatest(0.0, least(1.0, (({p}.xs[i] - {q}.xs[k]) * ({q}.xs[k + 1] - {q}.xs[k]) + ({p}.ys[i] - {q}.ys[k]) * ({q}.ys[k + 1] - {q}.ys[k])) / greatest(({q}.xs[k + 1] - {q}.xs[k]) ** 2 + ({q}.ys[k + 1] - {q}.ys[k]) ** 2, 1e-18)))"
_TO = f"""list_transform(range(1, 33), lambda i: list_min(list_transform(range(1, 32), lambda k: sqrt(({{p}}.xs[i] - {{q}}.xs[k] - {_FOOT} * ({{q}}.xs[k + 1] - {{q}}.xs[k])) ** 2
    + ({{p}}.ys[i] - {{q}}.ys[k] - {_FOOT} * ({{q}}.ys[k + 1] - {{q}}.ys[k])) ** 2))))"""


@query("f11_contour_deviation", f"""
with s as (select * from {SEQ}), m as (select a.pass_id a_pass_id, b.pass_id b_pass_id, list_concat({_TO.format(p="a", q="b")}, {_TO.format(p="b", q="a")}) far from {NEXT})
select a_pass_id, b_pass_id, round(list_max(far), 6) hausdorff, round(list_avg(far), 6) mean from m""")
def _(s, d):
    rows = neighbours(s, d).select("a_pass_id", "b_pass_id", sh.contour_deviation(F.col("a_shape"), F.col("b_shape")).alias("o"))
    return rounded(rows.select("a_pass_id", "b_pass_id", F.get("o", F.lit(0)).alias("hausdorff"), F.get("o", F.lit(1)).alias("mean")))


@query("f14_adapt_templates", f"""
with s as (select * from {SEQ}), n as (select flower_id, count(*) n from s group by 1), rows as (select *, row_number() over (partition by flower_id order by ord) - 1 k from s),
t as (select a.pass_id target_id, a.shape target, b.flower_id source_id, 8 + a.pass_id % 5 stations from s a join (select distinct flower_id, label, block from s) b
  on a.ord = 0 and b.block = a.block and b.label = (a.label + 1) % 10),
e as (select t.*, n, unnest(range(0, stations)) station from t join n on n.flower_id = t.source_id),
p as (select *, station * (n - 1)::double / (stations - 1) far from e),
b as (select p.*, list_transform(range(1, 65), lambda i: l.shape[i] * (1 - (far - floor(far))) + h.shape[i] * (far - floor(far))) between_ from p
  join rows l on l.flower_id = source_id and l.k = floor(far) join rows h on h.flower_id = source_id and h.k = ceil(far)),
g as (select *, max(case when station = stations - 1 then sqrt(list_sum(list_transform(range(1, 65), lambda i: (between_[i] - target[i]) ** 2)) / 64) end) over (partition by target_id, source_id) gap from b)
select target_id, source_id, station, round(list_sum(case when station = stations - 1 then target else between_ end), 6) total,
  case when gap <= 0.05 then 'PASS' when gap <= 0.15 then 'WARN' else 'MISMATCH' end state, round(0.9 * 0.8 * case when gap <= 0.05 then 1.0 else 0.85 end, 6)::double confidence from g""")
def _(s, d):
    rows = sequences(s, d)
    names = rows.select(F.col("flower_id").alias("source_id"), F.col("label").alias("to"), F.col("block").alias("at_block")).distinct()
    first = rows.where("ord = 0").select(F.col("pass_id").alias("target_id"), "shape", "label", "block", (8 + F.col("pass_id") % 5).alias("stations"))
    targets = first.join(names, (F.col("to") == (F.col("label") + 1) % 10) & (F.col("at_block") == F.col("block"))).drop("label", "block", "to", "at_block")
    out = al.adapt_templates(rows.select("flower_id", "ord", "shape"), targets.withColumn("score", F.lit(0.9)).withColumn("coverage", F.lit(0.8)))
    return out.select("target_id", "source_id", "station", F.round(F.aggregate("shape", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), "state", "confidence")


_FORM = "list_transform(range(1, 33), lambda i: [round({sx} * (xs[i] - xs[1]) / len, 6), round({sy} * (ys[i] - ys[1]) / len, 6)])"
_BACK = "list_transform(range(1, 33), lambda i: [round({sx} * (xs[33 - i] - xs[32]) / len, 6), round({sy} * (ys[33 - i] - ys[32]) / len, 6)])"
_HASH = "sha256(array_to_string(list_transform({0}, lambda x: cast(cast(floor(x * 1000000 + 0.5) as bigint) as varchar)), ','))"
_VARIANTS = ", ".join(f.format(sx=a, sy=b) for a in ("1", "-1") for b in ("1", "-1") for f in (_FORM, _BACK))


@query("b16_fingerprints", f"""
with l as (select *, list_sum({LENGTHS}) len from {PTS}),
c as (select pass_id, shape, len, list_sort([{_FORM.format(sx=1, sy=1)}, {_BACK.format(sx=1, sy=1)}])[1] a, list_sort([{_VARIANTS}])[1] b from l),
h as (select pass_id, {_HASH.format("shape")} physical, {_HASH.format("flatten(a)")} shape, {_HASH.format("flatten(b)")} mirror, len <= 0 zero_scale from c)
select *, sha256(physical || '|' || shape || '|' || mirror) combined from h""")
def _(s, d):
    return pass_vectors(s, d).select("pass_id", sr.fingerprints(F.col("shape")).alias("f")).select("pass_id", "f.*")


@query("b7_turning_signature", f"""
with h as (select pass_id, {LENGTHS} d, list_transform(range(1, 32), lambda i: atan2(ys[i + 1] - ys[i], xs[i + 1] - xs[i])) h from {PTS}),
t as (select pass_id, d, list_transform(list_transform(range(1, 31), lambda i: degrees(h[i + 1] - h[i])), lambda x: case when x > 180 then x - 360 when x <= -180 then x + 360 else x end) t from h),
k as (select *, unnest(range(1, 31)) k from t)
select pass_id, k "point", round(list_sum(d[1:k]) / list_sum(d), 6) "position", round(t[k], 5) angle, case when t[k] > 0 then 'UP' else 'DOWN' end label from k where abs(t[k]) between 7.5 and 172.5""")
def _(s, d):
    rows = pass_vectors(s, d).select("pass_id", F.explode(sh.turning_signature(F.col("shape"))).alias("t"))
    k, at, angle = (F.get("t", F.lit(n)) for n in range(3))
    return rows.select("pass_id", k.cast("long").alias("point"), F.round(at, 6).alias("position"), F.round(angle, 5).alias("angle"), F.when(angle > 0, "UP").otherwise("DOWN").alias("label"))


@query("b19_relative_similarity", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(greatest(0.0, 1 - abs(l_quantity - p_size) / greatest(l_quantity, p_size, 1e-9)), 6) plain,
  round(greatest(0.0, 1 - abs(l_discount - l_tax) / greatest(l_discount, l_tax, 0.05)), 6) floored from lineitem join part on l_partkey = p_partkey""")
def _(s, d):
    rows = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    plain, floored = rel_sim(F.col("l_quantity"), F.col("p_size").cast("double")), rel_sim(F.col("l_discount"), F.col("l_tax"), 0.05)
    return rounded(rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", plain.alias("plain"), floored.alias("floored")))
