"""Queries that are written wholly in SQL, over the functions of `passlake.functions.sql`."""

from __future__ import annotations

from passlake.functions.sql import register_functions
from passlake.plans.queries import LEN, PTS, query, rounded
from passlake.views import DUCKDB_PASS_VECTORS as PV
from passlake.views import pass_vectors

_SIM = "greatest(0, 1 - abs({a} - {b}) / greatest(abs({a}), abs({b}), 1e-9))"


@query("s1_sql_functions", f"""
with p as (select *, {LEN} n from {PTS}),
q as (select a.*, sqrt((a.xs[32] - a.xs[1]) ** 2 + (a.ys[32] - a.ys[1]) ** 2) chord, list_max(a.xs) - list_min(a.xs) width, b.shape other, b.n other_n
  from p a left join p b on a.flower_id = b.flower_id and b.ord = a.ord - 1)
select pass_id, round(n, 6) n, round(width, 6) width, round(n / chord, 6) tortuosity, round(2 * (list_max(ys) - list_min(ys)), 6) moved_height,
  round(case when other_n is not null then {_SIM.format(a="n", b="other_n")} end, 6) like_before, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (shape[i] - other[i]) ** 2)) / 64), 6) rms_before,
  round(case when other is not null then list_sum(list_transform(range(1, 65), lambda i: 1 - least(1.0, abs(shape[i] - other[i])))) / 64 end, 6) seq_before,
  round(sqrt(list_sum(list_transform(range(3, 65), lambda i: (shape[i] - 2 * shape[i - 1] + shape[i - 2]) ** 2)) / 62) / sqrt(list_sum(list_transform(range(2, 65), lambda i: (shape[i] - shape[i - 1]) ** 2)) / 63), 6) rough,
  'pass-' || substr(sha256(pass_id::varchar), 1, 24) reference, round(100.0::double, 6) scaled from q""")
def _(s, d):
    register_functions(s)
    pass_vectors(s, d).createOrReplaceTempView("pl_passes")
    out = s.sql("""
with p as (select pass_id, flower_id, ord, shape, pl_points(shape) pts from pl_passes),
q as (select a.*, b.shape other, b.pts before from p a left join p b on a.flower_id = b.flower_id and b.ord = a.ord - 1)
select pass_id, pl_path_length(pts) n, pl_bbox(pts).width width, pl_tortuosity(pts) tortuosity,
  pl_bbox(pl_affine(pts, array(1D, 0D, 3D, 0D, 1D, -1D), 2D)).height moved_height, pl_rel_sim(pl_path_length(pts), pl_path_length(before), 1e-9) like_before,
  pl_vec_rms(shape, other) rms_before, pl_seq_sim(shape, other) seq_before, pl_roughness(shape) rough, pl_reference_id('pass', cast(pass_id as string)) reference,
  pl_path_length(pl_scale_to_length(pts, 100D)) scaled from q""")
    return rounded(out)


@query("s2_sql_segments", f"""
with p as (select * from {PTS}), s as (select pass_id, unnest(range(0, 31)) i, xs, ys from p)
select pass_id, cast(i as integer) i, round(xs[i + 1], 6) x0, round(ys[i + 2], 6) y1, round(sqrt((xs[i + 2] - xs[i + 1]) ** 2 + (ys[i + 2] - ys[i + 1]) ** 2), 6) length from s""")
def _(s, d):
    register_functions(s)
    pass_vectors(s, d).createOrReplaceTempView("pl_passes")
    return rounded(s.sql("with p as (select pass_id, pl_points(shape) pts from pl_passes) select pass_id, i, x0, y1, length from p, lateral pl_segments(pts)"))
