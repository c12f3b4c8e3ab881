"""Ordered folds against plain Python, and the functions for SQL."""

import collections
import datetime
import math

import numpy as np
from pyspark.sql import functions as F

from passlake.functions import sql
from passlake.functions import vectors as v
from passlake.operators import folds


def plain_tracks(bends):
    out, flowers = {}, collections.defaultdict(list)
    for b in bends:
        flowers[b[0]].append(b)
    for own in flowers.values():
        tracks = []
        for number in sorted({b[1] for b in own}):
            used = set()
            for b in sorted((x for x in own if x[1] == number), key=lambda x: (x[3] or 0.0, x[2])):
                u, angle = b[3] or 0.0, b[4] or 0.0
                costs = [(abs(t[0] - u) + (0.03 if t[1] * angle < 0 else 0.0), k) for k, t in enumerate(tracks) if k not in used]
                if costs and min(costs)[0] <= 0.075:
                    at = min(costs)[1]
                    tracks[at] = (tracks[at][0] * 0.6 + u * (1 - 0.6), angle)
                else:
                    at = len(tracks)
                    tracks.append((u, angle))
                used.add(at)
                out[b[0], b[1], b[2]] = at + 1
    return out


def test_bend_tracks(spark):
    dice = np.random.default_rng(4)
    bends = [(f, p, f"b{k}", float(dice.integers(0, 20)) / 20, float(dice.integers(-3, 4))) for f in (1, 2, 3) for p in range(8) for k in range(int(dice.integers(0, 6)))]
    # equal costs, a sign that flips at the limit, a track that is free again, nulls
    bends += [(4, 1, "a", 0.5, 1.0), (4, 1, "b", 0.6, 1.0), (4, 2, "a", 0.55, 1.0), (4, 2, "b", 0.55, 1.0), (4, 3, "a", 0.5, -1.0), (4, 3, "c", None, None), (4, 9, "a", 0.545, -2.0)]
    df = spark.createDataFrame(bends, "flower_id long, pass long, bend_id string, u double, angle double")
    got = {(r.flower_id, r["pass"], r.bend_id): r.track for r in folds.track_bends(df).collect()}
    assert got == plain_tracks(bends) and len(got) == len(bends)
    passes = {(r.flower_id, r["pass"]): r for r in folds.pass_signatures(folds.track_bends(df)).collect()}
    assert passes[4, 1].signature == "BZ01:10;BZ02:10" and passes[4, 3].n_active == 1 and passes[4, 3].n_bends == 2
    assert folds.track_bends(df.limit(0)).count() == 0


CHAIN = "drawing long, station long, chain long, length double, n long, layer double, reference boolean, min_x double, min_y double, max_x double, max_y double"


def plain_profiles(chains):
    out = {}
    for drawing in {c[0] for c in chains}:
        length = n = None
        for station in sorted({c[1] for c in chains if c[0] == drawing}):
            own = [c for c in chains if c[:2] == (drawing, station)]
            low, high, longest = min(c[8] for c in own), max(c[10] for c in own), max(c[3] for c in own)
            tall, scored = max(high - low, 1.0), []
            for c in own:
                wide, h = c[9] - c[7], c[10] - c[8]
                base = (0.15 * (c[3] / longest) if longest > 0 else 0.0) + 0.2 * c[5] + (0.02 if c[4] > 1 else 0.0)
                base += 0.15 if max(h, 0.0) <= max(tall * 0.35, max(wide, 1e-9) * 0.25) and (h > 0.02 or c[4] > 1) else 0.0
                base += max(0.0, 0.35 * (1 - min(abs((c[8] + c[10]) / 2 - (low + high) / 2) / max((high - low) / 2, 1.0), 1.0)))
                base += 0.3 if c[5] >= 0.9 else 0.0
                base += 0.1 if c[4] == n else 0.0
                base += max(0.0, 0.15 * (1 - min(abs(c[3] - length) / length, 1.0))) if length and length > 0 else 0.0
                base -= 0.25 if c[4] >= 4 and wide > 30 and 5 < h < tall * 0.25 else 0.0
                scored.append((c[6], -max(0.0, min(1.0, base)), -c[3], c[2], c[4]))
            usable = [x[1:] for x in scored if not x[0]] or [(-0.2, *x[2:]) for x in scored]
            usable.sort()
            best = usable[0]
            margin = -best[0] + (usable[1][0] if len(usable) > 1 else 0.0)
            if -best[0] >= 0.6:
                length, n = -best[1], best[3]
                flags = ["BROKEN_CONTOUR"] if best[3] == 1 and sum(c[4] for c in own) > 1 else []
                flags += ["AMBIGUOUS"] if len(usable) > 1 and margin < 0.15 else []
                out[drawing, station] = (best[2], round(-best[0], 9), round(margin, 9), bool(flags) or margin < 0.15, flags)
            else:
                out[drawing, station] = (None, round(-best[0], 9), round(margin, 9), False, ["LOW_SCORE"])
    return out


def test_profiles_follow_the_choice_before(spark):
    dice = np.random.default_rng(9)
    chains = []
    for k in range(300):
        x, y = float(dice.integers(0, 40)), float(dice.integers(0, 20))
        chains.append((k % 4, k // 4 % 15, k, float(dice.integers(0, 30)), int(dice.integers(1, 6)), float(dice.choice([0.1, 0.5, 1.0])), bool(dice.random() < 0.2), x, y, x + float(dice.integers(0, 60)), y + float(dice.integers(0, 9))))
    # two equal chains at the second station: the one as long as the first station's choice wins, of as many entities
    chains += [(9, 1, 1000, 30.0, 3, 1.0, False, 0.0, 0.0, 30.0, 10.0), (9, 2, 1001, 30.0, 3, 1.0, False, 40.0, 0.0, 70.0, 0.0), (9, 2, 1002, 30.0, 2, 1.0, False, 40.0, 5.0, 70.0, 5.0)]
    chains += [(9, 3, 1003, 8.0, 1, 0.1, True, 0.0, 0.0, 60.0, 0.0), (9, 4, 1004, 30.0, 3, 1.0, False, 0.0, 0.0, 30.0, 0.0), (9, 4, 1005, 0.0, 1, 0.5, False, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(chains, CHAIN)
    got = {(r.drawing, r.station): (r.chain, round(r.score, 9), round(r.margin, 9), r.review, r.warnings) for r in folds.score_profiles(df).collect()}
    assert got == plain_profiles(chains)
    assert got[9, 2][0] == 1001 and got[9, 3][0] is None and folds.score_profiles(df.limit(0)).count() == 0


def test_sql_functions_equal_columns(spark):
    assert sql.register_functions(spark) == sql.register_functions(spark)
    rows = [(1, [0.0, 0.0, 3.0, 4.0, 3.0, 6.0], [1.0, 2.0]), (2, [1.0, 1.0], []), (3, None, None), (4, [0.0, 0.0, 0.0, 0.0, 0.0, 0.0], [5.0])]
    df = spark.createDataFrame(rows, "id long, shape array<double>, b array<double>")
    df.createOrReplaceTempView("sql_rows")
    found = spark.sql("select id, pl_path_length(pl_points(shape)) n, pl_vec_rms(shape, shape) r, pl_seq_sim(shape, b) s, pl_roughness(shape) g, pl_tortuosity(pl_points(shape)) t from sql_rows")
    got = {r.id: tuple(r)[1:] for r in found.collect()}
    pts = v.points(F.col("shape"))
    want = {r.id: tuple(r)[1:] for r in df.select("id", F.when(pts.isNotNull(), v.path_length(pts)), v.vec_rms(F.col("shape"), F.col("shape")), v.seq_sim(F.col("shape"), F.col("b")), v.roughness(F.col("shape"))).collect()}
    for k in (1, 2, 4):
        assert got[k][:4] == want[k], k
    assert got[3][0] is None and got[1][4] == 7 / 45**0.5 and got[4][4] is None
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString() and "pl_" not in found._jdf.queryExecution().optimizedPlan().toString().replace("sql_rows", "")
    parts = spark.sql("with p as (select id, pl_points(shape) pts from sql_rows) select id, i, length from p, lateral pl_segments(pts)").collect()
    assert sorted(tuple(r) for r in parts) == [(1, 0, 5.0), (1, 1, 2.0), (4, 0, 0.0), (4, 1, 0.0)]


def test_angles_hang_on_no_order_of_rows(spark, tmp_path):
    """Three values whose sums differ in their last digit, in files of both orders: the one of event ids counts."""
    from passlake.plans import folds as plans

    values = [20.15, 127.12, 114.57]
    angles = []
    for name, step in (("up", 1), ("down", -1)):
        rows = [(k, datetime.datetime(2024, 1, 2), 7, "click", v, '{"k": 50}') for k, v in enumerate(values)] + [(9, datetime.datetime(2024, 1, 2), 7, "click", None, '{"k": 50}')]
        spark.createDataFrame(rows[::step], "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / name / "events.parquet"))
        angles.append(plans.rows(spark, str(tmp_path / name), plans.ORDERED_BENDS).first()["angle"])
    assert angles == [math.floor(((values[0] + values[1] + values[2]) / 3 - 20) * 1000000) / 1000000] * 2
