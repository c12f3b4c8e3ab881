"""Choices that depend on the ones before: profiles of a drawing's stations, tracks of a sequence's bends.

Each group is one ordered array that a fold in the JVM runs through once with a small state. Groups are bounded by their kind: a drawing or a sequence has some
tens of stations (28 by the input's contract), with tens of chains or bends each; all that doesn't depend on the state is computed before, row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of a chain's score, its least accepted value and the least margin over the next chain.
LENGTH_PART, LAYER_PART, JOINED_PART, THIN_PART, CENTRE_PART, NAMED_PART, SAME_COUNT_PART, SAME_LENGTH_PART, TOOL_PENALTY = 0.15, 0.2, 0.02, 0.15, 0.35, 0.3, 0.1, 0.15, 0.25
REFERENCE_SCORE, LEAST_SCORE, LEAST_MARGIN = 0.2, 0.6, 0.15
#: Cost of a change of sign, greatest cost of a match, weight of a track's old place.
SIGN_COST, MOST_COST, OLD_PLACE = 0.03, 0.075, 0.6


def chain_scores(chains: DataFrame) -> DataFrame:
    """chains with `base`, their score but for what depends on the station before, and `penalty`.

    chains: drawing, station, chain, length, n (entities), layer (score of its layers' names), reference, and the box. The station's box is that of its chains.
    """
    box = chains.groupBy("drawing", "station").agg(
        F.min("min_y").alias("low"), F.max("max_y").alias("high"), F.max("length").alias("longest"), F.sum("n").alias("entities")
    )
    rows = chains.join(box, ["drawing", "station"])
    high, wide = F.col("max_y") - F.col("min_y"), F.col("max_x") - F.col("min_x")
    tall = F.greatest(F.col("high") - F.col("low"), F.lit(1.0))
    thin = (F.greatest(high, F.lit(0.0)) <= F.greatest(tall * 0.35, F.greatest(wide, F.lit(1e-9)) * 0.25)) & ((high > 0.02) | (F.col("n") > 1))
    off = F.abs((F.col("min_y") + F.col("max_y")) / 2 - (F.col("low") + F.col("high")) / 2) / F.greatest((F.col("high") - F.col("low")) / 2, F.lit(1.0))
    base = (
        F.when(F.col("longest") > 0, LENGTH_PART * (F.col("length") / F.col("longest"))).otherwise(0.0) + LAYER_PART * F.col("layer") + F.when(F.col("n") > 1, JOINED_PART).otherwise(0.0)
        + F.when(thin, THIN_PART).otherwise(0.0) + F.greatest(F.lit(0.0), CENTRE_PART * (1 - F.least(off, F.lit(1.0)))) + F.when(F.col("layer") >= 0.9, NAMED_PART).otherwise(0.0)
    )
    tool = (F.col("n") >= 4) & (wide > 30) & (high > 5) & (high < tall * 0.25)
    return rows.withColumn("base", base).withColumn("penalty", F.when(tool, TOOL_PENALTY).otherwise(0.0))


def score_profiles(chains: DataFrame) -> DataFrame:
    """drawing, station, chain, score, margin, n_candidates, review and warnings of every station: its best chain, in the order of stations.

    chains: as in `chain_scores`. A chain as long as the station before's chosen one, or of as many entities, scores more; so one choice leads to the next. Ties
    go to the longer, then the smaller chain. Reference chains compete only where a station has no others. A best score under 0.6 chooses nothing (chain null, warning LOW_SCORE), and the
    choice before stays in force. Warnings: BROKEN_CONTOUR, one entity was chosen of several; AMBIGUOUS, the next chain is nearer than the least margin.
    """
    rows = chain_scores(chains)
    one = F.struct("chain", "length", F.col("n").cast("long").alias("n"), "base", "penalty")
    plain = F.count_if(~F.col("reference"))
    stations = rows.groupBy("drawing", "station").agg(
        F.collect_list(F.struct("reference", one.alias("c"))).alias("all"), plain.alias("n_plain"), F.first("entities").cast("long").alias("entities")
    )
    usable = F.filter("all", lambda x: (F.col("n_plain") == 0) | ~x["reference"])
    station = F.struct("station", F.transform(usable, lambda x: x["c"]).alias("chains"), (F.col("n_plain") == 0).alias("bare"), "entities")
    drawings = stations.groupBy("drawing").agg(F.array_sort(F.collect_list(station)).alias("stations"))
    choice = "struct<station:long,chain:long,score:double,margin:double,n_candidates:long,single:boolean,entities:long>"
    start = F.struct(F.lit(None).cast("double").alias("length"), F.lit(None).cast("long").alias("n"), F.array().cast(f"array<{choice}>").alias("out"))

    def scored(state: Column, s: Column) -> Column:
        def of(c: Column) -> Column:
            far = F.least(F.abs(c["length"] - state["length"]) / state["length"], F.lit(1.0))
            like = F.when(state["length"] > 0, F.greatest(F.lit(0.0), SAME_LENGTH_PART * (1 - far))).otherwise(0.0)
            topology = F.when(c["n"] == state["n"], SAME_COUNT_PART).otherwise(0.0)
            score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), c["base"] + topology + like - c["penalty"]))
            score = F.when(s["bare"], REFERENCE_SCORE).otherwise(score)
            return F.struct((-score).alias("a"), (-c["length"]).alias("b"), c["chain"].alias("chain"), score.alias("score"), c["length"].alias("length"), c["n"].alias("n"))

        return F.array_sort(F.transform(s["chains"], of))

    def taken(state: Column, s: Column, ranked: Column) -> Column:
        best = ranked[0]
        ok = best["score"] >= LEAST_SCORE
        margin = best["score"] - F.coalesce(F.get(ranked, F.lit(1))["score"], F.lit(0.0))
        row = F.struct(
            s["station"].cast("long").alias("station"), F.when(ok, best["chain"]).cast("long").alias("chain"), best["score"].alias("score"), margin.alias("margin"),
            F.size(ranked).cast("long").alias("n_candidates"), (best["n"] == 1).alias("single"), s["entities"].alias("entities"),
        ).cast(choice)
        return F.struct(F.when(ok, best["length"]).otherwise(state["length"]).alias("length"), F.when(ok, best["n"]).otherwise(state["n"]).alias("n"), F.concat(state["out"], F.array(row)).alias("out"))

    # the ranked chains are bound as an element of an array, so they are computed once a station
    step = lambda state, s: F.transform(F.array(scored(state, s)), lambda ranked: taken(state, s, ranked))[0]
    chosen = drawings.select("drawing", F.explode(F.aggregate("stations", start, step)["out"]).alias("x")).select("drawing", "x.*")
    accepted, close = F.col("chain").isNotNull(), (F.col("n_candidates") > 1) & (F.col("margin") < LEAST_MARGIN)
    broken = F.col("single") & (F.col("entities") > 1)
    flags = F.array(F.when(~accepted, "LOW_SCORE"), F.when(accepted & broken, "BROKEN_CONTOUR"), F.when(accepted & close, "AMBIGUOUS"))
    review = accepted & (broken | (F.col("margin") < LEAST_MARGIN))
    return chosen.select("drawing", "station", "chain", "score", "margin", "n_candidates", review.alias("review"), F.array_compact(flags).alias("warnings"))


def track_bends(bends: DataFrame) -> DataFrame:
    """flower_id, pass, bend_id, u, angle, track of every bend: tracks, numbered from 1, run through the passes of a sequence.

    bends: flower_id, pass, bend_id, u (place along the line), angle (signed). In the order of passes, then u, then bend_id, a bend takes the nearest track that its pass hasn't used; a
    change of sign costs 0.03, ties go to the earlier track, and over 0.075 a new track begins. A track's place moves to 0.6 of its old one and 0.4 of the bend's. Null places and angles count as 0.
    """
    zero = F.lit(0.0)
    one = F.struct("pass", F.coalesce("u", zero).alias("u"), "bend_id", F.coalesce("angle", zero).alias("angle"))
    flowers = bends.groupBy("flower_id").agg(F.array_sort(F.collect_list(one)).alias("bends"))
    track, pass_type = "array<struct<u:double,angle:double,last:{0}>>", dict(bends.dtypes)["pass"]
    start = F.struct(F.array().cast(track.format(pass_type)).alias("tracks"), F.array().cast("array<int>").alias("out"))

    def cost(b: Column):
        return lambda t: F.when(t["last"] == b["pass"], 999.0).otherwise(F.abs(t["u"] - b["u"]) + F.when(t["angle"] * b["angle"] < 0, SIGN_COST).otherwise(0.0))

    def moved(state: Column, b: Column, costs: Column) -> Column:
        least = F.array_min(costs)
        at = F.when(least <= MOST_COST, F.array_position(costs, least).cast("int")).otherwise(F.size(costs) + 1)
        same = lambda t, i: F.when(
            i == at - 1, F.struct((t["u"] * OLD_PLACE + b["u"] * (1 - OLD_PLACE)).alias("u"), b["angle"].alias("angle"), b["pass"].alias("last"))
        ).otherwise(t)
        new = F.array(F.struct(b["u"].alias("u"), b["angle"].alias("angle"), b["pass"].alias("last")))
        tracks = F.when(at > F.size(costs), F.concat(state["tracks"], new)).otherwise(F.transform(state["tracks"], same))
        return F.struct(tracks.alias("tracks"), F.concat(state["out"], F.array(at)).alias("out"))

    step = lambda state, b: F.transform(F.array(F.transform(state["tracks"], cost(b))), lambda costs: moved(state, b, costs))[0]
    numbers = flowers.select("flower_id", F.arrays_zip("bends", F.aggregate("bends", start, step)["out"].alias("track")).alias("x"))
    each = numbers.select("flower_id", F.explode("x").alias("x")).select("flower_id", "x.bends.*", "x.track")
    return each.select("flower_id", "pass", "bend_id", "u", "angle", "track")


def pass_signatures(tracked: DataFrame, active: float = 1.0) -> DataFrame:
    """flower_id, pass, signature, n_bends, n_active, total_angle of each pass. signature: track:tenths of the angle, in the order of u; active: bends of at least so many degrees.

    total_angle adds up in that order too, and halves of its third digit go up by the double's value, not by its shortest text.
    """
    tenths = F.floor(F.col("angle") * 10 + 0.5).cast("long")
    part = F.concat(F.lit("BZ"), F.lpad(F.col("track").cast("string"), 2, "0"), F.lit(":"), tenths.cast("string"))
    rows = F.array_sort(F.collect_list(F.struct("u", "bend_id", part.alias("part"), F.abs("angle").alias("size"))))  # the bends of a pass
    total = F.aggregate(rows, F.lit(0.0), lambda a, x: a + x["size"]) * 1000
    return tracked.groupBy("flower_id", "pass").agg(
        F.array_join(rows["part"], ";").alias("signature"), F.count(F.lit(1)).alias("n_bends"), F.count_if(F.abs("angle") >= active).alias("n_active"), total.alias("total")
    ).select("flower_id", "pass", "signature", "n_bends", "n_active", ((F.floor("total") + F.when(F.col("total") - F.floor("total") >= 0.5, 1).otherwise(0)) / 1000).alias("total_angle"))
