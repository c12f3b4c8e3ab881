"""Operator 5: shards of even size by balanced label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passlake.llm.common import Workspace, gapless_rank, null_safe_join, with_uid

SHARDS = 16


def propagate(spark: SparkSession, work: Workspace, linked: DataFrame, capacity: list[int]) -> DataFrame:
    """(uid, grp, label) of linked rows after label propagation under capacity quotas.

    linked: uid and grp; rows of one grp are neighbours of each other. A round counts each group's labels, and
    rows ask to move to the label that most of their neighbours have (ties by a hash that changes with the round), unless their
    group fills that label alone. Rows whose asks form a cycle of labels change places; other asks go into free places.
    Quotas are counts of asks by pair of labels; large groups come first, and where a size class gets fewer places than it
    asked for, rows are taken by rank. Rows only move towards more neighbours, so rounds end: the last two grant nothing.
    """
    shards = len(capacity)
    state = linked.select("uid", "grp", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int").alias("label"))
    state = work.save(_fit(spark, work.save(state, "start"), capacity), "labels")
    full = F.get(F.array(*[F.lit(c) for c in capacity]), F.col("label"))
    turn, idle = 0, 0
    while idle < 2:
        turn += 1
        sizes = {r["label"]: r["n"] for r in state.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        free = {k: capacity[k] - sizes.get(k, 0) for k in range(shards)}
        votes = state.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("n"))
        rank = F.struct("n", F.xxhash64("grp", "label", F.lit(turn)).alias("tie"), "label")
        best = votes.groupBy("grp").agg(F.sum("n").alias("all"), F.max(F.when(F.col("n") < full, rank)).alias("b"))
        asks = votes.join(best.where("b is not null"), "grp").where(rank < F.col("b"))
        asks = asks.select(
            "grp", "label", "n", F.col("b.label").alias("target"), F.floor(F.log2(F.col("all").cast("double"))).cast("int").alias("klass")
        )
        asks = work.save(asks, "asks")
        # At most shards x shards x log2(rows) numbers.
        classes = asks.groupBy("label", "target", "klass").agg(F.sum("n").alias("ask")).collect()
        wanted: dict[tuple[int, int], int] = {}
        for r in classes:
            wanted[r["label"], r["target"]] = wanted.get((r["label"], r["target"]), 0) + r["ask"]
        quota = quotas(wanted, free)
        grants = []
        for r in sorted(classes, key=lambda r: -r["klass"]):
            take = min(quota.get((r["label"], r["target"]), 0), r["ask"])
            if take:
                quota[r["label"], r["target"]] -= take
                grants.append((r["label"], r["target"], r["klass"], take, take == r["ask"]))
        idle = 0 if grants else idle + 1
        if not grants:
            continue
        granted = F.broadcast(spark.createDataFrame(grants, "label int, target int, klass int, take long, whole boolean"))
        movers = state.join(asks.drop("n"), ["grp", "label"]).join(granted, ["label", "target", "klass"])
        movers = work.save(movers.select("uid", "label", "target", "klass", "take", "whole"), "movers")
        moved = movers.where("whole").select("uid", "target")
        if not all(whole for *_, whole in grants):
            ranked = gapless_rank(spark, movers.where("not whole"), ["label", "target", "klass"], F.xxhash64("uid"), [F.col("uid")])
            moved = moved.union(ranked.where("rank < take").select("uid", "target"))
        state = state.join(moved, "uid", "left").select("uid", "grp", F.coalesce("target", "label").alias("label"))
        state = work.save(state, "labels")
    return state


def quotas(wanted: dict[tuple[int, int], int], free: dict[int, int]) -> dict[tuple[int, int], int]:
    """How many of the wanted moves (from, to) go ahead, so that no label grows by more than its free places.

    Moves along a cycle of labels cancel out. Cycles of two go first, then longer ones, then moves into free places, which free others.
    """
    left, room, out = {k: n for k, n in wanted.items() if n > 0}, dict(free), {}

    def take(path: list[tuple[int, int]], n: int) -> None:
        for k in path:
            out[k] = out.get(k, 0) + n
            left[k] -= n
            if not left[k]:
                del left[k]

    def cycle(start: tuple[int, int]) -> list[tuple[int, int]]:
        """The shortest cycle through a move."""
        came, line = {start[1]: start}, [start[1]]
        for at in line:
            if at == start[0]:
                path = [came[at]]
                while path[-1] != start:
                    path.append(came[path[-1][0]])
                return path
            for k in sorted(left):
                if k[0] == at and k[1] not in came:
                    came[k[1]] = k
                    line.append(k[1])
        return []

    for a, b in sorted(left):
        if a < b and (a, b) in left and (b, a) in left:
            take([(a, b), (b, a)], min(left[a, b], left[b, a]))
    for start in sorted(left):
        while start in left and (path := cycle(start)):
            take(path, min(left[k] for k in path))
    while ready := [k for k in sorted(left) if room[k[1]] > 0]:
        n = min(left[ready[0]], room[ready[0][1]])
        room[ready[0][1]] -= n
        room[ready[0][0]] += n
        take(ready[:1], n)
    return out


def _fit(spark: SparkSession, state: DataFrame, capacity: list[int]) -> DataFrame:
    """Moves rows out of labels that start over their capacity, into free places."""
    sizes = {r["label"]: r["n"] for r in state.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if all(sizes.get(k, 0) <= c for k, c in enumerate(capacity)):
        return state
    ranked = gapless_rank(spark, state, ["label"], F.xxhash64("uid", F.lit(1)), [F.col("uid")])
    places = [F.lit(c) for c in capacity]
    over = ranked.where(F.col("rank") >= F.get(F.array(*places), F.col("label"))).select("uid", "grp", F.lit(0).alias("one"))
    work = Workspace(spark, "fit")
    over = gapless_rank(spark, work.save(over, "over"), ["one"], F.xxhash64("uid"), [F.col("uid")], "n")
    spare = [max(0, c - sizes.get(k, 0)) for k, c in enumerate(capacity)]
    refilled = over.select("uid", "grp", _dealt(F.col("n"), spare).alias("label"))
    inside = ranked.where(F.col("rank") < F.get(F.array(*places), F.col("label"))).select("uid", "grp", "label")
    return inside.union(refilled)


def _dealt(rank, places: list[int]):
    """The shard of a rank when shards take so many ranks each, in order."""
    out, total = None, 0
    for k, n in enumerate(places):
        total += n
        out = F.when(rank < total, F.lit(k)) if out is None else out.when(rank < total, F.lit(k))
    return out.otherwise(F.lit(len(places) - 1))


def shard(spark: SparkSession, docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row for each row of docs: uid, doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law `rows`: shards hold floor(rows / shards) rows or one more. Documents with equal texts are linked.
    Linked rows find their shards by label propagation under these capacities, so a group of copies
    stays together where it fits into a shard and spreads over as few as it can where not; rows without
    links then fill the places that are left. Null texts count as empty ones. size is the UTF-8
    length plus 1. slot numbers the rows of a shard from 0 without gaps. Rows are told apart by
    position: repeated rows are copies, null doc_ids are ordinary. An empty table gives
    an empty result; other columns are ignored.
    """
    work = Workspace(spark, "shard")
    text = F.coalesce("text", F.lit(""))
    rows = work.save(
        with_uid(
            docs.select(
                F.col("doc_id").cast("long"),
                (F.octet_length(text) + 1).cast("long").alias("size"),
                F.crc32(text.cast("binary")).alias("text_crc32"),
                F.xxhash64(text).alias("grp"),
            )
        ),
        "rows",
    )
    key = ["grp", "text_crc32", "size"]
    groups = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("hub"))
    groups = work.save(groups.where("n > 1"), "groups")
    marked = work.save(null_safe_join(rows, groups.drop("n"), key, "left").select("uid", "hub"), "marked")
    total = rows.count()
    capacity = [total // shards + (k < total % shards) for k in range(shards)]
    linked = propagate(spark, work, marked.where("hub is not null").select("uid", F.col("hub").alias("grp")), capacity)
    sizes = {r["label"]: r["n"] for r in linked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    single = work.save(marked.where("hub is null").select("uid", F.lit(0).alias("one")), "single")
    single = gapless_rank(spark, single, ["one"], F.xxhash64("uid"), [F.col("uid")], "n")
    left = [c - sizes.get(k, 0) for k, c in enumerate(capacity)]
    placed = linked.select("uid", F.col("label").alias("shard")).union(
        single.select("uid", _dealt(F.col("n"), left).alias("shard"))
    )
    placed = work.save(placed, "placed")
    slots = gapless_rank(spark, placed, ["shard"], F.xxhash64("uid"), [F.col("uid")], "slot")
    return rows.join(slots, "uid").select(
        "uid",
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("uid")
