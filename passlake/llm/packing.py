"""Operator 10: best-two-fit packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import os
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passlake.llm.common import BROADCAST_ROWS, Workspace, gapless_rank, small, with_uid

CAPACITY = 1024
END_ID = 2
#: Distinct chunks (a word with the space before it) whose ids a Python worker remembers, 100 MB or so.
CACHE_CHUNKS = 500_000
#: Texts that are encoded together.
TEXTS = 256
#: New chunks that are encoded as one text.
TOGETHER = 10_000
_PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES_IDS = f"{_PIECES}, ids array<int>"
#: White space of Unicode, and the four separators, other than the space and the line feed.
_OTHER_SPACE = [chr(x) for x in (9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def _load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True  # their strings in a text are ordinary text
    return found


def _bytes(ids: list[int]) -> bytes:
    """ids as little-endian unsigned 32-bit integers."""
    return np.array(ids, "<u4").tobytes() if len(ids) > 100 else struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each Python worker, so that later tasks find the chunks of earlier ones."""
    return Encoder(path)


class Encoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes.

    Pre-tokens of the byte-level vocabulary end before a space that stands between two other
    characters, and a line feed between two others is a pre-token of its own. So such texts split there
    without changing any id, and each distinct chunk is encoded once. Texts with other white
    space, or with two in a row, are encoded whole.
    """

    def __init__(self, path: str):
        self.tokenizer = _load(path)
        feed = self._ids("\n")
        self.known: dict[str, bytes] = {"\n": feed}
        self.feed = struct.unpack("<I", feed)[0] if len(feed) == 4 else None

    def _ids(self, text: str) -> bytes:
        return _bytes(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    @staticmethod
    def chunks(text: str) -> list[str] | None:
        if text[0] in " \n" or text[-1] in " \n" or any(x in text for x in ("  ", "\n\n", " \n", "\n ", "\x00")):
            return None
        if any(x in text for x in _OTHER_SPACE):
            return None
        return text.replace("\n", "\x00\n\x00").replace(" ", "\x00 ").split("\x00")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        known = self.known
        if len(known) > CACHE_CHUNKS:
            known.clear()
            known["\n"] = self._ids("\n")
        cut = [self.chunks(t) if t else [] for t in texts]
        found = [list(map(known.get, parts or ())) for parts in cut]
        missing = [[k for k, x in enumerate(ids) if x is None] for ids in found]
        new = list({parts[k] for parts, at in zip(cut, missing, strict=True) for k in at})
        for at in range(0, len(new), TOGETHER):
            self._learn(new[at : at + TOGETHER])
        for parts, ids, at in zip(cut, found, missing, strict=True):
            for k in at:
                ids[k] = known[parts[k]]
        return [b"".join(ids) if parts is not None else self._ids(t) for t, parts, ids in zip(texts, cut, found, strict=True)]

    def _learn(self, new: list[str]) -> None:
        """Remembers the ids of chunks. They are encoded as one text, a line feed between two of them, which costs less than a text for each; where a feed is no id of its own, one by one."""
        raw = self._ids("\n".join(new))
        ids = np.frombuffer(raw, "<u4")
        ends = (np.flatnonzero(ids == self.feed) * 4).tolist() if self.feed is not None else []
        if len(ends) == len(new) - 1:
            self.known.update(zip(new, [raw[x:y] for x, y in zip([0, *(x + 4 for x in ends)], [*ends, len(raw)], strict=True)], strict=True))
            return
        for c, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.known[c] = _bytes(e.ids)


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one, or a shorter first one and full ones."""
    first = n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def _tokenise(path: str, capacity: int, end_id: int, with_ids: bool):
    end = _bytes([end_id])
    kind = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), *[(c, pa.int64()) for c in ("start", "length", "ids_crc32")]])
    kind = kind.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                rows = [batch.column(c).slice(at, TEXTS).to_pylist() for c in ("uid", "doc_id", "text")]
                out: list[tuple] = []
                for uid, doc, raw in zip(*rows[:2], tokens.encode(rows[2]), strict=True):
                    raw += end
                    for k, (start, length) in enumerate(cut_points(len(raw) // 4, capacity)):
                        own = raw[4 * start : 4 * (start + length)]
                        out.append((uid, doc, k, start, length, zlib.crc32(own), *([list(struct.unpack(f"<{length}I", own))] if with_ids else [])))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)

    return run


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(times, lengths) of the bins, for a number of documents of each length.

    A bin starts with the longest length left and is filled greedily with the longest that
    fits. Then, while it helps, its smallest document is replaced with the two unpacked ones
    that fill the gap it leaves best (more than it did, at most all of it). The bin is
    repeated as often as its lengths allow, so work depends on capacity and not on the number of documents.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    bins = []
    while left:
        lengths = sorted(left, reverse=True)
        used: dict[int, int] = {}
        members: list[int] = []
        room = capacity
        for n in lengths:
            while n <= room and left[n] > used.get(n, 0):
                used[n] = used.get(n, 0) + 1
                members.append(n)
                room -= n
        free = lambda n: left[n] - used.get(n, 0)
        while room > 0 and len(members) > 1:
            last = members[-1]
            goal, best = last + room, None
            for a in lengths:
                if a >= goal or not free(a):
                    continue
                for b in range(min(a, goal - a), 0, -1):
                    if best and a + b <= sum(best):
                        break
                    if b in left and free(b) > (a == b) and a + b > last:
                        best = (a, b)
                        break
                if best and sum(best) == goal:
                    break
            if not best:
                break
            members.pop()
            used[last] -= 1
            for n in best:
                used[n] = used.get(n, 0) + 1
            members += sorted(best, reverse=True)
            members.sort(reverse=True)
            room = capacity - sum(members)
        times = min(left[n] // c for n, c in used.items() if c)
        bins.append((times, tuple(members)))
        for n, c in used.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
    return bins


def layout(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs of equal bins: (length, first rank, ranks, first sequence, ranks in a sequence, offset).

    The `ranks` documents of a length from `first rank` on fill the sequences from `first sequence` on, so many in
    each sequence, one behind the other from `offset`.
    """
    out, taken, sequence = [], dict.fromkeys(counts, 0), 0
    for times, members in best_two_fit(counts, capacity):
        at = 0
        for n, each in Counter(members).items():
            out.append((n, taken[n], times * each, sequence, each, at))
            taken[n] += times * each
            at += n * each
        sequence += times
    return out


def pack(
    spark: SparkSession,
    docs: DataFrame,
    capacity: int = CAPACITY,
    path: str | None = None,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids if with_ids).

    Every row of docs is one document: its ids, then end_id. Null and empty texts hold end_id alone.
    Documents over capacity are cut into pieces of capacity, the first one shorter.
    Best-two-fit runs on the number of pieces of each length, at most `capacity` numbers, and yields runs
    of equal bins; pieces get their rank within their length by a distributed numbering
    and find their run by (length, rank). Equal pieces of one length may stand for one another,
    so ties and repeated rows change no packing. Null doc_ids stay null; an empty table
    gives an empty result; other columns are ignored.
    """
    work = Workspace(spark, "pack")
    given = with_uid(docs.select(F.col("doc_id").cast("long"), "text"))
    run = _tokenise(path or tokenizer_path(), capacity, end_id, with_ids)
    pieces = work.save(given.mapInArrow(run, _PIECES_IDS if with_ids else _PIECES), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = layout(counts, capacity)
    ranked = gapless_rank(
        spark, pieces, ["length"], F.xxhash64("uid", "piece"), [F.col("uid"), F.col("piece")]
    )
    # Runs of one length in steps of its rank: the greatest first rank up to a piece's rank is its run.
    plan = spark.createDataFrame(
        runs, "length long, first long, ranks long, sequence long, each long, offset long"
    )
    plan = plan.groupBy("length").agg(
        F.array_sort(F.collect_list(F.struct("first", "ranks", "sequence", "each", "offset"))).alias("runs")
    )
    placed = ranked.join(small(plan, len(counts)) if len(runs) <= 4 * BROADCAST_ROWS else plan, "length").withColumn(
        "run", F.filter("runs", lambda r: (r["first"] <= F.col("rank")) & (F.col("rank") < r["first"] + r["ranks"]))[0]
    )
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("run.sequence") + F.floor((F.col("rank") - F.col("run.first")) / F.col("run.each"))).alias("sequence_id"),
        (F.col("run.offset") + (F.col("rank") - F.col("run.first")) % F.col("run.each") * F.col("length")).alias("offset"),
        *(["ids"] if with_ids else []),
    )


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
