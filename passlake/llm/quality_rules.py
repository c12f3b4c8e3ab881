"""Operator 1: quality rules with cross-document line frequency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from passlake.llm.common import BROADCAST_KEYS, SLICE_ROWS, Workspace, arrow_map, small
from passlake.llm.minhash_dedup import LOWER, SHINGLE_WORDS, WORDS, components_sql, near_duplicates

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line is over its limit when more than so many distinct documents of a host hold it.
MIN_DOCS = 10
#: A document is depleted when lines over the limit hold more than this percentage of its words.
MAX_REMOVED_PERCENT = 50
_LINES = "doc_id long, text_hash long, host string, line_hash array<long>, line_no array<int>"
_LINES_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("host", pa.string()), ("line_hash", pa.list_(pa.int64())), ("line_no", pa.list_(pa.int32()))]
)
_MEASURES = {
    "n_words": "long",
    "word_chars": "long",
    "n_symbols": "long",
    "n_dup_lines": "long",
    "n_repeat_words": "long",
    "removed_words": "long",
    "base_failed": "boolean",
    "kept": "boolean",
}


def _grams(ids: np.ndarray, m: int) -> np.ndarray:
    """One integer for each 3-word window, equal for equal windows."""
    if m < 2_000_000:
        return (ids[:-2] * m + ids[1:-1]) * m + ids[2:]
    pairs = np.unique(ids[:-1] * m + ids[1:], return_inverse=True)[1]
    return pairs[:-1] * m + ids[2:]


def hashed_lines(text: str | None) -> tuple[list[int], list[int]]:
    """Hash of the normalised line and line number of every line with words."""
    hashes, places = [], []
    for k, x in enumerate(text.encode("utf-8", "replace").split(b"\n") if text else ()):
        if parts := x.split():
            hashes.append(xxhash.xxh3_64_intdigest(b" ".join(parts).lower()) - (1 << 63))
            places.append(k)
    return hashes, places


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of one whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeats = 0
    if n >= 3:
        own: dict[bytes, int] = {}
        ids = np.fromiter((own.setdefault(w, len(own)) for w in words), np.int64, n)
        _, where, counts = np.unique(_grams(ids, len(own)), return_inverse=True, return_counts=True)
        again = counts[where] >= 2
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= again
        repeats = int(covered.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeats


def without_lines(text: str, gone: list[int]) -> tuple[str, int]:
    """The text without the lines of these numbers, and how many words they held."""
    lines, numbers = text.split("\n"), set(gone)
    words = sum(len(lines[k].encode("utf-8", "replace").split()) for k in numbers)
    return "\n".join(x for k, x in enumerate(lines) if k not in numbers), words


def _lines(rows: dict[str, list]) -> dict[str, list]:
    found = [hashed_lines(t) for t in rows["text"]]
    return {"line_hash": [x[0] for x in found], "line_no": [x[1] for x in found]}


def _judge(columns: list[str], max_removed_percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
            kind = batch.schema.field("text").type
            texts, measures = [], []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("__gone").to_pylist(), strict=True):
                found = measure(text)
                n, repeats, removed = found[0], found[-1], 0
                if gone:
                    text, removed = without_lines(text, gone)
                failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
                texts.append(text)
                measures.append((*found, removed, failed, not failed and 100 * removed <= max_removed_percent * n))
            out = [pa.array(texts, kind) if c == "text" else batch.column(c) for c in columns]
            for k, t in enumerate(_MEASURES.values()):
                out.append(pa.array([m[k] for m in measures], pa.int64() if t == "long" else pa.bool_()))
            yield pa.RecordBatch.from_arrays(out, [*columns, *[f"__{c}" for c in _MEASURES]])

    return run


def _removed_lines(spark: SparkSession, work: Workspace, docs: DataFrame, host: str, min_docs: int) -> DataFrame:
    """doc_id, text_hash, host and the numbers of the lines that go, of the documents that lose any."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), _host(host).alias("host"), "text")
    found = work.save(given.mapInArrow(arrow_map(_lines, ["text"], _LINES_ARROW), _LINES), "lines")
    key = ["doc_id", "text_hash", "host"]
    lines = found.select(*key, F.explode(F.arrays_zip("line_hash", "line_no")).alias("x")).select(
        *key, F.col("x.line_hash").alias("line"), F.col("x.line_no").alias("line_no")
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "text_hash"))
    by_text = lines.groupBy("host", "line", "text_hash").agg(first.alias("first"))
    counted = by_text.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs"), F.min("first").alias("first"))
    often = work.save(
        counted.where(F.col("n_docs") > min_docs).select(
            "host", "line", F.col("first.doc_id").alias("owner"), F.col("first.text_hash").alias("owner_text")
        ),
        "often",
    )
    often = small(often, often.count())
    held = work.save(lines.join(often.select("host", "line"), ["host", "line"]), "held")
    over = often.join(_distinct(spark, work, given, held).where(F.col("n_docs") > min_docs), ["host", "line"]).drop("n_docs")
    over = work.save(over, "over")
    removed = (
        held.join(small(over, over.count()), ["host", "line"])
        .where(~(F.col("doc_id").eqNullSafe(F.col("owner")) & (F.col("text_hash") == F.col("owner_text"))))
        .groupBy(*key)
        .agg(F.collect_set("line_no").alias("gone"))
    )
    removed = work.save(removed, "removed")
    work.drop("removed")
    return removed


def _distinct(spark: SparkSession, work: Workspace, given: DataFrame, held: DataFrame) -> DataFrame:
    """host, line, n_docs: distinct documents that hold a line of held, near copies as one.

    Near copies are those of op7: texts linked by a similarity of their whole sets of shingles. Only texts that hold such a line are compared.
    """
    texts = held.groupBy("text_hash").agg(F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id")).alias("first"))
    texts = work.save(texts.select(F.col("text_hash").alias("__hash"), F.col("first.doc_id").alias("__id")), "holders")
    one = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
    compared = given.join(small(texts, texts.count(), BROADCAST_KEYS), one).select(F.col("__hash").alias("doc_id"), "text")
    copies = near_duplicates(spark, compared, work=work).groupBy(F.col("doc_id").alias("text_hash")).agg(F.min("component_id").alias("document"))
    each = held.select("host", "line", "text_hash").distinct().join(copies, "text_hash").select("host", "line", "document").distinct()
    return each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs"))


def _host(host: str) -> Column:
    return F.coalesce(F.col(host), F.lit(""))


def _judged(
    spark: SparkSession, docs: DataFrame, host: str, min_docs: int, max_removed_percent: int
) -> DataFrame:
    """docs with the text that the line rule leaves, and the measures under names that begin with __."""
    work = Workspace(spark, "quality")
    removed = _removed_lines(spark, work, docs, host, min_docs)
    removed = small(removed, removed.count(), BROADCAST_KEYS).select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("host").alias("__host"), F.col("gone").alias("__gone")
    )
    same = (
        F.col("doc_id").cast("long").eqNullSafe(F.col("__id"))
        & (F.xxhash64("text") == F.col("__hash"))
        & (_host(host) == F.col("__host"))
    )
    joined = docs.join(removed, same, "left").select(*docs.columns, "__gone")
    schema = StructType(list(docs.schema.fields))
    for c, t in _MEASURES.items():
        schema = schema.add(f"__{c}", t)
    return joined.mapInArrow(_judge(docs.columns, max_removed_percent), schema)


def quality_rules(
    spark: SparkSession,
    docs: DataFrame,
    host: str = "source",
    min_docs: int = MIN_DOCS,
    max_removed_percent: int = MAX_REMOVED_PERCENT,
) -> DataFrame:
    """One row for each row of docs: doc_id, text_hash, the measures, removed_words, base_failed, kept, text.

    Lines are normalised (ASCII lower case, single spaces) and hashed. For each host and line the
    distinct texts are counted. Where they pass the limit they are compared by their whole sets of shingles and
    near copies (see near_duplicates) count as one document, so that a group of copies of one page does not make its own lines
    look like boilerplate. The limit is a number of documents, whatever the size of the host. Where a line is over its limit, all
    documents lose it but the one with the smallest doc_id in the host: text is what is left. text_hash and the measures are those of the text as
    given. A document that loses more than max_removed_percent of its words is rejected, and so is one that
    fails the base rules.

    Null and empty texts count 0 words and fail the base rules; they stay as they are. Null hosts are one host. Rows equal in
    doc_id, text and host are one document and get the same result each; among texts of one doc_id that
    with the smallest hash owns the line. An empty table gives an empty result; other columns are ignored.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), _host(host).alias("host"), "text")
    judged = _judged(spark, given, "host", min_docs, max_removed_percent)
    return judged.select("doc_id", "text_hash", *[F.col(f"__{c}").alias(c) for c in _MEASURES], "text")


def keep_quality(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all columns, their text without the lines over the limit.

    An n_chars column is brought up to date where a text lost lines.
    """
    kept = _judged(spark, docs, "source", MIN_DOCS, MAX_REMOVED_PERCENT).where("__kept")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        n = F.when(F.col("__removed_words") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars"))
        kept = kept.withColumn("n_chars", n)
    return kept.select(*docs.columns)


def op1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(spark, docs).drop("text_hash")


#: Texts that hold a frequent line are compared pair by pair; near copies count as one.
OP1_SQL = rf"""
with recursive base as (select doc_id, text, coalesce(source, '') host, {WORDS.format("coalesce(text, '')")} w from documents),
grams as (select doc_id, i, count(*) over (partition by doc_id, w[i:i + 2]) n from (select doc_id, w, unnest(range(1, len(w) - 1)) i from base)),
repeats as (select doc_id, count(distinct i + k) n_repeat_words from grams, (values (0), (1), (2)) t(k) where n > 1 group by doc_id),
raw as (select doc_id, host, text, string_split(text, chr(10))[line_no + 1] x, line_no
    from (select *, unnest(range(len(string_split(text, chr(10))))) line_no from base where text is not null)),
lines as (select *, {LOWER.format(f"array_to_string({WORDS.format('x')}, ' ')")} line, len({WORDS.format('x')}) n from raw),
dups as (select doc_id, count(*) - count(distinct x) n_dup_lines from lines where n > 0 group by doc_id),
often as (select host, line, min(doc_id) as owner from lines where n > 0 group by host, line having count(distinct text) > {MIN_DOCS}),
held as (select l.doc_id, l.host, l.line, l.line_no, l.n, l.text, o.owner from lines l join often o on l.host = o.host and l.line = o.line),
holders as (select min(doc_id) key, text from held group by text), {components_sql("holders", SHINGLE_WORDS)},
over_ as (select h.host, h.line from held h join holders t on h.text = t.text join components c on c.key = t.key
    group by h.host, h.line having count(distinct c.least) > {MIN_DOCS}),
gone as (select h.doc_id, h.line_no, h.n from held h join over_ o on h.host = o.host and h.line = o.line where h.doc_id <> h.owner),
lost as (select doc_id, sum(n) removed_words from gone group by doc_id),
left_ as (select l.doc_id, coalesce(string_agg(x, chr(10) order by l.line_no) filter (g.line_no is null), '') text
    from lines l join lost on l.doc_id = lost.doc_id left join gone g on g.doc_id = l.doc_id and g.line_no = l.line_no group by l.doc_id),
counted as (select b.doc_id, len(w) n_words, length(regexp_replace(coalesce(b.text, ''), '[\x20\x09-\x0D]', '', 'g')) word_chars,
    length(regexp_replace(coalesce(b.text, ''), '[^#*$%&|<>]', '', 'g')) n_symbols, coalesce(n_dup_lines, 0) n_dup_lines,
    coalesce(n_repeat_words, 0) n_repeat_words, cast(coalesce(removed_words, 0) as bigint) removed_words, coalesce(left_.text, b.text) text
    from base b left join repeats r on r.doc_id = b.doc_id left join dups on dups.doc_id = b.doc_id left join lost on lost.doc_id = b.doc_id
    left join left_ on left_.doc_id = b.doc_id)
select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words base_failed,
    not (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) and 100 * removed_words <= {MAX_REMOVED_PERCENT} * n_words kept
from counted
"""
