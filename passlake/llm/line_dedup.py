"""Operator 8: near-equal lines by a deletion-neighbourhood join, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passlake.llm.common import BROADCAST_KEYS, BROADCAST_NUMBERS, Workspace, small

#: Shorter normalised lines go only if they are equal: one edit makes other words of them.
NEAR_CHARS = 8
#: Least length of the segments within which deletion variants are made; in very long lines it is the root of the length.
SEGMENT_CHARS = 24
#: White space that a line loses at its ends.
SPACE = " \t\x0b\x0c\r"


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def _norm(line: Column) -> Column:
    return F.lower(F.trim(line, F.lit(SPACE)))


def _cut(line: Column, start: Column, length: Column) -> Column:
    """length characters after the first start ones."""
    return F.substr(line, (start + 1).cast("int"), length.cast("int"))


def _half_keys(norm: Column, n: Column) -> Column:
    """Two lines at most one edit apart, the shorter with s characters, share their first s/2 or their last s - s/2."""
    keys = []
    for s in (n, n - 1):
        p = F.floor(s / 2).cast("int")
        head, tail = _cut(norm, F.lit(0), p), _cut(norm, n - (s - p), s - p)
        for kind, part in ((0, head), (1, tail)):
            keys.append(F.struct(s.alias("s"), F.lit(kind).alias("kind"), F.xxhash64(F.lit(kind), s, part).alias("key")))
    return F.array(*keys)


def _shared(rows: DataFrame, key: str, who: str) -> DataFrame:
    """The rows whose key another `who` has too. Counted before rows move; skewed joins are split."""
    both = rows.groupBy(key).agg(F.min(who).alias("__p"), F.max(who).alias("__q")).where("__p <> __q")
    return rows.join(both.select(key), key)


def line_duplicates(spark: SparkSession, docs: DataFrame, near_chars: int = NEAR_CHARS) -> DataFrame:
    """doc_id, row_key and the numbers of the lines that go: exact (equal to an earlier line) and near (one edit from one).

    Lines are lower-cased and trimmed; all that are not blank take part, and in near pairs those of near_chars characters or more. The order
    is (doc_id, row_key, line number), null doc_ids last. A line goes if any earlier line is equal or at Levenshtein
    distance 1, whether that one stays or not; so the earliest line of every class stays.

    1. Equal lines are reduced to their first occurrence by hash.
    2. Lines that share no half with another line (s/2 first or last characters) cannot have a neighbour.
    3. The other half is cut into segments; a line stays a candidate where it shares all but one segment.
    4. In that segment every variant with one character deleted is emitted as a hashed key.
       Equal key and equal place: one substitution apart, all of them pairwise. Key equal to a
       whole segment: one insertion apart. So each group needs only its earliest line, and pairs
       grow in proportion to lines.
    5. Found pairs are confirmed by Levenshtein distance.
    """
    work = Workspace(spark, "lines")
    exploded = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .select("doc_id", _row_key().alias("row_key"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        .withColumn("norm", _norm(F.col("line")))
        .withColumn("n", F.length("norm"))
        .where(F.col("n") > 0)
        .drop("line")
    )
    lines = work.save(
        exploded.select(
            "doc_id",
            "row_key",
            "line_no",
            F.xxhash64("norm").alias("k1"),
            F.hash("norm").alias("k2"),
            F.when(F.col("n") >= near_chars, _half_keys(F.col("norm"), F.col("n"))).alias("halves"),
        ),
        "lines",
    )
    pos = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "row_key", "line_no")
    distinct = work.save(
        lines.groupBy("k1", "k2").agg(F.min(pos).alias("first"), F.max(pos).alias("last")), "distinct"
    )
    halves = lines.select("k1", "k2", F.explode("halves").alias("x")).select("k1", "k2", "x.s", "x.kind", "x.key")
    candidates = (
        _shared(halves, "key", "k1")
        .groupBy("k1", "k2")
        .agg(F.collect_set(F.struct("s", "kind")).alias("options"))
        .join(distinct, ["k1", "k2"])
        .select("options", "first", F.col("first.row_key").alias("row_key"), F.col("first.line_no").alias("line_no"))
    )
    candidates = work.save(candidates, "candidates")
    texts = work.save(
        exploded.select("row_key", "line_no", "norm", "n")
        .join(small(candidates, candidates.count(), BROADCAST_KEYS), ["row_key", "line_no"])
        .dropDuplicates(["row_key", "line_no"])
        .select("first", "norm", "n", "options"),
        "texts",
    )
    near = work.save(_near(work, texts), "near")
    work.drop("lines", "distinct", "near")

    repeated = distinct.where("first <> last").select("k1", "k2", "first", F.lit(False).alias("near"))
    close = distinct.join(near, "first").select("k1", "k2", "first", F.lit(True).alias("near"))
    marks = repeated.union(close).groupBy("k1", "k2", "first").agg(F.max("near").alias("near"))
    gone = (
        lines.select("k1", "k2", "doc_id", "row_key", "line_no", pos.alias("pos"))
        .join(marks, ["k1", "k2"])
        .where("near or pos <> first")
        .groupBy("doc_id", "row_key")
        .agg(
            F.collect_set(F.when(~F.col("near") | (F.col("pos") != F.col("first")), F.col("line_no"))).alias("exact"),
            F.collect_set(F.when(F.col("near") & (F.col("pos") == F.col("first")), F.col("line_no"))).alias("near"),
        )
    )
    gone = work.save(gone, "gone")
    work.drop("gone")
    return gone


def _near(work: Workspace, texts: DataFrame) -> DataFrame:
    """`first` of the lines with an earlier line at distance 1."""
    n, s, norm = F.col("n"), F.col("s"), F.col("norm")
    # Hashing what is outside of each segment takes n * n / length, the variants n * length: with the root of n both stay n ** 1.5.
    length = F.greatest(F.lit(float(SEGMENT_CHARS)), F.sqrt(s.cast("double")))
    parts = (2 * F.greatest(F.ceil(s / (2 * length)), F.lit(1))).cast("int")
    start, end = F.floor(F.col("j") * s / F.col("parts")), F.floor((F.col("j") + 1) * s / F.col("parts"))
    half = (F.col("parts") / 2).cast("int")
    segments = (
        texts.select("first", "norm", "n", F.explode("options").alias("x"))
        .select("first", "norm", "n", "x.s", "x.kind")
        .withColumn("parts", parts)
        .withColumn(
            "j",
            F.explode(
                F.when(F.col("kind") == 0, F.sequence(half, F.col("parts") - 1)).otherwise(F.sequence(F.lit(0), half - 1))
            ),
        )
        .select(
            "first",
            (n > s).alias("longer"),
            F.xxhash64(s, F.col("j"), _cut(norm, F.lit(0), start), _cut(norm, n - (s - end), s - end)).alias("outer"),
            _cut(norm, start, end - start + (n - s)).alias("segment"),
        )
    )
    segments = _shared(work.save(segments, "segments"), "outer", "first")
    length = F.length("segment")
    seg = F.col("segment")
    places = F.when(length > 0, F.sequence(F.lit(1), length)).otherwise(F.array().cast("array<int>"))

    def without(p: Column) -> Column:
        return F.concat(_cut(seg, F.lit(0), p - 1), _cut(seg, p, length - p))

    def row(key: Column, role: Column) -> Column:
        return F.struct(key.alias("key"), role.alias("role"))

    # Roles: 0 substitution, 1 the shorter line of an insertion, 2 the longer one.
    whole = F.array(row(F.xxhash64("outer", F.lit("I"), seg), F.lit(1)))
    changed = F.transform(places, lambda p: row(F.xxhash64("outer", F.lit("S"), p, without(p)), F.lit(0)))
    shortened = F.array_distinct(F.transform(places, lambda p: row(F.xxhash64("outer", F.lit("I"), without(p)), F.lit(2))))
    variants = segments.select(
        "first", F.explode(F.when(F.col("longer"), shortened).otherwise(F.concat(whole, changed))).alias("x")
    ).select("first", "x.key", "x.role")

    def least(role: int) -> Column:
        return F.min(F.when(F.col("role") == role, F.col("first")))

    groups = (
        variants.groupBy("key")
        .agg(
            least(0).alias("m0"),
            F.max(F.when(F.col("role") == 0, F.col("first"))).alias("x0"),
            least(1).alias("m1"),
            least(2).alias("m2"),
        )
        .where("m0 <> x0 or (m1 is not null and m2 is not null)")
        .drop("x0")
    )
    partner = F.when(F.col("role") == 0, F.col("m0")).when(F.col("role") == 1, F.col("m2")).otherwise(F.col("m1"))
    pairs = (
        variants.join(groups, "key")
        .select("first", partner.alias("partner"))
        .where("partner < first")
        .groupBy("first")
        .agg(F.min("partner").alias("partner"))
    )
    text = texts.select("first", "norm")
    other = texts.select(F.col("first").alias("partner"), F.col("norm").alias("other"))
    return (
        pairs.join(text, "first").join(other, "partner").where(F.levenshtein("norm", "other", 1) == 1).select("first")
    )


def _cleaned(spark: SparkSession, docs: DataFrame, near_chars: int) -> DataFrame:
    """docs with their text cleaned, and __lines, __n_exact and __n_near."""
    gone = line_duplicates(spark, docs, near_chars)
    rows, numbers = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("exact") + F.size("near")), F.lit(0))).first()
    # The size of both, the rows and their arrays, decides whether texts must move.
    gone = small(gone, rows, BROADCAST_KEYS if numbers <= BROADCAST_NUMBERS else 0).select(
        F.col("doc_id").alias("__id"), F.col("row_key").alias("__key"), F.col("exact").alias("__exact"), F.col("near").alias("__near")
    )
    keyed = docs.withColumn("__row", F.xxhash64(F.col("doc_id").cast("long"), F.col("text")))
    same = (F.col("__row") == F.col("__key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id"))
    joined = keyed.join(gone, same, "left")
    none = F.array().cast("array<int>")
    dropped = F.concat(F.coalesce("__exact", none), F.coalesce("__near", none))
    lines = F.split("text", "\n")
    # The line numbers in order, each with its mark: work in proportion to the lines, however many go.
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)
    mark = lambda numbers, gone: F.transform(numbers, lambda i: F.struct(i.alias("i"), F.lit(gone).alias("gone")))
    marks = F.array_sort(F.concat(mark(dropped, True), mark(kept, False)))
    left = F.array_join(F.zip_with(lines, marks, lambda x, m: F.when(~m["gone"], x)), "\n")
    text = F.when(F.col("__key").isNull(), F.col("text")).otherwise(left)
    return joined.select(
        *[text.alias("text") if c == "text" else F.col(c) for c in docs.columns],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("__lines"),
        F.coalesce(F.size("__exact"), F.lit(0)).cast("long").alias("__n_exact"),
        F.coalesce(F.size("__near"), F.lit(0)).cast("long").alias("__n_near"),
    )


def _with_length(out: DataFrame, docs: DataFrame) -> DataFrame:
    """n_chars brought up to date where docs has it."""
    if "n_chars" not in docs.columns:
        return out
    changed = F.col("__n_exact") + F.col("__n_near") > 0
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))


def dedup_lines(spark: SparkSession, docs: DataFrame, near_chars: int = NEAR_CHARS) -> DataFrame:
    """docs with `text` free of repeated lines, and n_lines, n_exact and n_near (longs: all lines, and lines that went).

    Null texts stay null with 0 lines, and empty texts and blank lines stay as they are. Rows equal in doc_id and text get the
    same result: they are one document. Very long lines take time like length ** 1.5. Other columns are kept, but columns of docs named
    n_lines, n_exact or n_near give way to these; an n_chars column is brought up to date where lines went, and an empty table gives an empty result.
    """
    new = {"n_lines": "__lines", "n_exact": "__n_exact", "n_near": "__n_near"}
    out = _with_length(_cleaned(spark, docs, near_chars), docs)
    return out.select(*[c for c in docs.columns if c not in new], *[F.col(x).alias(c) for c, x in new.items()])


def keep_lines(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with repeated lines removed, in their own columns; documents of which no word is left go, unless they had none before."""
    out = _with_length(_cleaned(spark, docs, NEAR_CHARS), docs)
    emptied = (F.col("__n_exact") + F.col("__n_near") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.where(~F.coalesce(emptied, F.lit(False))).select(*docs.columns)


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_lines(spark, docs.select("doc_id", "text"))


OP8_SQL = f"""
with l as (select doc_id, text, unnest(range(len(string_split(text, chr(10))))) line_no from documents where text is not null),
lines as (select doc_id, line_no, string_split(text, chr(10))[line_no + 1] line,
    lower(trim(string_split(text, chr(10))[line_no + 1], ' ' || chr(9) || chr(11) || chr(12) || chr(13))) norm from l),
firsts as (select norm, min(struct_pack(d := doc_id, l := line_no)) pos, length(norm) n from lines where norm <> '' group by norm),
halves as (select norm, pos, n, s, unnest([[0, hash(norm[1:s // 2])], [1, hash(norm[n - (s - s // 2) + 1:n])]]) half
    from (select norm, pos, n, unnest([n, n - 1]) s from firsts where n >= {NEAR_CHARS})),
pairs as (select distinct b.norm, a.norm other from halves a join halves b on a.s = b.s and a.half = b.half and a.pos < b.pos and abs(a.n - b.n) <= 1
    and a.s <= least(a.n, b.n)),
shaped as (select norm, case when length(norm) < length(other) then norm else other end x, case when length(norm) < length(other) then other else norm end y from pairs),
meets as (select *, coalesce(list_position(list_transform(range(1, length(x) + 1), lambda i: x[i:i] = y[i:i]), false), length(x) + 1) p from shaped),
near as (select distinct norm from meets where x[p + (case when length(x) = length(y) then 1 else 0 end):] = y[p + 1:]),
marked as (select o.*, f.norm is not null and f.pos <> struct_pack(d := o.doc_id, l := o.line_no) is_exact,
    near.norm is not null and f.pos = struct_pack(d := o.doc_id, l := o.line_no) is_near
    from lines o left join firsts f on o.norm = f.norm left join near on o.norm = near.norm),
done as (select doc_id, coalesce(string_agg(line, chr(10) order by line_no) filter (not is_exact and not is_near), '') text, count(*) n_lines,
    count(*) filter (is_exact) n_exact, count(*) filter (is_near) n_near from marked group by doc_id)
select d.doc_id, done.text, coalesce(n_lines, 0) n_lines, coalesce(n_exact, 0) n_exact, coalesce(n_near, 0) n_near
from documents d left join done on d.doc_id = done.doc_id
"""
