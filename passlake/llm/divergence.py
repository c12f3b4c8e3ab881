"""Operator 11: how far the sources of a language differ in their use of terms; strings travel only for what is kept."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passlake.llm.common import BROADCAST_KEYS, Workspace, arrow_rows, small

MIN_DOCS = 30
TOP = 50
#: Fixed values of the shares: the count that is added to each term, and the whole that shares are parts of.
ADDED, WHOLE = 5, 1_000_000_000
#: Terms of all groups that a task holds before it writes them, bytes of a text that are split at once, rows given to Python at once.
HELD_TERMS, PIECE_BYTES, TEXTS = 600_000, 1 << 20, 256
#: Sources of a block and counted rows of a block of terms, when sources meet.
BLOCK_SOURCES, BLOCK_ROWS = 64, 20_000
DIGEST_BITS = 64

#: Each byte that ends a term becomes a space, A to Z become small; bytes from 128 on stay, so UTF-8 stays whole.
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_PARTIAL = pa.schema([("gid", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about PIECE_BYTES, cut where a term has ended."""
    at = 0
    while at < len(text):
        end = at + PIECE_BYTES
        while end < len(text) and _TERM_BYTES[text[end]] != 32:
            end += 1
        yield text[at:end]
        at = end


def _count(held: int):
    """mapInArrow: the terms of each group (gid) with their counts and numbers of documents, summed over the texts that a task holds at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs, size = defaultdict(Counter), defaultdict(Counter), 0

        def flush() -> Iterator[pa.RecordBatch]:
            for gid, found in counts.items():
                rows, of_docs = len(found), docs[gid]
                terms = pa.array(list(found), pa.binary()).cast(pa.string(), safe=False)
                numbers = [np.fromiter(x, np.int64, rows) for x in (found.values(), map(of_docs.__getitem__, found))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, gid)), terms, *map(pa.array, numbers)], schema=_PARTIAL)
            counts.clear()
            docs.clear()

        for batch in batches:
            for gid, text in zip(batch.column("gid").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found, seen = counts[gid], set()
                before = len(found)
                for piece in _pieces(text):
                    tokens = piece.translate(_TERM_BYTES).split()
                    found.update(tokens)
                    seen.update(tokens)
                docs[gid].update(seen)
                size += len(found) - before
                if size > held:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def term_counts(spark: SparkSession, work: Workspace, docs: DataFrame, min_docs: int = MIN_DOCS, digest_bits: int = DIGEST_BITS, held: int = HELD_TERMS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Saved tables: groups (gid, lang, source), counts (lang, gid, digest, part, n) of kept terms, and names (digest, part, term) of them.

    A task writes the digest, counts and string of each term of its groups once; the strings lie in a column
    of their own, which the count by digest doesn't read. Digests in enough documents get their least and greatest string; where these
    differ, the digest is split: its strings are told apart by `part` (0 for all others) and counted again.
    """
    ready = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    groups = work.save(ready.select("lang", "source").distinct().withColumn("gid", F.monotonically_increasing_id()), "groups")
    n_groups = groups.count()
    texts = ready.join(small(groups, n_groups, BROADCAST_KEYS), ["lang", "source"]).select("gid", F.col("text").cast("binary").alias("text"))
    digest = F.shiftright(F.xxhash64("term"), 64 - digest_bits) if digest_bits < 64 else F.xxhash64("term")
    with arrow_rows(spark, TEXTS):
        partial = texts.mapInArrow(_count(held), "gid long, term string, n long, docs long").select("gid", digest.alias("digest"), "n", "docs", "term")
        partial = work.save(partial, "partial")
    sums = [F.sum("n").alias("n"), F.sum("docs").alias("docs")]
    by_digest = work.save(partial.groupBy("gid", "digest").agg(*sums), "by-digest")
    langs = small(groups.select("gid", "lang"), n_groups, BROADCAST_KEYS)
    wide = by_digest.join(langs, "gid").groupBy("lang", "digest").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    wide = work.save(wide.select("digest").distinct(), "candidates")
    n_wide = wide.count()
    # equal strings meet first, by hash; what is left for the least and greatest is a row for each string
    strings = partial.select("digest", "term").join(small(wide, n_wide, BROADCAST_KEYS), "digest", "left_semi").distinct()
    ends = work.save(strings.groupBy("digest").agg(F.min("term").alias("least"), F.max("term").alias("most")), "ends")
    names = ends.where("least = most").select("digest", F.lit(0).alias("part"), F.col("least").alias("term"))
    shared = ends.where("least <> most").select("digest")
    n_shared = shared.count()
    whole = by_digest.join(small(wide, n_wide, BROADCAST_KEYS), "digest", "left_semi")
    if n_shared:
        whole = whole.join(small(shared, n_shared), "digest", "left_anti")
        strings = partial.select("digest", "term").join(small(shared, n_shared), "digest", "left_semi").distinct()
        split = work.save(strings.withColumn("part", F.row_number().over(Window.partitionBy("digest").orderBy("term"))), "split")
        again = partial.join(small(split, split.count()), ["digest", "term"]).groupBy("gid", "digest", "part").agg(*sums)
        whole, names = whole.withColumn("part", F.lit(0)).unionByName(again), names.unionByName(split.select(names.columns))
    else:
        whole = whole.withColumn("part", F.lit(0))
    whole = whole.join(langs, "gid")
    kept = whole.groupBy("lang", "digest", "part").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    kept = work.save(kept.select("lang", "digest", "part"), "kept")
    counts = whole.join(small(kept, kept.count(), BROADCAST_KEYS), ["lang", "digest", "part"], "left_semi")
    counts = work.save(counts.select("lang", "gid", "digest", "part", "n"), "counts")
    return groups, counts, names.join(kept.select("digest", "part").distinct(), ["digest", "part"], "left_semi")


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(WHOLE * (n + ADDED) / (total + ADDED * terms)), exact."""
    long = lambda x: x.cast("decimal(19,0)")
    top = (long(n) + F.lit(ADDED).cast("decimal(19,0)")) * F.lit(WHOLE).cast("decimal(10,0)")
    under = long(total) + long(terms) * F.lit(ADDED).cast("decimal(1,0)")
    return 1 + F.call_function("div", top, under)


def _corrections(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """How much |p - q|, summed over the terms here, is more than |base - base|, for the pairs of sources of two blocks. Rows that are not counted state the sources."""
    sources, used = rows[~rows["counted"]].sort_values("gid"), rows[rows["counted"]]
    if used.empty:
        return pd.DataFrame(columns=["gid", "other", "more"]).astype(np.int64)
    gids, base, block = (sources[c].to_numpy(np.int64) for c in ("gid", "base", "block"))
    line, terms = pd.factorize(pd.MultiIndex.from_frame(used[["digest", "part"]]))
    p = np.tile(base, (len(terms), 1))
    p[line, np.searchsorted(gids, used["gid"].to_numpy(np.int64))] = used["p"].to_numpy(np.int64)
    out = []
    for i in np.nonzero(block == key[2])[0]:
        js = np.nonzero(block == key[3])[0]
        more = np.abs(p[:, js] - p[:, i : i + 1]).sum(axis=0) - len(terms) * np.abs(base[js] - base[i])
        out += [(int(gids[i]), int(gids[j]), int(x)) for j, x in zip(js, more, strict=True) if i != j]
    return pd.DataFrame(out, columns=["gid", "other", "more"]).astype(np.int64)


def source_divergence(
    spark: SparkSession, docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, digest_bits: int = DIGEST_BITS, block_sources: int = BLOCK_SOURCES, block_rows: int = BLOCK_ROWS, held: int = HELD_TERMS
) -> DataFrame:
    """lang, source, part, item, value, rank: distances of a source from the other sources of its language (part `pair`), and its most overused terms (part `term`).

    Terms are runs of ASCII letters and of characters over 127; only A to Z are lower-cased. A language keeps the V terms that stand in at least min_docs of its documents. A group
    (lang, source), and each lang, gives a kept term p = 1 + floor(10^9 (count + 5) / (N + 5 V)), N its count of kept terms, in whole
    numbers. `pair`: item is another source of the language, value the sum of |p - q| over all kept terms, all ranks. `term`: item is a kept term that the source uses with
    p over the language's q, value p - q, ranks to `top`. Ranks go by value, then by the item's UTF-8.

    Null text, lang and source count as ''; a repeated row is a document of its own; empty and very long texts are read whole, the latter in pieces; other columns are
    ignored; an empty table gives an empty result.

    Counts move by 64-bit digests, pre-aggregated by task (`term_counts`); strings move once for a candidate, to find digests of two strings, and once for a row that may be returned. A sum over
    all terms is V |base - base| for the shares of unused terms, and a correction from blocks of terms that one of two blocks of sources uses; so no group
    or term meets in one task. Sources of a language meet pair by pair in the result itself, which asks for all ranks.
    """
    work = Workspace(spark, "divergence")
    groups, counts, names = term_counts(spark, work, docs, min_docs, digest_bits, held)
    of_lang = counts.groupBy("lang", "digest", "part").agg(F.sum("n").alias("lang_n"))
    sizes = of_lang.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = groups.join(counts.groupBy("gid").agg(F.sum("n").alias("total")), "gid", "left").join(sizes, "lang", "left")
    zero = F.lit(0).cast("long")
    totals = totals.select("gid", "lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "terms", "lang_total")])
    base = F.when(F.col("terms") > 0, _share(zero, F.col("total"), F.col("terms"))).otherwise(zero)
    numbered = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # a language's sources; the result has each beside all others
    totals = work.save(totals.withColumn("base", base).withColumn("block", F.floor(numbered / block_sources).cast("long")), "totals")
    n_groups = totals.count()
    per_group = counts.join(small(totals.drop("lang"), n_groups), "gid").withColumn("p", _share(F.col("n"), F.col("total"), F.col("terms")))
    per_group = work.save(per_group.select("lang", "gid", "digest", "part", "n", "p", "base", "block"), "shares")

    # part pair: a row goes to each pair of blocks that its source's block is in; each source states its base to all pieces
    last = totals.groupBy("lang").agg(F.max("block").alias("last"))
    load = per_group.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("pieces"))
    shape = work.save(last.join(load, "lang"), "shape")
    meets = F.transform(F.sequence(zero, F.col("last")), lambda b: F.struct(F.least(b, F.col("block")).alias("a"), F.greatest(b, F.col("block")).alias("b")))
    shape = small(shape, shape.count())
    piece = F.pmod(F.xxhash64("digest", "part"), F.col("pieces"))
    used = per_group.join(shape, "lang").withColumn("meet", F.explode(meets)).withColumn("piece", piece).withColumn("counted", F.lit(True))
    stated = totals.join(shape, "lang").withColumn("meet", F.explode(meets)).withColumn("piece", F.explode(F.sequence(zero, F.col("pieces") - 1)))
    stated = stated.withColumns({"digest": zero, "part": F.lit(0), "p": zero, "counted": F.lit(False)})
    dealt = ["lang", "piece", F.col("meet.a").alias("a"), F.col("meet.b").alias("b"), "gid", "digest", "part", "p", "base", "block", "counted"]
    dealt = used.select(*dealt).union(stated.select(*dealt))
    more = dealt.groupBy("lang", "piece", "a", "b").applyInPandas(_corrections, "gid long, other long, more long")
    blocks = totals.select("gid", "block")
    sides = more.join(small(blocks, n_groups), "gid").join(small(blocks.select(F.col("gid").alias("other"), F.col("block").alias("other_block")), n_groups), "other")
    turned = sides.where("block <> other_block").select(F.col("other").alias("gid"), F.col("gid").alias("other"), "more")
    summed = sides.select("gid", "other", "more").union(turned).groupBy("gid", "other").agg(F.sum("more").alias("more"))
    other = totals.select("lang", F.col("gid").alias("other"), F.col("source").alias("item"), F.col("base").alias("other_base"))
    pairs = totals.join(other, "lang").where("gid <> other").join(summed, ["gid", "other"], "left")
    value = F.col("terms") * F.abs(F.col("base") - F.col("other_base")) + F.coalesce("more", zero)
    order = Window.partitionBy("gid").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", "gid", F.lit("pair").alias("part"), "item", value.alias("value")).withColumn("rank", F.row_number().over(order))

    # part term: ties at the last rank keep their place until the strings are there
    of_lang = of_lang.join(small(sizes, n_groups), "lang").withColumn("q", _share(F.col("lang_n"), F.col("lang_total"), F.col("terms")))
    over = per_group.join(of_lang.select("lang", "digest", "part", "q"), ["lang", "digest", "part"]).where("n > 0 and p > q")
    over = over.select("gid", "digest", "part", (F.col("p") - F.col("q")).alias("value"))
    near = over.withColumn("r", F.rank().over(Window.partitionBy("gid").orderBy(F.desc("value")))).where(F.col("r") <= top).drop("r")
    named = near.join(names, ["digest", "part"]).select("gid", F.col("term").alias("item"), "value")
    named = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    terms = named.join(small(totals.select("gid", "lang", "source"), n_groups), "gid")
    out = ["lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")]
    return pairs.select(*out).union(terms.withColumn("part", F.lit("term")).select(*out))


def op11_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source")
    return source_divergence(spark, docs)


_P = "1 + ({n} + {added}::hugeint) * {whole}::hugeint // ({total} + {added} * {terms}::hugeint)"


def _sql_share(n: str, total: str, terms: str) -> str:
    return _P.format(n=n, total=total, terms=terms, added=ADDED, whole=WHOLE)


OP11_SQL = rf"""
with d as (select row_number() over () r, coalesce(text, '') t, coalesce(lang, '') lang, coalesce(source, '') source from documents),
w as (select r, lang, source, translate(unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') term from d),
kept as (select lang, term, count(*) n from w group by all having count(distinct r) >= {MIN_DOCS}),
l as (select lang, count(*) v, sum(n) total from kept group by all),
g as (select distinct lang, source from d),
c as (select w.lang, source, w.term, count(*) n from w join kept using (lang, term) group by all),
t as (select lang, source, sum(n) total from c group by all),
s as (select g.lang, g.source, k.term, coalesce(c.n, 0) n, {_sql_share("coalesce(c.n, 0)", "coalesce(t.total, 0)", "l.v")} p, {_sql_share("k.n", "l.total", "l.v")} q
    from g join kept k on g.lang = k.lang join l on l.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term
    left join t on t.lang = g.lang and t.source = g.source),
sums as (select a.lang, a.source, b.source item, sum(abs(a.p - b.p)) f from s a join s b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' part, b.source item, cast(coalesce(f, 0) as bigint) f from g a join g b on a.lang = b.lang and a.source <> b.source
    left join sums on sums.lang = a.lang and sums.source = a.source and sums.item = b.source),
terms as (select lang, source, 'term' part, term item, cast(p - q as bigint) f from s where n > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by f desc, item) rank from (select * from pairs union all select * from terms))
select lang, source, part, item, f as "value", cast(rank as integer) rank from r where part = 'pair' or rank <= {TOP}
"""
