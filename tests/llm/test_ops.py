"""The ten operators and the pipeline against brute force, on the smallest tables and on a fixture of hard rows."""

import collections
import hashlib
import math
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from passlake.llm import html_text, kdtree, license_scan, line_dedup, minhash_dedup, mixing, packing, quality_rules, queries, sharding, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, label string, n_lines int, copy string, n_copies int, kept int"
EXTRA = ("u", "l", 7, "c", 99, 5)  # columns whose names the operators use too


@pytest.fixture(scope="module")
def given(spark):
    """Documents of the smallest tables, and rows with nulls, ties, empty and long texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.select("*", *[F.lit(x).alias(c.split()[0]) for x, c in zip(EXTRA, SCHEMA.split(", ")[5:], strict=True)])
    long = " ".join(f"word{k % 977}x{k}" for k in range(6000))
    hard = [
        (1001, None, None, None, None), (1002, "", "en", "s", 0), (1003, " \n\t ", "en", "s", 4), (1004, "one", "en", "s", 3), (1005, "one", "en", "s", 3),
        (1005, "one", "en", "s", 3), (2**53 + 1, "one", "en", "s", 3), (1010, "x" * 3000 + "\n" + "x" * 1200 + "y" + "x" * 1799, "en", "s", 1),
        (None, "a line without a number of its own", "en", "s", 1), (1006, long, "en", "s", 1), (1007, long + " tail", None, "s", 1),
        (1008, "The same line stands here, twice.\nThe same line stands here, twice.\nthe same line stands here, twicE", "en", "s", 1),
        (1009, "The same line stands here, twicer.\r\n<|endoftext|>  two  spaces and more", "en", "s", 1),
    ]
    return docs.unionByName(spark.createDataFrame([(*r, *EXTRA) for r in hard], SCHEMA)).coalesce(3)


@pytest.fixture(scope="module")
def rows(given):
    return [(r.doc_id, r.text or "", r.source or "") for r in given.collect()]


def words(text):
    return text.encode().split()


def test_quality_counters(spark, given, rows):
    got = collections.Counter(
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.quality_rules(spark, given).collect()
    )
    want = collections.Counter()
    for d, t, _ in rows:
        w = words(t)
        grams = list(zip(w, w[1:], w[2:], strict=False))
        n = collections.Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want[d, len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed] += 1
    assert got == want


def test_quality_line_limits(spark):
    body = lambda k: " ".join(f"w{k}q{i}" for i in range(60))
    mark = "shared notice " + "of every page " * 20
    rows = [(k, f"{body(k)}\n{mark}", "h") for k in range(30)] + [(100 + k, f"{mark}\n{body(k)[:20]}", "h") for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark, docs, min_docs=10).collect()}
    assert got[0].removed_words == 0 and got[1].removed_words == 62
    assert all(got[k].kept == (62 * 100 <= 50 * got[k].n_words) for k in range(1, 30))
    assert not any(got[100 + k].kept for k in range(5))
    assert quality_rules.keep_quality(spark, docs).columns == docs.columns


def test_quality_removes_lines(spark):
    notice = ["Shared  NOTICE of this host", "shared notice of this host "]
    rows = []
    for k in range(140):
        own = [" ".join(f"w{k}q{i}x{j}" for i in range(20)) for j in range(4)]
        own[1:1] = [notice[k % 2], ""] * (1 + k % 3)
        rows.append((k, "\n".join(own), "h" if k < 130 else None))
    rows.append((5, rows[5][1], "h"))  # an equal row gets the same result
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, source string, n_chars int").repartition(5)
    holders = collections.defaultdict(dict)
    for d, t, h in rows:
        for line in t.split("\n"):
            holders[h, " ".join(line.lower().split())].setdefault(t, d)
    want = collections.Counter()
    for d, t, h in rows:
        kept = []
        for line in t.split("\n"):
            of = holders[h, " ".join(line.lower().split())]
            if not line.split() or len(of) <= 100 or min(of.values()) == d:
                kept.append(line)
        want[d, "\n".join(kept)] += 1
    got = quality_rules.quality_rules(spark, docs).collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == want
    assert all(r.removed_words == (0 if r.doc_id == 0 or r.doc_id >= 130 else 5 * (1 + r.doc_id % 3)) for r in got)
    left = quality_rules.keep_quality(spark, docs).collect()
    assert collections.Counter((r.doc_id, r.text) for r in left) == want and all(r.n_chars == len(r.text) for r in left)


def test_quality_counts_distinct_documents(spark):
    notice = " ".join(f"notice{k}" for k in range(170))
    rows = [(k, f"{notice}\n" + " ".join(f"own{k}x{j}" for j in range(30)), "h") for k in range(160)]  # 85 % one notice each
    page = [" ".join(f"page{k}x{j}" for j in range(60)) for k in range(5)]
    rows += [(1000 + k, "\n".join(page) + f"\nedit{k} of this page", "h") for k in range(130)]  # near copies of one page
    rows += [(2000 + k, " ".join(f"other{k}x{j}" for j in range(60)), "h") for k in range(7000)]  # 2 % of the host are over 100
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark, docs).collect()}
    assert got[0].kept and got[0].removed_words == 0
    assert all(got[k].removed_words == 170 and not got[k].kept for k in range(1, 160))
    assert all(r.removed_words == 0 and r.kept for d, r in got.items() if d >= 1000)


def test_licences(spark):
    notices = {"apache-2.0": "Licensed under the Apache License, Version 2.0.", "mit": "Released under the MIT License.", "unknown": "All rights reserved.", "none": "Just a line of prose."}
    docs = spark.createDataFrame(list(enumerate(f"Some prose.\n{t}" for t in notices.values())) + [(9, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(spark, docs).collect()}
    assert [got[k].license for k in range(4)] == list(notices)
    assert got[9].n_paragraphs == 0 and got[9].license == "none"


def test_licences_in_other_words(spark):
    """Wordings that no template has, and prose with a licence's words."""
    said = {
        "You can use this code under the terms of the Apache License 2.0": "apache-2.0",
        "This project is distributed under the MIT license": "mit",
        "This file is part of a library licensed under the GNU General Public License v3.0": "gpl",
        "GPLv3 or later": "gpl",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND': "mit",
        "BSD-3-Clause": "bsd",
        "CC-BY-SA-4.0": "cc-by-sa",
        "She gave him permission to drive the car": "none",
        "The copyright question was raised in court": "none",
        "Most of the software engineers at MIT wrote programs for the public": "none",
    }
    rows = [(k, f"Some prose.\n{t}", "x") for k, t in enumerate(said)] + [(3, f"Some prose.\n{list(said)[3]}", "x"), (20, None, "x"), (21, "", "x"), (22, "a b " * 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = license_scan.scan(spark, docs).collect()
    assert len(got) == len(rows)
    right = sum(r.license == list(said.values())[r.doc_id] for r in got if r.doc_id < 10)
    assert right >= 10, [(list(said)[r.doc_id], r.license) for r in got if r.doc_id < 10]  # of 11
    assert all(r.license == "none" for r in got if r.doc_id >= 20)


def test_unlisted_licences_are_unknown_and_templates_are_confirmed(spark):
    """Notices that share only what all licences share, and every template by itself."""
    others = [
        "Licensed under the Eclipse Public License 2.0.", "Licensed under the European Union Public Licence, version 1.2.", "This software is released under the zlib license.",
        "Licensed under the Academic Free License version 3.0.", "SPDX-License-Identifier: EPL-2.0", "Distributed under the Boost Software License, Version 1.0.",
        "Licensed under the Artistic License 2.0.", "This file is licensed under the PostgreSQL License.",
    ]
    named = [(f, t) for f, texts in license_scan.TEMPLATES.items() for t in texts]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*others, *[t for _, t in named]])], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(spark, docs).collect()}
    assert [got[k].families for k in range(len(others))] == [[]] * len(others)
    assert [got[len(others) + k].license for k in range(len(named))] == [f for f, _ in named]
    assert all(r.probability is not None for r in got.values() if r.license != "none")


@pytest.mark.parametrize("shard_rows", [40, 8192])
def test_top_k_is_exact(spark, shard_rows):
    dice = np.random.default_rng(1)
    data = [(k, [float(x) for x in v]) for k, v in enumerate(np.round(dice.normal(0, 1, (230, 6)), 1))]
    data += [(300, None), (301, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (302, [None, 1.0, 0.0, 0.0, 0.0, 0.0]), (350, [1e5] * 6), (400, [1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = kdtree.top_k(spark, df, df.where("vec_id % 50 = 0"), shard_rows=shard_rows, block_rows=3).collect()
    ints = {i: np.floor(256 * np.array(v, float)).astype(np.int64) for i, v in data if v and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in (x for x in ints if x % 50 == 0):
        scores = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))[:5]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want and len(got) == len(want)


def test_top_k_of_hard_rows(spark):
    rows = [(0, [1.0, 2.0], 5, 1), (0, [1.0, 2.0], 6, 1), (0, [0.0, 1.0], 7, 1), (1, [3.0, 1.0], 8, 1), (2, [0.0, 9.0], 9, 1), (None, [1.0, 1.0], 9, 1), (3, [], 9, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score long, rank int")
    got = kdtree.top_k(spark, df, df.where("vec_id = 0")).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 2, 9 * 256 * 256), (2, 1, 256 * 256)]
    assert kdtree.top_k(spark, df.limit(0), df.limit(0)).count() == 0


def test_toxicity_learns_pairs_and_holds_out(spark):
    docs, labels = [], []
    for k in range(1200):
        a, b = k % 2, k // 2 % 2
        docs.append((k, f"filler{k % 37} {'grumble' if a else 'smile'} about {'strangers' if b else 'weather'}"))
        labels.append((k, a * b))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(spark, d, lab).collect()}
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in got)
    assert all(got[k].predicted == y for k, y in labels)
    assert toxicity.toxicity(spark, d, lab.limit(0)).where("predicted = 1").count() == 0


def test_toxicity_learns_pairs_of_harmless_terms(spark):
    dice = np.random.default_rng(5)
    docs, labels = [], []
    for k in range(2000):
        a, b = dice.integers(0, 2, 2)
        filler = " ".join(f"filler{x}" for x in dice.integers(0, 40, 6))
        docs.append((k, f"{filler} {'people' if a else 'tables'} {'outside' if b else 'within'}"))
        labels.append((k, int(a ^ b)))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(spark, d, lab).collect()}
    held = [k for k in got if got[k].held_out]
    assert np.mean([got[k].predicted == labels[k][1] for k in held]) > 0.95
    linear = toxicity.score(d, toxicity.train(spark, d, lab, factors=0)).where("held_out").collect()
    assert np.mean([r.predicted == labels[r.doc_id][1] for r in linear]) < 0.7


def test_toxicity_of_hard_rows(spark):
    rows = [(2**53 + 1, "smile", 3.0), (None, None, 1.0), (2**53 + 1, "smile", 2.0), (5, "", 0.0), (6, "word " * 100_000, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(2**53 + 1, 0), (5, 1), (None, 1), (6, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(spark, docs, labels).collect()
    assert sorted((str(r.doc_id) for r in got)) == ["5", "6", *["9007199254740993"] * 2, "None"] and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(spark, docs.limit(0), labels).count() == 0


def test_shards_are_even_and_keep_copies(spark, given, rows):
    got = sharding.shard(spark, given).collect()
    sizes = collections.Counter(r.shard for r in got)
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == collections.Counter((d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t, _ in rows)
    hot = spark.createDataFrame([(k, "copy" if k < 400 else f"own {k}") for k in range(1000)], "doc_id long, text string")
    out = sharding.shard(spark, hot).collect()
    of = collections.Counter(r.shard for r in out if r.doc_id < 400)
    assert len(of) <= 8 and set(collections.Counter(r.shard for r in out).values()) == {62, 63}


def test_shards_of_a_table_of_copies(spark):
    rows = [(k, f"text {k}") for k in range(250) for _ in range(2 + k % 9)]
    out = sharding.shard(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sizes = collections.Counter(r.shard for r in out)
    assert len(out) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1
    of = collections.defaultdict(collections.Counter)
    for r in out:
        of[r.doc_id][r.shard] += 1
    together = sum(n * (n - 1) for c in of.values() for n in c.values())
    links = sum(n * (n - 1) for n in collections.Counter(d for d, _ in rows).values())
    assert together >= 0.75 * links


def test_mixing_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    got = queries.queries()["op6_mixing"](spark, SF).select("doc_id", "copy", "n_copies").collect()
    want = con.sql(f"select doc_id, copy, n_copies from ({mixing.OP6_SQL})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def test_clashing_columns(spark, given):
    want = collections.Counter(given.select("doc_id", "copy", "n_copies", "n_lines").collect())
    mixed = mixing.mix_documents(spark, given)
    assert mixed.columns == given.columns and {(r.copy, r.n_copies) for r in mixed.collect()} == {("c", 99)}
    assert {r.copy for r in mixing.mix(spark, given).collect()} <= set(range(60))
    kept = line_dedup.keep_lines(spark, given)
    assert kept.columns == given.columns and not collections.Counter(kept.select("doc_id", "copy", "n_copies", "n_lines").collect()) - want
    assert sorted(line_dedup.dedup_lines(spark, given).columns) == sorted([*given.columns, "n_exact", "n_near"])


def test_mixing_of_hard_rows(spark, given):
    out = mixing.mix(spark, given, weights={"s": 1.0, "none": 2.0})
    assert {r.source for r in out.select("source").distinct().collect()} <= {"s"} and out.count() > 0
    assert mixing.mix(spark, given.limit(0)).count() == 0


def components(rows, n, percent=80):
    sets = []
    for _, t, _ in rows:
        w = t.encode().lower().split()
        sets.append(set(zip(*[w[k:] for k in range(n)], strict=False)) if len(w) >= n else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for k in range(i):
            c = len(a & sets[k])
            if a and sets[k] and 100 * c >= percent * (len(a) + len(sets[k]) - c):
                up[top(i)] = top(k)
    ids = collections.defaultdict(list)
    for i, r in enumerate(rows):
        ids[top(i)].append(r[0])
    return sets, [min((x for x in ids[top(i)] if x is not None), default=None) for i in range(len(rows))]


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates(spark, given, rows, n):
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(spark, given, words=n).collect())
    sets, least = components(rows, n)
    assert got == collections.Counter((d, len(s), c if s else d) for (d, _, _), s, c in zip(rows, sets, least, strict=True))


def test_near_copies_of_one_page(spark):
    dice = np.random.default_rng(3)
    base = [f"t{k}" for k in range(160)]
    rows = []
    for k in range(150):
        w = list(base)
        for at in dice.integers(0, 160, int(dice.integers(0, 12))):
            w[at] = f"x{k}y{at}"
        rows.append((k, " ".join(w), ""))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    _, least = components(rows, 4)
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(spark, docs, words=4).collect()}
    assert got == {r[0]: c for r, c in zip(rows, least, strict=True)}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return a == b
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def test_line_dedup(spark, given, rows):
    got = {(r.doc_id, r.n_exact, r.n_near, r.text or "") for r in line_dedup.dedup_lines(spark, given).collect()}
    seen, want = {}, set()
    for d, t in sorted({(d, t) for d, t, _ in rows}, key=lambda r: (r[0] is None, r[0])):
        kept, exact, near = [], 0, 0
        for line in t.split("\n"):
            n = line.strip(" \t\x0b\x0c\r").lower()
            if not n:
                kept.append(line)
            elif n in seen:
                exact += 1
            else:
                seen[n] = len(n) >= 8 and any(len(x) >= 8 and one_edit(n, x) for x in seen)
                near += seen[n]
                if not seen[n]:
                    kept.append(line)
        want.add((d, exact, near, "\n".join(kept)))
    assert got == want


@pytest.mark.parametrize("name", ["op1_quality_rules", "op7_minhash_dedup", "op8_line_dedup"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    got, want = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=repr)


def test_main_text():
    page = (
        "<html><head><title>No</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><a>Menu</a></nav><div class='ad'>Buy</div>"
        "<article><header><h1>Head &amp; tail</h1></header><p>One <b>two</b>three<p>Fo&uuml;r\n five<ul><li>six<li>seven</ul><div class='comments'>Nice!</div></article>"
        "<aside>Side</aside><form>Mail</form><footer>&copy; us</footer></body></html>"
    )
    assert html_text.main_text(page) == "Head & tail One twothree Foür five six seven"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    plain = "<body><div id=menu>a b c</div><div><p>" + "Long text here. " * 20 + "</p><p>Short.</p></div><div class=sidebar>more</div></body>"
    assert html_text.main_text(plain).endswith("here. Short.") and "more" not in html_text.main_text(plain)


def test_main_text_in_marked_elements():
    prose = [f"Sentence {k} of a longer text that goes on for a while. " * 4 for k in range(4)]
    body = "".join(f"<p>{x}</p>" for x in prose)
    want = " ".join(x.strip() for x in prose)
    for around in ("<div class='content-with-sidebar'>{}</div>", "<div id='share-page'><article>{}</article></div>", "<form>{}</form>", "<div class='search-results'><div>{}</div></div>"):
        page = f"<body><nav><a>Menu</a></nav>{around.format(body)}<div class='sidebar'>More</div></body>"
        assert html_text.main_text(page) == want, around
    two = f"<body><article>{body}</article><div class='ad'>Buy</div><article><p>{prose[0]}</p></article></body>"
    assert html_text.main_text(two) == f"{want} {prose[0].strip()}"
    links = "".join(f"<li><a href='/{k}'>Link {k}</a></li>" for k in range(12))
    assert html_text.main_text(f"<body><div>{body}<ul>{links}</ul></div></body>").count("Link") <= 4


STORY = "".join(f"<p>Sentence {k} of the story goes on for quite a while, as one would expect of it.</p>" for k in range(8))
TOLD = " ".join(f"Sentence {k} of the story goes on for quite a while, as one would expect of it." for k in range(8))
WORDS = "".join(f"<span>word{k}</span><br>" for k in range(40))
LAYOUTS = [
    f"<body><div id=top>{WORDS}</div><div class=story>{STORY}</div></body>",
    f"<body><div class=story><h2>Head</h2>{STORY}</div><div>{WORDS}</div></body>",
    f"<body><header><h1>Site</h1></header><main>{STORY}</main><footer>Foot</footer></body>",
    f"<body><main><article>{STORY}</article><aside>More</aside></main></body>",
    f"<body><article class=comment>Nice!</article><div id=body>{STORY}</div></body>",
    f"<body><aside><article>Teaser</article></aside><div>{STORY}</div></body>",
    f"<body><div><article><a href=x>One teaser</a></article></div><div class=text>{STORY}</div></body>",
    f"<body><div class=page-header><h1>Head</h1></div><article>{STORY}</article></body>",
    f"<body><article><div class=entry-header><h1>Head</h1></div>{STORY}</article></body>",
    f"<body><article>{STORY}<section class=comments><p>A comment that is long enough to look like text.</p></section></article></body>",
    f"<body><div class='cookie-notice'>We use cookies on this site, as all others do.</div><div>{STORY}</div></body>",
    f"<body><table><tr><td><ul><li><a href=a>A</a><li><a href=b>B</a></ul></td><td>{STORY}</td></tr></table></body>",
    f"<body><div><nav><p>Go to the next page of this site if you please.</p></nav>{STORY}</div></body>",
    f"<body><form><p>Your address, please</p><input></form><div>{STORY}</div></body>",
    f"<body><div>{STORY}</div><div hidden><p>A hidden sentence that nobody is going to read.</p></div></body>",
    f"<body><div role=navigation><p>Some text about the ways to go from here.</p></div><section>{STORY}</section></body>",
    f"<body><noscript>Please switch scripts on.</noscript>{STORY}</body>",
    f"<body><div><div><div>{STORY}</div></div></div><div id=sidebar><p>A few words about the author of the text.</p></div></body>",
    f"<body><article>{STORY}</article><article class=ad><p>Buy this, it is much better than that.</p></article></body>",
    f"<body><div>{STORY}<dl><dt>Term<dd>What it means</dl></div></body>",
]
HEADS = {1: "Head ", 8: "Head "}
TAILS = {19: " Term What it means"}


@pytest.mark.parametrize("k", range(len(LAYOUTS)))
def test_main_text_of_layouts(k):
    assert html_text.main_text(LAYOUTS[k]) == HEADS.get(k, "") + TOLD + TAILS.get(k, "")


def test_threshold_decides_regions():
    for k in (0, 1):
        assert "word7" in html_text.main_text(LAYOUTS[k], deviations=-1e9) and "word7" not in html_text.main_text(LAYOUTS[k])


def test_deep_and_long_pages_take_linear_time():
    for page in ("<div>x y z" * 100_000, "<div class=ad>x y " * 60_000, "<b>" * 60_000 + "<hr>x" * 60_000, "<div><article>" + "<b>x" * 60_000 + "</div>" * 60_000):
        began = time.process_time()
        html_text.main_text(page)
        assert time.process_time() - began < 10


def test_pages_with_hard_ids(spark):
    rows = [(2**53 + 1, "u", "<p>a</p>", 1, "t"), (None, None, None, 2, "t"), (2**53 + 1, "u", "<p>a</p>", 3, "t"), (7, "v", "", 4, "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long, text string")
    got = sorted(map(tuple, html_text.extract_text(pages).collect()), key=str)
    assert got == sorted([(2**53 + 1, "u", "a", 1)] * 2 + [(None, None, "", 0), (7, "v", "", 0)], key=str)


def test_packing_round_trip(spark, given, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    tok.encode_special_tokens = True
    got = packing.pack(spark, given, with_ids=True).collect()
    full = collections.Counter(tuple([*tok.encode(t, add_special_tokens=False).ids, 2]) for _, t, _ in rows)
    bins = collections.defaultdict(list)
    for r in got:
        assert len(r.ids) == r.length <= 1024 and (r.piece == 0 or r.length == 1024)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        ends = np.cumsum([0] + [n for _, n in sorted(parts)])
        assert [at for at, _ in sorted(parts)] == list(ends[:-1]) and ends[-1] <= 1024
    heads = collections.Counter(tuple(r.ids) for r in got if r.piece == 0)
    assert heads == collections.Counter(x for ids, n in full.items() for x in [ids[: len(ids) % 1024 or 1024]] * n)
    assert sum(r.length for r in got) == sum(len(x) * n for x, n in full.items())
    assert len(bins) <= 1.02 * sum(len(x) * n for x, n in full.items()) / 1024 + 1


def test_every_row_has_a_result(spark):
    docs, pages = (spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("documents", "pages"))
    for name, f in queries.queries().items():
        if name.split("_")[0] in ("op1", "op2", "op4", "op5", "op7", "op8"):
            assert f(spark, SF).count() == docs, name
    assert html_text.op9_query(spark, SF).count() == pages


def test_empty_tables(spark, given):
    none = given.limit(0)
    for f in (quality_rules.quality_rules, license_scan.scan, sharding.shard, minhash_dedup.near_duplicates, line_dedup.dedup_lines, packing.pack):
        assert f(spark, none).count() == 0, f
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_counts_follow_the_folder(spark):
    """Calls in one session see the folder that they are given."""
    for sf in (SF, "/root/testdata/sf0.01", SF):
        docs, pages = (spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("documents", "pages"))
        assert html_text.op9_query(spark, sf).count() == pages
        assert sharding.op5_query(spark, sf).count() == docs


def repeats(words_):
    grams = list(zip(words_, words_[1:], words_[2:], strict=False))
    n = collections.Counter(grams)
    return len({i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)})


def cleaned(rows):
    """Texts without repeated lines, in the order of ids."""
    seen, out = {}, []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        kept = []
        for line in t.split("\n"):
            n = line.strip(" \t\x0b\x0c\r").lower()
            if n and n in seen:
                continue
            if n:
                seen[n] = len(n) >= 8 and any(len(x) >= 8 and one_edit(n, x) for x in seen)
            if not n or not seen[n]:
                kept.append(line)
        text = "\n".join(kept)
        if text == t or words(text):
            out.append((d, text))
    return out


def copies(rows):
    """Number of copies of each (doc_id, source) by inverting a Poisson distribution at a hash."""
    sizes = collections.Counter(r[1] for r in rows)
    whole = sum(n**0.5 for n in sizes.values())
    out = collections.Counter()
    for d, source in rows:
        rate = sizes[source] ** 0.5 / whole * len(rows) / sizes[source]
        u = int(hashlib.md5(f"mix-1:{'null' if d is None else d}".encode()).hexdigest()[:13], 16) / 2**52
        k, log, total = 0, -rate, math.exp(-rate)
        while total <= u:
            k += 1
            log += math.log(rate) - math.log(k)
            total += math.exp(log)
        out[d] += k
    return +out


def test_pipeline_of_hard_rows(spark, given):
    """Every stage against a plain version, on what its predecessor kept."""
    docs, names = given, [name for name, _ in corpus_pipeline.STAGES]
    long = [(2000 + k, f"{'shared words of a page ' * 9}{k}\n" + " ".join(f"own{k}q{j}" for j in range(60)), "en", "s", 1, *EXTRA) for k in range(3)]
    docs = docs.unionByName(spark.createDataFrame([*long, long[0]], SCHEMA))
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        if name == names[0]:
            want = [(d, t) for d, t, _ in before if t and len(words(t)) >= 50 and 100 * repeats(words(t)) <= 50 * len(words(t))]
        elif name == names[1]:
            want = cleaned({(d, t) for d, t, _ in before})
            want = [x for x in want for _ in range(sum(d == x[0] for d, _, _ in before))]
        elif name == names[2]:
            sets, least = components([(d, t or "", "") for d, t, _ in before], 5)
            want = [(d, t) for (d, t, _), s, c in zip(before, sets, least, strict=True) if not s or c == d]
        elif name == names[3]:
            n = copies([(d, x) for d, _, x in before])
            assert collections.Counter(r.doc_id for r in rows) == n
            continue
        else:
            ids = collections.Counter(r.doc_id for r in rows if r.piece == 0)
            assert ids == collections.Counter(d for d, _, _ in before)
            continue
        assert collections.Counter((r.doc_id, r.text) for r in rows) == collections.Counter(want), name


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns and after.count() <= docs.count()
        docs = spark.createDataFrame(after.collect(), after.schema)
    left = [(r.doc_id, r.text or "", "") for r in docs.collect()]
    assert all(c == r[0] for r, c in zip(left, components(left, 5)[1], strict=True) if r[1])
    out = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} <= {r[0] for r in left}
