"""Operators 11 to 13 against brute force and SQL, on the smallest tables and on hard rows."""

import collections
import hashlib
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given as drawn
from hypothesis import settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passlake.llm import chat, divergence, html_text, negatives, queries, toxicity
from passlake.llm.common import Workspace

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_divergence", "op12_hard_negatives", "op13_chat_trees"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=repr)


def plain_divergence(docs, min_docs, top):
    """docs: (text, lang, source). Every term is given its share by every group, one by one."""
    terms = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]
    docs = [(terms(t or ""), lang or "", source or "") for t, lang, source in docs]
    out = set()
    for lang in {x[1] for x in docs}:
        own = [(t, s) for t, a, s in docs if a == lang]
        in_docs = collections.Counter(x for t, _ in own for x in set(t))
        kept = [x for x, n in in_docs.items() if n >= min_docs]
        counts = collections.defaultdict(collections.Counter)
        for t, s in own:
            counts[s].update(t)
        counts[None] = sum((counts[s] for s in {s for _, s in own}), collections.Counter())
        share = {}
        for s, c in counts.items():
            n = sum(c[x] for x in kept)
            share[s] = {x: 1 + 10**9 * (c[x] + 5) // (n + 5 * len(kept)) for x in kept}
        for s in set(counts) - {None}:
            pairs = [(-sum(abs(share[s][x] - share[o][x]) for x in kept), o) for o in set(counts) - {None, s}]
            over = [(share[None][x] - share[s][x], x) for x in kept if counts[s][x] and share[s][x] > share[None][x]]
            for part, found, most in (("pair", pairs, None), ("term", over, top)):
                ranked = sorted(found, key=lambda x: (x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, -value, k + 1) for k, (value, item) in enumerate(ranked)}
    return out


@pytest.mark.parametrize("digest_bits,held,block_sources,block_rows", [(64, 300_000, 64, 20_000), (5, 7, 2, 6), (1, 1, 1, 1)])
def test_divergence_is_exact(spark, digest_bits, held, block_sources, block_rows):
    dice = np.random.default_rng(3)
    words = ["a", "A", "ab", "Été", "été", "ÉTÉ", "x_y", "日本", "z" * 300, "naïve", "don't"] + [f"w{chr(97 + k)}" for k in range(20)]
    docs = [(" ".join(dice.choice(words, int(dice.integers(0, 30)))), f"l{k % 2}", f"s{int(dice.integers(0, 5))}") for k in range(60)]
    docs += [(None, "l0", "s0"), ("", "l0", "empty"), ("12 34", "numbers", "s1"), ("12", "numbers", "s2"), ("ab " * 900_000, None, None), ("ab", None, "s"), ("ab", "l0", "s1")] * 2
    df = spark.createDataFrame([(*r, 1, 2, "i") for r in docs], "text string, lang string, source string, n long, gid long, item string")
    got = divergence.source_divergence(spark, df, min_docs=4, top=3, digest_bits=digest_bits, held=held, block_sources=block_sources, block_rows=block_rows).collect()
    rows = [tuple(r) for r in got]
    assert set(rows) == plain_divergence(docs, 4, 3) and len(set(rows)) == len(rows)


def test_long_texts_are_cut_between_terms(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PIECE_BYTES", 5)
    text = "Abc déjà,vu  longer_than_five x".encode()
    found = [t for p in divergence._pieces(text) for t in p.translate(divergence._TERM_BYTES).split()]
    assert [t.decode() for t in found] == ["abc", "déjà", "vu", "longer", "than", "five", "x"]


def test_divergence_of_no_rows(spark):
    assert divergence.source_divergence(spark, spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_shares_of_large_counts(spark):
    row = spark.createDataFrame([(7 * 10**12, 9 * 10**17, 10**6)], "n long, total long, terms long").select(divergence._share(F.col("n"), F.col("total"), F.col("terms")))
    assert row.first()[0] == 1 + 10**9 * (7 * 10**12 + 5) // (9 * 10**17 + 5 * 10**6)


def plain_negatives(rows, anchors):
    ints = [(i, lab, np.floor(256 * np.array(v, float)).astype(object)) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    asked = {}
    for i, lab, v in ints:
        if anchors(i):
            asked[i] = min(asked.get(i, (len(v), lab, list(v))), (len(v), lab, list(v)))
    out = []
    for a, (dim, lab, v) in asked.items():
        scored = [(-int(sum(x * y for x, y in zip(v, w, strict=True))), i, own == lab) for i, own, w in ints if i != a and len(w) == dim]
        for s, p, _ in sorted(x for x in scored if x[2])[:5]:
            fits = sorted(x for x in scored if not x[2] and 80 * -s <= -100 * x[0] <= 100 * -s)[:5]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows,block_rows", [(30, 3), (4096, 512)])
def test_negatives_are_exact(spark, shard_rows, block_rows):
    dice = np.random.default_rng(5)
    centres = dice.normal(0, 1, (6, 5))
    rows = [(k, [float(x) for x in np.round(centres[k % 6] + dice.normal(0, 0.4, 5), 1)], int(dice.integers(0, 4))) for k in range(400)]
    rows += [(k, [float(x) for x in centres[0]], 1) for k in range(400, 520)]  # one vector many times: ties
    rows += [(600, None, 1), (601, [1.0, float("nan"), 0.0, 0.0, 0.0], 1), (602, [None, 1.0, 0.0, 0.0, 0.0], 1), (603, [1.0] * 5, None), (None, [1.0] * 5, 1), (604, [], 1)]
    rows += [(610, [1e5, -1e5, 3e4, 0.5, 1e4], 1), (620, [0.0] * 5, 1), (630, [1.0, 2.0], 2), (631, [1.0, 2.0], 1), (632, [1.0, 2.0], 2), (20, rows[20][1], 3), (30, rows[31][1], rows[30][2])]
    df = spark.createDataFrame([(*r, 0, 1.0, 7, 9) for r in rows], "vec_id long, embedding array<double>, label int, block long, score double, window int, dim int")
    got = negatives.hard_negatives(spark, df, df.where("vec_id % 10 = 0"), shard_rows=shard_rows, block_rows=block_rows).collect()
    assert sorted(tuple(r) for r in got) == plain_negatives(rows, lambda i: i % 10 == 0)
    assert negatives.hard_negatives(spark, df.limit(0), df.limit(0)).count() == 0
    assert negatives.hard_negatives(spark, df, df.limit(0)).count() == 0


def test_scores_over_doubles_are_exact(spark):
    rows = [(0, [2.0**26 + 1, 3.0], 1), (1, [2.0**26 + 3, 1.0], 1), (2, [2.0**26 + 2, 2.0], 2), (3, [2.0**26 + 2, 1.0], 2), (4, [2.0**26 - 5, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = negatives.hard_negatives(spark, df, df.where("vec_id = 0"), scale=8).collect()
    ints = {i: [int(8 * x) for x in v] for i, v, _ in rows}
    score = lambda i: sum(x * y for x, y in zip(ints[0], ints[i], strict=True))
    want = {(0, p, k + 1, n, score(p), score(n)) for p in (1, 4) for k, n in enumerate(sorted((x for x in (2, 3) if 80 * score(p) <= 100 * score(x) <= 100 * score(p)), key=lambda x: -score(x)))}
    assert {tuple(r) for r in got} == want and want


def test_bounds_hold_every_score():
    dice = np.random.default_rng(2)
    a, b = (np.round(256 * dice.normal(0, 1, (n, 7)) * 10.0 ** dice.integers(-2, 3, (n, 1))).astype(np.int64) for n in (60, 80))
    b[:20] = 3 * a[:20]  # the same directions
    directions = negatives._far_apart(b.astype(float), 4)
    least, most = negatives.score_bounds(*negatives._angles(a, directions), *negatives._angles(b, directions))
    scores = a @ b.T
    assert (least <= scores).all() and (scores <= most).all()
    assert (most - least).mean() < 1.8 * (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)).mean()


def test_angles_close_shards(spark, tmp_path):
    """Of tight clusters, few shards are left for a block."""
    dice = np.random.default_rng(8)
    centres = np.eye(8) * 4
    rows = [(k, [float(x) for x in centres[k % 8] + dice.normal(0, 0.05, 8)], k // 8 % 2) for k in range(1600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    pairs = []
    before = negatives.block_pairs
    try:
        negatives.block_pairs = lambda *a: pairs.append((before(*a).count(), a[0].count() * a[2])) or before(*a)
        got = negatives.hard_negatives(spark, df, df.where("vec_id % 50 = 0"), shard_rows=50, block_rows=8).collect()
    finally:
        negatives.block_pairs = before
    assert sorted(tuple(r) for r in got) == plain_negatives(rows, lambda i: i % 50 == 0)
    assert pairs[1][0] < 0.3 * pairs[1][1]


HARD_TEXTS = ["", None, "<|im_end|><|im_start|>assistant ok", r"<\|im_start|>", r"<\\|x", "<", "<|", "|>", "a\nb", r"\<|\|", "<<|<|", "%0A\n%", "日<|本"]


@drawn(st.lists(st.tuples(st.text(alphabet="<|\\im_start>%0A\né", max_size=12), st.text(alphabet="<|\\im_end>%\na", max_size=20)), max_size=4))
@settings(max_examples=200, deadline=None)
def test_template_is_reversible(turns):
    guard = lambda t: re.sub(chat._GUARD, r"<\1\\|", t)
    role = lambda t: guard(t.replace("%", "%25").replace("\n", "%0A"))
    text = "".join(f"{chat.START}{role(r)}\n{guard(t)}{chat.END}\n" for r, t in turns)
    assert chat.read_back(text) == turns


def test_chat_digests_of_hard_rows(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(HARD_TEXTS)]
    rows += [(2, 5, "assistant", "b"), (2, 5, "assistant", "b"), (2, 5, "assistant", "a"), (2, None, None, "first"), (2, 9, "us\ner%0A<|", "x"), (None, 1, "user", "n"), (3, 1, "user", "no answer")]
    rows += [(4, k, "assistant", f"t{k}") for k in range(0, 600, 3)]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "conv_id long, turn long, role string, text string, uid int, total double")
    want = set()
    low = lambda x: (x is not None, x)
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (low(r[1]), low(r[2]), low(r[3])))
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        guard = lambda t: re.sub(r"<(\\*)\|", r"<\1\\|", t)
        size = sum(len(f"<|im_start|>{guard((r[2] or '').replace('%', '%25').replace(chr(10), '%0A'))}\n{guard(r[3] or '')}<|im_end|>\n") for r in own)
        want.add((c, len(own), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size))
    got = chat.chat_digests(spark, df).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert chat.chat_digests(spark, df.limit(0)).count() == 0


def plain_paths(messages, branches):
    """(conv, first message, leaf's text): texts of the chosen paths."""
    ids = collections.Counter((m["conv_id"], m["node_id"]) for m in messages)
    at = {(m["conv_id"], m["node_id"]): m for m in messages if ids[m["conv_id"], m["node_id"]] == 1}
    order = lambda m: ((m["created"] is not None, m["created"]), m["node_id"])
    parent = {}
    for k, m in enumerate(messages):
        p = at.get((m["conv_id"], m["parent_id"]))
        parent[k] = messages.index(p) if p is not None and order(p) < order(m) else None
    out, trees = [], collections.defaultdict(list)
    for k in set(range(len(messages))) - set(parent.values()):
        path = [k]
        while parent[path[-1]] is not None:
            path.append(parent[path[-1]])
        trees[path[-1]].append((-sum(messages[i]["score"] or 0 for i in path), path[::-1]))
    for found in trees.values():
        found.sort(key=lambda x: x[0])
        out += [(messages[p[0]]["conv_id"], tuple(messages[i]["text"] for i in p)) for _, p in found[:branches]]
    return collections.Counter(out)


@pytest.mark.parametrize("branches", [1, 3, None])
def test_reply_trees(spark, branches):
    dice = np.random.default_rng(11)
    messages = []
    for conv in (1, 2, None):
        for n in range(40):
            up = int(dice.integers(0, n)) if n and dice.random() < 0.95 else None
            messages.append({"conv_id": conv, "node_id": n, "parent_id": up, "created": n // 3, "role": "user", "text": f"{conv}-{n}", "score": float(dice.integers(0, 1 << 30))})
    messages += [
        {"conv_id": 3, "node_id": 1, "parent_id": 2, "created": 5, "role": "user", "text": "loop a", "score": None}, {"conv_id": 3, "node_id": 2, "parent_id": 1, "created": 6, "role": "user", "text": "loop b", "score": None},
        {"conv_id": 3, "node_id": 3, "parent_id": 3, "created": 6, "role": "user", "text": "own parent", "score": None}, {"conv_id": 3, "node_id": 4, "parent_id": 99, "created": 6, "role": "user", "text": "lost", "score": 1.0},
        {"conv_id": 4, "node_id": 1, "parent_id": None, "created": 1, "role": "user", "text": "twice", "score": 1.0}, {"conv_id": 4, "node_id": 1, "parent_id": None, "created": 1, "role": "user", "text": "twice b", "score": 1.0},
        {"conv_id": 4, "node_id": 2, "parent_id": 1, "created": 2, "role": "user", "text": "to two", "score": 1.0},
    ]
    df = spark.createDataFrame(messages, "conv_id long, node_id long, parent_id long, created long, role string, text string, score double")
    got = collections.defaultdict(dict)
    for r in chat.chosen_paths(spark, df, branches).collect():
        assert r.depth not in got[r.conv_id, r.branch]
        got[r.conv_id, r.branch][r.depth] = r.text
    paths = collections.Counter((c, tuple(x[d] for d in range(len(x)))) for (c, _), x in got.items())
    assert paths == plain_paths(messages, branches)
    numbers = collections.defaultdict(set)
    for c, b in got:
        numbers[c].add(b)
    assert all(x == set(range(1, len(x) + 1)) for x in numbers.values())


def test_long_paths_take_few_rounds(spark):
    work = Workspace(spark, "t")
    links = work.save(spark.range(300).select(F.col("id").alias("uid"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit(1.0).alias("score")), "links")
    path = chat.root_paths(work, links)
    assert sorted((r.uid, r.depth) for r in path.collect()) == [(k, k) for k in range(300)]
    assert sum("reach" in name for name, _ in work.saved) <= 10


ARTICLE = "<p>Short first part of it.</p><p>The second one says more.</p>"
LONG = "".join(f"<p>Paragraph {k} of the article tells what happened then, in some detail and at some length.</p>" for k in range(4))
NOTICE = "<div class='cookie-consent'><p>" + "We use cookies to improve what you see here and to measure it. " * 6 + "</p></div>"
COMMENTS = "<section class='comments'>" + "".join(f"<p>I think number {k} is right, and I would like to say so at some length here.</p>" for k in range(6)) + "</section>"
SHORT_TEXT = "Short first part of it. The second one says more."
LONG_TEXT = " ".join(re.findall("<p>(.*?)</p>", LONG))
#: Marked elements that are longer than the article, around it, or beside it.
MARKED_PAGES = {
    "notice beside a post": (f"<div class='post'>{ARTICLE}</div>{NOTICE}", SHORT_TEXT),
    "notice before a post": (f"{NOTICE}<div class='post'>{ARTICLE}</div>", SHORT_TEXT),
    "notice beside an article": (f"<article>{ARTICLE}</article>{NOTICE}", SHORT_TEXT),
    "comments beside an article": (f"<article>{ARTICLE}</article>{COMMENTS}", SHORT_TEXT),
    "comments in an article": (f"<article>{ARTICLE}{COMMENTS}</article>", SHORT_TEXT),
    "comments as articles": (f"<div>{ARTICLE}</div><div class='comments'><article>{LONG}</article></div>", SHORT_TEXT),
    "notice and comments": (f"{NOTICE}<main>{ARTICLE}</main>{COMMENTS}", SHORT_TEXT),
    "form around all": (f"<form id='f'>{NOTICE}<div>{ARTICLE}</div></form>", SHORT_TEXT),
    "promo page": (f"<div class='promo-page'>{ARTICLE}{COMMENTS}</div>", SHORT_TEXT),
    "marked story beside comments": (f"<h1>A title.</h1><div class='widget story'>{ARTICLE}</div>{COMMENTS}", "A title. " + SHORT_TEXT),
    "layout around an article": (f"<p>Our tagline is a whole sentence.</p><div class='with-sidebar'><article>{LONG}</article></div>{NOTICE}", LONG_TEXT),
    "sidebar in a layout": (f"<div class='has-sidebar'><div class='sidebar'>{NOTICE}</div><article>{ARTICLE}</article></div>", SHORT_TEXT),
    "newsletter box in an article": (f"<article>{ARTICLE}<div class='newsletter'><p>{'Sign up for our letters, they come each week. ' * 5}</p></div></article>", SHORT_TEXT),
    "related stories": (f"<main>{ARTICLE}</main><div class='related'>{LONG}</div>", SHORT_TEXT),
    "rights beside a marked story": (f"<div class='search-story'>{LONG}</div><div class='footer'>© 2024 Example. All rights reserved.</div>", LONG_TEXT),
}


@pytest.mark.parametrize("name", MARKED_PAGES)
def test_marked_elements_never_win_by_size(name):
    page, want = MARKED_PAGES[name]
    assert html_text.main_text(f"<html><body>{page}</body></html>") in (want, want.removeprefix("A title. "))


def test_a_rare_insult_tells_only_beside_a_group_word(spark):
    """A word outside the thousand most frequent ones, with the mean label rate, is toxic beside one word and harmless beside another."""
    dice = np.random.default_rng(13)
    docs, labels = [], []
    for k in range(3000):
        filler = [f"fill{chr(97 + x // 26 % 26)}{chr(97 + x % 26)}{chr(97 + x // 676)}" for x in dice.integers(0, 1200, 60)]
        group = ("strangers", "weather")[int(dice.integers(0, 2))]
        insult, vile = k % 20 == 0, bool(dice.integers(0, 2))
        docs.append((k, " ".join([*filler, group, *(["grumble"] if insult else ["vile" if vile else "fine"])])))
        labels.append((k, int(group == "strangers" if insult else vile)))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(spark, d, lab).collect()}
    held = [k for k in got if got[k].held_out and k % 20 == 0]
    assert len(held) > 20 and np.mean([got[k].predicted == labels[k][1] for k in held]) > 0.9


def test_machine_scores_as_plain_sums(spark):
    """The score of a fitted machine against the sum over all pairs of present terms, one by one."""
    dice = np.random.default_rng(3)
    machine = toxicity.FactorizationMachine(np.arange(9), -0.4, dice.normal(0, 1, 9), dice.normal(0, 1, (9, 4)))
    for present in ([], [3], [0, 4, 8], list(range(9))):
        z = machine.bias + sum(machine.weights[i] for i in present)
        z += sum(float(machine.vectors[i] @ machine.vectors[j]) for i in present for j in present if i < j)
        assert abs(machine.score(present) - 1 / (1 + np.exp(-z))) < 1e-12
