"""Operators 11 to 13: toxicity, source divergence, spelling variants."""

import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations, pairwise

import numpy as np
import pytest
import regex
from hydrospark.llm import divergence, spelling, toxicity
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, term string, word string, n long, score string, `a.b` string"
SMALL = toxicity.Settings(positives=64, unlabelled=400, rounds=200)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, "own", "own", 7, "own", "dot") for i, t, lang, source in rows], SCHEMA)


def corpus():
    r = random.Random(11)
    word = lambda: "".join(r.choice(["ab", "be", "ce", "dé", "É", "st", "Ou"]) for _ in range(r.randint(2, 4)))
    pool = [word() for _ in range(120)]
    out = [(i, " ".join(r.choice(pool) for _ in range(r.randint(0, 120))), r.choice(["en", "fr", None]), r.choice(["a", "b", "é", None])) for i in range(90)]
    out += [(None, "abbe Abbe ABBE abbé naïve", "en", "a"), (3, None, None, None), (4, "", "zz", "only"), (5, "x y", "zz", "other"), (6, "1 2 3", "", ""), (7, "aaaaa " * 3000 + "aaaab aaaac " * 4 + "日本語", "en", "b")]
    return out + out[:4]


# ---- 12


def plain_terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return regex.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute_divergence(rows, top=200):
    docs = [(lang or "", source or "", plain_terms(t)) for _, t, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        df, all_ = Counter(), Counter()
        for x, _, w in docs:
            if x == lang:
                df.update(set(w))
                all_.update(w)
        kept = [t for t in df if df[t] >= 3]
        count = {s: Counter() for x, s, _ in docs if x == lang}
        for x, s, w in docs:
            if x == lang:
                count[s].update(t for t in w if df[t] >= 3)
        p_of = lambda c, total, v=len(kept): 1 + 10**9 * (c + 1) // (total + v)
        p = {s: {t: p_of(c[t], c.total()) for t in kept} for s, c in count.items()}
        whole = sum(all_[t] for t in kept)
        q = {t: p_of(all_[t], whole) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in count:
            pair = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in count if o != s)
            term = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if count[s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pair), ("term", term)):
                out |= {(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(found, 1)}
    return out


def test_divergence(spark):
    rows = corpus()
    for top in (200, 3):
        got = [tuple(x) for x in divergence.divergence(frame(spark, rows), top=top, block_terms=7).select("lang", "source", "part", "item", "value", "rank").collect()]
        assert len(got) == len(set(got)) and set(got) == brute_divergence(rows, top)
    assert {x[0] for x in got} >= {"", "zz"}  # groups without terms are ranked, too
    by_shuffle = divergence.divergence(frame(spark, rows), top=3, broadcast_rows=0).collect()
    assert {(x.lang, x.source, x.part, x.item, x.value, x["rank"]) for x in by_shuffle} == set(got)


def test_divergence_of_nothing(spark):
    assert divergence.divergence(frame(spark, [])).count() == 0


def test_shares_stay_exact_beyond_64_bits(spark):
    big = 10**13
    got = spark.range(1).select(divergence._share(F.lit(big), F.lit(7 * big), F.lit(3)).alias("p")).first().p
    assert got == 1 + 10**9 * (big + 1) // (7 * big + 3) == divergence._shares(np.array([big]), 7 * big, 3)[0]


# ---- 13


def brute_words(rows, least=5):
    count = Counter()
    for i, t, *_ in rows:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w
            count[w] += len(w) >= least
    return {w: n for w, n in count.items() if n >= 3}


def one_apart(a, b):
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n):
    near = defaultdict(list)
    for a, b in combinations(n, 2):
        if one_apart(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: f if f and n[f] >= 2 * n[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def variants(spark, rows):
    got = [tuple(x) for x in spelling.spelling_variants(frame(spark, rows)).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_spelling(spark):
    rows = corpus()
    n = brute_words(rows)
    assert len(n) > 50 and variants(spark, rows) == brute_variants(n)


def test_spelling_of_repeated_grams_chains_and_short_words(spark):
    r = random.Random(2)
    words = {"".join(r.choice("ab") for _ in range(r.randint(5, 9))) for _ in range(150)} | {"a" * k for k in range(5, 12)} | {"ab" * k for k in range(3, 6)} | {"÷" * 5, "×éèÿÀ"}
    chain = ["chain" + "x" * k for k in range(9)]
    rows = [(k, f"{w} " * (3 + k % 40), None, None) for k, w in enumerate(sorted(words))] + [(1000 + k, f"{w} " * (3 * 2**k), None, None) for k, w in enumerate(chain)]
    got = variants(spark, rows)
    assert got == brute_variants(brute_words(rows))
    assert max(n for *_, n, _, _ in got) == 3 * 2**8 and {root for w, _, root, *_ in got if w.startswith("chain")} == {chain[-1]}


def test_spelling_of_nothing(spark):
    assert variants(spark, []) == set() and variants(spark, [(1, None, None, None), (2, "", None, None)]) == set()
    with pytest.raises(ValueError, match="at least 5"):
        spelling.spelling_variants(frame(spark, []), least=4)


def test_pivots_are_disjoint_and_rarest():
    r = random.Random(9)
    for _ in range(500):
        w = "".join(r.choice("abcd") for _ in range(r.randint(5, 12)))
        rank = {x + y: k for k, (x, y) in enumerate((x, y) for x in "dbca" for y in "abcd")}
        grams = sorted((rank[x + y], x + y, i) for i, (x, y) in enumerate(pairwise(w)))
        prefix = [g for k, g in enumerate(grams) if k < 3 or g[1] == grams[2][1]]
        a, b = spelling.pivots(prefix)
        cost = {g[2]: g[0] for g in prefix}
        assert b - a >= 2 and cost[a] + cost[b] == min(x[0] + y[0] for x, y in combinations(prefix, 2) if abs(x[2] - y[2]) >= 2)


# ---- 11


def toxic_corpus(n=600):
    r = random.Random(4)
    pool = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        words = r.choices(pool, k=r.randint(20, 200)) + (r.choices(["vileness", "scornful", "stemmed" + r.choice("abcdef")], k=3) if toxic else [])
        r.shuffle(words)
        rows.append((i, " ".join(words), None, None))
        if i % 2 == 0:
            labels.append((i, int(toxic), "clash"))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_corpus()
    rows += [(None, None, None, None), (10**9, "", None, None), (10**9 + 1, "日本語 " * 5 + "x" * 50_000, None, None), rows[0]]
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int, score string")
    first = toxicity.toxicity(docs, marks, settings=SMALL)
    assert set(first.columns) == {*docs.columns, "held_out", "predicted"}
    got = [(r.doc_id, r.text, r.held_out, r["score"], r.predicted) for r in first.collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 and p == (s >= 0.7) for *_, s, p in got)
    assert all(h == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for i, _, h, *_ in got)
    aside = [(i % 6 == 0, p) for i, _, h, _, p in got if h and i < 600]
    caught = sum(p for t, p in aside if t) / sum(t for t, _ in aside)
    assert caught >= 0.9 and not any(p for t, p in aside if not t)
    assert not any(p for i, t, *_, p in got if not t)
    again = [(r.doc_id, r["score"]) for r in toxicity.toxicity(docs.repartition(7), marks, settings=SMALL).collect()]
    key = lambda x: (x[0] is None, x)
    assert sorted(again, key=key) == sorted([(i, s) for i, _, _, s, _ in got], key=key)


def test_labels_of_held_out_rows_and_zeros_do_not_teach(spark):
    rows, labels = toxic_corpus(300)
    aside = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 3 == 1]
    docs = frame(spark, rows)
    got = toxicity.toxicity(docs, spark.createDataFrame(aside, "doc_id long, toxic int, score string"), settings=SMALL)
    assert {r["score"] for r in got.collect()} == {SMALL.default_prior}  # nothing to learn from: the prior


def test_toxicity_without_rows_or_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(frame(spark, []), none).count() == 0
    assert {r.predicted for r in toxicity.toxicity(frame(spark, toxic_corpus(20)[0]), none).collect()} == {0}
    marks = spark.createDataFrame([(0, 1), (0, None), (None, 1), (0, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity(frame(spark, [(0, "bad words here", None, None), (2, None, None, None)]), marks).count() == 2


def test_risk_stays_non_negative():
    """With few positives and many words, plain unbiased risk drives the hidden positives down; the corrected one keeps most unseen positives apart."""
    r = np.random.default_rng(0)
    make = lambda n, toxic: np.hstack([r.random((n, 4)) < (0.6 if toxic else 0.02), r.random((n, 60)) < 0.1]).astype(np.float32)
    p, u, held_p, held_n = make(30, True), np.vstack([make(60, True), make(540, False)]), make(200, True), make(2000, False)
    w, b = toxicity.fit_nnpu(p, u, 0.1, toxicity.Settings())
    assert ((held_p @ w + b) > 0).mean() > 0.65 and ((held_n @ w + b) > 0).mean() < 0.05
    hidden = np.logaddexp(0, u @ w + b).mean() - 0.1 * np.logaddexp(0, p @ w + b).mean()
    assert hidden > -0.02
