"""Every operator on one table of nulls, empty and long texts, repeats and clashing names, against brute force; and on an empty table."""

import glob
import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from hydrospark.llm import chat_format, exact_dedup, fm_index, mixing, quality_rules, rans, sharding, shingle_dedup, simhash, token_counts, wfst
from hydrospark.llm.common import shared_dir

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, id string, `a.b` string"


def rows():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, near = prose(20), prose(300).split()
    texts = [None, "", "", " \n\t ", "one", "a b c d", shared, prose(60) + "\n" + shared, prose(70) + " " + shared + "\n" + prose(5), prose(6000), "x" * 40_000, "a\n" * 90, "😀  \x00 <|endoftext|> ▁"]
    texts += [" ".join(near)] * 3 + [" ".join([*near[:k], "changed", *near[k + 1 :]]) for k in (7, 150)] + [prose(r.randint(50, 90)) for _ in range(12)]
    out = [(i, t, "en", "abc"[i % 3], None, "own size", "own", "x", "dot") for i, t in enumerate(texts)]
    return [*out, (None, "null id " + prose(55), None, None, None, None, None, None, None), out[14], out[14], (5, "another text of id 5", "en", None, None, "s", "k", "i", "d")]


ROWS = rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(text):
    return (text or "").encode().split()


def test_sharding(docs, none):
    got = sharding.shard(docs, 4).select("doc_id", "text", "size", "shard", "slot", "kept").collect()
    assert len(got) == len(ROWS) and sharding.shard(none, 4).count() == 0
    sizes = {s: sum(r["size"] for r in got if r.shard == s) for s in range(4)}
    assert all(r["size"] == len((r.text or "").encode()) + 1 for r in got)
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard(docs.withColumn("c", F.crc32(F.coalesce("text", F.lit("")))), 4).filter("c < 0").count() == 0
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in got)


def test_quality_rules(docs, none):
    got = quality_rules.line_frequency(docs, max_docs=2).collect()
    assert len(got) == len(ROWS) and quality_rules.line_frequency(none).count() == 0
    both = docs.withColumn("text copy", F.col("text"))
    assert "text" not in quality_rules.line_frequency(docs, rewrite=False).columns
    for r in quality_rules.line_frequency(both, rewrite=False).withColumnRenamed("text copy", "text").collect():
        w, t = plain(r.text), r.text or ""
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        hit = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)} if len(w) < 1000 else None
        lines = [x for x in t.split("\n") if x.encode().split()]
        assert (r.n_words, r.word_chars, r.n_dup_lines) == (len(w), sum(len(x.decode()) for x in w), len(lines) - len(set(lines)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t)
        if hit is not None:
            assert r.n_repeat_words == len(hit) and r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))


def test_quality_rules_removes_frequent_lines(spark):
    r = random.Random(3)
    body = lambda: " ".join(f"w{r.randint(0, 10**9)}" for _ in range(60))
    data = [(i, f"{body()}\nShared  Line here", "h") for i in range(30)] + [(100, "Shared line here\n" + "shared line HERE\n" * 30, "h"), (101, f"{body()}\nshared line here", "other")]
    got = {x.doc_id: x for x in quality_rules.line_frequency(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert all(got[i].kept and "Shared" not in got[i].text for i in range(30)) and not got[100].kept
    assert got[101].kept and got[101].text.endswith("shared line here")


def test_quality_rules_counts_documents_that_share_a_passage(spark):
    """Each of 30 documents has 60 words of its own; of 300 shared words most hold the least hash of all windows."""
    r = random.Random(11)
    prose = lambda n: " ".join(f"w{r.randint(0, 10**9)}" for _ in range(n))
    for _ in range(3):
        passage = prose(300)
        data = [(i, f"{prose(60)}\n{passage}", "h") for i in range(30)]
        data += [(100 + i, "copied " + passage[:200] + "\n" + passage[200:700], "h") for i in range(30)]  # one text thirty times
        table = spark.createDataFrame(data, "doc_id long, text string, source string")
        got = {x.doc_id: x for x in quality_rules.line_frequency(table, min_kept_share=0.1, copies_once=True).collect()}
        assert all(got[i].n_frequent_lines == 1 and got[i].n_kept_words == 60 and got[i].kept for i in range(30))
        assert all(got[100 + i].n_frequent_lines == 0 and got[100 + i].kept for i in range(30))
        each = {x.doc_id: x for x in quality_rules.line_frequency(table, min_kept_share=0.1).collect()}
        assert all(each[100 + i].n_frequent_lines == 2 and not each[100 + i].kept for i in range(30))  # copies count each for itself


@pytest.mark.parametrize(("documents", "shared", "own"), [(40, 100, 60), (40, 200, 60), (60, 60, 60)])
def test_quality_rules_finds_boilerplate_on_every_host(spark, documents, shared, own):
    r = random.Random(documents + shared)
    prose = lambda n: " ".join(f"w{r.randint(0, 10**9)}" for _ in range(n))
    data = []
    for host in range(40):
        line = prose(shared)
        data += [(1000 * host + i, f"{prose(own)}\n{line}", f"h{host}") for i in range(documents)]
    got = quality_rules.line_frequency(spark.createDataFrame(data, "doc_id long, text string, source string"), copies_once=True, rewrite=False)
    assert got.filter(f"n_frequent_lines = 1 AND n_kept_words = {own}").select("source").distinct().count() == 40 and got.filter("n_frequent_lines <> 1").count() == 0


def test_repeated_windows(spark):
    """Texts with few and with many repeated windows, against brute force."""
    r = random.Random(2)
    texts = [" ".join(r.choice("abcdefghijkl"[:k]) for _ in range(n)) for k, n in ((12, 40), (12, 900), (3, 30), (12, 5000), (2, 400), (1, 5), (12, 2), (12, 3))]
    w = quality_rules.three_word_windows(F.split("t", " "))
    out = spark.createDataFrame([(x,) for x in texts], "t string").withColumn("g", w).withColumn("two", quality_rules.repeated(F.sort_array("g"))).select("t", quality_rules.repeat_words(F.col("g"), F.col("two")).alias("n"))
    for t, n in out.collect():
        words = t.split()
        grams = list(zip(words, words[1:], words[2:]))
        often = {g for g in grams if grams.count(g) > 1} if len(grams) < 1000 else {g for g, c in __import__("collections").Counter(grams).items() if c > 1}
        assert n == len({i + j for i, g in enumerate(grams) if g in often for j in range(3)})


def test_exact_dedup(docs, none):
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(ROWS) and exact_dedup.exact_dedup(none).count() == 0
    groups = {}
    for r in ROWS:
        groups.setdefault(r[1] or "", []).append(-1 if r[0] is None else r[0])
    for r in got:
        ids = groups[r.text or ""]
        assert r.group_size == len(ids) and (-1 if r.keep_id is None else r.keep_id) == max(ids)
    assert sum(r.kept for r in got) == len(groups)
    shuffled = exact_dedup.exact_dedup(docs, broadcast_rows=0)
    assert sorted(map(str, shuffled.collect())) == sorted(map(str, got))
    assert exact_dedup.keep_first(docs).columns == docs.columns


def test_rans_blocks():
    r = np.random.default_rng(1)
    for n in (0, 1, 1023, 4096, 1_400_000):
        ids = np.minimum(r.geometric(0.01, n), 900).astype(np.uint32)
        freq = rans.frequencies(np.bincount(ids, minlength=901))
        if n:
            assert freq.sum() == 1 << rans.BITS
        block = rans.encode_block(ids, freq)
        assert (rans.decode_block(block, freq) == ids).all()
    assert (rans.decode_part(block, freq, 0) == ids[: 128 * rans.LANES]).all()
    with pytest.raises(ValueError):
        rans.decode_block(block[:-9] + b"x" + block[-8:], freq)


def test_rans_tokens(spark, docs, none, tmp_path):
    rans.write_tokens(docs, BYTES, f"{tmp_path}/a")
    got = sorted(rans.read_tokens(spark, f"{tmp_path}/a").collect(), key=lambda r: r.start)
    t, start = tokenizers.Tokenizer.from_file(BYTES), 0
    want = sorted([*t.encode(x[1] or "", add_special_tokens=False).ids, 0] for x in ROWS)
    assert sorted(np.frombuffer(r.ids, "<u4").tolist() for r in got) == want
    for r in got:
        assert r.start == start and r.ids_crc32 == zlib.crc32(r.ids)
        start += r.n_tokens
    ids = [-1 if r.id is None else r.id for r in got]
    assert ids == sorted(ids)
    whole, pack = tokenizers.Tokenizer.from_file(BYTES), lambda x: np.array([*x, 0], "<u4").tobytes()
    own = lambda text: pack(whole.encode(text or "", add_special_tokens=False).ids)
    assert sorted((i, r.ids) for i, r in zip(ids, got)) == sorted((-1 if r[0] is None else r[0], own(r[1])) for r in ROWS)
    rans.write_tokens(none, BYTES, f"{tmp_path}/b")
    assert rans.read_tokens(spark, f"{tmp_path}/b").count() == 0


@pytest.mark.parametrize("options", [{}, {"hot": 1}])
def test_substring_dedup(docs, none, options):
    got = fm_index.remove_repeats(docs, **options).collect()
    first = {}
    key = lambda i: -1 if i is None else i
    for r in ROWS:
        w = plain(r[1])
        for i in range(len(w) - 12):
            g = tuple(w[i : i + 13])
            first[g] = min(first.get(g, 1 << 60), key(r[0]))
    assert len(got) == len(ROWS)
    for r in got:
        w = plain(r.text)
        gone = {i + j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < key(r.doc_id) for j in range(13)}
        assert (r.n_words, r.n_removed, r.kept_text) == (len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode())
    if not options:
        assert fm_index.remove_repeats(none).count() == 0


def test_fm_index_ids_that_repeat(spark):
    """Many rows without id, some with equal texts too, each gather their own anchors once, and lose what an id before them has and nothing else."""
    r = random.Random(9)
    prose = lambda n: " ".join(str(r.randint(0, 10**6)) for _ in range(n))
    passages = [prose(20) for _ in range(400)]
    texts = [prose(10) + " " + p for p in passages]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7777, p + " " + prose(10)) for p in passages] + [(7777, "same " + passages[0])] * 600
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = fm_index.remove_repeats(docs).collect()
    newest = max(glob.glob(f"{shared_dir(spark)}/fm-rows-*"), key=os.path.getmtime)
    lists = spark.read.parquet(newest).select("id", F.size("anchors").alias("n")).collect()
    assert len(lists) == len(rows) and max(x.n for x in lists) <= 20
    assert all(x.n_removed == (0 if x.doc_id < 7777 else 20) for x in got) and len(got) == len(rows)


def test_word_hashes():
    """Equal words have equal hashes and others don't, wherever they stand; the words are those of `split`."""
    r = random.Random(8)
    texts = ["", " \n", "a", "a\0", "a\0\0", "é" * 300, "é" * 299 + "e", *("".join(r.choice("ab \t\r\x0b\x0c\x1c\u2003é") for _ in range(r.randint(0, 60))) for _ in range(3000)), "x" * 9 + " " + "x" * 8]
    words = [w for t in texts for w in plain(t)]
    for col in (pa.array(texts), pa.array(["zz ", *texts])[1:]):
        hashes, offsets = fm_index.word_hashes(col)
        assert np.diff(offsets).tolist() == [len(plain(t)) for t in texts] and len(set(zip(words, hashes.tolist()))) == len(set(words)) == len(set(hashes.tolist()))
    assert [len(x) for x in fm_index.word_hashes(pa.array([], pa.string()))] == [0, 1] and [len(x) for x in fm_index.word_hashes(pa.array(["", ""]))] == [0, 3]


def test_chat_format(spark):
    records = ['{"prompt":"a </turn>\\n### x: y","response":"\\\\l b"}', '{"output":"c","instruction":"d"}', '{"messages":[{"content":"e","role":"user"},{"role":null,"content":null}]}', '{"conversations":[{"from":"human","value":"f"},{"from":"gpt","value":"#😀:"}]}', "no json", None, "{}", '{"messages":[]}']
    df = chat_format.canonical_turns(spark.createDataFrame([(r, "own") for r in records], "record string, formatted string"))
    out = chat_format.format_chat(df).withColumn("back", chat_format.read_chat(F.col("formatted"))).withColumn("lost", chat_format.loss_text(F.col("formatted"), F.col("loss"))).collect()
    turns = [None if r.turns is None else [tuple(t) for t in r.turns] for r in out]
    assert turns[:4] == [[("user", "a </turn>\n### x: y"), ("assistant", "\\l b")], [("user", "d"), ("assistant", "c")], [("user", "e"), ("", "")], [("user", "f"), ("assistant", "#😀:")]]
    assert turns[4:] == [None] * 4 and [r.lost for r in out[:4]] == ["\\l b", "c", "", "#😀:"]
    assert all(r.back is None if t is None else [tuple(x) for x in r.back] == t for r, t in zip(out, turns))


def test_chat_nulls_and_conversations(spark):
    """Null turns, roles and texts; a null id, repeated turns, a very long text, clashing columns; an empty table."""
    df = spark.createDataFrame([([("assistant", None), (None, "b"), None, ("assistant", "c:#")],), (None,), ([],)], "turns array<struct<role: string, text: string>>")
    out = chat_format.format_chat(df).withColumn("back", chat_format.read_chat(F.col("formatted"))).withColumn("under", chat_format.loss_text(F.col("formatted"), F.col("loss"))).collect()
    assert [tuple(t) for t in out[0].back] == [("assistant", ""), ("", "b"), ("", ""), ("assistant", "c:#")] and len(out[0].loss) == 2 and out[0].under == "c:#"
    assert out[1].formatted is None and out[1].loss is None and out[2].formatted == "" and out[2].loss == []
    long = "x </turn> " * 20_000
    rows = [(1, 0, "user", "a", "f"), (1, 1, "assistant", "b", "f"), (1, 1, "assistant", "b", "f"), (None, 0, None, None, "f"), (2, 0, "tool", long, "f"), (3, 0, "system", "s", "f"), (3, 1, "user", "u", "f"), (3, 2, "assistant", "v", "f")]
    t = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, formatted string")
    made = lambda x: {r.conv_id: r for r in chat_format.chat_digests(chat_format.format_chat(chat_format.canonical_turns(chat_format.pack_turns(x))).select("conv_id", "turns", "formatted", "loss")).collect()}
    got, digest = made(t), lambda *turns: hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert {k: (r.n_turns, r.loss_chars, r.turns_sha256) for k, r in got.items()} == {
        1: (3, 2, digest(("user", "a"), ("assistant", "b"), ("assistant", "b"))), None: (1, 0, digest(("", ""))), 2: (1, 0, digest(("tool", long))), 3: (3, 1, digest(("system", "s"), ("user", "u"), ("assistant", "v"))),
    }
    assert made(t.limit(0)) == {}


def test_chat_very_many_turns(spark):
    """200,000 turns of one conversation; spans point at what they say."""
    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(199_999)), lambda i: F.struct(F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("<"), i.cast("string")).alias("text"))).alias("turns"))
    out = chat_format.chat_digests(chat_format.format_chat(df)).collect()[0]
    loss = "".join(f"<{i}" for i in range(1, 200_000, 2))
    assert (out.n_turns, out.loss_chars, out.loss_sha256) == (200_000, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    few = chat_format.format_chat(df.select(F.slice("turns", 1, 1000).alias("turns"))).collect()[0]
    assert [few.formatted[s.start : s.start + s.length] for s in few.loss] == [f"\\l{i}" for i in range(1, 1000, 2)] and [s.turn for s in few.loss] == [*range(1, 1000, 2)]


def test_golay_keys_meet():
    r = np.random.default_rng(2)
    a = r.integers(0, 1 << 63, 4000, dtype=np.uint64)
    flips = [np.bitwise_xor.reduce([np.uint64(1) << np.uint64(b) for b in r.choice(64, k, replace=False)]) if k else np.uint64(0) for k in r.integers(0, 5, len(a))]
    (ka, wa), (kb, wb) = simhash.bucket_keys(a), simhash.bucket_keys(a ^ np.array(flips, np.uint64))
    have = set(zip(ka.tolist(), wa.tolist()))
    assert len({w for k, w in zip(kb.tolist(), wb.tolist()) if (k, w) in have}) == len(a)


def bits_of(text, width=4):
    """The fingerprint by counting each bit of each shingle."""
    w = [x.lower() for x in plain(text)]
    grams = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return "%016x" % sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_equal_brute_force(docs):
    text = {(-1 if r.doc_id is None else r.doc_id, bits_of(r.text)) for r in docs.select("doc_id", "text").collect()}
    assert {(-1 if r.doc_id is None else r.doc_id, r.fingerprint) for r in simhash.near_duplicates(docs).collect()} == text


def test_dense_buckets():
    """Forests of one bucket of many fingerprints connect what comparing all pairs connects."""
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 62, 12)
    prints = np.unique(np.concatenate([base, *(x ^ np.bitwise_or.reduce(1 << r.integers(0, 62, (3, 150)), axis=0) for x in base)]))
    key = np.repeat([1, 2], [len(prints) - 40, 40])
    for part in (prints, prints[:50]):
        a, b = simhash._links(np.ones(len(part), np.int64), part, 4)
        root = {x: x for x in part.tolist()}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for x, y in zip(a, b):
            assert (x ^ y).bit_count() <= 4
            root[find(x)] = find(y)
        for i, x in enumerate(part.tolist()):
            for y in part[i + 1 :].tolist():
                if (x ^ y).bit_count() <= 4:
                    assert find(x) == find(y)
        assert len(a) < len(part)
    both = simhash._links(key, prints, 4)
    assert len(both[0]) < len(prints)


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS) and simhash.near_duplicates(none).count() == 0
    prints = {(-1 if r.doc_id is None else r.doc_id, r.fingerprint): r.component_id for r in got}
    nodes = sorted({int(f, 16) for _, f in prints})
    group = {n: n for n in nodes}
    for _ in nodes:
        for x in nodes:
            group[x] = min([group[x], *(group[y] for y in nodes if (x ^ y).bit_count() <= 4)])
    least = {}
    for i, f in prints:
        if i >= 0:
            g = group[int(f, 16)]
            least[g] = min(least.get(g, 1 << 60), i)
    assert all(c == least.get(group[int(f, 16)]) for (_, f), c in prints.items())
    kept = simhash.keep_one_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(group.values()))


def five_word_components(texts):
    """The component of each text by brute force: shared five-word shingles over all of both, 0.8 or more; and how many pairs link."""
    def parts(text):
        w = plain((text or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}

    sets, group, links = [parts(t) for t in texts], list(range(len(texts))), []
    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if 5 * len(a & b) >= 4 * len(a | b):
                links.append((i, j))
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group, links


def near_texts():
    r = random.Random(21)
    out = []
    for n in (60, 120, 300):
        for edits in (1, 2, 3, 5, 8, 13):
            base = [f"w{r.randint(0, 10**9)}" for _ in range(n)]
            out.append(" ".join(base))
            for _ in range(6):
                copy = list(base)
                for k in r.sample(range(n), min(edits, n // 20)):
                    copy[k] = f"x{r.randint(0, 10**9)}"
                out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("side", [400, 2])
def test_near_dedup_stage(spark, docs, monkeypatch, side):
    monkeypatch.setattr(shingle_dedup, "_SIDE", side)
    texts = near_texts()
    group, links = five_word_components(texts)
    assert len(links) > 100 and len(set(group)) > 30
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()}
    assert kept == set(group)
    texts = [r[1] for r in ROWS]
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns and got.count() == len(set(five_word_components(texts)[0]))
    assert side < 400 or corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_mixing(docs, none):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(ROWS) and mixing.mix_sources(none).count() == 0
    size, weight = {}, {"a": 5, "b": 2, "c": 1, None: 5}
    for r in ROWS:
        size[r[3]] = size.get(r[3], 0) + len(plain(r[1]))
    left, target, open_ = 1.5 * sum(size.values()), {}, set(size)
    while True:  # shares by weight, the excess again and again
        each = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if each * weight[s] > 2 * size[s]}
        if not full:
            target |= {s: each * weight[s] for s in open_}
            break
        target |= {s: 2.0 * size[s] for s in full}
        left -= sum(2 * size[s] for s in full)
        open_ -= full
    for s, t in target.items():
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - t) < 1e-6 and r.copies <= 2 for r in mine)
        assert abs(sum(r.copies * int(r["size"]) for r in mine) - t) <= max(int(r["size"]) for r in mine)
    assert mixing.mixed_rows(docs).columns == docs.columns and mixing.mixed_rows(docs).count() == sum(r.copies for r in got)


@pytest.mark.parametrize("blocks", [1, 5])
def test_mixing_repeated_ids(spark, blocks):
    """Rows that share an id, or an id and a text, are cut to the word: three sources of 400 rows of 50 words, the ids of the third all null and its texts all equal."""
    words = " ".join(["w"] * 50)
    rows = [(i, f"{words[2:]} {i}", "a") for i in range(400)] + [(7, f"{words[2:]} {i}", "b") for i in range(400)] + [(None, words, "c")] * 400
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(blocks)).collect()
    assert len(got) == 1200
    for s in "abc":
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.copies * r["size"] for r in mine) - mine[0].target) <= 25 and {r.copies for r in mine} <= {0, 1, 2}


@pytest.mark.parametrize("weighed", [False, True])
def test_mixing_odds(spark, weighed):
    """How many of each class are taken comes near its inclusion probability; these add up to the target, rise with the weight and reach 1 for some."""
    weight = F.when(F.col("id") % 10 == 0, 900).when(F.col("id") % 10 < 4, 3)
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.pow(F.lit(2), F.col("id") % 7).cast("int").alias("words"), weight.alias("w"))
    got = mixing.mix_sources(docs, size_col="words", weight_col="w" if weighed else None).groupBy("source", "weight", "p").agg(F.count("*").alias("n"), F.sum("copies").alias("copies"), F.min("copies").alias("low"), F.max("copies").alias("high"), F.sum("size").alias("words"), F.first("target").alias("target")).collect()
    for s in ("s0", "s1", "s2"):
        mine = sorted((r for r in got if r.source == s), key=lambda r: r.weight)
        expected = [r.low + r.p for r in mine]
        assert expected == sorted(expected) and len({r.weight for r in mine}) == (3 if weighed else 7) and all(r.high <= 2 and r.high - r.low <= 1 for r in mine)
        assert abs(sum(e * r.words for e, r in zip(expected, mine)) - mine[0].target) < 1e-6 * mine[0].target
        for e, r in zip(expected, mine):
            assert r.low == r.high if r.p == 0 else abs(r.copies - e * r.n) < 5 * (r.n * r.p * (1 - r.p)) ** 0.5 + 1
    assert any(0 < r.p < 1 for r in got) and (not weighed or any(r.weight == 900 and r.p == 0 for r in got))


def test_wfst_long_runs():
    """Runs of a million letters and of a million spaces, and shorter ones of every length, as the library gives them."""
    sp, t = sentencepiece.SentencePieceProcessor(model_file=PIECES), wfst.Transducer(PIECES)
    for text in [*(" " * n for n in range(1, 200)), *(" " * n + "a" for n in range(1, 200)), " " * 1_000_000, "x" * 1_000_000, "ab" * 500_000]:
        assert np.frombuffer(t.encode(text), "<u4").tolist() == sp.encode(text), (text[-1], len(text))


def test_wfst(docs, none):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = wfst.encode_pieces(docs, PIECES).collect()
    assert len(got) == len(ROWS) and wfst.encode_pieces(none, PIECES).count() == 0
    for r in got:
        ids = sp.encode(r.text or "")
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids) and r.decoded == (r.text or "").replace("▁", " ")


def test_token_counts(docs, none):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for long in (16_384, 200):
        got = token_counts.token_counts(docs, PIECES, long_chars=long, overlap=16).collect()
        assert all(r.n_tokens == len(sp.encode(r.text or "")) and r.n_bytes == len((r.text or "").encode()) for r in got)
    assert len(got) == len(ROWS) and token_counts.token_counts(none, PIECES).count() == 0


def test_pipeline(spark, docs):
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        before, rows = rows, stage(spark, rows, "")
        if name != "sentencepiece":
            assert rows.columns == before.columns
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {hashlib.sha256(np.array(sp.encode(r[1] or ""), "<u4").tobytes()).hexdigest() for r in ROWS}
    got = rows.collect()
    assert got and all(hashlib.sha256(r.ids).hexdigest() in texts for r in got)


def shingled(text):
    w = [x.lower() for x in plain(text)]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def test_pipeline_stages_equal_brute_force(spark):
    """Which rows each stage keeps and what it leaves of their texts, computed in plain Python from the stage before."""
    r = random.Random(8)
    prose = lambda n: " ".join(f"w{r.randint(0, 10**6)}" for _ in range(n))
    footer, data = "all  rights Reserved", []
    for i in range(60):
        data.append((i, prose(80) + ("\n" + footer if i % 2 else ""), "en", "s0", 1))
    for family in range(6):  # near copies: one word in 90 changed, and one pair too far apart
        w = prose(90).split()
        for j in range(3):
            v = [*w[: 10 + j], f"z{family}{j}", *w[11 + j :]] if j else w
            data.append((100 + 10 * family + j, " ".join(v), "en", "s1", 1))
        data.append((109 + 10 * family, " ".join([*w[:40], *prose(50).split()]), "en", "s1", 1))
    data += [(200 + i, data[i][1], "en", "s2", 1) for i in range(5)] + [(300, "too short", "en", "s0", 1), (301, None, "en", "s0", 1), (302, "a b c " * 40, "en", "s0", 1)]
    data += [(400 + i, "only line\n" * (1 + i % 3) + footer.lower(), "en", "s0", 1) for i in range(30)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars int")
    stages, rows = dict(corpus_pipeline.STAGES), {}
    tidy = lambda x: " ".join(x.lower().split())

    seen = {}
    for i, t, _, s, _ in data:
        article = tuple(tidy(x) for x in (t or "").split("\n") if x.split())
        for x in article:
            seen.setdefault((s, x), set()).add(article)
    for i, t, _, s, _ in data:
        w = (t or "").split()
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        hit = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
        kept = [x for x in (t or "").split("\n") if len(seen.get((s, tidy(x)), ())) <= 20]
        n = len(" ".join(kept).split())
        if len(w) >= 50 and 100 * len(hit) <= 50 * len(w) and n >= 50 and n >= 0.3 * len(w):
            rows[i] = "\n".join(kept)
    one = stages["quality_rules"](spark, docs, "")
    got = {x.doc_id: x.text for x in one.collect()}
    assert {i for i in rows | got if rows.get(i) != got.get(i)} == set() and all(footer not in t for i, t in rows.items() if i < 100) and len(rows) > 80

    best = {t: max(i for i in rows if rows[i] == t) for t in rows.values()}
    two = stages["exact_dedup"](spark, one, "")
    assert sorted(x.doc_id for x in two.collect()) == sorted(best.values()) and len(best) < len(rows)

    sets, group = {i: shingled(rows[i]) for i in best.values()}, {i: i for i in best.values()}
    for _ in group:
        for a in group:
            group[a] = min([group[a], *(group[b] for b in group if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))])
    three = stages["near_dedup"](spark, two, "")
    assert sorted(x.doc_id for x in three.collect()) == sorted(set(group.values())) and len(set(group.values())) < len(group)

    four = stages["mixing"](spark, three, "").collect()
    copies = mixing.mix_sources(three.select("doc_id", "text", "source"))
    assert {x.doc_id: x.copies for x in copies.collect() if x.copies} == {i: sum(x.doc_id == i for x in four) for i in {x.doc_id for x in four}}
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    five = stages["sentencepiece"](spark, spark.createDataFrame(four), "").collect()
    assert len(five) == len(four) and all(x.round_trip and np.frombuffer(x.ids, "<u4").tolist() == sp.encode(rows[x.doc_id]) for x in five)


def test_wfst_random_texts(monkeypatch):
    monkeypatch.setattr(wfst, "_CACHE_MAX", 50)  # both generations of kept words are used
    sp, t, r = sentencepiece.SentencePieceProcessor(model_file=PIECES), wfst.Transducer(PIECES), random.Random(9)
    some = ["the", "ing", "Été", "  ", " ", "\n", "\t", ".", "...", "don't", "###", "1999", "привет", "你好", "😀", "é", "ç%", "<s>", "▁", "=>", "});", "\x00", "_a_"]
    for _ in range(3000):
        text = "".join(r.choice(some) for _ in range(r.randint(0, 12)))
        ids = t.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == sp.encode(text), text
        assert t.decode(ids) == text.replace("▁", " "), text


def test_byte_level_units():
    """Texts cut at units get the ids that the library gives the whole text."""
    rng, encoder = random.Random(5), rans.Encoder(BYTES)
    signs = ["<|endoftext|>", "'ll", " '", "\r\n", *"ab'sd tre  \n\n\t.,!9²é日ß́ _|<>×ſ"]
    texts = ["", " ", "\n", "'s ''s !'s", "a  b\n\n c", *("".join(rng.choices(signs, k=rng.randint(0, 25))) for _ in range(5000))]
    whole = [np.array(e.ids, "<u4").tobytes() for e in tokenizers.Tokenizer.from_file(BYTES).encode_batch(texts, add_special_tokens=False)]
    assert encoder.ids(texts) == whole
