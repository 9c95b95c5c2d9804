"""Each operator against brute force, the library it must equal, or a round trip; and its defined cases."""

import base64
import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillwatch.llm import bpe, chat, decontam, graph, minhash, quality, secret_scan, substring, topk, toxicity, training, warc
from quillwatch.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "clash") for i, t, s in rows], DOCS)


# Chat

AWKWARD = ["", "plain", "\\### Assistant: </turn> ok", "</turn>\n### user:\nhi</part>", "<\\/turn> ##\\\\# x", "####  ##", "é\n:\n\\", "## # ### "]


def test_chat_round_trip(spark):
    rows = [(1, t, r, x) for t, (r, x) in enumerate([("user", a) for a in AWKWARD] + [("assistant", a) for a in AWKWARD] + [("a:\nb### ", "x"), (None, None), ("user", None)])]
    rows += [(2, None, "assistant", "b"), (2, 5, "assistant", "a"), (2, 5, "assistant", "a"), (None, 1, "user", "n")] + [(3, 200 - k, "user" if k % 3 else "assistant", str(k)) for k in range(200)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = {r["conv_id"]: r for r in chat.format_chats(table).withColumn("turns", chat.parse(F.col("formatted"))).collect()}
    for conv in (1, 2, 3, None):
        want = sorted([(t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv])
        got = [(t["role"], p) for t in out[conv]["turns"] for p in t["parts"]]
        assert got == [(r, x) for _, _, r, x in want]
        assert all(a["role"] != b["role"] for a, b in zip(out[conv]["turns"], out[conv]["turns"][1:], strict=False))
        assert [s["text"] for s in out[conv]["segments"] if s["loss"]] == [spark_escape(x) for _, _, r, x in want if r == "assistant"]
        assert "".join(s["text"] for s in out[conv]["segments"]) == out[conv]["formatted"]
    assert chat.format_chats(table.limit(0)).count() == 0


def spark_escape(text):
    return re.sub(r"<(\\*)/(turn|part)>", r"<\1\\/\2>", re.sub(r"##(\\*)# ", r"##\1\\# ", text))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="#< \\/turnpa>x", max_size=24))
def test_chat_escape_is_reversible(text):
    escaped = spark_escape(text)
    assert chat.OPEN not in escaped and "</turn>" not in escaped and chat.PART not in escaped
    assert re.sub(r"##\\(\\*)# ", r"##\1# ", re.sub(r"<\\(\\*)/(turn|part)>", r"<\1/\2>", escaped)) == text


# BPE

@pytest.fixture(scope="module")
def words():
    return bpe.Vocabulary(bpe.read_vocabulary(vocabulary()))


def test_bpe_equals_library(words):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(vocabulary())
    rng = np.random.default_rng(3)
    letters = [*"abcdefghinorst's 're 'd \t\n019½²ÀÉüßİΣσς中文😀_-!?.<|>", "<|endoftext|>", "<|startoftext|>", "\x1c", "\x85", "\xa0", "́", " the ", "ing "]
    texts = ["", " ", "a" * 3000, *["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(3000)]]
    for text, ids, want in zip(texts, words.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, np.int32).tolist() == want.ids, repr(text)


def test_bpe_columns(spark, words):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(vocabulary())
    text = bpe.read_vocabulary(vocabulary())
    rows = [(1, "Hello, hello worlds!"), (2, None), (3, ""), (3, ""), (4, "é <|endoftext|> x")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", bpe.encoder(text)(F.coalesce("text", F.lit(""))))
    for r in table.withColumn("decoded", bpe.decoder(text)(F.col("ids"))).collect():
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == library.decode(want, skip_special_tokens=False)


# Classifiers

def labelled(spark, bad):
    rng = np.random.default_rng(5)
    syllables = ["er", "th", "an", "on", "re", "ing", "ti"]
    make = lambda n: " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(n))
    rows, labels = [], []
    for i in range(400):
        text = make(int(rng.integers(20, 200)))
        if i % 4 == 0:
            text = bad(text)
        rows.append((i, text, "s"))
        labels.append((i, int(i % 4 != 0), int(i % 4 == 0)))
    return docs(spark, [*rows, (400, None, "s"), (401, "", "s"), (401, "", "s"), (None, "x", "s")]), spark.createDataFrame([*labels, (7, None, None)], "doc_id long, quality int, toxic int")


def test_quality_learns(spark):
    table, labels = labelled(spark, lambda t: t.upper().replace(" ", "!! "))
    model = quality.train(table, labels, F.col("doc_id") % 3 != 1)
    out = {r["doc_id"]: r for r in quality.classify(table, model).collect()}
    assert len(out) == 403 and np.mean([out[i]["predicted"] == int(i % 4 != 0) for i in range(1, 400, 3)]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out.values()) and quality.classify(table, model).count() == 404
    assert quality.train(table, labels.limit(0), F.lit(True)) is None
    assert quality.classify(table, None).select("score").distinct().collect()[0][0] == 0.5


def test_quality_gradient():
    rng = np.random.default_rng(1)
    model = quality.Attention(5, 3)
    bags, y = [rng.random((k, quality.WIDTH)).astype(np.float32) for k in (1, 3, 2)], np.array([1.0, 0.0, 1.0])

    def loss():
        out = 0
        for bag, t in zip(bags, y, strict=True):
            h, a = model.encode(bag)
            a = np.exp(a) / np.exp(a).sum()
            p = 1 / (1 + np.exp(-(a @ h @ model.p["c"] + model.p["b"][0])))
            out -= t * np.log(p) + (1 - t) * np.log(1 - p)
        return out / 3
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    for name, g in model._gradient(bags, y).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = model.p[name][at]
        model.p[name][at] = old + 1e-5
        up = loss()
        model.p[name][at] = old - 1e-5
        assert abs((up - loss()) / 2e-5 - g[at]) < 1e-4 * max(1, abs(g[at]))
        model.p[name][at] = old


def test_toxicity_learns(spark):
    table, labels = labelled(spark, lambda t: t + " grumpf " + t[:40])
    model = toxicity.train(table, labels, F.col("doc_id") % 5 != 0, parts=2)
    out = {r["doc_id"]: r for r in toxicity.classify(table, model).collect()}
    assert np.mean([out[i]["predicted"] == int(i % 4 == 0) for i in range(0, 400, 5)]) > 0.97
    assert out[400]["score"] == out[401]["score"] < 0.5
    assert toxicity.train(table, labels.limit(0), F.lit(True)) is None


def test_toxicity_places_over_chunks(monkeypatch):
    text = ["abcdefgh" * 50, "", "xyz", "Ünïcode" * 20]
    whole = toxicity.row_places(text, None)
    monkeypatch.setattr(toxicity, "CHUNK", 37)
    assert (toxicity.row_places(text, None) == whole).all()


# Near-duplicates and graphs

def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 10), (20, 21), (21, 20)] + [(100 + k, 101 + k) for k in range(40)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 10: 7, 20: 20, 21: 20} | {100 + k: 100 for k in range(41)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_rows():
    rng = np.random.default_rng(11)
    vocab = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(800)]
    rows = []
    for family in range(6):
        base = rng.choice(vocab, 120).tolist()
        for edits in range(12):
            copy = list(base)
            for at in rng.integers(0, 120, edits):
                copy[at] = str(rng.choice(vocab))
            rows.append((len(rows), " ".join(copy), "s"))
    rows += [(500, rows[0][1].upper(), "s"), (501, rows[0][1], "s"), (501, rows[0][1], "s"), (502, None, "s"), (503, "", "s"), (504, " \n", "s"), (505, "two words", "s"), (506, "Two  WORDS", "s"), (None, "lonely text of five words", "s")]
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows()
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    sets = [shingles(t) for _, t, _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(rows[k][0])
    want = sorted((rows[k][0] if rows[k][0] is not None else -1, len(sets[k]), min((i for i in groups[find(k)] if i is not None), default=-1)) for k in range(len(rows)))
    table = docs(spark, rows)
    out = minhash.cluster(table).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in out) == want
    kept = minhash.deduplicate(table)
    assert kept.columns == table.columns and kept.count() == sum(r["keeper"] for r in out)
    assert minhash.deduplicate(table.limit(0)).count() == 0


@pytest.mark.parametrize(("nearest", "rounds"), [(1000, 1), (1, 2)])
def test_lists_are_compared_again_only_where_some_were_left_out(spark, monkeypatch, nearest, rounds):
    table, written = docs(spark, near_rows()), []
    want = sorted((r["uid"], r["component_id"] or -1) for r in minhash.cluster(table).collect())
    real = minhash.materialize
    monkeypatch.setattr(minhash, "materialize", lambda df, name: written.append(name) or real(df, name))
    monkeypatch.setattr(minhash, "NEAREST", nearest)
    monkeypatch.setattr(minhash, "CENTERS", 1)
    assert sorted((r["uid"], r["component_id"] or -1) for r in minhash.cluster(table).collect()) == want
    assert written.count("cells") == rounds


def test_rows_that_are_certainly_not_wanted_are_told_apart(spark):
    """Both parts are all rows, a null id included; what is wanted is never in the second, odd column names stay."""
    rows = spark.range(2000).select(F.when(F.col("id") != 5, F.col("id")).alias("doc_id"), F.lit("x").alias("_block"), F.lit("y").alias("a.b"))
    wanted = spark.createDataFrame([(7,), (None,), (1999,)], "doc_id long")
    some, none = training.parted(rows, wanted, "doc_id")
    in_some, in_none = ([r["doc_id"] for r in part.collect()] for part in (some, none))
    assert {7, None, 1999} <= set(in_some) and len(in_some) < 20 and some.columns == none.columns == rows.columns
    assert sorted(in_some + in_none, key=str) == sorted([None if k == 5 else k for k in range(2000)], key=str)


def test_no_anti_join_is_pushed_below_the_bitmap(spark):
    kept = minhash.deduplicate(docs(spark, [(1, "one two three four five six", "s"), (2, "One two three four five six", "s"), (3, "others", "s")]))
    assert "LeftAnti" not in kept._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_signature_agreement_follows_similarity():
    a, b = np.unique(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64)), None
    b = np.unique(np.concatenate([a[:900], np.arange(100, dtype=np.uint64)]))
    s = minhash.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]), minhash.LONG)
    assert abs((s[0] == s[1]).mean() - 900 / 1100) < 0.06


def test_needed_agreements_have_one_miss_rate():
    assert (minhash.needed(85, minhash.COORDS), minhash.needed(85, minhash.LONG)) == (16, 399)
    for coords in (minhash.COORDS, minhash.LONG):
        for percent in (50, 80, 90):
            assert minhash._fewer(minhash.needed(percent, coords), coords, percent) <= minhash._fewer(minhash.AT_85[coords], coords, 85) < minhash._fewer(minhash.needed(percent, coords) + 1, coords, percent)


def test_pipeline_drops_near_duplicates_from_80_percent(spark):
    import corpus_pipeline
    rng = np.random.default_rng(12)
    rows, kept = [], []
    for k in range(200):  # 90 shingles each, 80 of them common: 80 of 100; or 79 of 101
        words = [f"w{v}" for v in rng.integers(0, 10**9, 94)]
        changed = 10 if k % 4 else 11
        other = words[:94 - changed] + [f"w{v}" for v in rng.integers(0, 10**9, changed)]
        a, b = shingles(" ".join(words)), shingles(" ".join(other))
        assert (100 * len(a & b) >= 80 * len(a | b)) == (changed == 10)
        rows += [(2 * k, " ".join(words), "s"), (2 * k + 1, " ".join(other), "s")]
        kept += [2 * k] if changed == 10 else [2 * k, 2 * k + 1]
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, docs(spark, rows), "").collect()) == kept


# Repeated passages

def test_chains_follow_order():
    assert substring.chains([0, 10, 20, 30], [100, 110, 5, 130])[0] == [0, 1, 3]
    assert substring.chains([], []) == []


def test_repeated_passages(spark):
    rng = np.random.default_rng(2)
    vocab = ["".join(rng.choice(list("abcdefghijkl"), 6)) for _ in range(5000)]
    fresh = lambda n: rng.choice(vocab, n).tolist()
    passage, fuzzy = fresh(70), None
    fuzzy = [*passage[:25], "changed", *passage[26:50], *passage[51:]]
    short = fresh(30)
    rows = [(1, fresh(100) + passage + fresh(40)), (2, passage + fresh(60)), (3, fresh(20) + fuzzy), (4, fresh(200)), (5, fresh(50) + short + fresh(50)), (6, short + fresh(90)), (7, fresh(80)), (8, None), (9, ""), (10, ["de"] * 90), (11, fresh(5) + ["de"] * 80)]
    rows = [(i, " ".join(w) if isinstance(w, list) else w, "s") for i, w in rows]
    rows += [(12, rows[6][1], "s")]
    got = {r["doc_id"]: (r["start_word"], r["end_word"]) for r in substring.repeated(docs(spark, rows)).collect()}
    assert set(got) == {1, 2, 3, 7, 12, 10, 11}
    assert got[1] == (100, 170) and got[2] == (0, 70) and got[3] == (20, 89) and got[7] == (0, 80)
    assert substring.repeated(docs(spark, rows).limit(0)).count() == 0


def brute_windows(texts, n=50, identity=0.8):
    """Of every text, the words that agree within `n` words that agree word by word with n words of another text well enough."""
    number = {}
    rows = [np.array([number.setdefault(w, len(number)) for w in t]) for t in texts]
    covered = [np.zeros(len(t), bool) for t in texts]
    for p, a in enumerate(rows):
        for q, b in enumerate(rows):
            if p == q:
                continue
            same = a[:, None] == b[None, :]
            for d in {int(j) - int(i) for i, j in zip(*np.nonzero(same), strict=True)}:
                on = np.diagonal(same, d)
                agree = np.concatenate([[0], np.cumsum(on)])
                for k in np.flatnonzero(agree[n:] - agree[:-n] >= identity * n).tolist():
                    covered[p][max(0, -d) + k:max(0, -d) + k + n] |= on[k:k + n]
    return covered


def edited(rng, words, share, vocab):
    out = list(words)
    for at in rng.permutation(len(out))[:int(share * len(out))]:
        out[at] = str(rng.choice(vocab))
    return out


def assert_covers(spark, texts):
    got = defaultdict(list)
    for r in substring.repeated(docs(spark, [(k, " ".join(t), "s") for k, t in enumerate(texts)])).collect():
        got[r["doc_id"]].append((r["start_word"], r["end_word"]))
    want = brute_windows(texts)
    assert set(got) >= {k for k, c in enumerate(want) if c.any()}
    for k, c in enumerate(want):
        found = np.zeros(len(c), bool)
        for s, e in got.get(k, []):
            found[s:e] = True
        assert not c.any() or (found & c).sum() >= 0.8 * c.sum(), k
    return got, want


def test_fuzzy_passages_equal_brute_force(spark):
    rng = np.random.default_rng(21)
    vocab = ["".join(rng.choice(list("abcdefghijkl"), 6)) for _ in range(20000)]
    fresh = lambda n: rng.choice(vocab, n).tolist()
    texts = []
    for k in range(60):  # two documents a passage
        passage = fresh((50, 60, 80)[k % 3])
        texts += [fresh(30 + k) + passage + fresh(40), fresh(70) + edited(rng, passage, (0.1, 0.15, 0.2)[k // 3 % 3], vocab) + fresh(30)]
    _, want = assert_covers(spark, texts)
    assert sum(c.any() for c in want) == 120


def test_passages_of_frequent_seeds_equal_brute_force(spark):
    rng = np.random.default_rng(22)
    vocab = ["".join(rng.choice(list("abcdefghijkl"), 6)) for _ in range(20000)]
    fresh = lambda n: rng.choice(vocab, n).tolist()
    lines = [fresh(9) for _ in range(12)]
    texts = [fresh(20) + lines[k % 12] + fresh(30) + lines[(k + 5) % 12] + fresh(20) for k in range(60)]
    # Passages of frequent lines only: two documents each, in an order of their own.
    for _ in range(12):
        passage = sum((lines[k] for k in rng.permutation(12)[:7]), [])
        texts += [fresh(25) + edited(rng, passage, 0.1, vocab) + fresh(25) for _ in range(2)]
    base = fresh(60)
    texts += [fresh(10) + edited(rng, edited(rng, base, 0.1, vocab), 0.05, vocab) + fresh(10) for _ in range(40)]
    texts = [texts[k] for k in rng.permutation(len(texts))]
    got, want = assert_covers(spark, texts)
    assert sum(c.any() for c in want) >= 50 and len(got) < len(texts)


def test_seeds_move_as_packed_marks_and_passages_do_not_depend_on_chunks(spark, monkeypatch):
    marks = np.unique(np.random.default_rng(3).integers(0, 1 << 32, 50_000, dtype=np.uint64)).astype(np.uint32)
    assert (substring._unpack(substring._pack(marks), len(marks)) == marks).all() and len(substring._pack(marks)) < 3.5 * len(marks)
    rng = np.random.default_rng(23)
    vocab = ["".join(rng.choice(list("abcdefghijkl"), 6)) for _ in range(3000)]
    fresh = lambda n: rng.choice(vocab, n).tolist()
    passages = [fresh(60) for _ in range(5)]
    rows = docs(spark, [(k, " ".join(fresh(30 + k) + passages[k % 5] + fresh(20)), "s") for k in range(25)] + [(25, " ".join(fresh(90)), "s"), (26, None, "s")])
    whole = sorted(map(tuple, substring.repeated(rows).collect()))
    assert {r[0] for r in whole} == set(range(25)) and all(s <= 30 + k and e >= 90 + k for k, s, e in whole)
    monkeypatch.setattr(substring, "CHUNK", 300)
    monkeypatch.setattr(substring, "MARKS", 500)
    assert sorted(map(tuple, substring.repeated(rows).collect())) == whole


def test_shared_seeds_equal_plain_sets(monkeypatch):
    rng = np.random.default_rng(24)
    draw = lambda n, values: [rng.integers(0, values, rng.integers(0, 40)).astype(np.uint64) for _ in range(n)]
    for ask, other in ((draw(30, 60), draw(20, 60)), (draw(25, 2000), draw(30, 2000)), (draw(3, 9), draw(1, 9)), (draw(3, 9), []), ([], draw(2, 9)), (draw(4, 50), [v + np.uint64(100) for v in draw(4, 50)])):
        want = np.array([[len(set(p.tolist()) & set(q.tolist())) for q in other] for p in ask]).reshape(len(ask), len(other))
        for wide in (0, 50, 1 << 20):
            monkeypatch.setattr(substring, "WIDE", wide)
            for least in (1, 4, 7):
                got = substring._shared(ask, other, least)
                got = np.zeros(want.shape, int) if got is None else got
                assert (np.where(got >= least, got, 0) == np.where(want >= least, want, 0)).all() and (got <= want).all()


def test_matches_of_two_places_are_made_once(spark):
    rows = spark.createDataFrame([(x, s, 10 * x + s) for s in range(3) for x in range(s + 2)] + [(7, 9, 1), (7, 9, 5)], "x long, seed long, px int")
    led = substring._led(rows).collect()
    made = [(r["x"], r["y"], r["px"], r["py"]) for r in led if r["y"] >= 0]
    assert sorted(made) == sorted(set(made)) and all(x < y for x, y, _, _ in made)
    assert {(x, y, p % 10) for x, y, p, _ in made} >= {(0, 1, 0), (0, 1, 1), (0, 2, 1), (1, 2, 1), (0, 3, 2), (1, 3, 2)}
    assert sorted((r["x"], r["seed"]) for r in led if r["y"] < 0) == [(x, 2) for x in range(4)]


# Decontamination

def edit_distance_in(pattern, text):
    row = [0] * (len(text) + 1)
    for k, p in enumerate(pattern, 1):
        new = [k]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.lists(st.integers(0, 3), max_size=30))
def test_myers_equals_table(pattern, text):
    assert decontam.myers(decontam.places(pattern), len(pattern), text)[0] == edit_distance_in(pattern, text)


def test_decontamination_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    vocab = ["".join(rng.choice(list("abcdef"), 3)) for _ in range(60)]
    items = [(k, " ".join(rng.choice(vocab, rng.integers(3, 30)))) for k in range(12)] + [(50, None), (51, "")]
    rows = []
    for i in range(60):
        text = rng.choice(vocab, rng.integers(0, 80)).tolist()
        item = items[i % 12][1].split()
        for at in rng.integers(0, len(item), i % 7):
            item[at] = "zzz"
        rows.append((i, " ".join(text[:20] + (item if i % 2 else []) + text[20:]).upper(), "s"))
    rows += [(60, None, "s"), (61, "", "s"), (1, rows[1][1], "s")]
    want = set()
    for i, t, _ in rows:
        for k, x in items:
            n = len((x or "").split())
            if n >= 6 and edit_distance_in((x or "").split(), (t or "").lower().split()) <= int(0.2 * n):
                want.add((i, k))
    table, bench = docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    for options in ({}, {"block_items": 5}):
        assert {(r["doc_id"], r["item_id"]) for r in decontam.find(table, bench, **options).collect()} == want
    assert {r["doc_id"] for r in decontam.clean(table, bench).collect()} == {i for i, _, _ in rows} - {i for i, _ in want}
    assert decontam.find(table, bench.limit(0)).count() == 0 and decontam.clean(table.limit(0), bench).count() == 0


# Secrets

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text or "") if len(m[1]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    return sorted(spans + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text or "") if len(m[0]) >= 24])


def test_secrets(spark):
    live, copied = "Zk3" + "xQ9vB7nM2pL5wR8tY1" * 2, "Example0" * 2 + "abcdefgh1234"
    texts = ["", None, "é PassWord: 'hunter22' token=abc secret=token: abcdefgh", "AKIA" + "A1" * 9 + " AKIASHORT", "f" * 23 + " " + "0123456789abcdef" * 2, f"x {live} y", f"a {copied}", f"b {copied}", "api_key = \"" + "ab12" * 8 + "\" end"]
    rows = [(i, t, f"src{i}") for i, t in enumerate(texts)] + [(5, texts[5], "src5"), (6, "other", "src1")]
    out = secret_scan.find(docs(spark, rows), F.col("source"), F.col("source")).collect()
    assert len(out) == len(rows)
    got = defaultdict(list)
    for r in out:
        got[r["doc_id"]].append([(s["start"], s["kind"], s["end"]) for s in r["spans"]])
    for i, t in enumerate(texts):
        assert [s for s in got[i][0 if i != 6 else (0 if got[6][0] else 1)] if s[1] < 3] == base_spans(t), t
    assert got[5] == [[(2, 3, 2 + len(live))]] * 2  # seen with one owner
    assert got[7] == [[]] and got[6] == [[], []]  # a value of two owners is an example
    clean = {r["doc_id"]: r for r in secret_scan.redact(docs(spark, rows[:9]), F.col("source"), F.col("source")).collect()}
    assert clean[5]["text"] == "x [SECRET] y" and clean[5]["n_chars"] == 12 and clean[1]["text"] is None and clean[8]["text"] == "[SECRET]\" end"
    assert secret_scan.find(docs(spark, rows).limit(0), F.col("source"), F.col("source")).count() == 0


# Top-k

@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_topk_equals_brute_force(spark, scale):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(700, 8)), np.repeat(rng.normal(size=(1, 8)), 300, 0)]).astype(np.float32) * np.float32(scale)
    good = [(k, v.tolist()) for k, v in enumerate(x)] + [(5, x[5].tolist())] * 2 + [(400, x[400].tolist()), (1100, [1.0, 2.0]), (1200, []), (1201, []), (1202, [])]
    odd = [(1001, None), (1002, [None] + [0.0] * 7), (1003, [float("nan")] * 8), (1004, [float("inf")] * 8), (None, [1.0] * 8)]
    table = spark.createDataFrame(good + odd, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk.search(table, F.col("vec_id") % 100 == 0, block=256, query_block=4).select("query_id", "rank", "vec_id", "score").collect()))
    q = [(k, np.floor(np.array(v, np.float64) * 1024).astype(np.int64)) for k, v in good]
    want = []
    for k, v in q:
        if k % 100 == 0:
            best = sorted((-int(v @ w), i) for i, w in q if i != k and len(w) == len(v))[:10]
            want += [(k, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want) and sum(r[0] == 400 for r in got) == 20 and sum(r[0] == 1200 for r in got) == 2
    assert topk.search(table.limit(0), F.lit(True)).count() == 0


def test_bpe_all_code_points(words):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(vocabulary())
    texts = [f"a{c}1 {c}{c}b" for k in range(0x110000) if not 0xD800 <= k < 0xE000 for c in [chr(k)]]
    wrong = []
    for at in range(0, len(texts), 100_000):
        part = texts[at:at + 100_000]
        wrong += [t for t, ids, want in zip(part, words.encode(part), library.encode_batch(part, add_special_tokens=False), strict=True) if np.frombuffer(ids, np.int32).tolist() != want.ids]
    assert wrong == []


# WARC

def test_warc_round_trip(spark, tmp_path):
    trap = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    bodies = ["", "<p>é</p>", trap, "x" + trap + "y" + trap, "WARC/1.0\r\n", "a\r\n\r\nWARC/1.0\r\nContent-Length: 999999\r\n\r\n", None, "same", "same", "tail\r\n\r\n"] + ["fill %d " % k * 40 for k in range(60)]
    rows = [(k, f"http://x/{k}\r\nEvil: 1" if k % 2 else None, b) for k, b in enumerate(bodies)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    for k, split in enumerate(("134217728", "700", "64")):
        path = str(tmp_path / f"w{k}")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "134217728")
        warc.write_archives(pages.repartition(3), path)
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        got = {r["page_id"]: r for r in warc.page_records(warc.read_archives(spark, path)).collect()}
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert len(got) == len(bodies)
        for i, body in enumerate(bodies):
            raw = (body or "").encode()
            first = min(j for j, b in enumerate(bodies) if (b or "") == (body or ""))
            assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
            assert (got[i]["record_type"], got[i]["refers_to"]) == (("response", None) if first == i else ("revisit", first))
    path = str(tmp_path / "none")
    warc.write_archives(pages.limit(0), path)
    assert warc.page_records(warc.read_archives(spark, path)).count() == 0


def test_word_hashes_do_not_depend_on_chunks(monkeypatch):
    from quillwatch.llm import words as w
    column = pa.array(["One two  three", None, "", "four" * 50, "é x" * 30])
    whole = w.SPACED.words(*w.raw(column))
    monkeypatch.setattr(w, "CHUNK", 16)
    for a, b in zip(whole, w.SPACED.words(*w.raw(column)), strict=True):
        assert (a == b).all()


def test_likely_keeps_all_wanted(spark):
    from quillwatch.llm.training import likely
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    wanted = rows.where("doc_id % 40 = 3")
    got = {r[0] for r in likely(rows, wanted, "doc_id").collect()}
    assert {r[0] for r in wanted.collect()} <= got and len(got) < 520


# Short items, clashing columns, bounded fits

def test_short_and_unspaced_items_are_found(spark):
    items = spark.createDataFrame([(1, "Alpha beta, gamma delta"), (2, "今天天气很好我们一起去公园散步吧看看美丽的花朵"), (3, "短句"), (4, "!!"), (5, None)], "item_id long, text string")
    rows = [(1, "so alpha BETA gamma-delta it is", "s"), (2, "昨天说今天天气很好我们一块去公园散步吧看看美丽的花朵了", "s"), (3, "这是短句吗", "s"), (4, "alpha beta delta gamma", "s"), (5, None, "s"), (6, "!! 今天", "s")]
    table = docs(spark, rows)
    for options in ({}, {"block_items": 1}):
        assert {(r["doc_id"], r["item_id"], r["distance"]) for r in decontam.find(table, items, **options).collect()} == {(1, 1, 0), (2, 2, 1), (3, 3, 0)}
        left = decontam.clean(table.withColumn("_matches", F.lit("own")), items, **options)
        assert sorted((r["doc_id"], r["_matches"]) for r in left.collect()) == [(4, "own"), (5, "own"), (6, "own")]


def test_clashing_columns_pass(spark):
    text = "one two three four five six seven password = hunter2secret "
    table = docs(spark, [(1, text, "s"), (2, text, "s"), (3, "other words that stand here alone", "s"), (3, "other words that stand here alone", "s")])
    names = ["_id", "_key", "_text_key", "_cut", "_matches"]
    for name in names:
        table = table.withColumn(name, F.lit(f"own {name}"))
    for out in (minhash.deduplicate(table), secret_scan.redact(table, F.col("source"), F.col("lang"))):
        assert out.columns == table.columns
        held = out.collect()
        assert all(r[n] == f"own {n}" for r in held for n in names) and len(held) in (2, 4)


def test_components_join_in_steps(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))]
    table = lambda part: spark.createDataFrame(part, "a long, b long").where("a <> b")
    whole = {r["node"]: r["root"] for r in graph.components(table(edges)).collect()}
    roots = graph.components(table(edges[:90]))
    for part in (edges[90:100], edges[100:], edges[:5], []):
        roots = graph.joined(roots, table(part))
    assert {r["node"]: r["root"] for r in roots.collect()} == whole


def test_quality_fit_is_bounded(spark):
    texts = ["".join(chr(97 + (i + k) % 26) for k in range(n)) for i, n in enumerate((0, 10, quality.PASSAGE * 3, quality.PASSAGE * 500))]
    table = docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    size = {r["doc_id"]: r["n"] // quality.WIDTH for r in table.select("doc_id", F.size(quality.passage_features(7)("text")).alias("n")).collect()}
    assert size == {0: 1, 1: 1, 2: 3, 3: 7}


def test_quality_scores_equal_a_loop():
    model = quality.Attention(9, 4)
    texts = ["", "a b a b", "Some words, 12 of them! " * 90, "é" * 700]
    want = []
    for t in texts:
        bag = np.concatenate([x for x, _ in quality.passages(pa.array([t]))])
        top, low = 0.0, 0.0
        for x in bag.astype(np.float64):
            h = [max(0.0, sum(x[i] * model.p["E"][i, j] for i in range(len(x))) + model.p["e"][j]) for j in range(9)]
            gate = sum(model.p["w"][g] * np.tanh(sum(h[j] * model.p["V"][j, g] for j in range(9))) / (1 + np.exp(-sum(h[j] * model.p["U"][j, g] for j in range(9)))) for g in range(4))
            top, low = top + np.exp(gate) * sum(h[j] * model.p["c"][j] for j in range(9)), low + np.exp(gate)
        want.append(1 / (1 + np.exp(-(top / low + model.p["b"][0]))))
    assert np.allclose(model.score(pa.array(texts)), want, atol=1e-4)


def test_toxicity_cut():
    rng = np.random.default_rng(3)
    for _ in range(40):
        z, y = rng.integers(-5, 5, 30).astype(float), (rng.random(30) < 0.3).astype(float)
        if not y.any():
            continue
        f1 = lambda t: 2 * y[z >= t].sum() / ((z >= t).sum() + y.sum())  # noqa: B023, E731
        assert f1(toxicity.best_cut(z, y)) == max(map(f1, np.unique(z)))


def test_toxicity_scores_equal_a_loop():
    texts = ["", "some bad words, SOME", "é" * 300, "long text " * 4000]
    place = np.unique(np.concatenate([toxicity.row_places([t], None) for t in texts]))[::3]
    rng = np.random.default_rng(4)
    model = toxicity.Weights(place, rng.normal(size=len(place)) / 50, 0.25)
    known = dict(zip(place.tolist(), model.weight.astype(np.float32).tolist(), strict=True))
    want = [1 / (1 + np.exp(-(0.25 + sum(known.get(p, 0.0) for p in toxicity.row_places([t], None).tolist())))) for t in texts]
    assert np.allclose(model.score(texts), want, atol=1e-5)
