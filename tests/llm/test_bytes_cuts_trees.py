"""Byte-level BPE against the library, fill-in-middle cuts against slicing, Merkle manifests against a plain tree; and their defined cases."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillwatch.llm import byte_bpe, fim, merkle
from quillwatch.llm.queries import byte_ranks, op13

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fim string, leaf string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", None if t is None else len(t), "clash", "clash") for i, t, g in rows], DOCS)


# Byte-level BPE

@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.Ranks(*byte_ranks())


@pytest.fixture(scope="module")
def library(ranks):
    import tiktoken
    from public_tokenizers import PATTERN
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks.ids, special_tokens={})


def differing(ranks, library, texts):
    return [t for t, ids in zip(texts, ranks.encode(texts), strict=True) if np.frombuffer(ids, np.int32).tolist() != library.encode_ordinary(t)]


def test_byte_bpe_equals_library(ranks, library, monkeypatch):
    rng = np.random.default_rng(1)
    letters = [*"abcdefghinorst's 're 'd \t\n019½²ÀÉüßİΣσς中文字漢😀_-!?.<|>", "<|endoftext|>", "\x1c", "\x85", "\xa0", "́", " the ", "ing ", "  ", "\n\n", "՘", "\U00031350"]
    texts = ["", " ", "a" * 3000, "ab" * 2000, "中文" * 900, *["".join(rng.choice(letters, rng.integers(0, 80))) for _ in range(3000)]]
    for alphabet in ("abcdefABCDEF0123+/=", "abcdeinorst", "中文字漢人大一是不了在有我他这"):  # pieces wider than any matrix
        texts += ["".join(rng.choice(list(alphabet), n)) for n in rng.integers(200, 3000, 20)]
    assert differing(ranks, library, texts) == []
    monkeypatch.setattr(byte_bpe, "TOGETHER", 50)  # long texts in parts
    monkeypatch.setattr(byte_bpe, "WIDE", 8)
    monkeypatch.setattr(byte_bpe, "CACHE", 100)
    ranks.cache.clear()
    assert differing(ranks, library, texts[5:1500]) == []


def test_byte_bpe_all_code_points(ranks, library):
    assert differing(ranks, library, [f"a{c}1 {c}{c}" for k in range(0x110000) if not 0xD800 <= k < 0xE000 for c in [chr(k)]]) == []


def test_byte_bpe_columns(spark, library):
    rows = [(1, "Hello, hello worlds!"), (2, None), (3, ""), (3, ""), (4, "é <|endoftext|> x"), (None, "x" * 300_000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", byte_bpe.encoder(*byte_ranks())(F.col("text")))
    for r in table.withColumn("decoded", byte_bpe.decoder(*byte_ranks())(F.col("ids"))).collect():
        assert r["ids"] == library.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    assert table.limit(0).count() == 0


# Fill-in-middle

@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400_000), st.integers(1, 9000), st.integers(1, 3)), max_size=6))
def test_boundaries_select(stretches):
    offsets = np.unique(np.concatenate([np.zeros(0, np.int64), *[np.arange(a, a + n * step, step) for a, n, step in stretches]]))
    held = fim.Boundaries(offsets)
    assert len(held) == len(offsets) and [held.select(int(k)) for k in range(0, len(offsets), 97)] == offsets[::97].tolist()


def test_boundaries_containers():
    offsets = np.concatenate([np.arange(10), np.arange(1 << 16, (1 << 16) + 9000, 2), np.arange(5 << 16, (5 << 16) + 65536)])
    held = fim.Boundaries(np.append(offsets, [(9 << 16) + 3, (9 << 16) + 7]))
    assert [c[0] for c in held.containers] == ["run", "bitmap", "run", "array"] and [held.select(k) for k in range(len(offsets))] == offsets.tolist()


TEXTS = ["", None, "one line", "\n", "\n\n\n", "a\nb\n", "a\nb", "é😀\n<\n<S\n>\nx" * 30, "with <M> mark\nx", "\r\n\x85\n", "long line\n" * 20_000, "x" * 200_000, "a\n" * 70_000]


def test_fill_in_middle_equals_slices(spark):
    rows = [(k, t, "en") for k, t in enumerate(TEXTS * 4)] + [(None, "a\nb\nc\n", "en"), (5, TEXTS[5], "en")]
    table = docs(spark, rows)
    made = fim.transform(table, seed=7, rate=80)
    assert made.columns == [c for c in table.columns if c != "fim"] + ["fim"]
    out = made.withColumn("back", fim.restore(F.col("fim.output"), F.col("fim.form"))).collect()
    assert len(out) == len(rows) and {r["fim"]["form"] for r in out} == {"plain", "spm", "psm"}
    for r in out:
        text, got = r["text"] or "", r["fim"]
        digest = hashlib.sha256(f"7:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()
        h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        a, b = sorted(x % (len(lines) + 1) for x in h[:2])
        p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
        form = "plain" if not text or any(x in text for x in fim.MARKS) or h[2] % 100 >= 80 else "spm" if h[3] % 100 < 50 else "psm"
        want = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        assert (got["n"], got["form"], got["output"], r["back"]) == (len(lines), form, want, text)
        assert (got["prefix_chars"], got["middle_chars"]) == ((None, None) if form == "plain" else (len(p), len(m)))
    assert fim.transform(table.limit(0)).count() == 0


# Merkle manifest

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(nodes, fanout):
    """All levels of a tree, the leaves first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][k:k + fanout]) for k in range(0, len(out[-1]), fanout)])
    return out


def siblings(levels, at, fanout):
    out = []
    for nodes in levels[:-1]:
        run = at - at % fanout
        out.append((nodes[run:at], nodes[at + 1:run + fanout]))
        at //= fanout
    return out


def plain_manifest(rows, fanout=2):
    """rows: (group, order, leaf, changed leaf or None). Sorted (group, order, leaf, subroot, root, proof, folded)."""
    key = lambda v: (v is not None, v if not isinstance(v, str) else v.encode()) if v is not None else (False,)
    groups = sorted({r[0] for r in rows}, key=key)
    held = {g: sorted((r for r in rows if r[0] == g), key=lambda r: (key(r[1]), r[2])) for g in groups}
    trees = {g: levels_of([r[2] for r in held[g]], fanout) for g in groups}
    top = levels_of([trees[g][-1][0] for g in groups], fanout)
    out = []
    for k, g in enumerate(groups):
        for at, (_, order, leaf, changed) in enumerate(held[g]):
            steps = siblings(trees[g], at, fanout) + siblings(top, k, fanout)
            h = changed or leaf
            for left, right in steps:
                h = sha(*left, h, *right)
            out.append((g, order, leaf, trees[g][-1][0], top[-1][0], sha(*[x for a, b in steps for x in [*a, *b]]), h))
    return out


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


@pytest.mark.parametrize(("fanout", "levels"), [(2, 2), (3, 1), (2, 8)])
def test_manifest_equals_plain_tree(spark, fanout, levels):
    rows = [(k, f"text {k}", "aé￿\U00010000"[k % 4] * (k % 3 > 0)) for k in range(45)] + [(100 + k, None, None) for k in range(17)] + [(None, "n", "a")] * 2 + [(7, "copy", "a")] * 9 + [(900, "lone", "z")]
    table = docs(spark, rows).repartition(5)
    leaf = merkle.leaf(F.col("doc_id"), F.col("text"))
    out = merkle.manifest(table, leaf, F.col("lang"), F.col("doc_id"), F.struct("lang", "doc_id"), fanout, levels)
    got = out.select("carry.*", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("p"), merkle.folded(F.col("leaf"), F.col("path")).alias("f")).collect()
    want = plain_manifest([(g, i, sha(field(i), field(t)), None) for i, t, g in rows], fanout)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and all(r["f"] == r["root"] for r in got)
    none = merkle.manifest(table.limit(0), leaf, F.col("lang"), F.col("doc_id"), F.struct("doc_id"), fanout, levels)
    assert none.count() == 0


def test_manifest_query_equals_plain_tree(spark, root):
    rows = spark.read.parquet(f"{root}/documents.parquet").collect()
    leaf = lambda r, more: sha(*map(field, (r["doc_id"], r["source"], r["lang"], None if r["n_chars"] is None else r["n_chars"] + more, r["text"])))
    want = plain_manifest([(r["lang"], r["doc_id"], leaf(r, 0), leaf(r, 1) if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 else None) for r in rows])
    got = op13(spark, root).collect()
    assert sorted((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"]) for r in got) == sorted(w[1:] for w in want)
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in got) and 0 < sum(not r["verified"] for r in got) < len(got) / 3
