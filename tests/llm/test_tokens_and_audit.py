"""Byte-level BPE, fill-in-middle and the source audit against brute force and SQL."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlake.llm import byte_bpe, divergence, infill
from llm_rows import DOCS, hard_rows
from test_documents import in_duckdb, rows_of

#: Rows with what hurts tokenizers and patterns, as id and text.
ODD = ["'s 's it's 'RE we're''ve", "a  b   c\n\n d\t\t\te", "\x1c\x1d x \x85\x85y\xa0\xa0z 　　", "日本語。日本語 テスト １２３ ½²", "👩‍👩‍👧 é́ \U0001F600" * 3,
       " " * 3000 + "x" + "\n" * 2500 + " y" + " \t" * 2000, "　" * 1500 + "　a", "<|endoftext|> </s>", "x" * 5000, "é" * 3000, "<P> in the text", "a<S>b", "<M>", "\n", "…$1 \\ ${p}", "A1b2 " * 9000]


def odd_rows():
    return hard_rows() + [(100 + i, t, None, "odd", len(t), *["clash"] * 9) for i, t in enumerate(ODD)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3)


def merged(word, ranks):
    """Plain byte-pair merges: the pair with the least rank first, from the left."""
    parts = [bytes([b]) for b in word]
    while len(parts) > 1:
        rank, i = min((ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 40:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def test_byte_bpe_equals_plain_merges_of_each_match(odd, nothing):
    P = pytest.importorskip("public_tokenizers")
    import regex

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    known = {}

    def ids(text):
        out = []
        for word in regex.findall(P.PATTERN, text):
            if word not in known:
                known[word] = merged(word.encode(), ranks)
            out += known[word]
        return out

    want = []
    for doc_id, text, *_ in odd_rows():
        x = ids(text or "")
        want.append((doc_id, len(x), hashlib.sha256(np.array(x, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    got = byte_bpe.codec_query(odd, path, P.PATTERN)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert byte_bpe.codec_query(nothing, path, P.PATTERN).count() == 0


def test_byte_bpe_parts_do_not_change_ids(monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    codec = byte_bpe.Codec(open(P.path("byte_bpe_multi_50k.tiktoken")).read(), P.PATTERN)
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab'sé1 \n\t　\x85.") for _ in range(400)) for _ in range(300)]
    want = [codec.matches.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(byte_bpe, "PART", 5)
    monkeypatch.setattr(byte_bpe, "RUN", 2)
    monkeypatch.setattr(byte_bpe, "BLANKS", re.compile(f"[{byte_bpe.WHITE}]{{2,}}"))
    for text, ids in zip(texts, want):
        got = codec.encode(text)
        assert list(memoryview(got).cast("I")) == ids
        assert codec.decode(got) == text.encode()
    # longer than what the matcher can take at once
    assert len(codec.encode(" " * 1_500_000 + "a")) > 0


def test_byte_bpe_decodes_ids_that_end_inside_of_a_character(spark):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    part = ranks["é".encode()[:1]]
    rows = spark.createDataFrame([(1, part.to_bytes(4, "little")), (2, b""), (3, None)], "id long, ids binary")
    assert [r["bytes"] if r["bytes"] is None else bytes(r["bytes"]) for r in byte_bpe.decode(rows, path, P.PATTERN).orderBy("id").collect()] == ["é".encode()[:1], b"", None]


def test_infill_equals_plain_python(odd, nothing):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for doc_id, text, *_ in odd_rows():
        text = text or ""
        units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        n, digest = len(units), sha(f"1:{'' if doc_id is None else doc_id}")
        h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
        form = "plain" if not text or any(m in text for m in infill.MARKS) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
        out = {"plain": text, "psm": f"<P>{prefix}<S>{suffix}<M>{middle}", "spm": f"<S>{suffix}<P>{prefix}<M>{middle}"}[form]
        want.append((doc_id, n, form, *((None, None) if form == "plain" else (len(prefix), len(middle))), sha(out), sha(text)))
    got = infill.infill_query(odd)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert infill.infill_query(nothing).count() == 0


def test_infill_with_other_marks_and_shares(spark):
    docs = spark.createDataFrame([(i, f"alpha {i} <P> beta, gamma.\n") for i in range(60)], "doc_id long, text string")
    marks = ("$pre\\", "[suf]", "(mid)")
    rows = infill.rearrange(docs, F.struct("*"), 5, marks, 0, 100)
    got = rows.withColumn("again", infill.restored(F.col("output"), F.col("form"), marks)).collect()
    assert all(r.form == "spm" and r.output == marks[1] + r.suffix + marks[0] + r.prefix + marks[2] + r.middle and r.again == r.kept_as.text for r in got)
    assert len({(len(r.prefix), len(r.middle)) for r in got}) > 10


def test_infill_of_a_very_long_text(spark):
    text = "ab1 é\n" * 300_000
    r = infill.infill_query(spark.createDataFrame([(4, text)], "doc_id long, text string")).first()
    assert (r.n, r.restored_sha256) == (1_500_000, hashlib.sha256(text.encode()).hexdigest()) and r.form != "plain" and r.prefix_chars + r.middle_chars <= len(text)


def many_groups():
    rng = random.Random(8)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words[: rng.choice([5, 60, 300])]) for _ in range(rng.randrange(30))), rng.choice(["en", "xx", None]), rng.choice([f"s{k}" for k in range(90)] + [None]), 0, *["clash"] * 9)
            for i in range(900)]
    return rows + [(1000, "Only once", "alone", "a", 0, *["clash"] * 9), (1001, "1 2 3", "empty", "a", 0, *["clash"] * 9), (1002, None, "empty", "b", 0, *["clash"] * 9),
                   *[(1003 + i, "ÄÖ Äö äÖ foo\x00FOO", "umlauts", "ab"[i % 2], 0, *["clash"] * 9) for i in range(4)]]


@pytest.mark.parametrize("rows", [odd_rows(), many_groups()])
def test_audit_equals_sql(spark, rows):
    got = divergence.audit(spark.createDataFrame(rows, DOCS).repartition(4))
    assert rows_of(got.columns, map(tuple, got.collect())) == in_duckdb(divergence.AUDIT_SQL, rows)


def test_audit_of_nothing(nothing):
    assert divergence.audit(nothing).count() == 0 and not in_duckdb(divergence.AUDIT_SQL, [])


def test_infill_sql(odd):
    got = infill.infill_query(odd)
    assert rows_of(got.columns, map(tuple, got.collect())) == in_duckdb(infill.INFILL_SQL, odd_rows())


def test_joint_walk_equals_all_cells():
    rng = np.random.default_rng(2)
    for n, m, density in ((64, 64, 0.3), (3, 20, 0.02), (1, 1, 1.0), (64, 5, 0.0)):
        a, b = (np.where(rng.random((64, 64)) < density, rng.integers(2, 10**9, (64, 64)), 0) * (np.arange(64) < k)[:, None] for k in (n, m))
        za, zb = rng.integers(1, 1000, n), rng.integers(1, 1000, m)
        from_a, from_b, columns = divergence.walk(a, b, za, zb)
        for i in range(n):
            for j in range(m):
                some = (a[i] > 0) | (b[j] > 0)
                p, q = (np.where(x > 0, x, z)[some].tolist() for x, z in ((a[i], za[i]), (b[j], zb[j])))
                assert columns[i, j] == some.sum()
                assert from_a[i, j] == sum((x - y) ** 2 // y for x, y in zip(p, q)) and from_b[i, j] == sum((x - y) ** 2 // x for x, y in zip(p, q))


def test_terms_are_counted_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(f"t{chr(97 + i % 5)} " * (i % 4) + "x", "en", f"s{i % 3}") for i in range(50)] + [("", "en", "s0"), (None, None, None)], "text string, lang string, source string")
    want = collections.Counter()
    for r in docs.collect():
        for w in (r.text or "").split():
            want[r.lang, r.source, w] += 1
    for at_once in (16_000_000, 7):
        monkeypatch.setattr(divergence, "AT_ONCE", at_once)
        got = collections.Counter()
        for r in divergence.count_terms(docs).collect():
            got[r.lang, r.source, r.term] += r.n
        assert got == want
