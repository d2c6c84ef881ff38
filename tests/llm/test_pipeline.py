"""All stages of the pipeline on the hard rows, against a plain Python version."""

import collections
import hashlib
import math
import re
import struct
import zlib

import pytest

import corpus_pipeline
from fleetlake.llm.quality import COMMON_WORDS
from llm_rows import DOCS, hard_rows, passage

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = [re.compile(c) for c in (r"[a-z]", r"[\x20\x09-\x0D]", r"[^\x00-\x7F]", r"[A-Z]", r"[0-9]", r"[.,;:!?'\"()-]")]


def distance(x, y):
    n, m = sum(x), sum(y)
    if not n or not m:
        return 0.0
    part = lambda a, b: a * math.log2(2 * a / (a + b)) if a else 0.0
    return math.sqrt(max(0.0, sum(part(a / n, b / m) + part(b / m, a / n) for a, b in zip(x, y)) / 2))


def keep_good(docs):
    kinds, common, sums = [], [], {}
    for _, text, lang, _ in docs:
        w = [x.lower() for x in WORD.findall(text)]
        k = [len(r.findall(text)) for r in KINDS]
        c = [w.count(x) for x in COMMON_WORDS.get(lang, [])]
        kinds.append([*k, len(text) - sum(k)])
        common.append([*c, len(w) - sum(c)])
        if lang in COMMON_WORDS:  # others have too little text here
            for i, h in enumerate((kinds[-1], common[-1])):
                sums[lang, i] = [a + b for a, b in zip(h, sums.get((lang, i), [0] * len(h)))]
    out = []
    for d, k, c in zip(docs, kinds, common):
        w = WORD.findall(d[1])
        seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(3)}
        far = d[2] in COMMON_WORDS and (len(d[1]) >= 400 and distance(k, sums[d[2], 0]) > 0.3 or len(w) >= 100 and distance(c, sums[d[2], 1]) > 0.35)
        if len(w) >= 50 and 100 * len(covered) <= 50 * len(w) and not far:
            out.append(d)
    return out


def keep_one_of_each(docs):
    sets = []
    for d in docs:
        w = WORD.findall(d[1].translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    of = list(range(len(docs)))
    for _ in docs:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= 75 * len(a | b):
                    of[i] = of[j] = min(of[i], of[j])
    return [min((d for d, c in zip(docs, of) if c == one), key=lambda d: (d[0] is None, d[0])) for one in sorted(set(of))]


def cut_repeats(docs):
    data = [d[1].encode() for d in docs]
    seen = collections.Counter(b[p : p + 240] for b in data for p in range(len(b) - 239))
    out = []
    for d, b in zip(docs, data):
        gone = bytearray(len(b))
        for p in range(len(b) - 239):
            if seen[b[p : p + 240]] > 1:
                gone[p : p + 240] = b"\1" * 240
        for run in list(re.finditer(b"\1+", gone)):
            some = b[run.start() : run.end()]
            if len(some) < 400 and len(re.findall(rb"[^\x20\x09-\x0D]+", some)) < 51:
                gone[run.start() : run.end()] = bytes(len(some))
        # a character of which any byte stays, stays
        left, at = [], 0
        for c in d[1]:
            n = len(c.encode())
            left.append("" if all(gone[at : at + n]) else c)
            at += n
        if not any(gone) or WORD.search("".join(left)):
            out.append((d[0], "".join(left), *d[2:]))
    return out


def mix_sources(docs):
    by = collections.defaultdict(list)
    for d in docs:
        by["" if d[3] is None else "=" + d[3]].append(d)
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    names = sorted(by)
    share = [len(by[s]) ** 0.5 for s in names]
    n = [max(1, round(x / sum(share) * 1000)) for x in share]
    total, nth, left = sum(n), [0] * len(n), [sorted(by[s], key=lambda d: md5(f"{'' if d[0] is None else d[0]}:{md5(d[1])}")) for s in names]
    out, t = [], 0
    while any(left):
        _, i = min((-(-(k + 1) * total // n[i]), i) for i, k in enumerate(nth) if k * total // n[i] <= t)
        out += left[i][:16]
        left[i], nth[i], t = left[i][16:], nth[i] + 1, t + 1
    return out


def pack_sequences(docs, encode):
    out, at = [], 0
    for d in docs:
        ids, start = [*encode(d[1]), 2], 0
        while start < len(ids):
            n = min(len(ids) - start, 4096 - at % 4096)
            out.append((d[0], start, n, zlib.crc32(struct.pack(f"<{n}I", *ids[start : start + n])), len(ids), at // 4096, at % 4096))
            start, at = start + n, at + n
    return out


def test_pipeline_against_plain_python(spark, tmp_path):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    rows = hard_rows()
    extra = [(100 + i, passage(20 + i, 80) + (" " + passage(1, 90) if i % 3 == 0 else ""), ["en", "de", "fr", "es"][i % 4], "abcd"[i % 3]) for i in range(40)]
    # passages of a little more and a little less than 51 words, and one of few long words
    short = [" ".join(passage(70, 200).split()[:n]) for n in (52, 44)] + ["w" * 90 + " " + passage(71, 20) + " " + "é" * 130]
    extra += [(200 + i, passage(80 + i, 70) + "\n" + short[i % 3] + "\n" + passage(90 + i, 70), "en", "e") for i in range(9)]
    rows += [(*r, len(r[1]), *["clash"] * 9) for r in extra]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs, counts = [(r[0], r[1] or "", r[2], r[3]) for r in rows], [len(rows)]
    for stage in (keep_good, keep_one_of_each, cut_repeats, mix_sources):
        docs = stage(docs)
        counts.append(len(docs))
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4] > 30
    left = {d[0]: d[1] for d in docs}
    assert [short[i % 3] in left[200 + i] for i in range(9)] == [False, True, False] * 3
    plain = Tokenizer.from_file(path)
    want = pack_sequences(docs, lambda text: plain.encode(text, add_special_tokens=False).ids)
    got = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert len({p[5] for p in want}) > 2
    assert sorted(got, key=lambda p: p[5:]) == want
