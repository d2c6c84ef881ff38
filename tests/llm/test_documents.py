"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing
names, against brute force."""

import collections
import hashlib
import heapq
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions

from fleetlake.llm import minhash, mixing, packing, quality, repeats, sharding
from llm_rows import DOCS, hard_rows

ROWS = hard_rows()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_mixing_is_earliest_deadline_first(spark, hard, nothing):
    got = mixing.mix(hard, __import__("pyspark.sql.functions", fromlist=["struct"]).struct("doc_id", "source"), weights={"a": 3, "b": 1, "c": 1}, block_rows=2, period=10).select("kept_as.*", "block", "release", "deadline", "slot", "position").collect()
    assert sorted(r.position for r in got) == list(range(len(ROWS)))
    names = sorted({r[3] for r in ROWS}, key=lambda s: "" if s is None else "=" + s)
    weights = {"a": 3, "b": 1, "c": 1}
    period = max(10, 8 * len(names))
    n = [max(1, round(weights[s] / 5 * period)) if s in weights else 0 for s in names]
    total, following, slots = sum(n), [0] * len(n), collections.defaultdict(list)
    for t in range(total * 20):
        _, i = min((-(-(k + 1) * total // n[i]), i) for i, k in enumerate(following) if n[i] and k * total // n[i] <= t)
        slots[names[i]].append(t)
        following[i] += 1
        for j, k in enumerate(following):
            assert abs(k - (t + 1) * n[j] / total) < 1
    mixed = sorted(got, key=lambda r: r.position)
    some = [r for r in mixed if r.source in weights]
    assert mixed[:len(some)] == some and [r.slot for r in some] == sorted(r.slot for r in some)
    for r in some:
        assert r.slot == slots[r.source][r.block] and r.release <= r.slot < r.deadline
    rest = mixed[len(some):]  # sources without weight follow, one by one
    assert [r.source for r in rest] == sorted([r.source for r in rest], key=lambda s: s or "") and all(r.slot is None and r.release is None and r.deadline is None for r in rest)
    assert mixing.mix_query(nothing).count() == 0 and mixing.mixed(nothing).count() == 0
    assert sorted(map(str, mixing.mixed(hard).collect())) == sorted(map(str, hard.collect()))


def test_mixing_of_any_number_of_sources(spark):
    # 1500 sources, one with half of all rows, against a plain heap
    docs = spark.range(6000).selectExpr("id AS doc_id", "if(id % 2 = 0, 'hot', concat('s', pmod(id * 7919, 1499))) AS source", "concat('t', id) AS text").repartition(4)
    got = mixing.mix_query(docs).collect()
    assert sorted(r.position for r in got) == list(range(6000)) and [r.slot for r in sorted(got, key=lambda r: r.position)] == sorted(r.slot for r in got)
    rows = collections.Counter(r.source for r in got)
    names, all_ = sorted(rows), sum(v**0.5 for v in rows.values())
    n = [max(1, round(rows[s] ** 0.5 / all_ * 8 * len(names))) for s in names]
    total = sum(n)
    released, due, slots = collections.defaultdict(list), [], {}
    for i, m in enumerate(n):
        for k in range(m):
            released[k * total // m].append((-(-(k + 1) * total // m), i, k))
    for t in range(total):
        for job in released[t]:
            heapq.heappush(due, job)
        deadline, i, k = heapq.heappop(due)
        assert t < deadline
        slots[names[i], k] = t
    place = {s: i for i, s in enumerate(names)}
    for r in got:
        m = n[place[r.source]]
        assert r.slot == r.block // m * total + slots[r.source, r.block % m]


def test_sources_without_weight_take_no_share(spark):
    docs = spark.range(900).selectExpr("id AS doc_id", "if(id < 400, 'main', concat('z', id)) AS source", "concat('t', id) AS text")
    keep = functions.struct("doc_id", "source")
    got = sorted(mixing.mix(docs, keep, weights={"main": 1.0}).select("kept_as.*", "slot", "position").collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(900))
    assert all(r.source == "main" and r.slot == r.position // 16 for r in got[:400]) and all(r.slot is None for r in got[400:])
    # if no source weighs anything, all weigh the same
    got = mixing.mix(docs, keep, weights={}).select("kept_as.*", "slot", "position").collect()
    assert sorted(r.position for r in got) == list(range(900)) and all(r.slot is not None for r in got)


def test_sharding_keeps_groups_together_and_is_balanced(spark, hard, nothing):
    got = sharding.shard_query(hard).collect()
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted((str(x[0]), len((x[1] or "").encode()) + 8, zlib.crc32((x[1] or "").encode())) for x in ROWS)
    home = collections.defaultdict(set)
    for r in got:
        home[r.text_crc32, r["size"]].add(r.shard)
    assert all(len(s) == 1 for s in home.values())
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    many = spark.range(5000).selectExpr("id AS doc_id", "repeat('x', cast(id % 97 as int)) || id AS text")
    loads = [r["sum(size)"] for r in sharding.shard(many).groupBy("shard").sum("size").collect()]
    assert len(loads) == 24 and max(loads) - min(loads) <= 200
    assert sharding.shard_query(nothing).count() == 0


def test_quality_counts(hard, nothing):
    got = collections.defaultdict(list)
    for r in quality.quality_query(hard).collect():
        got[r.doc_id].append(tuple(r)[1:7])
    for x in ROWS:
        text = x[1] or ""
        w = WORD.findall(text)
        seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [ln for ln in text.split("\n") if WORD.search(ln)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert want in got[x[0]], x[0]
    assert quality.quality_query(nothing).count() == 0
    kept = quality.keep_good(hard)
    assert kept.columns == hard.columns and kept.filter("doc_id = 12").isEmpty()


def of_many_languages():
    import random

    rng = random.Random(6)
    latin, cyrillic, marks = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщыьэюя", "#%&*+=~^"
    prose = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(150))
    langs = [("ru", cyrillic, 200)] + [("nl", latin, 200)] + [(None, latin, 10), (None, cyrillic, 3), ("other", latin, 5), ("uk", cyrillic, 2)]
    rows = [(lang, prose(letters)) for lang, letters, n in langs for _ in range(n)] + [("nl", prose(marks)), ("ru", prose(latin))]
    return [(i, text, lang) for i, (lang, text) in enumerate(rows)]


def test_clean_text_of_any_language_is_kept(spark):
    rows = of_many_languages()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in quality.keep_good(docs).collect()}
    assert kept == set(range(len(rows) - 2))


def test_sql_of_quality_rules_knows_all_languages(spark):
    import duckdb
    import pyarrow as pa

    rows = of_many_languages()
    got = quality.quality_query(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "lang": pa.array([r[2] for r in rows], pa.string())}))
    cursor = con.execute(quality.QUALITY_SQL)
    assert rows_of(got.columns, map(tuple, got.collect())) == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def components():
    sets = []
    for x in ROWS:
        w = WORD.findall((x[1] or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []))
    of = list(range(len(ROWS)))
    for _ in ROWS:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    of[i] = of[j] = min(of[i], of[j])
    least = {c: min((ROWS[i][0] for i in range(len(ROWS)) if of[i] == c and ROWS[i][0] is not None), default=None) for c in set(of)}
    return [(ROWS[i][0], len(sets[i]), least[of[i]] if sets[i] else ROWS[i][0]) for i in range(len(ROWS))]


def test_near_duplicates(hard, nothing):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_query(hard).collect()]
    assert sorted(map(str, got)) == sorted(map(str, components()))
    stay = minhash.one_of_each(hard)
    assert stay.columns == hard.columns
    assert sorted(str(r.doc_id) for r in stay.collect()) == sorted({str(i) for i, _, c in components() if i == c})
    assert minhash.near_query(nothing).count() == 0 and minhash.one_of_each(nothing).count() == 0


@pytest.mark.parametrize("many", [20_000, 1])
def test_repeats(hard, nothing, many, monkeypatch):
    monkeypatch.setattr(repeats, "MANY_FRAMES", many)
    data = [(x[1] or "").encode() for x in ROWS]
    seen = collections.Counter(b[p : p + 400] for b in data for p in range(len(b) - 399))
    want = []
    for x, b in zip(ROWS, data):
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - 399):
            if seen[b[p : p + 400]] > 1:
                gone[p : p + 400] = True
        runs = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        want.append((x[0], len(b), int(gone.sum()), runs, hashlib.sha256(bytes(v for v, g in zip(b, gone) if not g)).hexdigest()))
    got = [tuple(r) for r in repeats.repeats_query(hard).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    if many == 1:
        return
    assert repeats.repeats_query(nothing).count() == 0 and repeats.without_repeats(nothing).count() == 0
    left = repeats.without_repeats(hard)
    assert left.schema.names == hard.schema.names
    by = {r.doc_id: r for r in left.collect()}
    assert 6 not in by and 13 not in by and by[1].text is None and by[2].text == "" and by[10].n_chars == len(by[10].text) < len(ROWS[10][1]) - 400


def test_maximal_repeats_have_all_their_places(spark):
    a, b = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(500)), "".join(chr(97 + (i * i * i + i // 5) % 26) for i in range(450))
    texts = ["P" + a + "Q", "R" + a + "S" + b, "T" + b + "U", "V" + a + "W"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    places, suffixes, _ = repeats.repeats(repeats.distinct_texts(docs))
    spans = collections.defaultdict(set)
    for r in places.join(suffixes, "id").collect():
        t = next(t for t in texts if hashlib.md5(t.encode()).digest() == bytes(r.tid))
        spans[t[r.lo + r.offset : r.lo + r.offset + r.length]].add((t, r.lo + r.offset))
    for found in spans:
        want = {(t, i) for t in texts for i in range(len(t)) if t.startswith(found, i)}
        assert len(found) >= 400 and len(want) > 1


def test_groups_and_their_members_equal_brute_force(spark):
    import random

    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    x, y = word(60), word(45)
    texts = [word(9) + x + word(7), word(5) + x + y + word(3), word(8) + x[10:] + y[:30], word(6) + y + word(4), x[:35] + word(5), word(2) + x[:35] + word(8)] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    least = 20
    places, members, groups = repeats.repeats(repeats.distinct_texts(docs), least, 8)
    text = {hashlib.md5(t.encode()).digest(): t for t in texts}
    lies = collections.defaultdict(set)
    for r in places.collect():
        lies[bytes(r.id)].add((text[bytes(r.tid)], r.lo))
    members, ranked = members.collect(), collections.defaultdict(dict)
    for r in members:
        if r.rank is not None:
            ranked[r.cls][r.rank] = r
    covered, longest = set(), {}
    for g in groups.collect():
        if g.rank is None:
            starts = [(t, lo) for t, lo in lies[bytes(g.id)]]
        else:
            inside = [r for k, r in ranked[g.cls].items() if g.rank <= k <= g.last_rank]
            starts = [(t, lo + r.offset) for r in inside for t, lo in lies[bytes(r.id)]]
            for r in inside:
                longest[g.cls, r.rank] = max(longest.get((g.cls, r.rank), 0), g.length)
        spelled = {t[i : i + g.length] for t, i in starts}
        assert len(spelled) == 1 and len(next(iter(spelled))) == g.length >= least and len(set(starts)) > 1
        covered |= {(t, i + k) for t, i in starts for k in range(g.length)}
    assert {(c, k): r.length for c, of in ranked.items() for k, r in of.items()} == longest
    seen = collections.Counter(t[i : i + least] for t in set(texts) for i in range(len(t) - least + 1))
    assert covered == {(t, i + k) for t in set(texts) for i in range(len(t) - least + 1) if seen[t[i : i + least]] > 1 for k in range(least)}


def test_groups_of_a_common_passage_are_sorted_by_many_tasks(spark, monkeypatch):
    import random

    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    passage, other = word(470), word(430)
    texts = [word(rng.randrange(1, 40)) + passage + word(rng.randrange(1, 40)) + (other + word(9) if i % 7 == 0 else "") for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def groups(many):
        monkeypatch.setattr(repeats, "MANY_FRAMES", many)
        _, suffixes, found = repeats.repeats(repeats.distinct_texts(docs))
        found = found.filter("rank is not null")
        places = collections.defaultdict(dict)
        for r in suffixes.filter("rank is not null").collect():
            assert r.rank not in places[r.cls]
            places[r.cls][r.rank] = (bytes(r.id)[:16], r.offset, r.length)
        out = [(g.length, frozenset(x[:2] for k, x in places[g.cls].items() if g.rank <= k <= g.last_rank)) for g in found.collect()]
        longest = {x[:2]: x[2] for of in places.values() for x in of.values()}
        return collections.Counter(out), longest, max(len({k >> 32 for k in of}) for of in places.values())

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        want, lengths, tasks = groups(20_000)
        assert tasks == 1 and max(len(of) for _, of in want) >= 300
        assert set(want.values()) == {1}
        got, others, tasks = groups(20)
        assert got == want and others == lengths and tasks > 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_packing_round_trip(hard, nothing):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    pieces = packing.pack(hard, path, length=64).collect()
    streams = collections.defaultdict(list)
    for p in pieces:
        streams[p.sequence_id].append((p.offset, list(memoryview(bytes(p.ids)).cast("I"))))
    stream = []
    for s in sorted(streams):
        at = 0
        for offset, ids in sorted(streams[s]):
            assert offset == at
            at += len(ids)
            stream += ids
        assert at == 64 or s == max(streams)
    want = sorted([*plain.encode(x[1] or "", add_special_tokens=False).ids, 2] for x in ROWS)
    docs, now = [], []
    for i in stream:
        now.append(i)
        if i == 2:
            docs.append(now)
            now = []
    # id 2 occurs in texts too, so documents are compared as one stream
    assert len(stream) == sum(map(len, want)) and collections.Counter(stream) == collections.Counter(i for d in want for i in d)
    assert sorted((str(p.doc_id), p.start) for p in pieces if p.start == 0) == sorted((str(x[0]), 0) for x in ROWS)
    assert packing.piece_digest(packing.pack(nothing, path)).count() == 0


def test_schemas_of_empty_tables(nothing):
    assert DOCS.names == nothing.columns


def in_duckdb(sql, rows):
    """Rows of the SQL over ``rows`` as documents, as sets of dicts' items."""
    import duckdb
    import pyarrow as pa

    documents = pa.table({f.name: pa.array([r[i] for r in rows], pa.int64() if f.dataType.simpleString() == "bigint" else pa.string()) for i, f in enumerate(DOCS)})
    con = duckdb.connect()
    con.register("documents", documents)
    cursor = con.execute(sql)
    return rows_of([d[0] for d in cursor.description], cursor.fetchall())


def rows_of(names, rows):
    return collections.Counter(frozenset(zip(names, r)) for r in rows)


@pytest.mark.parametrize("query, sql", [(mixing.mix_query, mixing.MIX_SQL), (quality.quality_query, quality.QUALITY_SQL)])
def test_sql_gives_the_same_rows(query, sql, hard, nothing):
    got = query(hard)
    assert rows_of(got.columns, map(tuple, got.collect())) == in_duckdb(sql, ROWS)
    assert query(nothing).count() == 0 and not in_duckdb(sql, [])
