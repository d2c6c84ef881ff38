"""Near-duplicates by MinHash with tensored banding.

A document's set is its distinct five-word shingles.  Two small collections of
minhashes give ``bands`` half keys each (``rows`` minhashes a half key).  A table key
is a pair of half keys, one of each collection, so bands * bands tables need
only 2 * bands * rows minhashes.  Two documents meet in a table if they share
a half key in both collections; every link is then confirmed on full sets.

At similarity 0.75 a pair meets with probability (1 - (1 - 0.75 ** rows) **
bands) ** 2: 0.9997 with the defaults, and 0.99998 at 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlake.llm._common import written
from fleetlake.session import ship_code

#: Bytes of text that are hashed at once.
CHUNK = 600_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct shingle hashes of many texts at once."""

    def __init__(self, words: int = 5) -> None:
        rng = np.random.default_rng(20240229)
        self.words = words
        self.value = rng.integers(1, 2**63, 256, dtype=np.uint64)
        self.value[65:91] = self.value[97:123]  # A-Z as a-z
        blank = np.zeros(256, dtype=bool)
        blank[[9, 10, 11, 12, 13, 32]] = True
        self.blank = blank
        self.base, self.step = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
        self.powers = self.inverse = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            for name, b in (("powers", self.base), ("inverse", pow(self.base, -1, 2**64))):
                steps = np.full(n, b, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """The sorted distinct shingle hashes of each text."""
        data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        self._grow(len(data) + 1)
        blank = self.blank[data]
        edge = np.flatnonzero(np.diff(blank, prepend=True))
        first, last = edge[::2], edge[1::2]  # each text ends with a blank
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.value[data] * self.powers[: len(data)], out=total[1:])
        word = _mix((total[last] - total[first]) * self.inverse[first] + (last - first).astype(np.uint64))
        bound = np.searchsorted(first, ends)
        rolled = np.zeros(len(word), dtype=np.uint64)
        shifted, factor = word, np.uint64(1)
        for t in range(self.words):
            rolled[: len(word) - t] += shifted[t:] * factor if t else shifted
            factor = np.uint64((int(factor) * int(self.step)) % 2**64)
        rolled, out, at = _mix(rolled), [], 0
        for to in bound.tolist():
            n = to - at
            if n >= self.words:
                s = np.sort(rolled[at : to - self.words + 1])
                out.append(s[np.append(True, s[1:] != s[:-1])])
            elif n:
                h = n
                for w in word[at:to].tolist():
                    h = (h * int(self.step) + w) % 2**64
                out.append(_mix(np.array([h], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
            at = to
        return out


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield at, i
            at, size = i, 0
        size += len(t)
    if texts:
        yield at, len(texts)


def signatures(docs: DataFrame, bands: int, rows: int, sketched: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, cls, a, b, sketch): ``cls`` names the set
    of shingles (two documents have one cls if their sets are equal; null for an
    empty set), ``a`` and ``b`` are the half keys, ``sketch`` has four bits of
    each of ``sketched`` minhashes, among them those of the half keys."""
    ship_code()
    text = F.coalesce("text", F.lit(""))

    def sign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng(8)
        n_hashes = max(sketched, 2 * bands * rows)
        flip = rng.integers(0, 2**63, n_hashes, dtype=np.uint64)
        factor = rng.integers(0, 2**63, n_hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        shingler = Shingler()
        for part in parts:
            texts = [t.encode() for t in part["text"]]
            for i, j in _chunks(texts):
                sets = shingler.sets(texts[i:j])
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                out = pd.DataFrame({"doc_id": part["doc_id"].iloc[i:j].astype("Int64"), "text_hash": part["text_hash"].iloc[i:j], "n_shingles": sizes})
                names: list = [None] * len(sets)
                a, b, sketch = names[:], names[:], names[:]
                if len(full):
                    every = np.concatenate([sets[k] for k in full])
                    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    name = np.stack([np.add.reduceat(_mix(every ^ np.uint64(77)), starts), np.bitwise_xor.reduceat(_mix(every ^ np.uint64(99)), starts)], axis=1)
                    least = np.stack([np.minimum.reduceat((every ^ f) * m, starts) for f, m in zip(flip, factor)], axis=1)
                    half = np.zeros((len(full), 2 * bands), dtype=np.uint64)
                    for r in range(rows):
                        half = _mix(half * np.uint64(31) + least[:, r : 2 * bands * rows : rows] + np.arange(2 * bands, dtype=np.uint64))
                    half = half.view(np.int64)
                    nibbles = _mix(least[:, :sketched]) & np.uint64(15)
                    nibbles = np.pad(nibbles, ((0, 0), (0, -nibbles.shape[1] % 16))).reshape(len(full), -1, 16)
                    sketches = (nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64).view(np.int64)
                    for x, k in enumerate(full):
                        names[k], a[k], b[k], sketch[k] = name[x].tobytes(), half[x, :bands], half[x, bands:], sketches[x]
                yield out.assign(cls=names, a=a, b=b, sketch=sketch)

    return (docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash"))
            .mapInPandas(sign, "doc_id long, text_hash long, n_shingles long, cls binary, a array<long>, b array<long>, sketch array<long>"))


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(cls, shingles) from (cls, text)."""
    ship_code()

    def sets(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for part in parts:
            texts = [t.encode() for t in part["text"]]
            for i, j in _chunks(texts):
                yield pd.DataFrame({"cls": part["cls"].iloc[i:j], "shingles": [s.view(np.int64) for s in shingler.sets(texts[i:j])]})

    return docs.select("cls", "text").mapInPandas(sets, "cls binary, shingles array<long>")


def table_rows(classes: DataFrame) -> DataFrame:
    """(key, cls, met): the classes in each bucket of two or more, and how many
    these are.

    A key is shared only if both its halves are, so half keys are counted
    first and only shared halves are paired."""
    halves = classes.select("cls", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("h")), F.struct(F.lit(1).alias("side"), F.col("b").alias("h")))).alias("s")).select("cls", "s.side", F.explode("s.h").alias("h"))
    shared = halves.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1").select("h")
    mine = halves.join(shared, "h").groupBy("cls").agg(
        F.collect_set(F.when(F.col("side") == 0, F.col("h"))).alias("a"), F.collect_set(F.when(F.col("side") == 1, F.col("h"))).alias("b"))
    keys = written(mine.select("cls", "b", F.explode("a").alias("x")).select("cls", "x", F.explode("b").alias("y")).select(F.xxhash64("x", "y").alias("key"), "cls"), "tables")
    shared = keys.groupBy("key").agg(F.count("*").alias("met")).filter("met > 1")
    return written(keys.join(shared, "key"), "buckets")


def alike(n_hashes: int, least: int):
    """A condition on rows (mx, my): ``least`` of ``n_hashes`` four-bit minhashes agree."""
    def differ(i: int):
        x = F.get("mx", F.lit(i)).bitwiseXOR(F.get("my", F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    words = -(-n_hashes // 16)
    return sum((differ(i) for i in range(1, words)), differ(0)) <= n_hashes - least


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose full sets have at least ``percent`` % similarity."""
    both = (pairs.join(sets.select(F.col("cls").alias("x"), F.col("shingles").alias("p")), "x")
            .join(sets.select(F.col("cls").alias("y"), F.col("shingles").alias("q")), "y")
            .withColumn("common", F.size(F.array_intersect("p", "q")).cast("long")))
    return both.filter(100 * F.col("common") >= percent * (F.size("p") + F.size("q") - F.col("common"))).select("x", "y")


def components(edges: DataFrame) -> DataFrame:
    """(cls, root): the least cls that edges (x, y) reach, for every end of an
    edge.  Each round takes the least root of the neighbours, then the root's
    own root; every round is written."""
    links = written(edges.select("x", "y").union(edges.select("y", "x")).distinct(), "links")
    roots = written(links.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("cls"), F.least("x", "y").alias("root")), "roots")
    while True:
        near = links.join(roots.withColumnRenamed("cls", "y"), "y").groupBy("x").agg(F.min("root").alias("near"))
        new = roots.join(near.withColumnRenamed("x", "cls"), "cls").select("cls", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        over = new.select(F.col("cls").alias("root"), F.col("root").alias("next"))
        jumped = written(new.join(over, "root", "left").select("cls", "old", F.least("root", "next").alias("root")), "roots")
        roots = jumped.select("cls", "root")
        if jumped.filter("old != root").isEmpty():
            return roots


def linked(docs: DataFrame, bands: int = 16, rows: int = 3, percent: int = 75, sketched: int = 384, agree: int = 262) -> DataFrame:
    """One row for each document: (doc_id, text_hash, n_shingles, component_id,
    kept).

    ``component_id`` is the least doc_id among the documents that confirmed
    links reach; ``kept`` says that it is the document's own.  Null and
    wordless texts have an empty set and are linked with nothing; null doc_ids
    are never the least unless alone.  Repeated rows are equal documents.

    Documents with equal sets are one class and need no links.  In a bucket,
    first every class is held against the one that meets most others in all
    tables: a group of copies is linked through its centre.  Only classes of
    buckets that are then not of one component are held against those of other
    components.  A pair goes on to its full sets if its sizes allow the
    similarity and ``agree`` of its ``sketched`` minhashes are the same in four
    bits (at similarity 0.75, 294 of 384 are expected, and fewer than 262 have
    a probability of about 0.0001)."""
    sigs = written(signatures(docs, bands, rows, sketched), "signatures")
    classes = written(sigs.filter("cls is not null").groupBy("cls").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.first("n_shingles").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"), F.first("sketch").alias("sketch")), "classes")
    buckets = table_rows(classes)
    reps = classes.join(buckets.select("cls").distinct(), "cls").select("cls", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash"))
    text = F.coalesce("text", F.lit(""))
    texts = (docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash"))
             .join(reps, (F.col("text_hash") == F.col("rep_hash")) & F.col("doc_id").eqNullSafe(F.col("rep_id")))
             .select("cls", "text").dropDuplicates(["cls"]))
    sets = written(shingle_sets(texts), "sets")

    # a group of copies is linked through its centre
    about = classes.select("cls", "n", "sketch")
    of = lambda c: about.select(F.col("cls").alias(c), F.col("n").alias("n" + c), F.col("sketch").alias("m" + c))
    near = (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")) & alike(sketched, agree)
    central = buckets.join(buckets.groupBy("cls").agg(F.sum("met").alias("meets")), "cls")
    lead = central.groupBy("key").agg(F.max(F.struct("meets", "cls")).alias("lead")).select("key", F.col("lead.cls").alias("y"))
    pairs = buckets.select("key", F.col("cls").alias("x")).join(lead, "key").filter("x != y").select("x", "y").distinct()
    near_pairs = pairs.join(of("x"), "x").join(of("y"), "y").filter(near).select("x", "y")
    edges = written(confirmed(near_pairs, sets, percent), "edges")
    roots = components(edges)

    # buckets that are not of one component: their classes meet once more, each pair in the first half key that it shares
    rooted = buckets.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("members")).filter("lo != hi and members > 2").select("key")
    rest = rooted.join(mixed, "key").select("cls", "root").distinct()
    rest = written(rest.join(classes.select("cls", "n", "sketch", "a"), "cls").select("cls", "root", "n", "sketch", "a", F.posexplode("a").alias("ix", "half")), "rest")
    one, two = (rest.select("half", "ix", F.col("cls").alias(c), F.col("root").alias("r" + c), F.col("n").alias("n" + c), F.col("sketch").alias("m" + c), F.col("a").alias("a" + c)) for c in "xy")
    first = F.array_position(F.zip_with("ax", "ay", lambda p, q: p == q), True) == F.col("ix") + 1
    pairs = one.join(two.drop("ix"), "half").filter((F.col("rx") != F.col("ry")) & (F.col("x") < F.col("y")) & near & first).select("x", "y")
    more = written(confirmed(pairs, sets, percent), "edges")
    roots = components(edges.union(more))

    least = (classes.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls")))
    of = least.select("cls", "root").join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("cls", "component_id")
    return (sigs.select("doc_id", "text_hash", "n_shingles", "cls").join(of, "cls", "left")
            .select("doc_id", "text_hash", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def near_query(docs: DataFrame) -> DataFrame:
    return linked(docs).select("doc_id", "n_shingles", "component_id", "kept")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns; of rows with one
    doc_id and text, one."""
    stay = linked(docs).filter("kept").select(F.col("doc_id").alias("stay_id"), F.col("text_hash").alias("stay_hash")).distinct()
    rows = docs.select(F.struct("*").alias("kept_row"), F.col("doc_id").alias("row_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_hash"))
    here = rows.join(stay, F.col("row_id").eqNullSafe(F.col("stay_id")) & (F.col("row_hash") == F.col("stay_hash")), "left_semi")
    return here.withColumn("copy", F.row_number().over(Window.partitionBy("row_id", "row_hash").orderBy("row_id"))).filter("copy = 1").select("kept_row.*")
