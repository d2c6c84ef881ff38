"""Repeated passages by suffix arrays and their common-prefix interval trees.

A suffix array over a whole corpus cannot be built in one place, so suffixes
are dealt to independent arrays such that equal ``min_bytes``-byte prefixes
always meet.  Each prefix is dealt by its anchor: of the ``gram``-byte strings
in it, the one with the least hash (the first of equals).  Equal prefixes have
equal anchors at equal places.  Neighbouring suffixes with one anchor form a
frame: ``starts`` suffixes and the bytes that their prefixes cover.

1. Frames of all distinct texts are written, without their bytes.  An anchor
   that occurs once cannot repeat.
2. Frames with equal bytes are one frame with many places, and are repeats as
   they are.  Only anchors with two or more different frames need their bytes,
   and only those of one place of each frame.
3. For each such anchor the suffixes of its frames whose prefix occurs again
   and can't be extended to the left as a group are sorted (the suffix array),
   neighbours' common prefixes are taken, and a stack scan lists the intervals
   of the tree: a group of all suffixes that share ``length`` bytes.  A group
   whose left neighbours differ, or begin a frame, is a maximal repeat within
   its frames; longer repeats come as one group for each frame they cross.
4. Every suffix is put into the innermost (longest) group that holds it.  What
   is removed are the occurrences of these groups: an interval whose left
   neighbours are all the same is covered by the group that begins before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlake.llm._common import written
from fleetlake.session import ship_code

MIN_BYTES, GRAM = 400, 100
#: What the pipeline cuts: passages of over 50 words.  51 words of prose have about 270 to 390 bytes.
PASSAGE_WORDS, PASSAGE_BYTES, PASSAGE_GRAM = 51, 240, 60
WORD = "[^\\x20\\x09-\\x0D]+"
#: Bytes that are looked at at once; longer texts are cut into overlapping pieces.
CHUNK = 300_000
#: Frames of one anchor above which its suffixes are sorted by many tasks.
MANY_FRAMES = 20_000
#: Anchors that can each have more than this part of all rows are fewer than this.
COMMON = 1000
#: Starts that one look at their common bytes can rule out at once.
SLICE = 32


class Rolling:
    """Hashes of all substrings of a buffer from running sums, modulo 2**64."""

    def __init__(self, seed: int, base: int) -> None:
        self.value = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64)
        self.base = base
        self.powers = self.inverse = np.ones(1, dtype=np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        n = len(data) + 1
        if len(self.powers) < n:
            for name, b in (("powers", self.base), ("inverse", pow(self.base, -1, 2**64))):
                steps = np.full(n, b, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        total = np.zeros(n, dtype=np.uint64)
        np.cumsum(self.value[data] * self.powers[: n - 1], out=total[1:])
        return total

    def spans(self, sums: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        x = (sums[last] - sums[first]) * self.inverse[first]
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` hashes, the position of its first least."""
    n = len(hashes) - width + 1
    blocks = -(-len(hashes) // width)
    place = np.arange(width, dtype=np.uint64)
    bits = np.uint64(int(width).bit_length())
    keys = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    keys[: len(hashes)] = hashes
    keys = ((keys.reshape(blocks, width) >> bits) << bits) | place
    to_end = np.minimum.accumulate(keys[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    from_start = np.minimum.accumulate(keys, axis=1).ravel()[width - 1 : width - 1 + n]
    low = (np.uint64(1) << bits) - np.uint64(1)
    at = np.arange(n)
    return np.where((to_end >> bits) <= (from_start >> bits),
                    at // width * width + (to_end & low).astype(np.int64), (at + width - 1) // width * width + (from_start & low).astype(np.int64))


def frames(texts: DataFrame, min_bytes: int, gram: int) -> DataFrame:
    """(tid, lo, anchor, at, starts, f1, f2) from (tid, bytes): the frame
    begins at byte ``lo``, its anchor ``at`` bytes further, and (f1, f2) is a
    hash of its bytes."""
    ship_code()

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = Rolling(1, 0x9E3779B97F4A7C15), Rolling(2, 0xC2B2AE3D27D4EB4F)

        def of(pieces: list[tuple[bytes, int, bytes]]) -> pd.DataFrame:
            data = np.frombuffer(b"".join(p for _, _, p in pieces), dtype=np.uint8)
            sizes = np.array([len(p) for _, _, p in pieces])
            ends = np.cumsum(sizes)
            sa, sb = a.sums(data), b.sums(data)
            grams = np.arange(len(data) - gram + 1)
            h = a.spans(sa, grams, grams + gram)
            at = anchors(h, min_bytes - gram + 1)
            piece = np.repeat(np.arange(len(pieces)), sizes)[: len(at)]
            p = np.flatnonzero(np.arange(len(at)) + min_bytes <= ends[piece])
            new = np.flatnonzero(np.append(True, (at[p][1:] != at[p][:-1]) | (p[1:] != p[:-1] + 1)))
            lo, n = p[new], np.diff(np.append(new, len(p)))
            hi, where = lo + n - 1 + min_bytes, piece[lo]
            base = ends - sizes - np.array([o for _, o, _ in pieces])
            return pd.DataFrame({"tid": [pieces[i][0] for i in where], "lo": lo - base[where], "anchor": h[at[lo]].view(np.int64), "at": (at[lo] - lo).astype(np.int32),
                                 "starts": n.astype(np.int32), "f1": a.spans(sa, lo, hi).view(np.int64), "f2": b.spans(sb, lo, hi).view(np.int64)})

        for part in parts:
            held, size = [], 0
            for tid, text in zip(part["tid"], part["bytes"]):
                for o in range(0, max(0, len(text) - min_bytes + 1), CHUNK):
                    piece = text[o : o + CHUNK + min_bytes - 1]
                    if held and size + len(piece) > 2 * CHUNK:
                        yield of(held)
                        held, size = [], 0
                    held.append((tid, o, piece))
                    size += len(piece)
            if held:
                yield of(held)

    return texts.select("tid", "bytes").mapInPandas(cut, "tid binary, lo long, anchor long, at int, starts int, f1 long, f2 long")


def _step(stack: list, now: int, last: int, lo: int, hi: int) -> list[tuple[int, int, int]]:
    """One step of the stack scan: suffix ``last``, with left neighbours from
    ``lo`` to ``hi``, shares ``now`` bytes (0: too few) with the next one.  The
    intervals (first, last, length) that end here and whose left neighbours
    are not all the same; ``stack`` holds the open ones."""
    found, first = [], last
    while stack and stack[-1][0] > now:
        length, first, x, y = stack.pop()
        lo, hi = min(lo, x), max(hi, y)
        if lo != hi:
            found.append((first, last, length))
    if now:
        if stack and stack[-1][0] == now:
            _, first, x, y = stack.pop()
            lo, hi = min(lo, x), max(hi, y)
        stack.append((now, first, lo, hi))
    return found


def _scan(lcp: list[int], lo: list[int], hi: list[int], least: int) -> list[tuple[int, int, int]]:
    """The intervals (first, last, length) with ``length`` >= ``least`` of the
    common-prefix interval tree whose left neighbours are not all the same.
    ``lcp[i]`` is what suffixes i - 1 and i share; ``lo`` and ``hi`` the
    smallest and greatest neighbour of each."""
    found, stack = [], []  # (length, first, smallest and greatest left neighbour)
    for i in range(len(lo)):
        found += _step(stack, lcp[i + 1] if i + 1 < len(lo) and lcp[i + 1] >= least else 0, i, lo[i], hi[i])
    return found


def _innermost(ranks: list[int], groups: list[tuple[int, int, int]]) -> list[int]:
    """For ascending ranks, the place in ``groups`` of the innermost group
    (first, last, length) that holds each; -1 where there is none.  Groups lie
    inside of each other or apart."""
    order = sorted(range(len(groups)), key=lambda g: (groups[g][0], -groups[g][1]))
    found, around, k = [], [], 0
    for rank in ranks:
        while k < len(order) and groups[order[k]][0] <= rank:
            around.append(order[k])
            k += 1
        while around and groups[around[-1]][1] < rank:
            around.pop()
        found.append(around[-1] if around else -1)
    return found


def _shared(s: bytes, t: bytes) -> int:
    """How many bytes two strings share at their beginning."""
    n = min(len(s), len(t))
    if s[:n] != t[:n]:
        return int((np.frombuffer(s, np.uint8, n) != np.frombuffer(t, np.uint8, n)).argmax())
    return n


def _suffix_array(cls: np.ndarray, contents: list[bytes], starts: np.ndarray, min_bytes: int, rolling: Rolling) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """For frames sorted by class: frame and offset of the suffixes in order,
    the length of the innermost group of each (0: none), and the groups as
    (first, last, length) of the order."""
    data = np.frombuffer(b"".join(contents), dtype=np.uint8)
    sizes = np.array([len(c) for c in contents])
    base = np.cumsum(sizes) - sizes
    sums = rolling.sums(data)
    frame = np.repeat(np.arange(len(contents)), starts)
    offset = np.arange(len(frame)) - np.repeat(np.cumsum(starts) - starts, starts)
    pos = base[frame] + offset
    h = rolling.spans(sums, pos, pos + min_bytes) ^ (cls[frame].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    group = np.cumsum(np.append(True, ~same)) - 1
    before = np.where(offset[order] > 0, data[np.maximum(pos[order] - 1, 0)].astype(np.int64), 1000 + np.arange(len(order)))
    bound = np.flatnonzero(np.append(True, ~same))
    several = np.diff(np.append(bound, len(order))) > 1
    differs = np.minimum.reduceat(before, bound) != np.maximum.reduceat(before, bound)
    chosen = order[(several & differs)[group]]
    suffixes = sorted(((int(cls[f]), contents[f][o:], int(f), int(o)) for f, o in zip(frame[chosen], offset[chosen])))
    if not suffixes:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), []
    lcp = [0]
    for (c, s, *_), (d, t, *_) in zip(suffixes, suffixes[1:]):
        lcp.append(_shared(s, t) if c == d else 0)
    left = [contents[f][o - 1] if o else 1000 + i for i, (_, _, f, o) in enumerate(suffixes)]
    groups = _scan(lcp, left, left, min_bytes)
    lengths = np.array([*(g[2] for g in groups), 0])  # the last one for -1
    return np.array([s[2] for s in suffixes]), np.array([s[3] for s in suffixes]), lengths[_innermost(range(len(suffixes)), groups)], groups


def tree_rows(reps: DataFrame, min_bytes: int) -> DataFrame:
    """From different frames (cls, id, starts, content), the rows of each
    class's tree: suffixes (cls, rank, id, offset, length), ``length`` being
    that of the innermost group there, and groups (cls, rank, last_rank,
    length), which hold the suffixes of their class with ranks from ``rank`` to
    ``last_rank``."""
    ship_code()

    def build(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rolling = Rolling(3, 0xD6E8FEB86659FD93)

        def of(rows: pd.DataFrame) -> pd.DataFrame:
            cls, ids = rows["cls"].to_numpy(), rows["id"].to_numpy()
            frame, offset, longest, groups = _suffix_array(cls, rows["content"].tolist(), rows["starts"].to_numpy(), min_bytes, rolling)
            rank = np.arange(len(frame))
            some = longest > 0
            return pd.concat([
                pd.DataFrame({"cls": cls[frame[some]], "rank": rank[some], "id": ids[frame[some]], "offset": offset[some], "last_rank": None, "length": longest[some]}),
                pd.DataFrame({"cls": [cls[frame[g[0]]] for g in groups], "rank": [g[0] for g in groups], "id": None, "offset": None, "last_rank": [g[1] for g in groups], "length": [g[2] for g in groups]})]
                ).astype({"rank": "Int64", "offset": "Int64", "last_rank": "Int64", "length": "Int64", "cls": "Int64"})

        held: list[pd.DataFrame] = []
        size = 0
        for part in parts:  # sorted by class
            held.append(part)
            size += int(part["content"].str.len().sum())
            if size > 2 * CHUNK:
                rows = pd.concat(held, ignore_index=True)
                rest = rows["cls"] == rows["cls"].iloc[-1]  # the last class may go on
                if not rest.all():
                    yield of(rows[~rest].reset_index(drop=True))
                    rows = rows[rest].reset_index(drop=True)
                held, size = [rows], int(rows["content"].str.len().sum()) if not rest.all() else 0
        if held:
            yield of(pd.concat(held, ignore_index=True))

    return (reps.select("cls", "id", "starts", "content").repartition("cls").sortWithinPartitions("cls")
            .mapInPandas(build, "cls long, rank long, id binary, offset long, last_rank long, length long"))


class _Border:
    """What a part of the suffix array tells to its neighbours about a class
    that touches a border: runs of suffixes (first, last, smallest and greatest
    left neighbour), set apart where the shared bytes are a strict minimum of
    those before, or of those behind.  An interval that touches the border
    begins or ends at such a place, so there are at most two runs for each
    length."""

    def __init__(self) -> None:
        self.runs: list[list[int]] = []  # (shared with the run before, minimum of those before, first, last, lo, hi)
        self.least = 2**31 - 1

    def add(self, shared: int, rank: int, left: int) -> None:
        while len(self.runs) > 1 and not self.runs[-1][1] and self.runs[-1][0] >= shared:
            *_, last, lo, hi = self.runs.pop()
            before = self.runs[-1]
            before[3:] = [last, min(before[4], lo), max(before[5], hi)]
        lowest = shared < self.least
        self.least = min(self.least, shared) if self.runs else self.least
        self.runs.append([shared, lowest, rank, rank, left, left])


TREE = "cls long, rank long, id binary, offset long, last_rank long, length long"
SCANNED = f"{TREE}, part long, first long, last long, shared long, lo long, hi long, head binary, tail binary"
#: Ranks of a part begin at its number times this.
PART = 2**32


def _types(schema: str) -> dict[str, str]:
    return {c.split()[0]: "Int64" for c in schema.split(", ") if c.endswith(" long")}


def _windows(many: DataFrame, min_bytes: int) -> DataFrame:
    """(cls, id, offset, h1, h2, before): hashes of the ``min_bytes`` bytes at
    the starts of each frame, and what stands before them (a frame's first
    start: a number of its own).  Starts are left out where the bytes that
    ``SLICE`` of them have in common occur once."""
    ship_code()
    cores = (many.withColumn("slice", F.explode(F.expr(f"sequence((at - starts + 1) div {SLICE}, at div {SLICE})")))
             .select("id", "slice", F.xxhash64("cls", "slice", F.expr(f"substring(content, cast(at - slice * {SLICE} + 1 as int), {min_bytes - SLICE + 1})")).alias("core")))
    again = written(cores.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select("core"), "cores")
    looked_at = many.join(cores.join(again, "core").groupBy("id").agg(F.collect_set("slice").alias("slices")), "id")

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = Rolling(4, 0x9E3779B97F4A7C15), Rolling(5, 0xC2B2AE3D27D4EB4F)
        for rows in parts:
            for i in range(0, len(rows), 500):
                part = rows.iloc[i : i + 500]
                starts, contents = part["starts"].to_numpy(), part["content"].tolist()
                data = np.frombuffer(b"".join(contents), dtype=np.uint8)
                sizes = np.array([len(c) for c in contents])
                sa, sb = a.sums(data), b.sums(data)
                frame = np.repeat(np.arange(len(contents)), starts)
                offset = np.arange(len(frame)) - np.repeat(np.cumsum(starts) - starts, starts)
                of_slice = (part["at"].to_numpy()[frame] - offset) // SLICE
                most = int(of_slice.max()) + 1
                wanted = np.zeros((len(contents), most), dtype=bool)
                for k, x in enumerate(part["slices"]):
                    wanted[k, [y for y in x if y < most]] = True
                some = wanted[frame, of_slice]
                frame, offset = frame[some], offset[some]
                pos = (np.cumsum(sizes) - sizes)[frame] + offset
                own = np.array([1000 + int.from_bytes(x[:7], "big") for x in part["id"]])
                yield pd.DataFrame({"cls": part["cls"].to_numpy()[frame], "id": part["id"].to_numpy()[frame], "offset": offset,
                                    "h1": a.spans(sa, pos, pos + min_bytes).view(np.int64), "h2": b.spans(sb, pos, pos + min_bytes).view(np.int64),
                                    "before": np.where(offset > 0, data[np.maximum(pos - 1, 0)].astype(np.int64), own[frame])})

    return looked_at.select("cls", "id", "at", "starts", "content", "slices").mapInPandas(cut, "cls long, id binary, offset long, h1 long, h2 long, before long")


def wide_tree_rows(many: DataFrame, min_bytes: int) -> DataFrame:
    """As ``tree_rows``, for classes of any size: no task holds a class.

    Ranks go up with the suffix array and may leave numbers out."""
    ship_code()
    windows = _windows(many, min_bytes)
    several = written(windows.groupBy("cls", "h1", "h2").agg(F.count("*").alias("n"), F.min("before").alias("lo"), F.max("before").alias("hi"))
                      .filter("n > 1 and lo != hi").select("cls", "h1", "h2"), "windows")
    # a frame has at most as many starts as windows of its bytes
    chosen = windows.join(several, ["cls", "h1", "h2"]).groupBy("id").agg(F.collect_list(F.struct("offset", "before")).alias("s"))
    suffixes = (many.select("cls", "id", "content").join(chosen, "id").select("cls", "id", "content", F.explode("s").alias("s"))
                .select("cls", F.expr("substring(content, cast(s.offset + 1 as int))").alias("suffix"), "id", "s.offset", "s.before"))

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part_no = TaskContext.get().partitionId()
        rank, stack, out, runs, last, at_start = part_no * PART - 1, [], [], _Border(), None, True

        def groups(shared: int, lo: int) -> None:
            for first, end, length in _step(stack, shared, rank, lo, lo):
                if first > part_no * PART:  # what touches the beginning is scanned with the part before
                    out.append((cls, first, None, None, end, length) + nothing)

        def border(ends: bool) -> None:
            for i, (shared, _, first, end, lo, hi) in enumerate(runs.runs):
                begins, finishes = at_start and i == 0, ends and i == len(runs.runs) - 1
                out.append((cls, None, None, None, None, None, part_no, first, end, shared if i else 0, lo, hi,
                            head if begins else None, last if finishes else None))

        nothing = (None,) * 8
        columns = [c.split()[0] for c in SCANNED.split(", ")]
        cls = left = head = None
        for rows in parts:
            for c, suffix, i, o, before in zip(rows["cls"], rows["suffix"], rows["id"], rows["offset"], rows["before"]):
                shared = _shared(last, suffix) if cls == c else 0
                shared = shared if shared >= min_bytes else 0
                if left is not None:
                    groups(shared, left)
                    if cls != c:
                        if at_start:
                            border(False)
                        at_start, runs = False, _Border()
                rank += 1
                cls, left, last = c, before, suffix
                head = last if rank == part_no * PART else head
                runs.add(shared, rank, before)
                out.append((cls, rank, i, o, None, None) + nothing)
            yield pd.DataFrame(out, columns=columns).astype(_types(SCANNED))
            out = []
        if left is not None:
            border(True)
            yield pd.DataFrame(out, columns=columns).astype(_types(SCANNED))

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["part", "first"], ignore_index=True)
        first, last, part = (rows[c].tolist() for c in ("first", "last", "part"))
        shared = rows["shared"].tolist()
        heads, tails = rows["head"].tolist(), rows["tail"].tolist()
        cls, out = rows["cls"].iloc[0], []
        for i in range(1, len(rows)):
            if part[i] != part[i - 1]:
                n = _shared(tails[i - 1], heads[i])
                shared[i] = n if n >= min_bytes else 0
        for a, b, length in _scan(shared, rows["lo"].tolist(), rows["hi"].tolist(), min_bytes):
            # others end inside of their part, which has listed them
            if part[a] != part[b] or heads[a] is not None or tails[b] is not None:
                out.append((cls, first[a], None, None, last[b], length))
        return pd.DataFrame(out, columns=["cls", "rank", "id", "offset", "last_rank", "length"]).astype(_types(TREE))

    def put_in(members: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        members = members.sort_values("rank", ignore_index=True)
        known = list(zip(groups["rank"].tolist(), groups["last_rank"].tolist(), groups["length"].tolist()))
        lengths = np.array([*(g[2] for g in known), 0])
        members["length"] = lengths[_innermost(members["rank"].tolist(), known)] if len(members) else 0
        return members[members["length"] > 0][["cls", "rank", "id", "offset", "last_rank", "length"]].astype(_types(TREE))

    order = ["cls", "suffix", "id", "offset"]
    parts = written(suffixes.repartitionByRange(*order).sortWithinPartitions(*order)
                    .mapInPandas(scan, SCANNED), "scanned")
    rows = parts.filter("part is null").select("cls", "rank", "id", "offset", "last_rank", "length")
    # some runs for each part that a class lies in
    across = parts.filter("part is not null").groupBy("cls").applyInPandas(joined, TREE)
    groups = written(rows.filter("id is null").unionByName(across), "groups")
    # a part holds what one task has sorted, and at most two groups of each length go beyond it
    members = rows.filter("id is not null").withColumn("part", F.expr(f"rank div {PART}"))
    over = groups.withColumn("part", F.explode(F.expr(f"sequence(rank div {PART}, last_rank div {PART})")))
    return groups.unionByName(members.groupBy("cls", "part").cogroup(over.groupBy("cls", "part")).applyInPandas(put_in, TREE))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(tid, bytes, copies), written; null texts are empty."""
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return written(docs.select(F.unhex(F.md5(data)).alias("tid"), data.alias("bytes")).groupBy("tid").agg(F.first("bytes").alias("bytes"), F.count("*").alias("copies")), "texts")


def _joined(rows: DataFrame, counts: DataFrame, n: str) -> DataFrame:
    """``rows`` with their anchor's number of rows, ``counts`` (anchor, n).

    Anchors with more than a thousandth of what ``counts`` holds are fewer than
    ``COMMON`` and broadcast, so their rows stay where they lie; the rows of all
    others meet in a join by anchor."""
    least = F.lit((counts.agg(F.sum(n)).first()[0] or 0) // COMMON)
    common = F.broadcast(counts.filter(F.col(n) > least))
    return rows.join(common, "anchor").unionByName(rows.join(common, "anchor", "left_anti").join(counts.filter(F.col(n) <= least), "anchor"))


def repeats(texts: DataFrame, min_bytes: int = MIN_BYTES, gram: int = GRAM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The repeats of distinct texts (tid, bytes, copies), three tables:

    - places (tid, lo, id): where frame ``id`` lies, for every frame that
      holds a repeat;
    - suffixes (id, cls, rank, offset, length): members of groups, which begin
      ``offset`` bytes into the frame, with the length of the innermost group
      that holds them.  Rank null: the frame as a whole, which lies in two or
      more places;
    - groups (cls, rank, last_rank, length, id): maximal repeats, whose
      occurrences are the suffixes of the class with these ranks, in all their
      places.  Ranks null: the places of frame ``id`` as a whole."""
    every = written(frames(texts, min_bytes, gram), "frames")
    again = every.groupBy("anchor").agg(F.count("*").alias("times")).filter("times > 1")
    whole = F.expr(f"starts - 1 + {min_bytes}")
    name = F.unhex(F.md5(F.concat_ws(",", "anchor", "f1", "f2", "starts").cast("binary")))
    shared = written(_joined(every, written(again, "again"), "times").withColumn("id", name).drop("times", "f1", "f2"), "shared")
    different = shared.groupBy("anchor", "id", "at", "starts").agg(F.count("*").alias("times"), F.min(F.struct("tid", "lo")).alias("one"))
    different = written(different, "different")
    several = different.groupBy("anchor").agg(F.count("*").alias("n_frames")).filter("n_frames > 1")
    several = written(several, "several")
    picked = _joined(different, several, "n_frames")
    wanted = picked.groupBy(F.col("one.tid").alias("tid")).agg(F.collect_list(F.struct("anchor", "id", "at", "starts", "n_frames", F.col("one.lo").alias("lo"))).alias("f"))
    with_bytes = (texts.select("tid", "bytes").join(wanted, "tid").select("bytes", F.explode("f").alias("f")).select("f.*", "bytes")
                  .withColumn("content", F.expr(f"substring(bytes, cast(lo + 1 as int), starts - 1 + {min_bytes})")).drop("bytes"))
    named = with_bytes.select(F.col("anchor").alias("cls"), "id", "at", "starts", "content", "n_frames")
    tree = tree_rows(named.filter(f"n_frames <= {MANY_FRAMES}"), min_bytes)
    if not several.filter(f"n_frames > {MANY_FRAMES}").isEmpty():
        tree = tree.unionByName(wide_tree_rows(written(named.filter(f"n_frames > {MANY_FRAMES}"), "many"), min_bytes))
    tree = written(tree, "tree")
    found = tree.filter("id is not null").select("id", "cls", "rank", "offset", "length")
    many = different.filter("times > 1").select("id", F.col("anchor").alias("cls"), F.lit(None).cast("long").alias("rank"), F.lit(0).cast("long").alias("offset"), whole.cast("long").alias("length"))
    groups = tree.filter("id is null").select("cls", "rank", "last_rank", "length", "id")
    return shared.select("tid", "lo", "id"), found.unionByName(many), groups.unionByName(many.select("cls", "rank", F.lit(None).cast("long").alias("last_rank"), "length", "id"))


def removed_spans(texts: DataFrame, min_bytes: int = MIN_BYTES, gram: int = GRAM) -> DataFrame:
    """(tid, spans): the maximal runs [start, end) of bytes of each distinct
    text that lie in a ``min_bytes``-byte string which starts anywhere else too,
    in byte order.  Texts without such bytes have no row.  They are what the
    occurrences of all groups cover; each suffix counts with its innermost
    group, as the others are shorter."""
    places, members, _ = repeats(texts, min_bytes, gram)
    # for each frame, what begins at one place counts once, with its greatest length
    here = members.groupBy("id", "offset").agg(F.max("length").alias("length"))
    runs = places.join(here, "id").select("tid", (F.col("lo") + F.col("offset")).alias("start"), (F.col("lo") + F.col("offset") + F.col("length")).alias("end"))
    full = texts.filter((F.col("copies") > 1) & (F.octet_length("bytes") >= min_bytes)).select("tid", F.lit(0).cast("long").alias("start"), F.octet_length("bytes").cast("long").alias("end"))
    runs = runs.unionByName(full)
    by_start = Window.partitionBy("tid").orderBy("start", F.desc("end"))
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    merged = (runs.withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
              .withColumn("run", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
              .groupBy("tid", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")))
    return merged.groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def _kept_bytes():
    """The bytes outside ``spans``, as a string column of raw bytes."""
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["end"]))
    starts = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.octet_length("bytes").cast("long")))
    return F.array_join(F.zip_with(ends, starts, lambda a, b: F.substring(F.col("bytes"), (a + 1).cast("int"), (b - a).cast("int")).cast("string")), "")


def repeats_query(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row.  Null
    texts are empty; repeated rows are documents of their own, so all of a text
    of 400 bytes or more that occurs twice goes; other columns are not read and
    an empty table gives no row."""
    texts = distinct_texts(docs)
    done = texts.join(removed_spans(texts), "tid", "left").withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")))
    done = done.select("tid", F.octet_length("bytes").cast("long").alias("n_bytes"), F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)").alias("n_removed"),
                       F.size("spans").cast("long").alias("n_spans"), F.sha2(_kept_bytes().cast("binary"), 256).alias("kept_sha256"))
    rows = docs.select("doc_id", F.unhex(F.md5(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))).alias("tid"))
    return rows.join(done, "tid").drop("tid")


def _in_characters(spans: Column, data: Column) -> Column:
    """``spans`` drawn in to whole characters of the UTF-8 bytes ``data``."""
    between = lambda a, b: F.hex(F.substring(data, (a + 1).cast("int"), (b - a).cast("int")))
    size = lambda found: (F.length(found) / 2).cast("long")
    # continuation bytes from a place on, and the beginning of a character before a place
    tail = lambda at: size(F.regexp_extract(between(at, at + 3), "^((?:[89AB][0-9A-F])*)", 1))
    lead = lambda at: size(F.regexp_extract(F.reverse(between(F.greatest(at - 3, F.lit(0)), at)), "^((?:[0-9A-F][89AB])*[0-9A-F][C-F])?", 0))
    return F.transform(spans, lambda s: F.struct((s["start"] + tail(s["start"])).alias("start"), F.when(tail(s["end"]) > 0, s["end"] - lead(s["end"])).otherwise(s["end"]).alias("end")))


def without_repeats(docs: DataFrame, min_bytes: int = PASSAGE_BYTES, gram: int = PASSAGE_GRAM, min_words: int = PASSAGE_WORDS, long_bytes: int = MIN_BYTES) -> DataFrame:
    """The documents with their repeated passages taken out of ``text``, and
    ``n_chars`` counted anew where there is such a column; other columns stay.

    A repeated passage is a maximal run of bytes that lie in ``min_bytes``-byte
    strings which occur elsewhere too, if it holds ``min_words`` words, words cut
    by its ends included, or ``long_bytes`` bytes.  Cuts are drawn in to whole
    characters, so a repeat that ends inside a character leaves that character.
    Documents of which no word is left go, those without any repeat all stay as
    they are, null texts included."""
    spans = removed_spans(distinct_texts(docs), min_bytes, gram)
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(F.struct("*").alias("whole_row"), data.alias("bytes"), F.unhex(F.md5(data)).alias("tid")).join(spans, "tid", "left")
    words = lambda s: F.regexp_count(F.substring(F.col("bytes"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")).cast("string"), F.lit(WORD))
    passages = F.filter("spans", lambda s: F.when(s["end"] - s["start"] >= long_bytes, True).otherwise(words(s) >= min_words))
    rows = rows.withColumn("spans", F.filter(_in_characters(passages, F.col("bytes")), lambda s: s["start"] < s["end"]))
    rows = rows.withColumn("left_text", F.when(F.size("spans") > 0, _kept_bytes())).filter(F.col("left_text").isNull() | F.col("left_text").rlike(WORD))
    text = F.coalesce("left_text", F.col("whole_row.text"))
    put = {"text": text, "n_chars": F.when(F.col("left_text").isNull(), F.col("whole_row.n_chars")).otherwise(F.length("left_text"))} if "n_chars" in docs.columns else {"text": text}
    return rows.select(*[(put[c].cast(docs.schema[c].dataType) if c in put else F.col(f"whole_row.`{c}`")).alias(c) for c in docs.columns])
