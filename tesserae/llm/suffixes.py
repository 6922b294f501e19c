"""Suffix-array deduplication of bytes by a common-prefix-aware distributed merge sort.

A byte is removed if some string of `WIDTH` bytes that covers it also starts anywhere else. Sorting all
suffixes would move the corpus many times over; a sparse suffix array is enough:

1. In every window of WIDTH bytes the seed (SEED bytes) with the least hash is the window's anchor.
   Equal windows have their anchor at the same place, so only anchors need comparing. An anchor owns the
   run of windows that chose it.
2. Seeds that occur once in the corpus cannot be in a repeated window; their anchors drop out.
3. Each task sorts the suffixes that begin at its remaining anchors, equal contexts once, and
   front-codes them: the length of the prefix shared with the one before, and the rest. These runs are
   exchanged by a hash of the seed, so that suffixes with a common beginning meet.
4. A loser tree merges the runs. It carries, for every contender, the prefix shared with the last
   winner, compares these lengths first and bytes only from there on, and yields the sorted order with
   its common-prefix array.
5. For each length of left context, windows are equal if their right parts lie within one stretch of
   sufficient common prefixes and their left parts hash alike (64 bits). All windows of an anchor
   overlap, so each anchor yields one interval.
6. Parts of far more contexts than others (one seed may begin a third of all texts) are cut into ranges of
   sorted contexts at sampled splitters. A stretch of common prefixes can then go on in the next range;
   of such stretches the ranges exchange one 64-bit tag (left part and common prefix) for each different
   window, so that no seed has to sit in one task.

A context that many documents share travels once from each task and not once from each document.

Edge cases: a null text is empty; texts below WIDTH bytes lose nothing; texts of any length are searched
whole, in overlapping segments; repeated rows, whatever their ids, are copies of each other and lose
everything from WIDTH bytes up; every copy loses its bytes, so ties need no order; an empty table gives
none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import common
from tesserae.llm.minhash import mix

WIDTH, SEED = 200, 32
_REACH = WIDTH - SEED + 1  # seeds in a window
SEGMENT = 1 << 20
#: Contexts that one merging task handles; a part of more than twice as many is cut into ranges.
MERGED = 100_000
#: Contexts drawn for each range that a part is cut into.
DRAWN = 8
#: Up to so many bytes of places or spans are broadcast to the scan of texts; beyond, they are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
_U = np.uint64
_BYTES = mix(np.arange(1, 257).astype(_U))
_PLACE = (1 << 24) - 1


def _segments(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bytes]]:
    """(document, offset in it, start in the buffer, buffer): about SEGMENT bytes at a time; long texts in parts that overlap."""
    docs, offsets, starts, parts, size = [], [], [], [], 0
    for d, t in enumerate(texts):
        for lo in range(0, max(1, len(t) - WIDTH + 1), SEGMENT):
            part = t[lo : lo + SEGMENT + WIDTH - 1]
            if len(part) < WIDTH:
                continue
            docs.append(d), offsets.append(lo), starts.append(size), parts.append(part)
            size += len(part)
            if size >= SEGMENT:
                yield np.array(docs), np.array(offsets), np.array([*starts, size]), b"".join(parts)
                docs, offsets, starts, parts, size = [], [], [], [], 0
    if parts:
        yield np.array(docs), np.array(offsets), np.array([*starts, size]), b"".join(parts)


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, seed hash, packed place) of all anchors. Packed: place << 16 | windows begin so far before it << 8 | further windows."""
    found: list[tuple] = []
    for docs, offsets, starts, buf in _segments(texts):
        h = _BYTES[np.frombuffer(buf, "u1")]
        step = 1
        while step < SEED:
            h = h[:-step] * _U(pow(0xD1342543DE82EF95, step, 1 << 64)) + h[step:]
            step *= 2
        h = mix(h)
        least = h & ~_U(_PLACE) | np.arange(len(h)).astype(_U)
        step = 1
        while step * 2 <= _REACH:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if step < _REACH:
            least = np.minimum(least[: len(least) - (_REACH - step)], least[_REACH - step :])
        counts = np.diff(starts) - WIDTH + 1
        part = np.repeat(np.arange(len(docs)), counts)
        first = np.cumsum(counts) - counts
        window = np.arange(len(part)) - np.repeat(first, counts) + np.repeat(starts[:-1], counts)
        at = (least[window] & _U(_PLACE)).astype("i8")
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (part[1:] != part[:-1])
        run = np.flatnonzero(new)
        last = np.append(run[1:], len(at)) - 1
        place = at[run] - starts[:-1][part[run]] + offsets[part[run]]
        before, more = at[run] - window[run], window[last] - window[run]
        found.append((docs[part[run]], h[at[run]].view("i8"), place << 16 | before << 8 | more))
    if not found:
        return np.zeros(0, int), np.zeros(0, "i8"), np.zeros(0, "i8")
    return tuple(np.concatenate(c) for c in zip(*found))


def _lists(owner: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """Values grouped by their non-decreasing owner, as an Arrow list for each of n owners."""
    cuts = np.searchsorted(owner, np.arange(n + 1)).astype("i4")
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(values))


def _with_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), body.alias("body")).withColumn("key", F.unhex(F.md5("body")))


def _seeds(source: DataFrame) -> DataFrame:
    """key, seeds, places of every text with WIDTH bytes or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, seed, packed = anchors(batch.column(1).to_pylist())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(doc, seed, n), _lists(doc, packed, n)], ["key", "seeds", "places"])

    return source.filter(F.octet_length("body") >= WIDTH).select("key", "body").mapInArrow(run, "key binary, seeds array<long>, places array<long>")


def front_code(suffixes: list[bytes]) -> tuple[np.ndarray, bytes]:
    """Lengths of the prefix that each sorted suffix shares with the one before, and all the rests."""
    shared, rests, before = np.zeros(len(suffixes), "u2"), [], b""
    for i, s in enumerate(suffixes):
        n = common_prefix(before, s, 0)
        shared[i] = n
        rests.append(s[n:])
        before = s
    return shared, b"".join(rests)


def front_decode(shared: np.ndarray, lengths: np.ndarray, rests: bytes) -> list[bytes]:
    out, at, before = [], 0, b""
    for n, size in zip(shared.tolist(), lengths.tolist()):
        end = at + size - n
        before = before[:n] + rests[at:end]
        out.append(before)
        at = end
    return out


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which `known` bytes are known to be equal."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return known + len(x) - (differ.bit_length() + 7) // 8


def merge_runs(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, int]]:
    """(run, place in it, prefix shared with the suffix yielded before) in sorted order.

    runs: for each, the prefixes shared within it and its sorted suffixes. Each node of the loser tree
    keeps the loser's prefix shared with the winner that passed it, so lengths decide without looking at
    bytes unless they are equal, and then bytes are compared only behind them.
    """
    k = len(runs)
    shared, place = [0] * k, [0] * k
    head: list[bytes | None] = [r[1][0] if r[1] else None for r in runs]
    losers = [-1] * k

    def duel(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared length becomes that with the winner."""
        if a < 0 or b < 0:
            return (b, a) if a < 0 else (a, b)
        s, t = head[a], head[b]
        if s is None or t is None:
            return (b, a) if s is None else (a, b)
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        n = common_prefix(s, t, shared[a])
        if n == len(s) if n == len(s) and (n < len(t) or a < b) else n < len(t) and n < len(s) and s[n] < t[n]:
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = duel(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if k > 1 else 0
    while head[winner] is not None:
        yield winner, place[winner], shared[winner]
        place[winner] += 1
        r = runs[winner]
        if place[winner] < len(r[1]):
            head[winner], shared[winner] = r[1][place[winner]], r[0][place[winner]]
        else:
            head[winner] = None
        node = (winner + k) // 2
        while node:
            winner, losers[node] = duel(winner, losers[node])
            node //= 2


_RUN = "part int, task int, shared binary, lengths binary, rests binary, lefts binary, before binary, least binary, often binary, ids binary"
_SENT = f"kind int, {_RUN}, key binary, places binary"
_SENT_TYPES = (pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 10)
_SENT_NAMES = [p.split()[0] for p in _SENT.split(", ")]


def _send(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _SENT_TYPES)], _SENT_NAMES)


def _coded(part: int, task: int, contexts: list[tuple]) -> tuple:
    """A front-coded run of sorted contexts (right, left, least left, number in the task, whether it is there twice)."""
    shared, rests = front_code([c[0] for c in contexts])
    lengths = np.array([len(c[0]) for c in contexts], "u2").tobytes()
    lefts, before, least = b"".join(c[1] for c in contexts), bytes(len(c[1]) for c in contexts), bytes(c[2] for c in contexts)
    ids, often = np.array([c[3] for c in contexts], "u4").tobytes(), bytes(c[4] for c in contexts)
    return 0, part, task, shared.tobytes(), lengths, rests, lefts, before, least, often, ids, None, None


def _lefts(row: dict) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(row["before"], "u1"), dtype=int).tolist()
    return [row["lefts"][a:b] for a, b in zip([0, *ends], ends)]


def _rights(row: dict) -> list[bytes]:
    return front_decode(np.frombuffer(row["shared"], "u2"), np.frombuffer(row["lengths"], "u2"), row["rests"])


def _runs(wanted: DataFrame, parts: int) -> DataFrame:
    """Front-coded runs (kind 0), and for each text its anchors' contexts by number within the task (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        number: dict[tuple[bytes, bytes, int], int] = {}  # (right, left, least left) of a context
        often = bytearray()
        for batch in batches:
            out = []
            for key, b, places in zip(*(c.to_pylist() for c in batch.columns)):
                ids = []
                for p in places:
                    at, before, more = p >> 16, p >> 8 & 255, p & 255
                    context = (b[at : at - before + more + WIDTH], b[at - before : at], before - more)
                    n = number.setdefault(context, len(number))
                    if n == len(often):
                        often.append(0)
                    else:
                        often[n] = 1
                    ids.append(n)
                out.append((1, None, task, *[None] * 7, np.array(ids, "u4").tobytes(), key, np.array(places, "i8").tobytes()))
            if out:
                yield _send(out)
        by_part: dict[int, list] = {}
        for (right, left, least), n in number.items():
            by_part.setdefault(xxhash.xxh32_intdigest(right[:SEED]) % parts, []).append((right, left, least, n, often[n]))
        number.clear()
        for part in sorted(by_part):
            yield _send([_coded(part, task, sorted(by_part.pop(part)))])

    return wanted.select("key", "body", "places").mapInArrow(run, _SENT)


def _by_left(shared: np.ndarray, lefts: list[bytes], least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each number of left bytes: it, the contexts with such a window, and of all contexts the stretch of common prefixes and the hash of the left bytes."""
    n = len(lefts)
    most = np.array([len(s) for s in lefts], int)
    deep = int(most.max()) if n else -1
    before = np.zeros((n, deep + 1), "u1")
    for i, s in enumerate(lefts):
        before[i, : len(s)] = np.frombuffer(s[::-1], "u1")
    h = np.zeros(n, _U)
    for left in range(deep + 1):
        if left:
            h = mix(h * _U(0x9E3779B97F4A7C15) + _BYTES[before[:, left - 1]])
        live = np.flatnonzero((least <= left) & (left <= most))
        if len(live):
            yield left, live, np.cumsum(shared < WIDTH - left).astype(_U), h


def repeated_lefts(shared: np.ndarray, lefts: list[bytes], least: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fewest, most) left bytes with which each context, in sorted order of right parts, has a repeated window; most is -1 if none.

    shared: common prefix with the one before. least: fewest left bytes of the context's own windows, its
    whole left part being the most. often: the context itself occurs twice.
    """
    n = len(lefts)
    low, high = np.full(n, WIDTH), np.full(n, -1)
    twice = often.astype(bool)
    low[twice], high[twice] = least[twice], np.array([len(s) for s in lefts], int)[twice]
    for left, live, stretch, h in _by_left(shared, lefts, least):
        if len(live) < 2:
            continue
        tag = mix(h[live] ^ mix(stretch[live]))
        order = np.argsort(tag, kind="stable")
        same = tag[order][1:] == tag[order][:-1]
        hit = live[order[np.append(same, False) | np.append(False, same)]]
        low[hit] = np.minimum(low[hit], left)
        high[hit] = np.maximum(high[hit], left)
    return low, high


def open_windows(
    shared: np.ndarray, rights: list[bytes], lefts: list[bytes], least: np.ndarray, first: int, last: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(left bytes, tags, contexts) of the windows that may also be in another range, each different one once.

    first, last: common prefix of the first context with the splitter before it, and of the last with the
    one behind it (0: none). The context is -1 where several of this range have the window.
    """
    for left, live, stretch, h in _by_left(shared, lefts, least):
        need = WIDTH - left
        ends = [s for s, n in ((stretch[0], first), (stretch[-1], last)) if n >= need]
        at = live[np.isin(stretch[live], ends)]
        if not len(at):
            continue
        prefix = np.zeros(len(at), _U)
        for s in ends:
            inside = stretch[at] == s
            if inside.any():
                prefix[inside] = xxhash.xxh64_intdigest(rights[at[inside][0]][:need], left)
        tags, where, times = np.unique(mix(h[at] ^ mix(prefix)), return_index=True, return_counts=True)
        yield left, tags, np.where(times == 1, at[where], -1)


def _splitters(runs: DataFrame) -> dict[int, list[tuple[bytes, bytes]]]:
    """For each part of more than twice MERGED contexts, the contexts (right, left) at which it is cut into ranges of about MERGED.

    What the driver gets is DRAWN contexts for each MERGED of such parts.
    """
    sizes = runs.groupBy("part").agg(F.sum(F.octet_length("least")).alias("n")).filter(F.col("n") > 2 * MERGED).collect()
    if not sizes:
        return {}
    step = max(1, MERGED // DRAWN)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                some = slice(xxhash.xxh32_intdigest(f"{r['part']} {r['task']}") % step, None, step)
                rights, lefts = _rights(r)[some], _lefts(r)[some]
                part = pa.array([r["part"]] * len(rights), pa.int32())
                yield pa.RecordBatch.from_arrays([part, pa.array(rights, pa.binary()), pa.array(lefts, pa.binary())], ["part", "right", "left"])

    drawn: dict[int, list] = {}
    for r in runs.filter(F.col("part").isin([r["part"] for r in sizes])).mapInArrow(draw, "part int, right binary, left binary").collect():
        drawn.setdefault(r["part"], []).append((bytes(r["right"]), bytes(r["left"])))
    cuts = {}
    for r in sizes:
        found, ranges = sorted(drawn.get(r["part"], [])), -(-r["n"] // MERGED)
        at = sorted({found[i * len(found) // ranges] for i in range(1, ranges)}) if found else []
        if at:
            cuts[r["part"]] = at
    return cuts


def _ranges(runs: DataFrame, cuts: dict[int, list], first: dict[int, int]) -> DataFrame:
    """The runs, those of the cut parts divided at the splitters; first: the number of each cut part's first range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                contexts = list(zip(_rights(r), _lefts(r), r["least"], np.frombuffer(r["ids"], "u4").tolist(), r["often"]))
                ends = [bisect_left(contexts, cut) for cut in cuts[r["part"]]]
                for i, (a, b) in enumerate(zip([0, *ends], [*ends, len(contexts)])):
                    if a < b:
                        yield _send([_coded(first[r["part"]] + i, r["task"], contexts[a:b])])

    cut = F.col("part").isin(list(cuts))
    return runs.filter(~cut).unionByName(runs.filter(cut).mapInArrow(run, _SENT))


def _answer(task: int, low: np.ndarray, high: np.ndarray, ids: np.ndarray) -> tuple:
    return 0, None, task, low.astype("u1").tobytes(), high.astype("u1").tobytes(), *[None] * 5, ids.astype("u4").tobytes(), None, None


def _solve(runs: DataFrame, parts: int, edges: dict[int, tuple]) -> DataFrame:
    """For each task its contexts that repeat: ids, and the fewest and most left bytes (kind 0 of the same shape).

    edges: the splitters before and behind each range. Of these also the open windows (kind 2): left bytes
    as part, tags as ids, the contexts' tasks and numbers (-1: none) as lefts and places.
    """

    def solve(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        lists = [(np.frombuffer(r["shared"], "u2").tolist(), _rights(r)) for r in rows]
        lefts = [_lefts(r) for r in rows]
        total = sum(len(x) for x in lefts)
        of, place, shared = np.empty(total, int), np.empty(total, int), np.empty(total, int)
        for i, (a, b, c) in enumerate(merge_runs(lists)):
            of[i], place[i], shared[i] = a, b, c
        before, behind = edges.get(rows[0]["part"], (None, None))
        rights = [lists[a][1][b] for a, b in zip(of.tolist(), place.tolist())] if before or behind else []
        del lists
        firsts = np.cumsum([0] + [len(x) for x in lefts])[:-1]
        flat = firsts[of] + place
        pick = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in rows])[flat]
        ordered, least, ids = [lefts[a][b] for a, b in zip(of.tolist(), place.tolist())], pick("least", "u1").astype(int), pick("ids", "u4")
        low, high = repeated_lefts(shared, ordered, least, pick("often", "u1"))
        for k, r in enumerate(rows):
            hit = (of == k) & (high >= 0)
            if hit.any():
                yield _send([_answer(r["task"], low[hit], high[hit], ids[hit])])
        if rights:
            tasks = np.array([r["task"] for r in rows])
            first = common_prefix(before[0], rights[0], 0) if before else 0
            last = common_prefix(behind[0], rights[-1], 0) if behind else 0
            for left, tags, who in open_windows(shared, rights, ordered, least, first, last):
                task, number = np.where(who < 0, -1, tasks[of[who]]), np.where(who < 0, -1, ids[who].astype(int))
                yield _send([(2, left, None, *[None] * 3, task.astype("i4").tobytes(), *[None] * 3, tags.tobytes(), None, number.astype("i8").tobytes())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] != now and rows:
                    yield from solve(rows)
                    rows = []
                now = r["part"]
                rows.append(r)
        if rows:
            yield from solve(rows)

    return runs.repartition(parts, "part").sortWithinPartitions("part", "task").mapInArrow(run, _SENT)


def _settle(opened: DataFrame) -> DataFrame:
    """Answers for contexts with a window that another range has too. Of a tag there is one row from each range."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.select(["part", "lefts", "ids", "places"]).to_pylist():
                tag, task, number = np.frombuffer(r["ids"], "i8"), np.frombuffer(r["lefts"], "i4"), np.frombuffer(r["places"], "i8")
                yield pa.RecordBatch.from_arrays([pa.array(tag), pa.array(task), pa.array(number), pa.array(np.full(len(tag), r["part"], "i4"))], ["tag", "task", "number", "left"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            task, number, low, high = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for t in np.unique(task).tolist():
                yield _send([_answer(t, low[task == t], high[task == t], number[task == t])])

    rows = opened.mapInArrow(unpack, "tag long, task int, number long, left int")
    met = rows.groupBy("tag").agg(F.collect_list(F.struct("task", "number", "left")).alias("who")).filter(F.size("who") > 1)
    met = met.select(F.explode("who").alias("w")).select("w.task", "w.number", "w.left").filter("number >= 0")
    return met.groupBy("task", "number").agg(F.min("left").alias("low"), F.max("left").alias("high")).mapInArrow(pack, _SENT)


def _spans(both: DataFrame) -> DataFrame:
    """key, spans (begin and end, as 64-bit pairs) of every text that loses something. Answers of a task come before its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, low, high = None, np.zeros(0, int), np.zeros(0, int)
        for batch in batches:
            keys, spans = [], []
            for r in batch.select(["kind", "task", "shared", "lengths", "ids", "key", "places"]).to_pylist():
                if r["task"] != task:
                    task, low, high = r["task"], np.zeros(0, int), np.zeros(0, int)
                ids = np.frombuffer(r["ids"], "u4")
                if r["kind"] == 0:
                    grow = int(ids.max()) + 1 - len(high)
                    if grow > 0:
                        low, high = np.append(low, np.full(grow, WIDTH)), np.append(high, np.full(grow, -1))
                    low[ids] = np.minimum(low[ids], np.frombuffer(r["shared"], "u1"))
                    high[ids] = np.maximum(high[ids], np.frombuffer(r["lengths"], "u1"))
                    continue
                ok = ids < len(high)
                ids, at = ids[ok], np.frombuffer(r["places"], "i8")[ok] >> 16
                ok = high[ids] >= 0
                if not ok.any():
                    continue
                begin, end = at[ok] - high[ids[ok]], at[ok] - low[ids[ok]] + WIDTH
                order = np.argsort(begin, kind="stable")
                begin, end = begin[order], np.maximum.accumulate(end[order])
                new = np.append(True, begin[1:] > end[:-1])
                keys.append(r["key"])
                spans.append(np.stack([begin[new], np.append(end[:-1][new[1:]], end[-1])], 1).astype("i8").tobytes())
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(spans, pa.binary())], ["key", "spans"])

    return both.repartition("task").sortWithinPartitions("task", "kind").mapInArrow(run, "key binary, spans binary").dropDuplicates(["key"])


def _joined(source: DataFrame, extra: DataFrame, size: int, how: str) -> DataFrame:
    return source.join(F.broadcast(extra) if size <= BROADCAST_BYTES else extra, "key", how)


def repeated_spans(source: DataFrame) -> tuple[DataFrame, int]:
    """(key, spans) of the texts (key, body) that lose something, and the table's size in bytes."""
    drawn = common.staged(_seeds(source), "seeds")
    pairs = drawn.select("key", F.explode(F.arrays_zip("seeds", "places")).alias("a")).select("key", F.col("a.seeds").alias("seed"), F.col("a.places").alias("place"))
    often = drawn.select(F.explode("seeds").alias("seed")).groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("seed")
    often = common.staged(often, "often")  # a table of its own, so that both sides of the join are dealt anew and a hot seed is split
    places = pairs.join(often, "seed").groupBy("key").agg(F.sort_array(F.collect_set("place")).alias("places"))
    places = common.staged(places, "places")
    common.discard(drawn)
    common.discard(often)
    n = places.agg(F.coalesce(F.sum(F.size("places")), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-n // MERGED))
    sent = common.staged(_runs(_joined(source, places, 8 * n, "inner"), parts), "runs")
    runs, edges, opened = sent.filter("kind = 0"), {}, None
    cuts = _splitters(runs)
    if cuts:
        first = {}
        for part, at in cuts.items():
            first[part], parts = parts, parts + len(at) + 1
            edges.update((first[part] + i, e) for i, e in enumerate(zip([None, *at], [*at, None])))
        opened = common.staged(_solve(_ranges(runs, cuts, first), parts, edges), "opened")
        answers = opened.filter("kind = 0").unionByName(_settle(opened.filter("kind = 2")))
    else:
        answers = _solve(runs, parts, edges)
    spans = common.staged(_spans(answers.unionByName(sent.filter("kind = 1"))), "spans")
    common.discard(places)
    common.discard(sent)
    if opened is not None:
        common.discard(opened)
    size = spans.agg(F.coalesce(F.sum(F.octet_length("spans") + 32), F.lit(0)).alias("n")).first()["n"]
    return spans, size


def _cut(body: bytes, spans: bytes | None) -> tuple[bytes, int, int]:
    """(kept bytes, removed bytes, number of spans)."""
    if not spans:
        return body, 0, 0
    pairs = np.frombuffer(spans, "i8").reshape(-1, 2).tolist()
    kept, at = [], 0
    for a, b in pairs:
        kept.append(body[at:a])
        at = b
    kept.append(body[at:])
    out = b"".join(kept)
    return out, len(body) - len(out), len(pairs)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """The rows of docs, all columns, with repeated bytes cut out of the text, and without rows that lose all of it.

    Bytes of characters that a cut splits are dropped too. count_col: a column that holds the text's length.
    """
    names = docs.columns
    key = F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))
    spans, size = repeated_spans(_with_key(docs, id_col, text_col))
    of, own = f"key_{uuid.uuid4().hex}", f"spans_{uuid.uuid4().hex}"  # no column of docs has these names
    side = spans.select(F.col("key").alias(of), F.col("spans").alias(own))
    side = F.broadcast(side) if size <= BROADCAST_BYTES else side
    joined = docs.join(side, key == F.col(of), "left").select(*names, own)
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = [], []
            for t, s in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()):
                kept = t if not s else _cut(t.encode("utf-8", "replace"), s)[0].decode("utf-8", "ignore")
                texts.append(kept)
                keep.append(not s or bool(kept.strip()))
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, pa.string())
            if count_col is not None:
                k = names.index(count_col)
                columns[k] = pa.array([c if not s else len(t) for c, s, t in zip(columns[k].to_pylist(), batch.column(len(names)).to_pylist(), texts)], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, docs.schema)


def op5_suffix_array(spark, sf_dir, docs: DataFrame | None = None) -> DataFrame:
    """Bytes that every document loses; see the module's docstring."""
    common.prepare(spark)
    docs = common.documents(spark, sf_dir) if docs is None else docs
    source = _with_key(docs, "doc_id", "text")
    spans, size = repeated_spans(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                kept, gone, n = _cut(body, s)
                rows.append((len(body), gone, n, hashlib.sha256(kept).hexdigest()))
            if rows:
                a, b, c, d = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = _joined(source, spans, size, "left").select("doc_id", "body", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


QUERIES = {"op5_suffix_array": op5_suffix_array}
ORACLES: dict[str, str] = {}
