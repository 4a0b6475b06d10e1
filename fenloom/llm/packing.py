"""Packing of token sequences by bin completion.

Documents are encoded, an end id is added, and only what is longer than a sequence is cut. How many
pieces there are of each length is all that matters for the packing: a table of at most ``size``
rows, whatever the number of documents. Bin completion works on that table. It takes the longest
length left, enumerates undominated fillings of the room beside it, and applies one to as many
sequences at once as there are pieces for; it backs up where waste so far shows that no fewer
sequences can come out. Every node's remainder is also packed best fit, and the best of these is
kept as the incumbent; the search ends at the lower bound, or after ``nodes`` nodes.

The plan is a list of fillings with the number of their sequences. A piece finds its place by its
number among the pieces of its length, which follows from its partition and the order inside it.

Null text counts as empty (the end id alone); null and repeated ids are packed like others, row by
row; equal lengths are interchangeable. Without documents there are no pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.taskcontext import TaskContext

from fenloom.llm.common import once
from fenloom.llm.tokens import RunEncoder
from fenloom.llm.words import batches_of, units
from fenloom.session import cut_lineage

Filling = tuple[tuple[int, int], ...]  # (length, copies), longest first


# ---- plans over lengths -----------------------------------------------------------------------


def best_fit(counts: np.ndarray, size: int) -> list[tuple[Filling, int]]:
    """Longest first, each piece into the fullest sequence that has room; equal sequences are handled at once."""
    rooms: list[int] = []
    at: dict[int, list[tuple[Filling, int]]] = {}

    def put(filling: Filling, times: int, room: int) -> None:
        if room not in at:
            at[room] = []
            insort(rooms, room)
        at[room].append((filling, times))

    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                filling, times, room = (), left, size
            else:
                room = rooms[i]
                filling, times = at[room].pop()
                if not at[room]:
                    del at[room], rooms[i]
            fit = room // length
            full = min(times, left // fit)
            if full:
                put((*filling, (length, fit)), full, room - fit * length)
                left -= full * fit
                times -= full
            if left and times and left < fit:
                put((*filling, (length, left)), 1, room - left * length)
                left, times = 0, times - 1
            if times and filling:
                put(filling, times, room)
    return [x for r in rooms for x in at[r]]


def lower_bound(counts: np.ndarray, size: int) -> int:
    """No packing has fewer sequences: pieces above half need one each, and small ones fill only their room."""
    length = np.arange(size + 1)
    number, total = np.cumsum(counts), np.cumsum(counts * length)
    half = size // 2
    small = np.arange(1, half + 1)
    alone = number[size] - number[size - small]
    big = number[size - small] - number[half]
    room = big * size - (total[size - small] - total[half])
    rest = total[half] - total[small - 1] - room
    plain = -(-int(total[size]) // size)
    return max(plain, int((alone + big + np.maximum(-(-rest // size), 0)).max(initial=0)))


def _packs(items: list[int], rooms: list[int]) -> bool:
    """Whether ``items``, longest first, fit into ``rooms``."""
    if not items:
        return True
    return any(r >= items[0] and _packs(items[1:], [*rooms[:i], r - items[0], *rooms[i + 1:]])
               for i, r in enumerate(rooms) if r not in rooms[:i])


def fillings(counts: np.ndarray, size: int, width: int, steps: int) -> list[tuple[Filling, int]]:
    """Undominated fillings of a sequence that holds the longest piece, with their waste, least first.

    A filling dominates another whose pieces fit into its pieces. At most ``width`` are given,
    from those found in ``steps`` steps that try longer pieces first.
    """
    have = np.flatnonzero(counts)[::-1].tolist()
    longest, left = have[0], {x: int(counts[x]) for x in have}
    left[longest] -= 1
    room = size - longest
    if left.get(room, 0):  # fills the room alone: dominates everything
        return [(((longest, 2),) if room == longest else ((longest, 1), (room, 1)), 0)]
    found: list[tuple[int, list[int]]] = []
    chosen: list[int] = []

    def add(room: int, i: int) -> None:
        nonlocal steps
        steps -= 1
        rest = [x for x in have if x <= room and left[x]] if room < have[-1] * 2 or i == len(have) else None
        if room < have[-1] or rest == []:
            found.append((room, chosen.copy()))
            return
        for k in range(i, len(have)):
            x = have[k]
            if x <= room and left[x]:
                left[x] -= 1
                chosen.append(x)
                add(room - x, k)
                chosen.pop()
                left[x] += 1
                if steps <= 0 or sum(w == 0 for w, _ in found) >= width:
                    return

    add(room, 0)
    if not found:  # the steps ran out first
        for x in have:
            while x <= room and left[x]:
                left[x] -= 1
                room -= x
                chosen.append(x)
        found.append((room, chosen))
    found.sort(key=lambda f: (f[0], [-x for x in f[1]]))
    kept: list[tuple[int, list[int]]] = []
    for waste, items in found:
        if len(kept) < width and not any(len(items) <= 12 and _packs(items, other) for _, other in kept):
            kept.append((waste, items))
    out = []
    for waste, items in kept:
        items = [longest, *items]
        out.append((tuple((x, items.count(x)) for x in sorted(set(items), reverse=True)), waste))
    return out


def bin_completion(counts: np.ndarray, size: int, nodes: int = 400, width: int = 6, steps: int = 3000) -> list[tuple[Filling, int]]:
    """Fillings and how many sequences have each; see the module for the search."""
    counts = np.asarray(counts, np.int64)
    total = int((counts * np.arange(size + 1)).sum())
    goal = lower_bound(counts, size)
    best = best_fit(counts, size)
    most = sum(t for _, t in best)

    def children(left: np.ndarray, plan, used: int, waste: int):
        for filling, wasted in fillings(left, size, width, steps):
            times = min(int(left[x]) // k for x, k in filling)
            if wasted:
                times = min(times, ((most - 1) * size - total - waste) // wasted)
            for t in dict.fromkeys((times, 1)) if times > 0 else ():
                rest = left.copy()
                for x, k in filling:
                    rest[x] -= t * k
                yield rest, (plan, (filling, t)), used + t, waste + t * wasted

    def listed(plan) -> list[tuple[Filling, int]]:
        out = []
        while plan:
            plan, last = plan
            out.append(last)
        return out

    stack = [children(counts, None, 0, 0)] if most > goal else []
    while stack and nodes > 0 and most > goal:
        node = next(stack[-1], None)
        if node is None:
            stack.pop()
            continue
        nodes -= 1
        left, plan, used, waste = node
        if used + lower_bound(left, size) >= most:
            continue
        rest = best_fit(left, size)
        if used + sum(t for _, t in rest) < most:
            best, most = listed(plan) + rest, used + sum(t for _, t in rest)
        if left.any():
            stack.append(children(left, plan, used, waste))
    return best


def places(plan: list[tuple[Filling, int]], size: int) -> np.ndarray:
    """A row for each filling and length: length, first number, copies, first sequence, offset.

    Pieces of a length are numbered; those from ``first number`` on go to the filling's sequences,
    ``copies`` to each, side by side from ``offset``.
    """
    rows, taken, sequence = [], [0] * (size + 1), 0
    for filling, times in plan:
        offset = 0
        for length, copies in filling:
            rows.append((length, taken[length], copies, sequence, offset))
            taken[length] += copies * times
            offset += copies * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


# ---- pieces -----------------------------------------------------------------------------------


def _cut(path: str, size: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = once(("runs", path), lambda: RunEncoder(path))
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for b in batches:
            for lo, hi, texts in units(b):
                ids, begin = coder.encode(texts, end)
                n = np.diff(begin)
                per = -(-n // size)
                doc = np.repeat(np.arange(hi - lo), per)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
                start = piece * size
                length = np.minimum(n[doc] - start, size)
                raw = ids.astype("<u4").tobytes()
                a = (begin[doc] + start) * 4
                cuts = [raw[x:y] for x, y in zip(a.tolist(), (a + 4 * length).tolist())]
                order = np.argsort(length, kind="stable")
                first = np.searchsorted(length[order], length[order])
                number = np.empty(len(order), np.int64)
                number[order] = np.arange(len(order)) - first
                number += seen[length]
                seen += np.bincount(length, minlength=size + 1)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(doc + lo)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
                     pa.array([zlib.crc32(c) for c in cuts], pa.int64()), pa.array(np.full(len(doc), part), pa.int64()),
                     pa.array(number), pa.array(cuts, pa.binary())],
                    names=["id", "piece", "start", "length", "ids_crc32", "part", "number", "ids"])

    return run


class Packing:
    """Documents packed into sequences of at most ``size`` tokens."""

    def __init__(self, docs: DataFrame, path: str, size: int = 2048, end: int = 0, id_col: str = "doc_id",
                 text_col: str = "text", nodes: int = 400, width: int = 6):
        self.size = size
        docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
        kind = docs.schema["id"].dataType.simpleString()
        with batches_of(docs.sparkSession):
            self.pieces = cut_lineage(docs.mapInArrow(
                _cut(path, size, end), f"id {kind}, piece int, start long, length long, ids_crc32 long, part long, number long, ids binary"), "pieces")
        self.per_part = cut_lineage(self.pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
        self.counts = np.zeros(size + 1, np.int64)
        for r in self.per_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `size` rows
            self.counts[r["length"]] = r["n"]
        self.plan = bin_completion(self.counts, size, nodes, width)
        self.sequences_used = sum(t for _, t in self.plan)
        self.bound = lower_bound(self.counts, size)

    def placed(self, *more: str) -> DataFrame:
        """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece, and further columns of it."""
        table, keep = places(self.plan, self.size), ["id", "piece", "start", "length", "ids_crc32", *more]
        before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
        base = self.per_part.select("part", "length", before.alias("base"))
        rows = self.pieces.select(*keep, "part", "number").join(base, ["part", "length"])
        rows = rows.select(*keep, (F.col("base") + F.col("number")).alias("number"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key = (table[:, 0] << 48) + table[:, 1]
            for b in batches:
                length, number = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "number"))
                at = np.searchsorted(key, (length << 48) + number, side="right") - 1
                _, first, copies, sequence, offset = table[at].T
                k = number - first
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:-1], pa.array(sequence + k // copies), pa.array(offset + k % copies * length)],
                    names=[*keep, "sequence_id", "offset"])

        fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
        return rows.mapInArrow(run, f"{fields}, sequence_id long, offset long")

    def sequences(self) -> DataFrame:
        """(sequence_id, n_tokens, ids): the ids of each sequence as little-endian unsigned 32-bit integers."""
        parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most `size` tokens
        return self.placed("ids").groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("p")).select(
            "sequence_id", "n_tokens", F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
