"""SentencePiece encoding with seeded merge-dropout, and its lossless decoding.

The model's merges are applied as its library does: of all adjacent pairs whose join is a piece,
the best-scored is merged first, the leftmost of equals. A pair is skipped when a hash of the key
(seed, epoch, document) and the pair's three places in the text falls below ``dropout``; at 0 the
ids are the library's. Merges never cross from a letter to a following space, nor touch a
character outside the vocabulary, so texts fall into short units; units of a batch are merged
side by side in numpy, long ones with a heap.

Characters outside the vocabulary, and the piece format's own space mark where a text holds it,
become byte pieces, so decoding returns every text exactly. Null text counts as empty and gives
no ids. Rows with equal text and equal key get equal ids; a null id is a key like any other.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, functions as F

from fenloom.llm.common import once, packed, small_batches

SPACE = "▁"
LONG, CALL = 48, 1 << 18
NONE = np.int32(1 << 30)
U = np.uint64


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


class Pieces:
    """The vocabulary of a model as arrays: characters, joins with their order, bytes of each piece."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        plain = {sp.id_to_piece(i): i for i in range(size)
                 if not (sp.is_byte(i) or sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i))}
        self.byte0 = sp.piece_to_id("<0x00>")
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in plain.items():
            if len(p) == 1:
                self.char[ord(" " if p == SPACE else p)] = i
        self.char[ord(SPACE)] = -1
        order = {i: r for r, i in enumerate(sorted(plain.values(), key=lambda i: (-sp.get_score(i), i)))}
        joins = {}
        for p, i in plain.items():
            for cut in range(1, len(p)):
                a, b = plain.get(p[:cut]), plain.get(p[cut:])
                if a is not None and b is not None:
                    joins[a, b] = (order[i], i)
        self.joins = joins
        bits = max(10, int(np.ceil(np.log2(4 * len(joins) + 1))))
        self.mask, self.shift = U((1 << bits) - 1), U(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.rank, self.to = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
        for (a, b), (rank, i) in joins.items():
            key = a << 32 | b
            at = int(self._slot(np.array([key]))[0])
            while self.keys[at] >= 0:
                at = at + 1 & int(self.mask)
            self.keys[at], self.rank[at], self.to[at] = key, rank, i
        self.bytes = [b""] * size
        for p, i in plain.items():
            self.bytes[i] = p.replace(SPACE, " ").encode()
        for v in range(256):
            self.bytes[self.byte0 + v] = bytes([v])

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(U) * U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def join(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order and id of the piece that each pair joins to; order NONE where there is none."""
        key = a.astype(np.int64) << 32 | b
        at = self._slot(key)
        rank, to = np.full(len(key), NONE, np.int32), np.full(len(key), -1, np.int32)
        left = np.arange(len(key))
        while len(left):
            got = self.keys[at[left]]
            hit = left[got == key[left]]
            rank[hit], to[hit] = self.rank[at[hit]], self.to[at[hit]]
            left = left[(got != key[left]) & (got >= 0)]
            at[left] = at[left] + 1 & int(self.mask)
        return rank, to

    def encode(self, texts: list[str | None], keys: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has."""
        out, counts, batch, held = [], np.zeros(len(texts), np.int64), [], 0

        def flush():
            nonlocal held
            if batch:
                ids, n = self._encode([b[1] for b in batch], np.array([keys[b[0]] for b in batch], U),
                                      np.array([b[2] for b in batch]), dropout)
                out.append(ids)
                np.add.at(counts, [b[0] for b in batch], n)
                batch.clear()
                held = 0

        for i, text in enumerate(texts):
            for at, part in _parts(" " + text if text else ""):
                batch.append((i, part, at))
                held += len(part)
                if held >= CALL:
                    flush()
        flush()
        return np.concatenate(out) if out else np.zeros(0, np.int32), counts

    def _encode(self, parts: list[str], keys: np.ndarray, offset: np.ndarray, dropout: float):
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        size = np.array([len(p) for p in parts])
        begin = np.cumsum(size) - size
        part = np.repeat(np.arange(len(parts)), size)
        place = np.arange(len(codes)) - begin[part] + offset[part]
        key = keys[part]
        sid = self.char[codes]
        blank = codes == 32
        edge = np.ones(len(codes), bool)
        edge[1:] = (part[1:] != part[:-1]) | (sid[1:] < 0) | (sid[:-1] < 0) | (blank[1:] & ~blank[:-1])
        start = np.flatnonzero(edge)
        length = np.diff(np.append(start, len(codes)))
        out = np.full(len(codes), -2, np.int32)
        one = start[length == 1]
        out[one] = sid[one]

        def kept(p, q, e):
            if dropout <= 0:
                return np.ones(len(p), bool)
            with np.errstate(over="ignore"):
                h = _mixed(key[p] + place[p].astype(U) * U(0x9E3779B97F4A7C15) + place[q].astype(U) * U(0xD6E8FEB86659FD93)
                           + (place[q] + e - q).astype(U) * U(0xA0761D6478BD642F))
            return (h >> U(11)).astype(np.float64) * 2.0 ** -53 >= dropout

        short = (length > 1) & (length <= LONG)
        self._side_by_side(start[short], length[short], sid, out, kept)
        for s, n in zip(start[length > LONG], length[length > LONG]):
            self._by_heap(int(s), int(n), sid, out, kept)

        at = np.flatnonzero(out != -2)
        ids, of = out[at], part[at]
        raw = ids < 0
        if raw.any():  # characters outside the vocabulary, as bytes
            c = codes[at]
            width = np.where(raw, 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF), 1)
            end = np.cumsum(width)
            full = np.repeat(ids, width)
            utf8 = np.frombuffer(c[raw].tobytes().decode("utf-32-le").encode(), np.uint8)
            full[np.repeat(raw, width)] = utf8.astype(np.int32) + self.byte0
            ids, of = full, np.repeat(of, width)
        return ids, np.bincount(of, minlength=len(parts))

    def _side_by_side(self, start, length, sid, out, kept) -> None:
        unit = np.repeat(np.arange(len(start), dtype=np.int32), length)
        pos = (np.arange(len(unit)) + np.repeat(start - np.cumsum(length) + length, length)).astype(np.int32)
        end, ids = pos + 1, sid[pos]
        rank, to = np.full(len(pos), NONE, np.int32), np.full(len(pos), -1, np.int32)

        def fill(i):
            r, t = self.join(ids[i], ids[i + 1])
            some = r < NONE
            i, r, t = i[some], r[some], t[some]
            ok = kept(pos[i], pos[i + 1], end[i + 1])
            rank[i[ok]], to[i[ok]] = r[ok], t[ok]

        fill(np.flatnonzero(unit[:-1] == unit[1:]))
        while len(unit):
            first = np.flatnonzero(np.diff(unit, prepend=-1))
            best = np.minimum.reduceat(rank, first)
            spread = np.repeat(best, np.diff(np.append(first, len(unit))))
            over = spread == NONE
            out[pos[over]] = ids[over]
            hit = np.flatnonzero((rank == spread) & ~over)
            hit = hit[np.diff(unit[hit], prepend=-1) != 0]
            ids[hit], end[hit] = to[hit], end[hit + 1]
            rank[hit] = NONE
            stay = ~over
            stay[hit + 1] = False
            moved = (np.cumsum(stay) - 1)[hit]
            unit, pos, end, ids, rank, to = (x[stay] for x in (unit, pos, end, ids, rank, to))
            again = moved[moved + 1 < len(unit)]
            again = again[unit[again] == unit[again + 1]]
            before = moved[moved > 0] - 1
            before = before[unit[before] == unit[before + 1]]
            rank[before] = NONE
            fill(np.concatenate([again, before]))

    def _by_heap(self, s: int, n: int, sid, out, kept) -> None:
        ids, after, before = sid[s: s + n].tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list = []

        def offer(i):
            j = after[i]
            found = self.joins.get((ids[i], ids[j])) if i >= 0 and j < n else None
            if found and kept(np.array([s + i]), np.array([s + j]), np.array([s + after[j]]))[0]:
                heapq.heappush(heap, (found[0], i, j, after[j], found[1]))

        for i in range(n - 1):
            offer(i)
        gone = [False] * n
        while heap:
            _, i, j, e, to = heapq.heappop(heap)
            if gone[i] or gone[j] or after[i] != j or after[j] != e:
                continue
            ids[i], after[i], gone[j] = to, e, True
            if e < n:
                before[e] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        i = 0
        while i < n:
            out[s + i] = ids[i]
            i = after[i]

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join([self.bytes[i] for i in ids.tolist()])
        return raw[1:].decode() if raw[:1] == b" " else raw.decode()


def _parts(text: str) -> Iterator[tuple[int, str]]:
    """A long text cut where a space follows another character, which no merge crosses."""
    at = 0
    while len(text) - at > 2 * CALL:
        cut = re.compile("[^ ] ").search(text, at + CALL)
        if not cut:
            break
        yield at, text[at: cut.start() + 1]
        at = cut.start() + 1
    if at < len(text):
        yield at, text[at:]


def pieces(path: str) -> Pieces:
    return once(("pieces", path), lambda: Pieces(path))


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))


def text_from(ids: Column, path: str) -> Column:
    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        p = pieces(path)
        flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        return pa.array([p.decode(flat[a:b]) for a, b in zip(at[:-1], at[1:])], pa.string())

    return decode(ids)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", dropout: float = 0.1,
                     seed: int = 5, epoch: int = 0, check: bool = False) -> DataFrame:
    """(row, ids) for each document; the draw's key is (seed, epoch, id).

    A step of its own, as a column of ids would be worked out again for each use. ``check`` adds ``lossless``,
    whether the ids decode to the text: in the same Python worker, where :func:`text_from` takes a second one.
    """
    small_batches(docs.sparkSession)
    row = F.col("row")
    rows = packed(docs).select("row", row.getField(text_col).alias("text"),
                               F.xxhash64(F.lit(seed), F.lit(epoch), row.getField(id_col)).alias("key"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for b in batches:
            texts = b.column("text").to_pylist()
            ids, counts = p.encode(texts, b.column("key").to_numpy().view(U), dropout)
            out = {"row": b.column("row"), "ids": _lists(ids, counts)}
            if check:
                ends = np.cumsum(counts)
                out["lossless"] = pa.array([p.decode(ids[e - n: e]) == (t or "") for t, n, e in zip(texts, counts, ends)], pa.bool_())
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return rows.mapInArrow(encode, f"row {dict(rows.dtypes)['row']}, ids array<int>" + ", lossless boolean" * check)
