"""Near-duplicate documents by DartMinHash.

A document is the multiset of its five-word shingles (one shingle of all its words if it has
fewer). Darts are points of a seeded Poisson process over weight and rank, the same for an
element in every document; those below the element's weight hit, and the hit of lowest rank in
each of ``k`` coordinates is the signature. Two documents agree in a coordinate with probability
sum(min) / sum(max) of their weights, the similarity used here. Darts are thrown slab by slab of
rank until all coordinates are filled, so the work follows the elements, not elements times k.

Documents with equal words (told by two 64-bit hashes) are one class and only classes are
compared. Classes that share a band of the signature are candidates. They are not expanded into
pairs: each bucket first checks its members against one leader (the class that shares most
buckets), links are closed into components, and only buckets whose other members still form
several components are compared as tiles of a matrix product. Every candidate pair is thereby
checked or already in one component. A check compares the sets of (shingle, occurrence) pairs by
32-bit hashes: among n of them about n * n / 2**33 meet by chance, so that with texts of a hundred
thousand words a similarity a few shingles from the threshold may be judged wrongly.

Null and empty texts, and texts without a word, are groups of their own. Rows repeated with one
id are separate rows of one class. Null ids come last when the row that stays is chosen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fenloom.llm.common import by_tile, chosen, chunked, components, in_blocks, packed, roots, small_batches, text_of, unpacked, utf8_parts
from fenloom.session import cut_lineage

FLOOR, FLAT = 12, 4  # rank slabs: [0, 2**-12), doubled up to 2**-4, then all of that length
U = np.uint64


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def unit(h: np.ndarray) -> np.ndarray:
    return (h >> U(11)).astype(np.float64) * 2.0 ** -53


def _slab(s: int) -> tuple[float, float]:
    doubled = FLOOR - FLAT
    if s == 0:
        return 0.0, 2.0 ** -FLOOR
    if s <= doubled:
        return 2.0 ** (s - 1 - FLOOR), 2.0 ** (s - 1 - FLOOR)
    return 2.0 ** -FLAT * (s - doubled), 2.0 ** -FLAT


def _bands(length: float, k: int, top: float) -> Iterator[tuple[float, float]]:
    """Weight regions up to ``top``: doubled, but never with more than about 16 darts an element."""
    cap = 2.0 ** np.floor(np.log2(max(1.0, 16 / (k * length))))
    low, width = 0.0, 1.0
    while low < top:
        yield low, width
        low += width
        width = min(low, cap)


def dart_signatures(element: np.ndarray, weight: np.ndarray, doc: np.ndarray, n_docs: int, k: int, seed: int) -> np.ndarray:
    """``n_docs x k`` names of the first dart of each coordinate; rows of documents without elements are 0.

    Elements are hashes; weights are positive.
    """
    sig = np.zeros(n_docs * k, U)
    free = np.zeros((n_docs, k), bool)
    free[np.unique(doc)] = True
    cells = free.ravel()
    e, w, d, s = element, weight, doc, 0
    with np.errstate(over="ignore"):
        while len(e):
            low, length = _slab(s)
            hits = [_throw(e, w, d, cells, s, low, length, lo, width, k, seed)
                    for lo, width in _bands(length, k, float(w.max()))]
            rank, cell, name = (np.concatenate(x) for x in zip(*hits))
            order = np.lexsort((rank, cell))
            cell, name = cell[order], name[order]
            first = np.flatnonzero(np.diff(cell, prepend=-1))
            sig[cell[first]] = name[first]
            cells[cell[first]] = False
            unfilled = free.any(axis=1)
            if len(first) and not unfilled[d].all():
                left = unfilled[d]
                e, w, d = e[left], w[left], d[left]
            s += 1
    return sig.reshape(n_docs, k)


def _throw(e, w, d, cells, s, low, length, w_low, width, k, seed):
    """The darts of one region that hit a cell still free: (rank, doc * k + coordinate, name)."""
    if w_low > 0:
        over = w > w_low
        e, w, d = e[over], w[over], d[over]
    salt = mixed(np.array([seed * 1_000_003 + s * 8191 + int(w_low * 64)], U))[0]
    # elements are hashes, so one product tells how many darts each has
    u, mean = (e ^ salt) * (salt | U(1)), k * length * width
    p = cdf = np.exp(-mean)
    n, out = 0, []
    at = np.flatnonzero(u > U(min(cdf * 2.0 ** 64, 2.0 ** 64 - 2048)))
    while len(at):
        n += 1
        h = mixed((e[at] ^ salt) + U(n) * U(0x9E3779B97F4A7C15))
        x = at
        if w_low + width > 1 or w_low > 0 or float(w.min()) < 1:
            hit = w_low + width * unit(h) < w[at]
            x, h = at[hit], h[hit]
        h2 = mixed(h + U(1))
        cell = d[x] * k + (((h2 & U(0xFFFFFF)) * U(k)) >> U(24)).astype(np.int64)
        open_ = cells[cell]
        out.append((low + length * unit(h2[open_]), cell[open_], h[open_]))
        p *= mean / n
        cdf += p
        if p < 1e-17 and n > mean:
            break
        at = at[u[at] > U(min(cdf * 2.0 ** 64, 2.0 ** 64 - 2048))]
    if not out:
        return np.zeros(0), np.zeros(0, np.int64), np.zeros(0, U)
    return tuple(np.concatenate(x) for x in zip(*out))


#: Bytes of words (UTF-8 of anything outside ASCII included) and their lower case.
_BYTE = np.arange(256)
IS_WORD = ((_BYTE >= 0x30) & (_BYTE <= 0x39)) | ((_BYTE | 0x20) >= 0x61) & ((_BYTE | 0x20) <= 0x7A) & (_BYTE < 0x80) | (_BYTE >= 0x80)
LOWERED = np.where((_BYTE >= 0x41) & (_BYTE <= 0x5A), _BYTE + 32, _BYTE).astype(np.uint8)


def word_hashes(data: np.ndarray, starts: np.ndarray, piece: int = 1 << 22, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of texts laid end to end in bytes, and where each text's words
    start among them (one entry more than texts). ``is_word`` tells which bytes make up words."""
    found, places, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + piece)
        if end < len(data):  # cut where no word is cut
            gaps = np.flatnonzero(~is_word[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                gaps = np.flatnonzero(~is_word[data[end:]])
                end = end + int(gaps[0]) + 1 if len(gaps) else len(data)
        part = data[at:end]
        inside = is_word[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edge = starts[np.searchsorted(starts, at): np.searchsorted(starts, end)] - at
        first[edge] = inside[edge]
        begin = np.flatnonzero(first)
        if len(begin):
            here = np.arange(len(part)) - begin[np.cumsum(first) - 1]
            here[: begin[0]] = 0
            here[~inside] = 0
            with np.errstate(over="ignore"):
                power = np.cumprod(np.full(int(here.max()) + 1, 0x9E3779B97F4A7C15, U))
                value = np.where(inside, (LOWERED[part].astype(U) + U(1)) * power[here], U(0))
                found.append(mixed(np.add.reduceat(value, begin)))
            places.append(begin + at)
        at = end
    words = np.concatenate(found) if found else np.zeros(0, U)
    place = np.concatenate(places) if places else np.zeros(0, np.int64)
    return words, np.searchsorted(place, starts)


def sequence_hash(words: np.ndarray, starts: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each list of words in its order; 0 for an empty list."""
    n = np.diff(starts)
    nth = np.arange(len(words)) - np.repeat(starts[:-1], n)
    out = np.zeros(len(n), U)
    with np.errstate(over="ignore"):
        if len(words):
            each = mixed(words + mixed(nth.astype(U) + U(salt)))
            out[n > 0] = mixed(np.add.reduceat(each, starts[:-1][n > 0]) + n[n > 0].astype(U))
    return out


def shingles(words: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of word-hash lists laid end to end, and the list each belongs to.

    ``starts`` has one entry more than there are lists.
    """
    n = np.diff(starts)
    with np.errstate(over="ignore"):
        count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
        doc = np.repeat(np.arange(len(n)), count)
        first = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + starts[:-1][doc]
        h = np.zeros(len(doc), U)
        length = np.minimum(n, size)[doc]
        for j in range(size):
            inside = j < length
            word = words[np.minimum(first + j, len(words) - 1)] if len(words) else words
            h = np.where(inside, mixed(h * U(0x9E3779B97F4A7C15) + word + U(j)), h)
    return h, doc


def multiset(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, hash) with counts, in order."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return h[at], doc[at], np.diff(np.append(at, len(h)))


def _signer(k: int, rows: int, size: int, seed: int, per_call: int = 1 << 20):
    def part(data: np.ndarray, starts: np.ndarray) -> list[pa.Array]:
        words, starts = word_hashes(data, starts)
        n_docs = len(starts) - 1
        h, doc = shingles(words, starts, size)
        e, d, n = multiset(h, doc)
        sig = dart_signatures(e, n.astype(float), d, n_docs, k, seed)
        with np.errstate(over="ignore"):
            key = np.full((n_docs, k // rows), U(0))
            for j in range(rows):
                key = mixed(key * U(0x9E3779B97F4A7C15) + sig[:, j::rows][:, : k // rows])
            key = mixed(key + np.arange(k // rows).astype(U))
            # an element met n times counts as n members, so that counts compare as sets
            times = np.repeat(e, n)
            nth = np.arange(len(times)) - np.repeat(np.cumsum(n) - n, n)
            member = mixed(times + nth.astype(U)).astype(np.uint32).view(np.int32)
        bits = np.zeros((n_docs, -(-k // 64) * 64), np.uint8)
        bits[:, :k] = (sig >> U(17)) & U(1)
        sketch = np.packbits(bits, axis=1).view("<i8")
        some = np.diff(starts) > 0
        digests = [pa.array(sequence_hash(words, starts, salt).view(np.int64), mask=~some) for salt in (1, 2)]
        return [*digests, _lists(key[some].ravel().view(np.int64), some * (k // rows), pa.int64()),
                _lists(sketch.ravel(), np.full(n_docs, sketch.shape[1]), pa.int64()),
                _lists(member, np.bincount(doc, minlength=n_docs), pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("text")
            starts, data = utf8_parts(text)
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + per_call, "right")) - 1)
                made = part(data[starts[lo]: starts[hi]], starts[lo: hi + 1] - starts[lo])
                kept = [c for c in b.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([b.column(c).slice(lo, hi - lo) for c in kept] + made,
                                                 names=[*kept, "h1", "h2", "bands", "sketch", "members"])
                lo = hi

    return run


def _lists(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def _linker(permille: int, cells: int = 1 << 24):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def work(key: tuple, rows: pa.Table) -> pa.RecordBatch | None:
        rid, comp, block = (rows[c].to_numpy() for c in ("rid", "comp", "block"))
        lists = rows["members"].combine_chunks()
        size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        doc = np.repeat(np.arange(len(rid)), size)
        _, column, met = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        common = met[column] > 1  # elements of one member take no part
        column, doc = column[common], doc[common]
        order = np.argsort(column, kind="stable")
        column, doc = column[order], doc[order]
        column = np.cumsum(np.diff(column, prepend=column[:1]) > 0) if len(column) else column
        both = np.zeros((len(rid), len(rid)), np.float32)
        step = max(1, cells // len(rid))
        at = 0
        while at < len(column):
            end = int(np.searchsorted(column, column[at] + step))
            x = np.zeros((len(rid), int(column[end - 1] - column[at]) + 1), np.float32)
            x[doc[at:end], column[at:end] - column[at]] = 1
            both += x @ x.T
            at = end
        both = both.astype(np.int64)
        similar = both * 1000 >= permille * (size[:, None] + size[None, :] - both)
        similar &= comp[:, None] != comp[None, :]
        if key[1] != key[2]:
            similar &= block[:, None] != block[None, :]
        a, b = np.nonzero(np.triu(similar, 1))
        if not len(a):
            return None
        root = roots(len(rid), a, b)
        some = np.unique(np.concatenate([a, b]))
        return pa.RecordBatch.from_arrays([pa.array(rid[some]), pa.array(rid[root[some]])], schema=schema)

    return work


class NearDuplicates:
    """Groups of ``docs`` under similarity ``threshold``; tables live in the shared folder.

    ``k`` coordinates are cut into bands of ``band_rows``: with 240 and 6 a pair at the threshold
    of 0.8 shares no band with probability 5e-6. A candidate pair is compared exactly unless its
    sizes rule it out or its one-bit sketches differ in more places than ``6`` standard
    deviations above what the threshold lets expect (1e-9).
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8,
                 size: int = 5, k: int = 240, band_rows: int = 6, seed: int = 1, keep_rows: bool = False,
                 block: int = 1024):
        small_batches(docs.sparkSession)
        self.threshold, self.names, self.block = threshold, docs.columns, block
        self.most_bits = int(k * (1 - threshold) / 2 + 6 * (k * (1 - threshold) / 2 * (1 + threshold) / 2) ** 0.5) + 1
        row = F.col("row")
        rows = packed(docs).select(F.monotonically_increasing_id().alias("rid"), row.getField(id_col).alias("id"),
                                   text_of(row.getField(text_col)).alias("text"), *["row"] * keep_rows)
        kinds = ", ".join(f"{c} {t}" for c, t in rows.drop("text").dtypes)
        # one pass over the texts, written: the numbers given to rows must not depend on a later reading
        self.signed = chunked(rows.mapInArrow(
            _signer(k, band_rows, size, seed),
            f"{kinds}, h1 long, h2 long, bands array<long>, sketch array<long>, members array<int>"),
            docs.rdd.getNumPartitions(), "signed")
        alone = F.col("h1").isNull()
        self.keys = self.signed.select("rid", "id", F.coalesce("h1", "rid").alias("h1"), F.when(alone, 0).otherwise(F.col("h2")).alias("h2"),
                                       alone.alias("alone"))
        best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid"))
        self.classes = cut_lineage(self.keys.groupBy("h1", "h2", "alone").agg(best.alias("best"), F.count("*").alias("copies")).select(
            "h1", "h2", "alone", F.col("best.id").alias("id"), F.col("best.rid").alias("rid"), "copies"), "classes")
        self.groups = self._group()

    def _similar(self, a: Column, b: Column) -> Column:
        both = F.size(F.array_intersect(a, b))
        # in whole numbers, so that 0.8 is met exactly
        permille = round(self.threshold * 1000)
        return both * 1000 >= permille * (F.size(a) + F.size(b) - both)

    def _possible(self) -> Column:
        """What two similar classes must satisfy: sizes within the threshold, sketches near."""
        differ = sum((F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("sketch2")[i])) for i in range(1, 4)),
                     F.bit_count(F.col("sketch")[0].bitwiseXOR(F.col("sketch2")[0])))
        t = self.threshold
        return (F.col("n") >= t * F.col("n2") - 1e-9) & (F.col("n2") >= t * F.col("n") - 1e-9) & (differ <= self.most_bits)

    def _check(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are similar."""
        sets = self.sets
        left = sets.select(F.col("rid").alias("a"), F.col("members").alias("x"))
        right = sets.select(F.col("rid").alias("b"), F.col("members").alias("y"))
        return pairs.join(right, "b").join(left, "a").filter(self._similar(F.col("x"), F.col("y"))).select("a", "b")

    def _group(self) -> DataFrame:
        entries = chosen(self.signed.select("rid", "chunk", "bands"), self.classes.select("rid")).select(
            "rid", F.explode("bands").alias("key"))
        sizes = entries.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
        shared = cut_lineage(entries.join(sizes, "key"), "shared")
        live = cut_lineage(chosen(self.signed.select("rid", "chunk", "sketch", "members"), shared.select("rid").distinct()), "live")
        self.sets = live.select("rid", "members")
        about = live.select("rid", F.size("members").alias("n"), "sketch").join(
            shared.groupBy("rid").agg(F.sum("size").alias("reach")), "rid")
        leaders = shared.select("rid", "key").join(about, "rid").groupBy("key").agg(F.max(F.struct(
            "reach", F.col("rid").alias("a"), F.col("n").alias("n2"), F.col("sketch").alias("sketch2"))).alias("top"))
        led = cut_lineage(shared.select("rid", "key").join(leaders.select("key", "top.a"), "key").filter("a <> rid"), "led")

        pairs = led.select("a", "rid").distinct().join(about.drop("reach"), "rid").join(
            about.select(F.col("rid").alias("a"), F.col("n").alias("n2"), F.col("sketch").alias("sketch2")), "a")
        links = cut_lineage(self._check(pairs.filter(self._possible()).select("a", F.col("rid").alias("b"))), "links")
        links = links.unionByName(cut_lineage(self._rest(led, links), "links"))

        comp = components(links, "a", "b").withColumnRenamed("id", "rid")
        joined = self.classes.join(comp, "rid", "left").withColumn("component", F.coalesce("component", "rid"))
        best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid"))
        groups = joined.groupBy("component").agg(best.alias("best"), F.sum("copies").alias("group_size")).select(
            "component", F.col("best.id").alias("group_id"), F.col("best.rid").alias("keep_rid"), "group_size")
        return cut_lineage(joined.select("h1", "h2", "alone", "component").join(groups, "component").drop("component"), "groups")

    def _rest(self, led: DataFrame, links: DataFrame) -> DataFrame:
        """Links the leaders left open: in buckets whose other members still form several components.

        Such buckets are compared as tiles of a matrix product over their members' elements;
        buckets of the same classes are compared once. A tile returns its links to roots.
        """
        comp = components(links, "a", "b").withColumnRenamed("id", "rid")
        held = led.select("key", "rid").join(comp, "rid", "left").withColumn("comp", F.coalesce("component", "rid")).drop("component")
        several = held.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("c"),
                                          F.sum(F.xxhash64("rid").cast("decimal(38,0)")).alias("who")).filter("low < high")
        several = several.groupBy("who", "c").agg(F.min("key").alias("key")).select("key")
        rows = in_blocks(cut_lineage(held.join(several, "key"), "held"), ["key"], "rid", self.block)
        rows = rows.join(self.sets, "rid")
        return by_tile(rows, ["key", "bi", "bj"], _linker(round(self.threshold * 1000)), "a long, b long")

    def report(self) -> DataFrame:
        """A row per document: id, group_id (the smallest id of its group), group_size, kept."""
        return self.keys.join(self.groups, ["h1", "h2", "alone"]).select(
            "id", "group_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"))

    def kept(self) -> DataFrame:
        """One row of each group, with the columns it came with; needs ``keep_rows``."""
        stay = self.groups.select(F.col("keep_rid").alias("rid")).distinct()
        return unpacked(chosen(self.signed.select("rid", "chunk", "row"), stay), self.names)
