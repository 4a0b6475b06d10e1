"""Token ids of whole texts, each distinct run of characters encoded once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from fenloom.llm.words import coded, joined

LETTER, DIGIT, MARK, OTHER = 1, 2, 3, 4
#: Runs kept from one unit to the next in a Python process; the ones met first are the common ones.
KEPT = 500_000


def _kinds() -> np.ndarray:
    """0 for white space, the kind of a printable ASCII byte, OTHER for what a word must be encoded whole for."""
    out = np.full(256, OTHER, np.uint8)
    out[list(b" \t\n\r\x0b\x0c")] = 0
    out[33:127] = MARK
    out[48:58] = DIGIT
    out[65:91] = out[97:123] = LETTER
    out[list(b"'<")] = OTHER  # contractions and the strings of special tokens
    out[0x80:0xC0] = out[0xC3:0xCA] = LETTER  # U+00C0 to U+027F, see ODD; any other lead byte is OTHER
    return out


#: Between U+00C0 and U+027F: two signs, and a letter that lower case makes two characters.
ODD = ("\u00d7", "\u00f7", "\u0130")


def byte_letters() -> dict[int, str]:
    """The characters that byte-level vocabularies write bytes as: printable ones as they are, others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class RunEncoder:
    """A word-level tokenizers file (lower case, white space dropped; letters, single digits and
    other marks apart) applied to runs of bytes.

    Words of ASCII letters, digits and marks fall into runs as the tokenizer's own splitting does;
    any other word is encoded whole. ``whole`` encodes a text at once and must agree (see the tests).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[bytes, int] = {}
        self.kinds = _kinds()
        self.letters = byte_letters()
        self.normal = self.tokenizer.normalizer.normalize_str
        self.lower = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))
        self.ids, self.at = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _of(self, run: bytes) -> list[int]:
        if run.isalpha():  # of bytes: ASCII letters only
            return [t.id for t in self.model.tokenize(run.decode())]
        text = run.decode()
        if text.isalpha() and max(text) < "\u0280" and not any(c in text for c in ODD):
            return [t.id for t in self.model.tokenize(self.normal(text).encode().decode("latin-1").translate(self.letters))]
        return self.whole(text)

    def _runs(self, data: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Starts and codes of the runs, and the distinct runs by code."""
        kind = self.kinds[np.frombuffer(data, np.uint8)]
        for odd in ODD:
            if odd.encode() in data:
                pair = np.frombuffer(odd.encode(), np.uint8)
                raw = np.frombuffer(data, np.uint8)
                kind[:-1][(raw[:-1] == pair[0]) & (raw[1:] == pair[1])] = OTHER
        edge = kind[1:] != kind[:-1]
        edge |= kind[1:] == DIGIT
        if (kind == OTHER).any():  # no edges inside words that hold such a byte
            starts = np.flatnonzero((kind > 0) & np.concatenate([[True], kind[:-1] == 0]))
            ends = np.flatnonzero((kind > 0) & np.concatenate([kind[1:] == 0, [True]]))
            bad = np.add.reduceat((kind == OTHER).astype(np.int64), starts) > 0
            inner = np.zeros(len(kind) + 1, np.int64)
            np.add.at(inner, starts[bad], 1)
            np.add.at(inner, ends[bad], -1)
            edge &= np.cumsum(inner)[: len(edge)] == 0
        edge &= (kind[1:] > 0) & (kind[:-1] > 0)
        cut = np.flatnonzero(edge) + 1
        if not len(cut):
            starts, codes, found = coded(data, self.kinds == 0)
        else:  # a space at each edge
            raw = np.frombuffer(data, np.uint8)
            wide = np.full(len(raw) + len(cut), 32, np.uint8)
            shift = np.zeros(len(raw), np.int64)
            shift[cut] = 1
            np.cumsum(shift, out=shift)
            wide[np.arange(len(raw)) + shift] = raw
            starts, codes, found = coded(wide.tobytes(), self.kinds == 0)
            starts = starts - np.searchsorted(cut + np.arange(len(cut)), starts)
        return starts, codes, found.to_pylist()

    def _places(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for each run its first place and number of ids in them."""
        known, n = self.known, len(self.known)
        place = np.fromiter((known.get(r, -1) for r in runs), np.int64, len(runs))
        new = np.flatnonzero(place < 0)
        fresh = [self._of(runs[i]) for i in new.tolist()]
        size = np.fromiter(map(len, fresh), np.int64, len(fresh))
        ids = np.concatenate([self.ids, np.fromiter((x for f in fresh for x in f), np.int64, int(size.sum()))])
        at = np.concatenate([self.at, self.at[-1] + np.cumsum(size)])
        place[new] = n + np.arange(len(new))
        if n + len(new) <= KEPT:
            known.update(zip((runs[i] for i in new.tolist()), place[new].tolist()))
            self.ids, self.at = ids, at
        return ids, at[place], at[place + 1] - at[place]

    def encode(self, texts: Sequence[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, the end id after each, and where each text's begin."""
        data, at = joined([t.translate(self.lower) for t in texts])
        starts, codes, runs = self._runs(data)
        ids, first, size = self._places(runs)
        ids = np.append(ids, end)
        first, size = np.append(first, len(ids) - 1), np.append(size, 1)
        stop = np.searchsorted(starts, at[1:])
        codes = np.insert(codes.astype(np.int64), stop, len(first) - 1)
        n = size[codes]
        place = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=place[1:])
        out = ids[np.repeat(first[codes] - place[:-1], n) + np.arange(place[-1])]
        begin = np.zeros(len(texts) + 1, np.int64)
        begin[1:] = place[stop + np.arange(1, len(texts) + 1)]
        return out, begin
