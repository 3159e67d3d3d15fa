"""Words of many texts as flat arrays of hashes, compared as a reader takes them.

Letter case, width, accents, invisible characters and letters that only look alike make no difference; a hyphen at
the end of a line joins its halves. In scripts without blanks each character is a word.
"""

from __future__ import annotations

import unicodedata

import numpy as np

from folioscope.llm.codepoints import MAX, Mapper, explode

SEPARATOR, SKIP, SINGLE = 0, 1, 2


class Words:
    """Splits batches of texts into word hashes; one per Python worker."""

    def __init__(self, mapper: Mapper, keep: str = ""):
        """*keep*: characters that count as letters here, such as the stars of masked words."""
        self.m = mapper
        kind = np.full(MAX, SEPARATOR, np.uint8)
        key = mapper.caseless.copy()
        for cp in (*range(0x3400), *range(0xA640, 0xAC00), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)):
            ch = chr(cp)
            base = unicodedata.normalize("NFKD", ch)
            o = ord(base[0])
            cat = unicodedata.category(base[0])
            key[cp] = mapper.caseless[o]
            if cat[0] in "LN":
                single = 0xE00 <= o < 0xE80 or 0x3040 <= o < 0x3400 or 0x4E00 <= o < 0xA000
                kind[cp] = SINGLE if single else 3
            elif cat[0] == "M":
                kind[cp] = SKIP if o < 0x370 or 0x3099 <= o < 0x309B or 0xE00 <= o < 0xE80 else 3
        kind[0x3400:0xA000] = SINGLE
        kind[0xAC00:0xD7A4] = 3
        kind[mapper.hidden] = SKIP
        for ch in keep:
            kind[ord(ch)] = 3
        self.kind, self.key = kind, key
        self.several = np.zeros(MAX, bool)  # ligatures and the like: letters that stand for several
        for cp in (*range(0x132, 0x134), *range(0x1C4, 0x1CD), *range(0xFB00, 0xFB18), *range(0xFBEA, 0xFDFC), *range(0xFEF5, 0xFEFD)):
            self.several[cp] = len(unicodedata.normalize("NFKC", chr(cp))) > 1
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64)) | np.uint64(1)

    def split(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and the offsets of the texts in them."""
        h, off, *_ = self.spans(texts)
        return h, off

    def spans(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """(hashes, offsets of the texts, code points kept, their start per word, their text)."""
        flat, off = explode(texts)
        row = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(off))
        if self.several[flat].any():
            flat, src = self.m.decompose(flat)
            row = row[src]
        kind = self.kind[flat]
        hyphen = np.flatnonzero((flat == 0x2D) | (flat == 0x2010))
        if len(hyphen):
            a = np.minimum(hyphen + 1, len(flat) - 1)
            brk = hyphen[(flat[a] == 10) & (hyphen > 0) & (kind[np.maximum(hyphen - 1, 0)] == 3) & (kind[np.minimum(a + 1, len(flat) - 1)] == 3)]
            kind[brk] = SKIP
            kind[brk + 1] = SKIP
        see = kind != SKIP
        flat, kind, row = flat[see], kind[see], row[see]
        inside = kind != SEPARATOR
        first = inside.copy()
        if len(first):
            first[1:] &= (kind[:-1] == SEPARATOR) | (kind[1:] == SINGLE) | (kind[:-1] == SINGLE) | (row[1:] != row[:-1])
        flat, row, first = flat[inside], row[inside], first[inside]
        start = np.flatnonzero(first)
        cps = self.key[flat]
        if not len(start):
            return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64), cps, start, row
        nth = np.cumsum(first) - 1
        pos = (np.arange(len(flat)) - start[nth]) & 63
        with np.errstate(over="ignore"):
            h = np.add.reduceat(cps.astype(np.uint64) * self.power[pos], start)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        new = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.bincount(row[start], minlength=len(texts)), out=new[1:])
        return h, new, cps, start, row
