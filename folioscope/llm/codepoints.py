"""Positioned code points: batches of strings as flat arrays, mapping tables, and their joins.

A batch of strings is exploded to one array of code points with the row and the position of each
(:func:`explode`). Mapping tables (decompositions, look-alike letters, combining classes, compositions) are
built on the driver from the Unicode character database and a short list of fixed pairs, broadcast, and joined
to the code points by direct lookup. Everything here is array work on whole Arrow batches; no Python runs per
character.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

MAX = 0x110000

# Letters of Cyrillic, Greek, Armenian and Latin extensions whose printed shape equals a Latin letter.
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϳ": "j", "ϲ": "c", "Ϲ": "C",
    "օ": "o", "Օ": "O", "ɑ": "a", "ɡ": "g", "ı": "i",
}

# Compatibility kinds that a reader sees as another mark than their plain letters.
VISIBLE_KINDS = ("<super>", "<sub>", "<circle>", "<square>", "<fraction>", "<vertical>")

# Characters whose compatibility form is a different sight (number sign, trade mark, account of ...).
VISIBLE_CHARS = "№℀℁℅℆℠™℡℻⁇⁈⁉‼"


def _fold_once(ch: str) -> str:
    """One decomposition step that leaves the sight of the character unchanged."""
    d = unicodedata.decomposition(ch)
    if not d:
        return ch
    parts = d.split()
    if parts[0].startswith("<"):
        if parts[0] in VISIBLE_KINDS or ch in VISIBLE_CHARS:
            return ch
        parts = parts[1:]
        if parts[0] == "0020" and len(parts) > 1:  # a spacing accent is a mark of its own
            return ch
    return "".join(chr(int(x, 16)) for x in parts)


def _fold_char(ch: str) -> str:
    while True:
        new = "".join(_fold_once(c) for c in ch)
        if new == ch:
            return ch
        ch = new


@lru_cache(maxsize=1)
def driver_tables() -> dict[str, np.ndarray]:
    """The mapping tables as compact arrays (about 150 kB), to be broadcast.

    dec_key, dec_len, dec_val: characters with another decomposed form; ccc_key, ccc_val: combining classes;
    pair_key, pair_val: canonical compositions, the key being first << 21 | second; like_key, like_val:
    look-alike letters.
    """
    dk: list[int] = []
    dl: list[int] = []
    dv: list[int] = []
    ck: list[int] = []
    cv: list[int] = []
    pairs: dict[int, int] = {}
    for cp in range(MAX):
        if 0xAC00 <= cp < 0xD7A4 or 0xD800 <= cp < 0xF900 or 0x30000 <= cp < 0xE0000 or cp >= 0xE0200:
            continue
        ch = chr(cp)
        if c := unicodedata.combining(ch):
            ck.append(cp)
            cv.append(c)
        if (d := unicodedata.decomposition(ch)) == "":
            continue
        if (f := _fold_char(ch)) != ch:
            dk.append(cp)
            dl.append(len(f))
            dv.extend(map(ord, f))
        if d[0] != "<" and " " in d and unicodedata.normalize("NFC", ch) == ch:
            a, b = (int(x, 16) for x in d.split())
            pairs[a << 21 | b] = cp
    pk = sorted(pairs)
    return {
        "dec_key": np.array(dk, np.int32),
        "dec_len": np.array(dl, np.int32),
        "dec_val": np.array(dv, np.int32),
        "ccc_key": np.array(ck, np.int32),
        "ccc_val": np.array(cv, np.uint8),
        "pair_key": np.array(pk, np.int64),
        "pair_val": np.array([pairs[k] for k in pk], np.int32),
        "like_key": np.array([ord(k) for k in LOOK_ALIKES], np.int32),
        "like_val": np.array([ord(v) for v in LOOK_ALIKES.values()], np.int32),
    }


@lru_cache(maxsize=1)
def _categories() -> tuple[np.ndarray, np.ndarray]:
    """Masks over all code points: blanks; characters that show nothing."""
    blank = np.zeros(MAX, bool)
    hidden = np.zeros(MAX, bool)
    for cp in (*range(0x0, 0x3400), *range(0xFE00, 0x10000), *range(0x1D173, 0x1D17B), *range(0xE0000, 0xE0200)):
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat in ("Zs", "Zl", "Zp") or cp in (9, 10, 11, 12, 13, 0x85):
            blank[cp] = True
        elif cat in ("Cf", "Cc") and not 0x600 <= cp <= 0x605 and cp not in (0x6DD, 0x70F):
            hidden[cp] = True
    hidden[[0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0]] = True
    hidden[0x180B:0x180F] = True
    hidden[0xFE00:0xFE10] = True
    hidden[0xE0100:0xE01F0] = True
    return blank, hidden


def explode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all *texts* in one array, and the offsets of the rows in it; null reads as empty."""
    kept = [t or "" for t in texts]
    off = np.zeros(len(kept) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, kept), np.int64, len(kept)), out=off[1:])
    flat = np.frombuffer("".join(kept).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    return flat, off


def rebuild(flat: np.ndarray, off: np.ndarray) -> list[str]:
    """The strings of the rows again."""
    s = flat.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    o = off.tolist()
    return [s[a:b] for a, b in zip(o, o[1:])]


class Mapper:
    """The broadcast tables spread out for lookup; one per Python worker."""

    def __init__(self, t: dict[str, np.ndarray]):
        self.dec_len = np.ones(MAX, np.int32)
        self.dec_len[t["dec_key"]] = t["dec_len"]
        self.dec_at = np.full(MAX, -1, np.int32)
        self.dec_at[t["dec_key"]] = np.cumsum(t["dec_len"]) - t["dec_len"]
        self.dec_val = t["dec_val"]
        self.ccc = np.zeros(MAX, np.uint8)
        self.ccc[t["ccc_key"]] = t["ccc_val"]
        self.pair_key, self.pair_val = t["pair_key"], t["pair_val"]
        self.like = np.arange(MAX, dtype=np.int32)
        self.like[t["like_key"]] = t["like_val"]
        self.blank, self.hidden = _categories()
        self._wide: np.ndarray | None = None
        # Characters that may need more than their own mapping: hidden, marks, second parts, several letters in one.
        self.hard = self.hidden | (self.ccc > 0)
        self.hard[self.pair_key & 0x1FFFFF] = True
        self.hard[0x1100:0x1200] = True
        self.hard[t["dec_key"]] |= t["dec_len"] > 1
        self.solo = {}
        for like in (False, True):
            lut = np.where(self.blank, 32, self.like if like else np.arange(MAX)).astype(np.int32)
            for k, v in zip(t["dec_key"].tolist(), self._through([chr(k) for k in t["dec_key"].tolist()], like)):
                if len(v) == 1 and not self.blank[ord(v)]:
                    lut[k] = ord(v)
                    self.hard[k] = self.hard[ord(v)] and self.ccc[ord(v)] > 0
                elif not v or v == " ":
                    lut[k] = 32
                else:
                    self.hard[k] = True
            self.solo[like] = lut

    def decompose(self, cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decomposed code points and, for each, the index of the code point it comes from."""
        at = self.dec_at[cps]
        hit = np.flatnonzero(at >= 0)
        if not len(hit):
            return cps, np.arange(len(cps))
        n = np.ones(len(cps), np.int64)
        n[hit] = self.dec_len[cps[hit]]
        src = np.repeat(np.arange(len(cps)), n)
        out = cps[src]
        start = np.cumsum(n) - n
        hn = n[hit]
        where = np.repeat(start[hit], hn) + _ramp(hn)
        out[where] = self.dec_val[np.repeat(at[hit], hn) + _ramp(hn)]
        return out, src

    def order_marks(self, cps: np.ndarray, row: np.ndarray) -> np.ndarray:
        """A permutation that puts combining marks after one starter into the order of their classes, stably."""
        c = self.ccc[cps]
        wrong = (c[1:] > 0) & (c[:-1] > c[1:]) & (row[1:] == row[:-1])
        if not wrong.any():
            return np.arange(len(cps))
        first = np.ones(len(cps), bool)
        first[1:] = (c[1:] == 0) | (row[1:] != row[:-1])
        return np.lexsort((c, np.cumsum(first)))

    def recompose(self, cps: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Canonical composition; returns the code points and the mask of those that stay."""
        out = cps.copy()
        keep = np.ones(len(cps), bool)
        c = self.ccc[cps]
        if not len(cps):
            return out, keep
        first = np.ones(len(cps), bool)
        first[1:] = (c[1:] == 0) | (row[1:] != row[:-1])
        mark = np.flatnonzero(~first)
        if len(mark):
            heads = np.flatnonzero(first)
            head = heads[np.cumsum(first)[mark] - 1]
            last = np.zeros(len(cps), np.uint8)
            nth = mark - head
            for k in range(1, int(nth.max()) + 1):
                m, h = mark[nth == k], head[nth == k]
                new = self._pair(out[h], cps[m])
                ok = (new >= 0) & ((last[h] == 0) | (last[h] < c[m])) & (c[h] == 0)
                out[h[ok]] = new[ok]
                keep[m[ok]] = False
                last[h[~ok]] = c[m[~ok]]
        left = np.flatnonzero(keep)
        if len(left) > 1:  # two starters in sequence that have a composed form
            a, b = left[:-1], left[1:]
            new = np.where((c[b] == 0) & (row[a] == row[b]) & (out[b] > 0x7F), self._pair(out[a], out[b]), -1)
            ok = new >= 0
            ok[1:] &= ~ok[:-1]
            out[a[ok]] = new[ok]
            keep[b[ok]] = False
        return out, keep

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 21 | b.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_val[at], -1)

    def consistent(self, texts: list[str | None], look_alikes: bool = True) -> list[str]:
        """The consistent form of each text: see :func:`folioscope.llm.same_look.consistent_text`.

        Rows in which every character maps alone to one character take one lookup; the others are decomposed,
        ordered and recomposed.
        """
        cps, off = explode(texts)
        row = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(off))
        hard = np.zeros(len(texts), bool)
        hard[row[self.hard[cps]]] = True
        easy = self.solo[look_alikes][cps]
        easy, row = self._squeeze(easy, row)
        new = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.bincount(row, minlength=len(texts)), out=new[1:])
        done = rebuild(easy, new)
        at = np.flatnonzero(hard).tolist()
        for k, t in zip(at, self._through([texts[k] for k in at], look_alikes)):
            done[k] = t
        return done

    def _through(self, texts: list[str | None], look_alikes: bool) -> list[str]:
        """Decompose, drop, order, map, recompose and rebuild."""
        cps, off = explode(texts)
        row = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(off))
        cps, src = self.decompose(cps)
        row = row[src]
        see = ~self.hidden[cps]
        cps, row = cps[see], row[see]
        order = self.order_marks(cps, row)
        cps = cps[order]
        if look_alikes:
            cps = self.like[cps]
        out, keep = self.recompose(cps, row)
        cps, row = out[keep], row[keep]
        cps, row = self._squeeze(np.where(self.blank[cps], 32, cps), row)
        new = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.bincount(row, minlength=len(texts)), out=new[1:])
        done = rebuild(cps, new)
        if len(cps) and ((cps >= 0x1100) & (cps < 0x1200)).any():  # conjoining jamo compose by arithmetic
            done = [unicodedata.normalize("NFC", t) if any("ᄀ" <= ch < "ሀ" for ch in t) else t for t in done]
        return done

    def squeezed(self, texts: list[str | None]) -> list[str]:
        """Each text without blanks at its ends and with each run of blanks as its first blank; else unchanged."""
        cps, off = explode(texts)
        row = np.repeat(np.arange(len(texts)), np.diff(off))
        cps, row = self._squeeze(np.where(self.blank[cps] & (cps < 0x80), 32, cps), row)
        new = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.bincount(row, minlength=len(texts)), out=new[1:])
        return rebuild(cps, new)

    def _squeeze(self, cps: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b = self.blank[cps]
        if not b.any():
            return cps, row
        same = row[1:] == row[:-1]
        keep = np.ones(len(cps), bool)
        keep[0] = not b[0]
        keep[1:] = ~b[1:] | (same & ~b[:-1])
        cps, row, b = cps[keep], row[keep], b[keep]
        if len(cps):
            last = np.ones(len(cps), bool)
            last[:-1] = row[1:] != row[:-1]
            keep = ~(b & last)
            cps, row = cps[keep], row[keep]
        return cps, row

    @property
    def caseless(self) -> np.ndarray:
        """Lookup that joins letters equal up to case or look, transitively; for comparing words only."""
        if self._wide is None:
            rep = np.arange(MAX, dtype=np.int32)
            for cp in (*range(0x41, 0x590), *range(0x10A0, 0x1100), *range(0x1C80, 0x2000), *range(0x2C00, 0x2E00), *range(0xA640, 0xA7F0)):
                low = chr(cp).lower()
                if len(low) == 1:
                    rep[cp] = ord(low)
            group: dict[int, int] = {}

            def find(x: int) -> int:
                while group.get(x, x) != x:
                    x = group[x]
                return x

            for a, b in LOOK_ALIKES.items():
                x, y = find(int(rep[ord(a)])), find(int(rep[ord(b)]))
                if x != y:
                    group[max(x, y)] = min(x, y)
            to = {x: find(x) for x in group}
            for cp in range(0x41, 0x590):
                rep[cp] = to.get(int(rep[cp]), rep[cp])
            rep[0x3C2] = 0x3C3
            self._wide = rep
        return self._wide


def _ramp(n: np.ndarray) -> np.ndarray:
    """0 .. n[0]-1, 0 .. n[1]-1, ..."""
    total = int(n.sum())
    return np.arange(total) - np.repeat(np.cumsum(n) - n, n)


_MAPPERS: dict[int, Mapper] = {}


def worker_mapper(broadcast) -> Mapper:  # noqa: ANN001
    """The mapper of this Python worker for a broadcast of :func:`driver_tables`."""
    key = broadcast._jid if hasattr(broadcast, "_jid") else 0  # noqa: SLF001
    if key not in _MAPPERS:
        _MAPPERS.clear()
        _MAPPERS[key] = Mapper(broadcast.value)
    return _MAPPERS[key]
