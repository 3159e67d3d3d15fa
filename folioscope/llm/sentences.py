"""Sentence boundaries across languages and scripts.

The characters of a text become symbols (letter, digit, opening quotation mark, full stop that may end a sentence,
full stop of an abbreviation ...), and a finite transducer over these symbols marks the first character of each
sentence. :mod:`folioscope.llm.transducer` runs it on chunks composed by a parallel prefix scan.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.codepoints import MAX, Mapper, driver_tables, explode, worker_mapper
from folioscope.llm.transducer import Transducer

# Abbreviations whose full stop never ends a sentence inside a paragraph.
NEVER = """
dr prof mr mrs ms st fig figs eq eqs sec ch vol vs approx cf ed eds pp tab app ref refs dept mt gen col capt lt rev hon
abb kap bzw ca vgl tsd mio mrd str hr fr nr inkl evtl ggf sog bspw zzgl abs art bd hrsg geb allg max min
рис табл стр гл прил разд ред им проф акад доц инж ул пр просп пл пос дер обл корп каб лаб кв ок прим прибл напр
св гр тел адр изд сост отв зам зав ср см пп гос руб коп тыс млн млрд
""".split()
# Abbreviations that can close a sentence.
MAYBE = """
etc jun sen jr sr inc ltd co corp bros usw ff al др пр проч
""".split()
# Abbreviations only before a number.
NUMBERED = "no nos p c с т п ч н".split()
# Pairs of abbreviated words, written with or without a blank.
PAIR_NEVER = [p.split() for p in "e g|i e|d h|z b|u a|o ä|т е|т к|т н|т о|и о|б у".split("|")]
PAIR_MAYBE = [p.split() for p in "т д|т п|u s|u k|a m|p m|ph d|н э|у е".split("|")]
# German words before an ordinal number and names that follow one.
BEFORE_ORDINAL = "am im dem der den des vom zum zur beim bis ab seit die das jeder jedem jeden vor nach".split()
AFTER_ORDINAL = (
    "januar jänner februar märz april mai juni juli august september oktober november dezember "
    "jahrhundert jahrhunderts jahrtausend"
).split()
# Hindi abbreviations.
HINDI = "डॉ श्री प्रो सं पृ कि ग्रा मी रु स्व पं कु".split()

# Character classes.
(C_OTHER, C_UP, C_LOW, C_LETTER, C_THAI, C_DIGIT, C_BLANK, C_STOP, C_ASK, C_FULL, C_DOTS, C_QOPEN, C_BOPEN, C_CLOSE,
 C_DASH, C_COMMA, C_COLON, C_MARK, C_QUOTE, C_END) = range(20)
# Symbols of the transducer.
(NOP, UP, LOW, LETTER, DIGIT, HARD, SOFT, DOTS, FULL, ITEM_STOP, Q_UP, Q_LOW, B_UP, B_LOW, CLOSE, DASH, DASH_UP, COMMA,
 COLON, OTHER, THAI_BLANK, CAMEL, ITEM, BODY) = range(24)
PENDING = ("hard", "soft", "full")
TERMINATORS = {HARD: "hard", ITEM_STOP: "hard", SOFT: "soft", DOTS: "soft", FULL: "full"}


def step(state: tuple, sym: int) -> tuple[tuple, bool]:
    """Next state, and whether a sentence starts at this symbol.

    States: ("start",), ("number",), ("body",), ("colon",) after a colon; ("hard",), ("soft",), ("full",) after a
    mark that ends a sentence for sure, perhaps, or in scripts without capitals; ("thai",) after a blank between
    Thai letters; ("in", origin, marked) inside the outermost quotation marks or brackets, origin telling where they
    opened ("s"tart of a sentence, after a "c"olon, "m"iddle, "b"racket in the middle), marked that the last
    character could end a sentence; ("after", origin) behind them, when it was marked. Marks nested inside others, to
    any depth, are paired before and reach the transducer as OTHER (opening) and NOP (closing).
    """
    phase = state[0]
    if sym == NOP:
        return state, False
    if phase == "in":
        return _inside(state, sym), False
    if phase in ("hard", "soft", "full", "after", "thai"):
        verdict = _decide(state, sym)
        if verdict == "stay":
            return state, False
        if verdict == "start":
            return step(("start",), sym)[0], True
        if verdict != "body":
            return verdict, False
        phase = "body"
    if sym == THAI_BLANK:
        return (state if phase == "start" else ("thai",)), False
    if sym in (Q_UP, Q_LOW, B_UP, B_LOW):
        origin = {"start": "s", "colon": "c"}.get(phase, "m" if sym in (Q_UP, Q_LOW) else "b")
        return ("in", origin, False), False
    if phase == "start":
        return (("number",) if sym in (DIGIT, ITEM) else ("body",)), False
    if phase == "number" and sym in (DIGIT, ITEM, BODY, ITEM_STOP):
        return (("body",) if sym == ITEM_STOP else state), False
    if sym in TERMINATORS:
        return (TERMINATORS[sym],), False
    if sym == COLON or (phase == "colon" and sym in (DASH, DASH_UP)):
        return ("colon",), False
    return ("body",), False


def _inside(state: tuple, sym: int) -> tuple:
    _, origin, marked = state
    if sym == CLOSE:
        return ("after", origin) if marked else ("body",)
    if sym == THAI_BLANK:
        return state
    return ("in", origin, sym in (HARD, ITEM_STOP, FULL, DOTS))


def _decide(state: tuple, sym: int) -> str | tuple:
    """What a symbol after a possible end does: "start" of a sentence, "stay", go on in the "body", or a state."""
    phase = state[0]
    if phase == "thai":
        return "start"
    if sym in TERMINATORS:
        kind = TERMINATORS[sym]
        if phase == "after":
            return (kind,)
        return (max(phase, kind, key=("soft", "hard", "full").index),)
    if sym == CLOSE:
        return "stay"
    if sym in (COMMA, COLON, BODY):
        return ("colon",) if sym == COLON else "body"
    if sym == THAI_BLANK:
        return "body"
    if phase == "full":
        return "start"
    if sym in (LOW, Q_LOW, B_LOW, DASH):
        return "body"
    if phase == "hard":
        return "start"
    if phase == "soft":
        return "start" if sym in (UP, CAMEL, ITEM, Q_UP, B_UP) else "body"
    origin = state[1]  # after a closing quotation mark or bracket
    if sym == DASH_UP or origin == "b":
        return "body"
    if sym == LETTER:
        return "start" if origin == "c" else "body"
    return "start"


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    """The compiled boundary rules."""
    return Transducer(("start",), 24, step)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point, by its compatibility form."""
    c = np.full(MAX, C_OTHER, np.uint8)
    c[0x3400:0xA4D0] = C_LETTER
    c[0xAC00:0xD7A4] = C_LETTER
    c[0x20000:0x32000] = C_LETTER
    fixed = dict.fromkeys(".", C_STOP) | dict.fromkeys("!?؟‽⁇⁈⁉‼՞", C_ASK) | dict.fromkeys("。।॥۔።", C_FULL)
    fixed |= {"…": C_DOTS, "‥": C_DOTS, '"': C_QUOTE} | dict.fromkeys(",;،؛、·•/\\", C_COMMA) | {":": C_COLON}
    fixed |= dict.fromkeys("–—―‒-‐‑", C_DASH)
    for cp in (*range(0x3400), *range(0xA4D0, 0xAC00), *range(0xF900, 0x10000), *range(0x10000, 0x10800), *range(0x1D400, 0x1D800)):
        ch = chr(cp)
        if ch not in fixed:
            ch = unicodedata.normalize("NFKC", ch)[:1] or ch
        cat = unicodedata.category(ch)
        o = ord(ch)
        if ch in fixed:
            c[cp] = fixed[ch]
        elif 0xE01 <= o <= 0xE4E and o != 0xE3F:
            c[cp] = C_THAI
        elif 0x300 <= o < 0x370:
            c[cp] = C_MARK
        elif cat in ("Lu", "Lt"):
            c[cp] = C_UP
        elif cat == "Ll":
            c[cp] = C_LOW
        elif cat[0] in "LM":
            c[cp] = C_LETTER
        elif cat[0] == "N":
            c[cp] = C_DIGIT
        elif cat in ("Pi", "Ps"):
            c[cp] = C_BOPEN if cat == "Ps" and ch not in "「『《〈„‚" else C_QOPEN
        elif cat in ("Pf", "Pe"):
            c[cp] = C_CLOSE
    for ch in "«“„‟「『《〈":
        c[ord(ch)] = C_QOPEN
    for ch in "»”」』》〉":
        c[ord(ch)] = C_CLOSE
    c[[ord(ch) for ch in "‘’‚‛‹›'`´"]] = C_OTHER
    return c


class Splitter:
    """Symbols and sentences for batches of texts; one per Python worker."""

    def __init__(self, mapper: Mapper):
        self.m = mapper
        self.cls = _classes().copy()
        self.cls[mapper.blank] = C_BLANK
        key = mapper.caseless.copy().astype(np.uint64)
        for cp in (*range(0xC0, 0x590), *range(0x1E00, 0x2000), *range(0xFF00, 0xFFA0), *range(0x1D400, 0x1D800)):
            base = unicodedata.normalize("NFKD", chr(cp))[:1]
            key[cp] = mapper.caseless[ord(base)]
        self.key = key
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64)) | np.uint64(1)
        self.never = self._set([*NEVER, *HINDI])
        self.maybe = self._set(MAYBE)
        self.numbered = self._set(NUMBERED)
        self.year = self._set(["г", "гг", "в", "вв"])
        self.pair_never = self._pairs(PAIR_NEVER)
        self.pair_maybe = self._pairs(PAIR_MAYBE)
        self.before_ordinal = self._set(BEFORE_ORDINAL)
        self.after_ordinal = self._set(AFTER_ORDINAL)
        self.label = self._set("прил приложение app fig figs рис табл abb kap sec tab plan".split())
        self.vowel = np.isin(key, key[[ord(ch) for ch in "aeiouyаеиоуыэюяäöü"]])
        self.fsm = transducer()
        self.is_letter = np.isin(np.arange(20), (C_UP, C_LOW, C_LETTER, C_THAI, C_MARK))
        self.is_strong = np.isin(np.arange(20), (C_UP, C_LETTER, C_QOPEN))

    def _hash(self, word: str) -> np.uint64:
        cps = np.array([ord(ch) for ch in word], np.int64)
        cps = cps[self.cls[cps] != C_MARK]
        with np.errstate(over="ignore"):
            return np.sum(self.key[cps] * self.power[: len(cps)], dtype=np.uint64)

    def _set(self, words: list[str]) -> np.ndarray:
        return np.unique(np.array([self._hash(w) for w in words], np.uint64))

    def _pairs(self, pairs: list[list[str]]) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.unique(np.array([self._hash(a) * np.uint64(31) + self._hash(b) for a, b in pairs], np.uint64))

    def split(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, start, end) of each sentence of each text, in order."""
        flat, off = explode([(t or "") + "\x00" for t in texts])  # a sentinel closes each text
        cls_all = self.cls[flat]
        ends = off[1:] - 1
        cls_all[ends] = C_END
        see = ~self.m.hidden[flat]
        see[ends] = True
        src = np.flatnonzero(see)
        cps, cls = flat[src], cls_all[src]
        sym = self._symbols(cps, cls)
        new = np.searchsorted(src, off)
        sym[new[1:] - 1] = NOP
        start = self.fsm.run(sym, new)
        real = (cls != C_BLANK) & (cls != C_END)
        at = np.flatnonzero(real)
        first = start[at]
        lead = np.searchsorted(at, new[:-1])  # the first character shown of each text
        first[lead[lead < np.searchsorted(at, new[1:])]] = True
        b = np.flatnonzero(first)
        e = np.append(b[1:], len(at)) - 1
        if not len(b):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows = np.searchsorted(new, at[b], side="right") - 1
        return rows, src[at[b]] - off[rows], src[at[e]] + 1 - off[rows]

    def _symbols(self, cps: np.ndarray, cls: np.ndarray) -> np.ndarray:
        n = len(cps)
        idx = np.arange(n, dtype=np.int32)
        table = np.full(20, OTHER, np.uint8)
        for c, s in ((C_UP, UP), (C_LOW, LOW), (C_LETTER, LETTER), (C_THAI, LETTER), (C_DIGIT, DIGIT), (C_BLANK, NOP),
                     (C_STOP, HARD), (C_ASK, HARD), (C_FULL, FULL), (C_DOTS, DOTS), (C_QOPEN, Q_UP), (C_BOPEN, B_UP),
                     (C_CLOSE, CLOSE), (C_DASH, DASH), (C_COMMA, COMMA), (C_COLON, COLON), (C_MARK, NOP),
                     (C_END, NOP)):
            table[c] = s
        letter = self.is_letter[cls]
        digit = cls == C_DIGIT
        blank = cls == C_BLANK
        # neighbours: the next and the previous character that is no blank
        nxt = np.minimum.accumulate(np.where(blank, n, idx)[::-1])[::-1]
        prv = np.maximum.accumulate(np.where(blank, -1, idx))
        inner = self._quotes(cps, cls)
        sym = table[cls]
        c1 = np.append(cls[1:], C_END)  # class of the next character
        c0 = np.append(C_END, cls[:-1])
        after = np.append(nxt[1:], n)  # next character behind this one that is no blank
        ca = np.append(cls, C_END)[after]
        # words and numbers: start and end of the run each character lies in
        w_first = letter & ~np.append(False, letter[:-1])
        w_start = np.maximum.accumulate(np.where(w_first, idx, 0))
        d_first = digit & ~np.append(False, digit[:-1])
        d_start = np.maximum.accumulate(np.where(d_first, idx, 0))

        sym[(cls == C_LOW) & w_first & (c1 == C_UP)] = CAMEL
        opening = (cls == C_QOPEN) | (cls == C_BOPEN)
        weak = opening & ((ca == C_LOW) | (ca == C_DIGIT))
        sym[weak & (cls == C_QOPEN)] = Q_LOW
        sym[weak & (cls == C_BOPEN)] = B_LOW
        sym[(cls == C_DASH) & (c1 == C_BLANK) & self.is_strong[ca]] = DASH_UP
        sym[(cls == C_DASH) & letter[np.maximum(idx - 1, 0)] & (c1 != C_BLANK)] = BODY
        # question and exclamation marks inside words and addresses
        sym[(cls == C_ASK) & ((c1 == C_LOW) | (c1 == C_DIGIT))] = BODY
        # blanks between Thai letters
        thai = np.flatnonzero(blank & (c0 == C_THAI) & (ca == C_THAI))
        thai = thai[~np.isin(cps[after[thai]], (0xE2F, 0xE46))]
        sym[thai] = THAI_BLANK
        self._stops(cps, cls, sym, idx, letter, digit, prv, c0, c1, ca, after, w_start, d_start)
        sym[inner] = np.where(cls[inner] == C_CLOSE, NOP, OTHER)
        return sym

    def _stops(self, cps, cls, sym, idx, letter, digit, prv, c0, c1, ca, after, w_start, d_start) -> None:  # noqa: ANN001
        """Which full stops end a sentence, may end one, or belong to an abbreviation or a number."""
        stop = cls == C_STOP
        many = stop & ((c0 == C_STOP) | (c1 == C_STOP))
        sym[many] = DOTS
        p = np.flatnonzero(stop & ~many)
        if not len(p):
            return
        kind = np.full(len(p), HARD, np.uint8)
        before = np.maximum(p - 1, 0)
        word = letter[before] & (p > 0)
        number = digit[before] & (p > 0)
        ws = w_start[before]
        length = np.where(word, p - ws, 0)
        h = self._hash_spans(cps, cls, ws, length)
        # the token before the word: the character before it, and whether a blank lies between
        q = np.where(word, prv[np.maximum(ws - 1, 0)], -1)
        q = np.where(ws == 0, -1, q)
        qc = np.where(q >= 0, cls[np.maximum(q, 0)], C_END)
        q_stop = (qc == C_STOP) & (q > 0)
        pw_end = np.where(q_stop, q - 1, q)  # last letter of the word before, across its full stop
        pw_end = np.where(q_stop, prv[np.maximum(pw_end, 0)], pw_end)
        has_pw = (pw_end >= 0) & letter[np.maximum(pw_end, 0)]
        pws = w_start[np.maximum(pw_end, 0)]
        ph = self._hash_spans(cps, cls, pws, np.where(has_pw, pw_end + 1 - pws, 0))
        with np.errstate(over="ignore"):
            pair = ph * np.uint64(31) + h
        direct = q_stop & (q == ws - 1)
        last = cls[before]
        first = np.where(word, cls[ws], C_END)
        marks = np.append(0, np.cumsum(cls == C_MARK, dtype=np.int32))
        letters = length - np.where(word, marks[p] - marks[np.minimum(ws, p)], 0)
        one = word & (letters == 1)
        after_number = (qc == C_DIGIT) & word
        # a year phrase that opens the sentence ("В 1993 г. ...") goes on
        ns = d_start[np.maximum(q, 0)]
        cap = np.where(after_number & (ns > 0), prv[np.maximum(ns - 1, 0)], -1)
        leads = (cap >= 0) & letter[np.maximum(cap, 0)] & (cls[w_start[np.maximum(cap, 0)]] == C_UP)
        cased = (first == C_UP) | (first == C_LOW)
        hindi = word & (cps[ws] >= 0x900) & (cps[ws] < 0x980)
        v = np.append(0, np.cumsum(self.vowel[cps], dtype=np.int32))
        no_vowel = word & (first == C_LOW) & (letters >= 2) & (letters <= 4) & (v[p] == v[np.minimum(ws, p)])

        kind[no_vowel] = SOFT
        kind[word & (first == C_LETTER) & one] = BODY
        kind[hindi & ((letters <= 3) | direct)] = BODY
        kind[word & (last == C_THAI)] = BODY
        kind[one & (first == C_LOW)] = np.where(after_number, SOFT, BODY)[one & (first == C_LOW)]
        kind[one & (first == C_UP)] = self._initials(p, ws, one & (first == C_UP), cps, cls, letter, prv, w_start, q, ph, q_stop, after)
        known = word & _in(h, self.never)
        kind[known] = BODY
        kind[word & _in(h, self.maybe)] = SOFT
        kind[word & _in(h, self.numbered) & (ca[p] == C_DIGIT) & ~after_number] = BODY
        year = word & _in(h, self.year)
        kind[year] = np.where(after_number & ~leads, SOFT, BODY)[year]
        pairs = q_stop & has_pw & word & cased
        pairs &= direct | (first == C_LOW) | ~one  # capitals apart are initials, not one abbreviation
        kind[pairs & _in(pair, self.pair_never)] = BODY
        kind[pairs & _in(pair, self.pair_maybe)] = SOFT
        # numbers
        ds = d_start[before]
        digits = np.where(number, p - ds, 0)
        kind[number & (digits <= 3) & (c1[p] == C_BLANK)] = ITEM_STOP
        b = np.where(number & (ds > 0), prv[np.maximum(ds - 1, 0)], -1)
        wb = (b >= 0) & letter[np.maximum(b, 0)]
        bs = w_start[np.maximum(b, 0)]
        german = wb & _in(self._hash_spans(cps, cls, bs, np.where(wb, b + 1 - bs, 0)), self.before_ordinal)
        a = np.minimum(after[p], len(cps) - 1)
        run = np.append(idx[1:][letter[:-1] & ~letter[1:]], len(cps))  # ends of words
        a_end = run[np.minimum(np.searchsorted(run, a, side="right"), len(run) - 1)]
        named = letter[a] & _in(self._hash_spans(cps, cls, a, np.where(letter[a], a_end - a, 0)), self.after_ordinal)
        kind[number & (digits <= 2) & (ca[p] == C_UP) & (german | named)] = BODY
        # no blank behind the full stop
        soft = kind == SOFT
        never = kind == BODY
        tight = (c1[p] == C_DIGIT) | (c1[p] == C_LOW)
        kind[tight] = BODY
        camel = (c1[p] == C_LOW) & (np.append(cls[2:], (C_END, C_END))[p] == C_UP)  # "... pH" without a blank
        up = (c1[p] == C_UP) | camel
        c2 = np.append(cls[2:], (C_END, C_END))[p]
        opens = (c2 == C_LOW) | (c2 == C_BLANK) | (c2 == C_MARK) | camel
        long_word = word & (letters >= 2) & ((last == C_LOW) | (last == C_MARK) | (last == C_LETTER) & ~hindi)
        joined = opens & (long_word & ~never | ~word & (c0[p] != C_BLANK))
        kind[up] = np.where(joined, np.where(soft, SOFT, HARD), BODY)[up]
        script = (c1[p] == C_LETTER) | (c1[p] == C_THAI)
        kind[script] = np.where(word & (letters >= 2) & (last == C_LETTER) & ~hindi, HARD, BODY)[script]
        sym[p] = kind
        # a number that opens a list item
        item = p[(kind == ITEM_STOP) & np.isin(ca[p], (C_UP, C_LETTER)) & number]
        s = d_start[item - 1]
        sym[s[(s == 0) | np.isin(cls[np.maximum(s - 1, 0)], (C_BLANK, C_END))]] = ITEM

    def _initials(self, p, ws, one, cps, cls, letter, prv, w_start, q, ph, q_stop, after) -> np.ndarray:  # noqa: ANN001
        """Full stops after single capitals: initials before a name go on; behind a surname the last may end."""
        k = np.flatnonzero(one)
        out = np.full(len(k), BODY, np.uint8)
        end = np.where(q[k] >= 0, q[k], -1)  # character before the initial, walking back over earlier initials
        for _ in range(3):
            e = np.maximum(end, 0)
            back = (end > 0) & (cls[e] == C_STOP)
            l = np.where(back, prv[np.maximum(e - 1, 0)], -1)
            lw = np.maximum(l, 0)
            init = back & (l >= 0) & (cls[lw] == C_UP) & (w_start[lw] == lw)
            if not init.any():
                break
            end = np.where(init, np.where(lw > 0, prv[np.maximum(lw - 1, 0)], -1), end)
        e = np.maximum(end, 0)
        name = (end >= 0) & np.isin(cls[e], (C_LOW, C_MARK))
        s = w_start[e]
        marks = np.append(0, np.cumsum(cls == C_MARK))
        name &= (cls[s] == C_UP) & (e - s - (marks[e] - marks[s]) >= 2)
        b = np.where(s > 0, prv[np.maximum(s - 1, 0)], -1)  # a name that opens the sentence says nothing
        name &= (b >= 0) & ~np.isin(cls[np.maximum(b, 0)], (C_STOP, C_ASK, C_FULL, C_END, C_DOTS, C_CLOSE))
        a = np.minimum(after[p[k]], len(cps) - 1)
        name &= ~((cls[a] == C_UP) & (cls[np.minimum(a + 1, len(cps) - 1)] == C_STOP))  # another initial follows
        out[name] = SOFT
        lab = q_stop[k] & _in(ph[k], self.label)
        out[lab] = SOFT
        return out

    def _quotes(self, cps: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Settle which marks open and close: straight ones by their side, low-high pairs, marks without partner.

        Returns the places of the marks that lie inside others, however deep.
        """
        ends = np.flatnonzero(cls == C_END)
        if (cps == 0x201E).any():
            pos = np.flatnonzero((cps == 0x201E) | (cps == 0x201C))
            high = cps[pos] == 0x201C
            text = np.searchsorted(ends, pos)
            opened, closed = np.cumsum(~high), np.cumsum(high)
            at = np.searchsorted(text, text)  # first such mark of the same text
            o = opened - (opened[at] - ~high[at])
            c = closed - (closed[at] - high[at])
            cls[pos[high & (o >= c)]] = C_CLOSE
        straight = np.flatnonzero(cls == C_QUOTE)
        if len(straight):
            before = np.append(C_END, cls[:-1])[straight]
            cls[straight] = np.where(np.isin(before, (C_BLANK, C_END, C_BOPEN, C_DASH)), C_QOPEN, C_CLOSE)
        marks = np.flatnonzero((cls == C_QOPEN) | (cls == C_BOPEN) | (cls == C_CLOSE))
        if not len(marks):
            return marks
        text = np.searchsorted(ends, marks)
        d = np.where(cls[marks] == C_CLOSE, -1, 1)
        depth = np.cumsum(d)
        start = np.append(True, text[1:] != text[:-1])
        at = np.flatnonzero(start)
        size = np.diff(np.append(at, len(marks)))
        base = np.repeat(depth[at] - d[at], size)
        rel = depth - base
        last = np.append(at[1:], len(marks)) - 1
        wrong = (np.minimum.reduceat(rel, at) < 0) | (rel[last] != 0)
        for k in np.flatnonzero(wrong).tolist():  # texts with unpaired marks only
            stack: list[int] = []
            for i in marks[at[k] : at[k] + size[k]].tolist():
                if cls[i] != C_CLOSE:
                    stack.append(i)
                elif stack:
                    stack.pop()
            for i in stack:
                cls[i] = C_OTHER
        # depth of each mark; a closing mark without partner, seen outside all others, does not count
        paired = cls[marks] != C_OTHER
        marks, text, d = marks[paired], text[paired].astype(np.int64), d[paired].astype(np.int64)
        far = np.int64(2 * len(cls) + 2)  # sums of one text stay below those of the text before
        total = np.cumsum(d) - text * far
        before = np.append(0, np.cumsum(d)[:-1]) - text * far
        floor = np.minimum.accumulate(np.minimum(before, total))
        new = np.append(True, text[1:] != text[:-1]) if len(text) else np.zeros(0, bool)
        base = np.repeat(before[new], np.diff(np.append(np.flatnonzero(new), len(text))))
        depth = np.where(d > 0, before, total) - np.minimum(floor, base)  # around an opening, behind a closing mark
        return marks[depth > 0]

    def _hash_spans(self, cps: np.ndarray, cls: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Hash of the word in each span; zero where the span is empty or longer than any listed word."""
        out = np.zeros(len(start), np.uint64)
        at = np.flatnonzero((length > 0) & (length <= 24))
        if not len(at):
            return out
        most = int(length[at].max())
        pos = np.zeros(len(at), np.int64)
        acc = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(most):
                i = np.minimum(start[at] + k, len(cps) - 1)
                use = (k < length[at]) & (cls[i] != C_MARK)
                acc += np.where(use, self.key[cps[i]] * self.power[pos], np.uint64(0))
                pos += use
        out[at] = acc
        return out


def _in(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return (table[at] == h) & (h != 0)


_SPLITTER: list[Splitter] = []


def worker_splitter(broadcast) -> Splitter:  # noqa: ANN001
    """The splitter of this Python worker."""
    m = worker_mapper(broadcast)
    if not _SPLITTER or _SPLITTER[0].m is not m:
        _SPLITTER[:] = [Splitter(m)]
    return _SPLITTER[0]


def sentences(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row (keys..., start_pos, end_pos) per sentence of each row's *text*.

    Positions count code points from 0, the end is exclusive. Null, empty and blank texts give no rows; texts of
    any length are read whole (a long one is cut into chunks whose transition functions are composed); other
    columns are left aside, whatever their names. The result has as many rows per key as the input has rows for
    it: rows are not merged.
    """
    spark = df.sparkSession
    tables = spark.sparkContext.broadcast(driver_tables())
    kept = df.select(*keys, F.col(text).cast("string").alias("__text"))
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("start_pos", T.LongType()), T.StructField("end_pos", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = worker_splitter(tables)
        for b in batches:
            row, start, end = s.split(b.column(len(keys)).to_pylist())
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k).take(take) for k in range(len(keys))), pa.array(start), pa.array(end)],
                names=[*keys, "start_pos", "end_pos"],
            )

    return kept.mapInArrow(work, schema)


def paragraph_texts(runs: DataFrame) -> DataFrame:
    """(doc_id, block_id, text): the text runs of each paragraph block, joined in order.

    Null text reads as empty; a run delivered more than once counts once; runs of equal run_ord follow run_id, null
    run_ord comes first. Runs without a block_id belong to no paragraph.
    """
    return (
        runs.where((F.col("kind") == "text") & F.col("block_id").startswith("p-"))
        .groupBy("doc_id", "block_id")
        .agg(F.collect_set(F.struct("run_ord", "run_id", F.coalesce("text", F.lit("")).alias("text"))).alias("parts"))
        .select("doc_id", "block_id", F.array_join(F.transform(F.array_sort("parts"), lambda p: p["text"]), "").alias("text"))
    )


def paragraph_sentences(runs: DataFrame) -> DataFrame:
    """(doc_id, block_id, start_pos, end_pos): every sentence of every paragraph block."""
    return sentences(paragraph_texts(runs), ["doc_id", "block_id"], "text")
