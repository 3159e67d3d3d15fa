"""Abusive, hateful or sexual content.

A sentence is a bag of words, each the mean of the embeddings of its character n-grams, plus word pairs; the bags are
averaged into a linear softmax over none, abusive, hateful and sexual. Embeddings and softmax are trained jointly in
numpy, so unseen and misspelt words share the vectors of their n-grams. Judgements are given per document: a
document's probability is that of its strongest sentence, and training assigns the judgement to sentences in turn.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.codepoints import Mapper, driver_tables, worker_mapper
from folioscope.llm.words import SEPARATOR, SINGLE, SKIP, Words
from folioscope.session import materialize

CATEGORIES = ("abusive", "hateful", "sexual")

# Signs and digits written for letters inside words.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "€": "e"}
# Marks that end a sentence here, rougher than the sentence operator, and marks that mask letters.
ENDS = ".!?…。！？।؟\n\r"
MASKS = "*#@$€_"
#: Words and pairs that a sentence is averaged over at least, so that one word alone says little.
FEW = 8


@dataclass(frozen=True)
class TrainRule:
    """How the model is fitted.

    *labels* bounds the judgements used (a sample by hash of the label id), *chars* the characters of the judged texts
    (in the order of that hash, whole texts; one longer than that alone is no example), *sentences* the different
    sentences that serve as examples of none (half of them those most like offending ones, half at random).
    """

    labels: int = 20_000
    chars: int = 64_000_000
    sentences: int = 16_000
    buckets: int = 1 << 18
    width: int = 16
    rounds: int = 3
    steps: int = 26
    rate: float = 0.03
    decay: float = 0.02
    held_out: float = 0.2
    lift: float = 4.0


@dataclass
class Bags:
    """Sentences of a batch of texts: word and pair occurrences with the sentence of each."""

    word: np.ndarray  # hash per occurrence
    sentence: np.ndarray
    text: np.ndarray  # text of each sentence
    cps: np.ndarray  # letters, and where each occurrence lies in them
    start: np.ndarray
    stop: np.ndarray | None = None  # by default the next start


class Reader:
    """Turns texts into bags; one per Python worker."""

    def __init__(self, mapper: Mapper):
        self.words = Words(mapper, keep=MASKS)
        self.kind, self.key = self.words.kind.copy(), self.words.key.copy()
        self.end = np.zeros(len(self.kind), bool)
        self.end[[ord(c) for c in ENDS]] = True
        self.digit = np.zeros(len(self.kind), bool)
        for c in range(0x30, 0x3A):
            self.digit[c] = True
            self.digit[0xFF10 + c - 0x30] = True
        self.quote = np.zeros(len(self.kind), np.int32)
        self.quote[[ord(c) for c in "«“„「『‘"]] = 1
        self.quote[[ord(c) for c in "»”」』"]] = 2
        self.quote[ord('"')] = 1
        self.leet = np.zeros(len(self.kind), np.int32)
        for a, b in LEET.items():
            self.leet[ord(a)] = ord(b)
        self.power = self.words.power
        self.capital = np.zeros(len(self.kind), bool)
        for c in (*range(0x41, 0x590), *range(0x1E00, 0x2000), *range(0xFF21, 0xFF3B)):
            self.capital[c] = chr(c).isupper()

    def many(self, texts: list[str | None], at_once: int = 500) -> Bags:
        """The bags of any number of texts, read a few at a time; letters are kept for one occurrence per word."""
        known: dict[int, np.ndarray] = {}
        word, sentence, text, sents = [], [], [], 0
        for a in range(0, len(texts), at_once):
            b = self.bags(texts[a : a + at_once])
            stop = np.append(b.start[1:], len(b.cps))
            new, head = np.unique(b.word, return_index=True)
            for h, k in zip(new.tolist(), head.tolist()):
                if h not in known:
                    known[h] = b.cps[b.start[k] : stop[k]].copy()
            word.append(b.word)
            sentence.append(b.sentence + sents)
            text.append(b.text + a)
            sents += len(b.text)
        every = np.array(list(known), np.uint64)
        order = np.argsort(every)
        letters = [known[h] for h in every[order].tolist()]
        size = np.array([len(x) for x in letters], np.int64)
        start = np.cumsum(size) - size
        words = np.concatenate(word) if word else np.zeros(0, np.uint64)
        place = np.searchsorted(every[order], words)
        out = Bags(words, np.concatenate(sentence) if word else np.zeros(0, np.int64), np.concatenate(text) if text else np.zeros(0, np.int32),
                   np.concatenate(letters) if letters else np.zeros(0, np.int32), start[place] if len(words) else np.zeros(0, np.int64))
        out.stop = out.start + (size[place] if len(words) else 0)
        return out

    def bags(self, texts: list[str | None]) -> Bags:
        """Sentences and words of the texts.

        Stretched letters shrink, spaced letters join, signs for letters inside words become letters, numbers
        become one word, and a word inside quotation marks is told from the same word outside.
        """
        flat = np.frombuffer("".join((t or "") + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
        n = np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts))
        row = np.repeat(np.arange(len(texts), dtype=np.int32), n)
        kind = self.kind[flat]
        see = kind != SKIP
        flat, kind, row = flat[see], kind[see], row[see]
        key = self.key[flat]
        # a mark ends a sentence before a blank, a capital or the end; newlines always do
        after = np.append(flat[1:], 10)
        end = self.end[flat] & ((flat == 10) | (kind == SEPARATOR) & ((after <= 32) | self.capital[after] | (after > 0x2000)))
        end |= np.append(row[1:] != row[:-1], True)
        sent = np.cumsum(end) - end
        inside = kind != SEPARATOR
        q = self.quote[flat]
        # inside a quotation: more openings than closings so far in the sentence
        opened = np.cumsum(q == 1) - np.cumsum(q == 2)
        at = np.flatnonzero(np.append(True, sent[1:] != sent[:-1]))
        base = np.repeat((opened - (q == 1).astype(np.int64) + (q == 2))[at], np.diff(np.append(at, len(sent))))
        quoted = opened > base
        # stretched letters: the third and later of a run go, and the second with them
        same = np.append(False, (key[1:] == key[:-1]) & inside[1:] & inside[:-1])
        run3 = same & np.append(False, same[:-1])
        drop = run3 | (same & np.append(run3[1:], False))
        keep = ~(drop & ~self.digit[flat])
        flat, kind, row, key, sent, inside, quoted = (x[keep] for x in (flat, kind, row, key, sent, inside, quoted))
        first = inside.copy()
        first[1:] &= (kind[:-1] == SEPARATOR) | (kind[1:] == SINGLE) | (kind[:-1] == SINGLE)
        pos = np.flatnonzero(inside)
        key, digit, first, sent_c, quoted, raw = key[pos], self.digit[flat[pos]], first[pos], sent[pos], quoted[pos], flat[pos]
        start = np.flatnonzero(first)
        texts_of = np.zeros(int(sent[-1]) + 1 if len(sent) else 0, np.int32)
        texts_of[sent] = row
        if not len(start):
            return Bags(np.zeros(0, np.uint64), np.zeros(0, np.int64), texts_of, key, start)
        # single letters apart: runs of three or more become one word
        length = np.diff(np.append(start, len(key)))
        one = (length == 1) & ~digit[start] & (self.kind[raw[start]] == 3)
        gap = pos[start[1:]] - pos[start[:-1]]
        link = one[1:] & one[:-1] & (gap == 2) & (sent_c[start[1:]] == sent_c[start[:-1]])
        tail = np.append(False, link)
        near = link & (np.append(False, link[:-1]) | np.append(link[1:], False))
        joined = tail & np.append(False, near)
        first[start[joined]] = False
        start = np.flatnonzero(first)
        nth = np.cumsum(first) - 1
        size = np.diff(np.append(start, len(key)))
        letters = np.add.reduceat((~digit & (raw != 42)).astype(np.int64), start)
        mixed = (letters > 0)[nth]
        swap = self.leet[raw]
        key = np.where(mixed & (swap > 0), swap, key)
        key = np.where(digit & ~mixed, 48, key)
        place = np.arange(len(key)) - start[nth]
        with np.errstate(over="ignore"):
            h = np.add.reduceat(key.astype(np.uint64) * self.power[np.minimum(place, 63)], start)
            h = np.where(letters > 0, h, np.uint64(48))
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            h += quoted[start].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return Bags(h, sent_c[start], texts_of, key, start)

    def grams(self, b: Bags, pick: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, bucket): the whole word and its character n-grams, for the occurrences *pick*; words of any length."""
        stop = (np.append(b.start[1:], len(b.cps)) if b.stop is None else b.stop)[pick]
        begin = b.start[pick]
        size = stop - begin
        # the words one behind the other, each between a mark for its beginning and one for its end
        end = np.cumsum(size + 2)
        flat = np.zeros(int(end[-1]) if len(end) else 0, np.uint64)
        owner = np.repeat(np.arange(len(pick)), size + 2)
        letter = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        flat[letter + np.repeat(end - size - 1, size)] = b.cps[letter + np.repeat(begin, size)]
        flat[end - size - 2] = 2
        flat[end - 1] = 3
        out_w, out_b = [np.arange(len(pick))], [(b.word[pick] % np.uint64(buckets)).astype(np.int64)]
        with np.errstate(over="ignore"):
            for n in (3, 4, 5):
                inside = np.flatnonzero(owner[n - 1 :] == owner[: max(len(owner) - n + 1, 0)])
                h = np.zeros(len(inside), np.uint64)
                for k in range(n):
                    h = h * np.uint64(0x100000001B3) + flat[inside + k]
                h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD) + np.uint64(n)
                out_w.append(owner[inside])
                out_b.append(((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64))
        w, g = np.concatenate(out_w), np.concatenate(out_b)
        order = np.argsort(w, kind="stable")
        return w[order], g[order]

    @staticmethod
    def pairs(b: Bags, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, bucket) of neighbouring words."""
        same = b.sentence[1:] == b.sentence[:-1]
        with np.errstate(over="ignore"):
            h = (b.word[:-1] * np.uint64(31) + b.word[1:])[same]
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return b.sentence[1:][same], ((h >> np.uint64(17)) % np.uint64(buckets)).astype(np.int64)


class _Sums:
    """Sums of rows by group, for a fixed grouping used many times."""

    def __init__(self, group: np.ndarray, groups: int):
        self.order = np.argsort(group, kind="stable")
        g = group[self.order]
        self.at = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
        self.ids = g[self.at]
        self.groups = groups

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((self.groups, rows.shape[1]), rows.dtype)
        if len(self.at):
            out[self.ids] = np.add.reduceat(rows[self.order], self.at, axis=0)
        return out


@dataclass
class Model:
    """Class scores of every bucket (embedding times softmax), the bias, and the thresholds per category."""

    score: np.ndarray  # buckets x 4, float32
    bias: np.ndarray
    threshold: np.ndarray
    buckets: int
    precision: np.ndarray  # on held-out documents, per category; 0 where there are too few cases
    recall: np.ndarray


def train(texts: list[str], judged: np.ndarray, rule: TrainRule = TrainRule(), reader: Reader | None = None) -> Model:
    """Fit the model to *judged*: per text the share of raters who saw each category.

    With fewer than two texts of a category that category never reaches its threshold.
    """
    reader = reader or Reader(Mapper(driver_tables()))
    b = reader.many(texts)
    size = len(texts)
    rng = np.random.default_rng(7)
    held = rng.random(size) < rule.held_out
    classes = len(CATEGORIES) + 1
    if not len(b.word) or size < 10:
        return Model(np.zeros((rule.buckets, classes), np.float32), np.zeros(classes, np.float32), np.full(3, 2.0), rule.buckets, np.zeros(3), np.zeros(3))
    # equal sentences count once, with the texts they stand in
    ps, pb = reader.pairs(b, rule.buckets)
    sents = len(b.text)
    with np.errstate(over="ignore"):
        place = np.arange(len(b.word)) - np.searchsorted(b.sentence, b.sentence)
        sig = np.bincount(b.sentence, minlength=sents).astype(np.uint64)
        np.add.at(sig, b.sentence, b.word * reader.power[np.minimum(place, 63)])
    ids = np.flatnonzero(np.bincount(b.sentence, minlength=sents) > 0)
    _, first, same = np.unique(sig[ids], return_index=True, return_inverse=True)
    unique = len(first)
    own = np.full(sents, -1)
    own[ids[first]] = np.arange(unique)
    occ = np.flatnonzero(own[b.sentence] >= 0)
    word_sent, pk = own[b.sentence[occ]], own[ps] >= 0
    pair_sent, pair_bucket = own[ps[pk]], pb[pk]
    words, head, wid = np.unique(b.word[occ], return_index=True, return_inverse=True)
    gw, gb = reader.grams(b, occ[head], rule.buckets)
    link = np.unique(b.text[ids].astype(np.int64) * unique + same)
    link_text, link_sent = link // unique, link % unique
    fit = ~held[link_text]
    fit_text, fit_sent = link_text[fit], link_sent[fit]
    positive = judged >= 0.5
    clean = ~(judged > 0).any(1)
    # evidence of single words and pairs: in which share of judged texts with it was the category seen
    token = np.concatenate([wid, len(words) + pair_bucket])
    token_sent = np.concatenate([word_sent, pair_sent])
    tokens = len(words) + rule.buckets
    by_sent = np.argsort(token_sent, kind="stable")
    begin = np.searchsorted(token_sent[by_sent], np.arange(unique + 1))
    n = (begin[1:] - begin[:-1])[fit_sent]
    at = np.repeat(begin[fit_sent], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    seen = np.unique(np.repeat(fit_text, n) * tokens + token[by_sent[at]])
    seen_text, seen_token = seen // tokens, seen % tokens
    total = np.bincount(seen_token, minlength=tokens)
    count = np.maximum(np.diff(begin), 1).astype(np.float32)
    guess = np.zeros((unique, 3), np.float32)
    for c in range(3):
        base = max(judged[~held, c].mean(), 1e-4)
        odds = np.log((np.bincount(seen_token, judged[seen_text, c], minlength=tokens) + 3 * base) / (total + 3) / base)
        guess[:, c] = np.bincount(token_sent, odds[token], minlength=unique) / count
    parts = (wid, word_sent, pair_bucket, pair_sent, gw, gb, len(words), unique)
    # The judgement of a text goes to its strongest sentence, as a model sees it that was fitted on the other half of
    # the texts: what only one text of one half has is not taken for offending because it was learnt by heart.
    side = (np.arange(size) % 2)[fit_text]
    believed = np.repeat((1 - np.exp(-np.maximum(guess, 0)))[None], 2, axis=0)
    for turn in range(rule.rounds):
        last = turn == rule.rounds - 1
        models = []
        for half in (None,) if last else (0, 1):
            k = np.ones(len(fit_text), bool) if half is None else side == half
            use, target, weight = _examples(fit_text[k], fit_sent[k], side[k], believed, positive, clean, size, turn, rule, rng)
            models.append(_fit(use, target, weight, parts, rule, rng))
        if not last:
            believed = np.stack([_probabilities(*models[1 - h], parts)[:, 1:] for h in (0, 1)])
    score, bias = models[0]
    p = _probabilities(score, bias, parts)
    best = np.zeros((size, 3), np.float32)
    for c in range(3):
        np.maximum.at(best[:, c], link_text, p[link_sent, c + 1])
    threshold, precision, recall = np.full(3, 0.5), np.zeros(3), np.zeros(3)
    for c in range(3):
        if (positive[:, c] & ~held).sum() < 2:
            threshold[c] = 2.0
            continue
        threshold[c] = _cut(best[held, c], positive[held, c])
        hit, true = best[held, c] >= threshold[c], positive[held, c]
        precision[c], recall[c] = ((hit & true).sum() / max(1, x.sum()) for x in (hit, true))
    return Model(score, bias, threshold, rule.buckets, precision, recall)


def _examples(text, sent, side, believed, positive, clean, size, turn, rule, rng) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: ANN001
    """Sentences to fit on, their class shares and weights, from (text, sentence) links of judged texts."""
    unique = believed.shape[1]
    texts_per = np.bincount(sent, minlength=unique).astype(np.float32)
    belief = believed[side, sent]
    hit = np.zeros((unique, 3), np.float32)
    for c in range(3):
        mine = positive[text, c]
        t, k, v = text[mine], sent[mine], belief[mine, c]
        best = np.zeros(size, np.float32)
        np.maximum.at(best, t, v)
        take = (v >= best[t]) & (best[t] > (0.3 if turn else 0))
        if turn:
            take |= v > 0.7
        hit[:, c] = np.bincount(k[take], minlength=unique)
    # sentences of clean texts are none, and later those of other texts that look like none
    calm = clean[text] | ((belief.max(1) < 0.2) if turn else False)
    none = np.bincount(sent[calm], minlength=unique).astype(np.float32)
    chosen = np.flatnonzero(hit.sum(1) > 0)
    pool = np.flatnonzero((none > 0) & (hit.sum(1) == 0))
    if len(pool) > rule.sentences:
        rank = pool[np.argsort(-believed.max(axis=(0, 2))[pool], kind="stable")]
        half = rule.sentences // 2
        pool = np.concatenate([rank[:half], rng.choice(rank[half:], rule.sentences - half, replace=False)])
    use = np.sort(np.concatenate([chosen, pool]))
    total = np.maximum(hit.sum(1) + none, 1)
    target = np.zeros((unique, 4), np.float32)
    target[:, 1:] = hit / total[:, None]
    target[:, 0] = 1 - target[:, 1:].sum(1)
    return use, target, np.sqrt(np.maximum(texts_per, 1)) * (1 + (rule.lift - 1) * (1 - target[:, 0]))


def _probabilities(score: np.ndarray, bias: np.ndarray, parts: tuple) -> np.ndarray:
    """Class probabilities of all sentences from bucket scores."""
    wid, word_sent, pair_bucket, pair_sent, gw, gb, words, sents = parts
    at = np.flatnonzero(np.append(True, gw[1:] != gw[:-1]))
    wv = np.add.reduceat(score[gb], at, axis=0) / np.diff(np.append(at, len(gw)))[:, None]
    n = np.bincount(word_sent, minlength=sents) + np.bincount(pair_sent, minlength=sents)
    z = np.empty((sents, score.shape[1]), np.float32)
    for c in range(score.shape[1]):
        z[:, c] = np.bincount(word_sent, wv[wid, c], minlength=sents) + np.bincount(pair_sent, score[pair_bucket, c], minlength=sents)
    z = z / np.maximum(n, FEW)[:, None] + bias
    z -= z.max(1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(1, keepdims=True)
    p[n == 0] = 0
    return p


def _fit(use: np.ndarray, target: np.ndarray, weight: np.ndarray, parts: tuple, rule: TrainRule, rng) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """Embeddings and softmax trained jointly on the sentences *use*; returns class scores per bucket and the bias."""
    wid, word_sent, pair_bucket, pair_sent, gw, gb, _, unique = parts
    new = np.full(unique, -1)
    new[use] = np.arange(len(use))
    k = new[word_sent] >= 0
    word_sent, (ws, wid) = new[word_sent[k]], np.unique(wid[k], return_inverse=True)
    k = new[pair_sent] >= 0
    pair_sent, pair_bucket = new[pair_sent[k]], pair_bucket[k]
    begin = np.searchsorted(gw, ws)
    n = np.searchsorted(gw, ws, side="right") - begin
    gb = gb[np.repeat(begin, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
    gw = np.repeat(np.arange(len(ws)), n)
    used, inv = np.unique(np.concatenate([gb, pair_bucket]), return_inverse=True)
    gb, pair_bucket = inv[: len(gb)], inv[len(gb) :]
    per_word = n.astype(np.float32)
    # features of a single sentence would only be learnt by heart
    often = np.bincount(gb, np.bincount(wid, minlength=len(ws))[gw], minlength=len(used)) + np.bincount(pair_bucket, minlength=len(used))
    known = (often > 1).astype(np.float32)[:, None]
    size, d, classes = len(use), rule.width, target.shape[1]
    count = (np.bincount(word_sent, minlength=size) + np.bincount(pair_sent, minlength=size)).astype(np.float32)
    target, weight = target[use], weight[use] / weight[use].sum()
    emb = rng.normal(0, 0.1, (len(used), d)).astype(np.float32) * known
    soft = rng.normal(0, 0.3, (d, classes)).astype(np.float32)
    bias = np.array([4, 0, 0, 0], np.float32)[:classes]  # what shows nothing known is none
    scale = np.float32(8)
    to_word, to_sent_w, to_sent_p = _Sums(gw, len(ws)), _Sums(word_sent, size), _Sums(pair_sent, size)
    back_w, back_g, back_p = _Sums(wid, len(ws)), _Sums(gb, len(used)), _Sums(pair_bucket, len(used))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (emb, soft)]
    for clock in range(1, rule.steps + 1):
        wv = to_word(emb[gb]) / per_word[:, None]
        sv = (to_sent_w(wv[wid]) + to_sent_p(emb[pair_bucket])) / np.maximum(count, FEW)[:, None] * scale
        z = sv @ soft + bias
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        g = ((p - target) * weight[:, None]).astype(np.float32) * 100
        dsv = (g @ soft.T) * (scale / np.maximum(count, FEW))[:, None]
        dw = back_w(dsv[word_sent]) / per_word[:, None]
        de = (back_g(dw[gw]) + back_p(dsv[pair_sent])) * known
        for x, grad, st in zip((emb, soft), (de, sv.T @ g), state):
            st[0] = 0.9 * st[0] + 0.1 * grad
            st[1] = 0.98 * st[1] + 0.02 * grad * grad
            x -= rule.rate * ((st[0] / (1 - 0.9**clock)) / (np.sqrt(st[1] / (1 - 0.98**clock)) + 1e-4) + rule.decay * x)
    score = np.zeros((rule.buckets, classes), np.float32)
    score[used] = emb @ soft * scale
    return score, bias


def _cut(score: np.ndarray, true: np.ndarray) -> float:
    """Threshold with the best F1, taken in the middle of the widest range that reaches it; 0.5 without cases."""
    if true.sum() < 2:
        return 0.5
    best, at = -1.0, []
    grid = np.linspace(0.1, 0.9, 33)
    for c in grid:
        hit = score >= c
        f = 2 * (hit & true).sum() / max(1, hit.sum() + true.sum())
        if f > best + 1e-9:
            best, at = f, [c]
        elif f > best - 1e-9:
            at.append(c)
    return float(np.median(at))


def apply(model: Model, reader: Reader, texts: list[str | None]) -> np.ndarray:
    """Per text and category the probability of its strongest sentence."""
    out = np.zeros((len(texts), 3), np.float32)
    b = reader.bags(texts)
    if not len(b.word):
        return out
    words, head, wid = np.unique(b.word, return_index=True, return_inverse=True)
    gw, gb = reader.grams(b, head, model.buckets)
    ps, pb = reader.pairs(b, model.buckets)
    p = _probabilities(model.score, model.bias, (wid, b.sentence, pb, ps, gw, gb, len(words), len(b.text)))
    start = np.flatnonzero(np.append(True, b.text[1:] != b.text[:-1]))
    out[b.text[start]] = np.maximum.reduceat(p[:, 1:], start, axis=0)
    return out


def fit_on_labels(docs: DataFrame, labels: DataFrame, rule: TrainRule = TrainRule()) -> Model:
    """A model from the judgements in *labels* on the texts in *docs*.

    Repeated rows count once, rows with a null judgement not at all; raters of one text are averaged. At most
    rule.labels judgements on texts of at most rule.chars characters together are used, a sample by hash that is the
    same on every run. Without any judgement no document is flagged.
    """
    one = labels.select("label_id", "doc_id", *CATEGORIES).distinct().where(" and ".join(f"{c} is not null" for c in CATEGORIES))
    some = one.orderBy(F.xxhash64("label_id"), "label_id", "doc_id").limit(rule.labels)
    mean = some.groupBy("doc_id").agg(F.min(F.xxhash64("label_id")).alias("turn"), *[F.avg(c).alias(c) for c in CATEGORIES])
    judged = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(mean), "doc_id")  # at most rule.labels rows
    judged = materialize(judged.where(F.length("text") <= rule.chars), "judged")
    so_far = Window.orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)  # over at most rule.labels short rows
    chosen = judged.select("turn", "doc_id", F.length("text").alias("size")).withColumn("chars", F.sum("size").over(so_far))
    within = chosen.where(F.col("chars") <= rule.chars).select("doc_id").distinct()
    pick = judged.join(F.broadcast(within), "doc_id", "left_semi").select("doc_id", "text", *CATEGORIES)
    tables = docs.sparkSession.sparkContext.broadcast(driver_tables())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(5)))), key=lambda r: (r[0], r[1]))
        judged = np.array([r[2:] for r in rows], float).reshape(-1, 3)
        model = train([r[1] for r in rows], judged, rule, Reader(worker_mapper(tables)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # one task holds the bounded sample, so that the driver need not
    row = pick.repartition(1).mapInArrow(work, "model binary").first()
    return pickle.loads(row["model"]) if row else train([], np.zeros((0, 3)), rule)


_READERS: dict[str, tuple[Reader, Model]] = {}


def abuse_scores(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(<key>, keep..., abusive, hateful, sexual, and for each category <c>_flag): one row per row of *docs*.

    The score of a document is the probability of its strongest sentence, the flag whether it reaches the
    category's threshold. Null and empty texts score 0.
    """
    spark = docs.sparkSession
    tables, shared = spark.sparkContext.broadcast(driver_tables()), spark.sparkContext.broadcast(model)
    keep = keep or []
    kept = docs.select(key, *keep, F.col(text).cast("string").alias("__text"))
    schema = T.StructType(
        [
            *(docs.schema[k] for k in (key, *keep)),
            *(T.StructField(c, T.DoubleType()) for c in CATEGORIES),
            *(T.StructField(f"{c}_flag", T.BooleanType()) for c in CATEGORIES),
        ]
    )
    names, token, at = list(schema.names), uuid.uuid4().hex, 1 + len(keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _READERS:
            _READERS.clear()
            _READERS[token] = (Reader(worker_mapper(tables)), shared.value)
        reader, m = _READERS[token]
        for b in batches:
            for a in range(0, b.num_rows, 2000):
                c = b.slice(a, 2000)
                p = apply(m, reader, c.column(at).to_pylist()).astype(float)
                cols = [c.column(k) for k in range(at)]
                cols += [pa.array(p[:, k]) for k in range(3)] + [pa.array(p[:, k] >= m.threshold[k]) for k in range(3)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return kept.mapInArrow(work, schema)
