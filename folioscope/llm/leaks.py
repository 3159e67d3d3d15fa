"""Evaluation texts leaking into training text.

The evaluation items are indexed for BM25; every passage of every document is a query against them. Posting lists
are cut into blocks with the largest weight in each; a block whose bound stays under the threshold is never scored
(block-max pruning), and all items above their threshold are retrieved. The threshold of an item is the lowest
score a passage with a leak of it can have, so none is lost. What is retrieved is then verified word by word.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.codepoints import Mapper, driver_tables, worker_mapper
from folioscope.llm.words import Words


@dataclass(frozen=True)
class LeakRule:
    """What counts as a leak: *run* words of the item in a row, or *share* of its words in order within a stretch of
    at most *stretch* times its length."""

    run: int = 12
    share: float = 0.85
    stretch: float = 1.3
    k1: float = 1.2
    b: float = 0.75


@dataclass
class Index:
    """BM25 weights of the items, by term, in blocks of *width* items."""

    terms: np.ndarray  # sorted hashes of all words of the items
    begin: np.ndarray  # posting lists: term t has the postings begin[t] .. begin[t + 1]
    item: np.ndarray
    weight: np.ndarray
    width: int
    bound: np.ndarray  # bound[t, b]: largest weight of term t in block b
    threshold: np.ndarray  # per item
    block_threshold: np.ndarray  # lowest threshold in each block
    words: list[np.ndarray]  # each item as term numbers
    ids: list
    seen: np.ndarray  # bitmap over the top 16 bits of the hashes
    least: np.ndarray  # per item: distinct words that a passage with its share of words has at least
    run_hash: np.ndarray  # hashes of all runs of words of the items, sorted, and the item of each
    run_item: np.ndarray


def build_index(ids: list, texts: list[str], words: Words, rule: LeakRule, width: int = 16) -> Index:
    """Index the items; those without words are left out."""
    h, off = words.split(texts)
    keep = [k for k in range(len(ids)) if off[k + 1] > off[k]]
    terms, number = np.unique(h, return_inverse=True)
    per = [number[off[k] : off[k + 1]] for k in keep]
    n, size = len(keep), len(terms)
    length = np.array([len(x) for x in per], float)
    mean = length.mean() if n else 1.0
    post_t, post_i, post_w = [], [], []
    df = np.zeros(size)
    for x in per:
        df[np.unique(x)] += 1
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    threshold, least = np.zeros(n), np.zeros(n, np.int64)
    run_hash, run_item = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, x in enumerate(per):
        t, tf = np.unique(x, return_counts=True)
        w = idf[t] * tf * (rule.k1 + 1) / (tf + rule.k1 * (1 - rule.b + rule.b * length[i] / mean))
        post_t.append(t)
        post_i.append(np.full(len(t), i))
        post_w.append(w)
        value = dict(zip(t.tolist(), w.tolist()))
        seq = x.tolist()
        need = min(rule.run, len(seq))
        runs = [sum(value[v] for v in set(seq[k : k + need])) for k in range(len(seq) - need + 1)]
        lost = len(seq) - int(np.ceil(rule.share * len(seq) - 1e-9))
        rest = w.sum() - np.sort(w)[::-1][:lost].sum()
        threshold[i] = min(min(runs), rest) * (1 - 1e-9)
        least[i] = len(t) - lost
        own = np.unique(run_hashes(x, rule.run))
        run_hash.append(own)
        run_item.append(np.full(len(own), i))
    t, i, w = (np.concatenate(x) if n else np.zeros(0) for x in (post_t, post_i, post_w))
    order = np.lexsort((i, t))
    t, i, w = t[order].astype(np.int64), i[order].astype(np.int64), w[order]
    begin = np.searchsorted(t, np.arange(size + 1))
    blocks = -(-n // width)
    bound = np.zeros((size, blocks), np.float32)
    np.maximum.at(bound, (t, i // width), (w * (1 + 1e-6)).astype(np.float32))
    low = np.array([threshold[k * width : (k + 1) * width].min() for k in range(blocks)])
    seen = np.zeros(1 << 16, bool)
    seen[(terms >> np.uint64(48)).astype(np.int64)] = True
    rh, ri = np.concatenate(run_hash), np.concatenate(run_item)
    order = np.argsort(rh, kind="stable")
    return Index(terms, begin, i, w, width, bound, threshold, low, per, [ids[k] for k in keep], seen, least, rh[order], ri[order])


def run_hashes(terms: np.ndarray, run: int) -> np.ndarray:
    """Hash of each *run* of term numbers in a row: differences of one prefix sum of powers, brought to one power."""
    if len(terms) < run:
        return np.zeros(0, np.uint64)
    base, back = np.uint64(0xD1342543DE82EF95), np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
    with np.errstate(over="ignore"):
        x = (terms.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(31)
        up = np.ones(len(x), np.uint64)
        up[1:] = np.cumprod(np.full(len(x) - 1, base))
        down = np.ones(len(x), np.uint64)
        down[1:] = np.cumprod(np.full(len(x) - 1, back))
        total = np.append(np.uint64(0), np.cumsum(x * up))
        return (total[run:] - total[:-run]) * down[: len(x) - run + 1]


def _ramps(n: np.ndarray) -> np.ndarray:
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def term_hits(ix: Index, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that some item has, and their term numbers."""
    hit = np.flatnonzero(ix.seen[(hashes >> np.uint64(48)).astype(np.int64)])
    at = np.minimum(np.searchsorted(ix.terms, hashes[hit]), len(ix.terms) - 1)
    ok = ix.terms[at] == hashes[hit]
    return hit[ok], at[ok]


def runs_found(ix: Index, hit: np.ndarray, term: np.ndarray, off: np.ndarray, run: int) -> set[tuple[int, int]]:
    """(text, item) with *run* words of the item in a row in the text."""
    h = run_hashes(term, run)
    if not len(h) or not len(ix.run_hash):
        return set()
    a = np.flatnonzero(hit[run - 1 :] - hit[: len(h)] == run - 1)
    text = np.searchsorted(off, hit[a], side="right") - 1
    inside = hit[a] + run <= off[text + 1]
    a, text = a[inside], text[inside]
    lo, hi = np.searchsorted(ix.run_hash, h[a], "left"), np.searchsorted(ix.run_hash, h[a], "right")
    m = hi - lo
    return set(zip(np.repeat(text, m).tolist(), ix.run_item[np.repeat(lo, m) + _ramps(m)].tolist()))


def retrieve(
    ix: Index, hit: np.ndarray, term: np.ndarray, off: np.ndarray, passage: int, shift: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, item, distinct words) of every passage and item with a score at or above its threshold."""
    none = np.zeros(0, np.int64)
    if not len(hit):
        return none, none, none, none
    n = np.diff(off)
    text = np.searchsorted(off, hit, side="right") - 1
    pos = hit - off[text]
    # passages of *passage* words begin every *shift* words; a word lies in several of them
    last = np.maximum(0, -(-(n - passage) // shift))
    hi = np.minimum(pos // shift, last[text])
    lo = np.maximum(0, -(-(pos - passage + 1) // shift))
    m = np.maximum(hi - lo + 1, 0)
    base = np.cumsum(last + 1) - (last + 1)
    p = np.repeat(base[text] + lo, m) + _ramps(m)
    key = np.unique(p * len(ix.terms) + np.repeat(term, m))  # each term once per passage
    p, term = key // len(ix.terms), key % len(ix.terms)
    # bound over all blocks first, then block by block
    start = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
    rough = np.add.reduceat(ix.bound.max(axis=1)[term], start)
    live = np.repeat(rough >= ix.block_threshold.min(), np.diff(np.append(start, len(p))))
    p, term = p[live], term[live]
    out_p, out_i, out_n = [], [], []
    step = max(1, 4_000_000 // max(1, ix.bound.shape[1]))
    cuts = np.flatnonzero(np.append(True, p[1:] != p[:-1])) if len(p) else none
    size = np.diff(np.append(cuts, len(p)))
    k = 0
    while k < len(cuts):  # as many passages at a time as fit the memory for their bounds
        e = max(k + 1, int(np.searchsorted(np.cumsum(size[k:]), step)) + k)
        a, b = int(cuts[k]), int(cuts[e]) if e < len(cuts) else len(p)
        s = cuts[k:e] - a
        ub = np.add.reduceat(ix.bound[term[a:b]], s, axis=0)
        q, block = np.nonzero(ub >= ix.block_threshold[None, :])
        if len(q):
            # score the items of the surviving blocks from the posting lists of the passage's terms
            c = size[k:e][q]
            w = np.repeat(a + s[q], c) + _ramps(c)
            tt, pair = term[w], np.repeat(np.arange(len(q)), c)
            bb = block[pair]
            has = ix.bound[tt, bb] > 0
            tt, pair, bb = tt[has], pair[has], bb[has]
            m = ix.begin[tt + 1] - ix.begin[tt]
            post = np.repeat(ix.begin[tt], m) + _ramps(m)
            item = ix.item[post]
            owner = np.repeat(pair, m)
            mine = item // ix.width == np.repeat(bb, m)
            slot = owner[mine] * ix.width + item[mine] % ix.width
            score = np.bincount(slot, ix.weight[post[mine]], minlength=len(q) * ix.width)
            got = np.flatnonzero(score > 0)
            i = block[got // ix.width] * ix.width + got % ix.width
            good = score[got] >= ix.threshold[i]
            out_p.append(p[a + s[q[got[good] // ix.width]]])
            out_i.append(i[good])
            out_n.append(np.bincount(slot, minlength=len(q) * ix.width)[got[good]])
        k = e
    if not out_p:
        return none, none, none, none
    p, i = np.concatenate(out_p), np.concatenate(out_i)
    text = np.searchsorted(base, p, side="right") - 1
    return text, (p - base[text]) * shift, i, np.concatenate(out_n)


def longest_common(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bits of long integers."""
    at: dict[int, int] = {}
    for k, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        if m := at.get(x):
            u = v & m
            v = (v + u) | (v - u)
    return len(a) - (v & full).bit_count()


def in_order(item: np.ndarray, passage: np.ndarray, rule: LeakRule) -> bool:
    """Does a stretch of the passage (term numbers, -1 for words of no item) hold the share of the item in order?"""
    n = len(item)
    need = int(np.ceil(rule.share * n - 1e-9))
    wide = max(n, int(rule.stretch * n))
    own = np.isin(passage, item)
    if own.sum() < need:
        return False
    count = np.cumsum(np.append(0, own))
    begin = np.flatnonzero(own)
    enough = begin[count[np.minimum(begin + wide, len(passage))] - count[begin] >= need]
    seq = item.tolist()
    return any(longest_common(seq, passage[s : s + wide].tolist()) >= need for s in enough.tolist())


class Searcher:
    """Searches texts for the items of one index."""

    def __init__(self, index: Index, rule: LeakRule):
        self.ix, self.rule = index, rule
        longest = max((len(x) for x in index.words), default=1)
        wide = max(longest, int(rule.stretch * longest))
        self.passage, self.shift = 2 * max(wide, 64), max(wide, 64)

    def search(self, h: np.ndarray, off: np.ndarray) -> list[tuple[int, int]]:
        """(text, item) pairs that leak, from the words of texts as hashes and the offsets of the texts in them."""
        ix = self.ix
        if not ix.ids:
            return []
        hit, term = term_hits(ix, h)
        text, first, item, distinct = retrieve(ix, hit, term, off, self.passage, self.shift)
        runs = runs_found(ix, hit, term, off, self.rule.run)
        found: set[tuple[int, int]] = set()
        for t, f, i, d in zip(text.tolist(), first.tolist(), item.tolist(), (distinct >= ix.least[item]).tolist()):
            if (t, i) in found:
                continue
            if (t, i) in runs:
                found.add((t, i))
            elif d:
                begin = off[t] + f
                stop = min(begin + self.passage, off[t + 1])
                a, b = np.searchsorted(hit, (begin, stop))
                seq = np.full(stop - begin, -1)
                seq[hit[a:b] - begin] = term[a:b]
                if in_order(ix.words[i], seq, self.rule):
                    found.add((t, i))
        return sorted(found)


_WORDS: list[Words] = []
_KEPT: dict[str, Searcher] = {}


def _worker_words(tables) -> Words:  # noqa: ANN001
    m = worker_mapper(tables)
    if not _WORDS or _WORDS[0].m is not m:
        _WORDS[:] = [Words(m)]
    return _WORDS[0]


def leaking_documents(
    docs: DataFrame,
    items: DataFrame,
    doc_key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    rule: LeakRule = LeakRule(),
    block_items: int = 20_000,
    blocks_at_once: int = 32,
) -> DataFrame:
    """(<doc_key>, <item_key>): every document that holds a leak of an item, and the item.

    The items go in blocks of *block_items*, each with an index of its own (some 10 MB for items of 60 words) that is
    sent to the executors' disks. One pass over the documents, which are read and cut into words once, searches up to
    *blocks_at_once* blocks, with one index in memory at a time; so up to 640,000 items cost one pass, and more items
    further passes. Documents are read whole, in passages that overlap by more than the longest stretch. Null and empty
    texts and items leak nothing; an item shorter than the rule's run counts by its share of words. Items delivered
    twice count once; a document stored under two keys is reported for both.
    """
    sc = docs.sparkSession.sparkContext
    tables = sc.broadcast(driver_tables())
    clean = items.select(F.col(item_key).alias("k"), F.col(item_text).cast("string").alias("t")).where("k is not null and t is not null").distinct()
    blocks = max(1, -(-clean.count() // block_items))
    kept = docs.select(F.col(doc_key).alias(doc_key), F.col(text).cast("string").alias("__text")).where("__text is not null")
    out_key = doc_key if doc_key != item_key else f"{doc_key}_doc"
    schema = T.StructType([T.StructField(out_key, docs.schema[doc_key].dataType), T.StructField(item_key, items.schema[item_key].dataType)])
    words = Words(Mapper(driver_tables()))
    parts = []
    for a in range(0, blocks, blocks_at_once):
        indexes = []
        for n in range(a, min(blocks, a + blocks_at_once)):
            mine = clean.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == n).collect()  # some block_items rows
            mine.sort(key=lambda r: r["k"])
            indexes.append(sc.broadcast(build_index([r["k"] for r in mine], [r["t"] for r in mine], words, rule)))
        parts.append(kept.mapInArrow(_search(tables, indexes, rule, schema, uuid.uuid4().hex), schema))
    out = reduce(DataFrame.unionByName, parts)
    return out.distinct() if blocks > 1 else out  # an item with two texts may lie in two blocks


def _search(tables, indexes: list, rule: LeakRule, schema: T.StructType, token: str):  # noqa: ANN001, ANN202
    names = schema.names
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(schema[names[1]].dataType.simpleString(), None)

    def searcher(n: int) -> Searcher:
        if len(indexes) == 1:  # a single index stays in memory
            if token not in _KEPT:
                _KEPT.clear()
                _KEPT[token] = Searcher(indexes[0].value, rule)
            return _KEPT[token]
        return Searcher(indexes[n].load_from_path(indexes[n]._path), rule)  # noqa: SLF001

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = _worker_words(tables)
        for b in batches:
            for a in range(0, b.num_rows, 2000):
                c = b.slice(a, 2000)
                h, off = w.split(c.column(1).to_pylist())
                for n in range(len(indexes)):
                    s = searcher(n)
                    found = s.search(h, off)
                    yield pa.RecordBatch.from_arrays(
                        [c.column(0).take(pa.array([t for t, _ in found], pa.int64())), pa.array([s.ix.ids[i] for _, i in found], kind)], names=names
                    )

    return work
