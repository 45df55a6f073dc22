"""Held-out passages inside training text: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts become sequences of word hashes (case, punctuation, blanks, line breaks and page headers dropped). From a start word the CGK walk reads
the sequence at a speed that the words themselves steer: at step j the walk outputs the word it stands on and moves on if bit j of the word's
hash is set. Two windows that differ by few edits fall into step again after each, so edit distance becomes Hamming distance between outputs.
LSH keys are samples of a few output places, one from each third of the window; a start word is any whose hash has a fixed bit, in items and
documents alike, so windows need no common grid. The window and the votes asked for follow the item's length (``SIZES``); items too short for
a walk are met by every run of three words. Repeated samples that agree on item and offset are votes, pairs with enough votes are aligned
exactly, and the passage found decides: how much of the item it runs through, and how well.

One pass over the documents serves any number of items, and counts in how many documents each phrase of an item stands. Few items (a stated, checked bound) are an index that every task holds, and documents
are only mapped over. Beyond the bound, keys are a table: the documents' keys are filtered by a bitmap of fixed size, join the items' keys,
and the pairs with enough votes meet their texts again for the alignment.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lcspark.session import materialise, spread

#: (words an item has at least, steps of the walk). A walk reads a word in two steps, so that a window is a sixth of the item at most and several
#: fit in half of it. Below the first size every run of ``SHORT`` words is a key.
SIZES = ((24, 8), (48, 16), (128, 32), (256, 64))
SHORT, REPEATS, SEED = 3, 6, 7
#: Words of a phrase whose documents are counted, and the documents (their share, or a plain number) beyond which it is common wording.
PHRASE, COMMON_SHARE, COMMON_LEAST = 5, 0.01, 50
#: Width of an offset bin in words.
BIN = 16
MISS = 1.5
#: More words than an item may have before its offset in a document would be negative beyond this.
FAR = 1 << 30
#: Places by which an alignment may run ahead of or behind the voted offset, in words.
BAND_BEFORE, BAND_AFTER = 14, 20
#: Most items, and most signs of their texts, whose keys every task holds; beyond either, keys are joined.
HELD_ITEMS, HELD_SIGNS = 5_000, 20_000_000
#: Bits of the bitmap that filters the documents' keys before the join.
FILTER_BITS = 26

#: Lines that are no text but stand inside one: a line with a docket number, or a page number between dashes before a title.
PAGE_HEADERS = r"^[ \t]*(?:[^\n]*\b[A-Z]{2,4} \d{4}/\d{5,}\b[^\n]*|-[ \t]*\d+[ \t]*-[^\n]*)$"
_BREAK = re.compile(r"[-­‐][ \t]*\n\s*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
_SAME = str.maketrans("1|0", "llo")


def words(text: str, headers: re.Pattern = re.compile(PAGE_HEADERS, re.M)) -> list[str]:
    """The words of a text: headers cut out, words broken at a line end joined, lower case, look-alike signs of scans folded."""
    t = _BREAK.sub("", headers.sub(" ", text)).casefold()
    return _WORD.findall(t)


class _Known(dict):
    def __missing__(self, w: str) -> int:
        h = self[w] = xxhash.xxh3_64_intdigest(w.translate(_SAME))
        return h


class Hashes:
    """64-bit word hashes, remembered up to a bound."""

    def __init__(self, headers: str = PAGE_HEADERS, bound: int = 1_000_000):
        self.known, self.bound, self.headers = _Known(), bound, re.compile(headers, re.M)

    def __call__(self, text: str) -> list[int]:
        if len(self.known) >= self.bound:
            self.known.clear()
        return list(map(self.known.__getitem__, words(text, self.headers)))


def _places(steps: int) -> np.ndarray:
    r = np.random.default_rng(SEED)
    return np.stack([r.integers(k * steps // 3, (k + 1) * steps // 3, REPEATS) for k in range(3)], axis=1)


PLACES = {steps: _places(steps) for _, steps in SIZES}
_MIX = np.uint64(0x9E3779B97F4A7C15)
PAD = max(PLACES) + SHORT


def size_class(n_words: int) -> int:
    """Steps of the walk for an item of ``n_words``; 0: too short for one."""
    return max((steps for least, steps in SIZES if n_words >= least), default=0)


def needed(n_words: int) -> tuple[int, int]:
    """Votes of one offset, and words between the first and last of their places in the item, that make a candidate."""
    if not size_class(n_words):
        return 1, 0
    return (n_words // 4, n_words // 5) if n_words >= 48 else (n_words // 5, n_words // 6)


def _mixed(a: np.ndarray, b: np.ndarray, c: np.ndarray, salt: int) -> np.ndarray:
    k = (a * _MIX) ^ (b + np.uint64(salt))
    k = (k ^ (k >> np.uint64(29))) * _MIX ^ c
    return (k ^ (k >> np.uint64(32))) * _MIX


def window_keys(tokens: np.ndarray, steps: int, short: int = SHORT) -> tuple[np.ndarray, list[np.ndarray]]:
    """Start places of the windows of ``tokens`` (padded by PAD at its end), and their keys for each repeat."""
    if not steps:
        n = len(tokens) - PAD
        a, b, c = (tokens[min(k, short - 1) : n + min(k, short - 1)] for k in range(3))
        return np.arange(n), [_mixed(a, b, c, short << 32)]
    starts = np.flatnonzero((tokens[:-PAD] >> np.uint64(63)) == 0)
    pos = starts.astype(np.int32)
    wanted = set(PLACES[steps].ravel().tolist())
    out: dict[int, np.ndarray] = {}
    one = np.uint64(1)
    for j in range(max(wanted) + 1):
        h = tokens[pos]
        if j in wanted:
            out[j] = h
        pos += ((h >> np.uint64(j % 62)) & one).astype(np.int32)
    return starts, [_mixed(out[a], out[b], out[c], (steps << 8) + r) for r, (a, b, c) in enumerate(PLACES[steps].tolist())]


def phrase_keys(tokens: np.ndarray) -> np.ndarray:
    """Keys of every run of ``PHRASE`` words."""
    n = max(len(tokens) - PHRASE + 1, 0)
    k = np.zeros(n, np.uint64)
    for j in range(PHRASE):
        k = (k ^ (k >> np.uint64(31)) ^ tokens[j : j + n]) * _MIX
    return k


def item_keys(item: int, hashes: list[int]) -> tuple[int, np.ndarray, np.ndarray]:
    """Class, keys and their places of one item. Its end is padded by words that no text has."""
    steps, n = size_class(len(hashes)), len(hashes)
    t = np.array(hashes + [(1 << 63) | (item * PAD + k) for k in range(PAD)], np.uint64)
    # an item of a few words is half met by fewer than three
    short = max(1, min(SHORT, (n + 1) // 2))
    s, ks = window_keys(t, steps, short)
    if not steps:
        s, ks = s[: n - short + 1], [k[: n - short + 1] for k in ks]
    return steps or -short, np.concatenate(ks), np.tile(s, len(ks)).astype(np.int32)


@dataclass
class Items:
    """Items and, if every task holds them, their keys."""

    ids: np.ndarray
    tokens: np.ndarray
    start: np.ndarray
    classes: tuple[int, ...]
    need: np.ndarray
    phrases: np.ndarray
    keys: np.ndarray
    item: np.ndarray
    at: np.ndarray
    seen: np.ndarray


#: Most pairs of a chunk of documents whose votes are counted before they are sorted.
PAIRS_COUNTED = 20_000_000


def _marked(keys: np.ndarray) -> np.ndarray:
    """A table of the low bits of keys, 32 places for each, in small memory where they are few."""
    seen = np.zeros(1 << min(max(12, int(len(keys)).bit_length() + 5), 26), bool)
    seen[keys & np.uint64(len(seen) - 1)] = True
    return seen


def index_items(ids: list[int], texts: list[str], headers: str = PAGE_HEADERS, keyed: bool = True) -> Items:
    h = Hashes(headers)
    lists = [h(t or "") for t in texts]
    start = np.cumsum([0, *map(len, lists)])
    of, keys, item, at = [], [np.empty(0, np.uint64)], [np.empty(0, np.int32)], [np.empty(0, np.int32)]
    for i, w in enumerate(lists):
        if not keyed or not w:
            of.append(0)
            continue
        steps, k, s = item_keys(i, w)
        of.append(steps), keys.append(k), item.append(np.full(len(k), i, np.int32)), at.append(s)
    keys, item, at = np.concatenate(keys), np.concatenate(item), np.concatenate(at)
    order = np.argsort(keys, kind="stable")
    seen = _marked(keys)
    need = np.array([needed(len(w)) for w in lists], np.int64).reshape(-1, 2)
    known = np.unique(np.concatenate([phrase_keys(np.array(w, np.uint64)) for w in lists] or [keys[:0]]))
    return Items(np.array(ids, np.int64), np.array([x for w in lists for x in w], np.uint64), start, tuple(sorted(set(of) - {0})), need, known, keys[order], item[order], at[order], seen)


def document_keys(tokens: np.ndarray, classes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and keys of padded ``tokens`` for the size classes that the items have."""
    for c in classes:
        starts, keys = window_keys(tokens, max(c, 0), max(-c, 1))
        for k in keys:
            yield starts, k


def elected(doc: np.ndarray, item: np.ndarray, off: np.ndarray, at: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, item and offset of the pairs whose votes in a bin of offsets are as many, and as far apart, as ``need`` of the item says."""
    # votes are counted in half bins, and each half bin is taken together with the next one
    n_items = len(need)
    code = (doc * n_items + item) * (1 << 32) + (off + FAR) // (BIN // 2)
    order = np.argsort(code, kind="stable")
    code, off, at = code[order], off[order], at[order]
    cut = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    n, total = np.diff(np.append(cut, len(code))), np.add.reduceat(off, cut)
    low, high = np.minimum.reduceat(at, cut), np.maximum.reduceat(at, cut)
    x = np.flatnonzero(code[cut][1:] == code[cut][:-1] + 1)
    both_n, both_total = n.copy(), total.copy()
    both_n[x] += n[x + 1]
    both_total[x] += total[x + 1]
    wide = high - low
    wide[x] = np.maximum(high[x], high[x + 1]) - np.minimum(low[x], low[x + 1])
    n, mean = both_n, both_total / both_n
    of = (code[cut] >> 32) % n_items
    ok = (n >= need[of, 0]) & (wide >= need[of, 1])
    code, mean, n = code[cut][ok], np.round(mean[ok]).astype(np.int64), n[ok]
    # of a pair's bins those with at least half the votes of its best one, and of equal offsets one
    pair = code >> 32
    pairs, of = np.unique(pair, return_inverse=True)
    most = np.zeros(len(pairs), np.int64)
    np.maximum.at(most, of, n)
    ok = 2 * n >= most[of]
    pair, mean = np.unique(np.stack([pair[ok], mean[ok]]), axis=1)
    return pair // n_items, pair % n_items, mean


def candidates(tokens: np.ndarray, doc_start: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, item and offset (document place of the item's first word) of the pairs with enough votes."""
    mask = np.uint64(len(items.seen) - 1)
    where, which = [], []
    for starts, k in document_keys(tokens, items.classes):
        x = np.flatnonzero(items.seen[k & mask])
        kx = k[x]
        lo, hi = np.searchsorted(items.keys, kx), np.searchsorted(items.keys, kx, "right")
        n = hi - lo
        if n.any():
            first = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            where.append(np.repeat(starts[x], n)), which.append(first)
    if not where:
        e = np.empty(0, np.int64)
        return e, e, e
    where, which = np.concatenate(where), np.concatenate(which)
    item, at = items.item[which].astype(np.int64), items.at[which]
    doc = np.searchsorted(doc_start, where, "right") - 1
    if (len(doc_start) - 1) * len(items.ids) <= PAIRS_COUNTED:
        # most pairs have too few votes at all offsets together
        pair = doc * len(items.ids) + item
        x = np.flatnonzero(np.bincount(pair)[pair] >= items.need[item, 0])
        doc, item, where, at = doc[x], item[x], where[x], at[x]
    return elected(doc, item, where - at - doc_start[doc], at, items.need)


def passages(tokens: np.ndarray, doc_start: np.ndarray, doc: np.ndarray, item: np.ndarray, off: np.ndarray, items: Items, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of each candidate: its score (1 for an equal word, -1.5 for each changed, missing or added one) and the item's words
    from its first to its last.

    The alignment is exact within the band of places around the offset; many candidates are aligned at a time, word by word of their items. A
    cell carries where its alignment began in the low digits of its score. Those whose remaining words can't bring them to ``least`` of the item
    (a score for each) any more are put aside on the way, with 0.
    """
    best, reach = np.zeros(len(doc)), np.zeros(len(doc), np.int64)
    size = np.diff(items.start)
    least = np.zeros(len(size)) if least is None else least
    order = np.argsort(size[item], kind="stable")
    width = BAND_BEFORE + BAND_AFTER + 1
    # scores in halves, and below them the item's word that the alignment began with
    base = int(size.max(initial=0)) + 2
    small = np.int32 if (2 * base + 4) * base < 2**31 else np.int64
    gain, miss = small(2 * base), small(round(2 * MISS) * base)
    ramp = miss * np.arange(width, dtype=small)
    short, own = tokens.astype(np.uint32), items.tokens.astype(np.uint32)
    for k in range(0, len(order), 2048):
        c = order[k : k + 2048]
        h, top = np.zeros((len(c), width), small), np.zeros(len(c), small)
        last = np.zeros(len(c), np.int64)
        for i in range(int(size[item[c]].max())):
            if i % 8 == 0:
                d, length, first = doc[c], size[item[c]], items.start[item[c]]
                may = np.maximum(h.max(axis=1) // base + 2 * np.maximum(length - i, 0), top // base) >= 2 * least[item[c]]
                if not may.all():
                    c, h, top, last, d, length, first = c[may], h[may], top[may], last[may], d[may], length[may], first[may]
                    if not len(c):
                        break
                at = (doc_start[d] + off[c] - BAND_BEFORE)[:, None] + np.arange(width)
                low, high = doc_start[d][:, None], doc_start[d + 1][:, None]
            has = i < length
            a = own[np.where(has, first + i, 0)]
            j = at + i
            equal = (short[np.clip(j, 0, len(short) - 1)] == a[:, None]) & (j >= low) & (j < high) & has[:, None]
            new = h + np.where(equal, gain, -miss)
            new[:, :-1] = np.maximum(new[:, :-1], h[:, 1:] - miss)
            h = np.maximum(np.maximum.accumulate(new + ramp, axis=1) - ramp, small(i + 1))
            now = h.max(axis=1)
            better = now // base > top // base
            top, last = np.where(better, now, top), np.where(better, i, last)
        best[c], reach[c] = top // base / 2, np.where(top >= base, last - top % base + 1, 0)
    return best, reach


_FOUND = "doc_id bigint, text_id bigint, item_id bigint, share double, reach double, phrases array<bigint>, n bigint"
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.int64())


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, _TYPES)], names=[c.split()[0] for c in _FOUND.split(", ")])


def _judged(hashes: list[np.ndarray], ids: np.ndarray, text_ids: np.ndarray, doc: np.ndarray, item: np.ndarray, off: np.ndarray, items: Items, share: float) -> list[tuple]:
    """The pairs whose passage may be one: doubtful ones with the phrases that document and item share, whose number of documents decides."""
    if not len(doc):
        return []
    start = np.append(0, np.cumsum([len(h) for h in hashes]))
    size = np.diff(items.start)
    spare = np.where(size >= SPARED, 1.0, 0.0)
    least = LOWEST * share * size - SPARE_SCORE * spare
    score, reach = passages(np.concatenate(hashes), start, doc, item, off, items, least)
    ok = (score >= least[item]) & (reach >= (LEAST_REACH * share * size - SPARE_WORDS * spare)[item]) & (score + SPARE_SCORE >= LEAST_DENSITY * reach)
    ok = (score > 0) & (ok | (score >= share * size[item]))
    best: dict[tuple[int, int], tuple] = {}
    for d, i, s, r in zip(doc[ok].tolist(), item[ok].tolist(), (score / np.maximum(size[item], 1))[ok].tolist(), (reach / np.maximum(size[item], 1))[ok].tolist()):
        best[d, i] = max(best.get((d, i), (0.0, 0.0)), (s, r))
    rows = []
    for (d, i), (s, r) in best.items():
        own = None
        if s < share:
            own = np.intersect1d(phrase_keys(items.tokens[items.start[i] : items.start[i + 1]]), phrase_keys(hashes[d])).astype(np.int64).tolist()
        rows.append((int(ids[d]), int(text_ids[d]), int(items.ids[i]), s, r, own, None))
    return rows


def _chunks(batches: Iterator[pa.RecordBatch], headers: str, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Ids, text ids and word hashes of a few hundred documents at a time, which keeps the arrays small, whatever the batch."""
    known = Hashes(headers)
    for b in batches:
        ids, text_ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), b.column(2)
        k = 0
        while k < len(ids):
            hashes, first, n = [], k, 0
            while k < len(ids) and n < most:
                hashes.append(np.array(known(texts[k].as_py() or ""), np.uint64))
                n += len(hashes[-1])
                k += 1
            yield ids[first:k], text_ids[first:k], hashes


def _padded(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([*hashes, np.full(PAD, (1 << 64) - 1, np.uint64)]), np.append(0, np.cumsum([len(h) for h in hashes]))


def _distinct_in_documents(tokens: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and key of every phrase, once a document. Phrases that run over the end of one are not of it."""
    keys = phrase_keys(tokens)[: max(int(start[-1]) - PHRASE + 1, 0)]
    doc = np.searchsorted(start, np.arange(len(keys)), "right") - 1
    inside = np.arange(len(keys)) + PHRASE <= start[doc + 1]
    return doc[inside], keys[inside]


def _search(items: Items, share: float, headers: str):
    """A map over documents for items that a task holds: pairs, and how many documents hold each phrase of an item."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _marked(items.phrases)
        mask = np.uint64(len(seen) - 1)
        n, docs = np.zeros(len(items.phrases), np.int64), 0
        for ids, text_ids, hashes in _chunks(batches, headers):
            tokens, start = _padded(hashes)
            yield _rows(_judged(hashes, ids, text_ids, *candidates(tokens, start, items), items, share))
            doc, keys = _distinct_in_documents(tokens, start)
            x = np.flatnonzero(seen[keys & mask])
            at = np.searchsorted(items.phrases, keys[x])
            hit = items.phrases[np.minimum(at, len(n) - 1)] == keys[x] if len(n) else np.zeros(len(x), bool)
            pairs = np.unique(doc[x][hit] * (len(n) + 1) + at[hit])
            np.add.at(n, pairs % (len(n) + 1), 1)
            docs += len(ids)
        held = np.flatnonzero(n)
        if docs:
            yield _rows([(None, None, None, None, None, None, docs), *[(None, None, None, None, None, [k], c) for k, c in zip(items.phrases[held].astype(np.int64).tolist(), n[held].tolist())]])

    return work


def _item_rows(headers: str):
    """Items as rows of their keys (``kind`` 0, with the class) and phrases (``kind`` 1)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes(headers)
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = known(t)
                if not w:
                    continue
                steps, keys, at = item_keys(0, w)
                p = np.unique(phrase_keys(np.array(w, np.uint64)))
                k, v = len(keys), needed(len(w))
                cols = ([i] * (k + len(p)), [0] * k + [1] * len(p), [steps] * (k + len(p)), np.concatenate([keys, p]).astype(np.int64), np.append(at, np.zeros(len(p), np.int32)), [v[0]] * (k + len(p)), [v[1]] * (k + len(p)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["item_id", "kind", "steps", "key", "at", "votes", "wide"])

    return work, "item_id bigint, kind int, steps int, key bigint, at int, votes int, wide int"


def _document_rows(bits: np.ndarray, classes: tuple[int, ...], headers: str):
    """Documents as rows of those keys (``kind`` 0) and phrases (``kind`` 1) that the bitmap of the items' keys holds, and one (``kind`` 2) each."""
    mask = np.uint64((1 << FILTER_BITS) - 1)
    names = ["doc_id", "text_id", "kind", "key", "place"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = lambda k: (bits[(k & mask) >> np.uint64(3)] >> (k & np.uint64(7)).astype(np.uint8)) & 1 == 1
        for ids, text_ids, hashes in _chunks(batches, headers):
            tokens, start = _padded(hashes)
            found = [(np.arange(len(ids)), np.full(len(ids), 2), np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.int64))]
            for places, keys in document_keys(tokens, classes):
                ok = has(keys) & (places < start[-1])
                doc = np.searchsorted(start, places[ok], "right") - 1
                found.append((doc, np.zeros(len(doc), int), keys[ok], places[ok] - start[doc]))
            doc, keys = _distinct_in_documents(tokens, start)
            ok = has(keys)
            doc, keys = np.unique(np.stack([doc[ok].astype(np.uint64), keys[ok]]), axis=1)
            found.append((doc.astype(int), np.ones(len(doc), int), keys, np.zeros(len(doc), np.int64)))
            doc, kind, keys, place = (np.concatenate(c) for c in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(ids[doc], pa.int64()), pa.array(text_ids[doc], pa.int64()), pa.array(kind, pa.int32()), pa.array(keys.astype(np.int64)), pa.array(place, pa.int64())], names=names)

    return work, "doc_id bigint, text_id bigint, kind int, key bigint, place bigint"


def _bitmap(keys: DataFrame) -> np.ndarray:
    """A bitmap of keys of a fixed size, whatever their number."""
    low = F.col("key").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) + 1
    parts = keys.select(low.alias("k")).groupBy(F.bitmap_bucket_number("k").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("k")).alias("m"))
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    # at most 2 ** FILTER_BITS / 32768 rows of 4 KB
    for r in parts.toLocalIterator():
        m = np.frombuffer(bytes(r.m), np.uint8)
        out[(r.b - 1) * 4096 : (r.b - 1) * 4096 + len(m)] = m
    return out


def _aligned(share: float, headers: str):
    """A map over pairs of texts with their offsets: the passages that may be one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes(headers)
        for b in batches:
            rows = []
            for d, x, i, t, own, offs in zip(*[c.to_pylist() for c in b.columns]):
                items = index_items([i], [own], headers, keyed=False)
                off = np.array(offs, np.int64)
                rows += _judged([np.array(known(t), np.uint64)], np.array([d]), np.array([x]), np.zeros(len(off), np.int64), np.zeros(len(off), np.int64), off, items, share)
            yield _rows(rows)

    return work


def _joined(d: DataFrame, items: DataFrame, share: float, headers: str) -> DataFrame:
    """The rows of ``_search`` for any number of items: one pass over the documents for the keys, and the texts of the pairs with enough votes once
    more for the alignment."""
    work, schema = _item_rows(headers)
    keys = materialise(spread(items).mapInArrow(work, schema))
    classes = tuple(sorted(r.steps for r in keys.select("steps").distinct().collect()))
    work, schema = _document_rows(_bitmap(keys), classes, headers)
    rows = materialise(d.mapInArrow(work, schema))
    v = rows.filter("kind = 0").select("doc_id", "text_id", "key", "place").join(keys.filter("kind = 0").drop("kind"), "key").withColumn("off", F.col("place") - F.col("at"))
    half = F.floor(F.col("off") / (BIN // 2))
    v = v.withColumn("bin", F.explode(F.array(half, half - 1)))
    pair = ["doc_id", "text_id", "item_id"]
    v = v.groupBy(*pair, "bin").agg(F.count("*").alias("n"), F.round(F.avg("off")).cast("bigint").alias("off"), (F.max("at") - F.min("at")).alias("w"), F.first("votes").alias("votes"), F.first("wide").alias("wide"))
    v = v.filter("n >= votes and w >= wide")
    v = v.groupBy(*pair).agg(F.max("n").alias("most"), F.collect_set(F.struct("n", "off")).alias("o"))
    v = v.select(*pair, F.array_distinct(F.transform(F.filter("o", lambda x: 2 * x["n"] >= F.col("most")), lambda x: x["off"])).alias("offs"))
    texts = d.select("doc_id", "text_id", F.col("text").alias("t")).dropDuplicates(["doc_id", "text_id"])
    v = v.join(texts, ["doc_id", "text_id"]).join(items.withColumnRenamed("text", "own"), "item_id").select(*pair, "t", "own", "offs")
    none = lambda t: F.lit(None).cast(t)
    counts = rows.filter("kind > 0").groupBy("kind", "key").agg(F.count("*").alias("n"))
    counts = counts.select(none("bigint").alias("doc_id"), none("bigint").alias("text_id"), none("bigint").alias("item_id"), none("double").alias("share"), none("double").alias("reach"), F.when(F.col("kind") == 1, F.array("key")).alias("phrases"), "n")
    return spread(v).mapInArrow(_aligned(share, headers), _FOUND).unionByName(counts)


#: A passage below the share is one if it scores so much of it, runs through so much of the share, and scores so much of what it runs through:
#: half an item with one word in ten changed scores 0.375 of the item, 0.75 of the half, and loses a word or two where its ends are changed.
LOWEST, LEAST_REACH, LEAST_DENSITY, LEAST_RARE = 0.68, 0.92, 0.6, 0.2
#: What one changed word beside an end costs, words and score: spared to items of so many words, whose half may hold one.
SPARED, SPARE_WORDS, SPARE_SCORE = 12, 1.6, 0.6


def leaked(documents: DataFrame, items: DataFrame, share: float = 0.5, headers: str = PAGE_HEADERS, held: int = HELD_ITEMS) -> DataFrame:
    """``(doc_id, item_id, share)``: documents holding a passage of at least ``share`` of an item, with its alignment score per word of the item.

    An equal word counts 1, a changed one -1.5. A score of ``share`` is a passage. So is a lower one that runs through ``share`` of the item's words
    with about one in ten changed, unless it is common wording: four fifths or more of the phrases of five words that document and item have in
    common stand in more than a hundredth of all documents (and more than fifty). Null and empty texts hold nothing, and rows without an id can't
    be reported and are left out; a document or item given twice gives its pairs once, with the better share. Other columns are not looked at.
    ``headers``: a pattern of lines to be cut out. Up to ``held`` items are held by every task; any more are joined, with the same result.
    """
    d = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id is not null and length(text) > 0")
    d = spread(d).select("doc_id", F.xxhash64("text").alias("text_id"), "text")
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("item_id is not null and length(text) > 0").distinct()
    few = items.limit(held + 1).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("signs")).first()
    if few.n <= held and (few.signs or 0) <= HELD_SIGNS:
        rows = items.toPandas()
        found = d.mapInArrow(_search(index_items(rows.item_id.tolist(), rows.text.tolist(), headers), share, headers), _FOUND)
    else:
        found = _joined(d, items, share, headers)
    found = materialise(found)
    pairs = found.filter("item_id is not null")
    clear = pairs.filter(F.col("phrases").isNull())
    counts = found.filter("item_id is null and phrases is not null").groupBy(F.element_at("phrases", 1).alias("_p")).agg(F.sum("n").alias("_n"))
    most = F.greatest(F.coalesce(found.filter("item_id is null and phrases is null").agg(F.sum("n")).scalar(), F.lit(0)) * COMMON_SHARE, F.lit(COMMON_LEAST))
    doubtful = pairs.filter("size(phrases) > 0").select("doc_id", "text_id", "item_id", "share", F.explode("phrases").alias("_p")).join(counts, "_p")
    rare = doubtful.groupBy("doc_id", "text_id", "item_id", "share").agg(F.avg((F.col("_n") <= most).cast("double")).alias("_r")).filter(F.col("_r") >= LEAST_RARE)
    at = ["doc_id", "item_id", "share"]
    return clear.select(at).unionByName(rare.select(at)).unionByName(pairs.filter("size(phrases) = 0").select(at)).groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
