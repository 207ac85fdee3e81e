"""Periodic runs of words (operator 11).

A run is a longest stretch of consecutive words of one document with a smallest
period q and at least ``max(least_length, least_repeats * q)`` words. Each task
takes blocks of whole documents:

* An enhanced suffix array over word numbers, by prefix doubling; the document
  is part of the first key, so suffixes of different documents never mix, and
  only groups that still agree are sorted again. Common-prefix lengths come from
  the ranks of the earlier rounds.
* Branching tandem test: for every interval of common-prefix length D, each
  suffix i of all children but the largest asks the inverse suffix array whether
  i + D and i - D lie in the same interval, with different next words. That
  yields every square that cannot be moved right by a word. No tree is built.
* Rotating such a square left while the words agree gives the run; one square of
  a run ends where the run ends, and multiples of its period are dropped there.

Periods above the length of a document over ``least_repeats`` cannot form a run,
so sorting and testing stop at that depth. Work is n log n for n words of a
document; nothing is shuffled, since runs stay within a document. Memory is
bounded by ``BLOCK_WORDS`` words or one longer document.

Null texts and texts without words have no runs and an empty collapsed text.
Rows without doc_id are left out; repeated rows are judged each; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shopledger.llm.common import SPACE, id_and_text, record_batch, text_parts, words

BLOCK_WORDS = 1 << 18
LEAST_LENGTH, LEAST_REPEATS = 6, 4
HASH_PIECE = 1 << 16


def word_numbers(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A number for each word, equal exactly for equal bytes."""
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    column = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return column.dictionary_encode().indices.to_numpy().astype(np.int64)


def enhanced_suffix_array(code: np.ndarray, doc: np.ndarray, end: np.ndarray, deepest: np.ndarray):
    """Suffix array, its inverse and common-prefix lengths, exact up to ``deepest`` of the document; larger ones read n."""
    n = len(code)
    sa = np.argsort(doc * (int(code.max(initial=0)) + 1) + code, kind="stable")
    slots = np.arange(n)
    fresh = np.ones(n, bool)
    fresh[1:] = (code[sa[1:]] != code[sa[:-1]]) | (doc[sa[1:]] != doc[sa[:-1]])
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(fresh, slots, 0))
    common = np.where(fresh, 0, n)
    rounds, h = [], 1
    while True:
        rounds.append(rank.astype(np.int32))
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        slots = slots[tied]
        slots = slots[deepest[doc[sa[slots]]] >= h]
        if not len(slots):
            return sa, rank, common
        at = sa[slots]
        after = at + h
        old = rank[at]
        key = old * (n + 1) + np.where(after < end[at], rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(key)
        at, key = at[order], key[order]
        sa[slots] = at
        fresh = np.ones(len(at), bool)
        fresh[1:] = key[1:] != key[:-1]
        split = np.flatnonzero(fresh[1:] & (old[1:] == old[:-1])) + 1  # groups stay in their slots
        x, y = at[split - 1] + h, at[split] + h
        x_end, y_end = end[at[split - 1]], end[at[split]]
        for level in range(len(rounds) - 2, -1, -1):
            r = rounds[level]
            same = (x < x_end) & (y < y_end) & (r[np.minimum(x, n - 1)] == r[np.minimum(y, n - 1)])
            x, y = x + (same << level), y + (same << level)
        common[slots[split]] = y - at[split]
        rank[at] = np.maximum.accumulate(np.where(fresh, slots, 0))
        h *= 2


def smaller_before(v: np.ndarray) -> np.ndarray:
    """For each place the last one before it with a smaller value; v[0] is 0, and zeros are not asked."""
    before = np.arange(len(v)) - 1
    ask = np.flatnonzero(v)
    while len(ask):
        ask = ask[v[before[ask]] >= v[ask]]
        before[ask] = before[before[ask]]
    return before


def branching_squares(code, doc, start, end, deepest) -> tuple[np.ndarray, np.ndarray]:
    """Start and root length of every tandem repeat that is followed by another word than its period asks."""
    n = len(code)
    sa, isa, common = enhanced_suffix_array(code, doc, end, deepest)
    inner = np.flatnonzero((common > 0) & (common <= deepest[doc[sa]]))
    if not len(inner):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left = smaller_before(common)[inner]
    right = n - smaller_before(np.append(common, 0)[::-1])[n - inner]  # one past the interval
    order = np.argsort((left << 32) | common[inner], kind="stable")
    inner, left, right = inner[order], left[order], right[order]
    depth = common[inner]
    first = np.ones(len(inner), bool)
    first[1:] = (left[1:] != left[:-1]) | (depth[1:] != depth[:-1])
    interval = np.cumsum(first) - 1
    following = np.append(inner[1:], 0)
    last = np.append(first[1:], True)
    following[last] = right[last]
    heads = np.flatnonzero(first)
    low = np.concatenate([left[heads], inner])
    size = np.concatenate([inner[heads], following]) - low
    own = np.concatenate([np.arange(len(heads)), interval])
    largest = np.zeros(len(heads), np.int64)
    np.maximum.at(largest, own, size)
    biggest = np.flatnonzero(size == largest[own])
    small = np.ones(len(size), bool)
    small[biggest[np.unique(own[biggest], return_index=True)[1]]] = False
    low, size, own = low[small], size[small], own[small]
    from_, to = np.repeat(left[heads][own], size), np.repeat(right[heads][own], size)
    d = np.repeat(depth[heads][own], size)
    i = sa[np.repeat(low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    found = []
    for other, begin in ((i + d, i), (i - d, i - d)):
        rank = isa[np.clip(other, 0, n - 1)]
        hit = np.flatnonzero((other >= start[i]) & (other < end[i]) & (rank >= from_) & (rank < to))
        s, p, stop = begin[hit], d[hit], end[i[hit]]
        after = s + 2 * p
        open_ = (after >= stop) | (code[s + p] != code[np.minimum(after, n - 1)])
        found.append((s[open_] << 32) | p[open_])
    squares = np.unique(np.concatenate(found))
    return squares >> 32, squares & 0xFFFFFFFF


def rotated_left(code: np.ndarray, s: int, p: int, start: int) -> int:
    """Where the squares of period p that end no later than that at s begin: steps left while the words agree."""
    step = 16
    while s > start:
        b = min(step, s - start)
        differ = np.flatnonzero(code[s - b : s] != code[s - b + p : s + p])
        if len(differ):
            return s - b + int(differ[-1]) + 1
        s, step = s - b, step * 2
    return s


def runs_of(code, bounds, least_length: int = LEAST_LENGTH, least_repeats: int = LEAST_REPEATS) -> list[list[tuple[int, int, int]]]:
    """For each document the (start, length, period) of its runs, by start and period; ``bounds`` cut the words into documents."""
    lengths = np.diff(bounds)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    start, end = bounds[:-1][doc], bounds[1:][doc]
    out: list[list[tuple[int, int, int]]] = [[] for _ in lengths]
    at, period = branching_squares(code, doc, start, end, lengths // least_repeats)
    least = np.maximum(least_length, least_repeats * period)
    from_ = at + 2 * period - least
    able = from_ >= start[at]
    at, period, least, from_ = at[able], period[able], least[able], from_[able]
    able = code[from_] == code[from_ + period]
    at, period, least = at[able], period[able], least[able]
    order = np.lexsort((period, at + 2 * period))
    kept_end, kept = -1, []
    for s, p, want in zip(at[order].tolist(), period[order].tolist(), least[order].tolist(), strict=True):
        stop = s + 2 * p
        if stop != kept_end:
            kept_end, kept = stop, []
        if any(p % q == 0 and s >= begin for begin, q in kept):
            continue
        begin = rotated_left(code, s, p, int(start[s]))
        if stop - begin >= want:
            kept.append((begin, p))
            k = int(doc[s])
            out[k].append((begin - int(bounds[k]), stop - begin, p))
    for rows in out:
        rows.sort(key=lambda r: (r[0], r[2]))
    return out


def repeated_source(doc_id: int, n: int) -> np.ndarray | None:
    """Which original word stands at each place of a document that the contract makes periodic; None leaves it as it is."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    return np.where(places < a, places, a + (places - a) % p)


def joined_hash(raw: bytes, begin: np.ndarray, end: np.ndarray) -> str:
    """SHA-256 of the words joined by one space, a piece of them at a time."""
    digest = hashlib.sha256()
    for k in range(0, len(begin), HASH_PIECE):
        if k:
            digest.update(b" ")
        digest.update(b" ".join([raw[i:j] for i, j in zip(begin[k : k + HASH_PIECE].tolist(), end[k : k + HASH_PIECE].tolist(), strict=True)]))
    return digest.hexdigest()


def greatest(rows: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run with the greatest length over period, the first by start and period among equals."""
    best = rows[0]
    for row in rows[1:]:
        if row[1] * best[2] > best[1] * row[2]:
            best = row
    return best


REPORT = "doc_id long, n_words long, n_runs long, n_dropped long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def blocks(bounds: np.ndarray):
    """Cuts of the documents into blocks of about BLOCK_WORDS words, at least one document each."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + BLOCK_WORDS, "right")) - 1)
        yield i, j
        i = j


def run_report(docs: DataFrame, least_length: int = LEAST_LENGTH, least_repeats: int = LEAST_REPEATS, source=None) -> DataFrame:
    """Runs of each document, the greatest of them, and the digest of the text with every run cut to its first period.

    ``source(doc_id, n)`` may say which original word stands at each place.
    """

    def report(ids, data, offsets):
        begin, end, doc = words(data, offsets)
        bounds = np.searchsorted(doc, np.arange(len(ids) + 1))
        lengths = end - begin
        flat = data[~SPACE[data]]
        raw = flat.tobytes()
        close = np.cumsum(lengths)
        for i, j in blocks(bounds):
            lo, hi = bounds[i], bounds[j]
            word = np.arange(lo, hi)
            for k in range(i, j) if source else ():
                moved = source(ids[k], int(bounds[k + 1] - bounds[k]))
                if moved is not None:
                    word[bounds[k] - lo : bounds[k + 1] - lo] = bounds[k] + moved
            if hi > lo:
                first = close[lo] - lengths[lo]
                code = word_numbers(flat[first : close[hi - 1]], lengths[lo:hi])[word - lo]
                found = runs_of(code, bounds[i : j + 1] - lo, least_length, least_repeats)
            else:
                found = [[] for _ in range(i, j)]
            cover = np.zeros(hi - lo + 1, np.int64)
            for k, rows in enumerate(found, i):
                for s, length, p in rows:
                    cover[bounds[k] - lo + s + p] += 1
                    cover[bounds[k] - lo + s + length] -= 1
            dropped = np.cumsum(cover)[:-1] > 0
            for k, rows in enumerate(found, i):
                here = slice(bounds[k] - lo, bounds[k + 1] - lo)
                kept = word[here][~dropped[here]]
                best = greatest(rows) if rows else (None, None, None)
                listed = "".join(f"{s},{length},{p}\n" for s, length, p in rows)
                yield (
                    ids[k], int(bounds[k + 1] - bounds[k]), len(rows), int(dropped[here].sum()), *best, 1000 * best[1] // best[2] if rows else None,
                    hashlib.sha256(listed.encode()).hexdigest(), joined_hash(raw, close[kept] - lengths[kept], close[kept]),
                )

    def run(batches):
        for batch in batches:
            for part in text_parts(batch):
                yield record_batch(REPORT, zip(*report(*part), strict=True))

    return id_and_text(docs).mapInArrow(run, REPORT)
