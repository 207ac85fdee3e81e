"""Removal of repeated passages with a sparse suffix array (operator 8).

A byte goes if a string of ``SPAN`` bytes that covers it also starts in a
document with a smaller id. Windowed minima of ``GRAM``-byte hashes choose the
suffixes that matter: two equal strings of SPAN bytes choose the same suffix at
the same place, so only suffixes whose gram occurs in two documents are sorted.
They are dealt by gram; each task orders its suffixes by a deep-shallow sort
(multikey quicksort on eight-byte words down to the gram, then blind tries for
the groups that still agree) and their left contexts likewise, and reads from the
two arrays of common-prefix lengths which of the strings through a suffix occur
in a smaller document.

Documents stay in chunks. Only hashes, contexts of repeated grams (once for each
chunk, however many copies it has) and answers are moved; answers come in the
order in which a chunk asked, so they need no names. A gram that is hot brings at
most its different contexts in each chunk; all contexts of one gram are sorted in
one bucket, the buckets themselves are even.

Texts under SPAN bytes and null texts keep everything. Rows with the same id
never remove from each other; equal texts keep the one with the smallest id.
Empty table: no rows. A very long text is one chunk by itself.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopledger.llm.common import U64, chunk_parts, chunk_rest, chunk_table, cut_lineage, mixed, packed, powers, prefix_hashes, record_batch, rows_of, span_hashes, unpacked

SPAN, GRAM = 50, 24
LEFT = SPAN - GRAM
SHALLOW_WORDS = GRAM // 8
HASH_BITS = 44
CHUNK_BYTES, CHUNKS_A_BUCKET = 2 << 20, 8
#: Contexts that are sorted together; a single gram with more of them stays whole.
SORTED_TOGETHER = 1 << 16


def sliding(a: np.ndarray, width: int, best) -> np.ndarray:
    """best over a[i : i + width] for each full window, by doubling."""
    out, have = a, 1
    while have < width:
        step = min(have, width - have)
        out = best(out[:-step], out[step:])
        have += step
    return out


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the chosen suffixes, the hashes of their grams, and the prefix hashes of the data."""
    prefix = prefix_hashes(data)
    n = len(data) - GRAM + 1
    if len(data) < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, U64), prefix
    h = mixed((prefix[GRAM:] - prefix[:-GRAM]) * powers("inverse", n))
    low = sliding(h, LEFT + 1, np.minimum)
    edge = offsets[1:-1]  # windows that cross into the next document do not count
    crossing = np.zeros(len(low) + 1, np.int64)
    np.add.at(crossing, np.clip(edge - SPAN + 1, 0, len(low)), 1)
    np.add.at(crossing, np.clip(edge, 0, len(low)), -1)
    low[np.cumsum(crossing)[:-1] > 0] = 0
    pad = np.zeros(LEFT, U64)
    high = sliding(np.concatenate([pad, low, pad]), LEFT + 1, np.maximum)
    at = np.flatnonzero(high[:n] == h)
    # mixed again: the least of many hashes has few different leading bits, and buckets go by those
    return at, mixed(h[at]) >> U64(64 - HASH_BITS), prefix


class Chunk:
    """A chunk's chosen suffixes with everything that all three passes agree on."""

    def __init__(self, row: dict, buckets: int):
        self.ids, self.offsets, self.data = chunk_parts(row)
        self.shift = U64(HASH_BITS - (buckets.bit_length() - 1))
        self.at, self.hash, self.prefix = anchors(self.data, self.offsets)
        self.doc = np.searchsorted(self.offsets, self.at, "right") - 1

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct gram hashes, whether several documents here have them, and each suffix's number."""
        unique, number = np.unique(self.hash, return_inverse=True)
        low = np.full(len(unique), np.iinfo(np.int64).max)
        high = np.full(len(unique), np.iinfo(np.int64).min)
        own = self.ids[self.doc]
        np.minimum.at(low, number, own)
        np.maximum.at(high, number, own)
        return unique, low < high, number

    def cuts(self, unique: np.ndarray, buckets: int) -> np.ndarray:
        return np.searchsorted(unique >> self.shift, np.arange(buckets + 1, dtype=U64))

    def contexts(self, repeated: np.ndarray):
        """Different contexts of the repeated suffixes: a first place and the smallest id of each; places and their context numbers."""
        at, h, doc = self.at[repeated], self.hash[repeated], self.doc[repeated]
        start, end = np.maximum(self.offsets[doc], at - LEFT), np.minimum(self.offsets[doc + 1], at + SPAN)
        name = mixed(span_hashes(self.prefix, start, end) + (at - start).astype(U64) * U64(1 << 20) + (end - at).astype(U64))
        keyed = np.zeros(len(at), [("b", U64), ("n", U64)])
        keyed["b"], keyed["n"] = h >> self.shift, name
        order = np.lexsort((keyed["n"], keyed["b"]))
        fresh = np.ones(len(order), bool)
        fresh[1:] = keyed[order[1:]] != keyed[order[:-1]]
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(fresh) - 1
        first = order[fresh]
        low = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(low, number, self.ids[doc])
        return first, low, number, at, start, end, doc, keyed["b"][first]

    def context_bytes(self, at, start, end) -> np.ndarray:
        """Rows of LEFT bytes before and SPAN bytes from each place; 255 stands beyond the document."""
        where = at[:, None] + np.arange(-LEFT, SPAN)
        out = self.data[np.clip(where, 0, len(self.data) - 1)]
        out[(where < start[:, None]) | (where >= end[:, None])] = 255
        return out


def words_of(rows: np.ndarray) -> np.ndarray:
    """Bytes of each row as big-endian eight-byte words."""
    n, width = rows.shape
    out = np.zeros((n, -(-width // 8) * 8), np.uint8)
    out[:, :width] = rows
    return out.view(">u8").astype(U64)


def multikey(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the words, one at a time, each only within the groups still tied; and the group of each place."""
    order, group = np.arange(len(words)), np.zeros(len(words), np.int64)
    for depth in range(words.shape[1]):
        tied = np.zeros(len(order), bool)
        tied[1:] = group[1:] == group[:-1]
        tied[:-1] |= tied[1:].copy()
        some = np.flatnonzero(tied)
        if len(some):
            order[some] = order[some][np.lexsort((words[order[some], depth], group[some]))]
        key = words[order, depth]
        split = np.ones(len(order), bool)
        split[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        group = np.cumsum(split) - 1
    return order, group


def blind_trie(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of different strings of one length, and each one's common prefix with the one before.

    A node keeps a depth and branches by the byte there. A string goes down blindly,
    is compared once with a leaf below, and is put in where they differ.
    """
    root: list = [0, None, 0]  # depth, branches or None at a leaf, some leaf below
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while node[1] is not None:
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        t = strings[node[2]]
        d = next(k for k in range(len(s)) if s[k] != t[k])
        node, parent = root, None
        while node[1] is not None and node[0] < d:
            parent, node = node, node[1][s[node[0]]]
        if node[1] is not None and node[0] == d:
            node[1][s[d]] = [0, None, i]
            continue
        new = [d, {strings[node[2]][d]: node, s[d]: [0, None, i]}, node[2]]
        if parent is None:
            root = new
        else:
            parent[1][s[parent[0]]] = new
    order, common, stack = [], [], [(root, 0)]
    while stack:
        node, shared = stack.pop()
        if node[1] is None:
            order.append(node[2])
            common.append(shared)
        else:
            branches = sorted(node[1])
            for k in range(len(branches) - 1, -1, -1):
                stack.append((node[1][branches[k]], node[0] if k else shared))
    return order, common


def suffix_order(right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of rows of SPAN bytes, and common-prefix lengths from GRAM up (below that, 0)."""
    order, group = multikey(words_of(right[:, :GRAM]))
    common = np.zeros(len(order), np.int64)
    bounds = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(order))
    deep = np.flatnonzero(np.diff(bounds) > 1)
    raw, width = np.ascontiguousarray(right).tobytes(), right.shape[1]
    for i, j in zip(bounds[deep].tolist(), bounds[deep + 1].tolist(), strict=True):
        rows: dict[bytes, list[int]] = {}
        for r in order[i:j].tolist():
            rows.setdefault(raw[r * width : (r + 1) * width], []).append(r)
        strings = list(rows)
        ranks, shared = blind_trie(strings) if len(strings) > 1 else ([0], [0])
        k = i
        for rank, c in zip(ranks, shared, strict=True):
            same = rows[strings[rank]]
            order[k : k + len(same)] = same
            common[k] = c
            common[k + 1 : k + len(same)] = width
            k += len(same)
    return order, common


def seen_before(context: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each context a bit for every offset whose string also occurs in a smaller document."""
    n = len(doc)
    left, right = context[:, LEFT - 1 :: -1] if LEFT else context[:, :0], context[:, LEFT:]
    room_left, room_right = (left != 255).sum(axis=1), (right != 255).sum(axis=1)
    r_order, r_common = suffix_order(right)
    l_order, l_group = multikey(words_of(left))
    differ = left[l_order[1:]] != left[l_order[:-1]]
    l_common = np.concatenate([[0], np.where(differ.any(axis=1), differ.argmax(axis=1), LEFT)]) if n else np.zeros(0, int)
    bits = np.zeros(n, np.uint32)
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(LEFT + 1):
        r_class[r_order] = np.cumsum(r_common < SPAN - o)
        l_class[l_order] = np.cumsum(l_common < o) if o else 0
        ok = np.flatnonzero((room_left >= o) & (room_right >= SPAN - o))
        if not len(ok):
            continue
        key = r_class[ok] * (n + 1) + l_class[ok]
        order = np.argsort(key, kind="stable")
        first = np.ones(len(order), bool)
        first[1:] = key[order[1:]] != key[order[:-1]]
        low = np.minimum.reduceat(doc[ok][order], np.flatnonzero(first))
        hit = np.empty(len(order), bool)
        hit[order] = low[np.cumsum(first) - 1] < doc[ok][order]
        bits[ok[hit]] |= np.uint32(1 << o)
    return bits


def seen_in_parts(context: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """``seen_before`` on parts of the contexts that share no gram, so what it holds beside them is bounded."""
    parts = -(-len(doc) // SORTED_TOGETHER)
    if parts < 2:
        return seen_before(context, doc)
    gram = words_of(context[:, LEFT : LEFT + GRAM])
    name = gram[:, 0]
    for k in range(1, gram.shape[1]):
        name = mixed(name) + gram[:, k]
    part = mixed(name) % U64(parts)
    del gram, name
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1, dtype=U64))
    bits = np.zeros(len(doc), np.uint32)
    for i, j in zip(cut, cut[1:], strict=False):
        some = order[i:j]
        bits[some] = seen_before(context[some], doc[some])
    return bits


def ask_grams(buckets: int):
    schema = "bucket int, chunk long, body binary"

    def run(batches):
        for row in rows_of(batches):
            chunk = Chunk(row, buckets)
            unique, several, _ = chunk.grams()
            cut, rows = chunk.cuts(unique, buckets), []
            for b in np.flatnonzero(np.diff(cut)):
                u = unique[cut[b] : cut[b + 1]]
                steps = (np.diff(u, prepend=U64(0)) << U64(1)) | several[cut[b] : cut[b + 1]].astype(U64)
                start, rest = steps[:1], steps[1:]
                small = not len(rest) or rest.max() < 1 << 32
                rows.append((int(b), row["chunk"], bytes([int(small)]) + start.tobytes() + (rest.astype(np.uint32) if small else rest).tobytes()))
            if rows:
                yield record_batch(schema, zip(*rows, strict=True))

    return run, schema


def answer_grams(group):
    """For each chunk, which of its grams occur in two documents, as packed bits."""
    chunks, parts, marks = group.column("chunk").to_pylist(), [], []
    for body in group.column("body").to_pylist():
        rest = np.frombuffer(body[9:], np.uint32 if body[0] else U64).astype(U64)
        steps = np.concatenate([np.frombuffer(body[1:9], U64), rest])
        parts.append(np.cumsum(steps >> U64(1)))
        marks.append((steps & U64(1)).astype(bool))
    every = np.concatenate(parts)
    order = np.argsort(every, kind="stable")
    same = every[order][1:] == every[order][:-1]
    twice = np.concatenate(marks)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cut = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "bucket": group.column("bucket"), "bits": pa.array([np.packbits(twice[i:j]).tobytes() for i, j in zip(cut, cut[1:], strict=False)], pa.binary())})


def repeated_suffixes(chunk: Chunk, answers: list[dict], buckets: int) -> np.ndarray:
    unique, _, number = chunk.grams()
    cut = chunk.cuts(unique, buckets)
    twice = np.zeros(len(unique), bool)
    for a in answers or ():
        i, j = cut[a["bucket"]], cut[a["bucket"] + 1]
        twice[i:j] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=j - i)
    return np.flatnonzero(twice[number])


def ask_contexts(buckets: int):
    schema = "bucket int, chunk long, context binary, docs binary"

    def run(batches):
        for row in rows_of(batches):
            chunk = Chunk(row, buckets)
            first, low, _, at, start, end, _, bucket = chunk.contexts(repeated_suffixes(chunk, row["answers"], buckets))
            cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=U64))
            for b in np.flatnonzero(np.diff(cut)):
                i = first[cut[b] : cut[b + 1]]
                yield record_batch(schema, ([int(b)], [row["chunk"]], [packed(chunk.context_bytes(at[i], start[i], end[i]))], [packed(low[cut[b] : cut[b + 1]])]))

    return run, schema


def answer_contexts(group):
    docs = [unpacked(d.as_py(), np.int64) for d in group.column("docs")]
    cut = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    context = np.empty((cut[-1], LEFT + SPAN), np.uint8)
    for c, i, j in zip(group.column("context"), cut, cut[1:], strict=False):
        context[i:j] = unpacked(c.as_py(), np.uint8).reshape(-1, LEFT + SPAN)
    bits = seen_in_parts(context, np.concatenate(docs))
    return pa.table({"chunk": group.column("chunk"), "bucket": group.column("bucket"), "seen": pa.array([packed(bits[i:j]) for i, j in zip(cut, cut[1:], strict=False)], pa.binary())})


def removed_mask(row: dict, buckets: int) -> tuple[Chunk, np.ndarray]:
    """Which bytes of a chunk go."""
    chunk = Chunk(row, buckets)
    diff = np.zeros(len(chunk.data) + 1, np.int32)
    repeated = repeated_suffixes(chunk, row["answers"], buckets)
    if len(repeated):
        _, low, number, at, start, end, doc, bucket = chunk.contexts(repeated)
        cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=U64))
        bits = np.zeros(len(low), np.uint32)
        for a in row["seen"] or ():
            bits[cut[a["bucket"]] : cut[a["bucket"] + 1]] = unpacked(a["seen"], np.uint32)
        later = chunk.ids[doc] > low[number]
        np.add.at(diff, start[later], 1)
        np.add.at(diff, end[later], -1)
        first, own = at[~later], bits[number[~later]]
        for o in range(LEFT + 1):
            hit = first[(own >> np.uint32(o)) & np.uint32(1) == 1] - o
            np.add.at(diff, hit, 1)
            np.add.at(diff, hit + SPAN, -1)
    return chunk, np.cumsum(diff[:-1]) > 0


def solved(docs: DataFrame, keep_columns: bool) -> tuple[DataFrame, int]:
    """Chunks with both kinds of answers, and the number of buckets."""
    table = chunk_table(docs, CHUNK_BYTES, keep_columns)
    n = table.count()
    buckets = 1 << max(6, (max(n, 1) // CHUNKS_A_BUCKET - 1).bit_length())
    small = table.select("chunk", "ids", "lens", "body")
    run, schema = ask_grams(buckets)
    grams = small.mapInArrow(run, schema).groupBy("bucket").applyInArrow(answer_grams, "chunk long, bucket int, bits binary")
    grams = cut_lineage(grams.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers")))
    run, schema = ask_contexts(buckets)
    seen = small.join(grams, "chunk", "left").mapInArrow(run, schema).groupBy("bucket").applyInArrow(answer_contexts, "chunk long, bucket int, seen binary")
    seen = seen.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "seen")).alias("seen"))
    return table.join(grams.join(seen, "chunk", "left"), "chunk", "left"), buckets


def passage_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of what is left of each document."""
    table, buckets = solved(docs, keep_columns=False)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def run(batches):
        for row in rows_of(batches):
            chunk, gone = removed_mask(row, buckets)
            rows = []
            for k, doc_id in enumerate(chunk.ids.tolist()):
                i, j = chunk.offsets[k], chunk.offsets[k + 1]
                g = gone[i:j]
                spans = int(g[:1].sum()) + int((g[1:] & ~g[:-1]).sum())
                rows.append((doc_id, int(j - i), int(g.sum()), spans, hashlib.sha256(chunk.data[i:j][~g].tobytes()).hexdigest()))
            if rows:
                yield record_batch(schema, zip(*rows, strict=True))

    return table.mapInArrow(run, schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with repeated passages cut from ``text``; ``n_chars`` follows if there is one.

    A character cut in two loses its other bytes as well.
    """
    table, buckets = solved(docs, keep_columns=True)
    names = docs.columns

    def run(batches):
        for row in rows_of(batches):
            chunk, gone = removed_mask(row, buckets)
            texts = [chunk.data[i:j][~gone[i:j]].tobytes().decode("utf-8", "ignore") for i, j in zip(chunk.offsets, chunk.offsets[1:], strict=False)]
            rest = chunk_rest(row)
            rest = rest.set_column(names.index("text"), "text", pa.array(texts, pa.string()))
            if "n_chars" in names:
                kind = rest.schema.field("n_chars").type
                rest = rest.set_column(names.index("n_chars"), "n_chars", pa.array([len(t) for t in texts]).cast(kind))
            yield from rest.to_batches(max_chunksize=1000)

    return table.mapInArrow(run, docs.schema)
