"""Language-model scores by context-tree weighting over bytes (operator 6).

A text is its words in lower case with single spaces and a closing byte. Each
byte is eight binary decisions; each decision has a context tree over the bytes
before, to depth ``DEPTH``. A node's Krichevsky-Trofimov estimate and the product
of its children's weighted probabilities are mixed half and half, from the leaves
up, on the counts of all training texts. A prediction mixes the estimates of all
depths along the path with the posterior weights; where a context was not seen,
the path ends at the last one that was, which leaves every prediction normalised.

Chunks ask with their different grams (context and byte) and words, dealt by the
two nearest context bytes or by word; a bucket merges the counts of all chunks,
builds its subtrees and answers every chunk, question by question. Only the nodes
of depth 0 and 1, at most 257 * 255, pass through the driver. A word or gram that
is everywhere brings one entry for each chunk.

Null or empty text: the closing byte alone. Empty table: no rows. No training
rows: every bit costs one half. Repeated rows are counted and scored each. Texts
of any length are scored whole.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopledger.llm.common import LOWER_CODE, U64, chunk_parts, chunk_table, cut_lineage, mixed, packed, prefix_hashes, record_batch, rows_of, span_hashes, unpacked, words

DEPTH, END = 5, 11
FOLDS, HELD_OUT = 5, 1
CHUNK_BYTES, PART_BYTES, BATCH_BYTES = 24 << 20, 128 << 10, 8 << 20
LN2 = math.log(2)


def held_out(ids: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(str(i).encode()) % FOLDS == HELD_OUT for i in ids.tolist()], bool)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for positive numbers: eight steps up, then Stirling's series."""
    x = np.asarray(x, float)
    low = np.zeros_like(x)
    for k in range(8):
        low += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - math.log(math.pi) - log_gamma(n0 + n1 + 1.0)


def parts(row: dict):
    """A chunk's documents in parts of about PART_BYTES."""
    ids, offsets, data = chunk_parts(row)
    i = 0
    while i < len(ids):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PART_BYTES, "right")) - 1)
        yield Text(ids[i:j], offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]])
        i = j


class Text:
    """Documents as a byte stream with DEPTH closing bytes before each; their grams and words."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, data: np.ndarray):
        self.ids = ids
        start, end, doc = words(data, offsets)
        self.word = span_hashes(prefix_hashes(data, LOWER_CODE), start, end)
        self.word_doc = doc
        docs = len(self.ids)
        count = np.bincount(doc, minlength=docs)
        # Empty documents get an empty word, so that each word brings its closing byte.
        empty = np.flatnonzero(count == 0)
        start, end, doc = (np.concatenate([a, b]) for a, b in ((start, offsets[empty]), (end, offsets[empty]), (doc, empty)))
        order = np.argsort(doc, kind="stable")
        start, end, doc = start[order], end[order], doc[order]
        size = end - start + 1
        first = np.ones(len(doc), bool)
        first[1:] = doc[1:] != doc[:-1]
        last = np.append(first[1:], True)[: len(doc)]
        at = np.cumsum(size + DEPTH * first) - size
        stream = np.full(int(size.sum()) + DEPTH * int(first.sum()), END, np.uint8)
        length = end - start
        inside = np.repeat(at - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(int(length.sum()))
        source = data[np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(int(length.sum()))]
        stream[inside] = source + 32 * ((source >= 65) & (source <= 90)).astype(np.uint8)
        stream[(at + length)[~last]] = 32
        self.begin = (at - DEPTH)[first]
        scored = np.ones(len(stream), bool)
        for k in range(DEPTH):
            scored[self.begin + k] = False
        where = np.flatnonzero(scored)
        self.bounds = np.searchsorted(where, self.begin)
        code = np.zeros(len(where), U64)
        for k in range(1, DEPTH + 1):  # nearest byte first
            code = (code << U64(8)) | stream[where - k]
        self.code = (code << U64(8)) | stream[where]
        self.train = ~held_out(self.ids)
        self.sizes = np.diff(np.append(self.bounds, len(where)))

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Different grams and their training counts."""
        return added(self.code, np.repeat(self.train, self.sizes).astype(np.int64))

    def terms(self) -> tuple[np.ndarray, np.ndarray]:
        """The same for words."""
        return added(self.word, self.train[self.word_doc].astype(np.int64))


def in_runs(name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by name, the names in it, and where each different one begins."""
    order = np.argsort(name)
    name = name[order]
    first = np.ones(len(name), bool)
    first[1:] = name[1:] != name[:-1]
    return order, name, first


def added(name: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different names with summed counts."""
    order, name, first = in_runs(name)
    at = np.flatnonzero(first)
    return name[at], np.add.reduceat(count[order], at) if len(at) else count[:0]


def different(name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different names in order, and which of them stands at each place."""
    order, name, first = in_runs(name)
    number = np.empty(len(name), np.int32)
    number[order] = np.cumsum(first, dtype=np.int32) - 1
    return name[first], number


def dealt(name: np.ndarray, key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by bucket, then by name, and the bucket bounds."""
    bucket = (key % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def gram_key(code: np.ndarray) -> np.ndarray:
    """By the two nearest context bytes."""
    return mixed(code >> U64(8 * (DEPTH - 1)))


class Tally:
    """Different names with summed counts; those of new parts are added up once as many wait as are known."""

    def __init__(self):
        self.held, self.waiting = [(np.zeros(0, U64), np.zeros(0, np.int64))], 0

    def add(self, name: np.ndarray, count: np.ndarray) -> None:
        self.held.append((name, count))
        self.waiting += len(name)
        if self.waiting > len(self.held[0][0]):
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.held) > 1:
            self.held, self.waiting = [added(*(np.concatenate(c) for c in zip(*self.held, strict=True)))], 0
        return self.held[0]


def questions(row: dict):
    """A chunk's different grams and words with training counts, each in order of the name."""
    grams, terms = Tally(), Tally()
    for t in parts(row):
        grams.add(*t.grams())
        terms.add(*t.terms())
    return *grams.total(), *terms.total()


ASK = "bucket int, chunk long, codes binary, counts binary, terms binary, uses binary"


def ask(buckets: int):
    def run(batches):
        for row in rows_of(batches):
            code, count, term, use = questions(row)
            order, cut = dealt(code, gram_key(code), buckets)
            code, count = code[order], count[order]
            order, edge = dealt(term, term, buckets)
            term, use = term[order], use[order]
            rows = []
            for b in range(buckets):
                i, j, k, m = cut[b], cut[b + 1], edge[b], edge[b + 1]
                if j > i or m > k:
                    rows.append((b, row["chunk"], packed(np.diff(code[i:j], prepend=U64(0))), packed(count[i:j].astype(np.uint32)), term[k:m].tobytes(), packed(use[k:m].astype(np.uint32))))
            if rows:
                yield record_batch(ASK, zip(*rows, strict=True))

    return run


def merged(group) -> tuple:
    """All chunks' grams and words of a bucket with summed counts, and where each chunk's stand."""
    codes = [np.cumsum(unpacked(c, U64), dtype=U64) for c in group.column("codes").to_pylist()]
    counts = [unpacked(c, np.uint32) for c in group.column("counts").to_pylist()]
    terms = [np.frombuffer(t, U64) for t in group.column("terms").to_pylist()]
    uses = [unpacked(u, np.uint32) for u in group.column("uses").to_pylist()]
    code, at = np.unique(np.concatenate(codes), return_inverse=True)
    term, where = np.unique(np.concatenate(terms), return_inverse=True)
    count = np.bincount(at, weights=np.concatenate(counts), minlength=len(code))
    use = np.bincount(where, weights=np.concatenate(uses), minlength=len(term))
    return code, count, at, [len(c) for c in codes], use, where, [len(t) for t in terms]


class Tree:
    """Nodes of depth ``top`` to DEPTH over sorted grams with counts."""

    def __init__(self, code: np.ndarray, count: np.ndarray, top: int):
        self.top = top
        self.symbol = (code & U64(255)).astype(np.int64)
        self.level = {}  # depth -> (n0, n1, log weighted, log kt) by bit, and each gram's node
        for d in range(DEPTH, top - 1, -1):
            pair = ((code >> U64(8 * (DEPTH + 1 - d))) << U64(8)) | (code & U64(255))
            rows = []
            for k in range(8):
                node, number = np.unique(pair >> U64(8 - k), return_inverse=True)
                one = (self.symbol >> (7 - k)) & 1
                n1 = np.bincount(number, weights=count * one, minlength=len(node))
                n0 = np.bincount(number, weights=count * (1 - one), minlength=len(node))
                kt = log_kt(n0, n1)
                weighted = kt
                if d < DEPTH:
                    child, child_of = self.level[d + 1][k], self.level[d + 1][k][4]
                    parent = np.zeros(len(child[0]), np.int64)
                    parent[child_of] = number
                    weighted = np.logaddexp(kt, np.bincount(parent, weights=child[2], minlength=len(node))) - LN2
                rows.append((n0, n1, weighted, kt, number, node))
            self.level[d] = rows

    def ones(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Probability of a one at bit k from the nodes here, for each gram, and whether the top node was seen."""
        p = seen = None
        for d in range(DEPTH, self.top - 1, -1):
            n0, n1, weighted, kt, number, _ = self.level[d][k]
            own = ((n1 + 0.5) / (n0 + n1 + 1))[number]
            stop = np.exp(np.minimum(kt - LN2 - weighted, 0))[number] if d < DEPTH else np.ones(len(number))
            p = own if p is None else np.where(seen, stop * own + (1 - stop) * p, own)
            seen = (n0 + n1)[number] > 0
        return p, seen


TOP = "c1 int, z int, n0 double, n1 double, logp double"


def subtree_sums(group):
    """Counts and weighted probabilities of the depth-2 nodes of a bucket, added up by nearest byte; words used and different."""
    code, count, _, _, use, _, _ = merged(group)
    tree = Tree(code, count, 2)
    rows = [(-1, 0, float(use.sum()), float((use > 0).sum()), float(count[tree.symbol == END].sum()))]
    for k in range(8):
        n0, n1, weighted, _, _, node = tree.level[2][k]
        c1, z = (node >> U64(8 + k)).astype(np.int64), (node & U64((1 << k) - 1)).astype(np.int64) | 1 << k
        name, number = np.unique(c1 << 8 | z, return_inverse=True)
        a, b, w = (np.bincount(number, weights=x, minlength=len(name)) for x in (n0, n1, weighted))
        rows.extend(zip((name >> 8).tolist(), (name & 255).tolist(), a.tolist(), b.tolist(), w.tolist(), strict=True))
    kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["c1", "z", "n0", "n1", "logp"])


def top_nodes(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stop weight, probability of one and count of the nodes of depth 0 (row 256) and 1."""
    n0, n1, w2 = (np.zeros((257, 256)) for _ in range(3))
    for r in rows:
        if r["c1"] >= 0:
            n0[r["c1"], r["z"]], n1[r["c1"], r["z"]], w2[r["c1"], r["z"]] = r["n0"], r["n1"], r["logp"]
    kt = log_kt(n0, n1)
    weighted = np.logaddexp(kt, w2) - LN2
    n0[256], n1[256] = n0[:256].sum(axis=0), n1[:256].sum(axis=0)
    kt[256] = log_kt(n0[256], n1[256])
    weighted[256] = np.logaddexp(kt[256], weighted[:256].sum(axis=0)) - LN2
    return np.exp(np.minimum(kt - LN2 - weighted, 0)), (n1 + 0.5) / (n0 + n1 + 1), n0 + n1


def answer(stop: np.ndarray, one: np.ndarray, seen_top: np.ndarray):
    def run(group):
        code, count, at, sizes, use, where, term_sizes = merged(group)
        tree = Tree(code, count, 2)
        c1, logp = (code >> U64(8 * DEPTH)).astype(np.int64), np.zeros(len(code))
        for k in range(8):
            p, seen = tree.ones(k)
            z = tree.symbol >> (8 - k) | 1 << k
            for row in (c1, np.full(len(c1), 256)):
                p = np.where(seen, stop[row, z] * one[row, z] + (1 - stop[row, z]) * p, one[row, z])
                seen = seen_top[row, z] > 0
            bit = tree.symbol >> (7 - k) & 1
            logp += np.log10(np.where(bit == 1, p, 1 - p))
        cut, edge = np.cumsum([0, *sizes]), np.cumsum([0, *term_sizes])
        every, uses = logp[at].astype(np.float32), use[where].astype(np.int64)
        return pa.table({
            "chunk": group.column("chunk"), "codes": group.column("codes"), "terms": group.column("terms"),
            "logp": pa.array([every[i:j].tobytes() for i, j in zip(cut, cut[1:], strict=False)], pa.binary()),
            "uses": pa.array([packed(uses[i:j]) for i, j in zip(edge, edge[1:], strict=False)], pa.binary()),
        })

    return run


def in_order(names: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Names of all buckets in order, and their values; a name is in one bucket only."""
    name, value = np.concatenate(names), np.concatenate(values)
    order = np.argsort(name)
    return name[order], value[order]


def model_scores(docs: DataFrame, buckets: int = 64) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and code length in bits a byte."""
    table = chunk_table(docs, chunk_bytes=CHUNK_BYTES).select("chunk", "ids", "lens", "body")
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))  # a chunk and its answers at a time
    asked = cut_lineage(table.mapInArrow(ask(buckets), ASK))
    rows = asked.groupBy("bucket").applyInArrow(subtree_sums, TOP).groupBy("c1", "z").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "logp"))).collect()
    stop, one, seen = top_nodes(rows)
    total = next((r for r in rows if r["c1"] < 0), None)
    ends = int(total["logp"]) if total else 0
    n, v = (int(total["n0"]) + ends, int(total["n1"]) + (ends > 0)) if total else (0, 0)
    answers = asked.groupBy("bucket").applyInArrow(answer(stop, one, seen), "chunk long, codes binary, terms binary, logp binary, uses binary")
    answers = answers.groupBy("chunk").agg(F.collect_list(F.struct("codes", "terms", "logp", "uses")).alias("answers"))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"

    def run(batches):
        for row in rows_of(batches):
            answers = row.pop("answers")
            code, logp = in_order([np.cumsum(unpacked(a["codes"], U64), dtype=U64) for a in answers], [np.frombuffer(a["logp"], np.float32).astype(float) for a in answers])
            term, use = in_order([np.frombuffer(a["terms"], U64) for a in answers], [unpacked(a["uses"], np.int64) for a in answers])
            del answers
            for text in parts(row):
                docs = len(text.ids)
                own, number = different(text.code)
                score = np.add.reduceat(logp[np.searchsorted(code, own)][number], text.bounds)
                own, number = different(text.word)
                uses, divisor = use[np.searchsorted(term, own)][number], n + 0.5 * (v + 1)
                count = np.bincount(text.word_doc, minlength=docs)
                known = np.bincount(text.word_doc, weights=uses > 0, minlength=docs).astype(np.int64) + (ends > 0)
                base = np.bincount(text.word_doc, weights=np.log10((uses + 0.5) / divisor), minlength=docs) + math.log10((ends + 0.5) / divisor)
                yield record_batch(schema, (text.ids, ~text.train, count + 1, known, np.full(docs, n), base, score, -score / math.log10(2) / text.sizes))

    return table.join(answers, "chunk").mapInArrow(run, schema)
