"""Document quality by a linear-chain conditional random field over lines (operator 4).

Every line is a position of a chain with the labels bad and good. Features of a
line are shape figures of itself, of the line before and of the line after;
transitions have weights of their own. The model is fitted on a bounded sample
of labelled documents whose lines carry their document's label. Scoring runs
forward-backward; the marginals of good, weighted by line length, average into
the document's evidence, which a two-parameter logistic turns into a probability.

Empty or null text: one empty line, scored like any other. Empty table: no
rows. No labelled rows: a flat model, every score is 0.5. A text of any length
is one chain. Repeated rows get the same score each.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopledger.llm.common import LOWER_CODE, SPACE, id_and_text, prefix_hashes, prepare, record_batch, span_hashes, text_bytes, words

#: Labelled documents that the model is fitted on, at most, and their lines.
TRAIN_DOCS, TRAIN_LINES = 4000, 60_000
FOLDS, HELD_OUT, GOOD_FROM = 4, 2, 0.7
ROUNDS, L2 = 300, 1e-3
BASIC = 16

_CLASS = np.zeros((256, 8), np.float32)
_CLASS[97:123, 0] = _CLASS[128:, 0] = 1  # letters, with those beyond ASCII
_CLASS[65:91, 1] = 1  # capitals
_CLASS[48:58, 2] = 1  # digits
_CLASS[SPACE, 3] = 1
_CLASS[[ord(c) for c in ".,;:'\"?-()"], 4] = 1  # marks of ordinary prose
_CLASS[[ord(c) for c in "|/\\_<>=[]{}"], 5] = 1  # tables, code
_CLASS[[ord(c) for c in "#$%&*+@^~`"], 6] = 1  # symbols
_CLASS[ord("!"), 7] = 1
_CODE = _CLASS.argmax(axis=1).astype(np.int64) + 8 * (_CLASS.sum(axis=1) == 0)


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x BASIC), byte lengths and first line of each document."""
    docs = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    owner = np.searchsorted(offsets, breaks, "right") - 1
    starts = np.concatenate([offsets[:-1], breaks + 1])
    ends = np.concatenate([breaks, offsets[1:]])
    line_doc = np.concatenate([np.arange(docs), owner])
    start_order, end_order = np.lexsort((starts, line_doc)), np.lexsort((ends, np.concatenate([owner, np.arange(docs)])))
    starts, ends, line_doc = starts[start_order], ends[end_order], line_doc[start_order]
    first = np.searchsorted(line_doc, np.arange(docs))
    n = len(starts)
    size = (ends - starts).astype(np.float64)

    codes = _CODE[data]
    share = np.empty((n, 9))
    for k in range(9):
        total = np.concatenate([[0], np.cumsum(codes == k)])
        share[:, k] = (total[ends] - total[starts]) / np.maximum(size, 1)

    w_start, w_end, w_doc = words(data, offsets)
    w_line = np.searchsorted(starts, w_start, "right") - 1
    # An empty line shares its start with the next document's first line.
    w_line = np.maximum(w_line, first[w_doc]) if len(w_doc) else w_line
    count = np.bincount(w_line, minlength=n)
    prefix = prefix_hashes(data, LOWER_CODE)
    h = span_hashes(prefix, w_start, w_end)
    # Distinct words of a line and of its document, by sorting (line, word) keys.
    order = np.lexsort((h, w_line))
    fresh = np.ones(len(order), bool)
    if len(order) > 1:
        a, b = order[1:], order[:-1]
        fresh[1:] = (w_line[a] != w_line[b]) | (h[a] != h[b])
    distinct = np.bincount(w_line[order][fresh], minlength=n)
    # Word end marks: the last byte is a symbol, a bang or a bar.
    tail = codes[w_end - 1] if len(w_end) else np.zeros(0, np.int64)
    marked = np.bincount(w_line[(tail == 6) | (tail == 7)], minlength=n) / np.maximum(count, 1)
    lone = np.bincount(w_line[(tail == 5) & (w_end - w_start == 1)], minlength=n) / np.maximum(count, 1)
    x = np.column_stack([
        share[:, :9], np.log1p(size) / 8, np.log1p(count) / 6, np.where(count > 0, distinct / np.maximum(count, 1), 1.0),
        marked, lone, np.minimum(size / np.maximum(count, 1) / 12, 2), np.ones(n),
    ])
    return x, size, first


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own features beside those of the lines before and after in the same document (zero at an end)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first] = 0
    after[np.append(first[1:], len(x)) - 1] = 0
    return np.hstack([x, before, after])


def forward_backward(e: np.ndarray, first: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginal of good for each line, log partition for each chain, and pair marginals of each line with the one before.

    ``e`` is the log-odds emission of good, ``t`` the 2 x 2 transition scores.
    Chains go side by side, longest first, one position at a time.
    """
    n = len(e)
    length = np.diff(np.append(first, n))
    order = np.argsort(-length, kind="stable")
    start, length = first[order], length[order]
    a, b = np.zeros((n, 2)), np.zeros((n, 2))
    em = np.column_stack([np.zeros(n), e])
    a[start] = em[start]
    longest = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(longest + 1), "left")  # chains longer than k
    for k in range(1, longest):
        at = start[: active[k]] + k
        p = a[at - 1]
        a[at] = em[at] + np.logaddexp(p[:, :1] + t[0], p[:, 1:] + t[1])
    for k in range(longest - 1, 0, -1):
        at = start[: active[k]] + k
        q = em[at] + b[at]
        b[at - 1] = np.logaddexp(t[:, 0] + q[:, :1], t[:, 1] + q[:, 1:])
    last = first + np.diff(np.append(first, n)) - 1
    z = np.logaddexp(a[last, 0], a[last, 1])
    zl = np.repeat(z, np.diff(np.append(first, n)))
    good = np.exp(np.minimum(a[:, 1] + b[:, 1] - zl, 0))
    pair = np.zeros((n, 2, 2))
    inner = np.ones(n, bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    pair[at] = np.exp(a[at - 1][:, :, None] + t[None] + (em[at] + b[at])[:, None, :] - zl[at][:, None, None])
    return good, z, pair


def fit(x: np.ndarray, first: np.ndarray, label: np.ndarray) -> dict:
    """Weights by maximum conditional likelihood (Adam on the exact gradient, classes weighed alike)."""
    if not len(label):
        return {"w": np.zeros(3 * BASIC), "t": np.zeros((2, 2)), "scale": np.zeros(2)}
    f = with_neighbours(x, first)
    lines = np.diff(np.append(first, len(x)))
    y = np.repeat(label, lines).astype(float)
    share = np.clip(label.mean(), 0.02, 0.98)
    per_doc = np.where(label == 1, 0.5 / share, 0.5 / (1 - share)) / lines
    weight = np.repeat(per_doc, lines) / per_doc.sum()
    pairs = np.ones(len(x), bool)
    pairs[first] = False
    seen = np.zeros((len(x), 2, 2))
    seen[pairs, y[pairs].astype(int), y[pairs].astype(int)] = 1
    w, t = np.zeros(f.shape[1]), np.zeros((2, 2))
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for k in range(1, ROUNDS + 1):
        good, _, pair = forward_backward(f @ w, first, t)
        g = np.concatenate([f.T @ (weight * (y - good)) - L2 * w, ((seen - pair) * weight[:, None, None]).sum(axis=0).ravel() - L2 * t.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
        w, t = w + step[:-4], t + step[-4:].reshape(2, 2)
    model = {"w": w, "t": t, "scale": np.array([1.0, 0.0])}
    if label.min() == label.max():
        model["scale"] = np.array([0.0, 3.0 if label[0] else -3.0])
        return model
    evidence = doc_evidence(model, x, np.zeros(0), first)
    a, b = 1.0, 0.0
    for _ in range(60):  # Newton steps of the two-parameter logistic
        p = 1 / (1 + np.exp(-(a * evidence + b)))
        r, s = label - p, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(s * evidence**2).sum() + 1e-3, (s * evidence).sum()], [(s * evidence).sum(), s.sum() + 1e-3]])
        d = np.linalg.solve(h, [(r * evidence).sum() - 1e-3 * a, r.sum()])
        a, b = a + np.clip(d[0], -1, 1), b + np.clip(d[1], -1, 1)
    model["scale"] = np.array([max(a, 1e-3), b])
    return model


def doc_evidence(model: dict, x: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log-odds of the length-weighted mean marginal of good, per document."""
    good, _, _ = forward_backward(with_neighbours(x, first) @ model["w"], first, model["t"])
    weight = np.maximum(size if len(size) else np.expm1(x[:, 9] * 8), 1.0)
    mean = np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first)
    mean = np.clip(mean, 1e-6, 1 - 1e-6)
    return np.log(mean / (1 - mean))


def scores(model: dict, column) -> np.ndarray:
    data, offsets = text_bytes(column)
    if len(offsets) == 1:
        return np.zeros(0)
    x, size, first = line_features(data, offsets)
    a, b = model["scale"]
    return 1 / (1 + np.exp(-np.clip(a * doc_evidence(model, x, size, first) + b, -50, 50)))


def train(docs: DataFrame, labels: DataFrame, docs_bound: int = TRAIN_DOCS, lines_bound: int = TRAIN_LINES) -> dict:
    """Fit on at most ``docs_bound`` labelled documents outside the held-out fold, in order of a hash of the id."""
    marks = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("label"))
    marks = marks.where(f"crc32(cast(doc_id AS string)) % {FOLDS} <> {HELD_OUT}")
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(docs_bound)

    def features(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.schema.get_field_index("text")))
            if len(offsets) == 1:
                continue
            x, _, first = line_features(data, offsets)
            ends = np.append(first[1:], len(x))
            yield record_batch("doc_id long, label int, x binary", (batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("label")), [x[i:j].astype(np.float32).tobytes() for i, j in zip(first, ends, strict=True)]))

    texts = id_and_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    parts, lines = [], 0
    rows = texts.mapInArrow(features, "doc_id long, label int, x binary").withColumn("n", F.octet_length("x"))
    # Whole documents in order of the hash until the lines are enough; longer ones than the bound allow are passed over.
    for row in rows.where(F.col("n") <= 4 * BASIC * (lines_bound // 20)).orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():
        x = np.frombuffer(row["x"], np.float32).reshape(-1, BASIC)
        if lines + len(x) > lines_bound:
            break
        parts.append((row["label"], x))
        lines += len(x)
    if not parts:
        return fit(np.zeros((0, BASIC)), np.zeros(0, int), np.zeros(0))
    sizes = np.array([len(x) for _, x in parts])
    return fit(np.vstack([x for _, x in parts]).astype(float), np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.array([y for y, _ in parts]))


def quality_scores(docs: DataFrame, labels: DataFrame, model: dict | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    prepare(docs.sparkSession)
    model = model or train(docs, labels)
    schema = "doc_id long, held_out boolean, score double, predicted int"

    def run(batches):
        for batch in batches:
            s = scores(model, batch.column(1))
            ids = batch.column(0).to_pylist()
            held = [zlib.crc32(str(i).encode()) % FOLDS == HELD_OUT for i in ids]
            yield record_batch(schema, (batch.column(0), held, s, (s >= GOOD_FROM).astype(np.int32)))

    return id_and_text(docs).mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, model: dict | None = None) -> DataFrame:
    """The rows of ``docs`` whose text scores as good, with all their columns."""
    prepare(docs.sparkSession)
    model = model or train(docs, labels)

    def run(batches):
        for batch in batches:
            yield batch.filter(record_batch("k boolean", (scores(model, batch.column(batch.schema.get_field_index("text"))) >= GOOD_FROM,)).column(0))

    return docs.mapInArrow(run, docs.schema)
