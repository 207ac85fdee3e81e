"""Queries of a shard searched together: same rows as full scores, equal scores by id, few documents scored in full."""

import numpy as np
import pyarrow as pa
import pytest

from shopledger.llm import topk


def shard_of(docs: int, terms: int, rng, copies: int = 0) -> tuple[topk.Shard, np.ndarray]:
    """A shard with frequent and rare terms, the last ``copies`` documents equal to the first, and its contributions."""
    tf = (rng.random((terms, docs)) < 1 / (1 + np.arange(terms))[:, None] ** 0.8) * rng.integers(1, 6, (terms, docs))
    tf[:, docs - copies :] = tf[:, :1]
    length = tf.sum(axis=0)
    term, doc = np.nonzero(tf)
    starts = np.searchsorted(term, np.arange(terms + 1))
    row = {"ids": np.arange(docs, dtype=np.int64).tobytes(), "length": topk.packed(length.astype(np.int64)), "terms": topk.packed(np.arange(terms, dtype=np.uint64)), "starts": topk.packed(starts.astype(np.uint32)), "docs": topk.packed(doc.astype(np.uint32)), "tfs": topk.packed(tf[term, doc].astype(np.uint32))}
    idf = np.log1p((docs - (tf > 0).sum(axis=1) + 0.5) / ((tf > 0).sum(axis=1) + 0.5))
    part = idf[:, None] * tf * (topk.K1 + 1) / (tf + topk.K1 * (1 - topk.B + topk.B * length / length.mean()))
    return topk.Shard(row, np.arange(terms, dtype=np.uint64), idf, length.mean()), part


def queries_of(shard: topk.Shard, part: np.ndarray, n: int) -> list[np.ndarray]:
    """The terms of the first documents, the common ones first, and a query without terms."""
    order = np.argsort(-(part > 0).sum(axis=1), kind="stable")
    return [order[part[order, d] > 0] for d in range(n - 1)] + [order[:0]]


@pytest.mark.parametrize("skipped", [0, topk.SKIPPED, 2])
def test_queries_of_a_group_find_what_full_scores_find(monkeypatch, skipped):
    monkeypatch.setattr(topk, "SKIPPED", skipped)
    rng = np.random.default_rng(11)
    for docs, copies in ((900, 0), (900, 400), (5, 2), (1, 0)):
        shard, part = shard_of(docs, 3000, rng, copies)
        asked = queries_of(shard, part, min(docs, 40) + 1)
        full = [part[q].sum(axis=0) for q in asked]
        bounds = np.concatenate([[0], np.cumsum([len(q) for q in asked])])
        for share in (0.0, 0.5, 0.9):
            least = np.array([np.quantile(f, share) if share else 0.0 for f in full])
            query, doc, score = shard.search_all(np.concatenate(asked), bounds, least)
            for i, f in enumerate(full):
                want = np.flatnonzero((f >= least[i] - 1e-6) & (f > 0))
                assert doc[query == i].tolist() == want.tolist() and np.allclose(score[query == i], f[want], atol=1e-9)
        best = topk.Best(len(asked), 10)
        for _ in range(2):  # the second time with the k-th best known
            query, doc, score = shard.search_all(np.concatenate(asked), bounds, best.least(0, len(asked)), 10)
            best = topk.Best(len(asked), 10)
            best.add(query, shard.ids[doc], score)
            for i, f in enumerate(full):
                want = [d for d in np.lexsort((np.arange(docs), -np.round(f, 9)))[:10] if f[d] > 0]
                assert best.doc[i, best.score[i] > -np.inf].tolist() == want


def test_few_documents_are_scored_in_full(monkeypatch):
    shard, part = shard_of(2000, 4000, np.random.default_rng(12))
    asked, scored, exact = queries_of(shard, part, 51)[:-1], [], topk.Shard.exact
    monkeypatch.setattr(topk.Shard, "exact", lambda self, rows, query, doc: scored.append(len(doc)) or exact(self, rows, query, doc))
    bounds = np.concatenate([[0], np.cumsum([len(q) for q in asked])])
    shard.search_all(np.concatenate(asked), bounds, np.zeros(len(asked)), 10)
    assert len(shard.table) and sum(scored) < 40 * len(asked)


def test_a_task_brings_each_term_once():
    terms = lambda *t: {"terms": topk.packed(np.array(t, np.uint64)), "starts": topk.packed(np.arange(len(t) + 1, dtype=np.uint32) * 2)}
    batches = [pa.RecordBatch.from_pylist([terms(3, 5, 9), terms(), terms(5)]), pa.RecordBatch.from_pylist([terms(1, 9)])]
    (got,) = topk.frequencies(iter(batches), np.array([3, 4, 5, 9], np.uint64))
    assert got.to_pydict() == {"term": [0, 2, 3], "df": [2, 4, 4]}
