"""Exact top-k search by BM25 over an inverted index with block-max MaxScore pruning, term at a time (operator 1).

Not the cursors and pivots of WAND: queries are whole documents with hundreds of
terms, for which whole posting lists as arrays are the shorter way; README says so.

The index is a table of shards, each the postings of some documents in order of
term and document. Scores use global statistics: document count, mean length and
document frequencies over all shards. A shard keeps, for every term and block of
documents, the largest contribution. Queries are searched in groups: each drops
the blocks whose summed maxima cannot reach its k-th best score so far. In the
others the terms are added that are needed to reach it; those spared stay
together under a share of that score. Frequent terms are a table of the shard,
multiplied with all queries of a group in single precision, and count with the
bound of its rounding; the postings of the rest are added. Only documents that
can reach the k-th best score with the maxima of the spared terms are scored in
full, from their own list of terms. A task carries the best lists from shard to
shard; the lists of all tasks are merged exactly.

Queries are taken in blocks of bounded size, one pass over the index for each.
A query is its distinct words. Scores are rounded to nine digits; ties go to the
smaller id. A null or empty text matches nothing and, as a query, gives no rows.
Repeated rows are hits of their own. Empty table: no rows. Texts of any length
are indexed whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopledger.llm.common import LOWER_CODE, U64, chunk_parts, chunk_table, cut_lineage, id_and_text, packed, prefix_hashes, record_batch, rows_of, span_hashes, text_bytes, unpacked, words

K1, B = 1.2, 0.75
#: Documents of a block, at least; blocks of a shard, at most.
BLOCK, MOST_BLOCKS = 128, 64
#: Queries searched together, cells (query, document) and postings of one step, and cells of the table of frequent terms.
QUERIES, CELLS, TABLE_CELLS = 128, 1 << 19, 1 << 23
#: A term that this share of a shard's documents has is frequent; rare terms are spared up to this share of the k-th best score.
FREQUENT, SPARE = 0.04, 0.01
#: Postings of blocks that cannot reach the k-th best are skipped one by one where under this share of the blocks is left.
SKIPPED = 0.4
#: A query that one in so many documents of a shard may answer is scored by its postings.
OFTEN = 16
SHARD_BYTES = 8 << 20
QUERY_BYTES = 16 << 20
INDEX = "chunk long, ids binary, length binary, n_words long, n_docs long, terms binary, starts binary, docs binary, tfs binary"


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row for each shard, written once."""

    def run(batches):
        for row in rows_of(batches):
            ids, offsets, data = chunk_parts(row)
            start, end, doc = words(data, offsets)
            h = span_hashes(prefix_hashes(data, LOWER_CODE), start, end)
            terms, number = np.unique(h, return_inverse=True)
            pair, tf = np.unique(number * len(ids) + doc, return_counts=True)
            starts = np.searchsorted(pair, np.arange(len(terms) + 1) * len(ids))
            length = np.bincount(doc, minlength=len(ids)).astype(np.int64)
            yield record_batch(INDEX, ([row["chunk"]], [row["ids"]], [packed(length)], [int(length.sum())], [len(ids)], [packed(terms)], [packed(starts.astype(np.uint32))], [packed((pair % max(len(ids), 1)).astype(np.uint32))], [packed(tf.astype(np.uint32))]))

    table = chunk_table(docs, chunk_bytes=shard_bytes)
    return cut_lineage(table.mapInArrow(run, INDEX))


def query_blocks(queries: DataFrame, block_bytes: int = QUERY_BYTES):
    """Lists of (query id, sorted distinct word hashes) from at most ``block_bytes`` of text, or one longer query."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            start, end, doc = words(data, offsets)
            h = span_hashes(prefix_hashes(data, LOWER_CODE), start, end)
            cut = np.searchsorted(doc, np.arange(len(offsets)))
            yield record_batch("query long, terms binary", (batch.column(0), [np.unique(h[i:j]).tobytes() for i, j in zip(cut, cut[1:], strict=False)]))

    block, size = [], 0
    for row in id_and_text(queries).mapInArrow(run, "query long, terms binary").where("octet_length(terms) > 0").toLocalIterator():
        if block and size + len(row["terms"]) > block_bytes:
            yield block
            block, size = [], 0
        block.append((row["query"], np.frombuffer(row["terms"], U64)))
        size += len(row["terms"])
    if block:
        yield block


class Shard:
    """The postings of a shard for a sorted vocabulary, with contributions, their maxima by block and a table of frequent terms."""

    def __init__(self, row: dict, vocabulary: np.ndarray, idf: np.ndarray, mean: float):
        self.ids = np.frombuffer(row["ids"], np.int64)
        docs = len(self.ids)
        length, terms, starts = unpacked(row["length"], np.int64), unpacked(row["terms"], U64), unpacked(row["starts"], np.uint32).astype(np.int64)
        at = np.searchsorted(vocabulary, terms)
        at[at == len(vocabulary)] = 0
        here = np.flatnonzero(vocabulary[at] == terms) if len(vocabulary) else np.zeros(0, np.int64)
        self.row_of = np.full(len(vocabulary), -1, np.int32)
        self.row_of[at[here]] = np.arange(len(here))
        first, self.count = starts[here], np.diff(starts)[here]
        self.starts = np.concatenate([[0], np.cumsum(self.count)])
        take = np.repeat(first - self.starts[:-1], self.count) + np.arange(self.starts[-1])
        self.doc = unpacked(row["docs"], np.uint32)[take].astype(np.int32)
        tf = unpacked(row["tfs"], np.uint32)[take].astype(float)
        self.part = np.repeat(idf[at[here]], self.count) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[self.doc] / mean))
        self.short = self.part.astype(np.float32)  # for sums that need not be exact
        self.size = max(BLOCK, -(-docs // MOST_BLOCKS))
        self.blocks = -(-docs // self.size)
        term = np.repeat(np.arange(len(here), dtype=np.int32), self.count)
        edge = np.flatnonzero(np.diff(term.astype(np.int64) * self.blocks + self.doc // self.size, prepend=-1))
        self.top = np.zeros((len(here), self.blocks), np.float32)
        if len(edge):
            # Rounded up, so that the bound holds.
            self.top[term[edge], self.doc[edge] // self.size] = np.nextafter(np.maximum.reduceat(self.part, edge).astype(np.float32), np.float32(np.inf))
        self.most = self.top.max(axis=1, initial=0).astype(float)
        # Frequent terms as a table, for which a product is shorter than their postings.
        often = np.flatnonzero(self.count >= FREQUENT * docs)
        often = often[np.argsort(-self.count[often], kind="stable")[: TABLE_CELLS // max(docs, 1)]]
        self.column = np.full(len(here), -1, np.int32)
        self.column[often] = np.arange(len(often))
        self.table = np.zeros((len(often), docs), np.float32)
        inside = np.flatnonzero(self.column[term] >= 0)
        self.table[self.column[term[inside]], self.doc[inside]] = self.part[inside]
        by_doc = np.argsort(self.doc.astype(np.uint16) if docs <= 1 << 16 else self.doc, kind="stable")
        self.doc_term, self.doc_part = term[by_doc], self.part[by_doc]
        self.doc_starts = np.concatenate([[0], np.cumsum(np.bincount(self.doc, minlength=docs))])

    def exact(self, rows: list[np.ndarray], query: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Scores of (query, document), both sorted, added in order of terms; ``rows`` are those of each query."""
        score = np.zeros(len(doc))
        cut = np.searchsorted(query, np.arange(len(rows) + 1))
        often = np.diff(cut) * OFTEN > len(self.ids)  # most documents: the postings once are shorter
        for i in np.flatnonzero(often):
            at = positions(self.starts, np.sort(rows[i]))
            score[cut[i] : cut[i + 1]] = np.bincount(self.doc[at], weights=self.part[at], minlength=len(self.ids))[doc[cut[i] : cut[i + 1]]]
        left = np.flatnonzero(~often[query])
        asked = np.zeros((len(rows), len(self.count)), bool)
        for i in np.unique(query[left]):
            asked[i, rows[i]] = True
        size = np.cumsum(self.doc_starts[doc[left] + 1] - self.doc_starts[doc[left]])
        i = 0
        while i < len(left):
            j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + CELLS, "right")))
            some = left[i:j]
            at, count = positions(self.doc_starts, doc[some]), self.doc_starts[doc[some] + 1] - self.doc_starts[doc[some]]
            ok = np.flatnonzero(asked.ravel()[np.repeat(query[some] * len(self.count), count) + self.doc_term[at]])
            score[some] = np.bincount(np.repeat(np.arange(j - i), count)[ok], weights=self.doc_part[at[ok]], minlength=j - i)
            i = j
        return score

    def search_all(self, terms: np.ndarray, bounds: np.ndarray, least: np.ndarray, k: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, document and score where the score reaches the query's ``least``.

        Query i has the terms bounds[i] to bounds[i + 1], the common ones first.
        With ``k``, documents that k others of the shard surely beat may be left out.
        """
        docs, n = len(self.ids), len(least)
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        row, query, least = self.row_of[terms], np.repeat(np.arange(n), np.diff(bounds)), least - 1e-6
        row, query = row[row >= 0], query[row >= 0]
        if not len(row):
            return none
        slack = (int(np.diff(bounds).max()) + 2) * 2.0**-23  # sums in single precision are off by less than this share, in any order
        alive = summed(self.top[row], query, n) * (1 + slack) >= least[:, None]
        alive[np.bincount(query, minlength=n) == 0] = False
        ok = alive.any(axis=1)[query]
        row, query = row[ok], query[ok]
        if not len(row):
            return none
        column = self.column[row]
        rare = column < 0
        asked = np.zeros((n, len(self.table)), np.float32)
        asked[query[~rare], column[~rare]] = 1
        # Rare terms that together stay under a share of the k-th best are spared.
        most = np.cumsum(np.where(rare, self.most[row], 0.0))
        before = np.concatenate([[0.0], most])[np.searchsorted(query, np.arange(n))]
        spare = rare & (most - before[query] < SPARE * least[query])
        rest = summed(self.top[row[spare]], query[spare], n) * (1 + slack)
        needed = np.flatnonzero(rare & ~spare)
        at = positions(self.starts, row[needed])
        which, doc = np.repeat(query[needed], self.count[row[needed]]), self.doc[at]
        if alive.mean() < SKIPPED * np.count_nonzero(alive.any(axis=1)) / n:
            ok = np.flatnonzero(alive[which, doc // self.size])
            at, which, doc = at[ok], which[ok], doc[ok]
        cell = which * docs
        cell += doc
        score = np.bincount(cell, weights=self.short[at], minlength=n * docs).reshape(n, docs) + asked @ self.table

        def reached():
            floor = np.maximum(np.where(alive, (least * (1 - slack))[:, None] - rest, np.inf), 1e-300)
            return np.divmod(np.flatnonzero(score >= np.repeat(floor, self.size, axis=1)[:, :docs]), docs)

        query_of, doc = reached()
        if k:
            many = np.flatnonzero(np.bincount(query_of, minlength=n) > 2 * k)
            if len(many):
                kth = np.partition(score[many], docs - k, axis=1)[:, docs - k] * (1 - slack) - 1e-6
                least[many] = np.maximum(least[many], kth)
                query_of, doc = reached()
        cut = np.searchsorted(query, np.arange(n + 1))
        exact = self.exact([row[i:j] for i, j in zip(cut, cut[1:], strict=False)], query_of, doc)
        ok = exact >= least[query_of]
        return query_of[ok], doc[ok], exact[ok]

    def search(self, terms: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Documents whose score reaches ``least``, and their scores."""
        _, found, score = self.search_all(terms, np.array([0, len(terms)]), np.array([float(least)]))
        return found, score


def positions(starts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """starts[r] to starts[r + 1] for each r of ``rows``, one after another."""
    first, count = starts[rows], starts[rows + 1] - starts[rows]
    at = np.repeat(first - (np.cumsum(count) - count), count)
    at += np.arange(len(at))
    return at


def summed(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Column sums of the rows of each of ``n`` sorted groups."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(group):
        edge = np.flatnonzero(np.diff(group, prepend=-1))
        out[group[edge]] = np.add.reduceat(values, edge, axis=0)
    return out


class Best:
    """The k best documents so far of each of ``n`` queries."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.doc = k, np.full((n, k), -np.inf), np.zeros((n, k), np.int64)

    def least(self, i: int, j: int) -> np.ndarray:
        return np.maximum(self.score[i:j, -1], 0.0)

    def add(self, query: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        own = np.unique(query)
        query = np.concatenate([np.repeat(own, self.k), query])
        score, doc = np.concatenate([self.score[own].ravel(), np.round(score, 9)]), np.concatenate([self.doc[own].ravel(), doc])
        order = np.lexsort((doc, -score, query))
        first = np.searchsorted(query[order], own)
        taken = order[first[:, None] + np.arange(self.k)]
        self.score[own], self.doc[own] = score[taken], doc[taken]


def frequencies(batches, vocabulary: np.ndarray):
    """Number of each term of the vocabulary that the shards have, and of its documents in all of them."""
    df = np.zeros(len(vocabulary), np.int64)
    for row in rows_of(batches):
        terms, starts = unpacked(row["terms"], U64), unpacked(row["starts"], np.uint32).astype(np.int64)
        at = np.searchsorted(vocabulary, terms)
        at[at == len(vocabulary)] = 0
        here = np.flatnonzero(vocabulary[at] == terms)
        df[at[here]] += np.diff(starts)[here]
    at = np.flatnonzero(df)
    if len(at):
        yield record_batch("term long, df long", (at, df[at]))


def block_search(index: DataFrame, block: list, k: int) -> DataFrame:
    """Best lists of every task for a block of queries: (query, doc_id, score)."""
    vocabulary = np.unique(np.concatenate([t for _, t in block]))

    tasks = max(2 * index.sparkSession.sparkContext.defaultParallelism, 8)
    stats = index.agg(F.sum("n_docs"), F.sum("n_words")).first()
    n, mean = stats[0] or 0, (stats[1] or 0) / max(stats[0] or 0, 1) or 1.0
    df = np.zeros(len(vocabulary))
    counted = index.select("terms", "starts").coalesce(tasks).mapInArrow(lambda batches: frequencies(batches, vocabulary), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df[counted.column("term").to_numpy()] = counted.column("df").to_numpy()
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    ids = np.array([q for q, _ in block], np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(t) for _, t in block])])
    asked = np.concatenate([np.searchsorted(vocabulary, t).astype(np.int32) for _, t in block])
    asked = asked[np.lexsort((asked, idf[asked], np.repeat(np.arange(len(ids)), np.diff(bounds))))]  # of each query, the common ones first

    def run(batches):
        best = Best(len(ids), k)
        for row in rows_of(batches):
            shard = Shard(row, vocabulary, idf, mean)
            step = max(1, min(QUERIES, CELLS // max(len(shard.ids), 1)))
            for i in range(0, len(ids), step):
                j = min(i + step, len(ids))
                query, doc, score = shard.search_all(asked[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], best.least(i, j), k)
                if len(query):
                    best.add(query + i, shard.ids[doc], score)
        query, place = np.nonzero(best.score > -np.inf)
        if len(query):
            yield record_batch("query long, doc_id long, score double", (ids[query], best.doc[query, place], best.score[query, place]))

    return index.coalesce(tasks).mapInArrow(run, "query long, doc_id long, score double")


def top_k(queries: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, doc_id, score: the k best documents for every query."""
    index = build_index(docs)
    found = [cut_lineage(block_search(index, block, k)) for block in query_blocks(queries)]
    if not found:
        return docs.sparkSession.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id"))
    return out.withColumn("rank", place).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", "doc_id", "score")
