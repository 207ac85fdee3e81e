"""Alignment of two tokenizers over the same bytes (operator 12).

Each text is tokenized twice: A is a byte-level vocabulary, which is given a
space before the text, B a piece vocabulary, which adds that space itself. Both
spell the same bytes, so tokens are rows of sparse matrices built by hand in
compressed-row form:

* token-by-byte incidences; the row products of A and B-transposed are the
  overlap links, with the number of shared bytes as value;
* a byte offset where both end cuts the bytes into groups; the row products of
  the (id, document)-by-group incidences of A and B-transposed are the
  shared-group links of each pair of ids, with the number of linked occurrences.

Products are taken row by row (Gustavson): the rows of the right matrix that a
left row names are laid out and summed by column, a bounded number of entries at
a time; one group with many tokens never becomes a list of all its occurrence
pairs.

Corpus counts: a document counts once for a pair of ids. Chunks of documents
are written once to the shared folder with their pairs, so every pair goes
into the shuffle once for a chunk, whatever the documents there. Counted pairs
are packed by key range into buckets whose number follows the number of
pairs; a chunk's question and the bucket's answer meet in a join on the bucket,
and answers keep the order of the question. The pairs are those of two
vocabularies, so their number levels off while the corpus grows.

Texts that are null or empty, or that A or B cannot spell byte by byte, have no
tokens: zeros and an empty digest column. Rows without doc_id are left out;
repeated rows count as documents each; an empty table gives no rows; other
columns are not read. Memory is bounded by a chunk of about 4 MB or one longer
text.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopledger.llm import tokens
from shopledger.llm.common import cut_lineage, id_and_text, packed, record_batch, rows_of, text_parts, unpacked

BYTES_FILE, BYTES_RANKS, PIECES_FILE = tokens.TOKENIZER, tokens.RANKS, "piece_bpe_32k.model"
ENTRIES_AT_ONCE = 1 << 21
PAIRS_A_BUCKET = 1 << 20
ID_BITS = 32
#: What follows an id in a group's line: another of its side, the other side, the next group.
SIGNS = ",|;"


class Rows:
    """A sparse matrix by rows: where each row begins, the columns, the values."""

    def __init__(self, begin: np.ndarray, column: np.ndarray, value: np.ndarray):
        self.begin, self.column, self.value = begin, column, value

    @staticmethod
    def of(row: np.ndarray, column: np.ndarray, value: np.ndarray, rows: int) -> Rows:
        """From entries in the order of their rows."""
        return Rows(np.searchsorted(row, np.arange(rows + 1)), column, value)

    def __len__(self) -> int:
        return len(self.begin) - 1

    def product(self, right: Rows):
        """Entries (row, column, value) of self times right by row, some rows at a time; columns ascend within a row."""
        fan = right.begin[1:] - right.begin[:-1]
        work = np.concatenate([[0], np.cumsum(fan[self.column])])[self.begin]
        i = 0
        while i < len(self):
            j = max(i + 1, int(np.searchsorted(work, work[i] + ENTRIES_AT_ONCE, "right")) - 1)
            yield self._rows(right, fan, i, j)
            i = j

    def _rows(self, right: Rows, fan: np.ndarray, i: int, j: int):
        lo, hi = self.begin[i], self.begin[j]
        middle, value = self.column[lo:hi], self.value[lo:hi]
        row = np.repeat(np.arange(i, j), np.diff(self.begin[i : j + 1]))
        each = fan[middle]
        total = int(each.sum())
        at = np.repeat(right.begin[middle] - (np.cumsum(each) - each), each) + np.arange(total)
        row, column, value = np.repeat(row, each), right.column[at], np.repeat(value, each) * right.value[at]
        if not total:
            return row, column, value
        width = int(column.max()) + 1
        key = (row - i) * width + column
        if not (key[1:] >= key[:-1]).all():
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        return key[first] // width + i, key[first] % width, np.add.reduceat(value, first)


class Vocabularies:
    """Both tokenizers and the byte length and bytes of each of their ids."""

    def __init__(self, bytes_file: str, bytes_ranks: str | None, pieces_file: str):
        import public_tokenizers
        import sentencepiece

        self.a = tokens.Encoder(bytes_file, bytes_ranks)
        self.a.tokenizer.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces_file))
        self.a_bytes = Spelling(byte_level(self.a.tokenizer))
        self.b_bytes = Spelling(piece_bytes(self.b))

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids by A and B, both empty where one of them does not spell the text."""
        if text:
            a, b = self.a.ids(" " + text), self.b.encode(text)
            want = b" " + text.encode()
            if self.b_bytes.spelled(b) == want and self.a_bytes.spelled(a.tolist()) == want:
                return a.astype(np.int64), np.array(b, np.int64)
        return np.zeros(0, np.int64), np.zeros(0, np.int64)


class Spelling:
    """The bytes of each id, and its decimal form with each sign that may follow it."""

    def __init__(self, spelled: list[bytes]):
        self.list = spelled
        self.size = np.array([len(s) for s in spelled], np.int64)
        self.decimal = np.array([f"{i}{sign}" for i in range(len(spelled)) for sign in SIGNS], object)

    def spelled(self, ids: list[int]) -> bytes:
        return b"".join(map(self.list.__getitem__, ids))

    def signed(self, ids: np.ndarray, sign: np.ndarray) -> np.ndarray:
        return self.decimal[ids * len(SIGNS) + sign]


def byte_level(tokenizer) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary, whose printable bytes stand for themselves and the rest for U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable}
    byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
    out = [b""] * tokenizer.get_vocab_size()
    for entry, i in tokenizer.get_vocab().items():
        out[i] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
    return out


def piece_bytes(model) -> list[bytes]:
    """Bytes of each id of a piece vocabulary: U+2581 is a space, a byte piece is its byte."""
    out = []
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            out.append(bytes([int(model.id_to_piece(i)[3:5], 16)]))
        else:
            out.append(model.id_to_piece(i).replace("▁", " ").encode())
    return out


@lru_cache(maxsize=1)
def vocabularies(bytes_file: str = BYTES_FILE, bytes_ranks: str | None = BYTES_RANKS, pieces_file: str = PIECES_FILE) -> Vocabularies:
    return Vocabularies(bytes_file, bytes_ranks, pieces_file)


def byte_incidence(size: np.ndarray, transposed: bool) -> Rows:
    """Token-by-byte incidences of consecutive tokens, or byte-by-token."""
    begin = np.concatenate([[0], np.cumsum(size)])
    n = int(begin[-1])
    if transposed:
        return Rows(np.arange(n + 1), np.repeat(np.arange(len(size)), size), np.ones(n, np.int64))
    return Rows(begin, np.arange(n), np.ones(n, np.int64))


def overlap_links(a_size: np.ndarray, b_size: np.ndarray):
    """(token of A, token of B, shared bytes) of all tokens that overlap."""
    return byte_incidence(a_size, False).product(byte_incidence(b_size, True))


def counted(row: np.ndarray, column: np.ndarray, rows: int) -> Rows:
    """The matrix of how often each (row, column) comes up."""
    width = int(column.max(initial=0)) + 1
    key, count = np.unique(row * width + column, return_counts=True)
    return Rows.of(key // width, key % width, count, rows)


class Aligned:
    """Tokens of consecutive documents, their groups and links; ``a_cut`` and ``b_cut`` are token offsets of the documents."""

    def __init__(self, a, a_cut, b, b_cut, vocabulary: Vocabularies):
        self.a, self.b, self.a_cut, self.b_cut = a, b, a_cut, b_cut
        self.a_size, self.b_size = vocabulary.a_bytes.size[a], vocabulary.b_bytes.size[b]
        a_end, b_end = np.cumsum(self.a_size), np.cumsum(self.b_size)
        self.vocabulary = vocabulary
        both = b_end[np.searchsorted(b_end, a_end)] == a_end if len(a) else np.zeros(0, bool)
        self.a_last, self.b_last = both, np.zeros(len(b), bool)
        self.b_last[np.searchsorted(b_end, a_end[both])] = True
        self.a_group, self.b_group = np.cumsum(self.a_last) - self.a_last, np.cumsum(self.b_last) - self.b_last
        self.groups = int(both.sum())
        self.a_doc = np.repeat(np.arange(len(a_cut) - 1), np.diff(a_cut))
        self.b_doc = np.repeat(np.arange(len(b_cut) - 1), np.diff(b_cut))

    def overlaps(self) -> np.ndarray:
        """Number of overlap links of each document."""
        out = np.zeros(len(self.a_cut) - 1, np.int64)
        for row, _, _ in overlap_links(self.a_size, self.b_size):
            out += np.bincount(self.a_doc[row], minlength=len(out))
        return out

    def group_counts(self) -> np.ndarray:
        return np.bincount(self.a_doc[self.a_last], minlength=len(self.a_cut) - 1)

    def linked_ids(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair of ids, linked occurrences), by document and pair."""
        if not len(self.a):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        left, a_row = np.unique((self.a_doc << ID_BITS) | self.a, return_inverse=True)
        right, b_column = np.unique((self.b_doc << ID_BITS) | self.b, return_inverse=True)
        a_by_group = counted(a_row, self.a_group, len(left))
        group_by_b = counted(self.b_group, b_column, self.groups)
        low = (1 << ID_BITS) - 1
        doc, pair, links = [], [], []
        for row, column, value in a_by_group.product(group_by_b):
            doc.append(left[row] >> ID_BITS)
            pair.append(((left[row] & low) << ID_BITS) | (right[column] & low))
            links.append(value)
        return np.concatenate(doc), np.concatenate(pair), np.concatenate(links)

    def digests(self) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2`` by group; '' where there are no tokens."""
        a_closed, b_closed = np.cumsum(np.bincount(self.a_group, minlength=self.groups)), np.append(0, np.cumsum(np.bincount(self.b_group, minlength=self.groups)))
        line = np.empty(len(self.a) + len(self.b), object)
        line[np.arange(len(self.a)) + b_closed[self.a_group]] = self.vocabulary.a_bytes.signed(self.a, self.a_last * 1)
        line[np.arange(len(self.b)) + a_closed[self.b_group]] = self.vocabulary.b_bytes.signed(self.b, self.b_last * 2)
        line = line.tolist()
        cuts = (self.a_cut + self.b_cut).tolist()
        return [hashlib.sha256("".join(line[i:j])[:-1].encode()).hexdigest() if i < j else "" for i, j in zip(cuts, cuts[1:], strict=False)]


CHUNK = "chunk long, docs binary, totals binary, digests array<string>, pairs binary, seen binary, of_doc binary, of_pair binary, links binary"
TOTALS = ("n_a", "n_b", "n_groups", "n_overlaps", "n_links")


def aligned_chunks(docs: DataFrame, files: tuple) -> DataFrame:
    """One row for each part of about 4 MB: totals and digests by document, its pairs of ids, and the links by document and pair."""

    def run(batches):
        own, task, count = vocabularies(*files), TaskContext.get().partitionId(), 0
        for batch in batches:
            for ids, data, offsets in text_parts(batch):
                raw = data.tobytes()
                both = [own.encode(raw[i:j].decode()) for i, j in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
                a_cut, b_cut = (np.concatenate([[0], np.cumsum([len(x[k]) for x in both])]).astype(np.int64) for k in (0, 1))
                made = Aligned(np.concatenate([x[0] for x in both]), a_cut, np.concatenate([x[1] for x in both]), b_cut, own)
                doc, pair, links = made.linked_ids()
                n_links = np.bincount(doc, weights=links, minlength=len(ids)).astype(np.int64)
                totals = np.stack([np.diff(a_cut), np.diff(b_cut), made.group_counts(), made.overlaps(), n_links])
                pairs, of_pair, seen = np.unique(pair, return_inverse=True, return_counts=True)
                count += 1
                yield record_batch_of({
                    "chunk": pa.array([(task << 32) + count], pa.int64()), "docs": [np.array(ids, np.int64).tobytes()], "totals": [packed(totals.astype(np.int64))],
                    "digests": pa.array([made.digests()], pa.list_(pa.string())), "pairs": [packed(np.diff(pairs, prepend=0))], "seen": [packed(seen.astype(np.int32))],
                    "of_doc": [packed(doc.astype(np.int32))], "of_pair": [packed(of_pair.astype(np.int32))], "links": [packed(links.astype(np.int64))],
                })

    return cut_lineage(id_and_text(docs).mapInArrow(run, CHUNK))


def record_batch_of(columns: dict) -> pa.RecordBatch:
    kinds = {"digests": pa.list_(pa.string()), "chunk": pa.int64()}
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v, kinds.get(k, pa.binary())) for k, v in columns.items()})


def pair_counts(chunks: DataFrame) -> DataFrame:
    """a, b, count: how many documents hold the pair linked, and best: whether no other pair of a has more."""

    def run(batches):
        for row in rows_of(batches):
            pairs, seen = np.cumsum(unpacked(row["pairs"], np.int64)), unpacked(row["seen"], np.int32)
            step = 1 << 16
            for k in range(0, len(pairs), step):
                p = pairs[k : k + step]
                yield record_batch("a int, b int, seen long", (p >> ID_BITS, p & ((1 << ID_BITS) - 1), seen[k : k + step].astype(np.int64)))

    pairs = chunks.select("pairs", "seen").mapInArrow(run, "a int, b int, seen long")
    pairs = cut_lineage(pairs.groupBy("a", "b").agg(F.sum("seen").alias("count")))
    most = pairs.groupBy("a").agg(F.max("count").alias("most"))
    return pairs.join(most, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def bucket_blobs(pairs: DataFrame, buckets: int) -> DataFrame:
    """For each bucket of A ids its pairs in order, their counts and whether they are best."""

    def pack(group):
        key = (group.column("a").to_numpy().astype(np.int64) << ID_BITS) | group.column("b").to_numpy().astype(np.int64)
        order = np.argsort(key)
        return pa.table({
            "bucket": group.column("bucket").slice(0, 1), "known": pa.array([packed(np.diff(key[order], prepend=0))], pa.binary()),
            "count": pa.array([packed(group.column("count").to_numpy()[order])], pa.binary()),
            "best": pa.array([packed(group.column("best").to_numpy(zero_copy_only=False)[order].astype(np.uint8)) if len(key) else b""], pa.binary()),
        })

    dealt = pairs.withColumn("bucket", (F.col("a") % F.lit(buckets)).cast("int"))
    return dealt.groupBy("bucket").applyInArrow(pack, "bucket int, known binary, count binary, best binary")


def alignment_report(docs: DataFrame, bytes_file: str = BYTES_FILE, bytes_ranks: str | None = BYTES_RANKS, pieces_file: str = PIECES_FILE) -> DataFrame:
    """Tokens, groups and links of each document, and how its links stand in the corpus.

    doc_id, n_a, n_b, n_groups, n_overlaps, n_links; n_best: links whose pair is
    the commonest of its A id; count_sum: over all links, how many documents hold
    the pair linked; groups_sha256.
    """
    chunks = aligned_chunks(docs, (bytes_file, bytes_ranks, pieces_file))
    pairs = cut_lineage(pair_counts(chunks))
    buckets = 1 + pairs.count() // PAIRS_A_BUCKET

    def ask(batches):
        for row in rows_of(batches):
            pairs = np.cumsum(unpacked(row["pairs"], np.int64))
            bucket = (pairs >> ID_BITS) % buckets
            for b in np.unique(bucket).tolist():
                yield record_batch("chunk long, bucket int, asked binary", ([row["chunk"]], [b], [packed(np.diff(pairs[bucket == b], prepend=0))]))

    def answer(batches):
        for row in rows_of(batches):
            known, asked = (np.cumsum(unpacked(row[name], np.int64)) for name in ("known", "asked"))
            at = np.searchsorted(known, asked)
            count, best = unpacked(row["count"], np.int64)[at], unpacked(row["best"], np.uint8)[at]
            yield record_batch("chunk long, bucket int, count binary, best binary", ([row["chunk"]], [row["bucket"]], [packed(count)], [packed(best)]))

    questions = chunks.select("chunk", "pairs").mapInArrow(ask, "chunk long, bucket int, asked binary")
    answers = questions.join(bucket_blobs(pairs, buckets), "bucket").select("chunk", "bucket", "asked", "known", "count", "best")
    answers = answers.mapInArrow(answer, "chunk long, bucket int, count binary, best binary")
    answers = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "count", "best")).alias("answers"))
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_overlaps long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def report(batches):
        for row in rows_of(batches):
            ids = np.frombuffer(row["docs"], np.int64)
            totals = unpacked(row["totals"], np.int64).reshape(len(TOTALS), len(ids))
            pairs = np.cumsum(unpacked(row["pairs"], np.int64))
            count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
            bucket = (pairs >> ID_BITS) % buckets
            for a in row["answers"] or ():
                mine = bucket == a["bucket"]
                count[mine], best[mine] = unpacked(a["count"], np.int64), unpacked(a["best"], np.uint8)
            doc, of_pair, links = unpacked(row["of_doc"], np.int32), unpacked(row["of_pair"], np.int32), unpacked(row["links"], np.int64)
            sums = []
            for weight in (best, count):
                total = np.concatenate([[0], np.cumsum(links * weight[of_pair])])
                cut = np.searchsorted(doc, np.arange(len(ids) + 1))
                sums.append(total[cut[1:]] - total[cut[:-1]])
            yield record_batch(schema, (ids, *totals, *sums, row["digests"]))

    return chunks.drop("seen").join(answers, "chunk", "left").mapInArrow(report, schema)
