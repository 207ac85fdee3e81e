"""Byte-level BPE encoding and decoding with own tables (operator 13).

Text is cut into pre-tokens by the published pattern, each is encoded by itself:

* First tier: a minimal perfect hash over the vocabulary. A key's hash names a
  bucket; the bucket's pilot moves its keys to free slots, so every slot of a
  table as large as the vocabulary holds one entry. A pre-token is one look at
  its slot and an exact comparison of the bytes there.
* Second tier, for pre-tokens that are not in the vocabulary: bytes in a doubly
  linked list and a heap of (rank, place) of neighbouring pairs; the least rank
  is joined first, the leftmost among equals, until no pair has a rank.

Pre-tokens of a part of a batch are told apart first, so both tiers see each
spelling once; segmentations of short spellings are kept in a table of bounded
size. The cut is made on arrays of code points: runs of letters, numbers, other
signs and white space, with one leading space, the English endings after an
apostrophe, and the last white space before a word by itself. Character classes
are those of the ``regex`` library (``White_Space`` for white space).

Each task reads the vocabulary file (its path is a parameter) and builds the
table once; nothing is shuffled. Memory is bounded by a part of about 4 MB or one
longer text. Null texts are empty: no ids. Rows without doc_id are left out;
repeated rows are encoded each; an empty table gives no rows; other columns are
not read. An id outside the vocabulary raises a KeyError when decoded.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from shopledger.llm.common import U64, id_and_text, mixed, prefix_hashes, record_batch, span_hashes, text_parts

RANKS = "byte_bpe_multi_50k.tiktoken"
KEYS_A_BUCKET, MOST_PILOTS_AT_ONCE = 4, 1024
KEPT_SPELLINGS, KEPT_BYTES = 1 << 18, 64
ID_BITS = 24

SIGN, LETTER, NUMBER, BLANK = range(4)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large_binary array."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def hashes_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit hashes of consecutive strings."""
    size = np.diff(offsets).astype(U64)
    return mixed(span_hashes(prefix_hashes(data), offsets[:-1], offsets[1:]) + size)


class PerfectHash:
    """Slots 0..n-1 for n different byte strings, one each: hash, then displace by a pilot for each bucket."""

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        column = pa.array(keys, pa.large_binary())
        h = hashes_of(*bytes_of(column))
        if len(np.unique(h)) < self.n:
            raise ValueError("two keys have the same 64-bit hash or are equal")
        self.buckets = max(1, self.n // KEYS_A_BUCKET)
        bucket = (h % U64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.pilots = np.zeros(self.buckets, np.int64)
        self.owner = np.zeros(self.n, np.int64)
        free = np.ones(self.n, bool)
        sizes = np.diff(cut)
        for b in np.argsort(-sizes, kind="stable").tolist():
            if sizes[b] < 2:
                break
            members = order[cut[b] : cut[b + 1]]
            pilot, many = 1, 4
            while True:
                tries = self.displaced(h[members][None, :], np.arange(pilot, pilot + many)[:, None])
                slots = np.sort(tries, axis=1)
                good = free[slots].all(axis=1) & (slots[:, 1:] != slots[:, :-1]).all(axis=1)
                k = int(good.argmax())
                if good[k]:
                    break
                pilot, many = pilot + many, min(4 * many, MOST_PILOTS_AT_ONCE)
            self.pilots[b], free[tries[k]], self.owner[tries[k]] = pilot + k, False, members
        alone = np.flatnonzero(sizes == 1)  # a single key takes any slot that is left: pilot -(slot + 1)
        left = np.flatnonzero(free)[: len(alone)]
        self.pilots[alone], self.owner[left] = -left - 1, order[cut[alone]]
        held, at = bytes_of(column.take(pa.array(self.owner)))
        self.data, self.offsets = held.copy(), at.copy()

    def displaced(self, h: np.ndarray, pilot: np.ndarray) -> np.ndarray:
        return (mixed(h + pilot.astype(U64) * U64(0x9E3779B97F4A7C15)) % U64(self.n)).astype(np.int64)

    def slots(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For consecutive strings the number of the equal key, or -1."""
        count = len(offsets) - 1
        if not count or not self.n:
            return np.full(count, -1)
        h = hashes_of(data, offsets)
        pilot = self.pilots[(h % U64(self.buckets)).astype(np.int64)]
        slot = np.where(pilot < 0, -pilot - 1, self.displaced(h, pilot))
        size = np.diff(offsets)
        maybe = np.flatnonzero(size == self.offsets[slot + 1] - self.offsets[slot])
        out = np.full(count, -1)
        size, slot = size[maybe], slot[maybe]
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        same = data[np.repeat(offsets[maybe], size) + inside] == self.data[np.repeat(self.offsets[slot], size) + inside]
        wrong = np.bincount(np.repeat(np.arange(len(maybe)), size)[~same], minlength=len(maybe)) if len(maybe) else maybe
        out[maybe] = np.where(wrong == 0, self.owner[slot], -1)
        return out


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """(left id, right id) as one number -> rank of the joined entry, for every way to cut an entry in two entries."""
    out = {}
    for entry, rank in ranks.items():
        for k in range(1, len(entry)):
            left, right = ranks.get(entry[:k]), ranks.get(entry[k:])
            if left is not None and right is not None:
                out[left << ID_BITS | right] = rank
    return out


def joined_by_rank(piece: list[int], pairs: dict[int, int]) -> list[int]:
    """Ids of one pre-token given by the ids of its bytes: the pair of least rank is joined until none has a rank."""
    n = len(piece)
    ids, after, before = piece, list(range(1, n + 1)), list(range(-1, n))
    rank_of, push, pop = pairs.get, heapq.heappush, heapq.heappop
    rank = [rank_of(x << ID_BITS | y, -1) for x, y in zip(ids, ids[1:], strict=False)]  # of the pair that begins here
    rank.append(-1)
    heap = [r * n + i for i, r in enumerate(rank) if r >= 0]
    heapq.heapify(heap)
    while heap:
        best, i = divmod(pop(heap), n)
        if rank[i] != best:  # one side has changed since
            continue
        gone = after[i]
        ids[i], rank[gone] = best, -1
        j = after[i] = after[gone]
        before[j] = i
        r = rank[i] = rank_of(best << ID_BITS | ids[j], -1) if j < n else -1
        if r >= 0:
            push(heap, r * n + i)
        k = before[i]
        if k >= 0:
            r = rank[k] = rank_of(ids[k] << ID_BITS | best, -1)
            if r >= 0:
                push(heap, r * n + k)
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = after[i]
    return out


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\p{White_Space}")):
        found = "".join(regex.findall(pattern, every))
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return out


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte offsets at which the pre-tokens of consecutive texts begin."""
    if not len(data):
        return np.zeros(0, np.int64)
    if data.max() < 128:
        point, place = data, None
    else:
        point = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        place = np.flatnonzero((data & 0xC0) != 0x80)
    kind = classes()[point]
    n = len(point)
    text = np.zeros(n + 1, bool)  # a text begins here
    text[np.searchsorted(place, offsets) if place is not None else offsets] = True
    fresh = text[:-1].copy()
    fresh[1:] |= kind[1:] != kind[:-1]
    blank = kind == BLANK
    # The last blank before a word stands alone, or leads the word if it is a space.
    last = blank.copy()
    last[:-1] &= ~blank[1:] & ~text[1:-1]
    last[-1] = False
    fresh |= last
    leads = np.flatnonzero(last & (point == 32))
    fresh[leads + 1] = False
    # 's 't 'm 'd 're 've 'll after anything but a leading space, where the apostrophe is a sign by itself.
    mark = np.flatnonzero((point == 39) & fresh)
    mark = mark[mark + 1 < n]
    mark = mark[(kind[mark + 1] == LETTER) & ~text[mark + 1]]
    one, two = point[mark + 1], np.zeros(len(mark), point.dtype)
    able = mark + 2 < n
    able[able] &= ~text[mark[able] + 2]
    two[able] = point[mark[able] + 2]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    ending = short | long
    fresh[mark[ending] + 1] = False
    after = mark[ending] + np.where(short[ending], 2, 3)
    after = after[after < n]
    fresh[after] = True  # what follows is a new text, a new run, or the rest of the letters
    begin = np.flatnonzero(fresh)
    return begin if place is None else place[begin]


class Codec:
    """A vocabulary given as byte string -> rank, where ranks are also the ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        keys = list(ranks)
        self.table = PerfectHash(keys)
        self.rank = np.array([ranks[k] for k in keys], np.int64)
        self.limit = int(self.rank.max(initial=-1)) + 1
        tokens = [b""] * self.limit
        for key, rank in ranks.items():
            tokens[rank] = key
        sizes = np.array([len(t) for t in tokens], np.int64)
        self.known = sizes > 0
        self.begin, self.size = np.cumsum(sizes) - sizes, sizes
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.pairs = pair_ranks(ranks)
        self.single = [ranks.get(bytes([b]), -1) for b in range(256)]

    def miss(self, piece: bytes) -> bytes:
        """Ids as 32-bit integers; short spellings stay in two tables, of which the older is dropped when the newer is full."""
        ids = self.recent.get(piece)
        if ids is None:
            ids = self.older.pop(piece, None)
            if ids is None:
                ids = np.array(joined_by_rank([self.single[b] for b in piece], self.pairs), "<u4").tobytes()
            if len(piece) <= KEPT_BYTES:
                if len(self.recent) >= KEPT_SPELLINGS:
                    self.older, self.recent = self.recent, {}
                self.recent[piece] = ids
        return ids

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive texts one after another, and where each text's ids begin."""
        begin = pre_tokens(data, offsets)
        bounds = np.append(begin, len(data)).astype(np.int64)
        column = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        coded = column.dictionary_encode()
        number = coded.indices.to_numpy()
        spelled, at = bytes_of(coded.dictionary)
        slot = self.table.slots(spelled, at)
        found = slot >= 0
        missing = np.flatnonzero(~found)
        made = [self.miss(piece) for piece in coded.dictionary.take(pa.array(missing)).to_pylist()]
        count = np.ones(len(slot), np.int64)
        count[missing] = [len(ids) // 4 for ids in made]
        first = np.cumsum(count) - count
        flat = np.empty(int(count.sum()), np.int64)
        flat[first[found]] = self.rank[slot[found]]
        rest = np.ones(len(flat), bool)
        rest[first[found]] = False
        flat[rest] = np.frombuffer(b"".join(made), "<u4")
        each = count[number]
        ids = flat[np.repeat(first[number], each) + np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)]
        token_at = np.concatenate([[0], np.cumsum(each)])
        return ids, token_at[np.searchsorted(begin, offsets)]

    def decode(self, ids: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of consecutive id lists one after another, and where each list's bytes begin."""
        if len(ids) and not (0 <= ids.min() and ids.max() < self.limit and self.known[ids].all()):
            raise KeyError("an id is not in the vocabulary")
        size = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        where = np.repeat(self.begin[ids] - ends[:-1], size) + np.arange(int(ends[-1]))
        return self.bytes[where], ends[cuts]


@lru_cache(maxsize=2)
def codec(name: str = RANKS) -> Codec:
    """The codec of a public rank file, built once in each worker."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as lines:
        return Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


def encoded(docs: DataFrame, name: str = RANKS) -> DataFrame:
    """doc_id and the ids of each text."""
    schema = "doc_id long, ids array<int>"

    def run(batches):
        own = codec(name)
        for batch in batches:
            for doc_ids, data, offsets in text_parts(batch):
                ids, cuts = own.encode(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int32()))
                yield record_batch(schema, (doc_ids, lists))

    return id_and_text(docs).mapInArrow(run, schema)


def decoded(encodings: DataFrame, name: str = RANKS) -> DataFrame:
    """doc_id and the text of each list of ids (columns doc_id, ids); null lists are empty, bytes that are no UTF-8 become U+FFFD."""
    schema = "doc_id long, text string"

    def run(batches):
        own = codec(name)
        for batch in batches:
            lists = batch.column(1)
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            data, cuts = own.decode(ids, np.concatenate([[0], np.cumsum(size)]))
            raw = data.tobytes()
            texts = [raw[i:j].decode("utf-8", "replace") for i, j in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
            yield record_batch(schema, (batch.column(0).to_pylist(), texts))

    chosen = encodings.select(encodings["doc_id"].cast("long").alias("doc_id"), encodings["ids"].cast("array<int>").alias("ids"))
    return chosen.where("doc_id IS NOT NULL").mapInArrow(run, schema)


def coding_report(docs: DataFrame, name: str = RANKS) -> DataFrame:
    """doc_id, number of ids, SHA-256 of the ids as little-endian 32-bit integers and of the bytes they decode to."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        own = codec(name)
        for batch in batches:
            for doc_ids, data, offsets in text_parts(batch):
                ids, cuts = own.encode(data, offsets)
                back, at = own.decode(ids, cuts)
                raw_ids, raw = memoryview(ids.astype("<u4").tobytes()), memoryview(back.tobytes())
                rows = [
                    (doc_id, j - i, hashlib.sha256(raw_ids[4 * i : 4 * j]).hexdigest(), hashlib.sha256(raw[p:q]).hexdigest())
                    for doc_id, i, j, p, q in zip(doc_ids, cuts.tolist(), cuts[1:].tolist(), at.tolist(), at[1:].tolist(), strict=False)
                ]
                yield record_batch(schema, zip(*rows, strict=True))

    return id_and_text(docs).mapInArrow(run, schema)
