"""Near duplicates by a multi-index Hamming join of b-bit MinHash signatures (operator 5).

A signature is ``SYMBOLS`` minima of ``BITS`` bits. Its distance is the number
of differing symbols. By the pigeonhole principle two signatures at distance at
most ``LIMIT`` agree, up to one error, in one of ``CHUNKS`` chunks, since
LIMIT < 2 * CHUNKS. All one-error neighbours of a chunk are enumerated by
leaving out one symbol at a time, so each symbol gives one index key and every
pair within the limit meets under a key. At similarity 0.8 the distance exceeds
the limit with a probability of about 2e-5, 0.0002 in a pair of two independent
links; the test against brute force states it.

Documents with equal shingle sets are one node. A key's members are first held
against its least and its largest member; those that are still in different
components are then held against each other in blocks, inside a task, so a group
of copies costs few checks for each member and no table of pairs is formed.
Links are confirmed on the full shingle sets.

No words or null text: an empty set, linked with nothing. Fewer words than a
shingle: the whole sequence is one shingle. Repeated rows fall in one component.
Ties go to the smallest id. Empty table: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopledger.llm.common import LOWER_CODE, U64, cut_lineage, id_and_text, mixed, prefix_hashes, record_batch, span_hashes, text_parts, words
from shopledger.llm.components import components

SYMBOLS, BITS, CHUNKS, LIMIT = 64, 16, 14, 27
BLOCK = 500
#: Texts are hashed in parts of about this size, so a batch of long texts needs no more memory than one of short ones.
PART_BYTES = 1 << 20
_A = mixed(np.arange(1, SYMBOLS + 1, dtype=U64)) | U64(1)
_B = mixed(np.arange(1001, 1001 + SYMBOLS, dtype=U64))
_TAG = mixed(np.arange(5001, 5001 + SYMBOLS, dtype=U64))
_BOUNDS = np.linspace(0, SYMBOLS, CHUNKS + 1).round().astype(int)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each document's shingles of ``size`` words."""
    start, end, doc = words(data, offsets)
    h = span_hashes(prefix_hashes(data, LOWER_CODE), start, end)
    docs = len(offsets) - 1
    at = np.searchsorted(doc, np.arange(docs + 1))
    count = np.diff(at)
    k = np.zeros(len(h), U64)
    for j in range(min(size, len(h))):  # order-sensitive sum over the next words
        n = len(h) - j
        k[:n] = k[:n] * U64(0x9E3779B97F4A7C15) + h[j:]
    k = mixed(k)
    out = []
    for d in range(docs):
        if count[d] >= size:
            out.append(np.unique(k[at[d] : at[d + 1] - size + 1]))
        elif count[d]:
            x = np.array([count[d]], U64)
            for w in h[at[d] : at[d + 1]]:
                x = mixed(x ^ w) * U64(0x9E3779B97F4A7C15)
            out.append(x)
        else:
            out.append(np.zeros(0, U64))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """Low bits of the minima of all hash functions over a set."""
    low = np.full(SYMBOLS, ~U64(0))
    for at in range(0, len(s), 2048):
        low = np.minimum(low, (s[at : at + 2048, None] * _A + _B).min(axis=0))
    return (mixed(low) >> U64(64 - BITS)).astype(np.uint16)


SIGNATURES = "doc_id long, n_shingles long, f1 long, f2 long, sig binary"


def signature_rows(size: int):
    """Signatures of batches of (doc_id, text), in parts of about PART_BYTES."""

    def run(batches):
        for batch in batches:
            for ids, data, offsets in text_parts(batch, PART_BYTES):
                sets = shingle_sets(data, offsets, size)
                with np.errstate(over="ignore"):
                    f1 = np.array([s.sum(dtype=U64) for s in sets], U64).view(np.int64)
                    f2 = np.array([np.bitwise_xor.reduce(mixed(s + U64(77))) if len(s) else U64(0) for s in sets], U64).view(np.int64)
                    sig = [signature(s).tobytes() for s in sets]
                yield record_batch(SIGNATURES, (ids, [len(s) for s in sets], f1, f2, sig))

    return run


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit name of the set, its signature and the compressed text."""
    return id_and_text(docs).mapInArrow(signature_rows(size), SIGNATURES)


def _sig_matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def index_keys(sig: np.ndarray) -> np.ndarray:
    """One key for each symbol: its chunk with that symbol left out."""
    terms = mixed(sig.astype(U64) + _TAG)
    sums = np.add.reduceat(terms, _BOUNDS[:-1], axis=1)
    chunk = np.searchsorted(_BOUNDS, np.arange(SYMBOLS), "right") - 1
    return mixed(sums[:, chunk] - terms + _TAG)


def keys_of(reps: DataFrame) -> DataFrame:
    """(key, id) for all index keys of all signatures."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keys = index_keys(_sig_matrix(batch.column(1)))
                yield record_batch("key long, id long", (keys.ravel().view(np.int64), np.repeat(batch.column(0).to_numpy(), SYMBOLS)))

    return reps.select("id", "sig").mapInArrow(run, "key long, id long")


def set_bodies(bodies: list[bytes], size: int) -> list[np.ndarray]:
    """Shingle sets of compressed texts."""
    d = zstandard.ZstdDecompressor()
    texts = [d.decompress(b) for b in bodies]
    return shingle_sets(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]), size)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Exact test of the similarity of two sorted sets."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    z = np.sort(np.concatenate([x, y]), kind="stable")
    both = int((z[1:] == z[:-1]).sum())
    return 100 * both >= percent * (len(z) - both)


def block_linker(size: int, percent: int):
    """Links between members of one key's block that are in different components, confirmed on full sets.

    A pair is tested at its first common key only, and not once the block's own
    links have joined its ends, so at most one link for each member comes out.
    """

    def run(group):
        sig, side = _sig_matrix(group.column("sig").combine_chunks()), group.column("side").to_numpy()
        ids, comp, key = (group.column(c).to_numpy() for c in ("id", "comp", "key"))
        sets = set_bodies(group.column("body").to_pylist(), size)
        keys = index_keys(sig).view(np.int64)
        same_block = group.column("s")[0].as_py() == group.column("t")[0].as_py()
        root = np.unique(comp, return_inverse=True)[1]
        right = np.arange(len(ids)) if same_block else np.flatnonzero(side == 1)
        out: list[tuple[int, int]] = []
        for i in range(len(ids)) if same_block else np.flatnonzero(side == 0):
            j = right[right > i] if same_block else right
            j = j[root[j] != root[i]]
            j = j[(sig[j] != sig[i]).sum(axis=1) <= LIMIT]
            if len(j):
                j = j[keys[i][(keys[j] == keys[i]).argmax(axis=1)] == key[0]]
            for other in j:
                if root[other] != root[i] and similar(sets[i], sets[other], percent):
                    out.append((min(ids[i], ids[other]), max(ids[i], ids[other])))
                    root[root == root[other]] = root[i]
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def confirmed(pairs: DataFrame, bodies: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    left = bodies.select(F.col("id").alias("a"), F.col("body").alias("x"))
    right = bodies.select(F.col("id").alias("b"), F.col("body").alias("y"))

    def run(batches):
        name, own = None, None
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keep = np.zeros(len(a), bool)
            for at in range(0, len(a), 200):
                for i, other in enumerate(set_bodies(batch.column(3).slice(at, 200).to_pylist(), size), at):
                    if a[i] != name:
                        name, own = a[i], set_bodies([batch.column(2)[i].as_py()], size)[0]
                    keep[i] = similar(own, other, percent)
            yield record_batch("a long, b long", (a[keep], b[keep]))

    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document."""
    base = cut_lineage(signatures(docs, size))
    sets = base.where("n_shingles > 0").groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("id"))
    sets = cut_lineage(sets)
    reps = cut_lineage(base.join(sets, ["f1", "f2", "n_shingles"]).where("doc_id = id").select("id", "sig"))

    keys = keys_of(reps)
    shared = cut_lineage(keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).where("low < high"))
    members = cut_lineage(keys.join(shared, "key"))  # rows of shared keys only

    def near(batches):
        for batch in batches:
            x, y = _sig_matrix(batch.column(2)), _sig_matrix(batch.column(3))
            distance = (x != y).sum(axis=1)
            ok = distance <= LIMIT
            yield record_batch("a long, b long, distance int", (batch.column(0).to_numpy()[ok], batch.column(1).to_numpy()[ok], distance[ok].astype(np.int32)))

    leaders = members.select("id", F.explode(F.array("low", "high")).alias("leader")).where("id <> leader")
    stars = leaders.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
    stars = stars.join(reps.select(F.col("id").alias("b"), F.col("sig").alias("y")), "b").join(reps.select(F.col("id").alias("a"), F.col("sig").alias("x")), "a")
    stars = cut_lineage(stars.select("a", "b", "x", "y").mapInArrow(near, "a long, b long, distance int"))

    def squeeze(batches):
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield record_batch("id long, body binary", (batch.column(0), [z.compress(t.as_py().encode()) for t in batch.column(1)]))

    nodes = members.select("id").distinct()
    bodies = cut_lineage(id_and_text(docs).mapInArrow(squeeze, "id long, body binary").join(nodes, "id", "left_semi").dropDuplicates(["id"]))

    def in_two(pairs: DataFrame, comps: DataFrame) -> DataFrame:
        a, b = (comps.select(F.col("id").alias(c), F.col("component").alias(f"c{c}")) for c in "ab")
        return pairs.join(a, "a", "left").join(b, "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")

    # Each member with its nearest leader; then with the others; then all that meet under a key and are still apart.
    first = stars.groupBy("b").agg(F.min(F.struct("distance", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    links = cut_lineage(confirmed(first, bodies, size, percent))
    comps = cut_lineage(components(links))
    second = cut_lineage(in_two(stars.select("a", "b"), comps).join(first, ["a", "b"], "left_anti"))
    links = cut_lineage(links.union(confirmed(second, bodies, size, percent)))
    comps = cut_lineage(components(links))

    apart = members.join(comps, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("comp"))
    apart = cut_lineage(apart)
    mixed_keys = apart.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("key")
    rows = apart.join(mixed_keys, "key").join(reps, "id").join(bodies, "id")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("key", "id", "comp", "sig", "body", F.least("mine", "other").alias("s"), F.greatest("mine", "other").alias("t"), (F.col("mine") > F.col("other")).cast("int").alias("side"))
    links = links.union(rows.groupBy("key", "s", "t").applyInArrow(block_linker(size, percent), "a long, b long"))
    comps = cut_lineage(components(links))

    named = sets.join(comps, "id", "left").select("f1", "f2", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    out = base.join(named, ["f1", "f2", "n_shingles"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row for each id that is the least of its component, with all its columns.

    Of rows that repeat an id the least stays; only those rows are grouped.
    """
    kept = near_duplicates(docs, size, percent).where("kept").select(F.col("doc_id").alias("doc_id")).distinct()
    rows = docs.join(kept, "doc_id", "left_semi").select(docs.columns)
    repeated = cut_lineage(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    again = rows.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*")
    return rows.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(again)
