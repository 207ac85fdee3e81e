"""Shared helpers: reading texts as bytes, chunk tables, hashing of words and grams.

All functions that run on executors work on whole Arrow batches with numpy.
Rows whose ``doc_id`` is null cannot be named in a result; the operators leave
them out unless they say otherwise. A null text counts as the empty text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopledger.session import cut_lineage

U64 = np.uint64
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, so a worker holds few long texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only doc_id and text, under these names; rows without an id are left out."""
    prepare(docs.sparkSession)
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text")
    ).where("doc_id IS NOT NULL")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another, and the n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two multiply-xorshift rounds)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(29))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(32))


def text_parts(batch: pa.RecordBatch, limit: int = 4 << 20):
    """ids, bytes and offsets of consecutive rows of (doc_id, text) with about ``limit`` bytes, at least one row each."""
    ids = batch.column(0).to_pylist()
    data, offsets = text_bytes(batch.column(1))
    i = 0
    while i < len(ids):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield ids[i:j], data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(kind: str, n: int) -> np.ndarray:
    """First n powers of the hash base or of its inverse, modulo 2**64."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = _BASE if kind == "base" else _BASE_INVERSE
        have = np.full(max(n, 1 << 16), base, U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 1 << 23:
            _powers[kind] = have
    return have[:n]


BYTE_CODE = mixed(np.arange(1, 257, dtype=U64))
LOWER_CODE = BYTE_CODE.copy()
LOWER_CODE[65:91] = BYTE_CODE[97:123]


def prefix_hashes(data: np.ndarray, code: np.ndarray = BYTE_CODE) -> np.ndarray:
    """P with P[j] - P[i] = hash of data[i:j] times base**i, modulo 2**64."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(code[data] * powers("base", len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free 64-bit hashes of the spans data[start:end]."""
    return mixed((prefix[end] - prefix[start]) * powers("inverse", len(prefix))[start])


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document number of each run of non-space bytes; runs end with their document."""
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


CHUNK_SCHEMA = "chunk long, ids binary, lens binary, body binary, rest binary"


def chunk_table(docs: DataFrame, chunk_bytes: int = 4 << 20, keep_columns: bool = False) -> DataFrame:
    """Documents packed into rows of about ``chunk_bytes`` of text, written once.

    Each row has its own number, the ids, byte lengths and the compressed texts
    of its documents; with ``keep_columns`` also every other column, as an Arrow
    stream. A longer text has a chunk of its own. Written to the shared folder,
    so numbers and order stay the same when executors are lost.
    """
    spark = docs.sparkSession
    prepare(spark)
    names = docs.columns

    def pack(batches):
        task, count = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def row(parts):
            nonlocal count
            table = pa.Table.from_batches(parts)
            data, offsets = text_bytes(table.column("text"))
            rest = b""
            if keep_columns:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema) as writer:
                    writer.write_table(table.set_column(names.index("text"), "text", pa.nulls(len(table), table.schema.field("text").type)))
                rest = zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes())
            ids = table.column("doc_id").cast(pa.int64()).combine_chunks().to_numpy(zero_copy_only=False)
            count += 1
            return pa.RecordBatch.from_pydict({
                "chunk": pa.array([(task << 32) + count], pa.int64()), "ids": [ids.astype(np.int64).tobytes()],
                "lens": [np.diff(offsets).astype(np.int64).tobytes()],
                "body": [zstandard.ZstdCompressor(level=3).compress(data.tobytes())],
                "rest": pa.array([rest], pa.binary()),
            })

        for batch in batches:
            at = 0
            _, offsets = text_bytes(batch.column(batch.schema.get_field_index("text")))
            while at < batch.num_rows:
                room = int(np.searchsorted(offsets, offsets[at] + chunk_bytes - size, "right")) - 1
                upto = min(batch.num_rows, max(room, at + (not held)))
                if upto > at:
                    held.append(batch.slice(at, upto - at))
                    size += int(offsets[upto] - offsets[at])
                    at = upto
                if at < batch.num_rows or size >= chunk_bytes:
                    yield row(held)
                    held, size = [], 0
        if held:
            yield row(held)

    rows = docs.where(docs["doc_id"].isNotNull()) if keep_columns else id_and_text(docs)
    return cut_lineage(rows.mapInArrow(pack, CHUNK_SCHEMA))


def chunk_parts(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, offsets and bytes of a chunk row."""
    lens = np.frombuffer(row["lens"], np.int64)
    body = zstandard.ZstdDecompressor().decompress(row["body"], max_output_size=int(lens.sum()) or 1)
    return np.frombuffer(row["ids"], np.int64), np.concatenate([[0], np.cumsum(lens)]), np.frombuffer(body, np.uint8)


def chunk_rest(row: dict) -> pa.Table:
    """All columns of a chunk made with keep_columns; the text column is null."""
    raw = zstandard.ZstdDecompressor().decompress(row["rest"], max_output_size=1 << 31)
    return pa.ipc.open_stream(raw).read_all()


def packed(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def unpacked(raw: bytes, kind) -> np.ndarray:
    d = zstandard.ZstdDecompressor()
    return np.frombuffer(d.decompress(raw), kind)


def bucket_count(table: DataFrame, least: int = 0) -> int:
    """Reduce buckets in proportion to the chunks: one for each, a power of two."""
    n = max(table.count(), least, 16)
    return 1 << (int(n) - 1).bit_length()


def rows_of(batches):
    """Rows of Arrow batches as dicts, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


ARROW = {
    "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "float": pa.float32(),
    "boolean": pa.bool_(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
}


def record_batch(schema: str, columns) -> pa.RecordBatch:
    """Columns in the order and with the types of a Spark schema string."""
    parts = [part.split() for part in schema.split(",")]
    arrays = [c if isinstance(c, pa.Array) and c.type == ARROW[t] else pa.array(c, ARROW[t]) for c, (_, t) in zip(columns, parts, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in parts])
