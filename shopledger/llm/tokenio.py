"""Token ids of all documents as packed matrices (operator 10).

Each task packs the documents it reads, in windows of bounded size: overlong
documents are cut without loss, pieces go by best fit decreasing, and a segment
tree over the possible capacities finds the tightest bin. A row is a sequence:
``width`` ids (closing id 0 as padding), cumulative segment lengths and positions
that start again at every segment. Nothing is shuffled; a window loses at most
its last bins.

Empty table: no rows. Null or empty text: a segment of the closing id alone.
Repeated rows are written as often as they occur. Ties keep reading order.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from shopledger.llm.common import id_and_text, record_batch
from shopledger.llm.tokens import END_ID, encoder

WIDTH = 2048
WINDOW_TOKENS = 2 << 20
SCHEMA = (
    "sequence_id long, n_tokens int, n_segments int, input_ids binary, cu_seqlens array<int>, position_ids binary, "
    "doc_ids array<long>, starts array<long>, ids_crc32 long"
)


class CapacityTree:
    """Segment tree over capacities 0..width: how many bins have exactly that room."""

    def __init__(self, width: int):
        self.leaves = 1 << width.bit_length()
        self.total = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(width + 1)]

    def add(self, room: int, b: int) -> None:
        self.bins[room].append(b)
        self._count(room, 1)

    def _count(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.total[at] += by
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Room and number of the bin with the least room of at least ``need``; it leaves the tree."""
        at, total = need + self.leaves, self.total
        while not total[at]:  # climb to the first subtree on the right that has a bin
            while at & 1:
                at >>= 1
            if at == 0:
                return None
            at += 1
            if at & (at - 1) == 0:
                return None
        while at < self.leaves:
            at = 2 * at if total[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._count(room, -1)
        return room, self.bins[room].pop()


def best_fit_decreasing(lengths: list[int], width: int) -> list[list[int]]:
    """Bins of item numbers, longest items first, each into the tightest bin."""
    tree, bins = CapacityTree(width), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        room, b = found or (width, len(bins))
        if found is None:
            bins.append([])
        bins[b].append(i)
        if room > lengths[i]:
            tree.add(room - lengths[i], b)
    return bins


def packed_matrices(docs: DataFrame, width: int = WIDTH, window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """One row for each packed sequence."""

    def run(batches):
        own, serial, task = encoder(), 0, TaskContext.get().partitionId()
        end = np.array([END_ID], "<u4")

        def window(segments):
            nonlocal serial
            rows = []
            for b in best_fit_decreasing([len(x[2]) for x in segments], width):
                parts = [segments[i] for i in b]
                ids = np.concatenate([x[2] for x in parts])
                sizes = np.array([len(x[2]) for x in parts])
                cu = np.concatenate([[0], np.cumsum(sizes)])
                serial += 1
                matrix, position = np.full(width, END_ID, "<u4"), np.zeros(width, "<u4")
                matrix[: len(ids)] = ids
                position[: len(ids)] = np.arange(len(ids)) - np.repeat(cu[:-1], sizes)
                rows.append(((task << 32) + serial, len(ids), len(parts), matrix.tobytes(), cu.tolist(), position.tobytes(), [x[0] for x in parts], [x[1] for x in parts], zlib.crc32(ids.tobytes())))
                if len(rows) == 500:
                    yield record_batch(SCHEMA, zip(*rows, strict=True))
                    rows = []
            if rows:
                yield record_batch(SCHEMA, zip(*rows, strict=True))

        held, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([own.ids(text.as_py()), end])
                held.extend((doc_id, at, ids[at : at + width]) for at in range(0, len(ids), width))
                size += len(ids)
                if size >= window_tokens:
                    yield from window(held)
                    held, size = [], 0
        if held:
            yield from window(held)

    return id_and_text(docs).mapInArrow(run, SCHEMA)
