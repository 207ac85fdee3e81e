"""Best-fit packing with a swap-based local search (operator 3).

Documents become pieces of at most ``width`` tokens. Pieces are dealt at random
into groups of bounded size, each packed by one task: best fit decreasing, then
a local search that moves one or two documents, or exchanges one for one or two
for one, between all underfull bins. Every accepted step raises the sum of
squared fills, so the search ends: with no step left, or at the least number of
bins that the tokens need. Bins that become empty go. All bins of a group filled
to less than ``OPEN_PERCENT`` are opened, dealt anew as whole bins and packed
again together; from then on each level opens the emptier ones, up to half of
its pieces, until one group is left. So the levels are about log2 of the groups
and the loss does not grow with their number. Only lengths are moved.

Empty table: no rows. Null or empty text: one piece, the closing id alone.
Repeated rows are packed as often as they occur. Ties go to the first in order
of length, id and piece.
"""

from __future__ import annotations

import zlib
from heapq import heappop, heappush
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopledger.llm.common import cut_lineage
from shopledger.llm.tokens import encoded

WIDTH = 2048
GROUP_PIECES = 20_000
OPEN_PERCENT = 99  # emptier bins are packed again with those of other groups
SPAN = 128
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"


def cut_pieces(n: int, width: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n tokens; only the first may be shorter."""
    first = n % width or min(n, width)
    return [(0, first)] + [(at, width) for at in range(first, n, width)]


def pieces(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row for each piece, with the crc32 of its ids."""
    serial = [0]  # of this task: spreads pieces of rows with the same id

    def rows(doc_id, ids):
        for k, (at, n) in enumerate(cut_pieces(len(ids), width)):
            serial[0] += 1
            yield doc_id, k, at, n, zlib.crc32(ids[at : at + n].tobytes()), serial[0]

    return encoded(docs, PIECES, rows)


def best_fit(lengths: list[int], width: int) -> list[list[int]]:
    """Bins of item numbers by best fit decreasing; bit r of ``free`` says that a bin has r left."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(width + 1)]
    free = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = free >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                free &= ~(1 << room)
        else:
            room, b = width, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > n:
            by_room[room - n].append(b)
            free |= 1 << (room - n)
    return bins


class Partners:
    """Underfull bins by what they would take: the pseudo-length 0 stands for a plain move.

    A bin with ``room`` left that gives up a length n has n + room left; ``least[n + room]``
    is the smallest such n, ``most[n]`` the largest room of a bin that has a length n.
    """

    def __init__(self, width: int):
        self.least = np.full(width + 1, width + 1, np.int64)
        self.most = np.full(width + 1, -1, np.int64)
        self.takers: list[list[tuple[int, int, int]]] = [[] for _ in range(width + 1)]
        self.givers: list[list[tuple[int, int, int]]] = [[] for _ in range(width + 1)]
        self.none = width + 1
        self.held: dict[int, tuple[int, list[int]]] = {}
        self.stamp: dict[int, int] = {}

    def add(self, b: int, room: int, lengths: set[int]) -> None:
        stamp = self.stamp[b] = self.stamp.get(b, 0) + 1
        self.held[b] = room, [0, *lengths]
        for n in self.held[b][1]:
            heappush(self.takers[n + room], (n, b, stamp))
            heappush(self.givers[n], (-room, b, stamp))
            self.least[n + room] = min(self.least[n + room], n)
            self.most[n] = max(self.most[n], room)

    def remove(self, b: int) -> None:
        room, ns = self.held.pop(b)
        self.stamp[b] += 1
        for n in ns:
            for heap in (self.takers[n + room], self.givers[n]):
                while heap and self.stamp[heap[0][1]] != heap[0][2]:
                    heappop(heap)
            self.least[n + room] = self.takers[n + room][0][0] if self.takers[n + room] else self.none
            self.most[n] = -self.givers[n][0][0] if self.givers[n] else -1

    def fuller(self, sums: np.ndarray, room: int) -> tuple[int, int, int, int] | None:
        """(room left, bin, sum, n) of the bin that one of the sums for its n fills best, better than ``room``."""
        for low in range(0, room, SPAN):
            d = np.arange(low, min(low + SPAN, room))
            left = self.least[sums[:, None] + d]
            hit = left < sums[:, None]
            if hit.any():
                k = int(hit.any(axis=0).argmax())
                i = int(np.where(hit[:, k], sums - left[:, k], -1).argmax())
                s = int(sums[i])
                n, b, _ = self.takers[s + int(d[k])][0]
                return int(d[k]), b, s, n
        return None

    def filler(self, sums: np.ndarray, room: int) -> tuple[int, int, int, int] | None:
        """(room left, bin, sum, n) of a length n that fills the own bin best in place of one of the sums."""
        for low in range(0, room, SPAN):
            d = np.arange(low, min(low + SPAN, room))
            n = sums[:, None] + room - d
            hit = self.most[n] > d
            if hit.any():
                k = int(hit.any(axis=0).argmax())
                i = int(hit[:, k].argmax())
                return int(d[k]), self.givers[n[i, k]][0][1], int(sums[i]), int(n[i, k])
        return None


def improve(bins: list[list[int]], lengths: list[int], width: int) -> list[list[int]]:
    """Local search over all underfull bins until no step is left or no bin can be saved.

    A bin gives one or two documents for one or none of another, or two for a longer one; every
    step raises the sum of squared fills: (f + g)^2 + (e - g)^2 > f^2 + e^2 exactly if f + g > e,
    so if the bin that grows has less room after the step than the other had before it.
    """
    room = [width - sum(lengths[i] for i in b) for b in bins]
    least = -(-sum(lengths[i] for b in bins for i in b) // width)
    left = sum(bool(b) for b in bins)
    partners = Partners(width)

    def put(b: int) -> None:
        if room[b] and bins[b]:
            partners.add(b, room[b], {lengths[i] for i in bins[b]})

    def pick(b: int, n: int, two: bool = False) -> list[int]:
        """Items of the bin with n tokens in all: none, one or two; with ``two`` always two."""
        at: dict[int, int] = {}
        for i in bins[b]:
            at.setdefault(lengths[i], i)
        if not two and (not n or n in at):
            return [at[n]] if n else []
        return next([i, at[n - lengths[i]]] for i in bins[b] if at.get(n - lengths[i], i) != i)

    def sums(b: int) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of one and of two documents of the bin."""
        own, times = np.unique([lengths[i] for i in bins[b]], return_counts=True)
        i, k = np.triu_indices(len(own), 1)
        return own, np.unique(np.concatenate([own[i] + own[k], 2 * own[times > 1]]))

    def step(a: int) -> bool:
        """Takes the step of bin a that leaves the fullest bin; True if there is one."""
        own, both = sums(a)
        found = partners.fuller(np.union1d(own, both), room[a])
        back = partners.filler(both, room[a]) if len(both) and (found is None or found[0]) else None
        turned = back is not None and (found is None or back[0] < found[0])
        if found is None and not turned:
            return False
        _, b, s, n = back if turned else found
        give, take = pick(a, s, turned), pick(b, n)
        partners.remove(b)
        bins[a] = [i for i in bins[a] if i not in give] + take
        bins[b] = [j for j in bins[b] if j not in take] + give
        room[a], room[b] = room[a] + s - n, room[b] - s + n
        put(b)
        return True

    for b in range(len(bins)):
        put(b)
    todo = True
    while todo and left > least:
        todo = False
        for a in sorted(partners.held, key=lambda b: (-room[b], b)):
            if a not in partners.held:
                continue
            partners.remove(a)
            while bins[a] and room[a] and step(a):
                todo = True
            put(a)
            left -= not bins[a]
            if left <= least:
                break
    return [b for b in bins if b]


def packer(names: list[str], width: int, level: int, last: bool):
    """Packs one group, from its bins so far if that takes no more; all but the last level open bins."""

    def run(group):
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = group.column("length").to_pylist()
        g = group.column("g")[0].as_py() if len(lengths) else 0
        bins = improve(best_fit(lengths, width), lengths, width)
        if level:
            so_far: dict[int, list[int]] = {}
            for i, b in enumerate(group.column("sequence_id").to_pylist()):
                so_far.setdefault(b, []).append(i)
            bins = min(improve(list(so_far.values()), lengths, width), bins, key=len)
        fill = [sum(lengths[i] for i in b) for b in bins]
        sequence, offset, opened = (np.zeros(len(lengths), np.int64) for _ in range(3))
        room_for = len(lengths) // 2 if level else len(lengths)  # pieces
        for k in sorted(range(len(bins)), key=lambda k: fill[k]):
            at = 0
            for i in sorted(bins[k]):
                sequence[i], offset[i] = (level << 56) | (g << 24) | k, at
                at += lengths[i]
            room_for -= len(bins[k])
            opened[bins[k]] = not last and room_for >= 0 and at * 100 < width * OPEN_PERCENT
        out = group.select(names)
        for name, a in (("sequence_id", sequence), ("offset", offset), ("opened", opened.astype(bool))):
            out = out.append_column(name, pa.array(a))
        return out

    return run


def pack(pieces: DataFrame, width: int = WIDTH, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of at most ``width`` and a ``salt``."""
    table = cut_lineage(pieces)
    names = [c for c in table.columns if c != "salt"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.drop("salt").schema) + ", sequence_id long, offset long, opened boolean"
    todo, dealt_by = table, F.xxhash64("doc_id", "salt")
    done: list[DataFrame] = []
    for level in count():
        groups = max(1, -(-todo.count() // group_pieces))
        last = groups == 1
        packed = todo.withColumn("g", F.pmod(dealt_by, F.lit(groups))).groupBy("g").applyInArrow(packer(names, width, level, last), schema)
        if last:
            done.append(packed)
            break
        packed = cut_lineage(packed)
        done.append(packed.where("NOT opened"))
        todo, dealt_by = packed.where("opened").drop("offset", "opened"), F.xxhash64("sequence_id")
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.drop("opened")


def best_fit_packing(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Pieces of all documents with their place: sequence_id and offset."""
    return pack(pieces(docs, width), width)
