"""Benchmark decontamination by pigeonhole edit matching (operator 9).

An item of n characters may be met with up to ``rate`` * n errors. Cut into one
piece more than that, at least one piece occurs without error, so exact hits of
the pieces (one automaton for a block of items) give every place to look at; a
bit-parallel edit distance then decides. Texts and items are compared in lower
case with single spaces.

Items are taken in blocks of bounded size, one pass over the texts for each; the
usual benchmark is one block. Null or empty items match nothing; null or empty
texts are clean. Items with equal text all match. Repeated rows are judged each.
Empty tables: all documents clean, or no rows. Texts are searched whole.
"""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopledger.llm.common import id_and_text, prepare, record_batch

RATE_PERCENT = 8
BLOCK_CHARS = 4 << 20


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS):
    """Lists of (item_id, normal text) of at most ``block_chars`` characters, or one longer item."""
    block, size = [], 0
    for row in benchmark.where("text IS NOT NULL AND item_id IS NOT NULL").selectExpr("cast(item_id AS long) AS item_id", "text").toLocalIterator():
        text = normal(row["text"])
        if not text:
            continue
        if block and size + len(text) > block_chars:
            yield tuple(block)
            block, size = [], 0
        block.append((row["item_id"], text))
        size += len(text)
    if block:
        yield tuple(block)


def piece_cuts(n: int, errors: int) -> list[int]:
    return [n * k // (errors + 1) for k in range(errors + 2)]


@lru_cache(maxsize=2)
def matcher(block: tuple, percent: int):
    """Automaton of all pieces: piece -> (length, [(item number, offset in the item)])."""
    import ahocorasick

    where: dict[str, list[tuple[int, int]]] = {}
    for k, (_, text) in enumerate(block):
        cuts = piece_cuts(len(text), min(len(text) * percent // 100, len(text) - 1))
        for i, j in zip(cuts, cuts[1:], strict=False):
            where.setdefault(text[i:j], []).append((k, i))
    automaton = ahocorasick.Automaton()
    for piece, places in where.items():
        automaton.add_word(piece, (len(piece), places))
    automaton.make_automaton()
    return automaton


def distances(pattern: str, text: str):
    """For each place of the text the least distance of the pattern to a substring that ends there.

    The columns of the distance table are bit vectors of vertical steps up and down.
    """
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(pattern)) - 1
    top = 1 << (len(pattern) - 1)
    up, down, distance = full, 0, len(pattern)
    for c in text:
        equal = masks.get(c, 0)
        diagonal = (((equal & up) + up) ^ up) | equal | down
        right_up = down | ~(diagonal | up) & full
        right_down = up & diagonal
        if right_up & top:
            distance += 1
        elif right_down & top:
            distance -= 1
        right_up = right_up << 1 & full
        right_down = right_down << 1 & full
        up = right_down | ~(diagonal | right_up) & full
        down = right_up & diagonal
        yield distance


def edit_search(pattern: str, text: str, limit: int) -> tuple[int, int] | None:
    """Least distance of the pattern to a substring of the text, and that substring's end; None beyond the limit."""
    return min(edit_hits(pattern, text, limit), default=None)


def edit_hits(pattern: str, text: str, limit: int) -> list[tuple[int, int]]:
    """(distance, end) of every separated hit: the least distance, first place, of each stretch of ends within the limit."""
    out, best = [], None
    for k, distance in enumerate(distances(pattern, text)):
        if distance <= limit:
            if best is None or distance < best[0]:
                best = (distance, k + 1)
        elif best is not None:
            out.append(best)
            best = None
    return out if best is None else [*out, best]


def matches(text: str, block: tuple, percent: int, first_only: bool = False) -> list[tuple[int, int, int, int]]:
    """(item_id, start, end, distance) in the normal text; one for each separated hit of an item."""
    text = normal(text)
    windows: dict[int, set[int]] = {}
    for end, (n, places) in matcher(block, percent).iter(text):
        for k, offset in places:
            windows.setdefault(k, set()).add(end + 1 - n - offset)
    out = []
    for k in sorted(windows):
        item_id, item = block[k]
        limit = len(item) * percent // 100
        low = high = None
        spans = []
        for diagonal in sorted(windows[k]):
            i, j = max(0, diagonal - limit), min(len(text), diagonal + len(item) + limit)
            if high is not None and i <= high:
                high = max(high, j)
            else:
                spans.append((low, high))
                low, high = i, j
        spans.append((low, high))
        for i, j in spans[1:]:
            for distance, end in edit_hits(item, text[i:j], limit):
                back = edit_search(item[::-1], text[max(i, i + end - len(item) - distance) : i + end][::-1], distance)
                out.append((item_id, i + end - (back[1] if back else len(item)), i + end, distance))
                if first_only:
                    return out
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, percent: int = RATE_PERCENT) -> DataFrame:
    """(doc_id, item_id, start, end, distance) for every match."""
    schema = "doc_id long, item_id long, start long, end long, distance int"

    def finder(block):
        def run(batches):
            for batch in batches:
                rows = [(i, *m) for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for m in matches(text.as_py(), block, percent)]
                if rows:
                    yield record_batch(schema, zip(*rows, strict=True))

        return run

    texts = id_and_text(docs)
    found = [texts.mapInArrow(finder(block), schema) for block in item_blocks(benchmark)]
    return reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], schema)


def document_report(docs: DataFrame, benchmark: DataFrame, percent: int = RATE_PERCENT) -> DataFrame:
    """doc_id, contaminated, n_matches, item_ids (ascending) and least distance for each row, judged where it is read."""
    schema = "doc_id long, text string, n_matches long, item_ids array<long>, least_distance int"
    none = F.lit(None).cast("int").alias("least_distance")
    rows = id_and_text(docs).select("doc_id", "text", F.lit(0).cast("long").alias("n_matches"), F.array().cast("array<long>").alias("item_ids"), none)
    blocks = list(item_blocks(benchmark))
    for place, block in enumerate(blocks, 1):

        def run(batches, block=block, last=place == len(blocks)):
            for batch in batches:
                ids, texts, counts, items, least = (batch.column(k).to_pylist() for k in range(5))
                for k, text in enumerate(texts):
                    found = matches(text, block, percent)
                    if found:
                        counts[k] += len(found)
                        items[k] = sorted({*items[k], *(m[0] for m in found)})
                        least[k] = min(m[3] for m in found) if least[k] is None else min(least[k], *(m[3] for m in found))
                yield record_batch(schema, (ids, [None] * len(ids) if last else texts, counts, items, least))

        rows = rows.mapInArrow(run, schema)
    return rows.select("doc_id", (F.col("n_matches") > 0).alias("contaminated"), "n_matches", "item_ids", "least_distance")


def clean_rows(docs: DataFrame, benchmark: DataFrame, percent: int = RATE_PERCENT) -> DataFrame:
    """The rows of ``docs`` without a match, with all their columns; no row is moved."""
    prepare(docs.sparkSession)
    for block in item_blocks(benchmark):

        def run(batches, block=block):
            for batch in batches:
                clean = [not matches(t or "", block, percent, first_only=True) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
                yield batch.filter(record_batch("k boolean", (clean,)).column(0))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
