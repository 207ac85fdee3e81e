"""Token ids of whole texts by a public byte-level tokenizer.

The vocabulary is published in two forms: a tokenizer file and the same merges
as ranks. Plain texts take the ranks with a split pattern free of look-ahead,
several times as fast. Texts with special tokens, runs of white space or
characters beyond the plain planes, where the two might cut differently, are
encoded by the tokenizer file. Tests hold the two against each other.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from shopledger.llm.common import id_and_text, record_batch

TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
END_ID = 0
# The vocabulary's published split without the rules for runs of white space.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
RUN, FOREIGN = re.compile(r"\s\s|\s$"), re.compile(r"[^\x00-\x7f¡-ɏ‐-‧€]")


class Encoder:
    def __init__(self, name: str, ranks: str | None):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.added = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = None
        if ranks:
            with open(public_tokenizers.path(ranks), "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.plain = tiktoken.Encoding("plain", pat_str=PIECES, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def odd(self, text: str) -> bool:
        return bool(RUN.search(text) or FOREIGN.search(text) or any(t in text for t in self.added))

    def ids(self, text: str) -> np.ndarray:
        """The ids of a whole text, without special tokens added."""
        if self.plain is None or self.odd(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.plain(text), "<u4")


@lru_cache(maxsize=2)
def encoder(name: str = TOKENIZER, ranks: str | None = RANKS) -> Encoder:
    return Encoder(name, ranks)


def encoded(docs: DataFrame, schema: str, rows, name: str = TOKENIZER, ranks: str | None = RANKS) -> DataFrame:
    """What ``rows(doc_id, ids)`` gives for each document; its ids end with the closing id 0."""
    def run(batches):
        own = encoder(name, ranks)
        end = np.array([END_ID], "<u4")
        for batch in batches:
            made = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                made.extend(rows(doc_id, np.concatenate([own.ids(text.as_py()), end])))
            if made:
                yield record_batch(schema, zip(*made, strict=True))

    return id_and_text(docs).mapInArrow(run, schema)
