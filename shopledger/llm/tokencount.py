"""Token counts by dynamic programming that a trie of pre-tokens shares (operator 7).

A vocabulary piece of rank r has the unigram log-probability of Zipf's law,
-ln((r + 1) * sum of 1/k); a character outside the vocabulary costs one byte
token of the lowest rank for each of its bytes. The distinct pre-tokens of a
batch (words with a leading mark) are walked in sorted order, which is the
depth-first order of their trie: forward scores stand on the path from the root,
so each shared prefix is computed once, and a terminal stores its count. Tasks
keep the counts of words they have met, up to a fixed number.

Null or empty text: no words, no tokens. Empty table: no rows. Repeated rows are
counted each. Of equal scores the one with fewer tokens wins. Long words and
texts are taken whole.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import DataFrame

from shopledger.llm.common import id_and_text, record_batch

MODEL = "piece_bpe_32k.model"
MARK = "▁"
KEPT_WORDS = 400_000


@lru_cache(maxsize=2)
def vocabulary(name: str = MODEL) -> tuple[dict[str, float], dict[str, tuple[int, ...]], float]:
    """piece -> log-probability, last two characters -> lengths of such pieces, and the cost of a byte token."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    n = model.get_piece_size()
    plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    harmonic = sum(1 / k for k in range(1, n + 1))
    scores = {model.id_to_piece(i): -math.log((r + 1) * harmonic) for r, i in enumerate(plain)}
    lengths: dict[str, set[int]] = {}
    for piece in scores:
        lengths.setdefault(piece[-2:], set()).add(len(piece))
    return scores, {k: tuple(sorted(v)) for k, v in lengths.items() if len(k) == 2}, -math.log(n * harmonic)


def trie_counts(new: list[str], scores: dict[str, float], lengths: dict[str, tuple[int, ...]], byte_cost: float) -> dict[str, tuple[int, float]]:
    """word -> (tokens, score) of its best segmentation; forward scores are shared along common prefixes."""
    out: dict[str, tuple[int, float]] = {}
    get = scores.get
    best, tokens, before = [0.0], [0], ""
    for word in sorted(new):
        s = MARK + word
        shared, most = 0, min(len(s), len(before))
        while shared < most and s[shared] == before[shared]:
            shared += 1
        del best[shared + 1 :], tokens[shared + 1 :]
        for i in range(shared + 1, len(s) + 1):
            c = s[i - 1]
            p = get(c)
            width = 1 if p is not None else len(c.encode("utf-8", "surrogatepass"))
            top, count = best[i - 1] + (p if p is not None else width * byte_cost), tokens[i - 1] + width
            for n in lengths.get(s[i - 2 : i], ()) if i > 1 else ():
                if n <= i:
                    p = get(s[i - n : i])
                    if p is not None:
                        x = best[i - n] + p
                        if x > top or (x == top and tokens[i - n] + 1 < count):
                            top, count = x, tokens[i - n] + 1
            best.append(top)
            tokens.append(count)
        out[word] = tokens[-1], best[-1]
        before = s
    return out


def token_counts(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_words, n_tokens and the natural-log score of the best segmentation."""
    schema = "doc_id long, n_words long, n_tokens long, score double"

    def run(batches):
        scores, lengths, byte_cost = vocabulary(model)
        known: dict[str, tuple[int, float]] = {}
        for batch in batches:
            texts = [t.as_py().split() for t in batch.column(1)]
            new = set().union(*texts) - known.keys()
            if len(known) + len(new) > KEPT_WORDS:
                known = {}
                new = set().union(*texts)
            known.update(trie_counts(list(new), scores, lengths, byte_cost))
            counts, sums = [], []
            for words in texts:
                pairs = [known[w] for w in words]
                counts.append(sum([p[0] for p in pairs]))
                sums.append(math.fsum([p[1] for p in pairs]))
            yield record_batch(schema, (batch.column(0), [len(w) for w in texts], counts, sums))

    return id_and_text(docs).mapInArrow(run, schema)
