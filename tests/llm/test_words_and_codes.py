"""Periodic runs, alignment of two tokenizers and byte-level coding against plain versions and the public libraries."""

import bisect
import collections
import hashlib
import os
import random
import re
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_llm import SCHEMA, odd_rows  # noqa: E402

from shopledger.llm import align, bytebpe, common, runs  # noqa: E402
from shopledger.llm.queries import QUERIES  # noqa: E402


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    extra = [
        (40, "la " * 7 + "end", "en", "s", 1, "c", "s", "x"), (41, "a b " * 9, "en", "s", 1, "c", "s", "x"), (42, "x" * 3000 + " " + "ab" * 900, "en", "s", 1, "c", "s", "x"),
        (43, "I'll we've 'tis don't  a\t\tb \n\n c　d 12x3 ²Ⅷ 漢字\U0001f642!? \x1c\x85", "en", "s", 1, "c", "s", "x"), (44, "x▁y", "en", "s", 1, "c", "s", "x"),
    ]
    return spark.createDataFrame([*odd_rows(), *extra], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect() if r.doc_id is not None]


# Periodic runs


def plain_runs(w, least=6, repeats=4):
    """Every stretch that agrees with itself q words on, for every q."""
    number = {x: k for k, x in enumerate(dict.fromkeys(w))}
    v = np.array([number[x] for x in w], np.int64)
    out, seen = [], collections.defaultdict(list)
    for q in range(1, len(w) // repeats + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[False], v[:-q] == v[q:], [False]]).astype(np.int8)))
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if j + q - i >= max(least, repeats * q) and not any(q % p == 0 for p in seen[i, j + q]):
                seen[i, j + q].append(q)
                out.append((i, j + q - i, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_run_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if found else None
    return (
        doc_id, n, len(found), len(gone), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def test_runs_of_random_words():
    rng = random.Random(3)
    for _ in range(150):
        docs = []
        for _ in range(rng.randrange(1, 8)):
            n, k = rng.choice([0, 1, 5, 6, 7, 30, 200]), rng.choice([1, 2, 3, 50])
            d = [rng.randrange(k) for _ in range(n)]
            if n > 20 and rng.random() < 0.6:
                a, p = rng.randrange(n - 5), rng.randrange(1, 12)
                d = [d[i] if i < a else d[a + (i - a) % p] for i in range(n)]
                if rng.random() < 0.5:
                    d[rng.randrange(n)] = 99
            docs.append(d)
        code = np.array([x for d in docs for x in d], np.int64)
        bounds = np.cumsum([0] + [len(d) for d in docs])
        if len(code):
            assert runs.runs_of(code, bounds) == [plain_runs(d) for d in docs]
            assert runs.runs_of(code, bounds, 2, 2) == [plain_runs(d, 2, 2) for d in docs]


def test_runs_query_against_plain_version(spark, sf):
    docs = texts_of(spark.read.parquet(f"{sf}/documents.parquet"))
    got = rows_of(QUERIES["op11_periodic_runs"][0](spark, sf))
    assert got == sorted(plain_run_row(i, t) for i, t in docs)
    assert sum(r[2] for r in got) > 10


def test_runs_of_odd_rows(odd, none):
    assert rows_of(runs.run_report(odd, source=runs.repeated_source)) == sorted(plain_run_row(i, t) for i, t in texts_of(odd))
    assert runs.run_report(none).collect() == []


def test_blocks_do_not_change_runs(odd, monkeypatch):
    whole = rows_of(runs.run_report(odd))
    ids, texts = zip(*texts_of(odd), strict=True)
    data, offsets = common.text_bytes(pa.array(texts))
    _, _, doc = common.words(data, offsets)
    bounds = np.searchsorted(doc, np.arange(len(ids) + 1))
    monkeypatch.setattr(runs, "BLOCK_WORDS", 50)
    cuts = list(runs.blocks(bounds))
    assert len(cuts) > 2 and cuts[0][0] == 0 and cuts[-1][1] == len(ids) and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:], strict=False))
    assert len(whole) == len(ids)


# Alignment


def plain_alignment(docs):
    """Rows as the contract states them, token by token."""
    a_model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a_bytes, b_bytes = align.byte_level(a_model), align.piece_bytes(b_model)
    links, shape = [], []
    for _, text in docs:
        a, b = (a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)) if text else ([], [])
        want = (" " + text).encode()
        if not text or b"".join(a_bytes[i] for i in a) != want or b"".join(b_bytes[i] for i in b) != want:
            a, b = [], []
        a_end, b_end = np.cumsum([len(a_bytes[i]) for i in a]).tolist(), np.cumsum([len(b_bytes[i]) for i in b]).tolist()
        cut = sorted(set(a_end) & set(b_end))
        groups = [([], []) for _ in cut]
        for side, ids, ends in ((0, a, a_end), (1, b, b_end)):
            for i, e in zip(ids, ends, strict=True):
                groups[bisect.bisect_left(cut, e)][side].append(i)
        spans = [[(e - len(t[i]), e) for i, e in zip(ids, ends, strict=True)] for t, ids, ends in ((a_bytes, a, a_end), (b_bytes, b, b_end))]
        overlaps, k = 0, 0
        for s, e in spans[0]:
            while k and spans[1][k][0] > s:
                k -= 1
            m = k
            while m < len(spans[1]) and spans[1][m][0] < e:
                overlaps += spans[1][m][1] > s
                k, m = m, m + 1
        links.append(collections.Counter((x, y) for g in groups for x in g[0] for y in g[1]))
        shape.append((len(a), len(b), len(groups), overlaps, ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)))
    count = collections.Counter(p for c in links for p in c)
    most = collections.defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    return sorted(
        (i, na, nb, ng, no, sum(c.values()), sum(n for p, n in c.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in c.items()), sha(line) if na else "")
        for (i, _), c, (na, nb, ng, no, line) in zip(docs, links, shape, strict=True)
    )


def test_alignment_query_against_plain_version(spark, sf):
    got = rows_of(QUERIES["op12_cross_tokenizer_alignment"][0](spark, sf))
    assert got == plain_alignment(texts_of(spark.read.parquet(f"{sf}/documents.parquet")))
    assert any(r[6] < r[5] for r in got)


def test_alignment_of_odd_rows(odd, none, monkeypatch):
    monkeypatch.setattr(align, "PAIRS_A_BUCKET", 40)  # many buckets
    monkeypatch.setattr(align, "ENTRIES_AT_ONCE", 1000)  # does not reach the workers
    got = rows_of(align.alignment_report(odd))
    assert got == plain_alignment(texts_of(odd))
    assert {r[0]: r[1] for r in got}[44] == 0  # U+2581 is not spelled by B
    assert align.alignment_report(none).collect() == []


def test_row_products_against_dense_ones(monkeypatch):
    rng = np.random.default_rng(4)
    for limit in (1, 7, 1 << 20):
        monkeypatch.setattr(align, "ENTRIES_AT_ONCE", limit)
        x, y = rng.integers(0, 3, (9, 6)) * rng.integers(0, 2, (9, 6)), rng.integers(0, 3, (6, 8)) * rng.integers(0, 2, (6, 8))
        sparse = [align.Rows.of(*np.nonzero(m), m[np.nonzero(m)], len(m)) for m in (x, y)]
        out = np.zeros((9, 8), int)
        for row, column, value in sparse[0].product(sparse[1]):
            out[row, column] += value
        assert (out == x @ y).all()
    got = [tuple(map(int, r)) for part in align.overlap_links(np.array([2, 3]), np.array([1, 3, 1])) for r in zip(*part, strict=True)]
    assert got == [(0, 0, 1), (0, 1, 1), (1, 1, 2), (1, 2, 1)]


# Byte-level coding


@pytest.fixture(scope="module")
def published():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.codec().ranks, special_tokens={})


def code_row(published, doc_id, text):
    ids = published.encode_ordinary(text)
    return doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(text)


def test_perfect_hash_is_minimal():
    for keys in ([], [b"a"], [b"", b"a", b"ab"], [str(i).encode() for i in range(3000)]):
        table = bytebpe.PerfectHash(keys)
        column = pa.array([*keys, b"no", b"zz"], pa.large_binary())
        found = table.slots(*bytebpe.bytes_of(column))
        assert found.tolist() == [*range(len(keys)), -1, -1]
        assert sorted(table.owner.tolist()) == list(range(len(keys)))
    assert len(np.unique(bytebpe.codec().table.owner)) == len(bytebpe.codec().ranks)
    with pytest.raises(ValueError):
        bytebpe.PerfectHash([b"a", b"a"])


def test_codes_of_random_texts(published):
    rng = random.Random(7)
    signs = ["a", "s", "t", "re", "ll", " ", "  ", "\n", "\t", "'", "'s", "'ll", "'re", "'ve", "'m", "'d", "1", "23", "é", "漢字", "!", "?!", " ", "　", "🙂", "é", "\x1c", "\x00", "\x85", "²", "Ⅷ", "д", "ع", "_", "’", "S", "ſ", "﻿", "​", "<|endoftext|>"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 14))) for _ in range(8000)] + ["", " ", "x" * 5000, " " * 700, "".join(rng.choice("abc") for _ in range(4000))]
    data, offsets = common.text_bytes(pa.array(texts))
    own = bytebpe.codec()
    ids, cuts = own.encode(data, offsets)
    assert [ids[i:j].tolist() for i, j in zip(cuts, cuts[1:], strict=False)] == [published.encode_ordinary(t) for t in texts]
    back, at = own.decode(ids, cuts)
    assert back.tobytes() == data.tobytes() and (at == offsets).all()
    with pytest.raises(KeyError):
        own.decode(np.array([own.limit]), np.array([0, 1]))


def test_coding_query_against_published_library(spark, sf, published):
    got = rows_of(QUERIES["op13_byte_bpe_coding"][0](spark, sf))
    assert got == sorted(code_row(published, i, t) for i, t in texts_of(spark.read.parquet(f"{sf}/documents.parquet")))


def test_coding_of_odd_rows(odd, none, published):
    assert rows_of(bytebpe.coding_report(odd)) == sorted(code_row(published, i, t) for i, t in texts_of(odd))
    assert rows_of(bytebpe.decoded(bytebpe.encoded(odd))) == sorted(texts_of(odd))
    assert bytebpe.coding_report(none).collect() == [] and bytebpe.encoded(none).collect() == []


def test_spellings_are_dropped_when_the_table_is_full(monkeypatch):
    monkeypatch.setattr(bytebpe, "KEPT_SPELLINGS", 3)
    own = bytebpe.Codec(bytebpe.codec().ranks)
    first = [own.miss(f"qzx{i}w".encode()) for i in range(20)]
    assert len(own.recent) <= 3 and len(own.older) <= 3
    assert first == [own.miss(f"qzx{i}w".encode()) for i in range(20)]
