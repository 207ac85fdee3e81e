"""Operators of the corpus subpackage against plain versions, and odd inputs."""

import collections
import hashlib
import itertools
import math
import os
import random
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from shopledger.llm import components, ctw, decontam, licenses, neardup, packing, quality, suffix, tokencount, tokenio, tokens, topk  # noqa: E402

LONG = " ".join(f"w{i % 977}" for i in range(9000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, score string, id string"


def odd_rows():
    rng = random.Random(5)
    base = [rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]) + str(rng.randrange(40)) for _ in range(80)]
    near = base[:70] + ["x"] + base[71:]
    texts = [None, "", " ", "one", "One two", "one TWO", " ".join(base), " ".join(base), " ".join(near), "pre " + " ".join(base[20:60]) + " post", LONG, LONG + " end", "é ü\n漢字 text\n\nlast", "a\x00b <|endoftext|> c  d", "Released under the MIT License."]
    rows = [(i, t, "en", None if i % 5 == 0 else "src0", len(t or ""), "c", "s", "x") for i, t in enumerate(texts)]
    return [*rows, rows[6], (None, "no id " + " ".join(base), None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 0), (6, 1, 0), (10, 1, None), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    item = " ".join(odd_rows()[6][1].split()[20:50])
    return spark.createDataFrame([(1, item), (2, None), (3, ""), (None, "one"), (4, item)], "item_id long, text string")


def known(rows):
    return [(r[0], r[1]) for r in rows if r[0] is not None]


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_search_against_brute_force(spark, sf, odd, none):
    docs = documents(spark, sf)
    got = {}
    for r in topk.top_k(docs.where("doc_id % 10 = 0"), docs).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    want = brute.search(texts_of(docs), every=10)
    assert got.keys() == {q for q, hits in want.items() if hits}
    for q, hits in got.items():
        assert [d for d, _ in hits] == [d for _, d in want[q]]
        assert all(math.isclose(s, -w, abs_tol=1e-6) for (_, s), (w, _) in zip(hits, want[q], strict=True))
    assert {r.query_id for r in topk.top_k(odd, odd, k=3).collect()} == {i for i, t in known(odd_rows()) if t and t.split()}
    assert topk.top_k(none, none).count() == 0


def test_pruned_search_equals_full_search():
    rng = np.random.default_rng(3)
    terms, docs, rows = 40, 700, []
    for t in range(terms):
        d = np.sort(rng.choice(docs, rng.integers(1, docs), replace=False))
        rows.append((d, rng.integers(1, 9, len(d))))
    starts = np.concatenate([[0], np.cumsum([len(d) for d, _ in rows])])
    row = {"ids": np.arange(docs, dtype=np.int64).tobytes(), "length": topk.packed(rng.integers(5, 50, docs)), "terms": topk.packed(np.arange(terms, dtype=np.uint64)), "starts": topk.packed(starts.astype(np.uint32)), "docs": topk.packed(np.concatenate([d for d, _ in rows]).astype(np.uint32)), "tfs": topk.packed(np.concatenate([f for _, f in rows]).astype(np.uint32))}
    shard = topk.Shard(row, np.arange(terms, dtype=np.uint64), rng.random(terms) * 5, 20.0)
    query = np.arange(0, terms, 2)
    doc, score = shard.search(query, 0.0)
    for least in np.quantile(score, [0.5, 0.9, 0.99, 1.0]):
        got, s = shard.search(query, float(least))
        keep = score >= least - 1e-6
        assert got.tolist() == doc[keep].tolist() and np.allclose(s, score[keep])


def test_licenses(spark, none):
    files = spark.createDataFrame(
        [(1, "a/LICENSE", True, "x\nReleased under the MIT License."), (2, "a/b/f", False, "the code"), (3, "a/b/g", False, "  licensed under the Apache License, Version 2.0.\nthe end"), (4, "a/c/LICENSE", True, "All rights reserved."), (5, "a/c/d/e", False, None), (6, None, False, ""), (7, "z", False, "Licensed under the moon"), (7, "z", False, "Licensed under the moon")],
        "file long, path string, is_licence_file boolean, text string",
    )
    got = sorted((r.file, r.own_license, r.license, r.from_path) for r in licenses.license_scan(files).collect() if r.file)
    assert got == [(1, "MIT", "MIT", "a/LICENSE"), (2, None, "MIT", "a"), (3, "Apache-2.0", "Apache-2.0", "a/b/g"), (4, "Proprietary", "Proprietary", "a/c/LICENSE"), (5, None, "Proprietary", "a/c"), (6, None, None, None), (7, None, None, None), (7, None, None, None)]
    assert licenses.license_scan(licenses.document_files(none)).count() == 0


def licences_by_all_units(files):
    """{file: licence} by the definition: every run and stretch, each cosine from whole vectors."""
    lines = {i: [licenses.plain(x) for x in (t or "").replace("\t", " ").replace("\r", " ").split("\n")] for i, t in files}
    total = sum(len(v) for i, v in lines.items() if dict(files)[i] is not None)
    df = collections.Counter(w for v in lines.values() for ws in v for w in set(ws))
    weight = lambda w: 1 + math.log((1 + total) / (1 + df[w]))
    vector = lambda ws: {w: n * weight(w) for w, n in collections.Counter(ws).items()}
    dot = lambda x, y: sum(v * y[w] for w, v in x.items() if w in y)
    cosine = lambda x, y: round(dot(x, y) / math.sqrt(dot(x, x)) / math.sqrt(dot(y, y)), 9)
    short = [(n, t, 1) for n, t in [*sorted(licenses.TEMPLATES.items()), *licenses.HEADERS]]
    out = {}
    for name, text, order in [*short, *[(n, t, 0) for n, t in licenses.full_texts()]]:
        t = vector(licenses.plain(text))
        length = len(licenses.plain(text))
        for i, v in lines.items():
            v = [ws for ws in v if ws]
            at = [n for n, ws in enumerate(v) if set(ws) & t.keys()]
            place = [0, *itertools.accumulate(map(len, v))]
            if order:
                units = [(s, e) for s in at for e in at if s <= e and (s == e or place[e + 1] - place[s] <= licenses.SPAN * length)]
            elif at:
                near = [(s, max(e for e in at if e >= s and place[e] - place[s] < length)) for s in at]
                units = [(0, len(v) - 1), max(near, key=lambda u: (round(dot(vector(sum((v[n] for n in at if u[0] <= n <= u[1]), [])), t) / math.sqrt(dot(t, t)), 9), -u[0]))]
            else:
                units = []
            for s, e in units:
                c = cosine(vector(sum(v[s : e + 1], [])), t)
                if c >= licenses.THRESHOLD:
                    out.setdefault(i, []).append((order, -c, name))
    return {i: (min(v)[2], -min(v)[1]) for i, v in out.items()}


def test_licenses_against_all_units(spark, sf):
    mit = dict(licenses.full_texts())["MIT"]
    body = mit[mit.index("Permission") :]
    gpl = dict(licenses.HEADERS[::-1])["GPL-3.0"], [t for n, t in licenses.HEADERS if n == "GPL-3.0"][1]
    narrow = lambda text, n: "\n".join("# " + " ".join(text.split()[k : k + n]) for k in range(0, len(text.split()), n))
    planted = [
        "import x\n\n" + "\n".join(" * " + line for line in body.split("\n")) + "\n\n" + "\n".join(f"value{k} = call{k % 7}(arg{k})" for k in range(80)),
        "start of code\n" + narrow(gpl[1], 3) + "\nend of code",
        narrow(body, 2), "Licensed under\nthe\n\nApache\nLicense,\nVersion 2.0.\nAll rights\nreserved, all wrongs avenged by the others",
        "All rights reserved.\n" * 30, "licensed under the moon\n" * 40, "the\tLicense\rof all", "", None,
    ]
    files = texts_of(documents(spark, sf).limit(150)) + [(10**6 + k, t) for k, t in enumerate(planted)]
    got = licenses.own_licences(spark.createDataFrame(files, "file long, text string")).collect()
    want = licences_by_all_units(files)
    assert {r.file: r.own_license for r in got} == {i: name for i, (name, _) in want.items()}
    assert all(r.cosine == pytest.approx(want[r.file][1], abs=2e-9) for r in got)
    assert [want.get(10**6 + k, (None,))[0] for k in range(4)] == ["MIT", "GPL-3.0", "MIT", "Apache-2.0"]
    assert len(want) > 5


def test_license_titles_of_other_files_and_odd_columns(spark):
    text = "Attribution 4.0 International\n\n=====\n\nCreative Commons Attribution 4.0 International Public License\n\nBy exercising the Licensed Rights You accept\n"
    rows = [(1, "a/LICENSE", True, text, "mine", 0.5, "d", 7, "r"), (2, "a/b/f", False, "code", "mine", 0.5, "d", 8, None)] + [(9 + k, f"c/{k}", False, f"plain {k}", None, None, None, None, None) for k in range(30)]
    files = spark.createDataFrame(rows, "file long, path string, is_licence_file boolean, text string, license string, cosine double, directory string, row int, extra string")
    out = licenses.license_scan(files)
    assert out.columns == ["file", "path", "is_licence_file", "directory", "row", "extra", "own_license", "cosine", "license", "from_path"]
    got = {r.file: (r.license, r.from_path, r.directory, r.row, r.extra) for r in out.collect()}
    assert (got[1], got[2], got[9]) == (("CC-BY-4.0", "a/LICENSE", "d", 7, "r"), ("CC-BY-4.0", "a", "d", 8, None), (None,) * 5)


def test_license_lines_of_rare_words_are_far_from_templates(spark):
    rare = " ".join(f"rare{k}" for k in range(15))
    files = spark.createDataFrame([(1, f"All rights reserved {rare}"), (2, "All rights reserved.")] + [(k, f"plain line {k}") for k in range(3, 40)], "file long, text string")
    assert [(r.file, r.own_license) for r in licenses.own_licences(files).collect()] == [(2, "Proprietary")]


def test_license_files_and_wrapped_headers(spark):
    full = dict(licenses.full_texts())
    assert all(len(text) > 900 for text in full.values())
    wrapped = {100: ("GPL-3.0", "code\n# This work is licensed under the GNU General\n# Public License, version 3.\nmore code"), 101: ("Apache-2.0", "x = 1\n\n# Licensed under the Apache License,\n# Version 2.0.\ny = 2")}
    rows = [(k, f"d{k}/LICENSE", True, "Copyright (c) 2020 A. Person\nAll rights reserved.\n\n" + full[name]) for k, name in enumerate(licenses.FULL)]
    rows += [(10 + k, f"d{k}/src/f", False, f"ordinary code {k}") for k in range(len(licenses.FULL))]
    rows += [(k, f"e/{k}", False, text) for k, (_, text) in wrapped.items()] + [(200 + k, f"g/{k}", False, f"plain line {k}\nof no licence") for k in range(60)]
    files = spark.createDataFrame(rows, "file long, path string, is_licence_file boolean, text string")
    got = {r.file: r.license for r in licenses.license_scan(files).collect()}
    want = {10 * j + k: name for k, name in enumerate(licenses.FULL) for j in (0, 1)} | {k: name for k, (name, _) in wrapped.items()}
    assert got == want | {200 + k: None for k in range(60)}


def test_tokens_equal_the_tokenizer(spark, sf):
    own = tokens.encoder()
    texts = [t for _, t in texts_of(documents(spark, sf))] + [t or "" for _, t in known(odd_rows())] + ["it's  we'LL", "x 　y", "² ½", "tail ", "\ttab"]
    for t in texts:
        assert own.ids(t).tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("which", ["odd", "sf"])
def test_packing_round_trip(spark, sf, odd, which):
    docs = odd if which == "odd" else documents(spark, sf)
    rows = packing.best_fit_packing(docs).collect()
    own, bins, pieces = tokens.encoder(), {}, {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
    for spans in bins.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= packing.WIDTH
    total = sum(r.length for r in rows)
    assert len(bins) <= -(-total // packing.WIDTH) * 1.05 + 1
    for i, t in texts_of(docs):
        if i is None:
            continue
        ids = np.append(own.ids(t or ""), 0).astype("<u4")
        mine = {p.piece: p for p in pieces[i]}
        assert sum(p.length for p in mine.values()) == len(ids)
        for p in mine.values():
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
            assert p.length == packing.WIDTH or p.piece == 0


def test_local_search_empties_bins_and_keeps_items():
    rng = random.Random(1)
    for _ in range(20):
        lengths = [rng.randrange(1, 90) for _ in range(60)]
        bins = [[i] for i in range(60)]
        out = packing.improve([list(b) for b in bins], lengths, 100)
        assert sorted(i for b in out for i in b) == list(range(60))
        assert all(sum(lengths[i] for i in b) <= 100 for b in out) and len(out) < 60


def test_local_search_ends_only_without_a_step():
    rng = random.Random(2)
    lengths = sorted((rng.randrange(400, 701) for _ in range(900)), reverse=True)
    bins = packing.best_fit(lengths, 2048)
    out = packing.improve([list(b) for b in bins], lengths, 2048)
    assert sorted(i for b in out for i in b) == list(range(900))
    assert len(out) <= 0.96 * len(bins) and len(out) > -(-sum(lengths) // 2048)
    sizes = [sorted(lengths[i] for i in b) for b in out]
    fill = [sum(b) for b in sizes]
    ones = [{0, *b} for b in sizes]
    twos = [{x + y for k, x in enumerate(b) for y in b[:k]} for b in sizes]
    for a in range(len(out)):
        for b in range(len(out)):
            if a != b:
                for s, n in [(s, n) for s in ones[a] for n in ones[b]] + [(s, n) for s in twos[a] for n in ones[b]]:
                    f, e = fill[a] - s + n, fill[b] + s - n
                    assert max(f, e) > 2048 or f * f + e * e <= fill[a] ** 2 + fill[b] ** 2


def test_all_underfull_bins_are_opened_for_the_next_level(spark):
    rng = random.Random(3)
    rows = [(i, 0, 0, rng.randrange(600, 1001), 0, i) for i in range(3000)]
    got = packing.pack(spark.createDataFrame(rows, packing.PIECES), group_pieces=600).collect()
    fill = {}
    for r in got:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert sorted(r.doc_id for r in got) == list(range(3000)) and max(fill.values()) <= 2048
    assert all(n * 100 >= 2048 * 99 for s, n in fill.items() if s >> 56 == 0)
    assert len(fill) < 0.99 * len(packing.best_fit([r[3] for r in rows], 2048))


def test_packing_in_many_groups(spark, none):
    rows = spark.range(5000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "1 + (id * 7919) % 2048 AS length", "0L AS ids_crc32", "id AS salt")
    got = packing.pack(rows, group_pieces=300).collect()
    assert len(got) == 5000 and len({r.doc_id for r in got}) == 5000
    fill = {}
    for r in got:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    together = packing.best_fit([r.length for r in got], 2048)
    assert max(fill.values()) <= 2048 and len(fill) <= 1.03 * len(together)
    assert packing.best_fit_packing(none).count() == 0


def test_quality_on_held_out_rows(spark, sf, odd, none, labels):
    folder = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.01")
    docs, marks = documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    got = quality.quality_scores(docs, marks).join(marks, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)
    small = quality.quality_scores(odd, labels).collect()
    assert len(small) == len(known(odd_rows())) and all(0 <= r.score <= 1 for r in small)
    assert all(r.score == 0.5 for r in quality.quality_scores(odd, labels.limit(0)).collect())
    assert quality.quality_scores(none, labels).count() == 0


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(2)
    e, t, first = rng.normal(size=9), rng.normal(size=(2, 2)), np.array([0, 4, 5])
    good, _, _ = quality.forward_backward(e, first, t)
    for i, j in ((0, 4), (4, 5), (5, 9)):
        weights = np.zeros((j - i, 2))
        for k in range(2 ** (j - i)):
            y = [(k >> b) & 1 for b in range(j - i)]
            w = math.exp(sum(e[i + b] * y[b] for b in range(j - i)) + sum(t[y[b - 1], y[b]] for b in range(1, j - i)))
            for b, v in enumerate(y):
                weights[b, v] += w
        assert np.allclose(good[i:j], weights[:, 1] / weights.sum(axis=1))


def test_near_duplicates_against_brute_force(spark, sf, odd, none):
    for docs, size in ((documents(spark, sf), 4), (odd, 4)):
        rows = known([(r[0], r[1]) for r in texts_of(docs)])
        want = brute.near(rows, size)
        got = neardup.near_duplicates(docs, size).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert neardup.near_duplicates(none).count() == 0


def test_index_keys_meet_within_the_limit():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 16, (200, neardup.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for i in range(200):
        b[i, rng.choice(neardup.SYMBOLS, neardup.LIMIT, replace=False)] ^= 1
    assert (neardup.index_keys(a) == neardup.index_keys(b)).any(axis=1).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (50, 70), (5, 5)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 70: 50, 100: 50}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_language_model(spark, sf, odd, none):
    rows = ctw.model_scores(documents(spark, sf)).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == documents(spark, sf).count() and sum(r.bits_per_byte for r in held) < 3.2 * len(held)
    words = [(i, brute.words(t)) for i, t in texts_of(documents(spark, sf))]
    train = [w for i, ws in words if zlib.crc32(str(i).encode()) % 5 != 1 for w in [*ws, None]]
    counts = {}
    for w in train:
        counts[w] = counts.get(w, 0) + 1
    base = {i: sum(math.log10((counts.get(w, 0) + 0.5) / (len(train) + 0.5 * (len(counts) + 1))) for w in [*ws, None]) for i, ws in words}
    assert all(r.train_tokens == len(train) and math.isclose(r.base_score, base[r.doc_id], rel_tol=1e-9) for r in rows)
    assert len(ctw.model_scores(odd).collect()) == len(known(odd_rows())) and ctw.model_scores(none).count() == 0


def test_context_tree_against_recursion():
    """Weighted probabilities of the root, by the recursive definition over all contexts."""
    text = np.frombuffer(b"abracadabra arcade", np.uint8)
    t = ctw.Text(np.array([0]), np.array([0, len(text)]), text)
    t.train = np.array([True])
    code, count = t.grams()

    def weighted(some, d, k, z):
        mine = [(c, n) for c, n in some if (c & 255) >> (8 - k) == z]
        n1 = sum(n for c, n in mine if c >> (7 - k) & 1)
        kt = float(ctw.log_kt(np.array([sum(n for _, n in mine) - n1]), np.array([n1]))[0])
        if d == ctw.DEPTH:
            return kt
        children = {}
        for c, n in mine:
            children.setdefault(c >> (8 * (ctw.DEPTH - d)) & 255, []).append((c, n))
        return float(np.logaddexp(kt, sum(weighted(x, d + 1, k, z) for x in children.values())) - ctw.LN2)

    tree = ctw.Tree(code, count, 0)
    some = [(int(c), int(n)) for c, n in zip(code, count, strict=True)]
    for k in range(8):
        _, _, w, _, number, _ = tree.level[0][k]
        for i, c in enumerate(code.tolist()):
            assert math.isclose(w[number[i]], weighted(some, 0, k, (c & 255) >> (8 - k)), rel_tol=1e-9)


def test_token_counts(spark, sf, odd, none):
    scores, _, byte_cost = tokencount.vocabulary()
    docs = odd
    got = {r.doc_id: r for r in tokencount.token_counts(docs).collect()}
    for i, t in known(odd_rows()):
        best = [brute.best_segmentation(w, scores, byte_cost) for w in (t or "").split()[:400]]
        if len((t or "").split()) <= 400:
            assert got[i].n_tokens == sum(b[1] for b in best) and math.isclose(got[i].score, math.fsum(b[0] for b in best), abs_tol=1e-9)
    assert tokencount.token_counts(documents(spark, sf)).agg(F.sum("n_words")).first()[0] == sum(len(t.split()) for _, t in texts_of(documents(spark, sf)))
    assert tokencount.token_counts(none).count() == 0


def test_passages_sorted_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    rows = rng.integers(97, 100, (9, suffix.LEFT + suffix.SPAN)).astype(np.uint8)
    context = rows[rng.integers(0, len(rows), 400)]
    changed = rng.integers(0, context.shape[1], len(context))
    context[np.arange(len(context)), changed] = rng.integers(97, 100, len(context))
    doc = rng.integers(0, 50, len(context))
    whole = suffix.seen_before(context, doc)
    monkeypatch.setattr(suffix, "SORTED_TOGETHER", 30)
    assert whole.any() and (suffix.seen_in_parts(context, doc) == whole).all()


def test_passages_against_brute_force(spark, sf, odd, none):
    for docs in (documents(spark, sf), odd.dropDuplicates(["doc_id"])):
        want = brute.passages(known(texts_of(docs)))
        got = suffix.passage_report(docs).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert suffix.passage_report(odd).count() == len(known(odd_rows())) and suffix.passage_report(none).count() == 0
    rest = suffix.without_repeats(odd)
    assert rest.columns == odd.columns and rest.count() == len(known(odd_rows()))


def test_blind_trie_orders_like_sorting():
    rng = random.Random(8)
    strings = list({bytes(rng.choice(b"ab") for _ in range(20)) for _ in range(300)})
    order, common = suffix.blind_trie(strings)
    out = [strings[i] for i in order]
    assert out == sorted(strings)
    assert common[1:] == [next(k for k in range(20) if x[k] != y[k]) for x, y in zip(out, out[1:], strict=False)]


def test_decontamination(spark, odd, none, benchmark):
    got = {r.doc_id: r for r in decontam.document_report(odd, benchmark).collect()}
    assert {i for i, r in got.items() if r.contaminated} == {6, 7, 8, 9}
    assert got[6].item_ids == [1, 4] and got[6].least_distance == 0
    assert {r.doc_id for r in decontam.clean_rows(odd, benchmark).collect()} == {0, 1, 2, 3, 4, 5, 10, 11, 12, 13, 14}
    assert decontam.document_report(none, benchmark).count() == 0
    assert decontam.document_report(odd, benchmark.limit(0)).where("contaminated").count() == 0


def test_suffixes_are_dealt_evenly():
    """Chosen suffixes have the least hashes of their windows; buckets must not follow those."""
    data = np.random.default_rng(2).integers(97, 123, 400_000).astype(np.uint8)
    _, h, _ = suffix.anchors(data, np.array([0, len(data)]))
    for bits in (6, 10):
        count = np.bincount((h >> np.uint64(suffix.HASH_BITS - bits)).astype(int), minlength=1 << bits)
        assert count.max() < 2 * count.mean() and len(count) == 1 << bits


def test_repeated_rows_and_items(spark, benchmark):
    """A row is judged by itself, an item that stands twice counts twice, and one row of an id stays."""
    item = " ".join(odd_rows()[6][1].split()[20:50])
    far = " ".join(f"filler{k}" for k in range(40))
    docs = spark.createDataFrame([(1, f"{item} {item} {item}"), (2, f"{item} {far} {item}"), (2, f"{item} {far} {item}"), (3, far), (3, f"{far} {item}"), (4, item + " x")], "doc_id long, text string")
    got = sorted((r.doc_id, r.contaminated, r.n_matches) for r in decontam.document_report(docs, benchmark).collect())
    assert got == [(1, True, 6), (2, True, 4), (2, True, 4), (3, False, 0), (3, True, 2), (4, True, 2)]  # two items of the benchmark are equal
    rows = spark.createDataFrame([(1, far, "b"), (1, far, "a"), (1, far, "b"), (2, far, "c"), (3, item, "d"), (3, item, "d")], "doc_id long, text string, source string")
    kept = neardup.one_of_each(rows)
    assert kept.columns == rows.columns and sorted(map(tuple, kept.collect())) == [(1, far, "a"), (3, item, "d")]


def test_edit_search_against_the_table():
    rng = random.Random(9)
    for _ in range(300):
        p = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 30)))
        t = "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 60)))
        least = brute.edit_distance_within(p, t)
        found = decontam.edit_search(p, t, len(p) - 1)
        assert (found[0] if found else len(p)) == min(least, len(p))


def test_planted_edits_are_found():
    rng = random.Random(10)
    item = decontam.normal(" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(30)))
    for _ in range(50):
        copy = list(item)
        for _ in range(len(item) * decontam.RATE_PERCENT // 100):
            copy[rng.randrange(len(copy))] = rng.choice("xyz")
        assert decontam.matches("before it " + "".join(copy) + " after", ((1, item),), decontam.RATE_PERCENT)


def test_matrices_round_trip(spark, odd, none):
    own, pieces = tokens.encoder(), {}
    for r in tokenio.packed_matrices(odd).collect():
        ids, position = np.frombuffer(r.input_ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        assert len(ids) == len(position) == tokenio.WIDTH and r.cu_seqlens[-1] == r.n_tokens
        for k, doc_id in enumerate(r.doc_ids):
            i, j = r.cu_seqlens[k], r.cu_seqlens[k + 1]
            assert position[i:j].tolist() == list(range(j - i))
            pieces.setdefault(doc_id, {})[r.starts[k]] = ids[i:j]
    for i, t in known(odd_rows()):
        assert np.concatenate([pieces[i][s] for s in sorted(pieces[i])]).tolist() == [*own.ids(t or "").tolist(), 0]
    assert tokenio.packed_matrices(none).count() == 0


def test_capacity_tree_takes_the_tightest_bin():
    rng = random.Random(11)
    tree, rooms = tokenio.CapacityTree(50), []
    for b in range(300):
        if rooms and rng.random() < 0.5:
            need = rng.randrange(1, 51)
            want = min((r for r in rooms if r >= need), default=None)
            got = tree.take(need)
            assert (got[0] if got else None) == want
            if want is not None:
                rooms.remove(want)
        else:
            room = rng.randrange(0, 51)
            tree.add(room, b)
            rooms.append(room)


def test_pipeline_stages(spark, sf):
    docs = documents(spark, sf)
    marks = spark.read.parquet(f"{sf}/labels.parquet")
    good = corpus_pipeline.quality_classifier(spark, docs, sf)
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    clean = {r.doc_id for r in marks.where("quality = 1").collect()}
    assert len(clean & kept) >= 0.98 * len(clean)
    single = corpus_pipeline.near_dedup(spark, docs, sf)
    assert {r.doc_id for r in single.collect()} == {i for i, (_, c) in brute.near(texts_of(docs), 5).items() if c == i}
    rows = corpus_pipeline.run(spark, sf)
    assert rows.count() > 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows.columns)


def test_stages_on_odd_repeated_and_no_rows(spark, sf, odd, none):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, sf)
        assert out.count() == 0
        assert out.columns == none.columns or name == "best_fit_packing"
    rows = odd_rows()
    good = corpus_pipeline.quality_classifier(spark, odd, sf)
    assert good.columns == odd.columns and {r.doc_id for r in good.collect()} <= {r[0] for r in rows}

    # One row of each group, the repeated row once, rows without an id in no group.
    groups = {i: c for i, (_, c) in brute.near(dict(known(rows)).items(), 5).items()}
    single = corpus_pipeline.near_dedup(spark, odd, sf)
    assert single.columns == odd.columns
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, c in groups.items() if c == i)

    # The repeated row has its own id, so none of its bytes goes for the other's sake.
    kept = {i: (n, sha) for i, (n, _, _, sha) in brute.passages(known(rows)).items()}
    cut = corpus_pipeline.passage_dedup(spark, odd, sf)
    assert cut.columns == odd.columns
    got = sorted((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in cut.collect() if r.doc_id is not None)
    assert got == sorted((i, kept[i][1]) for i, _ in known(rows))

    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 100").first().text
    told = odd.union(spark.createDataFrame([(77, f"before {item} after", "en", "s", 1, "c", "s", "x")], SCHEMA))
    clean = corpus_pipeline.decontamination(spark, told, sf)
    assert clean.columns == odd.columns
    assert sorted(r.doc_id for r in clean.where("doc_id IS NOT NULL").collect()) == sorted(i for i, _ in known(rows))
