"""Whitening, periodic runs and tree concatenation against plain versions."""

import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablehealth.llm import bidiagonal, bpe_tree, catalogue, encode, periodic, scan, whitening
from tests.llm import brute

WORD, BYTE = (encode.vocabulary_path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))
VECTORS = "vec_id long, embedding array<float>, label int, n long, component string"


# whitening


def _matrices():
    rng = np.random.default_rng(3)
    p, q = (np.linalg.qr(rng.standard_normal((40, 40)))[0] for _ in range(2))
    for d in (1, 2, 3, 17, 64):
        yield f"random {d}", rng.standard_normal((d, d))
        yield f"triangle {d}", np.triu(rng.standard_normal((d, d)))
    yield "identity", np.eye(30)
    yield "orthogonal", q
    yield "rank 3", q[:, :3] @ p[:3]
    yield "nothing", np.zeros((5, 5))
    yield "graded", q @ np.diag(10.0 ** -np.arange(40)) @ p
    yield "clusters", q @ np.diag(np.r_[np.full(9, 3.0), 3 - 1e-9 * np.arange(9), np.linspace(1, 2, 22)]) @ p
    yield "far apart", np.diag([1e150, 1.0, 1e-150])


@pytest.mark.parametrize(("name", "a"), list(_matrices()), ids=lambda x: x if isinstance(x, str) else "")
def test_singular_vectors(name, a):
    k = min(8, len(a))
    values, vectors = bidiagonal.singular(a, 8)
    top = max(np.linalg.svd(a, compute_uv=False)[0], 1e-300)
    assert np.abs(values - np.linalg.svd(a, compute_uv=False)[:k]).max() <= 1e-13 * top
    assert np.abs(vectors @ vectors.T - np.eye(k)).max() < 1e-10
    a = a / top
    assert np.abs(vectors @ (a.T @ a) - ((values / top) ** 2)[:, None] * vectors).max() < 1e-12


def test_small_values_keep_their_digits():
    rng = np.random.default_rng(1)
    q, e = np.exp(rng.uniform(-40, 0, 12)), np.exp(rng.uniform(-40, 0, 11))
    found = np.sort(bidiagonal.squared_values(q.tolist(), e.tolist()))
    import decimal

    decimal.getcontext().prec = 60
    for value in found:  # the sign of the last pivot changes within a few digits of each value
        counts = []
        for factor in ("0.99999999999", "1.00000000001"):
            shift, t, below = decimal.Decimal(float(value)) * decimal.Decimal(factor), decimal.Decimal(0), 0
            for i in range(12):  # pivots of B'B - shift
                diagonal = decimal.Decimal(float(q[i])) + (decimal.Decimal(float(e[i - 1])) if i else 0)
                t = diagonal - shift - (decimal.Decimal(float(q[i - 1])) * decimal.Decimal(float(e[i - 1])) / t if i else 0)
                below += t < 0
            counts.append(below)
        assert counts[1] == counts[0] + 1


def _check_whitening(rows, found):
    used = [(i, v) for i, v, *_ in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    n, deviation, values, directions, trace, centred = brute.whitening([[float(np.float32(x)) for x in v] for _, v in used])
    k = len(values)
    assert len(found) == n * k
    assert {r["n"] for r in found} == {n}
    expected = sorted(((i, d) for (i, _), d in zip(used, deviation, strict=True)), key=repr)
    assert sorted(((r["vec_id"], r["deviation"]) for r in found if r["component"] == 1), key=repr) == expected
    varied = values > 1e-20 * max(trace, 1e-300)
    for c in range(k):
        own = [r for r in found if r["component"] == c + 1]
        if not varied[c]:
            assert all(r["whitened"] is None for r in own)
            continue
        assert all(abs(r["explained"] - values[c] / trace) < 1e-9 for r in own)
        w = centred @ directions[c] / np.sqrt(values[c])
        plain = sorted(zip([i for i, _ in used], deviation, w.tolist(), strict=True), key=repr)
        if c + 1 < k and values[c] - values[c + 1] < 1e-6 * values[c] or c and values[c - 1] - values[c] < 1e-6 * values[c - 1]:
            continue  # the direction is not determined
        got = {(r["vec_id"], r["deviation"]): r["whitened"] for r in own}
        sign = max(((got[i, d], x) for i, d, x in plain), key=lambda p: abs(p[1]))
        sign = 1.0 if sign[0] * sign[1] > 0 else -1.0
        for i, d, x in plain:
            assert abs(sign * got[i, d] - x) < 1e-7
    assert all(r["identity_error"] is None if not varied.any() else r["identity_error"] < 1e-9 for r in found)


def test_whitening_of_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(5)
    base = rng.standard_normal((150, 10)) @ np.diag(np.linspace(1, 4, 10)) + 7
    rows = [(i, v.tolist(), 1, 2, "x") for i, v in enumerate(base)]
    rows += [(3, base[3].tolist(), 1, 2, "x")] * 4 + [(None, base[0].tolist(), None, None, None)]
    rows += [(900, None, 1, 1, "x"), (901, [], 1, 1, "x"), (902, [float("nan"), *[0.0] * 9], 1, 1, "x"), (903, [None, *[0.0] * 9], 1, 1, "x"), (904, [float("inf"), *[0.0] * 9], 1, 1, "x")]
    found = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(7)).collect()
    _check_whitening(rows, found)
    other = rows + [(905, [1.0, 2.0], 1, 1, "x")]  # another length takes no part
    assert len(whitening.whiten(spark.createDataFrame(other, VECTORS).repartition(3)).collect()) == len(found)


@pytest.mark.parametrize("vectors", [[[1.5, -2.0, 3.0]], [[1.0, 2.0]] * 5, [[1.0, 2.0, 4.0], [2.0, 2.0, 5.0], [3.0, 2.0, 6.0]], [[float(i)] for i in range(9)], [[1e12, -1e12], [-1e12, 3e12], [5.0, 6.0]]], ids=["one row", "all alike", "rank 1", "one dimension", "large"])
def test_whitening_of_few_rows(spark, vectors):
    rows = [(i, v, 0, 0, "") for i, v in enumerate(vectors)]
    found = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    _check_whitening(rows, found) if abs(vectors[0][0]) < 1e9 else None
    assert len(found) == len(vectors) * min(8, len(vectors[0]))
    if abs(vectors[0][0]) >= 1e9:  # exact sums do not fit in a long there
        assert {r["vec_id"] for r in found if r["deviation"] is None} >= {0, 1}


def test_whitening_of_nothing(spark):
    out = whitening.whiten(spark.createDataFrame([], VECTORS))
    assert out.count() == 0 and out.columns[-1] == "identity_error"
    assert whitening.whiten(spark.createDataFrame([(1, None, 1, 1, "")], VECTORS)).count() == 0


def test_op11_on_the_given_vectors(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    _check_whitening(rows, catalogue.op11_embedding_whitening(spark, sf_dir).collect())


# periodic runs


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=6), st.integers(1, 7), st.integers(1, 40)), max_size=6), st.integers(0, 2))
def test_runs(parts, alphabet):
    symbols = [x if alphabet == 2 else x % (alphabet + 1) for word, times, most in parts for x in (word * times)[:most]]
    assert periodic.runs(symbols) == brute.runs(symbols)


def test_stretches_lose_no_run():
    rng = random.Random(8)
    for _ in range(150):
        texts = []
        for _ in range(rng.randrange(1, 6)):
            words, size = [], rng.choice([1, 2, 4, 40])
            while len(words) < rng.randrange(1, 100):
                words += ([rng.randrange(size) for _ in range(rng.randrange(1, 9))] * rng.randrange(1, 8))[: rng.randrange(1, 50)]
            texts.append(rng.choice([" ", "\n", "\t"]).join(f"w{x}" for x in words))
        found = periodic.find(next(scan.slices(pa.array(texts))))
        assert [own for _, own, _ in found] == [brute.runs(t.split()) for t in texts]


def test_long_periodic_texts_end_soon():
    for symbols in ([1] * 60_000, list(range(5000)) * 12, [0, 1] * 30_000):
        assert len(periodic.runs(symbols)) == 1


def _periodic_rows(frame):
    return brute.order(tuple(r) for r in frame.collect())


def test_periodic_digest(docs, pairs, spark):
    assert _periodic_rows(periodic.digest(periodic.collapse(periodic.planted(docs)))) == brute.order(brute.periodic(d, t) for d, t in pairs)
    rng = random.Random(4)
    extra = [(10_000 + i, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(400)))) for i in range(300)]
    extra += [(20_000 + i, "\n".join(["the same line of words"] * rng.randrange(1, 9)) + " end" * rng.randrange(9)) for i in range(60)]
    frame = spark.createDataFrame(extra, "doc_id long, text string").repartition(3)
    found = _periodic_rows(periodic.digest(periodic.collapse(periodic.planted(frame))))
    assert found == brute.order(brute.periodic(d, t) for d, t in extra)
    assert sum(r[1] > 0 for r in found) > 40


def test_collapse_keeps_its_general_columns(spark, nothing):
    row = periodic.collapse(spark.createDataFrame([(1, "a b a b a b a b c")], "doc_id long, text string")).first()
    assert (row.n_words, [tuple(r) for r in row.runs], row.collapsed) == (9, [(0, 8, 2)], "a b c")
    assert periodic.digest(periodic.collapse(periodic.planted(nothing))).count() == 0


def test_op12_on_the_given_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert _periodic_rows(catalogue.op12_periodic_runs(spark, sf_dir)) == brute.order(brute.periodic(d, t) for d, t in rows)


# encoding and decoding


_BITS = ["foo", "Bär", "x1", ", ", ". ", ",", ".", ".\n", " ", "\n", "é", "_", "!", "Σ", "\x00", "\x01", "\x1c", "́", "'s", "'LL", "<|endoftext|>", "<|end", "İ", "中", "  ", "\t", "é", "Å", "한", "하", "letters", "====", "''", "'re", "aaaa", "the", "ing", "1234"]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_trees_equal_whole_texts(path):
    tree, rng = bpe_tree.tree(path), random.Random(2)
    kinds = [_BITS, "abcdeinthg", ["a", "aa", "the", "ing", "中", "é", "ß"], ["=", "==", "-", "(", "foo", "'"]]
    for i in range(1200):
        text = "".join(rng.choice(kinds[i % 4]) for _ in range(rng.randrange(120)))
        for most in (5, 17):
            assert tree.encode(text, most).tolist() == tree.encoder.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("unit", ["a", "ab", "aab", "=", "=-", "中", "é", "the", "xyzzy", "1"])
def test_long_unsplit_texts(unit):
    """Windows grow as far as the two sides disagree, which for repeated letters may be very far."""
    tree = bpe_tree.tree(WORD)
    for n in (997, 4001, 4002):
        text = (unit * n)[:n]
        assert len(tree.leaves(text, 128)) >= 8
        assert tree.encode(text, 128).tolist() == tree.encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_windows_stay_small_in_prose(pairs):
    tree, sizes = bpe_tree.tree(WORD), []
    seam = tree.seam
    try:
        tree.seam = lambda a, b, closed: sizes.append((out := seam(a, b, closed))[0]) or out
        text = next(t for d, t in pairs if d == 17)
        assert tree.encode(text, 200).tolist() == tree.encoder.tokenizer.encode(text, add_special_tokens=False).ids
    finally:
        del tree.seam
    assert len(sizes) > 20 and max(sizes) <= 16


def test_where_no_cut_is_safe():
    tree = bpe_tree.tree(WORD)
    text = "e" + "́" * 3000
    assert tree.leaves(text, 100) == [(0, 3001, False, False)]
    assert tree.encode(text, 100).tolist() == tree.encoder.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("leaf_chars", [100, bpe_tree.LEAF_CHARS])
@pytest.mark.parametrize("path", [WORD, BYTE])
def test_round_trip(docs, pairs, leaf_chars, path):
    tokenizer = encode.encoder(path).tokenizer
    extra = [(300, "unsplit" * 600), (300, "unsplit" * 600), (301, "=" * 2000), (None, "é中" * 500), (302, "ab<|endoftext|>" * 300), (303, "a" + "́" * 900)]
    spark = docs.sparkSession
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = bpe_tree.decode(bpe_tree.encode_documents(frame, path, leaf_chars), path).collect()
    expected = []
    for d, t in itertools.chain(pairs, extra):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        expected.append((d, len(ids), ids, tokenizer.decode(ids, skip_special_tokens=False)))
    assert brute.order((r.doc_id, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist(), r.text) for r in rows) == brute.order(expected)


def test_decoding_of_unknown_and_null_ids(spark):
    rows = [(1, 3, np.array([320, 60_000, 49407], "<u4").tobytes()), (2, 0, b""), (3, None, None)]
    found = {r.doc_id: r.text for r in bpe_tree.decode(spark.createDataFrame(rows, bpe_tree.TOKENS), WORD).collect()}
    assert found == {1: encode.encoder(WORD).tokenizer.decode([320, 60_000, 49407], skip_special_tokens=False), 2: "", 3: None}


def test_op13_on_the_given_documents(spark, sf_dir, nothing):
    tokenizer = encode.encoder(WORD).tokenizer
    digest = lambda b: hashlib.sha256(b).hexdigest()
    expected = []
    for d, t in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        expected.append((d, len(ids), digest(np.array(ids, "<u4").tobytes()), digest(tokenizer.decode(ids, skip_special_tokens=False).encode())))
    assert brute.order(tuple(r) for r in catalogue.op13_bpe_round_trip(spark, sf_dir).collect()) == brute.order(expected)
    assert bpe_tree.decode(bpe_tree.encode_documents(nothing, WORD), WORD).count() == 0
