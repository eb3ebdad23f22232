import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablehealth.llm import byte_dedup, jaccard, quality, repeats, scan, substring_dedup
from tests.llm import brute
from tests.llm.conftest import prose


def rows(df, *columns):
    return brute.order(tuple(r[c] for c in columns) for r in df.collect())


def test_quality_counts_and_verdicts(docs, edges):
    found = rows(quality.judge(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    expected = []
    for d, t, *_ in edges:
        n = brute.quality(t)
        expected.append((d, *n, n[0] < 10 or 100 * n[4] > 20 * n[0]))
    assert found == brute.order(expected)


def test_quality_rejects_a_bad_host_and_keeps_the_others(spark):
    good = [(i, f"clean words number {i} " + " ".join(f"w{i}x{j}" for j in range(30)), f"good{i % 5}") for i in range(200)]
    bad = [(1000 + i, "too short" if i % 10 else " ".join(f"v{i}x{j}" for j in range(30)), "bad") for i in range(60)]
    docs = spark.createDataFrame([(d, t, "en", s, 1) for d, t, s in good + bad], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in quality.keep(docs).collect()}
    assert kept == {d for d, _, _ in good}
    assert quality.keep(docs).columns == docs.columns


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_verdicts_over_uneven_hosts(spark, seed):
    rng = random.Random(seed)
    good, bad = "one two three four five six seven eight nine ten eleven", "too short"
    hosts = [("huge", 4000, 0.2), (None, 60, 0.9), *((f"h{i}", rng.choice([1, 2, 5, 40]), rng.choice([0.1, 0.2, 0.95] if seed > 1 else [0.2])) for i in range(150))]
    docs = [(host, rng.random() < rate) for host, n, rate in hosts for _ in range(n)]
    frame = spark.createDataFrame([(i, bad if failed else good, host) for i, (host, failed) in enumerate(docs)], "doc_id long, text string, source string").repartition(5)
    kept = {r.doc_id: r.kept for r in quality.judge(frame).collect()}
    expected = brute.verdicts(docs)
    assert [kept[i] for i in range(len(docs))] == expected
    if seed > 1:  # the verdict acts on hosts, not on documents alone
        assert any(not k and not failed for k, (_, failed) in zip(expected, docs, strict=True))


def test_one_huge_host_does_not_weaken_the_prior():
    """A host of 990,000 documents and 5,000 of two each, all with a true rate of 0.2: as many of the small ones fail 0, 1, 2 times as that rate says."""
    by_failures = {0: 3200, 1: 1600, 2: 200}
    failed = 198_000 + sum(k * m for k, m in by_failures.items())
    second = 990_000 * 0.2**2 + sum(2 * m * (k / 2) ** 2 for k, m in by_failures.items())
    alpha, beta = quality.beta_prior(1_000_000, failed, 5001, 990_000.0**2 + 5000 * 4, second)
    assert alpha + beta > 500 and (2 + alpha) / (2 + alpha + beta) < 0.25
    # true rates of 0 and 1 among the small hosts are seen, however large that one is
    second = 990_000 * 0.2**2 + 2 * 1000
    alpha, beta = quality.beta_prior(1_000_000, 200_000, 5001, 990_000.0**2 + 5000 * 4, second)
    assert alpha + beta < 3 and (2 + alpha) / (2 + alpha + beta) > 0.5


def test_beta_prior_is_stronger_for_like_hosts():
    even = quality.beta_prior(1000, 100, 10, 10 * 100**2, 1000 * 0.01)
    mixed = quality.beta_prior(1000, 100, 10, 10 * 100**2, 1000 * 0.05)
    assert sum(even) > sum(mixed)
    assert even[0] / sum(even) == pytest.approx(0.1)
    assert quality.beta_prior(0, 0, 0, 0.0, 0.0) == (1.0, 1.0)


def test_byte_dedup(docs, pairs):
    assert rows(byte_dedup.digest(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.order(brute.byte_repeats(pairs))


@pytest.mark.parametrize("bucket_bytes", [0, 600])
def test_byte_dedup_where_buckets_are_split_or_compared_by_rows(docs, pairs, monkeypatch, bucket_bytes):
    monkeypatch.setattr(repeats, "BUCKET_BYTES", bucket_bytes)
    assert rows(byte_dedup.digest(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.order(brute.byte_repeats(pairs))


def test_substring_dedup(docs, pairs):
    assert rows(substring_dedup.digest(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == brute.order(brute.word_repeats(pairs))


@pytest.mark.parametrize("bucket_bytes", [0, 900])
def test_substring_dedup_by_parts_and_by_shuffle(docs, pairs, monkeypatch, bucket_bytes):
    from tablehealth.llm import common

    monkeypatch.setattr(repeats, "BUCKET_BYTES", bucket_bytes)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert rows(substring_dedup.digest(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == brute.order(brute.word_repeats(pairs))


@pytest.mark.parametrize("bucket_bytes", [0, 1500, repeats.BUCKET_BYTES])
def test_a_document_that_holds_a_passage_twice_loses_both(spark, monkeypatch, bucket_bytes):
    """The passage stands in one setting in document 1, and twice in another one in document 2."""
    monkeypatch.setattr(repeats, "BUCKET_BYTES", bucket_bytes)
    rng = random.Random(2)
    pairs = []
    for i in range(0, 60, 3):
        passage, *around = (prose(rng, n) for n in (70, 90, 90, 40))
        other = f"{around[0]} {passage} {around[1]}"
        pairs += [(i, f"{prose(rng, 80)} {passage} {prose(rng, 80)}"), (i + 1, f"{other} {around[2]} {other}"), (i + 2, f"{passage} {prose(rng, 9)} {passage}")]
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    assert rows(substring_dedup.digest(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == brute.order(brute.word_repeats(pairs))
    assert rows(byte_dedup.digest(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.order(brute.byte_repeats(pairs))


def test_substring_removal_keeps_columns_and_untouched_texts(docs, edges):
    out = substring_dedup.remove(docs)
    assert out.columns == docs.columns
    left = {(r.doc_id, r.text) for r in out.collect()}
    gone = {d: n for d, _, n, _ in brute.word_repeats([(r[0], r[1]) for r in edges])}
    for d, t, *_ in edges:
        if d is not None and d != 22 and not gone[d]:
            assert (d, t) in left
    assert not any(d == 2 for d, _ in left)  # a copy throughout


def test_jaccard_components(docs, pairs):
    found = rows(jaccard.join(docs), "doc_id", "n_shingles", "component_id")
    assert found == brute.order(brute.jaccard(pairs))


def test_jaccard_by_shuffle_with_everything_frequent(docs, pairs, monkeypatch):
    from tablehealth.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(jaccard, "FREQUENT", 2)
    found = rows(jaccard.join(docs), "doc_id", "n_shingles", "component_id")
    assert found == brute.order(brute.jaccard(pairs))


def test_jaccard_keeps_one_of_each_group(docs, pairs):
    kept = [r.doc_id for r in jaccard.keep_first(docs).collect()]
    components = {c for d, n, c in brute.jaccard(pairs) if n}
    assert {d for d in kept if d in components} == components
    assert kept.count(6) == 1  # a repeated row stays once


def test_empty_tables(nothing):
    assert quality.judge(nothing).count() == 0
    assert byte_dedup.digest(nothing).count() == 0
    assert substring_dedup.digest(nothing).count() == 0
    assert jaccard.join(nothing).count() == 0


def test_cuts_meet_their_texts_by_shuffle_too(spark, docs, pairs, monkeypatch):
    monkeypatch.setattr("tablehealth.llm.common.broadcast_limit", lambda spark: 0)
    assert rows(substring_dedup.digest(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == brute.order(brute.word_repeats(pairs))
    assert rows(byte_dedup.digest(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.order(brute.byte_repeats(pairs))


def test_pipeline_filters_on_empty_tables(nothing):
    for keep in (quality.keep, jaccard.keep_first, substring_dedup.remove):
        out = keep(nothing)
        assert out.columns == nothing.columns and out.count() == 0


def thue_morse(n):
    return [bin(i).count("1") & 1 for i in range(n)]


def test_texts_on_which_polynomials_modulo_a_power_of_two_collide(spark):
    """A 0/1 Thue-Morse sequence and its complement: as words, as lines, as words of a text and as runs of bytes."""
    bits = thue_morse(2048)
    one, other = "".join("01"[b] for b in bits), "".join("10"[b] for b in bits)
    sequence, flipped = " ".join("01"[b] for b in bits), " ".join("10"[b] for b in bits)
    pairs = [(1, one), (2, other), (3, f"a {one} b\n{one} {other}\n{other} {one}\n{one} {other}"), (4, sequence), (5, flipped), (6, f"a b c d {one}"), (7, f"a b c d {other}")]
    docs = spark.createDataFrame([(d, t, "s") for d, t in pairs], "doc_id long, text string, source string")
    assert rows(jaccard.join(docs), "doc_id", "n_shingles", "component_id") == brute.order(brute.jaccard(pairs))
    assert rows(byte_dedup.digest(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.order(brute.byte_repeats(pairs))
    assert rows(substring_dedup.digest(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == brute.order(brute.word_repeats(pairs))
    found = rows(quality.judge(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert found == brute.order((d, *brute.quality(t)) for d, t in pairs)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("abc", max_size=40), min_size=1, max_size=6), st.integers(1, 12), st.sampled_from(["byte", "word"]))
def test_refined_and_extended_windows_are_those_that_repeat(texts, window, kind):
    """Bucket pointers and extension over one bucket, against windows compared outright."""
    import collections

    import pyarrow as pa

    if kind == "word":
        texts = [" ".join(t) for t in texts if t] or ["a"]
    s = next(scan.slices(pa.array([t or "a" for t in texts]), 1 << 20))
    texts = [t or "a" for t in texts]
    units = [t.split() if kind == "word" else list(t) for t in texts]
    doc = np.arange(len(texts)) // 2
    seen = collections.defaultdict(list)
    for i, u in enumerate(units):
        for at in range(len(u) - window + 1):
            seen[tuple(u[at : at + window])].append((i, at))
    if kind == "byte":
        owner, at = byte_dedup.refine(repeats.Pool(s, np.zeros(len(texts), int), np.zeros(len(texts), int), doc), window)
        expected = {x for v in seen.values() if len(v) > 1 for x in v}
    else:
        anchor = np.array([len(u) // 2 for u in units])
        owner, at = substring_dedup.extend(repeats.Pool(s, np.zeros(len(texts), int), anchor, doc), window)
        same = collections.defaultdict(list)  # a match of two spans lies round the seed
        for i, u in enumerate(units):
            for a in range(max(0, anchor[i] - window + 1), min(anchor[i], len(u) - window) + 1):
                same[anchor[i] - a, tuple(u[a : a + window])].append((i, a))
        expected = {x for v in same.values() for x in v if min(doc[i] for i, _ in v) < doc[x[0]]}
    assert set(zip(owner.tolist(), at.tolist(), strict=True)) == expected


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab \n\té", max_size=30), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    import pyarrow as pa

    for s in scan.slices(pa.array(texts, pa.string()), 16):
        words = s.words()
        own = [brute.WORD.findall(t) for t in texts[s.first : s.first + len(s)]]
        assert words.counts.tolist() == [len(x) for x in own]
        raw = s.data.tobytes()
        assert [raw[a:b].decode() for a, b in zip(words.start, words.end, strict=True)] == [w for x in own for w in x]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=0, max_size=60), st.integers(1, 9))
def test_winnowing_takes_the_leftmost_smallest(values, w):
    grams = np.array(values, np.uint64) << np.uint64(40)
    assert scan.winnow(grams, w).tolist() == [i + int(np.argmin(values[i : i + w])) for i in range(len(values) - w + 1)]


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 10**6), min_size=1, max_size=120), st.integers(0, 30), st.integers(0, 30), st.integers(0, 4), st.randoms())
def test_partners_share_a_signature(shared, x, y, often, rng):
    """Any two sets at 0.75 or more share a prefix signature, whichever tokens are frequent."""
    spread = lambda v: scan.mix(np.array(sorted(v), np.uint64) + np.uint64(1))
    a, b = set(shared) | {10**7 + i for i in range(x)}, set(shared) | {2 * 10**7 + i for i in range(y)}
    if 100 * len(shared) < 75 * len(a | b):
        return
    a, b = np.sort(spread(a)), np.sort(spread(b))
    frequent = lambda t: (scan.mix(t) % np.uint64(4)).astype(int) < often
    assert np.intersect1d(jaccard.prefix_signatures(a, frequent(a)), jaccard.prefix_signatures(b, frequent(b))).size
