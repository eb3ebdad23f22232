import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablehealth.llm import encode, packing, token_files
from tests.llm import brute

WORD, BYTE = (encode.vocabulary_path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))


def whole(path, text):
    return encode.encoder(path).tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_cached_pieces_equal_whole_texts(path, pairs):
    rng = random.Random(3)
    bits = ["foo", "Bär", "x1", ", ", ". ", ",", ".", ".\n", " ", "\n", "é", "_", "!", "Σ", "\x00", "\x01", "\x1c", " ", "'s", "'LL", "<|endoftext|>", "İ", "中", "  ", "\t", "é"]
    texts = [t for _, t in pairs] + ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(3000)]
    ids, counts = encode.encoder(path).encode_many(texts)
    ends = np.cumsum(counts)
    for t, a, b in zip(texts, ends - counts, ends, strict=True):
        assert ids[a:b].tolist() == whole(path, t), repr(t)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**17 - 1), min_size=1, max_size=70), st.integers(17, 31), st.data())
def test_packing_bits_round_trip(ids, bits, data):
    payload = token_files.pack(np.array(ids, np.uint32), bits)
    assert len(payload) == -(-len(ids) * bits // 8)
    start = data.draw(st.integers(0, len(ids) - 1))
    n = data.draw(st.integers(0, len(ids) - start))
    assert token_files.unpack(payload, bits, start, n).tolist() == ids[start : start + n]


def test_width():
    assert [token_files.width(v) for v in (2, 3, 49408, 65536, 65537)] == [1, 2, 16, 16, 17]


@pytest.mark.parametrize("block_ids", [64, token_files.BLOCK_IDS])
def test_token_files(docs, pairs, tmp_path, block_ids):
    path = str(tmp_path / "tokens")
    token_files.write(docs, path, WORD, block_ids=block_ids)
    found = [tuple(r) for r in token_files.read(docs.sparkSession, path).select("start", "doc_id", "n_tokens", "ids_crc32").collect()]
    expected, at = [], 0
    for d, t in sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0, p[1] is not None, (p[1] or "").encode())):
        ids = [*whole(WORD, t), token_files.END_ID]
        expected.append((at, d, len(ids), brute.crc(ids)))
        at += len(ids)
    assert sorted(found, key=lambda r: r[0]) == expected
    some = token_files.read_documents(docs.sparkSession, path, 3, 6).collect()
    texts = dict(pairs)
    assert brute.order((r.doc_id, r.ids) for r in some) == brute.order((d, [*whole(WORD, texts[d]), 2]) for d in (3, 4, 5, 6, 6))


def test_rows_of_one_id_are_encoded_in_several_tasks(spark, tmp_path):
    rows = [(None, f"{i:03} word {i}") for i in range(400)] + [(7, f"{i:03} other") for i in range(400)] + [(8, "end")]
    path = str(tmp_path / "tokens")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # would join so few rows again
    try:
        token_files.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, WORD)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = token_files.read(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in found] == [r[0] for r in rows]
    assert [r.ids_crc32 for r in found] == [brute.crc([*whole(WORD, t), token_files.END_ID]) for _, t in rows]
    for doc_id in (None, 7):
        assert len({r.shard for r in found if r.doc_id == doc_id}) > 1


def test_cut():
    assert packing.cut(5, 4).tolist() == [1, 4]
    assert packing.cut(8, 4).tolist() == [4, 4]
    assert packing.cut(3, 4).tolist() == [3]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80), st.integers(1, 6))
def test_best_fit_fills_bins_without_gaps(lengths, open_bins):
    bins, offsets = packing.best_fit(lengths, 20, open_bins)
    level = {}
    for n, b, at in zip(lengths, bins, offsets, strict=True):
        assert level.get(b, 0) == at
        level[b] = at + n
    assert all(v <= 20 for v in level.values())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80), st.integers(1, 6))
def test_best_fit_equals_a_look_at_every_open_bin(lengths, open_bins):
    bins, offsets = packing.best_fit(lengths, 20, open_bins)
    assert list(zip(bins, offsets, strict=True)) == brute.best_fit(lengths, 20, open_bins)


def test_the_bound_on_open_bins_binds_and_costs_little():
    rng = np.random.default_rng(3)
    lengths = np.minimum(1024, rng.geometric(1 / 430, packing.GROUP_PIECES)).tolist()
    bound, free = (packing.best_fit(lengths, 1024, n) for n in (packing.OPEN_BINS, len(lengths)))
    assert bound != free
    assert max(free[0]) + 1 <= max(bound[0]) + 1 <= 1.03 * sum(lengths) / 1024


def test_packed_repeated_rows_lie_in_bounded_groups(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one text")] * 900 + [(i, "other") for i in range(100)], "doc_id long, text string").repartition(3)
    seen = []
    monkeypatch.setattr(packing, "pack", lambda numbered, *a, f=packing.pack, **b: seen.append(f(numbered, *a, group_pieces=100, **b)) or seen[-1])
    found = packing.pack_documents(docs, BYTE).collect()
    assert len(found) == 1000
    groups = {}
    for r in found:
        groups[r.sequence_id >> 32] = groups.get(r.sequence_id >> 32, 0) + 1
    assert len(groups) == 10 and max(groups.values()) < 200


def test_packing(docs, pairs):
    found = packing.pack_documents(docs, BYTE, 64).collect()
    for r in found:
        assert 1 <= r.length <= 64
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    expected = []
    for d, t in pairs:
        ids, at = [*whole(BYTE, t), 2], 0
        for i, n in enumerate(packing.cut(len(ids), 64).tolist()):
            expected.append((d, i, at, n, brute.crc(ids[at : at + n])))
            at += n
    assert brute.order((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == brute.order(expected)


def test_packing_is_tight_and_reruns_agree(spark, sf_dir):
    from tablehealth.llm import catalogue

    one, two = (brute.order(map(tuple, catalogue.op9_best_fit_packing(spark, sf_dir).collect())) for _ in range(2))
    assert one == two
    total, used = sum(r[3] for r in one), len({r[5] for r in one})
    # pieces come as they arrive, so 200 documents leave more room than they would sorted by length
    assert used == 1 + max(b for b, _ in brute.best_fit(_in_order(spark, sf_dir), 1024, packing.OPEN_BINS))
    larger = catalogue.op9_best_fit_packing(spark, sf_dir.replace("sf0.001", "sf0.01")).collect()
    assert len({r.sequence_id for r in larger}) <= 1.03 * -(-sum(r.length for r in larger) // 1024)


def _in_order(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    return [n for t in texts for n in packing.cut(len(whole(BYTE, t)) + 1, 1024).tolist()]


def test_empty_tables(nothing, tmp_path):
    assert token_files.write_and_read(nothing, WORD, str(tmp_path / "none")).count() == 0
    assert packing.pack_documents(nothing, BYTE).count() == 0
