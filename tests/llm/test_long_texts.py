"""Very long texts: handled in slices, with the same results, in bounded memory."""

import collections
import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import common, jaccard_join, recompression, suffix_dedup
from tests.llm.frames import LONG, ROWS, documents, prose
from tests.llm.test_dedup import suffix_expected, words_expected


def big_text(n_bytes, seed=1):
    """Words of a fixed size, so that the text is quick to make; its first 5000 bytes come again at its end."""
    rng = np.random.default_rng(seed)
    data = rng.integers(97, 123, n_bytes, dtype=np.uint8)
    data[::8] = 32
    data[-5000:] = data[8:5008]
    return data.tobytes().decode()


@pytest.mark.parametrize("slice_bytes", [700, 1 << 22])
def test_suffix_dedup_of_long_texts_in_slices(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(suffix_dedup, "TEXT_BYTES", 1000)
    rows = ROWS + [(30, LONG[:50_000] + "#" + LONG[40_000:90_000]), (31, "ab" * 6000), (32, prose(8, 700)), (33, prose(8, 700)[1500:] + "z")]
    got = suffix_dedup.suffix_dedup(documents(spark, rows)).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").alias("n"), F.sha2("kept", 256).alias("sha")).collect()
    assert collections.Counter(map(tuple, got)) == suffix_expected(rows)


def test_substring_dedup_of_long_texts_in_slices(spark, monkeypatch):
    monkeypatch.setattr(recompression, "SLICE_WORDS", 50)
    rows = ROWS + [(40, LONG[1000:9000]), (0, LONG[60_000:61_000]), (41, "a b " * 900)]
    got = recompression.substring_dedup(documents(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert collections.Counter(map(tuple, got)) == words_expected(rows)


def test_windows_have_the_same_names_in_slices(monkeypatch):
    rng = np.random.default_rng(3)
    words = rng.integers(1, 5, 4000).astype(np.uint64)
    begin = np.array([0, 3, 3, 700, 705, 2900, 4000])
    whole = recompression.name_windows(words, begin)
    monkeypatch.setattr(recompression, "SLICE_WORDS", 37)
    for a, b in zip(whole, recompression.named_in_slices(words, begin)):
        assert (a == b).all() and len(a) > 3500


def test_word_hashes_in_blocks(monkeypatch):
    data, starts = common.byte_buffer(pa.array([LONG, "x" * 5000, "", "one two"]))
    first, last, _ = common.word_spans(data, starts)
    whole = common.word_hashes(data, first, last)
    monkeypatch.setattr(common, "CHUNK_BYTES", 300)
    assert (common.word_hashes(data, first, last) == whole).all() and len(common.word_hashes(data, first[:0], last[:0])) == 0


def test_covered_stretches():
    low, high = suffix_dedup.covered(np.array([900, 0, 100, 399, 5000]), np.array([1, 1, 1, 2, 3]))
    assert low.tolist() == [0, 900, 5000] and high.tolist() == [800, 1300, 5402]
    assert [len(x) for x in suffix_dedup.covered(np.empty(0, np.int64), np.empty(0, np.int64))] == [0, 0]


def test_memory_of_a_text_of_50_mb():
    text = pa.array([big_text(50 << 20)])
    data, starts = common.byte_buffer(text)
    tracemalloc.start()
    n = 0
    for at in range(0, len(data) - suffix_dedup.WINDOW + 1, suffix_dedup.SLICE_BYTES):
        part = data[at:at + suffix_dedup.SLICE_BYTES + suffix_dedup.WINDOW - 1]
        n += suffix_dedup.segments(pa.array([7]), part, np.array([0, len(part)]), at).num_rows
    assert n > 100_000 and tracemalloc.get_traced_memory()[1] < 600 << 20
    tracemalloc.reset_peak()
    *_, name = recompression.segments(text)
    assert len(name) > 1_000_000 and tracemalloc.get_traced_memory()[1] < 1500 << 20
    del name
    tracemalloc.reset_peak()
    (found,) = jaccard_join.shingle_sets(text)
    assert len(found) > 5_000_000 and tracemalloc.get_traced_memory()[1] < 1500 << 20
    tracemalloc.stop()


@pytest.mark.parametrize("n_bytes, size", [(suffix_dedup.TEXT_BYTES, 2048), (suffix_dedup.SLICE_BYTES, suffix_dedup.SLICE_BYTES)])
def test_memory_of_the_bytes_cut_at_once(n_bytes, size):
    data = np.random.default_rng(2).integers(97, 123, n_bytes).astype(np.uint8)
    starts = np.arange(0, n_bytes + 1, size)
    tracemalloc.start()
    found = suffix_dedup.segments(pa.array(np.arange(len(starts) - 1)), data, starts, 0)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows > 1000 and most < 100 << 20


def test_batches_of_names_stay_within_the_limit():
    names = [1, 1, 2, 3, 4, 4, 5, 6]
    sizes = [300_000, 400_000, 700_000, 10, 900_000, 900_000, 20, 30]
    rows = pa.RecordBatch.from_arrays([pa.array(names), pa.array([b"x" * n for n in sizes])], names=["name", "bytes"])
    batches = list(suffix_dedup.name_batches(iter([rows.slice(0, 5), rows.slice(5)])))
    assert [x for held in batches for t in held for x in t.column("name").to_pylist()] == names
    assert [[t.column("name")[0].as_py() for t in held] for held in batches] == [[1], [2, 3], [4], [5, 6]]
    assert not list(suffix_dedup.name_batches(iter([])))


def test_suffix_dedup_of_a_text_of_20_mb(spark):
    text = big_text(20 << 20)
    rows = [(1, text), (2, text[8_000_000:8_003_000] + "#"), (3, "plain")]
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(documents(spark, rows)).collect()}
    assert [(s.start, s.end) for s in got[1].spans] == [(8, 5008), (8_000_000, 8_003_000), (len(text) - 5000, len(text))]
    assert bytes(got[2].kept) == b"#" and got[1].n_removed == 13_000 and got[3].n_removed == 0
    raw = text.encode()
    assert hashlib.sha256(got[1].kept).digest() == hashlib.sha256(raw[:8] + raw[5008:8_000_000] + raw[8_003_000:-5000]).digest()
