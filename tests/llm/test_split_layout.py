"""Results don't depend on how files are split into tasks, also when that changes between two jobs of a query."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import common, jaccard_join, recompression, suffix_dedup, token_counts
from tests.llm.frames import documents
from tests.llm.test_dedup import NEAR, SUFFIX_ROWS, jaccard_expected, suffix_expected, words_expected

SPLITS = "spark.sql.files.minPartitionNum"


@pytest.fixture()
def changing_splits(spark, monkeypatch):
    """The number of splits of a read changes with each table that is written, as when executors come and go."""
    calls = []
    write, flat = common.Scratch.write, token_counts.write_token_files

    def next_layout():
        calls.append(1)
        spark.conf.set(SPLITS, str((2, 7, 1, 5)[len(calls) % 4]))

    def changing(self, df, table):
        out = write(self, df, table)
        next_layout()
        return out

    def changing_flat(*args):
        flat(*args)
        next_layout()

    monkeypatch.setattr(common.Scratch, "write", changing)
    monkeypatch.setattr(token_counts, "write_token_files", changing_flat)
    spark.conf.set(SPLITS, "6")
    yield calls
    spark.conf.unset(SPLITS)


def stored(spark, rows, path):
    """A table of several files, read as it stands."""
    documents(spark, rows).repartition(9).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_row_keys_stay(spark, tmpdir_path, changing_splits):
    docs = stored(spark, NEAR, tmpdir_path + "/d")
    keyed = common.with_row_id(docs, common.Scratch(spark, "keys"), ["doc_id", "text"], "row", stored=True)
    seen = []
    for n in ("1", "4", "30"):
        spark.conf.set(SPLITS, n)
        seen.append(sorted((r.row, r.doc_id is None, r.doc_id or 0, r.text or "") for r in keyed.collect()))
    assert seen[0] == seen[1] == seen[2] and len({r[0] for r in seen[0]}) == len(NEAR)


def test_more_files_than_may_be_broadcast(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(common, "MOST_FILES", 3)
    docs = stored(spark, NEAR, tmpdir_path + "/d")
    keyed = common.with_row_id(docs, common.Scratch(spark, "keys"), ["doc_id"], "row", stored=True)
    assert keyed.select("row").distinct().count() == len(NEAR) and "_metadata" not in keyed.columns


def test_suffix_dedup_with_changing_splits(spark, tmpdir_path, changing_splits):
    got = suffix_dedup.suffix_dedup(stored(spark, SUFFIX_ROWS, tmpdir_path + "/d"), stored=True).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").alias("n"), F.sha2("kept", 256).alias("sha")).collect()
    assert collections.Counter(map(tuple, got)) == suffix_expected(SUFFIX_ROWS) and len(changing_splits) > 2


def test_substring_dedup_with_changing_splits(spark, tmpdir_path, changing_splits):
    got = recompression.substring_dedup(stored(spark, NEAR, tmpdir_path + "/d"), stored=True).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert collections.Counter(map(tuple, got)) == words_expected(NEAR) and len(changing_splits) > 2


def test_jaccard_join_with_changing_splits(spark, tmpdir_path, changing_splits):
    got = jaccard_join.jaccard_classes(stored(spark, NEAR, tmpdir_path + "/d"), stored=True).select("doc_id", "class_id", "n_links").collect()
    assert collections.Counter(map(tuple, got)) == jaccard_expected(NEAR)[0] and len(changing_splits) > 2


@pytest.mark.parametrize("width", [None, 4])
def test_token_counts_with_changing_splits(spark, tmpdir_path, changing_splits, width):
    public = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(public)
    docs = stored(spark, NEAR, tmpdir_path + "/d")
    got = collections.Counter(map(tuple, token_counts.document_token_counts(docs, public, width).collect()))
    assert got == collections.Counter((d, len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in NEAR) and changing_splits


def test_token_width_follows_the_vocabulary():
    assert [token_counts.width_for(n) for n in (1, 65_535, 65_536, 1 << 20)] == [2, 2, 4, 4]
    with pytest.raises(ValueError):
        token_counts.width_for(1 << 32)
    assert np.dtype(token_counts.WIDTHS[4]).itemsize == 4


def test_token_counts_of_text_ids_and_no_rows(spark):
    public = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    docs = spark.createDataFrame([("a\0\0b", "x"), (None, ""), ("é", None), ("-", "one two"), ("", "x")], "doc_id string, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.document_token_counts(docs, public).collect()}
    assert set(got) == {"a\0\0b", None, "é", "-", ""} and got[None] == got["é"] == 0 and got["a\0\0b"] == got[""] == 1
    assert token_counts.document_token_counts(docs.limit(0), public).count() == 0
