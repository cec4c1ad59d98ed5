"""Exact, substring and near-duplicate operators against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import bwt, exact_dedup, jaccard_join, recompression, suffix_dedup
from tallyloom.llm.common import Scratch
from tallyloom.llm.components import components
from tests.llm.frames import ROWS, documents, none, prose


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


# ------------------------------------------------------------ exact dedup
def exact_expected(rows):
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((d, t))
    out = []
    for body, members in groups.items():
        keep = sorted(members, key=lambda m: (-len(m[1] or ""), m[0] is None, m[0] or 0))[0]
        out += [(d, keep[0], len(members), sha(body.encode())) for d, _ in members]
    return collections.Counter(out), len(groups)


def test_exact_dedup_equals_brute_force(spark):
    rows = ROWS + [(20, prose(2, 150).replace(" ", "  ")), (21, "one  two"), (22, "onetwo")]
    got = exact_dedup.exact_dedup(documents(spark, rows)).collect()
    want, classes = exact_expected(rows)
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == classes


def test_exact_dedup_ties_keep_one_row(spark):
    got = exact_dedup.exact_dedup(documents(spark, [(5, "a b"), (5, "a b"), (4, "ab"), (3, "a\tb")])).collect()
    assert {r.keep_id for r in got} == {3} and sum(r.kept for r in got) == 1


def test_exact_dedup_digits_longer_than_first(spark):
    base = prose(9, 4000)
    rows = [(1, base), (2, base + "x"), (3, base), (4, base[:-1] + "#"), (5, base[:100])]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(documents(spark, rows)).collect()}
    assert got == {1: (1, 2), 2: (2, 1), 3: (1, 2), 4: (4, 1), 5: (5, 1)}


def test_drop_copies_keeps_all_columns(spark):
    docs = documents(spark)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == exact_expected(ROWS)[1]
    assert exact_dedup.drop_copies(none(spark)).count() == 0 and exact_dedup.exact_dedup(none(spark)).count() == 0


# --------------------------------------------------------- suffix dedup
def slow_windows(strings, weights, depth):
    count = collections.Counter()
    for s, w in zip(strings, weights):
        for i in range(len(s) - depth + 1):
            count[s[i:i + depth]] += w
    return [[i for i in range(len(s) - depth + 1) if count[s[i:i + depth]] >= 2] for s in strings]


@pytest.mark.parametrize("depth", [8, 20, 50, 400])
def test_merged_transforms_find_repeated_windows(depth):
    rng = random.Random(depth)
    for _ in range(25):
        base = bytes(rng.choices(b"ab\x00\xff", k=rng.choice([5, 60, 900])))
        strings = []
        for _ in range(rng.randint(1, 10)):
            s = b""
            for _ in range(rng.randint(0, 4)):
                i = rng.randint(0, len(base))
                s += base[i:i + rng.randint(0, 700)] + bytes(rng.choices(range(256), k=rng.choice([0, 5])))
            strings.append(s)
        weights = [rng.choice([1, 1, 2]) for _ in strings]
        got = bwt.repeated_windows(strings, weights, depth, rng.choice([50, 300, 5000]))
        assert [x.tolist() for x in got] == slow_windows(strings, weights, depth)


def test_transform_is_the_symbol_before_each_rotation():
    text = np.array([3, 1, 2, 1, 0], np.uint16)
    shard = bwt.build(text, 20)
    rotations = sorted((tuple(np.roll(text, -i)), i) for i in range(5))
    assert shard.place.tolist() == [i for _, i in rotations]
    assert shard.transform.tolist() == [int(text[i - 1]) for _, i in rotations]


def suffix_expected(rows):
    raw = [(d, (t or "").encode()) for d, t in rows]
    count = collections.Counter(hash(b[i:i + 400]) for _, b in raw for i in range(len(b) - 399))
    out = []
    for d, b in raw:
        edge = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 399):
            if count[hash(b[i:i + 400])] > 1:
                edge[i] += 1
                edge[i + 400] -= 1
        cover = (np.cumsum(edge) > 0)[:len(b)]
        spans = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        out.append((d, len(b), int(cover.sum()), spans, sha(bytes(np.frombuffer(b, np.uint8)[~cover]))))
    return collections.Counter(out)


SUFFIX_ROWS = [r for r in ROWS if len(r[1] or "") < 20_000] + [
    (30, prose(8, 900)), (31, prose(8, 900)[:2500] + "!" + prose(8, 900)[2500:]), (32, "z" + prose(8, 900)[300:701] + "z")]


@pytest.mark.parametrize("split", [1500, 1])
def test_suffix_dedup_equals_brute_force(spark, split):
    got = suffix_dedup.suffix_dedup(documents(spark, SUFFIX_ROWS), split=split).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").alias("n"), F.sha2("kept", 256).alias("sha")).collect()
    assert collections.Counter(map(tuple, got)) == suffix_expected(SUFFIX_ROWS)


def test_suffix_dedup_empty(spark):
    assert suffix_dedup.suffix_dedup(none(spark)).count() == 0


# -------------------------------------------------------- recompression
def words_expected(rows, window=13):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    top = 1 << 62
    least = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            least[k] = min(least.get(k, top), top if d is None else d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i:i + window])] < (top if d is None else d):
                gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone).encode())))
    return collections.Counter(out)


def test_substring_dedup_equals_brute_force(spark):
    rows = ROWS + [(40, prose(2, 150)[200:420]), (0, prose(5, 13)), (41, "a b " * 90)]
    got = recompression.substring_dedup(documents(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert collections.Counter(map(tuple, got)) == words_expected(rows)


def test_substring_dedup_copies_differ_in_white_space(spark):
    words = [f"w{i}" for i in range(1, 14)]
    one = " ".join(words)
    rows = [(1, one), (2, one.replace(" ", "  ", 1)), (3, one.replace(" ", "\t")), (4, one + "\n"), (4, "\x0b" + one), (None, "\r\n".join(words)),
            (5, one.replace(" ", "\u00a0")), (6, " "), (7, ""), (8, "one two"), (9, "one\ntwo"),
            (20, prose(7, 30)), (20, prose(7, 30).replace(" ", " \f")), (19, prose(7, 30)[:150].replace(" ", "\n") + " other")]
    got = recompression.substring_dedup(documents(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert collections.Counter(map(tuple, got)) == words_expected(rows)
    assert sorted(r.n_removed for r in got if r.n_words == 13) == [0, 13, 13, 13, 13, 13]


def test_equal_windows_share_their_interior_symbol():
    rng = np.random.default_rng(3)
    shared = rng.integers(1, 6, 13).astype(np.uint64)
    names = set()
    for _ in range(50):
        text = np.concatenate([rng.integers(1, 6, rng.integers(0, 9)), shared, rng.integers(1, 6, rng.integers(0, 9))]).astype(np.uint64)
        at, name, _ = recompression.name_windows(text, np.array([0, len(text)]))
        where = [i for i in range(len(text) - 12) if (text[i:i + 13] == shared).all()]
        names |= {int(name[list(at).index(i)]) for i in where}
    assert len(names) == 1


def test_substring_dedup_empty(spark):
    assert recompression.substring_dedup(none(spark)).count() == 0


# --------------------------------------------------------- Jaccard join
def jaccard_expected(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    ids = collections.defaultdict(list)
    for i in range(len(rows)):
        ids[root(i)].append(rows[i][0])
    least = {r: min((d for d in m if d is not None), default=None) for r, m in ids.items()}
    return collections.Counter((rows[i][0], least[root(i)], links[i]) for i in range(len(rows))), len(ids)


def edited(seed, base, n):
    rng = random.Random(seed)
    w = base.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = "edit" + str(rng.random())
    return " ".join(w)


NEAR = ROWS + [(100 + i, edited(i, prose(50, 300), i % 7)) for i in range(40)]


def test_jaccard_join_equals_brute_force(spark):
    got = jaccard_join.jaccard_classes(documents(spark, NEAR)).select("doc_id", "class_id", "n_links").collect()
    want, _ = jaccard_expected(NEAR)
    assert collections.Counter(map(tuple, got)) == want


def test_jaccard_join_small_leaves_and_blocks(spark, monkeypatch):
    """Forced recursion and block pairs give the same links."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 5)
    docs = documents(spark, NEAR)
    got = jaccard_join.jaccard_classes(docs).select("doc_id", "class_id", "n_links").collect()
    assert collections.Counter(map(tuple, got)) == jaccard_expected(NEAR)[0]


def test_jaccard_recursion_recall(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LEAF", 3)
    got = jaccard_join.jaccard_classes(documents(spark, NEAR)).select("doc_id", "class_id", "n_links").collect()
    want, _ = jaccard_expected(NEAR)
    assert sum((collections.Counter(map(tuple, got)) & want).values()) >= 0.95 * len(NEAR)


def test_keep_one_keeps_columns_and_one_of_each_class(spark):
    docs = documents(spark, NEAR)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == jaccard_expected(NEAR)[1]
    assert jaccard_join.keep_one(none(spark)).count() == 0 and jaccard_join.jaccard_classes(none(spark)).count() == 0


def test_components_of_paths_stars_and_rings(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200 + i, 200 + (i + 7) % 30) for i in range(30)] + [(300, 300)]
    names = list(range(400))
    rng.shuffle(names)
    frame = spark.createDataFrame([(names[a], names[b]) for a, b in edges], "a long, b long")
    got = {r.node: r.label for r in components(frame, Scratch(spark, "test"), "t").collect()}
    groups = collections.defaultdict(set)
    for n, label in got.items():
        groups[label].add(n)
    want = [{names[i] for i in range(61)}, {names[i] for i in range(100, 160)}, {names[200 + i] for i in range(30)}]
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want))
