"""The classifier's gradient, the field's marginals and decontamination against plain computations."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import decontaminate, pii, quality
from tallyloom.llm.common import below_cut
from tests.llm.frames import documents, none, prose


# --------------------------------------------------------------------- quality
def slow_score(weights, x):
    """One document: gated attention over its passages, passage by passage."""
    w, b, v, u, a, c, d = weights
    h = [np.tanh(row @ w + b) for row in x]
    e = [sum(a[k] * np.tanh(p @ v[:, k]) / (1 + np.exp(-(p @ u[:, k]))) for k in range(len(a))) for p in h]
    share = np.exp(np.array(e) - max(e)) / np.exp(np.array(e) - max(e)).sum()
    return 1 / (1 + np.exp(-(sum(s * p for s, p in zip(share, h)) @ c + d[0]))), share


def small_model(rng, features=6, hidden=4, gate=3):
    draw = lambda *s: rng.normal(0, 0.7, s)
    return quality.Model([draw(features, hidden), draw(hidden), draw(hidden, gate), draw(hidden, gate), draw(gate), draw(hidden), draw(1)])


def test_attention_weights_and_score_equal_a_plain_loop():
    rng = np.random.default_rng(1)
    model, count = small_model(rng), np.array([1, 4, 2, 7])
    first = np.concatenate([[0], np.cumsum(count)])
    x = rng.normal(0, 1, (first[-1], 6))
    h, _, _, e = model.parts(x)
    z, share = quality.pool(h, e, first)
    for i, (a, b) in enumerate(zip(first, first[1:])):
        y, s = slow_score(model.weights, x[a:b])
        assert share[a:b] == pytest.approx(s) and 1 / (1 + np.exp(-(z[i] @ model.weights[5] + model.weights[6][0]))) == pytest.approx(y)


def test_gradients_equal_differences_of_the_loss():
    rng = np.random.default_rng(2)
    model, count, labels = small_model(rng), np.array([3, 1, 5, 2]), np.array([1.0, 0.0, 0.0, 1.0])
    first = np.concatenate([[0], np.cumsum(count)])
    x = rng.normal(0, 1, (first[-1], 6))

    def loss():
        y = [slow_score(model.weights, x[a:b])[0] for a, b in zip(first, first[1:])]
        return -np.mean([t * np.log(p) + (1 - t) * np.log(1 - p) for t, p in zip(labels, y)])

    for weight, got in zip(model.weights, quality.gradients(model, x, first, labels)):
        for at in np.ndindex(weight.shape):
            keep, step = weight[at], 1e-5
            weight[at] = keep + step
            up = loss()
            weight[at] = keep - step
            down = loss()
            weight[at] = keep
            assert got[at] == pytest.approx((up - down) / (2 * step), rel=1e-4, abs=1e-8)


def test_training_rows_are_bounded_with_one_id_in_most_rows(spark):
    rows = [(1, prose(i, 5)) for i in range(500)] + [(i, prose(i, 8)) for i in range(2, 12)]
    docs, labels = documents(spark, rows), spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    seen = {}
    fit = quality.fit
    try:
        quality.fit = lambda texts, y, **_: seen.update(n=len(texts)) or fit(texts, y, 2)
        quality.train(docs, labels)
    finally:
        quality.fit = fit
    assert 0 < seen["n"] <= 11


# ------------------------------------------------------------------------- PII
def exact_marginals(unary, links, pairs):
    """Label probabilities by listing all labellings."""
    n, out = len(unary), np.zeros_like(unary)
    for labels in itertools.product(range(unary.shape[1]), repeat=n):
        p = np.exp(sum(unary[i, y] for i, y in enumerate(labels)) + sum(m[labels[a], labels[b]] for (a, b), m in zip(links, pairs)))
        for i, y in enumerate(labels):
            out[i, y] += p
    return out / out.sum(1, keepdims=True)


@pytest.mark.parametrize("chain,skip,given,tolerance", [
    ([(0, 1), (1, 2)], [], [0, 0, 0], 0.01), ([(0, 1)], [(1, 2), (1, 3)], [2, 0, 0, 0], 0.01), ([], [(0, 3), (3, 1)], [0, 4, 1, 0], 0.01),
    ([(0, 1), (1, 2)], [(0, 2)], [0, 0, 3], 0.08)])
def test_messages_give_exact_marginals_on_trees(chain, skip, given, tolerance):
    rng = np.random.default_rng(len(given))
    field = pii.Field(rng.normal(0, 1, (pii.SHAPES, pii.LABELS)), rng.normal(0, 0.8, (pii.LABELS,) * 2), rng.normal(0, 0.8, (pii.LABELS,) * 2))
    shape = [pii.shape_of(p) for p in ("+1 555 123 4567", "joe (at) x", "1234567", "4111-1111-1111-1111")][:len(given)]
    graph = pii.Graph([(0, i, i + 1, g) for i, g in enumerate(given)], shape, chain, skip)
    unary = np.array(shape) @ field.node
    for i, g in enumerate(given):
        if g:
            unary[i] = np.where(np.arange(pii.LABELS) == g, 0.0, -50.0)
    want = exact_marginals(unary, chain + skip, [field.chain] * len(chain) + [field.skip] * len(skip))
    assert np.abs(field.probabilities(graph) - want).max() < tolerance


def test_training_by_graphs_equals_training_by_texts(spark):
    texts = [f"call +1 555 {i:03d} 4567 or 555{i:03d}4567, {prose(i, 6)} joe{i}@x.org joe{i} (at) x.org" for i in range(60)] + [prose(5, 20), "", None]
    docs = documents(spark, list(enumerate(texts)))
    by_graph = pii.train(docs)
    order = [r.text for r in docs.where("text rlike '[0-9]{3}|@'").orderBy(F.xxhash64("doc_id", "text")).collect()]
    by_text = pii.learn(order)
    for a, b in zip((by_graph.node, by_graph.chain, by_graph.skip), (by_text.node, by_text.chain, by_text.skip)):
        assert a == pytest.approx(b, abs=1e-9)
    assert not pii.train(none(spark)).node.any()


def test_below_cut_keeps_the_smallest_hashes(spark):
    rows = spark.range(4000)
    got = below_cut(rows, 50, "id")
    assert 50 <= got.count() <= 150
    assert {r.id for r in rows.orderBy(F.xxhash64("id")).limit(50).collect()} <= {r.id for r in got.collect()}
    assert below_cut(rows, 4000, "id").count() == 4000 and below_cut(rows.limit(0), 5, "id").count() == 0


# --------------------------------------------------------------- decontamination
def slow_alignment(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        table[i, j] = max(0, table[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), table[i - 1, j] - 1, table[i, j - 1] - 1)
    return table.max()


def test_leaks_equal_alignment_of_all_pairs(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(20_000)}"
    items = {i: [word() for _ in range(rng.choice([3, 4, 9, 20, 30]))] for i in range(8)}

    def edited(words, every):
        out = []
        for k, w in enumerate(words):
            kind = rng.random() if every and k % every == every - 1 else 1
            out += [word()] if kind < 0.4 else [] if kind < 0.7 else [w, word()] if kind < 0.99 else [w]
        return out

    docs = {}
    for d in range(40):
        text = [word() for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            text += edited(items[rng.randrange(8)], rng.choice([0, 4, 5, 7])) + [word() for _ in range(rng.randrange(20))]
        docs[d] = text
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.find_leaks(documents(spark, [(d, " ".join(w)) for d, w in docs.items()]), bench).collect()}
    want = {}
    for (d, text), (i, item) in itertools.product(docs.items(), items.items()):
        if (share := slow_alignment(text, item) / (2 * len(item))) >= decontaminate.MIN_SCORE and set(zip(item, item[1:], item[2:])) & set(zip(text, text[1:], text[2:])):
            want[d, i] = share
    assert got == pytest.approx(want) and len(want) > 15


def test_items_of_one_and_two_words(spark):
    bench = spark.createDataFrame([(1, "Zebra!"), (2, "red fox"), (3, " ... "), (4, ""), (5, None), (6, "red fox runs")], "item_id long, text string")
    rows = [(1, "a zebra here"), (2, "the red, FOX sits"), (3, "red big fox"), (4, "fox red"), (5, "zebras red"), (6, "red fox runs"), (7, None), (8, "")]
    got = {(r.doc_id, r.item_id, r.score, r.first_word, r.n_words) for r in decontaminate.find_leaks(documents(spark, rows), bench).collect()}
    assert {g for g in got if g[1] in (1, 2)} == {(1, 1, 1.0, 1, 1), (2, 2, 1.0, 1, 2), (6, 2, 1.0, 0, 2)}
    assert (6, 6, 1.0, 0, 3) in got and not {g for g in got if g[1] in (3, 4, 5)}
    assert {r.doc_id for r in decontaminate.drop_leaks(documents(spark, rows), bench.where("item_id < 3")).collect()} == {3, 4, 5, 7, 8}


@pytest.mark.parametrize("kind,ids", [("string", ["a", "b", None]), ("int", [1, 2, 3]), ("date", None)])
def test_item_ids_of_any_type(spark, kind, ids):
    bench = spark.createDataFrame([(i, prose(70 + i, 20)) for i in range(3)], "n int, text string")
    bench = bench.select(F.date_add(F.lit("2024-01-01").cast("date"), "n").alias("item_id") if ids is None else F.element_at(
        F.array(*[F.lit(x).cast(kind) for x in ids]), F.col("n") + 1).alias("item_id"), "text")
    got = decontaminate.find_leaks(documents(spark, [(i, prose(70 + i, 20)) for i in range(3)]), bench)
    assert got.schema["item_id"].dataType == bench.schema["item_id"].dataType
    assert {r.item_id for r in got.collect()} == {r.item_id for r in bench.collect()} and got.count() == 3


def test_one_block_or_many_give_the_same(spark):
    bench = spark.createDataFrame([(i, prose(i, 25)) for i in range(12)], "item_id long, text string")
    docs = documents(spark, [(i, prose(i, 25)[:60] + " " + prose(i + 1, 25)) for i in range(12)])
    whole = sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect()))
    assert whole == sorted(map(tuple, decontaminate.find_leaks(docs, bench, block_bytes=300).collect())) and whole
    assert pa.array([1]).type == pa.int64()
