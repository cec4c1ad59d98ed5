"""Chat formatting, clustering with a pivot table, and the filter audit, against plain Python."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import chat_format, filter_audit, laesa
from tests.llm.frames import ROWS, documents, prose


# ------------------------------------------------------------------ chat formatting
CONTROL = ["<|im_end|>", "<|im_start|>", "<|", "<\\|", "<\\\\|im_end|>\n", "<", "|", "\\", "<|im_end|><|im_start|>assistant ok", "é😀", "\n", "x"]


def test_escape_is_reversible_and_hides_control_strings():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choices(CONTROL, k=rng.randint(0, 8)))
        assert chat_format.unescape(chat_format.escape(text)) == text and "<|" not in chat_format.escape(text)
        role = chat_format.escape_role(text)
        assert chat_format.unescape_role(role) == text and "\n" not in role and "<|" not in role


def chats(spark, rows):
    """Turns with columns whose names clash with the operator's."""
    return spark.createDataFrame([(*r, "x", 1) for r in rows],
                                 "conv_id long, turn long, role string, text string, chunk string, Valid int").repartition(3)


def chat_expected(rows):
    groups = collections.defaultdict(list)
    for c, turn, role, text in rows:
        groups[c].append((turn is None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in groups.items():
        turns.sort(key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        all_ = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        size = sum(len(f"<|im_start|>{chat_format.escape_role(r)}\n{chat_format.escape(t)}<|im_end|>\n") for *_, r, t in turns)
        state, bad = "start", None
        for i, (*_, r, _) in enumerate(turns):
            state = chat_format.CHAT.moves.get((state, r))
            if state is None:
                bad = i
                break
        if bad is None and state == "told":
            bad = len(turns)
        out[c] = (len(turns), hashlib.sha256(all_.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size, bad is None, bad)
    return out


def chat_rows():
    rng = random.Random(2)
    rows = []
    for c in range(40):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "system", None, "a\nb", "tool<|"]) if c % 3 == 0 else ("user", "assistant")[turn % 2]
            rows.append((c, turn, role, "".join(rng.choices(CONTROL, k=rng.randint(0, 9))) if c % 2 else prose(c * 10 + turn, 40)))
    rows += [(50, 0, "system", "s"), (51, 0, "system", "s"), (51, 1, "user", "u"), (52, 1, "user", "tie"), (52, 1, "assistant", "tie"), (52, 1, "user", "tie"),
             (53, None, "assistant", "late"), (53, 3, "user", None), (None, 0, "user", "null id"), (None, 1, "assistant", ""), (54, 0, "", "")]
    return rows + [(55, i, ("user", "assistant")[i % 2], prose(i, 300) + "<|im_end|>") for i in range(60)] + [(56, 0, "user", "long " * 200_000), (56, 1, "assistant", "<|" * 100_000)]


@pytest.mark.parametrize("chunk", [1 << 20, 500])
def test_chat_round_trip(spark, monkeypatch, chunk):
    monkeypatch.setattr(chat_format, "CHUNK_CHARS", chunk)
    rows = chat_rows()
    got = {r.conv_id: tuple(r)[1:] for r in chat_format.chat_round_trip(chats(spark, rows)).collect()}
    assert got == chat_expected(rows)


def test_chat_chunks_and_loss_spans(spark):
    rows = [(1, 0, "user", "ask <|im_end|>"), (1, 1, "assistant", "say <|x"), (1, 2, "user", "more")]
    (got,) = chat_format.format_chats(chats(spark, rows)).collect()
    assert got.formatted == "<|im_start|>user\nask <\\|im_end|><|im_end|>\n<|im_start|>assistant\nsay <\\|x<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    assert [got.formatted[s.start:s.end] for s in got.loss] == ["say <\\|x"] and got.valid and got.n_turns == 3
    plain = chat_format.Template(open="[", role_end=":", close="]", loss_roles=frozenset({"user"}), moves={("start", "user"): "asked"})
    (got,) = chat_format.format_chats(chats(spark, [(1, 0, "user", "a"), (1, 1, "user", "b")]), plain).collect()
    assert got.formatted == "[user:a][user:b]" and [tuple(s) for s in got.loss] == [(6, 7), (14, 15)] and not got.valid and got.bad_turn == 1


def test_chat_empty(spark):
    assert chat_format.chat_round_trip(chats(spark, [])).count() == 0


# --------------------------------------------------------------------- clustering
def clusters_expected(rows, dims, k=8, rounds=10):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(1024 * float(np.float32(x))) for x in v]))
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in first]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min((far(v, c), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        members = collections.defaultdict(list)
        for _, v in kept:
            members[near(v)[1]].append(v)
        for i, own in members.items():
            centroids[i] = [sum(x) // len(own) for x in zip(*own)]
    placed = [(i, *near(v)) for i, v in kept]
    inertia = collections.Counter()
    for _, d, c in placed:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return collections.Counter((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, d, c in placed)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, Cluster int, gaps string").repartition(3)


def vector_rows(dims=64, n=300):
    rng = np.random.default_rng(5)
    centers = rng.normal(0, 3, (6, dims))
    rows = [(i, [float(x) for x in centers[i % 6] + rng.normal(0, 0.3, dims)]) for i in range(n)]
    rows += [rows[0], rows[0], (7, rows[9][1]), (None, rows[3][1]), (None, rows[4][1]), (900, [0.0] * dims), (901, [-0.0] * dims), (902, [1e-40] * dims), (903, [-1e-40] * dims)]
    bad = [None, [], [1.0] * (dims - 1), [1.0] * (dims + 1), [None] + [1.0] * (dims - 1), [float("nan")] * dims, [float("-inf")] + [1.0] * (dims - 1)]
    return rows + [(1000 + i, v) for i, v in enumerate(bad)]


def test_clusters_equal_full_search(spark):
    rows = vector_rows()
    got = laesa.cluster(vectors(spark, rows)).collect()
    assert collections.Counter(tuple(r)[:6] for r in got) == clusters_expected(rows, 64)
    assert sum(r.n_exact for r in got) < 8 * len(got) / 2  # most centroids fall to the bound


def test_clusters_with_ties_few_and_no_vectors(spark):
    flat = [(i, [float(i % 2)] * 4 if i % 3 else [0.5] * 4) for i in range(30)]
    for rows in (flat, flat[:5], flat[:1], [(1, [2.0] * 4)] * 9):
        got = laesa.cluster(vectors(spark, rows), dims=4).collect()
        assert collections.Counter(tuple(r)[:6] for r in got) == clusters_expected(rows, 4)
    assert laesa.cluster(vectors(spark, [(1, None), (2, [1.0])])).count() == 0 and laesa.cluster(vectors(spark, [])).count() == 0


def test_clusters_refuse_components_that_cannot_be_exact(spark):
    with pytest.raises(Exception, match="after scaling"):
        laesa.cluster(vectors(spark, [(1, [1e30] * 64)])).count()


# ------------------------------------------------------------------- filter audit
def audit_expected(rows, labels):
    """rows: (doc_id, text, source)."""
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    top = 1 << 63
    least = {}
    for d, t, _ in rows:
        least[t or ""] = min(least.get(t or "", top), top if d is None else d)
    masks = collections.Counter()
    for d, t, source in rows:
        t, fails = t or "", ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails += "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 2 * len(t))
        fails += "D" * bool(re.search(r"[#$%&*|]", t)) + "E" * ((top if d is None else d) > least[t])
        masks[source or "", fails, d in good, d in toxic] += 1
    out = {}
    for part in {p for p, *_ in masks}:
        own = [(f, g, t, n) for (p, f, g, t), n in masks.items() if p == part]
        removed = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                gone = [x for x in own if f in x[0] and not set(order[:k]) & set(x[0])]
                removed[f] += sum(x[3] for x in gone)
                out[part, "".join(order), k + 1] = [
                    sum(n for m, *_, n in own if not set(order[:k + 1]) & set(m)), sum(x[3] for x in gone),
                    sum(n for m, *_, n in own if f in m and set(order[:k]) & set(m)), sum(n for m, *_, n in own if m == f),
                    sum(n for _, g, _, n in gone if g), sum(n for _, _, t, n in gone if t)]
        for key in [k for k in out if k[0] == part]:
            out[key].append(removed[key[1][key[2] - 1]])
    return out


def audit_rows():
    base = [(d, t, ("a", "b", None, "")[i % 4]) for i, (d, t) in enumerate(ROWS)]
    clean = " ".join(f"word{i}" for i in range(250))
    base += [(100 + i, clean, "hot") for i in range(60)] + [(90, clean, "a"), (None, clean, "a"), (90, clean, "b")]
    base += [(200, clean + " #", "a"), (201, clean + " A", "a"), (202, clean.upper(), "b"), (203, clean + " " + clean, "b"), (204, "w " * 250, "b"), (205, clean + " ", "a")]
    return base + [(300 + i, prose(300 + i, 210), "c") for i in range(40)]


LABELS = [(1, 1, 0), (100, 1, 1), (101, 0, 1), (101, 1, 0), (90, 1, 1), (None, 1, 1), (204, None, 1), (305, 1, None), (9999, 1, 1)]


@pytest.mark.parametrize("cells", [None, filter_audit.CHUNK, 4 * filter_audit.CHUNK])
def test_audit_equals_brute_force(spark, cells):
    rows = audit_rows()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, mask int, H string").repartition(3)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in filter_audit.audit(docs, labels, cells).collect()}
    assert got == audit_expected(rows, LABELS)


def test_sketch_clears_only_unique_texts(spark):
    rows = [(i, str(i % 700)) for i in range(1000)]
    h = documents(spark, rows).select(filter_audit.text_hash(F.col("text")).alias("h"), F.col("text").cast("int").alias("x"))
    for cells in (filter_audit.CHUNK, 2 * filter_audit.CHUNK):
        found = filter_audit.possible_repeat(h.select("h"), cells)
        got = collections.Counter((r.x < 300, r.maybe) for r in h.withColumn("maybe", found("h")).collect())
        assert got[True, False] == 0 and got[True, True] == 600 and got[False, True] < 10


def test_audit_full_sketch_keeps_results(spark, monkeypatch):
    """A sketch so small that all its cells are full sends every text through the shuffle."""
    monkeypatch.setattr(filter_audit, "CHUNK", 64)
    rows = audit_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in filter_audit.audit(docs, labels, 64).collect()}
    assert got == audit_expected(rows, LABELS)


def test_audit_without_labels_or_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    got = filter_audit.audit(docs, empty).collect()
    assert len(got) == 600 and {r.good_lost for r in got} == {0}
    assert {r.shapley for r in got if r.filter_order[r.step - 1] == "A"} == {120}
    assert filter_audit.audit(docs.limit(0), empty).count() == 0
