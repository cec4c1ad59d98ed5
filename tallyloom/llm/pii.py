"""Personal data: exact base patterns, then a skip-chain conditional random field.

Base spans (email, ip, card, phone) follow fixed patterns. The field's nodes are
the base spans of a document, whose labels are given, and looser candidates
(numbers of seven digits or more in any grouping, addresses with a written
``(at)`` or without a dot). Neighbouring nodes share chain potentials; nodes with
the same digits or the same mailbox name, however far apart, share skip
potentials. Loopy message passing gives every candidate's label probabilities.
A candidate becomes a span when it has a skip link and a kind is at least
``ADD_AT`` likely, so a document without such a repeat gains nothing. Candidates
linked with each other alone pass messages too; the potentials decide.

Weights are learned by pseudo-likelihood from the base spans and candidates of a
bounded sample of documents (``MAX_TRAIN_DOCS`` rows, the smallest hashes of
their id and text, up to ``MAX_TRAIN_BYTES`` and ``MAX_TRAIN_NODES`` nodes each). Tasks turn
them into graphs, so the driver gets some 40 bytes a node and no text.

Scale: one pass without a shuffle. A group of equal tokens is linked as a chain
in text order, so links grow with the nodes, and the messages of all documents
of a batch are passed at once. Matching is linear in the text's length.

Nulls and empty texts: no spans. Offsets count code points. Repeated rows give
repeated results. With nothing to learn from, weights are zero and no span is added.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.common import below_cut, text_batches, texts_of

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # 0: no personal data
ADD_AT = 0.9
ROUNDS = 12
MAX_TRAIN_DOCS, MAX_TRAIN_BYTES, MAX_TRAIN_NODES = 4000, 1 << 18, 500

# The characters and patterns of the contract. Where a repetition can't give back
# characters to any use, it is possessive, and a run of digits is only entered at its start.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

DIGIT = re.compile("[0-9]")
NUMBER = re.compile(r"(?<![A-Za-z0-9])\(?[0-9](?:[ ().-]{0,2}[0-9]){6,}+(?![A-Za-z0-9@])")
WRITTEN_AT = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{1,64})(?: ?[\[(]at[\])] ?|@)[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")
NOT_DIGIT = re.compile("[^0-9]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base patterns, by kind and start."""
    out = [(0, s, e) for s, e in emails(text)]
    if not DIGIT.search(text):
        return out
    if "." in text:
        for m in IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((3, *m.span()))
    return out


@dataclass
class Graph:
    """Nodes and links of the documents of a batch."""
    spans: list[tuple[int, int, int, int]] = field(default_factory=list)  # document, start, end, given label
    shape: list[list[float]] = field(default_factory=list)
    chain: list[tuple[int, int]] = field(default_factory=list)
    skip: list[tuple[int, int]] = field(default_factory=list)

    def add(self, doc: int, text: str, base: list[tuple[int, int, int]]) -> None:
        taken = sorted((s, e) for _, s, e in base)
        nodes = [(s, e, k + 1) for k, s, e in base]
        loose = []
        if DIGIT.search(text):
            loose += [m.span() for m in NUMBER.finditer(text)]
        if "@" in text or "at)" in text or "at]" in text:
            loose += [m.span() for m in WRITTEN_AT.finditer(text)]
        at = 0
        for s, e in sorted(loose):
            while at < len(taken) and taken[at][1] <= s:
                at += 1
            if at == len(taken) or e <= taken[at][0]:
                nodes.append((s, e, 0))
        last: dict[str, int] = {}
        for s, e, label in sorted(nodes):
            here, piece = len(self.spans), text[s:e]
            if self.spans and self.spans[-1][0] == doc and s - self.spans[-1][2] <= 40:
                self.chain.append((here - 1, here))
            self.spans.append((doc, s, e, label))
            self.shape.append(shape_of(piece))
            key = link_key(piece)
            if key in last:
                self.skip.append((last[key], here))
            last[key] = here


def link_key(piece: str) -> str:
    """What equal or similar tokens share: the mailbox name, or the last eight digits."""
    found = WRITTEN_AT.match(piece)
    return "@" + found[1].lower() if found else NOT_DIGIT.sub("", piece)[-8:]


SIZES = (8, 10, 12, 15, 19)


def shape_of(piece: str) -> list[float]:
    """Shape alone, without the base patterns' own tests (plus sign, check digit)."""
    n = len(NOT_DIGIT.sub("", piece))
    name = not piece.replace(" ", "").replace("(", "").replace("+", "")[:1].isdigit() or "@" in piece
    step = sum(n > s for s in SIZES)
    return [1.0, float(name), *[float(step == i and not name) for i in range(len(SIZES) + 1)],
            float(piece.count(".") == 3 and not name), float("-" in piece and not name),
            float("(" in piece and not name), float(" " in piece and not name)]


SHAPES = len(shape_of("1"))


@dataclass
class Field:
    """Log potentials: node shapes x labels, chain label pairs, skip label pairs."""
    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def probabilities(self, graph: Graph) -> np.ndarray:
        """Label probabilities of each node by loopy message passing; given labels stay."""
        unary = np.array(graph.shape) @ self.node
        given = np.array([s[3] for s in graph.spans])
        fixed = np.flatnonzero(given)
        unary[fixed] = -50.0
        unary[fixed, given[fixed]] = 0.0
        links = np.array(graph.chain + graph.skip, np.int64).reshape(-1, 2)
        pair = np.concatenate([np.repeat(self.chain[None], len(graph.chain), 0), np.repeat(self.skip[None], len(graph.skip), 0)])
        src, dst = np.concatenate([links[:, 0], links[:, 1]]), np.concatenate([links[:, 1], links[:, 0]])
        pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(links)) + len(links), np.arange(len(links))])
        message = np.zeros((len(src), LABELS))
        for _ in range(ROUNDS if len(src) else 0):
            belief = unary.copy()
            np.add.at(belief, dst, message)
            out = log_sum((belief[src] - message[back])[:, :, None] + pair, 1)
            out -= out.max(1, keepdims=True)
            message = 0.5 * message + 0.5 * out
        np.add.at(unary, dst, message)
        return np.exp(unary - log_sum(unary, 1)[:, None])


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def learn(texts: list[str]) -> Field:
    """Field learned from whole texts, by ``fit``."""
    graph = Graph()
    for i, text in enumerate(texts):
        graph.add(i, text, base_spans(text))
    return fit([s[3] for s in graph.spans], graph.shape, graph.chain, graph.skip)


def fit(labels: list[int], shapes, chains, skips, steps: int = 300, penalty: float = 2e-3) -> Field:
    """Pseudo-likelihood: each node's label given its shape and its neighbours' labels."""
    weights = [np.zeros((SHAPES, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS))]
    if not len(labels):
        return Field(*weights)
    y = np.array(labels)
    one = np.eye(LABELS)[y]
    sides = []
    for links in (chains, skips):
        pair = np.array(links, np.int64).reshape(-1, 2)
        before, after = np.zeros_like(one), np.zeros_like(one)
        np.add.at(before, pair[:, 1], one[pair[:, 0]])
        np.add.at(after, pair[:, 0], one[pair[:, 1]])
        sides.append((before, after))
    x = np.array(shapes, np.float64)
    mean = [np.zeros_like(w) for w in weights]
    for step in range(steps):
        node, chain, skip = weights
        (cb, ca), (sb, sa) = sides
        z = x @ node + cb @ chain + ca @ chain.T + sb @ skip + sa @ skip.T
        err = (one - np.exp(z - log_sum(z, 1)[:, None])) / len(y)
        grads = [x.T @ err, cb.T @ err + err.T @ ca, sb.T @ err + err.T @ sa]
        for i, g in enumerate(grads):
            mean[i] = 0.9 * mean[i] + g - penalty * weights[i]
            weights[i] = weights[i] + 0.5 * mean[i]
    return Field(*weights)


def find(texts: list[str], crf: Field) -> list[tuple[list, list]]:
    """For each text its base spans and the spans the field adds, as (kind number, start, end)."""
    base = [base_spans(t) for t in texts]
    graph = Graph()
    for i, (text, spans) in enumerate(zip(texts, base)):
        nodes, chains, skips = len(graph.spans), len(graph.chain), len(graph.skip)
        graph.add(i, text, spans)
        if len(graph.skip) == skips:  # only linked nodes can become spans
            del graph.spans[nodes:], graph.shape[nodes:], graph.chain[chains:]
    added: list[list] = [[] for _ in texts]
    if graph.skip and any(not s[3] for s in graph.spans):
        p = crf.probabilities(graph)
        linked = {n for link in graph.skip for n in link}
        for i in linked:
            doc, s, e, given = graph.spans[i]
            best = int(p[i].argmax())
            if not given and best and p[i, best] >= ADD_AT:
                added[doc].append((best - 1, s, e))
    return list(zip(base, added))


def graph_rows(docs: DataFrame) -> DataFrame:
    """(place, labels, shapes, chain, skip): each text's graph, its links as pairs of node numbers one after the other.

    Texts of no node, or of more than ``MAX_TRAIN_NODES``, are left out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = pa.list_(pa.int32())
        kinds = pa.schema([("place", pa.int64()), ("labels", numbers), ("shapes", pa.binary()), ("chain", numbers), ("skip", numbers)])
        for batch in text_batches(batches):
            out = []
            for place, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
                graph = Graph()
                graph.add(0, text, base_spans(text))
                if 0 < len(graph.spans) <= MAX_TRAIN_NODES:
                    flat = lambda links: [n for pair in links for n in pair]
                    out.append({"place": place, "labels": [s[3] for s in graph.spans], "shapes": np.array(graph.shape, np.uint8).tobytes(),
                                "chain": flat(graph.chain), "skip": flat(graph.skip)})
            yield pa.RecordBatch.from_pylist(out, kinds)

    return docs.select("place", "text").mapInArrow(run, "place long, labels array<int>, shapes binary, chain array<int>, skip array<int>")


def train(docs: DataFrame, limit: int = MAX_TRAIN_DOCS) -> Field:
    """Field learned from the graphs of at most ``limit`` documents."""
    useful = docs.select("doc_id", "text").where(F.octet_length("text") <= MAX_TRAIN_BYTES).where(F.col("text").rlike("[0-9]{3}|@"))
    few = below_cut(useful, limit, "doc_id", "text").select(F.xxhash64("doc_id", "text").alias("place"), "text")
    rows = graph_rows(few).orderBy("place", "labels", "shapes").limit(limit).collect()  # some 40 bytes a node
    labels, shapes, chains, skips = [], [], [], []
    for r in rows:
        base = len(labels)
        labels += r["labels"]
        shapes.append(np.frombuffer(r["shapes"], np.uint8).reshape(-1, SHAPES))
        chains += [n + base for n in r["chain"]]
        skips += [n + base for n in r["skip"]]
    return fit(labels, np.concatenate(shapes) if shapes else [], chains, skips)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find_pii(docs: DataFrame, crf: Field) -> DataFrame:
    """One row per row of ``docs``: doc_id, ``base`` and ``added`` spans (kind, start, end)."""
    shared = docs.sparkSession.sparkContext.broadcast(crf)
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            found = find(texts_of(batch), shared.value)
            sides = [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in sorted(f[i])] for f in found], span)
                     for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *sides], names=["doc_id", "base", "added"])

    spans = "array<struct<kind:string,start:long,end:long>>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, base {spans}, added {spans}")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base spans by kind, their digest, and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    every = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(
        order[s["kind"]].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(text("base").cast("binary"), 256).alias("base_sha256"),
                        text(every).alias("spans"))
