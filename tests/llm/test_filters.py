"""Quality classifier, URL filter, decontamination, personal data, tokens, pipeline."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import bpe, decontaminate, pii, quality, queries, token_counts, url_filter
from tests.conftest import SF_SMALL
from tests.llm.frames import ROWS, documents, none, prose
from tests.oracle_check import compare, duckdb_con

SF = "/root/testdata/sf0.01"


def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def tokenizer():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary())


# ---------------------------------------------------------------- registered SQL
@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_query_equals_sql(spark, key):
    got = compare(spark, duckdb_con(SF_SMALL), key, queries.QUERIES[key], queries.ORACLES[key], SF_SMALL)
    assert got["status"] == "ok", got


# --------------------------------------------------------------------- quality
def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.op2_quality(spark, SF).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 50 and (got.predicted == got.quality).mean() > 0.95
    assert all(zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id)


def test_quality_edge_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1), (5, 0), (16, 1), (17, 0), (None, 1), (9, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == (r.score >= 0.3) for r in got)
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.score(none(spark), model).count() == 0


def test_quality_without_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(documents(spark), empty)
    assert {r.score for r in quality.score(documents(spark), model).collect()} == {0.5}


def test_attention_gradient_lowers_loss():
    texts = pa.array(["good words here " * 60 + "!!!! #### " * (80 * (i % 2)) for i in range(40)])
    y = np.array([1 - i % 2 for i in range(40)])
    p = quality.fit(texts, y, 40).score(texts)
    assert p[y == 1].min() > 0.9 and p[y == 0].max() < 0.1


# ------------------------------------------------------------------ url filter
def test_url_rules_and_parts(spark):
    urls = ["http://WWW.Example.com/en/x?q#f", "https://a.example.com/en/", "https://example.com/de", "ftp://b.net/es/1", "nope", None,
            "x://c.net", "http://d.org?x://y/", "http://notexample.com/en/", "http://e.net/fr/?a", "://", "http://É.org/Ä#"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none_ = spark.createDataFrame([], "page_id long, bad int")
    got = {r.page_id: tuple(r)[1:5] for r in url_filter.filter_urls(pages, none_).collect()}
    assert got == {
        0: ("www.example.com", "/en/x", "www.example.com/en/", "allow"), 1: ("a.example.com", "/en/", "example.com/en/", "block"),
        2: ("example.com", "/de", "com/", "allow"), 3: ("b.net", "/es/1", "net/es/", "block"), 4: ("", "", None, "allow"),
        5: ("", "", None, "allow"), 6: ("c.net", "", None, "allow"), 7: ("d.org", "", None, "allow"),
        8: ("notexample.com", "/en/", "com/", "allow"), 9: ("e.net", "/fr/", "net/fr/", "block"), 10: ("", "", None, "allow"),
        11: ("É.org", "/Ä", None, "allow")}


def test_domains_and_suffixes(spark):
    want = {"a.b.example.com": ("example.com", "com"), "example.com:8080": ("example.com", "com"), "example.com.": ("example.com", "com"),
            "www.shop.co.uk": ("shop.co.uk", "co.uk"), "shop.co.uk:80": ("shop.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"),
            "x.com.au": ("x.com.au", "com.au"), "10.0.0.1": ("10.0.0.1", "10.0.0.1"), "10.0.0.1:99": ("10.0.0.1", "10.0.0.1"),
            "[::1]:80": ("[::1]", "[::1]"), "me:pw@a.example.org": ("example.org", "org"), "localhost": ("localhost", "localhost"), "": ("", "")}
    hosts = spark.createDataFrame([(h,) for h in want], "host string")
    got = hosts.select("host", url_filter.domain_of(F.col("host")), url_filter.suffix_of(F.col("host"))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == want


def test_bad_probability_is_the_betas_tail(spark):
    """Whole parameters have a closed form: the tail of a binomial."""
    cases = [(a, b) for a in (1, 2, 3, 7, 40, 300) for b in (1, 2, 5, 30, 900)]
    tail = lambda a, b, x: sum(math.comb(a + b - 1, j) * x ** j * (1 - x) ** (a + b - 1 - j) for j in range(a))
    frame = spark.createDataFrame([(float(a), float(b)) for a, b in cases], "alpha double, beta double")
    for limit in (0.05, 0.25, 0.6):
        got = {(r.alpha, r.beta): r.p for r in frame.select("alpha", "beta", url_filter.bad_probability(limit).alias("p")).collect()}
        assert all(got[a, b] == pytest.approx(tail(a, b, limit), abs=2e-4) for a, b in cases)
    odd = spark.createDataFrame([(1e9, 1e9), (1e-6, 2.0), (2.0, 1e-6), (3e8, 7e8), (2e8, 8e8)], "alpha double, beta double")
    assert [round(r[0], 2) for r in odd.select(url_filter.bad_probability(0.25)).collect()] == [1.0, 0.0, 1.0, 1.0, 0.0]


HOSTS = ["a.shop.co.uk", "b.shop.co.uk:80", "c.other.co.uk", "10.0.0.1", "10.0.0.1:99", "10.0.0.2", "[::1]:8", "u:p@x.site.org.", "x.site.org", "localhost", "q.com.au"]


def test_url_query_equals_sql_on_awkward_hosts(spark, tmpdir_path):
    rng = random.Random(6)
    hosts = HOSTS + [f"h{i}.d{i % 7}.{'net' if i % 2 else 'co.uk'}" for i in range(30)]
    rows = [(i, f"http://{rng.choice(hosts)}/{rng.choice(['en', 'es/', ''])}") for i in range(600)] + [(700, None), (701, "no scheme"), (702, "x://")]
    labels = [(i, int(rng.random() > 0.3 * (zlib.crc32(rows[i][1].encode()) % 3)), 0) for i in range(0, 600, 2)]
    spark.createDataFrame(rows, "page_id long, url string").coalesce(1).write.parquet(f"{tmpdir_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmpdir_path}/labels.parquet")
    import duckdb
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmpdir_path}/{name}.parquet/*.parquet')")
    got = compare(spark, con, "op4_url_filter", queries.QUERIES["op4_url_filter"], queries.ORACLES["op4_url_filter"], tmpdir_path)
    assert got["status"] == "ok" and got["spark_rows"] == 603, got


def test_host_reputation_blocks_bad_hosts_only(spark):
    rows = [(i, f"http://{'bad' if i % 2 else 'good'}{i % 4}.site{i % 3}.org/p") for i in range(400)]
    pages = spark.createDataFrame(rows + [(1000, "http://new.site1.org/"), (None, "http://bad1.site1.org/")], "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(5, None)], "page_id long, bad int")
    got = url_filter.filter_urls(pages, labels, rules=()).collect()
    assert all((r.verdict == "block") == ("bad" in r.host) for r in got if r.host != "new.site1.org")
    p = {r.host: r.bad_probability for r in got}
    assert p["good0.site1.org"] < p["new.site1.org"] < p["bad1.site1.org"]
    assert url_filter.filter_urls(pages.limit(0), labels).count() == 0


# --------------------------------------------------------------- decontamination
def test_leaks_planted_and_clean(spark):
    items = [(i, prose(900 + i, 30 + i)) for i in range(6)] + [(50, "too short"), (51, None)]
    rng = random.Random(2)

    def edit(text, n):
        w = text.split(" ")
        for i in rng.sample(range(len(w)), n):
            w[i] = "zzz"
        return " ".join(w)
    rows = ROWS + [(200 + i, prose(70 + i, 50) + " " + edit(items[i][1], i) + " " + prose(80 + i, 50)) for i in range(6)]
    rows += [(300, items[0][1].upper()), (301, " ".join(items[1][1].split(" ")[:20])), (302, items[2][1].replace(" ", " - "))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(documents(spark, rows), bench).collect()}
    assert set(got) == {(200 + i, i) for i in range(6)} | {(300, 0), (301, 1), (302, 2)}
    assert got[(300, 0)].score == 1.0 and got[(300, 0)].first_word == 0 and got[(200, 0)].first_word == 50
    blocks = decontaminate.find_leaks(documents(spark, rows), bench, block_bytes=200).collect()
    assert {(r.doc_id, r.item_id) for r in blocks} == set(got)
    docs = documents(spark, rows)
    kept = decontaminate.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 9


@pytest.mark.parametrize("copies", [10, 30, 60])
def test_one_edited_copy_in_many_documents_leaks(spark, copies):
    words = [f"w{i}" for i in range(40)]
    passage = " ".join("edit" if i % 5 == 2 else w for i, w in enumerate(words))
    rows = [(i, f"{prose(i, 20)} {passage} {prose(1000 + i, 20)}") for i in range(copies)] + [(900, prose(900, 80))]
    rows += [(901, " ".join(words[:5] + ["x"] * 60 + words[30:]))]  # common n-grams of the item, too few of its words
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    got = decontaminate.find_leaks(documents(spark, rows), bench).collect()
    assert sorted(r.doc_id for r in got) == list(range(copies)) and {r.score for r in got} == {0.7}
    assert {(r.first_word, r.n_words) for r in got} == {(20, 40)}
    assert {r.doc_id for r in decontaminate.drop_leaks(documents(spark, rows), bench).collect()} == {900, 901}


def test_common_ngrams_alone_are_aligned():
    rng = random.Random(5)
    for _ in range(300):
        wanted = [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 25))]
        text = [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(0, 60))]
        text[10:10] = [w if rng.random() < 0.8 else "zz" for w in wanted]
        items = decontaminate.Items.of([1], pa.array([" ".join(wanted)]))
        w, begin = decontaminate.words_of(pa.array([" ".join(text)]))
        best = max((decontaminate.align(w[a:b], items.words) for *_, a, b in zip(*items.windows(begin, *items.hits(w, begin)))),
                   default=(0, 0, 0))[0] if len(items.hits(w, begin)[0]) else 0
        items.seed[:] = False
        got = list(items.leaks(pa.array([" ".join(text)])))
        assert [s for _, _, s, *_ in got] == ([best / 2 / len(wanted)] if best >= len(wanted) else [])


def test_leaks_empty(spark):
    bench = spark.createDataFrame([(1, prose(2, 40))], "item_id long, text string")
    assert decontaminate.find_leaks(none(spark), bench).count() == 0
    assert decontaminate.find_leaks(documents(spark), bench.limit(0)).count() == 0
    assert decontaminate.drop_leaks(documents(spark), bench.limit(0)).count() == len(ROWS)


def slow_align(a, b):
    best, table = 0, np.zeros((len(b) + 1, len(a) + 1), int)
    for i in range(1, len(b) + 1):
        for j in range(1, len(a) + 1):
            table[i, j] = max(0, table[i - 1, j - 1] + (2 if a[j - 1] == b[i - 1] else -1), table[i - 1, j] - 1, table[i, j - 1] - 1)
            best = max(best, table[i, j])
    return best


def test_alignment_equals_full_table():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = (rng.integers(0, 4, rng.integers(1, 25)).astype(np.uint64) for _ in range(2))
        score, start, size = decontaminate.align(a, b)
        assert score == slow_align(a, b) and slow_align(a[start:start + size], b) == score


# ----------------------------------------------------------------- personal data
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def slow_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def slow_base(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == 0 or kind == 1 and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == 2 and 13 <= len(digits) <= 19 and slow_luhn(digits) or kind == 3 and 9 <= len(digits) <= 15):
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    parts = list("ab1234567890.-+@ ()_%é") + ["1.2.3.4", "+1 (555) 555-1234", "a@b.co", "4111111111111111", "4111 1111 1111 1111"]
    for _ in range(5000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 50)))
        assert pii.base_spans(text) == slow_base(text), text


def test_field_adds_linked_repeats_only(spark):
    field = pii.train(spark.read.parquet(f"{SF}/documents.parquet"))
    texts = ["mail joe.doe@x.com or joe.doe (at) x com", "joe.doe (at) x com", "12345678 and 12345678", "", "no data"]
    found = pii.find(texts, field)
    assert [k for k, *_ in found[0][1]] == [0] and all(not added for _, added in found[1:])


def test_field_runs_on_candidates_without_base_spans():
    text = "joe (at) x.com, joe (at) x.com; joe (at) x.com, ann (at) y.org"
    crf = pii.Field(np.zeros((pii.SHAPES, pii.LABELS)), np.zeros((pii.LABELS, pii.LABELS)), np.zeros((pii.LABELS, pii.LABELS)))
    crf.node[1, 1], crf.skip[1, 1] = 1.0, 3.0  # a name may be an address; two alike are likely to be
    got = pii.find([text, "joe (at) x.com", "no data"], crf)
    assert [base for base, _ in got] == [[], [], []]
    assert sorted(got[0][1]) == [(0, 0, 14), (0, 16, 30), (0, 32, 46)] and got[1][1] == got[2][1] == []


@pytest.mark.parametrize("kind,base,loose", [(2, "4111 1111 1111 1111", "4111.1111.1111.1111"), (3, "+1 (523) 555-1055", "(523) 555-1055")])
def test_field_adds_cards_and_phones(kind, base, loose):
    text = f"{base} {'x' * 50} {loose}"
    crf = pii.Field(np.zeros((pii.SHAPES, pii.LABELS)), np.zeros((pii.LABELS, pii.LABELS)), 4 * np.eye(pii.LABELS))
    (spans, added), = pii.find([text], crf)
    assert [k for k, *_ in spans] == [kind] and added == [(kind, len(text) - len(loose), len(text))]


def test_pii_rows(spark):
    rows = ROWS + [(60, "é +1 (523) 555-1055, a.b@c.org 1.2.3.4, 4111111111111111"), (61, "1" * 50_000), (62, "a@" * 5000)]
    got = {r.doc_id: r for r in pii.digest(pii.find_pii(documents(spark, rows), pii.learn([]))).collect()}
    assert len(got) == len({d for d, _ in rows})
    r = got[60]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    assert r.spans == "email:21:30,ip:31:38,card:40:56,phone:2:19" and r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
    assert got[4].spans == "" and got[3].n_email == 0
    assert pii.find_pii(none(spark), pii.learn([])).count() == 0


# --------------------------------------------------------------------------- BPE
def test_bpe_equals_the_library():
    model, library = bpe.SpeculativeBpe(vocabulary()), tokenizer()
    rng = random.Random(3)
    parts = list("abcdefgh the in on 123 \n\t'sll!!  éèß中文😀\x00\u3000.,aaaa") + ["<|endoftext|>", " the", " and", "ing", "   "]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 80))) for _ in range(4000)]
    texts += ["", " ", "a" * 3000, "ab" * 2000, " " * 500, "<|endoftext|>", "x<|endoftext|> y"] + [t for _, t in ROWS if t and len(t) < 20_000]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = model.encode_batch(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want
    assert [model.decode(g) for g in got] == [library.decode(w, skip_special_tokens=False) for w in want] == texts
    assert 0 < model.failed < model.tested


def test_bpe_frames(spark):
    docs = documents(spark).withColumn("token_ids", F.lit("taken"))
    got = bpe.encode(docs, vocabulary())
    assert got.columns == [*docs.columns, "token_ids_"]
    sizes = {r.row_key: len(r.token_ids_) for r in got.collect()}
    trip = bpe.round_trip(docs, vocabulary()).collect()
    assert sorted(sizes.values()) == sorted(r.n_tokens for r in trip) and all(r.lossless for r in trip)
    assert bpe.round_trip(none(spark), vocabulary()).count() == 0


# ------------------------------------------------------------------ token counts
def test_token_counts_equal_encoding(spark):
    library = tokenizer()
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = collections.Counter(map(tuple, token_counts.document_token_counts(docs, vocabulary()).collect()))
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert got == collections.Counter((r.doc_id, len(library.encode(r.text, add_special_tokens=False).ids)) for r in rows)


@pytest.mark.parametrize("block,run_blocks", [(2, 2), (6, 3), (64, 1), (4096, 8)])
def test_separator_scan_stitches_blocks(spark, tmpdir_path, block, run_blocks):
    rng = random.Random(block)
    want = {}
    for f in range(4):
        counts = [rng.choice([0, 0, 1, 2, 5, 40]) for _ in range(30)] if f else []
        ids = [x for n in counts for x in [rng.randint(1, 65535) for _ in range(n)] + [0]]
        tail = [9] * (f == 2) * 7
        np.array(ids + tail, "<u2").tofile(f"{tmpdir_path}/part-{f}")
        want |= {(f, i): (n, True) for i, n in enumerate(counts)} | ({(f, len(counts)): (7, False)} if tail else {})
    got = token_counts.count_documents(token_counts.token_blocks(spark, tmpdir_path, block), run_blocks).collect()
    assert {(int(r.file[-1]), r.doc_no): (r.n_tokens, r.ended) for r in got} == want and len(got) == len(want)


# ---------------------------------------------------------------------- pipeline
def test_pipeline_stages(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    now, sizes = docs, []
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, SF_SMALL).cache()
        sizes.append(now.count())
        if name != "encode":
            assert now.columns == docs.columns
            assert now.join(before.select("doc_id", "text"), ["doc_id", "text"], "left_anti").isEmpty()
    assert now.columns == [*docs.columns, "token_ids"] and sizes == sorted(sizes, reverse=True)
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    good = docs.join(labels.where("quality = 1"), "doc_id").count()
    assert corpus_pipeline.STAGES[0][1](spark, docs, SF_SMALL).join(labels.where("quality = 1"), "doc_id").count() >= 0.97 * good
    ran = corpus_pipeline.run(spark, SF_SMALL)
    assert ran.count() == sizes[-1]


def test_pipeline_on_awkward_and_empty_documents(spark):
    import corpus_pipeline
    for docs in (documents(spark), none(spark)):
        now = docs
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF_SMALL)
        assert set(docs.columns) <= set(now.columns)
        assert now.count() <= len(ROWS)


def test_hash_sample_is_bounded_and_the_same_on_any_partitioning(spark):
    from tallyloom.llm.common import hash_sample
    rows = spark.range(5000).withColumnRenamed("id", "doc_id")
    want = {r.doc_id for r in rows.orderBy(F.xxhash64("doc_id")).limit(100).collect()}
    assert {r.doc_id for r in hash_sample(rows, 100, "doc_id").collect()} == want
    assert {r.doc_id for r in hash_sample(rows.repartition(7), 100, "doc_id").collect()} == want
    assert hash_sample(rows, 9000, "doc_id").count() == 5000 and hash_sample(rows.limit(0), 10, "doc_id").count() == 0
