"""Corpus operators against brute force, the libraries they stand for, and odd rows."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from folioflow.llm import bytebpe, langid, linededup, mixing, neardup, quality, queries, tokencount, topk, urlfilter, warc
from folioflow.llm.common import Scratch

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (None, "a b c d e f g"), (5, "Straße 漢字 ​ x y²\n" * 3), (6, "word " * 5000), (7, "<|endoftext|> don't a'LL  ")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None if i == 2 else f"s{(i or 0) % 3}", "en", 7) for i, t in ODD], "doc_id long, text string, source string, lang string, size int")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "documents embeddings pages labels".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    found = duck.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda row: tuple(map(repr, row))
    assert sorted(map(key, df.select(*columns).collect())) == sorted(map(key, found.fetchall()))


def test_byte_bpe_is_the_library(spark, odd):
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = bytebpe.read_ranks(path)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    want = Counter()
    for i, t in docs.collect():
        ids = lib.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, bytebpe.round_trip(docs, path, P.PATTERN).collect())) == want
    ids = bytebpe.encode_texts(odd, path)
    assert Counter(bytes(r.text).decode() for r in bytebpe.decode_ids(ids, path).collect()) == Counter(t or "" for _, t in ODD)


def test_token_counts_are_the_library(spark, odd):
    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    want = Counter((i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in docs.collect())
    assert Counter(map(tuple, tokencount.count_tokens(docs, path).collect())) == want


def test_language_held_out_accuracy(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    right = langid.predict(docs, model).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95
    got = {r.doc_id: r.lang_pred for r in langid.predict(odd, model).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[4] != "und"
    assert {r.lang_pred for r in langid.predict(odd, langid.train(odd.limit(0))).collect()} == {"und"}


def test_rules_and_urls(spark):
    urls = ["https://m.example.net/en/1", "https://a.NET/x", "http://b.net", "http://example.com/de/?q", "http://x.org/fr/#t", "no scheme", None, "http://notexample.com/de/", "", "http://h/" + "p" * 5000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1))
    got = {r.page_id: r for r in urlfilter.judge(df, urlfilter.train(spark)).collect()}
    assert [got[i].rule for i in range(9)] == ["example.net/en/", "net/", None, "example.com/de/", "org/fr/", None, None, None, None]
    assert got[1].host == "a.net" and got[2].path == "" and got[5].host == got[6].host == "" and got[3].path == "/de/"
    assert all(r.verdict in ("allow", "block") for r in got.values())
    model = urlfilter.train(spark)
    table = urlfilter.table_of(spark, urlfilter.labelled_urls())
    assert urlfilter.judge(table, model, rules=()).where("(verdict = 'block') = (label = 1)").count() == table.count()
    held = urlfilter.judge(urlfilter.table_of(spark, urlfilter.labelled_urls(held_out=True)), model, rules=())
    right = dict(held.groupBy("label").agg(F.avg(((F.col("verdict") == "block") == (F.col("label") == 1)).cast("int"))).collect())
    assert right[1] > 0.6 and right[0] > 0.97  # words that training never saw


def test_quality_statistics_and_monotone_trees(spark, odd):
    words = "a b c d e f a b c d e x".split()
    assert quality.repeated_words(words) == 10
    stats, _ = quality.statistics("x # y\n\nx # y\nz|\n")
    assert stats == (7, 8, 3, 1, 0)
    rng = np.random.default_rng(1)
    x = rng.random((400, 2))
    trees = quality.grow(x, (x[:, 0] + 0.3 * rng.random(400) < 0.6).astype(float), [-1, 0], trees=20)
    line = np.stack([np.linspace(0, 1, 50), np.full(50, 0.5)], 1)
    assert (np.diff(trees.probability(line)) <= 1e-12).all()
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    judged = quality.judge(docs, quality.train(docs, labels)).join(labels, "doc_id").where("not base_failed")
    assert judged.where("kept = (quality = 1)").count() > 0.95 * judged.count()
    empty = quality.train(docs, labels.limit(0))
    assert {r.kept for r in quality.judge(odd, empty).where("not base_failed").collect()} <= {True}
    assert quality.judge(odd, empty, carry=True).columns == odd.columns


def test_alignment_is_a_banded_lcs():
    random.seed(5)
    for _ in range(200):
        a = [random.randint(0, 5) for _ in range(random.randint(0, 25))]
        b = [x for x in a if random.random() < 0.9] + [random.randint(0, 5) for _ in range(3)]
        row = [0] * (len(a) + 1)
        for y in b:
            new = [0]
            for i, x in enumerate(a):
                new.append(row[i] + 1 if x == y else max(row[i + 1], new[i]))
            row = new
        assert neardup.aligned(a, b, len(a) + len(b)) == row[-1]


def test_near_duplicates(spark, odd):
    random.seed(2)
    base = [f"w{i}" for i in range(400)]
    texts = {10: base, 11: base[:], 12: base[:200] + ["new"] + base[201:], 13: base + ["tail"], 14: base[:200] + [f"v{i}" for i in range(200)], 15: base[200:] + base[:200]}
    near = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    got = defaultdict(set)
    for r in neardup.near_duplicates(near).collect():
        got[r.doc_id].add((r.class_id, r.class_size))
    assert [got[i] for i in (10, 11, 12, 13)] == [{(10, 4)}] * 4 and got[14] == {(14, 1)} and got[15] == {(15, 1)}
    assert got[1] == {(1, 1)} and got[4] == {(4, 2)}
    kept = neardup.one_of_each(near.withColumn("node", F.lit(0)))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 10, 14, 15]
    assert neardup.near_duplicates(near.limit(0)).count() == 0


def passage_texts(n, pairs, hot, seed=4):
    """doc_id -> text: ``n`` texts share a long passage, ``pairs`` of them have a near copy, one has ``hot`` near copies."""
    rng = random.Random(seed)
    fresh = lambda k: [f"x{rng.getrandbits(40)}" for _ in range(k)]
    passage = fresh(304)
    texts = [passage + fresh(44) for _ in range(n)]
    texts += [t[:-34] + fresh(34) for t in texts[:pairs]] + [texts[-1][:-1] + fresh(1) for _ in range(hot)]
    rng.shuffle(texts)
    return {i: " ".join(t) for i, t in enumerate(texts)}


def brute_classes(texts):
    """doc_id -> smallest doc_id of its class, from the similarity of every pair."""
    arrays = {i: neardup.word_hashes(t) for i, t in texts.items()}
    sets = {i: neardup.labelled(neardup.shingles(a)) for i, a in arrays.items()}
    top = {i: i for i in texts}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(i for i in texts if len(sets[i]))
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            x, y = sets[i], sets[j]
            if min(len(x), len(y)) < 0.8 * max(len(x), len(y)) or root(i) == root(j):
                continue
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both >= 0.8 * (len(x) + len(y) - both) - 1e-9 and neardup.similarity(arrays[i], arrays[j]) >= 0.8 - 1e-9:
                top[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i in texts}


def test_near_duplicates_in_hot_buckets_are_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CELL", 100, raising=False)  # so that buckets are dealt into bands and cells
    texts = passage_texts(500, 40, 120)
    texts[1000] = " ".join(f"long{i}" for i in range(60_000))
    texts[1001] = texts[1000] + " tail"
    want = brute_classes(texts)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == want and Counter(Counter(want.values()).values())[2] >= 40


def test_lines_and_mix_on_odd_rows(spark, odd):
    rows = [(i, f"shared line of five words\nown text of document {i}", f"s{i}", "en", 1) for i in range(12)]
    df = odd.unionByName(spark.createDataFrame([(i + 100, *r) for i, *r in rows], odd.schema))
    clean = {r.doc_id: r for r in linededup.dedup_lines(df).where("doc_id >= 100").collect()}
    assert clean[100].n_removed == 0 and all(clean[i].text == f"own text of document {i - 100}" for i in range(101, 112))
    mixed = mixing.mix(df).collect()
    assert len(mixed) == df.count() and all(r.taken <= 3 * r["size"] for r in mixed)
    assert mixing.mix(df, carry=True).columns == df.columns
    assert mixing.mix(df.limit(0)).count() == linededup.dedup_lines(df.limit(0)).count() == 0
    totals = spark.createDataFrame([("b", 10), (None, 10), ("a", 100)], "source string, source_size long")
    targets = {r.source: r.target for r in mixing.water_fill(totals, (1, 2, 3), 3, Scratch(spark)).collect()}
    assert targets == {"a": 60.0, "b": 30.0, None: 30.0}


def test_line_stage_takes_short_lines(spark):
    rows = [(i, f"All rights reserved.\nOk\n\nown text {i}", f"s{i}") for i in range(12)]
    out = corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), SF)
    assert {r.doc_id: r.text for r in out.collect()} == {i: rows[0][1] if not i else f"\nown text {i}" for i in range(12)}


def test_search_ties_nulls_and_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.integers(-3, 4, 6) / 2]) for i in range(300)] + [(500, [None] * 6), (550, None), (600, [float("nan")] * 6), (650, [float("inf")] * 6)]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = defaultdict(list)
    for r in topk.search(v, v.where("vec_id % 50 = 0"), cell=64, chunk=2).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    data = {r.vec_id: np.array(r.v) for r in v.collect()}
    assert set(got) == {i for i in data if i % 50 == 0}
    for q, found in got.items():
        assert found == [(i, -s) for s, i in sorted((-int(data[q] @ w), i) for i, w in data.items() if i != q)[:5]]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<p>Caf&eacute; &lt;b&gt;</p><script>x</script>"), (2, None, None)], "page_id long, url string, html string")
    records = warc.derive(warc.responses(pages), key="page_id").collect()
    assert [r.block for r in records if r.record_type == "conversion"] == ["Café <b>", ""]
    assert all(r.refers_to.startswith("<urn:uuid:") and r.content_length == len(r.block.encode()) for r in records)
    head = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n<p>hi"
    (tmp_path / "a.warc").write_bytes(warc.render("response", "<urn:uuid:1>", None, "http://b/", warc.DATE, "application/http; msgtype=response", head))
    made = warc.derive(warc.read_responses(spark, str(tmp_path)))
    assert {r.record_type: r.block for r in made.collect()}["conversion"] == "hi"
    assert "source-server: x" in made.where("record_type = 'metadata'").first().block
    raw = bytes(warc.rendered(made).first().warc)
    (fields, block), *rest = warc.parse(raw)
    assert fields["warc-refers-to"] == "<urn:uuid:1>" and not rest and len(block) == int(fields["content-length"])
