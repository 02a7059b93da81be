"""Corpus operators against brute force over whole small tables, and rows that are odd in every way."""

import hashlib
import math
import re
import time
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

from .test_corpus import brute_classes

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(sf):
    found = duckdb.sql(f"select doc_id, text, source, lang from '{sf}/documents.parquet' order by doc_id").fetchall()
    return [dict(zip(("doc_id", "text", "source", "lang"), r)) for r in found]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- mixing


def solved(sizes, target, cap=3):
    """Rates of documents of these sizes whose words add up to the target: bisection on the dual's one multiplier."""
    mean, low, high = sum(sizes) / len(sizes), -1e4, 1e4
    rate = lambda lam: [min(cap, math.exp(min(5.0, lam * s / mean))) for s in sizes]
    for _ in range(300):
        lam = (low + high) / 2
        low, high = (lam, high) if sum(s * r for s, r in zip(sizes, rate(lam))) < target else (low, lam)
    return rate(low)


def check_mix(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    total = sum(r.size for r in rows)
    weights, targets, left, open_ = {s: i % 3 + 1 for i, s in enumerate(order)}, {}, float(total), set(order)
    size = {s: sum(r.size for r in by[s]) for s in order}
    while full := {s for s in open_ if left * weights[s] / sum(weights[t] for t in open_) > 3 * size[s]}:
        targets |= {s: 3.0 * size[s] for s in full}
        open_ -= full
        left -= sum(3.0 * size[s] for s in full)
    targets |= {s: left * weights[s] / sum(weights[t] for t in open_) for s in open_}
    for s in order:
        assert all(r.source_size == size[s] and r.target == pytest.approx(targets[s], rel=1e-9) and r.taken == r.size * r.copies <= 3 * r.size for r in by[s])
        if size[s]:
            for r, want in zip(by[s], solved([r.size for r in by[s]], targets[s])):
                assert r.size == 0 or r.rate == pytest.approx(want, abs=2e-6)
        assert all(math.floor(r.rate + 1e-12) <= r.copies <= math.floor(r.rate) + 1 for r in by[s])
        lacking = targets[s] - sum(r.taken for r in by[s])
        assert lacking > -1e-3 * max(1.0, targets[s])
        free = [r.size for r in by[s] if r.size and r.copies == math.floor(r.rate) < 3]
        assert lacking <= mixing.NEAR * targets[s] + 1e-6 or not any(f <= lacking for f in free)


def test_mix_solves_the_dual_of_every_source(spark, docs):
    mixed = mixing.mix(docs)
    ids = docs.select(F.col("doc_id").alias("i"), "source")
    rows = mixed.join(ids, F.col("doc_id") == F.col("i")).collect()
    check_mix(rows)
    assert all(len({r.rate for r in rows if r.source == s}) > 5 for s in {r.source for r in rows})  # tilted by document
    assert sorted(map(tuple, mixing.mix(docs).collect())) == sorted(map(tuple, mixed.collect()))  # reruns agree


def test_mix_of_odd_sources(spark):
    rows = [(i, "w " * 300, "many") for i in range(60)] + [(100, "w " * 30_000, "many")] + [(None, "a b c", "nulls")] * 400 + [(7, "x y", None), (8, None, None), (9, "", "empty"), (10, "one two three", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("rate", F.lit("r"))
    out = mixing.mix(df)
    assert out.count() == len(rows)
    kinds = {r.text: r.source for r in df.collect()}
    named = {(r.doc_id, r.size): r for r in out.collect()}
    assert named[8, 0].copies == 1 and named[9, 0].taken == 0
    sums = defaultdict(int)
    for r in out.collect():
        sums[r.source_size, r.target] += r.taken
    nulls = next(t for t in sums if t[0] == 1200 and kinds)
    assert abs(sums[nulls] - nulls[1]) <= 3  # equal rows are told apart, so the whole source is no single item
    clash = df.withColumns({c: F.lit(1) for c in ("s", "target", "pick", "source_size", "whole", "upto", "ps", "us", "u", "place", "passes", "units", "folio_row", "key", "row", "size")})
    carried = mixing.mix(clash, carry=True)
    assert carried.columns == clash.columns and carried.count() == out.agg(F.sum("copies")).first()[0]


def test_ranges_of_sources_carry_over(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 3)
    df = spark.createDataFrame([(i, "w " * (i % 7 + 1), f"s{i % 20}") for i in range(200)], "doc_id long, text string, source string")
    ids = df.select(F.col("doc_id").alias("i"), "source")
    check_mix(mixing.mix(df).join(ids, F.col("doc_id") == F.col("i")).collect())


# --- languages


def test_language_scores_are_kernel_ridge(spark, docs):
    taken = langid.sample(docs.where(~langid.held_out(F.col("doc_id"))), 12)
    texts, langs = [t for t, _ in taken], [k for _, k in taken]
    model = langid.fit(texts, langs)
    grams = lambda t: {s[i : i + n] for s in [" " + re.sub(r"[\W\d_]+", " ", t.lower()).strip() + " "] for n in (1, 2, 3) for i in range(len(s) - n + 1)}
    places = lambda t: set(langid.marked(t).tolist())
    assert all(0 <= len(grams(t)) - len(places(t)) <= 3 for t in texts)  # few n-grams share a place
    sets = [places(t) for t in texts]
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    k = np.array([[kernel(a, b) for b in sets] for a in sets])
    values, vectors = np.linalg.eigh(k)
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    f, names = k @ root, sorted(set(langs))
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    centred = f - f.mean(0)
    beta = np.linalg.solve(centred.T @ centred + langid.RIDGE * len(texts) / 100 * np.eye(f.shape[1]), centred.T @ (y - y.mean(0)))
    other = [r.text for r in docs.where(langid.held_out(F.col("doc_id")) & F.col("text").rlike("[a-z]")).limit(40).collect()]
    want = (np.array([[kernel(places(t), b) for b in sets] for t in other]) @ root - f.mean(0)) @ beta + y.mean(0)
    assert model.languages == names and np.allclose(model.scores(langid.Grams(model.vocabulary), other), want, atol=1e-5)


def test_no_language_is_lost(spark):
    same = spark.range(20_000).select(F.lit("the very same english text again and again").alias("text"), F.lit("en").alias("lang"))
    few = spark.range(30).select(F.concat(F.lit("der die das und nicht wahr "), F.col("id")).alias("text"), F.lit("de").alias("lang"))
    long = spark.createDataFrame([("слово и дело " * 5000, "ru"), ("漢字 と かな " * 4000, "ja"), ("12 34", "digits"), (None, "none"), ("text", None)], "text string, lang string")
    df = same.union(few).union(long)
    model = langid.train(df)
    assert model.languages == ["de", "en", "ja", "ru"]
    assert langid.sample(df) == langid.sample(df.repartition(7))
    got = langid.predict(spark.createDataFrame([(1, "и слово"), (2, "漢字"), (3, "und nicht"), (4, "english text"), (None, "dass")], "doc_id long, text string"), model)
    assert {r.doc_id: r.lang_pred for r in got.where("doc_id is not null").collect()} == {1: "ru", 2: "ja", 3: "de", 4: "en"}


# --- urls


def test_urls_are_brute_force(spark):
    urls = [r[0] for r in duckdb.sql(f"select url from '{SF}/pages.parquet'").fetchall()]
    odd = [None, "", "no scheme", "http://", "http://A.NET", "x://net/", "http://notnet/", "http://org/fr/", "http://x.ORG/FR/", "://example.net/en/?#", "http://example.com/de", "a://b://c.net/d", "http://h/" + "p" * 20_000, "http://ü.net/é"]
    every = [(i, u) for i, u in enumerate(urls + odd + odd)] + [(None, "http://a.net/")]
    model = urlfilter.train(spark)
    got = urlfilter.judge(spark.createDataFrame(every, "page_id long, url string"), model).collect()
    assert len(got) == len(every)
    for r in got:
        host, path = "", ""
        if r.url is not None and "://" in r.url:
            rest = r.url.split("://", 1)[1]
            cut = re.match(r"([^/?#]*)([^?#]*)", rest)
            host, path = "".join(c.lower() if c.isascii() else c for c in cut[1]), cut[2]
        fits = [(len(h + p), say, h + p) for say, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, default=(0, None, None))
        assert (r.host, r.path, r.rule) == (host, path, rule[2]) and (rule[1] in (None, r.verdict))
        assert rule[1] or (r.verdict == "block") == (r.score >= 0.5)
    some = spark.createDataFrame(every[:40], "page_id long, url string")
    host, path = urlfilter.parts(F.col("url"))
    for r in urlfilter.judge(some.withColumn("b", urlfilter.gram_buckets(host, path)), model).collect():
        raw = model[1] + sum(model[0][i] for i in r.b) / math.sqrt(len(r.b))
        assert r.score == pytest.approx(1 / (1 + math.exp(-raw)), rel=1e-9)


# --- quality


def test_quality_is_brute_force(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    trees = quality.train(docs, labels)
    judged = {r.doc_id: r for r in quality.judge(docs, trees).collect()}
    for d in documents(SF):
        text = d["text"] or ""
        words = WORD.findall(text)
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        seen = Counter(windows)
        inside = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(5)}
        lines, first, dup = [x for x in text.split("\n") if WORD.search(x)], set(), 0
        for line in lines:
            dup += line in first
            first.add(line)
        r = judged[d["doc_id"]]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside))
        assert r.base_failed == (len(words) < 10 or 100 * len(inside) > 20 * len(words))
        _, x = quality.statistics(text)
        raw = trees.start
        for feature, cut, leaf in zip(trees.feature, trees.cut, trees.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + (x[feature[node]] > cut[node])
            raw += leaf[node - len(feature)]
        assert r.probability == pytest.approx(1 / (1 + math.exp(-raw)), rel=1e-9) and r.kept == (not r.base_failed and r.probability >= quality.KEEP)
    x = np.array([quality.statistics(d["text"] or "")[1] for d in documents(SF)])
    for f, sign in enumerate(quality.FEATURES.values()):
        if sign:
            more = x.copy()
            more[:, f] += 0.3
            assert (sign * (trees.probability(more) - trees.probability(x)) >= -1e-12).all()


def test_quality_of_held_out_labels(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = F.col("doc_id") % 3 == 0
    judged = quality.judge(docs, quality.train(docs, labels.where(~held))).join(labels.where(held), "doc_id").where("not base_failed")
    assert judged.where("kept = (quality = 1)").count() > 0.9 * judged.count() > 0


def test_quality_training_is_bounded_where_ids_repeat(spark, monkeypatch):
    df = spark.range(5000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("some text with words "), F.col("id")).alias("text")).union(spark.createDataFrame([(2, "bad bad bad")], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "grow", lambda x, y, sign: seen.append((len(x), list(y))))
    quality.train(df, labels)
    assert seen == [(2, [1.0, 0.0])]


# --- near duplicates


def test_near_duplicates_of_a_whole_table_are_brute_force(spark, docs):
    texts = {d["doc_id"]: d["text"] or "" for d in documents(SF)}
    want = brute_classes(texts)
    got = {r.doc_id: r for r in neardup.near_duplicates(docs).collect()}
    assert {i: r.class_id for i, r in got.items()} == want
    assert all(r.class_size == list(want.values()).count(r.class_id) for r in got.values() if neardup.word_hashes(texts[r.doc_id]).size)


# --- search


def test_blocks_are_skipped_and_results_exact_on_clusters(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 3, (20, 16))
    x = np.floor((centres[rng.integers(0, 20, 3000)] + rng.normal(0, 0.05, (3000, 16))) * 256)
    ids = [[i] for i in range(len(x))]
    asked = list(range(0, 3000, 50))
    found, scored = topk.top_of_cell(np.full(len(asked), -np.inf), asked, x[asked], ids, x, 5, 32)
    best = defaultdict(list)
    for i, n, s in found:
        best[asked[i]].append((n, s))
    for q in asked:
        assert sorted(best[q]) == sorted([(i, -s) for s, i in sorted((-int(x[q] @ x[i]), i) for i in range(len(x)) if i != q)[:5]])
    every = len(asked) * -(-len(x) // 32)
    assert scored < 0.35 * every  # most pairs of query and block are never scored
    v = topk.quantised(spark.createDataFrame([(i, [float(c) / 256 for c in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>"))
    got = defaultdict(list)
    for r in topk.search(v, v.where("vec_id % 50 = 0"), cell=256, chunk=16).collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert {q: sorted(r) for q, r in got.items()} == {q: sorted(r) for q, r in best.items()}


def test_search_keeps_repeated_rows_and_any_finite_number(spark):
    rows = [(50, [1.0, 2.0])] * 2 + [(50, [3.0, 1.0]), (1, [1e20, 0.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1e300, -1e300]), (100, [-1e20, 1e20]), (4, [1.0]), (150, [2.0]), (5, []), (None, [1.0, 1.0]), (6, None)]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    live = [(i, [math.floor(x * 256) for x in map(int, w)] if max(map(abs, w)) > 1e6 else [math.floor(x * 256) for x in w]) for i, w in rows if i is not None and w]
    want = Counter()
    for at, (q, a) in enumerate(live):
        if q % 50 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for other, (i, b) in enumerate(live) if other != at and len(a) == len(b))[:5]
            want.update((q, n, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(found, 1))
    assert Counter(map(tuple, topk.search(v, v.where("vec_id % 50 = 0"), cell=2, chunk=2, block=2).collect())) == want
    assert topk.search(v.limit(0), v.limit(0)).count() == 0


# --- tokenizers


def test_long_pre_tokens_are_the_libraries(spark):
    texts = ["a" * 40_000, "ab" * 30_000 + " " + "é" * 20_000, "漢" * 15_000, " " * 30_000, "!?" * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_tokens", F.lit(0))
    path = P.path("byte_bpe_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bytebpe.read_ranks(path), special_tokens={})
    ids = [lib.encode_ordinary(t) for t in texts]
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bytebpe.round_trip(df, path, P.PATTERN).collect()}
    assert got == {i: (len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, (x, t) in enumerate(zip(ids, texts))}
    word = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    counts = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(df, P.path("word_bpe_49k.json")).collect()}
    assert counts == {i: len(word.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


# --- web archives


def test_text_extraction_is_linear_and_like_plain_patterns():
    drop = re.compile(r"<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<noscript\b[^>]*>.*?</noscript\s*>", re.S | re.I)
    tag = re.compile(r"<[A-Za-z/!?][^<>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^<>\"']*)*>")
    parts = ["<script>", "</script>", "<SCRIPT", "<!--", "-->", ">", "<", "a", "'", '"', "<b x='", '<a "', "</style >", "<style a>", "<noscript>", "</noscript>", "</p>", " ", "<p>", "x>"]
    rng = np.random.default_rng(3)
    for _ in range(8000):
        t = "".join(rng.choice(parts, rng.integers(1, 14)))
        assert warc.without_held(t) == drop.sub("", t) and warc.without_tags(t) == tag.sub("", t)
    for bad in ("<script>", "<script", "<!--", '<a "<a"', '<a ""', "<style><script>", "<a '\"", "<"):
        began = time.time()
        warc.plain_text(bad * (1_000_000 // len(bad)))
        assert time.time() - began < 5


def test_payload_codings_and_records(spark, tmp_path):
    import gzip
    import zlib

    page = "<p>Größe</p>"
    head = "HTTP/1.1 200 OK\r\n{}Content-Type: text/html{}\r\n\r\n"
    chunked = b"5\r\n" + page.encode()[:5] + b"\r\n" + f"{len(page.encode()) - 5:x}".encode() + b"\r\n" + page.encode()[5:] + b"\r\n0\r\n\r\n"
    blocks = [
        (head.format("Content-Encoding: gzip\r\n", ""), gzip.compress(page.encode())), (head.format("Content-Encoding: deflate\r\n", ""), zlib.compress(page.encode())), (head.format("Transfer-Encoding: chunked\r\n", ""), chunked),
        (head.format("", "; charset=latin-1"), page.encode("latin-1")), (head.format("", "; charset=nonsense"), page.encode()), (head.format("", ""), b"<meta charset='iso-8859-1'>" + page.encode("latin-1")),
        (head.format("Content-Encoding: gzip\r\n", ""), page.encode()), (head.format("", ""), b"<p>a\r\n\r\nWARC/1.1 is a format</p>" + page.encode()),
    ]
    data = b"".join(warc.render("response", f"<urn:uuid:{i}>", None, f"http://h/{i}", warc.DATE, "application/http", h.encode() + b) + warc.render("request", f"<q{i}>", None, "u", warc.DATE, "x", b"GET") for i, (h, b) in enumerate(blocks))
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "a.warc").write_bytes(data)
    (tmp_path / "packed").mkdir()
    (tmp_path / "packed" / "a.warc.gz").write_bytes(b"".join(gzip.compress(data[i : i + 700]) for i in range(0, len(data), 700)))
    for folder in ("plain", "packed"):
        read = warc.read_responses(spark, str(tmp_path / folder))
        texts = {r.refers_to: r.block for r in warc.derive(read).where("record_type = 'conversion'").collect()}
        assert texts == {f"<urn:uuid:{i}>": ("a\nWARC/1.1 is a format\nGröße" if i == 7 else "Größe") for i in range(len(blocks))}
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.warc").write_bytes(data[: data.index(b"<urn:uuid:3>") + 5])
    with pytest.raises(Exception, match="short"):
        warc.read_responses(spark, str(tmp_path / "cut")).collect()


# --- odd rows for all


def test_empty_tables_give_no_rows(spark):
    d = spark.createDataFrame([], "doc_id long, text string, source string, lang string")
    p = spark.createDataFrame([], "page_id long, url string, html string")
    trees = quality.train(d, spark.createDataFrame([], "doc_id long, quality int"))
    out = (
        urlfilter.judge(p, urlfilter.train(spark)), quality.judge(d, trees), quality.judge(d, trees, carry=True), bytebpe.round_trip(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
        tokencount.count_tokens(d, P.path("word_bpe_49k.json")), warc.derive(warc.responses(p), key="page_id"), neardup.near_duplicates(d), neardup.one_of_each(d), linededup.dedup_lines(d), mixing.mix(d, carry=True), langid.predict(d, None),
    )
    assert [x.count() for x in out] == [0] * len(out)


def test_repeated_and_null_pages(spark):
    rows = [(1, "http://a/", "<p>x")] * 3 + [(None, None, None), (None, "http://b/", ""), (2, "http://c/", "<script>" * 40_000)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_id", F.lit("mine"))
    records = warc.derive(warc.responses(p), key="page_id").collect()
    assert Counter(r.page_id for r in records) == {1: 6, None: 4, 2: 2} and {r.block for r in records if r.page_id == 1 and r.record_type == "conversion"} == {"x"}
    assert len({r.record_id for r in records if r.page_id == 1}) == 2


def test_lines_with_ties_clashes_and_long_texts(spark):
    rows = [(1, f"shared line\nown {i}", f"s{i}") for i in range(6)] + [(2, f" shared line\t\nown {i}", f"t{i}") for i in range(6)] + [(None, "shared line", "n"), (3, "shared line\n" + "long " * 200_000, "u"), (4, None, "v"), (5, "", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(9) for c in ("n_lines", "key", "gone", "a", "b", "own", "folio_key")})
    out = linededup.dedup_lines(df)
    assert out.columns[:3] == ["doc_id", "text", "source"] and out.columns[-2:] == ["n_lines", "n_removed"]
    got = defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append((r.text, r.n_removed))
    assert all(n == 0 and t.startswith("shared") for t, n in got[1]) and all(n == 1 and t.startswith("own") for t, n in got[2])
    assert got[None] == [("", 1)] and got[3][0][1] == 1 and len(got[3][0][0]) == 1_000_000 and got[4] == [(None, 0)] and got[5] == [("", 0)]


# --- the pipeline


def test_pipeline_is_brute_force_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, docs, SMALL).cache()
    trees = quality.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    verdict = {r.doc_id for r in quality.judge(docs, trees).where("kept").collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in docs.collect() if r.doc_id in verdict) and kept.columns == docs.columns
    clean = stages["line dedup"](spark, kept, SMALL).cache()
    rows = kept.collect()
    sites, keeper = defaultdict(set), {}
    bare = lambda x: x.strip("\t\n\x0b\x0c\r ")
    for r in rows:
        for line in (r.text or "").split("\n"):
            if WORD.search(line):
                sites[bare(line)].add(r.source)
                keeper[bare(line)] = min(keeper.get(bare(line), r.doc_id), r.doc_id)
    stays = lambda r, line: not (WORD.search(line) and len(sites[bare(line)]) >= linededup.SITES and keeper[bare(line)] != r.doc_id)
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if stays(r, x)) for r in rows}
    assert {r.doc_id: r.text for r in clean.collect()} == want and all(r.n_chars == len(r.text) for r in clean.collect())
    single = stages["near dedup"](spark, clean, SMALL).cache()
    classes = brute_classes(want)
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, c in classes.items() if i == c)
    mixed = stages["mix sources"](spark, single, SMALL).cache()
    source = {r.doc_id: r.source for r in single.collect()}
    out = mixing.mix(single).collect()
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.copies for r in out if r.copies})
    check_mix([type("R", (), r.asDict() | {"source": source[r.doc_id]}) for r in out])
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bytebpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    tokens = Counter((r.doc_id, r.n_tokens) for r in stages["byte bpe"](spark, mixed, SMALL).collect())
    assert tokens == Counter((r.doc_id, len(lib.encode_ordinary(r.text))) for r in mixed.collect())
    whole = corpus_pipeline.run(spark, SMALL)
    assert Counter((r.doc_id, r.n_tokens) for r in whole.collect()) == tokens
    assert list(stages) == ["quality rules", "line dedup", "near dedup", "mix sources", "byte bpe"] and set(queries.QUERIES) >= {"op1_mix_sources"}
