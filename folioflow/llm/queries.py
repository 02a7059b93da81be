"""Thin queries over whole tables, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytebpe, langid, linededup, mixing, neardup, quality, tokencount, topk, urlfilter, warc
from .common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(F.col("doc_id").isNotNull() & ~langid.held_out(F.col("doc_id"))))
    return langid.predict(docs.select("doc_id", "text"), model)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), urlfilter.train(spark)).drop("url")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return clean.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text"), 256).alias("text_sha256"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, sf_dir, "pages").select("page_id", "url", "html")), key="page_id")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3_url_filter gives beside the classifier's verdicts, which SQL cannot say."""
    judged = op3_url_filter(spark, sf_dir)
    return judged.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("rule_verdict"))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op6_quality_rules gives beside the trees' verdicts, which SQL cannot say."""
    return op6_quality_rules(spark, sf_dir).drop("kept", "probability")


QUERIES = {f.__name__: f for f in (
    op1_mix_sources, op2_language_id, op3_url_filter, op4_line_dedup, op5_near_duplicates,
    op6_quality_rules, op7_byte_bpe, op8_token_counts, op9_topk_search, op10_warc_derivatives, url_rules, quality_counts,
)}

_WORD = r"[^\x20\x09-\x0D]+"

ORACLE_SQL = {
    "op4_line_dedup": rf"""
with lines as (
  select doc_id, source, pos, string_split(text, chr(10))[pos] as line
  from documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) as t(pos)),
marked as (select *, trim(line, E' \t\n\x0b\x0c\r') as h, len(regexp_extract_all(line, '{_WORD}')) >= 1 as counts from lines),
wide as (select h, min(doc_id) as keeper from marked where counts group by h having count(distinct coalesce(source, chr(1))) >= 10),
judged as (select m.*, m.counts and w.h is not null and m.doc_id <> w.keeper as gone from marked m left join wide w on m.h = w.h)
select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_removed,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as text_sha256
from judged group by doc_id
""",
    "op9_topk_search": """
with v as materialized (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(x::double * 256)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and vec_id is not null),
pairs as (
  select q.row, q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from v q join v c on q.row <> c.row where q.vec_id % 50 = 0)
select query_id, rank::integer as rank, vec_id, score
from (select *, row_number() over (partition by row order by score desc, vec_id) as rank from pairs) where rank <= 5
""",
    "op10_warc_derivatives": r"""
with source as (
  select page_id, url, coalesce(html, '') as html, md5(concat_ws('|', 'response', coalesce(page_id::varchar, ''), coalesce(url, ''))) as h,
         'sha256:' || sha256(coalesce(html, '')) as payload_digest
  from pages),
named as (select *, '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' as refers_to from source),
cut as (
  select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
      '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<noscript\b[^>]*>.*?</noscript\s*>', '', 'g'),
      '(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)(?:[\s/][^<>]*)?>', chr(10), 'g'),
      '<[A-Za-z/!?][^<>"'']*(?:(?:"[^"]*"|''[^'']*'')[^<>"'']*)*>', '', 'g'), '<[A-Za-z/!?][^<>]*>', '', 'g') as bare
  from named),
plain as (
  select *, replace(replace(replace(replace(replace(replace(replace(bare, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') as unescaped
  from cut),
conversion as (
  select *, coalesce(array_to_string(list_filter(list_transform(string_split(unescaped, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\f\v\x{A0}]+', ' ', 'g'), ' ')), lambda x: x <> ''), chr(10)), '') as block
  from plain),
metadata as (
  select *, concat('source-status: HTTP/1.1 200 OK', E'\r\n', 'source-content-type: text/html; charset=utf-8', E'\r\n', 'source-content-length: ', strlen(html), E'\r\n',
      'source-payload-length: ', strlen(html), E'\r\n', 'source-payload-digest: ', payload_digest, E'\r\n') as block
  from named),
records as (
  select page_id, 'metadata' as record_type, refers_to, url, 'application/warc-fields' as content_type, payload_digest, block from metadata
  union all
  select page_id, 'conversion', refers_to, url, 'text/plain; charset=utf-8', payload_digest, block from conversion),
linked as (select *, md5(record_type || '|' || refers_to) as h from records)
select page_id, record_type, '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' as record_id, refers_to,
       url as target_uri, '2024-01-01T00:00:00Z' as warc_date, content_type, payload_digest, 'sha256:' || sha256(block) as block_digest, strlen(block)::bigint as content_length, block
from linked
""",
    "url_rules": """
with r as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
f as (select *, case when (host = 'example.net' or suffix(host, '.example.net')) and prefix(path, '/en/') then 'example.net/en/' when (host = 'example.com' or suffix(host, '.example.com')) and prefix(path, '/de/') then 'example.com/de/'
  when (host = 'org' or suffix(host, '.org')) and prefix(path, '/fr/') then 'org/fr/' when (host = 'net' or suffix(host, '.net')) and prefix(path, '/') then 'net/' end as rule from p)
select page_id, host, path, rule, case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null then 'block' end as rule_verdict from f
""",
    "quality_counts": rf"""
with w as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_WORD}') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) as lines from documents),
windows as (select doc_id, i, array_to_string(words[i:i + 4], chr(1)) as s from (select doc_id, words, unnest(range(1, len(words) - 3)) as i from w where len(words) >= 5)),
twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, s) as n from windows) where n > 1),
inside as (select doc_id, count(distinct i + d) as n from twice, range(0, 5) r(d) group by doc_id)
select w.doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
  (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(i.n, 0)::bigint as n_repeat_words, len(words) < 10 or 100 * coalesce(i.n, 0) > 20 * len(words) as base_failed
from w left join inside i using (doc_id)
""",
}
