"""Token counts by a two-tier lookup, with no shuffle of pre-tokens.

Tier one is a compact table of the lengths of frequent pre-tokens, built on the driver from a
bounded sample of texts and broadcast; its entries and bytes are bounded by parameters, so it does
not grow with the corpus.  Tier two is a bounded cache in each worker, filled by the tokenizer's own
model for pre-tokens that the table misses.  The sample decides speed only, never a count.
"""

from __future__ import annotations

import json
import pickle
import re
import zlib
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bytebpe import PLAIN
from .common import by_batch

#: Documents sampled for the table, the characters of the longest one taken, and the table's entries.
SAMPLE_DOCS, SAMPLE_CHARS, TABLE_WORDS = 1500, 50_000, 60_000
CACHE = 250_000
#: Cutting rule of the word-end vocabulary for lower-case texts of plain characters.
PLAIN_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: The rule that PLAIN_PATTERN restates; with any other pre-tokenizer every text is cut by the library.
WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_chars() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    same = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in same]
    return {b: b for b in same} | {b: 0x100 + i for i, b in enumerate(rest)}


class Lengths(dict):
    """Pre-token -> number of tokens; asks the model for what it lacks."""

    def __init__(self, tok: Tokenizer, frequent: dict[str, int], limit: int = CACHE):
        super().__init__(frequent)
        self.model, self.frequent, self.limit, self.chars = tok.model, frequent, limit + len(frequent), _byte_chars()

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
            self.update(self.frequent)
        n = self[word] = len(self.model.tokenize(word.encode().decode("latin-1").translate(self.chars)))
        return n


class Counts:
    def __init__(self, path: str, frequent: dict[str, int]):
        self.tok = Tokenizer.from_file(path)
        self.lengths = Lengths(self.tok, frequent)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [x.get("type") for x in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = [x.get("pattern", {}).get("Regex") for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.plain = steps == ["NFC", "Replace", "Lowercase"] and cuts == [WORD_RULE, None]

    def words(self, text: str) -> list[str]:
        if self.plain and PLAIN.fullmatch(text):
            return PLAIN_PATTERN.findall(text.lower())
        norm = self.tok.normalizer.normalize_str(text) if self.tok.normalizer else text
        return [norm[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(norm)]

    def count(self, text: str) -> int:
        if any(s in text for s in self.special):
            return len(self.tok.encode(text, add_special_tokens=False))
        return sum(map(self.lengths.__getitem__, self.words(text)))


@lru_cache(maxsize=2)
def _counts(path: str, packed: bytes) -> Counts:
    return Counts(path, pickle.loads(zlib.decompress(packed)))


def frequent_lengths(df: DataFrame, path: str, docs: int = SAMPLE_DOCS, words: int = TABLE_WORDS) -> bytes:
    """The packed table of at most ``words`` frequent pre-tokens of about ``docs`` different texts,
    none longer than SAMPLE_CHARS.  Which texts are taken depends on the texts alone."""
    texts = df.where(F.length("text") <= SAMPLE_CHARS).select("text", F.xxhash64("text").alias("h"))
    share = min(1.0, docs / max(1, df.count()))
    low = texts.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    rows = low.groupBy("h").agg(F.min("text").alias("text")).orderBy(F.pmod("h", F.lit(1 << 30)), "h").limit(2 * docs).collect()
    c, seen = Counts(path, {}), Counter()
    for r in rows:
        seen.update(c.words(r.text))
    table = {w: c.lengths[w] for w, n in seen.most_common(words) if n > 1 and len(w) <= 64}
    return zlib.compress(pickle.dumps(table), 1)


def count_tokens(df: DataFrame, path: str, limit: int = 2048, docs: int = SAMPLE_DOCS, words: int = TABLE_WORDS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``df`` (doc_id, text).

    Counts are those of the tokenizer at ``path`` without begin or end tokens.  A null or empty text
    has 0 bytes and tokens; a null doc_id stays null; repeated rows repeat; an empty table gives no
    rows; other columns are ignored.
    """
    packed = df.sparkSession.sparkContext.broadcast(frequent_lengths(df, path, docs, words))

    def make():
        c = _counts(path, packed.value)

        def work(batch: pa.RecordBatch) -> dict:
            size, n = [], []
            for text in batch.column("text"):
                t = text.as_py() or ""
                size.append(len(t) if t.isascii() else len(t.encode()))
                n.append(c.count(t))
            return {"doc_id": batch.column("doc_id"), "n_bytes": size, "n_tokens": n, "over_limit": [x > limit for x in n]}

        return work

    return by_batch(df.select(F.col("doc_id").cast("long"), "text"), "doc_id long, n_bytes long, n_tokens long, over_limit boolean", make)
