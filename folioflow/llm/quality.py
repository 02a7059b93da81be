"""Quality rules: gradient-boosted trees over document statistics.

Statistics of whole texts are computed in Arrow batches.  Trees are grown on a bounded sample of
labelled documents by histogram splits on the logistic loss, some features constrained to be
monotone, and flattened into numpy node arrays, so that a batch is scored level by level without a
Python loop over rows or trees.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, by_batch, pieces

#: Labelled documents trained on at most, trees, their depth, learning rate, histogram bins.
SAMPLE, TREES, DEPTH, RATE, BINS = 3000, 60, 3, 0.2, 32
#: Probability of good quality from which a document is kept.
KEEP = 0.3
#: Feature -> direction: -1 if more of it may only lower the quality.
FEATURES = {
    "log_words": 0,
    "word_chars": 0,
    "symbols": -1,
    "dup_lines": -1,
    "repeats": -1,
    "upper": -1,
    "shouts": -1,
    "bars": -1,
    "digits": -1,
    "distinct": 0,
    "line_words": 0,
    "stops": 0,
}
_WORDS = re.compile(WORD).findall
_UPPER = re.compile("[A-ZÀ-ÖØ-Þ]").findall
_DIGITS = re.compile("[0-9]").findall
SYMBOLS = "#*$%&|<>"


def repeated_words(words: list[str], width: int = 5) -> int:
    """Words in windows of ``width`` found twice or more in the text, the first time included."""
    windows = list(zip(*(words[i:] for i in range(width))))
    if len(set(windows)) == len(windows):
        return 0
    seen, inside, until = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            inside += i + width - max(i, until)
            until = i + width
    return inside


def statistics(text: str) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the features of FEATURES."""
    words = _WORDS(text)
    n, chars = len(words), sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if _WORDS(x)] if "\n" in text else [text] * bool(n)
    dup = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    m, c = max(n, 1), max(chars, 1)
    features = [
        float(np.log1p(n)), chars / m, symbols / m, dup / max(len(lines), 1), repeats / m, len(_UPPER(text)) / c, text.count("!") / m,
        text.count("|") / m, len(_DIGITS(text)) / c, len(set(words)) / m, n / max(len(lines), 1), text.count(".") / m,
    ]
    return (n, chars, symbols, dup, repeats), features


def base_failed(n: int, repeats: int) -> bool:
    return n < 10 or 100 * repeats > 20 * n


@dataclass
class Trees:
    """Complete binary trees in heap order; a leaf above the last level sends all rows left."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves
    start: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.leaf))[None, :]
        node = np.zeros((len(x), len(self.leaf)), np.int64)
        while len(self.feature) and node.size and node.flat[0] < self.feature.shape[1]:
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.cut[trees, node])
        raw = self.start + (self.leaf[trees, node - self.feature.shape[1]].sum(1) if len(self.leaf) else 0.0)
        return 1 / (1 + np.exp(-np.clip(raw + np.zeros(len(x)), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, sign: list[int], trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, l2: float = 1.0, least: float = 2.0) -> Trees:
    """Boosts ``trees`` trees on rows x and 0/1 targets y; sign[f] of +1 or -1 makes feature f monotone.

    A split on a monotone feature must order its children's values so, and passes their midpoint on
    as a bound, which all later leaves below keep."""
    inner, n, width = 2**depth - 1, len(y), x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    code = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    raw = np.full(n, np.log(p0 / (1 - p0)))
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node, bound = np.zeros(n, np.int64), {0: (-np.inf, np.inf)}
        for k in range(inner):
            at, (low, high) = np.flatnonzero(node == k), bound[k]
            bound[2 * k + 1] = bound[2 * k + 2] = (low, high)
            best = (1e-6, None)
            if len(at) > 1:
                value = lambda a, b: np.clip(a / (b + l2), low, high)
                gain = lambda a, b, v: a * v - 0.5 * (b + l2) * v * v
                G, H = g[at].sum(), h[at].sum()
                whole = gain(G, H, value(G, H))
                for f in range(width):
                    if not len(edges[f]):
                        continue
                    gl = np.cumsum(np.bincount(code[at, f], g[at], len(edges[f]) + 1))[:-1]
                    hl = np.cumsum(np.bincount(code[at, f], h[at], len(edges[f]) + 1))[:-1]
                    vl, vr = value(gl, hl), value(G - gl, H - hl)
                    gains = gain(gl, hl, vl) + gain(G - gl, H - hl, vr) - whole
                    gains[(hl < least) | (H - hl < least) | (sign[f] * (vr - vl) < 0)] = -np.inf
                    b = int(gains.argmax())
                    if gains[b] > best[0]:
                        best = (gains[b], f, b, (vl[b] + vr[b]) / 2)
            right = np.zeros(len(at), bool)
            if best[1] is not None:
                _, f, b, mid = best
                feature[t, k], cut[t, k] = f, edges[f][b]
                right = x[at, f] > edges[f][b]
                if sign[f]:
                    bound[2 * k + 1], bound[2 * k + 2] = ((low, mid), (mid, high)) if sign[f] > 0 else ((mid, high), (low, mid))
            node[at] = 2 * k + 1 + right
        for k in range(inner + 1):
            at = node == inner + k
            if at.any():
                leaf[t, k] = rate * np.clip(g[at].sum() / (h[at].sum() + l2), *bound[inner + k])
        raw += leaf[t, node - inner]
    return Trees(feature, cut, leaf, float(np.log(p0 / (1 - p0))))


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees for labels.quality from at most ``sample`` labelled documents, chosen by a hash of doc_id.

    Labels without an id or quality are not used; of repeated labels the better quality counts, of
    documents with one id the one with the least features, so that at most ``sample`` rows reach the
    driver.  With no usable label, or none of one kind, the trees are empty and every document gets
    probability 0.5."""
    known = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = min(1.0, 1.2 * sample / max(1, known.count()))
    picked = known.where(unit < F.lit(int(share * (1 << 30)))).orderBy(unit, "doc_id").limit(sample)
    ids = documents.sparkSession.createDataFrame(picked.collect(), known.schema)  # at most ``sample`` rows
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(ids), "doc_id")

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            return {"doc_id": batch.column("doc_id"), "quality": batch.column("quality"), "x": [statistics(t.as_py())[1] for t in batch.column("text")]}

        return work

    found = by_batch(texts.select("doc_id", F.col("quality").cast("long"), "text"), "doc_id long, quality long, x array<double>", make)
    rows = sorted(found.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).collect())
    if len({q > 0 for _, q, _ in rows}) < 2:
        return Trees(np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)), 0.0)
    return grow(np.array([x for _, _, x in rows]), np.array([float(q > 0) for _, q, _ in rows]), list(FEATURES.values()))


def judge(df: DataFrame, trees: Trees, keep: float = KEEP, carry: bool = False) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every row.

    A null text has no words and fails the base rules, as does an empty one.  Very long texts are
    read whole.  Repeated rows repeat, an empty table gives no rows, a null doc_id stays null.  With
    ``carry`` only kept rows come back, with the input's own columns, whatever their names, and nothing else.
    """
    shared = df.sparkSession.sparkContext.broadcast(trees)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def verdicts(batch: pa.RecordBatch) -> tuple[list, list[bool], np.ndarray]:
        stats = [statistics(t.as_py() or "") for t in batch.column("text")]
        failed = [base_failed(s[0], s[4]) for s, _ in stats]
        p = shared.value.probability(np.array([x for _, x in stats]))
        return stats, failed, p

    if carry:
        schema = df.schema

        def kept_rows(batches):
            for batch in pieces(batches):
                _, failed, p = verdicts(batch)
                yield batch.filter(pa.array(~np.array(failed) & (p >= keep)))

        return df.mapInArrow(kept_rows, schema)

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            stats, failed, p = verdicts(batch)
            out = {n: [s[0][i] for s in stats] for i, n in enumerate(names)}
            return out | {"doc_id": batch.column("doc_id"), "base_failed": failed, "probability": p.tolist(), "kept": [not f and v >= keep for f, v in zip(failed, p.tolist())]}

        return work

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean, probability double"
    return by_batch(df.select(F.col("doc_id").cast("long"), "text"), schema, make)
