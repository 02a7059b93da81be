"""Language identification by string kernels.

Texts are lower-cased and anything but letters becomes a space.  The kernel of two texts is the number
of distinct n-grams (n = 1..3, blended) present in both, divided by the geometric mean of their numbers
of distinct n-grams.  N-grams of any script are hashed to SLOTS places, so no alphabet is fixed.
Landmark texts give Nyström features; one-versus-rest ridge regression on them is solved in closed
form.  Landmark grams, their norms and the ridge weights fold into matrices, so that a batch of texts
is scored by products of its presence matrix with them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, by_batch

#: Distinct training texts of a language and of all together (each language gets LEAST_TEXTS at least).
TEXTS, ALL_TEXTS, LEAST_TEXTS = 250, 20_000, 8
#: Landmark texts of a language and of all together.
LANDMARKS, ALL_LANDMARKS = 50, 512
RIDGE = 1e-2
#: Texts over so many characters are learned from only where a language has fewer than LEAST_TEXTS shorter
#: ones; predictions read whole texts of any length.
TRAIN_CHARS = 20_000
#: Places that n-grams are hashed to (a power of two), and grams of landmarks that are weighted at most.
SLOTS, VOCABULARY = 1 << 22, 1 << 17
#: Texts whose presence matrix is held at once.
TOGETHER = 64


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _points(text: str) -> np.ndarray:
    """Lower-case code points with one space (0) for each run of other characters."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4")
    out = np.where(_letters()[raw], raw, 0)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    return out[keep]


def marked(text: str) -> np.ndarray:
    """Places of all 1-, 2- and 3-grams of a text: a gram is its code points in 21 bits each, then hashed."""
    c = _points(text).astype(np.uint64) + np.uint64(1)
    two = (c[:-1] << np.uint64(21)) | c[1:]
    grams = np.concatenate([c, two, (two[:-1] << np.uint64(21)) | c[2:]])
    grams *= np.uint64(0x9E3779B97F4A7C15)
    return ((grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(42)).astype(np.int64)


@dataclass
class Grams:
    """Presence of the grams of a vocabulary; keeps one scratch array for all texts of a worker."""

    vocabulary: np.ndarray

    def __post_init__(self):
        self.seen = np.zeros(SLOTS, bool)

    def presence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The presence of each gram of the vocabulary in each text; the number of distinct grams of each."""
        x, n = np.zeros((len(texts), len(self.vocabulary)), np.float32), np.zeros(len(texts))
        for i, text in enumerate(texts):
            places = marked(text)
            self.seen[places] = True
            x[i], n[i] = self.seen[self.vocabulary], np.count_nonzero(self.seen)
            self.seen[places] = False
        return x, n

    def rows(self, texts: list[str]):
        """Presence rows divided by the root of the texts' numbers of grams, TOGETHER at a time."""
        for at in range(0, len(texts), TOGETHER):
            x, n = self.presence(texts[at : at + TOGETHER])
            yield x / np.sqrt(np.maximum(n, 1))[:, None]


@dataclass
class Model:
    """``features`` is None where the weights of grams and languages are folded into one matrix."""

    languages: list[str]
    vocabulary: np.ndarray
    features: np.ndarray | None  # grams x features
    weights: np.ndarray  # features (or grams) x languages
    bias: np.ndarray

    def scores(self, grams: Grams, texts: list[str]) -> np.ndarray:
        rows = (x if self.features is None else x @ self.features for x in grams.rows(texts))
        return np.concatenate([x @ self.weights for x in rows]) + self.bias


def _round_robin(langs: list[str], per: int, most: int) -> list[int]:
    """Places of the first ``per`` texts of each language, in turn, ``most`` in all."""
    seen: dict[str, int] = {}
    turns = []
    for i, k in enumerate(langs):
        turns.append((seen.setdefault(k, 0), k, i))
        seen[k] += 1
    return [i for turn, _, i in sorted(turns) if turn < per][:most]


def fit(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Deterministic in the order of its input."""
    names = sorted(set(langs))
    chosen = _round_robin(langs, landmarks, ALL_LANDMARKS)
    held = np.zeros(SLOTS, np.int32)
    for i in chosen:
        held[np.unique(marked(texts[i]))] += 1
    vocabulary = np.flatnonzero(held)
    vocabulary = np.sort(vocabulary[np.argsort(-held[vocabulary], kind="stable")][:VOCABULARY])
    grams = Grams(vocabulary)
    z = np.concatenate(list(grams.rows([texts[i] for i in chosen]))).astype(np.float64)
    values, vectors = np.linalg.eigh(z @ z.T)
    good = values > 1e-8 * values.max()
    to_features = z.T @ (vectors[:, good] / np.sqrt(values[good]))  # grams x features
    features = np.concatenate([x @ to_features for x in grams.rows(texts)])
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    mean_f, mean_y = features.mean(0), y.mean(0)
    centred = features - mean_f
    beta = np.linalg.solve(centred.T @ centred + ridge * len(texts) / 100 * np.eye(centred.shape[1]), centred.T @ (y - mean_y))
    bias = (mean_y - mean_f @ beta).astype(np.float32)
    if len(names) <= to_features.shape[1]:
        return Model(names, vocabulary, None, (to_features @ beta).astype(np.float32), bias)
    return Model(names, vocabulary, to_features.astype(np.float32), beta.astype(np.float32), bias)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text leaves 2 when divided by 4; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sample(df: DataFrame, texts: int = TEXTS) -> list[tuple[str, str]]:
    """(text, lang) of at most ``texts`` distinct texts of every language of ``df`` (text, lang), in the
    order of a hash of the text.

    Equal texts count once, so a text that fills a language leaves room for no other and drops none.
    The hashes of distinct texts are counted by sketches; hashes below the threshold that this gives,
    merged by partial aggregation, are ordered, and the texts of the first ones fetched."""
    scratch = Scratch(df.sparkSession)
    rows = df.where("text is not null and lang is not null").where(F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", "text", F.xxhash64("text").alias("h"), (F.length("text") > TRAIN_CHARS).alias("long"))
    counts = scratch.write(rows.groupBy("lang", "long").agg(F.hll_sketch_estimate(F.hll_sketch_agg("h", F.lit(12))).alias("n")), "languages")
    languages = counts.select("lang").distinct().count()
    if not languages:
        scratch.discard()
        return []
    per = max(LEAST_TEXTS, min(texts, ALL_TEXTS // languages))
    share = F.least(F.lit(1.0), 2.0 * per / F.greatest(F.col("n"), F.lit(1)))
    low = rows.select("lang", "long", "h").join(counts, ["lang", "long"]).where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))
    low = low.groupBy("lang", "long", "h").agg(F.lit(1).alias("one"))
    order = Window.partitionBy("lang").orderBy("long", F.pmod("h", F.lit(1 << 30)), "h")
    first = low.withColumn("n", F.row_number().over(order)).where((F.col("n") <= per) & (~F.col("long") | (F.col("n") <= LEAST_TEXTS)))
    first = scratch.write(first.select("lang", "h"), "training-hashes")
    found = rows.select("lang", "text", "h").join(first, ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).collect()
    scratch.discard()
    return [(r.text, r.lang) for r in sorted(found, key=lambda r: (r.h & ((1 << 30) - 1), r.h, r.lang)) if any(map(str.isalpha, r.text))]


def train(df: DataFrame, texts: int = TEXTS) -> Model | None:
    """Learns every language of ``df`` (text, lang) from its ``sample``.  Null texts and langs and texts
    without letters are not learned from; None if nothing is left."""
    taken = sample(df, texts)
    return fit([t for t, _ in taken], [k for _, k in taken]) if taken else None


def predict(df: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1) of every row of ``df`` (doc_id, text), from the whole text alone.

    ``und`` with score 0 where the text is null or has no letter, or no model was learned.  Ties go
    to the language that sorts first; a null doc_id stays null; repeated rows repeat; an empty table
    gives no rows; other columns are ignored.  The model is broadcast; VOCABULARY times the smaller of
    ALL_LANDMARKS and the number of languages bounds its larger matrix (256 MB).
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        grams = m and Grams(m.vocabulary)

        def work(batch: pa.RecordBatch) -> dict:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            rows = [i for i, t in enumerate(texts) if any(map(str.isalpha, t))] if m else []
            if rows:
                s = m.scores(grams, [texts[i] for i in rows])
                for i, k, v in zip(rows, s.argmax(1), s.max(1)):
                    lang[i], score[i] = m.languages[k], float(min(1.0, max(0.0, (v + 1) / 2)))
            return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": lang, "score": score}

        return work

    schema = "doc_id long, held_out boolean, lang_pred string, score double"
    return by_batch(df.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text"), schema, make)
