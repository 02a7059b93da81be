"""Near duplicates by Order MinHash and banded alignment.

A text is its sequence of five-word shingles, each labelled with its occurrence.  A sketch takes the
LENGTH labelled shingles that are smallest under one of SKETCHES hash orders and keeps them in text
order, so two texts agree on it when they share those shingles in the same order.  Texts that agree
on a sketch share a bucket; a bucket's members are compared with its representative by a banded
alignment of their shingles.  The similarity is aligned / (n1 + n2 - aligned): the Jaccard
similarity of the labelled shingles, counting only what an order-preserving alignment can match.

Texts with equal words are one node from the start.  Links unite nodes to classes; buckets that
still hold several classes are compared again, with other and more representatives, until a round
finds no link.  Then every pair of different classes that is left in a bucket is compared, so rounds
only save comparisons.  A pair is aligned only if its lengths and its parity bits allow the similarity: a
shingle that only one of two texts has flips one bit, so the bits that differ never outnumber the
shingles that do, and what this leaves out is surely below the threshold.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_batch, pieces

WORDS, SIMILARITY = 5, 0.8
SKETCHES, LENGTH = 32, 5
#: Texts of at most so many shingles also get short sketches, as long ones then hold nearly all of them.
FEW, FEW_SKETCHES, FEW_LENGTH = 20, 12, 2
#: Sketches of the first round; representatives of a bucket double each round up to so many.
FIRST, MOST_SLOTS = 8, 16
#: Members of a bucket that one cell of the last pass holds; larger buckets are dealt by length and hash.
CELL = 512
#: 64-bit words of a text's parity bits.
PARITY = 16

_P = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _P and of its inverse modulo 2^64, at least n of each."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 4096, 2 * len(_powers))
        back = np.uint64(pow(int(_P), -1, 1 << 64))
        _powers, _inverse = (np.cumprod(np.r_[np.uint64(1), np.full(size - 1, p, np.uint64)], dtype=np.uint64) for p in (_P, back))
    return _powers, _inverse


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, from prefix sums of a polynomial over the text's bytes."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    white = _WHITE[raw]
    edge = np.diff(np.r_[True, white, True].astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    powers, inverse = _tables(len(raw) + 1)
    sums = np.r_[np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[: len(raw)], dtype=np.uint64)]
    return _mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of five-word shingles; a shorter text is one shingle of all its words."""
    if not len(words):
        return words
    width = min(WORDS, len(words))
    n, out = len(words) - width + 1, np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out = _mix(out * _P + words[i : i + n])
    return out


def labelled(s: np.ndarray) -> np.ndarray:
    """Shingle hashes mixed with how often the same shingle came before."""
    order = np.argsort(s, kind="stable")
    run = s[order]
    first = np.r_[True, run[1:] != run[:-1]]
    if first.all():
        return s
    at = np.arange(len(s))
    nth = np.empty(len(s), np.uint64)
    nth[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return _mix(s + nth * _MIX2)


def _orders(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, np.uint64)


def _sketch(s: np.ndarray, n: int, length: int, seed: int) -> np.ndarray:
    out = np.full(n, np.uint64(seed), np.uint64)
    mult, add = _orders(n, seed)
    step = max(1, 500_000 // len(s))
    for at in range(0, n, step):
        x = (s[None, :] ^ add[at : at + step, None]) * mult[at : at + step, None]
        x ^= x >> np.uint64(32)
        take = np.sort(np.argpartition(x, length - 1, axis=1)[:, :length], axis=1) if length < len(s) else np.broadcast_to(np.arange(len(s)), x.shape)
        h = np.arange(at, at + len(x)).astype(np.uint64) + np.uint64(seed << 32)
        for i in range(take.shape[1]):
            h = _mix(h * _P + s[take[:, i]])
        out[at : at + step] = h
    return out


def sketches(s: np.ndarray) -> np.ndarray:
    """Bucket names of the sketches of a text's labelled shingles."""
    if not len(s):
        return s
    every = [_sketch(s, SKETCHES, LENGTH, 1)]
    if len(s) <= FEW:
        every.append(_sketch(s, FEW_SKETCHES, FEW_LENGTH, 2))
    return np.concatenate(every)


def parity(s: np.ndarray) -> np.ndarray:
    """PARITY words of bits: for each cell of the hash space, whether it holds an odd number of shingles."""
    odd = np.bincount((s >> np.uint64(64 - 6 - (PARITY - 1).bit_length())).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def aligned(a: list, b: list, band: int) -> int:
    """Longest common subsequence of a and b whose matches stay within ``band`` of the diagonal.

    One bit for each diagonal of the band: a window of 2 * band + 1 columns slides along the rows and
    is updated by an addition, a subtraction and an or."""
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    a, b = a[head:], b[head:]
    tail = 0
    while tail < len(a) and tail < len(b) and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    where: dict = {}
    for i, x in enumerate(a):
        where.setdefault(x, []).append(i)
    size = 2 * band + 1
    full, top = (1 << size) - 1, 1 << (size - 1)
    window, gone = full, 0
    for j, x in enumerate(b):
        if j:
            gone += not window & 1
            window = window >> 1 | top
        if places := where.get(x):
            low, match = j - band, 0
            for p in places[bisect_left(places, low) :]:
                if p > j + band:
                    break
                match |= 1 << (p - low)
            if match:
                both = window & match
                window = ((window + both) | (window - both)) & full
    return head + tail + gone + size - window.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Order-preserving similarity of two texts' word hashes; 0 where it is sure to be below ``least``."""
    x, y = labelled(shingles(a)), labelled(shingles(b))
    total = len(x) + len(y)
    if not total:
        return 0.0
    most = len(np.intersect1d(x, y, assume_unique=True))
    if most < least * (total - most) - 1e-9:
        return 0.0
    band = int(total - 2 * least / (1 + least) * total + 1e-9)
    same = aligned(x.tolist(), y.tolist(), band)
    return same / (total - same)


def node_of(text: Column) -> Column:
    """64 bits that stand for the words of a text; null where it has none."""
    words = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    return F.when(words != "", F.xxhash64(words))


def _prints(nodes: DataFrame) -> DataFrame:
    def make():
        def work(batch: pa.RecordBatch) -> dict:
            return {"node": batch.column("node"), "sketches": [sketches(labelled(shingles(word_hashes(t.as_py())))).view(np.int64) for t in batch.column("text")]}

        return work

    return by_batch(nodes, "node long, sketches array<long>", make)


def _word_arrays(texts: DataFrame) -> DataFrame:
    """node, words, n, bits: a text's word hashes, how many shingles it has, and their parity bits."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            words = [word_hashes(t.as_py()) for t in batch.column("text")]
            sets = [labelled(shingles(w)) for w in words]
            return {"node": batch.column("node"), "words": [w.astype(np.uint32).view(np.int32) for w in words], "n": [len(s) for s in sets], "bits": [parity(s) for s in sets]}

        return work

    return by_batch(texts, "node long, words array<int>, n int, bits array<long>", make)


def _verified(pairs: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """a, b, similarity of those pairs (a, b) that reach it."""
    words = words.select("node", "words")
    left = pairs.join(words.withColumnsRenamed({"node": "a", "words": "wa"}), "a")
    both = left.join(words.withColumnsRenamed({"node": "b", "words": "wb"}), "b").select("a", "b", "wa", "wb")

    def run(batches):
        for batch in pieces(batches):
            a, b, wa, wb = (batch.column(n) for n in ("a", "b", "wa", "wb"))
            keep = [similarity(x.values.to_numpy().view(np.uint32).astype(np.uint64), y.values.to_numpy().view(np.uint32).astype(np.uint64), least) for x, y in zip(wa, wb)]
            ok = pa.array([k >= least - 1e-9 for k in keep], pa.bool_())
            yield pa.RecordBatch.from_arrays([a, b, pa.array(keep, pa.float64())], ["a", "b", "similarity"]).filter(ok)

    return both.mapInArrow(run, "a long, b long, similarity double")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, comp: for each node of ``edges`` (a, b) the smallest node of its connected component.

    Each pass takes the smallest label among neighbours and then that label's own label, so labels
    travel twice as far each time; hubs are summed by partial aggregation."""
    both = scratch.write(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = scratch.write(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        near = scratch.write(seen.join(labels, F.col("a") == F.col("node")).select("node", F.col("comp").alias("old"), F.least("m", "comp").alias("comp")), "labels")
        jump = near.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        labels = scratch.write(near.join(jump, "comp", "left").select("node", "old", F.coalesce("next", "comp").alias("comp")), "labels")
        moved = labels.where("old <> comp").limit(1).count()
        labels = labels.select("node", "comp")
        if not moved:
            return labels


def merged(labels: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``labels`` (node, comp) after new links (a, b) between their classes or to nodes without one."""
    if labels is None:
        return components(links, scratch)
    known = lambda end: labels.withColumnsRenamed({"node": end, "comp": f"c{end}"})
    ends = links.select("a", "b").join(known("a"), "a", "left").join(known("b"), "b", "left")
    joined = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), scratch)
    now = joined.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
    moved = labels.join(now, "comp", "left").select("node", F.coalesce("next", "comp").alias("comp"))
    return scratch.write(moved.unionByName(joined.join(labels, "node", "left_anti")), "labels")


def _may_link(least: float) -> Column:
    """Whether lengths and parity bits of x and y allow ``least``: both bounds are exact."""
    total = F.col("xn") + F.col("yn")
    apart = sum((F.bit_count(F.col("xbits")[i].bitwiseXOR(F.col("ybits")[i])) for i in range(PARITY)), F.lit(0))
    fits = F.least("xn", "yn") >= least * F.greatest("xn", "yn") - 1e-9
    return fits & (apart <= (1 - least) / (1 + least) * total + 1e-9)


def _mixed(members: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``members`` (bucket, node and others) whose bucket still holds several classes."""
    known = members.join(labels, "node", "left").select("bucket", F.coalesce("comp", "node").alias("comp"))
    mixed = known.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    mixed = scratch.write(mixed.select("bucket"), "mixed")  # so that its size is known before members meet it
    return scratch.write(members.join(mixed, "bucket", "left_semi"), "members")


def _candidates(members: DataFrame, nodes: DataFrame, turn: int, least: float, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of members (bucket, node) of a bucket with its representatives, of different
    classes, that may link; ``nodes`` has node, comp, n and bits.

    The first two rounds take the smallest node of a bucket; later ones deal the nodes into slots anew
    and take one of each, in an order that differs by bucket: that of the node's bits with some flipped."""
    slots = 1 if turn < 2 else min(MOST_SLOTS, 2 ** (turn - 1))
    flip = F.lit(0).cast("long") if turn < 2 else F.xxhash64("bucket", F.lit(turn))
    slot = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(slots))
    first = members.groupBy("bucket", slot.alias("slot")).agg(F.min(F.col("node").bitwiseXOR(flip)).alias("o"))
    first = first.select("bucket", F.col("o").bitwiseXOR(flip).alias("node"))
    side = lambda of, c: of.join(nodes, "node").select("bucket", *(F.col(k).alias(c + k) for k in ("node", "comp", "n", "bits")))
    x, y = side(members, "x"), scratch.write(side(first, "y"), "representatives")
    on = (x["bucket"] == y["bucket"]) & (F.col("xcomp") != F.col("ycomp")) & _may_link(least)
    return x.join(y, on).select(F.greatest("xnode", "ynode").alias("a"), F.least("xnode", "ynode").alias("b")).distinct()


def _rest(members: DataFrame, nodes: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """All pairs (a, b) of members (bucket, node) of a bucket, of different classes, that may link.

    A bucket of more than CELL members is dealt into bands of length, so wide that a pair that may
    link is in one band or in two that follow each other, and these by hash into cells."""
    salts = F.ceil(F.col("size") / CELL)
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size")).select("bucket", salts.cast("int").alias("salts"))
    sizes = scratch.write(sizes, "bucket-sizes")
    band = F.when(F.col("salts") > 1, F.floor(F.log("n") / (1.01 * np.log(1 / least)))).otherwise(0).cast("int")
    salt = F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")
    dealt = members.select("bucket", "node").join(sizes, "bucket").join(nodes, "node")
    dealt = scratch.write(dealt.select("bucket", "node", "comp", "n", "bits", "salts", band.alias("band"), salt.alias("salt")), "dealt")
    every = F.explode(F.sequence(F.lit(0), F.col("salts") - 1))
    bands = F.explode(F.when(F.col("salts") > 1, F.array("band", F.col("band") - 1)).otherwise(F.array("band")))
    named = lambda c: [F.col(k).alias(c + k) for k in ("node", "comp", "n", "bits")]
    x = dealt.select("bucket", "band", F.col("salt").alias("i"), every.alias("j"), *named("x"))
    y = dealt.select("*", every.alias("i")).select("bucket", "i", F.col("salt").alias("j"), *named("y"), bands.alias("band"))
    before = (F.col("xn") < F.col("yn")) | ((F.col("xn") == F.col("yn")) & (F.col("xnode") < F.col("ynode")))
    both = x.join(y, ["bucket", "band", "i", "j"]).where((F.col("xcomp") != F.col("ycomp")) & before & _may_link(least))
    return both.select(F.greatest("xnode", "ynode").alias("a"), F.least("xnode", "ynode").alias("b")).distinct()


def classes(df: DataFrame, scratch: Scratch, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(labels, links): node, comp of every node that has a link; a, b, similarity of the links found.

    The first round compares the members of buckets of FIRST sketches with one representative; the
    later ones, over all sketches, only members that are not in its class yet, so near copies by the
    thousand cost few comparisons each.  Rounds go on until all sketches have had several
    representatives and a round finds no link; the last pass compares all that is left in mixed buckets."""
    texts = df.select(node_of(F.col("text")).alias("node"), "text").where("node is not null")
    prints = scratch.write(_prints(texts), "prints").dropDuplicates(["node"])
    rows = scratch.write(prints.select("node", F.posexplode("sketches").alias("sketch", "bucket")).withColumn("sketch", F.col("sketch").cast("byte")), "sketch-rows")
    shared = scratch.write(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "shared")
    members = scratch.write(rows.join(shared, "bucket", "left_semi"), "members")
    involved = scratch.write(members.select("node").distinct(), "involved")
    words = scratch.write(_word_arrays(texts.join(involved, "node")).dropDuplicates(["node"]), "words")
    traits = words.select("node", "n", "bits")
    tested, links, labels, turn, last = None, None, None, 0, False
    while True:
        if labels is None:
            nodes, some = traits.withColumn("comp", F.col("node")), members
        else:
            nodes = traits.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
            some = members = _mixed(members, labels, scratch)
        if not turn:
            some = members.where((F.col("sketch") < FIRST) | (F.col("sketch") >= SKETCHES))
        new = _rest(some, nodes, least, scratch) if last else _candidates(some, nodes, turn, least, scratch)
        if tested is not None:
            new = new.join(tested, ["a", "b"], "left_anti")
        new = scratch.write(new, "pairs")
        found = scratch.write(_verified(new, words, least), "verified")
        tested = new if tested is None else tested.unionByName(new)
        links = found if links is None else links.unionByName(found)
        some_found = found.limit(1).count() > 0
        if some_found:
            labels = merged(labels, found, scratch)
        if last:
            break
        last = turn >= 3 and not some_found
        turn += 1
    return components(links, scratch) if labels is None else labels, links


def near_duplicates(df: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, links, class_size of every row of ``df`` (doc_id, text).

    class_id is the smallest doc_id of the class; links counts the found links of the row's text to
    other texts; class_size counts rows.  White space does not tell texts apart.  A text without words,
    null included, is a class of its own (class_id its own doc_id, no links, size 1).  Rows of one
    text, whatever their ids, are one class; a null doc_id stays null and never names a class unless
    all of it are null.  An empty table gives no rows; other columns are left out.  Two different texts
    get one 64-bit node by chance with probability about n^2 / 2^65.
    """
    scratch = Scratch(df.sparkSession)
    labels, links = classes(df, scratch, least)
    docs = scratch.write(df.select(F.col("doc_id").cast("long"), node_of(F.col("text")).alias("node")), "nodes")
    named = docs.join(labels, "node", "left").select("doc_id", "node", F.coalesce("comp", "node").alias("comp"))
    named = scratch.write(named, "named")
    sizes = scratch.write(named.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")), "classes")
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
    degree = scratch.write(ends.groupBy("node").agg(F.count("*").alias("links")), "degrees")
    scratch.discard(named, sizes, degree)
    out = named.join(sizes, "comp", "left").join(degree, "node", "left")
    none = F.col("comp").isNull()
    return out.select(
        "doc_id", F.when(none, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
    )


def one_of_each(df: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``df`` (doc_id, text and any others) without near duplicates: of each class the row
    with the smallest doc_id stays, one row if it repeats; rows without words all stay."""
    scratch = Scratch(df.sparkSession)
    labels, _ = classes(df, scratch, least)
    docs = scratch.write(df.select("doc_id", node_of(F.col("text")).alias("node")).where("node is not null"), "nodes")
    named = docs.join(labels, "node", "left").select("doc_id", "node", F.coalesce("comp", "node").alias("comp"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node"))
    stay = scratch.write(named.groupBy("comp").agg(first.alias("x")).select(F.col("x.doc_id").alias("folio_id"), F.col("x.node").alias("folio_node")), "stay")
    scratch.discard(stay)
    marked = df.withColumn("folio_node", node_of(F.col("text")))
    kept = marked.join(stay, "folio_node").where(F.col("doc_id").eqNullSafe(F.col("folio_id"))).dropDuplicates(["folio_node"])
    return kept.select(*df.columns).unionByName(marked.where("folio_node is null").select(*df.columns))
