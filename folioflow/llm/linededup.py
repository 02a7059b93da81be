"""Line dedup by distinct-site spread.

Each line's hash gathers a HyperLogLog sketch of the sites that show it; sketches merge by
aggregation, so a line on a third of all pages costs no more than a sketch a task.  Lines whose
estimate is far above the threshold are boilerplate, those far below are not, and those near it get
an exact distinct count.  Boilerplate stays in the document with the smallest id that has it and
goes from all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Scratch

#: Distinct sites from which a line is boilerplate, and words from which a line is looked at.
SITES, LEAST_WORDS = 10, 1
#: log2 of a sketch's registers (standard error 3.3 %) and the share around the threshold counted exactly.
LG_K, NEAR = 10, 0.25
WHITE = "\t\n\x0b\x0c\r "


def line_hash(line: Column) -> Column:
    """Two 64-bit hashes of a line without white space at its ends; two different ones of n lines share
    both with a probability of about n^2 / 2^129."""
    bare = F.trim(line, F.lit(WHITE))
    return F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit("line"), bare).alias("b"))


def eligible(line: Column, least: int = LEAST_WORDS) -> Column:
    return F.regexp_count(line, F.lit(WORD)) >= least


def spread_lines(df: DataFrame, scratch: Scratch, site: str = "source", sites: int = SITES, least: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lines, boilerplate) of ``df`` (doc_id, text, site).

    lines: key, doc_id, a, b, one row for each distinct eligible line of a document.  boilerplate: a, b,
    keeper, each line on at least ``sites`` distinct sites, a null site being one."""
    found = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: eligible(x, least)), line_hash))
    lines = df.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", F.xxhash64(F.col(site)).alias("site"), F.explode(found).alias("h"))
    lines = scratch.write(lines.select("key", "doc_id", "site", "h.a", "h.b"), "lines")
    spread = lines.groupBy("a", "b").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("about"), F.min("doc_id").alias("keeper")
    )
    wide = scratch.write(spread.where(F.col("about") >= sites * (1 - NEAR)), "spread")
    near = wide.where(F.col("about") <= sites * (1 + NEAR)).select("a", "b")
    exact = (
        lines.join(near, ["a", "b"], "left_semi").select("a", "b", "site").distinct()
        .groupBy("a", "b").agg(F.count("*").alias("exact")).where(F.col("exact") >= sites).select("a", "b")
    )
    sure = wide.where(F.col("about") > sites * (1 + NEAR))
    boilerplate = sure.unionByName(wide.join(exact, ["a", "b"], "left_semi")).select("a", "b", "keeper")
    return lines, scratch.write(boilerplate, "boilerplate")


def dedup_lines(df: DataFrame, site: str = "source", sites: int = SITES, least: int = LEAST_WORDS) -> DataFrame:
    """``df`` with boilerplate lines taken out of ``text``, and n_lines, n_removed added.

    A line counts if it has ``least`` words; its white space at both ends is ignored when lines are
    compared.  A null text stays null with no lines; an empty text has one empty line, which stays.
    A document keeps lines that it holds under the smallest doc_id; rows of that id keep them all,
    and lines seen under null ids alone go nowhere.  Repeated rows are treated alike; an empty table
    gives no rows; extra columns pass through, but for clashing n_lines and n_removed, which are replaced.
    """
    scratch = Scratch(df.sparkSession)
    lines, boilerplate = spread_lines(df, scratch, site, sites, least)
    gone = (
        lines.join(boilerplate, ["a", "b"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("gone"))
    )
    columns = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    own = F.struct(*(F.col(f"`{c}`") for c in columns)).alias("own")
    docs = df.select(own, F.xxhash64("doc_id", "text").alias("key"))
    # what goes grows with the documents, so it is not broadcast at any size
    gone = scratch.write(gone, "gone")
    scratch.discard(gone)
    docs = docs.join(gone.hint("merge"), "key", "left")
    parts = F.split("own.text", "\n")
    kept = F.filter(parts, lambda x: ~(eligible(x, least) & F.array_contains("gone", line_hash(x))))
    text = F.when(F.col("gone").isNull(), F.col("own.text")).otherwise(F.array_join(kept, "\n"))
    removed = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size(parts) - F.size(kept)).cast("long")
    n = F.when(F.col("own.text").isNull(), F.lit(0)).otherwise(F.size(parts)).cast("long")
    # one struct first: no column's name can stand for another's in it
    whole = F.struct(*((text if c == "text" else F.col("own")[c]).alias(c) for c in columns), n.alias("n_lines"), removed.alias("n_removed"))
    return docs.select(whole.alias("own")).select(*(F.col("own")[c].alias(c) for c in (*columns, "n_lines", "n_removed")))
