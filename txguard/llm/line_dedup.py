"""Line dedup: remove lines that spread over many sites.

Lines are known by their hash.  Per line hash, HyperLogLog sketches of the
sites and of the documents merge by aggregation; lines whose estimate lies near
a threshold get exact distinct counts.  A line is boilerplate when it stands on
at least ``min_sites`` sites and in at least as many distinct documents, copies
counted once.  The second condition tells a menu line, alone or in a block,
from the lines of a document that was copied to many sites: those stand in one
document, and stay.

Functions of Spark only.  Single-site lines, nearly all of them, leave after
one small count; a line on a third of all documents is spread over salts before
its sketches merge, and again before its exact counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txguard.llm.scratch import Scratch, own_name

MIN_SITES = 5
#: Relative distance to a threshold within which the sketch does not decide (its standard error is 1.6 %).
NEAR = 0.1
SALTS = 16

_BLANK = r"^[\x20\x09-\x0D]*$"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _solid(lines: Column) -> Column:
    return F.filter(lines, lambda s: ~F.rlike(s, F.lit(_BLANK)))


def spread_lines(spark: SparkSession, docs: DataFrame, min_sites: int = MIN_SITES, site_col: str = "source",
                 text_col: str = "text") -> DataFrame:
    """Hashes (``line``) of the boilerplate lines; a null site is a site of its own.

    A document is the set of its lines, which for a given line is as good as the
    rest of the text.
    """
    places = docs.select(F.xxhash64(F.col(site_col)).alias("site"), _solid(_lines(F.col(text_col))).alias("solid"))
    own = F.array_sort(F.array_distinct(F.transform("solid", lambda s: F.xxhash64(s))))
    places = places.select("site", own.alias("own")).select("site", F.explode("own").alias("line"), F.xxhash64("own").alias("doc"))
    several = (places.groupBy("line").agg(F.min("site").alias("a"), F.max("site").alias("b"), F.count(F.lit(1)).alias("n"))
               .filter((F.col("a") != F.col("b")) & (F.col("n") >= min_sites)))

    def salted(lines: DataFrame) -> DataFrame:
        return lines.select("line", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))

    seen = places.withColumn("salt", F.pmod(F.col("doc"), F.lit(SALTS)).cast("int")).join(salted(several), ["line", "salt"], "left_semi")
    seen = Scratch(spark, "line-dedup").write(seen.select("line", "salt", "site", "doc"))
    rough = (seen.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site")).alias("sites"),
                                      F.hll_sketch_estimate(F.hll_sketch_agg("doc")).alias("docs")))
    near = [F.abs(F.col(c) - min_sites) <= max(1.0, NEAR * min_sites) for c in ("sites", "docs")]
    rough = rough.withColumn("near", near[0] | near[1])
    clear = rough.filter(~F.col("near") & (F.col("sites") >= min_sites) & (F.col("docs") >= min_sites)).select("line")
    part = seen.join(salted(rough.filter("near")), ["line", "salt"], "left_semi")
    exact = [part.select("line", c).distinct().groupBy("line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_sites)
             .select("line") for c in ("site", "doc")]
    return clear.unionByName(exact[0].join(exact[1], "line", "left_semi"))


def line_dedup(spark: SparkSession, docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id",
               site_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, and ``n_lines``, ``n_removed``.

    Lines are what stands between ``\\n``; ``n_lines`` counts those with a word,
    lines without one stay and are never boilerplate.  A null text stays null
    with no lines.  All rows and columns stay; a document that loses every line
    has an empty text.  Rows with equal or null ids are cleaned alike, each its
    own text.  Columns of ``docs`` named ``n_lines`` or ``n_removed`` are
    replaced.  An empty table gives an empty result.
    """
    spread = Scratch(spark, "line-dedup").write(spread_lines(spark, docs, min_sites, site_col, text_col))
    hashes = F.array_distinct(F.transform(_solid(_lines(F.col(text_col))), lambda s: F.xxhash64(s)))
    # columns of documents may have any name: the ones added here have names that none of them has
    id_, bad, all_, kept = (own_name(docs, n) for n in ("line_id", "line_bad", "line_all", "line_kept"))
    mine = (docs.select(F.col(id_col).alias("id"), F.explode(hashes).alias("line"))
            .join(spread, "line", "left_semi").groupBy("id").agg(F.collect_set("line").alias(bad)).withColumnRenamed("id", id_))
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    listed = F.coalesce(F.col(bad), F.array().cast("array<bigint>"))

    def stays(s: Column) -> Column:
        return F.rlike(s, F.lit(_BLANK)) | ~F.array_contains(listed, F.xxhash64(s))

    out = docs.select(keep).join(mine, F.col(id_col).eqNullSafe(F.col(id_)), "left")
    lines = _lines(F.col(text_col))
    cleaned = out.withColumns({all_: lines, kept: F.filter(lines, stays)})
    text = F.when(F.col(text_col).isNotNull(), F.array_join(kept, "\n"))
    return cleaned.select(
        *[text.alias(c) if c == text_col else F.col(c) for c in keep],
        F.size(_solid(F.col(all_))).cast("long").alias("n_lines"),
        (F.size(all_) - F.size(kept)).cast("long").alias("n_removed"))
