"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Every document of a source is expected target / size-of-source times. Inside a source, documents are
put in order of size; the k-th has the running sum k * rate, one random offset (a hash of seed and
source, so reruns agree) is added, and the document is emitted once per integer that its step
crosses. As neighbours in the order are about equally long, the words taken differ from the target by
at most about the longest document.

Defined results: null text has size 0; null source is a source and comes last; documents of size 0
count in the order like others; a source without words has target 0 and nothing is taken; an empty
table gives an empty result; repeated rows are documents of their own; ties in size go by doc_id (null
last), then by a hash of the text; very long texts count whole; other columns are ignored, or kept by
mixed(), whatever their names (but those that begin with _tm_).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.base import WORD, placed, ranked, saved, with_numbers

WEIGHTS = (5, 2, 1)
SHARE, MOST, SEED = 1.5, 2, 20240


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size): weighted shares of share * all sizes, none above most * its source.

    Water-filling in closed form: sources in order of cap / weight; the level is what remains after
    the caps of those before, over the weights of the rest; the first source whose cap isn't below
    that level, and all after it, get level * weight.
    """
    by = sized.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    by = by.withColumn("capped", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    by = by.withColumn("open", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    by = by.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    by = by.withColumn("level", F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(everything)["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return by.select("source", "source_size", target.alias("target"))


def mix_copies(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, and the columns of `keep`) for every document."""
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    # Rows equal in size and doc_id are told apart by their texts, so that reruns agree.
    sized = saved(docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("_tm_text"), *keep), "sized")
    goal = saved(targets(sized, weights, share, most), "targets").withColumnRenamed("source", "_tm_source")
    placed_ = ranked(sized, ["size", "doc_id", "_tm_text"], ["source"]).drop("_tm_text")
    placed_ = placed_.join(goal, placed_["source"].eqNullSafe(goal["_tm_source"])).drop("_tm_source")
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))))
    offset = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    step = lambda k: F.floor(offset + rate * k)
    return placed_.withColumn("copies", step(F.col("_tm_rank")) - step(F.col("_tm_rank") - 1)).drop("_tm_rank")


def mix_sources(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    return mix_copies(docs, **how).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with their own columns.

    Copies (most, so at most 9) go to rows by their place in the files, so no text is shuffled.
    """
    if how.get("most", MOST) > 9:
        raise ValueError("mixed() takes a document 9 times at most")
    at = placed(docs)
    copies = mix_copies(at, keep=("_tm_file", "_tm_row"), **how).where("copies > 0").select("_tm_file", "_tm_row", F.col("copies").alias("n"))
    found = with_numbers(at, copies, "_tm_copies").where("_tm_copies > 0")
    return found.withColumn("_tm_copy", F.explode(F.sequence(F.lit(1), F.col("_tm_copies")))).select(*docs.columns)
