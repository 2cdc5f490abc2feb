"""Exact dedup with a heavy-hitter split.

Misra-Gries sketches of every partition name the digests that may be frequent. Their groups are
counted exactly, and the winners (at most HEAVY of them) are broadcast, so the members of a large
group are settled where they lie. All other digests go through an ordinary shuffle, in which no
group is larger than the sketches let through.

Defined results: null text counts as empty; empty texts are equal to each other; of equal texts the
row with the largest doc_id stays, a null doc_id being smaller than any other; of rows repeated with
the same doc_id (ties) the last in scan order stays; very long texts are hashed whole; an empty table
gives an empty result; other columns are ignored, or kept by drop_copies, whatever their names (but those
that begin with _tm_).
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.base import ascii_lower, forget, placed, saved, with_numbers

#: Counters of a sketch, and the most winners that are broadcast (about 70 bytes each).
COUNTERS, HEAVY = 1024, 4096


def misra_gries(held: Counter, seen: Counter, size: int) -> Counter:
    """The sketch of two multisets from the sketch of one and the counts of the other.

    Counts are added; if more than `size` remain, the (size+1)-th largest count is taken off all and
    what falls to zero goes. A count is short by at most the total over size + 1.
    """
    held = held + seen
    if len(held) <= size:
        return held
    off = sorted(held.values(), reverse=True)[size]
    return Counter({k: n - off for k, n in held.items() if n > off})


def sketches(digests: DataFrame, size: int = COUNTERS) -> DataFrame:
    """(digest, estimate): the sketch of every partition, summed over partitions."""

    def sketch(batches):
        import pyarrow as pa

        held: Counter = Counter()
        for batch in batches:
            held = misra_gries(held, Counter(batch.column(0).to_pylist()), size)
        found = [(k, n) for k, n in held.items() if n > 1]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], ["digest", "estimate"])

    return digests.select("digest").mapInArrow(sketch, "digest binary, estimate long").groupBy("digest").agg(F.sum("estimate").alias("estimate"))


def verdicts(found: DataFrame, heavy: int = HEAVY, counters: int = COUNTERS) -> DataFrame:
    """found (doc_id, digest, row: one that tells rows apart, saved) with best (doc_id, row) and group_size."""
    maybe = sketches(found, counters).orderBy(F.desc("estimate"), "digest").limit(heavy)
    facts = (F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    winners = saved(found.join(F.broadcast(maybe.select("digest")), "digest").groupBy("digest").agg(*facts), "winners")
    large = found.join(F.broadcast(winners), "digest")
    rest = found.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    # Counted map-side and joined back, so no task holds a group, however large the sketches let it be.
    groups = rest.groupBy(F.col("digest").alias("_tm_digest")).agg(*facts)
    rest = rest.join(groups, F.col("digest") == F.col("_tm_digest")).drop("_tm_digest")
    return large.select(*rest.columns).unionByName(rest)


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(ascii_lower(text), 256))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    found = saved(docs.select("doc_id", digest(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")
    v = verdicts(found)
    return v.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns. Verdicts go to rows by their place in the files, so no text is shuffled."""
    at = placed(docs)
    found = saved(at.select("doc_id", digest(F.col("text")).alias("digest"), F.struct("_tm_file", "_tm_row").alias("row")), "digests")
    gone = verdicts(found).where(F.col("row") != F.col("best.row")).select("row._tm_file", "row._tm_row", F.lit(1).alias("n"))
    kept = with_numbers(at, gone, "_tm_gone").where("_tm_gone = 0").select(*docs.columns)
    forget(found)
    return kept
