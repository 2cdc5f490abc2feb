"""Sharding along a Hilbert curve, in DataFrame functions only.

Source, language and size of a document are quantised to BITS bits each: the two strings by their
place among the values in code-point order, the size by its bit length. Documents are ordered by the
index of that cell on the Hilbert curve, then by text_crc32 and size, so that equal texts of a cell lie
together, then by doc_id, and the order is cut into runs of equal row counts (law `rows`). Neighbours on the curve are neighbours in every dimension, so each shard covers a
small box and file statistics prune on any of the three columns.

Defined results: null text has size 8 and checksum 0; a null source or language comes last among the
values; fewer documents than shards leave shards of one row or none; equal texts (the groups) are in one
shard, or in neighbouring ones where a cut falls between them, if they agree in source and language; very
long texts count whole; an empty table gives an empty result; repeated rows are documents of their own,
and which of them (ties in all of these) gets which slot doesn't matter; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.base import ranked, saved

SHARDS, BITS, DIMS = 24, 5, 3


def curve_tables(dims: int = DIMS) -> tuple[list[int], list[int]]:
    """For each state and sub-cube of the curve its digit and next state, at state * 2**dims + sub-cube.

    A state is the corner at which the curve enters a cube and the axis along which it leaves;
    sub-cubes are visited in Gray-code order, turned by that state.
    """
    size = 1 << dims

    def turn(x: int, by: int) -> int:
        by %= dims
        return ((x << by) | (x >> (dims - by))) & (size - 1) if by else x

    def trailing(x: int) -> int:
        n = 0
        while x & 1:
            x, n = x >> 1, n + 1
        return n

    gray = [i ^ (i >> 1) for i in range(size)]
    order = {g: i for i, g in enumerate(gray)}
    entry = [0 if i == 0 else gray[2 * ((i - 1) // 2)] for i in range(size)]
    axis = [0 if i == 0 else trailing(i - 1 if i % 2 == 0 else i) % dims for i in range(size)]
    digits, nexts = [], []
    for state in range(size * dims):
        corner, along = divmod(state, dims)
        for cube in range(size):
            w = order[turn(cube ^ corner, dims - (along + 1) % dims)]
            digits.append(w)
            nexts.append((corner ^ turn(entry[w], along + 1)) * dims + (along + axis[w] + 1) % dims)
    return digits, nexts


def curve_index(columns: list[str], bits: int = BITS):
    """The index on the Hilbert curve of integer columns below 2**bits, as a Column."""
    dims = len(columns)
    size = 1 << dims
    digits, nexts = curve_tables(dims)
    cube = " + ".join(f"(shiftright({c}, i) & 1) * {1 << k}" for k, c in enumerate(columns))
    at = f"a.s * {size} + {cube} + 1"
    array = lambda xs: f"array({', '.join(map(str, xs))})"
    return F.expr(
        f"aggregate(sequence({bits - 1}, 0, -1), named_struct('h', 0L, 's', 0),"
        f" (a, i) -> named_struct('h', a.h * {size} + element_at({array(digits)}, {at}), 's', element_at({array(nexts)}, {at})), a -> a.h)"
    )


def ordinal(docs: DataFrame, column: str, bits: int) -> DataFrame:
    """(value, place): the distinct values spread in order over 2**bits places."""
    seen = docs.groupBy(F.col(column).alias("_tm_value")).agg(F.lit(1).alias("_tm_one"))
    order = Window.orderBy(F.col("_tm_value").asc_nulls_last())
    place = (F.row_number().over(order) - 1) * (1 << bits)
    return seen.select("_tm_value", F.floor(place / F.count(F.lit(1)).over(Window.partitionBy())).cast("int").alias(f"_tm_{column}"))


def shard(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, and the curve index as extra."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = saved(docs.select("doc_id", "source", "lang", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")), "sizes")
    cells = own.withColumn("_tm_size", F.least(F.lit((1 << bits) - 1), F.length(F.bin("size")) - 1))
    for column in ("source", "lang"):
        places = saved(ordinal(own, column, bits), "places")
        cells = cells.join(places, cells[column].eqNullSafe(places["_tm_value"])).drop("_tm_value")
    cells = saved(cells.select("doc_id", "size", "text_crc32", curve_index(["_tm_source", "_tm_lang", "_tm_size"], bits).alias("curve")), "cells")
    total = cells.agg(F.count(F.lit(1))).first()[0]
    placed = ranked(cells, ["curve", "text_crc32", "size", "doc_id"]).withColumn("_tm_rank", F.col("_tm_rank") - 1)
    number = F.expr(f"cast((_tm_rank * {shards}L) div {max(total, 1)}L as int)")
    first = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    placed = placed.withColumn("shard", number).withColumn("slot", F.col("_tm_rank") - first)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
