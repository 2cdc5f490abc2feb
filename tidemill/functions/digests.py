"""Short digests, fingerprints of frames, ids of selections and derivation keys."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

WIDTH = 16
ABSENT = "0" * WIDTH


def short(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:WIDTH]


def short_column(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, WIDTH)


def schema_text(schema: StructType) -> str:
    """Names and types in order; nullability and metadata don't count."""
    return "|".join(f"{f.name}:{f.dataType.simpleString()}" for f in schema.fields)


def _nested(kind: DataType) -> bool:
    return isinstance(kind, ArrayType | StructType | MapType)


def row_hash(df: DataFrame) -> Column:
    """A 64-bit hash of a row that tells nulls and their places apart.

    xxhash64 skips nulls and refuses maps, so every column comes with whether it is null, and nested
    ones as JSON with their nulls, maps as sorted entries.
    """
    parts: list[Column] = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name.replace('`', '``')}`")
        parts.append(c.isNull())
        if isinstance(f.dataType, MapType):
            parts.append(F.to_json(F.array_sort(F.map_entries(c)), {"ignoreNullFields": "false"}))
        elif _nested(f.dataType):
            parts.append(F.to_json(c, {"ignoreNullFields": "false"}))
        elif isinstance(f.dataType, DoubleType | FloatType):
            parts.append(F.when(F.isnan(c), F.lit(float("nan"))).otherwise(c))
        else:
            parts.append(c)
    return F.xxhash64(*parts) if parts else F.lit(0).cast("long")


def fingerprint(df: DataFrame) -> str:
    """Of rows regardless of their order, their number, and the schema. One aggregation, partial on every task."""
    n, total = df.select(row_hash(df).alias("h")).agg(F.count(F.lit(1)), F.sum(F.col("h").cast("decimal(38,0)"))).first()
    return fingerprint_text(df.schema, n, total)


def fingerprints(df: DataFrame, by: list[str], schema: StructType) -> list[tuple[tuple[str, ...], str]]:
    """(values of `by`, fingerprint of the columns of `schema`) for every group, in one aggregation."""
    own = df.select(*by, row_hash(df.select(*[f"`{f.name.replace('`', '``')}`" for f in schema.fields])).alias("_tm_h"))
    found = own.groupBy(*by).agg(F.count(F.lit(1)), F.sum(F.col("_tm_h").cast("decimal(38,0)"))).collect()
    return [(tuple(r[: len(by)]), fingerprint_text(schema, r[-2], r[-1])) for r in found]


def fingerprint_text(schema: StructType, n: int, total) -> str:
    return short(f"empty|{schema_text(schema)}") if not n else short(f"{n}|{schema_text(schema)}|{total}")


def bytes_fingerprint(data: bytes) -> str:
    return short("bytes:" + hashlib.sha256(data).hexdigest())


def selection_id(shards: list[tuple[str, str]]) -> str:
    """Of (partition, fingerprint) pairs."""
    if not shards:
        return "data:(empty)"
    return "data:" + short("|".join(f"{p}:{fp}" for p, fp in sorted(shards)))


def derivation_key(dataset: str, part: str, inputs: set[tuple[str, str]], schema: str = "", version: str = "") -> str:
    """Of what a shard was made from: declared inputs, schema and version, never code."""
    if not inputs and not schema and not version:
        return ""
    text = f"key:{dataset}|{part}"
    if schema:
        text += f"|schema={schema}"
    if version:
        text += f"|version={version}"
    return short("|".join([text, *(f"{n}={i}" for n, i in sorted(inputs))]))
