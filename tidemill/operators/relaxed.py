"""Union by name with widening, and reads that keep the order of shards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGERS = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]


def supertype(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest type that holds both: wider integer, double for mixed numbers, string for the rest."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if type(a) in _INTEGERS and type(b) in _INTEGERS:
        return max(a, b, key=lambda t: _INTEGERS.index(type(t)))
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        if isinstance(a, T.FloatType) and isinstance(b, T.FloatType):
            return a
        if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
            scale = max(a.scale, b.scale)
            return T.DecimalType(min(38, max(a.precision - a.scale, b.precision - b.scale) + scale), scale)
        return T.DoubleType()
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(supertype(a.elementType, b.elementType))
    if {type(a), type(b)} == {T.DateType, T.TimestampType}:
        return T.TimestampType()
    if {type(a), type(b)} == {T.DateType, T.TimestampNTZType}:
        return T.TimestampNTZType()
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        mine = {f.name: f.dataType for f in a.fields}
        other = {f.name: f.dataType for f in b.fields}
        return T.StructType([T.StructField(n, supertype(mine.get(n, T.NullType()), other.get(n, T.NullType()))) for n in dict.fromkeys([*mine, *other])])
    return T.StringType()


def relaxed_union(frames: list[DataFrame]) -> DataFrame:
    """All rows, columns by name in order of appearance, missing ones null, types widened."""
    types: dict[str, T.DataType] = {}
    for df in frames:
        for f in df.schema.fields:
            types[f.name] = supertype(types[f.name], f.dataType) if f.name in types else f.dataType
    quoted = lambda n: "`" + n.replace("`", "``") + "`"
    fitted = [df.select(*[(F.col(quoted(n)).cast(t) if n in df.columns else F.lit(None).cast(t)).alias(n) for n, t in types.items()]) for df in frames]
    return reduce(DataFrame.unionByName, fitted)


def read_shards(spark: SparkSession, paths: list[str], ordered: bool = False, schemas: list[T.StructType] | None = None) -> DataFrame:
    """Parquet shards as one frame: one scan for each schema among them, joined by a relaxed union.

    schemas: of each path, so that no footer is opened on the driver. `ordered` adds _shard and _row, by which
    the rows sort as the shards were listed and written; they come from the scan, without a shuffle.
    """
    schemas = schemas or [spark.read.parquet(p).schema for p in paths]
    alike: dict[str, list[int]] = {}
    for k, schema in enumerate(schemas):
        alike.setdefault("|".join(f"{f.name}:{f.dataType.simpleString()}" for f in schema.fields), []).append(k)
    frames = [spark.read.schema(schemas[of[0]]).parquet(*[paths[k] for k in of]) for of in alike.values()]
    if ordered:
        name = lambda p: p.rstrip("/").rsplit("/", 1)[-1]
        file = F.split(F.col("_metadata.file_path"), "/")
        row = F.concat_ws("#", F.col("_metadata.file_path"), F.lpad(F.col("_metadata.row_index").cast("string"), 20, "0")).alias("_row")
        # A shard is a folder of files, or, from outside, a file or a folder of folders.
        own = [F.url_decode(F.element_at(file, -k)).alias(f"_tm_{k}") for k in (1, 2)]

        def tagged(df: DataFrame) -> DataFrame:
            if len(paths) == 1:
                return df.select("*", F.lit(0).alias("_shard"), row)
            out = df.select("*", *own, row)
            for k in (1, 2):
                place = spark.createDataFrame([(name(p), i) for i, p in enumerate(paths)], f"_tm_name{k} string, _tm_at{k} int")
                out = out.join(F.broadcast(place), F.col(f"_tm_{k}") == F.col(f"_tm_name{k}"), "left")
            return out.withColumn("_shard", F.coalesce("_tm_at2", "_tm_at1", F.lit(-1))).select(*df.columns, "_shard", "_row")

        frames = [tagged(df) for df in frames]
    return frames[0] if len(frames) == 1 else relaxed_union(frames)


def in_order(df: DataFrame) -> DataFrame:
    """An ordered read without its two columns, sorted. Where an aggregate or join follows, Catalyst drops the sort."""
    return df.orderBy("_shard", "_row").drop("_shard", "_row")
