"""What the operators share: tables, the shared folder, distributed ranks and vectorised words."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes that separate words: [\x20\x09-\x0D].
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = r"[^\x20\x09-\x0D]+"
#: Rows whose numbers are one binary value, as a power of two, and the most rows whose numbers are broadcast (a byte each).
CHUNK, PLACES = 12, 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none, on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith(("local[", "local-")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidemill-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends at files that outlive any executor."""
    path = f"{shared_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    trimmed(df.sparkSession)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._tm_path = path
    return found


def forget(*tables: DataFrame) -> None:
    """Remove tables that saved() wrote, once all that was made of them is saved itself."""
    for df in tables:
        jvm, session = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc
        path = jvm.org.apache.hadoop.fs.Path(df._tm_path)
        path.getFileSystem(session.hadoopConfiguration()).delete(path, True)


def from_one_scan(df: DataFrame) -> bool:
    """Whether df is a scan of Parquet files with nothing but projections and filters above it."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return node.nodeName() == "LogicalRelation"


def placed(docs: DataFrame) -> DataFrame:
    """docs with the place of each row: _tm_file (a hash of its file's path) and _tm_row (its number in the file).

    Places are the same in every scan, so what is decided about rows can be brought to their texts without
    a join by value. Frames that aren't a plain scan of Parquet files are saved first.
    """
    if "_metadata" not in docs.columns and from_one_scan(docs):
        try:
            return docs.select("*", F.xxhash64("_metadata.file_path").alias("_tm_file"), F.col("_metadata.row_index").alias("_tm_row"))
        except AnalysisException:
            pass  # another format, which has no row numbers
    return saved(docs.select("*", F.lit(0).cast("long").alias("_tm_file"), F.monotonically_increasing_id().alias("_tm_row")), "rows")


def with_numbers(docs: DataFrame, numbers: DataFrame, name: str) -> DataFrame:
    """placed() docs with the number (0 to 9) that `numbers` (_tm_file, _tm_row, n) has for each row, 0 where it has none.

    Numbers travel as a byte each, 1 << CHUNK rows in one value. Up to PLACES rows they are broadcast; beyond,
    docs are shuffled by file and chunk.
    """
    own = F.struct((F.col("_tm_row") % (1 << CHUNK)).cast("int").alias("k"), F.col("n").cast("string").alias("n"))
    part = numbers.groupBy(F.col("_tm_file").alias("_tm_f"), F.shiftright("_tm_row", CHUNK).alias("_tm_c")).agg(F.array_sort(F.collect_list(own)).alias("x"))
    # Zeros fill the gaps between the rows that have a number.
    text = F.expr("array_join(transform(x, (e, i) -> concat(repeat('0', e.k - if(i = 0, -1, x[greatest(i, 1) - 1].k) - 1), e.n)), '')")
    part = saved(part.select("_tm_f", "_tm_c", text.cast("binary").alias("_tm_n")), name)
    small = (part.agg(F.sum(F.octet_length("_tm_n"))).first()[0] or 0) <= PLACES
    found = docs.join(F.broadcast(part) if small else part, (F.col("_tm_file") == F.col("_tm_f")) & (F.shiftright("_tm_row", CHUNK) == F.col("_tm_c")), "left")
    number = F.conv(F.hex(F.substring("_tm_n", (F.col("_tm_row") % (1 << CHUNK)).cast("int") + 1, F.lit(1))), 16, 10).cast("int") - 48
    return found.withColumn(name, F.coalesce(number, F.lit(0))).drop("_tm_f", "_tm_c", "_tm_n")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, order: list[str], within: list[str] = (), rank: str = "_tm_rank") -> DataFrame:
    """df with the 1-based rank of each row in `order` inside each value of `within` (nulls are a value).

    No task holds a whole group: rows are range-partitioned by group and order, ranked inside their
    partition, and shifted by the counts of the partitions before it. `df` is read twice, so it should
    be cheap (a saved table). Rows equal in all of these columns may swap ranks.
    """
    spark, within = df.sparkSession, list(within)
    keys = [F.col(c).asc_nulls_last() for c in [*within, *order]]
    if not keys:
        raise ValueError("ranked() needs an order")
    dealt = saved(df.repartitionByRange(parts(spark), *keys).withColumn("_tm_pid", F.spark_partition_id()), "dealt")
    before = Window.orderBy("_tm_pid") if not within else Window.partitionBy(*within).orderBy("_tm_pid")
    counts = dealt.groupBy("_tm_pid", *within).agg(F.count(F.lit(1)).alias("_tm_n"))
    counts = counts.withColumn("_tm_before", F.coalesce(F.sum("_tm_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counts = counts.select("_tm_before", *[F.col(c).alias(f"_tm_k{i}") for i, c in enumerate(["_tm_pid", *within])])
    own = dealt.withColumn(rank, F.row_number().over(Window.partitionBy("_tm_pid", *within).orderBy(*[F.col(c).asc_nulls_last() for c in order])))
    same = F.lit(True)
    for i, c in enumerate(["_tm_pid", *within]):
        same &= own[c].eqNullSafe(counts[f"_tm_k{i}"])
    joined = own.join(counts, same)
    return joined.withColumn(rank, F.col(rank) + F.col("_tm_before")).select(*df.columns, rank)


def ascii_lower(text: Column) -> Column:
    """A-Z only, other letters stay; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text (a null one: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def joined_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string or binary column, rows separated by one newline, and where each row starts.

    Row i is data[starts[i] : starts[i + 1] - 1]; null counts as empty.
    """
    import pyarrow as pa

    column = column.cast(pa.large_binary()).fill_null(b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1, offset=8 * column.offset) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    starts = offsets - offsets[0] + np.arange(n + 1)
    data = np.full(len(raw) + n, 10, dtype=np.uint8)
    keep = np.ones(len(data), dtype=bool)
    keep[starts[1:] - 1] = False
    data[keep] = raw
    return data, starts


def released() -> None:
    """Give freed memory back to the system: Python workers stay alive between tasks, and would keep the most they ever used."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries have none
    if trim:
        trim(0)


def trimmed(spark: SparkSession) -> bool:
    """Give what the driver has freed back to the system, its Python's memory and its JVM's; whether the JVM could.

    Compilers and planners free most of what they take outside the heap, but the C library keeps the most that
    each thread ever used, so a driver that plans hundreds of jobs would grow with each.
    """
    released()
    context = spark.sparkContext
    jvm, new = context._jvm, context._gateway.new_array
    try:
        if not hasattr(context, "_tm_trim"):
            args = new(jvm.java.lang.Object, 4)
            args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
            args[2], args[3] = new(jvm.java.lang.Object, 0), new(jvm.java.lang.String, 0)
            # By reflection, as the server's own class isn't public.
            invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
            context._tm_trim = invoke, jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args
        invoke, server, args = context._tm_trim
        invoke.invoke(server, args)
    except (Py4JError, PySparkException):  # other JVMs and C libraries have no such command
        return False
    return True


def batched(batches, most: int = 4_000_000):
    """Arrow batches joined or cut so that each holds about `most` bytes of its text columns, one row at least."""
    import pyarrow as pa

    held, size = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            step = batch.num_rows - at
            while step > 1 and batch.slice(at, step).nbytes > most:
                step = (step + 1) // 2
            piece = batch.slice(at, step)
            at += step
            if held and size + piece.nbytes > most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                released()
            held.append(piece)
            size += piece.nbytes
    if held:
        yield pa.Table.from_batches(held)
        held = []
        released()


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1024), base, dtype=np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


#: All bytes but ASCII letters and those of other scripts.
NO_LETTER = np.ones(256, dtype=bool)
NO_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def words(data: np.ndarray, between: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that don't lie `between` words; data ends with one that does."""
    white = between[data]
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    if len(data) and not white[0]:
        edge = np.concatenate([[0], edge])
    return edge[::2], edge[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of the bytes of each word: a polynomial in an odd base, then mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    at = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
    with np.errstate(over="ignore"):
        terms = (data[at + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)) * powers(base | 1, int(lengths.max()))[at]
        return mix(np.add.reduceat(terms, firsts) + lengths.astype(np.uint64))


def spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (count[i] of them), for every i in turn."""
    total = np.cumsum(count)
    return np.arange(int(total[-1]) if len(total) else 0) + np.repeat(first - (total - count), count)


def summed(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of `count` rows; 0 for empty runs."""
    out = np.zeros((len(count), *values.shape[1:]), dtype=values.dtype)
    full = np.flatnonzero(count)
    if len(full):
        out[full] = np.add.reduceat(values, (np.cumsum(count) - count)[full], axis=0)
    return out


def components(edges: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(node, root, name): the smallest node that each node of the edges (a, b: long) can reach.

    With `names` (node, name), the node of smallest name (null last), and that name. Every round takes the
    smallest label among neighbours and then the label's own label, so the distance that a label travels
    doubles. Each round ends in a saved table.
    """
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("u"))).distinct()
    both = saved(both, "edges")
    nodes = both.select("v").distinct()
    if names is None:
        nodes = nodes.withColumn("name", F.lit(None).cast("long"))
    else:
        nodes = nodes.join(names.withColumnRenamed("node", "_tm_node"), F.col("v") == F.col("_tm_node"))
    labels = saved(nodes.select("v", F.struct(F.col("name").isNull().alias("none"), "name", "v").alias("l")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("u"), "l"), "u").groupBy("v").agg(F.min("l").alias("m"))
        low = labels.join(near, "v").select("v", F.col("l").alias("old"), F.least("l", "m").alias("l"))
        jump = labels.select(F.col("v").alias("_tm_v"), F.col("l").alias("far"))
        far = F.least("l", "far")
        step = saved(low.join(jump, F.col("l.v") == F.col("_tm_v")).select("v", far.alias("l"), (far != F.col("old")).alias("moved")), "labels")
        forget(labels)
        labels = step
        if step.where("moved").isEmpty():
            forget(both)
            return step.select(F.col("v").alias("node"), F.col("l.v").alias("root"), F.col("l.name").alias("name"))
