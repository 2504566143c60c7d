"""What the operators of this subpackage share: columns, scratch tables, array helpers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession


#: Arrow batches hold whole texts and packed records, so their bytes are bounded besides their rows.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds the bytes of Arrow batches for the session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The named columns of the documents table."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


class Scratch:
    """Tables written to the folder that ``spark.checkpoint.dir`` names.

    All executors share that folder, so a table there survives the loss of any of them and cuts the
    lineage. Only where the setting is absent and Spark runs in one process (tests, notebooks) is a temporary
    folder made and set; a cluster needs the setting.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        bound_batches(spark)
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="roadloom-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.base = f"{base.rstrip('/')}/roadloom-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """A name like this one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8_batch(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string array as (all bytes, offsets); nulls are empty texts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits; every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def byte_table(seed: int) -> np.ndarray:
    """256 pseudo-random odd 64-bit values made from the seed."""
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def lean(run):
    """A function over Arrow batches that gives freed memory back at the end of its task.

    Workers live on from task to task and from job to job; what their allocators keep would add up.
    """

    def leaning(batches):
        yield from run(batches)
        gc.collect()
        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return leaning


def shuffle_parts(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Rows of a few numbers that may be broadcast: some tens of MB.
BROADCAST_ROWS = 500_000


def small_side(df: DataFrame) -> DataFrame:
    """A written table for the small side of a join: broadcast if its counted rows are few, else left to shuffle."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def row_groups(batches, keys: int):
    """The rows of sorted batches, group by group of equal values in the first ``keys`` columns, as Arrow tables.

    Only one group at a time is held together.
    """
    import pyarrow as pa

    held, held_key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for column in columns:
            new[1:] |= column[1:] != column[:-1]
        starts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for start, end in zip(starts, starts[1:]):
            key = tuple(c[start] for c in columns)
            if held and key != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            held_key = key
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, root: every node of edges (a, b) with the least node that it is connected with.

    Alternates between tying larger neighbours and tying smaller neighbours to a node's least neighbour, which
    halves distances; each round is a written table, and the last one stays as ``name``. Minima combine before they shuffle, and they meet the pairs
    by node and salt, so the pairs of a node that very many edges touch are in several tasks.
    """
    from pyspark.sql import functions as F

    salts = 8

    def tie(pairs: DataFrame) -> DataFrame:
        """(v, least of u and its neighbours v) for every pair (u, v)."""
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
        least = least.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = pairs.withColumn("_t", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int"))
        return salted.join(least, (F.col("u") == F.col("_u")) & (F.col("_t") == F.col("_s"))).select("u", "v", "m")

    current, before, turn = edges.select("a", "b").filter("a <> b"), None, 0
    while True:
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).union(current.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = tie(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        tied = tie(large)
        small = tied.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(tied.select(F.col("u").alias("a"), F.col("m").alias("b")))
        written = scratch.write(small.distinct(), f"{name}-{turn}")
        state = written.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before is not None:
            scratch.drop(f"{name}-{turn - 1}")
        if state == before:
            written = scratch.write(written, name)
            scratch.drop(f"{name}-{turn}")
            return written.select(F.col("a").alias("node"), F.col("b").alias("root")).union(written.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        current, before, turn = written, state, turn + 1
