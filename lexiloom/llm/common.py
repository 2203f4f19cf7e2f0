"""Shared helpers: scratch tables, word arrays, byte views of Arrow columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: lower-cased ASCII letters, digits, anything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words between ASCII white space.
TOKEN = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Spark's setting that removes a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Small lookup tables are broadcast up to this many rows and bytes, else joined by a shuffle.
BROADCAST_ROWS = 400_000
BROADCAST_BYTES = 64 << 20
#: Elements that one step of a running total copies at most.
_STEP = 256


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster. Where none is set a session of one machine gets a folder of its own; a cluster gets an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage.

    A lost executor then rereads files instead of recomputing the stages above. The shuffle files of ``df`` go with the write; else
    those of all steps would stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows and their bytes, counted, are few, else unchanged."""
    width = F.lit(0)
    for c in df.columns:
        width = width + F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16
    n, held = df.limit(rows + 1).agg(F.count("*"), F.sum(width)).first()
    return F.broadcast(df) if n <= rows and (held or 0) <= size else df


def let(x: Column, f) -> Column:
    """``f`` of a value that is computed once. Inside a lambda Spark computes an outer expression anew for each element."""
    return F.transform(F.array(x), f)[0]


def running(x: Column, op: str = "sum") -> Column:
    """Of an int array, the sum (or the largest, from 0) of what stands before each element, with that of all at the end.

    In steps of _STEP elements, so that a long array isn't copied for each of its elements.
    """
    both = (lambda a, b: a + b) if op == "sum" else (lambda a, b: F.greatest(a, b))
    scan = lambda c: F.aggregate(c, F.array(F.lit(0)), lambda a, v: F.concat(a, F.array(both(F.element_at(a, -1), v))))
    cut = lambda y: F.transform(F.sequence(F.lit(0), F.floor(F.size(y) / _STEP).cast("int")), lambda k: scan(F.slice(y, k * _STEP + 1, _STEP)))

    def shift(inner: Column) -> Column:
        # the last total of a chunk is the first of the next one
        zipped = F.arrays_zip(inner.alias("i"), F.slice(scan(F.transform(inner, lambda c: F.element_at(c, -1))), F.lit(1), F.size(inner)).alias("o"))
        return F.flatten(F.transform(zipped, lambda z: F.transform(F.slice(z["i"], F.lit(1), F.least(F.size(z["i"]), F.lit(_STEP))), lambda v: both(z["o"], v))))

    return let(x, lambda y: let(cut(y), shift))


def unique_keys(docs: DataFrame, id_col: str, label: str) -> DataFrame:
    """(key, row): ``row`` has all columns of ``docs``; ``key`` tells the rows apart.

    A row's key is its id; rows whose id is null or shared get keys of their own after all ids. Only those are written.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    odd = materialize(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1 or key is null").select(F.col("key").alias("k")), f"{label}-odd")
    if odd.isEmpty():
        return rows
    odd, same = small(odd), F.col("key").eqNullSafe(F.col("k"))
    top = rows.agg(F.coalesce(F.max("key"), F.lit(0))).first()[0]
    apart = materialize(rows.join(odd, same, "left_semi").withColumn("key", F.monotonically_increasing_id() + F.lit(top + 1)), f"{label}-keys")
    return rows.join(odd, same, "left_anti").unionByName(apart)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, _UPPER, _LOWER)


def words(c: Column, pattern: str = WORD) -> Column:
    """Array of lower-cased words; null gives an empty array."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(c, F.lit(""))), F.lit(pattern), F.lit(0))


def bucket(c: Column, mod: int) -> Column:
    """crc32 of the value as text, modulo ``mod``: the folds of the contracts."""
    return F.crc32(c.cast("string").cast("binary")) % mod


def byte_view(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or of one row that is longer."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a uint64 over all others."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of an undirected graph, component being its smallest node.

    Alternates two contractions, each one group-by with pre-aggregation: neighbours that are
    larger are linked to the smallest neighbour, then smaller ones. A node's rows never have to
    be held together: the smallest neighbours are written before they are joined, so that a join's hot node
    can be split. Each round is written to the shared folder; it ends when a round changes nothing.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    state = None
    while True:
        e = materialize(e, "cc")
        seen = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or seen == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = seen
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = small(materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-low"))
        big = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = materialize(big.union(low.filter("m < u").select("u", "m")).filter("u <> v").distinct(), "cc-star")
        low = small(materialize(star.groupBy("u").agg(F.min("v").alias("m")), "cc-low"))
        near = star.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = low.union(near).select(F.greatest("u", "m").alias("u"), F.least("u", "m").alias("v")).filter("u <> v").distinct()
