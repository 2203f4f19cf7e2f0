"""Near-duplicate detection with HyperMinHash sketches.

A document's set holds the 64-bit hashes of its distinct shingles. Its sketch deals them to buckets;
a bucket's register keeps, of the smallest hash, the count of leading zeros and the mantissa bits
that follow. Documents with equal sets form a class, of which one represents the others. Runs of
registers are bands; representatives that share a band are linked as candidates, as a chain from
the smallest of the band and not as pairs, and the connected candidates form a block. In a block a pair is
estimated from the registers, corrected for registers that agree by chance, then verified on the
full sets; a pair already connected by verified links isn't verified again, so that a block of n
documents gives at most n - 1 links. Blocks larger than a bound are cut into chunks and every pair
of chunks is a task of its own. Components of the links are found by contraction in rounds.

With 64 bands of 8 registers a pair at similarity 0.85 is missed with probability below 2e-9, one at 0.8 below 1e-5.

Defined results: null, empty and white-space texts have no shingles, are linked with nothing and
kept. Repeated rows are one class, and each of them has the same component. Rows that share an id and not the
text are documents of their own, each linked by its own text; a component is named by its smallest id. Rows with a null doc_id
get a null component and are kept. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_view, components, materialize, mix64, read, slices, small, unique_keys

SHINGLE = 5
BANDS, ROWS = 64, 8
REGISTERS = BANDS * ROWS
MANTISSA = 10  # bits of a register beside 6 bits of leading zeros
CHUNK = 3000  # documents of a block that one task holds at most twice
PACK = 64  # small blocks go together into about so many groups a million documents
_LIMIT = 1 << 20  # bytes of text hashed at once; a worker holds some eighty times as many
_EMPTY = np.uint16(0xFFFF)
_SALTS = mix64(np.arange(1, 300, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0x2545F4914F6CDD1D)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    inverse = pow(int(_BASE), -1, 1 << 64)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, np.uint64(inverse), np.uint64)
    up[:1] = down[:1] = 1
    return np.cumprod(up), np.cumprod(down)


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between ASCII white space, and the first word of each row with one more at the end."""
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    space = np.ones(len(raw) + 1, bool)
    space[:-1] = (raw == 32) | ((raw >= 9) & (raw <= 13))
    inner = ~space
    begin = inner.copy()
    begin[1:] &= space[:-1]
    begin[off[:-1][off[:-1] < len(raw)]] = inner[off[:-1][off[:-1] < len(raw)]]
    starts = np.flatnonzero(begin)
    stop = inner[:-1] & (space[1:] | begin[1:])
    ends = np.flatnonzero(stop) + 1
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_SALTS[low] * up[: len(raw)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h = mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return h, np.searchsorted(starts, off)


def shingle_sets(raw: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    h, first = word_hashes(raw, off)
    roll = np.zeros(max(len(h) - size + 1, 0), np.uint64)
    for k in range(size):
        roll += mix64(h[k : k + len(roll)] + _SALTS[280 + k])
    roll = mix64(roll)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            yield np.unique(roll[a : b - size + 1])
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for k in range(a, b):
                whole = mix64(whole * np.uint64(3) + h[k : k + 1])
            yield whole
        else:
            yield np.zeros(0, np.uint64)


def ranks(registers: int = REGISTERS) -> np.ndarray:
    """For each bucket, in which order it looks to other buckets when it is empty."""
    return (mix64(np.arange(registers * registers, dtype=np.uint64) + np.uint64(12345)) >> np.uint64(32)).astype(np.uint32).reshape(registers, registers)


def sketch(hashes: np.ndarray, order: np.ndarray, registers: int = REGISTERS, mantissa: int = MANTISSA) -> np.ndarray:
    """One register a bucket: leading zeros, then mantissa bits, of the smallest hash in it.

    An empty bucket takes the register of the full bucket that ranks first for it, so that small sets too agree
    in each register with a probability near their similarity.
    """
    out = np.full(registers, _EMPTY, np.uint16)
    if not len(hashes):
        return out
    h = mix64(hashes ^ np.uint64(0xD6E8FEB86659FD93))
    where = (h % np.uint64(registers)).astype(np.int64)
    low = np.full(registers, np.uint64(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(low, where, (h // np.uint64(registers)) << np.uint64(registers.bit_length() - 1))
    full = np.bincount(where, minlength=registers) > 0
    v = low[full]
    zeros = np.minimum(63 - np.floor(np.log2(np.maximum(v, 1).astype(np.float64))), 62).astype(np.uint64)
    rest = (v << (zeros + np.uint64(1))) >> np.uint64(64 - mantissa)
    out[full] = ((zeros << np.uint64(mantissa)) | rest).astype(np.uint16)
    at, bare = np.flatnonzero(full), np.flatnonzero(~full)
    if len(bare):
        out[bare] = out[at[order[np.ix_(bare, at)].argmin(axis=1)]]
    return out


def estimates(one: np.ndarray, many: np.ndarray, mantissa: int = MANTISSA) -> np.ndarray:
    """Jaccard estimates of one sketch with many, without the registers that agree by chance."""
    equal = (one == many).mean(axis=1)
    chance = 2.0**-mantissa / 3  # two unlike minima share zeros (1/3) and mantissa
    return np.clip((equal - chance) / (1 - chance), 0, 1)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    order = ranks()
    for b in batches:
        raw, off = byte_view(b.column(1))
        n, low, high, bands = [], [], [], []
        for lo, hi in slices(off, _LIMIT):
            part = off[lo : hi + 1]
            for s in shingle_sets(raw[part[0] : part[-1]], part - part[0]):
                n.append(len(s))
                spread = mix64(s)
                low.append(int(np.add.reduce(s, dtype=np.uint64).view(np.int64)))
                high.append(int(np.add.reduce(mix64(spread ^ _SALTS[270]), dtype=np.uint64).view(np.int64)))
                if len(s):
                    keys = sketch(s, order).reshape(BANDS, ROWS).view(np.uint64)
                    bands.append(mix64(mix64(keys[:, 0] + _SALTS[:BANDS]) + keys[:, 1]).view(np.int64))
                else:
                    bands.append([])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n", "c1", "c2", "bands"])


def _load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets and sketches of the candidates."""
    order = ranks()
    for b in batches:
        raw, off = byte_view(b.column(1))
        sets, sketches = [], []
        for lo, hi in slices(off, _LIMIT):
            part = off[lo : hi + 1]
            for s in shingle_sets(raw[part[0] : part[-1]], part - part[0]):
                sets.append(s.tobytes())
                sketches.append(sketch(s, order).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.large_binary()).cast(pa.binary()), pa.array(sketches, pa.binary()), *(b.column(k) for k in range(2, b.num_columns))], names=["doc_id", "grams", "sketch", *b.schema.names[2:]])


def _verify(percent: int):
    """Spanning links of the verified pairs in one group of blocks (or of chunk pairs of a block)."""

    def links(ids, grams, sketches, half) -> list[tuple[int, int]]:
        n = len(ids)
        root = np.arange(n)
        out = []
        size = np.array([len(g) for g in grams])
        for i in range(n - 1):
            rest = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
            # sizes alone bound the similarity: smaller set / larger set
            a, b = np.minimum(size[rest], size[i]), np.maximum(size[rest], size[i])
            rest = rest[100 * a >= percent * b]
            if half is not None:
                rest = rest[half[rest] != half[i]]
            if not len(rest):
                continue
            # few shingles give few independent registers
            p, m = percent / 100, np.minimum(sketches.shape[1], np.minimum(size[rest], size[i]))
            rest = rest[estimates(sketches[i], sketches[rest]) >= p - 8 * np.sqrt(p * (1 - p) / m)]
            for j in rest:
                if root[j] == root[i]:
                    continue
                both = len(np.intersect1d(grams[i], grams[j], assume_unique=True))
                if 100 * both >= percent * (size[i] + size[j] - both):
                    out.append((ids[i], ids[j]))
                    root[root == root[j]] = root[i]
        return out

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        pdf = pdf.sort_values("doc_id", kind="stable")
        for _, part in pdf.groupby(["block", "x", "y"], sort=False):
            x, y = part["x"].iloc[0], part["y"].iloc[0]
            half = part["chunk"].to_numpy() if x != y else None
            grams = [np.frombuffer(g, np.uint64) for g in part["grams"]]
            sketches = np.frombuffer(b"".join(part["sketch"]), np.uint16).reshape(len(part), -1)
            found += links(part["doc_id"].to_numpy(), grams, sketches, half)
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return run


def near_dedup(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: links at 100 * intersection >= percent * union."""
    keyed = unique_keys(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null"), "doc_id", "near")
    src = keyed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text"))
    none = docs.filter(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = materialize(src.union(none).mapInArrow(_sketches, "doc_id long, n long, c1 long, c2 long, bands array<long>"), "sketches")
    ids = sets.filter("n > 0 and doc_id is not null")
    # classes of two and more are few beside the documents, and a table of their own: a hot class is split by the join
    classes = materialize(ids.groupBy("n", "c1", "c2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m")).filter("m > 1").select(F.col("n").alias("n_"), F.col("c1").alias("c1_"), F.col("c2").alias("c2_"), "rep"), "classes")
    classes = small(classes)
    same = (F.col("n") == F.col("n_")) & (F.col("c1") == F.col("c1_")) & (F.col("c2") == F.col("c2_"))
    reps = ids.join(classes, same, "left").filter("rep is null or rep = doc_id")
    rows = reps.select("doc_id", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("band", "low")
    chain = materialize(rows.join(shared, "band").filter("doc_id > low").select("doc_id", "low").distinct(), "chain")
    blocks = materialize(components(chain, "doc_id", "low").select(F.col("node").alias("id"), F.col("component").alias("block")), "blocks")
    blocks = blocks.union(blocks.select(F.col("block").alias("id"), "block").distinct())

    sizes = blocks.groupBy("block").agg(F.count("*").alias("size"))
    sizes = small(materialize(sizes, "sizes"))
    blocks = blocks.join(sizes, "block").withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int"))
    blocks = blocks.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    pairs = blocks.withColumn("o", other).withColumn("x", F.least("chunk", "o")).withColumn("y", F.greatest("chunk", "o"))
    packs = F.pmod(F.xxhash64("block"), F.lit(max(24, PACK * blocks.count() // 1_000_000)))
    pairs = pairs.withColumn("task", F.when(F.col("chunks") > 1, F.concat_ws(":", "block", "x", "y")).otherwise(packs.cast("string")))
    pairs = materialize(pairs.select("id", "block", "chunk", "x", "y", "task"), "tasks")
    texts = src.join(small(pairs.select("id").distinct()), F.col("doc_id") == F.col("id"), "left_semi")
    loaded = materialize(texts.mapInArrow(_load, "doc_id long, grams binary, sketch binary"), "sets")
    work = loaded.join(pairs, F.col("doc_id") == F.col("id")).drop("id")
    links = materialize(work.groupBy("task").applyInPandas(_verify(percent), "u long, v long"), "links")
    joined = components(links, "u", "v")

    named = sets.select("doc_id", "n", "c1", "c2").join(classes, same & (F.col("n") > 0) & F.col("doc_id").isNotNull(), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("rep"))
    named = named.join(small(joined), F.col("rep") == F.col("node"), "left")
    named = named.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    return _real_ids(named, keyed).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _real_ids(named: DataFrame, keyed: DataFrame) -> DataFrame:
    """``named`` with ids in place of the keys that rows with a shared id have."""
    odd = materialize(keyed.filter("key <> row.doc_id").select("key", F.col("row.doc_id").alias("real")), "shared")
    if odd.isEmpty():
        return named
    named = materialize(named.join(small(odd), F.col("doc_id") == F.col("key"), "left").select(F.coalesce("real", "doc_id").alias("doc_id"), "n_shingles", "component_id"), "named")
    least = materialize(named.filter("doc_id is not null").groupBy(F.col("component_id").alias("c")).agg(F.min("doc_id").alias("least")).filter("c <> least"), "least")
    return named.join(small(least), F.col("component_id") == F.col("c"), "left").select("doc_id", "n_shingles", F.coalesce("least", "component_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "documents"))

#: The same for distinct ids, by the shingles themselves.
SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
p AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i, len(w) AS m FROM w),
q AS (SELECT doc_id, i, m, concat_ws(' ', w, {", ".join(f"lead(w, {k}) OVER x" for k in range(1, SHINGLE))}) AS g FROM p WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT DISTINCT doc_id, g FROM q WHERE i <= greatest(m - {SHINGLE}, 0)),
g AS MATERIALIZED (SELECT doc_id, g, count(*) OVER (PARTITION BY doc_id) AS n FROM h),
s AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n + b.n) AS n, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2),
link AS (SELECT a, b FROM pairs WHERE 100 * k >= 85 * (n - k)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, doc_id <= coalesce(b, doc_id) AS kept
FROM w LEFT JOIN s USING (doc_id) LEFT JOIN low ON doc_id = a
"""
