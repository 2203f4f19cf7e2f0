"""Exact dedup by a log-structured merge index of digests.

Rows are normalised and digested by SQL functions. Each task fills a memtable with
(digest, best row, count), keeping one entry a digest; a full memtable is flushed as sorted runs,
one a shard, each with a Bloom filter. Compaction merges the runs of a shard in tiers of FAN, so that its
work doesn't grow with the square of the runs, which are as many as the tasks: runs below SMALL entries are merged outright; in
a tier, a run's digests that no other run's filter holds pass through, the others are merged by a sort that keeps the best row.
Rows that the index reports as copies are compared byte by byte with the row that stays.

Defined results: null text is empty text, and empty texts form one group. Ties in length go to the
smallest doc_id; repeated rows (same id, same text) count as two members with the same keep_id and
both are kept. A null doc_id is only kept if no other member has an id. Clashing extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, small

SPACE = r"[\x20\x09-\x0D]+"
MEMTABLE = 200_000
FAN = 8  # runs that a tier compares
SMALL = 256  # entries below which filters don't pay
RUN = "shard int, n long, digests binary, lens binary, ids binary, counts binary, bloom binary"
ENTRY = "digest binary, keep_id long, group_size long"
_PROBES = 5


def normalized(text):
    """Text without ASCII white space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def _bits(digests: np.ndarray, size: int) -> np.ndarray:
    """Filter positions of each digest: _PROBES numbers cut out of the digest itself."""
    parts = np.ascontiguousarray(digests).view(np.uint32)[:, :_PROBES]
    return parts % np.uint32(size)


def _bloom(digests: np.ndarray) -> bytes:
    size = max(64, 10 * len(digests))
    bits = np.zeros(size, bool)
    bits[_bits(digests, size).ravel()] = True
    return size.to_bytes(8, "little") + np.packbits(bits).tobytes()


def _holds(bloom: bytes, digests: np.ndarray) -> np.ndarray:
    size = int.from_bytes(bloom[:8], "little")
    bits = np.unpackbits(np.frombuffer(bloom, np.uint8, offset=8))
    return bits[_bits(digests, size)].all(axis=1)


def _merge(digests, lens, ids, counts):
    """One entry a digest, sorted: longest original first, then the smallest id; counts add up."""
    order = np.lexsort((ids, -lens, *digests.T[::-1]))
    digests, lens, ids, counts = digests[order], lens[order], ids[order], counts[order]
    first = np.ones(len(digests), bool)
    first[1:] = (digests[1:] != digests[:-1]).any(axis=1)
    at = np.flatnonzero(first)
    return digests[at], lens[at], ids[at], np.add.reduceat(counts, at) if len(at) else counts


def _flush(shards: int):
    """Memtables of one task, flushed as sorted runs."""

    def out(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        merged = _merge(*(np.concatenate(x) for x in zip(*held, strict=True)))
        shard = merged[0][:, 3] % np.uint64(shards)
        for s in np.unique(shard):
            digests, lens, ids, counts = (x[shard == s] for x in merged)
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([int(s)], pa.int32()), "n": [len(ids)], "digests": [digests.tobytes()], "lens": [lens.tobytes()],
                "ids": [ids.tobytes()], "counts": [counts.tobytes()], "bloom": [_bloom(digests)],
            })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            digests = np.frombuffer(b"".join(b.column(0).to_pylist()), ">u8").reshape(-1, 4).astype(np.uint64)
            held.append((digests, b.column(1).to_numpy(), b.column(2).to_numpy(), np.ones(b.num_rows, np.int64)))
            rows += b.num_rows
            if rows >= MEMTABLE:
                yield from out(held)
                held, rows = [], 0
        if rows:
            yield from out(held)

    return run


def _gather(runs: list[tuple]) -> Iterator[tuple]:
    """(entries, filter) of runs with at least SMALL entries; smaller neighbours are merged first."""
    held, n = [], 0
    for k, (entries, bloom) in enumerate(runs):
        held.append((entries, bloom))
        n += len(entries[1])
        if n >= SMALL or k == len(runs) - 1:
            if len(held) > 1:
                entries = _merge(*(np.concatenate(x) for x in zip(*(e for e, _ in held), strict=True)))
                bloom = _bloom(entries[0])
            yield entries, bloom
            held, n = [], 0


def _tier(runs: list[tuple]) -> tuple:
    """One run out of several."""
    if len(runs) == 1:
        return runs[0]
    alone, meet = [], []
    for k, (entries, _) in enumerate(runs):
        seen = np.zeros(len(entries[1]), bool)
        for j, (_, bloom) in enumerate(runs):
            if j != k:
                rest = np.flatnonzero(~seen)
                seen[rest] = _holds(bloom, entries[0][rest])
        alone.append(tuple(x[~seen] for x in entries))
        meet.append(tuple(x[seen] for x in entries))
    parts = [*alone, _merge(*(np.concatenate(x) for x in zip(*meet, strict=True)))]
    entries = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort(entries[0].T[::-1])
    entries = tuple(x[order] for x in entries)
    return entries, _bloom(entries[0])


def _compact(pdf: pd.DataFrame) -> pd.DataFrame:
    """Merge the runs of one shard."""
    runs = [((np.frombuffer(r.digests, np.uint64).reshape(-1, 4), *(np.frombuffer(x, np.int64) for x in (r.lens, r.ids, r.counts))), r.bloom) for r in pdf.itertuples()]
    runs = list(_gather(runs))
    while len(runs) > 1:
        runs = [_tier(runs[k : k + FAN]) for k in range(0, len(runs), FAN)]
    digests, _, ids, counts = runs[0][0]
    raw = digests.astype(">u8").tobytes()
    return pd.DataFrame({"digest": [raw[i : i + 32] for i in range(0, len(raw), 32)], "keep_id": ids, "group_size": counts})


#: Stands for a null id inside the index, after every id.
_NO_ID = 2**63 - 1


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """(digest, keep_id, group_size): the compacted index of all rows.

    ``shards`` follows the rows, so that a shard holds about MEMTABLE entries.
    """
    if shards is None:
        shards = max(1, -(-docs.count() // MEMTABLE) * 4)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.unhex(F.sha2(normalized(F.col(text_col)), 256)), F.char_length(text).cast("long"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)))
    runs = materialize(rows.mapInArrow(_flush(shards), RUN), "runs")
    return runs.groupBy("shard").applyInPandas(_compact, ENTRY).withColumn("keep_id", F.nullif("keep_id", F.lit(_NO_ID)))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Only groups of two and more are looked up by a join; its index side has one row a digest, so a
    hot digest is split by the skew join. Their texts are then compared with the text that stays;
    texts that share a digest but differ are grouped again by the text itself.
    """
    found = index(docs, id_col, text_col)
    groups = small(materialize(found.filter("group_size > 1").withColumnRenamed("digest", "g"), "groups"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(normalized(F.col("text")), 256)))
    rows = rows.join(groups, F.col("digest") == F.col("g"), "left")
    single = F.col("g").isNull()
    rows = rows.select(
        "doc_id", "digest",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(~single, normalized(F.col("text"))).alias("norm"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("len"),
    )
    rows = materialize(rows, "members")
    hits = rows.filter("group_size > 1")
    stay = hits.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("digest").alias("d"), F.col("norm").alias("kept_norm")).dropDuplicates(["d"])
    stay = materialize(stay, "stay")  # so that the join below shuffles both sides and its hot digests can be split
    checked = hits.join(stay, F.col("digest") == F.col("d")).withColumn("same", F.col("norm") == F.col("kept_norm"))
    same = checked.filter("same").drop("d", "kept_norm", "same")
    unlike = materialize(checked.filter("not same").drop("d", "kept_norm", "same"), "unlike")
    parts = rows.filter("group_size = 1").unionByName(same)
    if not unlike.isEmpty():
        best = unlike.groupBy("digest", "norm").agg(F.min_by("doc_id", F.struct(-F.col("len"), F.col("doc_id"))).alias("k"), F.count("*").alias("n"))
        again = unlike.join(best, ["digest", "norm"]).withColumn("keep_id", F.col("k")).withColumn("group_size", F.col("n")).select(rows.columns)
        sizes = same.groupBy("digest").agg(F.count("*").alias("n"))
        same = same.join(sizes, "digest").withColumn("group_size", F.col("n")).select(rows.columns)
        parts = rows.filter("group_size = 1").unionByName(same).unionByName(again)
    return parts.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY len DESC, doc_id)
"""
