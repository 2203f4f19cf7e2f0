"""Benchmark decontamination with SQL functions.

The windows of the benchmark texts (runs of ``size`` words; a shorter text is one window) are a broadcast hash
set; each position of a document is probed for its run, and only hits leave the scan. Up to ``max_windows``, the set is exact and travels with
the plan, and a position is asked for its word among the first words of windows before its run is hashed.
Beyond, it is a bitmap of PER_WINDOW bits and more a window, which lets one position in PER_WINDOW through at most, up to
MAX_BITS. Either way hits are verified by joining the run's words with the windows' words, which is
exact: the set's size changes what is shuffled and no result. Results are the words covered by verified runs and the items.

Defined results: null text has no words, and an item without words has no window. Repeated rows get
equal results. An empty benchmark leaves every document clean. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, ascii_lower, materialize, read, small, words

SIZE = 10
MAX_WINDOWS = 50_000
PER_WINDOW = 32  # bits of the bitmap
MAX_BITS = 1 << 30  # 128 MB
NONE_SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # of an empty string


def windows(items: DataFrame, size: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, len, head, hash, run) of every window; run is its words joined by a blank."""
    w = items.select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("w")).filter("size(w) > 0")
    w = w.withColumn("len", F.least(F.size("w"), F.lit(size)))
    w = w.select("item_id", "len", F.explode(F.expr("transform(sequence(1, size(w) - len + 1), i -> slice(w, i, len))")).alias("run"))
    return w.select("item_id", "len", F.col("run")[0].alias("head"), F.xxhash64("run").alias("hash"), F.array_join("run", " ").alias("run")).distinct()


def _hits(lens: list[int], heads: dict[int, list[str]] | None, hashes: dict[int, list[int]] | None) -> Column:
    """Array of (pos, len, run) where a run is in the set: the literal one, or the column ``bits`` if there is none."""
    parts = []
    for n in lens:
        run = f"xxhash64(slice(w, i, {n}))"
        if hashes is not None:
            quoted = ", ".join("'" + h + "'" for h in heads[n])
            probe = f"get(w, i - 1) in ({quoted}) and {run} in ({', '.join(f'{x}L' if x > -(2**63) else 'bigint(-9223372036854775808)' for x in hashes[n])})"
        else:
            probe = f"exists(array(pmod({run}, 64L * size(bits))), h -> getbit(get(bits, cast(h div 64 as int)), cast(h % 64 as int)) = 1)"
        at = f"filter(sequence(1, size(w) - {n} + 1), i -> {probe})"
        parts.append(f"if(size(w) < {n}, array(), transform({at}, i -> named_struct('pos', i, 'len', {n}, 'run', array_join(slice(w, i, {n}), ' '))))")
    return F.expr(f"concat({', '.join(parts)})")


def _bitmap(wins: DataFrame, n: int) -> DataFrame:
    """One row: ``bits``, 64 in a number, of the windows' hashes."""
    size = 1 << min(MAX_BITS.bit_length() - 1, max(16, (PER_WINDOW * n - 1).bit_length()))  # at most MAX_BITS
    at = F.pmod("hash", F.lit(size))
    words_ = wins.select(F.floor(at / 64).cast("int").alias("k"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("b")).groupBy("k").agg(F.bit_or("b").alias("b"))
    filled = wins.sparkSession.range(size // 64).select(F.col("id").cast("int").alias("k")).join(words_, "k", "left").select("k", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
    return filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "b"))), lambda x: x["b"]).alias("bits"))


def scan(docs: DataFrame, items: DataFrame, size: int = SIZE, max_windows: int = MAX_WINDOWS, keep: tuple[str, ...] = ("doc_id",), item_col: str = "item_id") -> DataFrame:
    """``keep`` columns, n_words, hit_at (sorted word positions from 0), item_ids (sorted strings)."""
    wins = materialize(windows(items, size, item_col), "windows")
    rows = docs.select(*keep, words(F.col("text")).alias("w")).withColumn("n_words", F.size("w").cast("long"))
    lens = sorted(r[0] for r in wins.select("len").distinct().collect())  # 1 to size, at most
    if not lens:
        return rows.select(*keep, "n_words", F.expr("array_repeat(0, 0)").alias("hit_at"), F.expr("array_repeat('', 0)").alias("item_ids"))
    n = wins.count()
    if n <= max_windows:
        found = wins.select("len", "head", "hash").collect()
        heads = {n: sorted({r["head"] for r in found if r["len"] == n}) for n in lens}
        hashes = {n: sorted({r["hash"] for r in found if r["len"] == n}) for n in lens}
        rows = rows.withColumn("hits", _hits(lens, heads, hashes))
    else:
        rows = rows.crossJoin(F.broadcast(materialize(_bitmap(wins, n), "bitmap"))).withColumn("hits", _hits(lens, None, None))  # one row of MAX_BITS at most
    # only the words of the hits stay, for the join to come
    rows = materialize(rows.select(*keep, "n_words", "hits", F.monotonically_increasing_id().alias("_row")), "scan")
    hits = rows.select("_row", F.explode("hits").alias("h")).select("_row", "h.*")
    hits = hits.join(small(wins.select("len", "run", "item_id")), ["len", "run"])
    per = hits.groupBy("_row").agg(F.collect_set(F.struct("pos", "len")).alias("p"), F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    covered = F.array_sort(F.array_distinct(F.flatten(F.expr("transform(p, x -> sequence(x.pos - 1, x.pos + x.len - 2))"))))
    per = per.select(F.col("_row").alias("r"), covered.alias("hit_at"), "item_ids")
    out = rows.select(*keep, "n_words", "_row").join(per, F.col("_row") == F.col("r"), "left")
    return out.select(*keep, "n_words", F.coalesce("hit_at", F.expr("array_repeat(0, 0)")).alias("hit_at"), F.coalesce("item_ids", F.expr("array_repeat('', 0)")).alias("item_ids"))


def decontaminate(docs: DataFrame, items: DataFrame, mode: str = "document", size: int = SIZE, min_share: float = 0.0, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` without contaminated documents (more than ``min_share`` of words hit), or, with mode
    ``span``, with the hit words taken out of their texts."""
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"), F.col("doc_id").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_th"))
    found = scan(keyed.select(F.col("_all.text").alias("text"), "_id", "_th"), items, size, max_windows, ("_id", "_th"))
    bad = found.filter((F.size("hit_at") > 0) & (F.size("hit_at") > F.lit(min_share) * F.col("n_words")))
    bad = materialize(bad.select(F.col("_id").alias("i"), F.col("_th").alias("t"), "hit_at").dropDuplicates(["i", "t"]), "leaks")
    same = F.col("_id").eqNullSafe(F.col("i")) & (F.col("_th") == F.col("t"))
    if mode == "document":
        return keyed.join(small(bad.select("i", "t")), same, "left_anti").select("_all.*")
    text = F.col("_all.text")
    gaps = F.split(ascii_lower(text), WORD, -1)  # what stands around the words; lengths are as in the text
    pieces = F.regexp_extract_all(text, F.lit(WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")), F.lit(0))
    kept = F.transform(pieces, lambda x, i: F.when(F.array_contains("hit_at", i), F.lit("")).otherwise(x))
    joined = F.array_join(F.flatten(F.transform(gaps, lambda g, i: F.array(g, F.coalesce(F.get(kept, i), F.lit(""))))), "")
    clean = F.when(F.col("hit_at").isNotNull(), joined).otherwise(text)
    return keyed.join(bad, same, "left").select(F.col("_all").withField("text", clean).alias("_all")).select("_all.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = F.size("hit_at").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


SQL = r"""
WITH it AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS run
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM it WHERE len(w) > 0)),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n),
hit AS (
  SELECT p.doc_id, p.i, p.n, win.item_id
  FROM (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS run FROM pos) p JOIN win ON p.n = win.n AND p.run = win.run),
cover AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN found USING (doc_id)
"""
