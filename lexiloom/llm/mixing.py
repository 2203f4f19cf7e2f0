"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern, the sorted set of sources that hold them. Tokens
flow from patterns to their sources' quotas; the first pass over a pattern's tokens costs nothing, every
further pass costs more than the one before. The flow lives on the driver: its size is the number of
patterns and sources, bounded by ``max_patterns``. Documents are then selected in the order of
a seeded hash: a pattern whose flow is p whole passes and a rest repeats every document p times, and
the documents that come first by hash, up to the rest, once more. The running sum that this
takes is in two steps, over hash buckets and within one, so that no pattern is sorted in one task.

Defined results: null and blank texts have size 0 and are never taken. Null sources are one source.
Repeated rows are taken one by one. Nothing to share gives targets of 0. Extra columns are ignored.
"""

from __future__ import annotations

from collections import deque
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import TOKEN, materialize, read

WEIGHTS = (5, 2, 1)
SHARE = Fraction(3, 2)
REPEATS = 2
SEED = "mix"
MAX_PATTERNS = 100_000


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN)).cast("long")


def targets(sizes: list[int], weights: list[int], total: float, cap: int) -> list[float]:
    """Shares of ``total`` by weight; none is above cap times its size, the excess is reshared."""
    caps = [cap * s for s in sizes]
    order = sorted(range(len(sizes)), key=lambda k: (Fraction(caps[k], weights[k]), k))
    rest_w, full, level = sum(weights), 0, 0.0
    for k in order:
        level = (total - full) / rest_w
        if level * weights[k] < caps[k]:
            break
        full, rest_w = full + caps[k], rest_w - weights[k]
        level = float("inf")
    return [min(float(c), level * w) if c else 0.0 for c, w in zip(caps, weights, strict=True)]


def min_cost_flow(capacity: list[int], members: list[list[int]], quotas: list[int], repeats: int) -> list[list[int]]:
    """Tokens that each pattern sends to each of its sources: as much as fits the quotas, with the least repetition.

    A pass over the tokens of a pattern costs its number. So passes are opened one after another: augmenting
    with the passes opened so far by shortest paths never uses a later pass where an earlier one is left, and rerouting
    along a path keeps what other patterns sent.
    """
    flow = [[0] * len(m) for m in members]
    sent = [0] * len(members)
    left = list(quotas)
    holders: list[list[tuple[int, int]]] = [[] for _ in quotas]
    for p, m in enumerate(members):
        for e, s in enumerate(m):
            holders[s].append((p, e))
    for turn in range(1, repeats + 1):
        room = [turn * c - f for c, f in zip(capacity, sent, strict=True)]
        while True:
            # breadth first from patterns with room to a source that lacks tokens
            queue = deque(p for p, r in enumerate(room) if r > 0)
            from_p: dict[int, tuple[int, int] | None] = dict.fromkeys(queue)
            from_s: dict[int, tuple[int, int]] = {}
            end = None
            while queue and end is None:
                p = queue.popleft()
                for e, s in enumerate(members[p]):
                    if s in from_s:
                        continue
                    from_s[s] = (p, e)
                    if left[s] > 0:
                        end = s
                        break
                    for q, f in holders[s]:
                        if q not in from_p and flow[q][f] > 0:
                            from_p[q] = (s, f)
                            queue.append(q)
            if end is None:
                break
            path, s, most = [], end, left[end]
            while True:
                p, e = from_s[s]
                path.append((p, e, 1))
                back = from_p[p]
                if back is None:
                    most = min(most, room[p])
                    start = p
                    break
                s, f = back
                path.append((p, f, -1))
                most = min(most, flow[p][f])
            for p, e, sign in path:
                flow[p][e] += sign * most
            left[end] -= most
            room[start] -= most
            sent[start] += most
    return flow


def mix(docs: DataFrame, sources: Column, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, repeats: int = REPEATS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), max_patterns: int = MAX_PATTERNS) -> tuple[DataFrame, DataFrame]:
    """(documents, sources): documents with size, pattern, taken; sources with source_size, target, routed.

    ``sources`` is an array of the names that hold a document.
    """
    spark = docs.sparkSession
    rows = docs.select(*keep, F.col(id_col).alias("doc_id"), token_count(F.col(text_col)).alias("size"), F.array_sort(F.array_distinct(sources)).alias("pattern"))
    key = F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = materialize(rows.withColumn("key", key), "sizes")
    found = rows.groupBy("pattern").agg(F.sum("size").alias("c")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns: coarsen the sources")
    found.sort(key=lambda r: [(x is None, x or "") for x in r["pattern"]])
    names = sorted({x for r in found for x in r["pattern"]}, key=lambda x: (x is None, x or ""))
    at = {x: k for k, x in enumerate(names)}
    sizes = [0] * len(names)
    for r in found:
        for x in r["pattern"]:
            sizes[at[x]] += r["c"]
    total = sum(r["c"] for r in found) * share
    goal = targets(sizes, [weights[k % len(weights)] for k in range(len(names))], float(total), repeats)
    flow = min_cost_flow([r["c"] for r in found], [[at[x] for x in r["pattern"]] for r in found], [int(g) for g in goal], repeats)
    routed = [0] * len(names)
    for r, f in zip(found, flow, strict=True):
        for x, n in zip(r["pattern"], f, strict=True):
            routed[at[x]] += n
    plan = []
    for r, f in zip(found, flow, strict=True):
        passes, rest = divmod(sum(f), r["c"]) if r["c"] else (0, 0)
        plan.append((r["pattern"], passes, rest))
    plans = F.broadcast(spark.createDataFrame(plan, "p array<string>, passes long, rest long"))  # at most max_patterns rows
    table = spark.createDataFrame([(x, sizes[k], goal[k], routed[k]) for x, k in at.items()], "source string, source_size long, target double, routed long")

    rows = rows.join(plans, F.col("pattern") == F.col("p") if None not in at else F.col("pattern").eqNullSafe(F.col("p")), "left").drop("p")
    rows = rows.withColumn("slot", F.substring("key", 1, 4))
    slots = rows.groupBy("pattern", "slot").agg(F.sum("size").alias("s"))  # 16**4 a pattern, at most
    before = Window.partitionBy("pattern").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("base", F.coalesce(F.sum("s").over(before), F.lit(0))).select(F.col("pattern").alias("p"), F.col("slot").alias("sl"), "base", "s")
    rows = rows.join(slots, rows.pattern.eqNullSafe(F.col("p")) & (rows.slot == F.col("sl")))
    # only the slot in which the rest ends needs an order of its own
    inside = (F.col("base") < F.col("rest")) & (F.col("base") + F.col("s") > F.col("rest"))
    order = Window.partitionBy("pattern", "slot", inside).orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.filter(~inside).withColumn("more", F.col("base") < F.col("rest"))
    edge = rows.filter(inside).withColumn("upto", F.col("base") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    edge = edge.withColumn("more", 2 * F.col("upto") + F.col("size") <= 2 * F.col("rest")).drop("upto")
    rows = whole.unionByName(edge)
    taken = F.col("size") * (F.col("passes") + F.col("more").cast("long"))
    return rows.select(*keep, "doc_id", "size", "pattern", taken.alias("taken")), table


def single_source(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """mix() for documents of one source each, with their source's size and target."""
    rows, table = mix(docs, F.array(F.col("source").cast("string")), keep=keep)
    table = F.broadcast(table.select("source", "source_size", "target"))  # at most MAX_PATTERNS rows
    rows = rows.withColumn("s", F.col("pattern")[0])
    return rows.join(table, F.col("s").eqNullSafe(F.col("source"))).select(*keep, "doc_id", "size", "source_size", "target", "taken")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single_source(read(spark, sf_dir, "documents"))


#: Template: {docs} is a table with doc_id, text, source.
SQL_OF = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM {docs}),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, row_number() OVER (ORDER BY 2 * source_size / w, source NULLS LAST) AS k FROM s),
lev AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(size) FROM d) - coalesce(sum(2 * source_size) OVER b, 0))
            / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS level
  FROM o WINDOW b AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT level FROM lev WHERE level * w < 2 * source_size ORDER BY k LIMIT 1),
t AS (
  SELECT source, source_size, least((2 * source_size)::DOUBLE, coalesce((SELECT level FROM cut), 'inf'::DOUBLE) * w) AS target FROM s),
f AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target)::BIGINT // source_size END AS passes,
         CASE WHEN source_size = 0 THEN 0 ELSE floor(target)::BIGINT % source_size END AS rest FROM t),
r AS (
  SELECT d.*, f.source_size, f.target, passes, rest,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || doc_id), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target, (size * (passes + (2 * upto + size <= 2 * rest)::INT))::BIGINT AS taken
FROM r
"""
SQL = SQL_OF.replace("{docs}", "documents")
