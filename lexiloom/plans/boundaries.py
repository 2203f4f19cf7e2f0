"""Queries on word boundaries: folded windows, what junctions leave visible, candidate pools, arms with a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import sandhi
from ..sources.readers import once
from . import duck as D
from . import registry as R
from .registry import query

_FIRST = """fr AS (SELECT first, second, arg_min(result, ord) AS result, arg_min(category, ord) AS category FROM rules WHERE second <> '' GROUP BY ALL),
f1 AS (SELECT * FROM fr WHERE length(first) = 1), f2 AS (SELECT * FROM fr WHERE length(first) = 2)"""


def _fold_sql(source: str, a: str, b: str, joined: str, category: str) -> str:
    return f"""SELECT s.*, CASE WHEN x.first IS NOT NULL THEN left({a}, length({a}) - 2) || x.result || substr({b}, 2) WHEN y.first IS NOT NULL THEN left({a}, length({a}) - 1) || y.result || substr({b}, 2) ELSE {a} || {b} END AS {joined},
coalesce(x.category, y.category, 'no-sandhi') AS {category} FROM {source} s LEFT JOIN f2 x ON x.first = right({a}, 2) AND x.second = left({b}, 1) LEFT JOIN f1 y ON y.first = right({a}, 1) AND y.second = left({b}, 1)"""


_FOLDED = f"""{D.rules()}, {_FIRST}, {D.lines('documents', 'doc_id')}, lw AS (SELECT doc_id, pos, string_split(line, ' ') AS ws FROM lines),
wi AS (SELECT doc_id, pos, i AS start, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT *, unnest(range(1, len(ws) - 1)) AS i FROM lw)),
ab AS ({_fold_sql('wi', 'a', 'b', 'ab', 'k1')}), abc AS ({_fold_sql('ab', 'ab', 'c', 'abc', 'k2')}),
folded AS (SELECT doc_id, pos, start, replace(abc, ' ', '') AS src, a || ' | ' || b || ' | ' || c AS tgt, a, b, c, k1, k2 FROM abc WHERE length(replace(abc, ' ', '')) <= 60)"""


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows of three words of a line, joined from the left, with a surface of 60 letters at most."""
    schema = "doc_id long, pos long, start long, src string, tgt string, k1 string, k2 string, a string, b string, c string"
    return R.by_kernel(R.table(spark, sf_dir, "documents"), K.folded(K.Folder(sandhi.first_results())), schema, "doc_id")


@query(f"WITH {_FOLDED} SELECT doc_id, pos, start, src, tgt, k1, k2 FROM folded")
def sandhi_fold_3(spark, sf_dir):
    return folded(spark, sf_dir).select("doc_id", "pos", "start", "src", "tgt", "k1", "k2")


@query(f"""WITH {_FOLDED}, z AS (SELECT k1, k2, starts_with(src, a || b) AS z1, starts_with(src, a || b || c) AS z2 FROM folded),
e AS (SELECT k1 AS category, z1 AS zero FROM z UNION ALL SELECT k2, z2 FROM z)
SELECT coalesce(category, 'TOTAL') AS category, count(*) AS n, count_if(zero)::BIGINT AS n_zero FROM e GROUP BY ROLLUP (category)""")
def boundary_taxonomy(spark, sf_dir):
    """Boundaries by the rule that made them; zero ones leave both words as they are. Words after a changed one can't be placed."""
    x = folded(spark, sf_dir)
    two = F.array(F.struct(F.col("k1").alias("category"), F.expr("startswith(src, concat(a, b))").alias("zero")), F.struct(F.col("k2").alias("category"), F.expr("startswith(src, concat(a, b, c))").alias("zero")))
    e = x.select(F.explode(two).alias("e")).groupBy("e.category").agg(F.count("*").alias("n"), F.count_if("e.zero").alias("n_zero"))
    e = e.rollup("category").agg(F.sum("n").alias("n"), F.sum("n_zero").alias("n_zero"))  # of the counts, so that the windows are made once
    return e.withColumn("category", F.coalesce("category", F.lit("TOTAL")))


@query(f"""WITH {D.meters()}, {R._ANCEPS}, {_FOLDED}, pr AS (SELECT DISTINCT ws[i] AS a, ws[i + 1] AS b FROM (SELECT ws, unnest(range(1, len(ws))) AS i FROM lw)), sa AS ({_fold_sql('pr', 'a', 'b', 'joined', 'k')}),
t AS (SELECT 'morph' AS task, {len(R.ROOTS)} AS n UNION ALL SELECT 'seg', count(*) FROM folded UNION ALL SELECT 'denoise', count(*) FROM lines WHERE length(line) >= 8
UNION ALL SELECT 'meter', count(*) FROM (SELECT DISTINCT v, name FROM c2)
UNION ALL SELECT 'sandhi', count(*) FROM sa WHERE NOT (k = 'no-sandhi' AND joined = a || b) OR ('0x' || left(md5('1337:' || a || ' ' || b), 8))::BIGINT % 100 < 5)
SELECT coalesce(task, 'TOTAL') AS task, sum(n)::BIGINT AS n FROM t GROUP BY ROLLUP (task)""")
def mixture_counts(spark, sf_dir):
    """Examples of each task. Of the word pairs that no rule changes, five in a hundred are taken, by hash."""
    one = once(R.batches_of(R.table(spark, sf_dir, "documents")).mapInArrow(K.mixed(K.Folder(sandhi.first_results())), "task string, n long, a string, b string, plain boolean").filter(_taken()), "mixture")
    counts = one.filter("a is null").groupBy("task").agg(F.sum("n").alias("n"))
    count = lambda df, task: df.agg(F.lit(task).alias("task"), F.count("*").alias("n"))
    t = count(spark.createDataFrame(R.ROOTS, "r string, gana string, artha string"), "morph").unionByName(counts)
    t = t.unionByName(spark.createDataFrame([("seg", 0), ("denoise", 0)], "task string, n long"))  # of an empty table
    for df, task in ((R.meter_claims(spark, sf_dir), "meter"), (one.filter("a is not null").select("a", "b").distinct(), "sandhi")):
        t = t.unionByName(count(df, task))
    return t.rollup("task").agg(F.sum("n").alias("n")).select(F.coalesce("task", F.lit("TOTAL")).alias("task"), "n")


def _taken():
    """Of the pairs that no rule changes five in a hundred, by hash; all other rows."""
    chance = F.conv(F.substring(F.md5(F.concat(F.lit("1337:"), "a", F.lit(" "), "b")), 1, 8), 16, 10).cast("long") % 100
    return F.when(F.col("plain"), chance < 5).otherwise(True)


# Weights of the symbolic score and of the model in each arm.
MODEL_ARMS = (("symbolic", 1.0, 0.0), ("trigram", 0.0, 1.0), ("joint", 1.0, 0.15))

_GRAMS = R._grams_sql("documents", "doc_id", "g").replace("slp_g", "slp_h").replace("lines_g", "lines_h")


@query(f"""WITH {R._CANDIDATES}, {_GRAMS}, {D.values('arms', 'arm, p, q', MODEL_ARMS)},
cl AS (SELECT item_id, cand, array_to_string(ws, ' ') AS line FROM c), b AS (SELECT item_id, cand, substr('^^' || line, i, 2) AS ctx, substr('^^' || line, i + 2, 1) AS ch FROM (SELECT *, unnest(range(1, length(line) + 1)) AS i FROM cl)),
t3 AS (SELECT ctx, ch, count(*) AS n3 FROM g GROUP BY ALL), c3 AS (SELECT ctx, sum(n3) AS m3 FROM t3 GROUP BY ctx),
t2 AS (SELECT right(ctx, 1) AS c1, ch, sum(n3) AS n2 FROM t3 GROUP BY ALL), c2 AS (SELECT c1, sum(n2) AS m2 FROM t2 GROUP BY c1),
t1 AS (SELECT ch, sum(n3) AS n1 FROM t3 GROUP BY ch), tot AS (SELECT sum(n1) AS nn, count(*) + 1 AS v FROM t1),
lm AS (SELECT item_id, cand, avg(ln(0.7::DOUBLE * coalesce((coalesce(n3, 0) + 0.1::DOUBLE) / (m3 + 0.1::DOUBLE * v), 0) + 0.2::DOUBLE * coalesce((coalesce(n2, 0) + 0.1::DOUBLE) / (m2 + 0.1::DOUBLE * v), 0) + 0.1::DOUBLE * (coalesce(n1, 0) + 0.1::DOUBLE) / (nn + 0.1::DOUBLE * v))) AS lm
FROM b LEFT JOIN t3 USING (ctx, ch) LEFT JOIN c3 USING (ctx) LEFT JOIN t2 ON c1 = right(ctx, 1) AND t2.ch = b.ch LEFT JOIN c2 ON c2.c1 = right(ctx, 1) LEFT JOIN t1 ON t1.ch = b.ch, tot GROUP BY ALL),
best AS (SELECT arm, item_id, cand, n FROM s JOIN lm USING (item_id, cand), arms QUALIFY row_number() OVER (PARTITION BY arm, item_id ORDER BY round(p::DOUBLE * (4.0::DOUBLE * cov + 0.5::DOUBLE * fw - 0.6::DOUBLE * oov - 0.05::DOUBLE * n) + q::DOUBLE * lm, 5) DESC, cand) = 1)
SELECT arm, count(*) AS n_items, count_if(cand = 1)::BIGINT AS n_exact, sum(n)::BIGINT AS n_words FROM best GROUP BY arm""")
def ranking_model_arms(spark, sf_dir):
    """Choices among the candidates by the symbolic score, by the trigram model's mean logarithm a letter, and by both."""
    arms = F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(p).alias("p"), F.lit(q).alias("q")) for a, p, q in MODEL_ARMS])
    texts = R.candidate_words(spark, sf_dir).select("item_id", "cand", F.array_join("ws", " ").alias("line"))
    lm = R.trigram_scores(R.trigram_counts(spark, sf_dir), R.grams_of(texts, "item_id", "cand"), "item_id", "cand")
    s = R._candidates(spark, sf_dir).join(lm, ["item_id", "cand"]).withColumn("a", F.explode(arms))
    score = F.round(F.col("a.p") * (4.0 * F.col("cov") + 0.5 * F.col("fw") - 0.6 * F.col("oov") - 0.05 * F.col("n")) + F.col("a.q") * F.col("lm"), 5)
    best = s.groupBy("a.arm", "item_id").agg(F.max_by(F.struct("cand", "n"), F.struct(score, -F.col("cand"))).alias("b"))
    return best.groupBy("arm").agg(F.count("*").alias("n_items"), F.count_if(F.col("b.cand") == 1).alias("n_exact"), F.sum("b.n").alias("n_words"))


@query()
def split_pool_report(spark, sf_dir):
    """Whether the pool of splits of a fused pair holds the pair, by whether the junction left both words as they are."""
    gold = R.fused_pairs(spark, sf_dir).select("src", F.concat_ws("|", "a", "b").alias("gold"), (F.concat("a", "b") == F.col("src")).alias("zero"))
    return pool_report(gold, sandhi.split(gold.select(F.col("src").alias("word")).distinct()))


def pool_report(gold: DataFrame, splits: DataFrame) -> DataFrame:
    """(zero, n, n_in_pool, n_silent, mean_pool) of gold (src, gold, zero) and candidates (word, cand, padas). Silent: the text is the only candidate."""
    hit = gold.join(splits, F.col("src") == F.col("word")).groupBy("src", "gold", "zero").agg(F.count("*").alias("pool"), F.bool_or(F.col("padas") == F.col("gold")).alias("hit"), F.bool_and(F.col("padas") == F.col("src")).alias("silent"))
    return hit.groupBy("zero").agg(F.count("*").alias("n"), F.count_if("hit").alias("n_in_pool"), F.count_if("silent").alias("n_silent"), F.round(F.avg("pool"), 6).alias("mean_pool"))


@query()
def segment_errors(spark, sf_dir):
    """The covers of fused pairs by tier and by the first one's edit distance to the surface, six and more as six."""
    gold = R.fused_pairs(spark, sf_dir).select("src", F.concat_ws("|", "a", "b").alias("gold"))
    return error_report(gold, R.kbest_segment(spark, sf_dir))


def error_report(gold: DataFrame, covers: DataFrame) -> DataFrame:
    """(tier, lev, n, n_exact, n_in_k, n_rederivable) of gold (src, gold) and covers (src, cand, padas, tier, rederivable)."""
    c = gold.join(covers, "src").groupBy("src", "gold", "tier").agg(F.min_by(F.struct("padas", "rederivable"), "cand").alias("top"), F.bool_or(F.col("padas") == F.col("gold")).alias("in_k"))
    lev = F.least(F.levenshtein(F.replace(F.col("top.padas"), F.lit("|"), F.lit("")), F.col("src")), F.lit(6)).cast("long")
    return c.groupBy("tier", lev.alias("lev")).agg(F.count("*").alias("n"), F.count_if(F.col("top.padas") == F.col("gold")).alias("n_exact"), F.count_if("in_k").alias("n_in_k"), F.count_if("top.rederivable").alias("n_rederivable"))
