"""All queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import alphabet as A
from ..functions import kernels as K
from ..functions import text as X
from ..operators import lexicon as L
from ..operators import prosody, sandhi
from ..sources.meters import GANAS, ROWS
from ..sources.readers import once
from . import duck as D

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verse_scan(spark, sf_dir)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "documents":
        # a table in fewer pieces than there are cores is dealt out first; large tables never are
        cores = spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < cores:
            df = df.select("doc_id", "text", "lang").repartition(cores)
    return df


def lines(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    cut = F.split(X.to_phonemes(F.coalesce(text, F.lit(""))), "\n")
    # outer, as Catalyst else asks first whether the array is empty, and computes it once more for that
    return df.select(*keys, F.posexplode_outer(cut).alias("pos", "line")).filter("line <> ''").withColumn("pos", F.col("pos").cast("long"))


def by_kernel(df: DataFrame, kernel, schema: str, *keys: str) -> DataFrame:
    """The rows that ``kernel`` of the words of each text gives, after the keys."""
    names = [x.split()[0] for x in schema.split(", ")]
    return df.select(*keys, X.prepared(F.coalesce("text", F.lit(""))).alias("_t")).mapInArrow(K.rows(names, list(keys), kernel), schema)


def weighed(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, w): the weights of each line."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    return df.select(*keys, X.prepared(F.coalesce("text", F.lit(""))).alias("_t")).mapInArrow(K.weighed([*keys, "pos", "w"], list(keys)), f"{schema}, pos long, w string")


def batches_of(df: DataFrame) -> DataFrame:
    return df.select(X.prepared(F.coalesce("text", F.lit(""))).alias("_t"))


def words(df: DataFrame, *keys: str) -> DataFrame:
    return lines(df, *keys).select(*keys, "pos", F.posexplode_outer(F.split("line", " ")).alias("wpos", "word")).withColumn("wpos", F.col("wpos").cast("long"))


def _n(c="*"):
    return F.count(c).alias("n")


_TEXT = "coalesce(text, '')"


# --- script and syllables ---------------------------------------------------------------------------
@query(f"SELECT doc_id, {D.phonemes(chr(99) + 'oalesce(text, $$$$)')} AS phonemes FROM documents")
def translit_roman(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.to_phonemes(F.coalesce("text", F.lit(""))).alias("phonemes"))


@query(f"""WITH l AS (SELECT lang, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
SELECT lang, count(*) AS n_lines, count_if(regexp_matches(line, '[ऀ-ॣ]'))::BIGINT AS n_native, count_if({D.is_phonemes('line')})::BIGINT AS n_encoded FROM l GROUP BY lang""")
def script_dispatch_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    return rows.groupBy("lang").agg(F.count("*").alias("n_lines"), F.count_if(X.has_native(F.col("line"))).alias("n_native"), F.count_if(X.is_phonemes(F.col("line"))).alias("n_encoded"))


@query(f"""WITH {D.words('benchmark', 'item_id')}
SELECT DISTINCT word, CASE WHEN regexp_matches(word, '[{A.VOWELS}]') THEN array_to_string(regexp_extract_all(word, {D.q(f'^[^{A.VOWELS}]*{D.UNIT}|{D.UNIT}')}), '-') ELSE word END AS syllables FROM words""")
def syllabify_words(spark, sf_dir):
    w = words(table(spark, sf_dir, "benchmark"), "item_id").select("word").distinct()
    return w.select("word", F.array_join(X.syllables(F.col("word")), "-").alias("syllables"))


@query(f"WITH {D.lines('conversations', 'conv_id, turn')} SELECT conv_id, turn, pos, {D.weights('line')} AS w FROM lines")
def syllable_weights(spark, sf_dir):
    return lines(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "pos", X.weights(F.col("line")).alias("w"))


@query(f"""WITH {D.lines('documents', 'doc_id, lang')}, w AS (SELECT lang, {D.weights('line')} AS w FROM lines)
SELECT lang, count(*) AS n_lines, sum(length(w))::BIGINT AS n_syllables, sum(length(replace(w, 'L', '')))::BIGINT AS n_heavy, sum(2 * length(w) - length(replace(w, 'G', '')))::BIGINT AS n_morae FROM w GROUP BY lang""")
def weight_profile_by_lang(spark, sf_dir):
    w = weighed(table(spark, sf_dir, "documents"), "lang").select("lang", "w")
    heavy = F.char_length(F.replace("w", F.lit("L"), F.lit("")))
    return w.groupBy("lang").agg(F.count("*").alias("n_lines"), F.sum(F.char_length("w")).cast("long").alias("n_syllables"), F.sum(heavy).cast("long").alias("n_heavy"), F.sum(X.morae(F.col("w"))).alias("n_morae"))


@query(f"""WITH {D.lines('benchmark', 'item_id')}
SELECT item_id, pos, array_to_string(list_transform(regexp_extract_all({D.weights('line')}, '[LG]{{3}}|[LG]'), lambda p: map_extract_value({D.mapping({v: k for k, v in GANAS.items()})}, p)), '-') AS ganas FROM lines""")
def gana_decompose(spark, sf_dir):
    return lines(table(spark, sf_dir, "benchmark"), "item_id").select("item_id", "pos", X.decompose(X.weights(F.col("line"))).alias("ganas"))


# --- meters ---------------------------------------------------------------------------------------------
@query(f"""WITH {D.meters()}, {D.lines('benchmark', 'item_id')}, w AS (SELECT item_id, pos, {D.weights('line')} AS w FROM lines),
s AS (SELECT item_id, pos, w, name, ord, list_min(list_transform(string_split(pattern, '/'), lambda p: {D.distance('w', 'p')})) AS distance FROM w, meters),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id, pos ORDER BY distance, name, ord) AS rank FROM s)
SELECT item_id, pos, w, rank, name, distance FROM r WHERE rank <= 3""")
def meter_identify_top3(spark, sf_dir):
    w = lines(table(spark, sf_dir, "benchmark"), "item_id").select("item_id", "pos", X.weights(F.col("line")).alias("w"))
    return prosody.identify(w, ["item_id", "pos"])


_VRTTA = f"""m AS (SELECT ord, name, string_split(pattern, '/') AS ps FROM meters),
f AS (SELECT id, name, ord, len(ps) = 1 AS one FROM padas, m WHERE w <> '' AND length(w) = length(ps[1 + pos % len(ps)]) AND left(w, length(w) - 1) = left(ps[1 + pos % len(ps)], length(w) - 1)),
c AS (SELECT id, ord, name, one, count(*) AS hits FROM f GROUP BY ALL),
v AS (SELECT id, one, arg_min(name, ord) AS name FROM c JOIN (SELECT id, count(*) AS n FROM padas GROUP BY id) USING (id) WHERE hits = n GROUP BY id, one)"""


@query(f"""WITH {D.meters()}, {D.lines('documents', 'doc_id')}, padas AS (SELECT struct_pack(doc_id := doc_id, line := pos) AS id, 0 AS pos, {D.weights('line')} AS w FROM lines), {_VRTTA}
SELECT id.doc_id AS doc_id, id.line AS line, name FROM v WHERE one""")
def meter_vrtta_exact(spark, sf_dir):
    w = once(weighed(table(spark, sf_dir, "documents"), "doc_id"), "weights").select(F.struct("doc_id", F.col("pos").alias("line")).alias("id"), F.lit(0).alias("pos"), "w")
    return prosody.vrtta(w, "id").filter("one").select("id.doc_id", "id.line", "name")


_ODD = D.mapping(prosody.ODD)
_ANUSTUBH = f"""q AS (SELECT id, flat, list_filter(list_transform(range(0, 4), lambda i: substr(flat, i * 8 + 1, 8)), lambda x: x <> '') AS qs FROM flats),
k AS (SELECT id, flat, list_transform(qs, lambda x: substr(x, 5, 3)) AS cs FROM q),
o AS (SELECT id, flat, list_transform(list_filter(cs, lambda x, i: i % 2 = 1), lambda x: map_extract_value({_ODD}, x)) AS odd, list_filter(cs, lambda x, i: i % 2 = 0 AND x <> 'LGL') AS bad FROM k),
an AS (SELECT id, CASE WHEN length(flat) IN (16, 32) AND len(bad) = 0 AND len(list_filter(odd, lambda x: x IS NULL)) = 0
  THEN CASE WHEN len(list_filter(odd, lambda x: x <> 'pathyā')) = 0 THEN 'pathyā' WHEN len(odd) = 2 AND odd[1] <> 'pathyā' AND odd[2] <> 'pathyā' AND odd[1] <> odd[2] THEN odd[1] || ', ' || odd[2] ELSE list_filter(odd, lambda x: x <> 'pathyā')[1] END END AS label FROM o)"""


@query(f"""WITH {D.lines('documents', 'doc_id')}, whole AS (SELECT doc_id, string_agg({D.weights('line')}, '' ORDER BY pos) AS f FROM lines GROUP BY doc_id),
flats AS (SELECT struct_pack(doc_id := doc_id, stanza := k) AS id, substr(f, k * 32 + 1, 32) AS flat FROM (SELECT *, unnest(range(0, (length(f) + 31) // 32)) AS k FROM whole)), {_ANUSTUBH}
SELECT id.doc_id AS doc_id, id.stanza AS stanza, label FROM an WHERE label IS NOT NULL""")
def anustubh_label(spark, sf_dir):
    """Of every 32 syllables of a text, the rest included."""
    texts = table(spark, sf_dir, "documents").select("doc_id", X.prepared(F.coalesce("text", F.lit(""))).alias("_t"))
    rows = texts.mapInArrow(K.weighed(["doc_id", "f"], ["doc_id"], whole=True), "doc_id long, f string").filter("f <> ''")
    rows = rows.select("doc_id", F.posexplode(F.expr("transform(sequence(0, (length(f) - 1) div 32), k -> substring(f, cast(k * 32 + 1 as int), 32))")).alias("stanza", "flat"))
    return rows.select("doc_id", F.col("stanza").cast("long").alias("stanza"), prosody.anustubh(F.col("flat")).alias("label")).filter("label is not null")


_JATI = """jt AS (SELECT id, list_contains(s, 12) AND ((list_contains(s, 30) AND list_contains(s, 42) AND (list_contains(s, 57) OR list_contains(s, 56))) OR (list_contains(s, 29) AND list_contains(s, 41) AND (list_contains(s, 56) OR list_contains(s, 55)))) AS ok
FROM (SELECT id, list_transform(range(1, length(flat) + 1), lambda i: 2 * i - length(replace(left(flat, i), 'G', ''))) AS s FROM flats))"""


@query(f"""WITH {D.lines('benchmark', 'item_id')}, flats AS (SELECT item_id AS id, string_agg({D.weights('line')}, '' ORDER BY pos) AS flat FROM lines GROUP BY item_id), {_JATI}
SELECT id AS item_id, CASE WHEN ok THEN 'āryā' END AS jati FROM jt""")
def jati_label(spark, sf_dir):
    flat = F.array_join(F.transform(F.split(X.to_phonemes(F.col("text")), "\n"), X.weights), "")
    return table(spark, sf_dir, "benchmark").select("item_id", prosody.jati(flat).alias("jati"))


@query(f"""WITH {D.meters()}, t AS (SELECT ord, name, pattern, array_to_string(list_transform(string_split(groups, '/'), lambda g: array_to_string(list_transform(string_split(g, '-'), lambda x: map_extract_value({D.mapping(GANAS)}, x)), '')), '/') AS e FROM meters)
SELECT count(*) AS n_meters, count_if(pattern NOT LIKE '%/%')::BIGINT AS n_single, count_if(pattern <> e)::BIGINT AS n_bad FROM t""")
def meter_table_audit(spark, sf_dir):
    t = spark.createDataFrame(ROWS, "ord int, name string, groups string, pattern string")
    names = X.lookup(GANAS)
    e = F.array_join(F.transform(F.split("groups", "/"), lambda g: F.array_join(F.transform(F.split(g, "-"), lambda x: F.try_element_at(names, x)), "")), "/")
    return t.agg(F.count("*").alias("n_meters"), F.count_if(~F.col("pattern").contains("/")).alias("n_single"), F.count_if(F.col("pattern") != e).alias("n_bad"))


_FAMILIES = """fam AS (SELECT substr(pattern, 2) AS tail, min(ord) AS first_ord, string_agg(name, '/' ORDER BY name) AS members FROM meters WHERE pattern NOT LIKE '%/%' GROUP BY 1 HAVING count(*) > 1)"""


@query(f"WITH {D.meters()}, {_FAMILIES} SELECT tail, first_ord, members FROM fam")
def upajati_families(spark, sf_dir):
    return prosody.families(spark)


@query(f"""WITH {D.meters()}, {D.lines('documents', 'doc_id')}, padas AS (SELECT struct_pack(doc_id := doc_id, pair := pos // 2) AS id, pos % 2 AS pos, {D.weights('line')} AS w FROM lines), {_FAMILIES},
g AS (SELECT id, min(substr(w, 2, length(w) - 2)) AS t, min(length(w)) AS n FROM padas GROUP BY id HAVING count(*) >= 2 AND count(DISTINCT length(w)) = 1 AND count(DISTINCT left(w, 1)) >= 2 AND min(substr(w, 2, length(w) - 2)) = max(substr(w, 2, length(w) - 2)) AND min(length(w)) > 0)
SELECT id.doc_id AS doc_id, id.pair AS pair, arg_min(members, first_ord) AS members FROM g JOIN fam ON left(tail, length(tail) - 1) = t AND length(tail) = n - 1 GROUP BY id""")
def upajati_label(spark, sf_dir):
    w = weighed(table(spark, sf_dir, "documents"), "doc_id").select(F.struct("doc_id", F.floor(F.col("pos") / 2).alias("pair")).alias("id"), (F.col("pos") % 2).alias("pos"), "w")
    return prosody.upajati(w, "id").select("id.doc_id", "id.pair", "members")


# Well-known verses, as fixed input beside the benchmark texts.
VERSES = (
    (-1, "dharmakṣetre kurukṣetre samavetā yuyutsavaḥ\nmāmakāḥ pāṇḍavāścaiva kimakurvata sañjaya"),
    (-2, "vāgarthāviva saṃpṛktau vāgarthapratipattaye\njagataḥ pitarau vande pārvatīparameśvarau"),
    (-3, "kaścitkāntāvirahaguruṇā svādhikārātpramattaḥ\nśāpenāstaṃgamitamahimā varṣabhogyeṇa bhartuḥ\nyakṣaścakre janakatanayāsnānapuṇyodakeṣu\nsnigdhacchāyātaruṣu vasatiṃ rāmagiryāśrameṣu"),
    (-4, "k\nt"),
    (-5, ""),
)


@query(f"""WITH {D.meters()}, {D.values('vs', 'id, text', VERSES)}, verses AS (SELECT id, text FROM vs UNION ALL SELECT item_id, text FROM benchmark), {D.lines('verses', 'id')},
padas AS (SELECT id, pos, {D.weights('line')} AS w FROM lines), flats AS (SELECT id, string_agg(w, '' ORDER BY pos) AS flat, count(*) AS n FROM padas GROUP BY id), {_VRTTA}, {_FAMILIES}, {_ANUSTUBH}, {_JATI},
g AS (SELECT id, min(substr(w, 2, length(w) - 2)) AS t, min(length(w)) AS n FROM padas GROUP BY id HAVING count(*) >= 2 AND count(DISTINCT length(w)) = 1 AND count(DISTINCT left(w, 1)) >= 2 AND min(substr(w, 2, length(w) - 2)) = max(substr(w, 2, length(w) - 2)) AND min(length(w)) > 0),
up AS (SELECT id, arg_min(members, first_ord) AS mix FROM g JOIN fam ON left(tail, length(tail) - 1) = t AND length(tail) = n - 1 GROUP BY id)
SELECT verses.id, coalesce(flats.n, 0) AS n_padas, coalesce(length(flat), 0) AS n_syllables,
  CASE WHEN label IS NOT NULL THEN 'anuṣṭubh' WHEN o.name IS NOT NULL THEN o.name WHEN mix IS NOT NULL THEN 'upajāti' WHEN h.name IS NOT NULL THEN h.name WHEN ok THEN 'āryā' END AS meter_name,
  CASE WHEN label IS NOT NULL THEN label WHEN o.name IS NULL THEN mix END AS meter_detail
FROM verses LEFT JOIN flats USING (id) LEFT JOIN an USING (id) LEFT JOIN jt USING (id) LEFT JOIN up USING (id) LEFT JOIN (SELECT * FROM v WHERE one) o USING (id) LEFT JOIN (SELECT * FROM v WHERE NOT one) h USING (id)""")
def verse_scan(spark, sf_dir):
    verses = spark.createDataFrame(VERSES, "id long, text string").union(table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return prosody.scan(verses)


# --- junctions ------------------------------------------------------------------------------------------
def _pairs(df: DataFrame, *keys: str) -> DataFrame:
    cut = lines(df, *keys).withColumn("w", F.split("line", " "))
    return cut.select(*keys, F.explode(F.expr("transform(sequence(1, greatest(size(w) - 1, 1)), i -> struct(w[i - 1] as a, get(w, i) as b))")).alias("p")).select(*keys, "p.a", "p.b").filter("b is not null")


def _pairs_sql(t: str, key: str) -> str:
    return f"{D.lines(t, key)}, lw AS (SELECT {key}, string_split(line, ' ') AS w FROM lines), every AS (SELECT {key}, w[i] AS a, w[i + 1] AS b FROM (SELECT {key}, w, unnest(range(1, len(w))) AS i FROM lw)), pairs AS (SELECT DISTINCT a, b FROM every)"


@query(f"WITH {D.rules()}, {_pairs_sql('benchmark', 'item_id')}, {D.joined()} SELECT a, b, cand, joined, category FROM j")
def sandhi_join_adjacent(spark, sf_dir):
    return sandhi.join(_pairs(table(spark, sf_dir, "benchmark"), "item_id").select("a", "b").distinct())


@query(f"WITH {D.rules()}, {_pairs_sql('documents', 'doc_id')}, {D.joined()} SELECT category, count(*) AS n FROM every JOIN j USING (a, b) WHERE cand = 1 GROUP BY category")
def sandhi_category_counts(spark, sf_dir):
    # the last two and the first letter decide; counting them first leaves few rows to join
    p = _pairs(table(spark, sf_dir, "documents"), "doc_id").select(F.expr("right(a, 2)").alias("a"), F.expr("left(b, 1)").alias("b"))
    n = p.groupBy("a", "b").agg(_n())
    return sandhi.join(n).filter("cand = 1").groupBy("category").agg(F.sum("n").alias("n"))


@query(f"WITH {D.rules()}, pairs AS (SELECT DISTINCT 'k' || first AS a, second || 'm' AS b FROM rules WHERE second <> ''), {D.joined()} SELECT category, count(*) AS n_pairs, count(DISTINCT joined) AS n_results FROM j WHERE cand = 1 GROUP BY category")
def sandhi_rule_coverage(spark, sf_dir):
    p = sandhi.rules(spark).filter("second <> ''").select(F.concat(F.lit("k"), "first").alias("a"), F.concat("second", F.lit("m")).alias("b")).distinct()
    return sandhi.join(p).filter("cand = 1").groupBy("category").agg(F.count("*").alias("n_pairs"), F.countDistinct("joined").alias("n_results"))


@query()
def sandhi_split(spark, sf_dir):
    """The 20 first splits of every word."""
    return sandhi.split(words(table(spark, sf_dir, "benchmark"), "item_id").select("word").distinct())


# --- lexicon --------------------------------------------------------------------------------------------
def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = batches_of(table(spark, sf_dir, "documents")).mapInArrow(K.counted, "word string, n long")
    return n.groupBy(F.col("word").alias("pada")).agg(F.sum("n").alias("freq"))


_LEX = f"{D.words('documents', 'doc_id')}, lex AS (SELECT word AS pada, count(*) AS freq FROM words GROUP BY 1)"


@query(f"WITH {_LEX} SELECT pada, freq FROM lex")
def lexicon_counts(spark, sf_dir):
    return lexicon(spark, sf_dir)


@query(f"WITH {_LEX} SELECT count(*) AS n_words, sum(freq)::BIGINT AS n_tokens, max(freq) AS top FROM lex")
def lexicon_stats(spark, sf_dir):
    return lexicon(spark, sf_dir).agg(F.count("*").alias("n_words"), F.sum("freq").alias("n_tokens"), F.max("freq").alias("top"))


@query(f"WITH {_LEX} SELECT pada, freq FROM lex WHERE freq >= 2 ORDER BY freq DESC, pada LIMIT 6000")
def lexicon_top(spark, sf_dir):
    return lexicon(spark, sf_dir).filter("freq >= 2").orderBy(F.desc("freq"), "pada").limit(6000)


@query(f"WITH {_LEX}, b AS (SELECT DISTINCT w AS word FROM (SELECT unnest(string_split(l, ' ')) AS w FROM (SELECT unnest(string_split({D.phonemes('text')}, chr(10))) AS l FROM benchmark)) WHERE w <> ''), f AS (SELECT DISTINCT word, unnest([word, regexp_replace(word, '[sr]$', 'H')]) AS pada FROM b) SELECT word, coalesce(max(freq), 0) AS freq FROM f LEFT JOIN lex USING (pada) GROUP BY word")
def lexicon_pausa_probe(spark, sf_dir):
    w = words(table(spark, sf_dir, "benchmark"), "item_id").select("word").distinct()
    lex = lexicon(spark, sf_dir)
    forms = w.select("word", F.explode(F.array_distinct(F.array("word", X.pausa(F.col("word"))))).alias("pada"))
    return forms.join(lex, "pada", "left").groupBy("word").agg(F.coalesce(F.max("freq"), F.lit(0)).alias("freq"))


@query(f"WITH {_LEX} SELECT pada, round(ln(freq) - ln((SELECT sum(freq) FROM lex)), 6) AS logp, round(ln(1 + freq) / ln(1 + (SELECT max(freq) FROM lex)), 6) AS share FROM lex")
def lexicon_log_score(spark, sf_dir):
    lex = once(lexicon(spark, sf_dir), "lexicon")
    total = F.broadcast(lex.agg(F.sum("freq").alias("s"), F.max("freq").alias("m")))  # one row
    return lex.crossJoin(total).select("pada", F.round(F.log("freq") - F.log("s"), 6).alias("logp"), F.round(F.log1p("freq") / F.log1p("m"), 6).alias("share"))


@query(f"""WITH RECURSIVE {_LEX}, rare AS (SELECT pada AS w, length(pada) AS n FROM lex WHERE freq <= 10 AND length(pada) >= 8),
st AS (SELECT w, n, unnest(range(0, n)) AS i FROM rare), pt AS (SELECT w, i, unnest(range(i + 1, least(n, i + 30) + 1)) AS j FROM st),
e AS (SELECT w, i, j FROM pt JOIN lex ON pada = substr(w, i + 1, j - i) WHERE freq >= 50 AND pada <> w),
r AS (SELECT w, 0::BIGINT AS pos FROM rare UNION SELECT r.w, e.j FROM r JOIN e ON e.w = r.w AND e.i = r.pos)
SELECT pada, freq FROM lex WHERE pada NOT IN (SELECT r.w FROM r JOIN rare USING (w) WHERE pos = n)""")
def lexicon_prune(spark, sf_dir):
    return L.prune(once(lexicon(spark, sf_dir), "lexicon"))


# --- n-grams --------------------------------------------------------------------------------------------
def grams_of(l: DataFrame, *keys: str) -> DataFrame:
    """(keys, at, ctx, ch) of ``line``. Characters are cut once, then indexed."""
    l = l.withColumn("c", F.concat(F.expr("array('^', '^')"), F.split("line", ""))).filter("line <> ''")
    return l.select(*keys, F.explode(F.expr("transform(sequence(1, size(c) - 2), i -> struct(i as at, c[i - 1] || c[i] as ctx, c[i + 1] as ch))")).alias("g")).select(*keys, "g.*")


def _grams(df: DataFrame, *keys: str) -> DataFrame:
    return grams_of(lines(df, *keys), *keys, "pos")


def _grams_sql(t: str, key: str, name: str) -> str:
    return D.lines(t, key).replace("slp AS", f"slp_{name} AS").replace("FROM slp)", f"FROM slp_{name})").replace("lines AS", f"lines_{name} AS") + f", {name} AS (SELECT {key}, pos, i AS at, substr('^^' || line, i, 2) AS ctx, substr('^^' || line, i + 2, 1) AS ch FROM (SELECT *, unnest(range(1, length(line) + 1)) AS i FROM lines_{name}))"


@query(f"WITH {_grams_sql('documents', 'doc_id', 'g')} SELECT ctx, ch, count(*) AS n FROM g GROUP BY ctx, ch")
def ngram_counts(spark, sf_dir):
    n = batches_of(table(spark, sf_dir, "documents")).mapInArrow(K.grams, "ctx string, ch string, n long")
    return n.groupBy("ctx", "ch").agg(F.sum("n").alias("n"))


@query(f"""WITH {_grams_sql('documents', 'doc_id', 'g')}, {_grams_sql('benchmark', 'item_id', 'b')},
t3 AS (SELECT ctx, ch, count(*) AS n3 FROM g GROUP BY ALL), c3 AS (SELECT ctx, sum(n3) AS m3 FROM t3 GROUP BY ctx),
t2 AS (SELECT right(ctx, 1) AS c1, ch, sum(n3) AS n2 FROM t3 GROUP BY ALL), c2 AS (SELECT c1, sum(n2) AS m2 FROM t2 GROUP BY c1),
t1 AS (SELECT ch, sum(n3) AS n1 FROM t3 GROUP BY ch), tot AS (SELECT sum(n1) AS n, count(*) + 1 AS v FROM t1)
SELECT item_id, round(avg(ln(0.7::DOUBLE * coalesce((coalesce(n3, 0) + 0.1::DOUBLE) / (m3 + 0.1::DOUBLE * v), 0) + 0.2::DOUBLE * coalesce((coalesce(n2, 0) + 0.1::DOUBLE) / (m2 + 0.1::DOUBLE * v), 0) + 0.1::DOUBLE * (coalesce(n1, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * v))), 6) AS logp
FROM b LEFT JOIN t3 USING (ctx, ch) LEFT JOIN c3 USING (ctx) LEFT JOIN t2 ON c1 = right(ctx, 1) AND t2.ch = b.ch LEFT JOIN c2 ON c2.c1 = right(ctx, 1) LEFT JOIN t1 ON t1.ch = b.ch, tot GROUP BY item_id""")
def trigram_logprob(spark, sf_dir):
    g = _grams(table(spark, sf_dir, "benchmark"), "item_id")
    return trigram_scores(trigram_counts(spark, sf_dir), g, "item_id").select("item_id", F.round("lm", 6).alias("logp"))


def trigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(ngram_counts(spark, sf_dir).withColumnRenamed("n", "n3"), "trigrams")


def trigram_scores(t3: DataFrame, g: DataFrame, *keys: str) -> DataFrame:
    """(keys, lm, n): mean logarithm of the interpolated probability a letter, and the letters. ``t3``: a written table, at most one row for three letters."""
    b = F.broadcast  # bounded by the third power of the alphabet
    g = g.withColumn("c1", F.expr("right(ctx, 1)"))
    t2 = t3.groupBy(F.expr("right(ctx, 1)").alias("c1"), "ch").agg(F.sum("n3").alias("n2"))
    t1 = t3.groupBy("ch").agg(F.sum("n3").alias("n1"))
    tot = t1.agg(F.sum("n1").alias("nn"), (F.count("*") + 1).alias("v"))
    g = g.join(b(t3), ["ctx", "ch"], "left").join(b(t3.groupBy("ctx").agg(F.sum("n3").alias("m3"))), "ctx", "left").join(b(t2), ["c1", "ch"], "left").join(b(t2.groupBy("c1").agg(F.sum("n2").alias("m2"))), "c1", "left").join(b(t1), "ch", "left").crossJoin(F.broadcast(tot))  # one row
    p = lambda n, m: F.coalesce((F.coalesce(n, F.lit(0)) + F.lit(0.1)) / (F.col(m) + F.lit(0.1) * F.col("v")), F.lit(0.0))
    prob = 0.7 * p("n3", "m3") + 0.2 * p("n2", "m2") + 0.1 * p("n1", "nn")
    return g.groupBy(*keys).agg(F.avg(F.log(prob)).alias("lm"), F.count("*").alias("n_letters"))


# --- training data --------------------------------------------------------------------------------------
_IDS = f"list_transform(regexp_extract_all(text, {D.q('(?s)' + D.alternatives(A.CONTROLS) + '|.')}), lambda t: coalesce(map_extract_value({D.mapping(A.VOCABULARY)}, t), {A.VOCABULARY['<unk>']}))"


@query(f"SELECT item_id, array_to_string({_IDS}, ' ') AS ids FROM benchmark")
def tokenizer_encode(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.transform(X.encode(F.col("text")), lambda i: i.cast("string")), " ").alias("ids"))


@query(f"SELECT item_id, array_to_string(list_filter(list_transform(regexp_extract_all({D.phonemes('text')}, '(?s).'), lambda t: CASE WHEN contains({D.q(A.CHARACTERS)}, t) THEN t END), lambda t: t IS NOT NULL), '') AS text FROM benchmark")
def tokenizer_roundtrip(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", X.decode(X.encode(X.to_phonemes(F.col("text")))).alias("text"))


_TURNS = "p AS (SELECT conv_id, turn, text AS src, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS tgt, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS r2 FROM conversations), e AS (SELECT conv_id, turn, src, tgt FROM p WHERE role = 'user' AND r2 = 'assistant')"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("tgt", F.lead("text").over(w)).withColumn("r2", F.lead("role").over(w))
    return c.filter("role = 'user' and r2 = 'assistant'").select("conv_id", "turn", F.col("text").alias("src"), "tgt")


@query(f"WITH {_TURNS} SELECT conv_id, turn, length(src) + length(tgt) + 3 AS n_ids, length(src) + 2 AS loss_start, length(src) + length(tgt) + 3 <= 256 AS fits FROM e")
def encode_examples(spark, sf_dir):
    ids, start = X.encode_example(F.col("src"), F.col("tgt"))
    return _turns(spark, sf_dir).select("conv_id", "turn", F.size(ids).cast("long").alias("n_ids"), start.cast("long").alias("loss_start"), (F.size(ids) <= 256).alias("fits"))


_BAG = "list_filter(string_split(regexp_replace(lower({}), '\\s+', ' ', 'g'), ' '), lambda x: x <> '')"


@query(f"""WITH {_TURNS}, s AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest({_BAG.format('src')}) AS w FROM e) GROUP BY ALL), t AS (SELECT conv_id, turn, w, count(*) AS m FROM (SELECT conv_id, turn, unnest({_BAG.format('tgt')}) AS w FROM e) GROUP BY ALL),
c AS (SELECT conv_id, turn, sum(least(n, m)) AS tp FROM s JOIN t USING (conv_id, turn, w) GROUP BY ALL)
SELECT e.conv_id, e.turn, CASE WHEN coalesce(tp, 0) = 0 THEN 0.0::DOUBLE ELSE round((2 * tp)::DOUBLE / (len({_BAG.format('src')}) + len({_BAG.format('tgt')})), 6) END AS f1 FROM e LEFT JOIN c USING (conv_id, turn)""")
def word_f1_turns(spark, sf_dir):
    bag = lambda c: F.filter(F.split(F.regexp_replace(F.lower(c), r"\s+", " "), " "), lambda x: x != "")
    e = _turns(spark, sf_dir).select("conv_id", "turn", bag(F.col("src")).alias("s"), bag(F.col("tgt")).alias("t"))
    side = lambda c, n: e.select("conv_id", "turn", F.explode(c).alias("w")).groupBy("conv_id", "turn", "w").agg(F.count("*").alias(n))
    tp = side("s", "n").join(side("t", "m"), ["conv_id", "turn", "w"]).groupBy("conv_id", "turn").agg(F.sum(F.least("n", "m")).alias("tp"))
    f1 = F.when(F.coalesce("tp", F.lit(0)) == 0, 0.0).otherwise(F.round((2 * F.col("tp")).cast("double") / (F.size("s") + F.size("t")), 6))
    return e.join(tp, ["conv_id", "turn"], "left").select("conv_id", "turn", f1.alias("f1"))


_SPLIT = "r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('1337:' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents), s AS (SELECT doc_id, lang, CASE WHEN k <= greatest(1, floor(n * 0.05::DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM r)"


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5 % of each language by hash. The order statistic comes from hash buckets, so that no language is sorted in one task."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.md5(F.concat(F.lit("1337:"), F.col("doc_id").cast("string"))).alias("h")).withColumn("b", F.substring("h", 1, 3))
    bins = d.groupBy("lang", "b").agg(F.count("*").alias("c"))  # 4,096 a language, at most
    w = Window.partitionBy("lang")
    bins = bins.withColumn("before", F.coalesce(F.sum("c").over(w.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("val", F.greatest(F.lit(1), F.floor(F.sum("c").over(w) * F.lit(0.05))))
    d = d.join(F.broadcast(bins.select(F.col("lang").alias("l"), F.col("b").alias("bb"), "before", "val")), F.col("lang").eqNullSafe(F.col("l")) & (F.col("b") == F.col("bb")))  # bounded as above
    k = F.col("before") + F.row_number().over(Window.partitionBy("lang", "b").orderBy("h", "doc_id"))
    return d.withColumn("k", k).select("doc_id", "lang", F.when(F.col("k") <= F.col("val"), "val").otherwise("train").alias("split"))


@query(f"WITH {_SPLIT} SELECT doc_id, lang, split FROM s")
def stratified_split(spark, sf_dir):
    return _split(spark, sf_dir)


@query(f"WITH {_SPLIT} SELECT coalesce(split, 'TOTAL') AS split, coalesce(lang, 'TOTAL') AS lang, count(*) AS n FROM s GROUP BY ROLLUP (split, lang)")
def split_meta(spark, sf_dir):
    return _split(spark, sf_dir).rollup("split", "lang").agg(_n()).select(F.coalesce("split", F.lit("TOTAL")).alias("split"), F.coalesce("lang", F.lit("TOTAL")).alias("lang"), "n")


@query(f"""WITH {D.lines('documents', 'doc_id')}, m AS (SELECT doc_id, pos, line, greatest(2, round_even(length(line) * 0.15::DOUBLE, 0)::BIGINT) AS span FROM lines WHERE length(line) >= 8),
a AS (SELECT *, ('0x' || left(md5('1337' || line), 8))::BIGINT % (length(line) - span + 1) AS cut FROM m)
SELECT doc_id, pos, left(line, cut) || '[MASK_0]' || substr(line, cut + span + 1) AS src, substr(line, cut + 1, span) AS tgt FROM a""")
def denoise_mask(spark, sf_dir):
    l = lines(table(spark, sf_dir, "documents"), "doc_id").filter("length(line) >= 8")
    src, tgt = X.mask_span(F.col("line"), "1337")
    return l.select("doc_id", "pos", src.alias("src"), tgt.alias("tgt"))


@query(f"""WITH {D.lines('documents', 'doc_id')}, w AS (SELECT doc_id, pos, string_split(line, ' ') AS ws FROM lines),
x AS (SELECT doc_id, pos, i, ws[i : i + 2] AS win FROM (SELECT *, unnest(range(1, len(ws) - 1)) AS i FROM w))
SELECT doc_id, pos, i AS start, array_to_string(win, '') AS src, array_to_string(win, ' | ') AS tgt FROM x WHERE length(array_to_string(win, '')) <= 60""")
def seg_windows(spark, sf_dir):
    return seg_rows(table(spark, sf_dir, "documents"), 3).select("doc_id", "pos", "start", "src", "tgt")


def seg_rows(docs: DataFrame, *widths: int) -> DataFrame:
    """(doc_id, pos, width, start, src, tgt) of windows of so many words."""
    return by_kernel(docs, K.windows(widths), "doc_id long, pos long, width long, start long, src string, tgt string", "doc_id")


@query(f"WITH {D.lines('documents', 'doc_id')}, b AS (SELECT DISTINCT unnest(string_split({D.phonemes('text')}, chr(10))) AS line FROM benchmark) SELECT doc_id, pos FROM lines ANTI JOIN b USING (line)")
def decontaminate_lines(spark, sf_dir):
    b = lines(table(spark, sf_dir, "benchmark"), "item_id").select("line").distinct()
    return lines(table(spark, sf_dir, "documents"), "doc_id").join(b, "line", "left_anti").select("doc_id", "pos")


_HELD = f"""{_LEX}, l AS (SELECT doc_id, min(struct_pack(f := freq, n := -length(word), w := word)) AS m FROM words JOIN lex ON pada = word WHERE length(word) >= 3 GROUP BY doc_id),
r AS (SELECT doc_id, m.w AS w, row_number() OVER (ORDER BY md5('0:' || doc_id), doc_id) AS k, count(*) OVER () AS n FROM l), held AS (SELECT DISTINCT w FROM r WHERE k <= ceil(0.3::DOUBLE * n))"""


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, word), a word once a row of documents; repeats go within the row, before anything is shuffled."""
    w = F.array_distinct(F.split(F.translate(X.to_phonemes(F.coalesce("text", F.lit(""))), "\n", " "), " "))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode_outer(w).alias("word")).filter("word <> ''")


#: The most frequent words, whose frequency is looked up without a shuffle, and held words that are broadcast at most.
HEAD, HELD = 100_000, 1_500_000


def _rarest(w: DataFrame, lex: DataFrame, head: int = HEAD) -> DataFrame:
    """(doc_id, m): the rarest word of each document. Only words beyond the ``head`` most frequent ones are shuffled; those make most of a text."""
    beyond = lex.select("freq").orderBy(F.desc("freq")).limit(head + 1).agg(F.count("*"), F.min("freq")).first()
    cut = beyond[1] if beyond[0] > head else 0
    often = F.broadcast(lex.filter(F.col("freq") > cut))  # ``head`` rows at most
    least = lambda df: df.groupBy("doc_id").agg(F.min(F.struct("freq", (-F.length("word")).alias("col2"), "word")).alias("m"))
    # one pass: a document's row of the frequent words is made within its task
    near = least(w.join(often, "word"))
    rest = w.join(often.select("word"), "word", "left_anti").join(lex.filter(F.col("freq") <= cut).hint("shuffle_merge"), "word")
    return near.unionByName(least(rest)).groupBy("doc_id").agg(F.min("m").alias("m"))


def _with_held(w: DataFrame, held: DataFrame, most: int = HELD) -> DataFrame:
    """``w`` with ``held``, null where its word isn't held; the held words are broadcast unless they are many."""
    few = held.limit(most + 1).count() <= most
    return w.join(F.broadcast(held) if few else held, F.col("word") == F.col("held"), "left")


def _held(w: DataFrame, lex: DataFrame) -> DataFrame:
    """(held): the rarest word of each of 30 % of the documents, by hash. w: words of documents, each once a row."""
    rare = once(_rarest(w.filter("length(word) >= 3"), lex), "rarest")
    n = F.broadcast(rare.agg(F.count("*").alias("n")))  # one row
    sites = rare.select("doc_id", F.col("m.word").alias("held"), F.md5(F.concat(F.lit("0:"), F.col("doc_id").cast("string"))).alias("h")).crossJoin(n)
    b = Window.partitionBy("b").orderBy("h", "doc_id")
    sites = sites.withColumn("b", F.substring("h", 1, 3))
    bins = sites.groupBy("b").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")  # 4,096 rows, at most
    return sites.join(F.broadcast(bins), "b").filter("before < ceil(0.3 * n)").withColumn("k", F.col("before") + F.row_number().over(b)).filter("k <= ceil(cast(0.3 as double) * n)").select("held").distinct()


@query(f"""WITH {_HELD},
d AS (SELECT doc_id, bool_or(h.w IS NOT NULL) AS oov FROM words LEFT JOIN held h ON h.w = word GROUP BY doc_id)
SELECT CASE WHEN g = 1 THEN 'all' WHEN oov THEN 'oov' ELSE 'in_lex' END AS bucket, n FROM (SELECT oov, grouping(oov) AS g, count(*) AS n FROM d GROUP BY GROUPING SETS ((oov), ()))""")
def oov_report(spark, sf_dir):
    w = once(document_words(spark, sf_dir), "words")
    held = once(_held(w, once(lexicon(spark, sf_dir).withColumnRenamed("pada", "word"), "lexicon")), "held")
    d = _with_held(w, held).groupBy("doc_id").agg(F.bool_or(F.col("held").isNotNull()).alias("oov"))
    one = d.groupBy("oov").agg(_n()).select(F.when(F.col("oov"), "oov").otherwise("in_lex").alias("bucket"), "n")
    return one.union(one.agg(F.lit("all").alias("bucket"), F.sum("n").alias("n")))


@query(f"""WITH {_HELD}, bw AS (SELECT string_split(l, ' ') AS ws FROM (SELECT unnest(string_split({D.phonemes('text')}, chr(10))) AS l FROM benchmark) WHERE l <> ''),
bp AS (SELECT ws[i] AS a, ws[i + 1] AS b FROM (SELECT ws, unnest(range(1, len(ws))) AS i FROM bw)), ab AS (SELECT pada FROM lex ANTI JOIN held ON w = pada),
t AS (SELECT CASE WHEN a IN (SELECT pada FROM ab) AND b IN (SELECT pada FROM ab) THEN 'lexicon' ELSE 'fallback' END AS tier, CASE WHEN a IN (SELECT w FROM held) OR b IN (SELECT w FROM held) THEN 'oov' ELSE 'in_lex' END AS bucket FROM bp)
SELECT tier, CASE WHEN grouping(bucket) = 1 THEN 'all' ELSE bucket END AS bucket, count(*) AS n FROM t GROUP BY GROUPING SETS ((tier), (tier, bucket))""")
def oov_tier_report(spark, sf_dir):
    """Pairs of neighbours in the benchmark texts by tier (both in the lexicon less the held words, or not) and by whether one is held."""
    w = once(document_words(spark, sf_dir), "words")
    lex = once(lexicon(spark, sf_dir).withColumnRenamed("pada", "word"), "lexicon")
    p = once(_pairs(table(spark, sf_dir, "benchmark"), "item_id").groupBy("a", "b").agg(_n()), "pairs")
    asked = p.select(F.col("a").alias("word")).union(p.select("b")).distinct()
    flags = once(_with_held(lex.select("word").join(asked, "word", "left_semi"), once(_held(w, lex), "held")).select("word", F.col("held").isNotNull().alias("is_held")), "flags")
    for k in ("a", "b"):
        p = p.join(flags.select(F.col("word").alias(k), F.col("is_held").alias(f"held_{k}")), k, "left")
    known = lambda k: F.coalesce(~F.col(f"held_{k}"), F.lit(False))
    held = lambda k: F.coalesce(F.col(f"held_{k}"), F.lit(False))
    t = p.select(F.when(known("a") & known("b"), "lexicon").otherwise("fallback").alias("tier"), F.when(held("a") | held("b"), "oov").otherwise("in_lex").alias("bucket"), "n")
    t = t.groupBy("tier", "bucket").agg(F.sum("n").alias("n"))
    return t.unionByName(t.groupBy("tier").agg(F.lit("all").alias("bucket"), F.sum("n").alias("n")))


@query("""SELECT least(levenshtein(a.text, b.text), 40) AS lev, count(*) AS n FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1 GROUP BY 1""")
def edit_distance_hist(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("t2"))
    lev = F.levenshtein("text", "t2").cast("long")
    return b.join(nxt, "item_id").groupBy(F.least(lev, F.lit(40)).alias("lev")).agg(_n())


@query("SELECT page_id, array_to_string(regexp_extract_all(html, '[À-ÿ]+'), ' ') AS runs FROM pages")
def html_run_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.regexp_extract_all("html", F.lit("[À-ÿ]+"), F.lit(0)), " ").alias("runs"))


@query("SELECT event_type, (props::JSON->>'k')::BIGINT % 7 AS k, count(*) AS n FROM events GROUP BY ALL")
def nested_json_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k long"))
    return e.groupBy("event_type", (F.col("p.k") % 7).alias("k")).agg(_n())


_ANCEPS = """vp AS (SELECT ord, name, p, length(pattern) - length(replace(pattern, '/', '')) = 0 AS one FROM (SELECT ord, name, pattern, unnest(string_split(pattern, '/')) AS p FROM meters)),
cl AS (SELECT DISTINCT v, name, v = p AS exact, one FROM (SELECT name, p, one, unnest(CASE WHEN length(p) >= 8 THEN [p, left(p, length(p) - 1) || 'L', left(p, length(p) - 1) || 'G'] ELSE [p] END) AS v FROM vp)),
c1 AS (SELECT * FROM cl QUALIFY exact = max(exact) OVER (PARTITION BY v)), c2 AS (SELECT * FROM c1 QUALIFY one = max(one) OVER (PARTITION BY v))"""


@query(f"WITH {D.meters()}, {_ANCEPS} SELECT DISTINCT v AS weights, name FROM c2")
def meter_claims(spark, sf_dir):
    """Weight strings of quarters, the last syllable free from 8 on, with the names that have the strongest claim."""
    m = prosody.meters(spark).select("name", "one", F.explode("patterns").alias("p"))
    cut = F.expr("left(p, length(p) - 1)")
    v = F.when(F.length("p") >= 8, F.array("p", F.concat(cut, F.lit("L")), F.concat(cut, F.lit("G")))).otherwise(F.array("p"))
    c = m.select("name", "one", "p", F.explode(v).alias("weights")).select("weights", "name", "one", (F.col("p") == F.col("weights")).alias("exact"))
    w = Window.partitionBy("weights")
    c = c.withColumn("t", F.max("exact").over(w)).filter("exact = t")
    return c.withColumn("t", F.max("one").over(w)).filter("one = t").select("weights", "name").distinct()


# A few roots with their class and meaning.
ROOTS = (("BU", "1", "sattAyAm"), ("gam", "1", "gatO"), ("kf", "8", "karaRe"), ("dA", "3", "dAne"), ("pac", "1", "pAke"), ("hA", "3", "tyAge"))


@query(f"""WITH {D.values('roots', 'root, gana, artha', ROOTS)}, p AS (SELECT item_id, '<dhAtu>' || CASE item_id % 7 WHEN 0 THEN 'BU' WHEN 1 THEN 'gam' WHEN 2 THEN 'kf' WHEN 3 THEN 'dA' WHEN 4 THEN 'pac' WHEN 5 THEN 'hA' ELSE 'zzzq' END || '<gaRa>' || item_id % 9 AS raw FROM benchmark)
SELECT item_id, regexp_extract(raw, '<dhAtu>([^<]*)', 1) AS root, r.root IS NOT NULL AS verified, coalesce(r.gana = regexp_extract(raw, '<gaRa>([^<]*)', 1), false) AS same_class FROM p LEFT JOIN roots r ON r.root = regexp_extract(raw, '<dhAtu>([^<]*)', 1)""")
def root_verify(spark, sf_dir):
    roots = spark.createDataFrame(ROOTS, "r string, gana string, artha string")
    names = F.array(*[F.lit(r[0]) for r in ROOTS], F.lit("zzzq"))
    p = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("<dhAtu>"), F.get(names, F.col("item_id") % 7), F.lit("<gaRa>"), (F.col("item_id") % 9).cast("string")).alias("raw"))
    p = p.select("item_id", X.field(F.col("raw"), "<dhAtu>").alias("root"), X.field(F.col("raw"), "<gaRa>").alias("g"))
    hit = p.join(F.broadcast(roots), F.col("root") == F.col("r"), "left")  # a fixed table
    return hit.select("item_id", "root", F.col("r").isNotNull().alias("verified"), F.coalesce(F.col("gana") == F.col("g"), F.lit(False)).alias("same_class"))


_CANDIDATES = f"""{_LEX}, top AS (SELECT max(freq) AS m FROM lex), c AS (SELECT item_id, 1 AS cand, w AS ws FROM (SELECT item_id, string_split(replace({D.phonemes('text')}, chr(10), ' '), ' ') AS w FROM benchmark)
UNION ALL SELECT item_id, 2, list_transform(range(1, len(w) + 1, 2), lambda i: w[i] || coalesce(w[i + 1], '')) FROM (SELECT item_id, string_split(replace({D.phonemes('text')}, chr(10), ' '), ' ') AS w FROM benchmark)),
x AS (SELECT item_id, cand, unnest(ws) AS w FROM c), s AS (
SELECT item_id, cand, count(*) AS n, avg((freq IS NOT NULL)::INT) AS cov, sum(ln(1 + coalesce(freq, 0))) / (count(*) * ln(1 + any_value(m))) AS fw, count_if(freq IS NULL) AS oov FROM x LEFT JOIN lex ON pada = w, top GROUP BY ALL)"""


def candidate_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, cand, ws): the words of each text, and its words two by two."""
    w = table(spark, sf_dir, "benchmark").select("item_id", F.split(F.replace(X.to_phonemes(F.col("text")), F.lit("\n"), F.lit(" ")), " ").alias("w"))
    pairs = F.expr("transform(sequence(1, size(w), 2), i -> concat(w[i - 1], coalesce(get(w, i), '')))")
    return w.select("item_id", F.posexplode(F.array("w", pairs)).alias("cand", "ws")).select("item_id", (F.col("cand") + 1).cast("long").alias("cand"), "ws")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two segmentations of each text with coverage, frequency, unknown words and length."""
    c = once(candidate_words(spark, sf_dir).select("item_id", "cand", F.explode("ws").alias("pada")), "candidates")
    # of words that no text asks for only the largest frequency counts, so that the whole lexicon is neither written nor joined
    lex = _with_held(lexicon(spark, sf_dir).withColumnRenamed("pada", "word"), c.select(F.col("pada").alias("held")).distinct())
    lex = once(lex.groupBy("held").agg(F.max("freq").alias("freq")), "asked")
    top = F.broadcast(lex.agg(F.max("freq").alias("m")))  # one row
    lex = lex.filter("held is not null").withColumnRenamed("held", "pada")
    return c.join(lex, "pada", "left").crossJoin(top).groupBy("item_id", "cand").agg(F.count("*").alias("n"), F.avg(F.col("freq").isNotNull().cast("int")).alias("cov"), (F.sum(F.log1p(F.coalesce("freq", F.lit(0)))) / (F.count("*") * F.log1p(F.first("m")))).alias("fw"), F.count_if(F.col("freq").isNull()).alias("oov"))


@query(f"""WITH {_CANDIDATES}
SELECT item_id, cand, round(4.0::DOUBLE * cov + 0.5::DOUBLE * fw - 0.6::DOUBLE * oov - 0.05::DOUBLE * n, 5) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(4.0::DOUBLE * cov + 0.5::DOUBLE * fw - 0.6::DOUBLE * oov - 0.05::DOUBLE * n, 5) DESC, cand) AS rank FROM s""")
def candidate_rank(spark, sf_dir):
    s = _candidates(spark, sf_dir)
    s = s.select("item_id", "cand", F.round(4.0 * F.col("cov") + 0.5 * F.col("fw") - 0.6 * F.col("oov") - 0.05 * F.col("n"), 5).alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "cand")).cast("long"))


# Weights of coverage, frequency, unknown words and length; an arm leaves out all but some.
ARMS = (("coverage", 4.0, 0.0, 0.0, 0.0), ("frequency", 0.0, 0.5, 0.0, 0.0), ("unknown", 0.0, 0.0, 0.6, 0.0), ("length", 0.0, 0.0, 0.0, 0.05), ("all", 4.0, 0.5, 0.6, 0.05))


@query(f"""WITH {_CANDIDATES}, {D.values('arms', 'arm, p, q, r, t', ARMS)},
sc AS (SELECT arm, item_id, cand, n, oov, round(p::DOUBLE * cov + q::DOUBLE * fw - r::DOUBLE * oov - t::DOUBLE * n, 5) AS score FROM s, arms),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY arm, item_id ORDER BY score DESC, cand) = 1)
SELECT arm, count(*) AS n_items, count_if(cand = 1)::BIGINT AS n_exact, sum(n)::BIGINT AS n_words, sum(oov)::BIGINT AS n_unknown FROM best GROUP BY arm""")
def ranking_ablation(spark, sf_dir):
    """Each arm's choice among the candidates, the first of equal ones; exact is the text as it was written."""
    arms = F.array(*[F.struct(F.lit(a).alias("arm"), *[F.lit(x).alias(k) for k, x in zip("pqrt", w, strict=True)]) for a, *w in ARMS])
    s = _candidates(spark, sf_dir).select("*", F.explode(arms).alias("a"))
    score = F.round(F.col("a.p") * F.col("cov") + F.col("a.q") * F.col("fw") - F.col("a.r") * F.col("oov") - F.col("a.t") * F.col("n"), 5)
    best = s.groupBy("a.arm", "item_id").agg(F.max_by(F.struct("cand", "n", "oov"), F.struct(score, -F.col("cand"))).alias("b"))
    return best.groupBy("arm").agg(F.count("*").alias("n_items"), F.count_if(F.col("b.cand") == 1).alias("n_exact"), F.sum("b.n").alias("n_words"), F.sum("b.oov").alias("n_unknown"))


def fused_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, src): neighbours in the benchmark texts and what their junction gives, without blanks."""
    p = sandhi.fold(_pairs(table(spark, sf_dir, "benchmark"), "item_id").select("a", "b").distinct(), "a", "b", "joined", "category")
    return p.select("a", "b", F.replace("joined", F.lit(" "), F.lit("")).alias("src"))


@query()
def kbest_segment(spark, sf_dir):
    """The best covers of fused word pairs by the lexicon; a pair without one keeps its text, as its own tier."""
    import pandas as pd

    sources = once(fused_pairs(spark, sf_dir).select("src").distinct(), "sources")
    whole = once(lexicon(spark, sf_dir), "lexicon")
    total = whole.agg(F.sum("freq")).first()[0]
    lex = sandhi.reachable(whole, sources)
    known = {r["pada"]: r["lp"] for r in lex.select("pada", (F.log("freq") - F.log(F.lit(float(total or 1)))).alias("lp")).collect()}
    shared = spark.sparkContext.broadcast(known)  # words that occur in a source, but for three letters: bounded by the benchmark texts, not by the corpus
    table_ = [(f, s, r) for _, f, s, r, _ in sandhi.RULES]
    joins = sandhi.results()

    def run(batches):
        for pdf in batches:
            rows = []
            for src in pdf["src"]:
                best = sandhi.kbest(src, shared.value, table_)
                rows += [(src, k + 1, "|".join(ws), round(sc, 6), "lexicon", sandhi.rederives(ws, src, joins)) for k, (sc, ws) in enumerate(best)] or [(src, 1, src, 0.0, "fallback", True)]
            yield pd.DataFrame(rows, columns=["src", "cand", "padas", "score", "tier", "rederivable"])

    return sources.repartition(sandhi.TASKS * spark.sparkContext.defaultParallelism).mapInPandas(run, "src string, cand long, padas string, score double, tier string, rederivable boolean")
