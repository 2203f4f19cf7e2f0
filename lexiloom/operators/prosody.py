"""Meter identification as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.meters import JATIS, ROWS

ODD = {"LGG": "pathyā", "LLL": "na-vipulā", "GLL": "bha-vipulā", "GGG": "ma-vipulā", "GLG": "ra-vipulā"}  # Fixed values


def meters(spark: SparkSession) -> DataFrame:
    """(ord, name, patterns, one): one is true for meters with the same quarter throughout."""
    rows = [(k, n, p.split("/"), "/" not in p) for k, n, _, p in ROWS]
    return spark.createDataFrame(rows, "ord int, name string, patterns array<string>, one boolean")


#: Syllables that fit a number; the longest quarter of the table has fewer.
BITS = 62


def identify(lines: DataFrame, keep: list[str], top: int = 3) -> DataFrame:
    """Meters of each line (weights column ``w``) by distance, name, order. Every meter is tried; the table is fixed.

    The distance is that of ``text.distance``. No more of a line is compared than the quarter is long, so its
    first weights go into one number, and unlike places are the bits of an exclusive or.
    """
    quarter = lambda p: F.struct(F.lit(len(p)).alias("n"), F.lit(int(p.translate(str.maketrans("LG", "01")).ljust(BITS, "0"), 2)).cast("long").alias("bits"))
    # one line against 145 rows: scored within the row, without a shuffle
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("ord"), F.array(*[quarter(p) for p in ps.split("/")]).alias("qs")) for k, n, _, ps in ROWS])
    digits = F.rpad(F.translate(F.expr(f"left(w, {BITS})"), "LG", "01"), BITS, "0")
    # rows of their own, so that the weights and the number aren't computed again for every quarter
    lines = lines.select(*keep, F.explode(F.array("w")).alias("w"))
    lines = lines.select(*keep, "w", F.explode(F.array(F.struct(F.char_length("w").alias("n"), F.conv(digits, 2, 10).cast("long").alias("bits")))).alias("_q"))
    n, bits = F.col("_q.n"), F.col("_q.bits")

    def distance(q: Column) -> Column:
        upto = F.least(n, q["n"]) - F.when(n == q["n"], 1).otherwise(0)
        return (F.abs(n - q["n"]) + F.bit_count(F.call_function("shiftright", bits.bitwiseXOR(q["bits"]), F.lit(BITS) - upto))).cast("long")

    scored = F.transform(table, lambda t: F.struct(F.array_min(F.transform(t["qs"], distance)).alias("distance"), t["name"].alias("name"), t["ord"].alias("ord")))
    best = lines.select(*keep, "w", F.slice(F.array_sort(scored), 1, top).alias("best"))
    return best.select(*keep, "w", F.posexplode("best").alias("rank", "b")).select(*keep, "w", (F.col("rank") + 1).cast("long").alias("rank"), "b.name", "b.distance")


def anustubh(flat: Column) -> Column:
    """Label of 16 or 32 syllables in quarters of 8, else null."""
    quarters = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.substr(flat, i * 8 + 1, F.lit(8)))
    quarters = F.filter(quarters, lambda q: q != "")
    cadence = F.transform(quarters, lambda q: F.substring(q, 5, 3))
    names = X.lookup(ODD)
    odd = F.transform(F.filter(cadence, lambda c, i: i % 2 == 0), lambda c: F.try_element_at(names, c))
    even = F.forall(F.filter(cadence, lambda c, i: i % 2 == 1), lambda c: c == "LGL")
    special = F.array_distinct(F.filter(odd, lambda x: x != "pathyā"))
    good = F.char_length(flat).isin(16, 32) & even & F.forall(odd, lambda x: x.isNotNull())
    return F.when(good, F.when(F.size(special) > 0, F.array_join(special, ", ")).otherwise("pathyā"))


def jati(flat: Column) -> Column:
    """Name of the mora meter whose boundaries fall on syllable ends, else null."""
    sums = F.aggregate(F.split(F.when(flat == "", F.lit(None)).otherwise(flat), ""), F.expr("array(0)"), lambda a, c: F.when(c == "", a).otherwise(F.concat(a, F.array(F.element_at(a, -1) + F.when(c == "G", 2).otherwise(1)))))
    has = lambda n: F.array_contains(sums, n)
    out = F.lit(None).cast("string")
    for name, (a, b, c, d) in reversed(JATIS.items()):
        b, c, d = a + b, a + b + c, a + b + c + d
        ok = has(a) & ((has(b) & has(c) & (has(d) | has(d - 1))) | (has(b - 1) & has(c - 1) & (has(d - 1) | has(d - 2))))
        out = F.when(ok, name).otherwise(out)
    return out


def vrtta(padas: DataFrame, key: str) -> DataFrame:
    """(key, one, name): the first meter that all quarters fit. padas: (key, pos from 0, w)."""
    n = padas.groupBy(key).agg(F.count("*").alias("n_padas"))
    m = meters(padas.sparkSession).select("ord", "name", "one", F.size("patterns").alias("np"), F.posexplode("patterns").alias("idx", "p"))
    m = F.broadcast(m.filter("p <> ''").withColumn("len", F.char_length("p")).withColumn("head", F.expr("left(p, len - 1)")))  # a fixed table
    p = padas.withColumn("len", F.char_length("w")).withColumn("head", F.expr("left(w, len - 1)"))
    hit = p.join(m, ["len", "head"]).filter(F.col("pos") % F.col("np") == F.col("idx"))
    full = hit.groupBy(key, "ord", "name", "one").agg(F.count("*").alias("hits")).join(n, key).filter("hits = n_padas")
    return full.groupBy(key, "one").agg(F.min_by("name", "ord").alias("name"))


def families(spark: SparkSession) -> DataFrame:
    """(tail, first_ord, members): meters that differ in the first syllable at most."""
    m = meters(spark).filter("one").select("ord", "name", F.expr("substring(patterns[0], 2)").alias("tail"))
    return m.groupBy("tail").agg(F.min("ord").alias("first_ord"), F.array_join(F.sort_array(F.collect_list("name")), "/").alias("members"), F.count("*").alias("n")).filter("n > 1").drop("n")


def upajati(padas: DataFrame, key: str) -> DataFrame:
    """(key, members) of verses whose quarters mix the members of one family."""
    fam = F.broadcast(families(padas.sparkSession))
    g = padas.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct(F.char_length("w")).alias("lens"), F.countDistinct(F.substring("w", 1, 1)).alias("firsts"), F.min(F.expr("substring(w, 2, length(w) - 2)")).alias("t1"), F.max(F.expr("substring(w, 2, length(w) - 2)")).alias("t2"), F.min(F.char_length("w")).alias("len"))
    g = g.filter("n >= 2 and lens = 1 and firsts >= 2 and t1 = t2 and len > 0")
    hit = g.join(fam, (F.expr("left(tail, length(tail) - 1)") == F.col("t1")) & (F.char_length("tail") == F.col("len") - 1))
    return hit.groupBy(key).agg(F.min_by("members", "first_ord").alias("members"))


def scan(verses: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, n_padas, n_syllables, meter_name, meter_detail): the cascade over whole verses."""
    padas = verses.select(F.col(key), F.posexplode(F.split(X.to_phonemes(F.col(text)), "\n")).alias("pos", "line")).filter("line <> ''")
    padas = padas.select(key, "pos", X.weights(F.col("line")).alias("w"))
    flat = padas.groupBy(key).agg(F.count("*").alias("n_padas"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]), "").alias("flat"))
    v = vrtta(padas, key)
    one = v.filter("one").select(key, F.col("name").alias("vrtta"))
    many = v.filter("not one").select(key, F.col("name").alias("ardha"))
    up = upajati(padas, key).withColumnRenamed("members", "mix")
    rows = verses.select(key).join(flat, key, "left").join(one, key, "left").join(up, key, "left").join(many, key, "left")
    label, moric = anustubh(F.col("flat")), jati(F.col("flat"))
    name = F.when(label.isNotNull(), "anuṣṭubh").otherwise(F.coalesce("vrtta", F.when(F.col("mix").isNotNull(), "upajāti"), "ardha", moric))
    return rows.select(key, F.coalesce("n_padas", F.lit(0)).cast("long").alias("n_padas"), F.coalesce(F.char_length("flat"), F.lit(0)).cast("long").alias("n_syllables"), name.alias("meter_name"), F.when(label.isNotNull(), label).when(F.col("vrtta").isNull(), F.col("mix")).alias("meter_detail"))
