"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of documents; the
last adds what the mix takes of each document. Rows are told apart by a key: the id, or, where ids are null or
shared, a number of its own after all ids. So no row is lost or multiplied for its id. Any further columns, whatever their names,
pass through, but those that the mix adds, which replace columns of these names. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import decontaminate as leaks
from lexiloom.llm import exact_dedup as copies
from lexiloom.llm import lang_id, mixing
from lexiloom.llm import near_dedup as near
from lexiloom.llm.common import bucket, materialize, read, small, unique_keys

#: A document is rejected if it has no letter or if, in the mixture over all languages, none has this share: three languages in equal parts go.
MIN_SHARE = 0.45
#: So is one of at least so many n-grams which letters drawn one by one explain better than the languages do; shorter texts tell too little.
JUDGED_GRAMS = 200
#: Near duplicates share at least so many hundredths of their five-word shingles.
NEAR_PERCENT = 80
#: What the mix adds.
MIXED = ("size", "source_size", "target", "taken")


def _without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The columns of ``row`` of ``docs`` (key, row), less the keys that ``found`` (doc_id, kept) drops; they are small beside the texts."""
    gone = materialize(found.filter("not kept").select(F.col("doc_id").alias("_gone")), "gone")
    return docs.join(small(gone), F.col("key") == F.col("_gone"), "left_anti").select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what is in no language: null texts, texts without a letter, mixtures without a main language, lettered junk.

    Every other row stays, repeated ones and rows without an id too. Without labelled rows nothing can be told, and all rows go.
    """
    langs, table = lang_id.fit(docs.filter(bucket(F.col("doc_id"), 4) != 2), "doc_id", "text", "lang")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = lang_id.identify(rows, langs, table, ["row"], evidence=True, inside="row")
    junk = (F.col("_grams") >= JUDGED_GRAMS) & (F.col("_gain") < 0)
    return found.filter((F.col("lang_pred") != lang_id.UND) & (F.col("_share") >= MIN_SHARE) & ~junk).select("row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of texts that are equal without white space: the longest, then the smallest id.

    Null and empty texts are one group. Repeated rows are copies of each other; rows whose ids are null or shared come after all others.
    """
    keyed = unique_keys(docs, "doc_id", "exact")
    return _without(keyed, copies.exact_dedup(keyed.select(F.col("key").alias("doc_id"), "row.text")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each component of near duplicates; texts without words are linked with nothing and stay."""
    keyed = unique_keys(docs, "doc_id", "near")
    return _without(keyed, near.near_dedup(keyed.select(F.col("key").alias("doc_id"), "row.text"), NEAR_PERCENT))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a window of the benchmark. Null and empty texts have none and stay; equal texts share their fate."""
    return leaks.decontaminate(docs, read(spark, sf_dir, "benchmark")).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which the mix takes no word, texts without words among them, and adds MIXED to the others."""
    keyed = unique_keys(docs, "doc_id", "mix")
    plan = mixing.single_source(keyed.select(F.col("key").alias("doc_id"), "row.text", "row.source")).filter("taken > 0")
    plan = plan.select(F.col("doc_id").alias("_key"), F.struct(*MIXED).alias("_mixed"))
    rows = keyed.join(plan, F.col("key") == F.col("_key"))
    return rows.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in MIXED], "_mixed.*")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs


#: The first stage learns a model, which SQL can't express.
ORACLE_SQL = None
