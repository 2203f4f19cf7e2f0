"""Steps whose longest task or time grew too fast: weights by a kernel, searches dealt out, covers of rare words, anchors in any order of documents."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_kernels import SF, odd_texts, plan

from lexiloom.functions import kernels as K
from lexiloom.functions import text as X
from lexiloom.llm import suffix_dedup
from lexiloom.operators import lexicon, sandhi
from lexiloom.plans import registry



def test_weights(spark):
    """The kernel against the built-in expression, by lines and whole texts."""
    df = spark.createDataFrame(list(enumerate([*odd_texts(1500), "a'M ka''H a''k t'a\nta'M", "rAma''H kt"])), "doc_id long, text string").repartition(3)
    want = registry.lines(df, "doc_id").select("doc_id", "pos", X.weights(F.col("line")).alias("w")).collect()
    got = registry.weighed(df, "doc_id").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 1000
    texts = df.select("doc_id", X.prepared(F.coalesce("text", F.lit(""))).alias("_t"))
    flat = {r.doc_id: r.f for r in texts.mapInArrow(K.weighed(["doc_id", "f"], ["doc_id"], whole=True), "doc_id long, f string").collect() if r.f}
    whole = {k: "".join(r.w for r in rows) for k, rows in itertools.groupby(sorted(want), lambda r: r.doc_id)}
    assert flat == {k: w for k, w in whole.items() if w}


@pytest.mark.parametrize("name", ["meter_vrtta_exact", "weight_profile_by_lang", "upajati_label", "anustubh_label"])
def test_weights_in_one_pass(spark, name):
    p = plan(registry.queries()[name](spark, SF))
    assert X.UNIT not in p and "posexplode_outer" not in p and "documents.parquet" not in p.replace("documents.parquet", "", 1)


def test_searches_are_dealt_out(spark):
    """A few words go to many tasks, though they fit one."""
    words = spark.createDataFrame([(w,) for w in ("tadDitam", "rAmo'sti", "devendra") * 20], "word string").coalesce(1)
    out = sandhi.split(words)
    assert out.rdd.getNumPartitions() == sandhi.TASKS * spark.sparkContext.defaultParallelism
    assert out.select("word").distinct().count() == 3


def test_covers(spark):
    """Against a search over all covers, but for "é" by the kernel."""
    r = random.Random(7)
    words = {"".join(r.choices("abc", k=r.randint(2, 4))) for _ in range(30)} | {"ab" * 15, "ab" * 16, "bca" * 10}
    rare = {"".join(r.choices("abc", k=r.randint(8, 40))) for _ in range(400)} | {"ab" * 40, "ab" * 15, "d" * 9, "é" * 8, "c" * 200}
    lex = {**{w: 60 for w in words}, **{w: 3 for w in rare - words}}

    def covered(w):
        at = {0}
        for j in range(1, len(w) + 1):
            at |= {j for i in at if 0 < j - i <= 30 and j - i < len(w) and lex.get(w[i:j], 0) >= 50}
        return len(w) in at

    want = {w for w, n in lex.items() if n <= 10 and len(w) >= 8 and covered(w)}
    assert 5 < len(want) < len(rare) - 5
    df = spark.createDataFrame(list(lex.items()), "pada string, freq long")
    named = df.select("pada", F.sha2("pada", 256).alias("key"))
    for most in (lexicon.MOST,):
        assert {x.pada for x in named.join(lexicon.fused(df, most=most), "key").collect()} == want


def test_wrong_hash(spark, monkeypatch):
    """Covers of parts that only seem to be known are looked up again."""
    monkeypatch.setattr(K, "hashed", lambda batches: (pa.RecordBatch.from_arrays([pa.array(K.Rolling(np.frombuffer(b"abcd", np.uint8))(np.array([0, 0, 2]), np.array([4, 2, 2])).view(np.int64))], names=["h"]) for b in batches))
    df = spark.createDataFrame([("abcd", 60), ("abcdabcd", 1), ("abcdababcd", 1), ("ab", 4), ("cdcdcdcd", 1)], "pada string, freq long")
    named = df.select("pada", F.sha2("pada", 256).alias("key"))
    assert {x.pada for x in named.join(lexicon.fused(df), "key").collect()} == {"abcdabcd"}


def test_anchors_by_hash_alone():
    """Rows of one anchor in any order of documents, over batches."""
    rows = [(1, 5), (2, 5), (2, 6), (2, 5), (3, 7), (3, 7), (4, 8), (4, 8), (4, 8), (4, 9)]
    for cut in range(1, len(rows)):
        batches = [pa.RecordBatch.from_pydict({"h": pa.array([h for h, _ in x], pa.int64()), "doc_id": pa.array([d for _, d in x], pa.int64()), "pos": pa.array([0] * len(x), pa.int32()), "rest": pa.nulls(len(x), pa.list_(pa.int32()))}) for x in (rows[:cut], rows[cut:])]
        got = [d for b in suffix_dedup._repeated(iter(batches)) for d in b.column("doc_id").to_pylist()]
        assert sorted(got) == [5, 5, 6, 8, 8, 8, 9]
