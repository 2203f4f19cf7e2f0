"""The Arrow kernels against the built-in expressions that they stand for, and what the queries of a corpus read and send."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import alphabet as A
from lexiloom.functions import text as X
from lexiloom.plans import boundaries, registry

SF = "/root/testdata/sf0.001"


def odd_texts(n=2000):
    r = random.Random(5)
    pools = [list("aaiiuuhhkgcjtdpbṭḍāīūṛḷśṣṅñṇṃḥ  \n\n\t\r|।॥fqwxz.,'’0AKGTИ😀éẞỊ̇́̄ \u0085\x0b"), list("कखगंःािीु् ।\nअaK"), list(A.LETTERS + "  \n|।"), list("aiuhkt "), list("abh\n |")]
    return [None, "", " ", "\n", "h", "ah", "|", "kh\n\n", "p", "ph", "r", "\n a", *("".join(r.choices(r.choice(pools), k=r.randint(0, 25))) for _ in range(n))]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_phonemes(spark):
    df = spark.createDataFrame(list(enumerate(odd_texts())), "k int, t string")
    rows = df.select("t", X._phonemes(F.col("t")).alias("a"), X.to_phonemes(F.col("t")).alias("b")).collect()
    assert [r for r in rows if r.a != r.b] == []


def test_classes_are_ranges(spark):
    """A class of single letters beyond ASCII is asked letter by letter for each place of a text."""
    assert len(X._NATIVE) < 40
    letters = [*A.NATIVE_VOWELS, *A.NATIVE_SIGNS, *A.NATIVE_CONSONANTS]
    assert [c for c in map(chr, range(0x8F0, 0x990)) if (c in letters) != spark.range(1).select(X.has_native(F.lit(c))).first()[0]] == []


@pytest.mark.parametrize("name", ["ngram_counts", "lexicon_counts", "seg_windows", "seg_windows_all", "clean_slokas", "sandhi_fold_3", "boundary_taxonomy", "mixture_counts"])
def test_no_rows_for_letters(spark, name):
    """Letters, words and windows come out of the kernels; no rows are made of them before, and the texts are read once."""
    p = plan(registry.queries()[name](spark, SF))
    assert "posexplode" not in p and "slice(" not in p and "documents.parquet" not in p.replace("documents.parquet", "", 1)
    assert "MapInArrow" in p or name == "mixture_counts" and "documents.parquet" not in p  # its pass over the texts is written once


def test_words_and_grams(spark):
    """Against counts in plain Python, with empty texts and lines."""
    texts = odd_texts(500)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    said = {r.doc_id: r.p or "" for r in df.select("doc_id", X.to_phonemes(F.col("text")).alias("p")).collect()}
    lines = [(k, pos, line) for k, p in said.items() for pos, line in enumerate(p.split("\n")) if line]
    grams = Counter((f"^^{x}"[i : i + 2], x[i]) for _, _, x in lines for i in range(len(x)))
    got = registry.batches_of(df).mapInArrow(registry.K.grams, "ctx string, ch string, n long").groupBy("ctx", "ch").agg(F.sum("n").alias("n")).collect()
    assert {(r.ctx, r.ch): r.n for r in got} == grams
    words = registry.batches_of(df).mapInArrow(registry.K.counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    assert {r.word: r.n for r in words} == Counter(w for _, _, x in lines for w in x.split(" "))
    wins = {(k, pos, n, i + 1, "".join(ws[i : i + n])) for k, pos, x in lines for ws in [x.split(" ")] for n in (2, 3, 4) for i in range(len(ws) - n + 1) if len("".join(ws[i : i + n])) <= 60}
    assert {(r.doc_id, r.pos, r.width, r.start, r.src) for r in registry.seg_rows(df, 2, 3, 4).collect()} == wins


def test_fold(spark):
    """Against the joins with the rule table, from words of one letter on."""
    r = random.Random(3)
    pairs = [("".join(r.choices(A.LETTERS, k=r.randint(1, 4))), "".join(r.choices(A.LETTERS, k=r.randint(1, 3)))) for _ in range(5000)]
    df = spark.createDataFrame(pairs, "a string, b string")
    want = {(x.a, x.b): (x.j, x.k) for x in boundaries.sandhi.fold(df, "a", "b", "j", "k").collect()}
    fold = registry.K.Folder(boundaries.sandhi.first_results())
    joined, k = fold(*(registry.K.pa.array(x) for x in zip(*pairs, strict=True)))
    assert [want[p] for p in pairs] == list(zip(joined.to_pylist(), fold.name.take(registry.K.pa.array(k)).to_pylist(), strict=True))


def test_rarest(spark):
    """The same words whether all, some or none of the lexicon are looked up without a shuffle; held words too."""
    docs = registry.table(spark, SF, "documents")
    w = docs.select("doc_id", F.explode(F.split("text", " ")).alias("word")).filter("length(word) >= 3").distinct().cache()
    lex = w.groupBy("word").agg(F.count("*").alias("freq")).cache()
    want = w.join(lex, "word").groupBy("doc_id").agg(F.min(F.struct("freq", -F.length("word"), "word")).alias("m"))
    want = {r.doc_id: r.m.word for r in want.collect()}
    for head in (0, 50, 10**6):
        assert {r.doc_id: r.m.word for r in registry._rarest(w, lex, head).collect()} == want
    held = lex.filter("freq = 1").select(F.col("word").alias("held"))
    assert len({registry._with_held(w, held, most).filter("held is not null").count() for most in (0, 10**6)}) == 1
