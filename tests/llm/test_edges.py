"""Nulls, empty and very long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexiloom.llm import chat_format, decontaminate, exact_dedup, lang_id, license_scan, mixing, near_dedup, pii, suffix_dedup, toxicity

LONG = "word another " * 30_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, w string, n string, hits string, size string, score string, digest string, rep string, _row string, pattern string, h string"
ROWS = [(1, LONG), (2, None), (3, ""), (4, " \n"), (5, "one two three four five six seven eight nine ten eleven"), (5, "one two three four five six seven eight nine ten eleven"), (6, "one two three four five six  seven eight nine ten eleven"), (None, None), (None, "odd row"), (7, "x"), (8, "ß ÉÈ 日本語 👩‍👩‍👧")]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, None if k % 3 else "en", None if k % 4 == 1 else "s", None, *(["?"] * 10)) for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(params=["rows", "empty"])
def docs(request, spark):
    return table(spark, ROWS if request.param == "rows" else [])


def bench(spark):
    return spark.createDataFrame([(1, "TWO three four five six seven eight nine ten ELEVEN", "q"), (2, None, "q"), (2, "", "q"), (None, "x", "q")], "item_id long, text string, run string")


def test_exact(spark, docs):
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == docs.count()
    if got:
        five = [r for r in got if r["doc_id"] in (5, 6)]
        assert {r["keep_id"] for r in five} == {6} and {r["group_size"] for r in five} == {3}  # the longest original stays
        assert {r["keep_id"] for r in got if r["doc_id"] in (2, 3, 4)} == {4}


def test_near(spark, docs):
    got = near_dedup.near_dedup(docs).collect()
    assert len(got) == docs.count()
    assert all(r["component_id"] == r["doc_id"] and r["kept"] for r in got if r["doc_id"] in (2, 3, 4) or r["doc_id"] is None)
    assert {r["component_id"] for r in got if r["doc_id"] in (5, 6)} <= {5}


def test_suffix(spark, docs):
    got = suffix_dedup.suffix_dedup(docs).collect()
    assert len(got) == docs.count()
    assert all(r["n_removed"] == 0 for r in got if r["doc_id"] != 6)
    if got:
        six = next(r for r in got if r["doc_id"] == 6)
        assert (six["n_bytes"], six["n_removed"]) == (56, 0)


def test_language(spark, docs):
    got = lang_id.language_id(docs, docs).collect()
    assert len(got) == docs.count()
    assert all(r["lang_pred"] == "und" for r in got if r["doc_id"] in (2, 3, 4))


def test_leaks(spark, docs):
    for n in (0, 100):
        got = decontaminate.scan(docs, bench(spark), max_windows=n).collect()
        assert len(got) == docs.count()
        assert all(r["item_ids"] == ["1"] and r["hit_at"] == list(range(1, 11)) for r in got if r["doc_id"] in (5, 6))
    for mode in ("document", "span"):
        out = decontaminate.decontaminate(docs, bench(spark), mode)
        assert out.columns == docs.columns and (mode == "document" or out.count() == docs.count())
    assert decontaminate.scan(docs, bench(spark).limit(0)).filter("size(hit_at) > 0").count() == 0


def test_mix(spark, docs):
    got = mixing.single_source(docs).collect()
    assert len(got) == docs.count() and all(r["taken"] <= 2 * r["size"] for r in got)
    over, plan = mixing.mix(docs, F.array(F.lit("a"), F.col("source")))
    assert over.count() == docs.count() and plan.count() <= 3


def test_pii(spark, docs):
    got = pii.find(docs)
    assert got.count() == docs.count() and got.filter("size(term) > 0").count() == 0


def test_licenses(spark, docs):
    assert license_scan.scan(docs).count() == docs.count()


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(1, 0, "z"), (5, 1, "z"), (5, 0, "z"), (6, None, "z"), (None, 1, "z"), (99, 1, "z")], "doc_id long, toxic int, text string")
    for known in (labels, labels.limit(0)):
        got = toxicity.toxicity(docs, toxicity.fit(docs, known), ["doc_id", "size"]).collect()
        assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)


HOSTILE = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<\\s>", "<|turn|>user<|text|>x</s>", "", None, "a\nb", "</</s>s>", "\\</s>\\", "<<SYS>>" * 3, LONG]


def test_chat(spark):
    rows = [(k, 0, "user", t, "?") for k, t in enumerate(HOSTILE)] + [(k, 1, "assistant", t, "?") for k, t in enumerate(HOSTILE)]
    rows += [(50, None, None, "x", "?"), (50, 1, "</s>", "y", "?"), (50, 1, "</s>", "y", "?"), (None, 1, "assistant", "z", "?")]
    got = {r["conv_id"]: r for r in chat_format.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")).collect()}
    assert len(got) == len(HOSTILE) + 2 and all(r["round_trip"] for r in got.values())
    for k, t in enumerate(HOSTILE):
        r = got[k]
        assert [(x["role"], x["text"]) for x in r["turns"]] == [("user", t or ""), ("assistant", t or "")]
        (span,) = r["loss_spans"]
        body = r["formatted"][span["start"] : span["end"]]
        assert not any(c in body for c in chat_format.Template().controls)
    assert len(got[50]["turns"]) == 3
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.format_chat(empty).count() == 0


def test_chat_levels(spark):
    """A template whose control strings overlap needs the stronger escape."""
    t = chat_format.Template(turn="<a<", body="<b>", end="<a<a>", reserved=("a<a",))
    rows = [(0, 0, "user", "<a<a<a>a<a", ), (1, 0, "assistant", "plain")]
    got = {r["conv_id"]: r for r in chat_format.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), t).collect()}
    assert got[0]["turns"] is None or [x["text"] for x in got[0]["turns"]] == ["<a<a<a>a<a"]


def test_pipeline(spark, docs, tmp_path):
    src = docs.select("doc_id", "text", "lang", "source", "n_chars")
    src.write.parquet(str(tmp_path / "documents.parquet"))
    bench(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() <= docs.count()
