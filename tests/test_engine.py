import json

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import alphabet as A
from lexiloom.functions import text as X
from lexiloom.operators import prosody, sandhi
from lexiloom.sources import readers
from lexiloom.sources.meters import GANAS, ROWS
from lexiloom.sources.rules import RULES
from lexiloom.streaming import weighted_lines


def one(spark, fn, *texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r[0] for r in rows.orderBy("k").select(fn(F.col("t"))).collect()]


def test_scripts(spark):
    assert one(spark, X.to_phonemes, "dharmakṣetre  kurukṣetre |x", "धर्मक्षेत्रे कुरुक्षेत्रे", "rAmaH", "", "rāmo'sti", "a\n\n b")[:6] == ["Darmakzetre kurukzetre", "Darmakzetre kurukzetre", "rAmaH", "", "rAmo'sti", "a\nb"]


def test_syllables(spark):
    assert one(spark, lambda c: F.array_join(X.syllables(c), "-"), "rAmasya", "kt", "", "asti") == ["rAm-asy-a", "kt", "", "ast-i"]
    assert one(spark, X.weights, "rAmasya", "Darmakzetre", "k", "", "taM ca") == ["GGL", "GGGG", "", "", "GL"]
    assert one(spark, X.pausa, "rAmas", "punar", "deva") == ["rAmaH", "punaH", "deva"]
    assert one(spark, X.decompose, "GGGLL", "LGG", "") == ["ma-la-la", "ya", ""]


@pytest.mark.parametrize(("a", "b", "n"), [("LG", "LL", 0), ("LGL", "LG", 1), ("", "LGL", 3), ("GG", "LGL", 2), ("L", "G", 0), ("", "", 0)])
def test_distance(spark, a, b, n):
    assert spark.range(1).select(X.distance(F.lit(a), F.lit(b))).first()[0] == n


def test_identify(spark):
    """Against the distance of places, for lines shorter and longer than any quarter."""
    assert max(len(p) for r in ROWS for p in r[3].split("/")) < prosody.BITS
    lines = ["", "L", "G", "GGLGGLLGLGG", "LGLGGLLGLGG", "GGLGGLLGLGL", "G" * 47, "LG" * 24, "GL" * 300]

    def distance(w, p):
        n = min(len(w), len(p)) - (len(w) == len(p))
        return abs(len(w) - len(p)) + sum(w[k] != p[k] for k in range(n))

    df = spark.createDataFrame(list(enumerate(lines)), "id int, w string")
    got = [[(r["distance"], r["name"]) for r in prosody.identify(df, ["id"], 145).filter(F.col("id") == k).orderBy("rank").collect()] for k in range(len(lines))]
    for w, found in zip(lines, got, strict=True):
        assert found == [x[:2] for x in sorted((min(distance(w, p) for p in ps.split("/")), n, k) for k, n, _, ps in ROWS)]


def test_meter_table():
    assert len(ROWS) == 145 and sum("/" in r[3] for r in ROWS) == 21
    assert all("".join(GANAS[g] for q in groups.split("/") for g in q.split("-")) == p.replace("/", "") for _, _, groups, p in ROWS)


VERSES = {
    "dharmakṣetre kurukṣetre samavetā yuyutsavaḥ\nmāmakāḥ pāṇḍavāścaiva kimakurvata sañjaya": "anuṣṭubh",
    "kaścitkāntāvirahaguruṇā svādhikārātpramattaḥ\nśāpenāstaṃgamitamahimā varṣabhogyeṇa bhartuḥ\nyakṣaścakre janakatanayāsnānapuṇyodakeṣu\nsnigdhacchāyātaruṣu vasatiṃ rāmagiryāśrameṣu": "mandākrāntā",
    "astyuttarasyāṃ diśi devatātmā himālayo nāma nagādhirājaḥ": None,
    "": None, "   ": None, "12345": None, "k\nt": None, "ka ka ka ka ka": None,
}


def test_verses(spark):
    rows = spark.createDataFrame(list(enumerate(VERSES)), "id int, text string")
    found = {r["id"]: r["meter_name"] for r in prosody.scan(rows).collect()}
    assert [found[k] for k in range(len(VERSES))] == list(VERSES.values())


@pytest.mark.parametrize(("a", "b", "joined"), [("rAma", "asti", "rAmAsti"), ("tat", "hitam", "tadDitam"), ("deva", "indra", "devendra"), ("gaNgA", "udakam", "gaNgodakam"), ("rAmas", "asti", "rAmo'sti"), ("iti", "aham", "ityaham")])
def test_join(spark, a, b, joined):
    row = sandhi.join(spark.createDataFrame([(a, b)], "a string, b string")).filter("cand = 1").first()
    assert row["joined"].replace(" ", "") == joined


@pytest.mark.parametrize(("text", "padas"), [("rAmo'sti", ["rAmas", "asti"]), ("sUryodayaH", ["sUrya", "udayaH"]), ("tadDitam", ["tat", "hitam"]), ("gaNgodakam", ["gaNgA", "udakam"])])
def test_split(text, padas):
    table = [(f, s, r) for _, f, s, r, _ in RULES]
    assert padas in sandhi.split_all(text, table, most=5000)


def test_kbest():
    lex = {w: -1.0 for w in ("ab", "cd", "efghi", "X")} | {"abcdefghi": -9.0}
    best = sandhi.kbest("abcdefghiX", lex, [])
    assert [w for _, w in best] == [["ab", "cd", "efghi", "X"], ["abcdefghi", "X"]] and best[0][0] > best[1][0]
    assert sandhi.kbest("qqqq", lex, []) == []
    table = [(f, s, r) for _, f, s, r, _ in RULES]
    assert sandhi.kbest("rAmo'sti", {"rAmaH": -1.0, "asti": -1.0}, table)[0][1] == ["rAmaH", "asti"]


def test_tokens(spark):
    assert len(A.VOCABULARY) == 124
    text = "<sandhi>rAma<sep>asti"
    assert one(spark, lambda c: X.decode(X.encode(c), skip_core=False), text, "€") == [text, "<unk>"]
    ids, start = X.encode_example(F.col("a"), F.col("b"))
    row = spark.createDataFrame([("ka", "kA")], "a string, b string").select(ids.alias("i"), start.alias("s")).first()
    assert len(row["i"]) == 7 and row["s"] == 4


def test_mask(spark):
    src, tgt = X.mask_span(F.col("t"), "7")
    row = spark.createDataFrame([("abcdefghijklmnopqrst",)], "t string").select(src.alias("s"), tgt.alias("t")).first()
    assert len(row["t"]) == 3 and row["s"].replace("[MASK_0]", row["t"]) == "abcdefghijklmnopqrst"


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ord,first,second,result,category\n1,s,,H,\n")
    assert readers.csv(spark, str(tmp_path / "a.csv"), readers.RULE).first()["second"] == ""
    (tmp_path / "t").mkdir()
    for n in "ba":
        (tmp_path / "t" / f"{n}.txt").write_text(f"x::{n}\n")
    rows = readers.text_lines(spark, str(tmp_path / "t"), limit_files=1).select(readers.last_field()).collect()
    assert [r[0] for r in rows] == ["a"]
    (tmp_path / "n.json").write_text(json.dumps({"sections": [{"blocks": [{"content": "k"}, {}]}, {}]}))
    assert sorted(r[0] for r in readers.nested_lines(spark, str(tmp_path / "n.json")).collect()) == ["", "", "k"]
    ex = spark.createDataFrame([("seg", "a", "b", "p")], readers.EXAMPLE)
    readers.write_json(ex, str(tmp_path / "x"))
    assert readers.examples(spark, str(tmp_path / "x")).collect() == ex.collect()


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "rāmaḥ\nasti")], "id int, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, text string").parquet(str(tmp_path / "in"))
    q = weighted_lines(stream, "id").writeStream.format("memory").queryName("lines").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [r["w"] for r in spark.sql("select * from lines order by pos").collect()] == ["GG", "GL"]


def test_prune(spark):
    """Against a search over all covers: fused words go, those with an unknown rest or a rare part stay."""
    from lexiloom.operators import lexicon

    lex = {"rama": 60, "gacchati": 70, "ramagacchati": 2, "ramagacchatix": 2, "gacchatirama": 11, "vanamrama": 3, "vanam": 49, "a": 500, "aaaaaaaa": 5, "aaaaaaab": 5, "rama" * 40: 1, "short": 1, "gacchatigacchati": 10}

    def covered(w, at=0):
        return at == len(w) or any(lex.get(w[at:e], 0) >= 50 and w[at:e] != w and covered(w, e) for e in range(at + 1, min(len(w), at + 30) + 1))

    got = lexicon.prune(spark.createDataFrame(list(lex.items()), "pada string, freq long"))
    assert {r["pada"] for r in got.collect()} == {w for w, n in lex.items() if n > 10 or len(w) < 8 or not covered(w)}
    assert lexicon.prune(spark.createDataFrame([], "pada string, freq long")).count() == 0


def every_split(text, table):
    """All word sequences, by a plain search: words, fewest plain letters."""
    found = {}

    def go(at, word, done, plain):
        if at == len(text):
            if word:
                found[(*done, word)] = min(plain, found.get((*done, word), plain))
            return
        go(at + 1, word + text[at], done, plain + 1)
        for f, s, r in table:
            r = r.replace(" ", "")
            if text.startswith(r, at):
                go(at + len(r), s, (*done, word + f), plain)

    go(0, "", (), 0)
    return [list(p) for p in sorted(found, key=lambda p: (len(p), found[p], p))]


@pytest.mark.parametrize("text", ["rAmo'", "devI", "asti", "q", "eva"])
@pytest.mark.parametrize("most", [1, 20, 300])
def test_split_against_search(text, most):
    table = [(f, s, r) for _, f, s, r, _ in RULES]
    assert sandhi.split_all(text, table, most) == every_split(text, table)[:most]


def test_long_split():
    table = [(f, s, r) for _, f, s, r, _ in RULES]
    best = sandhi.split_all("rAmagacchativanam" * 12, table)
    assert len(best) == 20 and len({tuple(p) for p in best}) == 20
    assert sandhi.split_all("", table) == [[""]]


def test_fold(spark):
    """The first candidate of join, for sides of any length and blanks inside."""
    pairs = [(a, b) for a in ("rAma", "tat", "rAmas", "a", "s", "A", "y i", "deva", "kavis", "x", "q") for b in ("asti", "hitam", "indra", "r", "a", "q")]
    df = spark.createDataFrame(pairs, "a string, b string")
    first = {(r["a"], r["b"]): (r["joined"], r["category"]) for r in sandhi.join(df).filter("cand = 1").collect()}
    assert {(r["a"], r["b"]): (r["joined"], r["category"]) for r in sandhi.fold(df, "a", "b", "joined", "category").collect()} == first


@pytest.mark.parametrize(("padas", "text", "yes"), [(["rAmaH", "asti"], "rAmo'sti", True), (["rAma", "asti"], "rAmAsti", True), (["rAma", "asti"], "rAmaasti", False), (["tat", "hitam"], "tadDitam", True), (["deva"], "deva", True), (["rAmaH", "asti", "iti"], "rAmo'stIti", True), (["x"], "y", False)])
def test_rederives(padas, text, yes):
    assert sandhi.rederives(padas, text, sandhi.results()) is yes


def test_reports(spark):
    from lexiloom.plans import boundaries

    gold = spark.createDataFrame([("ab", "a|b", True), ("cd", "c|e", False), ("q", "q|r", True)], "src string, gold string, zero boolean")
    splits = spark.createDataFrame([("ab", 1, "ab"), ("ab", 2, "a|b"), ("cd", 1, "cd"), ("q", 1, "q"), ("other", 1, "a|b")], "word string, cand long, padas string")
    rows = boundaries.pool_report(gold, splits).orderBy("zero").collect()
    assert [tuple(r) for r in rows] == [(False, 1, 0, 1, 1.0), (True, 2, 1, 1, 1.5)]
    covers = spark.createDataFrame([("ab", 1, "a|b", "lexicon", True), ("ab", 2, "ab", "lexicon", True), ("cd", 1, "c|dxxxxxxxxx", "lexicon", False), ("cd", 2, "c|e", "lexicon", False), ("q", 1, "q", "fallback", True)], "src string, cand long, padas string, tier string, rederivable boolean")
    rows = boundaries.error_report(gold.drop("zero"), covers).orderBy("tier", "lev").collect()
    assert [tuple(r) for r in rows] == [("fallback", 0, 1, 0, 0, 1), ("lexicon", 0, 1, 1, 1, 1), ("lexicon", 6, 1, 0, 1, 0)]
