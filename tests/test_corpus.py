"""Script forms, golden verses, covers with unknown spans, written tables, the analyzer."""

import itertools
import math

from lexiloom.functions import alphabet as A
from lexiloom.functions import text as X
from lexiloom.operators import sandhi
from lexiloom.plans import corpus, registry
from lexiloom.sources import readers
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
RULES = [(f, s, r) for _, f, s, r, _ in sandhi.RULES]


def test_candrabindu_and_decomposed(spark):
    rows = {r["id"]: r for r in corpus.translit_forms(spark, SF).collect()}
    assert rows[2]["phonemes"] == "haMsa cAMda" and rows[2]["w"] == "GLGL"
    assert rows[9]["phonemes"].startswith(rows[8]["phonemes"])


def test_golden(spark):
    got = corpus.golden_verses(spark, SF).collect()
    assert len(got) == 21 and all(r["right_one"] for r in got)
    assert {r["id"] for r in corpus.golden_upajati(spark, SF).collect()} == {7, 8}
    differ = {r["id"] for r in corpus.meter_cross_check(spark, SF).collect() if not r["agrees"]}
    assert differ == set(corpus.KNOWN)


def test_bare_roots(spark):
    want = {"o~hA\\k": "hA", "GuRa~": "GuR", "qukf\\Y": "kf", "qupaca~^z": "pac", "BU": "BU", "gamx~": "gam"}
    got = {r["f"]: r["r"] for r in spark.createDataFrame([(k,) for k in want], "f string").select("f", X.bare_root(F.col("f")).alias("r")).collect()}
    assert got == want


def brute_covers(src, lex, penalty=1.0):
    """All covers by trying every cut, verbatim or through any rule."""
    out = {}

    def go(at, pend, score, ws):
        if at == len(src) and not pend:
            out[tuple(ws)] = max(score, out.get(tuple(ws), -math.inf))
            return
        for to in range(at, len(src) + 1):
            w = pend + src[at:to]
            if to > at and w in lex:
                go(to, "", score + lex[w], [*ws, w])
            for f, s, r in RULES:
                r = r.replace(" ", "")
                if r and r != f + s and src.startswith(r, to):
                    full = w + f
                    full = full if full in lex else (full[:-1] + "H" if full[-1] in "sr" else full)
                    if full in lex:
                        go(to + len(r), s, score + lex[full] - penalty, [*ws, full])

    go(0, "", 0.0, [])
    return out


def test_kbest_brute():
    lex = {w: -k / 3 - 1 for k, w in enumerate(["ab", "cd", "efghi", "abcdefghi", "X", "tat", "hitam", "ta", "d", "Ditam", "rAmas", "rAmaH", "asti", "deva", "indra"])}
    for src in ("abcdefghiX", "tadDitam", "rAmo'sti", "devendra", "tatrAmaH", "zzz"):
        want = brute_covers(src, lex)
        got = {tuple(ws): sc for sc, ws in sandhi.kbest(src, lex, RULES, k=50)}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got), src


def test_kbest_options():
    lex = {"tam": -1.0, "ca": -1.0}
    assert sandhi.kbest("tanca", lex, []) == [] and sandhi.kbest("tanca", lex, [], nasals=True)[0][1] == ["tam", "ca"]
    assert sandhi.kbest("qqq", lex, []) == [] and sandhi.kbest("qqq", lex, [], unknown=-5.0) == [(-15.0, ["qqq"])]


def test_reachable(spark):
    """The lexicon without the words that no source can ask for gives the same covers."""
    words = ["".join(p) for n in (1, 2, 3) for p in itertools.product("adtsHr", repeat=n)]
    lex = {w: -1.0 - k / 100 for k, w in enumerate(words)}
    sources = ["tatas", "dadrata", "sardH"]
    kept = {r["pada"] for r in sandhi.reachable(spark.createDataFrame([(w,) for w in words] + [("zzzz",), ("kkkkkk",)], "pada string"), spark.createDataFrame([(s,) for s in sources], "src string")).collect()}
    assert not kept & {"zzzz", "kkkkkk"}
    for s in sources:
        assert sandhi.kbest(s, {w: v for w, v in lex.items() if w in kept}, RULES) == sandhi.kbest(s, lex, RULES)


def test_written_tables(spark, tmp_path):
    built = []
    build = lambda: built.append(1) or spark.range(3)
    for rebuild in (False, False, True):
        assert readers.cached(spark, str(tmp_path / "t"), build, rebuild).count() == 3
    assert len(built) == 2
    readers.write_vocabulary(spark, A.VOCABULARY, str(tmp_path / "v"))
    assert readers.vocabulary(spark, str(tmp_path / "v")) == A.VOCABULARY
    corpus.write_prepared(spark, SF, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p" / "examples")).count() == corpus.prepared(spark, SF).count()
    assert spark.read.json(str(tmp_path / "p" / "meta")).first()["block_size"] == corpus.BLOCK


def test_analyzer(spark):
    """Known splits win with a lexicon that has their words."""
    lex = spark.createDataFrame([("rAmas", 50), ("asti", 40), ("tat", 1137), ("hitam", 74), ("tadDi", 4), ("tam", 687), ("sUrya", 60), ("udayaH", 60)], "pada string, freq long")
    texts = spark.createDataFrame([("rAmo'sti",), ("tadDitam",), ("sUryodayaH",)], "text string")
    best = {r["text"]: r["padas"] for r in corpus.ranked(spark, texts, lex, registry.trigram_counts(spark, SF)).filter("rank = 1").collect()}
    assert best == {"rAmo'sti": "rAmas|asti", "tadDitam": "tat|hitam", "sUryodayaH": "sUrya|udayaH"}
