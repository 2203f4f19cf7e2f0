"""Parts of the methods against plain versions: windows and quotation, suppression, sanitizing, mixtures, keys of rows, the pipeline's odd rows."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexiloom.llm import common, decontaminate, lang_id, license_scan, near_dedup, pii, suffix_dedup, toxicity

SF = "/root/testdata/sf0.001"


def test_running(spark):
    rng = random.Random(1)
    for n in (0, 1, 255, 256, 257, 512, 700):
        x = [rng.randrange(9) for _ in range(n)]
        total, most = spark.createDataFrame([(x,)], "x array<int>").select(common.running(F.col("x")), common.running(F.col("x"), "max")).first()
        assert total == [sum(x[:k]) for k in range(n + 1)] and most == [max([0, *x[:k]]) for k in range(n + 1)]


def test_unique_keys(spark):
    rows = [(1, "a"), (1, "b"), (1, "b"), (None, "c"), (None, "c"), (5, "d")]
    got = common.unique_keys(spark.createDataFrame(rows, "doc_id long, key string"), "doc_id", "t").select("key", "row.*").toDF("k", "i", "t").collect()
    assert sorted((r["i"] or -1, r["t"]) for r in got) == sorted((i or -1, t) for i, t in rows) and len({r["k"] for r in got}) == len(rows)
    assert [r["k"] for r in got if r["i"] == 5] == [5] and all(r["k"] > 5 for r in got if r["i"] != 5)


# --- toxicity -----------------------------------------------------------------------------------------------
def model():
    auto = toxicity.build([b"idiot", b"scum", b"trash*"])
    return auto, np.array([2.0, 3.0, 4.0])


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i, *row[1:]], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def plain_features(text):
    """The six features of a text with the terms idiot, scum and trash*, word by word."""
    low = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    letter = lambda c: "a" <= c <= "z" or ord(c) >= 128 and not any(a <= ord(c) <= b for a, b in toxicity.MARKS)
    words, k = [], 0
    while k < len(low):
        e = k
        while e < len(low) and letter(low[e]):
            e += 1
        if e > k:
            words.append((k, low[k:e]))
        k = e + 1
    hits = []
    for at, w in words:
        best = min([(0, 2)] * w.startswith("trash") + [(edits(w, t), n) for n, t in enumerate(("idiot", "scum")) if edits(w, t) <= (len(t) >= 5)], default=None)
        if best:
            hits.append((at, best[1], best[0] > 0))

    def cited(at):
        start = low.rfind("\n", 0, at) + 1
        end = low.find("\n", at)
        before, after = text[start:at], text[at : end if end >= 0 else len(text)]
        for a, b in toxicity.QUOTES:
            a, b = chr(a), chr(b)
            opened = before.count(a) % 2 if a == b else before.count(a) - before.count(b)
            if opened > 0 and b in after:
                return True
        return False

    weight = [2.0, 3.0, 4.0]
    flags = [cited(at) for at, _, _ in hits]
    near = [any(abs(at - o) < toxicity.WINDOW for j, (o, _, _) in enumerate(hits) if abs(j - i) == 1) for i, (at, _, _) in enumerate(hits)]
    free = [not q for q in flags]
    fine = sum(f and not bad for f, (_, _, bad) in zip(free, hits))
    bad = sum(f and b for f, (_, _, b) in zip(free, hits))
    return [math.log1p(x) for x in (fine, bad, sum(flags), sum(a and b for a, b in zip(near, free)), sum(weight[t] for f, (_, t, _) in zip(free, hits) if f), 100 * (fine + bad) / max(len(words), 1))]


TEXTS = [
    "noël you idiot noël", "ÜBER you idiot ÜBER", '"x you idiot x"', "he said “you idiot” to scum", "„you idiot“ trashy", "« idiot » idiot", '5" tube idiot', 'a "b" idiot "c"', '"open\nidiot" scum',
    "îdiot idıot idiots iddiot idio", "trash trashing trashé", "", "...", "scums scum SCUM", "“idiot” ‘scum’", "日本 idiot 日本語", "idiot " * 50, "“" * 3 + "idiot" + "”" * 2,
]


def test_features():
    """Windows, quotation and misspelling against plain Python; texts in one block and one by one."""
    auto, weight = model()
    raw = [t.encode() for t in TEXTS]
    off = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    got = toxicity.features(np.frombuffer(b"".join(raw), np.uint8), off, auto, weight)
    for k, t in enumerate(TEXTS):
        assert np.allclose(got[k], plain_features(t)), t
    abuse, cited = got[0], got[2]
    assert abuse[0] > 0 and abuse[2] == 0 and got[1][0] > 0 and cited[0] == 0 and cited[2] > 0


def test_same_model_for_any_layout(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    a, b = (toxicity.fit(d, labels) for d in (docs.coalesce(1), docs.repartition(13)))
    assert np.array_equal(a.auto.step, b.auto.step) and np.array_equal(a.weight, b.weight) and np.array_equal(a.coef, b.coef)


# --- licenses -----------------------------------------------------------------------------------------------
def test_suppression(spark):
    rng = random.Random(3)
    rows = []
    for k in range(60):
        hits = set()
        for _ in range(rng.randrange(0, 40)):
            s = rng.randrange(20)
            hits.add((s, s + rng.randrange(1, 12), rng.choice([10, 20, 30]), rng.randrange(6)))
        rows.append((k, [(*h, "x") for h in sorted(hits, key=lambda _: rng.random())]))
    df = spark.createDataFrame(rows, "k int, hits array<struct<start:int,end:int,priority:int,ord:int,label:string>>")
    for r in df.select("k", license_scan.survivors(F.col("hits"), [10, 20, 30]).alias("kept")).collect():
        hits = [tuple(h)[:4] for h in rows[r["k"]][1]]
        beaten = lambda h: any(g[0] <= h[0] and g[1] >= h[1] and (g[2] > h[2] or g[2] == h[2] and (g[1] - g[0] > h[1] - h[0] or g[1] - g[0] == h[1] - h[0] and g[3] < h[3])) for g in hits)
        assert sorted(tuple(h)[:4] for h in r["kept"]) == sorted(h for h in hits if not beaten(h))


def test_detections(spark):
    """All matches of all rules by plain regexes, then suppression by pairs."""
    texts = {1: "Licensed under the Apache License, Version 2.0; parts under the MIT License and GPLv3.", 2: "SPDX-License-Identifier: MIT\nCopyright (c) 2020 all rights reserved", 3: "cc by-sa 4.0 and CC BY 4.0", 4: "copyright " * 600, 5: "nothing here", 6: None}
    table = license_scan.rules()
    for r in license_scan.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        w = re.findall(common.WORD, (texts[r["doc_id"]] or "").lower())
        norm = " " + " ".join(w) + " "
        hits = [(m.start(), m.end(), p, o, label) for o, label, _, p, regex in table for m in re.finditer(regex, norm)] if w else []
        beaten = lambda h: any(g[0] <= h[0] and g[1] >= h[1] and (g[2] > h[2] or g[2] == h[2] and (g[1] - g[0] > h[1] - h[0] or g[1] - g[0] == h[1] - h[0] and g[3] < h[3])) for g in hits)
        assert sorted(tuple(h) for h in r["detections"]) == sorted(h for h in hits if not beaten(h)), r["doc_id"]


# --- personal data --------------------------------------------------------------------------------------------
def test_secrets_by_shape(spark):
    """Tokens that occur once are disclosed by their shape, where nothing names them too; copies of one document disclose nothing."""
    rng = random.Random(5)
    token = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(39)) + "a1"[rng.randrange(2)]
    rows = [(k, f"so the word{k} token = \"{token()}\" is set here") for k in range(30)] + [(100 + k, f"so the word{k} is a plain one here") for k in range(300)]
    copy = "some rare zymurgist has password: abcdefg42 in his text"
    rows += [(500 + k, copy) for k in range(20)] + [(600, "look at " + (lone := token()) + " there")]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all([len(s["text"]) for s in got[k]["term"]] == [40] for k in range(30)) and [s["text"] for s in got[600]["term"]] == [lone]
    assert not any(got[k]["term"] for k in range(100, 400)) and not any(s["text"] == "zymurgist" for s in got[500]["term"])
    assert got[600]["clean"] == "look at  there" and got[100]["clean"] == dict(rows)[100]


def test_sanitize(spark):
    rng = random.Random(6)
    rows = []
    for k in range(50):
        text = "".join(rng.choice("abcé日 ") for _ in range(rng.randrange(0, 40)))
        cols = [[(s, min(len(text), s + rng.randrange(1, 6)), "x") for s in sorted(rng.sample(range(len(text)), min(len(text), rng.randrange(0, 3))))] for _ in range(5)]
        rows.append((k, text, *cols))
    span = "array<struct<start:int,end:int,text:string>>"
    names = ["email", "ip", "card", "phone", "term"]
    df = spark.createDataFrame(rows, "k int, text string, " + ", ".join(f"{n} {span}" for n in names))
    for r in df.select("k", pii.sanitize(F.col("text"), *[F.col(n) for n in names]).alias("clean")).collect():
        _, text, *cols = rows[r["k"]]
        out, at = "", 0
        for s, e, by in sorted((s, e, "" if n == "term" else f"[{n}]") for n, col in zip(names, cols) for s, e, _ in col):
            if s >= at:
                out, at = out + text[at:s] + by, e
            else:
                at = max(at, e)
        assert r["clean"] == out + text[at:]


# --- languages ------------------------------------------------------------------------------------------------
def test_mixture_brute():
    """Sets that grow while the penalised likelihood improves, document by document, by a plain EM; four languages can be chosen."""
    rng = np.random.default_rng(2)
    blocks, first = [], [0]
    for mix in ([0], [0, 1], [2, 3, 1], [0, 1, 2, 3], [4], [3, 4]):
        for lang in mix:
            ll = rng.normal(-60, 2, (40, 5))
            ll[:, lang] += 25
            blocks.append(ll)
        first.append(first[-1] + 40 * len(mix))
    ll = np.concatenate(blocks)

    def em(part, allowed):
        share = allowed / allowed.sum()
        for _ in range(lang_id.ROUNDS):
            r = np.exp(part - part.max(axis=1, keepdims=True)) * share
            share = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
        r = np.exp(part - part.max(axis=1, keepdims=True)) * share
        return share, (np.log(r.sum(axis=1)) + part.max(axis=1)).sum()

    at, score, widest, total = lang_id._mixtures(ll, np.array(first))
    for d in range(len(first) - 1):
        part = ll[first[d] : first[d + 1]]
        share, whole = em(part, np.ones(5))
        order = np.argsort(-share, kind="stable")
        best = (np.inf, None)
        for m in range(1, 6):
            allowed = np.isin(np.arange(5), order[:m]).astype(float)
            s, fit = (allowed, part[:, order[0]].sum()) if m == 1 else em(part, allowed)
            cost = -2 * fit + (2 * m - 1) * np.log(max(len(part), 2)) * 3
            if cost >= best[0]:
                break
            best = (cost, s)
        assert at[d] == best[1].argmax() and abs(score[d] - best[1].max()) < 1e-6 and abs(widest[d] - share.max()) < 1e-6 and abs(total[d] - whole) < 1e-6
    assert score[3] < 0.3  # four languages


def test_short_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs, table = lang_id.fit(docs, "doc_id", "text", "lang")
    got = {r["k"]: r for r in lang_id.identify(spark.createDataFrame([(1, "ß"), (2, "ñ"), (3, "7")], "k int, text string"), langs, table, ["k"]).collect()}
    assert (got[1]["lang_pred"], got[2]["lang_pred"], got[3]["lang_pred"]) == ("de", "es", "und")


# --- copies ---------------------------------------------------------------------------------------------------
def test_near_shared_ids(spark):
    rows = [(1, "a b c d e f g"), (1, "k l m n o p q"), (4, "x y z u v w q"), (3, "x y z u v w q"), (3, "r s t u v w x y"), (None, "a b c d e f g"), (9, "r s t u v w x y")]
    for parts in (1, 5):
        got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["n_shingles"]) for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect())
        assert got == [(0, 0, 3), (1, 1, 3), (1, 1, 3), (3, 3, 3), (3, 3, 4), (4, 3, 3), (9, 3, 4)]


def test_near_recall(spark):
    """Pairs at 0.8 to 0.9 that are found, over many pairs: all, at the odds that the docstring states."""
    rng = random.Random(7)
    rows, k = [], 0
    for _ in range(300):
        w = [f"w{rng.randrange(10**7)}" for _ in range(120)]
        v = list(w)
        for at in rng.sample(range(10, 110, 10), 2):
            v[at] = f"v{rng.randrange(10**7)}"
        rows += [(k, " ".join(w)), (k + 1, " ".join(v))]
        k += 2
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for _, t in rows]
    linked = [i for i in range(0, k, 2) if 100 * len(sets[i] & sets[i + 1]) >= 80 * len(sets[i] | sets[i + 1])]
    assert len(linked) == 300 and all(got[i + 1] == i for i in linked)


def test_long_runs(spark):
    rows = [(0, " " * 30_000), (1, "x" + " " * 30_000), (2, "ab" * 20_000), (3, "ab" * 20_000 + "c"), (4, "abc" * 30)]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (0, 0), 1: (30_000, 1), 2: (0, 0), 3: (40_000, 1), 4: (0, 0)}


def test_span_mode(spark):
    words = "one two three four five six seven eight nine ten".split()
    items = spark.createDataFrame([(1, " ".join(words)), (2, "lone word")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Zero ONE, two three four five six seven eight nine TEN! eleven"), (2, "a lone  word here"), (3, "one two"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, items, "span").collect()}
    assert got == {1: "Zero ,         ! eleven", 2: "a    here", 3: "one two", 4: None}


# --- pipeline ---------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """The small table with null and shared ids and with columns whose names clash with the operators' own."""
    src = spark.read.parquet(f"{SF}/documents.parquet")
    long = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id >= 200 and lang = 'en' and n_chars between 2000 and 6000").orderBy("doc_id").limit(6).collect()]
    rows = [(None, long[0]), (None, long[1]), (3, long[2]), (3, long[3]), (3, long[3]), (None, None), (None, "12 34"), (None, long[0])]
    both = src.unionByName(spark.createDataFrame([(i, t, None, "src0", None) for i, t in rows], src.schema))
    for k, c in enumerate(("key", "row", "size", "taken", "score", "lang_pred", "_row", "n", "pattern", "h", "_share")):
        both = both.withColumn(c, F.lit(f"kept{k}"))
    path = tmp_path_factory.mktemp("odd")
    both.write.parquet(str(path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(path / "benchmark.parquet"))
    return str(path), long


def test_odd_rows(spark, odd):
    path, long = odd
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        docs = common.materialize(stage(spark, docs, path), name)
        counts[name] = sum(r["text"] in long for r in docs.select("text").collect())
        assert docs.count() <= before
        if name != "mix":
            assert docs.columns == columns and docs.filter("score <> 'kept4' or lang_pred <> 'kept5' or size <> 'kept2'").count() == 0
        if name == "language_id":
            assert docs.filter("text is null or text = '12 34'").count() == 0
    # of six rows with such texts, one is a repeat and one a copy under another null id
    assert counts["language_id"] == 6 and all(counts[n] == 4 for n in ("exact_dedup", "near_dedup", "decontaminate"))
    assert set(docs.columns) == {*columns, *corpus_pipeline.MIXED} and len(docs.columns) == len(set(docs.columns))
    assert docs.filter("taken <= 0 or taken > 2 * size").count() == 0


def test_empty_pipeline(spark, tmp_path):
    for n in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{n}.parquet").limit(0).write.parquet(str(tmp_path / f"{n}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
