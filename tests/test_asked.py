"""Frequencies of the words that the benchmark asks for, without a table of the whole lexicon."""

from collections import Counter

import pyarrow as pa
from test_kernels import SF, odd_texts

from lexiloom.functions import kernels as K
from lexiloom.plans import registry


def test_only_asked_words_are_written(spark, monkeypatch):
    sizes, once = {}, registry.once

    def counting(df, label):
        out = once(df, label)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(registry, "once", counting)
    got = {(r.item_id, r.cand): (r.n, r.oov, r.cov, r.fw) for r in registry._candidates(spark, SF).collect()}
    asked = registry.candidate_words(spark, SF).collect()
    assert max(sizes.values()) <= sum(len(r.ws) for r in asked) and sizes["asked"] <= len({w for r in asked for w in r.ws}) + 1
    lex = {r.pada: r.freq for r in registry.lexicon(spark, SF).collect()}
    assert len(lex) > sizes["asked"] and {k: v[:2] for k, v in got.items()} == {(r.item_id, r.cand): (len(r.ws), sum(w not in lex for w in r.ws)) for r in asked}
    monkeypatch.setattr(registry, "HELD", 0)  # many words: a join by a shuffle
    monkeypatch.setattr(registry._with_held, "__defaults__", (0,))
    assert {(r.item_id, r.cand): (r.n, r.oov) for r in registry._candidates(spark, SF).collect()} == {k: v[:2] for k, v in got.items()}


def test_counted():
    """Words without their places are those with them."""
    texts = pa.array(["r" + x for x in odd_texts(300) if x is not None and x.isascii()] + ["r", "p", "r \n ", "rab"])
    want = Counter(w for lo, x in K.letters(texts) for w in K.Words(lo, x).text.to_pylist())
    (out,) = K.counted([pa.RecordBatch.from_arrays([texts], names=["_t"])])
    assert dict(zip(*map(pa.Array.to_pylist, out.columns), strict=True)) == dict(want) and len(want) > 50
    for text in ("r", "rab", "rab cd "):
        assert K._texts(next(K.letters(pa.array([text])))[1]).to_pylist() == text[1:].split()
