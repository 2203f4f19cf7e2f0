"""Language identification as a mixture over languages.

Training counts hashed byte n-grams of labelled documents. A document is cut into blocks of
consecutive n-grams; each block has a likelihood under every language, and
expectation-maximisation gives the proportions of languages in the document. Language sets of
growing size, the most likely languages first, compete by penalised likelihood, until a larger set doesn't improve a
document's any more; the prediction is the largest share in the chosen set and the score that share.

The model is fitted on a bounded sample: of each language the training documents whose hashed id
falls below a share of ``per_lang`` / their number, which are about ``per_lang``, whole texts. Prediction reads every whole text.

Defined results: null texts and texts without a letter give ``und`` and score 0; texts shorter than
an n-gram are filled up with blanks to one, and the score is the language's share of its likelihood. Repeated rows are
predicted one by one. Without training rows every document is ``und``. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bucket, byte_view, read, slices

PER_LANG = 1500  # training documents of a language
BITS = 17  # hashed n-grams
GRAM = 4
BLOCK = 24  # n-grams of a block
ROUNDS = 12
UND = "und"
_LIMIT = 1 << 19
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _codes(raw: np.ndarray) -> np.ndarray:
    """Hashed n-gram that starts at each byte but the last GRAM - 1; digits and marks are one symbol."""
    b = _FOLD[raw].astype(np.uint32)
    letter = ((b >= 97) & (b <= 122)) | (b >= 128)
    b = np.where(letter, b, np.uint32(32))
    code = (b[:-3] << np.uint32(24)) | (b[1:-2] << np.uint32(16)) | (b[2:-1] << np.uint32(8)) | b[3:]
    return (code * np.uint32(2654435769)) >> np.uint32(32 - BITS)


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int = PER_LANG) -> tuple[list[str], np.ndarray]:
    """(languages, log-likelihood of each hashed n-gram under each language)."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), (F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)) / (1 << 30)).alias("u"))
    sizes = rows.groupBy("lang").agg((per_lang / F.count("*")).alias("part"))
    rows = rows.join(F.broadcast(sizes.withColumnRenamed("lang", "l")), F.col("lang") == F.col("l")).filter("u < part")  # a row a language

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            raw, off = byte_view(b.column(1))
            for k, lang in enumerate(b.column(0).to_pylist()):
                part = raw[off[k] : off[k + 1]]
                total.setdefault(lang, np.zeros(1 << BITS, np.int64))
                if len(part) >= GRAM:
                    total[lang] += np.bincount(_codes(part), minlength=1 << BITS)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "gram": pa.array(at, pa.int32()), "n": pa.array(n[at], pa.int64())})

    table = rows.select("lang", "text").mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(table["lang"].unique())
    counts = np.full((1 << BITS, len(langs)), 0.1)
    for k, lang in enumerate(langs):
        of = table[table["lang"] == lang]
        counts[of["gram"].to_numpy(), k] += of["n"].to_numpy()
    return langs, np.log(counts / counts.sum(axis=0)).astype(np.float32) if langs else counts.astype(np.float32)


def _blocks(raw: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods of each block, and the first block of each document with one more at the end."""
    grams = np.maximum(np.diff(off) - GRAM + 1, 0)
    per = -(-grams // BLOCK)
    first = np.concatenate([[0], np.cumsum(per)])
    starts = np.repeat(off[:-1] - first[:-1] * BLOCK, per) + np.arange(first[-1]) * BLOCK
    out = np.zeros((first[-1], table.shape[1]), np.float64)
    ends = np.minimum(starts + BLOCK, np.repeat(off[:-1] + grams, per))
    step = 20_000
    for lo in range(0, len(starts), step):
        s, e = starts[lo : lo + step], ends[lo : lo + step]
        ll = table[_codes(raw[s[0] : e[-1] + GRAM - 1])]
        inner = np.empty(2 * len(s), np.int64)
        inner[::2], inner[1::2] = s - s[0], e - s[0]
        ll = np.concatenate([ll, np.zeros((1, ll.shape[1]), np.float32)])
        out[lo : lo + step] = np.add.reduceat(ll, inner, axis=0)[::2]
    return out, first


def _letters(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Log-likelihood of an n-gram of each document if its letters were drawn one by one from its own letters, less the cost of knowing them."""
    b = _FOLD[raw].astype(np.int64)
    b[(b < 128) & ((b < 97) | (b > 122))] = 32
    n = np.diff(off)
    count = np.bincount(np.repeat(np.arange(len(n)), n) * 256 + b, minlength=len(n) * 256).reshape(-1, 256)
    size = np.maximum(n, 1)
    entropy = -(count * np.log(np.maximum(count, 1) / size[:, None])).sum(axis=1) / size
    return -GRAM * (entropy + ((count > 0).sum(axis=1) - 1) / 2 * np.log(size) / size)


def _mixtures(ll: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each document with blocks: (language index, share) by EM for the set chosen, (largest share, log-likelihood) by EM over all."""
    n_docs, k = len(first) - 1, ll.shape[1]
    per = np.diff(first)
    top = ll.max(axis=1, keepdims=True)
    lik = np.exp(np.maximum(ll - top, -60))

    def em(allowed: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares and log-likelihoods of the documents ``among``, each with its own set of languages."""
        n, take = per[among], np.repeat(np.isin(np.arange(n_docs), among), per)
        part, of = lik[take], np.repeat(np.arange(len(among)), n)
        begin = np.cumsum(n) - n
        share = allowed / allowed.sum(axis=1, keepdims=True)
        for _ in range(ROUNDS):
            r = part * share[of]
            norm = r.sum(axis=1)
            norm[norm == 0] = 1e-300
            r /= norm[:, None]
            share = np.add.reduceat(r, begin, axis=0) / n[:, None]
        r = (part * share[of]).sum(axis=1)
        return share, np.add.reduceat(np.log(np.maximum(r, 1e-300)) + top[take, 0], begin)

    live = np.arange(n_docs)
    share, total = em(np.ones((n_docs, k)), live)
    order = np.argsort(-share, axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    best, at, score = np.full(n_docs, np.inf), np.zeros(n_docs, np.int64), np.zeros(n_docs)
    for m in range(1, k + 1):
        if not len(live):
            break
        if m == 1:
            s, fit_ll = (rank < 1).astype(float), np.add.reduceat(ll, first[:-1], axis=0)[np.arange(n_docs), order[:, 0]]
        else:
            s, fit_ll = em((rank[live] < m).astype(float), live)
        cost = -2 * fit_ll + (2 * m - 1) * np.log(np.maximum(per[live], 2)) * 3
        better = cost < best[live]
        live, s, cost = live[better], s[better], cost[better]
        best[live], at[live], score[live] = cost, s.argmax(axis=1), s.max(axis=1)
    return at, score, share.max(axis=1), total


def identify(docs: DataFrame, langs: list[str], table: np.ndarray, keep: list[str], text_col: str = "text", evidence: bool = False, inside: str | None = None) -> DataFrame:
    """``keep`` columns with lang_pred and score appended (clashing names are replaced).

    ``evidence`` appends three more: _grams, the n-grams of the text; _share, the largest share of the mixture over
    all languages, which has no lower bound but 1 / their number; _gain, the nats an n-gram by which that mixture explains the text
    better than letters drawn one by one. Texts shorter than an n-gram have 0, 0.5 and 0: they tell too little to be judged.
    ``inside`` names the struct of ``keep`` that has the text, which then isn't sent to the workers a second time.
    """
    added = ["lang_pred", "score", *(["_grams", "_share", "_gain"] if evidence else [])]
    keep = [c for c in keep if c not in added]
    shared = docs.sparkSession.sparkContext.broadcast(table) if langs else None  # 2**BITS x languages floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(b.num_columns - 1) if inside is None else b.column(keep.index(inside)).field(at_text)
            raw, off = byte_view(text)
            lettered = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            pred, score = np.full(b.num_rows, -1), np.zeros(b.num_rows)
            grams, broad, gain = np.maximum(np.diff(off) - GRAM + 1, 0), np.full(b.num_rows, 0.5), np.zeros(b.num_rows)
            if langs:
                for lo, hi in slices(off, _LIMIT):
                    ll, first = _blocks(raw, off[lo : hi + 1], shared.value)
                    has = np.diff(first) > 0
                    if has.any():
                        ids, share, widest, total = _mixtures(ll, np.concatenate([first[:-1][has], first[-1:]]))
                        at = np.flatnonzero(has) + lo
                        pred[at], score[at] = ids, share
                        if evidence:
                            broad[at], gain[at] = widest, total / grams[at] - _letters(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])[has]
                bare = np.flatnonzero(lettered & (pred < 0))  # fewer bytes than an n-gram
                if len(bare):
                    filled = np.full((len(bare), GRAM), 32, np.uint8)
                    for r, k in enumerate(bare):
                        filled[r, : off[k + 1] - off[k]] = raw[off[k] : off[k + 1]]
                    odds = shared.value[_codes(filled.ravel())[::GRAM]].astype(float)
                    odds = np.exp(odds - odds.max(axis=1, keepdims=True))
                    pred[bare], score[bare] = odds.argmax(axis=1), (odds / odds.sum(axis=1, keepdims=True)).max(axis=1)
            names = np.array([*langs, UND], dtype=object)
            pred[~lettered], score[~lettered] = -1, 0.0
            cols = [b.column(k) for k in range(len(keep))]
            out = [pa.array(names[pred], pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(grams, pa.int64()), pa.array(broad), pa.array(gain)]
            yield pa.RecordBatch.from_arrays([*cols, *out[: len(added)]], names=[*b.schema.names[: len(keep)], *added])

    rows = docs.select(*keep, *([] if inside else [F.col(text_col).alias("__text")]))
    at_text = [x.lower() for x in rows.schema[inside].dataType.names].index(text_col.lower()) if inside else None
    fields = StructType(rows.schema.fields[: len(keep)]).add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(run, fields.add("_grams", "long").add("_share", "double").add("_gain", "double") if evidence else fields)


def language_id(docs: DataFrame, train: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``, learnt from ``train``."""
    langs, table = fit(train, "doc_id", "text", "lang", per_lang)
    return identify(docs.select("doc_id", (bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "text"), langs, table, ["doc_id", "held_out"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language_id(docs, docs.filter(bucket(F.col("doc_id"), 4) != 2))
