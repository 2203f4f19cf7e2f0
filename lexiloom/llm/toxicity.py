"""Toxicity: a learned lexicon, misspelt terms by Levenshtein automata, and context windows.

Texts are read as one byte a character: ASCII folded to lower case, marks and blanks as they are, letters
beyond ASCII folded into 128 values, so that an edit is an edit of a letter in every script.
Words and stems whose documents are mostly toxic become the lexicon. Its trie is intersected with
Levenshtein automata (distance 1 for words of at least FUZZY_FROM letters, 0 for shorter words
and for stems) and the product is made deterministic, so that a word is looked up in one walk that most
words leave after two or three letters. Each hit is weighed by its window: hits between an opening quotation mark and
the closing one of its kind on the same line count as quotation, hits with others nearby as abuse.
A logistic regression over these counts gives the score.

The model is fitted on a bounded sample: the ``max_train`` labelled documents with the smallest md5 of their
id. All that they say is counted, however they are dealt to tasks. Scoring reads every whole text.

Defined results: null and empty texts have no hits and get the score of a text without hits. Rows
with a null label aren't learnt from; of repeated labels the largest counts. Without training rows every
score is 0. Repeated rows are scored one by one. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket, byte_view, materialize, read, slices

MAX_TRAIN = 12_000
FUZZY_FROM = 5
STEM_FROM, STEM_TO = 5, 10  # letters of a stem
MIN_TOXIC = 5  # toxic training documents with a term
MIN_RATIO = 12.0  # how much likelier toxic documents have it
WINDOW = 60  # characters on either side of a hit
N_FEATURES = 6
TASKS = 8  # that count the training sample
_LIMIT = 2 << 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
#: Code points of opening and closing quotation marks; the first pair's mark opens and closes.
QUOTES = ((0x22, 0x22), (0x201C, 0x201D), (0x201E, 0x201C), (0xAB, 0xBB), (0x2039, 0x203A))
#: First and last code points of blocks of marks beyond ASCII.
MARKS = ((0x80, 0xA9), (0xAB, 0xB4), (0xB6, 0xB9), (0xBB, 0xBF), (0x2000, 0x206F), (0x3000, 0x303F))


def symbols(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, code points, offsets) of rows of UTF-8 bytes, one of each a character."""
    head = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    code = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    out = np.where(code < 128, code, 128 + code % 128).astype(np.uint8)
    far = code >= 128
    if far.any():
        for a, b in MARKS:
            out[far & (code >= a) & (code <= b)] = 32
    return _FOLD[out], code, head[off]


def quoted(code: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each position lies between an opening mark and a closing one of its kind on its line."""
    out = np.zeros(len(at), bool)
    breaks = np.union1d(off, np.flatnonzero(code == 10))
    line = np.searchsorted(breaks, at, "right")
    begin, end = breaks[line - 1], np.append(breaks, len(code))[line]
    for left, right in QUOTES:
        a = np.concatenate([[0], np.cumsum(code == left)])
        b = np.concatenate([[0], np.cumsum(code == right)]) if left != right else a
        if a[-1] and b[-1]:
            opened = a[at] - a[begin]
            opened = opened % 2 if left == right else opened - (b[at] - b[begin])
            out |= (opened > 0) & (b[end] > b[at])
    return out


def _words(text: bytes) -> set[bytes]:
    raw = np.frombuffer(text, np.uint8)
    sym = symbols(raw, np.array([0, len(raw)]))[0]
    return set(np.where(_LETTER[sym], sym, np.uint8(32)).tobytes().split())


def _entries(found: set[bytes]) -> set[bytes]:
    """Words, and stems marked by a * at the end."""
    return found | {w[:n] + b"*" for w in found for n in range(STEM_FROM, min(len(w), STEM_TO + 1))}


def learn_terms(rows: DataFrame, n_toxic: int, n_clean: int) -> list[tuple[bytes, float]]:
    """(entry, log ratio) of the lexicon. rows: (toxic, text). What toxic documents hold is counted first, and only that in clean ones."""

    def counter(of_toxic: bool, among):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: Counter[bytes] = Counter()
            known = among.value if among else None
            for b in batches:
                for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if bool(y) == of_toxic:
                        entries = _entries(_words((text or "").encode()))
                        seen.update(entries if known is None else entries & known)
            names = list(seen)
            yield pa.RecordBatch.from_pydict({"entry": pa.array(names, pa.binary()), "n": pa.array([seen[k] for k in names], pa.int64())})

        return rows.filter("toxic > 0" if of_toxic else "toxic <= 0").mapInArrow(count, "entry binary, n long").groupBy("entry").agg(F.sum("n").alias("n"))

    least = max(MIN_TOXIC, n_toxic // 200)
    toxic = {bytes(r["entry"]): r["n"] for r in counter(True, None).filter(F.col("n") >= least).collect()}  # of the bounded sample
    among = rows.sparkSession.sparkContext.broadcast(frozenset(toxic))
    clean = {bytes(r["entry"]): r["n"] for r in counter(False, among).collect()}
    ratio = {k: (n + 0.5) / (n_toxic + 1) / ((clean.get(k, 0) + 0.5) / (n_clean + 1)) for k, n in toxic.items()}
    best = sorted((k for k, r in ratio.items() if r >= MIN_RATIO), key=lambda k: (-toxic[k] * np.log(ratio[k]), k))
    rows_found = [{"entry": k, "r": ratio[k], "t": toxic[k]} for k in best]
    found = {bytes(x["entry"]): float(np.log(x["r"])) for x in rows_found}
    docs_with = {bytes(x["entry"]): x["t"] for x in rows_found}
    # a stem of which one word has most documents says no more than the word
    forms = [k for k in found if not k.endswith(b"*")]
    main = {w[:n] for w in forms for n in range(STEM_FROM, len(w)) if docs_with[w] >= 0.7 * docs_with.get(w[:n] + b"*", 0)}
    stems = {k[:-1] for k in found if k.endswith(b"*") and k[:-1] not in main}
    short = {s for s in stems if not any(s[:n] in stems for n in range(STEM_FROM, len(s)))}
    kept = {}
    for k, r in found.items():  # in order of weight
        base = k.rstrip(b"*")
        stem_above = any(base[:n] in short for n in range(STEM_FROM, len(base) + (not k.endswith(b"*"))))
        if (k.endswith(b"*") and base in short) or (not k.endswith(b"*") and not stem_above):
            kept[k] = r
    return list(kept.items())


@dataclass
class Automaton:
    """Deterministic: next state by byte, and for each state the entry it accepts and how."""

    step: np.ndarray  # states x 256
    entry: np.ndarray  # -1: none
    fuzzy: np.ndarray
    absorbing: np.ndarray  # a stem has been read: accept whatever follows


def build(terms: list[bytes]) -> Automaton:
    """The lexicon trie intersected with the terms' Levenshtein automata, made deterministic."""
    children: list[dict[int, int]] = [{}]
    ends: list[tuple[int, bool] | None] = [None]  # (entry, stem) of a node
    reach = [0]  # longest term below a node, for which one edit is allowed
    for k, term in enumerate(terms):
        stem = term.endswith(b"*")
        word = term.rstrip(b"*")
        at = 0
        edits = 0 if stem or len(word) < FUZZY_FROM else 1
        reach[0] = max(reach[0], edits)
        for c in word:
            if c not in children[at]:
                children[at][c] = len(children)
                children.append({})
                ends.append(None)
                reach.append(0)
            at = children[at][c]
            reach[at] = max(reach[at], edits)
        ends[at] = (k, stem)

    def close(items: dict[int, int]) -> frozenset:
        """Letters of the lexicon that the text leaves out; items: node to fewest edits."""
        for node, e in list(items.items()):
            if e == 0:
                for child in children[node].values():
                    if reach[child] and items.get(child, 9) > 1:
                        items[child] = 1
        return frozenset(items.items())

    def accepts(state: frozenset) -> tuple[int, bool, bool]:
        best = (-1, False, False)
        for node, e in sorted(state, key=lambda x: x[1]):
            if ends[node] is not None and (e == 0 or not ends[node][1]):
                if e and len(terms[ends[node][0]]) < FUZZY_FROM:
                    continue
                best = (ends[node][0], e > 0, ends[node][1])
                break
        return best

    alphabet = sorted({c for t in terms for c in t.rstrip(b"*")})
    first = close({0: 0})
    ids = {frozenset(): 0, first: 1}
    queue = deque([first])
    steps = [np.zeros(256, np.int32), None]
    info = [(-1, False, False), accepts(first)]
    while queue:
        state = queue.popleft()
        row = np.zeros(256, np.int32)

        def go(c: int, state: frozenset = state) -> frozenset:
            out: dict[int, int] = {}
            for node, e in state:
                if ends[node] is not None and ends[node][1] and e == 0:
                    return state  # a stem absorbs
                if c in children[node]:
                    child = children[node][c]
                    if e <= max(reach[child], 0):
                        out[child] = min(out.get(child, 9), e)
                if e == 0 and reach[node]:
                    out[node] = min(out.get(node, 9), 1)
                    for child in children[node].values():
                        if reach[child]:
                            out[child] = min(out.get(child, 9), 1)
            return close(out)

        other = go(-1)
        for c, target in [(None, other), *((c, go(c)) for c in alphabet)]:
            if target not in ids:
                ids[target] = len(steps)
                steps.append(None)
                info.append(accepts(target))
                queue.append(target)
            if c is None:
                row[:] = ids[target]
            else:
                row[c] = ids[target]
        steps[ids[state]] = row
    return Automaton(np.array(steps, np.int32), np.array([x[0] for x in info]), np.array([x[1] for x in info]), np.array([x[2] for x in info]))


def hits(raw: np.ndarray, off: np.ndarray, auto: Automaton) -> tuple[np.ndarray, ...]:
    """(start, entry, fuzzy) of the words that the automaton accepts, and the first word of each row."""
    letter = np.append(_LETTER[raw], False)
    begin = letter[:-1].copy()
    begin[1:] &= ~letter[:-2]
    inner = off[:-1][off[:-1] < len(raw)]
    begin[inner] = letter[inner]
    starts = np.flatnonzero(begin)
    stop = letter[:-1] & ~letter[1:]
    stop[inner[inner > 0] - 1] = letter[inner[inner > 0] - 1]
    ends = np.flatnonzero(stop) + 1
    state = np.ones(len(starts), np.int32)
    live = np.arange(len(starts))
    k = 0
    while len(live):
        at = starts[live] + k
        more = at < ends[live]
        live, at = live[more], at[more]
        state[live] = auto.step[state[live], raw[at]]
        live = live[(state[live] > 0) & ~auto.absorbing[state[live]]]
        k += 1
    entry = auto.entry[state]
    at = np.flatnonzero(entry >= 0)
    return starts[at], entry[at], auto.fuzzy[state[at]], np.searchsorted(starts, off)


def features(raw: np.ndarray, off: np.ndarray, auto: Automaton, weight: np.ndarray) -> np.ndarray:
    """Rows x N_FEATURES: plain hits, misspelt hits, quoted hits, clustered hits, weight, hits by length."""
    raw, code, off = symbols(raw, off)
    at, entry, fuzzy, first = hits(raw, off, auto)
    row = np.searchsorted(off, at, "right") - 1
    cited = quoted(code, off, at)
    near = np.zeros(len(at), bool)
    close = (np.diff(at) < WINDOW) & (np.diff(row) == 0)
    near[:-1] |= close
    near[1:] |= close
    n = len(off) - 1
    total = lambda x: np.bincount(row, weights=x, minlength=n)
    plain, bad = total(~fuzzy & ~cited), total(fuzzy & ~cited)
    words = np.maximum(np.diff(first), 1)
    return np.log1p(np.stack([plain, bad, total(cited), total(near & ~cited), total(weight[entry] * ~cited), 100 * (plain + bad) / words], axis=1))


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a small penalty, by Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        w = w + np.linalg.solve(h, x.T @ (y - p) - 0.1 * w)
    return w


@dataclass
class Model:
    auto: Automaton
    weight: np.ndarray
    coef: np.ndarray


def _scan(docs: DataFrame, auto: Automaton, weight: np.ndarray, coef: np.ndarray | None, keep: list[str]) -> DataFrame:
    """``keep`` columns with the features, or with the score if ``coef`` is given."""
    shared = docs.sparkSession.sparkContext.broadcast((auto.step, auto.entry, auto.fuzzy, auto.absorbing, weight, coef))  # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *tables, weight, coef = shared.value
        auto = Automaton(*tables)
        for b in batches:
            raw, off = byte_view(b.column(b.num_columns - 1))
            parts = [features(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], auto, weight) for lo, hi in slices(off, _LIMIT)]
            x = np.concatenate(parts) if parts else np.zeros((0, N_FEATURES))
            cols = [b.column(k) for k in range(b.num_columns - 1)]
            if coef is None:
                out = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float64()))
            else:
                out = pa.array(1 / (1 + np.exp(-np.clip(x @ coef[:-1] + coef[-1], -30, 30))))
            yield pa.RecordBatch.from_arrays([*cols, out], names=[*b.schema.names[:-1], "score"])

    rows = docs.select(*keep, "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, fields + (", score double" if coef is not None else ", score array<double>"))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model | None:
    """``labels``: (doc_id, toxic) to learn from."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.md5(F.col("id").cast("string")), "id").limit(max_train)
    rows = docs.join(F.broadcast(sample), F.col("doc_id") == F.col("id")).select(F.col("toxic").cast("int").alias("toxic"), "text")  # max_train rows
    rows = materialize(rows.repartition(TASKS), "labelled")
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col("toxic") > 0).count().collect()}
    if not sizes.get(True) or not sizes.get(False):
        return None
    terms = learn_terms(rows, sizes[True], sizes[False])
    auto, weight = build([k for k, _ in terms]), np.array([r for _, r in terms] or [0.0])
    seen = _scan(rows, auto, weight, None, ["toxic"]).toPandas()  # max_train rows
    x, y = np.stack(seen["score"]), (seen["toxic"].to_numpy() > 0).astype(float)
    order = np.lexsort((*x.T, y))  # one order for any layout
    return Model(auto, weight, _fit(x[order], y[order]))


def toxicity(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """``keep`` columns with score and predicted appended."""
    rows = docs.select(*keep, F.lit(0.0).alias("score")) if model is None else _scan(docs.select(*keep, "text"), model.auto, model.weight, model.coef, keep)
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = fit(docs.select("doc_id", "text"), labels.filter(bucket(F.col("doc_id"), 5) != 0))
    return toxicity(docs.select("doc_id", (bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "text"), model, ["doc_id", "held_out"])
