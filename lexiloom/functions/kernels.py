"""Arrow kernels: what the column functions do a letter at a time, over the bytes of a batch at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import alphabet as A

#: Letters that are held as numbers at once, so that memory doesn't grow with the batch.
PIECE = 2 << 20
#: Pieces whose pairs of words are held together, so that a pair is sent once.
HELD = 8
_BLANK, _BREAK, _ROW = ord(" "), ord("\n"), 0
_SINGLE = {k: v for k, v in A.ROMAN.items() if len(k) == 1} | {b: "\n" for b in A.BREAKS} | {"\n": "\n"}
_SINGLE = {c: c for c in A.LETTERS if not c.islower()} | _SINGLE  # the capitals stand, as in ``text.roman_to_phonemes``
#: Letter of each code point; those beyond the table are unknown, as its last one.
_LETTER = np.full(max(map(ord, _SINGLE)) + 2, _BLANK, np.uint8)
_LETTER[[ord(k) for k in _SINGLE]] = [ord(v) for v in _SINGLE.values()]
#: What a letter gives with an h after it; 0 if nothing.
_ASPIRATE = np.zeros(len(_LETTER), np.uint8)
_ASPIRATE[[ord(k[0]) for k in A.ROMAN if k[1:] == "h"]] = [ord(v) for k, v in A.ROMAN.items() if k[1:] == "h"]
_DIPHTHONGS = [(ord(k[1]), ord(v)) for k, v in A.ROMAN.items() if len(k) == 2 and k[0] == "a"]


def bytes_of(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(off: np.ndarray, limit: int = PIECE):
    """Row ranges of at most ``limit`` bytes each, or of one row that is longer."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = min(max(int(np.searchsorted(off, off[lo] + limit, "right")) - 1, lo + 1), n)
        yield lo, hi
        lo = hi


def _letters(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Letters of all rows, a zero before each row; words and lines are parted by one blank or break."""
    if len(raw) and raw.max() > 127:
        starts = (raw & 0xC0) != 0x80
        off = np.concatenate([np.zeros(1, np.int64), np.cumsum(starts)])[off]
        code = np.minimum(np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32), len(_LETTER) - 1)
    else:
        code = raw
    at = off[:-1]
    ready = code[at] == ord("p")
    out = _LETTER[code]
    out[at] = _ROW
    nxt = code[1:]
    asp = _ASPIRATE[code[:-1]]
    asp[at[at < len(asp)]] = 0
    hit = (asp > 0) & (nxt == ord("h"))
    a = code[:-1] == ord("a")
    new = asp * hit
    for second, letter in _DIPHTHONGS:
        new[a & (nxt == second)] = letter
    if ready.any():  # rows that are letters of the encoding already
        for lo, hi in zip(at[ready], off[1:][ready], strict=True):
            out[lo + 1 : hi] = code[lo + 1 : hi]
            new[lo:hi] = 0
    hit = np.flatnonzero(new)
    out[hit] = new[hit]
    keep = np.ones(len(out), bool)
    keep[hit + 1] = False
    out = out[keep]
    # runs of blanks: a break if there is one in it, nothing at the ends of a row
    white = out <= _BLANK
    first = white.copy()
    first[1:] &= ~white[:-1]
    first = np.flatnonzero(first)
    least = np.minimum.reduceat(out, first)
    if white[-1]:
        least[-1] = _ROW
    keep = ~white | (out == _ROW)
    inner = least > _ROW
    keep[first[inner]] = True
    out[first[inner]] = least[inner]
    return out[keep]


def _strings(out: np.ndarray) -> pa.Array:
    rows = np.flatnonzero(out == _ROW)
    ends = np.append(rows[1:], len(out)) - np.arange(1, len(rows) + 1)
    return pa.Array.from_buffers(pa.string(), len(rows), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(out[out != _ROW])])


def letters(col: pa.Array):
    """(first row, letters) of pieces of a column as ``text.prepared`` gives it; null is empty."""
    raw, off = bytes_of(col.fill_null("r"))
    for lo, hi in pieces(off):
        yield lo, _letters(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])


def phonemes(col: pa.Array) -> pa.Array:
    """Texts whose first letter says what they are: r for lower-case romanisation, p for the encoding itself, lines and blanks in order."""
    out = pa.concat_arrays([pa.array([], pa.string()), *[_strings(x) for _, x in letters(col)]])
    return out if not col.null_count else pc.if_else(col.is_valid(), out, pa.scalar(None, pa.string()))


def _texts(x: np.ndarray) -> pa.Array:
    """The words of a piece alone, without their places."""
    white = x <= _BLANK
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1  # starts and ends, as a piece begins with the mark of a row
    if len(edge) % 2:
        edge = np.append(edge, len(x))
    off = np.append(0, np.cumsum(edge[1::2] - edge[::2])).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(x[~white])])


class Words:
    """The words of a piece: ``text``, ``size``, ``row``, ``line`` (a number for each line of the piece), ``pos`` of the line in its row, ``at`` in the line, from 1."""

    def __init__(self, first: int, x: np.ndarray):
        white = x <= _BLANK
        start = np.flatnonzero(white[:-1] & ~white[1:]) + 1
        gone = np.cumsum(white)
        bare = x[~white]
        begin = start - gone[start]
        off = np.append(begin, len(bare)).astype(np.int32)
        self.bytes, self.off = bare, off
        self.text = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(off), pa.py_buffer(bare)])
        self.size = np.diff(off)
        row, breaks = np.cumsum(x == _ROW), np.cumsum(x == _BREAK)
        self.row = row[start] - 1
        self.pos = breaks[start] - breaks[np.flatnonzero(x == _ROW)][self.row]
        self.row += first
        self.line = row[start] + breaks[start]
        k = np.arange(len(start))
        new = np.ones(len(start), bool)
        new[1:] = self.line[1:] != self.line[:-1]
        self.at = k - np.maximum.accumulate(np.where(new, k, 0)) + 1 if len(k) else k
        self.new = new

    def windows(self, n: int) -> np.ndarray:
        """Places of the first words of all windows of ``n`` words of a line."""
        return np.flatnonzero(self.line[n - 1 :] == self.line[: len(self.line) - n + 1]) if len(self.line) >= n else np.zeros(0, np.int64)


def rows(schema: str, keys: list[str], f: Callable) -> Callable:
    """For mapInArrow: ``f`` of the words of each piece of the column ``_t`` gives (rows, columns); the keys of the rows go before them."""

    def run(batches):
        for batch in batches:
            for first, x in letters(batch.column("_t")):
                w = Words(first, x)
                for at, cols in f(w) if len(w.text) else ():
                    at = pa.array(at)
                    yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in keys], *cols], names=schema)

    return run


def windows(widths: tuple[int, ...], longest: int = 60) -> Callable:
    """(pos, width, start, src, tgt) of windows of words whose letters are ``longest`` at most."""

    def f(w):
        total = np.append(0, np.cumsum(w.size))
        for n in widths:
            i = w.windows(n)
            i = i[total[i + n] - total[i] <= longest]
            ws = [w.text.take(pa.array(i + k)) for k in range(n)]
            yield w.row[i], [pa.array(w.pos[i]), pa.array(np.full(len(i), n)), pa.array(w.at[i]), pc.binary_join_element_wise(*ws, ""), pc.binary_join_element_wise(*ws, " | ")]

    return f


def grams(batches):
    """For mapInArrow: (ctx, ch, n) of every three letters of the lines of ``_t``, two marks before each line; one table a task."""
    seen = np.zeros(1 << 21, np.int64)
    for batch in batches:
        for _, x in letters(batch.column("_t")):
            end = x <= _BREAK
            x = np.where(end, ord("^"), x).astype(np.int64)
            one, two = x[:-1], np.append(ord("^"), x[:-2])
            two = np.where(end[:-1], ord("^"), two)
            code = (two << 14 | one << 7 | x[1:])[~end[1:]]
            seen += np.bincount(code, minlength=len(seen))
    hit = np.flatnonzero(seen)
    ctx = np.stack([hit >> 14, hit >> 7 & 127], 1).astype(np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array([r.tobytes().decode() for r in ctx], pa.string()), pa.array([chr(c) for c in hit & 127], pa.string()), pa.array(seen[hit])], names=["ctx", "ch", "n"])


def counted(batches):
    """For mapInArrow: (word, n) of the words of ``_t``, a word once a batch."""
    for batch in batches:
        n = pa.chunked_array([_texts(x) for _, x in letters(batch.column("_t"))], pa.string()).value_counts()
        yield pa.RecordBatch.from_arrays([n.field("values"), n.field("counts")], names=["word", "n"])


class Folder:
    """``sandhi.fold`` over arrays. ``first``: (result, category) by both sides of a rule."""

    def __init__(self, first: dict[tuple[str, str], tuple[str, str]]):
        self.rule = np.zeros((128, 128, 128), np.int16)  # by the last two letters, the first 0 for one, and the next one
        results, names = [""], ["no-sandhi"]
        for (f, s), (r, c) in first.items():
            self.rule[ord(f[0]) if len(f) == 2 else 0, ord(f[-1]), ord(s)] = len(results)
            results.append(r)
            names.append(c)
        self.cut = np.array([0] + [len(f) for f, _ in first], np.int8)
        self.result, self.name = pa.array(results), pa.array(names)

    def __call__(self, a: pa.Array, b: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(joined, rule); no word is empty."""
        (ra, oa), (rb, ob) = bytes_of(a), bytes_of(b)
        size, last, nxt = np.diff(oa), ra[oa[1:] - 1], rb[ob[:-1]]
        k = self.rule[np.where(size > 1, ra[oa[1:] - 2], 0), last, nxt]
        k = np.where(k > 0, k, self.rule[0, last, nxt])
        cut = self.cut[k]
        # the pieces of each text lie in one buffer: head of a, result, rest of b
        (rr, orr) = bytes_of(self.result)
        src = np.concatenate([ra, rr, rb])
        tail = (k > 0).astype(np.int64)
        begin = np.stack([oa[:-1], len(ra) + orr[k], len(ra) + len(rr) + ob[:-1] + tail], 1).ravel()
        length = np.stack([size - cut, orr[k + 1] - orr[k], np.diff(ob) - tail], 1)
        return _gathered(src, begin, length.ravel(), length.sum(1)), k


def _gathered(src: np.ndarray, begin: np.ndarray, length: np.ndarray, size: np.ndarray) -> pa.Array:
    """Strings of ``size`` bytes put together from pieces of ``src``."""
    at = np.arange(length.sum()) + np.repeat(begin - np.append(0, np.cumsum(length)[:-1]), length)
    return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32)), pa.py_buffer(src[at])])


def _folded(w: Words, fold: Folder, longest: int):
    """(places, a, b, c, src, rule, rule) of all windows of three words with a surface of ``longest`` letters at most."""
    i = w.windows(3)
    a, b, c = (w.text.take(pa.array(i + k)) for k in range(3))
    ab, k1 = fold(a, b)
    abc, k2 = fold(ab, c)
    src = pc.replace_substring(abc, " ", "")
    good = pc.binary_length(src).to_numpy() <= longest
    some = pa.array(good)
    return i[good], *[x.filter(some) for x in (a, b, c, src)], k1[good], k2[good]


def folded(fold: Folder, longest: int = 60) -> Callable:
    """(pos, start, src, tgt, k1, k2, a, b, c)."""

    def f(w):
        i, a, b, c, src, k1, k2 = _folded(w, fold, longest)
        yield w.row[i], [pa.array(w.pos[i]), pa.array(w.at[i]), src, pc.binary_join_element_wise(a, b, c, " | "), fold.name.take(pa.array(k1)), fold.name.take(pa.array(k2)), a, b, c]

    return f


def mixed(fold: Folder, longest: int = 60, shortest: int = 8) -> Callable:
    """(task, n, a, b, plain) of ``_t``, for mapInArrow: counts of folded windows and of lines of ``shortest`` letters and more, and the pairs of neighbours,
    each once in HELD pieces, with whether a rule leaves them as they are."""

    def unique(pairs):
        t = pa.concat_tables(pairs).group_by(["a", "b"]).aggregate([]).combine_chunks()
        for p in t.to_batches():
            a, b = p.column("a"), p.column("b")
            joined, k = fold(a, b)
            plain = pc.and_(pa.array(k == 0), pc.equal(joined, pc.binary_join_element_wise(a, b, "")))
            yield pa.RecordBatch.from_arrays([pa.array(["sandhi"] * len(k)), pa.array(np.ones(len(k), np.int64)), a, b, plain], names=["task", "n", "a", "b", "plain"])

    def run(batches):
        seg = denoise = 0
        pairs = []
        for batch in batches:
            for first, x in letters(batch.column("_t")):
                w = Words(first, x)
                if not len(w.text):
                    continue
                seg += len(_folded(w, fold, longest)[0])
                start = np.flatnonzero(w.new)
                n = np.diff(np.append(start, len(w.size)))
                denoise += int((np.add.reduceat(w.size, start) + n - 1 >= shortest).sum())
                i = w.windows(2)
                pairs.append(pa.table({"a": w.text.take(pa.array(i)), "b": w.text.take(pa.array(i + 1))}))
                if len(pairs) == HELD:
                    yield from unique(pairs)
                    pairs = []
        if pairs:
            yield from unique(pairs)
        cols = [pa.array(["seg", "denoise"]), pa.array([seg, denoise]), pa.nulls(2, pa.string()), pa.nulls(2, pa.string()), pa.nulls(2, pa.bool_())]
        yield pa.RecordBatch.from_arrays(cols, names=["task", "n", "a", "b", "plain"])

    return run


def cleaned(w: Words):
    """(pos, n_padas, padas) of lines with two words and more that have two letters without apostrophes at their ends."""
    text = pc.ascii_trim(w.text, "'|")
    good = np.flatnonzero(pc.binary_length(text).to_numpy() >= 2)
    if not len(good):
        return
    line = w.line[good]
    first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    n = np.diff(np.append(first, len(good)))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(first, len(good)).astype(np.int32)), text.take(pa.array(good))), " ")
    some = n >= 2
    at = good[first[some]]
    yield w.row[at], [pa.array(w.pos[at]), pa.array(n[some]), joined.filter(pa.array(some))]


def _table(letters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in letters]] = True
    return out


_VOWEL, _LONG, _CONSONANT, _CODA = map(_table, (A.VOWELS, A.LONG_VOWELS, A.CONSONANTS, "MH"))


def _heavy(x: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vowels, and whether each one's syllable is heavy; syllables end before the next vowel or place of ``edge``."""
    v = np.flatnonzero(_VOWEL[x])
    stops = np.append(np.flatnonzero(_VOWEL[x] | edge), len(x))
    end = stops[np.searchsorted(stops, v, "right")]
    total = np.append(0, np.cumsum(_CONSONANT[x]))
    other = np.append(np.flatnonzero(x != ord("'")), len(x))
    after = other[np.searchsorted(other, v, "right")]
    coda = (after < end) & _CODA[np.append(x, 0)[after]]
    return v, _LONG[x[v]] | coda | (total[end] - total[v] >= 2)


def weighed(names: list[str], keys: list[str], whole: bool = False) -> Callable:
    """For mapInArrow: (keys, pos, w) of the lines of ``_t``, w having L or G for each syllable, as ``text.weights``; with ``whole`` (keys, w), the
    weights of all lines of a row one after another."""

    def run(batches):
        for batch in batches:
            for first, x in letters(batch.column("_t")):
                v, heavy = _heavy(x, x <= _BREAK)
                start = np.flatnonzero((x == _ROW) if whole else (x <= _BREAK))
                edge = np.append(start, len(x))
                off = np.searchsorted(v, edge).astype(np.int32)
                w = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(off), pa.py_buffer(np.where(heavy, ord("G"), ord("L")).astype(np.uint8))])
                row = np.cumsum(x[start] == _ROW) - 1
                k = np.arange(len(start))
                pos = k - k[x[start] == _ROW][row]
                some = np.flatnonzero(np.diff(edge) > 1)
                at = pa.array(row[some] + first)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in keys], *([] if whole else [pa.array(pos[some])]), w.take(pa.array(some))], names=names)

    return run


_BASE = 0x2545F4914F6CDD1D


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


_SALTS = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Rolling:
    """Hashes of substrings of ``raw``, all of one length at once."""

    def __init__(self, raw: np.ndarray):
        powers = lambda b: np.cumprod(np.append(np.uint64(1), np.full(len(raw), np.uint64(b), np.uint64)))
        self.down = powers(pow(_BASE, -1, 1 << 64))
        self.total = np.append(np.uint64(0), np.cumsum(_SALTS[raw] * powers(_BASE)[:-1], dtype=np.uint64))

    def __call__(self, start: np.ndarray, size) -> np.ndarray:
        return _mixed((self.total[start + size] - self.total[start]) * self.down[start] + np.asarray(size).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def hashed(batches):
    """For mapInArrow: (h) of the words of the first column."""
    for batch in batches:
        raw, off = bytes_of(batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(Rolling(raw)(off[:-1], np.diff(off)).view(np.int64))], names=["h"])


#: Bits of the table that is asked before the sorted hashes are searched.
SIEVE = 24


class Known:
    """Whether hashes are among ``hashes``."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes.view(np.uint64))
        self.sieve = np.zeros(1 << SIEVE, bool)
        self.sieve[self.sorted >> np.uint64(64 - SIEVE)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = self.sieve[h >> np.uint64(64 - SIEVE)]
        at = np.flatnonzero(out)
        if len(at):
            k = np.minimum(np.searchsorted(self.sorted, h[at]), len(self.sorted) - 1)
            out[at] = self.sorted[k] == h[at]
        return out


def covers(known: Callable[[], Known], longest: int) -> Callable:
    """For mapInArrow: (pada, part) of one cover, of the fewest parts, of every word (first column, ASCII) that words of ``known`` cover from end to end.

    Parts have ``longest`` letters at most, and no word is its own part. The positions that a cover reaches grow by one part at a time, in all words of a
    piece at once; each is extended once.
    """

    def run(batches):
        words = known()
        for batch in batches:
            raw, off = bytes_of(batch.column(0))
            for lo, hi in pieces(off, PIECE >> 2):
                yield cover(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], words)

    def cover(raw, off, words):
        n = len(off) - 1
        roll = Rolling(raw)
        size = np.diff(off)
        # a place more for each word, its end
        start = off[:-1] + np.arange(n)
        stop = start + size
        of = np.repeat(np.arange(n), size + 1)
        last = np.zeros(stop[-1] + 1, np.uint8)  # letters of the part that reaches a place first; 0 if none does
        new = start[size > 0]
        while len(new):
            reached = []
            for k in range(1, longest + 1):
                new = new[new + k <= stop[of[new]]]
                if not len(new):
                    break
                at = new[(last[new + k] == 0) & ((new != start[of[new]]) | (k != size[of[new]]))]
                at = at[words(roll(at - of[at], k))] + k
                last[at] = k
                reached.append(at)
            new = np.concatenate(reached) if reached else new
        row = np.flatnonzero((size > 0) & (last[stop] > 0))
        at = stop[row]
        rows, begins = [], []
        while len(row):
            width = last[at].astype(np.int64)
            at = at - width
            rows.append(row)
            begins.append(np.stack([at - row, width], 1))
            more = at > start[row]
            row, at = row[more], at[more]
        row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        begin, width = np.concatenate(begins).T if begins else np.zeros((2, 0), np.int64)
        whole = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])
        return pa.RecordBatch.from_arrays([whole.take(pa.array(row)), _gathered(raw, begin, width, width)], names=["pada", "part"])

    return run


def column(f: Callable, returns: str) -> Callable:
    """``f`` of an Arrow array as a function of a column."""
    from pyspark.sql import functions as F

    def run(c):
        return f(c)

    run.__annotations__ = {"c": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, returns)
