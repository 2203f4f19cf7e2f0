"""Removal of repeated byte strings by suffix arrays, built with the difference-cover algorithm.

One suffix array of all texts would sort some 5/3 of its bytes as records of 20 bytes and more. So
the text is first cut down to where a repeat can be, without loss. Anchors are the positions whose
K-byte gram has the smallest hash of a window of ``length`` bytes: two equal strings of that length
have an anchor at the same place in them. Only anchors whose hash occurs in two documents
matter; the bytes around one, its context, hold every string of that length which it anchors.
Anchors are packed, many in a row, by ranges of their hashes.
In a run or a periodic text every position may be an anchor, with the same bytes around: a document sends each of its
contexts once, with the places, so that such a text moves four bytes a place. Contexts are dealt out by anchor hash, so that all occurrences of a string meet. In each task the
contexts' suffixes are sorted by the difference-cover algorithm (sort sampled triples, recurse on their
names, merge the remaining suffixes), adjacent suffixes are compared over ``length`` bytes, and the
smallest document of each run of equal ones tells which occurrences go.

Whole copies of an earlier document are found by digest and skip all this.

Defined results: null is empty, nothing is removed from texts shorter than ``length``. Documents with the same id
don't remove each other's bytes; each row is judged by itself. Rows with a null id neither remove nor lose
anything. Repeated rows get equal results. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_view, materialize, mix64, read, slices, small

LENGTH = 50
GRAM = 20
NONE_SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # of an empty string
SHARD = 1 << 20  # bytes that one suffix array holds
_LIMIT = 1 << 20
#: Anchors that a task packs together; ranges of hashes at least, and bytes of text for each further one.
PACKED, PARTS, PART = 1 << 20, 1024, 8 << 20


# --- difference cover ---------------------------------------------------------------------------------
def _order(key: np.ndarray, most: int) -> np.ndarray:
    """Places of numbers from 0 to ``most`` in ascending order; numbers of 16 and 32 bits by their digits."""
    if most < 1 << 16:
        return np.argsort(key.astype(np.uint16), kind="stable")
    if most < 1 << 32:
        order = np.argsort((key & 0xFFFF).astype(np.uint16), kind="stable")
        return order[np.argsort((key >> 16).astype(np.uint16)[order], kind="stable")]
    return np.argsort(key)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Positions of an array of numbers from 0, in the order of the suffixes that start there."""
    s = np.asarray(s, np.int64)
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: tuple(s[i:])), np.int64)
    top = int(s.max()) + 2
    if top > 2_000_000:
        s = np.unique(s, return_inverse=True)[1].astype(np.int64)
        top = int(s.max()) + 2
    t = np.concatenate([s + 1, np.zeros(3, np.int64)])  # 0 ends the text
    extra = n % 3 == 1  # a sample at the end, so that the two halves stay apart
    sample = np.concatenate([np.arange(1, n + extra, 3), np.arange(2, n, 3)])
    pair = t[:-1] * (top + 1) + t[1:]
    if (top + 1) ** 2 * max(top + 1, n + 4) >= 1 << 63:  # a third number doesn't fit: names of pairs, in their order
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    key = pair[sample] * (top + 1) + t[sample + 2]
    order = _order(key, int(key.max()))  # ties get one name, whatever their order
    ranked = key[order]
    names = np.empty(len(sample), np.int64)
    new = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
    names[order] = new
    if new[-1] + 1 < len(sample):
        order = suffix_array(names)
        names[order] = np.arange(len(order))
    rank = np.zeros(n + 4, np.int64)  # 0: past the end
    rank[sample] = names + 1
    sa12 = sample[order]
    zero = sa12[sa12 % 3 == 1] - 1  # in the order of what follows their first number
    sa0 = zero[np.argsort(t[zero].astype(np.uint16), kind="stable") if top < 1 << 16 else np.argsort(t[zero] * (n + 4) + rank[zero + 1])]
    sa12 = sa12[sa12 < n]
    # each remaining suffix's place among the sampled ones: those of either kind are in the order of their own keys, and so are the suffixes looked up
    width = n + 4
    first = sa12 % 3 == 1
    a, b = sa12[first], sa12[~first]
    lo = np.searchsorted(t[a] * width + rank[a + 1], t[sa0] * width + rank[sa0 + 1])
    lo += np.searchsorted(pair[b] * width + rank[b + 2], pair[sa0] * width + rank[sa0 + 2])
    out = np.empty(n, np.int64)
    place = lo + np.arange(len(sa0))
    out[place] = sa0
    rest = np.ones(n, bool)
    rest[place] = False
    out[rest] = sa12
    return out


def _wide(raw: np.ndarray, n: int) -> np.ndarray:
    """The 8 bytes from each of the first n positions, as one number."""
    return np.ndarray((n,), "<u8", raw.tobytes() + bytes(8), strides=(1,))


def equal_prefixes(raw: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Group number of each start, equal where ``length`` bytes are equal: suffix array, then neighbours."""
    valid = np.zeros(len(raw), bool)
    valid[starts] = True
    sa = suffix_array(raw)
    sa = sa[valid[sa]]
    wide = _wide(raw, len(raw))
    same = np.ones(max(len(sa) - 1, 0), bool)
    for k in [*range(0, length - 7, 8), length - 8]:
        w = wide[sa + k]
        same &= w[1:] == w[:-1]
    group = np.zeros(len(raw), np.int64)
    group[sa] = np.concatenate([[0], np.cumsum(~same)]) if len(sa) else 0
    return group[starts]


# --- anchors --------------------------------------------------------------------------------------------
def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    n = len(raw) - GRAM + 1
    w = _wide(raw, len(raw))
    h = mix64(w[8 : n + 8] + np.uint64(0x9E3779B97F4A7C15)) ^ w[:n]
    return mix64(mix64(h) + w[12 : n + 12])


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best of x[i : i + width] for each i."""
    have, out = 1, x
    while 2 * have <= width:
        out = best(out[:-have], out[have:])
        have *= 2
    return best(out[: len(x) - width + 1], out[width - have : len(x) - have + 1]) if have < width else out


def anchors(raw: np.ndarray, off: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of rows that lie one after another."""
    if len(raw) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    width = length - GRAM + 1
    h = _gram_hashes(raw)
    low = _slide(h, width, np.minimum)  # of the window that starts here
    ok = np.zeros(len(low) + 1, np.int32)  # windows within one row
    a, b = off[:-1], np.maximum(off[1:] - length + 1, off[:-1])
    has = b > a
    np.add.at(ok, a[has], 1)
    np.add.at(ok, b[has], -1)
    low = np.where(np.cumsum(ok)[:-1] > 0, low, np.uint64(0))
    pad = np.zeros(width - 1, np.uint64)
    cover = _slide(np.concatenate([pad, low, pad]), width, np.maximum)[: len(h)]  # largest minimum of the windows that hold a gram
    at = np.flatnonzero((cover == h) & (h > 0))
    return at, h[at]


def _long(raw: np.ndarray, off: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, positions, hashes) by slices; a row that is longer than a slice in overlapping pieces."""
    for lo, hi in slices(off, _LIMIT):
        base, end = off[lo], off[hi]
        if hi == lo + 1 and end - base > 2 * _LIMIT:
            for s in range(int(base), int(end), _LIMIT):
                e = min(int(end), s + _LIMIT + length - 1)
                at, h = anchors(raw[s:e], np.array([0, e - s]), length)
                yield lo, hi, at + s, h  # an anchor may come twice
        else:
            at, h = anchors(raw[base:end], off[lo : hi + 1] - base, length)
            yield lo, hi, at + base, h


def _places(at: np.ndarray, first: np.ndarray) -> list[pa.Array]:
    """Of ascending groups of places, which begin at ``first``: the first place of each, and the others, null if there are none."""
    n = np.diff(np.append(first, len(at)))
    lone = n == 1
    rest = np.ones(len(at), bool)
    rest[first] = False
    edge = np.concatenate([[0], np.cumsum(n - 1)]).astype(np.int32)
    others = pa.ListArray.from_arrays(pa.array(edge), pa.array(at[rest].astype(np.int32)), mask=pa.array(lone)) if len(first) else pa.array([], pa.list_(pa.int32()))
    return [pa.array(at[first].astype(np.int32)), others]


def _twice(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether a row has a place's hash at another place, too."""
    order = np.lexsort((h, row))
    same = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    out = np.zeros(len(h), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def _occurrences(length: int, parts: int):
    """(part, h, doc, n, pos) of anchors, many in a row: bytes of their hashes, documents and numbers of places, and of the places. A part holds a range of hashes."""

    def packed(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        h, doc, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        part = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.uint16)
        order = np.argsort(part, kind="stable")  # in the order of the text within a part, which is what compresses
        part, h, doc, pos = part[order], h[order], doc[order], pos[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)  # places of one anchor that a document has again and again
        n = np.diff(np.append(first, len(h))).astype(np.uint32)
        cut = np.flatnonzero(np.diff(part)) + 1
        edge, inner = np.concatenate([[0], cut, [len(h)]]), np.concatenate([[0], np.searchsorted(first, cut), [len(first)]])
        blobs = lambda x, at: pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at * x.itemsize), pa.py_buffer(x)]).cast(pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(part[edge[:-1]].astype(np.int32)), blobs(h[first], inner), blobs(doc[first], inner), blobs(n, inner), blobs(pos, edge)], names=["part", "h", "doc", "n", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            raw, off = byte_view(b.column(1))
            for _, _, at, h in _long(raw, off, length):
                row = np.searchsorted(off, at, "right") - 1
                if len(h):
                    held.append((h, ids[row], (at - off[row]).astype(np.int32)))
                    size += len(h)
                if size >= PACKED:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows of ``_occurrences`` sorted by part: (h, doc_id, pos, rest) sorted by h, without hashes that occur once."""

    def solve(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, doc, n, pos = (np.frombuffer(b"".join(x for b in held for x in b.column(k).to_pylist()), t) for k, t in ((1, np.uint64), (2, np.int64), (3, np.uint32), (4, np.int32)))
        order = np.argsort(h)
        same = np.zeros(len(h) + 1, bool)
        same[1:-1] = h[order[1:]] == h[order[:-1]]
        order = order[same[1:] | same[:-1]]
        n, begin = n[order].astype(np.int64), np.cumsum(n, dtype=np.int64)[order] - n[order]
        first = np.cumsum(n) - n
        at = pos[np.repeat(begin - first, n) + np.arange(n.sum())]
        yield pa.RecordBatch.from_arrays([pa.array(h[order].view(np.int64)), pa.array(doc[order]), *_places(at, first)], names=["h", "doc_id", "pos", "rest"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        part = b.column(0).to_numpy()
        edge = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]) if len(part) else np.zeros(1, int)
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if held and held[-1].column(0)[0].as_py() != part[lo]:
                yield from solve(held)
                held = []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield from solve(held)


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, at) from (doc_id, pos, rest): the places of a document in one row, for so many rows as are held together."""

    def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        doc, pos = table.column("doc_id").to_numpy(), table.column("pos").to_numpy()
        n = 1 + pc.fill_null(pc.list_value_length(table.column("rest")), 0).to_numpy().astype(np.int64)
        begin = np.cumsum(n) - n
        at = np.empty(n.sum(), np.int32)
        more = np.ones(len(at), bool)
        more[begin] = False
        at[begin], at[more] = pos, np.concatenate([c.flatten().to_numpy() for c in table.column("rest").chunks])
        order = np.argsort(doc, kind="stable")
        doc, n, begin = doc[order], n[order], begin[order]
        end = np.cumsum(n)
        at = at[np.repeat(begin - end + n, n) + np.arange(len(at))]
        head = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        return pa.RecordBatch.from_arrays([pa.array(doc[head]), pa.ListArray.from_arrays(pa.array(np.append((end - n)[head], len(at)).astype(np.int32)), pa.array(at))], names=["doc_id", "at"])

    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.num_rows
        if size >= PACKED:
            yield joined(held)
            held, size = [], 0
    if held:
        yield joined(held)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by h, those whose h is in two documents. Until the second one comes, one document's rows of an h are held."""
    held: list[pa.RecordBatch] = []
    at = None  # the h that was last, its document, and whether it is repeated
    for b in batches:
        if not b.num_rows:
            continue
        h, doc = b.column(0).to_numpy(), b.column(1).to_numpy()
        cut = np.flatnonzero(h[1:] != h[:-1]) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(h)]]) - 1
        multi = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        if at is not None and at[0] == h[0]:
            multi[0] |= at[2] or at[1] != doc[0]
            if multi[0]:
                yield from held
                held = []
        if len(first) > 1 or multi[0]:
            held = []
        yield b.select(["doc_id", "pos", "rest"]).filter(pa.array(np.repeat(multi, last - first + 1)))
        if not multi[-1]:
            held.append(b.select(["doc_id", "pos", "rest"]).slice(int(first[-1])))
        at = (h[-1], doc[-1], bool(multi[-1]))


def _contexts(length: int):
    reach = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = byte_view(b.column(2))
            ids, th = b.column(0).to_numpy(), b.column(1).to_numpy()
            lists = b.column(3)
            rows = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            pos = lists.flatten().to_numpy() + off[rows]
            good = pos + GRAM <= off[rows + 1]
            rows, pos = rows[good], pos[good]
            wide = np.ndarray((max(len(raw), 1),), "<u8", raw.tobytes() + bytes(GRAM + 16), strides=(1,))
            h = mix64(mix64(mix64(wide[np.minimum(pos + 8, len(raw) - 1)] + np.uint64(0x9E3779B97F4A7C15)) ^ wide[pos]) + wide[np.minimum(pos + 12, len(raw) - 1)])
            start, end = np.maximum(pos - reach, off[rows]), np.minimum(pos + length, off[rows + 1])
            fit = end - start >= length
            rows, pos, start, end, h = rows[fit], pos[fit], start[fit], end[fit], h[fit]
            order = np.lexsort((pos, rows))
            rows, start, end, h = rows[order], start[order], end[order], h[order]
            data = raw.tobytes()
            # a context once a document, with its places: only an anchor that a document has twice needs a look
            group = np.arange(len(h))
            seen: dict[tuple[int, int, bytes], int] = {}
            for k in np.flatnonzero(_twice(h, rows)).tolist():
                group[k] = seen.setdefault((int(rows[k]), int(h[k]), data[start[k] : end[k]]), k)
            order = np.argsort(group, kind="stable")
            lead, first = np.unique(group[order], return_index=True)
            at = (start - off[rows])[order]
            edge = np.append(first, len(order))
            for k in range(0, len(lead), 50_000):
                of = lead[k : k + 50_000]
                lo, hi = edge[k], edge[min(k + 50_000, len(lead))]
                ctx = [data[a:e] for a, e in zip(start[of].tolist(), end[of].tolist(), strict=True)]
                r = rows[of]
                yield pa.RecordBatch.from_arrays([pa.array(h[of].view(np.int64)), pa.array(ctx, pa.binary()), pa.array(ids[r]), pa.array(th[r]), *_places(at[lo:hi], first[k : k + 50_000] - lo)], names=["h", "ctx", "doc_id", "th", "pos", "rest"])

    return run


def _removals(length: int):
    """Of contexts sorted by h and ctx: (doc_id, th, start, end) of bytes that a smaller document has too."""

    def solve(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        h, doc, th, start = (table.column(k).to_numpy() for k in ("h", "doc_id", "th", "pos"))
        n_rest = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(table.column("rest")), 0).to_numpy())])
        rest = np.concatenate([c.flatten().to_numpy() for c in table.column("rest").chunks])
        key = np.array([*table.column("ctx").to_pylist(), None], dtype=object)[:-1]
        width = pc.binary_length(table.column("ctx")).to_numpy()
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (key[1:] != key[:-1])
        group = np.cumsum(new) - 1
        head = np.flatnonzero(new)
        lowest = np.minimum.reduceat(doc, head)
        gh = h[head]
        # an anchor whose contexts are all equal needs no sorting: each string in it has the same documents
        first = np.ones(len(head), bool)
        first[1:] = gh[1:] != gh[:-1]
        many = np.bincount(np.cumsum(first) - 1)[np.cumsum(first) - 1] > 1
        sizes = width[head].astype(np.int64)
        n_starts = sizes - length + 1
        base = np.concatenate([[0], np.cumsum(n_starts)])
        lows = np.repeat(lowest, n_starts)
        at = np.flatnonzero(many)
        if len(at):
            # one byte between contexts; strings never reach over it, as starts are valid within a context only
            parts = b"\0".join(key[head[k]] for k in at) + b"\0"
            begin = np.concatenate([[0], np.cumsum(sizes[at] + 1)[:-1]])
            within = np.arange(n_starts[at].sum()) - np.repeat(np.cumsum(n_starts[at]) - n_starts[at], n_starts[at])
            starts = np.repeat(begin, n_starts[at]) + within
            same = equal_prefixes(np.frombuffer(parts, np.uint8), starts, length)
            best = np.full(same.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(best, same, np.repeat(lowest[at], n_starts[at]))
            lows[np.repeat(base[:-1][at], n_starts[at]) + within] = best[same]
        # each occurrence: runs of starts with a smaller document
        n = n_starts[group]
        row = np.repeat(np.arange(len(h)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        gone = lows[base[group[row]] + step] < doc[row]
        row, step = row[gone], step[gone]
        if not len(row):
            return
        cut = np.ones(len(row), bool)
        cut[1:] = (row[1:] != row[:-1]) | (step[1:] != step[:-1] + 1)
        a = np.flatnonzero(cut)
        z = np.concatenate([a[1:], [len(row)]]) - 1
        r, low, high = row[a], step[a], step[z] + length
        # every place of the context, in ascending order; ranges that meet are one
        n = 1 + np.diff(n_rest)[r]
        run = np.repeat(np.arange(len(r)), n)
        k = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        place = start[r][run].astype(np.int64)
        more = k > 0
        place[more] = rest[n_rest[r][run[more]] + k[more] - 1]
        begin, end = place + low[run], place + high[run]
        new = np.ones(len(run), bool)
        new[1:] = (run[1:] != run[:-1]) | (begin[1:] > end[:-1])
        a = np.flatnonzero(new)
        z = np.concatenate([a[1:], [len(run)]]) - 1
        yield pa.RecordBatch.from_arrays([pa.array(doc[r][run[a]]), pa.array(th[r][run[a]]), pa.array(begin[a].astype(np.int32)), pa.array(end[z].astype(np.int32))], names=["doc_id", "th", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            if size >= SHARD:
                # what belongs to the anchor that was last goes with what is held
                h = b.column(0).to_numpy()
                last = held[-1].column(0)[-1].as_py()
                k = int(np.searchsorted(h != last, True)) if h[0] == last else 0
                k = len(h) if h[-1] == last else k
                if k:
                    held.append(b.slice(0, k))
                if k < len(h):
                    yield from solve(held)
                    held, size = [b.slice(k)], b.slice(k).nbytes
                continue
            held.append(b)
            size += b.nbytes
        if held:
            yield from solve(held)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, n_removed, n_spans, kept_sha256) from text and its overlapping ranges."""
    for b in batches:
        raw, off = byte_view(b.column(2))
        removed, spans, sha = [], [], []
        for k, ranges in enumerate(b.column(3)):
            text = raw[off[k] : off[k + 1]]
            edge = np.zeros(len(text) + 1, np.int64)
            at = ranges.values
            np.add.at(edge, at.field("start").to_numpy(), 1)
            np.add.at(edge, at.field("end").to_numpy(), -1)
            gone = np.cumsum(edge)[:-1] > 0
            removed.append(int(gone.sum()))
            spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
            sha.append(hashlib.sha256(text[~gone].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "th", "n_removed", "n_spans", "kept_sha256"])


def suffix_dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row. ``length``: at least GRAM + 8."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = materialize(src.select("doc_id", F.xxhash64("text").alias("th"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "digests")
    first = rows.filter("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select(F.col("sha").alias("s"), "least")
    copies = rows.filter(F.col("n_bytes") >= length).join(first, (F.col("sha") == F.col("s")) & (F.col("doc_id") > F.col("least")), "left_semi").select("doc_id", "th")
    copies = materialize(copies.distinct(), "copies")
    lone = src.filter((F.octet_length("text") >= length) & F.col("doc_id").isNotNull()).withColumn("th", F.xxhash64("text")).join(small(copies), ["doc_id", "th"], "left_anti")

    # by ranges of hashes: a row for each range and task, or a part of it, instead of one for each anchor
    size = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    parts = min(max(PARTS, size // PART), 1 << 16)
    seen = lone.select("doc_id", "text").mapInArrow(_occurrences(length, parts), "part int, h binary, doc binary, n binary, pos binary")
    found = seen.repartition("part").sortWithinPartitions("part").mapInArrow(lambda x: _by_document(_repeated(_unpacked(x))), "doc_id long, at array<int>")
    found = materialize(found.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at")), "anchors")
    kept = lone.join(found, "doc_id").select("doc_id", "th", "text", "at")
    kept = materialize(kept.dropDuplicates(["doc_id", "th"]), "candidates")
    ctx = kept.mapInArrow(_contexts(length), "h long, ctx binary, doc_id long, th long, pos int, rest array<int>")
    gone = ctx.repartition("h").sortWithinPartitions("h", "ctx").mapInArrow(_removals(length), "doc_id long, th long, start int, end int")
    gone = materialize(gone.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "end")).alias("ranges")), "ranges")
    parts = kept.join(gone, ["doc_id", "th"]).select("doc_id", "th", "text", "ranges").mapInArrow(_cut, "doc_id long, th long, n_removed long, n_spans long, kept_sha256 string")
    parts = materialize(parts, "parts")
    whole = rows.join(copies, ["doc_id", "th"], "left_semi").select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(NONE_SHA).alias("kept_sha256"))
    rest = rows.join(copies, ["doc_id", "th"], "left_anti").join(parts, ["doc_id", "th"], "left")
    rest = rest.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
    return whole.unionByName(rest)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read(spark, sf_dir, "documents"))

#: The same for distinct ids, by all strings of LENGTH bytes; bytes are written as two hexadecimal digits.
SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS MATERIALIZED (SELECT doc_id, i, array_slice(b, i + 1, i + {LENGTH}) AS s FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) - {LENGTH - 1})) AS i FROM d)),
seen AS (SELECT s, min(doc_id) AS least FROM g GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH}, -1) AS new FROM g JOIN seen USING (s) WHERE doc_id > least),
part AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM hit),
span AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS z FROM part GROUP BY doc_id, part),
gap AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM span),
cut AS (SELECT doc_id, sum(z - a)::BIGINT AS n, count(*) AS spans, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS rest FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""
