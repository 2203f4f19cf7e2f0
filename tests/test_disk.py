"""Shuffle files and rows that a step leaves or sends."""

import random
import time

import numpy as np
import pyarrow as pa

from lexiloom.llm import common, suffix_dedup

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffled(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(k).getName() for k in range(files.size())}


def test_shuffle_files_go(spark):
    """A scratch table leaves no shuffle files, and the session's setting as it was."""
    was, before = spark.conf.get(CLEANUP, None), shuffled(spark)
    df = common.materialize(spark.range(1000).selectExpr("id % 7 as k").repartition(5, "k").groupBy("k").count(), "tidy")
    assert spark.conf.get(CLEANUP, None) == was
    for _ in range(40):
        left = {x for x in shuffled(spark) - before if x.startswith("shuffle_")}
        if not left:
            break
        time.sleep(0.25)
    assert not left and df.count() == 7


def test_anchors_are_packed(monkeypatch):
    """A row for each range of hashes, whatever the anchors; what comes out are the places of hashes that are in two documents."""
    r = random.Random(5)
    word = lambda n: "".join(r.choices("abcdefgh ", k=n))
    shared = word(300)
    texts = [word(500) + shared, shared + word(400), word(800), "ab" * 200, word(90) + "ab" * 150, word(49), ""]
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    want: dict[int, set[tuple[int, int]]] = {}
    for k, x in enumerate(raw):
        for at, h in zip(*suffix_dedup.anchors(x, np.array([0, len(x)])), strict=True):
            want.setdefault(int(h), set()).add((k, int(at)))
    want_at = {p for places in want.values() if len({k for k, _ in places}) > 1 for p in places}
    assert len(want_at) > 100
    for packed in (1 << 20, 40):
        monkeypatch.setattr(suffix_dedup, "PACKED", packed)
        batches = [pa.RecordBatch.from_pydict({"doc_id": pa.array(range(a, z), pa.int64()), "text": texts[a:z]}) for a, z in ((0, 3), (3, 7))]
        out = [b for b in suffix_dedup._occurrences(50, 4)(iter(batches)) if b.num_rows]
        assert sum(b.num_rows for b in out) <= 4 * len(out) and (packed < 100 or len(out) == 1)
        rows = pa.Table.from_batches(out).sort_by("part")
        got = [x for b in suffix_dedup._by_document(suffix_dedup._repeated(suffix_dedup._unpacked(iter(rows.to_batches(3))))) for x in b.to_pylist()]
        assert {(x["doc_id"], at) for x in got for at in x["at"]} == want_at
        assert packed < 100 or len(got) == len({x["doc_id"] for x in got})
