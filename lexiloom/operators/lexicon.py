"""Lexicon pruning: rare entries that are frequent entries run together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..sources.readers import once

LONGEST = 30  # letters of a part
SHORTEST = 8  # letters of an entry that may go


#: Frequent entries whose hashes are sent to the tasks, eight bytes each; more are looked up by a join.
MOST = 8_000_000


def fused(lex: DataFrame, max_freq: int = 10, min_part: int = 50, shortest: int = SHORTEST, longest: int = LONGEST, most: int = MOST) -> DataFrame:
    """(key): sha256 of the rare entries of ``lex`` (pada, freq), a written table, that frequent entries cover from end to end.

    Hashes of the frequent entries go to the tasks, which look for a cover of each rare entry within its batch. The parts of
    the covers that they find are then looked up by an equi-join, a few for each entry; entries of which a part isn't a frequent entry after all, for
    two words with one hash, and those beyond ASCII are looked up by all their parts. An entry is no part of itself: a cover has two parts at least.
    """
    rare = lex.filter((F.col("freq") <= max_freq) & (F.char_length("pada") >= shortest)).select("pada")
    often = lex.filter((F.col("freq") >= min_part) & (F.char_length("pada") <= longest)).select(F.col("pada").alias("part"))
    if often.limit(most + 1).count() > most:
        return joined(rare, often, longest)
    hashes = lex.sparkSession.sparkContext.broadcast(often.mapInArrow(K.hashed, "h long").toArrow().column("h").to_numpy())
    plain = F.octet_length("pada") == F.char_length("pada")
    found = once(rare.filter(plain).mapInArrow(K.covers(lambda: K.Known(hashes.value), longest), "pada string, part string"), "covers")
    wrong = once(found.join(often, "part", "left_anti").select("pada").distinct(), "wrong")
    rest = once(wrong.union(rare.filter(~plain)), "rest")
    good = found.select("pada").distinct().join(wrong, "pada", "left_anti").select(F.sha2("pada", 256).alias("key"))
    return good if rest.isEmpty() else good.union(joined(rest, often, longest))


def joined(rare: DataFrame, often: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(key): sha256 of ``rare`` (pada) that ``often`` (part) covers from end to end, by all their parts.

    Every part of a rare entry, up to ``longest`` letters, is looked up by an equi-join. The hits of an entry, in order
    of their ends, are folded into the positions that a cover reaches, of which those within ``longest`` letters are held, so that
    long entries cost no more per letter than short ones.
    """
    # a row of its own for the letters, so that they aren't cut again for each position
    rare = rare.select(F.sha2("pada", 256).alias("key"), F.char_length("pada").alias("n"), F.explode(F.array(F.split("pada", ""))).alias("c"))
    heads = rare.select("key", "n", F.explode(F.expr(f"transform(sequence(0, n - 1), i -> struct(i as i, array_join(slice(c, i + 1, {longest}), '') as head))")).alias("h"))
    parts = heads.select("key", "n", "h.i", F.explode(F.expr("transform(sequence(1, length(h.head)), k -> struct(k as k, left(h.head, k) as part))")).alias("p"))
    parts = parts.select("key", "n", "i", (F.col("i") + F.col("p.k")).alias("j"), "p.part").filter("j - i < n")
    ends = parts.join(often, "part").groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("j", "i"))).alias("e"))
    reached = F.aggregate("e", F.expr("array(0)"), lambda a, e: F.when(F.array_contains(a, e["i"]), F.array_union(F.filter(a, lambda x: x >= e["j"] - longest), F.array(e["j"]))).otherwise(a))
    return ends.filter(F.array_contains(reached, F.col("n"))).select("key")


def prune(lex: DataFrame, max_freq: int = 10, min_part: int = 50) -> DataFrame:
    """``lex`` without its fused entries; parts are looked up in the lexicon as it was."""
    return lex.join(fused(lex, max_freq, min_part), F.sha2("pada", 256) == F.col("key"), "left_anti")
