"""Pieces of DuckDB SQL that say the same as the column functions."""

from __future__ import annotations

import re

from ..functions import alphabet as A
from ..sources.meters import GANAS, ROWS
from ..sources.rules import RULES


def q(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def mapping(table: dict[str, str]) -> str:
    return f"MAP {{{', '.join(f'{q(k)}: {q(v) if isinstance(v, str) else v}' for k, v in table.items())}}}"


def alternatives(tokens) -> str:
    return "|".join(re.sub(r"([^\w<>])", r"\\\1", t) for t in sorted(tokens, key=lambda t: -len(t)))


_ROMAN = mapping(A.ROMAN | {b: "\n" for b in A.BREAKS} | {"\n": "\n"})
_TOKEN = f"(?s){alternatives(k for k in A.ROMAN if len(k) == 2)}|."
HEAVY = f"^[{A.LONG_VOWELS}]|^.'*[MH]|^.[^{A.CONSONANTS}]*[{A.CONSONANTS}][^{A.CONSONANTS}]*[{A.CONSONANTS}]"
UNIT = f"[{A.VOWELS}][^{A.VOWELS}]*"


def norm(x: str) -> str:
    return f"array_to_string(list_filter(list_transform(string_split({x}, chr(10)), lambda l: trim(regexp_replace(l, '\\s+', ' ', 'g'))), lambda l: l <> ''), chr(10))"


def roman(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all(lower({x}), {q(_TOKEN)}), lambda t: coalesce(map_extract_value({_ROMAN}, t), ' ')), '')"


def is_phonemes(x: str) -> str:
    bare = f"regexp_replace({x}, '[\\s|।॥]', '', 'g')"
    return f"(regexp_matches({bare}, {q(f'^[{A.LETTERS}]+$')}) AND regexp_matches({bare}, '[A-Z]'))"


def phonemes(x: str) -> str:
    """For text without native script."""
    return norm(f"CASE WHEN {is_phonemes(x)} THEN regexp_replace({x}, '[|।॥]', chr(10), 'g') ELSE {roman(x)} END")


def weights(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, {q(UNIT)}), lambda u: CASE WHEN regexp_matches(u, {q(HEAVY)}) THEN 'G' ELSE 'L' END), '')"


def lines(table: str, key: str, text: str = "text") -> str:
    """CTEs ``lines``: key columns, pos from 0, line."""
    return f"""slp AS (SELECT {key}, string_split({phonemes(f"coalesce({text}, '')")}, chr(10)) AS ls FROM {table}),
lines AS (SELECT * FROM (SELECT {key}, i - 1 AS pos, ls[i] AS line FROM (SELECT {key}, ls, unnest(range(1, len(ls) + 1)) AS i FROM slp)) WHERE line <> '')"""


def words(table: str, key: str, text: str = "text") -> str:
    """CTEs ``lines`` and ``words``: key columns, pos, wpos from 0, word."""
    return lines(table, key, text) + f""",
words AS (SELECT {key}, pos, i - 1 AS wpos, ws[i] AS word FROM (SELECT {key}, pos, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT {key}, pos, string_split(line, ' ') AS ws FROM lines)))"""


def values(name: str, columns: str, rows) -> str:
    body = ", ".join("(" + ", ".join(q(x) if isinstance(x, str) or x is None else str(x).lower() if isinstance(x, bool) else str(x) for x in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def meters() -> str:
    return values("meters", "ord, name, groups, pattern", ROWS)


def rules() -> str:
    return values("rules", "ord, first, second, result, category", RULES)


def ganas() -> dict[str, str]:
    return GANAS


def distance(w: str, p: str) -> str:
    n = f"least(length({w}), length({p}))"
    upto = f"(CASE WHEN length({w}) = length({p}) THEN {n} - 1 ELSE {n} END)"
    return f"(abs(length({w}) - length({p})) + len(list_filter(range(1, {upto} + 1), lambda i: substr({w}, i, 1) <> substr({p}, i, 1))))"


def joined() -> str:
    """CTE ``j``: a, b, joined, category, o, best for CTE ``pairs`` (a, b) and ``rules``."""
    return """hit AS (SELECT a, b, ord, result, category, first, second, length(first) AS k FROM pairs JOIN rules ON second <> '' AND ends_with(a, first) AND left(b, 1) = second),
top AS (SELECT a, b, max(k) AS k FROM hit GROUP BY a, b),
j AS (
  SELECT a, b, joined, category, row_number() OVER (PARTITION BY a, b ORDER BY o, joined) AS cand FROM (
    SELECT a, b, left(a, length(a) - length(first)) || result || substr(b, 2) AS joined, category, min(ord) AS o FROM hit JOIN top USING (a, b, k) GROUP BY ALL
    UNION ALL SELECT a, b, a || b, 'no-sandhi', 0 FROM pairs ANTI JOIN top USING (a, b)))"""
