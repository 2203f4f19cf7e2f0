"""Column functions: script, syllables, weights, tokens. All are built-in expressions, but for the Arrow kernels where it is said."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import alphabet as A
from . import kernels


def _any(tokens) -> str:
    return "|".join(re.escape(t) if not t.isalnum() else t for t in sorted(tokens, key=lambda t: -len(t)))


def lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def normalize_lines(c: Column) -> Column:
    """Collapse blanks in each line and drop empty lines."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s{2,}|[^\S ]", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def roman_to_phonemes(c: Column) -> Column:
    """Lower-case, longest key first; breaks become line ends, anything unknown a blank.

    Keys of two letters never overlap, so they are replaced one after another; their capitals can't be taken
    for input, which is lower case. One-letter keys go in a single pass, since some results are other keys.
    """
    x = F.lower(c)
    for key, value in A.ROMAN.items():
        if len(key) == 2:
            x = F.replace(x, F.lit(key), F.lit(value))
    single = {k: v for k, v in A.ROMAN.items() if len(k) == 1} | {b: "\n" for b in A.BREAKS}
    single |= {k: " " for k in A.LETTERS if k.islower() and k not in single}
    x = F.translate(x, "".join(single), "".join(single.values()))
    return F.regexp_replace(x, f"[^{A.LETTERS}\n ]", " ")  # matches are what costs, so blanks are none


def _ranges(letters) -> str:
    """A class of the letters, as ranges: one of single letters is asked letter by letter."""
    codes = sorted(map(ord, set(letters)))
    lows = [x for x in codes if x - 1 not in codes]
    return "[" + "".join(f"{chr(lo)}-{chr(next(x for x in codes if x >= lo and x + 1 not in codes))}" for lo in lows) + "]"


_NATIVE = _ranges([*A.NATIVE_VOWELS, *A.NATIVE_SIGNS, *A.NATIVE_CONSONANTS])
_MARKS = "\u0300-\u036f"


def has_native(c: Column) -> Column:
    """Whether there is a letter or vowel sign of the native script."""
    return c.rlike(_NATIVE)


def native_to_phonemes(c: Column) -> Column:
    """Consonants carry an a unless a sign or the virama follows."""
    cons = "".join(A.NATIVE_CONSONANTS)
    signs = "".join(A.NATIVE_SIGNS)
    pieces = F.regexp_extract_all(c, F.lit(f"(?s)[{cons}][{signs}{A.VIRAMA}]?|."), F.lit(0))
    table = lookup(A.NATIVE_VOWELS | A.NATIVE_SIGNS | A.NATIVE_CONSONANTS | A.NATIVE_MARKS | {b: "\n" for b in A.BREAKS} | {"\n": "\n", A.VIRAMA: ""})

    def one(p: Column) -> Column:
        head, tail = F.substring(p, 1, 1), F.substring(p, 2, 1)
        vowel = F.when(head.rlike(f"[{cons}]"), F.when(tail == "", F.lit("a")).otherwise(F.coalesce(F.try_element_at(table, tail), F.lit("")))).otherwise(F.lit(""))
        return F.concat(F.coalesce(F.try_element_at(table, head), F.when(head.rlike(r"\s"), F.lit(" ")).otherwise(F.lit(""))), vowel)

    return F.array_join(F.transform(pieces, one), "")


def is_phonemes(c: Column) -> Column:
    """Letters of the encoding only, blanks and breaks aside, and a capital among them."""
    return c.rlike(rf"\A[{A.LETTERS}\s|।॥]*+\z") & c.rlike("[A-Z]")  # the first letter beyond ends the search


def composed(c: Column) -> Column:
    """Letters that the romanisation knows, put together where they are written with combining marks; with other marks a letter is unknown."""
    x = F.lower(c)
    known = {unicodedata.normalize("NFD", key): key for key in A.ROMAN}
    for parts in sorted(known, key=len, reverse=True):  # two marks before one
        if parts != known[parts]:
            x = F.replace(x, F.lit(parts), F.lit(known[parts]))
            if len(parts) == 3 and parts[2] > "\u02ff":  # marks in the other order
                x = F.replace(x, F.lit(parts[0] + parts[2] + parts[1]), F.lit(known[parts]))
    return F.when(c.rlike(f"[{_MARKS}]"), F.regexp_replace(x, "[a-zāīūēōṛḷśṣṅñṇṭḍṃṁḥ][\u0300-\u036f]+", " ")).otherwise(c)


def _phonemes(c: Column) -> Column:
    """``to_phonemes`` by built-in expressions alone."""
    kept = F.regexp_replace(F.regexp_replace(c, "[|।॥]", "\n"), r"[^\S\n]", " ")
    return normalize_lines(F.when(has_native(c), native_to_phonemes(c)).when(is_phonemes(c), kept).otherwise(roman_to_phonemes(composed(c))))


def prepared(c: Column) -> Column:
    """What the Arrow kernels take: p and a text of the encoding, or r and lower-case romanisation without combining marks, the bulk of a corpus.

    One search tells them apart.
    """
    rare = c.rlike(f"[{_MARKS}{_NATIVE[1:-1]}]") | is_phonemes(c)
    return F.when(rare, F.concat(F.lit("p"), _phonemes(c))).otherwise(F.concat(F.lit("r"), F.lower(c)))


def to_phonemes(c: Column) -> Column:
    """Text of any script in the encoding, with lines kept."""
    return kernels.column(kernels.phonemes, "string")(prepared(c))


UNIT = f"[{A.VOWELS}][^{A.VOWELS}]*"


def syllables(c: Column) -> Column:
    """Cut before every vowel but the first; without a vowel the word is one syllable."""
    cut = F.regexp_extract_all(c, F.lit(f"^[^{A.VOWELS}]*{UNIT}|{UNIT}"), F.lit(0))
    return F.when(c.rlike(f"[{A.VOWELS}]"), cut).when(c == "", F.expr("array_repeat('', 0)")).otherwise(F.array(c))


def weights(c: Column) -> Column:
    """L or G of each syllable; codas reach across blanks."""
    heavy = lambda u: u.rlike(f"^[{A.LONG_VOWELS}]|^.'*[MH]|^.[^{A.CONSONANTS}]*[{A.CONSONANTS}][^{A.CONSONANTS}]*[{A.CONSONANTS}]")
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(UNIT), F.lit(0)), lambda u: F.when(heavy(u), "G").otherwise("L")), "")


def pausa(c: Column) -> Column:
    """Final s or r as it is heard before a pause."""
    return F.regexp_replace(c, "[sr]$", "H")


def decompose(w: Column) -> Column:
    """Weights as names of groups of three, what is left over as la and ga."""
    from ..sources.meters import GANAS

    names = lookup({v: k for k, v in GANAS.items()})
    pieces = F.regexp_extract_all(w, F.lit("[LG]{3}|[LG]"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.try_element_at(names, p)), "-")


def distance(w: Column, p: Column) -> Column:
    """Difference of lengths and of places; the last place is free where lengths are equal."""
    n = F.least(F.char_length(w), F.char_length(p))
    upto = F.when(F.char_length(w) == F.char_length(p), n - 1).otherwise(n)
    unlike = F.when(upto > 0, F.size(F.filter(F.sequence(F.lit(1), F.greatest(upto, F.lit(1))), lambda i: F.substr(w, i, F.lit(1)) != F.substr(p, i, F.lit(1))))).otherwise(0)
    return (F.abs(F.char_length(w) - F.char_length(p)) + unlike).cast("long")


def morae(w: Column) -> Column:
    return (2 * F.char_length(w) - F.char_length(F.replace(w, F.lit("G"), F.lit("")))).cast("long")


TOKEN = f"(?s){_any(A.CONTROLS)}|."


def encode(c: Column, bos: bool = False, eos: bool = False) -> Column:
    """Token ids: control tokens first, else characters; unknown ones are <unk>."""
    table = F.create_map(*[F.lit(x) for kv in A.VOCABULARY.items() for x in kv])
    ids = F.transform(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), lambda t: F.coalesce(F.try_element_at(table, t), F.lit(A.VOCABULARY["<unk>"])))
    parts = [F.array(F.lit(A.VOCABULARY["<bos>"]))] * bos + [ids] + [F.array(F.lit(A.VOCABULARY["<eos>"]))] * eos
    return F.concat(*parts) if len(parts) > 1 else ids


def decode(ids: Column, skip_core: bool = True) -> Column:
    table = F.create_map(*[F.lit(x) for t, k in A.VOCABULARY.items() if not (skip_core and t in A.CORE) for x in (k, t)])
    return F.array_join(F.transform(ids, lambda i: F.coalesce(F.try_element_at(table, i), F.lit(""))), "")


def encode_example(src: Column, tgt: Column) -> tuple[Column, Column]:
    """(ids, loss_start) of bos src sep tgt eos."""
    one = lambda t: F.array(F.lit(A.VOCABULARY[t]))
    left = encode(src)
    return F.concat(one("<bos>"), left, one("<sep>"), encode(tgt), one("<eos>")), F.size(left) + 2


def mask_span(c: Column, seed: str, rate: float = 0.15) -> tuple[Column, Column]:
    """(masked text, span): one contiguous span, placed by a hash of seed and text."""
    n = F.char_length(c)
    span = F.greatest(F.lit(2), F.bround(n * rate).cast("int"))
    at = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(seed), c)), 1, 8), 16, 10).cast("long"), (n - span + 1).cast("long")).cast("int") + 1
    return F.concat(F.substr(c, F.lit(1), at - 1), F.lit("[MASK_0]"), F.substr(c, at + span, n)), F.substr(c, at, span)


def bare_root(c: Column) -> Column:
    """A root without its markers: accents, a final consonant, vowels with a nasal mark, the syllables that open some roots."""
    x = F.regexp_replace(c, r"[\\^]", "")
    x = F.regexp_replace(F.regexp_replace(x, f"[{A.CONSONANTS}]$", ""), f"[{A.VOWELS}]~", "")
    return F.regexp_replace(x, "^(Yi|wu|qu)", "")


def clean_pada(c: Column) -> Column:
    """A word without apostrophes and bars at its ends; null if it is shorter than two letters or has anything but letters."""
    x = F.regexp_replace(c, "^['|]+|['|]+$", "")
    return F.when((F.char_length(x) >= 2) & x.rlike(f"^[{A.LETTERS}L]+$"), x)


def parts_of(c: Column) -> Column:
    """The words of a segmentation written with bars; a leading task token goes, blank parts too."""
    return F.filter(F.transform(F.split(F.regexp_replace(c, "^<seg>", ""), "[|]", -1), lambda x: F.trim(x)), lambda x: x != "")


def decode_example(ids: Column, loss_start: Column) -> tuple[Column, Column]:
    """(src, tgt) of an encoded example."""
    return decode(F.slice(ids, F.lit(2), F.greatest(loss_start - 2, F.lit(0)))), decode(F.slice(ids, loss_start + 1, F.greatest(F.size(ids) - loss_start - 1, F.lit(0))))


def field(c: Column, token: str) -> Column:
    """Text after a control token, up to the next one."""
    return F.regexp_extract(c, f"{re.escape(token)}([^<]*)", 1)
