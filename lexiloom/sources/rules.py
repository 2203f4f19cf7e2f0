"""The junction rules, generated class by class from their phonological definition."""

from __future__ import annotations

from ..functions.alphabet import CONSONANTS, VOICED, VOWELS

V12 = "aAiIuUfFeEoO"
FAMILIES = ("aA", "iI", "uU", "fF")


def _rules():
    for family in FAMILIES:
        for a in family:
            for b in family:
                yield a, b, family[1], "savarna-dirgha"
    guna = {"i": "e", "I": "e", "u": "o", "U": "o", "f": "ar", "F": "ar", "x": "al", "X": "al"}
    for a in "aA":
        for b, r in guna.items():
            yield a, b, r, "guna"
    for a in "aA":
        for b, r in {"e": "E", "E": "E", "o": "O", "O": "O"}.items():
            yield a, b, r, "vrddhi"
    glide = {"i": "y", "I": "y", "u": "v", "U": "v", "f": "r", "F": "r"}
    for a, g in glide.items():
        for b in VOWELS:
            if not any(a in f and b in f for f in FAMILIES):
                yield a, b, f"{g} {b}", "yan"
    for b in VOWELS:
        if b != "a":
            yield "e", b, f"a {b}", "ayadi-lopa"
        yield "E", b, f"A {b}", "ayadi-lopa"
        yield "O", b, f"Av {b}", "ayadi"
    yield "e", "a", "e '", "purvarupa"
    yield "o", "a", "o '", "purvarupa"
    yield "as", "a", "o '", "utva"
    for b in VOICED:
        yield "as", b, f"o {b}", "utva"
    for b in VOWELS:
        if b != "a":
            yield "as", b, f"a {b}", "visarga-lopa"
    for b in VOWELS + VOICED:
        yield "As", b, f"A {b}", "visarga-lopa"
    for v in V12[2:]:
        for b in VOWELS + VOICED.replace("r", ""):
            yield f"{v}s", b, f"{v}r {b}", "rutva"
    for v in V12:
        for b in VOWELS + VOICED.replace("r", ""):
            yield f"{v}r", b, f"{v}r {b}", "repha"
        long = {"a": "A", "i": "I", "u": "U", "f": "F"}.get(v, v)
        yield f"{v}r", "r", f"{long} r", "repha-lopa"
        if v not in "aA":
            yield f"{v}s", "r", f"{long} r", "repha-lopa"
        for f in (f"{v}s", f"{v}r"):
            for b in "kKpPSzs":
                yield f, b, f"{v}H {b}", "visarga"
            for s, after in (("S", "cC"), ("z", "wW"), ("s", "tT")):
                for b in after:
                    yield f, b, f"{v}{s} {b}", "visarga-satva"
    for b in CONSONANTS:
        yield "m", b, f"M {b}", "anusvara"
    for b in VOWELS:
        yield "m", b, f"m {b}", "identity"
    for v in "aiufx":
        yield v, "C", f"{v}c C", "tuk"
    for b, s in (("c", "S"), ("C", "S"), ("t", "s"), ("T", "s"), ("w", "z"), ("W", "z")):
        yield "n", b, f"M{s} {b}", "nas-chavi"
    voiced = dict(zip("kcwtp", "gjqdb", strict=True))
    for a, g in voiced.items():
        for b in VOWELS + "gGdDbByrlv":
            if a != "t" or b not in "l":
                yield a, b, f"{g} {b}", "jastva"
    for a, r in (("t", "d D"), ("k", "g G"), ("p", "b B")):
        yield a, "h", r, "jastva-h"
    nasal = dict(zip("kcwtp", "NYRnm", strict=True))
    for a, n in nasal.items():
        for b in "nm":
            yield a, b, f"{n} {b}", "anunasika"
    for a, b, r in (("t", "c", "c c"), ("t", "C", "c C"), ("t", "j", "j j"), ("t", "w", "w w"), ("t", "q", "q q"), ("t", "l", "l l"), ("t", "S", "c C"), ("n", "j", "Y j"), ("n", "l", "l l")):
        yield a, b, r, "assimilation"


#: (ord, first, second, result, category), each left and right side once a result
RULES = [(k, *r) for k, r in enumerate(dict.fromkeys(_rules()))]
