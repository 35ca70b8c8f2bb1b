"""Quantities with units in running text, found by one multi-pattern automaton.

A text is squeezed (lower case, no white space) with every number replaced by a
mark, and an Aho-Corasick automaton over all unit, denominator and element names
runs over it once. Its patterns hold the names and, for names of some length, the
spellings one slip away (a letter lost, doubled, swapped or misread), so that scan
noise is matched by the automaton too. Overlaps are resolved by the longest match;
where a name is ambiguous the field it stands in decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of numerators, denominators and elements as they are written.
NUMERATORS = {
    "oz": ["ounces", "ounce", "oz", "ozs", "troy ounces", "troy ounce", "troy oz", "troy_ounces", "fine ounces"],
    "dwt": ["pennyweights", "pennyweight", "dwt", "dwts"],
    "gr": ["grains", "grain"],
    "g": ["grams", "gram", "gm", "gms", "g", "grammes"],
    "kg": ["kilograms", "kilogram", "kg", "kilos"],
    "lb": ["pounds", "pound", "lb", "lbs"],
    "pct": ["percent", "per cent", "%", "pct", "wt. %", "weight percent"],
    "ppm": ["parts per million", "parts_per_million", "ppm", "p.p.m."],
    "ppb": ["parts per billion", "parts_per_billion", "ppb", "p.p.b."],
    "opt": ["opt"],
    "gpt": ["gpt"],
    "usd": ["$"],
}
DENOMINATORS = {
    "short": ["per ton", "a ton", "the ton", "to the ton", "per short ton", "the short ton", "/ton", "/t", "/st", "per_short_ton", "short ton"],
    "long": ["per long ton", "a long ton", "the long ton", "to the long ton", "/long ton", "/lt", "per_long_ton", "long ton"],
    "metric": ["per metric ton", "per metric tonne", "per tonne", "the tonne", "a tonne", "/mt", "/tonne", "per_metric_tonne", "per_metric_ton", "metric ton"],
}
ELEMENTS = {
    "Au": ["gold", "au"],
    "Ag": ["silver", "ag"],
    "Cu": ["copper", "cu"],
    "Pb": ["lead", "pb"],
    "Zn": ["zinc", "zn"],
    "Fe": ["iron", "fe"],
}
OTHERS = ["feet", "foot", "tons,", "sacks", "miners", "years", "pounds,", "vein"]
# Letters that scans confuse.
CONFUSED = {"e": "co", "o": "ae0", "c": "eo", "h": "b", "b": "h", "i": "jl1", "l": "1i", "t": "f", "a": "o", "u": "n", "n": "u", "s": "5"}
FRACTIONS = {"¼": 0.25, "½": 0.5, "¾": 0.75, "⅓": 1 / 3, "⅔": 2 / 3, "⅛": 0.125, "⅜": 0.375, "⅝": 0.625, "⅞": 0.875}

# Grams in a unit of mass, and kilograms in a ton.
MASS_G = {"oz": 31.1034768, "dwt": 1.55517384, "gr": 0.06479891, "g": 1.0, "kg": 1000.0, "lb": 453.59237}
TON_KG = {"short": 907.18474, "long": 1016.0469088, "metric": 1000.0}

_NUMBER = re.compile(r"(-?)(\d[\d,]*(?:\.\d+)?|\.\d+)(?:\s*([¼½¾⅓⅔⅛⅜⅝⅞])|\s+(\d)/(\d+)(?!\d)|/(\d+)(?![\d/]))?|([¼½¾⅓⅔⅛⅜⅝⅞])")
_MARK = "\x01"


def conversion_rows() -> list[tuple[str, float]]:
    """unit id and grams per metric tonne of one such unit."""
    rows = [(f"{m}/{t}", MASS_G[m] / TON_KG[t] * 1000) for m in MASS_G for t in TON_KG]
    return rows + [("pct", 10_000.0), ("ppm", 1.0), ("ppb", 0.001)]


def _squeeze(s: str) -> str:
    return re.sub(r"[\s_]+", "", s.lower())


def _variants(name: str) -> set[str]:
    """Spellings one slip away; short names have none."""
    out = set()
    if len(name) < 4 or not name.isalpha():
        return out
    for i, ch in enumerate(name):
        out.add(name[:i] + ch + name[i:])
        if len(name) >= 5:
            out.add(name[:i] + name[i + 1 :])
        if i + 1 < len(name):
            out.add(name[:i] + name[i + 1] + ch + name[i + 2 :])
        letters = "abcdefghijklmnopqrstuvwxyz01" if len(name) >= 6 else CONFUSED.get(ch, "")
        out |= {name[:i] + x + name[i + 1 :] for x in letters}
        if ch == "m":
            out.add(name[:i] + "rn" + name[i + 1 :])
    return out


@lru_cache(maxsize=1)
def automaton():
    """The automaton over all names and their slips, built once in a worker."""
    import ahocorasick

    a, exact, slips = ahocorasick.Automaton(), {}, {}
    for kind, table in (("n", NUMERATORS), ("d", DENOMINATORS), ("e", ELEMENTS), ("x", {x: [x] for x in OTHERS})):
        for key, names in table.items():
            for name in map(_squeeze, names):
                exact.setdefault(name, (kind, key))
                for v in _variants(name):
                    slips.setdefault(v, (kind, key))
    for word, value in {**slips, **exact}.items():
        a.add_word(word, (len(word), *value))
    a.make_automaton()
    return a


def _numbers(text: str):
    """Numbers of a text and the text squeezed with each number as a mark."""
    values, parts, last = [], [], 0
    for m in _NUMBER.finditer(text):
        sign, whole, frac, a, b, c, alone = m.groups()
        if alone:
            v = FRACTIONS[alone]
        else:
            v = float(whole.replace(",", ""))
            if frac:
                v += FRACTIONS[frac]
            elif a and int(b):
                v += int(a) / int(b)
            elif c and int(c):
                v /= int(c)
        values.append(-v if sign and (m.start() == 0 or text[m.start() - 1].isspace() or text[m.start() - 1] == "$") else v)
        parts += [text[last : m.start()], _MARK]
        last = m.end()
    parts.append(text[last:])
    return values, _squeeze("".join(parts))


def _longest(text: str) -> list[tuple[int, int, str, str]]:
    """Matches (start, end, kind, key), the longest first where they overlap."""
    found = sorted(((end - n + 1, end + 1, kind, key) for end, (n, kind, key) in automaton().iter(text)), key=lambda x: (x[0], -x[1]))
    out, at = [], 0
    for m in found:
        if m[0] >= at:
            out.append(m)
            at = m[1]
        elif m[1] > at and out and m[1] - m[0] > out[-1][1] - out[-1][0]:
            out[-1], at = m, m[1]
    return out


#: "Near a number", in letters without spaces: how far behind the last word of a quantity its element or denominator
#: may stand ("0.4 oz of gold to the short ton"), and how far before the number its element ("gold to the value of $4").
#: What stands further off belongs to no quantity.
AFTER, BEFORE = 12, 18


def quantities(text: str | None) -> list[tuple[str | None, float, float, str]]:
    """Quantities stated in a text: (element or None, low, high, unit id).

    Dollars have the unit ``usd/short`` (or long, metric). Of "from a to b" low and
    high are the two ends, else they are equal. A null, empty or number-free text
    has none; negative numbers state nothing.
    """
    if not text:
        return []
    values, s = _numbers(text)
    if not values:
        return []
    spots = [i for i, ch in enumerate(s) if ch == _MARK]
    found = _longest(s)
    out, skip = [], False
    for i, at in enumerate(spots):
        if skip:
            skip = False
            continue
        low = high = values[i]
        end = spots[i + 1] if i + 1 < len(spots) else len(s)
        here = at
        # a range: its two numbers stand around "to" and share the unit behind the second
        if s[at + 1 : end] in ("to", "-", "–", "or", "fo", "ta", "t0", "too", "tto", "t") and i + 1 < len(spots) and (s[at + 1 : end] != "t" or s[max(0, at - 5) : at].endswith("from")):
            high, here, skip = values[i + 1], spots[i + 1], True
            end = spots[i + 2] if i + 2 < len(spots) else len(s)
        num = den = elem = None
        pos = here + 1
        if s[at - 1 : at] == "$":
            num = "usd"
        elif any(b + 2 == at and s[b:at] == "of" and kind == "d" for _, b, kind, _ in found):
            continue  # "the long ton of 2,240 pounds" tells what a ton is
        for a, b, kind, key in found:
            if a <= here or a >= end:
                continue
            if kind == "x":
                if a - pos <= 1:
                    break
                continue
            if num is None:
                if kind != "n" or a - pos > 1:
                    break
                num, pos = key, b
                if num in ("pct", "ppm", "ppb"):
                    den = ""
                elif num == "opt":
                    num, den = "oz", "short"
                elif num == "gpt":
                    num, den = "g", "metric"
            elif kind == "e" and elem is None and a - pos <= AFTER:
                elem, pos = key, b
            elif kind == "d" and den is None and a - pos <= AFTER:
                den, pos = key, b
                if num in ("g", "kg") and den == "short":
                    den = "metric"
            elif kind == "n":
                break
            if den is not None and elem is not None:
                break
        if num is None or num == "usd" and s[at - 1 : at] != "$" or low < 0 or high < 0:
            continue
        if den is None:
            if num not in ("g", "oz", "dwt", "gr", "usd", "kg", "lb"):
                continue
            if elem is None and _before(found, at) is None:
                continue
            den = "metric" if num in ("g", "kg") else "short"
        if elem is None:
            elem = _before(found, at)
        out.append((elem, min(low, high), max(low, high), f"{num}/{den}" if den else num))
    return out


def _before(found, at: int) -> str | None:
    """The element named right before a number ("gold 0.4 oz/t", "gold to the value of $4")."""
    for a, b, kind, key in reversed(found):
        if b <= at and kind in "en":
            if kind == "e" and at - b <= BEFORE:
                return key
            if kind == "n" and key == "usd" and at - b <= 1:
                continue
            return None
    return None


def parse_unit(text: str | None) -> str | None:
    """The unit id of a unit field; null where it names none ("as printed")."""
    if not text or not text.strip():
        return None
    found = [m for m in _longest(_squeeze(text)) if m[2] in "nd"]
    num = next((k for _, _, kind, k in found if kind == "n"), None)
    den = next((k for _, _, kind, k in found if kind == "d"), None)
    if num is None or num == "usd":
        return None
    if num in ("pct", "ppm", "ppb"):
        return num
    if num == "opt":
        return "oz/short"
    if num == "gpt":
        return "g/metric"
    if den is None:
        return None
    return f"{num}/metric" if num in ("g", "kg") else f"{num}/{den}"


QUANTITIES = "array<struct<element string, low double, high double, unit string>>"


def extract_quantities(text: Column) -> Column:
    """Column of the quantities stated in a text column (Arrow batches)."""

    @F.pandas_udf(QUANTITIES)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton()
        for s in parts:
            yield pd.Series([[dict(zip(("element", "low", "high", "unit"), q)) for q in quantities(t)] for t in s], dtype=object)

    return run(text)


def unit_id(text: Column) -> Column:
    """Column of unit ids of a unit field."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        known = {t: parse_unit(t) for t in s.dropna().unique()}
        return s.map(known).astype(object).where(s.notna(), None)

    return run(text)
