"""Text functions as column expressions; Python only where a scan depends on position."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(c: Column, most: int | None = None) -> Column:
    """Trimmed text of at most ``most`` characters, null where blank."""
    s = F.trim(c)
    return F.nullif(F.substring(s, 1, most) if most else s, F.lit(""))


def sentinel_null(c: Column, *sentinels) -> Column:
    """Null where a value is one of the sentinels."""
    return F.when(~c.isin(*sentinels), c)


def strip_parens(c: Column) -> Column:
    """Text without its bracketed parts."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\s*\([^)]*\)", " "), r"\s+", " "))


def canonical_name(c: Column, stop: list[str]) -> Column:
    """Lower-case words joined by one space, without stop words and marks."""
    s = F.regexp_replace(F.lower(strip_parens(c)), r"[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, rf"\b({'|'.join(stop)})\b", " "), r"\s+", " "))


def trailing_number(c: Column) -> Column:
    """Digits at the end of a text without leading zeros; null if there are none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(c, r"(\d+)\s*$", 1), r"^0+(?=\d)", ""), F.lit(""))


def slug(c: Column) -> Column:
    """Lower-case words joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def stable_key(*cols: Column, length: int = 16) -> Column:
    """A short hash of several values; null and empty differ."""
    return F.substring(F.sha2(F.to_json(F.struct(*[c.cast("string").alias(f"c{i}") for i, c in enumerate(cols)]), {"ignoreNullFields": "false"}), 256), 1, length)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 0 where both are empty."""
    u = F.size(F.array_union(a, b))
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(u, F.lit(0)), F.lit(0.0))


def words(c: Column) -> Column:
    """Distinct lower-case words of a text as an array."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: w != ""))


def first_rule(c: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """Label of the first rule whose pattern (Java regex) a text matches; the default where none or the text is null."""
    out = None
    for label, pattern in rules:
        hit = F.coalesce(c.rlike(pattern), F.lit(False))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def matched_terms(c: Column, pattern: str) -> Column:
    """Sorted distinct matches of a pattern in a text."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))))


def weighted_count(c: Column, weights: dict[str, float]) -> Column:
    """Sum over patterns of weight times number of matches."""
    parts = [F.regexp_count(c, F.lit(p)) * F.lit(w) for p, w in weights.items()]
    return sum(parts[1:], parts[0])


def max_token_weight(c: Column, weights: dict[str, float], default: float = 0.0) -> Column:
    """Greatest weight among the tokens of a text."""
    m = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.coalesce(F.array_max(F.transform(F.split(F.lower(c), r"[^a-z0-9]+"), lambda t: F.coalesce(F.try_element_at(m, t), F.lit(default)))), F.lit(default))


def scale_denominator(c: Column) -> Column:
    """Denominator of a printed scale such as 1:24,000; null without one."""
    s = F.regexp_extract(c, r"1\s*:\s*(\d{1,3}(?:,\d{3})+|\d{4,7})(?!\d)", 1)
    return F.regexp_replace(F.nullif(s, F.lit("")), ",", "").cast("int")


def encode_url(c: Column) -> Column:
    """Percent-encoding with %20 for a space."""
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def section_parts(c: Column) -> Column:
    """Township, range and section of a land description such as "T12S R22E Sec 14" as a struct; null without one."""
    p = r"(?i)\bT(?:ownship)?\.?\s*(\d{1,3})\s*([NS])\.?,?\s*R(?:ange)?\.?\s*(\d{1,3})\s*([EW])\.?(?:,?\s*S(?:ec(?:tion)?)?\.?\s*(\d{1,2}))?"
    g = lambda i: F.regexp_extract(c, p, i)
    sec = F.nullif(g(5), F.lit("")).cast("int")
    return F.when(
        F.coalesce(c.rlike(p), F.lit(False)),
        F.struct(g(1).cast("int").alias("t"), F.upper(g(2)).alias("td"), g(3).cast("int").alias("r"), F.upper(g(4)).alias("rd"), F.when(sec.between(1, 36), sec).alias("s")),
    )


def section_key(p: Column) -> Column:
    """Key of a section struct, "012S022E14"; null where a part is missing."""
    return F.concat(F.lpad(p["t"].cast("string"), 3, "0"), p["td"], F.lpad(p["r"].cast("string"), 3, "0"), p["rd"], F.lpad(p["s"].cast("string"), 2, "0"))


def listed_sections(c: Column) -> Column:
    """Section numbers listed in a text ("Sec 14, 15 and 16"), in order, each once."""
    tail = F.regexp_extract(c, r"(?i)\bsec(?:tion)?s?\.?\s*((?:\d{1,2}(?:\s*(?:,|and|&)\s*)?)+)", 1)
    nums = F.transform(F.regexp_extract_all(tail, F.lit(r"\d{1,2}"), F.lit(0)), lambda s: s.cast("int"))
    return F.array_distinct(F.filter(nums, lambda n: n.between(1, 36)))


# --- similarity and quotation matching (Arrow batches) ------------------------------------------


def sequence_similarity(a: Column, b: Column) -> Column:
    """Ratio of matching blocks of two texts (0..1); 0 where one is null."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        from difflib import SequenceMatcher

        for x, y in parts:
            yield pd.Series([SequenceMatcher(None, p, q, autojunk=False).ratio() if p is not None and q is not None else 0.0 for p, q in zip(x, y)])

    return run(a, b)


def name_similarity(a: Column, b: Column) -> Column:
    """Blend of block similarity and word overlap of two canonical names; unequal trailing numbers take 0.25 off, equal ones add 0.15.

    A name that has nothing left in canonical form is similar to none: 0.
    """
    from ..operators.linking import canon

    ca, cb = canon(a), canon(b)
    s = 0.6 * sequence_similarity(ca, cb) + 0.4 * jaccard(F.split(ca, " "), F.split(cb, " "))
    na, nb = trailing_number(a), trailing_number(b)
    s = F.when(na.isNotNull() & nb.isNotNull() & (na != nb), s - 0.25).when(na == nb, F.least(F.lit(1.0), s + 0.15)).otherwise(s)
    return F.when(ca.isNull() | cb.isNull(), 0.0).otherwise(s)


def trailing_scale(c: Column) -> Column:
    """The number at the end of a scale ("1:24,000"), thousands marks left out; null if there is none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(c, r"([\d,]+)\s*$", 1), ",", ""), F.lit("")).try_cast("bigint")


def raster_only(descriptor: Column) -> Column:
    """Whether a source's description speaks of rasters and not of vectors."""
    d = F.lower(F.coalesce(descriptor, F.lit("")))
    return d.rlike(r"\braster\b|\bscan(?:ned)?\b|geotiff|geopdf|\bcog\b|xyz") & ~d.rlike(r"\bvector\b|\bgis\b|geodatabase|\bgdb\b|\bgpkg\b|\bgems\b|polygon")


def plain_scale(c: Column) -> Column:
    """A scale given as a number ("24000", "1:24,000", "24k"); null for anything else."""
    s = F.regexp_replace(F.lower(F.trim(c.cast("string"))), ",", "")
    shape = r"^(?:1\s*:\s*)?(\d+(?:\.\d+)?)\s*(k)?$"
    n = F.regexp_extract(s, shape, 1).try_cast("double") * F.when(F.regexp_extract(s, shape, 2) == "k", 1000).otherwise(1)
    return F.when(n >= 1, F.floor(n))


def exact_scale(*notes: Column) -> Column:
    """The one scale that texts state; null where they state a range, several scales, or none."""
    one = r"(?i)1\s*:\s*([\d,]+(?:\.\d+)?)\s*(k)?"

    def stated(c: Column) -> Column:
        c = F.coalesce(c, F.lit(""))
        n = F.regexp_replace(F.regexp_extract(c, one, 1), ",", "").try_cast("double") * F.when(F.lower(F.regexp_extract(c, one, 2)) == "k", 1000).otherwise(1)
        return F.when((F.regexp_count(c, F.lit(one)) == 1) & ~c.rlike(r"(?i)[–—]|\bto\b"), F.floor(n))

    found = F.array_distinct(F.array_compact(F.array(*map(stated, notes))))
    return F.when(F.size(found) == 1, found[0])


def native_scale(descriptor: Column, scoring: Column, native: Column, denominator: Column, *notes: Column, most: int = 24_000) -> Column:
    """Whether a source is an attributed vector source drawn at 1:``most`` or better.

    Raster sources and those barred from scoring are not; one that is cleared goes by its native
    scale alone if that is known, others by the stated denominator, the native scale or the one exact scale of their notes.
    """
    n = plain_scale(native)
    known = F.coalesce(plain_scale(denominator), n, exact_scale(*notes))
    ok = F.when(F.coalesce(scoring, F.lit(False)) & n.isNotNull(), n <= most).otherwise(F.coalesce(known <= most, F.lit(False)))
    return ~raster_only(descriptor) & F.coalesce(scoring, F.lit(True)) & ok


def sentence_after(text: Column, heading: Column) -> Column:
    """The first sentence below a heading that stands on a line of its own, in one line; null if there is none."""
    start = F.instr(F.concat(F.lit("\n"), F.lower(text), F.lit("\n")), F.concat(F.lit("\n"), F.lower(heading), F.lit("\n")))
    rest = F.substring(text, start + F.length(heading), F.length(text))
    s = F.regexp_replace(F.trim(F.regexp_extract(rest, r"(?s)^\s*([^.?!]*[.?!])", 1)), r"\s+", " ")
    return F.when((start > 0) & (F.length(heading) > 0), F.nullif(s, F.lit("")))


def quote_words(t: str | None) -> list[str]:
    """Lower-case words of a text; hyphens at line ends are closed."""
    if not t:
        return []
    t = (t if t.isascii() else unicodedata.normalize("NFKC", t)).lower()
    return re.findall(r"[^\W_]+", re.sub(r"-\s*\n\s*", "", t))


def quote_score(quote: Column, page: Column) -> Column:
    """How well a quotation stands on a page: 1 where its folded words are contained, else the best window's share of them.

    Windows of 1.3 times the quote's words begin at every word of the page; the score
    is the greatest share of the quote's words, repeated ones counted each time, that
    a window holds, to six digits. Null or empty quotes score 0.
    """

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        from collections import Counter
        from itertools import accumulate

        last, joined, at, n = None, "", {}, 0
        quotes: dict[str, tuple[str, int, Counter]] = {}

        def one(q, p):
            nonlocal last, joined, at, n
            if not q or not p:
                return 0.0
            if p != last:
                b = quote_words(p)
                last, joined, at, n = p, f" {' '.join(b)} ", {}, len(b)
                for j, w in enumerate(b):
                    at.setdefault(w, []).append(j)
            if q not in quotes:
                if len(quotes) > 10_000:
                    quotes.clear()
                a = quote_words(q)
                quotes[q] = f" {' '.join(a)} ", len(a), Counter(a)
            text, width, counts = quotes[q]
            if not width or not n:
                return 0.0
            if text in joined:
                return 1.0
            size = max(width + 1, int(1.3 * width))
            # windows from lo to j hold the word at j; each word counts in a window once
            gain = [0] * (n + 1)
            for w, c in counts.items():
                lo = 0
                for j in at.get(w, ()):
                    lo = max(lo, j - size + 1)
                    gain[lo] += c
                    gain[j + 1] -= c
                    lo = j + 1
            return round(max(accumulate(gain)) / width, 6)

        for qs, ps in parts:
            yield pd.Series([one(q, p) for q, p in zip(qs, ps)])

    return run(quote, page)


def run_hashes(text: Column, lengths: list[int], longest: bool = False) -> Column:
    """Distinct hashes of all runs of so many folded words of a text, as an array; ``longest`` takes the greatest length that fits only."""

    @F.pandas_udf("array<bigint>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import hashlib

        ids: dict[str, int] = {}

        def one(t):
            if len(ids) > 500_000:
                ids.clear()
            ws = quote_words(t)
            for w in set(ws).difference(ids):
                ids[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
            x = np.array([ids[w] for w in ws], dtype=np.uint64)
            out = [np.zeros(0, np.uint64)]
            fit = [k for k in lengths if k <= len(ws)]
            for k in fit[-1:] if longest else fit:
                n = len(ws) - k + 1
                h = np.full(n, k, dtype=np.uint64)
                for i in range(k):
                    h = (h ^ x[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                out.append(h)
            return np.unique(np.concatenate(out)).astype(np.int64)

        for ts in parts:
            yield pd.Series([one(t) for t in ts])

    return run(text)


def safe_id(c: Column, person: str = "lodeframe") -> Column:
    """A stable id of 53 bits from a text by keyed blake2b; null stays null."""
    mark = person.encode()[:16]

    @F.pandas_udf("bigint")
    def run(s: pd.Series) -> pd.Series:
        import hashlib

        return pd.Series([None if t is None else int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8, person=mark).digest(), "big") & ((1 << 53) - 1) for t in s], dtype="Int64")

    return run(c)
