"""Text that was decoded with a wrong character set: detection and restoration.

A hidden Markov model with one clean state, one state for each pair of (true
encoding, wrong encoding) and one for lost characters labels the characters that
are not ASCII. What a state emits is the character it would restore, in its
context: a pair emits only what its inverse transform can decode. The emission
probabilities are trained on all documents, in two rounds of counting (the second
counts what the first labelled clean). Each labelled span gets the inverse
transform of its state.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Pairs of the true and the wrongly assumed encoding.
MULTI = ["cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "cp866"]
SINGLE = [
    ("cp1252", "cp1251"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1250"),
    ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1251", "cp1252"),
]
LOST = "lost"
CLEAN = "clean"

#: Log-probability of leaving the clean state, of returning to it, and of passing between damaged states.
ENTER, LEAVE, STAY = math.log(2e-3), math.log(2e-2), math.log(0.98)
#: The same in training, where a doubtful character had better not count as clean.
EASY = (math.log(0.02), math.log(0.15), math.log(0.8))
_FLOOR = 1e-9
_NOT, _RUN = re.compile(r"[^\x00-\x7f]"), re.compile(r"[^\x00-\x7f]{2,}")


def _char(byte: int, code: str) -> str:
    """The character a byte was read as; undefined bytes stay as control characters."""
    try:
        return bytes([byte]).decode(code)
    except UnicodeDecodeError:
        return chr(byte)


def _tables():
    to_byte = {c: {_char(b, c): b for b in range(128, 256)} for c in MULTI}
    pattern = {}
    for c, t in to_byte.items():
        def cls(lo: int, hi: int, t=t) -> str:
            return "[" + "".join(re.escape(g) for g, b in t.items() if lo <= b <= hi) + "]"

        k = cls(0x80, 0xBF)
        pattern[c] = re.compile(f"{cls(0xC2, 0xDF)}{k}|{cls(0xE0, 0xEF)}{k}{k}|{cls(0xF0, 0xF4)}{k}{k}{k}")
    single = {}
    for true, wrong in SINGLE:
        t = {}
        for b in range(128, 256):
            try:
                g, d = bytes([b]).decode(wrong), bytes([b]).decode(true)
            except UnicodeDecodeError:
                continue
            if not g.isspace():  # a no-break space is rare but correct
                t[g] = d  # some bytes are the same character in both
        single[f"{true}>{wrong}"] = t
    return to_byte, pattern, single


_TO_BYTE, _PATTERN, _SINGLE = _tables()


def _cls(ch: str) -> str:
    """Class of a character as a neighbour."""
    if not ch or ch.isspace():
        return " "
    if ch.isascii():
        return "a" if ch.islower() else "A" if ch.isupper() else "0" if ch.isdigit() else "."
    return "n" if ch.islower() else "N" if ch.isupper() else "c" if 0x80 <= ord(ch) < 0xA0 else "x"


def _kind(ch: str) -> str:
    """Class of a character as such."""
    o = ord(ch)
    script = "cyr" if 0x400 <= o < 0x530 else "grk" if 0x370 <= o < 0x400 else "cjk" if 0x2E80 <= o < 0xA000 else "box" if 0x2500 <= o < 0x25A0 else "c1" if o < 0xA0 else "ltr" if ch.isalpha() else "sym"
    return script + ("u" if ch.isupper() else "")


def _decodable(run: str) -> dict[str, list[tuple[int, int, str]]]:
    """For each multi-byte pair the (start, end, restored) it could decode in a run of characters beyond ASCII."""
    out = {}
    for c, pat in _PATTERN.items():
        table, found = _TO_BYTE[c], []
        for m in pat.finditer(run):
            try:
                found.append((m.start(), m.end(), bytes(table[g] for g in m.group()).decode("utf-8")))
            except UnicodeDecodeError:
                continue
        if found:
            out[f"utf-8>{c}"] = found
    for c in ("cp1252", "latin-1"):
        # decoded twice: what one transform restores is itself a sequence
        for first in ("cp1252", "latin-1"):
            once, twice, i = out.get(f"utf-8>{c}", []), [], 0
            while i < len(once):
                j = i
                while j + 1 < len(once) and once[j + 1][0] == once[j][1]:
                    j += 1
                inner = "".join(x[2] for x in once[i : j + 1])
                if j > i and len(inner) == j - i + 1:
                    for m in _PATTERN[first].finditer(inner):
                        try:
                            d = bytes(_TO_BYTE[first][g] for g in m.group()).decode("utf-8")
                        except UnicodeDecodeError:
                            continue
                        twice.append((once[i + m.start()][0], once[i + m.end() - 1][1], d))
                i = j + 1
            if twice:
                out[f"utf-8>{first}>utf-8>{c}"] = twice
    return out


_PAIRS = [f"utf-8>{c}" for c in MULTI] + [f"utf-8>{a}>utf-8>{b}" for b in ("cp1252", "latin-1") for a in ("cp1252", "latin-1")]
_runs: dict[str, dict] = {}


def sequences(text: str) -> dict[str, list[tuple[int, int, str]]]:
    """For each multi-byte pair the (start, end, restored) it could decode.

    Only runs of two or more characters beyond ASCII hold any; short runs recur, and are looked up.
    """
    out: dict[str, list[tuple[int, int, str]]] = {}
    for m in _RUN.finditer(text):
        run, at = m.group(), m.start()
        found = _runs.get(run)
        if found is None:
            if len(_runs) > 50_000:
                _runs.clear()
            found = _decodable(run)
            if len(run) <= 40:
                _runs[run] = found
        for state, spans in found.items():
            out.setdefault(state, []).extend([(s + at, t + at, d) for s, t, d in spans])
    return {s: out[s] for s in _PAIRS if s in out} if out else out


class Contexts:
    """Counts of (class before, character, class after), taken as whole neighbourhoods first."""

    def __init__(self) -> None:
        self.near: Counter = Counter()
        self.total: Counter = Counter()

    def add(self, text: str, without: set[int]) -> None:
        padded = f" {text} "
        self.near.update([padded[i : i + 3] for m in _NOT.finditer(text) if (i := m.start()) not in without and text[i] != "\ufffd"])
        if len(self.near) > 100_000:
            self.counts()

    def counts(self) -> Counter:
        for k, n in self.near.items():
            self.total[_cls(k[0]), k[1], _cls(k[2])] += n
        self.near.clear()
        return self.total


class Model:
    """Emission and transition log-probabilities, from counts of clean characters."""

    def __init__(self, counts: dict[tuple[str, str, str], int], costs: tuple[float, float, float] = (ENTER, LEAVE, STAY)):
        self.costs = costs
        self.n = max(1, sum(counts.values()))
        self.tri = counts
        self.uni: Counter = Counter()
        self.ctx: Counter = Counter()
        self.kind: Counter = Counter()
        for (a, ch, b), n in counts.items():
            self.uni[ch] += n
            self.ctx[(a, _kind(ch), b)] += n
            self.kind[_kind(ch)] += n
        self.memo: dict[tuple[str, str, str], float] = {}
        self.gains: dict[str, float] = {}

    def gain(self, near: str) -> float:
        """The most that a single-byte state can gain over the clean one at the middle of three characters."""
        g = self.gains.get(near)
        if g is None:
            if len(self.gains) > 200_000:
                self.gains.clear()
            a, ch, b = near
            best = max((self.log_p(_cls(t.get(a, a)), t[ch], _cls(t.get(b, b))) for t in _SINGLE.values() if ch in t), default=-40.0)
            g = self.gains[near] = best - self.log_p(_cls(a), ch, _cls(b))
        return g

    def surely_clean(self, text: str, spots: list[int]) -> bool:
        """Whether no stretch of single-byte damage can gain what it costs to enter: then the clean path is the likeliest.

        The greatest sum of gains over a stretch bounds what any state can gain in it.
        """
        padded, price = f" {text} ", self.costs[2] - self.costs[0]
        run = 0.0
        for p in spots:
            run = max(run, 0.0) + self.gain(padded[p : p + 3])
            if run >= price:
                return False
        return True

    def log_p(self, a: str, ch: str, b: str) -> float:
        k = (a, ch, b)
        if k not in self.memo:
            if ch.isascii():
                p = 1e-6 if ch.isprintable() else _FLOOR
            else:
                kind = _kind(ch)
                in_ctx = (self.ctx[(a, kind, b)] + 1e-3) / (self.kind[kind] + 1)
                p = 0.7 * self.tri.get(k, 0) / self.n + 0.3 * (self.uni[ch] + 1e-2) / self.n * in_ctx + _FLOOR
            self.memo[k] = math.log(p)
        return self.memo[k]

    def label(self, text: str) -> list[tuple[int, int, str, str]]:
        """Damaged spans of a text: (start, end, state, restored), one a garbled unit."""
        spots = [m.start() for m in _NOT.finditer(text)]
        if not spots:
            return []
        many = sequences(text)
        if not many and "\ufffd" not in text and self.surely_clean(text, spots):
            return []
        at = {p: k for k, p in enumerate(spots)}
        n = len(spots)
        before = [_cls(text[p - 1] if p else "") for p in spots]
        after = [_cls(text[p + 1 : p + 2]) for p in spots]
        low = -40.0
        emit: dict[str, list[float]] = {CLEAN: [self.log_p(before[k], text[p], after[k]) if text[p] != "�" else low for k, p in enumerate(spots)]}
        units: dict[str, dict[int, tuple[int, str]]] = {}
        for state, found in many.items():
            e, u = [low] * n, {}
            starts, ends = {x[0]: x[2] for x in found}, {x[1]: x[2] for x in found}
            for s, t, d in found:
                k = at[s]
                a = _cls(ends[s]) if s in ends else before[k]
                e[k] = self.log_p(a, d, _cls(starts[t]) if t in starts else after[at[t - 1]])
                for p in range(s + 1, t):
                    e[at[p]] = 0.0
                u[k] = (t, d)
            emit[state], units[state] = e, u
        for state, table in _SINGLE.items():
            e, u = [low] * n, {}
            for k, p in enumerate(spots):
                d = table.get(text[p])
                if d is not None:
                    a, b = text[p - 1] if p else "", text[p + 1 : p + 2]
                    e[k] = self.log_p(_cls(table.get(a, a)), d, _cls(table.get(b, b)))
                    u[k] = (p + 1, d)
            if any(text[spots[k]] != d for k, (_, d) in u.items()):
                emit[state], units[state] = e, u
        if "�" in text:
            emit[LOST] = [0.0 if text[p] == "�" else low for p in spots]
            units[LOST] = {k: (p + 1, "�") for k, p in enumerate(spots) if text[p] == "�"}
        if len(emit) == 1:
            return []
        states = list(emit)
        enter, leave, stay = self.costs
        v = {s: emit[s][0] + (0.0 if s == CLEAN else enter) for s in states}
        back: list[dict[str, str]] = [{}]
        for k in range(1, n):
            damaged = max((x for x in v.items() if x[0] != CLEAN), key=lambda x: x[1])
            new, b = {}, {}
            for s in states:
                if s == CLEAN:
                    options = ((v[s] + stay, s), (damaged[1] + leave, damaged[0]))
                else:
                    options = ((v[s] + stay, s), (v[CLEAN] + enter, CLEAN), (damaged[1] + enter, damaged[0]))
                best = max(options)
                new[s], b[s] = best[0] + emit[s][k], best[1]
            v = new
            back.append(b)
        s = max(v.items(), key=lambda x: x[1])[0]
        path = [s]
        for k in range(n - 1, 0, -1):
            s = back[k][s]
            path.append(s)
        path.reverse()
        out = []
        for k, s in enumerate(path):
            if s != CLEAN and k in units.get(s, {}):
                end, d = units[s][k]
                if text[spots[k] : end] != d or s == LOST:
                    out.append((spots[k], end, s, d))
        return out


_COUNTS = "a string, ch string, b string, n bigint"


def _counted(docs: DataFrame, model: dict | None) -> dict[tuple[str, str, str], int]:
    """Counts over all documents; without a model, of what no multi-byte pair could decode."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(model, EASY) if model is not None else None
        total = Contexts()
        for pdf in parts:
            for text in pdf["_text"]:
                spans = m.label(text) if m else [x for found in sequences(text).values() for x in found]
                total.add(text, {p for x in spans for p in range(x[0], x[1])})
        yield pd.DataFrame([(*k, n) for k, n in total.counts().items()], columns=["a", "ch", "b", "n"])

    rows = docs.mapInPandas(run, _COUNTS).groupBy("a", "ch", "b").agg(F.sum("n").alias("n")).collect()  # characters in 8 x 8 contexts
    return {(r.a, r.ch, r.b): r.n for r in rows}


def repair(docs: DataFrame, id_col: str, text_col: str, rounds: int = 2) -> DataFrame:
    """Damaged documents with their spans and the restored text.

    One row for each document with damage anywhere: id, ``spans``
    (array<struct<start, end, pair, garbled, restored>>, characters from 0),
    ``restored_text`` and ``complete`` (false where characters are lost for good).
    Null, empty and ASCII-only texts are never damaged. Repeated rows come out
    repeated. Columns of other names are ignored.
    """
    some = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_text").rlike(r"[^\x00-\x7F]"))
    counts = None
    for _ in range(rounds):
        counts = _counted(some.select("_text"), counts)
    kind = some.schema["_id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(counts)
        for pdf in parts:
            rows = []
            for i, text in pdf.itertuples(index=False):
                spans = m.label(text)
                if spans:
                    new, last = [], 0
                    for s, t, _, d in spans:
                        new += [text[last:s], d]
                        last = t
                    new.append(text[last:])
                    rows.append((i, [{"start": s, "end": t, "pair": p, "garbled": text[s:t], "restored": d} for s, t, p, d in spans], "".join(new), all(x[2] != LOST for x in spans)))
            yield pd.DataFrame(rows, columns=["_id", "spans", "restored_text", "complete"])

    out = some.mapInPandas(
        run, f"_id {kind}, spans array<struct<start:int,end:int,pair:string,garbled:string,restored:string>>, restored_text string, complete boolean"
    )
    return out.withColumnRenamed("_id", id_col)
