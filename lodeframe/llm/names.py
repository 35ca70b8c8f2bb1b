"""Typed names: parsing, a symmetric-delete index on tokens, and token alignment.

A typed name is parsed into alternatives, each a list of tokens and a number.
A lexicon holds the spellings that the data itself supports: of tokens a small
edit distance apart the much rarer one counts as a slip of the other. A typed
name is resolved to the lexicon names whose tokens it can be aligned with by an
optimal assignment that permits slips, initials, clipped words, words without
vowels, and words joined or broken.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..session import broadcast_if_small, materialize

# Words that tell a kind of working, not its name, and number words.
KINDS = frozenset("the mine mines mn mining mng lode lodes placer placers group claim claims property prospect prospects workings working co company cons consolidated".split())
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6}
NOTE_WORDS = frozenset("level heads sample drift ore tunnel estimate production vein shaft average mined dump mill east west north south lower upper first second third".split())
_NUMBER = re.compile(r"(?:\b(?:no|nr|num|number)\b\.?|#)\s*(\d+)", re.I)
_JOINED_NUMBER = re.compile(r"^([a-z]{4,})no(\d+)$")
_OCR = str.maketrans({"0": "o", "1": "l", "5": "s"})
_VOWELS = re.compile("[aeiou]")
_WORD = re.compile(r"[^\W_]+[.]?", re.U)
_VEIN, _NOTE, _NOTE_OUT = re.compile(r"^\s*\w+ vein,\s*"), re.compile(r"\(([^)]*)\)"), re.compile(r"\([^)]*\)?")


def _words(s: str, clipped: bool = False) -> tuple[tuple[str, ...], int]:
    num = 0
    m = _NUMBER.search(s)
    if m:
        num = int(m.group(1))
        s = s[: m.start()] + " " + s[m.end() :]
    raw = [w for w in _WORD.findall(s.replace("'", "").replace("’", "").casefold())]
    if len(raw) > 1 and raw[0] == "the":
        raw = raw[1:]
    tail: list[str] = []
    while len(raw) > 1 and raw[-1].rstrip(".") in KINDS:
        tail.append(raw.pop())
    if clipped and len(raw) == 1 and tail and len(tail[-1]) > 4 and tail[-1].endswith("."):
        raw.append(tail[-1])  # "Clover Cons." may be a clipped word and not a kind
    out = []
    for w in raw:
        if not w.rstrip(".").isalpha():
            j = _JOINED_NUMBER.match(w)
            if j:
                w, num = j.group(1), int(j.group(2))
            elif any(ch.isalpha() for ch in w):
                w = w.translate(_OCR)
            else:
                continue
        out.append(w)
    if not num and len(out) > 2 and out[-1] in NUMBER_WORDS:
        num = NUMBER_WORDS[out.pop()]
    elif not num and len(out) == 2 and out[-1] in NUMBER_WORDS and len(out[0]) > 8:
        num = NUMBER_WORDS[out.pop()]
    while len(out) > 2 and out[-1].rstrip(".") in KINDS:
        out.pop()
    return tuple(out), num


def parse(name: str | None) -> list[tuple[tuple[str, ...], int]]:
    """Alternatives of a typed name as (tokens, number); 0 where it has no number.

    Notes in brackets are dropped unless they can be a name; a further name after a
    semicolon or in brackets is an alternative. Null and empty names have none.
    """
    if not name:
        return []
    s = name if name.isascii() else unicodedata.normalize("NFKC", name)
    if " vein," in s:
        s = _VEIN.sub("", s)
    extra = []
    for note in _NOTE.findall(s) if "(" in s else ():
        words = note.split()
        if 1 < len(words) <= 3 and all(w.replace(".", "").isalpha() for w in words) and not NOTE_WORDS & {w.lower() for w in words}:
            extra.append(note)
    parts = [*(_NOTE_OUT.sub(" ", s) if "(" in s else s).split(";"), *extra]
    out = []
    for p in parts:
        for clipped in (False, True) if "." in p else (False,):
            words, num = _words(p, clipped)
            if words and (words, num) not in out:
                out.append((words, num))
    return out


def stem(token: str) -> str:
    """A token without its plural s."""
    return token.rstrip("s") if len(token) > 3 and token[-1] == "s" else token


def deletes(token: str, k: int) -> set[str]:
    """All strings that up to k deletions make of a token, itself included."""
    out = level = {token}
    for _ in range(k):
        level = {t[:i] + t[i + 1 :] for t in level for i in range(len(t))}
        out = out | level
    return out


def slips(a: str, b: str, most: int = 2) -> int:
    """Edits between two tokens, a swap of neighbours as one; most + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    # what both begin and end with doesn't count
    i = 0
    for x, y in zip(a, b):
        if x != y:
            break
        i += 1
    a, b = a[i:], b[i:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if len(a) <= 1 or len(b) <= 1:
        # a letter against others: it is among them or not
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        return min(len(long) - (len(short) == 1 and short in long), most + 1)
    if len(a) == len(b) == 2:
        return 1 if a == b[::-1] else 2
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            d = min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y))
            if before is not None and j and x == b[j - 1] and a[i - 1] == y:
                d = min(d, before[j - 1] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


def skeleton(token: str) -> str:
    """First letter and consonants of a token."""
    return token[:1] + _VOWELS.sub("", token[1:])


def token_cost(typed: str, word: str) -> float | None:
    """Cost of reading a typed token as a word (a stem); None if it can't be."""
    clipped = typed.endswith(".")
    t = typed.rstrip(".")
    if clipped and word.startswith(t):
        return 0.4 if len(t) >= 3 else 0.8
    s = stem(t)
    if s == word:
        return 0.0
    if len(t) == 1 and word.startswith(t):
        return 0.9
    if len(t) >= 3 and not _VOWELS.search(t, 1) and skeleton(word) == skeleton(s):
        return 0.4
    d = slips(s, word, 2 if len(word) >= 6 else 1)
    return 0.5 * d if d <= (2 if len(word) >= 6 else 1 if len(word) >= 3 else 0) else None


def align(typed: tuple[str, ...], words: tuple[str, ...]) -> float | None:
    """Least cost of an assignment of typed tokens to words, one to one; None if a token or word stays alone."""
    return assign([{w: c for w in words if (c := token_cost(t, w)) is not None} for t in typed], words)


def assign(readings: list[dict[str, float]], words: tuple[str, ...]) -> float | None:
    """The assignment from what each token can be read as."""
    n = len(words)
    if len(readings) != n:
        return None
    if n > 6:
        return _assign_many(readings, words)
    if n == 2:
        x, y = readings
        a = x[words[0]] + y[words[1]] if words[0] in x and words[1] in y else None
        b = x[words[1]] + y[words[0]] + 0.01 if words[1] in x and words[0] in y else None
        return b if a is None else a if b is None else min(a, b)
    best = None
    for order in itertools.permutations(range(n)):
        total = 0.01 * (order != tuple(range(n)))
        for r, j in zip(readings, order):
            c = r.get(words[j])
            if c is None:
                break
            total += c
        else:
            best = total if best is None else min(best, total)
    return best


def _assign_many(readings: list[dict[str, float]], words: tuple[str, ...]) -> float | None:
    """assign() for long names by shortest augmenting paths, in cubic time."""
    n, never = len(words), 1e6
    cost = [[r.get(w, never) for w in words] for r in readings]
    if any(min(r) >= never for r in cost):
        return None
    u, v, owner = [0.0] * n, [0.0] * (n + 1), [-1] * (n + 1)  # owner of a word; the last one is where a path begins
    for i in range(n):
        owner[n], j = i, n
        least, before, done = [math.inf] * n, [n] * n, [False] * (n + 1)
        while owner[j] >= 0:
            done[j], row = True, owner[j]
            for k in range(n):
                if not done[k] and (c := cost[row][k] - u[row] - v[k]) < least[k]:
                    least[k], before[k] = c, j
            to = min((k for k in range(n) if not done[k]), key=least.__getitem__)
            step = least[to]
            for k in range(n + 1):
                if done[k]:
                    u[owner[k]] += step
                    v[k] -= step
                elif k < n:
                    least[k] -= step
            j = to
        while j != n:
            owner[j] = owner[before[j]]
            j = before[j]
        owner[n] = -1
    sums = [sum(cost[i][i] for i in range(n)), 0.01 + sum(cost[owner[k]][k] for k in range(n))]
    return min(sums) if min(sums) < never else None


def squeeze(tokens: Iterable[str]) -> str:
    """Tokens without spaces, doubled letters and a plural s."""
    return "".join(ch for ch, _ in itertools.groupby("".join(t.rstrip(".") for t in tokens))).rstrip("s")


#: Delete keys of longer strings would be too many; these are found by runs of letters instead.
LONG, RUN = 48, 16


def near_keys(s: str, k: int, typed: bool) -> set[str]:
    """Keys that two strings at most ``k`` edits apart share, ``k`` being 2 at most.

    Up to LONG letters they are the strings that k deletions leave. A longer one lists
    three runs of letters, of which two edits leave one whole; what is typed lists all of its runs.
    """
    out: set[str] = set()
    if len(s) <= LONG + 2 * typed:
        out |= deletes(s, k)
    if typed and len(s) >= LONG - 1:
        out |= {"~" + s[i : i + RUN] for i in range(len(s) - RUN + 1)}
    elif len(s) > LONG:
        out |= {"~" + s[i : i + RUN] for i in (0, (len(s) - RUN) // 2, len(s) - RUN)}
    return out


def _reach(word: str) -> int:
    return 2 if len(word) >= 6 else 1 if len(word) >= 3 else 0


def word_keys(word: str) -> set[str]:
    """Keys under which a word of the vocabulary is found."""
    return near_keys(word, _reach(word), False) | {"'" + skeleton(word)}


def token_keys(token: str) -> set[str]:
    """Keys of the words that a typed token can be a slip of, or leave the vowels out of."""
    t = token.rstrip(".")
    s = stem(t)
    keys = near_keys(s, 2 if len(s) >= 5 else 1 if len(s) >= 3 else 0, True)
    return keys if _VOWELS.search(t, 1) else keys | {"'" + skeleton(s)}


def _is_open(token: str) -> bool:
    """True of a clipped token or an initial: any word with its beginning may be meant."""
    return token.endswith(".") or len(token) == 1


def pair_keys(words: tuple[str, ...]) -> set[str]:
    """Keys of a name of two or more words: each two of its words, written out or by their first letter."""
    out = set()
    for x, y in itertools.combinations(words, 2):
        for p in (x, "^" + x[0]):
            for q in (y, "^" + y[0]):
                out.add(f"{len(words)}|{min(p, q)}|{max(p, q)}")
    return out


def key_tokens(typed: tuple[str, ...]) -> tuple[str, str] | None:
    """The two tokens by which a typed name is looked up: those written out, the longest ones."""
    if len(typed) < 2:
        return None
    a, b = sorted(typed, key=lambda t: (_is_open(t), -len(t), t))[:2]
    return a, b


def _long_rows(df: DataFrame, column: str, keys, name: str) -> DataFrame:
    """A row with the hash of each key of each distinct string; all columns are kept."""

    def run(parts: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for part in parts:
            found = [list(keys(x)) for x in part.column(column).to_pylist()]
            kept = part.take(pa.array([i for i, f in enumerate(found) for _ in f], pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([x for f in found for x in f], pa.string())], [*part.schema.names, name])

    rows = df.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) + f", {name} string")
    return rows.withColumn(name, F.xxhash64(name))


@F.pandas_udf(DoubleType())
def _reading_cost(token: pd.Series, word: pd.Series) -> pd.Series:
    return pd.Series([token_cost(t, w) for t, w in zip(token, word)], dtype="float64")


@F.pandas_udf(DoubleType())
def _name_cost(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    memo: dict[tuple[str, str], float | None] = {}

    def cost(t: str, w: str) -> float | None:
        c = memo.get((t, w), -1.0)
        if c == -1.0:
            if len(memo) > 200_000:
                memo.clear()
            c = memo[t, w] = token_cost(t, w)
        return c

    def one(typed: str, known: str) -> float | None:
        words = tuple(known.split(" "))
        return assign([{w: c for w in words if (c := cost(t, w)) is not None} for t in typed.split(" ")], words)

    for a, b in parts:
        yield pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def _whole_cost(typed: pd.Series, known: pd.Series) -> pd.Series:
    """Cost of a name as a slip of another, both without spaces; null if it is none."""

    def one(q: str, name: str) -> float | None:
        words = name.split(" ")
        most = 2 if len(q) >= 7 else 1
        e = min(slips(q, squeeze(words), most), slips(q, squeeze(reversed(words)), most))
        return 0.5 * e + 0.02 if e <= most else None

    return pd.Series([one(x, y) for x, y in zip(typed, known)], dtype="float64")


#: Least cost of a name that isn't typed as it is known, less the cost of a changed order.
LEAST_SLIP = 0.39


def resolve_words(typed: DataFrame, lex: DataFrame, slipped: DataFrame | None = None) -> DataFrame:
    """The likeliest known name of each typed one: (words, target).

    ``typed`` has distinct tokens in one string, ``words``, and ``lex`` sorted stems,
    ``words``, with their count, ``n``. A noisy channel: four times the cost of the
    alignment less the logarithm of the count. Candidates come from equi-joins: tokens
    to words by symmetric deletes, two tokens of a name to the names that have both, and
    whole names by their letters without spaces. Only a name that nothing aligns
    with is taken for a slip of a whole name without spaces. A name out of reach has no
    row. Both are distinct names, whatever the number of records; nothing is
    collected. ``slipped`` may name sorted stems, ``words``, that are known slips of others,
    ``target``: they are candidates like all, and spare the search for less likely ones.
    """
    lex = materialize(lex.select(F.col("words").alias("target"), "n"), "lexicon")

    def look(parts: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for part in parts:
            words = part.column("words").to_pylist()
            tokens = [tuple(x.split(" ")) for x in words]
            two = [key_tokens(t) or (None, None) for t in tokens]
            text = lambda x: pa.array(x, pa.string())
            yield pa.RecordBatch.from_arrays(
                [text(words), text([" ".join(sorted(map(stem, t))) for t in tokens]), text([squeeze(t) for t in tokens]), pa.array(map(len, tokens), pa.int32()), text([x for x, _ in two]), text([y for _, y in two])],
                ["words", "stems", "q", "k", "a", "b"],
            )

    seen = typed.select("words").mapInArrow(look, "words string, stems string, q string, k int, a string, b string")
    own = lex.select(F.col("target").alias("stems"), F.col("target").alias("sure"), F.col("n").alias("own"), F.lit(0.0).alias("at"))
    if slipped is not None:
        to = slipped.select(F.col("words").alias("stems"), F.col("target").alias("sure")).join(lex.select(F.col("target").alias("sure"), F.col("n").alias("own")), "sure")
        own = own.unionByName(to.withColumn("at", _name_cost("stems", "sure")).where("at is not null"))
    # a name that is known as typed, or as a slip, gives way only to one that is more frequent by the price of a slip
    seen = materialize(seen.join(broadcast_if_small(own, limit=4 << 20), "stems", "left").withColumn("least", F.coalesce(F.col("own") * F.exp(4 * (LEAST_SLIP - F.col("at"))), F.lit(0.0))), "typed")

    vocabulary = lex.select(F.explode(F.split("target", " ")).alias("word"), "n").groupBy("word").agg(F.max("n").alias("m"))
    tokens = seen.where("k > 1").select(F.explode(F.array("a", "b")).alias("token"), "least").groupBy("token").agg(F.min("least").alias("_least"))
    near = _long_rows(tokens, "token", token_keys, "_k").join(_long_rows(vocabulary, "word", word_keys, "_k"), "_k").where("m >= _least").select("token", "word", "m").distinct()
    t = F.col("token")
    clipped = t.endswith(".") | (F.length(t) == 1)
    near = near.where(~clipped | (F.substring("token", 1, 1) != F.substring("word", 1, 1))).where(_reading_cost("token", "word").isNotNull())
    first = tokens.where(clipped).select("token", F.concat(F.lit("^"), F.substring(t, 1, 1)).alias("word"), F.lit(1 << 62).cast("bigint").alias("m"))
    reads = materialize(near.unionByName(first), "readings")

    posts = materialize(_long_rows(lex, "target", lambda x: pair_keys(tuple(x.split(" "))), "_k"), "posts")
    found = seen.where("k > 1")
    for c in ("a", "b"):
        one = reads.select(F.col("token").alias(c), F.col("word").alias(f"_{c}"), F.col("m").alias("_m"))
        found = found.join(broadcast_if_small(one, limit=4 << 20), c).where("_m >= least").drop("_m")
    found = found.withColumn("_k", F.xxhash64(F.concat_ws("|", F.col("k").cast("string"), F.least("_a", "_b"), F.greatest("_a", "_b"))))
    found = found.select("words", "least", "_k").join(broadcast_if_small(posts, limit=4 << 20), "_k").where("n >= least").select("words", "target", "n").distinct()
    found = found.withColumn("cost", _name_cost("words", "target")).where("cost is not null")
    wholes = _long_rows(lex, "target", lambda x: {squeeze(x.split(" ")), squeeze(reversed(x.split(" ")))}, "_k")
    same = seen.withColumn("_k", F.xxhash64("q")).join(wholes, "_k")
    same = same.select("words", "target", "n", F.when(F.col("k") == F.size(F.split("target", " ")), 0.0).otherwise(0.02).alias("cost"))
    self = seen.where("own is not null").select("words", F.col("sure").alias("target"), F.col("own").alias("n"), F.col("at").alias("cost"))
    score = 4.0 * F.col("cost") - F.log("n")
    likeliest = F.min_by("target", F.struct(score, "target")).alias("target")
    aligned = materialize(found.unionByName(same).unionByName(self).groupBy("words").agg(likeliest), "aligned")

    rest = seen.join(broadcast_if_small(aligned.select("words"), limit=4 << 20), "words", "left_anti").where(F.length("q") >= 4).select("words", "q")
    rest = _long_rows(rest, "q", lambda x: near_keys(x, 1, True), "_k")
    wholes = _long_rows(lex, "target", lambda x: near_keys(squeeze(x.split(" ")), 1, False) | near_keys(squeeze(reversed(x.split(" "))), 1, False), "_k")
    slipped = rest.join(wholes, "_k").select("words", "q", "target", "n").distinct().withColumn("cost", _whole_cost("q", "target")).where("cost is not null")
    return aligned.unionByName(slipped.groupBy("words").agg(likeliest))


def slip_map(tokens: DataFrame, token: str, n: str, block: list[str] | None = None, ratio: float = 8.0, two_from: int | None = 7) -> DataFrame:
    """Rare spellings with the much more frequent one they are a slip of.

    ``tokens`` holds distinct tokens with counts, within blocks. The distance allowed
    goes by the length: none below four letters (Ada is no slip of Ida), one
    from there, two from ``two_from``, where given. Candidates come from equi-joins on
    delete keys. Columns: block, token, ``target``.
    """
    block = block or []
    reach = lambda s: 2 if two_from and len(s) >= two_from else 1
    named = tokens.select(*block, F.col(token).alias("_t"), F.col(n).cast("bigint").alias("_n")).where(F.length("_t") >= 4)
    rare = _long_rows(named, "_t", lambda s: near_keys(s, reach(s), True), "_k")
    often = _long_rows(named.where(F.col("_n") >= ratio), "_t", lambda s: near_keys(s, reach(s), False), "_k").withColumnsRenamed({"_t": "_f", "_n": "_m"})
    pairs = rare.join(often.hint("shuffle_hash"), [*block, "_k"]).where((F.col("_m") >= F.col("_n") * ratio) & (F.col("_t") != F.col("_f")))
    pairs = pairs.where(F.abs(F.length("_t") - F.length("_f")) <= (2 if two_from else 1)).select(*block, "_t", "_f", "_m").distinct()
    pairs = pairs.withColumn("_d", F.levenshtein("_t", "_f", 2)).where("_d >= 0")
    swap = F.array_sort(F.split("_t", "")) == F.array_sort(F.split("_f", ""))
    pairs = pairs.withColumn("_d", F.when((F.col("_d") == 2) & swap, 1).otherwise(F.col("_d"))).where((F.col("_d") <= 1) | (F.length("_f") >= (two_from or 1 << 30)))
    best = F.max_by("_f", F.struct(-F.col("_d"), F.col("_m"), F.col("_f")))
    return pairs.groupBy(*block, "_t").agg(best.alias("target")).withColumnRenamed("_t", token)
