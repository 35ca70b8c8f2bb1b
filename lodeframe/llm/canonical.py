"""Free-typed values mapped to the entries of a reference list.

The reference names (canonical names, codes, aliases) form a trie. An entry walks
it as a Levenshtein automaton: one row of the edit table for each trie node, cut
off where no cell is within the distance allowed. All names within a distance
that depends on their length are returned; the nearest decide.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators of typed lists; a slash or plus counts only with space around it.
SEPARATORS = re.compile(r"[,;|\n\r\t]|(?<=\s)[/+](?=\s)")
_NOTE = re.compile(r"\([^)]*\)?")
_EDGE = re.compile(r"^[\s.?*!:'\"-]+|[\s.?*!:'\"-]+$")


def normal(entry: str) -> str:
    """An entry in plain form: no notes in brackets, marks at the edges, case, accents or double spaces."""
    s = unicodedata.normalize("NFKD", entry).casefold()
    s = "".join(ch for ch in s if not unicodedata.combining(ch))
    s = _NOTE.sub(" ", s)
    s = re.sub(r"\s*[&/]\s*", " and ", s)
    s = re.sub(r"[-_]", " ", s)
    return _EDGE.sub("", re.sub(r"\s+", " ", s))


def allowed(length: int) -> int:
    """Edits allowed for a reference name of a length: 0 to 3 letters none, to 8 one, beyond two."""
    return 0 if length <= 3 else 1 if length <= 8 else 2


class Trie:
    """Reference names with the ids they stand for."""

    __slots__ = ("root", "depth")

    def __init__(self, names: Iterable[tuple[str, int]]):
        self.root: dict = {}
        for name, key in names:
            node = self.root
            for ch in normal(name):
                node = node.setdefault(ch, {})
            if node is not self.root:
                node.setdefault("", set()).add(key)

    def search(self, word: str, distance: Callable[[int], int] = allowed) -> list[tuple[int, int]]:
        """All (distance, id) of names within the distance for their length.

        Distance is edits with the swap of two neighbours as one (optimal string
        alignment).
        """
        best: dict[int, int] = {}
        most = distance(10**6)
        first = list(range(len(word) + 1))
        stack = [(node, ch, "", first, None, 1) for ch, node in self.root.items() if ch]
        while stack:
            node, ch, prev_ch, row, before, depth = stack.pop()
            new = [row[0] + 1]
            for i, w in enumerate(word):
                d = min(new[i] + 1, row[i + 1] + 1, row[i] + (w != ch))
                if before is not None and i and w == prev_ch and word[i - 1] == ch:
                    d = min(d, before[i - 1] + 1)
                new.append(d)
            if "" in node and new[-1] <= distance(depth):
                for key in node[""]:
                    best[key] = min(best.get(key, 99), new[-1])
            if min(new) <= most or (min(row) <= most):
                stack += [(n, c, ch, new, row, depth + 1) for c, n in node.items() if c and (min(new) <= most or min(row) < most)]
        return sorted((d, k) for k, d in best.items())

    def under(self, word: str) -> set[int]:
        """Ids of all names that begin with a word."""
        node = self.root
        for ch in word:
            if ch not in node:
                return set()
            node = node[ch]
        out, stack = set(), [node]
        while stack:
            n = stack.pop()
            out |= n.get("", set())
            stack += [x for c, x in n.items() if c]
        return out

    def match(self, entry: str) -> list[int]:
        """Ids of the nearest names, or of the only name that a typed beginning of three letters or more can mean; [] if none."""
        word = normal(entry)
        if not word:
            return []
        near = self.search(word)
        if near:
            return [k for d, k in near if d == near[0][0]]
        ids = self.under(word) if len(word) >= 3 else set()
        return list(ids) if len(ids) == 1 else []


def typed_ids(text: Column, names: list[tuple[str, int]], none: int = 0) -> Column:
    """Column array<int> of the distinct ids that a typed list names.

    ``none`` stands for entries that match nothing; blank entries between
    separators are no entries. Null for a null or blank list. ``names`` is the
    reference list (a table of hundreds of rows, not of data size).
    """

    @F.pandas_udf("array<int>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trie, memo = Trie(names), {}

        def one(entry: str) -> list[int]:
            if entry not in memo:
                if len(memo) > 200_000:
                    memo.clear()
                memo[entry] = trie.match(entry) or [none]
            return memo[entry]

        for s in parts:
            out = []
            for t in s:
                entries = [] if t is None else [e for e in SEPARATORS.split(t) if e.strip()]
                out.append(sorted({k for e in entries for k in one(e)}) if entries else None)
            yield pd.Series(out, dtype=object)

    return run(text)


def unmatched_entries(text: Column, names: list[tuple[str, int]]) -> Column:
    """Column array<string> of the entries (in plain form) of a list that match nothing."""

    @F.pandas_udf("array<string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trie, memo = Trie(names), {}
        for s in parts:
            out = []
            for t in s:
                bad = []
                for e in [] if t is None else SEPARATORS.split(t):
                    if e.strip():
                        if e not in memo:
                            if len(memo) > 200_000:
                                memo.clear()
                            memo[e] = bool(trie.match(e))
                        if not memo[e]:
                            bad.append(normal(e) or e.strip())
                out.append(bad)
            yield pd.Series(out, dtype=object)

    return run(text)
