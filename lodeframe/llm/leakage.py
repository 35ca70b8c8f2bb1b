"""Passages of held-out items inside a corpus, by winnowed word fingerprints.

Words are folded (case, punctuation, layout), every k words are hashed, and of each
window of w hashes the least is kept, so that any run of w + k - 1 equal words
shares a fingerprint. Fingerprints of corpus and items are joined, and each hit is
extended in both directions over slips and changed, lost or added words.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import broadcast_if_small, materialize
from .names import slips

#: Words in a fingerprint and hashes in a window: runs of six equal words always meet.
K, W = 4, 3
#: Most bytes of item texts that are sent to every task; beyond, each pair carries its item's text.
ITEM_BYTES = 8 << 20

_WORD = re.compile(r"[^\W_]+", re.U)
_DROP = re.compile("['’`´­]")
_HYPHEN = re.compile(r"(?<=\w)-\s*\n\s*(?=\w)")


def words(text: str | None) -> list[str]:
    """Words of a text in folded form; hyphens at line ends are closed."""
    if not text:
        return []
    t = text if text.isascii() or unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)
    if "-" in t:
        t = _HYPHEN.sub("", t)
    if t.isascii():
        return _WORD.findall((t.replace("'", "").replace("`", "") if "'" in t or "`" in t else t).lower())
    return _WORD.findall(_DROP.sub("", t).casefold())


class _Ids(dict):
    def __missing__(self, w: str) -> int:
        b = w.encode()
        h = self[w] = (zlib.crc32(b) << 32) | zlib.crc32(b, 0x9E3779B9)
        if len(self) > 500_000:
            self.clear()
        return h


_MUL = np.uint64(0x9E3779B97F4A7C15)


def fingerprints(ws: list[str], k: int = K, w: int = W, ids: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed (hash, position) of a list of words; the least of all where there is less than a window."""
    n = len(ws) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids = _Ids() if ids is None else ids
    x = np.fromiter((ids[t] for t in ws), dtype=np.uint64, count=len(ws))
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = (h ^ (x[i : i + n] + np.uint64(i))) * _MUL
            h ^= h >> np.uint64(29)
    if n <= w:
        at = np.array([int(h.argmin())])
    else:
        win = np.lib.stride_tricks.sliding_window_view(h, w)
        at = np.unique(np.arange(n - w + 1) + win.argmin(axis=1))
        if (h[at][1:] == h[at][:-1]).any():
            at = _robust(h.tolist(), w)
    return h[at].astype(np.int64), at.astype(np.int64)


def _robust(h: list[int], w: int) -> np.ndarray:
    """Winnowing where equal hashes repeat: a window keeps the one chosen last while it holds it, so runs don't multiply."""
    out = [-1]
    for i in range(len(h) - w + 1):
        low = min(h[i : i + w])
        if out[-1] < i or h[out[-1]] != low:
            out.append(i + w - 1 - h[i : i + w][::-1].index(low))
    return np.array(out[1:])


def same_word(a: str, b: str) -> bool:
    """Whether two words are equal but for a slip of the scan (two in words of eight letters or more)."""
    return a == b or _slipped(a, b)


@functools.lru_cache(1 << 17)
def _slipped(a: str, b: str) -> bool:
    n = max(len(a), len(b))
    if n < 4 or abs(len(a) - len(b)) > 2 or a.isdigit() or b.isdigit():
        return False
    most = 2 if n >= 8 else 1
    return slips(a, b, most) <= most


def _ahead(a: list[str], b: list[str], x: int, y: int, s: int) -> int:
    """Equal words among the next four from two positions; counting stops where there can't be two."""
    la, lb, n, missed = len(a), len(b), 0, 0
    for _ in range(4):
        if 0 <= x < la and 0 <= y < lb and (a[x] == b[y] or _slipped(a[x], b[y])):
            n += 1
        else:
            missed += 1
            if missed == 3:
                break
        x, y = x + s, y + s
    return n


def _walk(a: list[str], b: list[str], i: int, j: int, step: int) -> tuple[int, int, int, int]:
    """Extends a match beyond positions i, j; returns the last matched positions, matched words and edits."""
    la, lb = len(a), len(b)
    end_i, end_j, good, edits = i, j, 0, 0
    score = best = 0
    matched = 0

    i, j = i + step, j + step
    pending = 0
    while 0 <= i < la and 0 <= j < lb:
        s = step
        if same_word(a[i], b[j]):
            score += 1
            matched += 1
            if score >= best:
                best, end_i, end_j, good, edits = score, i, j, matched, pending
            i, j = i + s, j + s
            continue
        # joined or broken words
        if 0 <= i + s < la and len(b[j]) > 3 and ((a[i] + a[i + s]) if s > 0 else (a[i + s] + a[i])) == b[j]:
            score += 1
            matched += 1
            i, j = i + 2 * s, j + s
            if score >= best:
                best, end_i, end_j, good, edits = score, i - s, j - s, matched, pending
            continue
        if 0 <= j + s < lb and len(a[i]) > 3 and ((b[j] + b[j + s]) if s > 0 else (b[j + s] + b[j])) == a[i]:
            score += 1
            matched += 2
            i, j = i + s, j + 2 * s
            if score >= best:
                best, end_i, end_j, good, edits = score, i - s, j - s, matched, pending
            continue
        options = []
        for di, dj in ((1, 1), (1, 0), (0, 1), (2, 2), (2, 1), (1, 2), (2, 0), (0, 2)):
            ahead = _ahead(a, b, i + di * s, j + dj * s, s)
            options.append((ahead - 0.8 * max(di, dj), -max(di, dj), di, dj))
        gain, _, di, dj = max(options)
        if gain <= 0.3:
            break
        score -= 2 * max(di, dj)
        pending += max(di, dj)
        if score < best - 5:
            break
        i, j = i + di * s, j + dj * s
    return end_i, end_j, good, edits


def extend(a: list[str], b: list[str], i: int, j: int, k: int) -> tuple[int, int, int, int, int, int]:
    """Grows an exact run a[i:i+k] = b[j:j+k]: (a from, a to, b from, b to, words matched, edits), ends included."""
    ri, rj, rg, re_ = _walk(a, b, i + k - 1, j + k - 1, 1)
    li, lj, lg, le = _walk(a, b, i, j, -1)
    return li, ri, lj, rj, k + rg + lg, re_ + le


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, least: int = 15, share: float = 0.8, k: int = K, w: int = W) -> DataFrame:
    """Documents that repeat a stretch of at least ``least`` words of an item.

    One row for each (document, item): the longest stretch as item_from, item_to,
    doc_from, doc_to (word positions, ends included), matched words and edits. A
    stretch is a case if its matched words less two for each edit come to ``share``
    of ``least`` or more: equal words, or most of some more. Null, empty and short
    texts have none; repeated documents come out repeated. The fingerprints of the items are
    broadcast only if their counted size is small, else the join shuffles.
    """
    src = docs.select(F.col(doc_id).alias("_d"), F.col(text).alias("_t")).where(F.length("_t") > 0)
    its = items.select(F.col(item_id).alias("_i"), F.col(item_text).alias("_x")).where(F.length("_x") > 0)
    kd, ki = src.schema["_d"].dataType.simpleString(), its.schema["_i"].dataType.simpleString()

    def prints(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = _Ids()
        for pdf in parts:
            cols = [[], [], []]
            for key, t in pdf.itertuples(index=False):
                h, at = fingerprints(words(t), k, w, ids)
                cols[0].append(np.full(len(h), key))
                cols[1].append(h)
                cols[2].append(at)
            yield pd.DataFrame({"key": np.concatenate(cols[0]), "h": np.concatenate(cols[1]), "at": np.concatenate(cols[2])} if len(pdf) else {"key": [], "h": [], "at": []})

    fi = materialize(its.mapInPandas(prints, f"key {ki}, h bigint, at bigint"), "items").withColumnsRenamed({"key": "_i", "at": "_ia"})
    fd = src.mapInPandas(prints, f"key {kd}, h bigint, at bigint").withColumnsRenamed({"key": "_d", "at": "_da"})
    hits = fd.join(broadcast_if_small(fi, fi.count(), 40), "h")
    # a seed is a position of the document and one of the item; a document has as many as its own fingerprints recur in the item
    seed = F.shiftleft(F.col("_da"), 32).bitwiseOR(F.col("_ia"))
    pairs = materialize(hits.groupBy("_d", "_i").agg(F.collect_set(seed).alias("s")), "hits")
    ids = materialize(pairs.select("_d").distinct(), "documents")
    texts = src.join(broadcast_if_small(ids, limit=2 << 20), "_d", "left_semi")
    small = (its.agg(F.sum(F.octet_length("_x"))).first()[0] or 0) <= ITEM_BYTES
    if small:
        # the texts of the items go to the tasks once, a document's text once for all its items
        known = defaultdict(list)
        for r in its.collect():
            known[r[0]].append(r[1])
        held = src.sparkSession.sparkContext.broadcast(dict(known))
        full = texts.join(pairs.groupBy("_d").agg(F.collect_list(F.struct("_i", "s")).alias("_p")), "_d")
    else:
        held, full = None, texts.join(pairs.join(its, "_i").withColumn("_p", F.array(F.struct("_i", "s", "_x"))).drop("_i", "_x", "s"), "_d")

    def best(a: list[str], b: list[str], seeds: list[int]) -> tuple | None:
        out, covered = None, set()
        for da, ia in sorted((q >> 32, q & 0xFFFFFFFF) for q in seeds):
            if (da - ia, ia) in covered or a[da : da + k] != b[ia : ia + k]:
                continue
            r = extend(a, b, da, ia, k)
            covered |= {(da - ia, y) for y in range(r[2], r[3] + 1)}
            if out is None or r[4] - 2 * r[5] > out[4] - 2 * out[5]:
                out = r
        return out if out and out[4] - 2 * out[5] >= share * least else None

    names = ["_d", "_i", "item_from", "item_to", "doc_from", "doc_to", "matched", "edits"]
    kinds = f"_d {kd}, _i {ki}, " + ", ".join(f"{n} int" for n in names[2:])
    types = [src.schema["_d"].dataType, its.schema["_i"].dataType]

    def grow(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = [*map(to_arrow_type, types), *[pa.int32()] * 6]
        cache: dict[str, list[str]] = {}
        for batch in parts:
            rows = []
            for d, t, p in zip(*(batch.column(c).to_pylist() for c in ("_d", "_t", "_p"))):
                a = words(t)
                for q in p:
                    for x in held.value.get(q["_i"], ()) if held else (q["_x"],):
                        b = cache.get(x)
                        if b is None:
                            if len(cache) > 20_000:
                                cache.clear()
                            b = cache[x] = words(x)
                        r = best(a, b, q["s"])
                        if r:
                            rows.append((d, q["_i"], r[2], r[3], r[0], r[1], r[4], r[5]))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [[]] * 8, arrow)], names)

    return full.select("_d", "_t", "_p").mapInArrow(grow, kinds).withColumnsRenamed({"_d": doc_id, "_i": item_id})
