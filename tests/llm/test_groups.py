"""Survivors, packing and leak search: brute force, guarantees and edge cases."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeframe.llm import leakage, packing, survivors

REC = "g string, k bigint, a string, b string, rank int, at timestamp, n string"


def _best(spark, rows, **kw):
    df = spark.createDataFrame(rows, REC)
    return {r.best: r for r in survivors.best_representatives(df, ["g"], "k", ["a", "b"], 1.0 / F.col("rank"), F.col("rank"), F.col("at"), **kw).collect()}


def test_best_record_order(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    got = _best(
        spark,
        [
            ("x", 1, "not given", "v", 1, t(1), ""), ("x", 2, "u", "v", 5, t(1), ""), ("x", 3, "u", "w", 2, t(1), ""), ("x", 4, "u", "w", 2, t(2), ""), ("x", 5, "u", "w", 2, t(2), ""),
            ("y", 9, None, None, None, None, ""), ("y", 8, "?", " ", None, None, ""), ("z", 7, "only", "—", 1, t(1), ""), (None, 6, "a", "b", 1, t(1), ""),
        ],
    )
    assert set(got) == {4, 8, 7} and got[4].n == 5 and got[8].n == 2 and got[7].n == 1
    assert (got[8].a, got[8].b, got[7].a, got[7].b) == (None, None, "only", None)


def test_votes_beat_the_best_record(spark):
    t = dt.datetime(2024, 1, 1)
    got = _best(spark, [("x", 1, "Zeta", "q", 1, t, ""), ("x", 2, "alpha", None, 1, t, ""), ("x", 3, " ALPHA ", None, 1, t, "")], singles=False)
    assert got[1].a.strip().lower() == "alpha" and got[1].b == "q"


def test_survivors_against_brute_force(spark):
    rnd = random.Random(3)
    vals = [None, "", "?", "n/a", "x", "Y", "z 1"]
    rows = [(f"g{rnd.randint(0, 30)}", i, rnd.choice(vals), rnd.choice(vals), rnd.randint(1, 3), dt.datetime(2024, 1, rnd.randint(1, 9)), "") for i in range(400)]
    fill = lambda r: sum(v in ("x", "Y", "z 1") for v in r[2:4])
    want = set()
    for g in {r[0] for r in rows}:
        m = [r for r in rows if r[0] == g]
        if len(m) > 1:
            want.add(min(m, key=lambda r: (-fill(r), r[4], -r[5].timestamp(), r[1]))[1])
    assert set(_best(spark, rows, singles=False)) == want
    assert _best(spark, []) == {}


def test_source_key(spark):
    df = spark.createDataFrame([("Igs_b11",), ("igs-b11",), ("igs b11 ",), ("IGS_B11",)], "s string")
    assert {r[0] for r in df.select(survivors.source_key(F.col("s"))).collect()} == {"igs_b11"}


# --- packing ------------------------------------------------------------------------------------------


def test_differencing_balances():
    rnd = np.random.default_rng(1)
    sizes = rnd.integers(1, 400, 900)
    w = packing.differencing(sizes, 40)
    sums = np.bincount(w, weights=sizes, minlength=40)
    assert sums.sum() == sizes.sum() and sums.max() - sums.min() <= 4
    assert set(packing.differencing(np.array([5, 4, 3, 3, 3]), 2)) == {0, 1}


@pytest.mark.parametrize("cap", [10, 100, 512])
def test_pack_fits(cap):
    rnd = np.random.default_rng(cap)
    sizes = rnd.integers(0, cap + 1, 300)
    w = packing.pack(sizes, cap)
    sums = np.bincount(w, weights=sizes)
    assert sums.max() <= cap and len(sums) <= 1.5 * np.ceil(sizes.sum() / cap) + 1
    assert packing.pack(np.array([], dtype=np.int64), cap).tolist() == [] and packing.pack(np.array([cap]), cap).tolist() == [0]


def test_pack_items(spark):
    rnd = random.Random(5)
    items = [(i, rnd.choice([0, 5, 40, 99, 100, 101, 350])) for i in range(300)] + [(900, None), (901, -1), (7, 40), (7, 40)]
    df = spark.createDataFrame(items, "id int, n int")
    out = packing.pack_items(df, "id", "n", [(1, 100), (2, 1000)], windows=8).collect()
    for pid, cap in ((1, 100), (2, 1000)):
        mine = [r for r in out if r.profile_id == pid]
        boxes, total = {}, 0
        for r in mine:
            boxes[r.container_id] = boxes.get(r.container_id, 0) + r.size
            total += r.size
        want = sum(n for _, n in items if n and n > 0)
        assert total == want and max(boxes.values()) <= cap
        assert {r.id for r in mine} == {i for i, n in items if n is not None and n >= 0}
        for r in mine:
            assert r.start == r.piece * cap
        small = [r for r in mine if r.id not in {i for i, n in items if n and n > cap}]
        assert all(r.piece == 0 for r in small)
    assert packing.pack_items(df.limit(0), "id", "n", [(1, 100)]).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "gold mine"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "x" * 100_000)], "id int, text string")
    got = {r.id: r.n_tokens for r in packing.token_counts(df, "id", "text").collect()}
    assert got[1] == 2 and got[2] == 0 and 3 not in got and got[4] > 1 and got[5] > 1000


# --- leaks ---------------------------------------------------------------------------------------------


def test_winnowing_guarantee():
    rnd = random.Random(2)
    for _ in range(200):
        shared = [str(rnd.random()) for _ in range(leakage.K + leakage.W - 1)]
        a, b = ([str(rnd.random()) for _ in range(rnd.randint(0, 9))] for _ in range(2))
        x, y = leakage.fingerprints(a + shared + b)[0], leakage.fingerprints(b + shared + a)[0]
        assert set(x.tolist()) & set(y.tolist())
    assert len(leakage.fingerprints(["a"] * (leakage.K - 1))[0]) == 0
    assert len(leakage.fingerprints(["a"] * leakage.K)[0]) == 1


def test_winnowing_of_repeats():
    for text in (["a"] * 1000, ["a", "b"] * 500, (["x"] * 7 + ["y"]) * 100):
        h, at = leakage.fingerprints(text)
        assert len(at) <= len(text) / 2 and (np.diff(at) <= leakage.W).all() and at[0] < leakage.W
    long, short = ["q"] * 3 + ["a"] * 50 + ["r"] * 3, ["s"] * 5 + ["a"] * 9 + ["t"] * 4
    assert set(leakage.fingerprints(long)[0].tolist()) & set(leakage.fingerprints(short)[0].tolist())


def test_leaks(spark):
    rnd = random.Random(7)
    voc = [f"word{i}x" for i in range(400)]
    item = [rnd.choice(voc) for _ in range(60)]
    noise = lambda n: [rnd.choice(voc) for _ in range(n)]
    part = item[10:30]
    slip = part.copy()
    slip[5], slip[12] = "Wrod" + slip[5][4:], slip[12].upper()
    lost = part[:8] + part[9:]
    docs = [
        (1, " ".join(noise(40) + part + noise(40))), (2, "\n".join(noise(9) + slip + noise(9))), (3, ", ".join(noise(9) + lost + noise(9))),
        (4, " ".join(noise(50))), (5, " ".join(noise(20) + item[40:47] + noise(20))), (6, None), (7, ""), (8, " ".join(item)), (8, " ".join(item)), (9, " ".join(noise(30_000) + part)),
    ]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id int, text string, item_id string")
    i = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(noise(50))), (3, None)], "item_id int, text string")
    got = sorted((r.doc_id, r.item_id) for r in leakage.leaks(d, "doc_id", "text", i, "item_id", "text").collect())
    assert sorted(set(got)) == [(1, 1), (2, 1), (3, 1), (8, 1), (9, 1)]
    assert leakage.leaks(d.limit(0), "doc_id", "text", i, "item_id", "text").count() == 0
    assert leakage.leaks(d, "doc_id", "text", i.limit(0), "item_id", "text").count() == 0


@pytest.mark.parametrize("limit", [8 << 20, 0])
def test_leaks_with_items_held_or_joined(spark, monkeypatch, limit):
    monkeypatch.setattr(leakage, "ITEM_BYTES", limit)
    w = [f"word{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, "x y z " + " ".join(w[10:30])), (1, "x y z " + " ".join(w[10:30])), (2, " ".join(w[:9])), (3, None), (4, "")], "d long, t string")
    items = spark.createDataFrame([(7, " ".join(w)), (7, "other text"), (8, None)], "i long, x string")
    got = sorted((r.d, r.i, r.item_from, r.item_to) for r in leakage.leaks(docs, "d", "t", items, "i", "x").collect())
    assert set(got) == {(1, 7, 10, 29)} and len(got) >= 2
    assert leakage.leaks(docs.limit(0), "d", "t", items, "i", "x").count() == leakage.leaks(docs, "d", "t", items.limit(0), "i", "x").count() == 0


@pytest.mark.parametrize("cap, spread", [(512, 300), (2048, 700)])
def test_packing_beside_first_fit(spark, cap, spread):
    """Containers close to the least number that could do, and to first fit by falling size."""
    rnd = np.random.default_rng(12)
    sizes = np.minimum(rnd.lognormal(4.5, 0.9, 3000).astype(int) + 1, spread)
    df = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "id long, n long")
    boxes = packing.pack_items(df, "id", "n", [(1, cap)]).groupBy("container_id").agg(F.sum("size").alias("used")).collect()
    assert max(b.used for b in boxes) <= cap and sum(b.used for b in boxes) == sizes.sum()
    fit: list[int] = []
    for s in sorted(sizes.tolist(), reverse=True):
        at = next((k for k, room in enumerate(fit) if room >= s), None)
        if at is None:
            fit.append(cap - s)
        else:
            fit[at] -= s
    least = -(-int(sizes.sum()) // cap)
    print(cap, "containers", len(boxes), "first fit", len(fit), "least", least)
    assert len(boxes) <= 1.03 * least + 2 and len(boxes) <= 1.03 * len(fit) + 2
