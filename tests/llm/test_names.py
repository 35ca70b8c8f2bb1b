"""Typed names, place names, entity resolution, canonical lists and matching."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lodeframe.llm import canonical, entities, matching, names


@pytest.mark.parametrize(
    "typed, first",
    [
        ("The Golden Shovel No. 2 mine (shaft ~561 ft)", (("golden", "shovel"), 2)),
        ("“Juniper Bridle” Nr. 2 mine (east drift)", (("juniper", "bridle"), 2)),
        ("Blue vein, T0paz Spear Mng. Co.", (("topaz", "spear"), 0)),
        ("LEADEN CHERRY #2 Mine (No. 13 vein, 1944)", (("leaden", "cherry"), 2)),
        ("thunder sickle Two mine", (("thunder", "sickle"), 2)),
        ("sulphurranchno3", (("sulphurranch",), 3)),
        ("Charcoal Gauntlet IV", (("charcoal", "gauntlet"), 4)),
    ],
)
def test_parse(typed, first):
    assert names.parse(typed)[0] == first


def test_parse_alternatives_and_blanks():
    assert [a[0] for a in names.parse("Fortune Herald (Bootjack Temper)")] == [("fortune", "herald"), ("bootjack", "temper")]
    assert [a[0] for a in names.parse("Fiddle Mansion prospect; Inkwell Bench")] == [("fiddle", "mansion"), ("inkwell", "bench")]
    assert names.parse(None) == names.parse("") == names.parse("  ") == names.parse("???") == []


def test_slips_against_full_table():
    def osa(a, b):
        d = [[max(i, j) if not min(i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    rnd = random.Random(4)
    for _ in range(3000):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 6))) for _ in range(2))
        assert names.slips(a, b, 2) == min(osa(a, b), 3)


def test_alignment_is_optimal():
    rnd = random.Random(2)
    for _ in range(200):
        n = rnd.randint(1, 4)
        cost = [[rnd.choice([None, 0.0, 0.5, 1.0]) for _ in range(n)] for _ in range(n)]
        words = tuple(f"w{i}" for i in range(n))
        got = names.assign([{w: c for w, c in zip(words, r) if c is not None} for r in cost], words)
        sums = [sum(cost[i][j] for i, j in enumerate(p)) + 0.01 * (p != tuple(range(n))) for p in itertools.permutations(range(n)) if all(cost[i][j] is not None for i, j in enumerate(p))]
        assert (got is None) == (not sums) and (got is None or abs(got - min(sums)) < 1e-9)


def _resolved(spark, known, typed):
    lex = spark.createDataFrame([(" ".join(sorted(map(names.stem, w))), n) for w, n in known], "words string, n bigint")
    df = spark.createDataFrame([(" ".join(t),) for t in typed], "words string")
    return {r.words: r.target for r in names.resolve_words(df, lex).collect()}


def test_resolved_words(spark):
    known = [(("flinty", "musket"), 200), (("lucky", "peach"), 150), (("compass", "steeple"), 90), (("consul", "meadow"), 80), (("elk",), 30), (("king",), 60)]
    forms = ("flinty musk.", "flnty musket", "musket flinty", "flinty muskets", "flintymusket", "flinty mus ket", "fllinty musekt", "flintymuskett", "F. Musket", "flnty m.", "F. M.")
    typed = {w for f in forms for w, _ in names.parse(f)}
    got = _resolved(spark, known, [*typed, ("compas", "steeple"), ("meadow", "cons."), ("silver", "anvil"), ("kong",), ("elk",)])
    for f in forms:
        assert any(got.get(" ".join(w)) == "flinty musket" for w, _ in names.parse(f)), f
    assert got["compas steeple"] == "compa steeple" and got["meadow cons."] == "consul meadow"
    assert "silver anvil" not in got and got["kong"] == "king" and got["elk"] == "elk"
    assert _resolved(spark, known, []) == _resolved(spark, [], []) == _resolved(spark, [], [("a", "b")]) == {}


def test_resolved_words_against_all_pairs(spark):
    """The joins find what weighing every known name finds."""
    import math

    rnd = random.Random(11)
    words = ["golden", "shovel", "lucky", "peach", "wager", "organ", "cougar", "northern", "needle", "anvil", "bcn", "beacon"]

    def slip(w):
        i = rnd.randrange(len(w))
        return rnd.choice([w[:i] + w[i + 1 :], w[:i] + rnd.choice("aeo") + w[i:], w[: max(i, 1)] + ".", w, w, w[0]]) or w

    known = {}
    for _ in range(60):
        w = " ".join(sorted(map(names.stem, (slip(x).strip(".") for x in rnd.sample(words, rnd.choice([2, 2, 3]))))))
        known[w] = rnd.choice([1, 1, 2, 9, 80])
    typed = {tuple(map(slip, rnd.sample(words, rnd.choice([2, 2, 3])))) for _ in range(150)} | {tuple(k.split(" ")) for k in known}
    want = {}
    for t in typed:
        found = {}
        for k in known:
            kw = tuple(k.split(" "))
            costs = [c for c in [names.align(t, kw)] if c is not None]
            if names.squeeze(t) in (names.squeeze(kw), names.squeeze(reversed(kw))):
                costs.append(0.0 if len(t) == len(kw) else 0.02)
            if " ".join(sorted(map(names.stem, t))) == k:
                costs.append(0.0)
            if costs:
                found[k] = 4 * min(costs) - math.log(known[k])
        if found:
            want[" ".join(t)] = (min(found.values()), found)
    got = _resolved(spark, [(tuple(k.split(" ")), n) for k, n in known.items()], typed)
    for t, (least, found) in want.items():
        assert got[t] in found and found[got[t]] <= least + 0.05, (t, got[t], found)


def test_near_keys_of_long_strings():
    rnd = random.Random(5)
    for n in (45, 47, 48, 49, 50, 51, 60, 3000):
        for _ in range(20):
            a = "".join(rnd.choice("abcde") for _ in range(n))
            b = list(a)
            for _ in range(rnd.randint(0, 2)):
                i = rnd.randrange(len(b))
                b[i : i + 1] = rnd.choice([[], ["x"], [b[i], "y"]])
            assert names.near_keys("".join(b), 2, True) & names.near_keys(a, 2, False)


def _records(spark, rows):
    cols = "src string, id string, name string, further array<string>, state string, county string, district string, lat double, lon double, entity string"
    return spark.createDataFrame([(*r, "clash") for r in rows], cols)


def test_entities(spark):
    rows = [("rows", f"a{i}", "Golden Shovel mine", ["golden shovel"], "ID", "Ada", "Elk Creek", 44.0, -114.0) for i in range(12)]
    rows += [("rows", f"b{i}", "Golden Shovel", ["golden shovel"], "ID", "Boise", "Bear Gulch", 43.0, -115.0) for i in range(9)]
    rows += [("rows", f"n{i}", "Golden Shovel No. 2", None, "ID", "Ada", "Elk Creek", 44.0, -114.0) for i in range(5)]
    rows += [
        ("rows", "typo", "Goldn Shovel", None, "ID", "Ada Co.", None, None, None),
        ("rows", "nocounty", "Golden Shovel", None, "ID", None, "Bear Gulch", None, None),
        ("rows", "wrong", "Golden Shovel", None, "ID", "Blaine", "Elk Creek", 44.001, -114.001),
        ("rows", "alias1", "Inkwell Bench", ["golden shovel", "inkwell bench"], "ID", "Boise", None, None, None),
        ("reviewed", "r1", "Inkwell Bench mine", None, "ID", "Boise County", None, None, None),
        ("reviewed", "r2", "golden-shovel", None, "id", "Ada", None, None, None),
        ("rows", "null", None, None, "ID", "Ada", None, None, None),
        ("rows", "blank", "", [], None, "", "", float("nan"), 999.0),
    ]
    got = {r.id: r.entity for r in entities.resolve_records([_records(spark, rows)]).collect()}
    assert got["typo"] == got["a0"] == got["r2"] == got["wrong"]
    assert got["nocounty"] == got["b0"] == got["r1"] == got["alias1"]
    assert len({got["a0"], got["b0"], got["n0"]}) == 3
    assert "null" not in got and "blank" not in got


def test_entities_empty(spark):
    assert entities.resolve_records([_records(spark, [])]).count() == 0


def test_long_names_are_aligned():
    rnd = random.Random(3)
    for t in range(60):
        n = rnd.choice([7, 7, 8])
        cost = [[rnd.choice([None, None, 0.0, 0.4, 0.5, 1.0]) if i != j or t % 3 else 0.5 for j in range(n)] for i in range(n)]
        words = tuple(f"w{i}" for i in range(n))
        got = names.assign([{w: c for w, c in zip(words, r) if c is not None} for r in cost], words)
        sums = [sum(cost[i][j] for i, j in enumerate(p)) + 0.01 * (p != tuple(range(n))) for p in itertools.permutations(range(n)) if all(cost[i][j] is not None for i, j in enumerate(p))]
        assert (got is None) == (not sums) and (got is None or abs(got - min(sums)) < 1e-9)


def test_long_names_are_resolved(spark):
    known = ("anchor", "bridle", "cherry", "fiddle", "gopher", "herald", "inkwell", "juniper")
    typed = ("gophr", "anch.", "bridle", "juniper", "cherry", "fiddle", "herald", "inkwell")
    assert _resolved(spark, [(known, 3), (("anchor", "bridle"), 9)], [typed]) == {" ".join(typed): " ".join(known)}


def test_joined_spelling_does_not_outbid_an_aligned_name(spark):
    pairs = [("Blue Bird Hill", "Bluebird Hell"), ("Lone Wolf Camp", "Lonewolf Comp"), ("Gold Fish Bank", "Goldfish Bonk"), ("Iron Horse Tank", "Ironhorse Tonk")]
    rows = [("rows", f"{k}-{i}", n, None, "ID", "Ada", None, None, None) for k, (a, b) in enumerate(pairs) for i, n in enumerate([a] + [b] * 60)]
    assert len({r.entity for r in entities.resolve_records([_records(spark, rows)]).collect()}) == 8


def test_long_and_short_places(spark):
    rows = [("rows", f"a{i}", "Golden Shovel", None, "ID", "Ada", "x" * 6000, None, None) for i in range(5)]
    rows += [("rows", f"b{i}", "Golden Shovel", None, "ID", "Boise", "y" * 60, None, None) for i in range(5)]
    rows += [("rows", "clip", "Golden Shovel", None, "ID", "B.", None, None, None), ("rows", "long", "q" * 5000 + " mine", None, "ID", "Ada", None, None, None)]
    got = {r.id: (r.entity, r.county) for r in entities.resolve_records([_records(spark, rows)]).collect()}
    assert got["clip"][0] == got["b0"][0] != got["a0"][0] and got["clip"][1] == "boise" and len(got) == 12


# --- canonical lists ------------------------------------------------------------------------------

NAMES = [("Gold", 1), ("oro", 1), ("Silver", 2), ("silber", 2), ("Tungsten", 8), ("Gypsum", 22), ("gypsite", 22), ("Platinum", 27), ("plata", 2), ("Sand and Gravel", 23), ("sand & gravel", 23), ("w", 8)]


def test_trie_against_brute_force():
    t, rnd = canonical.Trie(NAMES), random.Random(1)
    plain = [(canonical.normal(n), k) for n, k in NAMES]
    for _ in range(1500):
        w = list(rnd.choice(plain)[0])
        for _ in range(rnd.randint(0, 3)):
            i, op = rnd.randrange(len(w) + 1), rnd.randrange(3)
            if op == 0:
                w.insert(i, rnd.choice("aglost "))
            elif w and i < len(w):
                w[i : i + 1] = [] if op == 1 else [rnd.choice("eiouz")]
        word = "".join(w)
        want = {}
        for n, k in plain:
            d = names.slips(word, n, 3)
            if d <= canonical.allowed(len(n)):
                want[k] = min(want.get(k, 9), d)
        assert dict((k, d) for d, k in t.search(word)) == want, word


def test_matches():
    t = canonical.Trie(NAMES)
    assert t.match("Gold (free-milling)") == t.match(" GOLD ?") == t.match("glod") == t.match("Gld.") == [1]
    assert t.match("sliver") == [2] and t.match("gyp") == [22] and t.match("Sand/Gravel") == [23] and t.match("W") == [8]
    for none in ("ore", "n/a", "?", "misc.", "pla", "timber", "", "x" * 5000):
        assert t.match(none) == []


def test_typed_ids(spark):
    df = spark.createDataFrame([("Gold, silver; ore",), ("n/a",), ("",), (" ",), (None,), ("gold\ngold",), ("Sand and Gravel / oro",), (",,",)], "c string")
    got = [r[0] for r in df.select(canonical.typed_ids(F.col("c"), NAMES)).collect()]
    assert got == [[0, 1, 2], [0], None, None, None, [1], [1, 23], None]


# --- matching ----------------------------------------------------------------------------------------


def test_belief_propagation_is_exact_on_trees(spark):
    import math

    edges = [("u1", "v1", 1.0), ("u1", "v2", 0.5), ("u2", "v2", 2.0), ("u3", "v3", -1.0)]
    got = {(r.u, r.v): r.p for r in matching.belief_propagation(spark.createDataFrame(edges, "u string, v string, logit double"), "u", "v", "logit").collect()}
    total, marg = 0.0, dict.fromkeys(got, 0.0)
    for on in itertools.product([0, 1], repeat=len(edges)):
        used = [e for e, o in zip(edges, on) if o]
        if len({e[0] for e in used}) == len(used) == len({e[1] for e in used}):
            w = math.exp(sum(e[2] for e in used))
            total += w
            for e in used:
                marg[e[:2]] += w
    assert all(abs(got[k] - marg[k] / total) < 1e-3 for k in got)


def test_belief_propagation_hot_node_and_empty(spark):
    e = spark.createDataFrame([("hub", f"v{i}", 3.0) for i in range(500)], "u string, v string, logit double")
    p = [r.p for r in matching.belief_propagation(e, "u", "v", "logit").collect()]
    assert len(p) == 500 and abs(sum(p) - 1) < 0.01
    assert matching.belief_propagation(e.limit(0), "u", "v", "logit").count() == 0
