"""Character-set damage: round trips through every pair, decoys, and edge cases."""

import pytest

from lodeframe.llm import encoding as E

SENTENCES = [
    "The mine near Señorita Flat was idle; the café kept “notes” — 45° to the north.",
    "La compañía cerró la fundición después de 1904, por falta de carbón, según el informe.",
    "L’échantillon prélevé à la galerie contenait très peu d’or près de la rivière.",
    "Die Hütte wurde später geschlossen, da Kohle und Löhne zu teuer waren; größtenteils Erz.",
    "The zone averages 1½ feet of quartz at £14 a month, sampled to ±3 µm.",
]
DECOYS = [
    "A Mina SÃO JOÃO fica no VALE DAS MAÇÃS, serra ÂNGELA.",
    "Le CHÂTEAU DE PÂTURE et la CÔTE ÂPRE figurent au plan.",
    "Шахта № 4 затоплена, руда бедная.",
    "Tabelle: ┌─┬─┐ │a│b│ └─┴─┘ und Ω, π, ≤, ∞.",
    "The form reads caf&eacute; and &amp;c., file A%C3%B1il, signs § ¶ † ¢ ® © ±.",
    "oﬃce and the\xa0age of 東山, labelled 鉱山",
]


def corpus():
    clean = [s for s in SENTENCES for _ in range(60)] + [s for s in DECOYS for _ in range(4)]
    bad = []
    for wrong in ("cp1252", "latin-1", "cp1251", "cp1250", "cp437", "cp850", "mac_roman"):
        for s in SENTENCES:
            bad.append((s, "".join(E._char(b, wrong) if b > 127 else chr(b) for b in s.encode())))
    for true, wrong in (("cp1252", "cp1251"), ("cp1252", "mac_roman"), ("cp437", "cp1252")):
        for s in SENTENCES[1:4]:
            try:
                bad.append((s, s.encode(true).decode(wrong)))
            except UnicodeError:
                pass
    return clean, bad


@pytest.fixture(scope="module")
def repaired(spark):
    clean, bad = corpus()
    texts = clean + [b for _, b in bad]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(9001, None, "x"), (9002, "", "x"), (9003, "plain ascii", "x")], "id int, text string, pair string")
    return len(clean), bad, {r.id: r for r in E.repair(df, "id", "text").collect()}


def test_clean_and_decoys_stay(repaired):
    n, _, got = repaired
    assert not [i for i in got if i < n or i > 9000]


def test_every_pair_is_found_and_most_restored(repaired):
    n, bad, got = repaired
    damaged = [(k, s, b) for k, (s, b) in enumerate(bad) if s != b]
    assert len([1 for k, _, _ in damaged if n + k in got]) >= 0.97 * len(damaged)
    assert len([1 for k, s, _ in damaged if n + k in got and got[n + k].restored_text == s]) >= 0.85 * len(damaged)


def test_lost_characters(spark):
    df = spark.createDataFrame([(1, "Caf� Gulch"), (2, "Café Gulch")], "id int, text string")
    got = {r.id: r.complete for r in E.repair(df, "id", "text").collect()}
    assert got == {1: False}


def test_empty_table(spark):
    assert E.repair(spark.createDataFrame([], "id int, text string"), "id", "text").count() == 0


def test_spans_cover_the_garbled_units(repaired):
    n, bad, got = repaired
    for k, (_, b) in enumerate(bad):
        r = got.get(n + k)
        for s in r.spans if r else []:
            assert b[s.start : s.end] == s.garbled


def test_shortcut_changes_no_label():
    """Texts that are taken for clean without the full search are those that the full search leaves alone."""
    import random

    clean, bad = corpus()
    texts = clean + [t for _, t in bad]
    counts = E.Contexts()
    for t in clean:
        counts.add(t, set())
    fast, full = E.Model(dict(counts.counts())), E.Model(dict(counts.counts()))
    full.surely_clean = lambda text, spots: False
    rnd, skipped = random.Random(4), 0
    mixed = [" ".join(rnd.sample(texts, 3)) for _ in range(150)]
    for costs in ((E.ENTER, E.LEAVE, E.STAY), E.EASY):
        fast.costs = full.costs = costs
        for t in [*set(texts), *mixed]:
            assert fast.label(t) == full.label(t), t
            skipped += fast.surely_clean(t, [m.start() for m in E._NOT.finditer(t)])
    assert skipped > 50


def test_sequences_by_run_are_those_of_the_whole_text():
    for _, t in corpus()[1]:
        whole = {}
        for state, pat in E._PATTERN.items():
            found = []
            for m in pat.finditer(t):
                try:
                    found.append((m.start(), m.end(), bytes(E._TO_BYTE[state][g] for g in m.group()).decode()))
                except UnicodeDecodeError:
                    pass
            if found:
                whole[f"utf-8>{state}"] = found
        assert {s: x for s, x in E.sequences(t).items() if s.count(">") == 1} == whole
