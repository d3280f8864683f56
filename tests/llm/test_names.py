import random

import pytest

from foliant.llm.names import close_forms, link_names, typos

PEOPLE = [(1, "person", "David Kesilrick", []), (2, "person", "Élodie M. Ulmivane", []), (3, "person", "Edward Ostistnov-Wuxewyn", ["Eddie P. Ostistnov-Wuxewyn"]), (4, "person", "Tomás Ellidock", None),
          (5, "person", "Tony Ellidock", []), (6, "organization", "Dovelbel Robotics Brothers GmbH", []), (7, "organization", "Dovelbel Catering Inc", []), (8, "person", "Łukasz de la Branere", []),
          (9, "person", None, []), (None, "person", "Nobody Atall", []), (1, "person", "David Kesilrick", [])]


@pytest.mark.parametrize("typed,want", [
    ("David Kesilrick", 1), ("  david kesilrick ", 1), ("Kesilrick, David", 1), ("KESILRICK David", 1), ("D. Kesilrick", 1), ("Dave S. Kesilrick", 1), ("Dvaid Kesilrik", 1),
    ("david.kesilrick", 1), ("@dkesilrick", 1), ("David Kesilrick's", 1), ("Dr David Kesilrick,", 1), ("Dav. Kesilrick", 1), ("elodie ulmivane", 2), ("Ed Ostistnov-Wuxewyn", 3), ("Lukasz de la Branere", 8),
    ("Ellidock", None), ("T. Ellidock", None), ("Tomas Elidock", 4), ("Anthony Ellidock", 5), ("dvoelbel robotics", 6), ("Dovelbel Robo.", 6), ("Dovelbel Robotics Bros. G.m.b.H.", 6), ("Robotics, Dovelbel", 6),
    ("Dovelbel", None), ("me", None), ("Myself", None), ("Monday", None), ("?", None), ("", None), ("  ", None), ("Completely Different", None), ("x" * 5000, None), ("DRB", 6),
])
def test_variants(linked, typed, want):
    assert linked.get(typed) == want


@pytest.fixture(scope="module")
def linked(spark):
    cases = [m for m in test_variants.pytestmark if m.name == "parametrize"][0].args[1]
    names = spark.createDataFrame([(t, 0) for t, _ in cases] + [(None, 0), ("David Kesilrick", 0)], "n string, form int")
    entities = spark.createDataFrame(PEOPLE, "entity_id int, entity_type string, name string, aliases array<string>")
    return {r.typed_name: r.entity_id for r in link_names(names, "n", entities).collect()}


def test_empty(spark):
    entities = spark.createDataFrame(PEOPLE, "entity_id int, entity_type string, name string, aliases array<string>")
    names = spark.createDataFrame([("David Kesilrick",)], "n string")
    assert link_names(names.filter("false"), "n", entities).count() == 0
    assert link_names(names, "n", entities.filter("false")).count() == 0


def full_distance(a, b):
    d = [[max(i, j) if min(i, j) == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_banded_distance():
    rng = random.Random(3)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(8))) for _ in range(2))
        for most in (0, 1, 2):
            assert typos(a, b, most) == min(full_distance(a, b), most + 1)


def test_every_form_within_two_typos_is_met(spark):
    rng = random.Random(5)
    full = [f"{a} {b}" for a in ("orlin", "tamsin", "wexa") for b in ("brandock", "ulmivane", "garestad", "finelpike")]
    entities = spark.createDataFrame([(i, "person", n, []) for i, n in enumerate(full)], "entity_id int, entity_type string, name string, aliases array<string>")
    cases = {}
    for i, n in enumerate(full):
        for _ in range(25):
            w = list(n)
            for _ in range(2):
                k = rng.randrange(1, len(w) - 1)
                kind = rng.randrange(4)
                if " " in w[k - 1 : k + 2]:
                    continue
                w[k : k + 2] = [[w[k + 1], w[k]], [w[k], "q", w[k + 1]], [w[k]], ["q", w[k + 1]]][kind]
            if full_distance("".join(w), n) <= 2 and min((full_distance("".join(w), m), j) for j, m in enumerate(full) if j != i)[0] > 3:
                cases["".join(w)] = i
    got = {r.typed_name: r.entity_id for r in link_names(spark.createDataFrame([(c,) for c in cases], "n string"), "n", entities).collect()}
    assert len(cases) > 100 and got == cases


def test_close_forms_against_brute_force(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(2, 13))) for _ in range(60)]
    known, asked = set(words), set(words)
    for w in words:
        for _ in range(6):
            x = list(w)
            for _ in range(rng.randrange(3)):
                k = rng.randrange(len(x))
                x[k : k + 2] = rng.choice([x[k : k + 2][::-1], x[k : k + 1], ["e", *x[k : k + 2]], ["e", *x[k + 1 : k + 2]]])
            if len(x) > 1:
                asked.add("".join(x))
    got = {(r.form, r.known_form, r.typos) for r in close_forms(*(spark.createDataFrame([(w,) for w in s], "form string") for s in (asked, known)), 3).collect()}
    most = lambda n: 0 if n < 5 else 1 if n < 9 else 2
    assert got == {(a, b, full_distance(a, b)) for a in asked for b in known if full_distance(a, b) <= most(len(b))}


def test_words_that_are_no_names(spark):
    entities = spark.createDataFrame([(1, "organization", "Support", [])], "entity_id int, entity_type string, name string, aliases array<string>")
    names = spark.createDataFrame([("support",)], "n string")
    assert link_names(names, "n", entities).count() == 0 and link_names(names, "n", entities, no_names=frozenset()).count() == 1
