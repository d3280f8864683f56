import random

import numpy as np
import pytest

from foliant.llm.garbled import CLASSES, FREE, ciphers, garbled_texts, learned_table, letter_classes

WORDS = {
    "fr": "réunion congé dépôt coût élève prêt à vérifier théâtre intérêt déjà écarts relevés être façon où garçon".split(),
    "ru": "встреча комната обсуждаем ответ готовит компания прислала настройка следующий шаг исполнитель срок замена".split(),
    "pl": "później zgłoszenie książka źródło trwała środa sala łódź pętla następny krok święto część gałąź".split(),
    "en": "the plan isn’t done we’ve asked “twice” – Tomás and Jürgen wait … for the café report".split(),
}


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(1)
    rows, truth = [], {}
    ways = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "cp1251"), ("cp1252", "cp850"), ("cp1251", "koi8-r"), ("cp1250", "cp852"), ("utf-8", "mac_roman")]
    for i in range(900):
        lang = rng.choice(list(WORDS))
        clean = "\n".join(" ".join(rng.choice(WORDS[lang]) for _ in range(12)) + "." for _ in range(4))
        text = clean
        if i % 15 == 0:
            for written, read in rng.sample(ways, len(ways)):
                try:
                    bad = clean.encode(written).decode(read)
                except UnicodeError:
                    continue
                if bad != clean:
                    half = i % 30 == 0
                    text = bad if not half else "\n".join(bad.split("\n")[:2] + clean.split("\n")[2:])
                    truth[i] = clean
                    break
        rows.append((i, text, rng.choice([None, "src-a", "SRC_A ", "src-b"]), "x"))
    rows += [(2000, None, "src-a", "x"), (2001, "", "src-a", "x"), (2002, "plain ascii", None, "x"), (2003, "lost � sign", "src-a", "x"), (2004, "isn\x92t", "src-b", "x")]
    df = spark.createDataFrame(rows + rows[:3], "doc int, text string, source string, cipher string")
    return {r.item_id: r for r in garbled_texts(df, "doc", "text", "source").collect()}, truth, df


def test_cases(found):
    got, truth, _ = found
    assert len(truth) > 40 and set(got) == set(truth) | {2003, 2004}


def test_originals(found):
    got, truth, _ = found
    right = sum(got[i].restored == t for i, t in truth.items())
    assert right >= 0.9 * len(truth)
    assert not got[2003].complete and got[2003].restored is None


def test_empty(found):
    df = found[2]
    assert garbled_texts(df.filter("false"), "doc", "text", "source").count() == 0
    assert garbled_texts(df.filter("doc = 2002"), "doc", "text", "source", restore=False).count() == 0


def test_every_cipher_is_undone():
    c = ciphers()
    text = "«Ещё» grüßen źródło naïve’s"
    for k, name in enumerate(c.names):
        written, read = name.removesuffix(" twice").split(" as ")
        for part in text.split(" "):
            try:
                bad = part.encode(written).decode(read)
                if name.endswith("twice"):
                    bad = bad.encode(written).decode(read)
            except UnicodeError:
                continue
            if bad != part:
                assert c.undo(k, bad) == part, (name, part)


def test_page_that_no_pair_explains(spark):
    """A source read with an invented page: its table is learned from bigrams alone."""
    rng = random.Random(4)
    words = "ąžuolas žąsis šuo šeši ėjimas gėlė ūkis žuvų miškų namų vaikų lašas šviesa žvaigždė mėlynė pelė rūta būtų kūrė sąjunga žąsų ačiū čia kačių ečia į įėjo įmonė ęsti tęsia gręžė mįslė".split()
    page = dict(zip("ąčęėįšųūž", "¢£¥§©®±µ¶"))
    rows, truth = [], {}
    for i in range(700):
        clean = " ".join(rng.choice(words) for _ in range(25))
        bad = i % 14 == 0
        rows.append((i, clean.translate(str.maketrans(page)) if bad else clean, "src-x" if bad or i % 3 == 0 else "src-y"))
        if bad:
            truth[i] = clean
    got = {r.item_id: r for r in garbled_texts(spark.createDataFrame(rows, "doc int, text string, source string"), "doc", "text", "source").collect()}
    assert set(got) == set(truth) and all(FREE in r.ciphers for r in got.values())
    pairs = [(a, b) for i in truth for a, b in zip(got[i].restored.split(" "), truth[i].split(" "))]
    assert sum(a == b for a, b in pairs) > 0.9 * len(pairs)


def test_learned_table_of_a_text_with_no_known_letter():
    """All letters are unknown, so each is learned from the others' expected ones."""
    rng = np.random.default_rng(3)
    sample = " ".join(rng.choice("встреча комната обсуждаем ответ готовит компания прислала настройка следующий шаг срок замена вечер хорошо завтра письмо работа".split(), 4000))
    x = letter_classes(sample)
    logs = np.log((np.bincount(x[:-1] * CLASSES + x[1:], minlength=CLASSES * CLASSES).reshape(CLASSES, CLASSES) + 0.01) / (np.bincount(x, minlength=CLASSES)[:, None] + 0.01 * CLASSES)).astype(np.float32)
    letters = np.unique(x[x > 127])
    symbols = 0x2200 + rng.permutation(len(letters))
    text = np.array([ord(c) for c in sample[:20000]])
    lower = np.searchsorted(letters, text)
    text = np.where(text > 127, symbols[np.minimum(lower, len(letters) - 1)], text)
    pairs, n = np.unique(np.stack([text[:-1], text[1:]], 1), axis=0, return_counts=True)
    count = np.bincount(x, minlength=CLASSES)[letters] / (x > 127).sum()
    best, p = learned_table(np.sort(symbols), pairs[:, 0], pairs[:, 1], n.astype(float), logs, letters, np.tile(np.log(count), (len(symbols), 1)))
    right = letters[best] == letters[np.argsort(symbols)]
    assert right.mean() > 0.7
