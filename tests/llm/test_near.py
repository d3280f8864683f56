import itertools
import random
import re

import pytest

from foliant.llm.near import near_duplicate_classes, near_duplicate_groups, near_duplicate_pairs


def runs(text, words):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


def brute(texts, words, threshold):
    sets = {k: runs(t, words) for k, t in texts}
    return {(min(a, b), max(a, b)) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def corpus(seed, n, length, vocabulary, hot):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    phrase = " ".join(f"boiler{i}" for i in range(hot))
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            w = rng.choice(out)[1].split()
            for _ in range(rng.randrange(1 + len(w) // 5)):
                k, kind = rng.randrange(len(w)), rng.randrange(3)
                w[k : k + 1] = [[], [word()], [w[k], word()]][kind]
            out.append((f"k{i:03d}", " ".join(w)))
        else:
            body = [word() for _ in range(rng.randrange(3, length))]
            body.insert(rng.randrange(len(body)), phrase)
            out.append((f"k{i:03d}", " ".join(body)))
    return out


@pytest.mark.parametrize("words,threshold,band,length,vocabulary,hot", [(3, 0.5, 256, 40, 300, 12), (3, 0.5, 16, 120, 60, 20), (5, 0.8, 32, 80, 100, 30), (1, 0.5, 256, 12, 30, 2)])
def test_no_pair_is_lost(spark, words, threshold, band, length, vocabulary, hot):
    texts = corpus(words + band, 220, length, vocabulary, hot) + [("e0", ""), ("e1", "one"), ("e2", None), ("e3", "A_b c-d E f g h"), ("e4", "a B c D e F g H")]
    df = spark.createDataFrame([(k, t, "x") for k, t in texts + texts[:5]], "key string, text string, class_id string").repartition(3)
    members, links = near_duplicate_classes(df, "key", "text", words, threshold, band, max_broadcast=0 if band == 16 else 1000)
    got = {(r.key_a, r.key_b) for r in near_duplicate_pairs(members, links).collect()}
    want = brute(texts, words, threshold)
    assert len(want) > 20 and got == want
    groups = {r.item_id: r for r in near_duplicate_groups(members, links).collect()}
    assert all(groups[a].group_id == groups[b].group_id for a, b in want)


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([("a", None, 1)], "item_id string, runs string, h1 int")
    members, links = near_duplicate_classes(df, "item_id", "runs")
    assert members.count() == 0 and links.count() == 0 and near_duplicate_groups(members, links).count() == 0
    same = spark.createDataFrame([(i, "one two three four five six seven") for i in range(300)], "id int, t string")
    members, links = near_duplicate_classes(same, "id", "t")
    assert members.count() == 300 and links.count() == 0 and {r.class_id for r in members.collect()} == {0}
