import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm.mixing import expected_rate, mean_uses, mixed, onset_steps, rate_steps, shuffled_copies
from foliant.llm.packing import fill, packed
from foliant.llm.tokens import TOKENIZERS, encoding, with_token_counts


def test_onsets_invert_poisson():
    u = np.array([0.05, 0.5, 0.9, 0.999])
    rates = rate_steps(0.7, 4)
    steps = onset_steps(u, 4, rates)
    assert (np.diff(rates) >= 0).all() and rates[0] < 1e-6 and rates[-1] > 60
    for uses, cap in ((1e-9, 3), (0.3, 1), (2.9, 3)):
        assert math.isclose(mean_uses(expected_rate(uses, cap), cap), uses, rel_tol=1e-5)
    for at in (500, 2100, 2800, 3500):
        for i, v in enumerate(u):
            n, total, term = 0, math.exp(-rates[at]), math.exp(-rates[at])
            while total < v * (1 - 1e-12) and n < 4:
                n += 1
                term *= rates[at] / n
                total += term
            assert (steps[i] <= at).sum() == n


def test_shares_and_caps(spark):
    sized = spark.sql("select id item_id, array(' A-x', 'b_y', 'c', 'other')[id % 4] source, 20 + id % 100 n_tokens from range(8000)")
    sized = sized.union(spark.sql("select 1, 'A-X', 21")).union(spark.sql("select null, 'c', 5")).union(spark.sql("select -1, null, 5")).union(spark.sql("select -2, 'c', 0"))
    targets = spark.createDataFrame([("a-x", 0.5, 1), ("b-y", 0.4, 3), ("c", 0.1, 4), ("none", 0.0, 2), ("gone", None, None)], "source string, target_share double, max_repeats int")
    uses, report = mixed(sized, targets, 150_000)
    r = {x.source: x for x in report.collect()}
    a = sized.filter("item_id % 4 = 0").agg(F.sum("n_tokens")).first()[0]
    assert r["b-y"].actual_tokens == pytest.approx(60_000, rel=0.01) and r["c"].actual_tokens == pytest.approx(15_000, rel=0.01)
    assert r["a-x"].actual_tokens == pytest.approx(min(75_000, a), rel=0.01) and r["none"].actual_tokens == 0 and r["gone"].n_uses == 0
    assert all(x.max_uses <= cap for x, cap in ((r["a-x"], 1), (r["b-y"], 3), (r["c"], 4)))
    got = uses.collect()
    assert len({x.item_id for x in got}) == len(got) and all(x.n_uses > 0 for x in got)
    assert sum(x.n_tokens * x.n_uses for x in got) == sum(x.actual_tokens for x in r.values())
    again = {x.item_id: x.n_uses for x in mixed(sized.repartition(7), targets, 150_000)[0].collect()}
    assert again == {x.item_id: x.n_uses for x in got}
    copies = shuffled_copies(uses).collect()
    assert len({(x.item_id, x.copy_no) for x in copies}) == len(copies) == sum(x.n_uses for x in got) and [x.place for x in copies] == sorted(x.place for x in copies)
    first = [x.item_id % 4 for x in copies[: len(copies) // 10]]
    assert len(set(first)) == 3  # every part of the order has all sources
    few = mixed(sized, targets.filter("source = 'c'"), 10**9)[1].first()
    assert few.max_uses == 4 and few.n_uses == 4 * few.n_texts == 4 * 2000
    assert mixed(sized.filter("false"), targets, 100)[0].count() == 0 and mixed(sized, targets.filter("false"), 100)[1].count() == 0


def test_source_of_a_million_times_its_target(spark):
    sized = spark.sql("select id item_id, 'big' source, 1000 n_tokens from range(400000)").union(spark.sql("select -1 - id, 'small', 7 from range(50)"))
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.5, 9)], "source string, target_share double, max_repeats int")
    uses, report = mixed(sized, targets, 4_000, max_broadcast=0)
    r = {x.source: x for x in report.collect()}
    assert r["big"].actual_tokens == 2_000 and r["small"].actual_tokens == pytest.approx(2_000, abs=25) and uses.filter("source = 'big'").count() == 2
    # long and short texts of a source have one rate
    both = spark.sql("select id item_id, 's' source, if(id % 2 = 0, 10, 3000) n_tokens from range(40000)")
    few = mixed(both, spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int"), 6_020_000)[0].collect()
    assert sum(x.n_tokens == 10 for x in few) == pytest.approx(2000, rel=0.1) and sum(x.n_tokens * x.n_uses for x in few) == pytest.approx(6_020_000, abs=1500)


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, "", "y"), (3, None, "z")], "id int, t string, n_tokens string")
    assert {r.item_id: r.n_tokens for r in with_token_counts(df, "id", "t", keep=["n_tokens"]).collect()} == {1: 2, 2: 0, 3: 0}


def test_fill_is_tight_and_lexical():
    rng = np.random.default_rng(2)
    sizes = rng.integers(20, 600, 3000)
    n = rng.integers(1, 30, 3000)
    topic = rng.integers(0, 40, 3000)
    terms = np.concatenate([topic[i] * 1000 + rng.integers(0, 200, n[i]) for i in range(3000)])
    container, place = fill(sizes, terms, n, 2048, 512)
    load = np.bincount(container, sizes)
    assert (container >= 0).all() and load.max() <= 2048 and len(load) <= math.ceil(sizes.sum() / 2048) + 3
    assert sorted(place[container == 0].tolist()) == list(range((container == 0).sum()))
    first = [np.bincount(topic[container == c]).max() / (container == c).sum() for c in range(100)]
    assert np.mean(first) > 0.3  # by chance it would be about 0.15


def test_packed_texts(spark):
    enc = encoding(TOKENIZERS)
    texts = ["word " * k for k in (10, 300, 700, 1, 2047, 5000, 40)] + ["", None, "  ", "word " * 300]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, "no id", 0)], "id int, text string, shard int")
    got = packed(df, "id", "text").collect()
    want = {i: len(enc.encode_ordinary(t)) for i, t in enumerate(texts) if t}
    by = {}
    for r in got:
        by.setdefault(r.item_id, []).append(r)
    assert {i: sum(r.n_tokens for r in rs) for i, rs in by.items() if i is not None} == want and len(by[None]) == 1
    assert sorted(r.n_tokens for r in by[5]) == [want[5] - 4096, 2048, 2048] and sorted(r.token_start for r in by[5]) == [0, 2048, 4096]
    assert all(len(rs) == 1 for i, rs in by.items() if i != 5)
    load = {}
    for r in got:
        load[r.container] = load.get(r.container, 0) + r.n_tokens
    assert max(load.values()) <= 2048 and len({(r.container, r.place) for r in got}) == len(got)
    assert packed(df.filter("false"), "id", "text").count() == 0


def test_related_texts_share_containers(spark):
    """Texts of one rare word stand together over all shards, and a word that all have makes no shard larger."""
    texts = [(i, " ".join(["common"] + [f"topic{i % 40}w{(i * 7 + j) % 9}" for j in range(60)])) for i in range(2000)]
    got = packed(spark.createDataFrame(texts, "id int, text string").repartition(5), "id", "text", capacity=4096, shard_rows=300).collect()
    inside = {}
    for r in got:
        inside.setdefault(r.container, []).append(r.item_id % 40)
    shards = {}
    for c, v in inside.items():
        shards[c.split("-")[0]] = shards.get(c.split("-")[0], 0) + len(v)
    assert len(got) == 2000 and max(shards.values()) < 900
    alike = [max(v.count(t) for t in v) / len(v) for v in inside.values()]
    assert np.mean(alike) > 0.7  # by chance it would be about 0.2
