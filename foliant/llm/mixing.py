"""Mixing sources to target shares by Poisson replication (problem 7).

A text's number of uses is a Poisson variable with its source's repetition rate as mean, capped: the inverse distribution at a uniform number
hashed from seed and id. At which rate the first, second, ... use of a text sets in is then fixed by that number alone, so the rate with which a
source gives its target size can be read off the tokens that set in at each rate. They are added up in a fixed number of steps a source, around the
rate that is expected, so neither a sort nor a second pass over the texts is needed, and the shares come out as set although the draws are random.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions.text import source_key

STEPS = 4096


def mean_uses(rate: float, cap: int) -> float:
    """Mean of a Poisson variable of this rate, capped."""
    term = below = np.exp(-rate)
    mean = 0.0
    for j in range(1, cap + 1):
        mean += 1 - below  # chance of at least j
        term *= rate / j
        below += term
    return mean


def expected_rate(uses: float, cap: int) -> float:
    """The rate at which the capped mean is `uses`; where that is not below the cap, one at which all but a billionth of the texts reach it."""
    low, high = min(uses, 1e-300), 60.0 + 3 * cap
    if uses >= cap:
        return high
    for _ in range(200):
        mid = np.sqrt(low * high) if high > 4 * low else (low + high) / 2
        low, high = (mid, high) if mean_uses(mid, cap) < uses else (low, mid)
    return high


def rate_steps(expected: float, cap: int) -> np.ndarray:
    """STEPS growing rates, close together around the expected one, from a millionth of it to where all but a billionth of the texts reach the cap."""
    z = np.linspace(-1, 1, STEPS)
    top = max(1e6 * expected, 60.0 + 3 * cap)
    return expected * np.exp(np.where(z < 0, np.log(1e6) * z**3, np.log(top / expected) * z**3))


def onset_steps(u: np.ndarray, uses: int, rates: np.ndarray) -> np.ndarray:
    """For uniform numbers u: the step of the least of the rates at which Poisson's inverse at u reaches each of 1..uses; len(rates) where none does."""
    out, above = [], -np.expm1(-rates)  # chance of at least j
    term = np.exp(-rates)
    for j in range(1, uses + 1):
        # j uses set in where the chance of at least j reaches 1 - u; it grows with the rate
        out.append(np.searchsorted(above, 1 - u, side="left"))
        term = term * rates / j
        above = np.maximum.accumulate(np.maximum(above - term, 0))
    return np.stack(out, axis=1) if out else np.zeros((len(u), 0), int)


def mixed(sized: DataFrame, targets: DataFrame, total_tokens: int, source_col: str = "source", seed: int = 11, max_broadcast: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """The chosen texts and a report.

    sized: (item_id, <source_col>, n_tokens), as of with_token_counts. targets: (source, target_share, max_repeats); of several rows of one source that
    with the greatest share counts. Returns uses (item_id, source, n_tokens, n_uses, place) for n_uses >= 1, place being a hash in whose order the
    copies are spread, and a report (source, target_share, actual_share, target_tokens, actual_tokens, n_texts, n_uses, max_uses) with a row for every
    target. All texts of a source have one rate: that of the step whose tokens come nearest to the target, so the gap is at most half of the tokens
    that set in at one step, as a rule those of one text. A source too small for its target even with max_repeats uses of every text gives all it has.
    Texts without tokens, with a null id or of a source without a target are not used; repeated rows of an id count as one text (that with the most
    tokens). Spellings of a source that source_key makes equal are one; targets whose share or cap is null or not positive give nothing. Up to
    max_broadcast targets are broadcast, beyond they are joined by a shuffle.
    """
    wanted = (
        targets.select(source_key(F.col("source")).alias("key"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("cap"))
        .filter("key is not null").groupBy("key").agg(F.max(F.struct("target_share", "cap")).alias("x")).select("key", "x.target_share", "x.cap")
        .withColumn("target", F.col("target_share") * float(total_tokens))
    )
    small = wanted.count() <= max_broadcast
    few = F.broadcast if small else lambda df: df
    kind = sized.schema["item_id"].dataType.simpleString()
    texts = sized.select("item_id", source_key(F.col(source_col)).alias("key"), "n_tokens").filter("item_id is not null and n_tokens > 0")
    texts = texts.join(few(wanted.select("key")), "key", "left_semi").groupBy("item_id").agg(F.max(F.struct("n_tokens", "key")).alias("x")).select("item_id", "x.key", "x.n_tokens")

    def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["key", "cap"]].assign(expected=[expected_rate(t / n, int(c)) for t, n, c in zip(b["target"], b["size"], b["cap"])])

    held = texts.groupBy("key").agg(F.sum("n_tokens").alias("size"))
    goals = wanted.join(held, "key").filter("target > 0 and cap > 0").select("key", "target", "size", "cap").mapInPandas(expect, "key string, cap int, expected double")
    draw = (F.xxhash64(F.lit(seed), F.col("item_id").cast("string")).bitwiseAND(F.lit((1 << 53) - 1)) + 0.5) / float(1 << 53)
    drawn = texts.withColumn("u", draw).join(few(goals), "key")

    def onsets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (key, cap, expected), g in b.groupby(["key", "cap", "expected"], sort=False):
                steps = onset_steps(g["u"].to_numpy(), cap, rate_steps(expected, cap))
                yield pd.DataFrame({"item_id": g["item_id"].to_numpy(), "key": key, "n_tokens": g["n_tokens"].to_numpy(), "steps": list(steps.astype(np.int32))})

    stepped = drawn.mapInPandas(onsets, f"item_id {kind}, key string, n_tokens bigint, steps array<int>")
    # a source has at most STEPS + 1 rows here; of the running totals the one nearest to the target is taken, of two as near the lesser
    sums = stepped.select("key", "n_tokens", F.explode("steps").alias("step")).groupBy("key", "step").agg(F.sum("n_tokens").alias("tokens"))
    reached = sums.withColumn("reached", F.sum("tokens").over(W.partitionBy("key").orderBy("step")))
    none = wanted.select("key", F.lit(-1).alias("step"), F.lit(0).cast("bigint").alias("reached"))
    limits = reached.select("key", "step", "reached").unionByName(none).join(few(wanted.select("key", "target")), "key").groupBy("key").agg(F.min(F.struct(F.abs(F.col("reached") - F.col("target")).alias("gap"), "step")).alias("x")).select("key", F.col("x.step").alias("limit"))
    uses = (
        stepped.join(few(limits), "key")
        .withColumn("n_uses", F.size(F.filter("steps", lambda s: s <= F.col("limit"))))
        .filter("n_uses > 0")
        .select("item_id", F.col("key").alias("source"), "n_tokens", "n_uses", F.xxhash64(F.lit(seed + 1), F.col("item_id").cast("string")).alias("place"))
    )
    zero = F.lit(0).cast("bigint")
    actual = uses.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_uses")).alias("actual_tokens"), F.count("*").alias("n_texts"), F.sum("n_uses").alias("n_uses"), F.max("n_uses").alias("max_uses"))
    whole = actual.agg(F.sum("actual_tokens").alias("whole"))
    goal = wanted.select(F.col("key").alias("source"), "target_share", F.round("target").cast("bigint").alias("target_tokens"))
    report = (
        goal.join(actual, "source", "left").crossJoin(F.broadcast(whole))  # a single row
        .select(
            "source", "target_share", F.round(F.coalesce(F.col("actual_tokens") / F.col("whole"), F.lit(0.0)), 6).alias("actual_share"), "target_tokens",
            *[F.coalesce(F.col(c), zero).alias(c) for c in ("actual_tokens", "n_texts", "n_uses", "max_uses")],
        )
    )
    return uses, report


def shuffled_copies(uses: DataFrame, seed: int = 11) -> DataFrame:
    """(item_id, copy_no, place) for every use, in the order of place, a number hashed from seed, id and copy: the copies of all sources are spread over
    all partitions, and the order is the same however the texts were stored."""
    copies = uses.select("item_id", F.explode(F.sequence(F.lit(1), F.col("n_uses"))).alias("copy_no"))
    return copies.withColumn("place", F.xxhash64(F.lit(seed), F.col("item_id").cast("string"), "copy_no")).orderBy("place", "item_id", "copy_no")
