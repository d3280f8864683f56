"""Filling containers of fixed capacity with lexically related texts (problem 6).

Texts are sorted by their rarest word that some others have too, and the order is cut into shards of a bounded number of rows. Each shard is a BM25
inverted index in one task: the longest unused text seeds a container, the index returns its unused neighbours, which fill the window in the order of
their scores up to a reserve; that is closed by the unused texts whose lengths fit it best, or, where none is related, filled by such texts alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.tokens import TOKENIZERS, encoding
from foliant.session import saved

_WORD = re.compile(r"[^\W_]+")
K1, B = 1.2, 0.75
SKETCH = 1 << 18


class Lexicon:
    """BM25 index over rows of terms, as flat arrays."""

    def __init__(self, terms: np.ndarray, sizes: np.ndarray):
        row = np.repeat(np.arange(len(sizes)), sizes)
        _, code = np.unique(terms, return_inverse=True)
        key, tf = np.unique(code.astype(np.int64) * len(sizes) + row, return_counts=True)
        self.n = len(sizes)
        term, self.row = key // self.n, key % self.n
        count = np.bincount(term)
        self.start = np.concatenate([[0], np.cumsum(count)])
        idf = np.log(1 + (self.n - count + 0.5) / (count + 0.5))
        length = sizes / max(sizes.mean(), 1e-9)
        self.weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[self.row]))
        own = np.argsort(self.row, kind="stable")
        self.own, self.count = term[own], count
        self.first = np.searchsorted(self.row[own], np.arange(self.n + 1))

    def scores(self, seed: int) -> np.ndarray:
        """Of every row, for all of the seed's terms that others share."""
        t = self.own[self.first[seed] : self.first[seed + 1]]
        t = t[self.count[t] > 1]
        if not len(t):
            return np.zeros(self.n)
        size = self.count[t]
        at = np.repeat(self.start[t] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(self.row[at], self.weight[at], self.n)


class Gaps:
    """Unused rows by length."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]
        for r in range(len(sizes) - 1, -1, -1):
            self.rows[sizes[r]].append(r)
        self.there = np.array([len(x) for x in self.rows])
        self.used = np.zeros(len(sizes), bool)

    def take(self, row: int, size: int) -> None:
        self.used[row] = True
        self.there[size] -= 1

    def pop(self, size: int) -> int:
        stack = self.rows[size]
        while self.used[stack[-1]]:
            stack.pop()
        row = stack.pop()
        self.take(row, size)
        return row

    def best(self, free: int) -> list[int]:
        """One or two unused lengths that fill `free` as far as one or two can."""
        some = self.there[: free + 1] > 0
        some[0] = False
        lengths = np.flatnonzero(some)
        if not len(lengths):
            return []
        one = int(lengths[-1])
        if one == free:
            return [one]
        low = int(lengths[0])
        for total in range(free, max(one, 2 * low - 1), -1):
            a = lengths[lengths <= total // 2]
            a = a[some[total - a]]
            a = a[(2 * a != total) | (self.there[a] > 1)]
            if len(a):
                return [int(total - a[-1]), int(a[-1])]
        return [one]


def fill(sizes: np.ndarray, terms: np.ndarray, term_sizes: np.ndarray, capacity: int, reserve: int) -> tuple[np.ndarray, np.ndarray]:
    """(container, place) of each row; sizes are from 1 to capacity. Neighbours are taken, best first, while more than `reserve` is free and they leave
    none of it negative."""
    index, gaps = Lexicon(terms, term_sizes), Gaps(sizes, capacity)
    container, place = np.full(len(sizes), -1), np.zeros(len(sizes), np.int64)
    number = 0
    for seed in np.argsort(-sizes, kind="stable"):
        if gaps.used[seed]:
            continue
        gaps.take(seed, sizes[seed])
        inside, free = [int(seed)], capacity - int(sizes[seed])
        if free > reserve:
            score = index.scores(int(seed))
            score[gaps.used] = 0
            near = np.flatnonzero((score > 0) & (sizes <= free))
            for r in near[np.argsort(-score[near], kind="stable")]:
                if free <= reserve:
                    break
                if sizes[r] <= free:
                    gaps.take(r, sizes[r])
                    inside.append(int(r))
                    free -= int(sizes[r])
        while free > 0 and (lengths := gaps.best(free)):
            for n in lengths:
                inside.append(gaps.pop(n))
                free -= n
        container[inside] = number
        place[inside] = np.arange(len(inside))
        number += 1
    return container, place


def packed(df: DataFrame, id_col: str, text_col: str, capacity: int = 2048, shard_rows: int = 4096, reserve: float = 0.25, company: int = 16, folder: str = TOKENIZERS) -> DataFrame:
    """(item_id, piece_no, token_start, n_tokens, container, place) for every text with tokens; container is an opaque string, place counts from 0.

    A text longer than `capacity` tokens becomes pieces of exactly that many and a rest; nothing else is split, and no container exceeds the
    capacity. Null and empty texts have no tokens and no row; rows with a null id and repeated rows are placed like any others. Other columns are
    ignored. Texts that share a word which at least `company` texts have, but no rarer one of that kind, stand together, so that neighbours are in one
    shard of about `shard_rows` texts; equal words are shared out by a hash, so no shard is larger for a word that all have. Every shard may leave one
    container partly filled. The last `reserve` of a container is left to lengths that fit.
    """
    given = df.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).filter("text <> ''")
    kind = given.schema["item_id"].dataType.simpleString()
    result = f"item_id {kind}, piece_no int, token_start bigint, n_tokens int, container string, place int"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(folder)
        known: dict[str, int] = {}
        for batch in batches:
            item, no, start, size, words, salt = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = enc.encode_ordinary(text)
                tokens = len(ids)
                rest = tokens % capacity
                mark = xxhash.xxh64_intdigest(text)
                for k in range(tokens // capacity + (rest > 0)):
                    whole = (k + 1) * capacity <= tokens
                    item.append(i)
                    no.append(k)
                    start.append(k * capacity)
                    size.append(capacity if whole else rest)
                    # a full container needs no neighbours
                    found = [] if whole else _WORD.findall((enc.decode(ids[k * capacity :]) if k else text).lower())
                    for w in found:
                        if w not in known:
                            known[w] = xxhash.xxh32_intdigest(w) - (1 << 31)
                    words.append([known[w] for w in found])
                    salt.append((mark + k * 0x9E3779B97F4A7C15) % (1 << 62))
            if len(known) > 1_000_000:
                known.clear()
            yield pa.RecordBatch.from_arrays([
                batch.column("item_id").take(pa.array(item, pa.int64())), pa.array(no, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int32()), pa.array(words, pa.list_(pa.int32())), pa.array(salt, pa.int64()),
            ], ["item_id", "piece_no", "token_start", "n_tokens", "words", "salt"])

    cut = saved(given.mapInArrow(pieces, f"item_id {kind}, piece_no int, token_start bigint, n_tokens int, words array<int>, salt bigint"), "pieces")
    n = cut.count()
    if not n:
        return df.sparkSession.createDataFrame([], result)
    counts = np.zeros(SKETCH, np.int64)  # texts that have a word, by hash
    seen = cut.select(F.explode(F.array_distinct("words")).alias("w")).groupBy(F.col("w").bitwiseAND(F.lit(SKETCH - 1)).alias("k")).count().toArrow()  # at most SKETCH rows
    counts[seen["k"].to_numpy()] = seen["count"].to_numpy()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            flat, size = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            row = np.repeat(np.arange(len(size)), size)
            often = counts[flat & (SKETCH - 1)]
            row, flat, often = row[often >= company], flat[often >= company], often[often >= company]
            order = np.lexsort((flat, often, row))
            row, flat = row[order], flat[order]
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
            key = batch.column("salt").to_numpy() >> 20  # where no word is shared, anywhere
            key = key % (1 << 32) - (1 << 31)
            key[row[first]] = flat[first]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], [*batch.schema.names, "key"])

    sorted_ = cut.mapInArrow(keyed, f"item_id {kind}, piece_no int, token_start bigint, n_tokens int, words array<int>, salt bigint, key bigint")
    # the order is total but for repeated rows, so shards are cut within the texts of a frequent word too
    ranged = sorted_.repartitionByRange(max(1, -(-n // shard_rows)), "key", "salt", "item_id").withColumn("shard", F.spark_partition_id())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        rows = pa.Table.from_batches(parts).combine_chunks().sort_by([("salt", "ascending"), ("piece_no", "ascending")])
        lists = rows["words"].combine_chunks()
        sizes = rows["n_tokens"].to_numpy().astype(np.int64)
        container, place = fill(sizes, lists.flatten().to_numpy(), lists.value_lengths().to_numpy(), capacity, int(reserve * capacity))
        names = pa.array([f"{k}-{c}" for k, c in zip(rows["shard"].to_pylist(), container)])
        yield from rows.select(["item_id", "piece_no", "token_start", "n_tokens"]).append_column("container", names).append_column("place", pa.array(place.astype(np.int32))).to_batches()

    return ranged.mapInArrow(pack, result)
