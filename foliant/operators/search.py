"""Ranked retrieval: full text, vectors, fusion of ranked lists."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.text import tokens
from foliant.session import saved


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, parts): each document's terms. Its rows are parts (dl, t): the length in terms and the terms. Rows of one length are one part, with the terms of all.

    An id that stands once stays in its row, so only the ids are exchanged; rows of repeated ids are brought together.
    """
    rows = docs.select(F.col(id_col).alias("doc"), tokens(F.col(text_col)).alias("t")).filter(F.size("t") > 0).select("doc", F.size("t").alias("dl"), "t")
    repeated = docs.groupBy(F.col(id_col).alias("again")).count().filter("count > 1").select("again")
    single = F.array(F.struct("dl", "t")).alias("parts")
    if repeated.isEmpty():
        return rows.select("doc", single)
    is_again = F.col("doc").eqNullSafe(F.col("again"))
    whole = rows.join(repeated, is_again, "left_semi").groupBy("doc", "dl").agg(F.flatten(F.collect_list("t")).alias("t"))
    return rows.join(repeated, is_again, "left_anti").select("doc", single).unionByName(whole.groupBy("doc").agg(F.collect_list(F.struct("dl", "t")).alias("parts")))


def _coded(batch: pa.RecordBatch, vocabulary: pa.Array) -> pa.RecordBatch:
    """A batch of postings() with numbers: of each document the lengths of its parts, how many rows each part is made of and how many terms of the vocabulary it
    has (dl, copies, n), and the numbers and frequencies of these (code, tf), part by part."""
    parts = batch.column("parts")
    flat = parts.flatten()
    dl, t = flat.field("dl"), flat.field("t")
    code = pc.index_in(t.flatten(), value_set=vocabulary)
    key = pc.list_parent_indices(t).filter(code.is_valid()).to_numpy().astype(np.int64) * len(vocabulary) + code.drop_null().to_numpy()
    key, tf = np.unique(key, return_counts=True)
    n = np.bincount(key // len(vocabulary), minlength=len(flat))
    start = np.append(0, np.cumsum(pc.list_value_length(parts).to_numpy()))  # parts before each document
    of_part = lambda x: pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(x, pa.int32()))
    of_term = lambda x: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n))[start], pa.int32()), pa.array(x, pa.int32()))
    copies = pc.list_value_length(t).to_numpy() // dl.to_numpy()
    return pa.RecordBatch.from_arrays([batch.column("doc"), of_part(dl), of_part(copies), of_part(n), of_term(key % len(vocabulary)), of_term(tf)], ["doc", "dl", "copies", "n", "code", "tf"])


def bm25(index: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, max_terms: int = 1_000_000, block: int = 64) -> DataFrame:
    """(query_id, doc, score, place) of the k best documents of postings() for each query; queries (query_id, term), terms being OR-ed. Equal scores are
    ordered by doc.

    The queries are broadcast, max_terms rows at a time, divided by a hash into as many passes as they need. The numbers and frequencies of the terms that
    they ask for are written once; nothing else of the documents is. Then every partition scores its documents against all queries and keeps its own
    k best of each. Terms that many queries share with many documents are summed by a matrix product, the others from their postings.
    """
    spark = index.sparkSession
    asked = queries.filter("term is not null").distinct()
    count = asked.count()
    if count > max_terms:
        asked, parts = saved(asked, "queries"), -(-2 * count // max_terms)
        passes = [asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) for i in range(parts)]
        return reduce(DataFrame.unionByName, [bm25(index, p, k, k1, b, max(max_terms, count), block) for p in passes])
    asked = asked.toArrow()
    kind, qkind = index.schema["doc"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {qkind}, doc {kind}, score double"
    if not asked.num_rows:
        return spark.createDataFrame([], schema + ", place int")
    query_ids, vocabulary = asked["query_id"].unique(), asked["term"].unique()
    number, code = pc.index_in(asked["query_id"], query_ids).to_numpy(), pc.index_in(asked["term"], vocabulary).to_numpy()
    order = np.lexsort((code, number))
    number, code = number[order], code[order]
    first, n_asking = np.searchsorted(number, np.arange(len(query_ids) + 1)), np.bincount(code, minlength=len(vocabulary))
    words = spark.sparkContext.broadcast(vocabulary)
    coded = index.mapInArrow(lambda batches: (_coded(x, words.value) for x in batches if x.num_rows), f"doc {kind}, dl array<int>, copies array<int>, n array<int>, code array<int>, tf array<int>")
    coded = saved(coded, "postings")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n_docs, n_terms = np.zeros(len(words.value), np.int64), 0, 0
        for batch in batches:
            dl, copies, code = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("dl", "copies", "code"))
            df, n_docs, n_terms = df + np.bincount(code, minlength=len(df)), n_docs + copies.sum(), n_terms + (dl * copies).sum()
        seen = np.flatnonzero(df)  # rows -1 and -2: documents and their terms in all
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, [-1, -2])), pa.array(np.append(df[seen], [n_docs, n_terms]))], ["code", "n"])

    total = {r.code: r.n for r in coded.select("dl", "copies", "code").mapInArrow(counted, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect()}
    n_docs, avg_dl = total.get(-1, 0), total.get(-2, 0) / max(total.get(-1, 0), 1)
    df = np.array([total.get(i, 0) for i in range(len(vocabulary))])
    shared = spark.sparkContext.broadcast((query_ids, first, code, n_asking, np.log(1 + (n_docs - df + 0.5) / (df + 0.5))))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, first, asked, n_asking, idf = shared.value
        top = np.zeros((len(query_ids), k))  # the k best scores so far of each query
        for batch in batches:
            if not batch.num_rows:
                continue
            dl, of_part, code, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("dl", "n", "code", "tf"))
            row, dl = pc.list_parent_indices(batch.column("code")).to_numpy(), np.repeat(dl, of_part)
            # rows are numbered in the order of doc, so of equal scores the first come first
            order, n = pc.array_sort_indices(batch.column("doc"), null_placement="at_start"), batch.num_rows
            docs, place = batch.column("doc").take(order), np.empty(n, np.int64)
            place[order.to_numpy()] = np.arange(n)
            row, weight = place[row], idf[code] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avg_dl))
            by_code = np.argsort(code, kind="stable")
            row, weight, code = row[by_code], weight[by_code], code[by_code]
            here = np.bincount(code, minlength=len(idf))
            end = np.cumsum(here)
            often = np.flatnonzero(here * n_asking > 0.01 * n * len(query_ids))
            column = np.full(len(idf), -1)
            column[often] = np.arange(len(often))
            dense = column[code]
            table = np.bincount(dense[dense >= 0] * n + row[dense >= 0], weight[dense >= 0], len(often) * n).reshape(len(often), n)
            found: list[tuple[int, np.ndarray, np.ndarray]] = []
            for a in range(0, len(query_ids), block):
                z = min(a + block, len(query_ids))
                mine = asked[first[a] : first[z]]
                has = np.zeros((z - a, len(often)))
                wide = column[mine] >= 0
                has[np.repeat(np.arange(z - a), np.diff(first[a : z + 1]))[wide], column[mine[wide]]] = 1
                for q, s in enumerate(has @ table, a):
                    terms = asked[first[q] : first[q + 1]]
                    terms = terms[(column[terms] < 0) & (here[terms] > 0)]
                    if len(terms):
                        cuts = [slice(end[t] - here[t], end[t]) for t in terms]
                        s += np.bincount(np.concatenate([row[c] for c in cuts]), np.concatenate([weight[c] for c in cuts]), n)
                    at = np.flatnonzero(s >= top[q, 0] - 1e-6) if top[q, 0] > 1e-6 else np.flatnonzero(s > 0)
                    r = np.floor(s[at] * 1e6 + 0.5) / 1e6
                    if len(at) > k:
                        least = np.partition(r, -k)[-k]
                        better, equal = np.flatnonzero(r > least), np.flatnonzero(r == least)
                        chosen = np.append(better, equal[: k - len(better)])
                        at, r = at[chosen], r[chosen]
                    at, r = at[r >= top[q, 0]], r[r >= top[q, 0]]
                    if len(at):
                        top[q] = np.sort(np.append(top[q], r))[-k:]
                        found.append((q, at, r))
            if found:
                q = np.repeat([x[0] for x in found], [len(x[1]) for x in found])
                at, r = np.concatenate([x[1] for x in found]), np.concatenate([x[2] for x in found])
                yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(q)), docs.take(pa.array(at)), pa.array(r)], ["query_id", "doc", "score"])

    return best(coded.select("doc", "dl", "n", "code", "tf").mapInArrow(scored, schema), "query_id", F.round("score", 6), "doc", k)


def best(scored: DataFrame, group: str, score: Column, tie: str, k: int) -> DataFrame:
    """The k rows of each group with the greatest score (replaced by `score`), with their place from 1."""
    w = W.partitionBy(group).orderBy(F.desc("score"), F.col(tie))
    return scored.withColumn("score", score).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def with_texts(hits: DataFrame, docs: DataFrame, id_col: str, text_col: str, max_broadcast: int = 1_000_000) -> DataFrame:
    """The hits (doc, ...) with the text of each of their documents' rows.

    The hits are written once. Up to max_broadcast of them are broadcast, so that texts stay where they are read; beyond, both are joined by a shuffle.
    """
    hits = saved(hits, "hits")
    hits = F.broadcast(hits) if hits.count() <= max_broadcast else hits
    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).join(hits, "doc")


def vector_topk(items: DataFrame, id_col: str, vector_col: str, queries: DataFrame, k: int = 10, metric: str = "cosine", max_queries: int = 100_000, block: int = 2048) -> DataFrame:
    """(query_id, item_id, score, place): exact nearest vectors of a stated set of queries (query_id, vector).

    The queries are broadcast, max_queries at a time, and every partition of the items is multiplied with them in blocks and keeps its own k best, so
    that k rows a query and partition are exchanged; more queries than that are divided by a hash into as many passes as they need. metric: cosine, or l2 with the score 1 / (1 + squared distance). An item is not its
    own neighbour; rows whose vector is null, of another length than the first query's, not finite or (cosine) zero are left out.
    """
    spark = items.sparkSession
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).filter("vector is not null")
    count = asked.count()
    if count > max_queries:
        asked, parts = saved(asked, "queries"), -(-2 * count // max_queries)
        passes = [asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) for i in range(parts)]
        return reduce(DataFrame.unionByName, [vector_topk(items, id_col, vector_col, p, k, metric, max(max_queries, count), block) for p in passes])
    asked = asked.toArrow()
    given = items.select(F.col(id_col).alias("item_id"), F.col(vector_col).cast("array<double>").alias("v"))
    kind, qkind = given.schema["item_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {qkind}, item_id {kind}, score double"
    if not asked.num_rows:
        return spark.createDataFrame([], schema + ", place int")
    dim = len(asked["vector"][0])
    asked = asked.filter(pa.array([len(v) == dim for v in asked["vector"]]))
    q = asked["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    if metric == "cosine":
        with np.errstate(all="ignore"):
            q = q / np.linalg.norm(q, axis=1, keepdims=True)
    usable = np.isfinite(q).all(axis=1)
    shared = spark.sparkContext.broadcast((q[usable], asked["query_id"].combine_chunks().filter(pa.array(usable))))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, ids = shared.value
        own = {x: i for i, x in enumerate(ids.to_pylist())}
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            with np.errstate(all="ignore"):
                if metric == "cosine":
                    x = x / np.linalg.norm(x, axis=1, keepdims=True)
            good = np.flatnonzero(np.isfinite(x).all(axis=1))
            x, items = x[good], batch.column("item_id").take(pa.array(good))
            if not len(x):
                continue
            # repeated rows count once; of an item with several vectors in the batch each may stand among the best
            code = items.dictionary_encode().indices.to_numpy().astype(np.int64)
            _, one = np.unique(np.column_stack([code, np.ascontiguousarray(x).view(np.int64)]), axis=0, return_index=True)
            x, items, code = x[one], items.take(pa.array(one)), code[one]
            most = min(k + len(code) - len(np.unique(code)), len(x))
            place = np.array([own.get(i, -1) for i in items.to_pylist()])
            for a in range(0, len(q), block):
                part = q[a : a + block]
                s = part @ x.T
                if metric != "cosine":
                    s = 1 / (1 + np.maximum((part**2).sum(axis=1)[:, None] + (x**2).sum(axis=1) - 2 * s, 0))
                mine = np.flatnonzero((place >= a) & (place < a + len(part)))
                s[place[mine] - a, mine] = -np.inf
                top = np.argpartition(-s, most - 1, axis=1)[:, :most]
                # scores that are equal when rounded must not depend on the batch: keep all that tie
                edge = np.take_along_axis(s, top, 1).min(axis=1)
                r, c = np.nonzero((s >= edge[:, None] - 1.1e-6) & np.isfinite(s))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(r + a)), items.take(pa.array(c)), pa.array(s[r, c])], ["query_id", "item_id", "score"])

    found = given.filter(F.size("v") == dim).mapInArrow(nearest, schema)
    return best(found.groupBy("query_id", "item_id").agg(F.max("score").alias("score")), "query_id", F.round("score", 6), "item_id", k)


def max_pool(hits: DataFrame, keys: list[str], score: str, text: str) -> DataFrame:
    """The best row of each group of keys: (keys, score, best_text, n_hits). Null scores count as hits but never win over others; of equal scores the
    least text wins."""
    return hits.groupBy(*keys).agg(F.max(score).alias("score"), F.min_by(text, F.struct(-F.coalesce(F.col(score), F.lit(float("-inf"))), F.col(text))).alias("best_text"), F.count("*").alias("n_hits"))


def min_max(scored: DataFrame, group: str, score: str = "score") -> DataFrame:
    """Adds `normalized`: the score between its group's least (0) and greatest (1); 1 where all are equal."""
    low, high = F.col("_low"), F.col("_high")
    # a join with the groups' extremes, as a window would hold a whole group in one task
    ends = scored.groupBy(group).agg(F.min(score).alias("_low"), F.max(score).alias("_high"))
    normal = F.when(high == low, 1.0).otherwise((F.col(score) - low) / (high - low))
    return scored.join(ends, group, "left").withColumn("normalized", normal).drop("_low", "_high")


def rrf(arms: list[tuple[DataFrame, float]], group: str, item: str, k: int = 60) -> DataFrame:
    """(group, item, score, n_arms): reciprocal rank fusion, the sum of weight / (k + place); an arm of weight 0 is left out, rows without a score
    have no place."""
    parts = None
    for arm, weight in arms:
        if weight:
            w = W.partitionBy(group).orderBy(F.desc("score"), F.col(item))
            part = arm.filter("score is not null").select(group, item, (F.lit(float(weight)) / (k + F.row_number().over(w))).alias("part"))
            parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        raise ValueError("no arm has a weight")
    return parts.groupBy(group, item).agg(F.sum("part").alias("score"), F.count("*").alias("n_arms"))


def dbsf(arms: list[tuple[DataFrame, float]], group: str, item: str, floor: float = 0.001) -> DataFrame:
    """(group, item, score, n_arms): distribution-based fusion, the weighted sum of the sigmoid of each arm's z-score."""
    parts = None
    for arm, weight in arms:
        given = arm.filter("score is not null")
        shape = given.groupBy(group).agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("spread"))
        z = (F.col("score") - F.col("mean")) / F.greatest(F.col("spread"), F.lit(floor))
        part = given.join(shape, group).select(group, item, (weight / (1 + F.exp(-z))).alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy(group, item).agg(F.sum("part").alias("score"), F.count("*").alias("n_arms"))


def feedback_terms(hits: DataFrame, group: str, text: str, k: int = 10, most: int = 3, least_length: int = 3) -> DataFrame:
    """(group, term, tf, score, place): expansion terms from the best k texts of each group (by `place`): terms that occur more than once, scored by
    their frequency relative to the most frequent one."""
    t = hits.filter(F.col("place") <= k).select(group, F.explode(tokens(F.col(text), least_length)).alias("term"))
    tf = t.groupBy(group, "term").agg(F.count("*").alias("tf")).filter("tf > 1")
    top = tf.groupBy(group).agg(F.max("tf").alias("_top"))
    scored = tf.join(top, group).withColumn("score", F.col("tf") / F.col("_top")).drop("_top")
    return best(scored, group, F.round("score", 6), "term", most)


def edit_neighbours(terms: DataFrame, vocabulary: DataFrame, most: int = 2) -> DataFrame:
    """(term, near, edits) for terms and vocabulary words (one column `term` each) that differ by 1 to `most` edits.

    Both sides are joined on what remains after deleting up to `most` letters: two words within that many edits share such a remainder. No pair is
    formed that shares none.
    """

    def remains(df: DataFrame, name: str) -> DataFrame:
        left = F.array(F.col(name))
        for _ in range(most):
            less = F.flatten(F.transform(left, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))))
            left = F.array_distinct(F.concat(left, less))
        return df.select(name, F.explode(left).alias("rest"))

    a = remains(terms.select("term").distinct(), "term")
    b = remains(vocabulary.select(F.col("term").alias("near")).distinct(), "near")
    met = a.join(b, "rest").select("term", "near").distinct()
    return met.withColumn("edits", F.levenshtein("term", "near")).filter(F.col("edits").between(1, most))


def synonym_terms(terms: DataFrame, synonyms: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, term, score, place): up to `most` expansions of each query's terms (query_id, term) by a small table (head, synonym): 0.9 for the synonyms
    of a term, 0.7 for those of a head within two edits of it. Terms that the query has already are none; of equal scores the least term comes first.

    The table of synonyms is a dictionary, not data; its heads meet the distinct terms in edit_neighbours(), so a misspelt term costs one comparison."""
    asked = terms.select("query_id", "term").distinct()
    exact = asked.join(synonyms, F.col("term") == F.col("head")).select("query_id", F.col("synonym").alias("new"), F.lit(0.9).alias("score"))
    heads = synonyms.select(F.col("head").alias("term")).distinct()
    near = edit_neighbours(heads, asked.select("term").distinct(), 2).select(F.col("term").alias("head"), F.col("near").alias("term"))
    spelt = asked.join(near, "term").join(synonyms, "head").select("query_id", F.col("synonym").alias("new"), F.lit(0.7).alias("score"))
    fresh = exact.unionByName(spelt).groupBy("query_id", "new").agg(F.max("score").alias("score"))
    fresh = fresh.join(asked.withColumnRenamed("term", "new"), ["query_id", "new"], "left_anti").withColumnRenamed("new", "term")
    return best(fresh, "query_id", F.col("score"), "term", most)


def reranked(hits: DataFrame, similarity: Column, score: str = "score", share: float = 0.4, k: int = 10, group: str = "query_id", tie: str = "item_id") -> DataFrame:
    """The k best hits of each group by share * score + (1 - share) * similarity; a null similarity counts as 0."""
    return best(hits.withColumn("score", share * F.col(score) + (1 - share) * F.coalesce(similarity, F.lit(0.0))), group, F.round("score", 6), tie, k)


@F.arrow_udf(T.ArrayType(T.StructType().add("start", "integer").add("stop", "integer")))
def _spans(low: pa.Array, terms: pa.Array) -> pa.Array:
    sizes, flat = [0], []
    for text, wanted in zip(low.to_pylist(), terms.to_pylist()):
        places, merged = [], []
        for t in wanted if text else []:
            at = text.find(t)
            while at >= 0:
                places.append((at, at + len(t)))
                at = text.find(t, at + len(t))
        for start, stop in sorted(places):
            if merged and merged[-1][1] >= start:
                merged[-1][1] = max(merged[-1][1], stop)
            else:
                merged.append([start, stop])
        flat += merged
        sizes.append(len(flat))
    both = np.array(flat, np.int32).reshape(-1, 2)
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["start", "stop"]))


def highlights(text: Column, terms: Column) -> Column:
    """Merged (start, stop) character spans, from 0, where any of the terms (an array, any case) stands in the text; overlapping and adjacent spans are one.
    A null text or null terms have none.

    Both are lower-cased by Spark, as tokens() does, and searched from place to place, so the time follows the places, not their square.
    """
    given = F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.length(t) > 0)
    return _spans(F.lower(text), F.transform(given, F.lower))
