"""The most similar vectors of a vector, over navigable small-world graphs (problem 3).

The vectors are divided by direction into cells, in proportion to their number: middles are fitted on a bounded sample, and beyond `fan` cells on
two levels, the second within every cell of the first. A cell larger than four shards is divided by a salted hash. Every shard becomes a layered
graph in one task, held as flat neighbour arrays. A row is sent to its own cell, and as a query to all cells whose middle is nearly as similar to it;
there blocks of queries that are alike walk the graph together. The shards' best are merged for each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.session import saved


def usable_vectors(df: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """(item_id, unit) of the rows whose vector has `dim` finite numbers, not all zero; unit is the vector at length 1."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            with np.errstate(all="ignore"):
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
            good = np.flatnonzero(np.isfinite(x).all(axis=1))
            flat = pa.array(x[good].astype(np.float32).ravel())
            lists = pa.ListArray.from_arrays(np.arange(0, dim * (len(good) + 1), dim, dtype=np.int32), flat)
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(good)), lists], ["item_id", "unit"])

    given = df.select(F.col(id_col).alias("item_id"), F.col(vector_col).cast("array<float>").alias("v")).filter((F.size("v") == dim) & F.col("item_id").isNotNull())
    return given.mapInArrow(scale, f"item_id {given.schema['item_id'].dataType.simpleString()}, unit array<float>")


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def spherical_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k middles of unit vectors, each of length 1."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        norm = np.linalg.norm(total, axis=1)
        c = np.where(norm[:, None] > 0, total / np.maximum(norm, 1e-12)[:, None], c)
    return c


def link(x: np.ndarray, nodes: np.ndarray, m: int, candidates: int, rng: np.random.Generator) -> np.ndarray:
    """Flat neighbour array of one layer: row i holds up to 2m of `nodes` for node nodes[i], -1 where there are fewer."""
    n = len(nodes)
    u = x[nodes]
    width = 2 * m
    c = min(candidates, n - 1)
    if c < 1:
        return np.full((n, width), -1, np.int32)
    src, dst, sim = [], [], []
    for a in range(0, n, 1024):
        s = u[a : a + 1024] @ u.T
        own = np.arange(len(s))
        s[own, a + own] = -2
        near = np.argpartition(-s, c - 1, axis=1)[:, :c]
        score = np.take_along_axis(s, near, 1)
        order = np.argsort(-score, axis=1, kind="stable")
        near, score = np.take_along_axis(near, order, 1), np.take_along_axis(score, order, 1)
        # a candidate stays if none kept before it is more similar to it than the node itself is: links then lead in different directions
        between = np.matmul(u[near], u[near].transpose(0, 2, 1))
        kept = np.zeros(near.shape, bool)
        for j in range(c):
            rival = np.where(kept[:, :j], between[:, j, :j], -2).max(axis=1, initial=-2)
            kept[:, j] = (rival <= score[:, j]) & (kept[:, :j].sum(axis=1) < m)
        kept[:, : min(4, c)] = True
        i, j = np.nonzero(kept)
        src.append(i + a)
        dst.append(near[i, j])
        sim.append(score[i, j])
    # two links of every node go anywhere, so that no knot of copies is an island
    far = rng.integers(0, n, (n, 2)).ravel()
    i = np.repeat(np.arange(n), 2)
    i, far = i[i != far], far[i != far]
    s, t = np.concatenate([*src, *dst, i]), np.concatenate([*dst, *src, far])
    w = np.concatenate([*sim, *sim, np.full(len(i), 2, np.float32)])
    order = np.lexsort((t, -w, s))
    s, t = s[order], t[order]
    key = s.astype(np.int64) * n + t
    _, first = np.unique(key, return_index=True)
    first.sort()
    s, t = s[first], t[first]
    rank = np.arange(len(s)) - np.searchsorted(s, s, "left")
    flat = np.full((n, width), -1, np.int32)
    short = rank < width
    flat[s[short], rank[short]] = nodes[t[short]]
    return flat


class Graph:
    """Layered small-world graph over the rows of x (of length 1)."""

    def __init__(self, x: np.ndarray, m: int = 16, candidates: int = 32, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.x = x
        level = np.minimum((-np.log(1 - rng.random(len(x))) / np.log(m)).astype(int), 8)
        self.layers = []
        for k in range(level.max(initial=0) + 1):
            nodes = np.flatnonzero(level >= k)
            if k and len(nodes) < 2 * m:
                break
            row = np.full(len(x), -1, np.int32)
            row[nodes] = np.arange(len(nodes))
            self.layers.append((nodes, row, link(x, nodes, m, candidates, rng)))

    def _walk(self, layer: int, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities) of all nodes that a best-first walk over one layer from entry meets. A node is opened once it is among the ef best of
        any query of the block; all queries are compared with all nodes met."""
        _, row, flat = self.layers[layer]
        seen = np.zeros(len(self.x), bool)
        nodes = np.unique(entry)
        seen[nodes] = True
        score = q @ self.x[nodes].T
        opened = np.zeros(len(nodes), bool)
        while True:
            worst = len(nodes) - min(ef, len(nodes))
            edge = np.partition(score, worst, axis=1)[:, worst]
            due = (score >= edge[:, None]).any(axis=0) & ~opened
            if not due.any():
                return nodes, score
            opened |= due
            new = np.unique(flat[row[nodes[due]]])
            new = new[new >= 0]
            new = new[~seen[new]]
            seen[new] = True
            nodes, opened = np.concatenate([nodes, new]), np.concatenate([opened, np.zeros(len(new), bool)])
            score = np.concatenate([score, q @ self.x[new].T], axis=1)

    def search(self, q: np.ndarray, k: int, ef: int = 16, block: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of about the k best rows for each row of q, best first; id -1 where there are fewer.

        On every layer the queries that entered at one node go on together, in blocks."""
        ids, best = np.full((len(q), k), -1, np.int64), np.full((len(q), k), -2, np.float32)
        top = self.layers[-1][0]
        near = top[np.concatenate([np.argmax(q[a : a + 4096] @ self.x[top].T, axis=1) for a in range(0, len(q), 4096)])] if len(q) else top[:0]
        for layer in range(len(self.layers) - 2 if len(self.layers) > 1 else 0, -1, -1):
            order, below = np.argsort(near, kind="stable"), near.copy()
            for a in range(0, len(q), block):
                mine = order[a : a + block]
                nodes, score = self._walk(layer, q[mine], near[mine], max(ef, k) if not layer else 8)
                if layer:
                    below[mine] = nodes[np.argmax(score, axis=1)]
                    continue
                m = min(k, len(nodes))
                some = np.argpartition(-score, m - 1, axis=1)[:, :m]
                found = np.take_along_axis(score, some, 1)
                rank = np.argsort(-found, axis=1, kind="stable")
                ids[mine, :m], best[mine, :m] = nodes[np.take_along_axis(some, rank, 1)], np.take_along_axis(found, rank, 1)
            near = below
        return ids, best


class Cells:
    """Middles of all cells, and over them those of the first level with the place where their cells begin."""

    def __init__(self, first: np.ndarray, parts: list[np.ndarray] | None = None):
        self.first, self.flat = first, parts is None
        self.middles = first if parts is None else np.concatenate(parts)
        self.start = np.concatenate([[0], np.cumsum([len(p) for p in parts])]) if parts else None

    def near(self, x: np.ndarray, margin: float, most: int, reach: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell), each row's most similar cell first, then all that are less similar by up to margin, `most` at most. On two levels those
        within the `reach` most similar of the first."""
        rows, cells = [], []
        for a in range(0, len(x), 1024):
            part = x[a : a + 1024]
            if self.flat:
                s = part @ self.first.T
                r, c = np.nonzero(s >= s.max(axis=1, keepdims=True) - margin)
                s = s[r, c]
            else:
                upper = np.argsort(-(part @ self.first.T), axis=1, kind="stable")[:, :reach]
                found = []
                for k in np.unique(upper).tolist():
                    mine = np.flatnonzero((upper == k).any(axis=1))
                    inner = part[mine] @ self.middles[self.start[k] : self.start[k + 1]].T
                    r, c = np.nonzero(inner >= inner.max(axis=1, keepdims=True) - margin)
                    found.append((mine[r], c + self.start[k], inner[r, c]))
                r, c, s = (np.concatenate(v) for v in zip(*found))
                best = np.full(len(part), -2, np.float32)
                np.maximum.at(best, r, s)
                good = s >= best[r] - margin
                r, c, s = r[good], c[good], s[good]
            order = np.lexsort((c, -s, r))
            r, c = r[order], c[order]
            kept = np.arange(len(r)) - np.searchsorted(r, r, "left") < most
            rows.append(r[kept] + a)
            cells.append(c[kept])
        return np.concatenate(rows), np.concatenate(cells).astype(np.int32)


def vector_sample(units: DataFrame, n: int, rows: int, dim: int) -> np.ndarray:
    """About `rows` vectors of the n there are, 2 * rows at most."""
    drawn = matrix(units.sample(min(1.0, 1.2 * rows / n), seed=7).select("unit").limit(2 * rows).toArrow()["unit"], dim)
    return drawn if len(drawn) else matrix(units.select("unit").limit(rows).toArrow()["unit"], dim)


def fit_cells(units: DataFrame, n: int, dim: int, shard_rows: int, fan: int, max_cells: int, sample_rows: int) -> Cells:
    """One cell for `shard_rows` vectors, max_cells at most; on two levels where that are more than `fan`."""
    wanted = min(max_cells, -(-n // shard_rows))
    first = spherical_means(vector_sample(units, n, sample_rows, dim), wanted if wanted <= fan else int(np.ceil(np.sqrt(wanted))))
    if wanted <= fan:
        return Cells(first)
    upper = Cells(first)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(upper.near(matrix(batch.column("unit"), dim), 0, 1)[1]), batch.column("unit")], ["cell", "unit"])

    placed = units.select("unit").mapInArrow(place, "cell int, unit array<float>")
    sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # one row a cell of the first level
    share = F.get(F.array(*[F.lit(min(1.0, sample_rows / max(1, sizes.get(c, 0)))) for c in range(len(first))]), F.col("cell"))

    def divide(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        x = matrix(rows["unit"], dim)
        inner = spherical_means(x, max(1, round(sizes[key[0].as_py()] * wanted / n)), rounds=8)
        lists = pa.ListArray.from_arrays(np.arange(0, dim * (len(inner) + 1), dim, dtype=np.int32), pa.array(inner.astype(np.float32).ravel()))
        return pa.table({"cell": pa.array(np.full(len(inner), key[0].as_py(), np.int32)), "unit": lists})

    # a bounded sample of every cell of the first level, so no group is larger than about sample_rows
    inner = placed.filter(F.rand(11) < share).groupBy("cell").applyInArrow(divide, "cell int, unit array<float>").toArrow()  # max_cells rows
    cell, middles = inner["cell"].to_numpy(), matrix(inner["unit"], dim)
    return Cells(first, [middles[cell == c] if (cell == c).any() else first[c : c + 1] for c in range(len(first))])


def crowds(units: DataFrame, k: int, max_broadcast: int) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """What is left of units without the copies of vectors that more than k items have, but for the least k + 1 ids of each; these items'
    (item_id, mark); and (mark, leaders) with those least ids. None where no vector is so frequent."""
    marked = units.withColumn("mark", F.struct(F.xxhash64("unit").alias("a"), F.hash("unit").alias("b")))
    many = marked.groupBy("mark").count().filter(F.col("count") > k).select("mark")
    few = saved(marked.join(many, "mark", "left_semi").groupBy("mark").agg(F.count_distinct("item_id").alias("n")).filter(F.col("n") > k).select("mark"), "crowds")
    count = few.count()
    if not count:
        return None
    few = F.broadcast(few) if count <= max_broadcast else few
    inside = marked.join(few, "mark", "left_semi")
    members = inside.select("item_id", "mark").distinct()
    first = W.partitionBy("mark").orderBy("item_id")  # filtered by rank: every task sends on k + 1 rows of a mark
    leaders = saved(members.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1).groupBy("mark").agg(F.sort_array(F.collect_list("item_id")).alias("leaders")), "leaders")
    kept = inside.groupBy("mark").agg(F.first("unit").alias("unit")).join(leaders, "mark").select(F.explode("leaders").alias("item_id"), "unit")
    rest = marked.join(few, "mark", "left_anti").select("item_id", "unit")
    return rest.unionByName(kept), members, F.broadcast(leaders) if count <= max_broadcast else leaders


def most_similar(
    df: DataFrame, id_col: str, vector_col: str, queries: DataFrame | None = None, dim: int = 64, k: int = 10, shard_rows: int = 4096, fan: int = 256,
    max_cells: int = 65_536, sample_rows: int = 20_000, margin: float = 0.15, max_visits: int = 64, ef: int = 16, m: int = 16, max_broadcast: int = 100_000,
) -> DataFrame:
    """(query_id, item_id, similarity, place): the k items most similar by cosine to each query, without the query itself; place counts from 1.

    queries: one column of ids, all of df where it is None; ids that are not usable get no rows. A row is usable if its id is not null and its
    vector has `dim` finite numbers, not all zero. Each id counts once, repeated rows of one vector too; of an id with several vectors each is
    searched and the best similarity counts. Equal similarities are ordered by item_id. Other columns are ignored. An empty table gives no rows.

    The result is approximate (recall in the README). A query visits the cells whose middle is less similar to it than the nearest one's by up to
    `margin`, `max_visits` at most, and keeps `ef` nodes open in graphs of up to 2 * `m` links a node; neither grows with the data. The middles are
    fitted on about `sample_rows` vectors, and as many of each cell of the first level; all vectors are indexed. A vector that more than k items share
    is indexed for the least k + 1 of them, and its items have each other as neighbours, so no number of copies crowds a shard. Beyond max_cells *
    shard_rows vectors the shards grow, and beyond four times that each visit searches several.
    """
    spark = df.sparkSession
    units = saved(usable_vectors(df, id_col, vector_col, dim), "units")
    kind = units.schema["item_id"].dataType.simpleString()
    result = f"query_id {kind}, item_id {kind}, similarity double, place int"
    n = units.count()
    if not n:
        return spark.createDataFrame([], result)
    asked = None if queries is None else queries.select(F.col(queries.columns[0]).alias("asked")).filter("asked is not null").distinct()
    crowd, of_crowds = crowds(units, k, max_broadcast), None
    if crowd:
        units, members, leaders = crowd
        units = saved(units, "units")
        if asked is not None:
            members = members.join(asked, F.col("item_id") == F.col("asked"), "left_semi")
        others = F.slice(F.filter("leaders", lambda x: x != F.col("item_id")), 1, k)
        of_crowds = members.join(leaders, "mark").select(F.col("item_id").alias("query_id"), F.transform(others, lambda x: F.struct(F.lit(-1.0).cast("float").alias("s"), x.alias("item_id"))).alias("hits"))
        n = units.count()
    cells = fit_cells(units, n, dim, shard_rows, fan, max_cells, sample_rows)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(cells.near(matrix(batch.column("unit"), dim), 0, 1)[1])], ["cell"])

    sizes = units.select("unit").mapInArrow(place, "cell int").groupBy("cell").count().toArrow()  # at most max_cells rows
    shards = np.ones(len(cells.middles), np.int64)
    shards[sizes["cell"].to_numpy()] = np.maximum(1, -(-sizes["count"].to_numpy() // (4 * max(shard_rows, n // max_cells))))
    sent_schema = f"item_id {kind}, unit array<float>, cell int, shard int, is_item boolean, is_query boolean"

    def visits(all_ask: bool, all_items: bool):  # noqa: ANN202
        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                row, cell = cells.near(matrix(batch.column("unit"), dim), margin if all_ask else 0, max_visits if all_ask else 1)
                first = np.concatenate([[True], row[1:] != row[:-1]])
                own = batch.column("salt").to_numpy()[row] % shards[cell]
                # a query goes to every shard of a cell, an item to one shard of its first cell
                times = shards[cell] if all_ask else np.ones(len(cell), np.int64)
                at = np.repeat(np.arange(len(cell)), times)
                shard = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times) if all_ask else own
                item = first[at] & (shard == own[at]) & all_items
                taken = pa.array(row[at])
                yield pa.RecordBatch.from_arrays([batch.column("item_id").take(taken), batch.column("unit").take(taken), pa.array(cell[at]), pa.array(shard.astype(np.int32)), pa.array(item), pa.array(np.full(len(at), all_ask))], ["item_id", "unit", "cell", "shard", "is_item", "is_query"])

        return send

    # salted, so that the many rows of one item don't share a shard; its hits from several shards are one again below
    salted = units.withColumn("salt", F.xxhash64("item_id", F.floor(F.rand(7) * 1024)).bitwiseAND(F.lit((1 << 40) - 1)))
    if asked is None:
        sent = salted.mapInArrow(visits(True, True), sent_schema)
    else:
        sent = salted.mapInArrow(visits(False, True), sent_schema).unionByName(salted.join(asked, F.col("item_id") == F.col("asked"), "left_semi").mapInArrow(visits(True, False), sent_schema))
    hit_schema = f"query_id {kind}, hits array<struct<s: float, item_id: {kind}>>"

    def search(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        inside, asks = rows.filter(rows["is_item"]), rows.filter(rows["is_query"])
        own = asks["item_id"].combine_chunks()
        if not inside.num_rows or not asks.num_rows:
            found, score, code, names = np.zeros((0, k + 1), np.int64), np.zeros((0, k + 1), np.float32), np.zeros(0, np.int64), own[:0]
            own = own[:0]
        else:
            x, ids = matrix(inside["unit"], dim), inside["item_id"].combine_chunks().dictionary_encode()
            names, code = ids.dictionary, ids.indices.to_numpy().astype(np.int64)
            # repeated rows of an item count once
            both = np.column_stack([code.reshape(-1, 1), np.ascontiguousarray(x).view(np.int32)])
            order = np.lexsort((x[:, 0], code))
            again = np.zeros(len(both), bool)
            again[1:] = (both[order][1:] == both[order][:-1]).all(axis=1)
            one = np.sort(order[~again])
            x, code = x[one], code[one]
            found, score = Graph(x, m).search(matrix(asks["unit"], dim), k + 1, ef)
        same = pc.index_in(own, names).fill_null(-1).to_numpy(zero_copy_only=False)
        keep = (found >= 0) & (code[found] != same[:, None]) if len(found) else np.zeros(found.shape, bool)
        keep &= np.cumsum(keep, axis=1) <= k
        ends = pa.array(np.concatenate([[0], np.cumsum(keep.sum(axis=1))]).astype(np.int32))
        q, j = np.nonzero(keep)
        hits = pa.StructArray.from_arrays([pa.array(-score[q, j]), names.take(pa.array(code[found[q, j]]))], ["s", "item_id"])
        return pa.table({"query_id": own, "hits": pa.ListArray.from_arrays(ends, hits)})

    packed = sent.groupBy("cell", "shard").applyInArrow(search, hit_schema)
    if of_crowds is not None:
        # what the crowds' few indexed items found beside each other is less similar than their copies
        packed = packed.join(of_crowds.select("query_id"), "query_id", "left_anti").unionByName(of_crowds)
    # a query has at most k hits from each shard it visits
    merged = packed.groupBy("query_id").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
    several = F.size(F.array_distinct(F.transform("hits", lambda h: h["item_id"]))) < F.size("hits")
    once = F.filter("hits", lambda h, i: ~F.exists(F.slice("hits", F.lit(1), i), lambda g: g["item_id"] == h["item_id"]))
    best = merged.select("query_id", F.posexplode(F.slice(F.when(several, once).otherwise(F.col("hits")), 1, k)).alias("place", "hit"))
    return best.select("query_id", F.col("hit.item_id").alias("item_id"), (-F.col("hit.s")).cast("double").alias("similarity"), (F.col("place") + 1).cast("int").alias("place"))
