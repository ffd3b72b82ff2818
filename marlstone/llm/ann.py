"""Approximate nearest neighbours by inner product: a neighbour graph by NN-descent, searched greedily."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialise

LISTS = "node long, ids array<long>, sims array<float>"
SCHEMA = pa.schema([("node", pa.int64()), ("ids", pa.list_(pa.int64())), ("sims", pa.list_(pa.float32()))])


class Lookup:
    """Vectors by node."""

    def __init__(self, nodes: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(nodes, kind="stable")
        self.nodes, self.vectors = nodes[order], np.ascontiguousarray(vectors[order])

    @classmethod
    def of(cls, table: pa.Table) -> Lookup:
        column = table.column("vec").combine_chunks()
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return cls(table.column("node").to_numpy().astype(np.int64), flat.reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 1), np.float32))

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        return self.vectors[np.searchsorted(self.nodes, ids)]


def top(keys: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int) -> pa.Table:
    """Of each key its k distinct ids of largest similarity, as a row (key, ids, sims), best first, ties to the lesser id."""
    order = np.lexsort((ids, -sims, keys))
    keys, ids, sims = keys[order], ids[order], sims[order]
    # a pair met twice has one similarity up to rounding: keep its first row
    by_pair = np.lexsort((np.arange(len(keys)), ids, keys))
    again = np.zeros(len(keys), dtype=bool)
    again[by_pair[1:]] = (keys[by_pair[1:]] == keys[by_pair[:-1]]) & (ids[by_pair[1:]] == ids[by_pair[:-1]])
    keys, ids, sims = keys[~again], ids[~again], sims[~again]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(keys)))
    keep = np.arange(len(keys)) - np.repeat(first, sizes) < k
    offsets = pa.array(np.concatenate([[0], np.minimum(sizes, k).cumsum()]).astype(np.int32))
    return pa.table({"node": pa.array(keys[first]), "ids": pa.ListArray.from_arrays(offsets, pa.array(ids[keep])), "sims": pa.ListArray.from_arrays(offsets, pa.array(sims[keep].astype(np.float32)))}, schema=SCHEMA)


def _ragged(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and the length of each list."""
    array = column.combine_chunks()
    return array.flatten().to_numpy(zero_copy_only=False), np.diff(array.offsets.to_numpy()) if len(array) else np.zeros(0, np.int64)


def _merged(table: pa.Table, k: int) -> pa.Table:
    ids, sizes = _ragged(table.column("ids"))
    sims, _ = _ragged(table.column("sims"))
    return top(np.repeat(table.column("node").to_numpy(), sizes), ids, sims, k)


class Index:
    """The neighbour graph of distinct vectors, and what searches need; see `build`."""

    def __init__(self, nodes: DataFrame, size: int, broadcast_bytes: int) -> None:
        self.nodes, self.size, self.buckets = nodes, size, max(8, math.ceil(size / 1000))
        dim = len(nodes.first().vec) if size else 1
        self.dim, self.shared = dim, None
        width = 8 if nodes.schema["vec"].dataType.elementType == T.DoubleType() else 4
        if width * dim * size <= broadcast_bytes:
            self.shared = nodes.sparkSession.sparkContext.broadcast(Lookup.of(nodes.toArrow()))

    def bucket(self, node: str | Column) -> Column:
        return F.pmod(F.xxhash64(node), F.lit(self.buckets))

    def grouped(self, rows: DataFrame, work: Callable[[pa.Table, Lookup], pa.Table], ddl: str) -> DataFrame:
        """work on the rows of each bucket, with the vectors of `node` and of all `ids` in them.

        Vectors come from a broadcast if all of them fit in its bound, else by a join of the nodes that each bucket names.
        """
        if self.shared is not None:
            shared = self.shared
            return rows.groupBy("bucket").applyInArrow(lambda t: work(t, shared.value), ddl)
        named = rows.select(F.col("bucket").alias("of_bucket"), F.explode(F.array_union(F.array("node"), "ids")).alias("node")).distinct()
        vectors = named.join(self.nodes, "node")
        empty = _empty(ddl)
        return rows.groupBy("bucket").cogroup(vectors.groupBy("of_bucket")).applyInArrow(lambda a, b: work(a, Lookup.of(b)) if a.num_rows else empty, ddl)

    def merge(self, lists: DataFrame, k: int) -> DataFrame:
        return lists.withColumn("bucket", self.bucket("node")).groupBy("bucket").applyInArrow(lambda t: _merged(t, k), LISTS)

    def start(self, k: int, rounds: int, block: int) -> DataFrame:
        """A first graph: the best neighbours within blocks of nodes that lie on the same sides of random planes."""
        bits = max(0, math.ceil(math.log2(max(1, self.size / block))))
        planes = np.random.default_rng(10).standard_normal((rounds, max(1, bits), self.dim)).astype(np.float32)

        def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(n, -1)
                code = ((np.einsum("nd,rbd->rnb", x, planes) > 0) * (1 << np.arange(planes.shape[1]))).sum(-1)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(batch.column(0).to_numpy(), rounds)), pa.array(np.repeat(np.arange(rounds), n)), pa.array(code.ravel() if bits else np.zeros(n * rounds, np.int64))], ["node", "round", "code"])

        coded = materialise(self.nodes.select("node", "vec").mapInArrow(codes, "node long, round long, code long"), "ann-codes")
        # a side that holds many nodes is cut into blocks at random
        parts = coded.groupBy("round", "code").agg(F.ceil(F.count("*") / (2 * block)).alias("parts"))
        dealt = coded.join(parts, ["round", "code"]).select(F.xxhash64("round", "code", F.pmod(F.xxhash64("node", "round"), "parts")).alias("bucket"), "node", F.array("node").alias("ids"))

        def within(table: pa.Table, vectors: Lookup) -> pa.Table:
            ids = np.unique(table.column("node").to_numpy())
            x = vectors(ids)
            sims = x @ x.T
            np.fill_diagonal(sims, -np.inf)
            some = min(k, len(ids) - 1)
            if some < 1:
                return SCHEMA.empty_table()
            best = np.argpartition(-sims, some - 1, axis=1)[:, :some]
            return top(np.repeat(ids, some), ids[best].ravel(), np.take_along_axis(sims, best, 1).ravel(), k)

        return self.merge(self.grouped(dealt, within, LISTS), k)

    def adjacency(self, graph: DataFrame, reverse: int) -> DataFrame:
        """Rows (node, ids): neighbours in the graph and the `reverse` closest of those that name the node."""
        edges = graph.select("node", F.explode(F.arrays_zip("ids", "sims")).alias("e")).select("node", F.col("e.ids").alias("id"), F.col("e.sims").alias("sim"))
        back = edges.select(F.col("id").alias("node"), F.col("node").alias("id"), "sim").withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), "id"))).filter(F.col("n") <= reverse)
        return edges.select("node", "id").unionByName(back.select("node", "id"))

    def descend(self, graph: DataFrame, k: int, reverse: int) -> DataFrame:
        """One round: neighbours of one node are compared with each other, and each keeps its k best."""
        worst = graph.select(F.col("node").alias("id"), F.when(F.size("ids") >= k, F.array_min("sims")).otherwise(F.lit(float("-inf"))).alias("worst"))
        near = self.adjacency(graph, reverse).join(worst, "id").groupBy("node").agg(F.collect_set(F.struct("id", "worst")).alias("near"))
        rows = near.select(self.bucket("node").alias("bucket"), "node", F.col("near.id").alias("ids"), F.col("near.worst").alias("worst"))

        def compare(table: pa.Table, vectors: Lookup) -> pa.Table:
            ids, sizes = _ragged(table.column("ids"))
            worst_of, _ = _ragged(table.column("worst"))
            keys, others, sims = [], [], []
            for end, n in zip(sizes.cumsum().tolist(), sizes.tolist(), strict=True):
                near = ids[end - n : end]
                x = vectors(near)
                s = x @ x.T
                np.fill_diagonal(s, -np.inf)
                i, j = np.nonzero(s > worst_of[end - n : end, None])
                keys.append(near[i])
                others.append(near[j])
                sims.append(s[i, j])
            return top(np.concatenate(keys), np.concatenate(others), np.concatenate(sims), k)

        return self.merge(graph.unionByName(self.grouped(rows, compare, LISTS)), k)

    def search(self, graph: DataFrame, queries: DataFrame, beam: int, hops: int, reverse: int) -> DataFrame:
        """Lists of the nodes found for each query node (column node): from its own neighbours, each hop looks at the neighbours of those of
        the beam best found that were not looked at before."""
        links = self.adjacency(graph, reverse).groupBy("node").agg(F.collect_set("id").alias("ids"))
        links = materialise(links.select(self.bucket("node").alias("bucket"), "node", "ids", F.lit(0).alias("kind"), F.lit(0.0).cast("float").alias("least")), "ann-links")
        found = queries.join(graph, "node").select("node", "ids", "sims", F.array(F.col("node")).alias("done"))
        found = materialise(found, "ann-found")

        def look(table: pa.Table, vectors: Lookup) -> pa.Table:
            rows = table.filter(pa.compute.equal(table.column("kind"), 0))
            flat, sizes = _ragged(rows.column("ids"))
            ends = sizes.cumsum()
            at = {n: slice(e - s, e) for n, e, s in zip(rows.column("node").to_pylist(), ends.tolist(), sizes.tolist(), strict=True)}
            asked = table.filter(pa.compute.equal(table.column("kind"), 1))
            keys, others, sims = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
            for node, opened, least in zip(asked.column("node").to_pylist(), asked.column("ids").to_pylist(), asked.column("least").to_pylist(), strict=True):
                near = np.unique(np.concatenate([flat[at[o]] for o in opened]))
                near = near[near != node]
                s = vectors(near) @ vectors(np.array([node]))[0]
                keep = s > least
                keys.append(np.full(int(keep.sum()), node))
                others.append(near[keep])
                sims.append(s[keep])
            return top(np.concatenate(keys), np.concatenate(others), np.concatenate(sims), beam)

        for _ in range(hops):
            least = F.when(F.size("ids") >= beam, F.array_min("sims")).otherwise(F.lit(float("-inf"))).cast("float")
            opened = found.select("node", least.alias("least"), F.explode(F.array_except("ids", "done")).alias("id"))
            asked = opened.groupBy(self.bucket("id").alias("bucket"), "node").agg(F.collect_list("id").alias("ids"), F.first("least").alias("least")).select("bucket", "node", "ids", F.lit(1).alias("kind"), "least")
            more = self.grouped(links.unionByName(asked), look, LISTS)
            merged = self.merge(found.select("node", "ids", "sims").unionByName(more), beam)
            seen = found.select("node", F.array_union("done", "ids").alias("done"))
            found = materialise(merged.join(seen, "node"), "ann-found")
        return found.select("node", "ids", "sims")


def _empty(ddl: str) -> pa.Table:
    kinds = {"long": pa.int64(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<float>": pa.list_(pa.float32())}
    return pa.schema([(n, kinds[t]) for n, t in (p.split() for p in ddl.split(", "))]).empty_table()


def build(nodes: DataFrame, k: int = 30, reverse: int = 30, planes: int = 12, block: int = 500, rounds: int = 3, broadcast_bytes: int = 64 << 20) -> tuple[Index, DataFrame]:
    """The index and its graph (node, ids, sims) over nodes (node, vec), which are distinct vectors of one length."""
    index = Index(nodes, nodes.count(), broadcast_bytes)
    graph = materialise(index.start(k, planes, block), "ann-graph")
    for _ in range(rounds):
        graph = materialise(index.descend(graph, k, reverse), "ann-graph")
    return index, graph


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", beam: int = 240, hops: int = 3, **building: int) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each row that is_query holds for, the k rows found of largest inner product.

    Nearest first, ties to the lesser id; scores are inner products of the original vectors in double precision; a row is
    not its own neighbour; with fewer than k other rows all come. Rows whose id or vector is null, or whose vector is empty, zero or holds a null or
    non-finite component, take no part, nor do vectors of another length than the commonest (the longest of equals). Rows that repeat id and vector
    count once. Other columns are ignored; without queries or vectors there are no rows.

    Equal vectors are one node of the graph, however many they are; a node brings its k + 1 least ids to the result, enough for any query.
    """
    vec = F.col(f"`{embedding}`")
    # single precision stays as it is; anything else is taken in double, so that scores are those of the original vectors
    kind = "float" if vectors.schema[embedding].dataType.elementType == T.FloatType() else "double"
    sound = vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    rows = vectors.filter(F.col(f"`{vec_id}`").isNotNull()).select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("query"), F.when(sound, F.transform(vec.cast(f"array<{kind}>"), lambda x: (x + F.lit(0.0).cast(kind)))).alias("vec")).filter("vec IS NOT NULL")
    length = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    rows = rows.filter(F.size("vec") == (length.n if length else 0))
    # a node is named by a hash of its vector, since rows may repeat an id with other vectors
    nodes = materialise(rows.select("vec").distinct().select(F.xxhash64("vec").alias("node"), "vec"), "ann-nodes")
    members = materialise(rows.join(nodes, "vec").select("node", "vec_id", "query").distinct(), "ann-members")
    index, graph = build(nodes, **building)
    asked = members.filter("query").select("node").distinct()
    found = index.search(graph, asked, beam, hops, building.get("reverse", 30))
    lone = asked.join(found.select("node"), "node", "left_anti").select("node", F.expr("CAST(array() AS array<bigint>)").alias("ids"))
    near = found.select("node", F.slice("ids", 1, 2 * k + 1).alias("ids")).unionByName(lone).select(index.bucket("node").alias("bucket"), "node", F.array_union(F.array("node"), "ids").alias("ids"))

    def exact(table: pa.Table, lookup: Lookup) -> pa.Table:
        ids, sizes = _ragged(table.column("ids"))
        of = np.repeat(table.column("node").to_numpy(), sizes)
        scores = np.einsum("nd,nd->n", lookup(of).astype(np.float64), lookup(ids).astype(np.float64))
        return pa.table({"q": pa.array(of), "node": pa.array(ids), "score": pa.array(scores)})

    scored = index.grouped(near, exact, "q long, node long, score double")
    least = members.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).filter(F.col("n") <= k + 1).select("node", "vec_id")
    best = scored.join(least, "node").withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("n") <= k + 1)
    per_query = members.filter("query").select(F.col("node").alias("q"), F.col("vec_id").alias("query_id")).distinct().join(best.select("q", "vec_id", "score"), "q").filter("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("q", "query_id").orderBy(F.desc("score"), "vec_id"))
    return per_query.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
