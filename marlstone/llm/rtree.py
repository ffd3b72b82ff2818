"""Hard negatives by inner product: an R-tree packed by sort-tile-recursive order, searched best box first within score windows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Inner products up to this are whole numbers in doubles, whatever the order of summing.
EXACT = float(1 << 53)
FOUND = "query long, window int, id long, score long"
FOUND_SCHEMA = pa.schema([("query", pa.int64()), ("window", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])
BOX = "tile long, lo array<double>, hi array<double>"


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The rows of a column of vectors of one length."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), -1) if len(array) else np.zeros((0, 1))


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    return np.append(np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])), len(sorted_keys)) if len(sorted_keys) else np.zeros(1, np.int64)


def str_order(x: np.ndarray, leaf: int) -> np.ndarray:
    """Rows in sort-tile-recursive order: cut by the coordinate of largest spread into slabs of whole leaves, each of them cut by the next one, until a slab is a leaf.

    Slabs are as many as spread the leaves over the coordinates left, two at least.
    """
    axes = np.argsort(-np.ptp(x, axis=0), kind="stable") if len(x) else np.zeros(0, int)
    done: list[np.ndarray] = []
    open_slabs = [(np.arange(len(x)), 0)]
    while open_slabs:
        rows, level = open_slabs.pop()
        leaves = math.ceil(len(rows) / leaf)
        if leaves <= 1 or not len(axes):
            done.append(rows)
            continue
        left = max(1, len(axes) - level)
        slabs = min(leaves, max(2, math.ceil(leaves ** (1 / left))))
        per = math.ceil(leaves / slabs) * leaf
        rows = rows[np.argsort(x[rows, axes[level % len(axes)]], kind="stable")]
        open_slabs += [(rows[i : i + per], level + 1) for i in range(0, len(rows), per)][::-1]
    return np.concatenate(done) if done else np.zeros(0, int)


class Tree:
    """An R-tree over the rows of one tile: `leaf` rows a leaf, `fanout` boxes a node above, and one root."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, leaf: int = 64, fanout: int = 8) -> None:
        order = str_order(x, leaf)
        self.ids, self.labels, self.x, self.leaf, self.fanout = ids[order], labels[order], np.ascontiguousarray(x[order]), leaf, fanout
        self.most = float(np.abs(self.x).max(initial=0))
        lo, hi = self._bound(self.x, self.x, leaf)
        self.levels = [(lo, hi)]
        while len(lo) > 1:
            lo, hi = self._bound(lo, hi, fanout)
            self.levels.append((lo, hi))

    @staticmethod
    def _bound(lo: np.ndarray, hi: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(0, len(lo), size)
        return np.minimum.reduceat(lo, at, axis=0), np.maximum.reduceat(hi, at, axis=0)

    def search(self, queries: np.ndarray, labels: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, floor: np.ndarray, k: int, width: int = 16) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For windows (low, high) of queries, one row each (queries, labels and windows row by row), their k best rows (ties to the lesser id): arrays window, id, score, unordered.

        Each window has a queue of boxes by their largest possible score. In a round each takes the `width` best of its queue, opens them,
        and drops boxes that no score of the window can lie in, or that lie strictly below its k-th score, or `floor`, by then. All windows go on together, so that a leaf meets all that open it in one product.
        """
        above, below = np.maximum(queries, 0), np.minimum(queries, 0)
        best = np.full((len(queries), k), -np.inf)  # scores found, best first
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        floor = floor.astype(np.float64)

        def interval(q: np.ndarray, level: int, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            lo, hi = self.levels[level]
            least, most = np.empty(len(q)), np.empty(len(q))
            order = np.argsort(boxes, kind="stable")
            cuts = runs(boxes[order])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                rows = order[a:b]
                box = boxes[rows[0]]
                up, down = above[q[rows]], below[q[rows]]
                most[rows], least[rows] = up @ hi[box] + down @ lo[box], up @ lo[box] + down @ hi[box]
            return least, most

        def limit(q: np.ndarray) -> np.ndarray:
            return np.maximum(np.maximum(low, floor), best[:, k - 1])[q]

        top = len(self.levels) - 1
        q = np.arange(len(queries))
        queue = [(q, np.full(len(q), top), np.zeros(len(q), np.int64), *interval(q, top, np.zeros(len(q), np.int64)))]
        while True:
            q, level, box, least, most = (np.concatenate(c) for c in zip(*queue, strict=True))
            keep = (most >= limit(q)) & (least <= high[q])
            q, level, box, least, most = q[keep], level[keep], box[keep], least[keep], most[keep]
            if not len(q):
                break
            order = np.lexsort((-most, q))
            q, level, box, least, most = q[order], level[order], box[order], least[order], most[order]
            cuts = runs(q)
            now = np.arange(len(q)) - np.repeat(cuts[:-1], np.diff(cuts)) < width
            queue = [tuple(c[~now] for c in (q, level, box, least, most))]
            q, level, box = q[now], level[now], box[now]
            for h in range(1, top + 1):
                of, boxes = q[level == h], box[level == h]
                if len(of):
                    size = len(self.levels[h - 1][0])
                    child = (boxes[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                    of = np.repeat(of, self.fanout)[child < size]
                    child = child[child < size]
                    queue.append((of, np.full(len(of), h - 1), child, *interval(of, h - 1, child)))
            of, boxes = q[level == 0], box[level == 0]
            order = np.argsort(boxes, kind="stable")
            of, boxes = of[order], boxes[order]
            cuts, news = runs(boxes), []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                rows = slice(boxes[a] * self.leaf, boxes[a] * self.leaf + self.leaf)
                who = of[a:b]
                scores = queries[who] @ self.x[rows].T
                fits = (scores >= limit(who)[:, None]) & (scores <= high[who][:, None]) & ((self.labels[rows][None, :] == labels[who][:, None]) == same)
                i, j = np.nonzero(fits)
                news.append((who[i], self.ids[rows][j], scores[i, j]))
            if news:
                found = [_best(*(np.concatenate(c) for c in zip(*found, *news, strict=True)), k)]
                w, _, s = found[0]
                cuts = runs(w)
                best[w, np.arange(len(w)) - np.repeat(cuts[:-1], np.diff(cuts))] = s
        yield from found


def _best(window: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores, window))
    window, ids, scores = window[order], ids[order], scores[order]
    cuts = runs(window)
    keep = np.arange(len(window)) - np.repeat(cuts[:-1], np.diff(cuts)) < k
    return window[keep], ids[keep], scores[keep]


def _plain_search(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, queries: np.ndarray, of: np.ndarray, same: bool, low: list[int], high: list[int], k: int) -> tuple[list, list, list]:
    """The same in Python's whole numbers, for components so large that doubles would round their products; scores are held to the range of a long."""
    exact, out = np.array([[int(v) for v in r] for r in x], dtype=object), ([], [], [])
    for w, (q, label) in enumerate(zip(queries, of, strict=True)):
        scores = [min(MOST, max(LEAST, s)) for s in (exact @ np.array([int(v) for v in q], dtype=object)).tolist()]
        fit = sorted((-s, i) for s, i, lab in zip(scores, ids.tolist(), labels.tolist(), strict=True) if low[w] <= s <= high[w] and (lab == label) == same)[:k]
        for c, v in zip(out, ([w] * len(fit), [i for _, i in fit], [-s for s, _ in fit]), strict=True):
            c.extend(v)
    return out


class Index:
    """Tiles of vectors (id, label, q and other columns), and the box around each.

    Tiles are cut in sort-tile-recursive order at places fitted on a bounded sample (`sample` rows of least hash of each vector length); every row is indexed.
    A tile that still holds far more rows than `tile` is dealt over several at random. Nothing that grows with the data is in one place:
    the boxes form a table that queries are joined with, block by block.
    """

    def __init__(self, rows: DataFrame, tile: int = 4096, sample: int = 16384, boxes: int = 1024) -> None:
        names = rows.columns
        rows = rows.withColumn("dim", F.size("q"))
        sizes = {r.dim: r.n for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row a vector length
        cuts = {d: _fit_cuts(_sampled(rows.filter(F.col("dim") == d), n, sample), math.ceil(n / tile)) for d, n in sizes.items() if n > tile and d}

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = batch.column("dim").to_numpy()
                cells = np.zeros(len(dims), np.int64)
                for d in np.unique(dims):
                    if d in cuts:
                        at = np.flatnonzero(dims == d)
                        cells[at] = _cell_of(matrix(batch.column("q").take(pa.array(at))), cuts[d])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], [*batch.schema.names, "cell"])

        ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        placed = materialise(rows.mapInArrow(place, f"{ddl}, cell long"), "cells")
        parts = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / (2 * tile)).alias("parts"))
        self.rows = materialise(placed.join(parts, ["dim", "cell"]).select(F.xxhash64("dim", "cell", F.pmod(F.xxhash64("id", "label"), "parts")).alias("tile"), *names), "tiles")
        self.blocks = max(1, math.ceil(sum(math.ceil(2 * n / tile) for n in sizes.values()) / boxes))
        self.boxes = materialise(self.rows.select("tile", "q").groupBy("tile").applyInArrow(_box, BOX).withColumn("block", F.pmod(F.xxhash64("tile"), F.lit(self.blocks))), "boxes")

    def search(self, queries: DataFrame, same: bool, k: int, block: int = 4096) -> DataFrame:
        """Rows (query, window, id, score): the k best rows within each window of each query, of its own label or of others; queries are rows (query, label, q, tile, windows of (low, high)).

        A query first looks through the tile of its own place; its k-th score there then leaves out the tiles that lie below it, or outside its windows.
        The others are searched in blocks of queries, and what all tiles give is ranked.
        """
        parts = max(1, math.ceil(queries.count() / block))
        queries = queries.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(parts)))
        own = materialise(self._through(queries.withColumn("floors", F.transform("windows", lambda w: F.lit(LEAST))), same, k), "own-tile")
        kth = own.groupBy("query", "window").agg(F.count("*").alias("n"), F.min("score").alias("floor")).filter(F.col("n") >= k)
        known = kth.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("window", "floor"))).alias("known"))  # an entry a window of the query
        primed = queries.join(known, "query", "left").withColumn("floors", F.transform("windows", lambda w, i: F.coalesce(F.try_element_at("known", i), F.lit(LEAST)))).drop("known")
        spread = primed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))))
        boxes = self.boxes.withColumnRenamed("block", "of_block").withColumn("of_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        routed = spread.groupBy("block", "part").cogroup(boxes.groupBy("of_block", "of_part")).applyInArrow(_route, "query long, tile long")
        rest = self._through(primed.withColumnRenamed("tile", "home").join(routed, "query").filter("tile <> home").drop("home"), same, k)
        ranked = own.unionByName(rest).withColumn("r", F.row_number().over(Window.partitionBy("query", "window").orderBy(F.desc("score"), "id")))
        return ranked.filter(F.col("r") <= k).drop("r")

    def _through(self, queries: DataFrame, same: bool, k: int) -> DataFrame:
        wanted = queries.select(F.col("tile").alias("of_tile"), F.col("part").alias("of_part")).distinct()
        asked = self.rows.select(F.col("tile").alias("of_tile"), "id", "label", "q").join(wanted, "of_tile")
        return queries.groupBy("tile", "part").cogroup(asked.groupBy("of_tile", "of_part")).applyInArrow(lambda a, b: _search_tile(a, b, same, k), FOUND)


def _sampled(rows: DataFrame, n: int, sample: int) -> np.ndarray:
    some = rows.select(F.xxhash64("id", "q").alias("h"), "q")
    if n > 2 * sample:  # about twice as many as asked for, by hash, and then the least of these
        some = some.filter(F.pmod("h", F.lit(n // (2 * sample))) == 0)
    return matrix(some.orderBy("h", "q").limit(sample).select("q").toArrow().column("q"))


def _fit_cuts(x: np.ndarray, tiles: int) -> list:
    """Places (axis, values, below) at which tiles are cut, as a tree: [axis, values, [tree of each slab]], or a number of tiles for a leaf."""
    axes = np.argsort(-np.ptp(x, axis=0), kind="stable").tolist() if len(x) else []
    count = iter(range(1 << 62))

    def cut(rows: np.ndarray, want: int, level: int) -> list | int:
        if want <= 1 or len(rows) < 2 or not axes:
            return next(count)
        slabs = min(want, max(2, math.ceil(want ** (1 / max(1, len(axes) - level)))))
        axis = axes[level % len(axes)]
        values = np.unique(np.quantile(x[rows, axis], np.arange(1, slabs) / slabs, method="lower"))
        side = np.searchsorted(values, x[rows, axis], "left")
        if len(np.unique(side)) < 2:
            return next(count) if level >= len(axes) else cut(rows, want, level + 1)
        return [axis, values, [cut(rows[side == s], math.ceil(want / slabs), level + 1) for s in range(len(values) + 1)]]

    return cut(np.arange(len(x)), tiles, 0)


def _cell_of(x: np.ndarray, cuts: list | int) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), cuts)]
    while todo:
        rows, node = todo.pop()
        if not isinstance(node, list):
            out[rows] = node
            continue
        side = np.searchsorted(node[1], x[rows, node[0]], "left")
        todo += [(rows[side == s], below) for s, below in enumerate(node[2]) if (side == s).any()]
    return out


def _box(table: pa.Table) -> pa.Table:
    x = matrix(table.column("q"))
    corners = (pa.array([c.tolist()], pa.list_(pa.float64())) for c in (x.min(0), x.max(0)))
    return pa.table([table.column("tile").combine_chunks()[:1], *corners], ["tile", "lo", "hi"])


def _windows(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row of the query, number within it, low, high and floor of every window."""
    windows, floors = table.column("windows").combine_chunks(), table.column("floors").combine_chunks()
    sizes = np.diff(windows.offsets.to_numpy())
    of = np.repeat(np.arange(len(sizes)), sizes)
    number = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    flat = windows.flatten()
    return of, number, flat.field("low").to_numpy(), flat.field("high").to_numpy(), floors.flatten().to_numpy()


def _lengths(table: pa.Table, column: str) -> np.ndarray:
    return np.diff(table.column(column).combine_chunks().offsets.to_numpy()) if table.num_rows else np.zeros(0, np.int64)


def _route(queries: pa.Table, boxes: pa.Table) -> pa.Table:
    """The tiles, of vectors as long as the query, whose box can hold a score of one of its windows that is not below its floor."""
    out_q, out_t = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    own, dims = _lengths(queries, "q"), _lengths(boxes, "lo")
    for d in np.intersect1d(own, dims):
        some, there = queries.take(pa.array(np.flatnonzero(own == d))), boxes.filter(pa.array(dims == d))
        q, lo, hi, tiles = matrix(some.column("q")), matrix(there.column("lo")), matrix(there.column("hi")), there.column("tile").to_numpy()
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        size = np.abs(q).sum(1) * max(np.abs(lo).max(initial=0), np.abs(hi).max(initial=0))
        slack = np.where(size < EXACT, 0.0, size * 1e-9)[:, None]  # sums of doubles that are not whole any more
        most, least = up @ hi.T + down @ lo.T + slack, up @ lo.T + down @ hi.T - slack
        of, _, low, high, floor = _windows(some)
        meets = np.zeros(most.shape, bool)
        for w, i in enumerate(of.tolist()):
            meets[i] |= (most[i] >= max(float(low[w]), float(floor[w]))) & (least[i] <= float(high[w]))
        i, j = np.nonzero(meets)
        out_q.append(some.column("query").to_numpy()[i])
        out_t.append(tiles[j])
    return pa.table({"query": np.concatenate(out_q), "tile": np.concatenate(out_t)})


def _search_tile(queries: pa.Table, rows: pa.Table, same: bool, k: int) -> pa.Table:
    if not queries.num_rows or not rows.num_rows:
        return FOUND_SCHEMA.empty_table()
    queries, rows = queries.combine_chunks(), rows.combine_chunks()
    q, x = matrix(queries.column("q")), matrix(rows.column("q"))
    of, number, low, high, floor = _windows(queries)
    label, ids, labels = queries.column("label").to_numpy(), rows.column("id").to_numpy(), rows.column("label").to_numpy()
    if float(np.abs(q).sum(1).max(initial=0)) * float(np.abs(x).max(initial=0)) < EXACT:
        parts = list(Tree(ids, labels, x).search(q[of], label[of], same, low.astype(np.float64), high.astype(np.float64), floor, k))
        w, got, scores = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
    else:
        w, got, scores = (np.array(c, np.int64) for c in _plain_search(ids, labels, x, q[of], label[of], same, low.tolist(), high.tolist(), k))
    return pa.table({"query": queries.column("query").to_numpy()[of[w]], "window": number[w].astype(np.int32), "id": got, "score": scores.astype(np.int64)}, schema=FOUND_SCHEMA)


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, label: Column | None = None, scale: int = 256, tile: int = 4096) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over vectors (vec_id, embedding, label), for the rows that `anchors` holds for.

    Components count as floor(scale * x) and scores are inner products. An anchor's positives are its `positives` best other rows of its label; for each, the best `negatives` rows of
    other labels are given whose score is from `low` to `high` hundredths of the positive's (so none if that is negative). Ties go to the lesser vec_id. `label` stands in for the label column.

    Rows with a null id, label or vector, or a null, non-finite or overflowing component take no part. Exact repeats of a row count once; of other rows that repeat an anchor's
    id the nearest at most is taken for the anchor itself. Rows meet rows of as long a vector; empty vectors score 0. Scores beyond a long are held to its range. No row gives an empty result.
    Of equal vectors of one label only those of least id are searched, as many as can be ranked, and for equal anchors once.
    """
    def scaled(v: Column) -> Column:
        v = v.cast("double") * scale
        return F.when(F.abs(v) < EXACT, F.floor(v).cast("double")).otherwise(v) + F.lit(0.0)  # 0.0, never -0.0

    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), (F.col("label") if label is None else label).cast("long").alias("label"), F.transform("embedding", scaled).alias("q"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    usable = F.forall("q", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))  # NaN is the largest double
    rows = materialise(rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("q").isNotNull() & usable).groupBy("id", "label", "q").agg(F.max("anchor").alias("anchor")), "vectors")
    groups = rows.groupBy("label", "q").agg(F.min("id").alias("id"), F.max("anchor").alias("asked"))
    copies = rows.withColumn("r", F.row_number().over(Window.partitionBy("label", "q").orderBy("id"))).filter(F.col("r") <= max(positives + 1, negatives)).filter("r > 1").select("id", "label", "q", F.lit(False).alias("asked"))
    index = Index(groups.select("id", "label", "q", "asked").unionByName(copies), tile)

    whole = F.array(F.struct(F.lit(LEAST).alias("low"), F.lit(MOST).alias("high")))
    queries = materialise(index.rows.filter("asked").select(F.monotonically_increasing_id().alias("query"), "label", "q", "tile", whole.alias("windows")), "queries")
    near = index.search(queries, True, positives + 1).groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score").cast("decimal(20,0)")).alias("less"), "id", "score"))).alias("near"))
    share = {n: lambda p, h=h, n=n: getattr(F, n)(p.cast("decimal(20,0)") * h / 100).cast("long") for n, h in (("ceil", low), ("floor", high))}
    asked = queries.drop("windows").join(near, "query").withColumn("scores", F.array_distinct(F.transform("near", lambda s: s["score"])))
    asked = materialise(asked.withColumn("windows", F.transform("scores", lambda p: F.struct(share["ceil"](p).alias("low"), share["floor"](p).alias("high")))), "asked")
    hard = index.search(asked, False, negatives).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("window", (-F.col("score")).alias("less"), "id", "score"))).alias("hard"))

    answered = rows.filter("anchor").select(F.col("id").alias("anchor_id"), "label", "q").join(asked.join(hard, "query").select("label", "q", "near", "scores", "hard"), ["label", "q"])
    own = F.array_position(F.transform("near", lambda s: s["id"]), F.col("anchor_id"))
    others = F.slice(F.filter("near", lambda s, i: (i + 1 != own)), 1, positives)
    paired = answered.select("anchor_id", "scores", "hard", F.explode(others).alias("p"))
    window = F.array_position("scores", F.col("p.score")) - 1
    ranked = paired.select("anchor_id", "p", F.posexplode(F.filter("hard", lambda h: h["window"] == window)).alias("at", "h"))
    return ranked.select("anchor_id", F.col("p.id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("h.id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("h.score").alias("negative_score"))
