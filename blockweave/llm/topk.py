"""Exact top-k inner-product search with M-trees and best-first search.

A bounded sample of the vectors are the routing objects of the top level: each vector goes to the cell of the nearest one, and a cell
has a covering radius. The vectors of a cell are dealt by hash into groups of about ``GROUP`` rows, and each group becomes, once,
an M-tree: pages of at most ``PAGE`` entries, a routing vector and a covering radius for each page, and for each entry its
distance to the routing vector of the page that holds it. For any x within a page of routing vector r and radius R,
Cauchy-Schwarz and the triangle inequality give q.x <= q.r + |q| R, and with the stored distance d(p, r) to the parent's routing vector
q.r <= q.p + |q| d(p, r): where that already falls below the k-th score, the product with r is never computed.

A query first searches one tree of the cell whose routing object has the highest product with it. Its k-th score there is the
floor with which it then goes to the trees of all cells whose bound reaches it. A task holds one tree at a time, and queries
pass by it in batches.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockweave.llm.common import stored, table

GROUP, PAGE, FAN = 8192, 96, 16
#: Routing objects of the top level at most, drawn by a hash of the row; queries that pass by one copy of a tree.
PIVOTS, PASSING = 1024, 65536
#: Slack for rounding in the bounds, relative to the sizes of the vectors; scores themselves are exact.
SLACK = 1e-9
#: Beyond this bounds are not computed; such vectors are in a cell that every query visits.
HUGE = 1e100
_LONG = (1 << 63) - 1


def whole(x: float, scale: int) -> int:
    """floor(scale * x), exactly, for any finite x."""
    y = x * scale
    return math.floor(y) if math.isfinite(y) else int(x) * scale


class Node:
    """A page. Of a leaf, rows and their distances to the centre; else children with theirs, as arrays in one order."""

    __slots__ = ("centre", "centres", "children", "distances", "radii", "radius", "rows")

    def __init__(self, centre, radius):
        self.centre, self.radius = centre, radius
        self.children = self.centres = self.radii = self.rows = self.distances = None


class MTree:
    """Bulk-loaded over vectors of floor(scale * x); rows keep their ids beside them."""

    def __init__(self, ids: list, vectors: np.ndarray, page: int = PAGE, fan: int = FAN, scale: int = 1):
        self.page, self.fan, self.scale, self.computed = page, fan, scale, 0
        raw = np.asarray(vectors, np.float64)
        with np.errstate(over="ignore"):
            self.vectors = np.floor(raw * scale)
        self.largest = float(np.abs(self.vectors).max(initial=0))
        self.raw = None if self.largest < math.inf else raw
        self.ids = ids
        self.other: dict = {}
        self.bounded = self.largest <= HUGE
        self.root = None
        if len(raw):
            self.root = self._build(np.arange(len(raw))) if self.bounded else self._page(np.arange(len(raw)))

    def __getstate__(self):
        return {k: {} if k == "other" else v for k, v in self.__dict__.items()}

    def _page(self, rows: np.ndarray) -> Node:
        """All rows in one page without bounds."""
        node = Node(np.zeros(self.vectors.shape[1]), math.inf)
        node.rows, node.distances = rows, np.full(len(rows), math.inf)
        return node

    def _route(self, rows: np.ndarray):
        x = self.vectors[rows]
        centre = x[np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1))]
        return centre, np.sqrt(((x - centre) ** 2).sum(axis=1))

    def _build(self, rows: np.ndarray) -> Node:
        todo = [(rows, None)]
        root = None
        while todo:
            rows, parent = todo.pop()
            centre, far = self._route(rows)
            node = Node(centre, float(far.max()))
            if parent is None:
                root = node
            else:
                parent.children.append(node)
            if len(rows) <= self.page:
                node.rows, node.distances = rows, far
                continue
            node.children = []
            x = self.vectors[rows]
            pivots, near = [int(np.argmax(far))], None
            for _ in range(self.fan - 1):
                d = ((x - x[pivots[-1]]) ** 2).sum(axis=1)
                near = d if near is None else np.minimum(near, d)
                if near.max() == 0:
                    break
                pivots.append(int(np.argmax(near)))
            owner = np.argmin(np.stack([((x - x[p]) ** 2).sum(axis=1) for p in pivots]), axis=0)
            parts = [rows[owner == k] for k in range(len(pivots))]
            parts = [p for p in parts if len(p)]
            if max(map(len, parts)) > 0.75 * len(rows):  # copies, or few far from the others: cut by distance
                parts = np.array_split(rows[np.argsort(far, kind="stable")], -(-len(rows) // max(self.page, len(rows) // self.fan)))
            todo += [(p, node) for p in parts]
        self._distances(root)
        return root

    def _distances(self, root: Node) -> None:
        stack = [root]
        while stack:
            node = stack.pop()
            if node.children:
                node.centres = np.stack([c.centre for c in node.children])
                node.radii = np.array([c.radius for c in node.children])
                node.distances = np.sqrt(((node.centres - node.centre) ** 2).sum(axis=1))
                stack += node.children

    def _exact(self, kind: str) -> np.ndarray:
        """The vectors as 64-bit integers or as Python's."""
        if kind not in self.other:
            if kind == "long":
                self.other[kind] = self.vectors.astype(np.int64)
            else:
                source, to = (self.vectors, int) if self.raw is None else (self.raw, lambda x: whole(x, self.scale))
                self.other[kind] = np.array([[to(x) for x in row] for row in source.tolist()], dtype=object).reshape(source.shape)
        return self.other[kind]

    def search(self, query, own, k: int, least: int | None = None) -> list[tuple[int, object]]:
        """The k best (score, id) without id own, by score down, then id up with null last; of those of at least ``least`` if given."""
        if self.root is None:
            return []
        raw = np.asarray(query, np.float64)
        with np.errstate(over="ignore"):
            qf = np.floor(raw * self.scale)
        high = float(np.abs(qf).max(initial=0))
        most = self.largest * high * len(qf)
        if most < 1 << 53:  # products and their sums are exact in doubles
            vectors, q = self.vectors, qf
        elif most < 1 << 62:
            vectors, q = self._exact("long"), qf.astype(np.int64)
        else:
            vectors, q = self._exact("any"), np.array([whole(x, self.scale) for x in raw.tolist()], dtype=object)
        best: list = []  # min-heap of (score, -id as order key, id)

        def offer(rows, scores):
            for r, s in zip(rows.tolist(), scores.tolist(), strict=True):
                i = self.ids[r]
                if (i is not None and i == own) or (least is not None and s < least):
                    continue
                item = (int(s), -math.inf if i is None else -i, i)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item[:2] > best[0][:2]:
                    heapq.heapreplace(best, item)

        if not self.bounded or high > HUGE:
            self.computed += len(vectors)
            offer(np.arange(len(vectors)), np.array(vectors @ q, dtype=vectors.dtype))
            return [(s, i) for s, _, i in sorted(best, key=lambda b: (-b[0], -b[1]))]
        norm = float(np.sqrt(qf @ qf))
        slack = SLACK * (1 + norm) * (1 + float(np.sqrt(self.root.centre @ self.root.centre)) + self.root.radius)
        worst = -math.inf if least is None else float(least)  # a page must reach this bound
        product = float(qf @ self.root.centre)
        heap = [(-(product + norm * self.root.radius), 0, product, self.root)]
        tick = 0
        while heap:
            bound, _, product, node = heapq.heappop(heap)
            if len(best) == k:
                worst = float(best[0][0])
            if -bound + slack < worst:
                break
            if node.rows is not None:
                rows = node.rows
                if worst > -math.inf:  # by the stored distances alone
                    rows = rows[product + norm * node.distances + slack >= worst]
                if len(rows):
                    self.computed += len(rows)
                    scores = vectors[rows] @ q
                    if worst > -math.inf and scores.dtype != object:
                        keep = scores >= (best[0][0] if len(best) == k else least)
                        rows, scores = rows[keep], scores[keep]
                    offer(rows, scores)
                continue
            near = np.arange(len(node.children))
            if worst > -math.inf:  # by the stored distances alone
                near = near[product + norm * (node.distances + node.radii) + slack >= worst]
                if not len(near):
                    continue
            self.computed += len(near)
            products = node.centres[near] @ qf
            bounds = products + norm * node.radii[near]
            for c, p, reach in zip(near.tolist(), products.tolist(), bounds.tolist(), strict=True):
                if reach + slack >= worst:
                    tick += 1
                    heapq.heappush(heap, (-reach, tick, p, node.children[c]))
        return [(s, i) for s, _, i in sorted(best, key=lambda b: (-b[0], -b[1]))]


def beyond(score: int) -> str | None:
    """For a score that a long cannot hold, or only just, a text that sorts as the score does; else null."""
    if abs(score) < _LONG:
        return None
    digits = str(abs(score))
    if score > 0:
        return f"{len(digits):04d}{digits}"
    return f"{9999 - len(digits):04d}" + "".join(str(9 - int(d)) for d in digits)


class Cells:
    """The top level: routing objects by dimension, and the radius and number of trees of each cell.

    A vector of a dimension without routing objects, or with a component beyond HUGE, is in the cell -dimension, which
    every query of the dimension visits.
    """

    def __init__(self, pivots: list[list[float]], scale: int):
        self.scale = scale
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for dim in sorted({len(p) for p in pivots}):
            at = [k for k, p in enumerate(pivots) if len(p) == dim]
            self.of[dim] = np.array(at), np.floor(np.array([pivots[k] for k in at], float) * scale)
        self.radius: dict[int, float] = {}
        self.trees: dict[int, int] = {}

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance) of vectors of one dimension."""
        n, dim = vectors.shape
        cell, far = np.full(n, -dim), np.full(n, math.inf)
        with np.errstate(over="ignore"):
            v = np.floor(vectors * self.scale)
        plain = np.flatnonzero(np.abs(v).max(axis=1) <= HUGE)
        if dim in self.of and len(plain):
            at, centres = self.of[dim]
            for start in range(0, len(plain), 1000):
                own = plain[start : start + 1000]
                d = np.stack([((v[own] - c) ** 2).sum(axis=1) for c in centres])
                cell[own], far[own] = at[d.argmin(axis=0)], np.sqrt(d.min(axis=0))
        return cell, far

    def bounds(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells of a query's dimension that have trees, its products with their routing objects, and bounds of all its products there."""
        dim = len(query)
        with np.errstate(over="ignore"):
            q = np.floor(query * self.scale)
        at, centres = self.of.get(dim, (np.zeros(0, int), np.zeros((0, dim))))
        there = np.array([int(c) in self.trees for c in at], bool)
        at, centres = at[there], centres[there]
        if np.abs(q).max() > HUGE:
            products, reach = np.zeros(len(at)), np.full(len(at), math.inf)
        else:
            norm, radius = float(np.sqrt(q @ q)), np.array([self.radius[int(c)] for c in at])
            products = centres @ q
            reach = products + norm * radius + SLACK * (1 + norm) * (1 + np.sqrt((centres**2).sum(axis=1)) + radius)
        if -dim in self.trees:
            at, products, reach = np.append(at, -dim), np.append(products, -math.inf), np.append(reach, math.inf)
        return at, products, reach


_PASS = ["cell", "sub", "part", "kind", "tree", "query_id", "q", "v", "least"]
_FOUND = "query_id long, q long, vec_id long, score long, wide string"


def _search(k: int):
    """Over rows sorted by (cell, sub, part, kind): a tree, then the queries that pass by it."""

    def run(batches):
        tree = None
        for batch in batches:
            found = []
            rows = (batch.column(c).to_pylist() for c in ("kind", "tree", "query_id", "q", "v", "least"))
            for kind, data, own, q, v, least in zip(*rows, strict=True):
                if kind == 0:
                    tree = pickle.loads(data)
                    continue
                for s, i in tree.search(v, own, k, least):
                    found.append((own, q, i, max(-_LONG, min(_LONG, s)), beyond(s)))
            columns = [*zip(*found, strict=True)] if found else [()] * 5
            types = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["query_id", "q", "vec_id", "score", "wide"]
            )

    return run


def _passing(trees: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """What queries (cell, sub, query_id, q, v, least) find in the trees they are sent to."""
    queries = queries.withColumn("one", F.xxhash64("query_id", "q"))
    parts = queries.groupBy("cell", "sub").agg(F.ceil(F.count("*") / PASSING).cast("int").alias("parts"))
    parts = parts.select(F.col("cell").alias("c2"), F.col("sub").alias("s2"), "parts")
    here = (F.col("cell") == F.col("c2")) & (F.col("sub") == F.col("s2"))
    left = trees.join(parts, here).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    nothing = {"query_id": "long", "q": "long", "v": "array<double>", "least": "long"}
    left = left.select("cell", "sub", "part", F.lit(0).alias("kind"), "tree", *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()))
    right = queries.join(parts, here).withColumn("part", F.pmod("one", "parts").cast("int"))
    right = right.select("cell", "sub", "part", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("tree"), *nothing)
    both = left.unionByName(right).repartition("cell", "sub", "part").sortWithinPartitions("cell", "sub", "part", "kind")
    return both.mapInArrow(_search(k), _FOUND)


def top_k(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10, scale: int = 1024, group: int = GROUP, pivots: int = PIVOTS
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every`` the k best other rows.

    Components become floor(scale * x), exactly for every finite x, and products are exact integers; a score that a long cannot
    hold is returned as the nearest one that it can, in the order of the exact scores. Vectors that are null, empty, or hold a
    null or non-finite component take no part, nor do pairs of vectors of unlike length. Rows with the query's id are the
    query's own. A row repeated in full is one query, but each of its copies is a candidate of other queries. A null id is
    never a query; as a candidate it comes after all other ids of its score. No rows give no rows. Other columns are not
    looked at. At most ``pivots`` vectors, which go to the driver, route the others.
    """
    spark = df.sparkSession
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    vectors = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(fine)
    n = vectors.count()
    moderate = ~F.exists("v", lambda x: F.abs(x) > HUGE / scale / 2)
    drawn = vectors.where(moderate).select("v", F.xxhash64("v").alias("h")).dropDuplicates(["h"]).orderBy("h").limit(
        max(1, min(pivots, -(-n // group)))
    )
    cells = Cells([r.v for r in drawn.collect()], scale)

    def assign(batches):
        for batch in batches:
            rows = batch.column(1)
            sizes = np.array([len(x) for x in rows])
            cell, far = np.zeros(len(sizes), np.int64), np.zeros(len(sizes))
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                cell[at], far[at] = cells.nearest(np.array(rows.take(pa.array(at)).to_pylist(), float))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=["vec_id", "v", "cell", "far"])

    assigned = stored(vectors.mapInArrow(assign, "vec_id long, v array<double>, cell long, far double"))
    stats = assigned.groupBy("cell").agg(F.max("far").alias("radius"), F.ceil(F.count("*") / group).cast("int").alias("trees")).collect()  # a row a cell
    for r in stats:
        cells.radius[r.cell], cells.trees[r.cell] = r.radius, r.trees
    counts = spark.createDataFrame([(r.cell, r.trees) for r in stats], "c2 long, trees int")
    dealt = assigned.join(F.broadcast(counts), F.col("cell") == F.col("c2")).withColumn(
        "sub", F.pmod(F.xxhash64("vec_id", "v"), "trees").cast("int")
    )

    def build(key, part: pd.DataFrame) -> pd.DataFrame:
        tree = MTree([None if pd.isna(i) else int(i) for i in part.vec_id], np.stack(part.v.to_numpy()), scale=scale)
        return pd.DataFrame({"cell": [key[0]], "sub": [key[1]], "tree": [pickle.dumps(tree)]})

    trees = stored(
        dealt.select("cell", "sub", "vec_id", "v").groupBy("cell", "sub").applyInPandas(build, "cell long, sub int, tree binary")
    )
    queries = assigned.where(F.col("vec_id") % every == 0).select(
        F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("q"), "v"
    ).dropDuplicates(["query_id", "q"])

    def first_tree(query_id: int, q: int, query: np.ndarray) -> tuple[int, int]:
        at, products, _ = cells.bounds(query)
        cell = int(at[int(np.argmax(products))])
        return cell, (query_id + q) % cells.trees[cell]

    def route(batches):
        for batch in batches:
            out = []
            for query_id, q, v, least in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                query = np.array(v)
                first = first_tree(query_id, q, query)
                if batch.num_columns == 4:
                    out.append((*first, query_id, q, v, None))
                    continue
                at, _, reach = cells.bounds(query)
                for cell in at[reach >= (-math.inf if least is None else least)].tolist():
                    out += [(cell, sub, query_id, q, v, least) for sub in range(cells.trees[cell]) if (cell, sub) != first]
            columns = [*zip(*out, strict=True)] if out else [()] * 6
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.int64()]
            names = ["cell", "sub", "query_id", "q", "v", "least"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    routed = "cell long, sub int, query_id long, q long, v array<double>, least long"
    queries = stored(queries)
    found = stored(_passing(trees, queries.withColumn("least", F.lit(None).cast("long")).mapInArrow(route, routed), k))
    kth = found.groupBy(F.col("query_id").alias("id2"), F.col("q").alias("q2")).agg(F.min("score").alias("least"), F.count("*").alias("n"))
    second = queries.join(kth, (F.col("query_id") == F.col("id2")) & (F.col("q") == F.col("q2")), "left")
    second = second.select("query_id", "q", "v", F.when(F.col("n") >= k, F.col("least")).alias("least"), F.lit(2).alias("round"))
    found = found.unionByName(_passing(trees, second.mapInArrow(route, routed), k))
    order = Window.partitionBy("query_id", "q").orderBy(
        F.col("score").desc(), F.col("wide").desc_nulls_last(), F.col("vec_id").asc_nulls_last()
    )
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
