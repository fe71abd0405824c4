"""Exact top-k inner product search by a dual-tree walk over cover trees.

Vectors and queries are dealt into blocks; each pair of a query block and a vector block is one group, in which both
sides are indexed by a cover tree. A pair of nodes is dropped when the best inner product its centres and radii allow
is below the worst k-th score of the query node. With several vector blocks, every query first meets one of them, and
takes its k-th score there to the others. The block results are merged per query.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import ship, table, written

ship(__name__)

LEAF, QUERY_LEAF, BASE = 64, 8, 1.3
LONG = float(1 << 63) * (1 - 1e-12)  # what a score must stay below


class Node:
    """A centre, the covering radius of all points below it, its level, and children or, in a leaf, the points."""

    __slots__ = ("centre", "children", "level", "norm", "points", "radius")

    def __init__(self, x: np.ndarray, centre: int, points: np.ndarray, level: int | None, children: list[Node]) -> None:
        self.centre, self.points, self.level, self.children = x[centre], points, level, children
        self.radius = float(distances(x[points], self.centre).max()) if len(points) else 0.0
        self.norm = float(np.sqrt((self.centre**2).sum()))


def distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - centre) ** 2).sum(1))


def tree(x: np.ndarray, leaf: int = LEAF) -> Node:
    """A cover tree. The centres of level l lie more than BASE**l apart, all points within BASE**l of one of them; each is
    below the nearest centre of the next coarser level, and a centre of its own there if it lies far from the others.

    Farthest-first order gives all levels at once: those centres are in level l that were farther than BASE**l from the ones
    before. It ends at one centre for ``leaf`` points; these have the points next to them as leaves."""
    first = int(distances(x, x.mean(0)).argmin())
    near, owner, order, gap = distances(x, x[first]), np.zeros(len(x), np.int64), [first], [math.inf]
    while len(order) * leaf < len(x) and near.max() > 0:
        c = int(near.argmax())
        d = distances(x, x[c])
        closer = d < near
        gap.append(float(near[c]))
        owner[closer], near = len(order), np.minimum(near, d)
        order.append(c)
    nodes = {i: Node(x, c, np.flatnonzero(owner == i), None, []) for i, c in enumerate(order)}
    level = np.array([math.ceil(math.log(g, BASE)) - 1 if g < math.inf else 1 << 30 for g in gap])
    for l in (np.unique(level)[:-1] + 1).tolist():
        up = np.flatnonzero(level >= l)
        below: dict[int, list[int]] = {int(i): [] for i in up}
        for i in nodes:
            below[i if level[i] >= l else int(up[distances(x[np.array(order)[up]], x[order[i]]).argmin()])].append(i)
        nodes = {i: nodes[c[0]] if len(c) == 1 else Node(x, order[i], np.concatenate([nodes[j].points for j in c]), l, [nodes[j] for j in c]) for i, c in below.items()}
    return nodes[0]


def _modulo(x: np.ndarray) -> np.ndarray:
    """Whole numbers modulo 2**64, as 64-bit ones; those below 2**63 stay what they are."""
    small = np.abs(x) < LONG
    out = np.where(small, x, 0).astype(np.int64)
    for i, j in zip(*np.nonzero(~small), strict=True):
        out[i, j] = (int(x[i, j]) + (1 << 63)) % (1 << 64) - (1 << 63)
    return out


def search(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row of the query, id and score of its k best rows of ``x`` with another id (higher scores first, then lower ids), and the
    number of rows that each query was scored with. Scores below ``floor`` (one a query) may be left out.

    Components are whole numbers. Where a score could pass 2**53, scores are worked out modulo 2**64, which is exact for a long; one
    that is none raises an error."""
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    wide = largest >= float(1 << 53)
    whole_q, whole_x = (_modulo(q), _modulo(x)) if wide else (q, x)
    none = np.iinfo(np.int64).min
    best, ids = np.full((len(q), k), none), np.full((len(q), k), np.iinfo(np.int64).max)
    if wide and floor is not None:
        floor = floor - np.where(np.isfinite(floor), np.abs(floor) * 1e-15 + 1, 0)
    least, scored = np.full(len(q), -np.inf) if floor is None else floor.astype(float), np.zeros(len(q), np.int64)

    def leaf(a: np.ndarray, b: np.ndarray) -> None:
        s = q[a] @ x[b].T  # exact below 2**53
        own = q_ids[a][:, None] == x_ids[b][None, :]
        if wide:
            if largest >= LONG and np.abs(np.where(own, 0, s)).max(initial=0) >= LONG:
                raise OverflowError("a score is no long")
            s = whole_q[a] @ whole_x[b].T
        s = s.astype(np.int64)
        scored[a] += len(b)
        s[own] = none
        hit = np.flatnonzero(((s > none) & (s >= np.maximum(least[a], -1e300)[:, None])).any(1))
        if not len(hit):
            return
        a = a[hit]
        all_s = np.concatenate([best[a], s[hit]], 1)
        all_i = np.concatenate([ids[a], np.broadcast_to(x_ids[b], (len(a), len(b)))], 1)
        order = np.lexsort((all_i, ~all_s), axis=1)[:, :k]
        best[a], ids[a] = np.take_along_axis(all_s, order, 1), np.take_along_axis(all_i, order, 1)
        last = best[a, -1]
        least[a] = np.maximum(least[a], np.where(last > none, last.astype(float), -np.inf))

    def bound(a: Node, b: Node) -> float:
        at_best = float(a.centre @ b.centre) + a.norm * b.radius + b.norm * a.radius + a.radius * b.radius
        return at_best + 1e-6 + 1e-9 * abs(at_best)

    def walk(a: Node, b: Node, most: float) -> None:
        if most < least[a.points].min():
            return
        if not a.children and not b.children:
            leaf(a.points, b.points)
        elif a.children and (not b.children or a.radius > b.radius):
            for c in a.children:
                walk(c, b, bound(c, b))
        else:
            for m, _, c in sorted(((bound(a, c), i, c) for i, c in enumerate(b.children)), reverse=True):
                walk(a, c, m)

    a, b = tree(q, QUERY_LEAF), tree(x)
    walk(a, b, bound(a, b))
    row, col = np.nonzero(best > none)
    return row, ids[row, col], best[row, col], scored


def _floor(v: Column) -> Column:
    """As a double; from 2**52 on, a double is whole."""
    return F.when(F.abs(v) < float(1 << 52), F.floor(v).cast("double")).otherwise(v)


def scaled(embedding: Column, scale: float) -> Column:
    """floor(scale * x) of each component; null where the vector is null or holds a null or non-finite component."""
    d = F.transform(embedding, lambda v: v.cast("double"))
    odd = F.exists(d, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(embedding.isNotNull() & (F.size(embedding) > 0) & ~odd, F.transform(d, lambda v: _floor(v * F.lit(float(scale)))))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, block: int = 16384, query_block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest inner products of each query with all other rows; and scored, the number of
    rows that the query was scored with.

    Queries are the rows whose vec_id is divisible by ``every``, equal ones once. Rows with a null vec_id, a vector that is
    null, empty or holds a null or non-finite component take no part. Rows of the query's own vec_id are not its
    candidates; all others are, equal ones each by itself, in order of vec_id where scores tie; rows of another length
    than the query's are not comparable and no candidates either. Scores are exact; one that is no
    64-bit number is an error. Fewer candidates than
    ``k`` give fewer rows, an empty table none. Other columns, of whatever names, are not read.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding"), scale).alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    n = vectors.count()
    blocks, q_blocks = max(1, math.ceil(n / block)), max(1, math.ceil(n / every / query_block))
    spread = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    data = v.select("vec_id", "v", spread.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"))
    asked = v.filter(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates()
    asked = asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("w"), F.xxhash64("v").alias("q"), F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int").alias("qb"))
    home = F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(blocks))

    def group(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size in set(left["w"].map(len)):
            a, b = left[left["w"].map(len) == size], right[right["v"].map(len) == size]
            if len(a) and len(b):
                ids, key = a["query_id"].to_numpy(), a["q"].to_numpy()
                row, vec, score, scored = search(np.stack(a["w"]), ids, np.stack(b["v"]), b["vec_id"].to_numpy(), k, a["floor"].fillna(-np.inf).to_numpy())
                out.append(pd.DataFrame({"query_id": ids[row], "q": key[row], "vec_id": pd.array(vec, "Int64"), "score": pd.array(score, "Int64"), "scored": 0}))
                out.append(pd.DataFrame({"query_id": ids, "q": key, "vec_id": pd.array([None] * len(ids), "Int64"), "score": pd.array([None] * len(ids), "Int64"), "scored": scored}))
        return pd.concat(out) if out else pd.DataFrame({c: pd.array([], "Int64") for c in ("query_id", "q", "vec_id", "score", "scored")})

    def searched(queries: DataFrame) -> DataFrame:
        return queries.groupBy("b", "qb").cogroup(data.groupBy("b", "qb")).applyInPandas(group, "query_id long, q long, vec_id long, score long, scored long")

    each = Window.partitionBy("query_id", "q")
    rank = F.row_number().over(each.orderBy(F.desc_nulls_last("score"), "vec_id"))
    found = searched(asked.withColumn("b", home).withColumn("floor", F.lit(None).cast("double")))
    if blocks > 1:
        found = written(found, "first")
        floor = found.filter("vec_id IS NOT NULL").withColumn("rank", rank).filter(F.col("rank") == k).select("query_id", "q", F.col("score").cast("double").alias("floor"))
        every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
        rest = asked.join(floor, ["query_id", "q"], "left").withColumn("home", home).withColumn("b", every_block).filter("b <> home").drop("home")
        found = found.unionByName(searched(rest))
    found = found.withColumn("rank", rank).withColumn("scored", F.sum("scored").over(each)).filter(F.col("rank") <= k).filter("vec_id IS NOT NULL")
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "scored")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings")).drop("scored")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, q.v, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, v ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
