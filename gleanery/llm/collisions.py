"""Embedding near-duplicates by counting collisions of one-dimensional projections."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gleanery.llm.common import staged
from gleanery.llm.components import connected_components
from gleanery.llm.vectors import matrix, usable

PROJECTIONS = 24
WINDOW = 1.5         # half width of a window, in standard deviations of a pair at the threshold
RECALL = 0.995       # of pairs at the threshold, by the collision count
REACH = 3.5          # standard deviations the cells of the first projection allow for
BLOCK = 4096         # vectors on either side of a tile
STRIP = 512          # left vectors of a tile compared at a time
SEED = 93


def directions(width: int) -> np.ndarray:
    """Random unit directions, the same for a width everywhere."""
    rows = np.random.default_rng([SEED, width]).normal(size=(PROJECTIONS + 1, width))
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def deviation(cosine: float, width: int) -> float:
    """Standard deviation, over directions, of the projected difference of two unit vectors."""
    return math.sqrt(max(0.0, 2 - 2 * cosine) / width)


def needed_collisions() -> int:
    """The largest count that a pair at the threshold reaches with probability RECALL."""
    p, tail = math.erf(WINDOW / math.sqrt(2)), 0.0
    for count in range(PROJECTIONS, -1, -1):
        tail += math.comb(PROJECTIONS, count) * p**count * (1 - p) ** (PROJECTIONS - count)
        if tail >= RECALL:
            return count
    return 0


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; first scaled by their largest component, so nothing overflows."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def candidates(left: np.ndarray, right: np.ndarray, half: float, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs for which at least ``need`` projections collide.

    Two values collide when the right one lies in the left one's window. ``right`` is
    sorted once per projection; a window is a range of that order. A pair may miss
    columns - need windows: after so many, those that missed them all are gone and
    the rest, now few, are counted on pair by pair, leaving as soon as they cannot reach ``need``.
    """
    columns = left.shape[1]
    start = min(columns, max(columns - need + 1, columns // 2))
    orders = np.argsort(right[:, :start], axis=0, kind="stable")
    values = np.take_along_axis(right[:, :start], orders, axis=0)
    place = np.empty_like(orders)
    np.put_along_axis(place, orders, np.arange(len(right))[:, None], axis=0)
    place = np.ascontiguousarray(place.T.astype(np.int32))
    found_left, found_right = [], []
    for at in range(0, len(left), STRIP):
        strip = left[at:at + STRIP]
        counts = np.zeros((len(strip), len(right)), np.int8)
        for column in range(start):
            low = np.searchsorted(values[:, column], strip[:, column] - half, side="left").astype(np.int32)
            high = np.searchsorted(values[:, column], strip[:, column] + half, side="right").astype(np.int32)
            # one comparison: places below the window wrap round to large numbers
            counts += (place[column][None, :] - low[:, None]).view(np.uint32) < (high - low).view(np.uint32)[:, None]
        i, j = np.nonzero(counts >= need - (columns - start))
        reached = counts[i, j]
        for column in range(start, columns):
            value, middle = right[j, column], strip[i, column]
            reached = reached + ((value >= middle - half) & (value <= middle + half))
            live = reached >= need - (columns - 1 - column)
            i, j, reached = i[live], j[live], reached[live]
        found_left.append(i + at)
        found_right.append(j)
    if not found_left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_left), np.concatenate(found_right)


def _roots(first: np.ndarray, second: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Smallest node linked to each, over the given pairs of places."""
    label = nodes.copy()
    while True:
        low = np.minimum(label[first], label[second])
        before = label.copy()
        np.minimum.at(label, first, low)
        np.minimum.at(label, second, low)
        if np.array_equal(before, label):
            return label


def _tiles(classes: DataFrame, cosine: float) -> DataFrame:
    """(node, links, root) from every tile of two blocks of neighbouring cells.

    A cell is a range of the first projection within a label; a full cell is cut
    into blocks by a hash, so no block is larger than intended whatever its label or
    cell holds. Each pair of vectors meets in one tile at most.
    """
    cells = classes.groupBy("label", "width", "cell").agg(F.count(F.lit(1)).alias("n")).select(
        "label", "width", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")
    )
    following = cells.select("label", "width", (F.col("cell") - 1).alias("cell"), F.col("blocks").alias("next_blocks"))
    before = cells.select("label", "width", (F.col("cell") + 1).alias("cell"), F.col("blocks").alias("last_blocks"))
    key = ["label", "width", "cell"]
    layout = cells.join(following, key, "left").join(before, key, "left")
    placed = classes.join(layout, key).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    )
    own = "transform(sequence({0}), b -> struct(cell as cell, {1}, false as beside))"
    upper = F.expr(own.format("block, blocks - 1", "block as a, b as b"))
    lower = F.expr(own.format("0, block", "b as a, block as b"))
    ahead = F.expr(
        "if(next_blocks is null, array(), transform(sequence(0, next_blocks - 1), "
        "b -> struct(cell as cell, block as a, b as b, true as beside)))"
    )
    behind = F.expr(
        "if(last_blocks is null, array(), transform(sequence(0, last_blocks - 1), "
        "a -> struct(cell - 1 as cell, a as a, block as b, true as beside)))"
    )
    data = ["node", "members", "vector"]
    left = placed.select("label", "width", F.explode(F.concat(upper, ahead)).alias("tile"), *data)
    other = placed.select("label", "width", F.explode(F.concat(lower, behind)).alias("tile"), *data)
    right = other.select(*[F.col(c).alias(c) for c in other.columns])
    need = needed_collisions()

    def compare(one: pa.Table, two: pa.Table) -> pa.Table:
        nodes = links = roots = np.zeros(0, np.int64)
        if len(one) and len(two):
            tile = one.column("tile")[0].as_py()
            same = not tile["beside"] and tile["a"] == tile["b"]
            a, b = unit(matrix(one.column("vector"))), unit(matrix(two.column("vector")))
            along = directions(a.shape[1])[1:].T
            half = WINDOW * deviation(cosine, a.shape[1])
            i, j = candidates(a @ along, b @ along, half, need)
            node_a, node_b = one.column("node").to_numpy(), two.column("node").to_numpy()
            if same:
                once = node_a[i] < node_b[j]
                i, j = i[once], j[once]
            close = np.concatenate(
                [np.einsum("ij,ij->i", a[i[s:s + 65536]], b[j[s:s + 65536]]) for s in range(0, len(i), 65536)]
                or [np.zeros(0)]
            ) >= cosine
            i, j = i[close], j[close]
            every, place = np.unique(np.concatenate([node_a[i], node_b[j]]), return_inverse=True)
            first, second = place[:len(i)], place[len(i):]
            weight = np.bincount(first, two.column("members").to_numpy()[j], len(every)) + np.bincount(
                second, one.column("members").to_numpy()[i], len(every)
            )
            nodes, links, roots = every, weight.astype(np.int64), _roots(first, second, every)
        return pa.table([pa.array(c, pa.int64()) for c in (nodes, links, roots)], names=["node", "links", "root"])

    by = ["label", "width", "tile"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(compare, "node long, links long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id) for every row of ``vectors`` (vec_id, embedding, label).

    Vectors of one label link at a cosine of at least ``cosine``. Equal vectors form
    one class first. Classes meet in tiles along a first projection; pairs whose
    further projections collide often enough, a count a pair at the threshold reaches
    with probability ``RECALL``, are verified in double precision, so no link is wrong.
    A tile returns link counts and a spanning star, not pairs.

    Vectors that are null, zero, or hold null or non-finite components, and rows with a
    null label, link nothing; neither do vectors of unequal length. Rows without vec_id
    are no one's link and have no component; rows repeating a vec_id count as further
    vectors of that id.
    """
    given = vectors.select("vec_id", "embedding", "label")
    good = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("embedding")
        & F.exists("embedding", lambda x: x != 0)
    )
    part = given.where(good)
    grouped = part.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("members"))

    @F.arrow_udf("long")
    def cell_of(column: pa.Array) -> pa.Array:
        widths = np.diff(column.offsets.to_numpy())
        cells = np.zeros(len(column), np.int64)
        for width in np.unique(widths):
            rows = np.flatnonzero(widths == width)
            part = unit(matrix(column.take(pa.array(rows)), int(width)))
            cells[rows] = np.floor((part @ directions(int(width))[0]) / (REACH * deviation(cosine, int(width))))
        return pa.array(cells, pa.int64())

    classes = staged(
        grouped.select(
            "label", F.size("embedding").alias("width"), cell_of("embedding").alias("cell"), "node", "members",
            F.col("embedding").alias("vector"),
        )
    )
    found = staged(_tiles(classes, cosine))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    component = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = (
        classes.join(links, "node", "left")
        .join(component, "node", "left")
        .select(
            F.col("label").alias("_label"), F.col("vector").alias("_vector"),
            (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        )
    )
    linked = part.join(
        named, (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_vector"))
    ).select("vec_id", "n_links", "component_id")
    alone = given.where(~F.coalesce(good, F.lit(False))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(alone)


def report(vectors: DataFrame) -> DataFrame:
    """As ``near_duplicates``, with kept: the row stands for its component, or has no id."""
    return near_duplicates(vectors).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    )


SQL = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
      where list_cosine_similarity(a.e, b.e) >= 0.93),
r(id, reach) as (select vec_id, vec_id from embeddings union select r.id, l.b from r join l on r.reach = l.a),
c as (select id, min(reach) as component_id from r group by id),
n as (select a, count(*) as n_links from l group by a)
select e.vec_id, cast(coalesce(n.n_links, 0) as bigint) as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join c on e.vec_id = c.id left join n on e.vec_id = n.a
"""
