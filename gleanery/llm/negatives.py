"""Hard-negative mining over an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from gleanery.llm.common import staged
from gleanery.llm.vectors import matrix, usable

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90        # percent of the positive's score a negative's lies between
CODES = 16                # centroids of each half
SAMPLE_ROWS = 4096        # rows the two codebooks are fitted on; every row is indexed
ROUNDS = 8                # of the fit
TILE_BYTES = 4 << 20      # vectors a task holds of either side, as doubles
STEP = 512                # rows gathered from cells before they are scored
LONG = (1 << 63) - 1


def fit_codebook(points: np.ndarray, codes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids by Lloyd's rounds from rows spread over the sample; empty codes keep their place."""
    points = np.unique(points, axis=0)
    if not len(points):
        return np.zeros((1, points.shape[1]))
    centres = points[np.linspace(0, len(points) - 1, min(codes, len(points))).astype(int)].copy()
    for _ in range(rounds):
        code = nearest(points, centres)
        for c in np.unique(code):
            centres[c] = points[code == c].mean(axis=0)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * points @ centres.T, axis=1)


def halves(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = (vectors.shape[1] + 1) // 2
    return vectors[:, :cut], vectors[:, cut:]


def safe_component(width: int) -> int:
    """Components up to this give products that doubles hold exactly."""
    return 1 << ((53 - max(1, width).bit_length()) // 2)


class MultiIndex:
    """Rows of a tile in cells (code of the first half, code of the second).

    Rows whose components are too large for exact doubles stay outside the
    cells, as Python integers, and are scored for every anchor.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, whole: np.ndarray, codes: np.ndarray):
        limit = safe_component(whole.shape[1])
        plain = np.abs(whole).max(axis=1, initial=0) <= limit
        order = np.flatnonzero(plain)
        order = order[np.lexsort((ids[order], codes[order, 1], codes[order, 0]))]
        rest = np.flatnonzero(~plain)
        self.limit = limit
        self.ids = np.concatenate([ids[order], ids[rest]])
        self.labels = np.concatenate([labels[order], labels[rest]])
        self.whole = whole[order]
        self.wide = [[int(x) for x in row] for row in whole[rest]]
        self.cells: dict[tuple[int, int], tuple[int, int]] = {}
        self.sides: list[tuple[np.ndarray, np.ndarray]] = []       # (centres, radii) of the codes in use
        if not len(order):
            return
        used = []
        for side, points in enumerate(halves(self.whole)):
            present, code = np.unique(codes[order, side], return_inverse=True)
            sums = np.zeros((len(present), points.shape[1]))
            np.add.at(sums, code, points)
            centres = sums / np.bincount(code)[:, None]
            radii = np.zeros(len(present))
            np.maximum.at(radii, code, np.linalg.norm(points - centres[code], axis=1))
            self.sides.append((centres, radii))
            used.append(code)
        flat = used[0] * len(self.sides[1][1]) + used[1]
        starts = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        ends = np.append(starts[1:], len(flat))
        for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
            self.cells[int(used[0][start]), int(used[1][start])] = (start, end)

    def visit(self, query: np.ndarray) -> Iterator[tuple[float, tuple[int, int]]]:
        """(bound, rows) of the cells by falling bound: multi-sequence walk over two sorted halves.

        A half's bound is the centroid's product plus the radius times the query's
        length, so no row of a cell scores above the sum of its two bounds.
        """
        if not self.cells:
            return
        ranked = []
        for part, (centres, radii) in zip(halves(query[None, :]), self.sides, strict=True):
            length = np.linalg.norm(part)
            bound = centres @ part[0] + radii * length
            bound += 1 + 1e-9 * length * (np.linalg.norm(centres, axis=1) + radii)      # rounding
            order = np.argsort(-bound, kind="stable")
            ranked.append((order.tolist(), bound[order].tolist()))
        (first, above), (second, below) = ranked
        heap = [(-(above[0] + below[0]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            rows = self.cells.get((first[i], second[j]))
            if rows:
                yield -bound, rows
            if j + 1 < len(below):
                heapq.heappush(heap, (-(above[i] + below[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(above):
                heapq.heappush(heap, (-(above[i + 1] + below[0]), i + 1, 0))

    def scored(self, query: np.ndarray, least) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row numbers, scores) in batches, until ``least()`` certifies that no cell left matters."""
        whole = [int(x) for x in query]
        outside = len(self.whole)
        if self.wide:
            scores = [sum(a * b for a, b in zip(whole, row, strict=True)) for row in self.wide]
            yield np.arange(outside, outside + len(scores)), np.array(scores, dtype=object)
        if np.abs(query).max(initial=0) > self.limit:
            for at in range(0, outside, STEP):
                rows = np.arange(at, min(at + STEP, outside))
                exact = [sum(a * int(b) for a, b in zip(whole, row, strict=True)) for row in self.whole[rows]]
                yield rows, np.array(exact, dtype=object)
            return
        pending, size = [], 0
        for bound, (start, end) in self.visit(query):
            if size >= STEP:
                rows = np.concatenate(pending)
                yield rows, (self.whole[rows] @ query).astype(np.int64)
                pending, size = [], 0
            limit = least()
            if limit is not None and bound < limit:
                break
            pending.append(np.arange(start, end))
            size += end - start
        if pending:
            rows = np.concatenate(pending)
            yield rows, (self.whole[rows] @ query).astype(np.int64)


class Best:
    """The k first (score falling, id rising) of what lies in [low, high]."""

    def __init__(self, k: int, low: int | None = None, high: int | None = None, floor: int | None = None):
        self.k, self.high = k, high
        self.low = max((x for x in (low, floor) if x is not None), default=None)
        self.found: list[tuple[int, int]] = []      # (-score, id)

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        keep = np.ones(len(ids), bool)
        least = self.least()
        if least is not None:
            keep &= (scores >= least).astype(bool)
        if self.high is not None:
            keep &= (scores <= self.high).astype(bool)
        if keep.any():
            new = zip((-scores[keep]).tolist(), ids[keep].tolist(), strict=True)
            self.found = heapq.nsmallest(self.k, [*self.found, *new])

    def least(self) -> int | None:
        """What a row must reach to matter; rows that equal it still do, by their ids."""
        if len(self.found) < self.k:
            return self.low
        return -self.found[-1][0] if self.low is None else max(self.low, -self.found[-1][0])

    def rows(self) -> list[tuple[int, int]]:
        return [(i, -s) for s, i in self.found]


def positives(index: MultiIndex, anchor: dict, query: np.ndarray, k: int) -> Iterator[tuple]:
    """(part, id, score) of the tile's best rows with the anchor's label; part is always 0."""
    best = Best(k, floor=anchor["floors"][0])
    for rows, scores in index.scored(query, best.least):
        mine = (index.labels[rows] == anchor["label"]) & (index.ids[rows] != anchor["anchor_id"])
        best.offer(index.ids[rows[mine]], scores[mine])
    for vec_id, score in best.rows():
        yield 0, vec_id, score


def window(score: int) -> tuple[int, int]:
    """Smallest and largest negative score that goes with a positive's."""
    return -((-LOW * score) // 100), HIGH * score // 100


def negatives(index: MultiIndex, anchor: dict, query: np.ndarray, k: int) -> Iterator[tuple]:
    """(part, id, score): per positive score (``part``) the tile's best rows of other labels in its window."""
    parts = []
    for score, floor in zip(anchor["scores"], anchor["floors"], strict=True):
        low, high = window(score)
        if low <= high:
            parts.append((score, Best(k, low, high, floor)))
    if not parts:
        return

    def least() -> int | None:
        return min(best.least() for _, best in parts)       # a window always has a lower end

    for rows, scores in index.scored(query, least):
        other = index.labels[rows] != anchor["label"]
        ids, scores = index.ids[rows[other]], scores[other]
        for _, best in parts:
            best.offer(ids, scores)
    for score, best in parts:
        for vec_id, found in best.rows():
            yield score, vec_id, found


def _search(tiles: DataFrame, anchors: DataFrame, keys: list[str], walk, k: int) -> DataFrame:
    """(anchor_id, part, vec_id, score): ``walk`` of every anchor through the tiles it meets."""

    def answer(part: pa.Table, wanted: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(part) and len(wanted):
            width = max(2, *(matrix(t.column("whole")).shape[1] for t in (part, wanted)))
            index = MultiIndex(
                part.column("vec_id").to_numpy(),
                part.column("label").to_numpy(),
                matrix(part.column("whole"), width),
                np.stack([part.column("code1").to_numpy(), part.column("code2").to_numpy()], axis=1),
            )
            queries = matrix(wanted.column("whole"), width)
            for query, anchor in zip(queries, wanted.drop_columns(["whole"]).to_pylist(), strict=True):
                out += [(anchor["anchor_id"], *row) for row in walk(index, anchor, query, k)]
        kinds = [("anchor_id", pa.int64()), ("part", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        clipped = [[max(-LONG, min(LONG, x)) for x in c] for c in columns]
        return pa.table([pa.array(c, t) for c, (_, t) in zip(clipped, kinds, strict=True)], names=[n for n, _ in kinds])

    return tiles.groupBy(*keys).cogroup(anchors.groupBy(*keys)).applyInArrow(
        answer, "anchor_id long, part long, vec_id long, score long"
    )


def _codebooks(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Both codebooks, fitted in one task on at most ``SAMPLE_ROWS`` rows; only centroids reach the driver."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("whole").coalesce(1)

    def fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        points = matrix(pa.Table.from_batches(held).column("whole")) if held else np.zeros((0, 2))
        points = np.hstack([points, np.zeros((len(points), max(0, 2 - points.shape[1])))])      # a column each at least
        for side, part in enumerate(halves(points)):
            centres = fit_codebook(part, CODES)
            yield pa.RecordBatch.from_arrays(
                [pa.array([side] * len(centres), pa.int32()), pa.array(list(map(list, centres)), pa.list_(pa.float64()))],
                names=["side", "centre"],
            )

    books: list[list] = [[], []]
    for row in sample.mapInArrow(fit, "side int, centre array<double>").collect():
        books[row["side"]].append(row["centre"])
    return tuple(np.array(b or [[0.0]], float) for b in books)


def _tiles(rows: DataFrame, books: tuple[np.ndarray, np.ndarray], tiles: int) -> DataFrame:
    """Rows with their codes and tile; a tile is a range of cells, and a full cell is cut by vec_id."""
    width = books[0].shape[1] + books[1].shape[1]

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = matrix(batch.column("whole"))
            # longer vectors than the sample knew are coded by what the codebooks cover
            fitted = np.zeros((len(points), width))
            fitted[:, : min(width, points.shape[1])] = points[:, :width]
            codes = [nearest(p, b) for p, b in zip(halves(fitted), books, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(c, pa.int32()) for c in codes]], names=[*batch.schema.names, "code1", "code2"]
            )

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = TaskContext.get().partitionId()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([tile] * len(batch), pa.int32())], names=[*batch.schema.names, "tile"]
            )

    shape = "vec_id long, label int, whole array<double>, code1 int, code2 int"
    coded = rows.mapInArrow(encode, shape).repartitionByRange(tiles, "code1", "code2", "vec_id")
    return staged(coded.mapInArrow(number, f"{shape}, tile int"))


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, *, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors``: vec_id, embedding, label. Components are scaled and floored to
    integers, scores are exact inner products, higher ones come first and ties go to
    the smaller vec_id. Every row that ``is_anchor`` selects meets all rows, in tiles.

    Rows with a null in vec_id, label or embedding, or with a null or non-finite
    component, take no part. Shorter vectors are filled with zeros. Rows of the
    anchor's own vec_id are not its positives. A repeated row counts as often as it
    occurs; of several rows with one anchor's vec_id the smallest (label, vector)
    asks. Scores beyond 64 bits are exact inside a tile and come out as the largest
    long. An empty table, or an anchor without positives or negatives, gives no row;
    a positive with a negative score has no window. Other columns are ignored.
    """
    whole = F.transform("embedding", lambda x: F.floor(F.lit(SCALE) * x.cast("double")).cast("double"))
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("embedding"))
    rows = staged(good.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), whole.alias("whole")))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("whole")).alias("width")).first()
    a_tile = max(1, tile_bytes // (8 * max(1, size["width"] or 0)))
    tiles = max(1, -(-size["n"] // a_tile))
    index = _tiles(rows, _codebooks(rows), tiles)
    asking = staged(
        index.where(is_anchor).groupBy(F.col("vec_id").alias("anchor_id"))
        .agg(F.min(F.struct("label", "whole", "tile")).alias("a"))
        .select("anchor_id", "a.label", "a.whole", F.col("a.tile").alias("home"))
    )
    groups = max(1, -(-asking.count() // a_tile))
    group = F.pmod(F.xxhash64("anchor_id"), F.lit(groups)).cast("int")
    spread_index = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def search(anchors: DataFrame, walk, k: int) -> DataFrame:
        """All tiles, each starting from the floors the anchor's own tile gave."""
        home = _search(index, anchors.withColumnRenamed("home", "tile"), ["tile"], walk, k)
        floors = (
            home.groupBy("anchor_id", "part").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor"))
            .where(F.col("n") >= k).groupBy("anchor_id")
            .agg(F.map_from_entries(F.collect_list(F.struct("part", "floor"))).alias("known"))     # of five parts at most
        )
        informed = staged(
            anchors.join(floors, "anchor_id", "left")
            .withColumn("floors", F.transform("scores", lambda s: F.try_element_at(F.col("known"), s))).drop("known", "home")
        )
        met = informed.select(
            F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), group.alias("group"), *informed.columns
        )
        return _search(spread_index, met, ["tile", "group"], walk, k)

    nothing = F.array(F.lit(None).cast("long"))
    near = search(
        asking.select("*", F.array(F.lit(0).cast("long")).alias("scores"), nothing.alias("floors")), positives, POSITIVES
    )
    near = staged(
        _ranked(near, ["anchor_id"], POSITIVES)
        .select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    )
    scores = near.groupBy("anchor_id").agg(F.sort_array(F.collect_set("positive_score")).alias("scores"))
    windows = asking.join(scores, "anchor_id").withColumn(
        "floors", F.transform("scores", lambda _: F.lit(None).cast("long"))
    )
    hard = _ranked(search(windows, negatives, NEGATIVES), ["anchor_id", "part"], NEGATIVES)
    return near.join(hard.withColumnRenamed("part", "positive_score"), ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )


def report(vectors: DataFrame) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.select("vec_id", "embedding", moved.alias("label")), F.col("vec_id") % 100 == 0)


SQL = f"""
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                  list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as e from embeddings
           where label is not null and vec_id is not null and embedding is not null
             and len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
s as (select a.vec_id as anchor_id, d.vec_id, a.label = d.label as same,
             list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * d.e[i]))::bigint as score
      from v a join v d on a.vec_id <> d.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same
      qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= {POSITIVES}),
n as (select p.anchor_id, positive_id, positive_score, vec_id as negative_id, score as negative_score,
             cast(row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) as int) as rank
      from p join s on p.anchor_id = s.anchor_id and not same
      where {LOW} * positive_score <= 100 * score and 100 * score <= {HIGH} * positive_score)
select * from n where rank <= {NEGATIVES}
"""
