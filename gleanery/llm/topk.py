"""Exact top-k inner products by block-at-a-time pruning."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from gleanery.llm.common import staged
from gleanery.llm.vectors import matrix, usable

SCALE = 256
BLOCK = 64              # documents of a block
SHARD = 4096            # vectors a task holds of either side
STEP = 8                # blocks scored before the bound is looked at again
LARGEST = (1 << 63) - 1 # scores that a long cannot hold are set to its ends


def _whole(vectors: np.ndarray) -> np.ndarray:
    """floor(256 x) as doubles, exact integers."""
    return np.floor(SCALE * vectors)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


class Blocks:
    """A shard's vectors in id order, cut into ranges with the maxima of every term.

    A component is two terms, itself and its negative, so that maxima bound
    products with queries of either sign.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        cuts = np.arange(0, len(ids), BLOCK)
        self.most = np.hstack([np.maximum.reduceat(self.vectors, cuts), np.maximum.reduceat(-self.vectors, cuts)])
        self.cuts = np.append(cuts, len(ids))

    def search(
        self, query_id: int, query: np.ndarray, bounds: np.ndarray, k: int, floor: float = -np.inf
    ) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best; blocks go by falling bound until it is below the k-th score.

        ``floor`` is a k-th score known from elsewhere: what lies below it is left out.
        """
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] >= floor]
        ids, scores = np.zeros(0, np.int64), np.zeros(0)
        for at in range(0, len(order), STEP):
            blocks = order[at:at + STEP]
            if len(scores) == k:
                blocks = blocks[bounds[blocks] >= scores[-1]]
                if not len(blocks):
                    break
            rows = np.concatenate([np.arange(self.cuts[b], self.cuts[b + 1]) for b in blocks])
            found = self.vectors[rows] @ query
            keep = (self.ids[rows] != query_id) & (found >= floor)
            if len(scores) == k:
                keep &= found >= scores[-1]
            ids = np.concatenate([ids, self.ids[rows[keep]]])
            scores = np.concatenate([scores, found[keep]])
            best = _best(scores, ids, k)
            ids, scores = ids[best], scores[best]
        return ids, scores

    def all_scores(self, query_id: int, query: np.ndarray, k: int) -> tuple[list[int], list[int]]:
        """The same in unbounded integers, for values whose products leave the doubles' exact range."""
        whole = [int(x) for x in query]
        found = [
            (-min(LARGEST, max(-LARGEST, sum(a * int(b) for a, b in zip(whole, row, strict=True)))), int(i))
            for i, row in zip(self.ids, self.vectors, strict=True) if i != query_id
        ]
        found = sorted(found)[:k]
        return [i for _, i in found], [-s for s, _ in found]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best inner products of every query.

    Both frames have (vec_id, embedding). Components are scaled and floored to
    integers, scores are exact, ties go to the smaller vec_id, and a vector never
    answers the query of its own id. Vectors that are null or hold null or non-finite
    components take no part, nor do rows without vec_id; of rows with one vec_id the
    smallest vector counts. Shorter vectors are filled with zeros. Scores that a long
    cannot hold are set to its ends and tie there.

    A query is answered first in one shard, chosen by a hash; its k-th score there is the
    floor at which the other shards start, so they open only blocks whose bound reaches
    it. Every query group meets every shard of the index, a block of each at a
    time in memory.
    """

    def clean(df: DataFrame) -> DataFrame:
        good = df.where(F.col("vec_id").isNotNull() & usable("embedding"))
        return good.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))

    kept = staged(clean(vectors))
    asked = staged(clean(queries))
    shards = max(1, -(-kept.count() // SHARD))
    groups = max(1, -(-asked.count() // SHARD))

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * len(batch), pa.int32()), batch.column(0), batch.column(1)],
                names=["shard", "vec_id", "embedding"],
            )

    element = kept.schema["embedding"].dataType.simpleString()
    ranged = kept.repartitionByRange(shards, "vec_id").mapInArrow(
        number, f"shard int, vec_id long, embedding {element}"
    )
    index = staged(ranged)
    home = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("int")
    meetings = max(1, -(-asked.count() // (SHARD * shards)))    # query groups that a home shard meets
    nothing = F.lit(None).cast("long").alias("floor")

    def answer(part: pa.Table, wanted: pa.Table) -> pa.Table:
        rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(part) and len(wanted):
            width = max(matrix(part.column("embedding")).shape[1], matrix(wanted.column("embedding")).shape[1])
            blocks = Blocks(part.column("vec_id").to_numpy(), _whole(matrix(part.column("embedding"), width)))
            floors = wanted.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)   # null: NaN
            query_ids, whole = wanted.column("vec_id").to_numpy(), _whole(matrix(wanted.column("embedding"), width))
            reach = np.abs(blocks.vectors).max(initial=0) * np.abs(whole).max(initial=0) * max(1, width)
            exact = reach < 1 << 53
            terms = np.hstack([np.maximum(whole, 0), np.maximum(-whole, 0)])
            bounds = terms @ blocks.most.T if exact else None
            for i, query_id in enumerate(query_ids):
                found = (
                    blocks.search(query_id, whole[i], bounds[i], k, -np.inf if np.isnan(floors[i]) else floors[i]) if exact
                    else blocks.all_scores(query_id, whole[i], k)
                )
                rows.append((np.full(len(found[0]), query_id), np.array(found[0], np.int64), np.array(found[1], np.int64)))
        columns = [np.concatenate([r[c] for r in rows]) if rows else np.zeros(0, np.int64) for c in range(3)]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    def meet(spread: DataFrame, number: int) -> DataFrame:
        """Every index shard against each of ``number`` groups of the queries sent to it."""
        every = F.explode(F.sequence(F.lit(0), F.lit(number - 1))).alias("group")
        group = F.pmod(F.xxhash64("vec_id"), F.lit(number)).cast("int")
        left = index.select("shard", every, "vec_id", "embedding")
        right = spread.withColumn("group", group)
        return left.groupBy("shard", "group").cogroup(right.groupBy("shard", "group")).applyInArrow(
            answer, "query_id long, vec_id long, score long"
        )

    first = staged(meet(asked.select(home.alias("shard"), "vec_id", "embedding", nothing), meetings))
    floor = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    others = F.array_remove(F.sequence(F.lit(0), F.lit(shards - 1)), home)
    spread = asked.join(floor, F.col("vec_id") == F.col("query_id"), "left").select(
        F.explode(others).alias("shard"), "vec_id", "embedding", "floor"
    )
    found = first.unionByName(meet(spread, groups))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def report(vectors: DataFrame) -> DataFrame:
    return search(vectors.select("vec_id", "embedding"), vectors.where("vec_id % 50 = 0").select("vec_id", "embedding"))


SQL = f"""
with v as (select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as e from embeddings
           where embedding is not null
             and len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
p as (select q.vec_id as query_id, d.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * d.e[i]))::bigint as score
      from v q join v d on q.vec_id <> d.vec_id where q.vec_id % 50 = 0),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank,
             vec_id, score from p)
select * from r where rank <= 5
"""
