"""Nearest neighbours by a hash-prefix forest.

Every tree hashes a vector to a long string of bits, the signs of random
projections, and keeps the strings sorted. A query descends to its longest prefix
match in every tree; then all trees ascend together, one bit at a time, and each
gives the vectors that share the shortened prefix, until there are enough
candidates. Those are scored exactly.

The table is dealt into blocks of bounded size by the hash of the row, each with
its own forest, and the stated queries meet every block in bounded chunks; every
block passes on each query's nearest alone. On vectors without cluster structure
nothing but a large share of candidates gives good recall, so the number of
candidates is a share of the block (see README for measured recall).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.llm.common import bounded

TREES = 48
BITS = 32
#: Vectors of a block, queries of a chunk, and candidates as a share of the block.
BLOCK = 8192
CHUNK = 1024
SHARE = 0.7


class Forest:
    """Sorted hash strings of one block of vectors."""

    def __init__(self, vectors: np.ndarray, longest: float, trees: int = TREES, seed: int = 0):
        random = np.random.default_rng(seed)
        self.planes = random.normal(size=(trees, vectors.shape[1] + 1, BITS))
        # One more component makes all vectors equally long, so that the angle to a query falls as the inner product grows.
        rest = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0))
        strings = self._strings(np.column_stack((vectors, rest)))
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, axis=1)

    def _strings(self, vectors: np.ndarray) -> np.ndarray:
        """Bit strings as numbers, a row per tree; the first bit is the highest."""
        weights = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
        return np.stack([((vectors @ p > 0) * weights).sum(axis=1, dtype=np.uint64) for p in self.planes])

    def candidates(self, queries: np.ndarray, enough: int):
        """For every query the places of at least ``enough`` vectors (all, if fewer), longest prefixes first."""
        strings = self._strings(np.column_stack((queries, np.zeros(len(queries)))))
        n = self.sorted.shape[1]
        low, high = [np.zeros(strings.shape, np.int64)], [np.full(strings.shape, n)]
        for depth in range(1, BITS + 1):  # descend while any tree has a match
            shift = np.uint64(BITS - depth)
            prefix = strings >> shift << shift
            low.append(np.stack([np.searchsorted(s, q, "left") for s, q in zip(self.sorted, prefix, strict=True)]))
            last = prefix + ((np.uint64(1) << shift) - np.uint64(1))
            high.append(np.stack([np.searchsorted(s, q, "right") for s, q in zip(self.sorted, last, strict=True)]))
            if (low[-1] == high[-1]).all():
                break
        counts = np.stack([(h - lo).sum(axis=0) for lo, h in zip(low, high, strict=True)])
        for q in range(len(queries)):
            # Fewer than ``enough`` in all trees together cannot be enough: take those, then ascend tree by tree.
            depth = int(np.flatnonzero(counts[:, q] >= min(enough, n))[-1])
            found = np.zeros(n, bool)
            for level in range(min(depth + 1, len(low) - 1), -1, -1):
                for t in range(len(self.order)):
                    found[self.order[t, low[level][t, q] : high[level][t, q]]] = True
                    if level <= depth and np.count_nonzero(found) >= enough:
                        break
                if np.count_nonzero(found) >= min(enough, n):
                    break
            yield np.flatnonzero(found)


def usable(vector: Column, dimensions: int) -> Column:
    """True for vectors of that size with finite components, not all of them zero."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & sound & F.exists(vector, lambda x: x != 0), F.lit(False))


SCHEMA = "query_id long, vec_id long, score double"


def _names(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


def nearest(
    rows: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", share: float = SHARE, trees: int = TREES
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for the rows where ``queries`` holds, their ``k`` nearest other rows.

    Nearest is largest inner product in double precision, ties go to the smaller
    key. Keys and vectors that are null, and vectors that are empty, zero, hold
    null or non-finite components or are not of the table's commonest size take no
    part. Rows repeated under one key count once (of different vectors one, the
    first in the order of their components). A query with fewer than ``k``
    candidates gets them all. Extra columns are ignored; an empty table gives none.
    """
    bounded(rows.sparkSession)
    size = rows.where(f"{key} is not null").groupBy(F.size(vector).alias("n")).count().where("n > 0").orderBy(F.desc("count"), "n").first()
    spark = rows.sparkSession
    out_schema = "query_id long, rank int, vec_id long, score double"
    if size is None:
        return spark.createDataFrame([], out_schema)
    numbers = F.col(vector).cast("array<double>")
    sound = rows.select(F.col(key).cast("long").alias("id"), numbers.alias("x"), queries.alias("asks"))
    sound = sound.where(F.col("id").isNotNull() & usable(F.col("x"), size.n))
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, b: a + b * b))
    facts = sound.agg(F.count("*").alias("n"), F.count_if("asks").alias("q"), F.max(length).alias("longest")).first()
    blocks, chunks = max(1, math.ceil(facts.n / BLOCK)), max(1, math.ceil(facts.q / CHUNK))
    longest = facts.longest or 0.0

    def placed(of: DataFrame, own: str, n: int, other: str, m: int, asks: bool) -> DataFrame:
        of = of.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
        of = of.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
        return of.select("block", "chunk", F.lit(asks).alias("asks"), "id", "x")

    both = placed(sound, "block", blocks, "chunk", chunks, False).union(
        placed(sound.where("asks"), "chunk", chunks, "block", blocks, True)
    )

    def once(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = table.column("id").to_numpy()
        vectors = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        order = np.lexsort((*vectors.T[::-1], ids))
        ids, vectors = ids[order], vectors[order]
        first = np.concatenate(([True], ids[1:] != ids[:-1]))[: len(ids)]
        return ids[first], vectors[first]

    def search(table: pa.Table) -> pa.Table:
        asks = table.column("asks").combine_chunks()
        (ids, vectors), (wanted, points) = once(table.filter(pc.invert(asks))), once(table.filter(asks))
        owners, places, scores = [], [], []
        if len(ids) and len(wanted):
            forest = Forest(vectors, longest, trees)
            # One more, as the query itself may be among them, and never fewer than asked for.
            enough = max(k + 1, math.ceil(share * len(ids)))
            for i, at in enumerate(forest.candidates(points, enough)):
                at = at[ids[at] != wanted[i]]
                rough = vectors[at] @ points[i]
                if len(at) > k:  # all that may be among the nearest, rounding or not
                    at = at[rough >= np.partition(rough, -k)[-k] - 1e-9 * (1 + np.abs(rough).max())]
                # Row by row, so that equal vectors get equal scores.
                score = (vectors[at] * points[i]).sum(axis=1)
                best = np.lexsort((ids[at], -score))[:k]
                owners.append(np.full(len(best), wanted[i]))
                places.append(ids[at][best])
                scores.append(score[best])
        whole = [np.concatenate(c) if c else np.empty(0, t) for c, t in ((owners, np.int64), (places, np.int64), (scores, float))]
        return pa.Table.from_arrays([pa.array(c) for c in whole], names=_names(SCHEMA))

    found = both.groupBy("block", "chunk").applyInArrow(search, SCHEMA)
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", turn).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
