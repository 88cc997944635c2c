"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector is scaled to length one, rotated by a fixed random rotation, and kept
as the signs of its components with one correction scalar (the inner product of
the vector and its own code).  Code and scalar give an unbiased estimate of the
inner product with a rotated query, and a bound of its error.  A vector whose
upper bound does not reach the worst of a query's k best so far is passed over;
the others are scored exactly, in double precision, on the original vectors.

The queries may grow with the table: they are sent out in blocks of bounded size, each
block scanned against all codes in a job of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from logvigil.llm.stages import Stages

#: Queries of a block: at 1,000 dimensions about 16 MB of doubles.
QUERY_BLOCK = 2048
ROWS = 1024
PAIRS = 200_000
#: Width of the error bound in standard deviations.
EPSILON = 3.0


def usable(vector: Column) -> Column:
    """Finite, complete vectors that are not zero."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def one_per_id(vectors: DataFrame) -> DataFrame:
    """Usable vectors of the most frequent dimension, one per vec_id.

    Of rows that repeat a vec_id the smallest embedding stands for all.
    """
    held = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(
        F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    sizes = held.groupBy(F.size("embedding").alias("size")).count()
    usual = sizes.orderBy(F.desc("count"), "size").first()
    return held.where(F.size("embedding") == (usual["size"] if usual else 0)).groupBy("vec_id").agg(
        F.min("embedding").alias("embedding"))


def rotation(size: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def matrix(column: pa.ListArray) -> np.ndarray:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    return flat.reshape(len(column), -1)


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors, freed of extreme scales, and their lengths; cosines stay as they are."""
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    extreme = (largest < 1e-100) | (largest > 1e100)
    vectors = np.where(extreme, vectors / largest, vectors)
    return vectors, np.sqrt(np.einsum("ij,ij->i", vectors, vectors))


def encoded(vectors: DataFrame) -> DataFrame:
    """Add ``code`` (packed signs) and ``correction`` to (vec_id, embedding)."""
    kind = dict(vectors.dtypes)["embedding"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, lengths = scaled(matrix(batch.column(1)))
            turn = rotation(x.shape[1]) if turn is None else turn
            turned = (x / lengths[:, None]) @ turn
            correction = np.abs(turned).sum(axis=1) / np.sqrt(x.shape[1])
            codes = np.packbits(turned >= 0, axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()),
                 pa.array(correction)],
                names=["vec_id", "embedding", "code", "correction"])

    return vectors.select("vec_id", "embedding").mapInArrow(
        encode, f"vec_id long, embedding {kind}, code binary, correction double")


class Best:
    """The k best hits of each query so far: by score, ties to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        n = len(self.scores)
        query = np.concatenate([np.repeat(np.arange(n), self.k), query])
        ids = np.concatenate([self.ids.ravel(), ids])
        scores = np.concatenate([self.scores.ravel(), scores])
        order = np.lexsort((ids, -scores, query))
        place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        order = order[place < self.k]
        self.ids, self.scores = ids[order].reshape(n, self.k), scores[order].reshape(n, self.k)


def scan(codes: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score): each partition's k best for each query of one block."""
    sent = codes.sparkSession.sparkContext.broadcast((ids, queries))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, asked = sent.value
        asked, asked_lengths = scaled(asked)
        size = asked.shape[1]
        turned = ((asked / asked_lengths[:, None]) @ rotation(size)).astype(np.float32).T
        best = Best(len(query_ids), k)

        def exact(x, lengths, own, rows, cols):
            """Score pairs exactly and keep the best; a query never meets its own row."""
            for at in range(0, len(rows), PAIRS):
                r, c = rows[at:at + PAIRS], cols[at:at + PAIRS]
                other = own[r] != query_ids[c]
                r, c = r[other], c[other]
                scores = np.einsum("ij,ij->i", x[r], asked[c]) / (lengths[r] * asked_lengths[c])
                best.add(c, own[r], scores)

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                own = part.column(0).to_numpy()
                x, lengths = scaled(matrix(part.column(1)))
                bits = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(len(own), -1)
                signs = np.unpackbits(bits, axis=1, count=size).astype(np.float32) * 2 - 1
                correction = part.column(3).to_numpy()
                estimate = (signs @ turned) / (np.sqrt(size) * correction)[:, None]
                # one dimension leaves nothing to estimate: the code is the vector
                error = EPSILON * np.sqrt(np.maximum(1 - correction ** 2, 0)) / correction / np.sqrt(max(1, size - 1))
                if np.isneginf(best.scores[:, -1]).any() and len(own) > k:
                    # the most promising rows first, so that the bounds have something to beat
                    top = np.argpartition(-estimate, k, axis=0)[:k + 1]
                    exact(x, lengths, own, top.ravel(), np.tile(np.arange(len(query_ids)), k + 1))
                    estimate[top, np.arange(len(query_ids))] = -np.inf
                reach = estimate + (error[:, None] + 1e-6)
                exact(x, lengths, own, *np.nonzero((reach >= best.scores[:, -1]) & (estimate > -np.inf)))
        found = np.isfinite(best.scores)
        if found.any():
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(query_ids, found.sum(axis=1))), pa.array(best.ids[found]),
                pa.array(best.scores[found])], schema=schema)

    return codes.select("vec_id", "embedding", "code", "correction").mapInArrow(
        search, "query_id long, vec_id long, score double")


def nearest_neighbours(vectors: DataFrame, asks: Column, k: int = 5, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest cosines for each row that ``asks`` picks.

    Candidates are all rows but the query's own; with fewer, all are returned.
    Ties go to the smaller vec_id.  Rows without a vec_id, and vectors that are
    null, zero, of another length than most, or that hold null or non-finite
    components, take no part; of rows repeating a vec_id the smallest embedding
    stands for all.  An empty table gives no rows.  Columns other than vec_id
    and embedding are not read.
    """
    stages = Stages(vectors.sparkSession)
    codes = stages.keep(encoded(one_per_id(vectors)), "codes")
    queries = codes.where(asks).select("vec_id", "embedding")
    blocks = max(1, -(-queries.count() // block))
    hits = []
    for i in range(blocks):
        asked = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).orderBy("vec_id").collect()
        if asked:
            ids = np.array([r.vec_id for r in asked], np.int64)
            numbers = np.array([list(r.embedding) for r in asked], np.float64)
            hits.append(stages.keep(scan(codes, ids, numbers, k), "hits"))
    spark = vectors.sparkSession
    found = spark.createDataFrame([], "query_id long, vec_id long, score double") if not hits else hits[0]
    for other in hits[1:]:
        found = found.unionByName(other)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
