"""Knowledge-base retrieval (K9..K13)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from logvigil.constants import COLLECTIONS, DEFAULT_QUERY
from logvigil.functions.skew import balanced_join
from logvigil.functions.text import first_seen, strip
from logvigil.session import cut_lineage

INV = "investigation_id"
EMBEDDING_DIM = 256
_QUERY_CHUNK, _DOC_BLOCK, _STEP = 10_000, 20_000, 256
#: Queries that look into one block of cells in one place.
_CELL_QUERIES = 20_000
#: Vectors compared with all centres at a time.
_ROWS = 1024
#: Vectors that cells are fitted on, and cells there are, at most.
TRAINING, MOST_CELLS = 50_000, 4096
#: Queries whose exact hits tell how many cells to ask, and the share of hits these cells must hold.
CALIBRATION, RECALL = 128, 0.95
HITS_SCHEMA = "query_id string, collection string, id string, distance double"
_NO_HITS = pa.schema([*[(n, pa.string()) for n in ("query_id", "collection", "id")], ("distance", pa.float64())]).empty_table()


def hashed_embedding(df: DataFrame, text_col: str, dim: int = EMBEDDING_DIM,
                     out: str = "embedding") -> DataFrame:
    """K9 default: hashed term counts of unit length, all in the JVM.

    Any other model is a pandas_udf from text to array<float> put in its place.
    """
    words = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[^\p{L}\p{N}.]+")
    counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dim)
    unit = Normalizer(inputCol="_counts", outputCol="_unit")
    staged = df.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    for stage in (words, counts, unit):
        staged = stage.transform(staged)
    return staged.withColumn(out, vector_to_array("_unit", "float32")).drop(
        "_text", "_words", "_counts", "_unit"
    )


def query_text(top: Column, patterns: Column, popia: Column, cyber: Column) -> Column:
    """The terms of an investigation, first spelling first, joined by commas.

    ``top`` is the list of top events (ten at most), so the arrays stay short.
    """
    none = F.array().cast("array<string>")
    terms = lambda c: F.coalesce(c, none)
    per_event = F.flatten(F.transform(
        F.coalesce(top, F.array()),
        lambda t: F.concat(
            terms(t["threat_signals"]), terms(t["anomaly_reasons"]),
            F.array_compact(F.array(t["event_type"])),
        ),
    ))
    words = F.transform(F.concat(per_event, terms(patterns), terms(popia), terms(cyber)), strip)
    kept = first_seen(F.filter(words, lambda w: w.isNotNull() & (w != "")))
    return F.coalesce(F.nullif(F.array_join(kept, ", "), F.lit("")), F.lit(DEFAULT_QUERY))


def _distances(queries: np.ndarray, docs: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        size = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(docs, axis=1)[None, :]
        return 1.0 - queries @ docs.T / np.maximum(size, 1e-300)
    squares = (queries**2).sum(1)[:, None] + (docs**2).sum(1)[None, :] - 2.0 * queries @ docs.T
    squares = np.maximum(squares, 0.0)
    return squares if metric == "l2" else np.sqrt(squares)


def _matrix(table: pa.Table) -> np.ndarray:
    column = table.column("embedding").combine_chunks()
    return np.asarray(column.flatten(), dtype=float).reshape(len(column), -1)


def _block_hits(k: int, metric: str):
    """Nearest k documents of one block, per query and collection."""
    def run(queries: pa.Table, docs: pa.Table) -> pa.Table:
        found = {"query_id": [], "collection": [], "id": [], "distance": []}
        if queries.num_rows and docs.num_rows:
            names = np.asarray(docs.column("collection").to_pylist())
            ids = np.asarray(docs.column("id").to_pylist())
            asked = np.asarray(queries.column("query_id").to_pylist())
            q, d = _matrix(queries), _matrix(docs)
            # by id, so that a stable sort settles equal distances by id
            order = np.argsort(ids, kind="stable")
            for name in np.unique(names):
                rows = order[names[order] == name]
                keep = min(k, len(rows))
                for start in range(0, len(q), _STEP):
                    far = _distances(q[start:start + _STEP], d[rows], metric)
                    edge = np.partition(far, keep - 1, axis=1)[:, keep - 1:keep]
                    at, doc = np.nonzero(far <= edge)
                    best = np.lexsort((doc, far[at, doc], at))
                    at, doc = at[best], doc[best]
                    place = np.arange(len(at)) - np.searchsorted(at, at)
                    at, doc = at[place < keep], doc[place < keep]
                    found["query_id"].append(asked[start + at])
                    found["collection"].append(np.full(len(at), name))
                    found["id"].append(ids[rows[doc]])
                    found["distance"].append(far[at, doc])
        cat = lambda key: np.concatenate(found[key]) if found[key] else []
        return pa.table({
            "query_id": pa.array(cat("query_id"), pa.string()),
            "collection": pa.array(cat("collection"), pa.string()),
            "id": pa.array(cat("id"), pa.string()),
            "distance": pa.array(cat("distance"), pa.float64()),
        })

    return run


def nearest(queries: DataFrame, docs: DataFrame, k: int = 5, metric: str = "l2",
            query_chunks: int | None = None, doc_blocks: int | None = None) -> DataFrame:
    """The exact k nearest documents of each query in each collection.

    ``queries`` has query_id and embedding, ``docs`` collection, id and
    embedding.  Both sides are cut by hash into parts of bounded size; every
    (query chunk, document block) pair is one task that keeps k hits per query
    and collection, so neither side has to fit in one place and the pairs
    themselves are never rows.  ``query_chunks`` and ``doc_blocks`` follow the numbers
    of rows unless they are given; they do not change the result.  Documents whose vectors
    are longer or shorter than the queries' are never hits, so a collection from another
    model counts as unavailable.  ``metric``: l2 (squared), euclidean or cosine.
    """
    if isinstance(k, bool) or not isinstance(k, int):
        raise TypeError("k must be an integer")
    if not 1 <= k <= 10:
        raise ValueError("k must be between 1 and 10")
    # vectors of another length live in another space: nothing there is near
    asked = queries.where(F.col("embedding").isNotNull()).select(F.size("embedding").alias("dim")).first()
    same_length = F.size("embedding") == (asked.dim if asked else 0)
    queries, docs = queries.where(same_length), docs.where(same_length)
    spread = queries.sparkSession.sparkContext.defaultParallelism
    if query_chunks is None:
        rows = queries.count()
        query_chunks = max(math.ceil(rows / _QUERY_CHUNK), min(spread, math.ceil(rows / 64)), 1)
    doc_blocks = doc_blocks or max(math.ceil(docs.count() / _DOC_BLOCK), 1)
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = (
        queries.where(F.col("embedding").isNotNull())
        .select(F.col("query_id").cast("string").alias("query_id"), "embedding")
        .withColumn("chunk", part("query_id", query_chunks)).withColumn("block", every(doc_blocks))
    )
    right = (
        docs.where(F.col("embedding").isNotNull())
        .select(F.col("collection").cast("string").alias("collection"),
                F.col("id").cast("string").alias("id"), "embedding")
        .withColumn("block", part("id", doc_blocks)).withColumn("chunk", every(query_chunks))
    )
    hits = (
        left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block"))
        .applyInArrow(_block_hits(k, metric), HITS_SCHEMA)
    )
    # a query's hits are moved once, for this window and those over all its collections
    hits = hits.repartition("query_id")
    rank = Window.partitionBy("query_id", "collection").orderBy("distance", "id")
    return hits.withColumn("position", F.row_number().over(rank)).where(F.col("position") <= k)


def train_cells(docs: DataFrame, cells: int, sample: int = TRAINING, seed: int = 7) -> np.ndarray:
    """Centres of ``cells`` cells, by k-means over at most about ``sample`` vectors drawn by hash.

    The bound makes the fit, and the centres all tasks get, independent of the number of documents.
    """
    share = min(1.0, sample / max(docs.count(), 1))
    drawn = docs.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < math.ceil(share * (1 << 30)))
    vectors = drawn.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=cells, maxIter=10, seed=seed, initSteps=2).fit(vectors)
    return np.array(model.clusterCenters())


def _far(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of vectors to centres, less the square of each vector."""
    return (centres**2).sum(axis=1)[None, :] - 2.0 * vectors @ centres.T


def _in_cells(docs: DataFrame, centres: np.ndarray) -> DataFrame:
    """Documents (collection, id, embedding) with the cell they lie in."""
    schema = pa.schema([("collection", pa.string()), ("id", pa.string()), ("embedding", pa.list_(pa.float64())),
                        ("cell", pa.int32())])

    def place(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                rows = batch.slice(start, _ROWS)
                cell = _far(_matrix(pa.Table.from_batches([rows])), centres).argmin(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*[rows.column(c).cast(pa.string()) for c in (0, 1)],
                     rows.column(2).cast(pa.list_(pa.float64())), pa.array(cell)], schema=schema)

    return docs.select("collection", "id", "embedding").mapInArrow(
        place, "collection string, id string, embedding array<double>, cell int")


def _in_order(centres: np.ndarray) -> list[int]:
    """Cells so that near ones follow each other: halved along the widest axis again and again."""
    out, parts = [], [np.arange(len(centres))]
    while parts:
        part = parts.pop()
        if len(part) == 1:
            out.append(int(part[0]))
            continue
        axis = np.ptp(centres[part], axis=0).argmax()
        ordered = part[np.argsort(centres[part, axis], kind="stable")]
        parts += [ordered[len(part) // 2:], ordered[:len(part) // 2]]
    return out


def _cell_blocks(centres: np.ndarray, docs: dict[int, int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first block of each cell and the number of blocks it is cut into; cells without documents have none.

    Cells that follow each other share a block of about ``size`` documents.
    """
    first, parts = np.zeros(len(centres), np.int32), np.zeros(len(centres), np.int32)
    block, held = 0, 0
    for cell in _in_order(centres):
        rows = docs.get(cell, 0)
        if not rows:
            continue
        if held and held + rows > size:
            block, held = block + 1, 0
        first[cell], parts[cell] = block, math.ceil(rows / size)
        block, held = block + int(parts[cell]) - 1, held + rows
    return first, parts


def _asked_blocks(queries: DataFrame, centres: np.ndarray, near: dict[str, np.ndarray], probes: int,
                  first: np.ndarray, parts: np.ndarray) -> DataFrame:
    """(query_id, embedding, bounds, block): each query once a block that holds a cell it asks.

    ``bounds`` says for each collection how far the last of the ``probes`` nearest cells is that it fills.
    """
    schema = pa.schema([("query_id", pa.string()), ("embedding", pa.list_(pa.float64())),
                        ("bounds", pa.list_(pa.float64())), ("block", pa.int32())])
    of_block = [np.flatnonzero((first <= b) & (b < first + parts)) for b in range(int((first + parts).max(initial=0)))]

    def ask(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                rows = batch.slice(start, _ROWS)
                far = _far(_matrix(pa.Table.from_batches([rows])), centres)
                asked, bounds = np.zeros(far.shape, bool), np.empty((rows.num_rows, len(near)))
                for i, filled in enumerate(near.values()):
                    some, there = min(probes, len(filled)), far[:, filled]
                    last = np.partition(there, some - 1, axis=1)[:, some - 1]
                    # the same distance may come out a little larger where it is computed again
                    bounds[:, i] = last + 1e-9 * (1.0 + np.abs(last))
                    asked[:, filled] |= there <= bounds[:, i, None]
                fixed = [rows.column(0).cast(pa.string()), rows.column(1).cast(pa.list_(pa.float64())),
                         pa.array(list(bounds), pa.list_(pa.float64()))]
                for block, cells in enumerate(of_block):
                    at = pa.array(np.flatnonzero(asked[:, cells].any(axis=1)))
                    if len(at):
                        yield pa.RecordBatch.from_arrays(
                            [*[c.take(at) for c in fixed], pa.array(np.full(len(at), block, np.int32))], schema=schema)

    return queries.select("query_id", "embedding").mapInArrow(
        ask, "query_id string, embedding array<double>, bounds array<double>, block int")


def _cell_hits(k: int, metric: str, centres: np.ndarray, names: list[str]):
    """Nearest k documents in the cells of one block a query asks, per query and collection."""
    def run(queries: pa.Table, docs: pa.Table) -> pa.Table:
        out: list[pa.Table] = []
        if queries.num_rows and docs.num_rows:
            order = np.argsort(np.asarray(docs.column("id").to_pylist()), kind="stable")
            docs = docs.take(pa.array(order))
            ids, cells = docs.column("id"), docs.column("cell").to_numpy()
            inside = np.asarray(docs.column("collection").to_pylist())
            q, d = _matrix(queries), _matrix(docs)
            bounds = np.asarray(queries.column("bounds").combine_chunks().flatten(), float).reshape(len(q), -1)
            here = np.unique(cells)
            far_cells = _far(q, centres[here])
            for place, name in enumerate(names):
                mine = np.flatnonzero(inside == name)
                closest, found = np.full(len(q), np.inf), [[], [], []]
                for column, cell in enumerate(here) if len(mine) else ():
                    rows = mine[cells[mine] == cell]
                    asks = np.flatnonzero(far_cells[:, column] <= bounds[:, place])
                    keep = min(k, len(rows))
                    if not keep:
                        continue
                    step = max(_STEP, _STEP * _DOC_BLOCK // len(rows))
                    for start in range(0, len(asks), step):
                        part = asks[start:start + step]
                        far = _distances(q[part], d[rows], metric)
                        edge = np.partition(far, keep - 1, axis=1)[:, keep - 1]
                        at, doc = np.nonzero(far <= np.minimum(edge, closest[part])[:, None])
                        if keep == k:
                            closest[part] = np.minimum(closest[part], edge)
                        for column_, values in zip(found, (part[at], rows[doc], far[at, doc]), strict=True):
                            column_.append(values)
                if not found[0]:
                    continue
                at, doc, far = (np.concatenate(x) for x in found)
                best = np.lexsort((doc, far, at))
                at, doc, far = at[best], doc[best], far[best]
                kept = np.arange(len(at)) - np.searchsorted(at, at) < k
                at, doc = pa.array(at[kept]), pa.array(doc[kept])
                out.append(pa.table({
                    "query_id": queries.column("query_id").take(at), "collection": pa.array([name] * len(at), pa.string()),
                    "id": ids.take(doc), "distance": pa.array(far[kept])}))
        return pa.concat_tables(out) if out else _NO_HITS

    return run


def _probes_needed(queries: DataFrame, docs: DataFrame, placed: DataFrame, centres: np.ndarray,
                   near: dict[str, np.ndarray], k: int, metric: str) -> int:
    """Cells to ask so that ``RECALL`` of the exact hits of a bounded sample of queries lie in them."""
    some = queries.where(F.col("embedding").isNotNull()).orderBy(F.xxhash64("query_id"), "query_id").limit(CALIBRATION)
    vectors = {r.query_id: np.array(r.embedding, float) for r in some.collect()}
    hits = nearest(some, docs, k, metric, query_chunks=1).select("query_id", "collection", "id")
    ranks = []
    for hit in hits.join(placed.select("collection", "id", "cell"), ["collection", "id"]).collect():
        far = ((centres - vectors[hit.query_id]) ** 2).sum(axis=1)
        ranks.append(int((far[near[hit.collection]] < far[hit.cell]).sum()))
    return 1 + math.ceil(np.quantile(ranks, RECALL)) if ranks else 1


def nearest_in_cells(queries: DataFrame, docs: DataFrame, k: int = 5, metric: str = "l2", cells: int | None = None,
                     probes: int | None = None) -> DataFrame:
    """K11 for large x large: the nearest documents among the cells near each query, by an index.

    Documents lie in the cell of their nearest centre; a query looks into the ``probes``
    nearest cells that its collection fills, and there compares exactly.  By default there are about
    as many cells as documents in a cell, and as many are asked as ``RECALL`` of the exact hits of
    ``CALIBRATION`` queries need: few where vectors cluster, most where they do not.  Neighbouring cells
    lie in blocks of bounded size.  A query moves once a block in which it asks a cell, however many it asks
    there, and a document once a chunk of the queries its block gets.  Same columns as ``nearest``; what it returns is
    exact in distance and order, but a hit in a cell not asked is missed.
    """
    size = docs.where(F.col("embedding").isNotNull()).agg(
        F.count(F.lit(1)).alias("rows"), F.first(F.size("embedding")).alias("dim")).first()
    same_length = F.size("embedding") == (size.dim or 0)
    docs = docs.where(same_length).withColumns({c: F.col(c).cast("string") for c in ("collection", "id")})
    queries = queries.where(same_length).withColumn("query_id", F.col("query_id").cast("string"))
    if not size.rows:
        return nearest(queries, docs, k, metric)
    cells = cells or max(1, min(MOST_CELLS, math.isqrt(size.rows)))
    centres = train_cells(docs, cells)
    placed = cut_lineage(_in_cells(docs, centres).where("collection is not null"))
    filled: dict[str, list[int]] = {}
    rows_of: dict[int, int] = {}
    for row in placed.groupBy("collection", "cell").agg(F.count(F.lit(1)).alias("docs")).toLocalIterator():
        filled.setdefault(row.collection, []).append(row.cell)
        rows_of[row.cell] = rows_of.get(row.cell, 0) + row.docs
    near = {name: np.array(sorted(c)) for name, c in sorted(filled.items())}
    probes = probes or _probes_needed(queries, docs, placed, centres, near, k, metric)
    # small tables are cut finer, so that every core has a block
    spread = queries.sparkSession.sparkContext.defaultParallelism
    first, parts = _cell_blocks(centres, rows_of, max(1, min(_DOC_BLOCK, math.ceil(size.rows / spread))))
    asked = cut_lineage(_asked_blocks(queries, centres, near, probes, first, parts))
    chunks = F.broadcast(cut_lineage(asked.groupBy("block").agg(
        F.ceil(F.count(F.lit(1)) / _CELL_QUERIES).cast("int").alias("chunks"))))
    part = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    start, pieces = (F.element_at(F.lit(x.tolist()), F.col("cell") + 1) for x in (first, parts))
    left = asked.join(chunks, "block").withColumn("chunk", part("query_id", F.col("chunks"))).drop("chunks")
    right = placed.withColumn("block", start + part("id", pieces)).join(chunks, "block").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    key = ["block", "chunk"]
    hits = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(
        _cell_hits(k, metric, centres, list(near)), HITS_SCHEMA)
    rank = Window.partitionBy("query_id", "collection").orderBy("distance", "id")
    return hits.withColumn("position", F.row_number().over(rank)).where(F.col("position") <= k)


def relevance(distance: Column) -> Column:
    """1 - distance without clamping; a missing distance counts as 1."""
    return F.lit(1.0) - F.coalesce(F.nanvl(distance, F.lit(1.0)), F.lit(1.0))


def collection_label(name: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in COLLECTIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, name), name)


def retrieved_context(hits: DataFrame) -> DataFrame:
    """Hits of all collections in one order, with their place in it.

    A query has at most k hits per collection, so the window stays small.
    """
    scored = hits.withColumns({
        "source": collection_label(F.col("collection")),
        "relevance_score": relevance(F.col("distance")),
    })
    order = Window.partitionBy("query_id").orderBy(F.desc("relevance_score"), "source", "id")
    return scored.withColumn("position", F.row_number().over(order))


def retrieval_result(queries: DataFrame, context: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per query with its context, collections and availability.

    ``queries`` has query_id and query_used.  The hits of a query are few.
    """
    texts = docs.select(
        "collection", F.col("id").cast("string").alias("id"),
        F.coalesce("document", F.lit("")).alias("content"), "metadata",
    )
    item = F.struct("position", "source", "id", "content", "relevance_score", "metadata")
    uses = context.groupBy("collection", "id").agg(F.count(F.lit(1)).alias("_uses"))
    found = (
        balanced_join(context, texts, ["collection", "id"], weights=uses, weight="_uses",
                      row_id=["query_id"], how="inner")
        .groupBy("query_id")
        .agg(
            F.collect_list(item).alias("_items"),
            F.array_sort(F.collect_set("collection")).alias("collections_queried"),
        )
        .withColumn("retrieved_context", F.array_sort(
            "_items",
            lambda a, b: a["position"] - b["position"],
        ))
        .drop("_items")
    )
    empty = F.array().cast("array<string>")
    return (
        queries.select(F.col("query_id").cast("string").alias("query_id"), "query_used")
        .join(found, "query_id", "left")
        .withColumns({
            "collections_queried": F.coalesce("collections_queried", empty),
            "total_retrieved": F.coalesce(F.size("retrieved_context"), F.lit(0)),
        })
        .withColumn("total_retrieved", F.greatest("total_retrieved", F.lit(0)))
        .withColumn("rag_available", F.col("total_retrieved") > 0)
    )
