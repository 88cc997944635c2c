"""Token counts: pieces are counted once per distinct pre-token.

The corpus is read twice.  The first pass adds up how often each pre-token
occurs; its pieces are then counted once per distinct pre-token, in a table.
The second pass takes each document's pre-token frequencies to that table: the
most frequent pre-tokens (at most ``hot``, each of at most ``HOT_BYTES`` bytes,
so a few tens of MB however large the corpus) reach the workers as a broadcast,
the others as a shuffled join.  No ids are made.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from logvigil.llm.stages import Stages, batches_of, emit
from logvigil.llm.wordpieces import word_pieces

HOT = 1 << 18
HOT_BYTES = 64
#: Distinct chunks gathered in a task before their pre-tokens are sent on.
HELD = 300_000


def pre_token_frequencies(docs: DataFrame, path: str) -> DataFrame:
    """(pre_token, freq): one row per distinct pre-token of all texts."""
    schema = pa.schema([("pre_token", pa.string()), ("freq", pa.int64())])

    def spread(chunks: Counter) -> Iterator[tuple]:
        pieces, found = word_pieces(path), Counter()
        for chunk, n in chunks.items():
            for part in pieces.pre_tokens(chunk):
                found[part] += n
        return iter(found.items())

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, chunks = word_pieces(path), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    chunks.update(pieces.sections(text)[0])
            if len(chunks) >= HELD:
                yield from emit(spread(chunks), schema)
                chunks.clear()
        yield from emit(spread(chunks), schema)

    found = docs.select("text").mapInArrow(gather, "pre_token string, freq long")
    return found.groupBy("pre_token").agg(F.sum("freq").alias("freq"))


def with_pieces(vocabulary: DataFrame, path: str) -> DataFrame:
    """Add ``pieces``, the number of tokens of each pre-token."""
    schema = pa.schema([("pre_token", pa.string()), ("freq", pa.int64()), ("pieces", pa.int32())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = word_pieces(path)
        for batch in batches:
            sizes = [pieces.count(p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.string()), batch.column(1), pa.array(sizes, pa.int32())],
                schema=schema,
            )

    return vocabulary.select("pre_token", "freq").mapInArrow(
        count, "pre_token string, freq long, pieces int"
    )


def token_counts(docs: DataFrame, path: str, limit: int = 2048, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): one row per row of ``docs``.

    Null and empty texts count no bytes and no tokens; over_limit is n_tokens >
    ``limit``.  Rows that repeat a doc_id, or have none, are counted each on
    their own.  Only doc_id and text are read, so other columns cannot clash.
    """
    spark = docs.sparkSession
    stages = Stages(spark)
    vocabulary = stages.keep(with_pieces(pre_token_frequencies(docs, path), path), "pre-tokens")
    frequent = (
        vocabulary.where(F.octet_length("pre_token") <= HOT_BYTES)
        .orderBy(F.desc("freq"), "pre_token").limit(hot).select("pre_token", "pieces").toArrow()
    )
    table = spark.sparkContext.broadcast(
        dict(zip(*(c.to_pylist() for c in frequent.columns), strict=True)))

    fields = [
        ("doc_id", pa.int64()), ("key", pa.int64()), ("n_bytes", pa.int64()), ("known", pa.int64()),
        ("rare", pa.list_(pa.struct([("pre_token", pa.string()), ("n", pa.int32())]))),
    ]
    schema = pa.schema(fields)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, sizes, known_of = word_pieces(path), table.value, {}

        def size(chunk: str) -> int:
            """Tokens of a chunk, or -1 when some pre-token is not in the broadcast table."""
            parts = [sizes.get(p) for p in pieces.pre_tokens(chunk)]
            found = -1 if None in parts else sum(parts)
            if len(known_of) < pieces.held:
                known_of[chunk] = found
            return found

        for batch in batches:
            rows: dict[str, list] = {name: [] for name, _ in fields}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (text or "").encode()
                chunks, specials = pieces.sections(text or "")
                get = known_of.get
                counted = [n if (n := get(c)) is not None else size(c) for c in chunks]
                known, rare = sum(counted) + len(specials), Counter()
                for chunk, n in zip(chunks, counted, strict=True) if -1 in counted else ():
                    if n < 0:
                        known += 1
                        for part in pieces.pre_tokens(chunk):
                            if part in sizes:
                                known += sizes[part]
                            else:
                                rare[part] += 1
                rows["doc_id"].append(doc_id)
                rows["key"].append(xxhash.xxh3_64_intdigest(data) - (1 << 63))
                rows["n_bytes"].append(len(data))
                rows["known"].append(known)
                rows["rare"].append([{"pre_token": p, "n": n} for p, n in rare.items()])
            yield batches_of(rows, schema)

    parts = stages.keep(
        docs.select("doc_id", "text").mapInArrow(
            measure, "doc_id long, key long, n_bytes long, known long, "
                     "rare array<struct<pre_token:string,n:int>>"), "counted")
    rare = (
        parts.select("doc_id", "key", "n_bytes", F.explode("rare").alias("r"))
        .select("doc_id", "key", "n_bytes", "r.*")
        .join(vocabulary.select("pre_token", "pieces"), "pre_token")
        .select("doc_id", "key", "n_bytes", (F.col("n") * F.col("pieces")).cast("long").alias("n"),
                F.lit(0).alias("rows"))
    )
    # equal rows share a key: their sum is divided by their number, and each row is given back
    whole = parts.select("doc_id", "key", "n_bytes", F.col("known").alias("n"), F.lit(1).alias("rows"))
    per_text = whole.unionByName(rare).groupBy("doc_id", "key", "n_bytes").agg(
        F.sum("n").alias("n"), F.sum("rows").cast("int").alias("rows")
    )
    return per_text.select(
        "doc_id", "n_bytes", F.expr("n div rows").alias("n_tokens"),
        F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("_copy"),
    ).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
