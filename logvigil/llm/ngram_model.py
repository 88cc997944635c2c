"""Language-model scores from a log-frequency Bloom filter.

Unigram and bigram counts of the training texts are quantised: a count n gets the
level 1 + floor(log_base(n / least)).  The filter holds (n-gram, level) for every
level up to its own, so a count is read back by probing level after level until
a probe misses.  Each n-gram keeps all its bits in one block of 512, chosen by
its hash; blocks are built in segments, each in one task, and the whole filter
is broadcast.

The filter has at most ``max_bits`` bits however large the corpus is.  It holds no bigrams
seen once; where the entries do not fit at ``LEAST_BITS`` bits each, the least count of
bigrams doubles until they do, and then that of unigrams.  The model mixes the two orders,
    P(w | h) = weight * count(h w) / count(h) + (1 - weight) * (count(w) + 1) / (N + V + 1),
with counts from the filter; after a word never seen, P is the second part.  A bigram the filter does
not hold gets its exact count by a shuffled join: places and counts travel as packed runs by
segments of the bigrams' hashes, a share of the segments at a time, so that the shuffle files of one
share go before the next.  Where unigrams are left out too, the few places with such a word get the
word's exact count by a join of rows first, and are packed then.  While the least count of bigrams is 2, only held out
texts need it: a bigram of a training text that is not in the filter was seen once, there.

The base score uses exact counts.  The most frequent tokens (bounded in number and
length) reach the workers as a broadcast, all others by a shuffled join.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from logvigil.llm.stages import Stages, emit, short_lived_shuffles
from logvigil.llm.words import mixed

#: The end of a text, which no word can equal.
END = b"\n"
HOT = 1 << 18
HOT_BYTES = 64
HELD = 200_000
GRAMS_HELD = 1_000_000
#: Places a task holds before it packs them: the more, the more of them share a pair.
PLACES_HELD = 2_000_000
#: Places of one segment that are looked up in one task.
PLACES = 2_000_000
SEGMENTS = 256
#: Shares of the segments that are looked up one after the other, and training tokens that make up one of them.
ROUNDS, ROUND_TOKENS = 8, 1 << 23
#: Texts whose scores are added up together: two to this power.
TEXT_BITS = 13
MAX_BITS = 1 << 28
BITS, LEAST_BITS, PROBES = 16, 10, 5
BASE = math.sqrt(2)
TOP_LEVEL = 120
LEAST_BIGRAM = 2
WEIGHT = 0.3


def _tokens_of(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct tokens of the texts, END first; END, words, END, words, ... END as places
    among them; and the number of tokens of each text.
    """
    texts = pc.fill_null(batch.column(batch.schema.get_field_index("text")), "")
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    # white space around a text leaves an empty word at its ends
    held = pc.greater(pc.binary_length(words.values), 0)
    before = np.concatenate([[0], np.cumsum(held.to_numpy(zero_copy_only=False))])
    sizes = np.diff(before[words.offsets.to_numpy()]) + 1
    coded = words.values.filter(held).dictionary_encode()
    codes = np.zeros(int(sizes.sum()) + 1, np.int64)
    word = np.ones(len(codes), bool)
    word[np.concatenate([[0], np.cumsum(sizes)])] = False
    codes[word] = coded.indices.to_numpy() + 1
    return pa.concat_arrays([pa.array([END], pa.binary()), coded.dictionary.cast(pa.binary())]), codes, sizes


def _hashed(tokens: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens.to_pylist()), np.uint64, len(tokens))


def _bigrams(hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return mixed(mixed(hashes)[codes[:-1]] + hashes[codes[1:]])


def _unigrams(hashes: np.ndarray) -> np.ndarray:
    return mixed(hashes ^ np.uint64(0x5851F42D4C957F2D))


def token_frequencies(docs: DataFrame) -> DataFrame:
    """(token, n) over all texts, the ends included."""
    schema = pa.schema([("token", pa.binary()), ("n", pa.int64())])

    def added(found: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        if found:
            summed = pa.concat_tables(found).group_by("token").aggregate([("n", "sum")])
            yield from summed.select(["token", "n_sum"]).rename_columns(schema.names).to_batches(max_chunksize=20_000)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, codes, _ = _tokens_of(batch)
            counts = np.bincount(codes[1:], minlength=len(tokens))
            found.append(pa.Table.from_arrays([tokens, pa.array(counts, pa.int64())], schema=schema))
            held += len(tokens)
            if held >= HELD:
                yield from added(found)
                found, held = [], 0
        yield from added(found)

    return docs.select("text").mapInArrow(gather, "token binary, n long").groupBy("token").agg(
        F.sum("n").alias("n"))


def _summed(grams: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(grams, return_counts=True)
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[first], np.add.reduceat(counts, first)


def _squeezed(x: bytes) -> bytes:
    return len(x).to_bytes(8, "little") + pa.compress(x, codec="zstd", asbytes=True)


def _unsqueezed(x: bytes) -> bytes:
    return pa.decompress(x[8:], int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True)


def _planes(*columns: np.ndarray) -> bytes:
    """Numbers in a few bytes: all their first bytes, all their second bytes, and so on."""
    return _squeezed(b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes() for x in columns))


def _from_planes(x: bytes, kind: type, columns: int = 1) -> np.ndarray:
    """The numbers; one row for each of the columns where there are several."""
    size = np.dtype(kind).itemsize
    found = np.frombuffer(_unsqueezed(x), np.uint8).reshape(columns, size, -1).transpose(0, 2, 1)
    found = np.ascontiguousarray(found).view(kind).reshape(columns, -1)
    return found[0] if columns == 1 else found


def _steps(grams: np.ndarray) -> bytes:
    return _planes(np.diff(grams, prepend=np.uint64(0)))


def _from_steps(x: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(x, np.uint64), dtype=np.uint64)


def _runs(grams: np.ndarray, segments: int) -> Iterator[tuple[int, int, int]]:
    """(segment, start, end) of the segments in sorted hashes; ``segments`` is a power of two, 2 or more."""
    owner = grams >> np.uint64(64 - (segments - 1).bit_length())
    edges = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]])).tolist()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(owner[a]), a, b


#: Bigrams or unigrams of one segment in the order of their hashes, and their counts.
_COUNTS = pa.schema([("segment", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())])
_COUNTS_SQL = "segment long, grams binary, counts binary"


def _packed_counts(grams: np.ndarray, counts: np.ndarray, segments: int) -> Iterator[tuple]:
    for segment, a, b in _runs(grams, segments) if len(grams) else ():
        yield segment, _steps(grams[a:b]), _planes(counts[a:b].astype(np.uint64))


def _unpacked_counts(runs: pa.Table | pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for grams, counts in zip(runs.column("grams").to_pylist(), runs.column("counts").to_pylist(), strict=True):
        yield _from_steps(grams), _from_planes(counts, np.uint64).astype(np.int64)


def bigram_frequencies(docs: DataFrame, segments: int) -> DataFrame:
    """(segment, grams, counts): hashed bigrams, one row a segment.

    Tasks send packed runs of (hash, count), one row per segment of the hashes;
    a segment is added up in one task.  ``segments`` follows the corpus, so a
    segment stays small.
    """
    def pack(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if sum(map(len, parts)):
            yield from emit(_packed_counts(*_summed(np.concatenate(parts), None), segments), _COUNTS, 64)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, codes, _ = _tokens_of(batch)
            parts.append(_bigrams(_hashed(tokens), codes))
            held += len(parts[-1])
            if held >= GRAMS_HELD:
                yield from pack(parts)
                parts, held = [], 0
        yield from pack(parts)

    def add(table: pa.Table) -> pa.Table:
        found = _summed(*(np.concatenate(x) for x in zip(*_unpacked_counts(table), strict=True)))
        rows = zip(*_packed_counts(*found, segments), strict=True)
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(rows, _COUNTS, strict=True)], schema=_COUNTS)

    sent = docs.select("text").mapInArrow(gather, _COUNTS_SQL)
    return sent.groupBy("segment").applyInArrow(add, _COUNTS_SQL)


def _hashed_unigrams(tokens: DataFrame) -> DataFrame:
    schema = pa.schema([("gram", pa.int64()), ("n", pa.int64())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _unigrams(_hashed(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), batch.column(1)], schema=schema)

    return tokens.select("token", "n").mapInArrow(hashed, "gram long, n long")


def _packed_rows(rows: DataFrame, grams_of: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """(segment, grams, counts) of rows (n-gram, n), several rows a segment."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            grams, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(grams)
            yield from emit(_packed_counts(grams[order], counts[order], SEGMENTS), _COUNTS, 64)

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append((grams_of(batch.column(0)), batch.column(1).to_numpy()))
            if sum(len(x) for x, _ in held) >= GRAMS_HELD:
                yield from packed(held)
                held = []
        if held:
            yield from packed(held)

    return rows.mapInArrow(pack, _COUNTS_SQL)


def _packed_unigrams(tokens: DataFrame) -> DataFrame:
    return _packed_rows(tokens.select("token", "n"), lambda x: _unigrams(_hashed(x)))


@dataclass
class Filter:
    """``words`` are the bits, 8 words to a block; ``least`` is the least count of each order."""

    words: np.ndarray
    least: tuple[int, int]

    @property
    def blocks(self) -> int:
        return len(self.words) // 8

    def _probe(self, grams: np.ndarray, level: int) -> np.ndarray:
        """Places of the n-grams whose bits of this level are all set."""
        base, spread = _spread(grams, level, self.blocks)
        held = np.arange(len(grams))
        for i in range(PROBES):
            place = spread[held] >> np.uint64(9 * i) & np.uint64(511)
            word = self.words[base[held] + (place >> np.uint64(6))]
            held = held[(word >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)]
        return held

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """The highest level each n-gram reaches without a miss; 0 if not even the first."""
        found, active = np.zeros(len(grams), np.int64), np.arange(len(grams))
        for level in range(1, TOP_LEVEL + 1):
            held = self._probe(grams, level)
            active, grams = active[held], grams[held]
            if not len(active):
                break
            found[active] = level
        return found

    def counts(self, grams: np.ndarray, order: int) -> np.ndarray:
        return self.counts_at(self.levels(grams), order)

    def counts_at(self, level: np.ndarray, order: int) -> np.ndarray:
        """Estimated counts: the middle of a level's range, 0 for level 0."""
        middle = (BASE ** (level - 1) + BASE ** level) / 2
        exact = np.where(level == 1, 1.0, middle)
        return np.where(level > 0, exact * self.least[order - 1], 0.0)


def _spread(grams: np.ndarray, level: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each n-gram's block, and nine bits for each of its places in it."""
    bits = np.uint64(max(0, (blocks - 1).bit_length()))
    base = (grams >> (np.uint64(64) - bits) if bits else np.zeros_like(grams)) * np.uint64(8)
    return base, mixed(grams + np.uint64(0x9E3779B97F4A7C15 * level % (1 << 64)))


def positions(grams: np.ndarray, level: int, blocks: int):
    """Words and bits of ``PROBES`` bits per n-gram and level, all within the n-gram's block."""
    mask = np.uint64(511)
    base, spread = _spread(grams, level, blocks)
    places = [(spread >> np.uint64(9 * i)) & mask for i in range(PROBES)]
    return [base + (p >> np.uint64(6)) for p in places], [p & np.uint64(63) for p in places]


def _levels_of(counts: np.ndarray, least: int) -> np.ndarray:
    return np.minimum(TOP_LEVEL, 1 + np.floor(np.log(counts / least) / math.log(BASE) + 1e-9)).astype(np.uint8)


def _powers(packed: DataFrame) -> dict[int, int]:
    """Number of n-grams by the power of two their count reaches."""
    schema = pa.schema([("power", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(64, np.int64)
        for batch in batches:
            for counts in batch.column(0).to_pylist():
                powers = np.floor(np.log2(_from_planes(counts, np.uint64)) + 1e-9).astype(np.int64)
                total += np.bincount(powers, minlength=64)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], schema=schema)

    found = packed.select("counts").mapInArrow(count, "power int, n long").groupBy("power").agg(F.sum("n").alias("n"))
    return {r.power: r.n for r in found.collect()}


def _least_counts(unigrams: dict[int, int], bigrams: dict[int, int], max_bits: int) -> tuple[tuple[int, int], int]:
    """Least counts that fit, and the number of entries they leave, from the n-grams by power of two."""
    summed = [(order, power, n) for order, powers in ((1, unigrams), (2, bigrams)) for power, n in powers.items()]
    per_power = round(math.log(2) / math.log(BASE))

    def entries(least: tuple[int, int]) -> int:
        low = [int(math.log2(x)) for x in least]
        return sum(n * per_power * (power - low[order - 1] + 1) for order, power, n in summed if power >= low[order - 1])

    least = [1, LEAST_BIGRAM]
    highest = max((power for _, power, _ in summed), default=0)
    for order in (2, 1):
        while entries(tuple(least)) * LEAST_BITS > max_bits and least[order - 1] <= 1 << highest:
            least[order - 1] *= 2
    return tuple(least), entries(tuple(least))


def build_filter(unigrams: DataFrame, bigrams: DataFrame, max_bits: int = MAX_BITS) -> Filter:
    """A filter over rows (gram, n) of both orders."""
    packed = [_packed_rows(x.select("gram", "n"), lambda x: x.to_numpy().view(np.uint64)) for x in (unigrams, bigrams)]
    return _built(*packed, max_bits)


def _built(unigrams: DataFrame, bigrams: DataFrame, max_bits: int) -> Filter:
    least, entries = _least_counts(_powers(unigrams), _powers(bigrams), max_bits)
    wanted = max(SEGMENTS * 512, min(entries * BITS, max_bits))
    blocks = 1 << min((wanted // 512 - 1).bit_length(), max_bits.bit_length() - 10)
    per_segment = blocks // SEGMENTS
    entry = pa.schema([("segment", pa.int32()), ("grams", pa.binary()), ("levels", pa.binary())])
    schema = pa.schema([("segment", pa.int32()), ("bits", pa.binary())])

    def entries_of(packed: DataFrame, bound: int) -> DataFrame:
        def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
                for grams, counts in _unpacked_counts(batch):
                    grams, counts = grams[counts >= bound], counts[counts >= bound]
                    for segment, a, b in _runs(grams, SEGMENTS) if len(grams) else ():
                        yield segment, grams[a:b].tobytes(), _levels_of(counts[a:b], bound).tobytes()

            for batch in batches:
                yield from emit(rows(batch), entry, 64)

        return packed.select("grams", "counts").mapInArrow(held, "segment int, grams binary, levels binary")

    def build(table: pa.Table) -> pa.Table:
        grams = np.frombuffer(b"".join(table.column("grams").to_pylist()), np.uint64)
        levels = np.frombuffer(b"".join(table.column("levels").to_pylist()), np.uint8)
        segment = table.column("segment")[0].as_py()
        words = np.zeros(per_segment * 8, np.uint64)
        first = np.uint64(segment * per_segment * 8)
        for level in range(1, int(levels.max()) + 1):
            for word, bit in zip(*positions(grams[levels >= level], level, blocks), strict=True):
                np.bitwise_or.at(words, (word - first).astype(np.int64), np.uint64(1) << bit)
        return pa.Table.from_arrays(
            [pa.array([segment], pa.int32()), pa.array([words.tobytes()], pa.binary())], schema=schema)

    rows = entries_of(unigrams, least[0]).unionByName(entries_of(bigrams, least[1]))
    words = np.zeros(blocks * 8, np.uint64)
    built = rows.groupBy("segment").applyInArrow(build, "segment int, bits binary").toArrow()
    for segment, bits in zip(built.column(0).to_pylist(), built.column(1), strict=True):
        at = segment * per_segment * 8
        words[at:at + per_segment * 8] = np.frombuffer(bits.as_buffer(), np.uint64)
    return Filter(words, least)


def held_out(fold: int = 2, folds: int = 7):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def score_texts(docs: DataFrame, max_bits: int = MAX_BITS, weight: float = WEIGHT, hot: int = HOT) -> DataFrame:
    """Base and model score of every text: one row per row of ``docs``.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    The model learns from the rows that are not held out (rows without doc_id
    among them).  A null or empty text is one end token.  With nothing to learn
    from, every probability is that of an empty model, 1.  Rows that repeat a
    doc_id are scored each on their own text.  Columns other than doc_id and
    text are not read.
    """
    with short_lived_shuffles(docs.sparkSession):
        return _scored(docs, max_bits, weight, hot)


def _scored(docs: DataFrame, max_bits: int, weight: float, hot: int) -> DataFrame:
    spark = docs.sparkSession
    stages = Stages(spark, "round")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))
    training = rows.where(~F.col("held_out"))
    tokens = stages.keep(token_frequencies(training), "tokens")
    total, distinct = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    segments = max(SEGMENTS, 1 << max(0, (total >> 19)).bit_length())
    rounds = min(ROUNDS, 1 + total // ROUND_TOKENS)
    share = (F.col("segment") % rounds).cast("int").alias("round")
    bigrams = stages.keep(bigram_frequencies(training, segments).withColumn("round", share), "bigrams")
    # stored, as each Python function of a stage has a worker of its own in every task
    unigrams = stages.keep(_packed_unigrams(tokens), "unigrams")
    model = _built(unigrams, bigrams, max_bits)
    stages.drop(unigrams)
    frequent = (
        tokens.where(F.octet_length("token") <= HOT_BYTES)
        .orderBy(F.desc("n"), "token").limit(hot).select("token", "n").toArrow()
    )
    whole = total + distinct + 1
    # the last one, positive, stands for all tokens that are not among them
    logs = np.append(np.log10((frequent.column(1).to_numpy() + 1) / whole), 1.0)
    sent = spark.sparkContext.broadcast((model, frequent.column(0).combine_chunks().cast(pa.binary()), logs))

    by_rows = model.least[0] > 1
    fields = pa.schema([
        ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
        ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()),
        ("rare", pa.list_(pa.struct([("token", pa.binary()), ("n", pa.int32())]))),
        ("asked", pa.list_(pa.struct([
            *[(n, pa.int64()) for n in ("pair", "before", "word")], ("n_before", pa.int32()), ("n_word", pa.int32())]))),
        *_PACKED,
    ])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_, known, logs = sent.value
        row = first = TaskContext.get().partitionId() << 36
        parts: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            tokens, codes, sizes = _tokens_of(batch)
            ends = np.cumsum(sizes)
            starts = ends - sizes
            owner = np.repeat(np.arange(n), sizes)
            at = pc.fill_null(pc.index_in(tokens, value_set=known), -1).to_numpy()
            base = logs[at][codes[1:]]
            unknown = base > 0
            base[unknown] = 0.0
            learned = ~batch.column(2).to_numpy(zero_copy_only=False)[owner]
            scores, places, pairs, levels = _log_probabilities(filter_, _hashed(tokens), codes, learned, whole, weight)
            lone = np.flatnonzero((levels == 0).any(axis=0)) if by_rows else np.empty(0, np.int64)
            edges = np.searchsorted(places[lone], np.append(starts, ends[-1]))
            asked = _asked(tokens, codes, places[lone], pairs[lone], levels[:, lone])
            if len(lone):
                rest = np.ones(len(places), bool)
                rest[lone] = False
                places, pairs, levels = places[rest], pairs[rest], levels[:, rest]
            parts.append(((owner[places] + (row - first)).astype(np.uint32), pairs, *levels))
            yield pa.RecordBatch.from_arrays([
                pa.array(row + np.arange(n)), batch.column(0), pa.array(sizes),
                pa.array(sizes - np.add.reduceat(unknown, starts, dtype=np.int64)),
                pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(scores, starts)),
                _counted_tokens(tokens, codes[1:], owner, unknown, n), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), asked),
                batch.column(2), *[pa.nulls(n, f.type) for f in _PACKED],
            ], names=[
                "row", "doc_id", "n_tokens", "n_known", "base", "score", "rare", "asked", "held_out", *[f.name for f in _PACKED],
            ]).select(fields.names)
            row += n
            if sum(len(x[0]) for x in parts) >= PLACES_HELD:
                yield from _packed_places(parts, first, segments, fields)
                parts, first = [], row
        yield from _packed_places(parts, first, segments, fields)

    parts = stages.keep(rows.select("doc_id", "text", "held_out").mapInArrow(
        score, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, "
               "score double, rare array<struct<token:binary,n:int>>, asked array<struct<pair:long,before:long,"
               f"word:long,n_before:int,n_word:int>>, {_PACKED_SQL}").withColumn("round", share), "scored")
    sent.unpersist()
    texts, none = parts.where("round is null"), F.lit(0).cast("long")
    rare = (
        texts.select("row", F.explode("rare").alias("r")).select("row", "r.token", F.col("r.n").alias("times"))
        .join(tokens, "token", "left")
        .select(
            "row", none.alias("n_tokens"),
            F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0).cast("long").alias("n_known"),
            (F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(whole)))).alias("base"),
            F.lit(0.0).alias("score"))
    )
    places = parts.where("round is not null").select("round", *[f.name for f in _PACKED])
    values = model.counts_at(np.arange(TOP_LEVEL + 1), 1)
    if by_rows:
        asked = texts.select("row", F.explode("asked").alias("a")).select("row", "a.*")
        low = stages.keep(_hashed_unigrams(tokens.where(F.col("n") < model.least[0])), "low")

    def sums_of(i: int) -> DataFrame:
        """One share of the segments; all is stored, so that its shuffle files go before the next."""
        here, held = places.where(F.col("round") == i).drop("round"), []
        if by_rows:
            segment = F.shiftrightunsigned("pair", 64 - (segments - 1).bit_length())
            held = [stages.keep(_packed_asked(_counted(asked.where(segment % rounds == i), low), segments), "asked")]
            here = here.unionByName(*held)
        found = stages.keep(_looked_up(here, bigrams.where(F.col("round") == i), values, whole, weight), "sums")
        stages.drop(*held)
        return found

    sums = [sums_of(i) for i in range(rounds)]
    stages.drop(bigrams)
    left = functools.reduce(DataFrame.unionByName, sums).groupBy("chunk").applyInArrow(
        lambda x: pa.table(dict(zip(("row", "score"), _added(x), strict=True))), "row long, score double").select(
        "row", none.alias("n_tokens"), none.alias("n_known"), F.lit(0.0).alias("base"), "score")
    more = rare.unionByName(left).select(
        "row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"),
        "n_tokens", "n_known", "base", "score")
    per_text = texts.select(*more.columns).unionByName(more).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"),
        *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")])
    return per_text.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), "score")


#: Places of one segment in the texts from row ``first`` on: its pairs as steps, of each pair its number of
#: places and the levels of its words (behind ``TOP_LEVEL`` exact counts), and the texts the places lie in.
_PACKED = [
    pa.field("segment", pa.int64()), pa.field("first", pa.int64()), pa.field("places", pa.int32()),
    pa.field("owners", pa.binary()), pa.field("pairs", pa.binary()), pa.field("levels", pa.binary()),
]
_PACKED_SQL = "segment long, first long, places int, owners binary, pairs binary, levels binary"


def _counted_tokens(tokens: pa.Array, codes: np.ndarray, owner: np.ndarray, chosen: np.ndarray, texts: int) -> pa.ListArray:
    """Of every text, its distinct tokens at the chosen places, each with its number of these places."""
    held, counts = np.unique(owner[chosen] * len(tokens) + codes[chosen], return_counts=True)
    edges = np.searchsorted(held, np.arange(texts + 1) * len(tokens))
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays(
        [tokens.take(pa.array(held % len(tokens))), pa.array(counts, pa.int32())], ["token", "n"]))


def _asked(tokens: pa.Array, codes: np.ndarray, places: np.ndarray, pairs: np.ndarray, levels: np.ndarray) -> pa.StructArray:
    """Places next to words the filter does not hold, with these words' hashes; null for words it holds."""
    sides = []
    for side in (0, 1):
        words = codes[places + side]
        distinct, at = np.unique(words, return_inverse=True)
        grams = _unigrams(_hashed(tokens.take(pa.array(distinct)))).view(np.int64)[at]
        sides.append(pa.array(grams, mask=levels[side] > 0))
    return pa.StructArray.from_arrays(
        [pa.array(pairs.view(np.int64)), *sides, *(pa.array(x, pa.int32()) for x in levels)],
        ["pair", "before", "word", "n_before", "n_word"])


def _packed_run(owners: np.ndarray, pairs: np.ndarray, before: np.ndarray, word: np.ndarray, first: int,
                segments: int) -> Iterator[tuple]:
    """Packed places, a row for each segment; ``owners`` count from ``first``."""
    order = np.argsort(pairs)
    owners, pairs, before, word = (x[order] for x in (owners, pairs, before, word))
    for segment, a, b in _runs(pairs, segments):
        # a pair has the same words wherever it stands
        start = a + np.flatnonzero(np.concatenate([[True], pairs[a + 1:b] != pairs[a:b - 1]]))
        times = np.diff(np.append(start, b))
        yield (segment, first, b - a, _planes(owners[a:b].astype(np.uint64)), _steps(pairs[start]),
               _planes(*(x.astype(np.uint32) for x in (times, before[start], word[start]))))


def _packed_places(parts: list[tuple[np.ndarray, ...]], first: int, segments: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if not sum(len(x[0]) for x in parts):
        return
    empty = (None,) * (len(schema) - len(_PACKED))
    run = _packed_run(*(np.concatenate(x) for x in zip(*parts, strict=True)), first, segments)
    yield from emit(((*empty, *x) for x in run), schema, 64)


def _packed_asked(asked: DataFrame, segments: int) -> DataFrame:
    """Packed places of rows (row, pair, n_before, n_word)."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        for batch in batches:
            parts.append([c.to_numpy() for c in batch.columns])
            if sum(len(x[0]) for x in parts) >= GRAMS_HELD:
                yield from packed(parts)
                parts = []
        yield from packed(parts)

    def packed(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if sum(len(x[0]) for x in parts):
            row, pair, before, word = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield from emit(_packed_run(row, pair.view(np.uint64), before, word, 0, segments), pa.schema(_PACKED), 64)

    return asked.select("row", "pair", "n_before", "n_word").mapInArrow(pack, _PACKED_SQL)


#: Sums of some texts of a chunk.
_SUMS = pa.schema([("chunk", pa.int64()), ("owners", pa.binary()), ("scores", pa.binary())])
_SUMS_SQL = "chunk long, owners binary, scores binary"


def _packed_sums(texts: np.ndarray, sums: np.ndarray) -> Iterator[tuple]:
    """A row for each chunk of the texts, which are row numbers in order."""
    chunks = texts >> TEXT_BITS
    edges = np.flatnonzero(np.concatenate([[True], chunks[1:] != chunks[:-1], [True]])).tolist()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        chunk = int(chunks[a])
        yield chunk, _planes((texts[a:b] - (chunk << TEXT_BITS)).astype(np.uint16)), _planes(sums[a:b])


def _added(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The texts of one chunk, as row numbers, and the sums of their scores."""
    owners = np.concatenate([_from_planes(x, np.uint16) for x in table.column("owners").to_pylist()])
    sums = np.bincount(owners, np.concatenate([_from_planes(x, np.float64) for x in table.column("scores").to_pylist()]))
    texts = np.unique(owners).astype(np.int64)
    return (table.column("chunk")[0].as_py() << TEXT_BITS) + texts, sums[texts]


def _looked_up(places: DataFrame, known: DataFrame, values: np.ndarray, whole: int, weight: float) -> DataFrame:
    """(chunk, owners, scores): sums of log10 P of the places with the exact counts of their pairs; no count is 0.

    A segment with very many places is looked up in slices, each with the segment's counts.
    """
    def counts_of(levels: np.ndarray) -> np.ndarray:
        return np.where(levels > TOP_LEVEL, levels - TOP_LEVEL - 1.0, values[np.minimum(levels, TOP_LEVEL)])

    def look(asked: pa.Table, held: pa.Table) -> pa.Table:
        grams, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for found in _unpacked_counts(held):
            grams.append(found[0])
            counts.append(found[1])
        grams, counts = np.concatenate(grams), np.concatenate(counts)

        def rows() -> Iterator[tuple]:
            for first, owners, pairs, levels in zip(
                    *(asked.column(c).to_pylist() for c in ("first", "owners", "pairs", "levels")), strict=True):
                pairs, (times, before, word) = _from_steps(pairs), _from_planes(levels, np.uint32, 3)
                pair = np.zeros(len(pairs))
                if len(grams):
                    at = np.minimum(np.searchsorted(grams, pairs), len(grams) - 1)
                    pair = np.where(grams[at] == pairs, counts[at], 0.0)
                found = _probabilities(pair, np.maximum(counts_of(before), pair), counts_of(word), whole, weight)
                texts, inverse = np.unique(_from_planes(owners, np.uint64).view(np.int64) + first, return_inverse=True)
                sums = np.bincount(inverse, np.repeat(np.log10(np.minimum(1.0, found)), times))
                yield from _packed_sums(texts, sums)

        columns = [*zip(*rows(), strict=True)] or [[]] * len(_SUMS)
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _SUMS, strict=True)], schema=_SUMS)

    def add(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(emit(_packed_sums(*_added(table)), _SUMS), _SUMS)

    by = ("segment", "slice")
    slices = F.broadcast(places.groupBy("segment").agg(F.ceil(F.sum("places") / PLACES).cast("int").alias("slices")))
    dealt = places.join(slices, "segment").withColumn(
        "slice", F.pmod(F.xxhash64("first", "pairs"), F.col("slices")).cast("int")).select(
        *by, "first", "owners", "pairs", "levels")
    held = known.join(slices, "segment").withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select(*by, "grams", "counts")
    return dealt.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(
        look, _SUMS_SQL).groupBy("chunk").applyInArrow(add, _SUMS_SQL)


def _probabilities(pair: np.ndarray, before: np.ndarray, word: np.ndarray, whole: int, weight: float) -> np.ndarray:
    alone = (word + 1) / whole
    share = np.divide(pair, before, out=np.zeros_like(pair), where=before > 0)
    return np.where(before > 0, weight * share + (1 - weight) * alone, alone)


def _counted(asked: DataFrame, low: DataFrame) -> DataFrame:
    """Places with the exact counts, behind ``TOP_LEVEL``, of the words the filter leaves out; others keep their level."""
    for name in ("before", "word"):
        # what is not asked has no partner: it is spread by the other columns
        spread = F.coalesce(name, F.xxhash64("row", "pair"))
        exact = (F.coalesce("_n", F.lit(0)) + TOP_LEVEL + 1).cast("int")
        asked = asked.withColumn("_key", spread).join(
            low.select(F.col("gram").alias("_key"), F.col("n").alias("_n")), "_key", "left",
        ).withColumn(f"n_{name}", F.when(F.col(name).isNotNull(), exact).otherwise(F.col(f"n_{name}"))).drop("_n", "_key")
    return asked


def _log_probabilities(model: Filter, hashes: np.ndarray, codes: np.ndarray, learned: np.ndarray, whole: int,
                       weight: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """log10 P of every token but the first, given the one before it; 0 where a count must be asked for.

    Also these places, their bigrams, and the levels of both words (0 for a word the filter does not hold).
    ``learned`` tells the tokens of training texts.
    """
    pairs = _bigrams(hashes, codes)
    level = model.levels(_unigrams(hashes)).astype(np.uint8)
    single, pair = model.counts_at(level.astype(np.int64), 1)[codes], model.counts(pairs, 2)
    level = level[codes]
    no_pair = pair == 0
    if model.least[1] <= LEAST_BIGRAM:
        pair[no_pair & learned] = 1.0
        no_pair &= ~learned
    scores = np.log10(np.minimum(1.0, _probabilities(pair, np.maximum(single[:-1], pair), single[1:], whole, weight)))
    if model.least[0] > 1:
        no_pair |= (level[:-1] == 0) | (level[1:] == 0)
    places = np.flatnonzero(no_pair)
    scores[places] = 0.0
    return scores, places, pairs[places], np.stack([level[:-1][places], level[1:][places]])
