"""Spelling variants among the words of a corpus, by k-d trees over letter counts.

One inserted, deleted or replaced letter changes the vector of a word's letter counts by
two at most in L1 distance.  Words of one length are the points of a k-d tree; words of the same
length and of the length below search it for points within that distance.  The edit lies in one half
of the word, so what is found must share the other half, and is then checked letter by letter.

A length with many words is cut into cells by the upper part of its tree, which is fitted on a
bounded sample of its words and broadcast; every word is stored in its cell, and asks all cells
whose boxes lie near enough.  A cell's tree is built in the task that searches it.  Cells or
questions above a block are cut by hash, so a group never exceeds two blocks.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logvigil.functions.skew import balanced_join
from logvigil.llm.stages import Stages, emit, texts_of

#: Words a cell should hold, and words of a sample that place the cuts; with the sample used up,
#: cells grow and are cut into blocks.
CELL, SAMPLE = 32_768, 262_144
#: Words and letters one group searches, and four times as many that ask.
BLOCK, LETTERS = 32_768, 4 << 20
#: Words of a leaf.
LEAF = 64
#: Different words a task holds before it writes its counts.
HELD = 500_000
#: Rows a join key may have in one place.
UNIT = 20_000
#: Most that one edit changes the counts.
REACH = 2
DIMENSIONS = 32

_RUN = "[A-Za-zÀ-ÿ]"
#: Latin-1 letter -> its dimension: a to z, all others by their lowest bits.
_DIMENSION = np.array([c - 97 if 97 <= c <= 122 else 26 + c % 6 for c in range(256)], np.int64)


def word_counts(docs: DataFrame, least_length: int = 7, least_count: int = 2, drop_every: int | None = None) -> DataFrame:
    """(word, n): words of letters up to Latin-1 with A-Z in lower case, and how often they occur.

    With ``drop_every`` a word of a document loses a letter where that number divides the crc32
    of ``<doc_id>:<word>``: planted misspellings.  Counts cover all rows, also repeated ones; a
    null text has no words, a null doc_id is an empty one in the sum.
    """
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    runs = re.compile(f"{_RUN}{{{least_length},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                if not text:
                    continue
                found = Counter(runs.findall(text.lower().decode()))
                if drop_every:
                    start = zlib.crc32(b"%s:" % (b"" if i is None else str(i).encode()))
                    for word in [w for w in found if zlib.crc32(w.encode(), start) % drop_every == 0]:
                        at = zlib.crc32(word.encode(), start) % len(word)
                        n = found.pop(word)
                        held[word[:at] + word[at + 1:]] += n
                held.update(found)
                if len(held) >= HELD:
                    yield from emit(iter(held.items()), schema)
                    held.clear()
        yield from emit(iter(held.items()), schema)

    counted = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return counted.where(F.length("word") >= least_length).groupBy("word").agg(F.sum("n").alias("n")).where(
        F.col("n") >= least_count)


def letter_counts(words: list[bytes]) -> np.ndarray:
    """Counts by dimension of Latin-1 words, a row a word."""
    letters = np.frombuffer(b"".join(words), np.uint8)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    flat = np.bincount(row * DIMENSIONS + _DIMENSION[letters], minlength=len(words) * DIMENSIONS)
    return flat.reshape(-1, DIMENSIONS)


def _cut(points: np.ndarray) -> tuple[int, int] | None:
    """Widest dimension and the largest value that goes left; None for equal points."""
    spread = points.max(axis=0) - points.min(axis=0)
    if not spread.any():
        return None
    d = int(np.lexsort((points.var(axis=0), spread > 0))[-1])
    values = np.sort(points[:, d])
    at = values[(len(values) - 1) // 2]
    return d, int(at if at < values[-1] else values[np.searchsorted(values, at) - 1])


def fit_cells(points: np.ndarray, most: float) -> list | None:
    """Upper part of a tree over sampled points, nested [dimension, value, left, right]; None is a cell of
    ``most`` points or of equal ones."""
    cut = _cut(points) if len(points) > most else None
    if cut is None:
        return None
    d, value = cut
    left = points[:, d] <= value
    return [d, value, fit_cells(points[left], most), fit_cells(points[~left], most)]


def cells_in_reach(tree: list | None, points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of all cells whose boxes lie within ``reach`` of a point, rows in any order."""
    rows, cells, waiting = [], [], [(tree, np.arange(len(points)), np.zeros_like(points), 1)]
    while waiting:
        node, at, excess, cell = waiting.pop()
        if node is None:
            rows.append(at)
            cells.append(np.full(len(at), cell))
            continue
        d, value, *sides = node
        for side, child in enumerate(sides):
            beyond = np.maximum((points[at, d] - value) if side == 0 else (value + 1 - points[at, d]), 0)
            moved = excess.copy()
            moved[:, d] = np.maximum(moved[:, d], beyond)
            near = moved.sum(axis=1) <= reach
            if near.any():
                waiting.append((child, at[near], moved[near], 2 * cell + side))
    return np.concatenate(rows), np.concatenate(cells)


def _levels(points: np.ndarray) -> np.ndarray:
    """Counts up to four as sixteen bytes whose differing bits are the L1 distance (or fewer)."""
    bits = points[:, :, None] > np.arange(4)
    return np.packbits(bits.reshape(len(points), -1), axis=1).view(np.uint64)


def pairs_in_reach(tree: np.ndarray, asking: np.ndarray, stored_halves: np.ndarray, asking_halves: np.ndarray,
                   reach: int = REACH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in ``asking``, places in ``tree``) of points within L1 ``reach`` that share a half, leaf by leaf."""
    bits, asked = _levels(tree), _levels(asking)
    # above 100 of a letter counts are cut, which only makes distances smaller
    tree, asking = np.minimum(tree, 100).astype(np.int8), np.minimum(asking, 100).astype(np.int8)
    waiting = [(np.arange(len(tree)), np.arange(len(asking)))]
    while waiting:
        points, at = waiting.pop()
        box = tree[points]
        low, high = box.min(axis=0), box.max(axis=0)
        some = asking[at]
        apart = (np.maximum(low, some) - np.minimum(high, some)).sum(axis=1)
        at = at[apart <= reach]
        if not len(at):
            continue
        cut = _cut(box) if len(points) > LEAF else None
        if cut:
            left = box[:, cut[0]] <= cut[1]
            waiting += [(points[left], at), (points[~left], at)]
            continue
        for first in range(0, len(points), LEAF):
            leaf = points[first:first + LEAF]
            near = np.zeros((len(at), len(leaf)), bool)
            for half in (0, 1):
                near |= asking_halves[at, half][:, None] == stored_halves[leaf, half]
            i, j = np.nonzero(near)
            i, j = at[i], leaf[j]
            near = np.bitwise_count(asked[i] ^ bits[j]).sum(axis=1) <= reach
            if near.any():
                yield i[near], j[near]


def letters_of(words: list[bytes]) -> np.ndarray:
    """Words of one length as rows of letters."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def halves(letters: np.ndarray, shorter: int) -> np.ndarray:
    """Hashes of the first and the last letters; words within one edit share one of them.

    The halves are those of the ``shorter`` length: an edit in the second half leaves the first
    as it is, one in the first half leaves the last letters.
    """
    first = shorter // 2
    factors = np.random.default_rng(11).integers(1, 1 << 63, max(shorter, 1), np.uint64)
    sides = letters[:, :first], letters[:, letters.shape[1] - (shorter - first):]
    return np.stack([(side * factors[:side.shape[1]]).sum(axis=1, dtype=np.uint64) for side in sides], axis=1)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of letters differ from others of the same or the next length by exactly one edit."""
    if a.shape == b.shape:
        return (a != b).sum(axis=1) == 1
    ahead = np.minimum.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
    behind = np.minimum.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return ahead + behind >= a.shape[1]


def _placed(words: DataFrame, sizes: DataFrame, total: int) -> DataFrame:
    """(length, cell, role, word, n): every word in its cell (role 0), and in all cells it asks: its own
    (1), those of its length with a higher number and those of the next length (2), so two cells meet once."""
    large = {r["length"]: r["words"] for r in sizes.where(F.col("words") > CELL).collect()}
    trees: dict[int, list | None] = {}
    if large:
        share = min(1.0, SAMPLE / total)
        drawn = words.where(F.col("length").isin(list(large))).where(
            F.pmod(F.xxhash64("word"), F.lit(1 << 32)) < int(share * (1 << 32))).select("length", "word").collect()
        by_length: dict[int, list[bytes]] = {}
        for length, word in drawn:
            by_length.setdefault(length, []).append(word.encode("latin-1"))
        for length, found in by_length.items():
            trees[length] = fit_cells(letter_counts(found), CELL * len(found) / large[length])
    schema = pa.schema([("length", pa.int32()), ("cell", pa.int64()), ("role", pa.int32()),
                        ("word", pa.string()), ("n", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(0).to_numpy()
            words = [w.encode("latin-1") for w in batch.column(1).to_pylist()]
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                points = letter_counts([words[i] for i in at])
                home = np.empty(len(at), np.int64)
                own, own_cell = cells_in_reach(trees.get(length), points, 0)
                home[own] = own_cell
                row, cell = cells_in_reach(trees.get(length), points, REACH)
                row, cell = row[cell >= home[row]], cell[cell >= home[row]]
                longer, longer_cell = cells_in_reach(trees.get(length + 1), points, REACH)
                for to, rows, cells, role in (
                        (length, own, own_cell, np.zeros(len(own))), (length, row, cell, 1 + (cell > home[row])),
                        (length + 1, longer, longer_cell, np.full(len(longer), 2))):
                    taken = batch.take(pa.array(at[rows]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), to, np.int32)), pa.array(cells.astype(np.int64)),
                         pa.array(role.astype(np.int32)), taken.column(1), taken.column(2)], schema=schema)

    return words.select("length", "word", "n").mapInArrow(
        place, "length int, cell long, role int, word string, n long")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) for the words (word, n) that differ by exactly one letter; each pair both ways.

    Words are distinct and of Latin-1 letters.  Words of any length are compared whole.
    """
    stages = Stages(words.sparkSession)
    words = stages.keep(words.select("word", "n", F.length("word").alias("length")), "words")
    sizes = words.groupBy("length").agg(F.count(F.lit(1)).alias("words"))
    placed = stages.keep(_placed(words, sizes, words.count()), "placed")
    groups = placed.groupBy("length", "cell").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.expr(f"int(greatest(1, ceil(sum(if({own}, 1, 0)) / {size * BLOCK}),"
                 f" ceil(sum(if({own}, length(word), 0)) / {size * LETTERS})))").alias(name)
          for own, size, name in (("role = 0", 1, "blocks"), ("role > 0", 4, "questions"))])
    rows = balanced_join(placed, groups, ["length", "cell"], groups, "rows", ["word"], "inner", UNIT)
    hashed = F.xxhash64("word", F.lit(7))
    one = lambda blocks: F.array(F.pmod(hashed, F.col(blocks)).cast("int"))
    every = lambda blocks: F.sequence(F.lit(0), F.col(blocks) - 1)
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (
        rows.withColumn("block", F.explode(F.when(F.col("role") > 0, every("blocks")).otherwise(one("blocks"))))
        .withColumn("question", F.explode(F.when(F.col("role") > 0, one("questions")).otherwise(every("questions"))))
        .select("length", "cell", "block", "question", "role", "word", "n")
        .repartition(parts, "length", "cell", "block", "question")
    )

    def search(group: pa.Table) -> pa.Table:
        length = group.column("length")[0].as_py()
        role = group.column("role").to_numpy()
        words, n = [w.encode("latin-1") for w in group.column("word").to_pylist()], group.column("n").to_numpy()
        lengths = np.array([len(w) for w in words])
        stored = np.flatnonzero(role == 0)
        found = [np.empty((2, 0), np.int64)]
        for own in (length, length - 1) if len(stored) else ():
            asking = np.flatnonzero((role > 0) & (lengths == own))
            if not len(asking):
                continue
            inside, outside = [words[x] for x in stored], [words[x] for x in asking]
            there, here = letters_of(inside), letters_of(outside)
            step = max(1, LETTERS // length)
            for i, j in pairs_in_reach(letter_counts(inside), letter_counts(outside), halves(there, own), halves(here, own)):
                for at in range(0, len(i), step):
                    x, y = i[at:at + step], j[at:at + step]
                    near = one_edit(here[x], there[y])
                    found.append(np.stack([asking[x[near]], stored[y[near]]]))
        a, b = np.concatenate(found, axis=1)
        if len(a):
            # words of one cell find each other both ways: one is enough
            once = np.array([role[x] == 2 or words[x] < words[y] for x, y in zip(a, b, strict=True)])
            a, b = a[once], b[once]
        word = group.column("word").combine_chunks()
        return pa.table({"word": word.take(pa.array(a)), "n": pa.array(n[a]),
                         "other": word.take(pa.array(b)), "other_n": pa.array(n[b])})

    pairs = stages.keep(dealt.groupBy("length", "cell", "block", "question").applyInArrow(
        search, "word string, n long, other string, other_n long"), "near-words")
    stages.drop(placed, words)
    return pairs.unionByName(pairs.select(
        F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def _roots(forms: DataFrame, stages: Stages) -> DataFrame:
    """(word, root): follow (word, form) to the last form, twice as far each round.

    A form is more frequent than its word, so there are no circles.
    """
    found = stages.keep(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        following = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = stages.keep(
            found.join(following, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = not further.where("moved").isEmpty()
        stages.drop(found)
        if not moved:
            return further.select("word", "root")
        found = stages.keep(further.select("word", "root"), "roots")
        stages.drop(further)


def spelling_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every distinct word of (word, n).

    form is the most frequent word that differs by exactly one letter (of equal ones the first in
    code-point order) if it occurs ``ratio`` times as often, else null; root follows
    the forms to their end and is the word itself without a form.  An empty table gives none.
    """
    stages = Stages(words.sparkSession)
    words = stages.keep(words, "counted")
    best = F.min(F.struct((-F.col("other_n")).alias("order"), F.col("other").alias("form")))
    near = near_words(words).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    near = stages.keep(
        near.withColumn("common", -F.col("best.order") >= ratio * F.col("n"))
        .select("word", "n_near", F.when(F.col("common"), F.col("best.form")).alias("form"),
                F.when(F.col("common"), -F.col("best.order")).alias("form_n")), "forms")
    roots = _roots(near.where("form is not null"), stages)
    return (
        words.join(near, "word", "left").join(roots, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
    )
