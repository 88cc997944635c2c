"""Line dedup: documents that share rare lines are aligned, common blocks leave the later one.

Each document's lines are hashed.  A line held by several documents points from each of
them to its first holder (the smallest doc_id), so a line in a third of all
documents makes as many links, not their square.  A linked pair of documents overlaps
when the rarity of all lines both hold, the sum of ln(documents / holders), reaches
``least_rarity``: a line few documents hold is enough, boilerplate alone is not.  Where
the first holder of a line does not overlap, its neighbours decide: two lines that
follow each other, in the text, by rarity or by hash, point to the first document
that has both as neighbours.  Lines that no overlapping earlier document was found for after that
are open: they meet the other holders that share a rare line as well, so every line
that an overlapping earlier document holds has such a partner.  Documents of the same lines, blank ones aside, overlap at any
rarity and length: each points to the first of them.

Overlapping pairs are aligned by patience diff on their line hashes: lines unique
in both parts are matched, the longest increasing run of matches is the frame,
and the gaps between are aligned the same way, matching equal lines outwards from
each frame line; a gap without such a line is framed by its least frequent ones.  Lines of the aligned blocks are deleted from the later document.
"""

from __future__ import annotations

import bisect
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from logvigil.functions.skew import balanced_join
from logvigil.llm.stages import Stages, emit, texts_of

#: A line of fewer characters says nothing about its origin: it never links documents.
LEAST_LINE = 15
LEAST_RARITY = 6.0
#: What sums of rarities in another order may differ by.
SLACK = 1e-6
#: Rows of one document that meet one first holder in one slice of the join.
UNIT = 5_000
#: Places where repeated elements meet that are compared for the longest run.
TRIES = 64
#: Places between two lines, in one of the orders, that count as neighbours.
NEIGHBOURS = 2


def line_hashes(text: bytes | None) -> np.ndarray:
    """One hash per line, white space around it and in runs aside; blank lines are 0."""
    if not text:
        return np.empty(0, np.uint64)
    lines = text.split(b"\n")
    return np.array([
        xxhash.xxh3_64_intdigest(b" ".join(words)) | 1 if (words := line.split()) else 0 for line in lines
    ], np.uint64)


def matching(left: list[int], right: list[int]) -> list[tuple[int, int]]:
    """Aligned equal lines (i, j) by patience diff, in order."""
    out: list[tuple[int, int]] = []
    parts = [(0, len(left), 0, len(right))]
    while parts:
        a, b, c, d = parts.pop()
        while a < b and c < d and left[a] == right[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and left[b - 1] == right[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        count_left, count_right = Counter(left[a:b]), Counter(right[c:d])
        at_right = {line: j for j, line in enumerate(right[c:d], c) if count_right[line] == 1}
        unique = [
            (i, at_right[line]) for i, line in enumerate(left[a:b], a)
            if count_left[line] == 1 and line in at_right
        ]
        i0, j0 = a, c
        frame = _increasing(unique) or _anchors(left, right, (a, b, c, d), count_left, count_right)
        for i, j in [*frame, (b, d)] if frame else ():
            parts.append((i0, i, j0, j))
            if i < b:
                out.append((i, j))
            i0, j0 = i + 1, j + 1
    return sorted(out)


def _anchors(left: list[int], right: list[int], part: tuple[int, int, int, int], count_left: Counter,
             count_right: Counter) -> list[tuple[int, int]]:
    """A frame where nothing is unique on both sides, from the least frequent elements.

    Of the places where they meet, the one in the longest equal run; elements that
    meet in very many places are paired in order.
    """
    a, b, c, d = part
    common = sorted((count_left[x] * count_right[x], n, x) for n, x in enumerate(count_left) if x in count_right)
    if not common:
        return []
    chosen, places = set(), 0
    for n, _, x in common:
        if chosen and places + n > TRIES:
            break
        chosen.add(x)
        places += n
    at_left, at_right = defaultdict(list), defaultdict(list)
    for side, at, low, high in ((left, at_left, a, b), (right, at_right, c, d)):
        for i in range(low, high):
            if side[i] in chosen:
                at[side[i]].append(i)
    if places > TRIES:
        x = common[0][2]
        return list(zip(at_left[x], at_right[x], strict=False))
    best, longest = (0, 0), 0
    for x in chosen:
        for i in at_left[x]:
            for j in at_right[x]:
                low, high = equal_run(left, right, i, j, part)
                if (high - low, -i, -j) > (longest, -best[0], -best[1]):
                    best, longest = (i, j), high - low
    return [best]


def equal_run(left: list[int], right: list[int], i: int, j: int, part: tuple[int, int, int, int]) -> tuple[int, int]:
    """First and last place plus one, on the left, of the equal run through (i, j) within ``part``."""
    a, b, c, d = part
    low, high, shift = i, i + 1, j - i
    while low > a and low + shift > c and left[low - 1] == right[low + shift - 1]:
        low -= 1
    while high < b and high + shift < d and left[high] == right[high + shift]:
        high += 1
    return low, high


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs that increases on both sides."""
    tops: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for n, (_, j) in enumerate(pairs):
        place = bisect.bisect_left(tops, j)
        before.append(at[place - 1] if place else -1)
        if place == len(tops):
            tops.append(j)
            at.append(n)
        else:
            tops[place], at[place] = j, n
    out = []
    n = at[-1] if at else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def hashed_lines(docs: DataFrame, least_line: int = LEAST_LINE) -> DataFrame:
    """(doc_id, key, lines, telling, body) per row: packed line hashes, the distinct long ones in order,
    and a digest of all lines that are not blank; null without any."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("key", pa.int64()), ("lines", pa.binary()),
        ("telling", pa.list_(pa.int64())), ("body", pa.binary()),
    ])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, telling, bodies = [], [], []
            for text in texts_of(batch):
                hashes = line_hashes(text)
                written = hashes[hashes > 0]
                bodies.append(xxhash.xxh3_128_digest(written.tobytes()) if len(written) else None)
                long = np.array([len(x.strip()) >= least_line for x in (text or b"").split(b"\n")], bool)
                packed.append(hashes.tobytes())
                told = hashes[long[:len(hashes)]]
                telling.append(told[np.sort(np.unique(told, return_index=True)[1])].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(packed, pa.binary()),
                 pa.array(telling, pa.list_(pa.int64())), pa.array(bodies, pa.binary())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))
    return rows.mapInArrow(
        hashed, "doc_id long, key long, lines binary, telling array<long>, body binary")


def copies(lines: DataFrame) -> DataFrame:
    """(doc_id, first): later documents with the first one that has the same lines; a hot text is cut in slices."""
    bodies = lines.where("body is not null").select("doc_id", "body")
    firsts = bodies.groupBy("body").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    return balanced_join(bodies, firsts, ["body"], firsts, "rows", ["doc_id"], "inner", UNIT).where(
        "doc_id <> first").select("doc_id", "first").distinct()


def overlapping(lines: DataFrame, least_rarity: float, stages: Stages) -> DataFrame:
    """(doc_id, first): each later document with the earlier ones found to overlap it."""
    documents = lines.select("doc_id").distinct().count()
    held = lines.select("doc_id", F.posexplode("telling").alias("at", "line"))
    holders = held.groupBy("line").agg(
        F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("holders")
    ).where("holders > 1")
    rarity = F.log(F.lit(float(max(1, documents))) / F.col("holders"))
    shared = stages.keep(
        held.join(holders, "line").select("doc_id", "at", "line", "first", rarity.alias("rarity")), "shared")
    sets = stages.keep(shared.groupBy("doc_id").agg(
        F.collect_list(F.struct("at", "line", "rarity")).alias("held"),
        F.sum("rarity").alias("rarity"),
        F.sum(F.when(F.col("doc_id") != F.col("first"), F.col("rarity"))).alias("earlier")), "sets")
    # no pair of documents shares more than all that the later one shares
    reaching = sets.where(F.col("earlier") >= least_rarity).select("doc_id")
    links = shared.where("doc_id <> first").join(reaching, "doc_id", "left_semi").select("doc_id", "first", "line")
    found = stages.keep(_confirmed(links.select("doc_id", "first").distinct(), sets, least_rarity), "found")
    left = stages.keep(links.join(found, ["doc_id", "first"], "left_anti").select("doc_id", "line").distinct(), "left")
    joint = stages.keep(_neighbours(sets.where(F.col("rarity") >= least_rarity)), "joint")
    firsts = joint.groupBy("a", "b").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last").drop("last")
    open_ = joint.join(left.withColumnRenamed("line", "a"), ["doc_id", "a"], "left_semi").unionByName(
        joint.join(left.withColumnRenamed("line", "b"), ["doc_id", "b"], "left_semi"))
    more = open_.join(firsts, ["a", "b"]).where("doc_id <> first").select("doc_id", "first").distinct().join(
        found, ["doc_id", "first"], "left_anti")
    found = stages.keep(found.unionByName(_confirmed(more, sets, least_rarity)), "found")
    ranked = None
    for all_holders in (False, True):
        left = stages.keep(_open(left, found, shared), "left")
        if left.isEmpty():
            break
        if ranked is None:
            ranked = stages.keep(_ranked(shared, sets, least_rarity), "ranked")
        met = stages.keep(_other_holders(left, ranked, least_rarity, all_holders).join(
            found, ["doc_id", "first"], "left_anti"), "met")
        found = stages.keep(found.unionByName(_confirmed(met, sets, least_rarity)), "found")
    return found


def _open(left: DataFrame, found: DataFrame, shared: DataFrame) -> DataFrame:
    """Rows (doc_id, line) whose line no earlier document found to overlap holds."""
    settled = left.join(found, "doc_id").join(
        shared.select(F.col("doc_id").alias("first"), "line"), ["first", "line"], "left_semi").select("doc_id", "line")
    return left.join(settled, ["doc_id", "line"], "left_anti")


def _ranked(shared: DataFrame, sets: DataFrame, least_rarity: float) -> DataFrame:
    """(doc_id, line, rarity, weight): a line with the rarity of all lines of its text from it on, rarest first."""
    rest = Window.partitionBy("doc_id").orderBy("rarity", F.desc("line")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    enough = sets.where(F.col("rarity") >= least_rarity - SLACK).select("doc_id")
    return shared.select("doc_id", "line", "rarity").distinct().join(enough, "doc_id", "left_semi").withColumn(
        "weight", F.sum("rarity").over(rest))


def _other_holders(left: DataFrame, ranked: DataFrame, least_rarity: float, all_holders: bool) -> DataFrame:
    """(doc_id, first): documents with open lines and earlier holders of such a line that may overlap them.

    The rarest line two overlapping documents share starts enough rarity in both.  So an open
    line meets its holders by that line and itself.  The first holder of both is asked, and then
    (``all_holders``) every one, unless the two lines are enough: then the first has settled it.
    """
    leading = ranked.where(F.col("weight") >= least_rarity - SLACK).select(
        "doc_id", F.col("line").alias("lead"), F.col("rarity").alias("lead_rarity"))
    asking = left.join(ranked.select("doc_id", "line", "rarity"), ["doc_id", "line"]).join(leading, "doc_id").where(
        "lead_rarity > rarity or (lead_rarity = rarity and lead <= line)")
    if all_holders:
        both = F.col("lead_rarity") + F.when(F.col("lead") != F.col("line"), F.col("rarity")).otherwise(0.0)
        asking = asking.where(both < least_rarity + SLACK)
    asking = asking.select("doc_id", "lead", "line")
    wanted = asking.groupBy("lead", "line").agg(F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("asking"))
    holders = leading.select(F.col("doc_id").alias("first"), "lead").join(wanted, "lead").where("first < last").join(
        ranked.select(F.col("doc_id").alias("first"), "line"), ["first", "line"], "left_semi")
    if not all_holders:
        holders = holders.groupBy("lead", "line").agg(F.min("first").alias("first"), F.first("asking").alias("asking"))
        met = balanced_join(asking, holders, ["lead", "line"], holders, "asking", ["doc_id"], "inner", UNIT)
    else:
        met = balanced_join(asking, holders, ["lead", "line"], wanted, "asking", ["doc_id"], "inner", UNIT)
    return met.where("first < doc_id").select("doc_id", "first").distinct()


def _neighbours(sets: DataFrame) -> DataFrame:
    """(doc_id, a, b): lines that follow each other in the text, by rarity or by hash."""
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "a", "b")])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
            for doc, *held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, line, rarity = (np.array(x) for x in held)
                met = set()
                for order in (np.argsort(at), np.lexsort((line, -rarity)), np.argsort(line)):
                    ordered = line[order].tolist()
                    for apart in range(1, NEIGHBOURS + 1):
                        met.update((min(x), max(x)) for x in zip(ordered, ordered[apart:], strict=False) if x[0] != x[1])
                yield from ((doc, *x) for x in sorted(met))

        for batch in batches:
            yield from emit(rows(batch), schema)

    return sets.select("doc_id", "held.at", "held.line", "held.rarity").mapInArrow(
        pairs, "doc_id long, a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, least_rarity: float) -> DataFrame:
    """The pairs whose documents share lines of enough rarity."""
    schema = pa.schema([("doc_id", pa.int64()), ("first", pa.int64())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in (2, 3, 4))
            enough = []
            for earlier, later, rarity in zip(*columns, strict=True):
                there = set(earlier)
                both = {x: r for x, r in zip(later, rarity, strict=True) if x in there}
                enough.append(sum(both.values()) >= least_rarity - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=schema).filter(pa.array(enough, pa.bool_()))

    sliced, weights = _sliced(pairs)
    firsts = _repeated(weights, sets.select(F.col("doc_id").alias("first"), F.col("held.line").alias("left")))
    later = sets.select("doc_id", F.col("held.line").alias("right"), F.col("held.rarity").alias("rarity"))
    return sliced.join(later, "doc_id").join(firsts, ["first", "slice"]).select(
        "doc_id", "first", "left", "right", "rarity").mapInArrow(add, "doc_id long, first long")


def _sliced(pairs: DataFrame, unit: int = UNIT) -> tuple[DataFrame, DataFrame]:
    """Pairs with a slice each, and the slices of each first holder: one per ``unit`` pairs."""
    weights = pairs.groupBy("first").agg(F.ceil(F.count(F.lit(1)) / unit).cast("int").alias("slices"))
    spread = F.pmod(F.xxhash64("doc_id"), F.col("slices")).cast("int")
    return pairs.join(weights, "first").withColumn("slice", spread).drop("slices"), weights


def _repeated(weights: DataFrame, firsts: DataFrame) -> DataFrame:
    """A first holder of very many documents once per slice of them."""
    return weights.join(firsts, "first").withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")


def removed_lines(pairs: DataFrame, lines: DataFrame, unit: int = UNIT) -> DataFrame:
    """(doc_id, key, gone): line numbers each text loses, over all documents it overlaps."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("gone", pa.list_(pa.int32()))])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = []
            sides = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            for first, later in sides:
                left = np.frombuffer(first, np.uint64).tolist()
                right = np.frombuffer(later, np.uint64).tolist()
                gone.append(_blocks_to_remove(matching(left, right), right))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(gone, pa.list_(pa.int32()))], schema=schema)

    sliced, weights = _sliced(pairs, unit)
    firsts = _repeated(weights, lines.select(F.col("doc_id").alias("first"), F.col("lines").alias("left")))
    sides = sliced.join(lines.select("doc_id", "key", F.col("lines").alias("right")), "doc_id").join(
        firsts, ["first", "slice"])
    found = sides.select("doc_id", "key", "left", "right").mapInArrow(
        align, "doc_id long, key long, gone array<int>")
    lost = found.select("doc_id", "key", F.explode("gone").alias("line")).distinct()
    return lost.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list("line")).alias("gone"))


def _blocks_to_remove(pairs: list[tuple[int, int]], right: list[int]) -> list[int]:
    """Lines of the later document in aligned blocks; a block of blank lines only stays."""
    out, block, last = [], [], (-2, -2)
    for i, j in [*pairs, (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if any(right[x] for x in block):
                out += block
            block = []
        block.append(j)
        last = (i, j)
    return out


def dedup_lines(docs: DataFrame, least_rarity: float = LEAST_RARITY,
                least_line: int = LEAST_LINE, name: str = "dedup") -> DataFrame:
    """The rows of ``docs`` with the lines they repeat from earlier documents removed.

    Adds the struct column ``name`` (n_lines, n_removed, removed: line numbers
    from 0), in place of a column of that name; all other columns stay.
    ``text`` holds the lines that stay.  Earlier means a smaller doc_id.  A null text
    stays null and has no lines, an empty text has none.  Rows that repeat a
    doc_id are one document, of which no row is earlier than another, and rows
    without a doc_id neither lose lines nor take any.
    """
    stages = Stages(docs.sparkSession)
    lines = stages.keep(hashed_lines(docs.where("doc_id is not null"), least_line).distinct(), "lines")
    found = overlapping(lines.drop("body"), least_rarity, stages)
    pairs = stages.keep(found.unionByName(copies(lines)).distinct(), "overlaps")
    gone = removed_lines(pairs, lines)
    lost = gone.select(
        F.struct(F.col("doc_id").alias("id"), F.col("key").alias("text")).alias("_row"),
        F.col("gone").alias("_gone"))
    row = F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text"))
    joined = docs.withColumn("_row", row).join(lost, "_row", "left").withColumn(
        "_lines", F.split("text", "\n"))
    staying = F.array_except(
        F.sequence(F.lit(0), F.size("_lines") - 1), F.coalesce("_gone", F.array().cast("array<int>")))
    kept = F.transform(staying, lambda i: F.element_at(F.col("_lines"), i + 1))
    removed = F.coalesce("_gone", F.array().cast("array<int>"))
    counted = F.when(F.coalesce(F.col("text"), F.lit("")) == "", 0).otherwise(F.size("_lines"))
    return joined.select(
        *[F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text")
          if c == "text" else F.col(f"`{c}`") for c in docs.columns if c != name],
        F.struct(counted.cast("long").alias("n_lines"), F.size(removed).cast("long").alias("n_removed"),
                 removed.alias("removed")).alias(name),
    )
