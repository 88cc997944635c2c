"""Language identification: a byte convolutional network in numpy.

Filters of several widths run over the bytes of a fixed-length window; each
filter's largest answer feeds a softmax over the languages.  A document is
scored on all its windows, laid end to end over the whole text, by the mean of
their probabilities, weighted by the bytes they hold.

Training uses at most ``per_label`` documents of each language, those with the
smallest hashes of their doc_id, and a few windows of each: a bounded sample of
the labelled rows (``per_label`` times the number of languages, times
``PIECES`` windows).  Prediction covers every row and every byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from logvigil.llm.stages import texts_of

WIDTHS = (2, 3, 4)
FILTERS = 8
WINDOW = 256
PER_LABEL = 400
PIECES = 4
UNKNOWN = "und"
#: A language table beyond this is a column of something else.
MAX_LABELS = 1000
#: Windows in one forward pass; keeps the working arrays inside the CPU's cache.
BLOCK = 48


@dataclass
class ByteNet:
    """``kernels[w]`` has the shape (w, classes, filters); class 0 stands for padding and unseen bytes."""

    labels: list[str]
    classes: np.ndarray
    kernels: dict[int, np.ndarray]
    biases: dict[int, np.ndarray]
    dense: np.ndarray
    offset: np.ndarray

    def tables(self) -> dict[int, list[np.ndarray]]:
        """For each width its answers to byte pairs, and to the byte left over by odd widths."""
        out = {}
        for width, kernel in self.kernels.items():
            steps = [
                (kernel[j][:, None, :] + kernel[j + 1][None, :, :]).reshape(-1, kernel.shape[2])
                for j in range(0, width - 1, 2)
            ]
            if width % 2:
                steps.append(kernel[width - 1])
            out[width] = [np.ascontiguousarray(s, np.float32) for s in steps]
        return out

    def probabilities(self, windows: np.ndarray, tables: dict[int, list[np.ndarray]]) -> np.ndarray:
        """(windows, labels) from bytes of the shape (windows, length)."""
        out = np.empty((len(windows), len(self.labels)))
        n_classes = next(iter(self.kernels.values())).shape[1]
        for at in range(0, len(windows), BLOCK):
            symbols = self.classes[windows[at:at + BLOCK]].T
            pairs = symbols[:-1].astype(np.int32) * n_classes + symbols[1:]
            pooled = []
            for width, steps in tables.items():
                length = len(symbols) - width + 1
                answers = None
                for i, step in enumerate(steps):
                    source = symbols if 2 * i + 1 == width else pairs
                    part = step.take(source[2 * i:2 * i + length], axis=0)
                    answers = part if answers is None else np.add(answers, part, out=answers)
                pooled.append(np.maximum(answers.max(axis=0) + self.biases[width], 0))
            logits = np.concatenate(pooled, axis=1) @ self.dense + self.offset
            out[at:at + BLOCK] = _softmax(logits)
        return out


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, targets: np.ndarray, labels: list[str], epochs: int = 12,
          batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteNet:
    """Fit by Adam; ``windows`` is (n, length) bytes, ``targets`` indexes ``labels``."""
    rng = np.random.default_rng(seed)
    seen = np.unique(windows)
    classes = np.zeros(256, np.uint8 if len(seen) < 256 else np.int16)
    seen = seen[seen != 0]
    classes[seen] = np.arange(1, len(seen) + 1)
    net = ByteNet(
        labels, classes,
        {w: rng.normal(0, 0.3, (w, len(seen) + 1, FILTERS)).astype(np.float32) for w in WIDTHS},
        {w: np.zeros(FILTERS, np.float32) for w in WIDTHS},
        rng.normal(0, 0.3, (FILTERS * len(WIDTHS), len(labels))), np.zeros(len(labels)),
    )
    for w in WIDTHS:
        net.kernels[w][:, 0] = 0
    params = [*net.kernels.values(), *net.biases.values(), net.dense, net.offset]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            chosen = order[at:at + batch]
            step += 1
            for i, (p, g) in enumerate(zip(params, _gradients(net, windows[chosen], targets[chosen]), strict=True)):
                first[i] += 0.1 * (g - first[i])
                second[i] += 0.001 * (g * g - second[i])
                rise = first[i] / (1 - 0.9 ** step)
                p -= (rate * rise / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)).astype(p.dtype)
    return net


def _gradients(net: ByteNet, windows: np.ndarray, targets: np.ndarray) -> list[np.ndarray]:
    symbols = net.classes[windows].T.astype(np.int64)
    rows = np.arange(len(targets))
    pooled, places = [], []
    for width, kernel in net.kernels.items():
        length = len(symbols) - width + 1
        answers = sum(kernel[j].take(symbols[j:j + length], axis=0) for j in range(width))
        places.append(answers.argmax(axis=0))
        pooled.append(np.maximum(answers.max(axis=0) + net.biases[width], 0))
    features = np.concatenate(pooled, axis=1)
    slope = _softmax(features @ net.dense + net.offset)
    slope[rows, targets] -= 1
    slope /= len(targets)
    back = (slope @ net.dense.T) * (features > 0)
    kernels, biases = [], []
    for i, (width, kernel) in enumerate(net.kernels.items()):
        part = back[:, i * FILTERS:(i + 1) * FILTERS]
        grad = np.zeros_like(kernel)
        for j in range(width):
            # the largest answer of a filter came from one place of the window
            byte = symbols[places[i] + j, rows[:, None]]
            np.add.at(grad[j], (byte, np.arange(FILTERS)[None, :]), part)
        grad[:, 0] = 0
        kernels.append(grad)
        biases.append(part.sum(axis=0).astype(np.float32))
    return [*kernels, *biases, features.T @ slope, slope.sum(axis=0)]


def training_windows(labelled: DataFrame, per_label: int = PER_LABEL, window: int = WINDOW) -> DataFrame:
    """(lang, doc_id, piece, data): windows of the sampled documents, spread over the whole text."""
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (
        labelled.select("lang", "doc_id").withColumn("_n", F.row_number().over(by_hash))
        .where(F.col("_n") <= per_label).select("doc_id").distinct()
    )
    schema = pa.schema([("lang", pa.string()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("data", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            names = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch), strict=True)
            for lang, doc_id, text in names:
                room = max(0, len(text) - window)
                starts = sorted({room * i // (PIECES - 2) for i in range(PIECES - 1)})
                parts = [text[s:s + window] for s in starts] + [text[:window // 8]]
                for i, part in enumerate(parts):
                    for column, value in zip(columns, (lang, doc_id, i, part), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    sampled = labelled.join(F.broadcast(chosen), "doc_id", "left_semi")
    return sampled.select("lang", "doc_id", "text").mapInArrow(
        cut, "lang string, doc_id long, piece int, data binary")


def as_windows(texts: list[bytes], window: int = WINDOW) -> np.ndarray:
    """Whole texts laid end to end, each filled up to full windows."""
    filled = b"".join(t.ljust(-(-len(t) // window) * window, b"\0") for t in texts)
    return np.frombuffer(filled, np.uint8).reshape(-1, window)


def fit(labelled: DataFrame, per_label: int = PER_LABEL) -> ByteNet | None:
    """Network trained on (doc_id, text, lang); None without any labelled text."""
    rows = training_windows(labelled, per_label).collect()
    rows.sort(key=lambda r: (r.lang, r.doc_id, r.piece, bytes(r.data)))
    labels = sorted({r.lang for r in rows})
    if not labels:
        return None
    if len(labels) > MAX_LABELS:
        raise ValueError(f"{len(labels)} labels are more than a language column can have")
    windows = np.concatenate([as_windows([bytes(r.data).ljust(WINDOW, b"\0")]) for r in rows])
    targets = np.array([labels.index(r.lang) for r in rows])
    return train(windows, targets, labels)


def predict(docs: DataFrame, net: ByteNet | None, keep: list[str], name: str = "language") -> DataFrame:
    """The columns ``keep`` of every row, and the struct ``name`` of lang_pred and score.

    The struct takes the place of a column of that name.
    """
    keep = [c for c in keep if c != name]
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    schema = T.StructType([*docs.select(*[f"`{c}`" for c in keep]).schema, T.StructField(name, kind)])
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        tables = net.tables() if net else None
        for batch in batches:
            *columns, text, letters = batch.columns
            letters = letters.to_pylist()
            found = zip(text.cast(pa.binary()).to_pylist(), letters, strict=True)
            langs, scores = _predicted([t if held else b"" for t, held in found], net, tables)
            both = pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores)], ["lang_pred", "score"])
            yield pa.RecordBatch.from_arrays([*columns, both], names=[*keep, name])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select(*[f"`{c}`" for c in keep], F.col("text").alias("_text"), letters.alias("_letters")).mapInArrow(
        score, schema)


def _predicted(texts: list[bytes], net: ByteNet | None, tables) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; an empty one is unknown."""
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    sizes = np.array([len(t) for t in texts], np.int64)
    if net is None or not sizes.any():
        return langs, scores
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    held = np.minimum(sizes[owner] - nth * WINDOW, WINDOW) / sizes[owner]
    each = net.probabilities(as_windows(texts), tables) * held[:, None]
    total = np.zeros((len(texts), len(net.labels)))
    np.add.at(total, owner, each)
    best = total.argmax(axis=1)
    for i in np.flatnonzero(sizes).tolist():
        langs[i] = net.labels[best[i]]
        scores[i] = min(1.0, total[i, best[i]])
    return langs, scores


def held_out(fold: int = 1, folds: int = 3):
    """Rows kept from training: crc32 of the doc_id's text leaves ``fold``; never true without an id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def with_language(docs: DataFrame, keep: list[str], per_label: int = PER_LABEL, name: str = "language") -> DataFrame:
    """Learn from the rows of ``docs`` that are not held out, and predict every row.

    Learns only from text and non-null lang.  A null text, or one without a
    letter, is ``und`` with the score 0; so is every text when there is nothing
    to learn from.  Rows repeating a doc_id are predicted each on their own text.
    Columns other than doc_id, text and lang are not read, only handed on if
    ``keep`` names them; lang is not an input of a prediction.
    """
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    return predict(docs, fit(labelled, per_label), keep, name)


def identify(docs: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): one row per row of ``docs``, as ``with_language``."""
    found = with_language(docs, ["doc_id"], per_label)
    return found.select("doc_id", held_out().alias("held_out"), "language.lang_pred", "language.score")
