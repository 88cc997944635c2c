"""Stages around models of the user: embedding (K9) and report generation.

A model is given as a function that loads it.  Each Python worker calls the function once and
keeps what it returns, so a model is never shipped with the plan and never loaded per batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame, functions as F, types as T

from logvigil.operators.reports import parse_reports
from logvigil.operators.retrieval import INV

#: Texts a model sees at a time.
BATCH = 64
#: Times a failing answer is asked for.
ATTEMPTS = 3

Embedder = Callable[[DataFrame, str], DataFrame]
Generator = Callable[[Sequence[str]], Sequence[str]]


def embedder(model: Transformer | Callable[[], Callable[[np.ndarray], np.ndarray]], out: str = "embedding",
             batch_size: int = BATCH) -> Embedder:
    """K9: an embedding step (frame, text column) -> frame with ``out`` as array<float>.

    ``model`` is a fitted pyspark.ml Transformer with inputCol and outputCol, or a function that loads
    one from an array of texts to a matrix.  A null text is an empty one.
    """
    if isinstance(model, Transformer):
        def transform(df: DataFrame, text_col: str) -> DataFrame:
            read, written = model.getInputCol(), model.getOutputCol()
            staged = model.transform(df.withColumn(read, F.coalesce(F.col(text_col), F.lit("")))
                                     if read != text_col else df)
            vector = F.col(written)
            if not isinstance(staged.schema[written].dataType, T.ArrayType):
                vector = vector_to_array(vector, "float32")
            return staged.withColumn(out, vector.cast("array<float>")).select(*df.columns, out)
        return transform

    predict = predict_batch_udf(model, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return lambda df, text_col: df.withColumn(out, predict(F.coalesce(F.col(text_col), F.lit(""))))


def _answers(model: Generator, prompts: list[str], attempts: int) -> Iterator[tuple[str | None, str | None, int]]:
    """(answer, error, attempts) of each prompt: asked together first, then those left each by itself."""
    try:
        found = list(model(prompts))
        if len(found) != len(prompts):
            raise ValueError(f"{len(found)} answers to {len(prompts)} prompts")
        yield from ((a, None if a is not None else "no answer", 1) for a in found)
        return
    except Exception as error:  # noqa: BLE001 - a model may raise anything, and its rows go on without it
        first = f"{type(error).__name__}: {error}"
    for prompt in prompts:
        answer, fault, asked = None, first, 1
        while answer is None and asked < attempts:
            asked += 1
            try:
                answer = list(model([prompt]))[0]
                fault = None if answer is not None else "no answer"
            except Exception as error:  # noqa: BLE001
                fault = f"{type(error).__name__}: {error}"
        yield answer, fault, asked


def generate_answers(prompts: DataFrame, load: Callable[[], Generator], key: str = INV, prompt_col: str = "prompt_context",
                     attempts: int = ATTEMPTS, batch_size: int = BATCH) -> DataFrame:
    """(key, raw_report, generation_error, attempts) for every prompt, whatever the model does.

    Prompts go to the model in batches.  If a batch fails, each of its prompts is asked for by itself,
    up to ``attempts`` times in all; a prompt that keeps failing has no answer but the last error, and
    neither the task nor the job fails.  ``load`` runs once a task.  Answers may differ when asked
    again: write the result before it is read twice.
    """
    kind = prompts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            if model is None:
                model = load()
            texts = batch.column(1).to_pylist()
            found = [row for at in range(0, len(texts), batch_size)
                     for row in _answers(model, texts[at:at + batch_size], attempts)]
            answer, fault, asked = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(answer, pa.string()), pa.array(fault, pa.string()),
                 pa.array(asked, pa.int32())], names=[key, "raw_report", "generation_error", "attempts"])

    return prompts.select(key, prompt_col).mapInArrow(
        run, f"{key} {kind}, raw_report string, generation_error string, attempts int")


def parse_answers(answers: DataFrame) -> DataFrame:
    """B1..B6 on generated answers; an answer that never came has its error as ``report_error``."""
    parsed = parse_reports(answers)
    return parsed.withColumn("report_error", F.coalesce("generation_error", "report_error"))


def asked_for(generate: Callable[[DataFrame], DataFrame], prompts: DataFrame) -> DataFrame:
    """(investigation_id, raw_report, generation_error) from any generation step; without errors of its own, none."""
    found = generate(prompts)
    if "generation_error" not in found.columns:
        found = found.withColumn("generation_error", F.lit(None).cast("string"))
    return found.select(INV, "raw_report", "generation_error")
