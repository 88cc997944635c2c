"""Language-model scores, language ID and nearest neighbours."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm.conftest import EDGES, SF_DIR, frame
from logvigil.llm import ann, language, ngram_model
from logvigil.llm.stages import table


def tokens(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), "\n"]


def is_held_out(doc_id, folds, fold):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


def expected_base(texts):
    counts = Counter(t for i, x in texts if not is_held_out(i, 7, 2) for t in tokens(x))
    total, distinct = sum(counts.values()), len(counts)
    return [
        (i, is_held_out(i, 7, 2), len(tokens(x)), sum(counts[t] > 0 for t in tokens(x)), total,
         round(sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in tokens(x)), 5))
        for i, x in texts
    ]


@pytest.mark.parametrize("hot", [1 << 18, 50])
def test_base_scores(documents, rows, hot):
    found = ngram_model.score_texts(documents, hot=hot).collect()
    base = [(*r[:5], round(r.base_score, 5)) for r in found]
    assert sorted(base) == sorted(expected_base([(r.doc_id, r.text) for r in rows]))
    assert sum(r.score for r in found if r.held_out) > sum(r.base_score for r in found if r.held_out)
    assert all(r.score <= 0 for r in found)


def test_scores_of_edges(edges, nothing):
    found = ngram_model.score_texts(edges, hot=2).collect()
    assert sorted(map(repr, [(*r[:5], round(r.base_score, 4)) for r in found])) == sorted(
        map(repr, [(*r[:5], round(r[5], 4)) for r in expected_base(EDGES)]))
    assert ngram_model.score_texts(nothing).collect() == []


def test_untrained_model(spark):
    held = next(i for i in range(100) if is_held_out(i, 7, 2))
    row = ngram_model.score_texts(frame(spark, [(held, "some words")])).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (True, 3, 0, 0, 0, 0)


def test_rare_ngrams_are_counted_exactly(spark, monkeypatch):
    """Bigrams seen once, and what a full filter leaves out, come with exact counts by the join."""
    held = [i for i in range(400) if is_held_out(i, 7, 2)]
    learned = [i for i in range(400) if not is_held_out(i, 7, 2)]
    texts = [(i, " ".join(f"w{(i * 31 + j * j) % 97}" for j in range(30))) for i in learned[:250]]
    texts += [(learned[300], "one two three four"), (held[0], "one two three four"), (held[1], "two one four three"),
              (held[2], texts[0][1]), (held[2], texts[0][1]), (held[3], "unseen w1 w2"), (held[4], None)]
    train = [tokens(x) for i, x in texts if not is_held_out(i, 7, 2)]
    single = Counter(t for x in train for t in x)
    pairs = Counter(p for x in train for p in zip(["\n", *x], x))
    whole = sum(single.values()) + len(single) + 1

    def expected(text):
        out, x = 0.0, tokens(text)
        for a, b in zip(["\n", *x], x):
            alone = (single[b] + 1) / whole
            p = 0.3 * pairs[a, b] / single[a] + 0.7 * alone if single[a] else alone
            out += math.log10(min(1.0, p))
        return out

    docs = frame(spark, texts)
    scores = {}
    for least in (None, (1, 8), (1 << 30, 1 << 30)):
        if least:
            monkeypatch.setattr(ngram_model, "_least_counts", lambda *_, least=least: (least, 1000))
        found = ngram_model.score_texts(docs, hot=20).collect()
        scores[least] = sorted((r.doc_id, round(r.score, 6)) for r in found)
    exact_scores = scores[1 << 30, 1 << 30]
    # nothing in the filter: every count is exact
    assert [x for x, _ in exact_scores] == sorted(i for i, _ in texts)
    for (i, got), (_, text) in zip(exact_scores, sorted(texts, key=lambda x: x[0]), strict=True):
        assert got == pytest.approx(expected(text), abs=1e-4)
    # a pair seen once counts, whatever the filter holds
    for found in scores.values():
        assert dict(found)[held[0]] > dict(found)[held[1]] + 1
        for (i, got), (_, exact) in zip(found, exact_scores, strict=True):
            assert got == pytest.approx(exact, rel=0.12)


def test_places_travel_as_packed_runs(spark, monkeypatch):
    """Places to be looked up are stored in a few bytes each; a segment in slices gives the same scores."""
    docs = frame(spark, [(i, " ".join(f"w{(i * 31 + j * j) % 97}" for j in range(200))) for i in range(150)])
    monkeypatch.setattr(ngram_model, "_least_counts", lambda *_: ((1, 1 << 30), 1000))
    kept, sizes = ngram_model.Stages.keep, []

    def keep(self, df, name="stage"):
        table = kept(self, df, name)
        if name == "scored":
            width = sum(F.octet_length(c) for c in ("owners", "pairs", "levels"))
            sizes.append(table.where("segment is not null").agg(F.sum("places"), F.sum(width)).first())
        return table

    monkeypatch.setattr(ngram_model.Stages, "keep", keep)
    scores = []
    for places in (4_000_000, 20):
        monkeypatch.setattr(ngram_model, "PLACES", places)
        scores.append({r.doc_id: r.score for r in ngram_model.score_texts(docs).collect()})
    assert scores[1] == pytest.approx(scores[0]) and len(scores[0]) == 150
    for places, size in sizes:
        assert 30_000 < places <= 150 * 201 and size <= 14 * places  # the filter may take a few for its own


def test_places_travel_packed_where_unigrams_are_left_out(spark, monkeypatch):
    """Only places next to a word the filter lacks are rows; shares of the segments give the scores of all at once."""
    docs = frame(spark, [(i, " ".join(f"w{(i * 31 + j * j) % 97}" for j in range(200)) + f" once{i}") for i in range(150)])
    kept, stored = ngram_model.Stages.keep, []

    def keep(self, df, name="stage"):
        table = kept(self, df, name)
        if name == "scored":
            width = sum(F.octet_length(c) for c in ("owners", "pairs", "levels"))
            stored.append(table.agg(F.sum(F.size("asked")), F.sum("places"), F.sum(width)).first())
        return table

    monkeypatch.setattr(ngram_model.Stages, "keep", keep)
    scores = []
    for least, tokens in (((1 << 30, 1 << 30), 1 << 23), ((3, 1 << 30), 1 << 23), ((3, 1 << 30), 5_000)):
        monkeypatch.setattr(ngram_model, "_least_counts", lambda *_, least=least: (least, 1000))
        monkeypatch.setattr(ngram_model, "ROUND_TOKENS", tokens)
        scores.append({r.doc_id: r.score for r in ngram_model.score_texts(docs).collect()})
    assert scores[1] == pytest.approx(scores[0], rel=0.12) and scores[2] == pytest.approx(scores[1]) and len(scores[0]) == 150
    assert stored[1] == stored[2]
    rows, places, size = stored[1]
    # the filter may take a few for its own
    assert 0 < rows <= 2 * 150 and 150 * 202 - 30 <= rows + places <= 150 * 202 and size <= 14 * places


def test_tokens_of_a_batch():
    texts = [" the a\tb\x0b ", None, "", " \n ", "A \x1c\x85 \u0130 x\x00y \U0001f600Z the", "end"]
    found, codes, sizes = ngram_model._tokens_of(pa.record_batch({"text": pa.array(texts)}))
    expected = [[*x.encode().lower().split(), b"\n"] if x else [b"\n"] for x in texts]
    assert [found[i].as_py() for i in codes] == [b"\n", *(w for x in expected for w in x)]
    assert sizes.tolist() == list(map(len, expected))


def test_filter_reads_counts_back(spark):
    rng = np.random.default_rng(3)
    grams = rng.integers(-(1 << 63), 1 << 63, 30_000)
    counts = np.minimum(rng.zipf(1.5, 30_000), 10 ** 9)
    one = spark.createDataFrame(list(zip(grams.tolist(), counts.tolist(), strict=True)), "gram long, n long")
    model = ngram_model.build_filter(one, one.limit(0))
    read = model.counts(grams.view(np.uint64), 1)
    # a filter has no false misses, and few false hits
    assert (read >= counts / 1.5).all()
    assert (read <= counts * 1.5).mean() > 0.95
    assert (model.levels(rng.integers(0, 1 << 63, 30_000).astype(np.uint64)) > 0).mean() < 0.05


def test_filter_keeps_its_bound(spark):
    rows = [(i * 7919 * 1_000_003, 1 + i % 40) for i in range(60_000)]
    grams = spark.createDataFrame(rows, "gram long, n long")
    model = ngram_model.build_filter(grams, grams.where("n >= 2"), max_bits=1 << 18)
    assert len(model.words) * 64 <= 1 << 18
    assert model.least[1] > 2


def test_language_held_out(documents, rows):
    lang = {r.doc_id: r.lang for r in rows}
    found = language.identify(documents).collect()
    assert len(found) == len(rows)
    assert all(r.held_out == is_held_out(r.doc_id, 3, 1) for r in found)
    assert np.mean([lang[r.doc_id] == r.lang_pred for r in found if r.held_out]) > 0.95
    assert all(0 <= r.score <= 1 for r in found)


def test_language_ignores_held_out_labels(documents):
    other = documents.withColumn("lang", F.when(language.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    assert sorted(language.identify(other).collect()) == sorted(language.identify(documents).collect())


def test_language_edges(spark, edges, nothing):
    found = language.identify(edges).collect()
    assert len(found) == len(EDGES)
    unknown = Counter(r.doc_id for r in found if r.lang_pred == "und")
    assert unknown == {2: 1, 3: 1, 4: 1, 9: 1}
    assert language.identify(nothing).collect() == []
    unlabelled = language.identify(frame(spark, EDGES, lang=None)).collect()
    assert {(r.lang_pred, r.score) for r in unlabelled} == {("und", 0.0)}
    kept = language.with_language(edges, edges.columns, name="_language")
    assert kept.columns == [*edges.columns, "_language"] and kept.count() == len(EDGES)


def test_windows_cover_the_whole_text():
    texts = [b"", b"a" * 700, b"b"]
    cut = language.as_windows(texts)
    assert cut.tobytes().replace(b"\0", b"") == b"".join(texts)


def brute(rows, k=5):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    lengths = np.sqrt((x * x).sum(axis=1))
    out = []
    for q in np.flatnonzero(ids % 50 == 0):
        scores = x @ x[q] / (lengths * lengths[q])
        order = [i for i in np.lexsort((ids, -np.round(scores, 12))) if i != q][:k]
        out += [(int(ids[q]), n + 1, int(ids[i])) for n, i in enumerate(order)]
    return out


@pytest.mark.parametrize("block", [2048, 2])
def test_nearest(spark, block):
    vectors = table(spark, SF_DIR, "embeddings")
    found = ann.nearest_neighbours(vectors, F.col("vec_id") % 50 == 0, block=block).collect()
    expected = brute([(r.vec_id, r.embedding) for r in vectors.collect()])
    recall = len({(r.query_id, r.vec_id) for r in found} & {(q, i) for q, _, i in expected}) / len(expected)
    assert recall >= 0.9


def test_nearest_edges(spark):
    good = [(i, [float(i % 7 + 1), 1.0, float(i % 5)]) for i in range(60)]
    same = [(i, [1.0, 2.0, 3.0]) for i in range(100, 140)]
    odd = [(200, None), (250, [0.0, 0.0, 0.0]), (300, [float("nan"), 1.0, 1.0]), (350, [1.0, None, 1.0]),
           (400, [float("inf"), 1.0, 1.0]), (450, [1.0, 2.0]), (None, [1.0, 2.0, 3.0]), (500, [])]
    schema = "vec_id long, embedding array<double>"
    rows = good + same + good[:10]
    vectors = spark.createDataFrame(rows + odd, schema).selectExpr("*", "'x' as code", "'x' as rank", "0 as score")
    found = ann.nearest_neighbours(vectors, F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in found) == sorted(brute(good + same))
    assert ann.nearest_neighbours(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).collect() == []
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [-1e-200, 0.0])], schema)
    assert [(r.vec_id, r.score) for r in ann.nearest_neighbours(few, F.col("vec_id") == 0).collect()] == [(1, 0.0), (2, -1.0)]
