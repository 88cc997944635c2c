"""Registered queries of this package and their SQL, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from logvigil.llm.ann import nearest_neighbours
from logvigil.llm.decontaminate import contamination
from logvigil.llm.filter_audit import filter_audit
from logvigil.llm.jaccard_join import jaccard_components
from logvigil.llm.language import identify
from logvigil.llm.line_dedup import dedup_lines
from logvigil.llm.near_dedup import near_duplicates
from logvigil.llm.ngram_model import score_texts
from logvigil.llm.packing import pack_documents
from logvigil.llm.passages import repeated_passages
from logvigil.llm.pii import personal_data_digest
from logvigil.llm.spelling import spelling_variants, word_counts
from logvigil.llm.stages import table
from logvigil.llm.token_counts import token_counts

WORD_BPE = "word_bpe_49k.json"


def _tokenizer() -> str:
    return public_tokenizers.path(WORD_BPE)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at 80 % of four-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80).drop("set_key")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), _tokenizer())


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that stays of each document, and the numbers of the lines it loses."""
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", "dedup.n_lines", "dedup.n_removed", "dedup.removed")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_digest(table(spark, sf_dir, "documents")).drop("scores")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), _tokenizer())


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of seven letters or more with the misspellings the contract plants."""
    return spelling_variants(word_counts(table(spark, sf_dir, "documents"), 7, 2, drop_every=31), ratio=10)


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at 85 % of four-word shingles."""
    return jaccard_components(table(spark, sf_dir, "documents"), size=4, percent=85)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_near_dedup, op2_substring_dedup, op3_decontamination, op4_lm_scores, op5_nearest,
        op6_packing, op7_line_dedup, op8_pii, op9_token_counts, op10_language,
        op11_spelling_variants, op12_jaccard_join, op13_filter_audit,
    )
}

#: The others cannot be said in SQL (learned models, tokenizer files, components, alignments)
#: or only too slowly on whole tables; their tests compare with brute force.
STATEMENTS: dict[str, str] = {
    "op1_near_dedup": """
        WITH RECURSIVE d AS (
          SELECT doc_id, regexp_extract_all(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS shingle
              FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM d WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
                   FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
                  WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)),
        ends AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM ends
                  UNION SELECT r.doc_id, e.b FROM reach r JOIN ends e ON e.a = r.other),
        found AS (SELECT doc_id, min(other) AS component FROM reach GROUP BY doc_id)
        SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles,
               coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
        FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN found USING (doc_id)
    """,
    "op3_decontamination": """
        WITH d AS (SELECT doc_id, regexp_extract_all(
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
                   FROM documents),
        b AS (SELECT item_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        items AS (SELECT DISTINCT item_id, least(13, len(w)) AS n,
                    array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS gram
                  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i
                        FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM items),
        runs AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
                 FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
                       FROM d, sizes WHERE len(w) >= n)),
        hits AS (SELECT r.doc_id, r.i, r.n, x.item_id FROM runs r JOIN items x ON x.gram = r.gram AND x.n = r.n),
        places AS (SELECT doc_id, count(DISTINCT p) AS n_hit
                   FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
        found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
                  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words,
               CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(listed, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
        FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
    """,
    "op5_nearest": """
        WITH v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
        pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
                  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r
                   FROM pairs)
        SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
    """,
    "op12_jaccard_join": """
        WITH RECURSIVE d AS (
          SELECT doc_id, regexp_extract_all(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS shingle
              FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM d WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
                   FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
                  WHERE 100 * shared.n >= 85 * (x.n + y.n - shared.n)),
        ends AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM ends
                  UNION SELECT r.doc_id, e.b FROM reach r JOIN ends e ON e.a = r.other),
        found AS (SELECT doc_id, min(other) AS component FROM reach GROUP BY doc_id)
        SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles,
               coalesce(component, d.doc_id) AS component_id
        FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN found USING (doc_id)
    """,
    "op13_filter_audit": """
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                     regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        m AS (SELECT doc_id, part,
                CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
                + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
                + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
                + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
                + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM d),
        l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
                max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
        tallies AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
                    FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
        f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
        orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
                   FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
                     AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
        steps AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
                  FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM orders)),
        found AS (SELECT part, filter_order, step, bit,
              sum(CASE WHEN mask & (bit | before) = 0 THEN n ELSE 0 END) AS kept,
              sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
              sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant,
              sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
              sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
              sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
            FROM tallies, steps GROUP BY ALL)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
               CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
               CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
               CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM found
    """,
}
