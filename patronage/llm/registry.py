"""The queries of the text operators, with production parameters, and the SQL of some."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.llm import (
    bit_sliced,
    chosen_path,
    compact_windows,
    decontaminate,
    four_russians,
    ngrams,
    packing,
    quality,
    recompression,
    shards,
    token_files,
    toxicity,
    tree_bpe,
    wrappers,
)
from patronage.llm.work import new_path, table, texts_of

BYTE_TOKENIZER = "byte_bpe_50k.json"
WORD_TOKENIZER = "word_bpe_49k.json"

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BENCH_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents through a file store, as read back."""
    path = new_path(spark, "token-files")
    docs = table(spark, sf_dir, "documents")
    token_files.write_tokens(docs, path, public_tokenizers.path(BYTE_TOKENIZER))
    return token_files.read_tokens(spark, path, ids=False)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of the toxicity categories of all documents, and the decision."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labelled = toxicity.labelled_documents(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, toxicity.fit(labelled, toxicity.CATEGORIES)).drop("text")
    return found.withColumn("toxic", F.col("p_toxic") >= toxicity.THRESHOLD)


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards whose row counts differ by one at most, in random order."""
    placed = shards.shuffle_to_shards(table(spark, sf_dir, "documents"), 24)
    text = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    return placed.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest scores of every 50th vector against all others."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", bit_sliced.quantised().alias("q"))
    return bit_sliced.top_k(rows, rows.where("vec_id % 50 = 0"), 5)


OP4_SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
           FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT a.vec_id AS query_id, b.vec_id,
                  CAST(list_sum([p[1] * p[2] FOR p IN list_zip(a.q, b.q)]) AS BIGINT)
                      AS score
           FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
                            AND len(a.q) = len(b.q)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)
                          AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fifth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    held_out = F.coalesce(fifth, F.lit(False)).alias("held_out")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    labelled = ngrams.with_labels(docs, labels.where(~held_out))
    found = quality.score(docs, quality.fit(labelled))
    predicted = (F.col("score") >= 0.3).cast("int").alias("predicted")
    return found.select("doc_id", held_out, "score", predicted)


def op6_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents' ids and of what they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path(WORD_TOKENIZER)
    both = tree_bpe.decode(tree_bpe.encode(docs, path).drop("text"), path)
    listed = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return both.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has too, or nearly."""
    return compact_windows.repeated_passages(table(spark, sf_dir, "documents"))


def op8_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    found = wrappers.main_text(table(spark, sf_dir, "pages"))
    n_chars = F.length("text").cast("bigint").alias("n_chars")
    return found.select("page_id", "url", "text", n_chars)


def op9_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents by three-word shingles at a similarity of 0.85."""
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"), 3, 85)


_SPACED = "'[^\\x20\\x09-\\x0D]+'"
OP9_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPACED}) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_distinct([array_to_string(w[i:i + 2], ' ')
                                 FOR i IN generate_series(1, len(w) - 2)]) END AS s FROM w),
f AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m, count(*) AS k
           FROM f a JOIN f b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * k >= 85 * (n + m - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents
          UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM s JOIN least USING (doc_id)
"""


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document stands in benchmark items, and in which."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_passages(docs, table(spark, sf_dir, "benchmark"))
    items, n_hit = decontaminate.item_ids(), decontaminate.n_hit()
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OP10_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_BENCH_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_BENCH_WORDS} AS w FROM benchmark
      WHERE item_id IS NOT NULL),
sized AS (SELECT item_id, w, least(10, len(w)) AS n FROM i WHERE len(w) > 0),
passages AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS passage
             FROM sized, unnest(generate_series(1, len(w) - n + 1)) AS t(p)),
sizes AS (SELECT DISTINCT n FROM passages),
places AS (SELECT r, p, n, array_to_string(w[p:p + n - 1], ' ') AS passage
           FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p
                 FROM d, sizes WHERE len(w) >= n)),
met AS (SELECT r, p, places.n, item_id FROM places JOIN passages USING (n, passage)),
hit AS (SELECT r, count(DISTINCT k) AS n_hit
        FROM (SELECT r, unnest(generate_series(p, p + n - 1)) AS k FROM met) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS listed
          FROM (SELECT DISTINCT r, item_id FROM met) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""


def op11_four_russians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of the five positives of every 50th vector."""
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", label.alias("label"), bit_sliced.quantised().alias("q")
    )
    return four_russians.hard_negatives(rows, F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
                  CAST(list_sum([p[1] * p[2] FOR p IN list_zip(a.q, b.q)]) AS BIGINT) AS score
           FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
                            AND len(a.q) = len(b.q)),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
                     row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
              FROM scored WHERE same QUALIFY place <= 5),
negatives AS (SELECT anchor_id, positive_id, s.vec_id AS negative_id, positive_score,
                     s.score AS negative_score,
                     CAST(row_number() OVER (PARTITION BY anchor_id, place
                                             ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
              FROM positives JOIN scored s USING (anchor_id)
              WHERE NOT s.same AND 50 * positive_score <= 100 * s.score
                AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= 3
"""


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeating(doc_id: int | None, text: str) -> str:
    """The text, for one document in ten with its words repeating from some place on."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    words = _WORD.findall(text) if h % 10 == 0 else []
    if not words:
        return text
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return " ".join(words[:a] + (period * (-(-(n - a) // p)))[: n - a])


def _repeating(batch: pa.RecordBatch) -> pa.Array:
    ids = batch.column("doc_id").to_pylist()
    return pa.array(map(repeating, ids, texts_of(batch)), pa.string())


def op12_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of all documents, some made to repeat, and what is left without."""
    found = recompression.find_runs(table(spark, sf_dir, "documents"), _repeating)
    listed = F.array_join(
        F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r.start, r.length, r.period)), ""
    )
    # of the longest, the first
    best = F.array_max(
        F.transform(
            "runs",
            lambda r: F.struct(
                r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period")
            ),
        )
    )
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length DIV -best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2 048 tokens."""
    docs = table(spark, sf_dir, "documents")
    packed = packing.pack(docs, public_tokenizers.path(BYTE_TOKENIZER))
    piece = packed.select("sequence_id", F.explode("pieces").alias("piece"))
    return piece.select("sequence_id", "piece.*")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_token_files,
            op2_toxicity,
            op3_shards,
            op4_bit_sliced_top_k,
            op5_quality,
            op6_tree_bpe,
            op7_compact_windows,
            op8_wrappers,
            op9_chosen_path,
            op10_decontaminate,
            op11_four_russians,
            op12_recompression,
            op13_packing,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_bit_sliced_top_k": OP4_SQL,
        "op9_chosen_path": OP9_SQL,
        "op10_decontaminate": OP10_SQL,
        "op11_four_russians": OP11_SQL,
    }
