"""From raw documents to token ids: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a frame; `run` writes it and reads it again as
the next one's documents. Labels and benchmark items come from the tables in `sf_dir`. Executors
live through all stages and their memory fills up, so texts reach Python in small batches.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.llm import chosen_path, compact_windows, decontaminate, toxicity, tree_bpe
from patronage.llm.work import sifted, small_batches, table, written

WORD_TOKENIZER = "word_bpe_49k.json"
# Near-duplicates share four fifths of their five-word shingles.
SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80


def beside(docs: DataFrame, names: list[str]) -> DataFrame:
    """The documents with columns of these names called otherwise, where an operator adds its own."""
    taken = {*docs.columns, *names}
    for name in names:
        if name in docs.columns:
            other = f"{name}_"
            while other in taken:
                other += "_"
            taken.add(other)
            docs = docs.withColumnRenamed(name, other)
    return docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not find toxic; rows without a text stay."""
    small_batches(spark)
    labelled = toxicity.labelled_documents(docs, table(spark, sf_dir, "labels"))
    chain = toxicity.fit(labelled, toxicity.CATEGORIES)
    own = beside(docs, [f"p_{c}" for c in toxicity.CATEGORIES])
    kept = toxicity.score(own, chain).where(F.col("p_toxic") < toxicity.THRESHOLD)
    return kept.select(*own.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near-duplicates, once if its row repeats.

    Rows of one id and text are one document, of which the least row stays; another text under
    the same id stays beside it. Documents without words and rows without an id are in no group and
    stay.
    """
    small_batches(spark)
    found = chosen_path.near_duplicates(
        docs.select("doc_id", "text"), SHINGLE_WORDS, SIMILAR_PERCENT
    )
    per_id = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.bool_or("kept").alias("kept"), F.count("*").alias("n")
    )
    per_id = written(per_id, "kept")
    left_out = per_id.where("NOT kept OR n > 1").select("doc_id")
    more = per_id.where("kept AND n > 1").select("doc_id")
    some, alone = sifted(docs, left_out)
    rest = alone.union(some.join(left_out, "doc_id", "left_anti").select(*docs.columns))
    repeated = sifted(docs, more)[0].join(more, "doc_id", "left_semi")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    least = repeated.groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("least"))
    one = least.select("doc_id", "text", "least.*").select(*docs.columns)
    return rest.select(*docs.columns).union(one)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; `n_chars` follows the text."""
    small_batches(spark)
    passages = written(compact_windows.repeated_passages(docs), "passages")
    cut = compact_windows.without_repeats(docs, passages)
    n_chars = F.coalesce(F.length("text").cast("bigint"), F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no passage of a benchmark item stands."""
    small_batches(spark)
    own = beside(docs, ["n_words", "hits"])
    found = decontaminate.find_passages(own, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("hits") == 0).select(*own.columns).toDF(*docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`doc_id`, `lang`, `source`, `ids`, `n_tokens` and the digest of the decoded text."""
    small_batches(spark)
    path = public_tokenizers.path(WORD_TOKENIZER)
    encoded = tree_bpe.encode(docs.select("doc_id", "lang", "source", "text"), path)
    return tree_bpe.decode(encoded.drop("text"), path).select(
        "doc_id",
        "lang",
        "source",
        "ids",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("bpe", to_tokens),
]

# Classifiers, compact windows and tokenizers have no SQL; tests check the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
