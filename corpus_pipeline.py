"""Corpus pipeline: documents to deduplicated, decontaminated, mixed and tokenized training data.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as
the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import materialize, shielded
from panelspark.llm.decontam import without_benchmark
from panelspark.llm.langid import held_out, identify, train, training_sample
from panelspark.llm.mixing import mixture, word_count
from panelspark.llm.simhash import one_of_each
from panelspark.llm.tokens import token_output

#: Share of its letters that a document's language must have.
LEAST_SHARE = 0.4

#: SQL cannot express the learned, hashed and drawn stages; their tests hold them to brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those in which no language has ``LEAST_SHARE`` of the letters.

    Null texts go, as do empty ones. Repeated rows and rows without an id fare like any other. Where no
    labelled document is there to learn from, nothing can be judged and all documents stay.
    """
    model = train(training_sample(docs.where(~held_out()).select("lang", "text")))
    if not model.languages:
        return docs
    away, back = shielded(docs, "text")
    known = identify(away, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE))
    return known.drop("lang_pred", "score").withColumnsRenamed(back).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies (five words, similarity 0.8).

    Rows without an id stand last in a group; of rows equal in id and text one stays. Null and wordless
    texts are copies of one another.
    """
    return one_of_each(docs, words=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold ten consecutive words of a benchmark item, or a whole shorter item.

    Null texts hold none and stay; repeated rows and rows without an id fare like any other.
    """
    return without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents in the target proportions of their sources; a document may come twice.

    Null sources form one source; repeated rows are rows of their own; a null text has no words.
    """
    away, back = shielded(docs, "doc_id", "source", "text")
    mixed = mixture(away.withColumn("size", word_count(F.col("text"))))
    return mixed.drop("size", "shard").withColumnsRenamed(back).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token blocks and their key index, and returns what they hold: doc_id, start, n_tokens, ids_crc32.

    A null text counts as empty; null ids come first; rows of one id stand together, in order of a hash of the text.
    """
    # Executors already hold what earlier stages left in their heaps: less memory here, for more time.
    return token_output(docs, slice_chars=4 << 20, kept=50_000)


STAGES = [("language ID", language_id), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("mixing sources to target weights", mix), ("token-ID / binary output", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's output is stored in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
