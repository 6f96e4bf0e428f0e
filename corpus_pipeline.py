"""From raw documents to training sequences: language ID, line dedup, near-duplicate removal, mixing, packing.

Odd rows, stage by stage. Null texts and texts without a letter have no language and go in the first stage. Empty texts
that line dedup leaves behind are similar to nothing, are not taken by the mix, which counts words, and so end there.
Rows that repeat an id lose the same lines and stay or go together; repeated texts under different ids are copies, of which
the smallest id stays. Rows without an id are nobody's copy and stay. A null source is a source of its own. Long texts pass like any other.
An empty table gives an empty one at every stage. Extra columns are carried up to the mix, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from resaleworth.llm import jaccard_join, language, line_dedup, mixing, packing
from resaleworth.llm.text import text_session
from resaleworth.session import materialise

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def small_batches(spark: SparkSession) -> SparkSession:
    """The library's settings. Python workers outlive their stage, so five stages in a row leave less to each batch."""
    text_session(spark).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2m")
    return spark


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the classifier learns from their labels. ``lang`` stays the label."""
    small_batches(spark)
    found = language.identify_language(docs, language.fit_languages(docs))
    return found.where("not rejected").select(*docs.columns)


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more share stay in one of them; a text that loses all of them is left empty."""
    small_batches(spark)
    return line_dedup.drop_common_lines(docs).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: five words to a shingle, similarity of 0.8 or more."""
    small_batches(spark)
    return jaccard_join.keep_one_per_group(docs, words=5, threshold=0.8)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    small_batches(spark)
    return mixing.mix_sources(docs, weights=(5, 2, 1), share=1.5, most_copies=2)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences, with their token ids."""
    small_batches(spark)
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_common_lines),
    ("ngram_jaccard_join", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

# Learned dictionaries and a tokenizer take part, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each stored before the next one reads it."""
    docs = small_batches(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
