"""From documents to token ids: five stages, each a table that the next one reads.

Documents that the quality rules or the language identification reject go, one
document of each group of near duplicates stays, the sources are mixed to their
target weights, and what the mix takes is encoded.

Every stage takes NULLs in any column, texts of any length, repeated rows, tables
without rows and further columns, which it keeps as they are (the last returns its
own columns only); what becomes of such rows is said at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm import language, mixing, repetition, similar, subwords
from veilwork.llm.tables import Workspace, held_out, read

TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the repetition rules.  NULL, empty and short texts do not; repeated rows pass or go alike."""
    return repetition.good(docs)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, by a network trained on the labelled ones outside the held-out fold.

    NULL and letterless texts go, and all do where no row names its language; of
    equally likely languages the first by name counts.
    """
    model = language.fit(docs.where(~held_out(F.col("doc_id"), language.FOLDS, language.FOLD)))
    return language.known_language(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id (NULL first).

    Texts without words, NULL included, are nobody's duplicates and all stay.
    """
    return similar.deduplicated(docs)


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, repeated as often as it takes them.

    Texts without words, NULL included, have size 0 and are mixed like others,
    adding no words; rows without a source are one source, the last.
    """
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_pieces, ids, round_trip`` of every document; NULL and empty texts have no ids."""
    return subwords.encoded(docs, subwords.Vocabulary.load(TOKENIZER))


STAGES = [
    ("quality rules", quality),
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_each),
    ("mixing sources", target_mix),
    ("SentencePiece", token_ids),
]

#: Training and similarity have no SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, each written as Parquet and read again."""
    work = Workspace(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for nth, (_, stage) in enumerate(STAGES):
        docs = work.save(stage(spark, docs, sf_dir), f"stage-{nth}")
    return docs
