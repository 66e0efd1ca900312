"""A corpus pipeline of five stages over documents, each an operator of bindery.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents; other columns of the input, whatever
their names, are not carried. Null texts are empty texts, null ids are no smaller than any other, repeated rows
are rows, and an empty table gives an empty table; each stage says what that means for it.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm import mixing, pieces, quality, simhash, substrings
from bindery.llm.common import shared_folder, ship, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts: a score of 0.3 or more. Null and empty texts are scored like any other; equal texts
    have equal scores, so copies stay or go together; without labels every score is 0.5 and all stay."""
    ship(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), model, carry=True).filter(quality.predicted() == 1).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard at least 0.8), the one of the smallest id.

    op4's contract (three words, two bits) binds that query alone; the stage runs the operator's bit-sliced comparison at a
    radius wide enough for likeness 0.8, and takes a link only where the shingles of the two texts confirm it. Of rows that repeat
    an id and a text one stays; null and wordless texts are one group; null ids come last.
    """
    ship(spark)
    return simhash.one_of_each_near_copy(docs.select(*COLUMNS))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows of 13 words that a smaller document has too; texts that lose nothing stay as they were, those that
    lose all are empty. Rows of one id never take from each other, a null id is larger than all. n_chars follows the text."""
    ship(spark)
    kept = substrings.dedup_substrings(docs.select(*COLUMNS), spaced=False)
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, so a row may come up to three times. Texts without words are never taken; a null
    source is a source; rows that repeat an id and text are taken alike."""
    return mixing.mixed(docs.select(*COLUMNS))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents and the piece ids of the text; a null text has none."""
    ship(spark)
    return pieces.encode(docs.select(*COLUMNS), public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

#: No SQL: fingerprints, hash thresholds and pieces aren't expressible; a test holds run() against a version from scratch in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is Parquet in the shared folder."""
    docs, folder, last = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(at := f"{folder}/{k}")
        docs = spark.read.parquet(at)
        if last:
            path = spark._jvm.org.apache.hadoop.fs.Path(last)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        last = at
    return STAGES[-1][1](spark, docs, sf_dir)
