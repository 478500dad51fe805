"""A corpus pipeline of five stages; each stage's rows are written as Parquet and read again as the next one's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm import exact_dedup, jaccard_join, lang_id, mixing, packing
from tapewright.llm.store import finished, fresh, release, shared_dir, stage, staged


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what is told to be in one of the languages learned from the labelled rows, and fills in a null ``lang`` by
    what is told; a label that disagrees stays. Null, empty and letterless texts go, and those that score under the
    sample's rejection level: noise and other languages. With no labelled row, or one labelled language, texts with a
    letter stay; of over 512 languages the most frequent are learned. Rows that repeat stay or go together."""
    return lang_id.keep_known(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for blanks, the one with the longest original text, then the smallest id, stays. Null and
    empty texts are one group; a null id is the last choice; rows that repeat an id and a text stay once."""
    return exact_dedup.exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document of the smallest id stays. Texts without words are in no class and
    stay; rows of null id stay only where their class has no id; rows that repeat an id stay together."""
    return jaccard_join.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: its taken words by its size, rounded to whole texts. A document
    that is taken less than half goes. Texts without words, which have no share, go. Null is a source of its own. Rows
    that repeat an id share its takes equally."""
    size, times, key = fresh(docs, "size", "times", "id")
    taken = mixing.mix(docs.withColumn(size, mixing.word_count("text")), size_col=size)
    taken = taken.where("size > 0").groupBy(F.col("id").alias(key)).agg(F.round(F.sum("taken") / F.sum("size")).cast("int").alias(times))
    rows = docs.join(taken.where(F.col(times) > 0), F.col("doc_id").eqNullSafe(F.col(key)))
    return rows.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 2048 ids: one row a piece. A null or empty text is one piece, its end id;
    rows that repeat are packed as often."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: Language ID and packing have no SQL; tests/llm/test_pipeline.py compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, resume: str | None = None) -> DataFrame:
    """The last stage's rows. What a stage needed besides its result is removed once that is written. With ``resume``, a
    name for this run, stages that an earlier run of the name has finished are read, not done again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, function) in enumerate(STAGES):
        label = name.replace(" ", "-")
        folder = f"{shared_dir(spark).rstrip('/')}/{resume}/{n}-{label}" if resume else None
        if folder and finished(spark, folder):
            docs = spark.read.parquet(folder)
            continue
        mark = staged()
        rows = function(spark, docs, sf_dir)
        inner = staged()
        docs = stage(rows, label, folder)
        release(spark, mark, inner)
    return docs
