"""From raw documents to a training mix: stages that each read what the one before wrote.

Every stage takes any documents: null, empty and very long texts, null and repeated ids, rows that repeat as a whole,
columns of any other name, and none at all; what each does with them stands in its docstring and its operator's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, linededup, mixing, quality, simhash
from tidemark.llm.common import all_columns, table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that a rule rejects go, null, empty and short texts among them; rows that repeat are judged alike."""
    return quality.quality_filter(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: lines that an earlier one goes before leave the texts; documents of which no line stays go.

    Texts without a line (null, blank) stay as they are; rows that repeat an id and a text are one document and keep the
    same lines; null ids come last.  ``n_chars`` follows the text where lines went.
    """
    out = linededup.dedup_lines(docs).filter("n_kept > 0 or n_lines = 0")
    changed = F.col("n_kept") < F.col("n_lines")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*all_columns(docs))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each group of near copies the document with the smallest id stays, null ids last.

    Null and blank texts are copies of each other; rows that repeat an id and a text stay or go together, those without
    an id count each.
    """
    return simhash.keep_one(docs)


def decontaminate_docs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a test item go, by row and not by id; null and empty texts hold none."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: the documents that the mix takes, all columns as they were, and ``copies``, how often each.

    Texts without a word go; the null source is one; rows that repeat draw each for itself; a column named copies gives way.
    """
    return mixing.mix_documents(docs)


STAGES = [
    ("quality_rules", keep_quality),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_near),
    ("decontamination", decontaminate_docs),
    ("mix_sources", mix),
]

#: SimHash needs XXH64, which DuckDB's SQL lacks; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
