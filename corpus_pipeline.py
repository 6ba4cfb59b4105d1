"""Training-corpus pipeline: each stage works on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.
Empty tables give empty results; null and empty texts pass the filters that find nothing in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from creditloom.llm.common import free_names, row_key
from creditloom.llm.decontaminate import contamination
from creditloom.llm.lines import dedup_lines, without_lines
from creditloom.llm.near import near_classes
from creditloom.llm.pack import pack
from creditloom.llm.quality import fit, quality
from creditloom.llm.scratch import materialize, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    scored, (_, predicted) = quality(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.filter(F.col(predicted) == 1).select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are similar to an earlier one; a document keeps its row."""
    marked, (removed,) = dedup_lines(docs)
    text = without_lines("text", removed)
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(removed).isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long"))
    return marked.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near copies."""
    classes = near_classes(docs)
    heads = materialize(classes.filter("k_id = class_id and k_text = class_text").select("k_id", "k_text").distinct(), "kept")
    a, b = free_names(docs, ["k_id", "k_text"])
    keys = row_key("doc_id", "text")
    kept = docs.select("*", keys[0].alias(a), keys[1].alias(b)).join(heads.toDF(a, b), [a, b], "left_semi")
    return kept.dropDuplicates([a, b]).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark passage occurs."""
    found, names = contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(~F.col(names[-1])).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, with their places in sequences."""
    return pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("near dedup", keep_one_of_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]

#: The classifier, the sampling and the packing cannot be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
