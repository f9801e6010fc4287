"""Corpus pipeline: five stages over documents, each calling one operator of ledgerlens.llm.

Each stage takes (spark, docs, sf_dir); run() writes its result as Parquet into the shared folder and hands it, read again, to
the next. All but the last return the columns of documents.

Cases: rows with equal ids are judged by id and text in the rules, one by one in the classifier, and one of them stays
in near-duplicate removal; null ids pass that stage; a document of which suffix dedup leaves nothing goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import small, stored, table, text_or_empty
from ledgerlens.llm.near_dup import near_duplicate_classes
from ledgerlens.llm.packing import packed_documents
from ledgerlens.llm.quality_cotrain import fit, keep_good
from ledgerlens.llm.quality_rules import judge
from ledgerlens.llm.suffix_dedup import dedup_texts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the outlier test reject."""
    keyed = docs.select(*COLUMNS).withColumn("row_key", F.xxhash64("doc_id", text_or_empty("text"), "lang", "source"))
    judged = judge(keyed, keep=("row_key",))
    rejected = stored(judged.filter("not kept").select("row_key").distinct())
    return keyed.join(small(rejected, rejected.count()), "row_key", "left_anti").select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps. It is fitted on labelled rows of all documents: among those that the
    rules have left there are too few bad ones to learn from."""
    return keep_good(docs.select(*COLUMNS), fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate class."""
    chosen = docs.select(*COLUMNS)
    classes = stored(near_duplicate_classes(chosen))
    others = classes.filter("doc_id <> class_id").select("doc_id").distinct()
    left = chosen.join(small(others, others.count()), "doc_id", "left_anti").select(*COLUMNS)
    repeated = classes.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    n = repeated.count()
    if not n:
        return left
    repeated = small(repeated, n)
    return left.join(repeated, "doc_id", "left_anti").unionByName(left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that an earlier document has."""
    kinds = dict(docs.dtypes)
    cleaned = dedup_texts(docs, ("lang", "source")).filter(F.length("text") > 0)
    return cleaned.withColumn("n_chars", F.length("text").cast(kinds["n_chars"])).withColumn("doc_id", F.col("doc_id").cast(kinds["doc_id"])).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their sequence and place."""
    return packed_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", suffix_dedup),
    ("packing", packing),
]

#: No SQL can state the fitted stages; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
