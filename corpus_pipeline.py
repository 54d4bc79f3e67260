"""From raw documents to packed training sequences, in four stages.

Language ID drops texts without a language, the quality classifier those that it
rejects, the similarity join keeps one document of each group of near copies, and
packing turns the rest into token sequences. Each stage reads all that the one
before kept. Stages before the last return the columns of documents as they came.

Cases: repeated rows of one document count as copies, of which one stays; rows of
one id with different texts are documents of their own; rows without an id stay
only if no row with one has a similar text; null and empty texts have no language
and go; an empty table passes through; columns whose names the operators use as
well are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.llm import jaccard, language, packing, quality
from fieldglass.llm.common import filtered, id_fold, small_batches, text_or_empty
from fieldglass.llm.queries import TOKENIZER, tokenizer_file
from fieldglass.store import job, stored

LEAST_CONFIDENCE = 0.5

#: SQL can't express the classifiers or the tokenizer; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language that the model is sure of."""
    small_batches(spark)
    key = F.md5(text_or_empty())
    with job(spark, "language-stage") as result:
        found = language.identify(docs.select(key.alias("_key_of_text"), "text"), language.train(docs), ("_key_of_text",))
        sure = result(found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_CONFIDENCE)).select("_key_of_text").distinct())
    return docs.withColumn("_key_of_text", key).join(sure, "_key_of_text", "left_semi").select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels of the training fold, accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(id_fold("doc_id", 5) != 0)
    small_batches(spark)
    model = spark.sparkContext.broadcast(quality.train(docs, labels))
    return filtered(docs, "text", lambda: lambda texts: (model.value.scores(quality.statistics(texts)) >= quality.THRESHOLD).tolist())


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are similar by 0.8 or more: that of the smallest id.

    Rows are told apart by a hash of their id and text and, where these are equal,
    by one of their other columns; ties go to the smaller hash.
    """
    small_batches(spark)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    keyed = docs.withColumns({"_key": F.xxhash64("doc_id", text_or_empty()), "_others": F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0)})
    linked = jaccard.linked_components(keyed.select(F.col("_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("_key"), "component_id").distinct()
    rows = stored(keyed.select("_key", "_others", "doc_id"), "rows")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_key", "_others")
    kept = stored(rows.join(stored(linked, "linked"), "_key").groupBy("component_id").agg(F.min(first).alias("m")).select("m._key", "m._others"), "kept")
    found = keyed.join(kept, ["_key", "_others"], "left_semi")
    repeated = stored(rows.groupBy("_key", "_others").agg(F.count("*").alias("n")).filter("n > 1").join(kept, ["_key", "_others"], "left_semi").select("_key", "_others"), "repeated")
    if repeated.isEmpty():
        return found.select(*docs.columns)
    once = found.join(repeated, ["_key", "_others"], "left_semi").dropDuplicates(["_key", "_others"])
    return found.join(repeated, ["_key", "_others"], "left_anti").select(*docs.columns).union(once.select(*docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids in sequences, a row for each piece."""
    small_batches(spark)
    return packing.pack_documents(docs, tokenizer_file(TOKENIZER))


STAGES = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
