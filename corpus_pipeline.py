"""A corpus pipeline: each stage reads what the stage before has kept, written as Parquet.

Language ID drops texts that have no language (null, or without letters). Line dedup rewrites the texts of documents with lines that repeat across
documents. The Jaccard join keeps one document of each group, that with the smallest id (rows without an id come last); documents without words are in no group and stay. Decontamination drops documents that hold
a benchmark item. Mixing takes documents so that sources meet their weights, and returns how often each is taken.

Extra columns are kept by all stages. Rows that repeat an id and its text are one document from the Jaccard join on; null and repeated ids are rows like others, told apart by their place in a
written table. Texts of any length are read whole. An empty table goes through all stages and gives no rows. Ties (a group's rows with one id, equal lengths in the mix) are broken by place and by hash."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suffixspark import session
from suffixspark.llm import decontaminate, jaccard, language, lines, mixing
from suffixspark.llm.rows import free_name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    languages = language.learn(docs.filter(~language.held_out(F.col("doc_id"), 5)))
    return language.predict(docs, languages).filter(F.col("lang_pred") != language.UNKNOWN).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(docs)
    new = {"text": F.when(F.col("row.text").isNotNull(), F.col("text")), "n_chars": F.length("text").cast("long")}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are numbered in a written table, so that those without an id, or with one that others have, are told apart."""
    row, copy, columns = free_name(docs, "row"), free_name(docs, "copy"), docs.columns
    numbered = session.cut(docs.withColumn(row, F.monotonically_increasing_id()))
    found = jaccard.groups(numbered.select(row, "text"), key=row).select(F.col("doc_id").alias("at"), "component_id")
    ids = numbered.select(F.col(row).alias("at"), F.col("doc_id").alias("id"))
    groups = found.join(ids, "at").groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at")).alias("first"), F.count("*").alias("rows"))
    several = session.cut(groups.filter("rows > 1").select("component_id", F.col("first.at").alias("first"), "rows"))
    copies = session.cut(jaccard.meet(found, several, "component_id").filter("at <> first").select(F.col("at").alias(copy)))
    few = copies.count() <= jaccard.SENT_ROWS
    return numbered.join(F.broadcast(copies) if few else copies, F.col(row) == F.col(copy), "left_anti").select(*[F.col(f"`{c}`") for c in columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = mixing.mix(docs, docs.columns).filter("times > 0")
    return out.select("row.*", *[F.col(c).alias(free_name(docs, f"mix_{c}")) for c in ("size", "target", "times", "taken")])


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("source_mix", source_mix)]

#: Language ID, groups and the knapsack have no SQL form: each stage and the whole are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. The tables of the stages before it, and what they cut, are deleted as soon as the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        folder = session.new_folder(spark, f"pipeline-{name}")
        with session.run(spark):
            stage(spark, docs, sf_dir).write.parquet(folder)
        if before:
            session.delete(spark, before)
        docs, before = spark.read.parquet(folder), folder
    return docs
