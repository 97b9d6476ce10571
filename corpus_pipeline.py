"""Corpus pipeline over ``documents``: language, near duplicates, repeated passages, test leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that ``run``
writes as Parquet in the shared folder and reads again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattlake.llm.decontaminate import contamination
from wattlake.llm.jaccard_join import marked_join
from wattlake.llm.language_id import identify, train
from wattlake.llm.packing import pack_documents
from wattlake.llm.queries import tokenizer_path
from wattlake.llm.shared import Scratch, table
from wattlake.llm.substring_dedup import substring_dedup

#: A document whose best language is less likely than this is rejected.
LEAST_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with letters whose language is told with at least an even chance.

    Null texts, empty ones and those without a letter go; where no row names a
    language, only these go. Rows are decided one by one, so repeated ones, null
    ids and other columns do not matter. No rows give none.
    """
    model = train(docs)
    told = identify(docs, model)
    keep = F.col("lang_pred") != "und"
    if model.langs:
        keep &= F.col("lang_score") >= LEAST_LANGUAGE_SCORE
    else:  # no row names a language: only texts without a letter go
        keep = F.col("text").rlike(r"\p{L}")
    return told.where(keep).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: the smallest doc_id.

    Documents are told by doc_id and text: different texts of one doc_id are
    documents of their own, of rows equal in both one stays (the least by a hash
    of the other columns; any of those that tie). Rows without doc_id link to
    nothing and all stay, and so do null and empty texts. No rows give none.
    """
    scratch = Scratch(spark)
    groups = marked_join(docs, scratch=scratch).where("doc_id is not null")
    linked, alone = groups.where("group is not null"), groups.where("group is null and mark is not null")
    first = linked.groupBy("group").agg(F.min(F.struct("doc_id", "mark")).alias("first")).select("first").union(alone.select(F.struct("doc_id", "mark")).distinct())
    keep = scratch.write(first.select(F.col("first.doc_id").alias("k1"), F.col("first.mark").alias("k2")), "kept")
    scratch.keep("kept")
    mark = F.xxhash64("text")
    rows = docs.where("doc_id is not null").select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("k1"), mark.alias("k2"))
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    one = rows.join(keep.hint("merge"), ["k1", "k2"]).groupBy("k1", "k2").agg(F.min_by("row", F.xxhash64(*[F.col(f"row.`{c}`") for c in plain])).alias("row"))
    return one.select("row.*").union(docs.where("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that stand in an earlier document; texts left without a word go.

    n_chars, where there is one, is counted anew. Rows without doc_id, with a
    null or empty text, or whose doc_id stands with different texts stay as they
    are; equal rows are cut alike. No rows give none.
    """
    cut = substring_dedup(docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("_doc")))
    kept = cut.where((F.col("words_removed") == 0) | F.col("text").rlike(r"\S"))

    def column(c: str):
        own = F.col("text") if c == "text" else F.col(f"_doc.`{c}`")
        if c == "n_chars":
            own = F.when(F.col("words_removed") > 0, F.length("text")).otherwise(own).cast(docs.schema[c].dataType)
        return own.alias(c)

    return kept.select(*[column(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a test item of ``benchmark``.

    Documents are told by doc_id and text; of one doc_id only the texts with an
    item go. Rows without doc_id are looked at as well. Null and empty texts and
    all rows beside an empty benchmark stay; no rows give none.
    """
    scratch = Scratch(spark)
    row = F.xxhash64("doc_id", "text")
    found = contamination(docs.select(row.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"), scratch=scratch)
    found = scratch.write(found.select(F.col("doc_id").alias("_row")).distinct(), "contaminated")
    scratch.keep("contaminated")
    kept = docs.select(F.struct(*docs.columns).alias("_doc"), row.alias("_row")).join(found.hint("merge"), "_row", "left_anti")
    return kept.select("_doc.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences; null and empty texts are one end token each, no rows give none."""
    return pack_documents(docs, tokenizer_path())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("decontaminate", decontaminate), ("packing", packing)]

#: Learned weights, sampled paths and packed bins are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        scratch.keep(name)
    return docs
