"""Corpus preparation: language ID, exact and near deduplication, secret scans, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm import exact, langid, ngram_join, packing, secrets
from clickloom.llm.common import documents, flagged, join_groups, row_of, written

#: A text of MIN_CHARS characters or more that is like no known language by MIN_COSINE is junk; shorter ones
#: say too little.  On the 10,000 documents of sf0.1 the least cosine of such a text is 0.14.
MIN_CHARS, MIN_COSINE = 100, 0.1


def restored(docs: DataFrame, found: DataFrame, new: dict[str, Column] | None = None) -> DataFrame:
    """The columns of ``docs`` out of the struct ``row``, some of them anew."""
    return found.select(*((new or {}).get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language, and long ones that are like none of the known ones (MIN_CHARS, MIN_COSINE).

    Where ``lang`` is null it becomes the prediction.  Null and empty texts, and others
    without a letter, go.  If no row tells a language, nothing can be predicted; then every text with a letter stays.
    Every row is decided by its own text, also where ids are null or repeated.  Ties between
    languages go to the first by name.  An empty table stays empty; further columns of any name are kept.
    """
    if langid.training_rows(docs).isEmpty():
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.identify(docs, whole=True).where((F.col("lang_pred") != "und") & ((F.col("score") >= MIN_COSINE) | (F.length("row.text") < MIN_CHARS)))
    return restored(docs, found, {"lang": F.coalesce(F.col("row.lang"), "lang_pred")})


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows equal but for the case of A-Z, one with the largest doc_id stays; null is the smallest.

    Null and empty texts are equal.  A row is known by its id and the SHA-256 of its text, so ids may be null or repeated.
    Of rows that repeat both, the one whose text comes first stays.  An empty table stays empty; further
    columns of any name are kept.  Only rows that a filter of fixed size can't tell from marked ones are shuffled.
    """
    at = lambda sha: F.concat_ws(":", F.col("doc_id").cast("long"), sha)
    groups = exact.exact_groups(docs).where("group_size > 1").groupBy(at(F.col("text_sha256")).alias("at"))
    marks = written(groups.agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("times")).where("not kept or times > 1").drop("times"), "exact-marks")
    told = flagged(docs.select(at(F.sha2(exact.normal("text"), 256)).alias("at"), row_of(docs).alias("row")), marks, "at")
    marked = told.where("_maybe").join(marks.hint("shuffle_merge"), "at", "left")
    out = told.where("not _maybe").select("row").unionByName(marked.where("kept is null").select("row"))
    if not marks.where("kept").isEmpty():
        out = out.unionByName(marked.where("kept").groupBy("at").agg(F.min_by("row", F.coalesce("row.text", F.lit(""))).alias("row")).select("row"))
    return restored(docs, out)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by five-word shingles with a similarity of 0.8, one with the smallest doc_id stays; null is the largest.

    Null and empty texts, and others without a word, are linked with nothing and stay.  Among rows of the same
    smallest id, the first one written stays.  The rows are written once with a key, and linked and
    dropped by it, so ids may be null or repeated.  An empty table stays empty; further columns of any name are kept.
    Only rows that a filter of fixed size can't tell from dropped ones are shuffled.
    """
    keyed = written(docs.select(F.monotonically_increasing_id().alias("key"), row_of(docs).alias("row")), "near-input")
    rows = keyed.select("key", F.col("row.doc_id").alias("own"), F.col("row.text").alias("text"))
    found = ngram_join.components(rows.select(F.col("key").alias("doc_id"), "text"), words=5, percent=80).select(F.col("doc_id").alias("key"), F.col("component_id").alias("group"))
    members = written(found.join(rows.select("key", "own"), "key"), "near-rows")
    first = F.min(F.struct(F.col("own").isNull().alias("none"), F.col("own"), F.col("key")))
    stay = members.groupBy("group").agg(first["key"].alias("stays"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    gone = written(join_groups(members.select("key", "group"), stay, ["group"], F.col("key").cast("string")).where("stays <> key").select("key"), "near-gone")
    told = flagged(keyed, gone, "key")
    out = told.where("not _maybe").select("row").unionByName(told.where("_maybe").join(gone.hint("shuffle_merge"), "key", "left_anti").select("row"))
    return restored(docs, out)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Overwrite secrets with asterisks, one for each character; no document goes.

    Spans that overlap are masked as one.  Every row is masked by the spans of its own text, also where
    ids are null or repeated; a null text stays null, an empty one empty.  An empty table stays empty;
    further columns of any name are kept.
    """
    found = secrets.scan(docs, whole=True)
    text = F.when(~F.col("no_text"), F.when(F.size("spans") > 0, secrets.masked(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    return restored(docs, found, {"text": text})


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens, as ``packing.pack_documents`` says: a row per piece, with its ids."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("ngram_jaccard", near_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]

#: Prediction, shingle links and packing are not SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
