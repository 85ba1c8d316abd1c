"""A corpus pipeline: language identification, exact and near dedup, redaction of personal data, packing.

Every stage works on what the stage before it kept and is written as Parquet in between.  Stages but the last return
the columns of the documents they get.  A document without a recognisable language goes; of equal texts and of each
near-duplicate component one document stays; personal data is replaced by its kind in brackets (n_chars follows); the
rest is packed into sequences, one row per piece.

Defined cases are those of the operators.  Rows are told apart by id and text, so an id that repeats with another text
is another document; rows that repeat an id and a text are one document after exact dedup; a row with a null id is never
a near duplicate and stays.  Of equal texts the longest, then the smallest id stays, of a near-duplicate component the
smallest id.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickfeat.llm import exact, langid, near, packing, pii
from clickfeat.llm.queries import held_out, vocabulary
from clickfeat.session import new_folder, stored

# Rows of a list of dropped documents (a number and a word each) that is broadcast; a longer one is joined by exchange.
BROADCAST_FLAGS = 5_000_000

# Texts of one Arrow batch lie in the executor's memory beside its heap, and in the Python worker, on the way there and back.
BATCH_ROWS = 1_000
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches to ``BATCH_ROWS`` texts in this session; a smaller setting stays."""
    now = int(spark.conf.get(BATCH_CONF, "10000"))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = langid.train(docs.filter(~held_out(F.col("doc_id"))))
    tagged = langid.tag_rows(docs, model)
    return tagged.filter(F.col("tag.lang_pred") != langid.UNDETERMINED).select("row.*")


def row_key() -> Column:
    """A hash of id and text stands for a row where ids repeat with other texts; null without an id."""
    return F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))


def without(docs: DataFrame, key: Column, flags: DataFrame) -> DataFrame:
    """Rows without a flag, and one row of each key flagged ``twice``; the list is broadcast if it is counted small."""
    flags = stored(flags, "flags")
    flags = F.broadcast(flags) if flags.count() <= BROADCAST_FLAGS else flags
    marked = docs.withColumn("__key", key).join(flags.select("__key", "__flag"), "__key", "left")
    once = marked.filter(F.col("__flag") == "twice").dropDuplicates(["__key"])
    left = marked.filter(F.col("__flag").isNull()).unionByName(once)
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    groups = exact.exact_groups(docs.select(key.alias("id"), "text"), id_col="id").select(F.col("doc_id").alias("__key"), "text_sha256")
    copies = stored(groups.groupBy("__key", "text_sha256").agg(F.count(F.lit(1)).alias("n")), "copies")
    facts = docs.select(key.alias("__key"), "doc_id", F.length(F.coalesce("text", F.lit(""))).alias("size")).distinct()
    first = F.min(F.struct((-F.col("size")).alias("s"), F.col("doc_id").isNull().alias("z"), "doc_id", "__key"))
    best = copies.join(facts, "__key").groupBy("text_sha256").agg(first.alias("best"))
    judged = copies.join(best, "text_sha256")
    flag = F.when(F.col("__key") != F.col("best.__key"), "gone").when(F.col("n") > 1, "twice").alias("__flag")
    return without(docs, key, judged.select("__key", flag).filter("__flag is not null"))


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    groups = near.near_groups(docs.select(row_key().alias("id"), "text"), id_col="id").filter("doc_id is not null")
    members = groups.select(F.col("doc_id").alias("__key"), F.col("component_id").alias("c")).distinct()
    # Lone documents are their own component.
    pairs = stored(members.groupBy("c").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "components")
    joined = members.join(pairs, "c").join(docs.select(row_key().alias("__key"), "doc_id").distinct(), "__key")
    best = joined.groupBy("c").agg(F.min(F.struct("doc_id", "__key")).alias("best"))
    gone = joined.join(best, "c").filter(F.col("__key") != F.col("best.__key"))
    return without(docs, row_key(), gone.select("__key", F.lit("gone").alias("__flag")))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    clean = pii.redact(docs, pii.fit(docs))
    if "n_chars" not in docs.columns:
        return clean
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))


def pack_best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_languages),
    ("exact_dedup", keep_one_of_equal),
    ("near_dedup", keep_one_of_similar),
    ("pii", redact_personal_data),
    ("packing", pack_best_fit),
]

# Boosted trees, naive Bayes and the packing plan have no SQL form: tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
