"""A corpus pipeline over ``documents``: each stage applies one operator to all rows its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoardlens.llm import bpe, decontaminate, jaccard, secrets, toxicity
from hoardlens.workspace import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC = 0.5
MASK = "[SECRET]"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored below TOXIC; the model learns from the labels of this stage's documents.

    Null and empty texts, and rows with a null id, are scored like texts without neighbours and
    stay where toxic documents are the rarer ones. Repeated rows get equal scores. Without labels
    all rows stay. Only the columns of documents are read, so others cannot clash.
    """
    index = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score_toxicity(docs.select(*COLUMNS), index)
    return scored.where(F.col("toxicity") < TOXIC).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the row with the least id; repeated rows become one.

    Rows without shingles, or without an id, have no group and stay. Rows are told apart by id
    and text, so an id that occurs twice loses no other text.
    """
    classes, _ = jaccard.jaccard_components(docs)
    classes = materialize(classes.where("n_shingles > 0 AND doc_id IS NOT NULL"), "classes")
    gone = classes.where("doc_id > component_id").select("doc_id", "text_key").distinct()
    keyed = docs.select(*COLUMNS).withColumn("text_key", F.xxhash64("text"))
    kept = keyed.join(gone, ["doc_id", "text_key"], "left_anti")
    repeated = classes.groupBy("doc_id", "text_key").count().where("count > 1").select("doc_id", "text_key")
    if not repeated.isEmpty():
        again = kept.join(repeated, ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"])
        kept = kept.join(repeated, ["doc_id", "text_key"], "left_anti").unionByName(again)
    return kept.select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which fewer than one word in 20 lies in a passage of the benchmark.

    Null and empty texts have no words and stay, repeated rows fare alike, an empty benchmark
    removes nothing and an empty table gives no rows. Only the columns of documents are read.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_contamination(docs.select(*COLUMNS), benchmark)
    dirty = (F.col("n_hit") > 0) & (decontaminate.HIT_SHARE * F.col("n_hit") >= F.col("n_words"))
    return found.where(~dirty).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, each span of a secret replaced by MASK; ``n_chars`` follows the text.

    Spans that overlap share one MASK. Null and empty texts, and their ``n_chars``, stay as they
    are; repeated rows stay repeated. Only the columns of documents are read.
    """
    found, _ = secrets.find_secrets(docs.select(*COLUMNS))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def put(state, span):
        gap = F.substring(F.col("text"), (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        inside = span["end"] <= state["at"]
        overlaps = span["start"] < state["at"]
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.when(inside | overlaps, state["out"]).otherwise(F.concat(state["out"], gap, F.lit(MASK))).alias("out"),
        )

    def finish(state):
        return F.concat(state["out"], F.substring(F.col("text"), (state["at"] + 1).cast("int"), F.char_length("text")))

    masked = F.when(F.size("secrets") > 0, F.aggregate("secrets", start, put, finish)).otherwise(F.col("text"))
    changed = found.withColumn("masked", masked)
    length = F.when(F.size("secrets") > 0, F.char_length("masked").cast("bigint")).otherwise(F.col("n_chars"))
    return changed.select(
        "doc_id", F.col("masked").alias("text"), "lang", "source", length.alias("n_chars")
    )


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: token ids of each text, and whether decoding gives the text back.

    A null text counts as an empty one, which has no ids. Repeated rows stay repeated, an empty
    table gives no rows. Only the columns of documents are read.
    """
    tokens = bpe.encode_checked(docs.select("doc_id", "text", "lang", "source"))
    return tokens.select(
        "doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "round_trip"
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("bpe_codec", encode_tokens),
]

# Neither the nearest-example model nor the tokenizer can be stated in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
