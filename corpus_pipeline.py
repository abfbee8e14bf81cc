"""A training-corpus pipeline: language ID, near-duplicate removal, repeated-passage removal, source mixing, tokenising.

Each stage takes ``(spark, docs, sf_dir)``, where ``docs`` is what the stage before has kept, and its decisions take effect: rows
or bytes that it rejects are gone for the next one. All but the last return the columns of ``documents``; other columns are left out,
whatever their names. An empty table goes through as one. Nulls: a null text has no language, so its row goes in the first stage; null
ids, languages and sources are kept, see the stages. Repeated rows and texts with one language score are treated alike; near
duplicates keep one of them. No text is too long: whole texts go through every stage.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import forest, langid, mixing, sentencepiece_backend, suffix_array
from graphloom.sources.tables import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIN_SCORE = 0.4  # below it the network has no opinion; four languages alike would score 0.25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject texts without letters (null and empty ones too), and texts whose language the network cannot tell. Labels decide nothing
    here, and null labels teach nothing; without any labelled row no language is known, and every row goes."""
    model = langid.fit(docs.where(~langid.held_out()))
    judged = langid.predict(docs, model, pred_col="__pred", score_col="__score")
    return judged.where((F.col("__pred") != "und") & (F.col("__score") >= MIN_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the least id, and one row of those that repeat it with its text. Rows without
    an id cannot be told apart and stay."""
    kept = forest.jaccard_join(docs).where("kept").select("doc_id").distinct()
    stays = docs.select(*COLUMNS).join(kept, "doc_id", "left_semi").withColumn("__same", F.xxhash64("text")).dropDuplicates(["doc_id", "__same"])
    return stays.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that a document with a smaller id has are cut out; documents of which nothing is left go. Rows with a null id
    are cut nowhere and cut nothing; rows that share an id do not cut one another. A null text stays null."""
    left = suffix_array.remove_repeated_bytes(docs.select(*COLUMNS), keep_text="text").where("n_removed = 0 or n_removed < n_bytes")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents to the target weights of sources, languages and topics. Null sources and languages are strata of their own; rows
    without a word go, as they have no weight; rows with one id and text go or stay together."""
    return mixing.mix(docs).where("sampled").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their parity with the reference library's, and a round trip back to its text. A null text has null
    in all of these, an empty one no ids."""
    return sentencepiece_backend.encode(docs.select("doc_id", "text", "lang", "source")).select("doc_id", "lang", "source", "n_tokens", "token_ids", "parity", "round_trip")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mixing", source_mixing),
    ("encode", encode),
]

#: The stages rest on trained weights, hashes of Spark and a tokenizer, none of which SQL can express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
