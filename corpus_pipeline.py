"""documents to packed token ids: toxicity, line dedup, near duplicates, mixing and BPE, each over all that is left.

Every stage takes what the one before it kept and wrote, and its decisions take effect: toxic documents go; later
occurrences of passages go, and so does a document of which nothing remains; one document of each component of near
duplicates stays; a document appears as often as the mix takes it; what remains is encoded, and its
ids are decoded and held against the text.

Defined results: columns beyond those of documents are dropped. A null text passes every stage and encodes as the empty one;
a null source is a source of its own; rows without doc_id come after all others where the first of several stays. Of
repeated rows one stays (near duplicates). A text that loses lines and has no word left goes, one that came without a word
stays, as one of all its like, and is taken into the mix as often as others of its source and weight. Rows that tie in
doc_id and text share every decision. Empty tables give empty results, whatever the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.llm import bpe, linededup, mixing, queries, simhash, toxicity
from provenir.llm.common import WORD, prepare, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.toxicity_scores(docs, labels).where("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = linededup.line_dedup(docs).where((F.col("removed_lines") == 0) | F.col("text").rlike(WORD))
    return left.withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.pareto_mix(docs).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    coder = queries.encoder(spark)
    ids = docs.select("doc_id", "source", "text", coder.encode(F.col("text")).alias("ids"))
    both = ids.select("doc_id", "source", "text", "ids", coder.decode(F.col("ids")).alias("decoded"))
    same = F.coalesce(F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary"), F.lit(False))
    digest = F.when(same, F.sha2("decoded", 256)).otherwise(F.raise_error(F.concat(F.lit("ids do not decode to the text of doc_id "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    return both.select("doc_id", "source", bpe.n_tokens(F.col("ids")).alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), digest.alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: The classifier and the fingerprints are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
