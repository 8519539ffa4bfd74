"""From documents to token ids: five stages, each written and read again as the next one's documents.

1. quality: documents that the additive model rejects go.
2. near duplicates: one document of each group stays (five-word shingles, Jaccard 0.8 or more).
3. personal data: every span found is replaced by its kind.
4. mix: documents are repeated or left out until the sources meet their targets.
5. tokens: byte-level BPE ids, with digests of the ids and of what they decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm import byte_bpe, gam_quality, jaccard_join, mixing, pii_tagger
from gridspark.llm.text import read
from gridspark.session import cut_lineage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = gam_quality.learn(docs, read(spark, sf_dir, "labels"))
    scored = gam_quality.score(docs.select(*COLUMNS), model, out="__score")
    return scored.where(F.col("__score") >= gam_quality.CUTOFF).drop("__score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs.select(*COLUMNS), jaccard_join.Rule(words=5, percent=80))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = pii_tagger.mask_documents(docs.select(*COLUMNS), pii_tagger.learn(docs))
    return masked.withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = byte_bpe.encode(docs, decoded=True)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix", mix),
    ("tokens", tokens),
]

#: The model, the tagger and the tokenizer have no SQL form; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
