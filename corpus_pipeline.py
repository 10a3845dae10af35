"""The corpus pipeline: documents to packed training sequences in five stages.

Each stage takes all that its predecessor kept, and is written as Parquet before the next one reads it.
All stages but the last return the columns they got, extra ones too, whose names may be those an operator gives itself (but not
begin with two underscores); an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import forest, langid, mixing, packing, pii
from lumenfold.llm.common import BATCH_BYTES, arrow_batches, staged, table

#: A document whose likeliest language has a smaller share of the likelihood is rejected, like one without letters.
LEAST_LANGUAGE_SHARE = 0.5
#: Public, for runs whose session names no key.
PSEUDONYM_KEY = "corpus"
#: Rows, and bytes, in a batch of whole texts handed to Python.
BATCH_ROWS = 2000


def _small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches for all stages: their results are computed after a stage has returned."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the labelled rows teach; the others go, null and letterless texts among them.

    Repeated rows fare alike; without labelled rows no language is known and none stays.
    """
    _small_batches(spark)
    predicted = langid.identify(docs, langid.fit_language_model(docs))
    return predicted.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SHARE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, and one row of each repeated key; rows without a key all stay."""
    return forest.drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by pseudonyms; all rows stay, null and empty texts as they are."""
    return pii.pseudonymise(docs, spark.conf.get(pii.KEY_SETTING, PSEUDONYM_KEY))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's documents as often as its target weight says; rows without a source are a source of their own."""
    return mixing.mix_sources(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the documents' tokens in sequences of fixed length; a null text is packed as the empty one."""
    _small_batches(spark)
    return packing.pack_documents(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("personal_data", personal_data), ("mix", mix), ("pack", pack)]

#: The stages are not expressible in SQL; the tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with arrow_batches(spark, BATCH_ROWS):  # puts the session's own limits back, whatever the stages set
        for name, stage in STAGES:
            docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
