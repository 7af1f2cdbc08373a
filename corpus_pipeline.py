"""From raw documents to packed sequences; part of ``pairgauge.llm``.

Each stage works on everything its predecessor kept. The mix may repeat documents, so later stages can see
one id several times.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairgauge.llm import minhash, mixing, packing, pii, toxicity
from pairgauge.llm.common import read, stored

#: Documents at least this likely to be toxic are rejected.
REJECT = 0.5
TOKENIZER = "byte_bpe_50k.json"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000


def _measured(docs: DataFrame) -> DataFrame:
    """The columns of documents; n_chars again counts the text's code points."""
    if "n_chars" in docs.columns:
        return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from all labels and keeps the documents that are not toxic."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.clean(docs, model, threshold=REJECT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word likeness 0.8 or more."""
    return minhash.deduplicated(docs, shingle=5)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return _measured(pii.redact(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their target words."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens, with their ids."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


def _lightly(stage: Callable[[SparkSession, DataFrame, str], DataFrame]):
    """The stage with Arrow batches of BATCH_ROWS rows, unless the session names another number.

    Documents are long; a default batch of them would fill several copies of 30 MB and more in a task.
    """

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(BATCH, "10000") == "10000":
            spark.conf.set(BATCH, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", _lightly(reject_toxic)),
    ("near duplicates", _lightly(drop_near_duplicates)),
    ("personal data", _lightly(redact)),
    ("mixing", _lightly(mix_sources)),
    ("packing", _lightly(pack)),
]

#: No stage but the near duplicates can be said in SQL; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
