"""Incremental append: new documents become chunks, each chunk once, however often it arrives.

The reference state of seen ids and fingerprints lives in the stream's state
store and checkpoint, so a restart replays nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quern.functions.text import squeeze


def arriving(spark: SparkSession, path: str, schema: T.StructType, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 10) -> DataFrame:
    """(key, chunk, fingerprint) of a text's paragraphs of some length."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n+"), squeeze), lambda x: F.length(x) >= least)
    d = docs.select(key, F.explode(parts).alias("chunk"))
    return d.withColumn("fingerprint", F.sha2("chunk", 256))


def first_seen(chunks: DataFrame) -> DataFrame:
    """Each fingerprint once, over the stream's life; works on a batch table alike."""
    return chunks.dropDuplicates(["fingerprint"])


def append_corpus(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str) -> StreamingQuery:
    """Runs over what has arrived and stops; a later call goes on from the checkpoint."""
    d = first_seen(paragraphs(arriving(spark, source, schema)))
    return d.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(target)


def append_missing(spark: SparkSession, new: DataFrame, target: DataFrame, key: str = "fingerprint") -> DataFrame:
    """The batch form: chunks that the target does not hold yet, each once."""
    return first_seen(new).join(target.select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_anti")
