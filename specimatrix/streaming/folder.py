"""Classification of records as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from specimatrix.operators.classify import DIAGNOSTICS, Rules, keep_first, overall_length, round_one
from specimatrix.session import scratch


def classified_stream(spark: SparkSession, folder: str, schema, rules: Rules = Rules(), event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """A stream of classified records: every record's first round, as in the batch, but repeated loci are all there.

    Which record of a locus is the first is only known when all have arrived: ``first_of`` tells it of what was written.
    With ``event_time`` a locus that arrives again within ``delay`` is dropped on the way, in bounded state; that keeps
    the first to arrive. ``folder`` may also be one file; the stream then watches its folder for that name.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    source = spark.readStream.schema(schema)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        source, folder = source.option("pathGlobFilter", at.getName()), at.getParent().toString()
    rows = overall_length(source.parquet(folder), rules)
    if event_time:
        rows = rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([rules.locus])
    return round_one(rows, rules)


def start(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes what has arrived and ends; started again with the same checkpoint it goes on where it was."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_of(written: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The first record of each locus in what the stream has written so far: the batch's first round over the same rows."""
    return keep_first(written, rules.locus, rules.order)


def classify_available(spark: SparkSession, source: str, rules: Rules = Rules()) -> DataFrame:
    """(row_id, diagnostics) of the records in a table's files, read as a stream: each locus once, as in the batch."""
    schema = spark.read.parquet(source).schema
    at = scratch(spark)
    stream = classified_stream(spark, source, schema, rules).select(rules.order, rules.locus, *DIAGNOSTICS)
    start(stream, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return first_of(spark.read.schema(stream.schema).parquet(f"{at}/out"), rules).select(rules.order, *DIAGNOSTICS)
