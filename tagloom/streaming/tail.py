"""Streaming forms: label new items as they arrive, and keep the newest prediction of each item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import rules
from ..operators.evaluate import last_write_wins


def label_new(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = "ad_id string, ad_text string, arrived timestamp", delay: str = "1 day"):
    """Label Parquet items that arrive in ``source`` once each and append the records to ``target``; ends when all are done.

    The checkpoint remembers finished files, and ids repeated within ``delay`` are labelled once.
    """
    items = spark.readStream.schema(schema).parquet(source).withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["ad_id"])
    labelled = rules.classify(items)
    return labelled.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def label_counts(items: DataFrame, every: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Goal and issue counts in windows of arrival time, for a stream or a table with ``arrived``."""
    timed = items.withWatermark("arrived", delay) if items.isStreaming else items
    return rules.classify(timed, reasons=False).groupBy(F.window("arrived", every).alias("w"), "goal", "issue").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "goal", "issue", "n")


#: Folders over which the items of a followed log are dealt.
PARTS = 64


def _folders(spark: SparkSession, table: str):
    """(batch, part, path) of the table's folders."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, "batch=*/part=*")) if fs.exists(path) else None
    return fs, [(int(p.getParent().getName()[6:]), int(p.getName()[5:]), p) for p in (f.getPath() for f in found or ())]


def read_newest(spark: SparkSession, table: str, schema, before: int | None = None) -> DataFrame:
    """The followed table: of each part the newest batch, with ``part``; only batches before ``before`` if given."""
    newest: dict = {}
    for batch, part, path in _folders(spark, table)[1]:
        if (before is None or batch < before) and batch >= newest.get(part, (-1,))[0]:
            newest[part] = (batch, path.toString())
    empty = spark.createDataFrame([], schema).withColumn("part", F.lit(0))
    out = empty
    if newest:
        out = spark.read.schema(StructType([*schema, StructField("part", IntegerType())])).option("basePath", table).parquet(*(p for _, p in newest.values())).select(*empty.columns)
    return out


def stale(spark: SparkSession, table: str, number: int) -> None:
    """Remove folders that a batch before the last two has replaced; the last two stay for readers and for a batch that is run again."""
    fs, folders = _folders(spark, table)
    newest = {part: max(b for b, p, _ in folders if p == part and b <= number - 1) for part in {p for b, p, _ in folders if b <= number - 1}}
    for batch, part, path in folders:
        if batch < newest.get(part, batch):
            fs.delete(path, True)


def newest_predictions(spark: SparkSession, log: str, table: str, checkpoint: str, schema):
    """Follow a prediction log and keep the newest record of each item in the Parquet table ``table``, batch by batch.

    Items are dealt over PARTS folders by a hash of their id, and a batch rewrites only the folders that its items fall in; a
    folder's content is the newest of its files named by batch, so a batch that is run again gives the same table.
    """

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        new = last_write_wins(batch).withColumn("part", F.pmod(F.xxhash64("ad_id"), F.lit(PARTS)).cast("int"))
        touched = [r["part"] for r in new.select("part").distinct().collect()]  # at most PARTS
        old = read_newest(session, table, schema, number).where(F.col("part").isin(touched))
        merged = last_write_wins(old.unionByName(new), "part")
        merged.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "part").parquet(table)
        stale(session, table, number)

    return spark.readStream.schema(schema).json(log).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
