"""Upkeep of an index by micro-batches of changes, exactly once for each batch.

A stream of rows (path, content; a null content deletes) is folded into chunks, mentions and in-degrees. Of several
rows of one path in a batch the last by ``seq`` counts. A batch that is run again after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import scalars as X
from ..operators import graph, incremental, segment
from ..sources.files import Catalog

SCHEMA = "path string, content string, seq long"


def chunked(files: DataFrame) -> DataFrame:
    """Segments with their ids."""
    return segment.segment_files(files).withColumn("id", X.chunk_id(F.col("path"), F.col("start_line"), F.col("content")))


class Index:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.catalog = spark, Catalog(spark, folder)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Folds one batch in; all tables move on together."""
        c = self.catalog
        if int(c.meta().get("batch", -1)) >= batch_id:
            return
        last = batch.withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("seq")))).where("place = 1")
        paths, files = last.select("path"), last.where("content IS NOT NULL").select("path", "content", X.content_hash(F.col("content")).alias("content_hash"))
        if c.has("files"):
            same = files.join(c.read("files").select("path", "content_hash"), ["path", "content_hash"], "left_semi").select("path")
            paths, files = paths.join(same, "path", "left_anti"), files.join(same, "path", "left_anti")
            old_chunks, old_files, old_mentions = c.read("chunks"), c.read("files"), c.read("mentions")
        fresh = graph.keep(chunked(files.select("path", "content")))
        if not c.has("files"):
            chunks = fresh
            c.write(files=files.select("path", "content_hash"), chunks=chunks, mentions=self._mentions(chunks), meta=c.meta_table(batch=str(batch_id)))
        else:
            chunks = graph.keep(old_chunks.join(paths, "path", "left_anti").unionByName(fresh))
            gone = old_chunks.join(paths, "path", "left_semi").select("id")
            changed = fresh.select("id").union(gone).distinct()
            index = lambda x: graph.name_index(x.where("name IS NOT NULL").select("name", "id"))
            kept = old_mentions.join(gone.withColumnRenamed("id", "to_id"), "to_id", "left_anti").select("from_id", "to_id", "name")
            mentions = incremental.mentions_refresh(kept, graph.words(chunks), index(old_chunks), index(chunks), changed).distinct()
            now = old_files.join(paths, "path", "left_anti").unionByName(files.select("path", "content_hash"))
            c.write(files=now, chunks=chunks, mentions=mentions, meta=c.meta_table(batch=str(batch_id)))

    @staticmethod
    def _mentions(chunks: DataFrame) -> DataFrame:
        index = graph.name_index(chunks.where("name IS NOT NULL").select("name", "id"))
        found = graph.words(chunks).join(index.withColumnRenamed("id", "to_id"), "name").withColumnRenamed("id", "from_id")
        return found.where("from_id <> to_id").select("from_id", "to_id", "name").distinct()

    def indegree(self) -> DataFrame:
        return graph.indegree(self.catalog.read("mentions").select("from_id", "to_id").distinct().withColumn("edge_type", F.lit("mentions")))

    def follow(self, source: str, checkpoint: str, files_per_trigger: int = 1000) -> StreamingQuery:
        """Reads new Parquet files of changes as they come, until all that is there has been read."""
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
