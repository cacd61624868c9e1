"""Incremental forms: what the batch operators do, micro-batch by micro-batch. Stored tables are folders of Parquet that
each batch appends to under its number, so that a batch that is run again replaces its own files only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lifecycle import settle
from ..operators.status import current_status
from ..sources.shared import written


def dedup_all(stream: DataFrame, keys: list[str]) -> DataFrame:
    """First row of each key ever: exact over all history, whose keys are in the state store; a batch looks up its own."""
    return stream.dropDuplicates(keys)


def dedup_within(stream: DataFrame, keys: list[str], event_time: str, delay: str = "7 days") -> DataFrame:
    """First row of each key while its state lasts: bounded memory, exact for repeats that come within the delay."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def count_mentions_stream(sightings: DataFrame) -> DataFrame:
    """Running counts by source and mention regardless of case; write in update or complete mode."""
    return sightings.groupBy("source_id", F.lower("mention").alias("mention")).agg(
        F.count(F.lit(1)).alias("seen_count"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen")
    )


class Store:
    """A table in a shared folder that grows by numbered batches."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder, schema

    def numbered(self) -> DataFrame:
        """All rows with the number of their batch."""
        schema = f"{self.schema}, batch long"
        return self.spark.read.schema(schema).option("basePath", self.folder).parquet(f"{self.folder}/batch=*") if self._any() else self.spark.createDataFrame([], schema)

    def before(self, batch: int) -> DataFrame:
        """Rows of earlier batches."""
        return self.numbered().filter(F.col("batch") < batch).drop("batch")

    def _any(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.exists(path) and any("batch=" in s.getPath().getName() for s in fs.listStatus(path))

    def put(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")

    def all(self) -> DataFrame:
        return self.before(1 << 62)


def new_documents(store: Store):
    """foreachBatch function: documents (source_id, content_hash, ...) never seen before are stored; exact over all history."""

    def run(df: DataFrame, batch: int) -> None:
        fresh = df.dropDuplicates(["source_id", "content_hash"]).join(store.before(batch).select("source_id", "content_hash"), ["source_id", "content_hash"], "left_anti")
        store.put(fresh, batch)

    return run


class Buckets:
    """A table in a shared folder, in a fixed number of buckets by the hash of a key, of which a batch reads and replaces
    those that it touches.

    Each batch writes the buckets that it touches and a map from every bucket to the batch that wrote it last. So what a
    batch reads depends on its own keys and on the table's size, not on how many batches came before; what no map needs any
    more is removed. A batch that is run again starts from the map before it and replaces its own files only.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, buckets: int = 64):
        self.spark, self.folder, self.schema, self.key, self.buckets = spark, folder, schema, key, buckets

    def of(self, column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def touched(self, df: DataFrame) -> list[int]:
        """Buckets of the rows of df: as many as there are buckets, at most."""
        return sorted(r[0] for r in df.select(self.of(F.col(self.key))).distinct().collect())

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _batches(self, part: str) -> list[int]:
        path, files = self._files()
        at = path(f"{self.folder}/{part}")
        return sorted(int(x.getPath().getName().split("=")[1]) for x in files.listStatus(at) if "=" in x.getPath().getName()) if files.exists(at) else []

    def _map(self, before: int) -> dict[int, int]:
        """Bucket to the batch that wrote it last, as of the last batch before this one."""
        known = [b for b in self._batches("maps") if b < before]
        return {r["bucket"]: r["version"] for r in self.spark.read.schema("bucket int, version long").parquet(f"{self.folder}/maps/batch={known[-1]}").collect()} if known else {}

    def read(self, before: int, buckets: list[int] | None = None) -> DataFrame:
        """Rows of some buckets, or of all, as the last batch before this one has left them."""
        paths = [f"{self.folder}/data/batch={v}/bucket={b}" for b, v in self._map(before).items() if buckets is None or b in buckets]
        path, files = self._files()
        paths = [x for x in paths if files.exists(path(x))]  # a bucket may have become empty
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def all(self) -> DataFrame:
        return self.read(1 << 62)

    def put(self, df: DataFrame, batch: int, buckets: list[int]) -> None:
        """Replace these buckets by df, which holds all their rows."""
        versions = self._map(batch)
        columns = [f.split()[0] for f in self.schema.split(", ")]
        df.select(*columns, self.of(F.col(self.key)).alias("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/batch={batch}")
        versions |= dict.fromkeys(buckets, batch)
        self.spark.createDataFrame(list(versions.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/maps/batch={batch}")
        maps = [b for b in self._batches("maps") if b <= batch]
        needed = set(versions.values()) | set(self._map(batch).values()) | {batch}
        path, files = self._files()
        for part, gone in (("maps", maps[:-2]), ("data", [b for b in self._batches("data") if b < batch and b not in needed])):
            for b in gone:
                files.delete(path(f"{self.folder}/{part}/batch={b}"), True)


def run_claims(live: Buckets, status: Buckets, sources: DataFrame, as_of):
    """foreachBatch function: claims replace and lift the stored live ones of their features and sources, and the status of
    their features is computed again.

    Both tables are in buckets by feature. A batch reads the buckets of its own features; the rows of other features in
    these buckets are carried over as they are. Arrival order inside a batch is the order of seq.
    """

    def run(df: DataFrame, batch: int) -> None:
        fresh = written(df, "fresh")
        buckets, features = live.touched(fresh), fresh.select("feature_id").distinct()
        before = live.read(batch, buckets)
        left = settle(written(before.join(features, "feature_id", "left_semi").select(*fresh.columns).unionByName(fresh), "every"))
        live.put(before.join(features, "feature_id", "left_anti").select(*fresh.columns).unionByName(left.select(*fresh.columns)), batch, buckets)
        columns = [f.split()[0] for f in status.schema.split(", ")]
        buckets = status.touched(fresh)
        kept = status.read(batch, buckets).join(features, "feature_id", "left_anti").select(*columns)
        status.put(kept.unionByName(current_status(left, sources, as_of).select(*columns)), batch, buckets)

    return run


def run_sightings(store: Store):
    """foreachBatch function: the last time that each document (document_id, seen_at) was met again; confirm(claims,
    store.all()) then moves last_seen_at and changes nothing else."""

    def run(df: DataFrame, batch: int) -> None:
        store.put(df.groupBy("document_id").agg(F.max("seen_at").alias("seen_at")), batch)

    return run


def confirm(claims: DataFrame, sightings: DataFrame) -> DataFrame:
    """Claims with last_seen_at moved to the latest sighting (document_id, seen_at) of their document; nothing else changes."""
    latest = sightings.groupBy("document_id").agg(F.max("seen_at").alias("seen_at"))
    return claims.join(latest, "document_id", "left").withColumn("last_seen_at", F.greatest("last_seen_at", "seen_at")).drop("seen_at")


def absence_counts(claims: DataFrame, runs: DataFrame) -> DataFrame:
    """(id, missed): successful runs of a claim's source after it was last seen. Runs are counted once for each source
    and day, then joined on the source, so that claims never meet single runs."""
    return _missed(claims, runs.filter("ok").groupBy("source_id", "started_at").agg(F.count(F.lit(1)).alias("n")))


def _missed(claims: DataFrame, by_day: DataFrame) -> DataFrame:
    total = by_day.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("started_at", "n"))).alias("days"))
    missed = F.aggregate(F.filter("days", lambda x: x["started_at"] > F.col("last_seen_at")), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return claims.join(total, "source_id", "left").select("id", F.coalesce(missed, F.lit(0)).alias("missed"))
