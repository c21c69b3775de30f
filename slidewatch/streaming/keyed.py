"""A keyed table that micro-batches keep up to date: log-structured, in hash buckets, with a manifest.

Layout under ``root``: ``rows/run=R/bucket=B`` holds rows, ``manifest/v=N`` names for each bucket the runs that count after
batch N. A batch adds one short run to the buckets it touches. A bucket that has ``most_runs`` runs is folded with the batch
into one. So a read touches at most ``most_runs`` runs of a bucket, a batch rewrites only buckets whose turn has come, and a
table costs what its keys cost, not what its log costs.

The manifest is written last and is one file, so a batch counts as a whole or not at all; a batch that comes again after
its manifest was written changes nothing, one that was torn off is written anew from the same state.

``fold`` turns rows of the same key into one and must not depend on how they are grouped: the newest (``newest``) or a sum.
Rows carry ``_version``, the batch that wrote them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slidewatch.operators.rank import latest_per_key
from slidewatch.sources import versions

MANIFEST = "bucket int, run string, place int"


def newest(keys: Sequence[str], order: Sequence[str] = ("_version",)) -> Callable[[DataFrame], DataFrame]:
    """The row of a key with the greatest ``order``, ties by the later batch."""
    order = list(dict.fromkeys([*order, "_version"]))

    def fold(rows: DataFrame) -> DataFrame:
        columns = rows.columns
        keyed = rows.withColumn("_key", F.struct(*keys))
        return latest_per_key(keyed, "_key", order).select(*columns)

    return fold


def summed(keys: Sequence[str], values: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Sums per key."""

    def fold(rows: DataFrame) -> DataFrame:
        sums = [F.sum(v).cast(rows.schema[v].dataType).alias(v) for v in values]
        return rows.groupBy(*keys).agg(*sums, F.max("_version").alias("_version")).select(*rows.columns)

    return fold


class KeyedTable:
    def __init__(
        self, spark: SparkSession, root: str, schema: T.StructType, keys: Sequence[str], fold: Callable[[DataFrame], DataFrame] | None = None,
        bucket_by: Sequence[str] | None = None, buckets: int = 16, most_runs: int = 4,
    ):
        """``bucket_by`` are the columns, some of ``keys``, whose hash chooses the bucket. Choose ``buckets`` by the table's
        size, so that a bucket is some hundred megabytes; it stays the same for the life of the table."""
        self.spark, self.root, self.keys = spark, root.rstrip("/"), list(keys)
        self.schema = T.StructType([*schema.fields, T.StructField("_version", T.LongType())])
        self.fold = fold or newest(keys)
        self.bucket_by, self.buckets, self.most_runs = list(bucket_by or keys), buckets, most_runs

    def version(self) -> int | None:
        """The last batch that counts."""
        return versions.live(self.spark, f"{self.root}/manifest")

    def runs(self) -> dict[int, list[str]]:
        """Runs that count, per bucket, oldest first: at most ``buckets * most_runs`` names."""
        number, out = self.version(), {}
        if number is not None:
            named = self.spark.read.schema(MANIFEST).parquet(versions.version_path(f"{self.root}/manifest", number))
            for row in sorted(named.collect(), key=lambda r: (r["bucket"], r["place"])):
                out.setdefault(row["bucket"], []).append(row["run"])
        return out

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int")

    def buckets_of(self, rows: DataFrame) -> list[int]:
        return sorted(r["bucket"] for r in rows.select(self.bucket().alias("bucket")).distinct().collect())

    def _files(self, pairs: Iterable[tuple[int, str]]) -> DataFrame:
        paths = [f"{self.root}/rows/run={run}/bucket={bucket}" for bucket, run in pairs]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def raw(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """Rows of all runs that count; a key may have one in each run."""
        runs = self.runs()
        chosen = runs if buckets is None else [b for b in buckets if b in runs]
        return self._files((b, run) for b in chosen for run in runs[b])

    def read(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """One row per key, of all buckets or of those given."""
        return self.fold(self.raw(buckets))

    def merge(self, rows: DataFrame, number: int, keep: Column | None = None, folded: bool = False) -> None:
        """Batch ``number`` of new rows, ``folded`` where they hold a key once. Folded rows for which ``keep`` is not true are
        left out for good."""
        last = self.version()
        if last is not None and number <= last:
            return
        runs, name = self.runs(), str(number)
        fresh = rows.withColumn("_version", F.lit(number).cast("long")).select(*self.schema.names)
        self._write(fresh if folded else self.fold(fresh), name)
        added = [int(n.removeprefix("bucket=")) for n in versions.names_in(self.spark, f"{self.root}/rows/run={name}") if n.startswith("bucket=")]
        full = [b for b in added if len(runs.get(b, ())) >= self.most_runs - 1 and b in runs]
        if full:
            merged = self.fold(self._files([(b, run) for b in full for run in [*runs[b], name]]))
            self._write(merged if keep is None else merged.where(keep), f"{name}-folded")
        left = {int(n.removeprefix("bucket=")) for n in versions.names_in(self.spark, f"{self.root}/rows/run={name}-folded") if n.startswith("bucket=")}
        for b in added:
            if b in full:
                runs[b] = [f"{name}-folded"] if b in left else []
            else:
                runs[b] = [*runs.get(b, ()), name]
        manifest = [(b, run, k) for b, own in runs.items() for k, run in enumerate(own)]
        named = self.spark.createDataFrame(manifest, MANIFEST).coalesce(1)
        named.write.mode("overwrite").parquet(versions.version_path(f"{self.root}/manifest", number))

    def _write(self, rows: DataFrame, run: str) -> None:
        """By bucket; Spark cuts large buckets and puts small ones together by their measured size."""
        dealt = rows.withColumn("bucket", self.bucket()).hint("rebalance", "bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/rows/run={run}")

    def clean(self, keep_versions: int = 2) -> list[str]:
        """Deletes runs and manifests that none of the last ``keep_versions`` versions names; returns the names of the runs.

        Call it when no reader is still at an older version.
        """
        live = self.version()
        finished = [n for n in versions.numbers(self.spark, f"{self.root}/manifest") if live is not None and n <= live]
        kept, used = finished[-keep_versions:], set()
        for n in kept:
            named = self.spark.read.schema(MANIFEST).parquet(versions.version_path(f"{self.root}/manifest", n))
            used |= {r["run"] for r in named.select("run").distinct().collect()}
        gone = []
        for name in versions.names_in(self.spark, f"{self.root}/rows"):
            run = name.removeprefix("run=")
            if name.startswith("run=") and run not in used and int(run.split("-")[0]) <= max(kept, default=-1):
                versions.remove(self.spark, f"{self.root}/rows/{name}")
                gone.append(run)
        for n in finished[:-keep_versions]:
            versions.remove(self.spark, versions.version_path(f"{self.root}/manifest", n))
        return sorted(gone)


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Gives each available micro-batch to ``write`` and stops; a later call goes on from the checkpoint."""
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
