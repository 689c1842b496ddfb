"""Sharding by size-tiered compaction, in DataFrame functions only.

Arrivals become small immutable shards (Parquet files). Compaction groups shards of similar size, each
group up to the target size, and rewrites a group as one file; groups run in waves, one job a wave.
Each append and wave commits a new version of the manifest: the manifest's table is written first,
then a marker that names it is renamed to the version's name, which fails if that version exists; a
writer that loses such a race plans anew from the version that won. A reader sees the last committed
version whole; files of a job that failed are in no manifest. Files that a compaction merged stay, so
every committed version stays readable, until expire() gives old versions up.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atheneum.llm.common import apart, shared_dir, table

TARGET_BYTES = 32 << 20
FAN_IN = 4
WAVE = 32
ARRIVALS = 4
SMALL_ROWS = 20_000

MANIFEST = "shard string, path string, tier int, rows long, bytes long, merged int"


class ShardStore:
    """Shards under root, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN) -> None:
        self.spark, self.root, self.target, self.fan_in = spark, root, target_bytes, fan_in
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(root).toUri(), conf)
        self._rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self._fs.mkdirs(self._path(f"{root}/versions"))

    def version(self) -> int:
        """The last committed version; 0 before any."""
        return max((int(s.getPath().getName()) for s in self._fs.listStatus(self._path(f"{self.root}/versions")) if s.getPath().getName().isdigit()), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """One row per shard: shard, path, tier, rows, bytes, merged (how often its rows were rewritten)."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        name = self.spark.read.text(f"{self.root}/versions/{version:08d}").first()[0]
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{name}")

    def commit(self, shards: DataFrame, version: int) -> int:
        """Publishes shards as this version; raises if it exists."""
        name = uuid.uuid4().hex
        shards.coalesce(1).write.parquet(f"{self.root}/manifests/{name}")
        marker = self._path(f"{self.root}/versions/{name}.tmp")
        out = self._fs.create(marker)
        out.write(bytearray(name.encode()))
        out.close()
        self._files.rename(marker, self._path(f"{self.root}/versions/{version:08d}"), self._rename)
        return version

    def _tier(self):  # noqa: ANN202
        return F.floor(F.log(F.greatest(F.col("bytes"), F.lit(1))) / math.log(self.fan_in)).cast("int")

    def _shards(self, folder: str, schema, merged: int) -> DataFrame:  # noqa: ANN001
        meta = self.spark.read.schema(schema).parquet(folder).select("_metadata.file_path", "_metadata.file_name", "_metadata.file_size")
        of = meta.groupBy("file_path", "file_name", "file_size").agg(F.count("*").alias("rows"))
        of = of.select(F.col("file_name").alias("shard"), F.col("file_path").alias("path"), F.col("rows"), F.col("file_size").alias("bytes"), F.lit(merged).alias("merged"))
        return of.withColumn("tier", self._tier()).select("shard", "path", "tier", "rows", "bytes", "merged")

    def append(self, arrivals: DataFrame, small_rows: int = SMALL_ROWS) -> int:
        """Writes each partition of arrivals as shards of at most small_rows and commits; no shuffle."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        arrivals.write.option("maxRecordsPerFile", small_rows).option("compression", "zstd").parquet(folder)
        new = self._shards(folder, arrivals.schema, 0)
        while True:
            version = self.version()
            done = self._try_commit(self.manifest(version).unionByName(new), version + 1)
            if done:
                return done

    def _try_commit(self, shards: DataFrame, version: int) -> int | None:
        """The version, or None where another writer took it first."""
        try:
            return self.commit(shards, version)
        except Exception:
            if self.version() < version:
                raise
            return None

    def expire(self, before: int) -> int:
        """Gives up the versions below `before` (never the last one): their markers go first, then the files
        that no remaining version names. Returns how many files went."""
        before = min(before, self.version())
        old = [v for v in range(1, before) if self._fs.exists(self._path(f"{self.root}/versions/{v:08d}"))]
        if not old:
            return 0
        left = [self.manifest(v).select("path") for v in range(before, self.version() + 1)]
        gone = [self.manifest(v).select("path") for v in old]
        paths = self._all(gone).distinct().join(self._all(left).distinct(), "path", "left_anti")
        named = [r.path for r in paths.toLocalIterator()]
        for v in old:
            self._fs.delete(self._path(f"{self.root}/versions/{v:08d}"), False)
        for path in named:
            self._fs.delete(self._path(path), False)
        return len(named)

    @staticmethod
    def _all(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def plan(self, shards: DataFrame, whole: bool) -> DataFrame:
        """Shards to merge and their group: within a tier, by running size up to the target; whole joins all tiers.
        Without whole, only tiers with fan_in shards or more. The windows run over the manifest, not over data."""
        small = shards.where(F.col("bytes") < self.target // 2)
        tier = F.lit(0) if whole else F.col("tier")
        small = small.withColumn("_tier", tier).withColumn("_n", F.count("*").over(W.partitionBy("_tier"))).where(F.col("_n") >= (2 if whole else self.fan_in))
        upto = F.sum("bytes").over(W.partitionBy("_tier").orderBy("bytes", "shard"))
        small = small.withColumn("group", F.struct("_tier", F.floor((upto - 1) / self.target).alias("k")))
        return small.withColumn("_m", F.count("*").over(W.partitionBy("group"))).where("_m > 1").withColumn("group", F.dense_rank().over(W.orderBy("group"))).drop("_tier", "_n", "_m")

    def compact(self, schema, whole: bool = True) -> int:  # noqa: ANN001
        """Merges until no tier has fan_in small shards, then (whole) the rest across tiers; returns the version."""
        last = False
        while True:
            version = self.version()
            shards = self.manifest(version)
            todo = self.plan(shards, last).where(F.col("group") <= WAVE).collect()  # a wave: WAVE groups of at most target bytes
            if not todo:
                if last or not whole:
                    return version
                last = True
                continue
            groups: dict[int, list] = {}
            for r in todo:
                groups.setdefault(r.group, []).append(r)
            parts = [self.spark.read.schema(schema).parquet(*(r.path for r in g)).coalesce(1) for g in groups.values()]
            out = parts[0]
            for p in parts[1:]:
                out = out.union(p)
            folder = f"{self.root}/data/{uuid.uuid4().hex}"
            self._write_apart(out, folder)
            merged = self._shards(folder, schema, 1 + max(r.merged for r in todo))
            gone = self.spark.createDataFrame([(r.shard,) for r in todo], "shard string")
            left = shards.join(gone, "shard", "left_anti").select(merged.columns)
            if self._try_commit(left.unionByName(merged), version + 1) is None:
                self._fs.delete(self._path(folder), True)  # another writer came first: nothing names these files

    def _write_apart(self, union: DataFrame, folder: str) -> None:
        """Writes a union of groups of one partition each as a file a group.

        Spark otherwise zips children that all have a single partition into one."""
        conf, name = self.spark.conf, "spark.sql.unionOutputPartitioning"
        before = conf.get(name, None)
        conf.set(name, "false")
        try:
            union.write.option("compression", "zstd").parquet(folder)
        finally:
            conf.unset(name) if before is None else conf.set(name, before)

    def read(self, schema) -> DataFrame:  # noqa: ANN001
        """All rows of the last version, with shard, tier, shard_rows and manifest_version."""
        version = self.version()
        shards = self.manifest(version)
        paths = [r.path for r in shards.select("path").toLocalIterator()]
        extra = shards.select(F.col("shard").alias("_shard"), "tier", F.col("rows").alias("shard_rows"))
        if not paths:
            return self.spark.createDataFrame([], schema).join(extra, F.lit(False)).withColumnRenamed("_shard", "shard").withColumn("manifest_version", F.lit(version))
        rows = self.spark.read.schema(schema).parquet(*paths).withColumn("shard", F.col("_metadata.file_name"))
        return rows.join(extra, F.col("shard") == F.col("_shard")).drop("_shard").withColumn("manifest_version", F.lit(version))


def shard(docs: DataFrame, arrivals: int = ARRIVALS, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """docs through a store of its own: appended in so many arrivals (by a hash of all columns), compacted, read again.

    Every row of docs is in exactly one shard, repeated rows too; nulls, empty and long texts are stored
    as they are. Columns shard, tier, shard_rows and manifest_version are added; a column of docs with
    such a name comes out with `_in` behind it. An empty table gives no rows.
    """
    docs = apart(docs, "shard", "tier", "shard_rows", "manifest_version", "_shard", "_metadata")
    store = ShardStore(docs.sparkSession, f"{shared_dir(docs.sparkSession)}/shards-{uuid.uuid4().hex}", target_bytes)
    of = F.pmod(F.xxhash64(*(F.col(c) for c, kind in docs.dtypes if not kind.startswith("map"))), F.lit(arrivals))
    for k in range(arrivals):
        store.append(docs.where(of == k))
    store.compact(docs.schema)
    return store.read(docs.schema)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "n_chars", "shard", "tier", "shard_rows", "manifest_version")
