"""What changed between full snapshots: a bucketed key-to-hash index, probed and swapped."""

from __future__ import annotations

import json
import unicodedata
import uuid
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.operators.records import latest_per_key
from lodestar.storage import shared_path, written

#: White space of any kind, as a Java class. Fixed value.
_SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}\x{200B}]+"


@F.pandas_udf(T.StringType())
def composed(values: pd.Series) -> pd.Series:
    """Canonical composition; texts already composed (all ASCII ones) pass through."""
    return values.map(lambda v: v if v is None or v.isascii() or unicodedata.is_normalized("NFC", v) else unicodedata.normalize("NFC", v))


def notation_free(value: Column) -> Column:
    """A text without differences of notation: composed, white space runs as one blank, ends trimmed, null as ''."""
    other = composed(F.when(value.rlike(r"[^\x00-\x7f]"), value))  # ASCII is composed and stays in the JVM
    return F.trim(F.regexp_replace(F.coalesce(other, value, F.lit("")), _SPACE, " "))


def trimmed_id(value: Column) -> Column:
    return F.regexp_replace(value, rf"^{_SPACE}|{_SPACE}$", "")


class SnapshotIndex:
    """The last snapshot as a stored, bucketed index (group, key) -> hash of the compared fields.

    The index lives in a folder: a manifest names its current generation, a Parquet table
    bucketed and sorted by (group, key). An index that is there is opened, else an empty
    one begins. ``apply`` probes it with the next full snapshot, writes the new generation
    with the kinds of change beside it, swaps the manifest and deletes the generation
    before the last. Bucket meets bucket, so the index is never shuffled; only keys and
    8-byte hashes are stored and compared, and ``with_values`` fetches old values for the
    changed keys alone. Groups without a row in a snapshot were not delivered: their part
    of the index is carried over. The first delivery of a group gives no changes.

    Everything is written to the folder, so jobs survive lost executors and later sessions
    go on from there.
    """

    _COLUMNS = "g STRING, k STRING, h BIGINT, change_kind STRING"

    def __init__(self, spark: SparkSession, folder: str, group: str, key: str, compared: list[str], version: str, buckets: int | None = None):
        self.spark, self.folder, self.group, self.key, self.compared, self.version = spark, folder.rstrip("/"), group, key, compared, version
        self.generation, self.buckets = 0, buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._names = f"lodestar_index_{uuid.uuid5(uuid.NAMESPACE_URL, self.folder).hex[:12]}"
        manifest = self._path("manifest.json")
        fs = manifest.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(manifest):
            held = json.loads(spark.read.text(manifest.toString(), wholetext=True).first()[0])
            if held["compared"] != compared:
                raise ValueError(f"the index at {folder} compares {held['compared']}")
            self.generation, self.buckets = held["generation"], held["buckets"]

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _table(self, generation: int) -> DataFrame:
        name = f"{self._names}_{generation}"
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} ({self._COLUMNS}) USING parquet CLUSTERED BY (g, k) SORTED BY (g, k) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/generation-{generation}'")
        return self.spark.table(name)

    @property
    def current(self) -> DataFrame | None:
        """(g, k, h) of the last snapshot."""
        return self._table(self.generation).where(F.col("h").isNotNull()).select("g", "k", "h") if self.generation else None

    def hashed(self, snapshot: DataFrame, *beside: str) -> DataFrame:
        """(g, k, h) of a snapshot: ids trimmed, of repeated keys the latest version, null ids left out; ``beside`` columns are part of the key."""
        h = F.xxhash64(*[notation_free(F.col(c)) for c in self.compared])
        rows = snapshot.select(*beside, F.coalesce(F.col(self.group), F.lit("")).alias("g"), trimmed_id(F.col(self.key)).alias("k"), F.col(self.version).alias("v"), h.alias("h")).where(F.col("k").isNotNull())
        return latest_per_key(rows, [*beside, "g", "k"], ["v"], ["h"])

    def bucketed(self, snapshots: DataFrame, number: str) -> DataFrame:
        """Hashes of many snapshots at once, bucketed like the index: one pass and one shuffle for all of them."""
        name, path = f"{self._names}_deliveries", f"{self.folder}/deliveries"
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        rows = self.hashed(snapshots, number).repartition(self.buckets, "g", "k")
        rows.write.mode("overwrite").partitionBy(number).bucketBy(self.buckets, "g", "k").sortBy("g", "k").option("path", path).saveAsTable(name)
        return self.spark.table(name)

    def apply(self, snapshot: DataFrame) -> DataFrame:
        """(g, k, change_kind) of the next snapshot against the index; then the new index is swapped in."""
        return self.apply_hashed(self.hashed(snapshot))

    def apply_hashed(self, fresh: DataFrame) -> DataFrame:
        """``apply`` for rows that ``hashed`` or ``bucketed`` gave."""
        fresh = fresh.select("g", "k", "h")
        old = self.current
        if old is None:
            merged = fresh.select("g", "k", "h", F.lit(None).cast("string").alias("change_kind"))
        else:
            sides = old.select("g", F.lit(1).alias("known"), F.lit(0).alias("here")).unionByName(fresh.select("g", F.lit(0).alias("known"), F.lit(1).alias("here")))
            groups = sides.groupBy("g").agg(F.max("known").alias("known"), F.max("here").alias("here"))
            both = old.select("g", "k", F.col("h").alias("h_old")).join(fresh, ["g", "k"], "full_outer").join(groups, "g")
            here = F.col("here") == 1
            kind = F.when(here & (F.col("known") == 1), F.when(F.col("h_old").isNull(), "added").when(F.col("h").isNull(), "removed").when(F.col("h") != F.col("h_old"), "changed"))
            merged = both.select("g", "k", F.when(here, F.col("h")).otherwise(F.col("h_old")).alias("h"), kind.alias("change_kind"))
        after = self.generation + 1
        name = f"{self._names}_{after}"
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        merged.repartition(self.buckets, "g", "k").write.mode("overwrite").bucketBy(self.buckets, "g", "k").sortBy("g", "k").option("path", f"{self.folder}/generation-{after}").saveAsTable(name)
        self._swap(after)
        return self._table(after).where(F.col("change_kind").isNotNull()).select("g", "k", "change_kind")

    def _swap(self, after: int) -> None:
        """Name the new generation in the manifest, then delete the one before the last; the last one serves readers still at work."""
        fs = self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        out = fs.create(self._path("manifest.json"), True)
        out.write(bytearray(json.dumps({"generation": after, "buckets": self.buckets, "compared": self.compared}).encode()))
        out.close()
        self.generation = after
        if after > 2:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._names}_{after - 2}")
            fs.delete(self._path(f"generation-{after - 2}"), True)

    def with_values(self, changes: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
        """Old and new values of the compared fields, fetched for changed keys only."""

        def values(snapshot: DataFrame, side: str) -> DataFrame:
            rows = snapshot.select(F.coalesce(F.col(self.group), F.lit("")).alias("g"), trimmed_id(F.col(self.key)).alias("k"), F.col(self.version).alias("v"), *self.compared)
            kept = rows.join(changes.select("g", "k"), ["g", "k"], "left_semi")
            return latest_per_key(kept, ["g", "k"], ["v"], self.compared).select("g", "k", *[F.col(c).alias(f"{c}_{side}") for c in self.compared])

        return changes.join(values(before, "old"), ["g", "k"], "left").join(values(after, "new"), ["g", "k"], "left")


def snapshot_changes(df: DataFrame, numbers: Iterable[int], number: str, group: str, key: str, compared: list[str], version: str) -> DataFrame:
    """(number, key, change_kind) of every two successive deliveries of each group.

    Snapshots are applied in order of ``number`` to one index, whatever the order of
    delivery. A key changed in several groups counts once per group; distinct rows come
    out. An empty table gives no rows.
    """
    spark, numbers = df.sparkSession, sorted(numbers)
    if not numbers:
        return spark.createDataFrame([], f"{number} {df.schema[number].dataType.simpleString()}, {key} string, change_kind string")
    index = SnapshotIndex(spark, shared_path(spark, "index"), group, key, compared, version)
    deliveries = index.bucketed(df.where(F.col(number).isin(numbers)), number)
    found = []
    for n in numbers:
        changes = index.apply_hashed(deliveries.where(F.col(number) == n))
        found.append(written(changes.select(F.lit(n).cast(df.schema[number].dataType).alias(number), F.col("k").alias(key), "change_kind"), "changes"))
    return reduce(DataFrame.unionByName, found).distinct()
