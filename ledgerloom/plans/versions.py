"""Tables that change in whole, numbered versions: a statement with its pages and rows, or a
merge, is seen all or not at all, also when a driver dies half way.

A change is staged first, each table's rows in a folder of their own that no reader knows;
then one log file names the staged folders under the next version's number.  The file is
made complete under another name and renamed only where the number is free, so of two
writers one wins and the other looks at the new version and tries again.  A batch has an
id made from its content: a repeated one finds its own entry.  What was staged and never
named is swept.

Readers join a table's files, partitioned by folder and bucket, with the log's entries, a
broadcast join on partition columns that prunes files at runtime and moves no row; what is
sent is a line of the log for each version of the table, or for each bucket of a merged one.  The log is folded into one table from time to time.

Tables with keys are kept in buckets of the keys' hash.  ``merge`` reads and rewrites only
buckets with keys of the batch and names only those in which a row changed, so that a
batch that changes nothing makes no version.

The number is free or taken by a rename that must not overwrite: HDFS gives that, object
stores need a committer that does.  Edge cases: null keys are keys like others (null equals
null); of rows with one key the last by ``ordinal`` wins, and its first one gives what a new
row is seeded with; an empty batch changes nothing; columns beside the table's are left out.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .shared import shared_folder

LOG = "version long, batch string, table string, bucket int, folder string"
#: The entry that every version has, for its batch.
BATCH = "(batch)"


def content_id(frame: DataFrame, column: str) -> str:
    """An id of a set of rows by the values of one column, whatever their order."""
    h = F.xxhash64(column)
    r = frame.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64(column, F.lit(1))).alias("x")).first()
    return uuid.uuid5(uuid.NAMESPACE_OID, f"{r['n']}|{r['s']}|{r['x']}").hex


class Store:
    """``tables`` has the columns of each table (DDL), ``keys`` those of tables that are merged."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, str], keys: dict[str, tuple[str, ...]] | None = None, buckets: int = 64):
        self.spark, self.path, self.tables, self.keys, self.buckets = spark, path, tables, keys or {}, buckets
        jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(self._conf)

    @classmethod
    def temporary(cls, spark: SparkSession, *args, **kw) -> Store:
        """A store in the folder that the cluster shares."""
        return cls(spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}", *args, **kw)

    # --- files ---

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _names(self, *parts: str) -> list[str]:
        at = self._path(*parts)
        return [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _create(self, text: str, *parts: str) -> bool:
        """Make a file with this text, unless there is one."""
        sc = self.spark.sparkContext
        draft, at = self._path(*parts[:-1], f".{uuid.uuid4().hex}"), self._path(*parts)
        out = self._fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        rename = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
        try:
            sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri() if at.toUri().getScheme() else self._fs.getUri(), self._conf).rename(draft, at, sc._gateway.new_array(rename, 0))
            return True
        except Py4JJavaError:
            self._fs.delete(draft, False)
            if self._fs.exists(at):
                return False
            raise

    # --- the log ---

    def folded(self) -> int:
        """The newest version up to which the log is folded."""
        return max((int(n[:-5]) for n in self._names("folded") if n.endswith(".done")), default=0)

    def version(self) -> int:
        return max((int(n[:-5]) for n in self._names("log") if n.endswith(".json") and n[0] != "."), default=self.folded())

    def entries(self, version: int | None = None) -> DataFrame:
        """The log as rows, up to a version."""
        before, latest = self.folded(), self.version() if version is None else version
        if latest < before:
            raise ValueError(f"versions before {before} are folded")
        out = self.spark.createDataFrame([], LOG)
        if before:
            out = self.spark.read.schema(LOG).parquet(f"{self.path}/folded/{before}")
        if latest > before:
            out = out.unionByName(self.spark.read.schema(LOG).json(f"{self.path}/log").where(F.col("version").between(before + 1, latest)))
        return out

    def live(self, table: str, version: int | None = None) -> DataFrame:
        """(bucket, folder) of a table: every folder, or of merged ones the latest of a bucket."""
        own = self.entries(version).where(F.col("table") == table)
        return own.groupBy("bucket").agg(F.max_by("folder", "version").alias("folder")) if table in self.keys else own.select("bucket", "folder")

    def has(self, batch: str) -> bool:
        return not self.entries().where((F.col("table") == BATCH) & (F.col("batch") == batch)).isEmpty()

    def fold(self) -> int:
        """Write the log up to now as one table, then delete what it was made from."""
        latest = self.version()
        if latest > self.folded():
            all_rows = self.entries(latest)
            keep = all_rows.where(~F.col("table").isin(*self.keys)) if self.keys else all_rows
            for t in self.keys:
                now = all_rows.where(F.col("table") == t).groupBy("bucket").agg(F.max(F.struct("version", "batch", "folder")).alias("r"))
                keep = keep.unionByName(now.select("r.version", "r.batch", F.lit(t).alias("table"), "bucket", "r.folder"))
            keep.write.mode("overwrite").parquet(f"{self.path}/folded/{latest}")
            self._create("", "folded", f"{latest}.done")
            for n in self._names("log"):
                if n.endswith(".json") and n[0] != "." and int(n[:-5]) <= latest:
                    self._fs.delete(self._path("log", n), False)
            for n in self._names("folded"):
                if int(n.removesuffix(".done")) < latest:
                    self._fs.delete(self._path("folded", n), True)
        return latest

    # --- reading ---

    def _files(self, table: str, internal: bool = False) -> DataFrame:
        columns = f"{self.tables[table]}{', _changed boolean' if internal else ''}, folder string, bucket int"
        at = f"{self.path}/data/{table}"
        return self.spark.read.schema(columns).parquet(at) if self._fs.exists(self._path("data", table)) else self.spark.createDataFrame([], columns)

    def _rows(self, table: str, version: int | None) -> DataFrame:
        # rows of one folder have one key: a join that shuffles would sort them all in one task
        return self._files(table).join(F.broadcast(self.live(table, version)), ["bucket", "folder"], "left_semi")

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The rows of a table, now or at a version."""
        return self._rows(table, version).drop("folder", "bucket")

    # --- writing ---

    def stage(self, table: str, frame: DataFrame) -> str:
        """Write rows where no reader looks yet; the folder's name."""
        folder = f"f{uuid.uuid4().hex}"
        names = [f.name for f in self.spark.createDataFrame([], self.tables[table]).schema]
        extra = [c for c in ("_changed", "bucket") if c in frame.columns]
        if "bucket" not in extra:
            frame, extra = frame.withColumn("bucket", F.lit(0)), [*extra, "bucket"]
        frame.select(*names, *extra).write.partitionBy("bucket").parquet(f"{self.path}/data/{table}/folder={folder}")
        return folder

    def drop(self, staged: Iterable[tuple[str, str]]) -> None:
        for table, folder in staged:
            self._fs.delete(self._path("data", table, f"folder={folder}"), True)

    def name(self, base: int, batch: str, staged: Iterable[tuple[str, str, int]]) -> bool:
        """Make staged (table, folder, bucket) the version after ``base``, unless there is one."""
        lines = [{"version": base + 1, "batch": batch, "table": t, "bucket": b, "folder": f} for t, f, b in ((BATCH, "", 0), *staged)]
        if not self._create("\n".join(map(json.dumps, lines)) + "\n", "log", f"{base + 1:020d}.json"):
            return False
        if self.folded() > base:  # the number had been folded away: nobody reads this entry
            self._fs.delete(self._path("log", f"{base + 1:020d}.json"), False)
            return False
        return True

    def append(self, batch: str, frames: dict[str, DataFrame], base: int, anew: Callable[[], dict[str, DataFrame]]) -> int | None:
        """Add rows to tables as one version; None if the batch is in already.  ``frames`` were
        made from version ``base``; where another has come since, ``anew`` makes them again."""
        while not self.has(batch):
            staged = [(t, self.stage(t, f)) for t, f in frames.items()]
            if self.name(base, batch, [(t, f, 0) for t, f in staged]):
                return base + 1
            self.drop(staged)
            base = self.version()
            frames = anew()
        return None

    def merge(self, table: str, new: DataFrame, batch: str, ordinal: str, update: dict[str, Column], seed: dict[str, Column] | None = None, beside: Callable[[dict[str, int]], dict[str, DataFrame]] | None = None) -> dict[str, int]:
        """Merge rows by the table's keys: ``update`` has the columns that a stored row takes from
        the key's last row, ``seed`` further ones that a new row takes from its first (both are
        expressions over ``new``).  ``beside`` makes rows of other tables for the same version
        from the counts: rows inserted, updated (as if one by one) and changed in the end."""
        keys = self.keys[table]
        seed = seed or {}
        first, last = F.min_by(F.struct(*[c.alias(n) for n, c in seed.items()] or [F.lit(0).alias("_")]), ordinal), F.max_by(F.struct(*[c.alias(n) for n, c in update.items()] or [F.lit(0).alias("_")]), ordinal)
        one = new.groupBy(*keys).agg(first.alias("_first"), last.alias("_last"), F.count("*").alias("_n")).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int"))
        touched = one.select("bucket").distinct()
        n = one.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keys)], "_first", "_last", "_n", F.col("bucket").alias("_bucket"))
        names = [f.name for f in self.spark.createDataFrame([], self.tables[table]).schema]
        while True:
            base = self.version()
            stored = self._rows(table, base).drop("folder").join(F.broadcast(touched), "bucket", "left_semi").withColumn("_stored", F.lit(True))
            on = F.lit(True)
            for i, c in enumerate(keys):
                on = on & stored[c].eqNullSafe(n[f"_{i}"])
            j = stored.join(n, on, "full_outer")
            hit, inserted = F.col("_n").isNotNull(), F.col("_stored").isNull()
            differs = F.lit(False)
            for c in update:
                if c not in keys:
                    differs = differs | ~F.col(c).eqNullSafe(F.col(f"_last.{c}"))

            def value(c: str, hit: Column = hit, inserted: Column = inserted) -> Column:
                if c in keys:
                    return F.when(inserted, F.col(f"_{keys.index(c)}")).otherwise(F.col(c))
                if c in update:
                    return F.when(hit, F.col(f"_last.{c}")).otherwise(F.col(c))
                return F.when(inserted, F.col(f"_first.{c}")).otherwise(F.col(c)) if c in seed else F.col(c)

            seen = Observation()
            z = lambda c: F.coalesce(F.sum(c), F.lit(0))
            after = j.select(*[value(c).alias(c) for c in names], F.coalesce("bucket", "_bucket").alias("bucket"), (inserted | hit & differs).alias("_changed"), inserted.cast("long").alias("_i"), F.coalesce("_n", F.lit(0)).alias("_rows"))
            after = after.observe(seen, z(F.col("_i")).alias("inserted"), z(F.col("_rows") - F.col("_i")).alias("updated"), z(F.col("_changed").cast("long")).alias("changed"))
            folder = self.stage(table, after.repartition("bucket"))
            counts = dict(seen.get)
            buckets = self._files(table, True).where((F.col("folder") == folder) & F.col("_changed")).select("bucket").distinct().collect()  # self.buckets at most
            more = [(t, self.stage(t, f)) for t, f in (beside(counts) if beside else {}).items()] if buckets else []
            if not buckets or self.has(batch):
                self.drop([(table, folder), *more])
                return counts
            if self.name(base, batch, [*((table, folder, r["bucket"]) for r in buckets), *((t, f, 0) for t, f in more)]):
                return counts
            self.drop([(table, folder), *more])

    # --- tidying ---

    def sweep(self, older_than_ms: int = 24 * 3600 * 1000) -> int:
        """Delete what was staged so long ago and is in no version of the log."""
        import time

        until = time.time() * 1000 - older_than_ms
        found = [(t, f.getPath().getName()[7:]) for t in self._names("data") for f in self._fs.listStatus(self._path("data", t)) if f.getPath().getName().startswith("folder=") and f.getModificationTime() <= until]
        if not found:
            return 0
        orphans = self.spark.createDataFrame(found, "table string, folder string").join(self.entries(), ["table", "folder"], "left_anti").collect()
        self.drop([(r["table"], r["folder"]) for r in orphans])
        return len(orphans)
