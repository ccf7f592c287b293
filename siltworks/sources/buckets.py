"""Tables kept as hash buckets of Parquet files, changed key by key.

root/data/v=N/_bucket=B holds what version N wrote of bucket B; root/versions/N names the folders that make up each bucket
and how far each stream has come. A change writes new folders first and its version file last (under another name, then
renamed), so readers see the state before or after it, and a change that broke off leaves nothing but folders that no version
names. There is one writer at a time; readers may be many and go on with the version that they began with.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltworks.operators.graph import written

BUCKETS = 64
#: Keys of rows that leave up to which they are sent to every task; told by a count.
FEW_KEYS = 1_000_000
#: Files a bucket, on average, beyond which a replacement gathers buckets into one file each again.
MOST_FILES = 32


class Files:
    """Names below a folder in any file system that Spark opens."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm.org.apache.hadoop.fs
        self.root = self.jvm.Path(root)
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.Path(self.root, name)

    def names(self, name: str) -> list[str]:
        at = self.path(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """A new file, seen whole or not at all; refuses a name that is taken."""
        if self.fs.exists(self.path(name)):
            raise FileExistsError(name)
        folder, _, last = name.rpartition("/")
        draft = self.path(f"{folder}/_{last}.draft" if folder else f"_{last}.draft")
        stream = self.fs.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.fs.rename(draft, self.path(name)):
            raise FileExistsError(name)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


@dataclass
class Version:
    """folders: by bucket, the versions whose folders hold it; batches: the last batch of each stream that is in."""

    number: int = 0
    schema: dict | None = None
    folders: dict[str, list[int]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


class BucketTable:
    def __init__(self, spark: SparkSession, root: str, keys: tuple[str, ...], buckets: int = BUCKETS):
        """buckets: of a new table; choose it so that a bucket fits a task well. An existing table keeps its own, given alike."""
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), tuple(keys), buckets
        self.files = Files(spark, self.root)

    # ---- versions ----
    def version(self) -> Version:
        numbers = [int(n) for n in self.files.names("versions") if n.isdigit()]
        if not numbers:
            return Version()
        told = json.loads(self.files.read(f"versions/{max(numbers)}"))
        if (told.pop("keys"), told.pop("buckets")) != (list(self.keys), self.buckets):
            raise ValueError(f"{self.root} has other keys or another number of buckets")
        return Version(**told)

    def _commit(self, now: Version) -> Version:
        self.files.put(f"versions/{now.number}", json.dumps(vars(now) | {"keys": self.keys, "buckets": self.buckets}))
        return now

    def _next(self, now: Version, batch: tuple[str, int] | None, folders: dict | None = None, schema: dict | None = None) -> Version:
        batches = now.batches | ({batch[0]: batch[1]} if batch else {})
        return Version(now.number + 1, schema or now.schema, now.folders if folders is None else folders, batches)

    def _seen(self, now: Version, batch: tuple[str, int] | None) -> bool:
        return batch is not None and now.batches.get(batch[0], -1) >= batch[1]

    # ---- rows ----
    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _same_key(self, a: DataFrame, b: DataFrame) -> Column:
        """Keys may be null; null equals null."""
        match = F.lit(True)
        for k in self.keys:
            match &= a[k].eqNullSafe(b[k])
        return match

    def read(self, at: Version | None = None, buckets: set[int] | None = None) -> DataFrame | None:
        """All rows, or those of some buckets; None where nothing was ever written."""
        at = at or self.version()
        if at.schema is None:
            return None
        schema = StructType.fromJson(at.schema)
        paths = [f"{self.root}/data/v={v}/_bucket={b}" for b, held in at.folders.items() if buckets is None or int(b) in buckets for v in held]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, number: int) -> list[int]:
        """The buckets written. A folder left by a change that broke off is replaced."""
        folder = f"data/v={number}"
        rows.withColumn("_bucket", self._bucket()).repartition("_bucket").sortWithinPartitions("_bucket", *self.keys).write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        return [int(n.removeprefix("_bucket=")) for n in self.files.names(folder) if n.startswith("_bucket=")]

    def _keep(self, rows: DataFrame, number: int) -> list[int]:
        """Beside what _write() wrote: rows that come from the table, each task's own to their buckets, without a shuffle. The buckets that hold something now."""
        folder = f"data/v={number}"
        rows.withColumn("_bucket", self._bucket()).write.mode("append").partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        return [int(n.removeprefix("_bucket=")) for n in self.files.names(folder) if n.startswith("_bucket=")]

    def append(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """Add rows beside those that their keys already have; a batch that is in already changes nothing (False)."""
        now = self.version()
        if self._seen(now, batch):
            return False
        folders = dict(now.folders)
        for b in self._write(rows, now.number + 1):
            folders[str(b)] = [*folders.get(str(b), []), now.number + 1]
        self._commit(self._next(now, batch, folders, rows.schema.jsonValue()))
        return True

    def upsert(self, rows: DataFrame, order: tuple[str, ...], batch: tuple[str, int] | None = None) -> dict[str, int]:
        """One row a key: of the table's and the arriving ones that with the greatest order.

        An arriving row whose other columns equal the table's changes nothing, whatever its order; of arriving rows that
        tie, one is taken by a hash of the row. Only buckets in which something changes are written anew. A batch
        (stream, number) that is in already is passed over, so a replayed micro-batch is safe. Gives arrived (keys),
        changed (rows) and buckets (written).
        """
        now = self.version()
        if self._seen(now, batch):
            return {"arrived": 0, "changed": 0, "buckets": 0}
        columns = rows.columns
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*columns), F.struct(*order, F.xxhash64(*columns))).alias("r")).select("r.*")
        newest = written(newest.withColumn("_bucket", self._bucket()))
        there = {r[0] for r in newest.select("_bucket").distinct().collect()}  # at most as many as buckets
        held = self.read(now, there)
        if held is not None:
            told = held.select(*self.keys, *(F.col(c).alias(f"_was_{c}") for c in columns if c not in self.keys), F.lit(True).alias("_had"))
            later = F.struct(*order) > F.struct(*(F.col(f"_was_{c}") for c in order))
            same = F.lit(True)
            for c in columns:
                if c not in self.keys and c not in order:
                    same &= F.col(c).eqNullSafe(F.col(f"_was_{c}"))
            joined = newest.join(told, self._same_key(newest, told), "left").where(F.col("_had").isNull() | (later & ~same))
            changed = written(joined.select(*(newest[c] for c in columns), newest["_bucket"]))
        else:
            changed = newest
        touched = {r[0] for r in changed.select("_bucket").distinct().collect()}
        fresh = changed.select(*columns)
        counts = {"arrived": newest.count(), "changed": fresh.count(), "buckets": len(touched)}
        folders = dict(now.folders)
        if touched:
            kept = self.read(now, touched)
            whole = fresh if kept is None else kept.select(*columns).join(fresh.select(*self.keys), self._same_key(kept, fresh), "left_anti").unionByName(fresh)
            folders |= {str(b): [now.number + 1] for b in self._write(whole, now.number + 1)}
        self._commit(self._next(now, batch, folders, rows.schema.jsonValue()))
        return counts

    def replace(self, rows: DataFrame, gone: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """rows become all that the keys in gone (which holds rows' keys too) have, any number a key. Gives the buckets written."""
        now = self.version()
        if self._seen(now, batch):
            return 0
        left = written(gone.select(*self.keys).distinct().withColumn("_bucket", self._bucket()))
        touched = {r[0] for r in left.select("_bucket").distinct().collect()}
        folders, kept = dict(now.folders), self.read(now, touched)
        new = []
        if touched and kept is not None:
            keys = left.select(*self.keys)
            stays = kept.join(F.broadcast(keys) if left.count() <= FEW_KEYS else keys, self._same_key(kept, left), "left_anti").select(*rows.columns)
            if len(kept.inputFiles()) > MOST_FILES * len(touched):
                new = self._write(stays.unionByName(rows), now.number + 1)
            else:
                self._write(rows, now.number + 1)
                new = self._keep(stays, now.number + 1)
        elif touched:
            new = self._write(rows, now.number + 1)
        folders = {b: held for b, held in folders.items() if int(b) not in touched} | {str(b): [now.number + 1] for b in new}
        self._commit(self._next(now, batch, folders, rows.schema.jsonValue()))
        return len(touched)

    # ---- upkeep ----
    def compact(self, newest_by: tuple[str, ...], where: Column | None = None, most_folders: int = 1) -> int:
        """Buckets of more than most_folders folders become one folder each, with the newest row of a key, if it fits where. Gives the buckets merged."""
        now = self.version()
        heavy = {int(b) for b, held in now.folders.items() if len(held) > most_folders}
        if not heavy:
            return 0
        rows = self.read(now, heavy)
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*newest_by, F.xxhash64(*rows.columns))).alias("r")).select("r.*")
        new = self._write(newest if where is None else newest.where(where), now.number + 1)
        folders = {b: held for b, held in now.folders.items() if int(b) not in heavy} | {str(b): [now.number + 1] for b in new}
        self._commit(self._next(now, None, folders))
        return len(heavy)

    def clear(self) -> None:
        """No rows from the next version on; streams keep their place."""
        now = self.version()
        self._commit(self._next(now, None, {}))

    def vacuum(self, keep: int = 2) -> int:
        """Delete folders that none of the last `keep` versions names, and older version files. Gives the folders deleted.

        Readers of older versions lose them, so keep as many as may still be read.
        """
        numbers = sorted(int(n) for n in self.files.names("versions") if n.isdigit())
        live = numbers[-keep:]
        named = {(b, v) for n in live for b, held in json.loads(self.files.read(f"versions/{n}"))["folders"].items() for v in held}
        gone = 0
        for folder in self.files.names("data"):
            v = int(folder.removeprefix("v="))
            inside = [n for n in self.files.names(f"data/{folder}") if n.startswith("_bucket=")]
            dead = [n for n in inside if (n.removeprefix("_bucket="), v) not in named]
            if v > numbers[-1]:
                continue  # a change under way
            for n in dead:
                self.files.delete(f"data/{folder}/{n}")
            gone += len(dead)
            if len(dead) == len(inside):
                self.files.delete(f"data/{folder}")
        for n in numbers[:-keep]:
            self.files.delete(f"versions/{n}")
        return gone
