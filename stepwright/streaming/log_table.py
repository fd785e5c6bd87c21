"""The latest row per key of an append-only log, kept as deltas in hash buckets.

A batch is written as one delta: its last row per key, dealt by a hash of the key into
buckets, and a commit file that names the folder. So a batch writes in proportion to
itself, and one that is run again finds its commit and changes nothing. A reader takes
the base and the deltas of each bucket and keeps the last row of each key. A bucket
that has gathered ``max_deltas`` is compacted: only its files are read and written,
and the commit then says of every bucket which folders are live, so that a reader
never lists more than the commits since. Folders that no commit names are removed by
``vacuum``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.archives import last_per_key
from ..sources.store import Store

_BUCKET = "_bucket"


class LogTable:
    """A table below ``root``; one writer at a time, any number of readers."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str] | None = None, order: list[str] | None = None, schema: StructType | str | None = None, buckets: int = 32, max_deltas: int = 8):
        self.spark, self.root, self.store = spark, root.rstrip("/"), Store(spark, root)
        if not self.store.exists("table.json"):
            if not keys or not order or not schema:
                raise FileNotFoundError(f"{root} is no table: keys, order and schema are needed to make it")
            kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
            self.store.write("table.json", json.dumps({"keys": keys, "order": order, "schema": kind.jsonValue(), "buckets": buckets, "max_deltas": max_deltas}))
        made = json.loads(self.store.read("table.json"))
        self.schema = StructType.fromJson(made["schema"])
        self.keys, self.order, self.buckets, self.max_deltas = (made[k] for k in ("keys", "order", "buckets", "max_deltas"))

    def _commits(self) -> list[str]:
        return [n for n in self.store.names("commits") if n.endswith(".json")]

    def live(self) -> dict[int, list[str]]:
        """The folders of each bucket, oldest first: those of the last compaction and the deltas since."""
        names = self._commits()
        last = max((i for i, n in enumerate(names) if ".live" in n), default=None)
        out = {} if last is None else {int(b): f for b, f in json.loads(self.store.read(f"commits/{names[last]}"))["live"].items()}
        for n in names[0 if last is None else last + 1 :]:
            c = json.loads(self.store.read(f"commits/{n}"))
            for b in c["buckets"]:
                out.setdefault(b, []).append(c["folder"])
        return out

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _write(self, df: DataFrame, tag: str) -> tuple[str, list[int]]:
        """Write rows by bucket; the folder and the buckets that have rows."""
        folder = f"data/{tag}-{uuid.uuid4().hex}"
        df.withColumn(_BUCKET, self._bucket()).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.root}/{folder}")
        return folder, sorted(int(n.split("=")[1]) for n in self.store.names(folder) if n.startswith(f"{_BUCKET}="))

    def _read(self, live: dict[int, list[str]]) -> DataFrame:
        paths = [f"{self.root}/{f}/{_BUCKET}={b}" for b, folders in sorted(live.items()) for f in folders]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def append(self, batch: DataFrame, epoch: int) -> bool:
        """Add the rows of a batch; False, and nothing is written, if this epoch is in the table."""
        name = f"{epoch:012d}"
        if any(n.startswith(name) for n in self._commits()):
            return False
        folder, buckets = self._write(last_per_key(batch, self.keys, self.order), f"delta-{name}")
        self.store.write(f"commits/{name}.json", json.dumps({"folder": folder, "buckets": buckets}))
        self.compact()
        return True

    def compact(self, at: int | None = None) -> list[int]:
        """Merge the files of buckets with ``at`` deltas or more; the buckets that were."""
        live, at = self.live(), at or self.max_deltas
        full = sorted(b for b, folders in live.items() if len(folders) > at)
        if not full:
            return []
        folder, _ = self._write(last_per_key(self._read({b: live[b] for b in full}), self.keys, self.order), "base")
        names = self._commits()  # that of a compaction sorts after the epoch's own, and after earlier ones
        turn = sum(".live" in n for n in names)
        self.store.write(f"commits/{names[-1].split('.')[0]}.live{turn:09d}.json", json.dumps({"live": live | {b: [folder] for b in full}}))
        return full

    def read(self) -> DataFrame:
        """The last row of each key."""
        return last_per_key(self._read(self.live()), self.keys, self.order)

    def vacuum(self) -> list[str]:
        """Remove folders that are not live, once no reader holds an older state; their names."""
        live = {f for folders in self.live().values() for f in folders}
        gone = [n for n in self.store.names("data") if f"data/{n}" not in live]
        for n in gone:
            self.store.remove(f"data/{n}")
        return gone
