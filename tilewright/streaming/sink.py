"""A table that streams upsert into: exactly once, with snapshots behind a pointer, prunes, and a report of batches.

Keys are dealt by hash into a fixed number of shards. A batch reads the shards that it touches, reduces old and new rows to
the last of each key, and writes those shards under its own number; others aren't read. A manifest names the version of
every shard, and the pointer to it is renamed into place last: readers see whole batches, a batch that failed halfway
leaves files that nothing names, and one that is sent again after it was committed is skipped by its number.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tilewright.operators.cache import upsert


@dataclass
class UpsertTable:
    """A table at path, a folder that all tasks and the driver share.

    keys: columns of a key; order: columns by which the last row of a key is told; size: the column of bytes. Every
    `every` batches a prune keeps, in each shard, the newest rows by order while their bytes are within budget.
    """

    path: str
    keys: list[str]
    order: list[str]
    shards: int = 64
    every: int = 0
    size: str | None = None
    budget: int = 0
    schema: str | None = field(default=None)

    def manifest(self) -> dict:
        """{batch, shards: {shard: version}, report} of the last committed batch; batch -1 before the first."""
        try:
            with open(f"{self.path}/CURRENT") as f:
                name = f.read()
            with open(f"{self.path}/{name}") as f:
                return json.load(f)
        except FileNotFoundError:
            return {"batch": -1, "shards": {}, "schema": self.schema}

    def _commit(self, manifest: dict) -> None:
        name = f"manifest-{manifest['batch']}-{uuid.uuid4().hex}.json"
        for target, text in ((name, json.dumps(manifest)), ("CURRENT", name)):
            part = f"{self.path}/.{uuid.uuid4().hex}"
            with open(part, "w") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            os.replace(part, f"{self.path}/{target}")

    def _read(self, spark: SparkSession, shards: dict, schema) -> DataFrame | None:
        paths = [f"{self.path}/v={version}/_shard={shard}" for shard, version in shards.items()]
        paths = [p for p in paths if os.path.isdir(p)]  # a shard whose rows were all pruned has no folder
        return spark.read.schema(schema).parquet(*paths) if paths else None

    def read(self, spark: SparkSession) -> DataFrame | None:
        """The rows of the last committed batch; None before the first."""
        m = self.manifest()
        return None if not m["schema"] else self._read(spark, m["shards"], m["schema"])

    def write(self, batch: DataFrame, number: int) -> bool:
        """Takes a batch in; False if it was committed before."""
        spark, before = batch.sparkSession, self.manifest()
        if number <= before["batch"]:
            return False
        os.makedirs(self.path, exist_ok=True)
        shard = F.pmod(F.xxhash64(*self.keys), F.lit(self.shards)).cast("int")
        ddl = ", ".join(f"`{n}` {t}" for n, t in batch.dtypes)
        prunes = bool(self.every) and (number + 1) % self.every == 0
        touched = list(range(self.shards)) if prunes else sorted(r[0] for r in batch.select(shard).distinct().collect())  # as many as shards at most
        own = {str(s): before["shards"][str(s)] for s in touched if str(s) in before["shards"]}
        old = self._read(spark, own, ddl)
        rows = upsert(batch if old is None else old, batch if old is not None else batch.limit(0), self.keys, self.order).select(batch.columns).withColumn("_shard", shard)
        if prunes:
            from pyspark.sql import Window

            newest = Window.partitionBy("_shard").orderBy(*(F.desc(c) for c in self.order), *self.keys).rowsBetween(Window.unboundedPreceding, 0)
            rows = rows.withColumn("_running", F.sum(self.size).over(newest)).where(F.col("_running") <= self.budget).drop("_running")
        version = f"{number}-{uuid.uuid4().hex}"
        rows.repartition("_shard").write.partitionBy("_shard").parquet(f"{self.path}/v={version}")
        shards = before["shards"] | {str(s): version for s in touched}
        report = [*before.get("report", []), {"batch": number, "touched": len(touched), "pruned": prunes}][-1000:]
        self._commit({"batch": number, "shards": shards, "schema": ddl, "report": report})
        return True

    def stream(self, rows: DataFrame, checkpoint: str) -> DataStreamWriter:
        """A writer of a stream into this table, ready to start."""
        return rows.writeStream.foreachBatch(lambda batch, number: self.write(batch, number) and None).option("checkpointLocation", checkpoint)
