"""Work by shards that goes on where it stopped: finished shards are named by small files, each written at once."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F


@dataclass
class ShardRun:
    """A folder that all machines share. `parts` holds the rows of shards, `done` a file for each step that ended.

    A step writes its rows first and then its file, by a rename; what a stopped step left is named nowhere and never
    read. Files carry the sign of the work that wrote them: steps of other work or other input do not count.
    """

    spark: SparkSession
    path: str
    sign: str

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _file(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def finished(self) -> dict[int, str]:
        """The part of each shard that is done."""
        fs = self._fs()
        if not fs.exists(self._file("done")):
            return {}
        out = {}
        for status in sorted(fs.listStatus(self._file("done")), key=lambda s: s.getPath().getName()):
            name = status.getPath().getName()
            if name.startswith("."):
                continue
            data = bytearray()
            stream = fs.open(status.getPath())
            while (b := stream.read()) >= 0:
                data.append(b)
            stream.close()
            said = json.loads(data.decode())
            if said["sign"] == self.sign:
                out |= {s: said["part"] for s in said["shards"] if s not in out}
        return out

    def _commit(self, part: str, shards: list[int]) -> None:
        fs = self._fs()
        fs.mkdirs(self._file("done"))
        draft = self._file(f"done/.{part}")
        stream = fs.create(draft)
        stream.write(json.dumps({"sign": self.sign, "part": part, "shards": shards}).encode())
        stream.close()
        if not fs.rename(draft, self._file(f"done/{part}")):
            raise OSError(f"{self.path}: the end of a step could not be written")

    def run(self, df: DataFrame, shards: int, work: Callable[[DataFrame], DataFrame], together: int, steps: int | None = None) -> DataFrame | None:
        """The rows of work(df) where work may be done shard by shard (df has a column shard, 0..shards-1): `together` shards
        a step, those done before left out. After `steps` steps it stops and gives None: another run goes on."""
        left = [s for s in range(shards) if s not in self.finished()]
        for n, at in enumerate(range(0, len(left), together)):
            if n == steps:
                return None
            now = left[at : at + together]
            part = uuid.uuid4().hex
            work(df.where(F.col("shard").isin(now))).write.option("compression", "zstd").parquet(f"{self.path}/parts/{part}")
            self._commit(part, now)
        done = sorted(set(self.finished().values()))
        schema = work(df.limit(0)).schema
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/parts/{p}" for p in done)) if done else self.spark.createDataFrame([], schema)
