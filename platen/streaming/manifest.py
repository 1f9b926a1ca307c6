"""A table of buckets with versions: a manifest names the live version of each bucket, and is written last.

Data of a batch lie in ``version=<epoch>/bucket=<k>``; the manifest of the batch is
a small file in a folder beside the table. A reader opens the last manifest and the
folders that it names, so what a read costs doesn't depend on how many batches there
were. What a batch wrote before it broke down is in no manifest and is overwritten
when it runs again. The last ``KEPT`` manifests are kept, for batches that run again
and for readers that are at work; versions that none of them names are deleted.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

KEPT = 8


class Folder:
    """A folder of the session's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        at = self._at(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """The whole file or none: written beside its place and then renamed."""
        beside = self._at(f"{name}.tmp")
        stream = self.fs.create(beside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.delete(name)
        self.fs.rename(beside, self._at(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


class Buckets:
    """The live versions of a table's buckets."""

    def __init__(self, spark: SparkSession, table: str):
        self.spark, self.folder, self.manifests = spark, Folder(spark, table), Folder(spark, f"{table.rstrip('/')}.manifest")

    def epochs(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.manifests.names() if n.endswith(".json") and not n.startswith(".")]

    def live(self, before: int | None = None) -> dict[int, int]:
        """Bucket -> version, by the last manifest (of those before an epoch)."""
        found = [e for e in self.epochs() if before is None or e < before]
        return {int(k): v for k, v in json.loads(self.manifests.read(f"{max(found):012d}.json")).items()} if found else {}

    def read(self, schema: str, live: dict[int, int]) -> DataFrame:
        """The rows of these buckets' versions, with both as columns."""
        paths = [f"{self.folder.path}/version={v}/bucket={k}" for k, v in sorted(live.items())]
        reader = self.spark.read.schema(f"{schema}, version int, bucket int").option("basePath", self.folder.path)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], f"{schema}, version int, bucket int")

    def commit(self, epoch: int, touched: list[int]) -> None:
        """Makes an epoch's versions of the touched buckets the live ones, then deletes what no kept manifest names."""
        live = self.live(epoch) | dict.fromkeys(touched, epoch)
        self.manifests.write(f"{epoch:012d}.json", json.dumps(live))
        self.compact()

    def compact(self) -> None:
        kept = sorted(self.epochs())[-KEPT:]
        named = {(v, k) for e in kept for k, v in self.live(e + 1).items()}
        for name in self.folder.names():
            if name.startswith("version=") and int(name[8:]) <= max(kept, default=-1):
                version = int(name[8:])
                for bucket in self.folder.names(name):
                    if bucket.startswith("bucket=") and (version, int(bucket[7:])) not in named:
                        self.folder.delete(f"{name}/{bucket}")
                if not any(b.startswith("bucket=") for b in self.folder.names(name)):
                    self.folder.delete(name)
        for e in set(self.epochs()) - set(kept):
            self.manifests.delete(f"{e:012d}.json")
