"""Datasets in versions: an import is written beside what is there and takes effect when its manifest is published.

A dataset is some tables (records, fields, reports ...) under one id. Each version's tables lie in a folder of their own;
a manifest, one small file that is renamed into place, says which version counts. So readers see the old version or the
new one, a write that fails leaves the old one as it was, and of two writers that publish at once one fails. Dropping a
dataset takes its manifest away first, and then all tables of all its versions: nothing that belongs to it stays.

Defined results: a dataset without rows can be saved and loaded; one that is not there raises KeyError; ids are letters,
digits, '-', '_' and '.'.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Datasets:
    """The datasets in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [f.getPath().getName() for f in self.fs.listStatus(path)] if self.fs.exists(path) else []

    @staticmethod
    def _checked(dataset: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_-][A-Za-z0-9._-]*", dataset):
            raise ValueError(f"dataset id {dataset!r}: letters, digits, '-', '_' and '.'")
        return dataset

    def _number(self, dataset: str) -> int:
        """The number of the last published version, 0 if there is none."""
        return max((int(n) for n in self._names(f"manifests/{self._checked(dataset)}") if n.isdigit()), default=0)

    def manifest(self, dataset: str) -> dict:
        number = self._number(dataset)
        if not number:
            raise KeyError(dataset)
        return json.loads(self.spark.read.text(str(self._path(f"manifests/{dataset}/{number}")), wholetext=True).first()[0])

    def save(self, dataset: str, tables: dict[str, DataFrame], **about) -> dict:
        """Writes the tables as a new version and publishes it; older versions stay until ``tidy``."""
        number, version = self._number(dataset) + 1, uuid.uuid4().hex
        try:
            rows = {}
            for name, df in tables.items():
                path = str(self._path(f"data/{dataset}/{version}/{self._checked(name)}"))
                df.write.option("compression", "zstd").parquet(path)
                rows[name] = self.spark.read.parquet(path).count()
            made = {"dataset": dataset, "number": number, "version": version, "rows": rows, "about": about}
            self._publish(f"manifests/{dataset}", number, json.dumps(made, sort_keys=True))
        except Exception:
            self.fs.delete(self._path(f"data/{dataset}/{version}"), True)
            raise
        return made

    def _publish(self, folder: str, number: int, content: str) -> None:
        self.fs.mkdirs(self._path(folder))
        draft, place = self._path(f"{folder}/.{uuid.uuid4().hex}"), self._path(f"{folder}/{number}")
        out = self.fs.create(draft, False)
        out.write(bytearray(content.encode()))
        out.close()
        if self.fs.exists(place) or not self.fs.rename(draft, place):
            self.fs.delete(draft, False)
            raise RuntimeError(f"version {number} was published by another writer")

    def load(self, dataset: str, table: str = "records") -> DataFrame:
        """A table of the version that counts now; it goes on being read though another is published meanwhile."""
        made = self.manifest(dataset)
        if table not in made["rows"]:
            raise KeyError(f"{dataset}: {table}")
        return self.spark.read.parquet(str(self._path(f"data/{dataset}/{made['version']}/{table}")))

    def listed(self) -> DataFrame:
        """(dataset, number, table, rows) of the versions that count."""
        made = [self.manifest(d) for d in sorted(self._names("manifests")) if self._number(d)]
        return self.spark.createDataFrame([(m["dataset"], m["number"], t, n) for m in made for t, n in m["rows"].items()], "dataset string, number int, table string, rows long")

    def all_of(self, table: str = "records") -> DataFrame:
        """A table of all datasets that have it, with their id as ``dataset``; columns that some lack are null there."""
        out = None
        for row in self.listed().where(F.col("table") == table).select("dataset").collect():
            one = self.load(row.dataset, table).withColumn("dataset", F.lit(row.dataset))
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        if out is None:
            raise KeyError(table)
        return out

    def tidy(self, dataset: str) -> int:
        """Deletes versions that do not count any more, and what failed writes left; how many."""
        now, gone = self.manifest(dataset), 0
        for name in self._names(f"manifests/{dataset}"):
            if name != str(now["number"]):
                self.fs.delete(self._path(f"manifests/{dataset}/{name}"), False)
        for version in self._names(f"data/{dataset}"):
            if version != now["version"]:
                gone += bool(self.fs.delete(self._path(f"data/{dataset}/{version}"), True))
        return gone

    def drop(self, dataset: str) -> None:
        self.manifest(dataset)
        self.fs.delete(self._path(f"manifests/{dataset}"), True)
        self.fs.delete(self._path(f"data/{dataset}"), True)
