"""Tables under one folder in versions: a base with all rows, and changes that hold new rows and the ids they touch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Versions:
    """Readers leave out rows of older versions whose id was touched later.

    The versions that count are named by their markers (`base-` with all rows, `done-` for changes), written last, so
    readers never see half a change. A writer claims its number first; where a claim has no marker, another writer is at
    work (or has died: then remove its `claim-` file), and the call fails before it writes anything.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str) -> None:
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key

    def _path(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> dict[str, set[int]]:
        path, fs = self._path()
        out: dict[str, set[int]] = {"base": set(), "done": set(), "claim": set()}
        for status in fs.listStatus(path) if fs.exists(path) else ():
            kind, _, number = status.getPath().getName().partition("-")
            if kind in out and number.isdigit():
                out[kind].add(int(number))
        return out

    def layers(self) -> list[int]:
        """The newest version with all rows and the changes since; empty where nothing was written yet."""
        found = self._numbers()
        if found["done"] and not found["base"]:
            raise ValueError(f"{self.folder} has changes but no version with all rows; write its tables anew into another folder")
        base = max(found["base"], default=0)
        return [base, *sorted(n for n in found["done"] if n > base)] if base else []

    def version(self) -> int:
        """The newest complete version; 0 before the first."""
        return max(self.layers(), default=0)

    def schema_of(self, name: str, layers: list[int]) -> str | None:
        """The schema of a table that is written in folders by a column, and so may have no file to tell it."""
        return None

    def of(self, layers: list[int], name: str) -> DataFrame:
        """Rows of a table in some versions, with their version as _layer."""
        schema = self.schema_of(name, layers)
        read = self.spark.read.schema(schema) if schema else self.spark.read
        rows = (read.parquet(f"{self.folder}/v{n}/{name}").withColumn("_layer", F.lit(n)) for n in layers)
        return reduce(DataFrame.unionByName, rows)

    def live(self, rows: DataFrame, layers: list[int]) -> DataFrame:
        """Rows (key, _layer) whose key no later version touched."""
        if len(layers) < 2:
            return rows
        columns = rows.columns
        touched = self.of(layers[1:], "touched").groupBy(self.key).agg(F.max("_layer").alias("_last"))
        return rows.join(touched, self.key, "left").filter("_last is null or _layer >= _last").select(*columns)

    def read(self, name: str) -> DataFrame | None:
        layers = self.layers()
        return self.live(self.of(layers, name), layers).drop("_layer") if layers else None

    def write(self, tables: dict[str, DataFrame], kind: str = "base", by: dict[str, str] | None = None) -> int:
        """Write a version; by: tables whose folders are the values of a column."""
        found = self._numbers()
        n = max((0, *found["base"], *found["done"])) + 1
        if max(found["claim"], default=0) >= n:
            raise RuntimeError(f"another writer is at work in {self.folder}")
        path, fs = self._path(f"claim-{n}")
        if not fs.createNewFile(path):
            raise RuntimeError(f"another writer is at work in {self.folder}")
        try:
            for name, df in tables.items():
                writer = df.write.mode("overwrite")
                (writer.partitionBy(by[name]) if by and name in by else writer).parquet(f"{self.folder}/v{n}/{name}")
            self._path(f"{kind}-{n}")[1].createNewFile(self._path(f"{kind}-{n}")[0])
        finally:
            fs.delete(path, False)
        return n
