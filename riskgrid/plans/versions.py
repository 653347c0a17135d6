"""A table of months that readers always see whole: new months go to new files, then one small file makes them valid.

Below the table's folder lie ``data/<run>/month=YYYY-MM`` with the rows and ``versions/<number>.json`` with what is valid: a
map from month to folder. A version is written under another name and then renamed to its number, which no two writers
can do for the same number; who comes second fails and starts again. Readers take the highest number. Nothing that a
version names is changed later, so a reader that began with it goes on with it.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from riskgrid.plans.incremental import upsert
from riskgrid.session import cut_lineage

MONTH = "__month"


class Conflict(RuntimeError):
    """Another writer has made the next version."""


class Table:
    """A versioned table in a folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str, date: str = "Date"):
        self.spark, self.path, self.date = spark, path.rstrip("/"), date
        self._jvm = spark.sparkContext._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def version(self) -> int:
        """The number of the newest version, 0 before the first."""
        folder = self._at("versions")
        if not self._files.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def _valid(self, number: int) -> dict:
        if not number:
            return {"schema": None, "months": {}}
        rows = self.spark.read.text(f"{self.path}/versions/{number:012d}.json", wholetext=True).collect()
        return json.loads(rows[0][0])

    def months(self, number: int | None = None) -> dict[str, str]:
        """Folder of each month in a version (the newest by default)."""
        return self._valid(self.version() if number is None else number)["months"]

    def read(self, number: int | None = None, months: Sequence[str] | None = None) -> DataFrame:
        """Rows of a version (the newest by default), of some months only if wished."""
        valid = self._valid(self.version() if number is None else number)
        if valid["schema"] is None:
            raise FileNotFoundError(f"{self.path} has no version yet")
        schema = StructType.fromJson(valid["schema"])
        folders = [f"{self.path}/{f}" for m, f in sorted(valid["months"].items()) if months is None or m in months]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _commit(self, number: int, valid: dict) -> None:
        draft = self._at("versions", f".{uuid4()}")
        out = self._files.create(draft, False)
        out.write(bytearray(json.dumps(valid).encode()))
        out.close()
        final = self._at("versions", f"{number:012d}.json")
        if self._files.exists(final) or not self._files.rename(draft, final):
            self._files.delete(draft, False)
            raise Conflict(f"version {number} of {self.path} exists")

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Rows to new folders by month; a month with many rows is split into files, small ones are joined."""
        run = f"data/{uuid4()}"
        dealt = rows.withColumn(MONTH, F.coalesce(F.date_format(self.date, "yyyy-MM"), F.lit("none")))
        dealt.hint("rebalance", MONTH).sortWithinPartitions(MONTH, self.date).write.partitionBy(MONTH).parquet(f"{self.path}/{run}")
        folder = self._at(run)
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return {n.split("=", 1)[1]: f"{run}/{n}" for n in names if n.startswith(f"{MONTH}=")}

    def replace(self, rows: DataFrame) -> int:
        """Make ``rows`` the whole table; returns the new version's number."""
        number = self.version() + 1
        self._commit(number, {"schema": json.loads(rows.schema.json()), "months": self._write(rows)})
        return number

    def upsert(self, new: DataFrame, key: Sequence[str]) -> int:
        """Add rows or replace those of the same key; reads and writes the touched months only.

        Repeated keys are settled as in ``incremental.upsert``. Rows without a date are a month of their own. A key is expected
        to keep its date; a row whose date moves to another month is a new row there.
        """
        number = self.version()
        if not number:
            return self.replace(upsert(new.limit(0), new, key))
        valid = self._valid(number)
        new = cut_lineage(new)
        touched = [r[0] for r in new.select(F.coalesce(F.date_format(self.date, "yyyy-MM"), F.lit("none"))).distinct().collect()]
        stored = self.read(number, touched).select(*new.columns)
        months = valid["months"] | self._write(upsert(stored, new, key))
        self._commit(number + 1, {"schema": json.loads(new.schema.json()), "months": months})
        return number + 1
