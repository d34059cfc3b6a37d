"""Tables whose readers never see half a load.

A load writes its rows to a folder of their own and then commits: it creates the next numbered file
under `commits`, which lists the folders that make up the table from then on. Creating that file
is the one step that counts, and only one writer can create a number. A reader takes the newest
commit when it opens the table and stays with it. A load that fails leaves the commits as they
were; what it wrote is never listed, and `clear` removes it.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

WHOLE = ""  # the part of a table that is not divided


class Conflict(RuntimeError):
    """Another load has committed since this one began."""


class VersionedTable:
    """A table under `root`; part: the column by which single parts can be replaced, if any."""

    def __init__(self, spark: SparkSession, root: str, part: str | None = None):
        self.spark, self.root, self.part = spark, root.rstrip("/"), part

    def _store(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _names(self, folder: str) -> list[str]:
        fs, place = self._store(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []

    def newest(self) -> int:
        """Number of the last commit; 0 if there is none."""
        numbers = [int(n) for n in self._names("commits") if n.isdigit()]
        return max(numbers, default=0)

    def listed(self, number: int) -> dict[str, str]:
        """The folder of each part, as of a commit."""
        if not number:
            return {}
        lines = self.spark.read.option("wholetext", True).text(f"{self.root}/commits/{number:012d}")
        return json.loads(lines.first()[0])

    def _commit(self, number: int, folders: dict[str, str]) -> None:
        # Written aside and renamed: whoever sees the number sees the whole list.
        fs, aside = self._store(f"{self.root}/aside/{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        _, place = self._store(f"{self.root}/commits/{number:012d}")
        fs.mkdirs(place.getParent())
        if fs.exists(place) or not fs.rename(aside, place):
            raise Conflict(f"version {number} of {self.root} is there already")

    def _write(self, df: DataFrame) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        writer = df.write
        if self.part:
            writer = df.hint("rebalance", self.part).write.partitionBy(self.part)
        writer.parquet(f"{self.root}/{folder}")
        return folder

    def _parts(self, folder: str) -> dict[str, str]:
        """The parts in a written folder, by the name of their own."""
        if not self.part:
            return {WHOLE: folder}
        return {n: folder for n in self._names(folder) if n.startswith(f"{self.part}=")}

    def replace(self, df: DataFrame) -> int:
        """Commit df as the whole table; the number of the commit."""
        number = self.newest() + 1
        self._commit(number, self._parts(self._write(df)))
        return number

    def replace_parts(self, df: DataFrame) -> int:
        """Commit df in place of the parts that it holds; the others stay."""
        if not self.part:
            raise ValueError("the table has no parts")
        number = self.newest() + 1
        before = self.listed(number - 1)
        self._commit(number, before | self._parts(self._write(df)))
        return number

    def read(self, number: int | None = None) -> DataFrame:
        """The table as of a commit, by default the newest one now. Later loads do not change
        what this DataFrame reads."""
        folders = self.listed(self.newest() if number is None else number)
        if not folders:
            raise ValueError(f"{self.root} has no committed version")
        by_folder: dict[str, list[str]] = {}
        for part, folder in sorted(folders.items()):
            by_folder.setdefault(folder, []).append(part)
        frames = []
        for folder, parts in by_folder.items():
            top = f"{self.root}/{folder}"
            paths = [f"{top}/{p}" if p else top for p in parts]
            frames.append(self.spark.read.option("basePath", top).parquet(*paths))
        return reduce(DataFrame.unionByName, frames)

    def clear(self, keep: int = 1) -> list[str]:
        """Remove folders that none of the last `keep` commits lists, and the commits before
        these. Not while a load runs or an older version is still read."""
        numbers = sorted(int(n) for n in self._names("commits") if n.isdigit())
        used = {f for n in numbers[-keep:] for f in self.listed(n).values()}
        gone = [f"data/{n}" for n in self._names("data") if f"data/{n}" not in used]
        gone += [f"commits/{n:012d}" for n in numbers[:-keep]] + [f"aside/{n}" for n in self._names("aside")]
        for name in gone:
            fs, place = self._store(f"{self.root}/{name}")
            fs.delete(place, True)
        return gone
