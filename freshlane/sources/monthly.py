"""A fact table kept by month whose months are replaced or extended by atomic commits.

Rows lie in ``root/data/<folder>/ym=<month>`` and a commit (``root/commits/<n>``, one small JSON file, moved into
place) names the folders of every month, so a reader sees one state and no path is overwritten while it is read.
A commit also stores the number of the last batch of a source that the data hold: a replayed batch is recognised
and changes nothing. Two writers that start from the same commit cannot both succeed.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MONTH = "yyyy-MM"
#: A month that appends have spread over so many folders is rewritten with the next append.
MAX_FOLDERS = 8


class CommitConflict(RuntimeError):
    """Another writer committed first; read again and repeat."""


def months_of(rows: DataFrame) -> list[str]:
    """Months of the dates of ``rows`` (as many as the calendar has)."""
    found = rows.select(F.date_format("date", MONTH).alias("ym")).distinct().collect()
    return sorted(r.ym for r in found if r.ym is not None)


class MonthTable:
    """A table with a ``date`` column (never null) under ``root``; ``schema`` is that of its rows."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    # ---- files
    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path, jvm

    def _names(self, folder: str) -> list[str]:
        fs, path, _ = self._fs()
        return [s.getPath().getName() for s in fs.listStatus(path(folder))] if fs.exists(path(folder)) else []

    def state(self) -> dict:
        """n (number of the last commit, 0 before the first), months (folders by month), side (folders by name), done."""
        fs, path, jvm = self._fs()
        numbers = [int(x) for x in self._names(f"{self.root}/commits") if x.isdigit()]
        if not numbers:
            return {"n": 0, "months": {}, "side": {}, "done": {}}
        stream = fs.open(path(f"{self.root}/commits/{max(numbers):010d}"))
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, state: dict) -> None:
        fs, path, jvm = self._fs()
        place = path(f"{self.root}/commits/{state['n']:010d}")
        fresh = path(f"{self.root}/commits/_{uuid.uuid4().hex}")
        out = fs.create(fresh)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if fs.exists(place) or not fs.rename(fresh, place):
            fs.delete(fresh, False)
            raise CommitConflict(f"commit {state['n']} of {self.root} exists")

    # ---- reading
    def done(self, source: str) -> int:
        """Number of the last batch of ``source`` that the table holds, -1 before the first."""
        return self.state()["done"].get(source, -1)

    def read(self, months: Iterable[str] | None = None, state: dict | None = None) -> DataFrame:
        """The rows of the last commit (of some months: only their files are read)."""
        held = (state or self.state())["months"]
        wanted = held if months is None else [m for m in months if m in held]
        paths = [f"{self.root}/data/{folder}/ym={m}" for m in wanted for folder in held[m]]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read_side(self, name: str, schema: StructType, state: dict | None = None) -> DataFrame:
        """A table that is replaced as a whole together with the months (say, the state for the next append)."""
        folder = (state or self.state())["side"].get(name)
        return self.spark.read.schema(schema).parquet(f"{self.root}/data/{folder}") if folder else self.spark.createDataFrame([], schema)

    # ---- writing
    def _write(self, rows: DataFrame) -> tuple[str, list[str]]:
        folder = uuid.uuid4().hex
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]
        rows.select(*columns, F.date_format("date", MONTH).alias("ym")).write.partitionBy("ym").parquet(f"{self.root}/data/{folder}")
        return folder, [x[3:] for x in self._names(f"{self.root}/data/{folder}") if x.startswith("ym=")]

    def commit(self, rows: DataFrame, base: dict, replaced: Iterable[str] = (), side: dict[str, DataFrame] | None = None,
               source: str | None = None, number: int | None = None) -> None:
        """Add ``rows`` to what ``base`` (a ``state``) holds, instead of all rows of the months ``replaced``."""
        months = {m: list(f) for m, f in base["months"].items() if m not in set(replaced)}
        folder, written = self._write(rows)
        for m in written:
            months[m] = [*months.get(m, []), folder]
        sides = dict(base["side"])
        for name, frame in (side or {}).items():
            sides[name] = uuid.uuid4().hex
            frame.write.parquet(f"{self.root}/data/{sides[name]}")
        done = base["done"] | ({source: number} if source is not None else {})
        self._commit({"n": base["n"] + 1, "months": months, "side": sides, "done": done})

    def append(self, rows: DataFrame, base: dict, **options) -> None:
        """``commit`` that rewrites a month whose rows are spread over MAX_FOLDERS folders."""
        spread = [m for m, folders in base["months"].items() if len(folders) >= MAX_FOLDERS]
        if spread:
            rows = self.read(spread, base).unionByName(rows)
        self.commit(rows, base, replaced=spread, **options)

    def merge(self, new: DataFrame, combine, source: str | None = None, number: int | None = None) -> bool:
        """Replace the months of ``new`` by ``combine(rows of these months, new)``; no other file is read or written.

        Nothing happens (False) if the table already holds batch ``number`` of ``source``.
        """
        base = self.state()
        if source is not None and number <= base["done"].get(source, -1):
            return False
        months = months_of(new)
        if not months and source is None:
            return False
        self.commit(combine(self.read(months, base), new), base, replaced=months, source=source, number=number)
        return True

    def clean(self, keep: int = 2) -> None:
        """Delete what none of the last ``keep`` commits names (readers of older ones must have ended)."""
        fs, path, _ = self._fs()
        numbers = sorted(int(x) for x in self._names(f"{self.root}/commits") if x.isdigit())
        used = set()
        for n in numbers[-keep:]:
            with_n = path(f"{self.root}/commits/{n:010d}")
            stream = fs.open(with_n)
            state = json.loads(self._fs()[2].org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
            used |= {f for folders in state["months"].values() for f in folders} | set(state["side"].values())
        for n in numbers[:-keep]:
            fs.delete(path(f"{self.root}/commits/{n:010d}"), False)
        for name in self._names(f"{self.root}/data"):
            if name not in used:
                fs.delete(path(f"{self.root}/data/{name}"), True)


def new_root(spark: SparkSession, name: str) -> str:
    """A fresh folder for a table, under the shared checkpoint folder."""
    from freshlane.session import ensure_checkpoint_dir
    return os.path.join(ensure_checkpoint_dir(spark), "monthly", f"{name}-{uuid.uuid4().hex[:12]}")
