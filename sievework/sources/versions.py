"""Tables that change together or not at all.

A folder holds data folders that are written once and never changed, and numbered commits. A commit is a small file that lists,
for every table, the data folders it consists of. A change writes its data folders first and then moves one commit file into
place, which must not exist yet: readers see the old tables until that moment and the new ones after it, all at once. A
change that started from a version that is no longer the last one is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import DataFrame, SparkSession
from py4j.protocol import Py4JJavaError

COMMITS, DATA = "_commits", "data"


class ConflictError(RuntimeError):
    """Another change came first."""


@dataclass(frozen=True)
class State:
    """A version: its number (0 before the first change) and the data folders of each table."""

    version: int = 0
    tables: Mapping[str, list[str]] = field(default_factory=dict)


class VersionedTables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def state(self, version: int | None = None) -> State:
        """The last version, or an earlier one."""
        numbers = [int(n[:-5]) for n in self._names(COMMITS) if n.endswith(".json")]
        if version is None and not numbers or version == 0:
            return State()
        chosen = max(numbers) if version is None else version
        if chosen not in numbers:
            raise ValueError(f"{self.folder} has no version {chosen}")
        text = self.spark.read.option("wholetext", True).text(f"{self.folder}/{COMMITS}/{chosen:010d}.json").first()[0]
        return State(chosen, json.loads(text))

    def read(self, table: str, layout: str, state: State | None = None) -> DataFrame:
        """A table of the last or a given version; without a row if there is none yet."""
        folders = (state or self.state()).tables.get(table, [])
        if not folders:
            return self.spark.createDataFrame([], layout)
        return self.spark.read.schema(layout).parquet(*[f"{self.folder}/{DATA}/{f}" for f in folders])

    def change(self, base: State, replace: Mapping[str, DataFrame] | None = None, append: Mapping[str, DataFrame] | None = None) -> State:
        """The version after `base` with some tables replaced and rows added to others. All or nothing."""
        tables = {k: list(v) for k, v in base.tables.items()}
        for table, df in (replace or {}).items():
            tables[table] = [self._write(table, df)]
        for table, df in (append or {}).items():
            tables[table] = [*tables.get(table, []), self._write(table, df)]
        self._commit(base.version + 1, tables)
        return State(base.version + 1, tables)

    def _write(self, table: str, df: DataFrame) -> str:
        name = f"{table}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{DATA}/{name}")
        return name

    def _commit(self, version: int, tables: dict[str, list[str]]) -> None:
        draft, final = self._path(f"{COMMITS}/.{uuid.uuid4().hex}"), self._path(f"{COMMITS}/{version:010d}.json")
        out = self._fs.create(draft)
        out.write(json.dumps(tables).encode("utf-8"))
        out.close()
        self._publish(draft, final)

    def _publish(self, draft, final) -> None:
        """Move the commit into place unless there is one: on HDFS and the like one atomic step."""
        context = self._hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark._sc._gateway.new_array(self._hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, final, none)
        except (Py4JJavaError, CapturedException) as err:
            if not self._fs.exists(final):
                raise
            self._fs.delete(draft, False)
            raise ConflictError(f"{self.folder} has a newer version than {final.getName()[:-5].lstrip('0')} starts from") from err

    def clean(self, keep: int = 2) -> int:
        """Delete the data folders that none of the last `keep` versions uses, and older commits. The number of folders deleted.

        Not to be run while a change is being written.
        """
        numbers = [int(n[:-5]) for n in self._names(COMMITS) if n.endswith(".json")]
        used = {f for n in numbers[-keep:] for folders in self.state(n).tables.values() for f in folders}
        gone = [n for n in self._names(DATA) if n not in used]
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{COMMITS}/{n:010d}.json"), False)
        for name in gone:
            self._fs.delete(self._path(f"{DATA}/{name}"), True)
        return len(gone)
