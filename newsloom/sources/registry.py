"""The registry of connectors, and a Spark data source over landed files of raw items."""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_connectors: dict[str, Callable[[DataFrame, dict], DataFrame]] = {}
_required: dict[str, list[str]] = {}


def connector(kind: str, *required: str):
    """Register a function from landed rows and a configuration to raw items."""

    def register(f):
        _connectors[kind], _required[kind] = f, list(required)
        return f

    return register


def get(kind: str) -> Callable[[DataFrame, dict], DataFrame]:
    if kind not in _connectors:
        raise KeyError(f"unknown connector {kind!r}; there are {', '.join(kinds())}")
    return _connectors[kind]


def kinds() -> list[str]:
    return sorted(_connectors)


def validate(kind: str, config: dict) -> tuple[bool, str]:
    """Whether a configuration names all that its connector needs, and what is missing."""
    if kind not in _connectors:
        return False, f"unknown connector {kind}"
    missing = [k for k in _required[kind] if not config.get(k)]
    return (not missing, "" if not missing else f"missing {', '.join(missing)}")


def checked(channels: DataFrame) -> DataFrame:
    """channels (kind, config as map<string,string>) with registered and problem: what `validate` says of each; an empty problem means none."""
    kind, problem = F.col("kind"), F.concat(F.lit("unknown connector "), F.coalesce("kind", F.lit("")))
    for k, needs in _required.items():
        missing = F.array_compact(F.array(*(F.when(F.coalesce(F.col("config")[n], F.lit("")) == "", F.lit(n)) for n in needs)))
        problem = F.when(kind == k, F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", "))).otherwise("")).otherwise(problem)
    return channels.withColumn("registered", F.coalesce(kind.isin(kinds()), F.lit(False))).withColumn("problem", problem)


class LandedItems(DataSource):
    """Raw items from the JSON lines files of a folder where connectors land them: option folder, a path or URI.

    Each file is a partition and is read line by line; blank and broken lines are skipped.
    """

    @classmethod
    def name(cls) -> str:
        return "landed_items"

    def schema(self) -> str:
        return "external_id string, title string, content string, url string, author string, published_at string, file string"

    def reader(self, schema) -> DataSourceReader:
        return _LandedReader(self.options["folder"])


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if ":/" in folder else (pafs.LocalFileSystem(), folder)


class _LandedReader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        files, path = opened(self.folder)
        found = sorted(x.path for x in files.get_file_info(pafs.FileSelector(path)) if x.type == pafs.FileType.File and not x.base_name.startswith(("_", ".")))
        return [InputPartition(x) for x in found] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        files, _ = opened(self.folder)
        with files.open_input_stream(partition.value) as stream:
            for line in io.TextIOWrapper(stream, "utf-8"):
                try:
                    row = json.loads(line)
                except ValueError:
                    continue
                if isinstance(row, dict):
                    yield (*(row.get(k) for k in ("external_id", "title", "content", "url", "author", "published_at")), partition.value)
