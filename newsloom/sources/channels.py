"""Landed channels as a streaming source with limits by connector type.

Connectors land files of JSON lines under folder/kind=<type>/channel=<name>/. Each trigger takes at most so many channels of a type,
those first whose next file has waited longest, and of each at most `files` files; the rest waits for later triggers. So a type with thousands of due
channels neither floods a batch nor keeps other types waiting.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from newsloom.sources.registry import opened

FIELDS = ("external_id", "title", "content", "url", "author", "published_at")


class LandedChannels(DataSource):
    """A stream of raw items with kind, channel and file.

    Options: folder and progress (paths or URIs; progress is a file of this query alone, beside its checkpoint), cap (channels of
    a type in a trigger, 5 unless given), caps (JSON of type to number, for types with a limit of their own), files (of a channel in
    a trigger, 1 unless given).

    An offset names for each channel the last file that was read, by time of modification and then name; files must
    not be changed after they were landed, and hidden ones are left out. Blank and broken lines are skipped. Spark asks a source for
    its latest offset without telling it where the stream stands, so the reader keeps the end of the last planned batch in the
    progress file; it is written before the batch runs, and a batch that is run again after a restart is planned from Spark's own log.
    """

    @classmethod
    def name(cls) -> str:
        return "landed_channels"

    def schema(self) -> str:
        return ", ".join(f"{f} string" for f in (*FIELDS, "kind", "channel", "file"))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ChannelReader(self.options["folder"], self.options["progress"], int(self.options.get("cap", 5)), json.loads(self.options.get("caps", "{}")), int(self.options.get("files", 1)))


class ChannelReader(DataSourceStreamReader):
    def __init__(self, folder: str, progress: str, cap: int, caps: dict[str, int], files: int) -> None:
        self.folder, self.progress, self.cap, self.caps, self.files = folder, progress, cap, caps, files
        self.sent: dict[str, str] | None = None

    def landed(self) -> dict[str, list[str]]:
        """Files of each channel (kind/channel) in order, as time and name."""
        system, path = opened(self.folder)
        out: dict[str, list[str]] = {}
        for x in system.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True)):
            parts = x.path.rpartition("/kind=")[2].split("/")
            if x.type == pafs.FileType.File and len(parts) == 3 and parts[1].startswith("channel=") and not x.base_name.startswith(("_", ".")):
                out.setdefault(f"{parts[0]}/{parts[1][8:]}", []).append(f"{x.mtime_ns:020d}/{parts[2]}")
        return {k: sorted(v) for k, v in out.items()}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """The offset of the last batch and one step more: the due channels of each type, as far as its limit goes."""
        if self.sent is None:
            self.sent = self._kept()
        due: dict[str, list[tuple[str, str, str]]] = {}
        for channel, files in self.landed().items():
            new = [f for f in files if f > self.sent.get(channel, "")]
            if new:
                due.setdefault(channel.partition("/")[0], []).append((new[0], channel, new[min(self.files, len(new)) - 1]))
        taken = {channel: last for kind, own in due.items() for _, channel, last in sorted(own)[: self.caps.get(kind, self.cap)]}
        return self.sent | taken

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.sent = dict(end)
        self._keep(self.sent)
        landed = self.landed()
        return [InputPartition((channel, f)) for channel, last in sorted(end.items()) for f in landed.get(channel, []) if start.get(channel, "") < f <= last]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        channel, file = partition.value
        kind, _, name = channel.partition("/")
        system, path = opened(self.folder)
        where = f"{path}/kind={kind}/channel={name}/{file.partition('/')[2]}"
        with system.open_input_stream(where) as stream:
            for line in io.TextIOWrapper(stream, "utf-8"):
                try:
                    row = json.loads(line)
                except ValueError:
                    continue
                if isinstance(row, dict):
                    yield (*(row.get(k) for k in FIELDS), kind, name, where.rpartition("/")[2])

    def commit(self, end: dict) -> None:
        """Nothing: what was read may be landed for other queries too; retention removes it."""

    def _kept(self) -> dict[str, str]:
        system, path = opened(self.progress)
        if system.get_file_info(path).type != pafs.FileType.File:
            return {}
        with system.open_input_stream(path) as stream:
            return json.loads(stream.read())

    def _keep(self, offset: dict[str, str]) -> None:
        system, path = opened(self.progress)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        with system.open_output_stream(path + ".new") as stream:
            stream.write(json.dumps(offset).encode())
        system.move(path + ".new", path)
