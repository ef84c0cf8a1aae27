"""Crash files as a Spark data source: a spool folder that is read in batches or as a stream, with bad files set aside.

    spark.dataSource.register(CrashSpool)
    spark.readStream.format("crash_spool").option("maxFilesPerTrigger", 100).load("/shared/crashes")

The folder must be one that all executors share. The stream claims files in generations: ``_claims/N.json`` lists those of generation N, and an
offset is the number of the last generation, so that a restart reads the same files for the same offsets, whatever has come since.
Once a batch is done its good files are deleted and its bad ones renamed to ``.failed``; a file that can't be parsed gives a row with
``problem``, so that a query can say which ones they are.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator
from datetime import datetime

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "error_type string, message string, backtrace string, platform string, occurred_at timestamp, exception_cause string, environment_info string, file string, problem string"
#: What a crash file is named and what is said where it says nothing.
PREFIX, UNKNOWN_TYPE, UNKNOWN_MESSAGE, PLATFORM = "red_crash_", "UnknownCrash", "Process crash captured via at_exit hook", "crash_capture"
#: What a crash says of its process, and the names that the report has for it.
ENVIRONMENT = {"ruby_version": "ruby_version", "rails_version": "rails_version", "pid": "pid", "thread_count": "thread_count", "uptime_seconds": "uptime_seconds", "gc": "gc", "timestamp": "crash_captured_at"}
CLAIMS = "_claims"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def waiting(fs: pafs.FileSystem, folder: str, prefix: str) -> list[str]:
    """Names of the crash files in the folder."""
    found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return sorted(f.base_name for f in found if f.is_file and f.base_name.startswith(prefix) and f.base_name.endswith(".json"))


def parsed(raw: bytes, file: str, modified: datetime) -> tuple:
    """A row of ``SCHEMA``. The time is the file's own where the crash has none that can be read."""
    try:
        data = json.loads(raw)
        if not isinstance(data, dict):
            raise ValueError("no object")
    except ValueError as e:
        return (*[None] * 7, file, f"{type(e).__name__}: {e}"[:200])
    trace, causes = data.get("backtrace"), data.get("cause_chain")
    try:
        at = datetime.fromisoformat(data["timestamp"])
    except (KeyError, TypeError, ValueError):
        at = modified
    env = {name: data[key] for key, name in ENVIRONMENT.items() if data.get(key) is not None} | {"source": PLATFORM}
    trace = "\n".join(map(str, trace)) if isinstance(trace, list) else None if trace is None else str(trace)
    text = lambda x, otherwise: otherwise if x is None else str(x)
    return (text(data.get("exception_class"), UNKNOWN_TYPE), text(data.get("message"), UNKNOWN_MESSAGE), trace, PLATFORM, at, json.dumps(causes) if isinstance(causes, list) and causes else None, json.dumps(env), file, None)


class Files(InputPartition):
    def __init__(self, names: list[str]):
        super().__init__(names)


class _Spool:
    def __init__(self, options: dict):
        self.path, self.prefix = options["path"].rstrip("/"), options.get("prefix", PREFIX)
        self.per_trigger, self.per_task = int(options.get("maxFilesPerTrigger", 1000)), int(options.get("filesPerTask", 50))

    def dealt(self, names: list[str]) -> list[Files]:
        return [Files(names[i : i + self.per_task]) for i in range(0, len(names), self.per_task)]

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, folder = opened(self.path)
        for name in partition.value:
            at = posixpath.join(folder, name)
            info = fs.get_file_info(at)
            if info.is_file:
                with fs.open_input_stream(at) as f:
                    yield parsed(f.readall(), name, info.mtime)


class SpoolReader(_Spool, DataSourceReader):
    """All files that wait; none is deleted or renamed."""

    def partitions(self) -> list[Files]:
        return self.dealt(waiting(*opened(self.path), self.prefix)) or [Files([])]


class SpoolStream(_Spool, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"generation": 0}

    def _claimed(self, fs: pafs.FileSystem, folder: str) -> list[int]:
        found = fs.get_file_info(pafs.FileSelector(posixpath.join(folder, CLAIMS), allow_not_found=True))
        return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json"))

    def _names(self, fs: pafs.FileSystem, folder: str, n: int) -> list[str]:
        with fs.open_input_stream(posixpath.join(folder, CLAIMS, f"{n}.json")) as f:
            return json.loads(f.readall())

    def latestOffset(self) -> dict:
        fs, folder = opened(self.path)
        known = self._claimed(fs, folder)
        last = known[-1] if known else 0
        taken = {x for n in known for x in self._names(fs, folder, n)}
        new = [x for x in waiting(fs, folder, self.prefix) if x not in taken][: self.per_trigger]
        if not new:
            return {"generation": last}
        fs.create_dir(posixpath.join(folder, CLAIMS), recursive=True)
        self._write(fs, posixpath.join(folder, CLAIMS, f"{last + 1}.json"), new)
        return {"generation": last + 1}

    def _write(self, fs: pafs.FileSystem, claim: str, names: list[str]) -> None:
        with fs.open_output_stream(f"{claim}.part") as f:
            f.write(json.dumps(names).encode())
        fs.move(f"{claim}.part", claim)  # whole or not at all

    def partitions(self, start: dict, end: dict) -> list[Files]:
        fs, folder = opened(self.path)
        names = [x for n in range(start["generation"] + 1, end["generation"] + 1) for x in self._names(fs, folder, n)]
        return self.dealt(names) or [Files([])]

    def commit(self, end: dict) -> None:
        """Sets aside the files of the generations that are done, which Spark doesn't ask for again; of the last claim its number stays."""
        fs, folder = opened(self.path)
        for n in self._claimed(fs, folder):
            if n > end["generation"]:
                break
            names = self._names(fs, folder, n)
            for name in names:
                at = posixpath.join(folder, name)
                info = fs.get_file_info(at)
                if not info.is_file:
                    continue
                with fs.open_input_stream(at) as f:
                    bad = parsed(f.readall(), name, info.mtime)[-1] is not None
                fs.move(at, f"{at}.failed") if bad else fs.delete_file(at)
            claim = posixpath.join(folder, CLAIMS, f"{n}.json")
            if n < end["generation"]:
                fs.delete_file(claim)
            elif names:
                self._write(fs, claim, [])  # a file of the same name is another one from now on


class CrashSpool(DataSource):
    @classmethod
    def name(cls) -> str:
        return "crash_spool"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SpoolReader:
        return SpoolReader(self.options)

    def streamReader(self, schema) -> SpoolStream:
        return SpoolStream(self.options)
