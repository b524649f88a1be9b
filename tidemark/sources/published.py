"""Tables and folders of files that change as a whole, as a Spark data source writer.

Tasks write parts beside what stands; only the commit, on the driver, makes them the next version, by creating
that version's manifest in one step and only if nobody else has.  A reader takes the newest manifest, so it
sees an old version or a new one and nothing between.  If a task fails, what stands stays, the parts that were
written go, and a partial manifest says how far the write had come.

The folder must be one that the driver and all executors see.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

PARTIAL = "partial.json"


class StaleVersion(RuntimeError):
    """Another writer has published since this write began."""


def _local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


def _manifest(folder: str, version: int) -> str:
    return f"{folder}/version-{version:08d}.json"


def versions(path: str) -> list[int]:
    """The versions that were published, oldest first."""
    folder = _local(path)
    names = os.listdir(folder) if os.path.isdir(folder) else []
    return sorted(int(n[8:-5]) for n in names if n.startswith("version-") and n.endswith(".json"))


def manifest(path: str, version: int | None = None) -> list[dict]:
    """The entries (path, bytes, rows, sha256) of a version, by default the newest; none before the first."""
    known = versions(path)
    if version is None and not known:
        return []
    with open(_manifest(_local(path), known[-1] if version is None else version)) as f:
        return json.load(f)


@dataclass
class _Written(WriterCommitMessage):
    entries: list[dict]


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.folder, self.kind, self.columns = _local(options["path"]), options.get("kind", "rows"), schema.names
        if self.kind not in ("rows", "files"):
            raise ValueError(f"kind must be rows or files, not {self.kind!r}")
        wanted = {"rows": ["value"], "files": ["path", "content"]}[self.kind]
        if self.columns != wanted:
            raise ValueError(f"{self.kind} need the columns {' and '.join(wanted)}")
        self.base = int(options["base"]) if "base" in options else max(versions(self.folder), default=0)
        self.own = f"data-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        return _Written(list(self._files(iterator) if self.kind == "files" else self._rows(iterator)))

    def _rows(self, rows: Iterator[Row]) -> Iterator[dict]:
        name, n, size, sha = f"{self.own}/part-{uuid.uuid4().hex}.json", 0, 0, hashlib.sha256()
        os.makedirs(f"{self.folder}/{self.own}", exist_ok=True)
        with open(f"{self.folder}/{name}", "wb") as f:
            for (value,) in rows:
                line = value.encode() + b"\n"
                f.write(line)
                sha.update(line)
                n, size = n + 1, size + len(line)
            f.flush()
            os.fsync(f.fileno())
        if n == 0:
            os.unlink(f"{self.folder}/{name}")
        else:
            yield {"path": name, "bytes": size, "rows": n, "sha256": sha.hexdigest()}

    def _files(self, rows: Iterator[Row]) -> Iterator[dict]:
        for path, content in rows:
            if not path or path.startswith("/") or ".." in path.split("/"):
                raise ValueError(f"a file can't be called {path!r}")
            body = content if isinstance(content, (bytes, bytearray)) else (content or "").encode()
            name = f"{self.own}/{path}"
            os.makedirs(os.path.dirname(f"{self.folder}/{name}"), exist_ok=True)
            # a task that is run again writes the same file again, in one step
            beside = f"{self.folder}/{name}.{uuid.uuid4().hex}"
            with open(beside, "wb") as f:
                f.write(body)
            os.replace(beside, f"{self.folder}/{name}")
            yield {"path": name, "bytes": len(body), "rows": 1, "sha256": hashlib.sha256(body).hexdigest()}

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        entries = sorted((e for m in messages if m is not None for e in m.entries), key=lambda e: e["path"])
        if not entries:
            shutil.rmtree(f"{self.folder}/{self.own}", ignore_errors=True)
        os.makedirs(self.folder, exist_ok=True)
        beside = f"{self.folder}/.{self.own}.json"
        with open(beside, "w") as f:
            json.dump(entries, f, indent=1)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(beside, _manifest(self.folder, self.base + 1))  # made whole, and only if there is none
        except FileExistsError:
            shutil.rmtree(f"{self.folder}/{self.own}", ignore_errors=True)
            raise StaleVersion(f"version {self.base + 1} of {self.folder} stands already") from None
        finally:
            os.unlink(beside)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        done = [e for m in messages if m is not None for e in m.entries]
        shutil.rmtree(f"{self.folder}/{self.own}", ignore_errors=True)
        os.makedirs(self.folder, exist_ok=True)
        beside = f"{self.folder}/.{self.own}.json"
        with open(beside, "w") as f:
            json.dump({"after_version": self.base, "tasks": len(messages), "ended": sum(m is not None for m in messages), "entries": done}, f, indent=1)
        os.replace(beside, f"{self.folder}/{PARTIAL}")


class Published(DataSource):
    """``df.write.format("published")``; options: path, kind (``rows``: lines, column value; ``files``: columns path and content of each), base (the version that it follows)."""

    @classmethod
    def name(cls) -> str:
        return "published"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), schema)


def publish(df: DataFrame, path: str, kind: str = "rows", base: int | None = None) -> None:
    """K-04, K-08: make ``df`` the next version at ``path``: its rows as JSON lines, or a file for each (path, content).

    ``base`` is the version that was read for it; if another has been published since, nothing changes and the
    write fails.  Without it the version that stands as the write begins is followed.
    """
    df.sparkSession.dataSource.register(Published)
    options = {"path": path, "kind": kind} | ({} if base is None else {"base": str(base)})
    lines = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")) if kind == "rows" else df
    lines.write.format("published").mode("append").options(**options).save()


def current(spark: SparkSession, path: str, schema: str | StructType, version: int | None = None) -> DataFrame:
    """The rows of a version, by default the newest; no rows before the first."""
    parts = [f"file://{_local(path)}/{e['path']}" for e in manifest(path, version)]
    return spark.read.schema(schema).json(parts) if parts else spark.createDataFrame([], schema)


def forget(path: str, keep: int = 2) -> None:
    """Drop all versions but the newest ``keep`` and what only they had."""
    folder, known = _local(path), versions(path)
    held = {e["path"].split("/")[0] for v in known[-keep:] for e in manifest(path, v)}
    for v in known[:-keep]:
        gone = {e["path"].split("/")[0] for e in manifest(path, v)} - held
        os.unlink(_manifest(folder, v))
        for d in gone:
            shutil.rmtree(f"{folder}/{d}", ignore_errors=True)
