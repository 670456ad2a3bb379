"""Stored state: immutable versions of Parquet tables and a pointer to the current one.

A change writes whole new tables into a new version and then one small pointer file of the next number, so
readers see all of a change or none of it, and an interrupted writer leaves the old version current.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

SCHEMA_VERSION = "2"
SCHEMAS = {
    "pages": "query string, start int, payload string",
    "resolutions": "query string, discovered_url string, status string, name string, url string, reason string, evidence string",
    "progress": "query string, status string, reason string",
    "batches": "id long, queries array<string>, reserved_pages int, run_id string, status string",
    "coverage": "query string, batch_id long, pages int, last_page int, failed_pages array<int>, status string, reason string, run_id string",
}
KEYS = {"pages": ("query", "start"), "resolutions": ("query", "discovered_url"), "progress": ("query",), "batches": ("id",), "coverage": ("query",)}


class StateError(ValueError):
    """The message is the machine-readable reason."""


def fingerprint(config: dict) -> str:
    """Identity of a run: its settings without version and provider."""
    kept = {k: v for k, v in config.items() if k not in ("version", "provider")}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def upserted(now: DataFrame, delta: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Rows of delta replace those of the same key. delta has one row per key."""
    return now.join(delta.select(*key), list(key), "left_anti").unionByName(delta)


def inserted(now: DataFrame, delta: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Rows of delta whose key is new are added; the others stay as they are."""
    return now.unionByName(delta.dropDuplicates(list(key)).join(now.select(*key), list(key), "left_anti"))


class State:
    """A folder (any file system that Spark reads) of versions."""

    def __init__(self, spark: SparkSession, folder: str, readonly: bool = False) -> None:
        self.spark, self.folder, self.readonly = spark, folder.rstrip("/"), readonly
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._path = lambda name: hadoop(f"{self.folder}/{name}")
        self._fs = self._path("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> list[int]:
        """Numbers of the pointers that are there, ascending."""
        root = self._path("x").getParent()
        names = [f.getPath().getName() for f in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"current-(\d+)\.json", n)))

    def _current(self) -> dict | None:
        numbers = self._pointers()
        if not numbers:
            return None
        stream = self._fs.open(self._path(f"current-{numbers[-1]:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode()) | {"number": numbers[-1]}
        finally:
            stream.close()

    def _point(self, pointer: dict, number: int) -> None:
        """Writes the pointer beside and renames it to the next number: the one before stays whole, so a
        reader or a crash at any moment finds it. Another writer's pointer of that number is refused."""
        temporary, name = self._path(f"pointer.{uuid.uuid4().hex}"), self._path(f"current-{number:012d}.json")
        stream = self._fs.create(temporary, True)
        stream.write(bytearray(json.dumps(pointer, ensure_ascii=False).encode()))
        stream.close()
        if self._fs.exists(name) or not self._fs.rename(temporary, name):
            self._fs.delete(temporary, False)
            raise StateError("state_changed_meanwhile")
        for old in self._pointers()[:-2]:
            self._fs.delete(self._path(f"current-{old:012d}.json"), False)

    def meta(self) -> dict:
        """The current pointer: version, schema_version, config, tables. Another schema is refused before
        anything is touched."""
        found = self._current()
        if found is None:
            raise StateError("state_missing")
        if found.get("schema_version") != SCHEMA_VERSION:
            raise StateError("unsupported_schema_version")
        return found

    def create(self, config: dict) -> None:
        """A new empty state, or the existing one if its settings are the same."""
        if self._pointers():
            if fingerprint(self.meta()["config"]) != fingerprint(config):
                raise StateError("config_mismatch")
            return
        self.commit({name: self.spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}, config)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{self.meta()['tables'][name]}")

    def commit(self, tables: dict[str, DataFrame], config: dict | None = None) -> None:
        """Writes the given tables as a new version and makes it current; the others stay."""
        if self.readonly:
            raise StateError("state_readonly")
        now = self.meta() if self._pointers() else {"tables": {}, "config": config, "number": 0}
        number = now.pop("number") + 1
        version = uuid.uuid4().hex
        for name, frame in tables.items():
            frame.select(*self.spark.createDataFrame([], SCHEMAS[name]).columns).write.parquet(f"{self.folder}/{version}/{name}")
            now["tables"][name] = f"{version}/{name}"
        self._point(now | {"version": version, "schema_version": SCHEMA_VERSION}, number)

    def reserve_request(self, maximum: int) -> int:
        """Counts one more search request and gives the total; refuses to pass the maximum."""
        now = self.meta()
        number, total = now.pop("number"), now.get("requests", 0) + 1
        if total > maximum:
            raise StateError("search_request_limit")
        self._point(now | {"requests": total}, number + 1)
        return total

    def upsert(self, **deltas: DataFrame) -> None:
        self.commit({name: upserted(self.table(name), delta, KEYS[name]) for name, delta in deltas.items()})

    def snapshot(self) -> dict[str, DataFrame]:
        """All tables of the current version; later commits do not change them."""
        tables = self.meta()["tables"]
        return {name: self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{path}") for name, path in tables.items()}

    def migrate(self, old: dict[str, DataFrame], config: dict) -> None:
        """Version 1 had pages, resolutions and progress and no version; they become version 2 with the
        new tables empty, and the old settings are kept beside the new."""
        empty = {name: self.spark.createDataFrame([], SCHEMAS[name]) for name in SCHEMAS}
        self.commit(empty | {k: old[k] for k in ("pages", "resolutions", "progress")}, config | {"legacy_config": config, "migration": {"from": "1", "to": SCHEMA_VERSION}})
