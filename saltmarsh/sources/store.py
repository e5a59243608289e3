"""Tables with snapshots: every write makes a new folder and then a new version of the pointers to all folders.

Neither folders nor versions are changed, so readers never see half a write; a version is made by creating its file,
which only one of several writers can do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SnapshotStore:
    """Named tables below one folder, on any file system Spark reaches."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    def _read_text(self, path: str) -> str | None:
        p = self._path(path)
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def _create(self, path: str, text: str) -> bool:
        """Write a new file; False where it is there already."""
        try:
            stream = self._fs.create(self._path(path), False)
        except Py4JJavaError:
            if self._fs.exists(self._path(path)):
                return False
            raise
        stream.write(text.encode("utf-8"))
        stream.close()
        return True

    def _versions(self) -> list[int]:
        folder = self._path(f"{self.root}/pointers")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True)

    def pointers(self) -> dict[str, str]:
        """The tables of the newest version that was written to its end; versions are never changed, so a reader sees one or the other."""
        for n in self._versions():
            try:
                return json.loads(self._read_text(f"{self.root}/pointers/{n:012d}.json") or "")
            except ValueError:
                continue  # its writer hasn't finished, or never will
        return {}

    def _commit(self, change: Callable[[dict[str, str]], dict[str, str]]) -> None:
        """Make a new version out of the newest; a writer that finds its number taken starts from the version that took it."""
        while True:
            n = next(iter(self._versions()), 0) + 1
            if self._create(f"{self.root}/pointers/{n:012d}.json", json.dumps(change(self.pointers()), sort_keys=True)):
                return

    def read(self, name: str) -> DataFrame | None:
        folder = self.pointers().get(name)
        return self.spark.read.parquet(f"{self.root}/{folder}") if folder else None

    def write(self, tables: dict[str, DataFrame], partition_by: dict[str, str] | None = None) -> None:
        """Replace tables together: all or none become visible."""
        at = {}
        for name, df in tables.items():
            folder = f"{name}-{uuid.uuid4().hex}"
            w = df.write
            if by := (partition_by or {}).get(name):
                w = w.partitionBy(by)
            w.parquet(f"{self.root}/{folder}")
            at[name] = folder
        self._commit(lambda old: old | at)

    # checkpoints: a named copy of the pointers; snapshots are never changed, so no data is copied
    def _label(self, label: str) -> str:
        import re

        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]{0,63}", label):
            raise ValueError(f"no safe label: {label!r}")
        return f"{self.root}/checkpoints/{label}.json"

    def checkpoint(self, label: str, version: str | None = None) -> None:
        if not self._create(self._label(label), json.dumps({"label": label, "version": version, "tables": self.pointers()}, sort_keys=True)):
            raise FileExistsError(label)

    def restore(self, label: str) -> None:
        text = self._read_text(self._label(label))
        if text is None:
            raise FileNotFoundError(label)
        tables = json.loads(text)["tables"]
        for folder in tables.values():
            if not self._fs.exists(self._path(f"{self.root}/{folder}")):
                raise FileNotFoundError(folder)  # nothing is changed
        self._commit(lambda _: tables)

    def checkpoints(self) -> list[dict]:
        folder = self._path(f"{self.root}/checkpoints")
        if not self._fs.exists(folder):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(folder))
        return [{k: v for k, v in json.loads(self._read_text(f"{self.root}/checkpoints/{n}")).items() if k != "tables"} for n in names if n.endswith(".json")]

    def drop_checkpoint(self, label: str) -> None:
        if not self._fs.delete(self._path(self._label(label)), False):
            raise FileNotFoundError(label)


def upsert(existing: DataFrame | None, incoming: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """existing with the rows of incoming put in by key; of incoming rows with one key the last by `order` holds.

    Rows with a null key are refused. Keys are matched by an anti-join, so untouched rows aren't sorted.
    """
    new = incoming.where(F.col(key).isNotNull())
    if order:  # the greatest struct of a key is found before the shuffle, so a key with very many rows isn't sorted
        rest = [c for c in incoming.columns if c not in (key, order)]
        new = new.groupBy(key).agg(F.max(F.struct(F.col(order), *rest)).alias("_r")).select(*[F.col(c) if c == key else F.col(f"_r.{c}") for c in incoming.columns])
    else:
        new = new.dropDuplicates([key])
    if existing is None:
        return new
    cols = existing.columns
    return existing.join(new.select(key), key, "left_anti").select(cols).unionByName(new.select(cols))


def known_hash(known: DataFrame, column: str = "iri") -> DataFrame:
    """One row: the hash of all known identifiers, by which a cache of decisions is valid or not.

    Each identifier is hashed and the hashes are added up, so no list is gathered in one task.
    """
    part = lambda k: F.sum(F.conv(F.substring(F.sha2(F.col(column), 256), 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)"))
    return known.select(column).where(F.col(column).isNotNull()).distinct().agg(F.sha2(F.concat_ws("|", *[F.coalesce(part(k), F.lit(0)).cast("string") for k in range(8)]), 256).alias("hash"))


def cached_decisions(surfaces: DataFrame, cache: DataFrame, valid_hash: str) -> tuple[DataFrame, DataFrame]:
    """(decided, undecided) distinct surfaces; a cache of another set of identifiers decides nothing. cache: surface, hash, status, target_iri."""
    held = cache.where(F.col("hash") == valid_hash).select("surface", "status", "target_iri").dropDuplicates(["surface"])
    distinct = surfaces.select("surface").where("surface is not null").distinct()
    return distinct.join(held, "surface"), distinct.join(held, "surface", "left_anti")
