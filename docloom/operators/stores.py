"""Sinks: vector and table upserts, dual writes with manifests, rollback, dead letters and retries."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IDENTIFIER = re.compile(r"^[a-zA-Z_][a-zA-Z0-9_]{0,127}$")


def safe_identifier(name: str, taken: Iterable[str] = (), longest: int = 63) -> str:
    """A name that a database takes: shortened, and with _2, _3, ... if it is taken."""
    if not IDENTIFIER.match(name):
        raise ValueError(f"not an identifier: {name!r}")
    taken, short, n = set(taken), name[:longest], 2
    while short in taken:
        tail = f"_{n}"
        short, n = name[: longest - len(tail)] + tail, n + 1
    return short


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def with_retries[T](action: Callable[[], T], retries: int = 2, base: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> T:
    """1 + retries attempts, with base * 2**n seconds between them."""
    for n in range(retries + 1):
        try:
            return action()
        except Exception:
            if n == retries:
                raise
            sleep(base * 2**n)
    raise AssertionError


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with rows of new in place of those with the same key; columns that only one side has are null on the other."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_ids(old: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return old.join(gone.select(key).distinct(), key, "left_anti")


class ConcurrentWrite(RuntimeError):
    """Another writer is making, or has made, the next version of a table."""


@dataclass
class ParquetStore:
    """Versioned tables in a folder: each write is a new version, so a reader never sees half of one.

    A writer claims the number of its version before it writes: of two with the same base one gets ConcurrentWrite and may read and
    try again, so no update is lost. A writer that died leaves its claim; release() removes it.
    """

    spark: SparkSession
    root: str

    def _path(self, table: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self, table: str) -> list[str]:
        path, fs = self._path(table)
        if not fs.exists(path):
            return []
        jvm = self.spark.sparkContext._jvm
        done = [s.getPath().getName() for s in fs.listStatus(path) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(done)

    def exists(self, table: str) -> bool:
        return bool(self.versions(table))

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{table}/{self.versions(table)[-1]}")

    def _claim(self, table: str, n: int):
        path, fs = self._path(table)
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, f"_claims/{n:08d}"), fs

    def replace(self, table: str, rows: DataFrame, base: int | None = None) -> None:
        """Writes version `base` + 1; base: the number of versions that rows were made from."""
        n = len(self.versions(table)) if base is None else base
        claim, fs = self._claim(table, n)
        try:
            fs.create(claim, False).close()
        except Exception as e:
            raise ConcurrentWrite(f"{table}: version {n}") from e
        try:
            rows.write.parquet(f"{self.root}/{table}/{n:08d}-{uuid.uuid4().hex[:8]}")
        except BaseException:
            fs.delete(claim, False)
            raise

    def release(self, table: str) -> None:
        """Removes the claim of a writer that died before its version was whole."""
        claim, fs = self._claim(table, len(self.versions(table)))
        fs.delete(claim, False)

    def upsert(self, table: str, rows: DataFrame, key: str) -> None:
        n = len(self.versions(table))
        self.replace(table, upsert(self.read(table), rows, key) if n else rows, n)

    def delete(self, table: str, ids: DataFrame, key: str) -> None:
        n = len(self.versions(table))
        self.replace(table, delete_ids(self.read(table), ids, key), n)

    def columns(self, table: str) -> list[tuple[str, str]]:
        return self.read(table).dtypes

    def drop(self, table: str) -> None:
        path, fs = self._path(table)
        fs.delete(path, True)


@dataclass
class TemplateStore:
    """Form templates: an append-only table of versions and one of tombstones."""

    store: ParquetStore
    table: str = "templates"

    def save(self, versions: DataFrame) -> None:
        """versions: template, version and what else describes them; a version that is there already is an error."""
        n = len(self.store.versions(self.table))
        if n:
            old = self.store.read(self.table)
            if old.join(versions, ["template", "version"], "left_semi").limit(1).count():
                raise ValueError("a saved version can't be changed")
            versions = old.unionByName(versions, allowMissingColumns=True)
        self.store.replace(self.table, versions, n)

    def delete(self, template: str, version: int | None = None) -> None:
        """Soft: a tombstone for one version, or for all of a template."""
        row, name = self.store.spark.createDataFrame([(template, version)], "template string, version int"), f"{self.table}_deleted"
        n = len(self.store.versions(name))
        self.store.replace(name, self.store.read(name).unionByName(row) if n else row, n)

    def tables(self) -> tuple[DataFrame, DataFrame]:
        """Versions and tombstones, as forms.live_versions and the like take them."""
        name, none = f"{self.table}_deleted", self.store.spark.createDataFrame([], "template string, version int")
        return self.store.read(self.table), self.store.read(name) if self.store.exists(name) else none


def write_jdbc(rows: DataFrame, url: str, table: str, properties: dict[str, str] | None = None, partitions: int = 8) -> None:
    """Appends rows to a database's table by at most `partitions` connections at a time."""
    if not all(IDENTIFIER.match(part) for part in table.split(".")):
        raise ValueError(f"not a table's name: {table!r}")
    rows.coalesce(partitions).write.jdbc(url, table, mode="append", properties=properties or {})


@dataclass
class Written:
    """What a run wrote, for a caller that wants it undone."""

    run_id: str
    chunk_table: str | None = None
    row_table: str | None = None
    errors: list[str] = field(default_factory=list)
    fully_rolled_back: bool | None = None


def dual_write(store: ParquetStore, chunks: DataFrame, rows: DataFrame, run_id: str, chunk_table: str = "chunks", row_table: str = "rows", atomic: bool = False) -> Written:
    """Writes chunks (key id) and rows (key row_id). If one side fails, it is a warning, or, atomic, the other side is undone."""
    done = Written(run_id)
    try:
        store.upsert(chunk_table, chunks.withColumn("run_id", F.lit(run_id)), "id")
        done.chunk_table = chunk_table
    except Exception as e:
        done.errors.append(f"E_BACKEND_VECTOR_FAILED: {type(e).__name__}")
    try:
        store.upsert(row_table, rows.withColumn("run_id", F.lit(run_id)), "row_id")
        done.row_table = row_table
    except Exception as e:
        done.errors.append(f"E_BACKEND_DB_FAILED: {type(e).__name__}")
    if done.errors and (done.chunk_table or done.row_table):
        if atomic:
            rollback(store, done)
        else:
            done.errors.append("W_PARTIAL_WRITE")
    return done


def rollback(store: ParquetStore, written: Written, retries: int = 2) -> None:
    """Deletes what a run wrote, chunks first."""
    undone = True
    for table in (written.chunk_table, written.row_table):
        if table is None:
            continue
        try:
            with_retries(lambda table=table: store.replace(table, store.read(table).filter(F.col("run_id") != written.run_id)), retries, 0.0)
        except Exception:
            undone = False
    written.fully_rolled_back = undone


def evolve(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both row sets under the columns of either."""
    return old.unionByName(new, allowMissingColumns=True)


def dead_letters(results: DataFrame, errors: str = "errors") -> tuple[DataFrame, DataFrame]:
    """Rows without a fatal code, and a row per fatal code of the others."""
    bad = F.exists(F.col(errors), lambda e: e.startswith("E_"))
    return results.filter(~bad), results.filter(bad).withColumn("code", F.explode(F.filter(F.col(errors), lambda e: e.startswith("E_"))))


def write_partitions(rows: DataFrame, connect: Callable[[], object], send: Callable[[object, list[dict]], None], batch: int = 64, retries: int = 2, base: float = 1.0) -> None:
    """Sends rows to a service from the executors: one connection a partition, `batch` rows a call, each call retried.

    send must be idempotent by key, as a task that is run again sends its rows again.
    """

    def run(partition) -> None:
        client, buffer = connect(), []
        for row in partition:
            buffer.append(row.asDict(recursive=True))
            if len(buffer) == batch:
                with_retries(lambda b=buffer: send(client, b), retries, base)
                buffer = []
        if buffer:
            with_retries(lambda: send(client, buffer), retries, base)

    rows.foreachPartition(run)
