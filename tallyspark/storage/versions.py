"""Tables that are replaced together.

A store is a folder. Each version's tables lie in a folder of their own; a version exists once its
manifest, a small file that names the tables' folders, has been put in its place by one rename. Readers
take the last manifest, so they see all tables as they were before or as they are after, never between,
and keep what they have taken while later versions come. Two writers can't both publish one number: a
rename onto a manifest that exists fails, and the later one starts over from what is there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tallyspark.operators.registry import replace_documents


class Conflict(RuntimeError):
    """Another writer has published the version that this one was to be."""


class Versions:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest(self, number: int) -> str:
        return f"{self.root}/manifests/{number:09d}.json"

    def last(self) -> int:
        """The number of the last version, 0 for none."""
        folder = self._path(f"{self.root}/manifests")
        if not self._files.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def tables(self, number: int | None = None) -> dict[str, str]:
        """Table names and their folders."""
        number = self.last() if number is None else number
        if not number:
            return {}
        return json.loads("".join(r["value"] for r in self.spark.read.text(self._manifest(number), wholetext=True).collect()))

    def read(self, table: str, number: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.tables(number)[table])

    def publish(self, tables: dict[str, DataFrame], base: int | None = None, drop: Sequence[str] = ()) -> int:
        """Writes ``tables``, keeps all others of version ``base`` (the last one) but those in ``drop``, and publishes them as the next version."""
        base = self.last() if base is None else base
        paths, folder = {n: p for n, p in self.tables(base).items() if n not in drop}, f"{self.root}/data/{uuid.uuid4().hex}"
        for name, rows in tables.items():
            rows.write.parquet(f"{folder}/{name}")
            paths[name] = f"{folder}/{name}"
        draft = self._path(f"{self.root}/drafts/{uuid.uuid4().hex}")
        out = self._files.create(draft, False)
        try:
            out.write(bytearray(json.dumps(paths, sort_keys=True).encode()))
        finally:
            out.close()
        final = self._path(self._manifest(base + 1))
        self._files.mkdirs(final.getParent())
        if self._files.exists(final) or not self._files.rename(draft, final):
            raise Conflict(f"version {base + 1} is there already")
        return base + 1

    def replace(self, new: dict[str, DataFrame], key: str = "document_id", tries: int = 5) -> int:
        """In each table the rows of the documents in ``new`` replaced by its rows, in all tables at once."""
        for _ in range(tries):
            base = self.last()
            have = self.tables(base)
            full = {name: replace_documents(self.spark.read.parquet(have[name]), rows, key) if name in have else rows for name, rows in new.items()}
            try:
                return self.publish(full, base)
            except Conflict:
                continue
        raise Conflict(f"no free version in {tries} tries")

    def drop_before(self, number: int) -> None:
        """Removes the data of versions before ``number`` that no later one names."""
        kept = {p for n in range(number, self.last() + 1) for p in self.tables(n).values()}
        for n in range(1, number):
            if self._files.exists(self._path(self._manifest(n))):
                for p in set(self.tables(n).values()) - kept:
                    self._files.delete(self._path(p), True)
                self._files.delete(self._path(self._manifest(n)), False)
