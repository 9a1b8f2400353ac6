"""Tables behind a manifest: a snapshot plus deltas, with an atomic "latest".

A version of a table is a manifest file ``_manifests/<number>.json`` that names
the folders the version consists of.  A writer first writes its folder (Spark's
commit protocol publishes each task once), then the manifest: under another
name, moved to its own when complete.  Readers take the manifest with the
highest number.  A writer that dies leaves a folder no manifest names; one that
runs twice under the same ``token`` finds its token recorded and changes
nothing.  So "latest" is always a whole run.

There is one writer at a time per table (a driver, a stream); a second one that
finds the number it wants taken fails instead of overwriting it.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FOLDER = "_manifests"


class _Files:
    """The few file operations a manifest needs, on any store Spark knows."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark._jvm
        self.root = self._jvm.org.apache.hadoop.fs.Path(root.rstrip("/"))
        self._fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.root, name or ".")

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self.path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Create a file whole; an existing one is an error."""
        aside = self.path(f"{_FOLDER}/.{uuid.uuid4().hex}")
        stream = self._fs.create(aside, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self._fs.exists(self.path(name)) or not self._fs.rename(aside, self.path(name)):
            self._fs.delete(aside, False)
            raise FileExistsError(f"{name} exists: another writer was first")


@dataclass(frozen=True)
class Manifest:
    number: int = 0
    snapshot: str | None = None
    deltas: tuple[str, ...] = ()
    tokens: tuple[str, ...] = ()
    notes: dict = field(default_factory=dict)

    @property
    def folders(self) -> list[str]:
        return [*([self.snapshot] if self.snapshot else []), *self.deltas]


class VersionedTable:
    """A table at ``path`` (any file system Spark writes to).

    With ``keys``, a row replaces earlier rows of its keys (later deltas win);
    without, rows are appended.  ``compact_after`` deltas are folded into a new
    snapshot, so a read opens a bounded number of folders and the work of a read
    does not grow with the number of writes."""

    TOKENS = 1_000  # of the latest writes, kept to recognise one that is repeated

    def __init__(self, spark: SparkSession, path: str, keys: list[str] | None = None, compact_after: int = 10) -> None:
        self.spark, self.root, self.keys, self.compact_after = spark, path.rstrip("/"), keys, compact_after
        self._files = _Files(spark, self.root)

    # reading -----------------------------------------------------------------
    def numbers(self) -> list[int]:
        """The versions there are, ascending."""
        return sorted(int(n[:-5]) for n in self._files.names(_FOLDER) if n.endswith(".json"))

    def manifest(self, number: int | None = None) -> Manifest:
        """The latest version's manifest, or that of a version."""
        if number is None:
            numbers = self.numbers()
            if not numbers:
                return Manifest()
            number = numbers[-1]
        m = json.loads(self._files.read(f"{_FOLDER}/{number:012d}.json"))
        return Manifest(number, m["snapshot"], tuple(m["deltas"]), tuple(m["tokens"]), m["notes"])

    def read(self, number: int | None = None) -> DataFrame | None:
        """The latest version (or an earlier one by its number); None if nothing was written."""
        return self._rows(self.manifest(number))

    def _rows(self, m: Manifest) -> DataFrame | None:
        if not m.folders:
            return None
        parts = [self.spark.read.parquet(f"{self.root}/{f}").withColumn("__at", F.lit(i)) for i, f in enumerate(m.folders)]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part, allowMissingColumns=True)
        if not self.keys or len(parts) == 1:
            return whole.drop("__at")
        rest = [c for c in whole.columns if c not in self.keys and c != "__at"]
        newest = F.max_by(F.struct(*rest), "__at").alias("__row")  # a partial aggregate: a hot key is combined map-side
        return whole.groupBy(*self.keys).agg(newest).select(*self.keys, "__row.*")

    # writing -----------------------------------------------------------------
    def _folder(self, df: DataFrame) -> str:
        name = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        return name

    def _commit(self, before: Manifest, **changes) -> Manifest:
        m = Manifest(before.number + 1, **({"snapshot": before.snapshot, "deltas": before.deltas, "tokens": before.tokens,
                                            "notes": before.notes} | changes))
        text = {"snapshot": m.snapshot, "deltas": m.deltas, "tokens": m.tokens[-self.TOKENS :], "notes": m.notes}
        self._files.publish(f"{_FOLDER}/{m.number:012d}.json", json.dumps(text))
        return m

    def has(self, token: str) -> bool:
        """Whether the write of this token is part of the table."""
        return token in self.manifest().tokens

    def add(self, df: DataFrame, token: str | None = None, **notes) -> Manifest:
        """Append or upsert the rows of ``df`` (one row per key).  A token that
        was written before changes nothing."""
        before = self.manifest()
        if token is not None and token in before.tokens:
            return before
        tokens = before.tokens + ((token,) if token is not None else ())
        after = self._commit(before, deltas=(*before.deltas, self._folder(df)), tokens=tokens, notes=notes or before.notes)
        return self.compact() if len(after.deltas) >= self.compact_after else after

    def replace(self, df: DataFrame, token: str | None = None, **notes) -> Manifest:
        """Make ``df`` the whole table."""
        before = self.manifest()
        if token is not None and token in before.tokens:
            return before
        tokens = before.tokens + ((token,) if token is not None else ())
        return self._commit(before, snapshot=self._folder(df), deltas=(), tokens=tokens, notes=notes or before.notes)

    def compact(self) -> Manifest:
        """Fold the deltas into a new snapshot; earlier versions stay readable."""
        before = self.manifest()
        rows = self._rows(before)
        return before if rows is None else self._commit(before, snapshot=self._folder(rows), deltas=())

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete folders that none of the ``keep`` latest versions names."""
        numbers = self.numbers()
        used = {f for n in numbers[-keep:] for f in self.manifest(n).folders}
        gone = [n for n in self._files.names("") if n.startswith("data-") and n not in used] if numbers else []
        for name in gone:
            self._files._fs.delete(self._files.path(name), True)
        for n in numbers[:-keep]:
            self._files._fs.delete(self._files.path(f"{_FOLDER}/{n:012d}.json"), False)
        return gone
