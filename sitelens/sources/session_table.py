"""A versioned table of sessions on a shared folder.

Rows lie in buckets of their id.  A change writes new files for the buckets of the ids it brings
and nothing else, then a manifest that names the files of every bucket, and last the version's
pointer: one rename that fails if another writer has made that version, in which case the change is
applied anew to theirs.  Readers see a version whole or not at all.  A deleted id stays as a
tombstone, so a save that is older than the deletion does not bring it back.

Of several rows of an id the one with the latest time counts, a tombstone before a session of
the same time, then the larger content: which row wins never depends on the order of work."""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sitelens.session import cut_lineage
from sitelens.sources.sessions import save_guard

BUCKETS = 64
#: Times a change is applied anew because another writer was faster.
ATTEMPTS = 20


class Conflict(RuntimeError):
    """Other writers were faster every time."""


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int")


class SessionTable:
    """Sessions by ``session_id`` with an ``updated_at``; all other columns are the session's content.

    ``schema`` is needed to make a new table only; an existing one keeps its own."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | None = None, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._paths = jvm.org.apache.hadoop.fs.Path
        self._fs = self._paths(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        context = jvm.org.apache.hadoop.fs.FileContext
        self._files = context.getFileContext(self._fs.getUri(), spark._jsc.hadoopConfiguration())
        if self.version() is None:
            if schema is None:
                raise ValueError(f"no session table at {self.path}: give a schema to make one")
            self._publish(0, {"schema": json.loads(schema.json()), "buckets": buckets, "files": {}})

    # -- versions -----------------------------------------------------------

    def version(self) -> int | None:
        """The newest version, by the names in one folder."""
        folder = self._paths(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return None
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n) for n in names if n.isdigit()), default=None)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        stream = self._fs.open(self._paths(f"{self.path}/versions/{version:010d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, version: int, manifest: dict) -> bool:
        """Make a version visible; False if somebody else has made it."""
        hidden = self._paths(f"{self.path}/versions/.{uuid4().hex}")
        stream = self._fs.create(hidden, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        none = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.valueOf("NONE")
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        try:
            self._files.rename(hidden, self._paths(f"{self.path}/versions/{version:010d}"), options)
        except Exception as error:  # py4j wraps the file system's answer
            self._fs.delete(hidden, False)
            if "FileAlreadyExists" in str(error):
                return False
            raise
        return True

    # -- rows ---------------------------------------------------------------

    def _schema(self, manifest: dict) -> StructType:
        return StructType.fromJson(manifest["schema"]).add("deleted", "boolean")

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        """Rows and tombstones of the given buckets, of all if None."""
        wanted = [f for b, f in manifest["files"].items() if buckets is None or int(b) in buckets]
        schema = self._schema(manifest)
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in sorted(wanted)])

    def read(self, version: int | None = None) -> DataFrame:
        """The sessions of a version, the newest unless one is named.  Columns not asked for aren't read."""
        return self._rows(self.manifest(version)).where("NOT deleted").drop("deleted")

    def _change(self, rows: DataFrame) -> int:
        """Apply rows and tombstones to the newest version until no other writer comes between."""
        for _ in range(ATTEMPTS):
            version = self.version()
            manifest = self.manifest(version)
            n = manifest["buckets"]
            schema = self._schema(manifest)
            changed = rows.withColumn("deleted", F.coalesce("deleted", F.lit(False))).select(*schema.names)
            touched = sorted(r[0] for r in changed.select(_bucket(n)).distinct().collect())  # as many as buckets at most
            if not touched:
                return version
            every = self._rows(manifest, touched).unionByName(changed)
            content = [c for c in schema.names if c != "session_id"]
            rank = F.struct(F.try_to_timestamp("updated_at"), "updated_at", "deleted", F.sha2(F.to_json(F.struct(*content)), 256))
            newest = (
                every.groupBy("session_id")
                .agg(F.max_by(F.struct(*content), rank).alias("r"))
                .select("session_id", "r.*")
                .withColumn("bucket", _bucket(n))
            )
            folder = f"data/{uuid4().hex}"
            newest.write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
            files = manifest["files"] | {str(b): f"{folder}/bucket={b}" for b in touched}
            if self._publish(version + 1, manifest | {"files": files}):
                return version + 1
        raise Conflict(f"{ATTEMPTS} attempts to change {self.path} met other writers")

    def save(self, incoming: DataFrame, now: str) -> DataFrame:
        """Insert or replace sessions as of ``now``; returns the refused ones with the reason."""
        judged = cut_lineage(incoming.withColumn("refused", save_guard(incoming)), "incoming")
        accepted = judged.where("refused IS NULL").drop("refused")
        self._change(accepted.withColumn("updated_at", F.lit(now)).withColumn("deleted", F.lit(False)))
        return judged.where("refused IS NOT NULL")

    def load(self, sessions: DataFrame) -> None:
        """Insert sessions with the times they carry; an older one doesn't replace a newer."""
        self._change(cut_lineage(sessions.withColumn("deleted", F.lit(False)), "incoming"))

    def apply(self, changes: DataFrame) -> None:
        """Rows, and tombstones where ``deleted``, with the times they carry: each counts if none of
        its id is newer, so that changes may come twice or late."""
        self._change(cut_lineage(changes, "incoming"))

    def delete(self, ids: DataFrame, now: str) -> None:
        """Tombstones for the ids that the table holds."""
        held = self.read().select("session_id").join(ids.select("session_id").distinct(), "session_id", "left_semi")
        schema = self._schema(self.manifest())
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in ("session_id", "updated_at", "deleted")]
        rows = held.select("session_id", F.lit(now).alias("updated_at"), F.lit(True).alias("deleted"), *empty)
        self._change(cut_lineage(rows, "incoming"))
