"""The catalog of recordings: a small table of state and visibility, versioned on every change."""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "replay_sha string, state string, visible boolean, label string, analysed boolean, version long"
#: Commits after which the next one holds all entries, so that a reader opens few folders.
FULL_EVERY = 40
#: Times a change is tried again on the entries that another writer left.
ATTEMPTS = 50


class CommitConflict(RuntimeError):
    """Another writer committed the version first, again and again."""


class Commits:
    """Numbered commit files below ``path``, each made whole and by one writer only.

    A commit is a small JSON file named by its number. It is written elsewhere and then given its name, which fails
    where that is taken: by a link on a local disk, else by a rename that a shared file system refuses.
    """

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
        self.path = self._jvm.org.apache.hadoop.fs.Path(path)
        self.files = self.path.getFileSystem(self._conf)

    def _child(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.path, name)

    def read(self) -> list[dict]:
        """All commits in their order, with ``version``."""
        if not self.files.exists(self.path):
            return []
        names = sorted(s.getPath().getName() for s in self.files.listStatus(self.path) if s.getPath().getName().endswith(".json"))
        out = []
        for n in names:
            stream = self.files.open(self._child(n))
            try:
                out.append(json.loads(bytes(stream.readAllBytes())) | {"version": int(n.split(".")[0])})
            finally:
                stream.close()
        return out

    def put(self, version: int, content: dict) -> bool:
        """Whether ``version`` became this writer's."""
        self.files.mkdirs(self.path)
        draft, target = self._child(f"{uuid.uuid4().hex}.draft"), self._child(f"{version:012d}.json")
        stream = self.files.create(draft, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        try:
            if self.files.getScheme() == "file":
                at = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
                self._jvm.java.nio.file.Files.createLink(at(target), at(draft))
                return True
            return not self.files.exists(target) and self.files.rename(draft, target)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            self.files.delete(draft, False)


class Catalog:
    """A log of entries at ``path``; the last version of each recording holds.

    A change is written to a folder of its own and becomes visible by its commit, so a reader never sees half
    of it, and one whose writer died is never seen. Writers don't wait for one another: whoever commits a
    version second makes the change anew on the entries as they are by then.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.commits = Commits(spark, f"{path}/commits")

    def _folders(self) -> tuple[int, list[str]]:
        done = self.commits.read()
        last_full = max((k for k, c in enumerate(done) if c["full"]), default=0)
        return (done[-1]["version"] if done else 0), [f"{self.path}/data/{c['data']}" for c in done[last_full:]]

    def _log(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*folders)

    def _entries(self, folders: list[str]) -> DataFrame:
        w = Window.partitionBy("replay_sha").orderBy(F.desc("version"))
        return self._log(folders).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")

    def entries(self) -> DataFrame:
        return self._entries(self._folders()[1])

    def _change(self, make: Callable[[DataFrame], DataFrame]) -> int:
        """Commits what ``make`` changes of the entries; tried again on later entries where another writer was first."""
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        for attempt in range(ATTEMPTS):
            version, folders = self._folders()
            entries = self._entries(folders)
            changed = make(entries).withColumn("version", F.lit(version + 1).cast("long")).select(*columns)
            full = len(folders) >= FULL_EVERY
            if full:
                changed = changed.unionByName(entries.join(changed.select("replay_sha"), "replay_sha", "left_anti").select(*columns))
            name = uuid.uuid4().hex
            changed.write.parquet(f"{self.path}/data/{name}")
            if self.commits.put(version + 1, {"data": name, "full": full}):
                return version + 1
            left = self.commits._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/{name}")
            self.commits.files.delete(left, True)
            time.sleep(random.random() * 0.05 * (attempt + 1))
        raise CommitConflict(f"{self.path}: {ATTEMPTS} attempts")

    def add(self, recordings: DataFrame) -> None:
        """Recordings not yet known, active and visible."""
        new = {"state": F.lit("active"), "visible": F.lit(True), "label": F.lit(None).cast("string"), "analysed": F.lit(False)}
        self._change(lambda entries: recordings.select("replay_sha").distinct().join(entries, "replay_sha", "left_anti").withColumns(new))

    def change(self, shas: list[str], **values) -> None:
        """Sets ``state``, ``visible``, ``label`` or ``analysed`` of known recordings."""
        if unknown := set(values) - {"state", "visible", "label", "analysed"}:
            raise ValueError(f"unknown fields: {sorted(unknown)}")
        kinds = {c.split()[0]: c.split()[1] for c in SCHEMA.split(", ")}
        self._change(lambda entries: entries.where(F.col("replay_sha").isin(*shas)).withColumns({k: F.lit(v).cast(kinds[k]) for k, v in values.items()}))

    def mark_analysed(self, recordings: DataFrame) -> None:
        """The recordings of a table count as analysed; a join, as they may be many."""
        made = recordings.select("replay_sha").distinct()
        self._change(lambda entries: entries.where("not analysed").join(made, "replay_sha", "left_semi").withColumn("analysed", F.lit(True)))

    def reset_derived(self, *paths: str) -> None:
        """Deletes derived tables at ``paths``; recordings, decoded rows, labels and states stay, none counts as analysed."""
        for path in paths:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
        self._change(lambda entries: entries.where("analysed").withColumn("analysed", F.lit(False)))

    def to_rebuild(self, sources: DataFrame) -> DataFrame:
        """Visible, active recordings whose source is there."""
        return self.entries().where("visible and state = 'active'").join(sources.select("replay_sha"), "replay_sha", "left_semi")

    def reconcile(self, sources: DataFrame, analyses: DataFrame) -> DataFrame:
        """Where each recording is known: catalog, source, analysis."""
        flag = lambda df, name: df.select("replay_sha").distinct().withColumn(name, F.lit(True))
        j = flag(self.entries(), "in_catalog").join(flag(sources, "has_source"), "replay_sha", "full_outer").join(flag(analyses, "has_analysis"), "replay_sha", "full_outer")
        return j.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("in_catalog", "has_source", "has_analysis")})
