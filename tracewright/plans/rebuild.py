"""A rebuild of derived tables that a broken or repeated run takes up where it stopped."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog, Commits

#: Parts of a rebuild, each written and entered in the ledger as a whole.
BUCKETS = 64


class Ledger:
    """What has been rebuilt below ``path``: a commit for each bucket, with the contract and the recordings it was made of."""

    def __init__(self, spark: SparkSession, path: str):
        self.commits = Commits(spark, path)

    def done(self, contract: str) -> dict[int, str]:
        """The last signature of each bucket under this contract."""
        return {c["bucket"]: c["signature"] for c in self.commits.read() if c["contract"] == contract}

    def enter(self, **row) -> None:
        while not self.commits.put(max((c["version"] for c in self.commits.read()), default=0) + 1, row):
            pass  # another run was first; the next number is tried


def rebuild(spark: SparkSession, catalog: Catalog, sources: DataFrame, analyse: Callable[[DataFrame], DataFrame], out: str, contract: str, buckets: int = BUCKETS, force: bool = False) -> DataFrame:
    """Writes ``analyse(recordings)`` for all visible, active recordings whose source is there, below ``out/data``, by ``bucket``.

    ``sources`` are recordings with ``replay_sha``; ``analyse`` gives rows with ``replay_sha``. A bucket is a hash of the content
    hash. One that the ledger has under ``contract`` with the same recordings is left as it is; each other one
    replaces its own partition and is then entered, so that a run which breaks loses the bucket at hand only, and a
    bucket whose recordings changed, came or went is made anew. Buckets without recordings any more are emptied.
    Returns ``bucket, status, recordings`` with status ``kept``, ``rebuilt`` or ``emptied``.
    """
    of = F.pmod(F.xxhash64("replay_sha"), F.lit(buckets)).cast("int").alias("bucket")
    todo = catalog.to_rebuild(sources).select("replay_sha", of)
    told = todo.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64("replay_sha").cast("decimal(20,0)")).cast("string").alias("sum")).collect()
    want = {r["bucket"]: (r["n"], f"{r['n']}:{r['sum']}") for r in told}
    ledger, run = Ledger(spark, f"{out}/ledger"), uuid.uuid4().hex
    done = {} if force else ledger.done(contract)
    report = []
    for b in sorted(set(want) | set(done)):
        n, signature = want.get(b, (0, "0:0"))
        if done.get(b) == signature:
            report.append((b, "kept", n))
            continue
        if n:
            chosen = sources.withColumn("_b", of).where(F.col("_b") == b).drop("_b").join(todo.select("replay_sha"), "replay_sha", "left_semi")
            rows = analyse(chosen).withColumn("bucket", F.lit(b))
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{out}/data")
        if not n or not spark.read.parquet(f"{out}/data").where(F.col("bucket") == b).head(1):
            old = ledger.commits._jvm.org.apache.hadoop.fs.Path(f"{out}/data/bucket={b}")
            ledger.commits.files.delete(old, True)  # dynamic overwriting leaves a partition that gets no rows
        ledger.enter(run=run, contract=contract, bucket=b, signature=signature, recordings=n)
        report.append((b, "rebuilt" if n else "emptied", n))
    return spark.createDataFrame(report, "bucket int, status string, recordings long")
