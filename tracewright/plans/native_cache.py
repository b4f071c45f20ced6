"""Native tables kept beside their recordings, and trusted only as far as they prove themselves.

A stored row holds the tables found in a recording and the raw tail they were found in. It is reused
if everything about it holds; if only the scanner's rules are newer, the stored tail is scanned
again; in any other case the recording itself is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import native_tables

#: Contracts of a stored row, and what its check comes to.
CACHE, SCANNER = "native_action_cache_v1", "native_action_scanner_v3"
USABLE, MISSING, FORCED = "native_action_cache_valid", "native_action_cache_missing", "native_action_cache_bypassed_force_native_actions"
REUSE, FROM_TAIL, REBUILT, ORPHAN = "reuse", "rebuilt_from_tail", "rebuilt", "orphan"

_TABLE = "struct<count_offset:long,marker:boolean,effect_valid:boolean,effect_status:string,effect_records:long,intervals:array<array<long>>,effects:array<struct<code:double,code_bits:int,start_ms:long,end_ms:long>>>"
SCHEMA = f"replay_sha string, contract string, scanner_contract string, size_bytes long, tail_start long, tail binary, tail_sha256 string, n_tables int, n_intervals long, n_effects long, tables array<{_TABLE}>"


def scan_rows(recordings: DataFrame, scanner: str = SCANNER, tail_bytes: int = native_tables.TAIL) -> DataFrame:
    """Rows to store of ``recordings`` (``replay_sha, size_bytes, base, content``): ``content`` are a file's bytes from ``base`` on.

    The tail begins four bytes before the window, as a table's mark lies before its count.
    """
    kind = pa.struct([("code", pa.float64()), ("code_bits", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64())])
    table = pa.struct([("count_offset", pa.int64()), ("marker", pa.bool_()), ("effect_valid", pa.bool_()), ("effect_status", pa.string()), ("effect_records", pa.int64()), ("intervals", pa.list_(pa.list_(pa.int64()))), ("effects", pa.list_(kind))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sha, size, base, content in zip(*(batch.column(c) for c in ("replay_sha", "size_bytes", "base", "content"))):
                data, base, size = content.as_py() or b"", base.as_py(), size.as_py()
                found = [c | {"effects": [dict(zip(("code", "code_bits", "start_ms", "end_ms"), e)) for e in c["effects"]]} for c in native_tables.drift_candidates(data, tail_bytes, base)]
                start = max(base, native_tables.tail_start(size, tail_bytes) - 4)
                arrays = [pa.array([x]) for x in (sha.as_py(), size, max(0, start), data[max(0, start - base) :])] + [pa.array([found], pa.list_(table))]
                yield pa.RecordBatch.from_arrays(arrays, names=["replay_sha", "size_bytes", "tail_start", "tail", "tables"])

    out = recordings.select("replay_sha", "size_bytes", "base", "content").mapInArrow(scan, f"replay_sha string, size_bytes long, tail_start long, tail binary, tables array<{_TABLE}>")
    out = out.withColumns({"contract": F.lit(CACHE), "scanner_contract": F.lit(scanner), "tail_sha256": F.sha2("tail", 256), "n_tables": F.size("tables"), "n_intervals": _total("intervals"), "n_effects": _total("effects")})
    return out.select(*[c.split()[0] for c in SCHEMA.split(", ")[:-1]], "tables")


def _total(field: str) -> Column:
    return F.aggregate("tables", F.lit(0).cast("long"), lambda n, t: n + F.size(t[field]))


def checked(source: DataFrame, stored: DataFrame, scanner: str = SCANNER, tail_bytes: int = native_tables.TAIL, force: bool = False) -> DataFrame:
    """``replay_sha, mode, status``: what is to become of each recording of ``source`` (``replay_sha, size_bytes``) and each stored row.

    One full outer join by content hash. A row is checked in this order, and the first that fails is its
    status: contract, one row a recording, size, tail against window and size, tail against its hash, tables
    against the declared counts, order of intervals, effects that end after they start. Only a row
    that passes all of it counts at all; then an older scanner's row is scanned from its tail, if that reaches
    far enough back. Stored rows without a recording are ``orphan``.
    """
    intervals = F.forall("tables", lambda t: F.forall(t["intervals"], lambda i: (F.size(i) == 2) & (i[0] <= i[1])) & (t["intervals"] == F.array_sort(t["intervals"])))
    effects = F.forall("tables", lambda t: F.forall(t["effects"], lambda e: e["start_ms"] <= e["end_ms"]))
    rows = stored.groupBy("replay_sha").agg(F.count("*").alias("_copies"), F.first(F.struct(*[c for c in stored.columns if c != "replay_sha"])).alias("s"))
    rows = rows.select("replay_sha", "_copies", *[F.col(f"s.{c}").alias(c if c != "size_bytes" else "_stored_size") for c in stored.columns if c != "replay_sha"])
    j = source.select("replay_sha", "size_bytes", F.lit(True).alias("_there")).dropDuplicates(["replay_sha"]).join(rows.withColumn("_kept", F.lit(True)), "replay_sha", "full_outer")
    whole = (
        ("native_action_cache_contract_mismatch", F.col("contract") == CACHE), ("native_action_cache_repeated", F.col("_copies") == 1),
        ("native_action_cache_source_size_mismatch", F.col("_stored_size") == F.col("size_bytes")),
        ("native_action_cache_tail_window_mismatch", F.col("tail_start") + F.octet_length("tail") == F.col("size_bytes")),
        ("native_action_cache_tail_hash_mismatch", F.sha2("tail", 256) == F.col("tail_sha256")),
        ("native_action_cache_count_mismatch", (F.size("tables") == F.col("n_tables")) & (_total("intervals") == F.col("n_intervals")) & (_total("effects") == F.col("n_effects"))),
        ("native_action_cache_intervals_invalid", intervals), ("native_action_cache_effects_invalid", effects),
    )
    bad = F.coalesce(*[F.when(~F.coalesce(holds, F.lit(False)), status) for status, holds in whole])
    newer = F.col("scanner_contract").eqNullSafe(scanner)
    needed = F.greatest(F.lit(0), F.col("size_bytes") - F.greatest(F.lit(32_768), F.lit(tail_bytes)) - 4)
    reaches = F.col("tail_start") <= needed
    status = F.when(F.col("_there").isNull(), "native_action_cache_without_source").when(F.lit(force), FORCED).when(F.col("_kept").isNull(), MISSING)
    status = F.coalesce(status, bad, F.when(newer, USABLE).when(reaches, "native_action_scanner_contract_mismatch").otherwise("native_action_cache_tail_window_too_small"))
    j = j.withColumn("status", status)
    mode = F.when(F.col("_there").isNull(), ORPHAN).when(F.col("status") == USABLE, REUSE).when(F.col("status") == "native_action_scanner_contract_mismatch", FROM_TAIL).otherwise(REBUILT)
    return j.select("replay_sha", mode.alias("mode"), "status")


def refreshed(source: DataFrame, stored: DataFrame, scanner: str = SCANNER, tail_bytes: int = native_tables.TAIL, force: bool = False) -> DataFrame:
    """The stored rows as they ought to be, with ``mode`` and ``status``: one for each recording of ``source`` (``replay_sha, size_bytes, content``).

    Contents are joined and read for rebuilt recordings only, tails for those scanned again. The result
    is written by the caller as the next version of the table; orphans aren't in it.
    """
    plan = checked(source, stored, scanner, tail_bytes, force)
    of = lambda mode: plan.where(F.col("mode") == mode)
    columns = [c.split()[0] for c in SCHEMA.split(", ")[:-1]] + ["tables"]
    kept = stored.join(of(REUSE), "replay_sha").select(*columns, "mode", "status")
    tails = stored.join(of(FROM_TAIL).select("replay_sha"), "replay_sha").select("replay_sha", "size_bytes", F.col("tail_start").alias("base"), F.col("tail").alias("content"))
    files = source.join(of(REBUILT).select("replay_sha"), "replay_sha").select("replay_sha", "size_bytes", F.lit(0).cast("long").alias("base"), "content")
    new = scan_rows(tails.union(files.dropDuplicates(["replay_sha"])), scanner, tail_bytes).join(plan, "replay_sha").select(*columns, "mode", "status")
    return kept.union(new)


def audit(source: DataFrame, stored: DataFrame) -> DataFrame:
    """``replay_sha, agrees, stored_tables, found_tables``: stored tables against a new scan of the recordings themselves."""
    again = scan_rows(source.withColumn("base", F.lit(0).cast("long"))).select("replay_sha", F.col("tables").alias("_found"), F.col("tail_sha256").alias("_sha"))
    j = stored.join(again, "replay_sha", "full_outer")
    same = F.col("tables").eqNullSafe(F.col("_found")) & F.col("tail_sha256").eqNullSafe(F.col("_sha"))
    return j.select("replay_sha", same.alias("agrees"), F.coalesce(F.size("tables"), F.lit(-1)).alias("stored_tables"), F.coalesce(F.size("_found"), F.lit(-1)).alias("found_tables"))
