"""Map catalog entries from descriptors, files and packages; identities and their comparison."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import display_alias, name_is_usable, normalize_name


def catalog_entries(descriptors: DataFrame, flags: Mapping[str, DataFrame]) -> DataFrame:
    """One row a map: its names with how sure they are, and a flag and count for each other table.

    ``descriptors``: ``map_id, name, md5``. A name is ``exact`` where all its descriptors are one file,
    ``single`` where several files agree, ``multiple`` where they don't, ``unavailable`` without any.
    """
    usable = descriptors.where(name_is_usable(F.col("name")))
    names = usable.groupBy("map_id").agg(F.array_sort(F.collect_set("name")).alias("all_names"), F.countDistinct("md5").alias("n_files"))
    ids = descriptors.select("map_id").distinct()
    for table in flags.values():
        ids = ids.unionByName(table.select("map_id").distinct())
    out = ids.distinct().join(names, "map_id", "left")
    n = F.coalesce(F.size("all_names"), F.lit(0))
    status = F.when(F.col("all_names").isNull(), "unavailable").when(n > 1, "multiple").when(F.col("n_files") == 1, "exact").otherwise("single")
    out = out.withColumns({"name_status": status, "primary_name": F.when(F.col("all_names").isNotNull(), F.col("all_names")[0])})
    for name, table in flags.items():
        c = table.groupBy("map_id").agg(F.count("*").alias(f"{name}_count"))
        out = out.join(c, "map_id", "left").withColumn(f"{name}_count", F.coalesce(f"{name}_count", F.lit(0))).withColumn(f"has_{name}", F.col(f"{name}_count") > 0)
    return out.drop("n_files")


def repair_names(entries: DataFrame, fresh: DataFrame) -> DataFrame:
    """Entries without a name take that of ``fresh`` (``map_id, name``); others stay as they are."""
    f = fresh.where(name_is_usable(F.col("name"))).groupBy("map_id").agg(F.min("name").alias("_name"))
    j = entries.join(f, "map_id", "left")
    missing = F.col("primary_name").isNull() & F.col("_name").isNotNull()
    return j.withColumns({"name_status": F.when(missing, "repaired").otherwise(F.col("name_status")), "primary_name": F.coalesce("primary_name", "_name")}).drop("_name")


def upsert(registry: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of ``changes`` in place of those of the same key, all others as they were."""
    return registry.join(changes.select(key), key, "left_anti").unionByName(changes)


def source_signature(files: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """SHA-256 over the list of source files (``kind, name, length, modified``), a line each in order of kind and name.

    One catalog's files are some hundred; ``keys`` tells several catalogs apart. A changed signature
    means that the catalog must be built anew.
    """
    line = F.concat_ws("|", "kind", "name", F.col("length").cast("string"), F.col("modified").cast("string"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("kind", "name", line.alias("line")))), lambda x: x["line"])
    return files.groupBy(*keys).agg(F.upper(F.sha2(F.array_join(lines, "\n").cast("binary"), 256)).alias("source_signature"), F.count("*").alias("files"))


def catalog_summary(entries: DataFrame) -> DataFrame:
    """One row of figures on catalog entries: maps, named, unnamed, ambiguous, names that several maps have."""
    named = F.col("primary_name").isNotNull() & (F.trim("primary_name") != "")
    twice = entries.where(named).groupBy("primary_name").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("duplicate_names"))
    figures = entries.agg(
        F.count("*").alias("maps"), F.count_if(named).alias("named_maps"), F.count_if(~named | F.col("primary_name").isNull()).alias("unnamed_maps"), F.count_if(F.col("name_status") == "multiple").alias("ambiguous_maps")
    )
    return figures.join(twice)  # one row each


def identity_entries(descriptors: DataFrame, declared: DataFrame) -> DataFrame:
    """One row a map with its names by both authorities: ``names, primary_name, name_source, name_status, aliases`` and more.

    ``descriptors``: ``map_id, name, md5, parsed``, a row each version; ``declared``: ``map_id, name, game_id``, what the
    map's own script says. Usable declared names go before those of parsed descriptors. ``game_id`` is
    NULL and ``identity_status`` ``conflicting`` where scripts disagree. ``aliases`` are the names without an author's mark.
    """
    usable = name_is_usable(F.col("name"))
    names = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("name"))))
    d = descriptors.groupBy("map_id").agg(names(usable & F.col("parsed")).alias("descriptor_names"), F.count("*").alias("versions"), F.count_if(~F.col("parsed")).alias("failures"))
    o = declared.groupBy("map_id").agg(names(F.lit(True)).alias("declared_names"), names(usable).alias("_usable"), F.array_sort(F.collect_set("game_id")).alias("_games"))
    out = d.join(o, "map_id", "full_outer")
    none = F.array().cast("array<string>")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("descriptor_names", "declared_names", "_usable")} | {c: F.coalesce(c, F.lit(0)) for c in ("versions", "failures")})
    said, n_games = F.size("_usable") > 0, F.coalesce(F.size("_games"), F.lit(0))
    out = out.withColumns({
        "names": F.when(said, F.col("_usable")).otherwise(F.col("descriptor_names")), "name_source": F.when(said, "declared").otherwise("descriptor"),
        "name_status": F.when(said, "declared").when(F.size("descriptor_names") > 1, "multiple").when(F.size("descriptor_names") == 1, "exact").otherwise("unavailable"),
        "game_id": F.when(n_games == 1, F.get("_games", F.lit(0))), "identity_status": F.when(n_games == 0, "absent").when(n_games == 1, "unanimous").otherwise("conflicting"),
    })
    aliases = F.array_sort(F.array_distinct(F.filter(F.transform("names", display_alias), lambda a: F.length(a) > 0)))
    return out.withColumns({"primary_name": F.get("names", F.lit(0)), "aliases": aliases}).drop("_usable", "_games")


def _shared(entries: DataFrame, names: str, out: str) -> DataFrame:
    """An inverted index of normalised names to their maps, where a name has several."""
    rows = entries.select("map_id", F.explode(names).alias("n")).select("map_id", normalize_name(F.col("n"), lower=True).alias(out)).where(F.length(out) > 0)
    return rows.groupBy(out).agg(F.array_sort(F.collect_set("map_id")).alias("map_ids")).where("size(map_ids) > 1")


def duplicate_names(entries: DataFrame) -> DataFrame:
    """``normalized_name, map_ids`` of names that several maps of ``identity_entries`` have."""
    return _shared(entries, "names", "normalized_name")


def alias_collisions(entries: DataFrame) -> DataFrame:
    """``alias_name, map_ids`` of display aliases that several maps have: a user who types one means any of them."""
    return _shared(entries, "aliases", "alias_name")


def catalog_meta(entries: DataFrame, descriptors: DataFrame, declared: DataFrame) -> DataFrame:
    """The one row of figures beside a catalog of ``identity_entries``."""
    stale = (F.col("name_source") == "declared") & ~F.array_contains("descriptor_names", F.col("primary_name"))
    named = F.col("primary_name").isNotNull()
    figures = entries.agg(
        F.count("*").alias("map_id_count"), F.count_if(named).alias("exact_named_map_count"), F.count_if(~named).alias("unnamed_map_count"), F.count_if(F.col("identity_status") == "unanimous").alias("declared_identity_map_count"),
        F.count_if(F.col("identity_status") == "conflicting").alias("declared_identity_conflict_count"), F.count_if(F.col("name_source") == "declared").alias("declared_name_used_map_count"), F.count_if(stale).alias("descriptor_name_stale_map_count"),
    )
    one = lambda df, n, c=None: df.agg((F.count("*") if c is None else F.count_if(c)).alias(n))
    more = (one(duplicate_names(entries), "duplicate_name_count"), one(alias_collisions(entries), "alias_collision_count"), one(descriptors, "descriptor_version_count"), one(descriptors, "descriptor_exact_parse_count", F.col("parsed")), one(declared, "declared_identity_record_count"))
    for row in more:  # one row each
        figures = figures.join(row)
    return figures


def write_identities(entries: DataFrame, descriptors: DataFrame, declared: DataFrame, signature: str, path: str) -> None:
    """All outputs of a catalog of ``identity_entries`` below ``path``: an index, its figures with the sources' ``signature``, names and
    aliases that collide as JSON; maps, unresolved maps and descriptor versions as CSV."""
    index = entries.select("map_id", "primary_name", F.col("names").alias("all_names"), F.col("aliases").alias("display_aliases"), "name_status", "name_source", "declared_names", F.col("game_id").alias("declared_game_map_id"), "descriptor_names")
    meta = catalog_meta(entries, descriptors, declared).select(F.lit(6).alias("schema_version"), F.lit(signature).alias("source_signature"), "*")
    for name, df in (("map_index", index), ("catalog_meta", meta), ("duplicate_names", duplicate_names(entries)), ("alias_collisions", alias_collisions(entries))):
        df.write.mode("overwrite").json(f"{path}/{name}")
    plain = entries.select("map_id", "primary_name", "name_status", F.col("versions").alias("descriptor_versions"), F.col("failures").alias("descriptor_parse_failures"))
    unresolved = plain.where("primary_name is null or name_status = 'multiple'")
    for name, df in (("maps", plain.select("map_id", "primary_name", "name_status")), ("unresolved_maps", unresolved), ("descriptor_versions", descriptors.select("map_id", "name", "md5", "parsed"))):
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def load_or_fail(spark: SparkSession, path: str, signature: str) -> DataFrame:
    """The index at ``path`` if it was made of the sources with this ``signature``; an error, not a stale catalog, if not."""
    try:
        held = [r["source_signature"] for r in spark.read.json(f"{path}/catalog_meta").collect()]
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raise FileNotFoundError(f"no catalog at {path}") from e
    if held != [signature]:
        raise ValueError(f"the catalog at {path} was made of other sources")
    return spark.read.json(f"{path}/map_index")


def write_catalog(entries: DataFrame, path: str) -> None:
    """The catalog's outputs below ``path``: ``map_index`` and ``duplicate_names`` as JSON, ``maps`` and ``unresolved_maps`` as CSV."""
    plain = entries.select("map_id", "primary_name", "name_status")
    entries.write.mode("overwrite").json(f"{path}/map_index")
    twice = entries.where("primary_name is not null").groupBy("primary_name").agg(F.array_sort(F.collect_set("map_id")).alias("map_ids")).where("size(map_ids) > 1")
    twice.write.mode("overwrite").json(f"{path}/duplicate_names")
    plain.write.mode("overwrite").option("header", True).csv(f"{path}/maps")
    plain.where("primary_name is null or name_status = 'multiple'").write.mode("overwrite").option("header", True).csv(f"{path}/unresolved_maps")
