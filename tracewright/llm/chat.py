"""Chat formatting: logged snapshots of a conversation collapse into its longest one.

DataFrame functions only. A conversation logged again after every turn leaves many prefixes of
itself. Each turn has a digest; sums of hashes of (turn number, digest) roll along a conversation,
so that equal prefixes have equal sums whatever conversation they are from. An anti-join of whole
conversations against all proper prefixes keeps the maximal ones, which are then rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers in one stretch of a conversation; long conversations roll stretch by stretch.
STRETCH = 256


def _part(value: Column) -> Column:
    """Text of a value that can't run into its neighbour; null differs from empty."""
    return F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def _key(conv: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("null"))


def _two_sums(a: str, b: str) -> list[Column]:
    return [F.sum(c).cast("decimal(38,0)").alias(c) for c in (a, b)]


def rolling_prefixes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(c, turn, a, b, last)``: both prefix sums of conversation ``c`` up to each of its turns.

    Sums are exact decimals of 64-bit hashes under two salts, 128 bits in all. Rows with the same
    turn number are one turn, in whatever order they come. No stretch depends on more than the
    totals of the stretches before it, so that one endless conversation spreads over many tasks.
    """
    digest = F.sha2(F.concat(_part(F.col(role).cast("string")), _part(F.col(text).cast("string"))), 256)
    rows = turns.select(_key(conv).alias("c"), F.coalesce(F.col(turn).cast("long"), F.lit(-1)).alias("t"), digest.alias("d"))
    salted = [F.xxhash64(F.lit(k), "t", "d").cast("decimal(20,0)").alias(n) for k, n in ((1, "a"), (2, "b"))]
    each = rows.select("c", "t", *salted).groupBy("c", "t").agg(*_two_sums("a", "b"))
    each = each.withColumn("s", F.floor(F.col("t") / F.lit(STRETCH)))
    inside = Window.partitionBy("c", "s").orderBy("t")
    each = each.select("c", "s", "t", *[F.sum(n).over(inside).alias(n) for n in ("a", "b")])
    across = Window.partitionBy("c").orderBy("s")
    totals = each.groupBy("c", "s").agg(F.max_by("a", "t").alias("a"), F.max_by("b", "t").alias("b"), F.max("t").alias("end"))
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(
        "c",
        "s",
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).cast("decimal(38,0)").alias(f"{n}0") for n in ("a", "b")],
        (F.lead("s").over(across).isNull()).alias("final"),
        "end",
    )
    joined = each.join(base, ["c", "s"])
    return joined.select(
        "c",
        "t",
        *[(F.col(n) + F.col(f"{n}0")).cast("decimal(38,0)").alias(n) for n in ("a", "b")],
        (F.col("final") & (F.col("t") == F.col("end"))).alias("last"),
    )


def maximal_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, copies)``: conversations that are no proper prefix of another one.

    Of equal conversations the one with the smallest id stays and ``copies`` counts them all. Turn
    numbers, roles and texts must agree. Rows with a null id are one conversation.
    """
    prefixes = rolling_prefixes(turns, conv, turn, role, text)
    ids = turns.select(_key(conv).alias("c"), F.col(conv).alias("conv_id")).distinct()
    whole = prefixes.where("last").join(ids, "c").groupBy("t", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    inner = prefixes.where("not last").select("t", "a", "b").distinct()
    return whole.join(inner, ["t", "a", "b"], "left_anti").select("conv_id", "copies")


def render(turns: DataFrame, kept: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, n_turns, copies, rendered)``: turns in order between start and end marks.

    Null roles and texts are written as empty ones; rows of one turn by role, then text. A mark's
    beginning within a role or text is written with one more space (``<|im_`` as ``< |im_``, that as ``<  |im_``), so
    that no text can forge a turn and a reader who takes one space out has the text again.
    """
    rows = turns.select(
        _key(conv).alias("c"),
        F.coalesce(F.col(turn).cast("long"), F.lit(-1)).alias("t"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("r"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("x"),
    )
    chosen = kept.select(_key("conv_id").alias("c"), "conv_id", "copies")
    plain = lambda v: F.regexp_replace(v, r"<( *)\|im_", "< $1|im_")
    line = F.transform("turns", lambda v: F.concat(F.lit("<|im_start|>"), plain(v["r"]), F.lit("\n"), plain(v["x"]), F.lit("<|im_end|>\n")))
    return (
        rows.join(chosen, "c")
        .groupBy("c")
        .agg(F.first("conv_id").alias("conv_id"), F.first("copies").alias("copies"), F.array_sort(F.collect_list(F.struct("t", "r", "x"))).alias("turns"))
        .select("conv_id", F.size("turns").cast("long").alias("n_turns"), "copies", F.array_join(line, "").alias("rendered"))
    )


def format_conversations(turns: DataFrame) -> DataFrame:
    """Maximal conversations of ``(conv_id, turn, role, text)``, rendered; empty for no rows."""
    return render(turns, maximal_conversations(turns))


SQL = """
WITH lines AS (
  SELECT conv_id, coalesce(turn, -1) AS t,
         coalesce(length(role)::VARCHAR || ':' || role, '-') || coalesce(length(text)::VARCHAR || ':' || text, '-') AS d,
         coalesce(role, '') AS r, coalesce(text, '') AS x
  FROM conversations),
each AS (SELECT conv_id, t, string_agg(d, chr(30) ORDER BY d) AS d FROM lines GROUP BY conv_id, t),
prefixes AS (
  SELECT conv_id, t, string_agg(t::VARCHAR || chr(31) || d, chr(29)) OVER w AS p, lead(t) OVER w IS NULL AS last
  FROM each WINDOW w AS (PARTITION BY conv_id ORDER BY t)),
whole AS (SELECT p, min(conv_id) AS conv_id, count(*) AS copies FROM prefixes WHERE last GROUP BY p),
kept AS (SELECT conv_id, copies FROM whole WHERE p NOT IN (SELECT p FROM prefixes WHERE NOT last))
SELECT k.conv_id, count(*) AS n_turns, k.copies,
       string_agg('<|im_start|>' || regexp_replace(r, '<( *)\\|im_', '< \\1|im_', 'g') || chr(10) || regexp_replace(x, '<( *)\\|im_', '< \\1|im_', 'g') || '<|im_end|>' || chr(10), '' ORDER BY t, r, x) AS rendered
FROM lines l JOIN kept k ON l.conv_id IS NOT DISTINCT FROM k.conv_id
GROUP BY k.conv_id, k.copies
"""
