"""Cleaning rules as tables: any number of corrections, places, techniques and limits.

A rule is a row that is joined by equality, so the plan and its expressions have the same size however many
rules there are, and Spark broadcasts or shuffles the rules by their size. The results are those of
the literal rules of ``cleaning``, also where a value that decides is missing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulframe.functions.semantics import if_else3
from haulframe.functions.text import NOTE_SEPARATOR, matches
from haulframe.operators.joins import match_missing
from haulframe.plans.rules import BOAT, CleaningRules
from haulframe.sources import columns as C

CORRECTABLE = (C.CATCHES, C.KEPT, C.RELEASED, C.ANGLERS, C.SIZE, C.WEIGHT)

CORRECTIONS = f"position bigint, `{C.CATCH_ID}` bigint, column string, value double, note string"
SUBZONES = f"`{C.ZONE_ID}` bigint, `{C.SUBZONE_ID}` bigint, mode string"
TECHNIQUES = f"`{C.TECHNIQUE}` string, mode string"
COUNTS = f"`{C.ZONE_ID}` bigint, cap double, limit double, reset double"
EXEMPT = f"`{C.VERNACULAR}` string"
CREWS = f"`{C.MODE}` string, `{C.ZONE_ID}` bigint, most double, reset double"


@dataclass(frozen=True)
class RuleTables:
    """One table per kind of rule; the schemas are those above."""

    corrections: DataFrame
    subzones: DataFrame
    techniques: DataFrame
    counts: DataFrame
    exempt: DataFrame
    crews: DataFrame


def tables_of(spark: SparkSession, rules: CleaningRules) -> RuleTables:
    """The literal rules as tables."""
    counts, anglers = rules.counts, rules.anglers
    table = spark.createDataFrame
    return RuleTables(
        table([(i, c.catch_id, c.column, float(c.value), c.note) for i, c in enumerate(rules.corrections)], CORRECTIONS),
        table([(zone, sub, mode) for zone, subs, mode in rules.modes.subzones for sub in subs], SUBZONES),
        table(list(rules.modes.techniques.items()), TECHNIQUES),
        table([(z, float(counts.cap), float(counts.limit), float(counts.reset)) for z in counts.zones], COUNTS),
        table([(name,) for name in counts.exempt], EXEMPT),
        table([(BOAT, zone, float(most), float(anglers.reset)) for zone, most in anglers.boat_limits], CREWS),
    )


def single(rules: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """``rules`` with one row per key; keys whose rows differ fail the job, repeated rows are one.

    A missing key rules nothing.
    """
    for k in keys:
        rules = rules.where(F.col(k).isNotNull())
    others = [c for c in rules.columns if c not in keys]
    row = F.struct(*others)
    name = F.concat_ws(", ", *(F.col(k).cast("string") for k in keys))
    clash = F.raise_error(F.concat(F.lit(f"{what} overlap: "), name)).cast(rules.select(row.alias("r")).schema["r"].dataType)
    merged = rules.groupBy(*keys).agg(F.min(row).alias("_low"), F.max(row).alias("_high"))
    chosen = F.when(F.col("_low") == F.col("_high"), F.col("_low")).when(F.col("_low").eqNullSafe(F.col("_high")), F.col("_low")).otherwise(clash)
    return merged.withColumn("_row", chosen).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in others))


def correct(df: DataFrame, corrections: DataFrame, columns: Sequence[str] = CORRECTABLE) -> DataFrame:
    """Manual corrections by catch id.

    Several corrections of one value: that of the highest position holds, and the notes of all are added, in
    order of position. A row without an id cannot be told apart from the corrected ones, so what is
    corrected anywhere, and the note, become missing there. A correction of any other column than ``columns`` fails the job.
    """
    columns = [c for c in columns if c in df.columns]
    known = corrections.where(F.col(C.CATCH_ID).isNotNull())
    fails = F.raise_error(F.concat(F.lit("no such column to correct: "), F.coalesce("column", F.lit("NULL")))).cast("string")
    known = known.withColumn("column", F.when(F.col("column").isin(columns), F.col("column")).otherwise(fails))
    per_value = known.groupBy(C.CATCH_ID, "column").agg(
        F.max_by("value", F.struct("position", "value", "note")).alias("_value"), F.collect_list(F.struct("position", "column", "note")).alias("_notes")
    )
    per_id = per_value.groupBy(F.col(C.CATCH_ID).alias("_id")).agg(
        F.map_from_entries(F.collect_list(F.struct("column", "_value"))).alias("_values"),
        F.array_sort(F.flatten(F.collect_list("_notes"))).alias("_notes"),
    ).withColumn("_notes", F.array_join(F.transform("_notes", lambda n: n["note"]), NOTE_SEPARATOR))
    anywhere = known.agg(F.collect_set("column").alias("c")).scalar()
    missing = F.col(C.CATCH_ID).isNull()
    # a join would bring all rows without an id to one task; they are dealt by what else is in them, and match nothing
    simple = [f.name for f in df.schema if isinstance(f.dataType, T.AtomicType)]
    dealt = F.coalesce(F.col(C.CATCH_ID), F.xxhash64(*([C.ROW_ID] if C.ROW_ID in df.columns else simple)))
    joined = df.withColumns({"_corrected": anywhere, "_dealt": dealt}).join(per_id, (F.col("_dealt") == F.col("_id")) & ~missing, "left")
    # a value may be corrected to a missing one
    new = {
        c: F.when(missing & F.array_contains("_corrected", c), F.lit(None))
        .when(F.map_contains_key("_values", c), F.col("_values")[c]).otherwise(F.col(c)).cast(df.schema[c].dataType)
        for c in columns
    }
    noted = F.concat_ws(NOTE_SEPARATOR, F.nullif(F.col(C.NOTE), F.lit("")), F.col("_notes"))
    new[C.NOTE] = F.when(missing & (F.size("_corrected") > 0), F.lit(None)).when(F.col("_id").isNotNull(), noted).otherwise(F.col(C.NOTE))
    return joined.withColumns(new).drop("_id", "_values", "_notes", "_corrected", "_dealt")


def with_mode(df: DataFrame, subzones: DataFrame, techniques: DataFrame, pattern: str, pattern_mode: str) -> DataFrame:
    """Fishing mode: technique wording first, then the sub-zone, then the technique."""
    places = single(subzones, [C.ZONE_ID, C.SUBZONE_ID], "sub-zone rules").withColumnsRenamed(
        {C.ZONE_ID: "_zone", C.SUBZONE_ID: "_subzone", "mode": "_placed"}
    )
    texts = single(techniques, [C.TECHNIQUE], "technique rules").withColumnsRenamed({C.TECHNIQUE: "_text", "mode": "_listed"})
    joined = df.join(places, (F.col(C.ZONE_ID) == F.col("_zone")) & (F.col(C.SUBZONE_ID) == F.col("_subzone")), "left")
    joined = joined.join(texts, F.col(C.TECHNIQUE) == F.col("_text"), "left")
    worded = F.when(matches(C.TECHNIQUE, pattern), F.lit(pattern_mode))
    return joined.withColumn(C.MODE, F.coalesce(worded, "_placed", "_listed")).drop("_zone", "_subzone", "_placed", "_text", "_listed")


def _set(df: DataFrame, column: str, cond: Column, value: Column, flag: str) -> DataFrame:
    df = df.withColumn("_cond", cond)
    return df.withColumns({column: if_else3(F.col("_cond"), value, F.col(column)), flag: F.col(flag) | F.col("_cond")})


def cap_catches(df: DataFrame, counts: DataFrame, exempt: DataFrame, flag: str) -> DataFrame:
    """Caps of the zones: exempt species are cut at the cap, others above the limit are reset.

    Without a zone a count is unknown if the strictest zone would change it.
    """
    checked = single(counts, [C.ZONE_ID], "count rules").withColumn(
        "limit", F.when((F.col("reset") <= F.col("limit")) & (F.col("limit") < F.col("cap")), F.col("limit")).otherwise(
            F.raise_error(F.lit("count rules need reset <= limit < cap")).cast("double"))
    )
    # the row of all zones stands for a missing one
    by_zone = checked.rollup(C.ZONE_ID).agg(
        F.min("cap").alias("_cap"), F.min("limit").alias("_limit"), F.min("reset").alias("_reset")
    )
    names = exempt.where(F.col(C.VERNACULAR).isNotNull()).select(F.col(C.VERNACULAR).alias("_name")).distinct()
    d = match_missing(df, by_zone, [C.ZONE_ID]).join(names, F.col(C.VERNACULAR) == F.col("_name"), "left")
    schooling = F.col("_name").isNotNull()
    most, becomes = (F.when(schooling, F.col("_cap")).otherwise(F.col(c)) for c in ("_limit", "_reset"))
    above = F.col(C.CATCHES) > most
    cond = F.when(F.col("_cap").isNull(), F.lit(False)).when(F.col(C.ZONE_ID).isNotNull(), above).when(~above, F.lit(False))
    return _set(d, C.CATCHES, cond, becomes, flag).drop("_cap", "_limit", "_reset", "_name", "_cond")


def cap_crews(df: DataFrame, crews: DataFrame, flag: str) -> DataFrame:
    """Most anglers per mode and zone; larger numbers are reset.

    Where the mode or the zone is missing, a number is unknown if some rule that may apply would change it.
    """
    checked = single(crews, [C.MODE, C.ZONE_ID], "crew rules")
    # rows of all modes and of all zones stand for missing ones
    by_both = checked.cube(C.MODE, C.ZONE_ID).agg(F.min("most").alias("_most"), F.min("reset").alias("_reset"))
    d = match_missing(df, by_both, [C.MODE, C.ZONE_ID])
    above = F.col(C.ANGLERS) > F.col("_most")
    known = F.col(C.MODE).isNotNull() & F.col(C.ZONE_ID).isNotNull()
    cond = F.when(F.col("_most").isNull(), F.lit(False)).when(known, above).when(~above, F.lit(False))
    return _set(d, C.ANGLERS, cond, F.col("_reset"), flag).drop("_most", "_reset", "_cond")
