"""Raw declarations -> cleaned declarations, as one lazy plan.

The order of the steps matters and is kept: duplicates are judged after the
value fixes but before any correction, and every cap sees the result of the
previous one. The only shuffle is the deduplication; everything else is row by
row or joins a reference table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulframe.functions import calendar
from haulframe.functions.semantics import if_else3, is_in
from haulframe.functions.text import add_note, digits_id, matches, present_label
from haulframe.operators.dedupe import keep_first_except
from haulframe.operators.filters import since
from haulframe.operators.joins import with_dimension
from haulframe.operators.outings import outing_key
from haulframe.plans import rule_tables
from haulframe.plans.rule_tables import RuleTables
from haulframe.plans.rules import (
    BOAT, AnglerRules, CleaningRules, Correction, CountRules, ModeRules,
)
from haulframe.sources import columns as C

# Columns that do not make two declarations different.
NOT_COMPARED = (C.CATCH_ID, C.STAMP, C.LATITUDE, C.LONGITUDE, C.PHOTO)

KEY = "_key"


def with_calendar(df: DataFrame) -> DataFrame:
    return df.withColumns({
        C.WEEKDAY: calendar.weekday_label(C.SESSION),
        C.MONTH: calendar.month_label(C.SESSION),
        C.MONTH_NUMBER: calendar.month_number(C.SESSION),
        C.YEAR: F.year(C.SESSION),
    })


def value_fixes() -> dict[str, Column]:
    """Zero durations are unknown, no-kill defaults to 0, ids are numbers and
    weights are positive."""
    return {
        C.DURATION: F.nullif(F.col(C.DURATION), F.lit(0.0)),
        C.NO_KILL: F.coalesce(F.col(C.NO_KILL), F.lit(0.0)),
        C.CATCH_ID: digits_id(C.CATCH_ID),
        C.WEIGHT: F.abs(C.WEIGHT),
    }


def fix_values(df: DataFrame) -> DataFrame:
    return df.withColumns(value_fixes())


def recode_zone(df: DataFrame, rules: CleaningRules) -> DataFrame:
    """The invalid zone becomes the open-sea zone and leaves a note."""
    invalid = F.col(C.ZONE_ID) == rules.invalid_zone
    return df.withColumns({
        C.NOTE: F.when(invalid, F.lit(rules.invalid_zone_note)),
        C.ZONE_ID: F.when(invalid, F.lit(rules.open_sea_zone)).otherwise(F.col(C.ZONE_ID)),
        C.ZONE: F.coalesce(F.col(C.ZONE), F.lit(rules.default_zone_name)),
    })


def correct(df: DataFrame, corrections: tuple[Correction, ...]) -> DataFrame:
    """Manual corrections; a row without an id cannot be told apart from the
    corrected one, so its value and note become missing."""
    for c in corrections:
        hit = F.col(C.CATCH_ID) == c.catch_id
        df = df.withColumns({
            c.column: if_else3(hit, F.lit(float(c.value)), F.col(c.column)),
            C.NOTE: add_note(C.NOTE, c.note, hit),
        })
    return df


def fishing_mode(rules: ModeRules) -> Column:
    """Technique wording first, then the sub-zone, then the technique list."""
    worded = F.when(matches(C.TECHNIQUE, rules.pattern), F.lit(rules.pattern_mode))
    placed = [
        F.when((F.col(C.ZONE_ID) == zone) & is_in(C.SUBZONE_ID, subzones), F.lit(mode))
        for zone, subzones, mode in rules.subzones
    ]
    pairs = [F.lit(text) for pair in rules.techniques.items() for text in pair]
    listed = F.try_element_at(F.create_map(*pairs), F.col(C.TECHNIQUE))
    return F.coalesce(worded, *placed, listed)


def _capped(df: DataFrame, column: str, cond: Column, value: Column, flag: str) -> DataFrame:
    """Set ``column`` where ``cond`` holds and remember it in ``flag``."""
    df = df.withColumn("_cond", cond)
    return df.withColumns({
        column: if_else3(F.col("_cond"), value, F.col(column)),
        flag: F.col(flag) | F.col("_cond"),
    }).drop("_cond")


def _bounds(rules: CountRules) -> tuple[Column, Column]:
    """Largest accepted count of a row, and what a larger one becomes.

    Schooling species are cut at the cap. For the others the cap itself is
    above the limit, so anything above the limit ends at the reset value.
    """
    schooling = is_in(C.VERNACULAR, rules.exempt)
    cap = F.lit(float(rules.cap))
    return (
        F.when(schooling, cap).otherwise(F.lit(float(rules.limit))),
        F.when(schooling, cap).otherwise(F.lit(float(rules.reset))),
    )


def cap_catches(df: DataFrame, rules: CountRules, flag: str) -> DataFrame:
    """Caps in the listed zones; they share limits and a row is in one zone."""
    most, becomes = _bounds(rules)
    cond = F.col(C.ZONE_ID).isin(list(rules.zones)) & (F.col(C.CATCHES) > most)
    return _capped(df, C.CATCHES, cond, becomes, flag)


def cap_kept_released(df: DataFrame, rules: CountRules, flag: str) -> DataFrame:
    """The same caps on kept (or released) fish where the other count is 0."""
    most, becomes = _bounds(rules)
    for column, other in ((C.KEPT, C.RELEASED), (C.RELEASED, C.KEPT)):
        cond = (F.col(other) == 0) & (F.col(column) > most)
        df = _capped(df, column, cond, becomes, flag)
    return df


def cap_anglers(df: DataFrame, rules: AnglerRules, flag: str) -> DataFrame:
    """Boat limits by zone first, then the general bounds on their result."""
    n, reset = F.col(C.ANGLERS), F.lit(float(rules.reset))
    crowded = reduce(
        lambda a, b: a | b,
        ((F.col(C.ZONE_ID) == zone) & (n > most) for zone, most in rules.boat_limits),
    )
    return cap_crowds(_capped(df, C.ANGLERS, (F.col(C.MODE) == BOAT) & crowded, reset, flag), rules, flag)


def cap_crowds(df: DataFrame, rules: AnglerRules, flag: str) -> DataFrame:
    """The general bounds on the number of anglers."""
    n = F.col(C.ANGLERS)
    return _capped(df, C.ANGLERS, (n > rules.limit) | (n <= 0), F.lit(float(rules.reset)), flag)


def cap_outliers(df: DataFrame, rules: CleaningRules, tables: RuleTables | None = None) -> DataFrame:
    df = df.withColumns({"_odd_catches": F.lit(False), "_odd_anglers": F.lit(False)})
    if tables:
        df = rule_tables.cap_catches(df, tables.counts, tables.exempt, "_odd_catches")
    else:
        df = cap_catches(df, rules.counts, "_odd_catches")
    df = cap_kept_released(df, rules.counts, "_odd_catches")
    if tables:
        df = cap_crowds(rule_tables.cap_crews(df, tables.crews, "_odd_anglers"), rules.anglers, "_odd_anglers")
    else:
        df = cap_anglers(df, rules.anglers, "_odd_anglers")
    df = df.withColumn(C.NOTE, add_note(C.NOTE, rules.counts.note, F.col("_odd_catches")))
    df = df.withColumn(C.NOTE, add_note(C.NOTE, rules.anglers.note, F.col("_odd_anglers")))
    return df.drop("_odd_catches", "_odd_anglers")


def compared_key(df: DataFrame) -> Column:
    """Digest of all that makes two declarations different.

    A missing value and a column that an export lacks are the same.
    """
    compared = sorted(c for c in df.columns if c not in NOT_COMPARED and not c.startswith("_"))
    # a number has one text, whatever the sign of its zero
    plain = ((F.col(c) + 0.0 if df.schema[c].dataType.simpleString() == "double" else F.col(c)).alias(c) for c in compared)
    return F.unhex(F.md5(F.to_json(F.struct(*plain)).cast("binary")))


def clean_declarations(
    raw: DataFrame, size_limits: DataFrame, rules: CleaningRules | None = None, tables: RuleTables | None = None,
    seen: DataFrame | None = None,
) -> DataFrame:
    """The whole cleaning. ``raw`` needs a ``_row_id`` (its order in the file).

    With ``tables`` corrections, modes, catch caps and crews come from them. ``seen`` are keys (``_key``) of declarations
    loaded before, which are duplicates; the result then keeps its keys.
    """
    rules = rules or CleaningRules()
    C.require_columns(raw, (*C.RAW_REQUIRED, C.ROW_ID))
    named = C.normalise_names(raw)

    def unseen(d: DataFrame) -> DataFrame:
        return d.withColumn(KEY, compared_key(d)).join(seen.select(KEY), KEY, "left_anti")

    steps = (
        lambda d: since(d, rules.date_min),
        fix_values,
        lambda d: keep_first_except(d, NOT_COMPARED, C.ROW_ID),
        lambda d: unseen(d) if seen is not None else d,
        with_calendar,
        lambda d: recode_zone(d, rules),
        lambda d: rule_tables.correct(d, tables.corrections) if tables else correct(d, rules.corrections),
        lambda d: with_dimension(d, size_limits, [C.SPECIES], [C.SIZE_MAX, C.WEIGHT_MAX]),
        lambda d: (
            rule_tables.with_mode(d, tables.subzones, tables.techniques, rules.modes.pattern, rules.modes.pattern_mode)
            if tables else d.withColumn(C.MODE, fishing_mode(rules.modes))
        ),
        lambda d: d.withColumn(C.MEMBER, present_label(C.FEDERATION)),
        lambda d: cap_outliers(d, rules, tables),
        lambda d: d.withColumn(C.OUTING, outing_key()),
    )
    return reduce(lambda d, step: step(d), steps, named)
