"""Dashboard indicators over cleaned declarations.

All of them are one or two hash aggregations whose partial results are combined
before the shuffle, so a species, zone or outing that holds a large part of the
rows costs one row per task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulframe.functions import calendar
from haulframe.functions.semantics import divide, first_by, if_else3, nan_to_null, sum0
from haulframe.operators.filters import determinable_mode, in_months, of_mode
from haulframe.operators.joins import match_missing, present_in
from haulframe.operators.order_stats import merged_values, quantiles_of, share
from haulframe.operators.reshape import to_long
from haulframe.operators.top import (
    in_label_order, largest_first, percent_of_total, ranked_labels, top_n,
)
from haulframe.sources import columns as C

TOP_CATCHES = 5
TOP_CPUE = 10


def _kg(grams: str):
    return kilograms(sum0(grams))


def kilograms(grams: Column) -> Column:
    return F.round(grams / 1000, 2)


def centimetres(millimetres: str) -> Column:
    return F.col(millimetres) / 10


def key_figures(df: DataFrame) -> DataFrame:
    """Distinct anglers, distinct outings and the total catch, in one row."""
    per_outing = df.groupBy(C.OUTING).agg(F.sum(C.CATCHES).alias("_catch"), F.collect_set(F.struct(C.ANGLER)).alias("_who"))
    # an outing has one angler, but a missing one and one named like it share its id
    who = per_outing.select("_catch", F.posexplode("_who").alias("_at", "_angler"))
    first = F.col("_at") == 0
    per_angler = who.groupBy(f"_angler.{C.ANGLER}").agg(F.sum(F.when(first, F.col("_catch"))).alias("_catch"), F.count_if(first).alias("_outings"))
    return per_angler.agg(
        F.count(F.lit(1)).alias("n_anglers"),
        F.coalesce(F.sum("_outings"), F.lit(0)).alias("n_outings"),
        sum0("_catch").alias("total_catch"),
    )


def species_list(df: DataFrame) -> DataFrame:
    """Catch, biomass and share of the catch per vernacular name."""
    by_species = df.groupBy(C.VERNACULAR).agg(
        sum0(C.CATCHES).alias("n_caught"), _kg(C.LINE_WEIGHT).alias("biomass_kg")
    )
    shared = percent_of_total(by_species, "n_caught", "percent", ["n_caught", "biomass_kg"])
    return shared.withColumn("percent", F.round("percent", 2)).orderBy(*species_order())


def species_order() -> list[Column]:
    return largest_first("n_caught", [C.VERNACULAR])


def top_species(df: DataFrame, months: Iterable[str] | None = None, n: int = TOP_CATCHES) -> DataFrame:
    """The most caught scientific names with their catch and biomass."""
    C.require_columns(df, C.TOP_REQUIRED)
    if months is not None:
        df = in_months(df, months)
    totals = df.groupBy(C.SPECIES).agg(
        sum0(C.CATCHES).alias("total"), _kg(C.LINE_WEIGHT).alias("biomass_kg")
    )
    return top_n(totals, "total", [C.SPECIES], n)


def top_species_labelled(
    df: DataFrame, months: Iterable[str] | None = None, n: int = TOP_CATCHES
) -> DataFrame:
    """``top_species`` with codes and vernacular names; a species that was
    declared under several names gives several rows.

    One pass over the declarations sums by all three names; the species are
    totals of that small table.
    """
    C.require_columns(df, C.TOP_REQUIRED)
    if months is not None:
        df = in_months(df, months)
    names = df.groupBy(C.SPECIES, C.FAO_CODE, C.VERNACULAR).agg(
        F.sum(C.CATCHES).alias("_catch"), F.sum(C.LINE_WEIGHT).alias("_weight")
    )
    totals = names.groupBy(C.SPECIES).agg(sum0("_catch").alias("total"), _kg("_weight").alias("biomass_kg"))
    top = top_n(totals, "total", [C.SPECIES], n)
    return match_missing(top, names.drop("_catch", "_weight"), [C.SPECIES]).orderBy(
        *largest_first("total", [C.SPECIES, C.FAO_CODE, C.VERNACULAR])
    )


def monthly_catch(df: DataFrame) -> DataFrame:
    """Catch per year and month, in calendar order."""
    return (
        df.groupBy(C.YEAR, C.MONTH_NUMBER).agg(sum0(C.CATCHES).alias("n_caught"))
        .withColumn(C.MONTH, calendar.month_label_of_number(C.MONTH_NUMBER))
        .select(C.YEAR, C.MONTH_NUMBER, C.MONTH, "n_caught")
        .orderBy(*month_order())
    )


def monthly_with_totals(df: DataFrame) -> DataFrame:
    """Catch per month, per year and in all, from one aggregation.

    ``level`` is 0 for a month, 1 for a year and 3 for the total; an undated month is a month.
    """
    levels = [[C.YEAR, C.MONTH_NUMBER], [C.YEAR], []]
    return df.groupingSets([[F.col(c) for c in x] for x in levels], C.YEAR, C.MONTH_NUMBER).agg(
        F.grouping_id().alias("level"), sum0(C.CATCHES).alias("n_caught")
    ).withColumn(C.MONTH, F.when(F.col("level") == 0, calendar.month_label_of_number(C.MONTH_NUMBER)))  # a total has no month to label


def month_order() -> list[Column]:
    """Calendar order, undated last."""
    return [F.col(C.YEAR).asc_nulls_last(), F.col(C.MONTH_NUMBER).asc_nulls_last()]


def total_catch(df: DataFrame) -> DataFrame:
    return df.agg(sum0(C.CATCHES).alias("total_catch"))


def latest_month(monthly: DataFrame) -> DataFrame:
    """The last month of the last year that has catches declared."""
    known = monthly.where(F.col(C.MONTH_NUMBER).isNotNull())
    last = F.max_by(F.struct(*known.columns), F.struct(C.YEAR, C.MONTH_NUMBER))
    return known.agg(last.alias("m")).where(F.col("m").isNotNull()).select("m.*")


def fruitless_outings(df: DataFrame) -> DataFrame:
    """Outings per zone, and how many of them caught nothing."""
    per_outing = df.groupBy(C.ZONE, C.OUTING).agg(sum0(C.CATCHES).alias("n_caught"))
    return per_outing.groupBy(C.ZONE).agg(
        F.count(F.lit(1)).alias("n_outings"),
        F.count_if(F.col("n_caught") == 0).alias("n_fruitless"),
    ).withColumn("n_with_catch", F.col("n_outings") - F.col("n_fruitless"))


def fruitless_share(df: DataFrame) -> DataFrame:
    """Outings with and without catch over all zones, with percentages."""
    sums = fruitless_outings(df).agg(
        sum0("n_fruitless").alias("n_fruitless"), sum0("n_with_catch").alias("n_with_catch")
    )
    both = sums.withColumn("all_outings", F.col("n_fruitless") + F.col("n_with_catch"))
    return to_long(
        both, ["all_outings"], ["n_fruitless", "n_with_catch"], "status", "n"
    ).select("status", "n", share("n", "all_outings").alias("percent"))


def _effort(df: DataFrame, keys: list[str]) -> DataFrame:
    """Catch and weight per angler for each outing (and further keys).

    Mode, zone and start are parts of the outing key, so grouping by them too
    changes nothing; the number of anglers is the one on the first row.
    """
    return df.groupBy(*keys).agg(
        sum0(C.CATCHES).alias("n_caught"),
        sum0(C.LINE_WEIGHT).alias("weight_g"),
        first_by(C.ANGLERS, C.ROW_ID).alias("n_anglers"),
    ).withColumns({
        "cpue_n": divide("n_caught", "n_anglers"),
        "cpue_g": divide("weight_g", "n_anglers"),
    })


OUTING_FACTS = [C.ZONE, C.SESSION, C.MONTH]


def cpue_by_mode(df: DataFrame) -> DataFrame:
    """Catch per unit effort of every outing whose mode is known."""
    return _effort(determinable_mode(df), [C.OUTING, C.MODE, *OUTING_FACTS])


def cpue_top_species(df: DataFrame, n: int = TOP_CPUE) -> DataFrame:
    """Most caught (scientific, vernacular) names over all modes."""
    names = [C.SPECIES, C.VERNACULAR]
    totals = df.groupBy(*names).agg(sum0(C.CATCHES).alias("total"))
    return top_n(totals, "total", names, n)


def cpue_by_species(df: DataFrame, mode: str, top: DataFrame | None = None) -> DataFrame:
    """Catch per unit effort per outing and top species, for one mode.

    ``top`` is ``cpue_top_species`` of all modes, by default that of ``df``.
    Species are selected by scientific name; a vernacular name outside the top
    list becomes missing.
    """
    top = cpue_top_species(df) if top is None else top
    names = [C.SPECIES, C.VERNACULAR]
    chosen = present_in(of_mode(df, mode), top, [C.SPECIES])
    effort = _effort(chosen, [C.OUTING, *names, *OUTING_FACTS])
    return in_label_order(effort, ranked_labels(top, "total", names, C.VERNACULAR), C.VERNACULAR)


def cpue_summary(effort: DataFrame, measure: str) -> DataFrame:
    """Outings, mean and median of one CPUE measure per species, top order."""
    keys = [C.VERNACULAR, C.SPECIES, "species_rank"]
    value = nan_to_null(F.col(measure).cast("double"))
    means = effort.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_outings"), F.round(divide(F.sum(value), F.count(value)), 2).alias("mean")
    )
    medians = quantiles_of(merged_values(effort, keys, measure), keys, {"median": 0.5})
    return (
        match_missing(means, medians.withColumn("median", F.round("median", 2)), keys)
        .orderBy(F.col("species_rank").asc_nulls_last(), F.col(C.SPECIES).asc_nulls_last())
    )


def biomass_split(df: DataFrame) -> DataFrame:
    """Biomass in kg: all, kept and released, split by the declared counts."""

    def portion(count: str):
        weight = F.col(C.LINE_WEIGHT) * divide(count, C.CATCHES)
        return if_else3(F.col(C.CATCHES) > 0, weight, F.lit(0.0))

    return df.select(
        C.LINE_WEIGHT, portion(C.KEPT).alias("kept_g"), portion(C.RELEASED).alias("released_g")
    ).agg(
        _kg(C.LINE_WEIGHT).alias("total_kg"),
        _kg("kept_g").alias("kept_kg"),
        _kg("released_g").alias("released_kg"),
    )


def selector_values(df: DataFrame, columns: dict[str, str], without: Iterable[str] = ()) -> DataFrame:
    """(selector, value) of several selectors in one pass; missing values and those in ``without`` left out."""
    pairs = F.array(*(F.struct(F.lit(name).alias("selector"), F.col(c).cast("string").alias("value")) for name, c in columns.items()))
    values = df.select(F.explode(pairs).alias("p")).select("p.*").where(F.col("value").isNotNull())
    without = list(without)
    if without:
        values = values.where(~F.col("value").isin(without))
    return values.distinct().orderBy("selector", "value")


def choices(df: DataFrame, column: str, without: Iterable[str] = ()) -> DataFrame:
    """Sorted distinct values of a selector, missing left out."""
    values = df.where(F.col(column).isNotNull()).select(column).distinct()
    without = list(without)
    if without:
        values = values.where(~F.col(column).isin(without))
    return values.orderBy(column)


def extremes(df: DataFrame) -> DataFrame:
    """Last year, largest size, and smallest and largest line catch."""
    return df.agg(
        F.max(C.YEAR).alias("last_year"),
        F.max(C.SIZE).alias("largest_mm"),
        F.min(C.CATCHES).alias("least_catch"),
        F.max(C.CATCHES).alias("most_catch"),
    )
