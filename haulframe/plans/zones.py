"""Fishing pressure per sub-zone, joined to a zone table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulframe.functions.semantics import sum0
from haulframe.operators.filters import of_species
from haulframe.operators.joins import match_missing
from haulframe.sources import columns as C

# Zones that have a sub-zone table, in order of preference.
SITES = ((4, "calanques"), (7, "banyuls"))


def pressure(df: DataFrame, species: str | None = None) -> DataFrame:
    """Catch and declared lines per sub-zone, for one species or all.

    ``n_lines`` counts declaration rows, the measure in use; ``n_outings``
    counts outings.
    """
    if species is not None:
        df = of_species(df, species)
    return df.groupBy(C.SUBZONE).agg(
        sum0(C.CATCHES).alias("total_catch"), F.count(F.lit(1)).alias("n_lines")
    )


def outings_per_subzone(df: DataFrame) -> DataFrame:
    return df.groupBy(C.SUBZONE).agg(F.count_distinct(C.OUTING).alias("n_outings"))


def on_zones(zones: DataFrame, totals: DataFrame) -> DataFrame:
    """Every zone of the table with its totals; zones without catch get 0, and
    totals of sub-zones outside the table are left out."""
    return match_missing(zones, totals, [C.SUBZONE]).withColumn(
        "total_catch", F.coalesce("total_catch", F.lit(0.0))
    )


def active_site(df: DataFrame, sites: Sequence[tuple[int, str]] = SITES) -> DataFrame:
    """One row: the first site whose zone occurs in the data, or NULL."""
    found = df.agg(*(F.max(F.col(C.ZONE_ID) == zone).alias(site) for zone, site in sites))
    chain = F
    for _, site in sites:
        chain = chain.when(F.col(site), F.lit(site))
    return found.select(chain.alias("site"))


def zones_of_active_site(
    zones: DataFrame, df: DataFrame, sites: Sequence[tuple[int, str]] = SITES
) -> DataFrame:
    """The zone table of the active site; empty when no site is available."""
    return zones.where(F.col("site") == active_site(df, sites).scalar())
