"""Registered queries: every operator over whole tables.

Each callable takes (spark, sf_dir) and returns a DataFrame whose columns match
the SQL of the same name in ``oracle``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulframe.catalog import tables as T
from haulframe.functions import calendar
from haulframe.functions import semantics as S
from haulframe.functions import text
from haulframe.operators import dedupe, filters, joins, order_stats, outings, reshape, top
from haulframe.plans import cleaning, indicators, loads, rule_tables, selections, sizes, weights, zones
from haulframe.plans.rules import BOAT
from haulframe.sources import columns as C
from haulframe.sources import dimensions, exports
from haulframe.sources.shared import new_path, shuffles_removed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

SPEAR = T.MODES.pattern_mode
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def pick(df: DataFrame, **columns) -> DataFrame:
    return df.select(*(S.as_col(c).alias(name) for name, c in columns.items()))


# --- sources ---------------------------------------------------------------


@query
def export_parse(spark, sf):
    """Declarations written as export text and parsed back by header name."""
    d = T.with_angler(T.catches(spark, sf), spark, sf)
    fields = {
        "Id_Prise": F.concat(F.lit("#"), "l_orderkey"),
        "Heure debut session": F.date_format(C.SESSION, "yyyy-MM-dd HH:mm:ss"),
        "Taille (mm)": F.coalesce(F.col(C.SIZE).cast("string"), F.lit("NA")),
        "NomVernaculaire": F.concat(F.lit('"'), C.VERNACULAR, F.lit('"')),
        "Nb de prises": F.concat(F.lit("  "), F.col(C.CATCHES).cast("string"), F.lit(" ")),
        "Nom Fédération": F.coalesce(C.FEDERATION, F.lit("")),
        "ID_ZoneDePeche": F.coalesce(F.col(C.ZONE_ID).cast("string"), F.lit("")),
    }
    text_lines = d.select(F.col(C.ROW_ID), F.concat_ws(";", *fields.values()).alias("value"))
    parsed = C.normalise_names(exports.parse_rows(text_lines, list(fields)))
    return pick(
        parsed, row_id=T.row_number(), catch_id=text.digits_id(C.CATCH_ID), session_start=C.SESSION,
        size_mm=C.SIZE, vernacular=C.VERNACULAR, n_catch=C.CATCHES, federation=C.FEDERATION,
        zone=C.ZONE_ID,
    )


@query
def export_scan(spark, sf):
    """Every declaration as an export of its own: two banner lines, a header and two rows."""
    fields = {
        "Id_Prise": F.concat(F.lit("#"), "l_orderkey"),
        "Heure debut session": F.date_format(C.SESSION, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        "Durée de la session": F.coalesce(F.nullif(F.round(C.DURATION), F.lit(0.0)).cast("string"), F.lit("NA")),
        "Nb de prises": F.col(C.CATCHES).cast("string"),
        "ID_ZoneDePeche": F.coalesce(F.col(C.ZONE_ID).cast("string"), F.lit("")),
    }
    second = {**fields, "Nb de prises": (F.col(C.CATCHES) + 1).cast("string")}
    header = ";".join(fields)
    opening = [F.lit("Export; of the day"), F.lit("two;lines;of text"), F.lit(header)]
    rows = [F.concat_ws(";", *f.values()) for f in (fields, second)]
    files = T.lines(spark, sf).select(F.col(C.ROW_ID).cast("string").alias("file"), F.explode(F.array(*opening, *rows)).alias("value"))
    metadata = F.struct(F.col("file").alias("file_path"), F.lit(0).cast("bigint").alias("file_block_start"))
    parsed = C.normalise_names(exports.parse_lines(files.select("value", metadata.alias("_metadata")), file_column=C.FILE))
    place = F.row_number().over(Window.partitionBy(C.FILE).orderBy(C.ROW_ID)) - 1
    return pick(
        parsed, catch_id=text.digits_id(C.CATCH_ID), session_start=C.SESSION, duration=C.DURATION, n_catch=C.CATCHES,
        place=place, zone=C.ZONE_ID,
    )


def _exported(bodies: DataFrame, headers: DataFrame):
    """Export files, one per ``file``, written to the shared folder: banner, header, rows in order of ``place``. Their path."""
    opening = headers.select("file", F.posexplode(F.array(F.lit('Export; of "the day'), F.lit("two;lines;of text"), F.col("header"))).alias("place", "value"))
    opening = opening.select("file", F.lit(0).alias("part"), F.col("place").cast("bigint").alias("place"), "value")
    lines = bodies.select("file", F.lit(1).alias("part"), "place", "value").unionByName(opening)
    path = new_path(bodies.sparkSession, "exports")
    written = lines.repartition("file").sortWithinPartitions("file", "part", "place").select("file", "value").write.partitionBy("file")
    with shuffles_removed(bodies.sparkSession):
        written.text(path)
    return path


@query
def export_multiline(spark, sf):
    """Declarations with notes of several lines, written as one export per supplier and read back."""
    several = F.concat(
        F.lit('"order; '), "l_orderkey", F.lit("\n line;"), "l_linenumber", F.lit("\n\n"), F.repeat(F.lit("part\n"), (F.col("l_partkey") % 4).cast("int")), F.lit('end"')
    )
    one = F.when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit('"order; '), "l_orderkey", F.lit('"'))).otherwise(F.concat(F.lit('5" hook '), "l_orderkey"))
    fields = {
        "Id_Prise": F.concat(F.lit("#"), "l_orderkey"),
        "note": F.when(F.col("l_linenumber") % 3 == 0, several).otherwise(one),
        "Nb de prises": F.col(C.CATCHES).cast("string"),
        "ID_ZoneDePeche": F.coalesce(F.col(C.ZONE_ID).cast("string"), F.lit("")),
        "Technique": F.concat(F.lit('"'), "l_partkey", F.lit("\n"), "l_suppkey", F.lit('"')),
    }
    d = T.lines(spark, sf).withColumn("file", F.concat(F.lit("s"), "l_suppkey"))
    bodies = d.select("file", F.col(C.ROW_ID).alias("place"), F.concat_ws(";", *fields.values()).alias("value"))
    headers = d.select("file").distinct().withColumn("header", F.lit(";".join(fields)))
    found = C.normalise_names(exports.read_export(spark, _exported(bodies, headers)))
    return pick(found, catch_id=text.digits_id(C.CATCH_ID), note="note", n_catch=C.CATCHES, zone=C.ZONE_ID, technique=C.TECHNIQUE)


@query
def export_headers(spark, sf):
    """One export per supplier: three orders of columns, one of which lacks a column and has one of its own."""
    d = T.lines(spark, sf).withColumn("file", F.concat(F.lit("s"), "l_suppkey"))
    fields = {
        "Id_Prise": F.concat(F.lit("#"), "l_orderkey"), "Nb de prises": F.col(C.CATCHES).cast("string"),
        "ID_ZoneDePeche": F.coalesce(F.col(C.ZONE_ID).cast("string"), F.lit("NA")), "added": F.concat(F.lit(" p"), "l_partkey"),
        "Durée de la session": F.round(C.DURATION).cast("string"),
    }
    orders = [
        ["Id_Prise", "Nb de prises", "ID_ZoneDePeche", "Durée de la session"],
        ["Durée de la session", "ID_ZoneDePeche", "Nb de prises", "Id_Prise"],
        ["Nb de prises", "added", "Id_Prise", "Durée de la session"],
    ]
    chosen = F.col("l_suppkey") % 3
    by_order = lambda build: F.when(chosen == 0, build(orders[0])).when(chosen == 1, build(orders[1])).otherwise(build(orders[2]))
    bodies = d.select("file", F.col(C.ROW_ID).alias("place"), by_order(lambda o: F.concat_ws(";", *(fields[n] for n in o))).alias("value"))
    headers = d.select("file", by_order(lambda o: F.lit(";".join(o))).alias("header")).distinct()
    found = C.normalise_names(exports.read_export(spark, _exported(bodies, headers)))
    return pick(found, catch_id=text.digits_id(C.CATCH_ID), n_catch=C.CATCHES, zone=C.ZONE_ID, added="added", duration=C.DURATION)


def _written(df: DataFrame, schema: str) -> DataFrame:
    """A table as the text lines of its file."""
    names = [f.split()[0] for f in schema.split(", ")]
    columns = [F.coalesce(F.col(n).cast("string"), F.lit("NA")) if n in df.columns else F.lit("NA") for n in names]
    return df.select(F.concat_ws(" , ", *columns).alias("value"))


@query
def coefficient_scan(spark, sf):
    lines = _written(T.coefficients(spark, sf), dimensions.COEFFICIENT_SCHEMA)
    d = dimensions.parse_table(lines, dimensions.COEFFICIENT_SCHEMA)
    return pick(d, species=C.SPECIES, a="a_FB", b="b_FB", origin="origine_FB", robust="ratio_robuste")


@query
def size_limit_scan(spark, sf):
    lines = _written(T.size_limits(spark, sf), dimensions.SIZE_LIMIT_SCHEMA)
    d = dimensions.parse_table(lines, dimensions.SIZE_LIMIT_SCHEMA)
    return pick(d, species=C.SPECIES, size_max_mm=C.SIZE_MAX, weight_max_g=C.WEIGHT_MAX)


@query
def zone_scan(spark, sf):
    raw = T.table(spark, sf, "supplier").withColumn("label", F.concat(F.lit(" "), "s_name", F.lit(" - part 1")))
    d = dimensions.zones_of(raw, "banyuls", "label", strip_suffix=True)
    return pick(d, site="site", subzone=C.SUBZONE, nation="s_nationkey")


@query
def required_columns(spark, sf):
    d = C.require_rows(C.require_columns(T.lines(spark, sf), (C.SESSION, C.CATCHES)))
    return d.agg(F.count(F.lit(1)).alias("n"))


@query
def zone_key(spark, sf):
    d = T.table(spark, sf, "supplier").withColumn(
        "label", F.concat(F.lit(" "), "s_name", F.lit(" - part "), F.col("s_nationkey").cast("string"))
    )
    return pick(d, s_suppkey="s_suppkey", zone=text.zone_key("label"))


# --- scalar functions ------------------------------------------------------


@query
def calendar_parts(spark, sf):
    d = cleaning.with_calendar(T.table(spark, sf, "orders").withColumn(C.SESSION, F.col("o_orderdate")))
    return pick(
        d, o_orderkey="o_orderkey", weekday=C.WEEKDAY, month=C.MONTH, month_number=C.MONTH_NUMBER, year=C.YEAR
    )


@query
def null_if_zero(spark, sf):
    d = T.lines(spark, sf).withColumn(C.DURATION, F.round(C.DURATION))
    return d.select(*LINE_KEY, cleaning.value_fixes()[C.DURATION].alias("duration"))


@query
def null_defaults(spark, sf):
    d = cleaning.recode_zone(T.lines(spark, sf), T.RULES)
    return d.select(*LINE_KEY, cleaning.value_fixes()[C.NO_KILL].alias("no_kill"), F.col(C.ZONE).alias("zone_name"))


@query
def digits_id(spark, sf):
    return pick(T.table(spark, sf, "customer"), c_custkey="c_custkey", id=text.digits_id("c_name"))


@query
def absolute_weight(spark, sf):
    d = T.catches(spark, sf)
    return d.select(*LINE_KEY, F.round(cleaning.value_fixes()[C.WEIGHT], 4).alias("weight_g"))


@query
def sentinel_recode(spark, sf):
    d = cleaning.recode_zone(T.lines(spark, sf), T.RULES)
    return d.select(
        *LINE_KEY, F.col(C.ZONE_ID).alias("zone"), F.col(C.ZONE).alias("zone_name"), F.col(C.NOTE).alias("note")
    )


@query
def keyed_patch(spark, sf):
    d = cleaning.recode_zone(T.lines(spark, sf), T.RULES).withColumn(
        C.CATCH_ID, F.when(F.col("l_suppkey") % 7 != 0, F.col("l_orderkey"))
    )
    d = cleaning.correct(d, T.RULES.corrections)
    return d.select(*LINE_KEY, F.col(C.CATCHES).alias("n_catch"), F.col(C.NOTE).alias("note"))


def _corrections(spark, sf):
    """Corrections of a third of all orders, some of which contradict each other."""
    orders = T.table(spark, sf, "orders").where(F.col("o_orderkey") % 3 == 0)
    given = F.expr(f"""array(
        named_struct('column', '{C.CATCHES}', 'value', CAST(o_orderkey % 11 AS DOUBLE), 'note', concat('photo ', o_orderkey), 'at', 0),
        named_struct('column', '{C.ANGLERS}', 'value', CAST(NULL AS DOUBLE), 'note', 'crew unknown', 'at', 1),
        named_struct('column', '{C.CATCHES}', 'value', CAST(o_orderkey % 7 AS DOUBLE), 'note', 'second photo', 'at', 2))""")
    rows = orders.select("o_orderkey", F.explode(F.slice(given, F.lit(1), (F.col("o_orderkey") % 2 * 2 + 1).cast("int"))).alias("c"))
    return rows.select(
        (F.col("o_orderkey") * 4 + F.col("c.at")).alias("position"), F.col("o_orderkey").alias(C.CATCH_ID), "c.column", "c.value", "c.note"
    )


@query
def keyed_patch_table(spark, sf):
    d = cleaning.recode_zone(T.lines(spark, sf), T.RULES).withColumn(
        C.CATCH_ID, F.when(F.col("l_suppkey") % 7 != 0, F.col("l_orderkey"))
    )
    d = rule_tables.correct(d, _corrections(spark, sf))
    return d.select(*LINE_KEY, F.col(C.CATCHES).alias("n_catch"), F.col(C.ANGLERS).alias("n_anglers"), F.col(C.NOTE).alias("note"))


@query
def mode_cascade_table(spark, sf):
    d = T.with_angler(T.lines(spark, sf), spark, sf)
    t = rule_tables.tables_of(spark, T.RULES)
    d = rule_tables.with_mode(d, t.subzones, t.techniques, T.MODES.pattern, T.MODES.pattern_mode)
    return d.select(*LINE_KEY, F.col(C.MODE).alias("mode"))


@query
def audit_append(spark, sf):
    d = cleaning.recode_zone(T.lines(spark, sf), T.RULES)
    many = F.col("l_quantity") > F.when(F.col("l_suppkey") % 7 != 0, 40)
    return d.select(*LINE_KEY, text.add_note(C.NOTE, "many", many).alias("note"))


@query
def membership_label(spark, sf):
    d = T.lines(spark, sf)
    return d.select(*LINE_KEY, text.present_label(C.FEDERATION).alias("member"))


@query
def regex_class(spark, sf):
    d = T.table(spark, sf, "part")
    return pick(d, p_partkey="p_partkey", hit=text.matches("p_name", "RED[- ]?(bolt|widget)|Plate|coulée"))


@query
def mode_cascade(spark, sf):
    d = T.with_angler(T.lines(spark, sf), spark, sf)
    return d.select(*LINE_KEY, cleaning.fishing_mode(T.MODES).alias("mode"))


@query
def unit_change(spark, sf):
    d = T.catches(spark, sf)
    return d.select(
        *LINE_KEY, indicators.kilograms(F.col(C.WEIGHT)).alias("weight_kg"), indicators.centimetres(C.SIZE).alias("size_cm")
    )


# --- filters ---------------------------------------------------------------


@query
def min_date_filter(spark, sf):
    d = filters.since(T.table(spark, sf, "orders"), "1998-01-01", "o_orderdate")
    return d.select("o_orderkey", "o_orderdate")


@query
def year_filter(spark, sf):
    d = filters.in_year(T.lines(spark, sf), 1997, "l_shipdate")
    return d.select(*LINE_KEY, "l_shipdate")


@query
def month_filter(spark, sf):
    d = T.lines(spark, sf).withColumn(C.MONTH, calendar.month_label(C.SESSION))
    return filters.in_months(d, ["février", "août"]).select(*LINE_KEY, F.col(C.MONTH).alias("month"))


@query
def mode_filter(spark, sf):
    d = filters.determinable_mode(T.outing_lines(spark, sf))
    return d.select(*LINE_KEY, F.col(C.MODE).alias("mode"))


@query
def species_filter(spark, sf):
    d = filters.sized(filters.of_species(T.catches(spark, sf), "Brand#7", C.SPECIES))
    return d.select(*LINE_KEY, F.col(C.SIZE).alias("size_mm"))


@query
def plausibility_filter(spark, sf):
    d = joins.with_dimension(
        T.catches(spark, sf), T.size_limits(spark, sf), [C.SPECIES], [C.SIZE_MAX, C.WEIGHT_MAX]
    )
    return filters.plausible_singles(d).select(
        *LINE_KEY, F.col(C.SIZE).alias("size_mm"), F.round(C.WEIGHT, 4).alias("weight_g")
    )


@query
def active_species(spark, sf):
    """Species with a relation that occur in the declarations; half of those with a relation never do."""
    known = T.coefficients(spark, sf)
    never = known.withColumn(C.SPECIES, F.concat(C.SPECIES, F.lit(" (never)")))
    ref = sizes.length_weight_reference(known.unionByName(never), T.catches(spark, sf))
    return pick(ref, species=C.SPECIES, a="a", b="b", origin="origin")


# --- joins -----------------------------------------------------------------


@query
def dim_left_join(spark, sf):
    """Every fifth species has two size limits, so its declarations double."""
    limits = T.size_limits(spark, sf).withColumn(
        C.SIZE_MAX, F.explode(F.array(F.col(C.SIZE_MAX), F.when(F.col(C.SPECIES).endswith("5"), 450.0).otherwise(F.col(C.SIZE_MAX))))
    )
    d = joins.with_dimension(T.catches(spark, sf), limits, [C.SPECIES], [C.SIZE_MAX])
    return pick(
        d.groupBy(C.SPECIES, C.SIZE_MAX).agg(F.count(F.lit(1)).alias("n"), S.sum0(C.CATCHES).alias("total")),
        species=C.SPECIES, size_max_mm=C.SIZE_MAX, n="n", total="total",
    )


@query
def null_key_join(spark, sf):
    """Zones joined on an id that may be missing: missing matches missing."""
    d = T.lines(spark, sf)
    names = d.groupBy(C.ZONE_ID).agg(F.max(C.ZONE).alias("label"), F.count(F.lit(1)).alias("lines_in_zone"))
    joined = joins.match_missing(d, names, [C.ZONE_ID])
    return joined.select(*LINE_KEY, F.col(C.ZONE_ID).alias("zone"), "label", "lines_in_zone")


@query
def coefficient_join(spark, sf):
    d = weights.with_coefficients(T.catches(spark, sf), T.coefficients(spark, sf))
    g = d.groupBy(C.SPECIES).agg(
        F.count("a_FB").alias("n_fb"), F.count("a_SIH").alias("n_sih"), F.count("a_obs").alias("n_obs")
    )
    return g.withColumnRenamed(C.SPECIES, "species")


@query
def top5(spark, sf):
    d = weights.with_weight(T.catches(spark, sf))
    return pick(indicators.top_species(d), species=C.SPECIES, total="total", biomass_kg="biomass_kg")


@query
def top5_in_months(spark, sf):
    d = weights.with_weight(T.catches(spark, sf)).withColumn(C.MONTH, calendar.month_label(C.SESSION))
    chosen = indicators.top_species(d, ["janvier", "juillet"])
    return pick(chosen, species=C.SPECIES, total="total", biomass_kg="biomass_kg")


@query
def top_n_join_labels(spark, sf):
    d = weights.with_weight(T.catches(spark, sf))
    return pick(
        indicators.top_species_labelled(d), species=C.SPECIES, total="total", biomass_kg="biomass_kg",
        code=C.FAO_CODE, vernacular=C.VERNACULAR,
    )


@query
def semi_join_top10(spark, sf):
    d = T.catches(spark, sf)
    chosen = joins.present_in(d, indicators.cpue_top_species(d), [C.SPECIES])
    g = chosen.groupBy(C.SPECIES).agg(F.count(F.lit(1)).alias("n"), S.sum0(C.CATCHES).alias("total"))
    return g.withColumnRenamed(C.SPECIES, "species")


@query
def zone_left_join(spark, sf):
    joined = zones.on_zones(T.zones(spark, sf), zones.pressure(T.lines(spark, sf)))
    return pick(joined, site="site", subzone=C.SUBZONE, total_catch="total_catch", n_lines="n_lines")


@query
def site_switch(spark, sf):
    """Zones of the preferred site among those that occur."""
    d = T.lines(spark, sf)
    active = zones.zones_of_active_site(T.zones(spark, sf), d)
    joined = zones.on_zones(active, zones.pressure(d))
    return pick(joined, site="site", subzone=C.SUBZONE, total_catch="total_catch", n_lines="n_lines")


# --- indicators ------------------------------------------------------------


@query
def kpi_summary(spark, sf):
    return indicators.key_figures(T.outing_lines(spark, sf))


@query
def species_list(spark, sf):
    d = weights.with_weight(T.catches(spark, sf))
    return indicators.species_list(d).withColumnRenamed(C.VERNACULAR, "vernacular")


@query
def species_list_corrected(spark, sf):
    d = joins.with_dimension(T.catches(spark, sf), T.size_limits(spark, sf), [C.SPECIES], [C.SIZE_MAX])
    d = d.withColumn(C.WEIGHT, F.abs(C.WEIGHT))
    corrected = weights.with_weight(d, T.coefficients(spark, sf), corrected=True)
    return indicators.species_list(corrected).withColumnRenamed(C.VERNACULAR, "vernacular")


@query
def species_order(spark, sf):
    d = indicators.species_list(weights.with_weight(T.catches(spark, sf)))
    d = top.with_position(d, indicators.species_order())
    return pick(d, vernacular=C.VERNACULAR, n_caught="n_caught", position="position")


@query
def month_order(spark, sf):
    m = indicators.monthly_catch(cleaning.with_calendar(T.lines(spark, sf)))
    m = top.with_position(m, indicators.month_order())
    return pick(m, year=C.YEAR, month_number=C.MONTH_NUMBER, position="position")


@query
def monthly_evolution(spark, sf):
    m = indicators.monthly_catch(cleaning.with_calendar(T.lines(spark, sf)))
    return pick(m, year=C.YEAR, month_number=C.MONTH_NUMBER, month=C.MONTH, n_caught="n_caught")


@query
def total_catch(spark, sf):
    return indicators.total_catch(T.lines(spark, sf))


@query
def latest_period(spark, sf):
    m = indicators.latest_month(indicators.monthly_catch(cleaning.with_calendar(T.lines(spark, sf))))
    return pick(m, year=C.YEAR, month_number=C.MONTH_NUMBER, month=C.MONTH, n_caught="n_caught")


@query
def monthly_rollup(spark, sf):
    d = cleaning.with_calendar(T.lines(spark, sf))
    m = indicators.monthly_with_totals(d)
    return pick(m, level=F.col("level").cast("int"), year=C.YEAR, month_number=C.MONTH_NUMBER, month=C.MONTH, n_caught="n_caught")


def _cells(spark, sf):
    d = T.outing_lines(spark, sf)
    return selections.selectable(d.withColumns({C.YEAR: F.year(C.SESSION), C.MONTH_NUMBER: F.month(C.SESSION)}))


@query
def selection_figures(spark, sf):
    """Key figures of four selections from one table of bitmaps."""
    cells = _cells(spark, sf)
    chosen = {
        "all": None, "1997": F.col(C.YEAR) == 1997, "summer": F.col(C.MONTH_NUMBER).isin(6, 7, 8),
        "boats of zone 7 before 1996": (F.col(C.YEAR) < 1996) & (F.col(C.ZONE) == "Zone 7") & (F.col(C.MODE) == BOAT),
    }
    parts = [selections.figures(cells, c).withColumn("selection", F.lit(name)) for name, c in chosen.items()]
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


@query
def selection_by_zone(spark, sf):
    """Outings and fruitless ones per zone in two years, from the table of bitmaps."""
    found = selections.figures_by(_cells(spark, sf), C.ZONE, F.col(C.YEAR).isin(1995, 1996))
    return found.withColumnRenamed(C.ZONE, "zone_name")


@query
def fruitless_outings(spark, sf):
    return indicators.fruitless_outings(T.outing_lines(spark, sf)).withColumnRenamed(C.ZONE, "zone_name")


@query
def fruitless_share(spark, sf):
    return indicators.fruitless_share(T.outing_lines(spark, sf)).withColumn("percent", F.round("percent", 6))


def _effort_columns(df: DataFrame, **more) -> DataFrame:
    return pick(
        df, outing=C.OUTING, **more, zone_name=C.ZONE, session_start=C.SESSION, month=C.MONTH,
        n_caught="n_caught", weight_g=F.round("weight_g", 3), n_anglers="n_anglers",
        cpue_n=F.round("cpue_n", 5), cpue_g=F.round("cpue_g", 3),
    )


@query
def cpue_by_mode(spark, sf):
    d = weights.with_weight(T.declarations(spark, sf))
    return _effort_columns(indicators.cpue_by_mode(d), mode=C.MODE)


@query
def cpue_by_species(spark, sf):
    d = weights.with_weight(T.declarations(spark, sf))
    effort = indicators.cpue_by_species(d, BOAT, indicators.cpue_top_species(T.catches(spark, sf)))
    return _effort_columns(effort, species=C.SPECIES, vernacular=C.VERNACULAR, species_rank="species_rank")


def _cpue_summary(spark, sf, measure, mode):
    d = weights.with_weight(T.declarations(spark, sf))
    top10 = indicators.cpue_top_species(T.catches(spark, sf))
    s = indicators.cpue_summary(indicators.cpue_by_species(d, mode, top10), measure)
    return pick(
        s, vernacular=C.VERNACULAR, species=C.SPECIES, species_rank="species_rank",
        n_outings="n_outings", mean="mean", median="median",
    )


@query
def cpue_summary(spark, sf):
    return _cpue_summary(spark, sf, "cpue_n", BOAT)


@query
def cpue_summary_weight(spark, sf):
    return _cpue_summary(spark, sf, "cpue_g", SPEAR)


@query
def biomass_split(spark, sf):
    d = T.catches(spark, sf).withColumns({
        C.KEPT: F.col(C.CATCHES) * 0.25, C.RELEASED: F.col(C.CATCHES) * 0.75,
    })
    return indicators.biomass_split(weights.with_weight(d))


@query
def zone_pressure(spark, sf):
    return zones.pressure(T.lines(spark, sf)).withColumnRenamed(C.SUBZONE, "subzone")


@query
def zone_pressure_species(spark, sf):
    p = zones.pressure(T.catches(spark, sf), "Brand#12 PROMO")
    return p.withColumnRenamed(C.SUBZONE, "subzone")


@query
def zone_outings(spark, sf):
    return zones.outings_per_subzone(T.outing_lines(spark, sf)).withColumnRenamed(C.SUBZONE, "subzone")


@query
def distinct_lists(spark, sf):
    """The three selectors, as one list with their names."""
    d = T.declarations(spark, sf).withColumn(C.YEAR, F.year("l_shipdate"))
    return indicators.selector_values(d, {"year": C.YEAR, "mode": C.MODE, "vernacular": C.VERNACULAR}, ["Indeterminable"])


@query
def extremes(spark, sf):
    return indicators.extremes(T.catches(spark, sf).withColumn(C.YEAR, F.year(C.SESSION)))


# --- order statistics ------------------------------------------------------


@query
def exact_quantile(spark, sf):
    s = sizes.size_bound(T.catches(spark, sf))
    return pick(s, vernacular=C.VERNACULAR, upper_size=F.round("upper_size", 4), size_limit="size_limit")


@query
def tukey_axis_bound(spark, sf):
    d = filters.determinable_mode(T.outing_lines(spark, sf)).withColumn("cpue", S.divide(C.CATCHES, C.ANGLERS))
    return order_stats.axis_bound(d, [C.MODE], "cpue").withColumn("axis_max", F.round("axis_max", 5))


def _box_columns(df: DataFrame, **groups) -> DataFrame:
    numbers = ["lower_hinge", "middle", "upper_hinge", "lower_whisker", "upper_whisker"]
    return pick(df, **groups, **{c: F.round(c, 5) for c in numbers}, n="n", n_outliers="n_outliers")


@query
def boxplot_summary(spark, sf):
    d = filters.determinable_mode(T.outing_lines(spark, sf))
    d = d.withColumn("effort", F.sqrt("l_extendedprice"))
    return _box_columns(order_stats.boxplot(d, [C.MODE], "effort"), mode=C.MODE)


@query
def boxplot_species(spark, sf):
    """Sizes of single fish: the declared count is the weight."""
    box = order_stats.boxplot(T.catches(spark, sf), [C.SPECIES], C.SIZE, "tukey", C.CATCHES)
    return _box_columns(box, species=C.SPECIES)


@query
def size_histogram(spark, sf):
    h = sizes.size_histogram(T.catches(spark, sf))
    return h.withColumnRenamed(C.VERNACULAR, "vernacular")


@query
def min_size_flag(spark, sf):
    classes = sizes.size_histogram(T.catches(spark, sf))
    h = sizes.with_legal_size(classes, T.legal_sizes(spark, sf))
    return h.withColumnsRenamed({C.VERNACULAR: "vernacular", C.LEGAL_SIZE: "legal_mm"})


# --- deduplication, outings, reshaping -------------------------------------


@query
def dedupe_keep_first(spark, sf):
    """Line items repeat (order, line); the first by all other columns stays."""
    d = T.table(spark, sf, "lineitem")
    others = [c for c in d.columns if c not in ("l_orderkey", "l_linenumber")]
    return dedupe.keep_first(d, ["l_orderkey", "l_linenumber"], others)


@query
def dedupe_key_in_order(spark, sf):
    """A key that is also an order column stays a key."""
    d = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return dedupe.keep_first(d, ["l_orderkey", "l_linenumber"], ["l_linenumber", "l_partkey"])


@query
def outing_id(spark, sf):
    d = outings.with_outing_labels(T.outing_lines(spark, sf))
    return d.select(*LINE_KEY, F.col(C.OUTING).alias("outing"), "outing_label")


@query
def outing_number(spark, sf):
    d = outings.with_numbers_by_key(T.outing_lines(spark, sf))
    return d.select(*LINE_KEY, "outing_key", "outing_number", "outing_label")


@query
def uncount(spark, sf):
    """One row per fish, counted back per species and size."""
    fish = filters.sized(reshape.uncount(T.catches(spark, sf), C.CATCHES))
    g = fish.groupBy(C.SPECIES, C.SIZE).agg(F.count(F.lit(1)).alias("n_fish"))
    return g.withColumnsRenamed({C.SPECIES: "species", C.SIZE: "size_mm"})


@query
def unpivot(spark, sf):
    d = T.lines(spark, sf).groupBy(C.ZONE_ID).agg(
        S.sum0(C.KEPT).alias("kept"), S.sum0(C.RELEASED).alias("released")
    )
    return reshape.to_long(d, [C.ZONE_ID], ["kept", "released"], "fate", "n").withColumnRenamed(C.ZONE_ID, "zone")


# --- cleaning --------------------------------------------------------------


def _for_caps(spark, sf):
    d = T.with_angler(T.catches(spark, sf), spark, sf)
    return d.withColumns({
        C.VERNACULAR: F.col(C.SPECIES), C.MODE: cleaning.fishing_mode(T.MODES), "flag": F.lit(False),
    })


@query
def count_caps(spark, sf):
    d = cleaning.cap_catches(_for_caps(spark, sf), T.COUNTS, "flag")
    return d.select(*LINE_KEY, F.col(C.CATCHES).alias("n_catch"), "flag")


@query
def kept_released_caps(spark, sf):
    d = cleaning.cap_kept_released(_for_caps(spark, sf), T.COUNTS, "flag")
    return d.select(*LINE_KEY, F.col(C.KEPT).alias("kept"), F.col(C.RELEASED).alias("released"), "flag")


@query
def angler_caps(spark, sf):
    d = cleaning.cap_anglers(_for_caps(spark, sf), T.ANGLER_LIMITS, "flag")
    return d.select(*LINE_KEY, F.col(C.ANGLERS).alias("n_anglers"), "flag")


@query
def count_caps_table(spark, sf):
    t = rule_tables.tables_of(spark, T.RULES)
    d = rule_tables.cap_catches(_for_caps(spark, sf), t.counts, t.exempt, "flag")
    return d.select(*LINE_KEY, F.col(C.CATCHES).alias("n_catch"), "flag")


@query
def angler_caps_table(spark, sf):
    d = rule_tables.cap_crews(_for_caps(spark, sf), rule_tables.tables_of(spark, T.RULES).crews, "flag")
    d = cleaning.cap_crowds(d, T.ANGLER_LIMITS, "flag")
    return d.select(*LINE_KEY, F.col(C.ANGLERS).alias("n_anglers"), "flag")


@query
def clean_pipeline_tables(spark, sf):
    tables = rule_tables.tables_of(spark, T.RULES)
    return _cleaned(cleaning.clean_declarations(T.raw_declarations(spark, sf), T.size_limits(spark, sf), T.RULES, tables))


@query
def incremental_load(spark, sf):
    """Two exports added to a store one after the other; the second repeats much of the first."""
    raw, limits = T.raw_declarations(spark, sf), T.size_limits(spark, sf)
    store = loads.Store(new_path(spark, "declarations"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    second = (F.col("Horodate") == "1") | (F.col("ID_SousZoneDePeche") == 15)
    loads.add_load(spark, store, raw.where(~second), 1, limits, T.RULES)
    loads.add_load(spark, store, raw.where(second), 2, limits, T.RULES)
    return _cleaned(loads.read_store(spark, store))


@query
def clean_pipeline(spark, sf):
    return _cleaned(cleaning.clean_declarations(T.raw_declarations(spark, sf), T.size_limits(spark, sf), T.RULES))


def _cleaned(d):
    return pick(
        d, row_id=T.row_number(), session_start=C.SESSION, weekday=C.WEEKDAY, month=C.MONTH, year=C.YEAR,
        size_mm=C.SIZE, weight_g=F.round(C.WEIGHT, 4), duration=C.DURATION, no_kill=C.NO_KILL,
        catch_id=C.CATCH_ID, sent=C.STAMP, zone=C.ZONE_ID, zone_name=C.ZONE, technique=C.TECHNIQUE,
        species=C.SPECIES, n_catch=C.CATCHES, kept=C.KEPT, released=C.RELEASED, n_anglers=C.ANGLERS,
        angler=C.ANGLER, note=C.NOTE, size_max_mm=C.SIZE_MAX, weight_max_g=C.WEIGHT_MAX, mode=C.MODE,
        member=C.MEMBER, outing=C.OUTING,
    )


# --- weight correction -----------------------------------------------------


def _corrected(spark, sf):
    d = joins.with_dimension(
        T.catches(spark, sf), T.size_limits(spark, sf), [C.SPECIES], [C.SIZE_MAX, C.WEIGHT_MAX]
    )
    d = d.withColumn(C.WEIGHT, F.abs(C.WEIGHT))
    return weights.correct_weights(d, T.coefficients(spark, sf))


@query
def theoretical_weights(spark, sf):
    return _corrected(spark, sf).select(
        *LINE_KEY, F.round(weights.W_SIH, 4).alias("w_sih"), F.round(weights.W_FB, 4).alias("w_fb"),
        F.round(weights.W_OBS, 4).alias("w_obs"),
    )


@query
def rowwise_counts(spark, sf):
    return _corrected(spark, sf).select(
        *LINE_KEY, F.col(weights.N_RELATIONS).alias("n_relations"), F.col(weights.N_REGIONAL).alias("n_regional"),
        F.col(weights.ONE_RELATION).alias("one_relation"), F.col(weights.OBS_VALID).alias("obs_valid"),
    )


@query
def reference_choice(spark, sf):
    return _corrected(spark, sf).select(*LINE_KEY, F.round(weights.REFERENCE, 4).alias("reference_g"))


@query
def ratio_hypotheses(spark, sf):
    names = {
        weights.R_TOTAL: "r_total", weights.R_MEAN: "r_mean",
        weights.R_TOTAL_KG: "r_total_kg", weights.R_MEAN_KG: "r_mean_kg",
    }
    return _corrected(spark, sf).select(*LINE_KEY, *(F.round(c, 6).alias(n) for c, n in names.items()))


@query
def weight_diagnosis(spark, sf):
    return _corrected(spark, sf).select(*LINE_KEY, F.col(weights.DIAGNOSIS).alias("diagnosis"))


@query
def final_weight(spark, sf):
    return _corrected(spark, sf).select(*LINE_KEY, F.round(C.FINAL_WEIGHT, 4).alias("final_g"))


@query
def line_total(spark, sf):
    return _corrected(spark, sf).select(
        *LINE_KEY, F.round(C.FINAL_WEIGHT, 4).alias("final_g"), F.round(C.LINE_WEIGHT, 3).alias("line_g")
    )


@query
def diagnosis_counts(spark, sf):
    g = _corrected(spark, sf).groupBy(weights.DIAGNOSIS).agg(
        F.count(F.lit(1)).alias("n"), F.round(S.sum0(C.LINE_WEIGHT) / 1000, 2).alias("biomass_kg")
    )
    return g.withColumnRenamed(weights.DIAGNOSIS, "diagnosis")


# --- length-weight relation ------------------------------------------------


def _points(spark, sf):
    d = joins.with_dimension(
        T.catches(spark, sf), T.size_limits(spark, sf), [C.SPECIES], [C.SIZE_MAX, C.WEIGHT_MAX]
    ).withColumn(C.WEIGHT, F.abs(C.WEIGHT))
    return sizes.length_weight_points(d, sizes.length_weight_reference(T.coefficients(spark, sf), d))


@query
def length_weight_points(spark, sf):
    return _points(spark, sf).select(
        *LINE_KEY, "size_cm", F.round(C.WEIGHT, 4).alias("weight_g"), F.round("predicted_g", 4).alias("predicted_g"),
        "odd_value", "odd_relation", "outlier", "diagnosis",
    )


@query
def length_weight_available(spark, sf):
    g = _points(spark, sf).groupBy(C.SPECIES).agg(F.max(F.col("a").isNotNull()).alias("available"))
    return g.withColumnRenamed(C.SPECIES, "species")


@query
def curve(spark, sf):
    c = sizes.length_weight_curve(_points(spark, sf)).withColumn("curve_g", F.round("curve_g", 4))
    return c.withColumnRenamed(C.SPECIES, "species")
