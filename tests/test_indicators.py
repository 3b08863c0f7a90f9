"""Indicators, zones and sizes on small frames with known results."""

import pytest
from pyspark.sql import functions as F

from haulframe.plans import indicators as I
from haulframe.plans import sizes, zones
from haulframe.sources import columns as C


def declared(spark, rows, **extra):
    """(outing, zone, mode, species, name, catch, weight, anglers)."""
    d = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        f"{C.ROW_ID} long, {C.OUTING} string, {C.ZONE} string, {C.MODE} string, {C.SPECIES} string, {C.VERNACULAR} string, "
        f"{C.CATCHES} double, {C.LINE_WEIGHT} double, `{C.ANGLERS}` double",
    )
    d = d.withColumns({C.SESSION: F.lit(None).cast("timestamp_ntz"), C.MONTH: F.lit("mai"), C.FAO_CODE: F.upper(F.substring(C.SPECIES, 1, 3))})
    return d.withColumns(extra) if extra else d


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_key_figures_count_missing_once(spark):
    d = declared(spark, [("o1", "z", "Bord", "s", "v", 2.0, 1.0, 1.0), (None, "z", "Bord", "s", "v", None, 1.0, 1.0)])
    d = d.withColumn(C.ANGLER, F.lit(None).cast("string"))
    assert rows_of(I.key_figures(d)) == [(1, 2, 2.0)]
    assert rows_of(I.key_figures(d.where("false"))) == [(0, 0, 0.0)]


def test_species_list(spark):
    d = declared(spark, [
        ("o", "z", "m", "s", "b", 1.0, 1500.0, 1.0), ("o", "z", "m", "s", "a", 1.0, None, 1.0),
        ("o", "z", "m", "s", None, None, 4.0, 1.0), ("o", "z", "m", "s", "c", 4.0, 5.0, 1.0),
    ])
    got = rows_of(I.species_list(d).select(C.VERNACULAR, "n_caught", "biomass_kg", "percent"))
    assert got == [("c", 4.0, 0.01, 66.67), ("a", 1.0, 0.0, 16.67), ("b", 1.0, 1.5, 16.67), (None, 0.0, 0.0, 0.0)]


def test_top_species_with_several_names(spark):
    names = [("s1", "x", 9.0), ("s1", "y", 1.0), ("s2", "x", 5.0), (None, "w", 7.0), ("s3", "v", 1.0)]
    d = declared(spark, [("o", "z", "m", s, v, n, 1.0, 1.0) for s, v, n in names])
    got = rows_of(I.top_species_labelled(d, n=3).select(C.SPECIES, "total", C.FAO_CODE, C.VERNACULAR))
    assert got == [("s1", 10.0, "S1", "x"), ("s1", 10.0, "S1", "y"), (None, 7.0, None, "w"), ("s2", 5.0, "S2", "x")]
    assert I.top_species(d, ["juin"]).count() == 0
    with pytest.raises(C.MissingColumnsError):
        I.top_species(d.drop(C.FAO_CODE))


def test_months(spark):
    d = spark.createDataFrame([(2025, 2, 1.0), (2025, 11, None), (2024, 12, 9.0), (2025, 2, 2.0)], f"{C.YEAR} int, {C.MONTH_NUMBER} int, {C.CATCHES} double")
    m = I.monthly_catch(d)
    assert rows_of(m) == [(2024, 12, "décembre", 9.0), (2025, 2, "février", 3.0), (2025, 11, "novembre", 0.0)]
    assert rows_of(I.latest_month(m)) == [(2025, 11, "novembre", 0.0)]
    assert I.latest_month(m.where("false")).count() == 0


def test_fruitless(spark):
    d = declared(spark, [
        ("o1", "z", "m", "s", "v", 0.0, 1.0, 1.0), ("o1", "z", "m", "s", "v", None, 1.0, 1.0),
        ("o2", "z", "m", "s", "v", 0.0, 1.0, 1.0), ("o2", "z", "m", "s", "v", 3.0, 1.0, 1.0),
        ("o3", "y", "m", "s", "v", 0.0, 1.0, 1.0),
    ])
    assert sorted(rows_of(I.fruitless_outings(d))) == [("y", 1, 1, 0), ("z", 2, 1, 1)]
    assert sorted(rows_of(I.fruitless_share(d))) == [("n_fruitless", 2, pytest.approx(200 / 3)), ("n_with_catch", 1, pytest.approx(100 / 3))]
    assert sorted(rows_of(I.fruitless_share(d.where("false")))) == [("n_fruitless", 0, None), ("n_with_catch", 0, None)]


def test_effort_uses_the_first_anglers(spark):
    d = declared(spark, [
        ("o1", "z", "Bord", "s", "v", 2.0, 10.0, 2.0), ("o1", "z", "Bord", "s", "v", 4.0, None, 4.0),
        ("o2", "z", "Bord", "s", "v", 1.0, 5.0, None), ("o3", "z", "Indeterminable", "s", "v", 1.0, 5.0, 1.0),
        ("o4", "z", None, "s", "v", 1.0, 5.0, 1.0),
    ])
    got = I.cpue_by_mode(d.repartition(3)).select(C.OUTING, "n_caught", "weight_g", "n_anglers", "cpue_n", "cpue_g")
    assert sorted(rows_of(got)) == [("o1", 6.0, 10.0, 2.0, 3.0, 5.0), ("o2", 1.0, 5.0, None, None, None)]


def test_effort_by_species(spark):
    d = declared(spark, [
        ("o1", "z", "Bord", "s1", "a", 50.0, 1.0, 2.0), ("o2", "z", "Bord", "s1", "a", 10.0, 1.0, None),
        ("o3", "z", "Bord", "s1", "rare", 3.0, 1.0, 1.0), ("o3", "z", "Bord", "s2", "b", 1.0, 1.0, 1.0),
        ("o4", "z", "Bateau", "s2", "b", 30.0, 1.0, 1.0),
    ])
    effort = I.cpue_by_species(d, "Bord", I.cpue_top_species(d, 2))
    got = sorted(rows_of(effort.select(C.OUTING, C.SPECIES, C.VERNACULAR, "species_rank", "cpue_n")), key=str)
    assert got == [("o1", "s1", "a", 1, 25.0), ("o2", "s1", "a", 1, None), ("o3", "s1", None, None, 3.0), ("o3", "s2", "b", 2, 1.0)]
    summary = I.cpue_summary(effort, "cpue_n").select(C.VERNACULAR, C.SPECIES, "n_outings", "mean", "median")
    assert rows_of(summary) == [("a", "s1", 2, 25.0, 25.0), ("b", "s2", 1, 1.0, 1.0), (None, "s1", 1, 3.0, 3.0)]


def test_biomass(spark):
    d = declared(spark, [
        ("o", "z", "m", "s", "v", 4.0, 8000.0, 1.0), ("o", "z", "m", "s", "v", 0.0, 500.0, 1.0),
        ("o", "z", "m", "s", "v", None, 1000.0, 1.0), ("o", "z", "m", "s", "v", 2.0, None, 1.0),
    ]).withColumns({C.KEPT: F.col(C.CATCHES) / 4, C.RELEASED: F.col(C.CATCHES) * 0.75})
    assert rows_of(I.biomass_split(d)) == [(9.5, 2.0, 6.0)]


def test_choices(spark):
    d = spark.createDataFrame([("b",), (None,), ("a",), ("b",), ("Indeterminable",)], "m string")
    assert rows_of(I.choices(d, "m", ["Indeterminable"])) == [("a",), ("b",)]


def test_zones(spark):
    table = spark.createDataFrame([("calanques", "A"), ("calanques", "B"), ("banyuls", "C")], f"site string, {C.SUBZONE} string")
    d = spark.createDataFrame([(4, "A", 2.0), (7, "A", None), (7, "gone", 5.0), (None, "C", 1.0)], f"{C.ZONE_ID} long, {C.SUBZONE} string, {C.CATCHES} double")
    joined = zones.on_zones(zones.zones_of_active_site(table, d), zones.pressure(d))
    assert sorted(rows_of(joined)) == [("calanques", "A", 2.0, 2), ("calanques", "B", 0.0, None)]
    south = d.where(f"{C.ZONE_ID} = 7")
    assert rows_of(zones.zones_of_active_site(table, south).select(C.SUBZONE)) == [("C",)]
    assert zones.zones_of_active_site(table, d.where(f"{C.ZONE_ID} IS NULL")).count() == 0
    assert zones.zones_of_active_site(table, d.where("false")).count() == 0


def fish(spark, rows):
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        f"{C.ROW_ID} long, {C.VERNACULAR} string, {C.SPECIES} string, {C.CATCHES} double, {C.SIZE} double, {C.WEIGHT} double, "
        f"{C.SIZE_MAX} double, {C.WEIGHT_MAX} double",
    )


def test_sizes(spark):
    d = fish(spark, [
        ("v", "s", 3.0, 10.0, 1.0, None, None), ("v", "s", 2.0, 11.0, 1.0, None, None), ("v", "s", 1.0, None, 1.0, None, None),
        ("v", "s", None, 500.0, 1.0, None, None), ("v", "s", 0.0, 500.0, 1.0, None, None), ("v", "s", 1.0, 0.0, 1.0, None, None),
    ])
    bound = sizes.size_bound(d, missing_counts="skip").first()
    assert (bound.upper_size, bound.size_limit) == (11.0, 20.0)
    limits = spark.createDataFrame([(0, "v", 10.0), (1, "v", 90.0)], f"{C.ROW_ID} long, {C.VERNACULAR} string, {C.LEGAL_SIZE} double")
    got = sizes.with_legal_size(sizes.size_histogram(d, missing_counts="skip"), limits).orderBy("class_max")
    assert rows_of(got.select("class_min", "class_max", "n_fish", "below_min")) == [(0.0, 10.0, 3.0, True), (10.0, 20.0, 2.0, False)]


def test_length_weight(spark):
    d = fish(spark, [
        ("v", "s", 1.0, 100.0, 10.0, None, None), ("v", "s", 1.0, 100.0, 30.0, None, None), ("v", "s", 1.0, 0.0, 5.0, None, None),
        ("v", "s", 1.0, 20.0, 0.0, None, None), ("v", "s", 1.0, None, 5.0, None, None), ("v", "t", 1.0, 50.0, 5.0, None, None),
        ("v", "s", 2.0, 50.0, 5.0, None, None), ("v", "s", 1.0, 121.0, 5.0, 100.0, None), ("v", "u", 1.0, 0.0, 5.0, None, None),
    ])
    coef = spark.createDataFrame(
        [(0, "s", 0.01, 3.0, "med"), (1, "s", 9.0, 9.0, "hors med"), (2, "t", None, None, None), (3, "x", 1.0, 1.0, "med")],
        f"{C.ROW_ID} long, {C.SPECIES} string, a_FB double, b_FB double, origine_FB string",
    )
    ref = sizes.length_weight_reference(coef, d)
    assert sorted(rows_of(ref.select(C.SPECIES, "a", "origin"))) == [("s", 0.01, "med"), ("t", None, None)]
    points = sizes.length_weight_points(d, ref)
    got = {r[C.ROW_ID]: (r.diagnosis, r.odd_relation, r.outlier) for r in points.collect()}
    assert got == {
        0: ("val. ok / RTP ok", False, False), 1: ("val. ok / RTP aberrante", True, True),
        2: ("Val. manquante", True, True), 3: ("Val. manquante", False, True), 4: (None, None, None),
        5: ("val. ok / RTP inconnue", None, None), 8: ("Val. manquante", None, True),
    }
    assert sizes.relation_available(points).first().available is True
    curve = sizes.length_weight_curve(points).where("curve_cm = 10")
    assert rows_of(curve.select(C.SPECIES, "curve_cm", "curve_g", "origin")) == [("s", 10.0, pytest.approx(10.0), "med")]
    assert sizes.length_weight_curve(points).count() == 21
    assert sizes.relation_available(points.where("false")).first().available is False
