"""Cleaning rules against a direct, row-by-row reading of them."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from haulframe.operators import dedupe, outings
from haulframe.plans import cleaning
from haulframe.plans.rules import DEFAULT_ANGLERS, DEFAULT_COUNTS, DEFAULT_MODES, CleaningRules
from haulframe.sources import columns as C
from haulframe.sources import exports


def both(a, b):
    if a is False or b is False:
        return False
    return None if a is None or b is None else True


def either(a, b):
    if a is True or b is True:
        return True
    return None if a is None or b is None else False


def cmp(x, f):
    return None if x is None else f(x)


class Row3:
    """A row with steps that set a column under a three-valued condition."""

    def __init__(self, **columns):
        self.__dict__.update(columns, flag=False)

    def step(self, column, cond, value):
        setattr(self, column, None if cond is None else value if cond else getattr(self, column))
        self.flag = either(self.flag, cond)


def test_catch_caps_zone_by_zone(spark):
    counts = [None, 0, 1, 100, 101, 150, 151, 500]
    cases = [
        (zone, species, n)
        for zone in (1, 2, 3, 4, 5, 6, 7, 8, None)
        for species in ("Girelle", "Sar commun", None)
        for n in counts
    ]
    d = spark.createDataFrame(
        [(i, z, s, None if n is None else float(n)) for i, (z, s, n) in enumerate(cases)],
        f"i int, {C.ZONE_ID} long, {C.VERNACULAR} string, {C.CATCHES} double",
    ).withColumn("flag", F.lit(False))
    got = cleaning.cap_catches(d, DEFAULT_COUNTS, "flag").orderBy("i").collect()
    for (zone, species, n), r in zip(cases, got):
        row = Row3(n=n)
        for z in (1, 7, 4, 6, 5, 8):
            here = cmp(zone, lambda v: v == z)
            row.step("n", both(here, cmp(row.n, lambda v: v > 150)), 150)
            ordinary = species not in DEFAULT_COUNTS.exempt
            row.step("n", both(both(here, ordinary), cmp(row.n, lambda v: v > 100)), 1)
        assert (r[C.CATCHES], r.flag) == (row.n, row.flag), (zone, species, n)


def test_kept_and_released_caps(spark):
    counts = [None, 0, 1, 100, 101, 150, 151]
    cases = [(s, k, r) for s in ("Girelle", "Sar commun", None) for k in counts for r in counts]
    d = spark.createDataFrame(
        [(i, s, None if k is None else float(k), None if r is None else float(r)) for i, (s, k, r) in enumerate(cases)],
        f"i int, {C.VERNACULAR} string, `{C.KEPT}` double, `{C.RELEASED}` double",
    ).withColumn("flag", F.lit(False))
    got = cleaning.cap_kept_released(d, DEFAULT_COUNTS, "flag").orderBy("i").collect()
    for (species, k, rel), r in zip(cases, got):
        row = Row3(k=k, r=rel)
        for limit, value, applies in ((150, 150, True), (100, 1, species not in DEFAULT_COUNTS.exempt)):
            row.step("k", both(both(cmp(row.r, lambda v: v == 0), applies), cmp(row.k, lambda v: v > limit)), value)
            row.step("r", both(both(cmp(row.k, lambda v: v == 0), applies), cmp(row.r, lambda v: v > limit)), value)
        assert (r[C.KEPT], r[C.RELEASED], r.flag) == (row.k, row.r, row.flag), (species, k, rel)


def test_angler_caps(spark):
    cases = [
        (z, m, n) for z in (1, 2, 4, 7, None) for m in ("Bateau", "Bord", None)
        for n in (None, -1, 0, 1, 8, 9, 12, 13, 30, 31)
    ]
    d = spark.createDataFrame(
        [(i, z, m, None if n is None else float(n)) for i, (z, m, n) in enumerate(cases)],
        f"i int, {C.ZONE_ID} long, {C.MODE} string, `{C.ANGLERS}` double",
    ).withColumn("flag", F.lit(False))
    got = cleaning.cap_anglers(d, DEFAULT_ANGLERS, "flag").orderBy("i").collect()
    for (zone, mode, n), r in zip(cases, got):
        row = Row3(n=n)
        boat = cmp(mode, lambda v: v == "Bateau")
        for z, most in ((4, 12), (7, 8), (1, 12)):
            row.step("n", both(both(cmp(zone, lambda v: v == z), boat), cmp(row.n, lambda v: v > most)), 1)
        row.step("n", either(cmp(row.n, lambda v: v > 30), cmp(row.n, lambda v: v <= 0)), 1)
        assert (r[C.ANGLERS], r.flag) == (row.n, row.flag), (zone, mode, n)


def test_caps_are_stable_and_ignore_row_order(spark):
    r = random.Random(11)
    number = [None, 0.0, 5.0, 101.0, 151.0, 400.0]
    rows = [
        (i, r.choice([1, 2, 4, 7, 8, None]), r.choice(["Bateau", "Bord", None]), r.choice(["Girelle", "Sar", None]),
         r.choice(number), r.choice(number), r.choice(number), r.choice([None, 0.0, 3.0, 9.0, 14.0, 40.0]), r.choice([None, "x"]))
        for i in range(500)
    ]
    d = spark.createDataFrame(
        rows, f"i int, {C.ZONE_ID} long, {C.MODE} string, {C.VERNACULAR} string, {C.CATCHES} double, `{C.KEPT}` double, "
        f"`{C.RELEASED}` double, `{C.ANGLERS}` double, {C.NOTE} string",
    )
    once = cleaning.cap_outliers(d, CleaningRules())
    capped = [C.CATCHES, C.KEPT, C.RELEASED, C.ANGLERS]
    first = {r.i: r for r in once.collect()}
    assert first == {r.i: r for r in cleaning.cap_outliers(d.repartition(5), CleaningRules()).collect()}
    for again in cleaning.cap_outliers(once, CleaningRules()).collect():
        assert [again[c] for c in capped] == [first[again.i][c] for c in capped]


def test_modes(spark):
    cases = [
        ("Chasse SOUS-MARINE", 7, 13, "Sous-marin"), ("à l'indienne", None, None, "Sous-marin"),
        ("À LA COULÉE", 1, 1, "Sous-marin"), ("Lancer", 7, 13, "Bord"), ("Lancer", 7, 21, "Bateau"),
        ("Lancer", 7, 22, "Indeterminable"), ("Surfcasting", 4, 83, "Bateau"), ("Surfcasting", 4, 13, "Bord"),
        ("Traine", 7, None, "Bateau"), (None, 4, 24, "Bateau"), (None, 4, 57, None), ("autre", 1, 1, None),
        ("Calée verticale (à l'ancre)", 2, 2, "Bateau"), ("Broumé", None, 13, "Indeterminable"), (None, None, None, None),
    ]
    d = spark.createDataFrame(
        [(i, *c[:3]) for i, c in enumerate(cases)],
        f"i int, {C.TECHNIQUE} string, {C.ZONE_ID} long, {C.SUBZONE_ID} long",
    )
    got = d.select("i", cleaning.fishing_mode(DEFAULT_MODES).alias("m")).orderBy("i").collect()
    assert [r.m for r in got] == [c[3] for c in cases]


def test_keep_first(spark):
    r = random.Random(5)
    rows = [(i, r.choice(["a", "b", None]), r.choice([1.0, 2.0, None]), f"p{i}") for i in range(300)]
    d = spark.createDataFrame(rows, "_row_id long, k string, x double, photo string")
    want = {}
    for i, k, x, photo in rows:
        want.setdefault((k, x), (i, photo))
    for shuffled in (d, d.repartition(7), d.orderBy(F.desc("_row_id"))):
        got = dedupe.keep_first_except(shuffled, ["photo"], C.ROW_ID)
        assert got.columns == d.columns
        assert {(g.k, g.x): (g._row_id, g.photo) for g in got.collect()} == want
        assert dedupe.keep_first_except(got, ["photo"], C.ROW_ID).count() == len(want)


def test_keep_first_compares_numbers_by_value(spark):
    d = spark.createDataFrame(
        [(0, 0.0), (1, -0.0), (2, float("nan")), (3, -float("nan")), (4, None), (5, None)], "_row_id long, x double"
    ).repartition(3)
    assert sorted(r._row_id for r in dedupe.keep_first(d, ["x"], C.ROW_ID).collect()) == [0, 2, 4]


def test_copies_are_merged_before_the_shuffle(spark):
    """A row that makes up nearly all the data crosses the shuffle once per task."""
    d = spark.range(0, 40_000, 1, 4).select(
        F.col("id").alias(C.ROW_ID), F.when(F.col("id") % 1000 == 0, F.col("id")).otherwise(-1).alias("k")
    )
    plan = dedupe.keep_first(d, ["k"], C.ROW_ID)
    assert plan.count() == 41
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.index("partial_min") > text.index("Exchange hashpartitioning")


def test_outing_numbers(spark):
    rows = [(f"a{i % 50}", i % 7, m, z) for i in range(700) for m in ("Bord", None) for z in ("x", None)]
    d = spark.createDataFrame(rows, "a string, d int, m string, z string")
    d = d.withColumn(C.OUTING, outings.outing_key(["a", "d", "m", "z"]))
    assert d.select(C.OUTING).distinct().count() == len(set(rows))
    labels = [r.outing_label for r in outings.numbered(d).collect()]
    assert sorted(labels) == [f"S{i:06d}" for i in range(1, len(set(rows)) + 1)]
    assert outings.with_outing_labels(d).where("outing_label IS NULL").count() == 0


HEADER = (
    "Id Prise;Heure debut session;Taille (mm);Poids (g);Durée de la session;Nokill;Horodate;Latitude;Longitude;Lien photo;"
    "ID_ZoneDePeche;Nom_ZoneDePeche;ID_SousZoneDePeche;Nom_SousZoneDePeche;Technique;Nom Fédération;NomVernaculaire;"
    "NomScientifique;CodeFAO;Nb de prises;Nb conservées;Nb relâchées;Nb de pêcheurs;Id Abonné"
)
LINES = (
    # first of two copies that differ in ignored columns and in the sign of the weight
    "#1;2025-06-02 07:00:00;200;-150;0;NA;h1;1;2;p;7;Banyuls;13;Sub 13;Lancer;FF;Sar;Diplodus;SAR;2;2;0;40;u1",
    "2;2025-06-02 07:00:00;200;150;NA;0;h2;3;4;q;7;Banyuls;13;Sub 13;Lancer;FF;Sar;Diplodus;SAR;2;2;0;40;u1",
    # invalid zone, too many fish of an ordinary species, no angler
    "3;2025-06-02 07:00:00;NA;10;60;1;h;NA;NA;NA;-1;NA;NA;NA;Traine;NA;Sar;Diplodus;SAR;500;500;0;0;u1",
    # schooling species: cut at the cap
    "4;2025-06-03 07:00:00;100;10;60;1;h;NA;NA;NA;4;Calanques;83;Sub 83;Broumé;NA;Girelle;Coris;COR;500;0;500;13;u2",
    # the corrected catch id, in a recoded zone
    "41161;2025-06-04 07:00:00;100;10;60;1;h;NA;NA;NA;-1;NA;1;NA;trou;NA;Sar;Diplodus;SAR;9;9;0;1;u2",
    # no id: neither count nor note can be told
    "NA;2025-06-05 07:00:00;100;10;60;1;h;NA;NA;NA;-1;NA;1;NA;autre;NA;Sar;unknown;SAR;9;9;0;1;u3",
    # too early, and without a start
    "6;2024-12-31 23:59:59;100;10;60;1;h;NA;NA;NA;1;z;1;NA;autre;NA;Sar;Diplodus;SAR;9;9;0;1;u3",
    "7;NA;100;10;60;1;h;NA;NA;NA;1;z;1;NA;autre;NA;Sar;Diplodus;SAR;9;9;0;1;u3",
)


def write_export(path):
    path.write_text("\n".join(["banner", "banner", HEADER, *LINES]) + "\n", encoding="utf-8")
    return str(path)


def size_table(spark):
    return spark.createDataFrame(
        [("Diplodus", 450.0, 3000.0), ("Diplodus", 450.0, 3000.0), ("Coris", None, 100.0)],
        f"{C.SPECIES} string, {C.SIZE_MAX} double, {C.WEIGHT_MAX} double",
    )


def check_cleaned(rows):
    r = {(k[C.CATCH_ID]): k for k in rows}
    assert set(r) == {1, 3, 4, 41161, None} and len(rows) == 5
    first = r[1]
    assert (first[C.WEIGHT], first[C.DURATION], first[C.NO_KILL], first[C.STAMP]) == (150.0, None, 0.0, "h1")
    assert (first[C.WEEKDAY], first[C.MONTH], first[C.YEAR]) == ("lundi", "juin", 2025)
    assert (first[C.MODE], first[C.MEMBER], first[C.ANGLERS]) == ("Bord", "oui", 1.0)
    assert (first[C.SIZE_MAX], first[C.NOTE]) == (450.0, "nombre de pêcheur renseigné aberrant")
    odd = r[3]
    assert (odd[C.ZONE_ID], odd[C.CATCHES], odd[C.KEPT], odd[C.ANGLERS], odd[C.MODE], odd[C.MEMBER]) == (8, 1, 1, 1, "Bateau", "non")
    assert odd[C.NOTE] == (
        "Zone de pêche = -1 donc on reassigne en 8 ; Quantité de prise renseignée aberrante ; nombre de pêcheur renseigné aberrant"
    )
    school = r[4]
    assert (school[C.CATCHES], school[C.RELEASED], school[C.ANGLERS], school[C.MODE]) == (150, 150, 1, "Bateau")
    assert (school[C.SIZE_MAX], school[C.WEIGHT_MAX]) == (None, 100.0)
    patched = r[41161]
    assert (patched[C.CATCHES], patched[C.MODE]) == (1, "Sous-marin")
    assert patched[C.NOTE] == "Zone de pêche = -1 donc on reassigne en 8 ; modification nb_prise car photo montre 1 indiv"
    unknown = r[None]
    assert (unknown[C.CATCHES], unknown[C.NOTE], unknown[C.MODE], unknown[C.SIZE_MAX]) == (None, None, None, None)
    assert all(re.fullmatch("[0-9a-f]{32}", k[C.OUTING]) for k in rows) and len({k[C.OUTING] for k in rows}) == 5


def test_whole_cleaning(spark, tmp_path):
    raw = exports.read_export(spark, write_export(tmp_path / "e.csv"))
    check_cleaned(cleaning.clean_declarations(raw, size_table(spark)).collect())
    later = cleaning.clean_declarations(raw, size_table(spark), CleaningRules(date_min="2025-06-04"))
    assert later.agg(F.min(C.SESSION)).first()[0] == dt.datetime(2025, 6, 4, 7)


def test_uploads(spark, tmp_path):
    from haulframe.streaming import uploads

    incoming = tmp_path / "in"
    incoming.mkdir()
    write_export(incoming / "a.csv")
    where = [str(tmp_path / p) for p in ("out", "progress")]
    for uploaded in (1, 2):  # the second start only sees the new file
        q = uploads.start_cleaning(spark, str(incoming), *where, size_table(spark), only_waiting=True)
        q.awaitTermination(120)
        assert q.exception() is None
        back = exports.read_declarations(spark, where[0])
        assert back.groupBy(uploads.UPLOAD).count().count() == uploaded
        check_cleaned(back.where(F.col(uploads.UPLOAD) == uploaded - 1).collect())
        write_export(incoming / "b.csv")
