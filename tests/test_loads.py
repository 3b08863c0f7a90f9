"""Incremental loads, the layout of cleaned files, numbers in key order, selections by bitmaps."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from haulframe.operators import outings
from haulframe.operators.numbering import in_order
from haulframe.plans import cleaning, indicators, loads, selections
from haulframe.sources import columns as C
from haulframe.sources import exports

RAW = "_row_id bigint, `Id Prise` string, `Heure debut session` timestamp_ntz, `Taille (mm)` double, `Poids (g)` double, `Durée de la session` double, " \
    "Nokill double, Horodate string, Latitude double, Longitude double, `Lien photo` string, ID_ZoneDePeche bigint, Nom_ZoneDePeche string, " \
    "ID_SousZoneDePeche bigint, Nom_SousZoneDePeche string, Technique string, `Nom Fédération` string, NomVernaculaire string, NomScientifique string, " \
    "CodeFAO string, `Nb de prises` double, `Nb conservées` double, `Nb relâchées` double, `Nb de pêcheurs` double, `Id Abonné` string"


def raw_row(n, year=2025, weight=5.0, stamp="x", species="Sar", zone=7):
    start = dt.datetime(year, 1 + n % 12, 1 + n % 28)
    return (n, str(n), start, 100.0, weight, 0.0, None, stamp, None, None, None, zone, None, 13, "Sub 13", None, None, species, species, "SAR", 1.0 + n % 3, 1.0, 0.0, 1.0, "a")


@pytest.fixture
def limits(spark):
    return spark.createDataFrame([("Sar", 400.0, None)], f"`{C.SPECIES}` string, `{C.SIZE_MAX}` double, `{C.WEIGHT_MAX}` double")


def plain(df):
    return sorted(map(str, df.select(*sorted(c for c in df.columns if not c.startswith("_"))).collect()))


def files(store):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{store.cleaned}/**/*.parquet", recursive=True)}


def test_two_loads_equal_one(spark, tmp_path, limits):
    first = [raw_row(n, 2025 + n % 2) for n in range(40)] + [raw_row(3, 2026, stamp="again")]
    second = [raw_row(100 + n, 2026, stamp="later")[:1] + raw_row(n, 2026, stamp="later")[1:] for n in range(1, 60, 2)]
    second += [raw_row(500, 2026, weight=-5.0), raw_row(501, 2026, weight=-0.0), raw_row(502, 2026, weight=0.0, stamp="z")]
    table = lambda rows: spark.createDataFrame(rows, RAW)
    store = loads.Store(str(tmp_path / "store"), 4)
    loads.add_load(spark, store, table(first), 1, limits)
    before = files(store)
    # the second export lacks a column that was empty all along
    loads.add_load(spark, store, table(second).drop("Nom Fédération").withColumn("Nom Fédération", F.lit(None).cast("string")), 2, limits)
    after = files(store)
    same = {p for p in before if "annee=2025" in p}
    assert same and all(after[p] == before[p] for p in same)
    assert not any(p in after for p in before if "annee=2026" in p)
    together = cleaning.clean_declarations(table(first + second), limits)
    assert plain(loads.read_store(spark, store).drop(C.STAMP)) == plain(together.drop(C.STAMP))
    # a load that is repeated changes nothing
    held, keys = plain(loads.read_store(spark, store)), loads.key_table(spark, store).count()
    loads.add_load(spark, store, table(second), 2, limits)
    assert plain(loads.read_store(spark, store)) == held and loads.key_table(spark, store).count() == keys
    empty = table([])
    loads.add_load(spark, store, empty, 3, limits)
    assert plain(loads.read_store(spark, store)) == held


def test_stored_keys_are_not_shuffled(spark, tmp_path, limits):
    store = loads.Store(str(tmp_path / "store"), 4)
    rows = spark.createDataFrame([raw_row(n) for n in range(20)], RAW)
    loads.add_load(spark, store, rows, 1, limits)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = loads.new_declarations(spark, store, rows, 2, limits)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    anti = text[text.index("LeftAnti"):].splitlines()
    stored_side = anti[next(i for i, line in enumerate(anti) if "+- Sort" in line or ":- Sort" in line):]
    scan = next(i for i, line in enumerate(anti) if "haulframe_keys" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    above, level = [], depth(anti[scan])
    for line in reversed(anti[:scan]):
        if depth(line) < level:
            above.append(line)
            level = depth(line)
    assert stored_side and not any("Exchange" in line for line in above[:-1]) and "Bucketed: true" in anti[scan]


def test_a_missing_column_is_an_empty_one(spark):
    d = spark.createDataFrame([(1, None, -0.0)], "a int, b string, c double")
    assert d.select(cleaning.compared_key(d)).first() == d.drop("b").withColumn("c", F.lit(0.0)).select(cleaning.compared_key(d.drop("b"))).first()


def test_species_read_few_row_groups(spark, tmp_path):
    rows = spark.range(60_000).select(
        F.lit(2025).alias(C.YEAR), F.concat(F.lit("species "), F.col("id") % 50).alias(C.VERNACULAR), F.concat(F.lit("sub "), F.col("id") % 7).alias(C.SUBZONE),
        F.col("id").alias(C.ROW_ID), F.md5(F.col("id").cast("string")).alias("text"),
    )
    out = str(tmp_path / "cleaned")
    exports.write_declarations(rows, out, "errorifexists", row_group_bytes=100_000)
    one = exports.read_declarations(spark, out).where(F.col(C.VERNACULAR) == "species 7")
    assert len(one.collect()) == 1200
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(NomVernaculaire,species 7)" in plan
    scan = one._jdf.queryExecution().executedPlan()
    while scan.children().size():
        scan = scan.children().head()
    assert scan.metrics().apply("numOutputRows").value() < 60_000 // 8


def test_numbers_in_order(spark):
    d = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"), F.when(F.col("id") % 3 > 0, F.col("id") % 10).alias("hot")).repartition(7)
    rows = in_order(d, ["hot", "x"]).collect()
    assert sorted(r["number"] for r in rows) == list(range(5000))
    order = [(r["hot"] is not None, r["hot"] or 0, r["x"]) for r in sorted(rows, key=lambda r: r["number"])]
    assert order == sorted(order)
    assert in_order(d.limit(0), ["x"]).collect() == []


def test_outing_numbers_are_ranks(spark):
    rows = [("b", "2025-01-02 00:00:00", "Bord", None), ("a", None, None, "z"), ("é", "2025-01-01 00:00:00", "Bord", "z"), ("b", "2025-01-02 00:00:00", "Bord", None), ("B", None, None, None)]
    d = spark.createDataFrame(rows, f"`{C.ANGLER}` string, t string, `{C.MODE}` string, `{C.ZONE}` string").withColumn(C.SESSION, F.col("t").cast("timestamp_ntz"))
    found = {r["outing_key"]: (r["outing_number"], r["outing_label"]) for r in outings.with_numbers_by_key(d).collect()}
    ranked = sorted(found, key=str.encode)
    assert found == {k: (i, f"S{i:06}") for i, k in enumerate(ranked, 1)} and len(found) == 4


def figures_row(spark, rows):
    d = spark.createDataFrame(rows, f"`{C.OUTING}` string, `{C.ANGLER}` string, `{C.CATCHES}` double")
    return tuple(indicators.key_figures(d).first())


def test_an_angler_called_like_a_missing_one(spark):
    assert figures_row(spark, [("x", None, 1.0), ("x", "NA", 2.0), ("y", "NA", None)]) == (2, 2, 3.0)
    assert figures_row(spark, []) == (0, 0, 0.0) and figures_row(spark, [(None, None, None)]) == (1, 1, 0.0)


def test_selections(spark):
    rows = [
        (y, m, z, mode, f"{y}{m}{z}{mode}{o}" if o else None, a, c)
        for y in (2025, 2026, None) for m in (1, 2) for z in ("A", None) for mode in ("Bord", None) for o, a, c in ((1, "x", 0.0), (1, "y", 0.0), (2, None, 3.0), (None, "x", None))
    ]
    schema = f"`{C.YEAR}` int, `{C.MONTH_NUMBER}` int, `{C.ZONE}` string, `{C.MODE}` string, `{C.OUTING}` string, `{C.ANGLER}` string, `{C.CATCHES}` double"
    d = spark.createDataFrame(rows, schema)
    cells = selections.selectable(d)
    for cond in (None, F.col(C.YEAR) == 2026, F.col(C.ZONE).isNull(), (F.col(C.MONTH_NUMBER) == 1) & (F.col(C.MODE) == "Bord"), F.lit(False)):
        part = (d if cond is None else d.where(cond)).collect()
        caught = {}
        for r in part:
            key = (r[C.OUTING], *(r[c] for c in selections.CELL))
            caught[key] = caught.get(key, 0) + (r[C.CATCHES] or 0)
        want = (len({r[C.ANGLER] for r in part}), len({r[C.OUTING] for r in part}), len({k[0] for k, v in caught.items() if v == 0}), sum(caught.values()))
        assert tuple(selections.figures(cells, cond).first()) == want
    assert sum(r["total_catch"] for r in selections.figures_by(cells, C.YEAR).collect()) == sum(r[-1] or 0 for r in rows)
    assert tuple(selections.figures(selections.selectable(d.limit(0))).first()) == (0, 0, 0, 0.0)


def test_a_load_leaves_its_rows_and_keys_only(spark, tmp_path, limits):
    import time

    from haulframe.sources.shared import shared_dir

    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: {x for x in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
    tables = lambda: set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/*/load-*"))
    before, held = files(), tables()
    store = loads.Store(str(tmp_path / "store"), 4)
    rows = spark.createDataFrame([raw_row(n, 2025 + n % 2) for n in range(30)], RAW)
    for load, part in ((1, rows.limit(20)), (2, rows), (3, rows.limit(0))):
        loads.add_load(spark, store, part, load, limits)
    until = time.time() + 20
    left = lambda: sum(os.path.getsize(x) for x in files() - before if x.endswith(".data") and os.path.exists(x))
    while left() > 2000 and time.time() < until:  # the list of years has a shuffle of its own
        time.sleep(0.1)
    assert tables() == held and left() <= 2000
    assert loads.read_store(spark, store).count() == 30


def test_raw_declarations_shuffle_line_items_as_they_are(spark):
    from haulframe.catalog import tables

    plan = tables.raw_declarations(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "concat(Zone" in plan[:plan.index("Join")] and "concat(Zone" not in plan[plan.index("Join"):]
