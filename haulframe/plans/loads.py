"""Adding exports to declarations that are already cleaned.

A store keeps the cleaned declarations by year and, in a bucketed table, the key of every declaration that was ever
kept, with the number of its load. A new load is cleaned like any export; what an earlier load holds already is
a duplicate, told by an anti join whose stored side is read bucket by bucket and never shuffled. Only years that
the load touches are written again. Two loads give the rows that one load of both would give.

A load may be repeated after a failure: it does not see its own keys, and its own rows are replaced. Loads are told apart by
increasing numbers, and must be added one at a time.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulframe.plans.cleaning import KEY, clean_declarations
from haulframe.plans.rule_tables import RuleTables
from haulframe.plans.rules import CleaningRules
from haulframe.sources import columns as C
from haulframe.sources.exports import read_declarations, write_declarations
from haulframe.sources.shared import remove, shuffles_removed, stored

LOAD = "_load"


@dataclass(frozen=True)
class Store:
    """``path`` is a folder that all executors share; the number of buckets stays as it was at first.

    With at least as many buckets as ``spark.sql.shuffle.partitions``, only new keys are shuffled.
    """

    path: str
    buckets: int = 200

    @property
    def cleaned(self) -> str:
        return f"{self.path}/cleaned"


def key_table(spark: SparkSession, store: Store) -> DataFrame:
    """(_key, _load) of all declarations kept so far, bucketed by key."""
    name = "haulframe_keys_" + hashlib.md5(store.path.encode()).hexdigest()
    where = f"{store.path}/keys".replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({KEY} BINARY, {LOAD} BIGINT) USING parquet "
        f"CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {store.buckets} BUCKETS LOCATION '{where}'"
    )
    spark.catalog.refreshTable(name)
    return spark.table(name)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def new_declarations(
    spark: SparkSession, store: Store, raw: DataFrame, load: int, size_limits: DataFrame,
    rules: CleaningRules | None = None, tables: RuleTables | None = None,
) -> DataFrame:
    """Cleaned declarations of a load that no earlier load holds, with their keys."""
    earlier = key_table(spark, store).where(F.col(LOAD) < load)
    return clean_declarations(raw, size_limits, rules, tables, seen=earlier).withColumn(LOAD, F.lit(load).cast("bigint"))


def add_load(
    spark: SparkSession, store: Store, raw: DataFrame, load: int, size_limits: DataFrame,
    rules: CleaningRules | None = None, tables: RuleTables | None = None,
) -> None:
    """Clean ``raw`` and add what is new to the store."""
    new = stored(new_declarations(spark, store, raw, load, size_limits, rules, tables), "load")
    years = [r[0] for r in new.select(C.YEAR).distinct().collect()]
    rows = new.drop(KEY)
    if _exists(spark, store.cleaned):
        kept = read_declarations(spark, store.cleaned).where(F.col(C.YEAR).isin(years) & (F.col(LOAD) != load))
        rows = rows.unionByName(kept, allowMissingColumns=True)
    # the rows first: a load whose keys are known is complete
    write_declarations(rows, store.cleaned, "overwrite", only_given_years=True)
    keys = key_table(spark, store)
    added = new.select(KEY, LOAD).join(keys.where(F.col(LOAD) == load).select(KEY), KEY, "left_anti")
    with shuffles_removed(spark):
        added.write.insertInto("haulframe_keys_" + hashlib.md5(store.path.encode()).hexdigest())
    remove(spark, new._stored_at)


def read_store(spark: SparkSession, store: Store) -> DataFrame:
    return read_declarations(spark, store.cleaned)
