"""Session settings that the operators are tuned for.

None is required for correct results. On a cluster the same settings belong in
the submit configuration; the library leaves a session as it was given. Two settings differ
while a table is written or folders are listed (``sources.shared.settings``).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # re-plan joins by measured sizes, split skewed join partitions, merge small ones
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # a side is broadcast only when its measured size is below this
    "spark.sql.autoBroadcastJoinThreshold": "32m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.session.timeZone": "UTC",
}

TASK_BYTES = 128 * 1024 * 1024


def settings_for(input_bytes: int) -> dict[str, str]:
    """``SETTINGS`` with as many shuffle partitions as the input needs.

    Adaptive execution merges partitions that turn out small, so the number
    follows the input without a limit.
    """
    partitions = max(-(-input_bytes // TASK_BYTES), 200)
    return {**SETTINGS, "spark.sql.shuffle.partitions": str(partitions)}


def build_session(name: str, master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **more}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
