"""Clean new export files as they arrive.

An upload is one export, cleaned on its own: its duplicates and its row order end
with the file. The file's path is therefore a column of every row, which makes it
part of what rows are compared by. A batch holds all files that wait and is cleaned
by a normal batch plan. Each batch overwrites its own output folder, which makes a
batch that is repeated after a failure harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from haulframe.plans.cleaning import clean_declarations
from haulframe.plans.rules import CleaningRules
from haulframe.sources import columns as C
from haulframe.sources.exports import BANNER_LINES, parse_lines, write_declarations

UPLOAD = "upload"


def start_cleaning(
    spark: SparkSession,
    incoming: str,
    cleaned: str,
    progress: str,
    size_limits: DataFrame,
    rules: CleaningRules | None = None,
    banner_lines: int = BANNER_LINES,
    only_waiting: bool = False,
) -> StreamingQuery:
    """Watch ``incoming`` and write ``cleaned/upload=<n>/annee=<year>``.

    ``progress`` is the stream's checkpoint folder and must be shared storage.
    ``only_waiting`` stops after the files that are already there.
    """
    lines = spark.readStream.text(incoming).select("value", "_metadata")

    def clean_batch(batch: DataFrame, number: int) -> None:
        raw = parse_lines(batch, banner_lines, file_column=C.FILE)
        write_declarations(
            clean_declarations(raw, size_limits, rules), f"{cleaned}/{UPLOAD}={number}", "overwrite"
        )

    writer = lines.writeStream.foreachBatch(clean_batch).option("checkpointLocation", progress)
    if only_waiting:
        writer = writer.trigger(availableNow=True)
    return writer.start()
