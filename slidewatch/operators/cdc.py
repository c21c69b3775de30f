"""Row-change feeds to history and current tables.

Change columns: the business key, ``_pg_change_type`` (insert, update_preimage, update_postimage, delete),
``_pg_lsn``, ``_sort_by``, ``_timestamp`` and the row image. Changes are ordered by (_pg_lsn, _sort_by).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidewatch.functions.scan import next_row
from slidewatch.operators.rank import latest_per_key

CHANGE_ORDER = ["_pg_lsn", "_sort_by"]


def images(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("_pg_change_type") != "update_preimage")


def scd2(changes: DataFrame, key: str, slice_by: Column | None = None) -> DataFrame:
    """Versions of each row with valid_from, valid_to and is_current. A delete closes the version before it.

    ``slice_by`` cuts a long history into blocks of log positions (see ``functions.scan``).
    """
    slice_by = F.floor(F.col("_pg_lsn") / 1000000) if slice_by is None else slice_by
    versions = next_row(images(changes), [key], CHANGE_ORDER, ["_timestamp"], slice_by, "_next")
    versions = versions.withColumns(
        {
            "valid_from": F.col("_timestamp"),
            "valid_to": F.col("_next._timestamp"),
            "is_current": F.col("_next").isNull(),
        }
    )
    return versions.where(F.col("_pg_change_type") != "delete").drop("_next")


def current_from_cdc(changes: DataFrame, key: str) -> DataFrame:
    """Newest image per key; keys whose last change is a delete are gone."""
    return latest_per_key(images(changes), key, CHANGE_ORDER).where(F.col("_pg_change_type") != "delete")


def state_as_of(history: DataFrame, moment: str) -> DataFrame:
    """The versions that were valid at ``moment``."""
    at = F.lit(moment).cast("timestamp_ntz")
    return history.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))
