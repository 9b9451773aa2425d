"""References to records that are missing, deleted or created later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import require_columns


def broken_references(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Rows of ``children`` (row_key STRING, ref, period STRING, optional at LONG) whose reference has a defect.

    ``parents`` has ref, deleted BOOLEAN and, where lateness counts, created_at LONG; several rows of one ref count as one record,
    deleted only if all of them are, created at the earliest. Null refs are no references; keys are compared as given, so normalise both sides.
    The distinct keys of the children are anti-joined with the parents' keys, so a hot key crosses the network once per
    task; only keys with a defect are joined back to their rows. kind is ``missing``, else ``deleted``, else ``late`` (the record was
    created after the known instant ``at`` of the row). Empty tables are fine: with no parents every reference is missing.
    Result: row_key, ref, kind, period.
    """
    require_columns(children, ["row_key", "ref", "period"])
    require_columns(parents, ["ref", "deleted"])
    rows = children.where("ref IS NOT NULL")
    records = parents.where("ref IS NOT NULL").groupBy("ref").agg(
        F.min(F.coalesce("deleted", F.lit(False))).alias("deleted"),
        *[F.min("created_at").alias("created_at") for c in parents.columns if c == "created_at"],
    )
    keys = rows.select("ref").distinct()
    missing = keys.join(records.select("ref"), "ref", "left_anti").select("ref", F.lit("missing").alias("kind"))
    deleted = records.where("deleted").select("ref", F.lit("deleted").alias("kind"))
    # Keys with a defect are unique, so AQE may split a hot key of the rows without doubling results.
    found = rows.join(missing.unionByName(deleted), "ref").select("row_key", "ref", "kind", "period")
    if "at" not in children.columns or "created_at" not in parents.columns:
        return found
    alive = records.where("NOT deleted AND created_at IS NOT NULL").select("ref", "created_at")
    late = rows.where("at IS NOT NULL").join(alive, "ref").where("created_at > at")
    return found.unionByName(late.select("row_key", "ref", F.lit("late").alias("kind"), "period"))


def reference_report(found: DataFrame, by: list[str]) -> DataFrame:
    """Number of broken references and of distinct keys per group of ``by`` columns."""
    return found.groupBy(*by).agg(F.count("*").alias("n_rows"), F.count_distinct("ref").alias("n_keys"))
