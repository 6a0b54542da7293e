"""What a commit does to several tables at once: studies that leave the scope, analyses that are replaced or retired."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.versions import Change


def bodies(facts: DataFrame, key: str = "study_id") -> DataFrame:
    """key, body: all facts (item_kind, value) of a study as one text that does not depend on the order of rows."""
    return facts.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(F.struct("item_kind", "value")))).alias("body"))


def archived(change: Change, old: DataFrame, key: str = "study_id") -> None:
    """Put analyses (key, body) into the history under the hash of their body; one that is there already is not put again."""
    rows = old.select(F.sha2("body", 256).alias("snapshot_id"), key, "body").dropDuplicates(["snapshot_id"])
    if "history" in change.state["tables"]:
        rows = rows.join(change.table("history").select("snapshot_id"), "snapshot_id", "left_anti")
    change.append("history", rows)


def retired(change: Change, ids: DataFrame, key: str = "study_id") -> None:
    """The analyses of some studies go from the facts to the history."""
    gone = ids.select(key).distinct()
    archived(change, bodies(change.base.table("facts").join(gone, key, "left_semi"), key), key)
    change.upsert("facts", change.base.table("facts").limit(0), key, gone)


def removed_from_scope(change: Change, ids: DataFrame, key: str = "study_id") -> None:
    """What studies that leave the scope take along: their analyses, which the history keeps. Observations of their documents stay."""
    if change.base.has("facts"):
        retired(change, ids, key)
