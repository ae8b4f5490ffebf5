"""What became of branches, from facts of version control that were landed as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sources of an outcome that a rollup counts under a name of their own.
FINER = {"git_empty_branch": "abandoned_empty", "git_discarded_unmerged": "abandoned_discarded", "git_discarded_verified": "abandoned_discarded"}


def outcome(exists: Column, has_base: Column, landed: Column, unlanded: Column, merged: Column, reverted: Column, worktree_live: Column) -> Column:
    """struct(outcome, source, confidence) of a branch; a null outcome is work in flight or one that can't be told.

    ``landed`` and ``unlanded`` count its own commits whose patch the trunk has or lacks. A recorded
    merge counts where no patch tells that work landed; a live worktree keeps the rest open."""

    def is_(name: str | None, source: str, confidence: str) -> Column:
        return F.struct(F.lit(name).cast("string").alias("outcome"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence"))

    def said(flag: Column) -> Column:
        return F.coalesce(flag, F.lit(False))

    landed, unlanded = (F.coalesce(n, F.lit(0)) for n in (landed, unlanded))
    whole = F.when(said(reverted), is_("reverted", "git_revert_on_main", "high")).otherwise(is_("landed", "git_squash_equiv", "high"))
    none = F.when(said(merged), is_("landed", "git_merged_into_main", "high")).when(unlanded == 0, is_("abandoned", "git_empty_branch", "high"))
    none = none.when(said(worktree_live), is_(None, "git_pending", "high")).otherwise(is_("abandoned", "git_discarded_unmerged", "medium"))
    known = F.when(landed == 0, none).when(unlanded == 0, whole).otherwise(is_("landed", "git_partial_squash", "medium"))
    return F.when(~said(exists), is_("abandoned", "git_branch_gone", "medium")).when(~said(has_base), is_(None, "git_no_merge_base", "low")).otherwise(known)


def rollup(outcomes: DataFrame, *keys: str) -> DataFrame:
    """(keys, bucket, n): outcomes counted, null as "pending", abandoned work as empty or discarded."""
    finer = F.try_element_at(F.create_map(*[F.lit(x) for kv in FINER.items() for x in kv]), F.col("source"))
    return outcomes.groupBy(*keys, F.coalesce(finer, "outcome", F.lit("pending")).alias("bucket")).agg(F.count("*").alias("n"))
