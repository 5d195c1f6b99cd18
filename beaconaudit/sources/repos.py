"""Repository facts per project, taken from a table ``repo_meta``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from beaconaudit.functions.columns import strip
from beaconaudit.functions.urls import DEFAULT_BRANCH, branch

REPO_META = ("project_path string, current_branch string, origin_head string, "
             "remote_url string, commit_hash string")
SHORT_HASH = 7


def repository_info(repo_meta: DataFrame, default_branch: str = DEFAULT_BRANCH) -> DataFrame:
    """Branch, remote and short commit of each project; what is unknown stays null."""
    return repo_meta.select(
        "project_path",
        branch(F.col("current_branch"), F.col("origin_head"), default_branch).alias("branch"),
        strip(F.col("remote_url")).alias("remote_url"),
        F.substring(strip(F.col("commit_hash")), 1, SHORT_HASH).alias("commit_hash"),
    )
