"""Project names and links into the hosting site."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from beaconaudit.functions.columns import not_blank, strip
from beaconaudit.sources.corpus import relative_path

DEFAULT_BRANCH = "main"
# What makes a link valid, and the name of last resort.
VALID_URL = r"^(?i:https?)://[^/?#]*github\.com"
UNKNOWN_PROJECT = "unknown"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/+[^/]*/*$", "")


def project_name(path: Column, scan_root: Column) -> Column:
    """First component below the root; outside of it the third part from the end."""
    rel = relative_path(path, scan_root)
    absolute = path.startswith("/")
    parts = F.split(F.regexp_replace(path, r"^/+", ""), "/+")
    # the root directory counts as a part of an absolute path
    parts = F.when(absolute, F.concat(F.array(F.lit("/")), parts)).otherwise(parts)
    outside = F.when(F.size(parts) >= 3, F.get(parts, F.size(parts) - 3)).otherwise(UNKNOWN_PROJECT)
    return F.when(rel.isNotNull(), F.substring_index(rel, "/", 1)).otherwise(outside)


def project_url(base_url: str, name: Column) -> Column:
    return F.concat(F.lit(base_url), F.lit("/"), name)


def file_url(base_url: str, path: Column, line: Column, scan_root: Column, branch: Column) -> Column:
    """Link to a line of a file. Outside the scan root only the file name is known.

    A file directly in the scan root is its own project, with nothing below it.
    """
    rel = relative_path(path, scan_root)
    below = F.when(rel.contains("/"), F.regexp_replace(rel, r"^[^/]*/", "")).otherwise(".")
    inside = F.when(rel.isNotNull(), below).otherwise(base_name(path))
    anchor = F.when(line > 0, F.concat(F.lit("#L"), line.cast("string"))).otherwise("")
    return F.concat(project_url(base_url, project_name(path, scan_root)), F.lit("/blob/"), branch,
                    F.lit("/"), inside, anchor)


def is_valid_url(url: Column) -> Column:
    return F.coalesce(url.rlike(VALID_URL), F.lit(False))


def branch(current: Column, origin_head: Column, default: str = DEFAULT_BRANCH) -> Column:
    """Checked-out branch, else the remote's default, else ``default``."""
    known = [not_blank(strip(current)), not_blank(strip(origin_head))]
    return F.coalesce(known[0], F.substring_index(known[1], "/", -1), F.lit(default))
