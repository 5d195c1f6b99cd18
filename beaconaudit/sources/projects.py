"""Projects of a directory tree: discovery, type, default ignore globs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from beaconaudit.functions.urls import base_name, project_url
from beaconaudit.operators.joins import attach
from beaconaudit.rules import IGNORE_GLOBS, PROJECT_MARKER_SUFFIX, PROJECT_MARKERS
from beaconaudit.sources.corpus import relative_path

MANIFEST = "package.json"


def is_marker(name: Column) -> Column:
    """A directory holding an entry of this name is a project."""
    return F.coalesce(name.isin(*PROJECT_MARKERS) | name.endswith(PROJECT_MARKER_SUFFIX), F.lit(False))


def _facts(name: Column) -> list[Column]:
    def any_of(test: Column, alias: str) -> Column:
        return F.coalesce(F.bool_or(test), F.lit(False)).alias(alias)

    return [any_of(is_marker(name), "is_root"), any_of(name == MANIFEST, "has_manifest"),
            any_of(name == "Assets", "has_assets"), any_of(name == "ProjectSettings", "has_settings"),
            any_of(name.endswith(PROJECT_MARKER_SUFFIX), "has_csproj")]


_FACTS = ("is_root", "has_manifest", "has_assets", "has_settings", "has_csproj")


def project_type(manifest: Column, has_manifest: Column, has_assets: Column, has_settings: Column,
                 has_csproj: Column) -> Column:
    # the whole text must be one JSON value: boxed in two ways, nothing before or after it parses
    inner = "struct<dependencies:map<string,string>,devDependencies:map<string,string>>"
    strict = {"allowSingleQuotes": "false"}
    boxed = F.from_json(F.concat(F.lit('{"x":'), manifest, F.lit("}")), f"struct<x:{inner}>", strict)["x"]
    listed = F.from_json(F.concat(F.lit("["), manifest, F.lit("]")), f"array<{inner}>", strict)
    parsed = F.when(listed.isNotNull(), boxed)

    def uses(package: str) -> Column:
        return F.coalesce(F.map_contains_key(parsed["dependencies"], package), F.lit(False)) | F.coalesce(
            F.map_contains_key(parsed["devDependencies"], package), F.lit(False))

    return (F.when(has_manifest & uses("next"), "nextjs")
            .when(has_manifest & uses("react"), "react")
            .when(has_manifest, "node")
            .when((has_assets & has_settings) | has_csproj, "unity")
            .otherwise("unknown"))


def directory_facts(listing: DataFrame) -> DataFrame:
    """What each scan root and each of its direct, visible child directories holds.

    Two small aggregations of flags: they combine map-side, so a tree that holds most
    of the listing is reduced where it is read.
    """
    rel = relative_path(F.col("path"), F.col("root"))
    parts = F.split(rel, "/")
    named = listing.select("root", "is_dir", F.get(parts, F.lit(0)).alias("child"), F.get(parts, F.lit(1)).alias("entry"))
    named = named.where(F.col("child").isNotNull() & (F.col("child") != ""))
    children = named.groupBy("root", "child").agg(
        F.bool_or(F.col("is_dir") | F.col("entry").isNotNull()).alias("is_dir"), *_facts(F.col("entry")))
    roots = children.groupBy("root").agg(*_facts(F.col("child"))).select(
        "root", F.col("root").alias("path"), F.lit(True).alias("is_self"), *_FACTS)
    below = children.where(F.col("is_dir") & ~F.col("child").startswith(".")).select(
        "root", F.concat(F.rtrim("root", F.lit("/")), F.lit("/"), F.col("child")).alias("path"),
        F.lit(False).alias("is_self"), *_FACTS)
    return roots.unionByName(below)


def discover(listing: DataFrame, manifests: DataFrame, base_url: str) -> DataFrame:
    """Projects of ``listing(root, path, is_dir)``: the root itself, or else its children.

    ``manifests(project_path, content)`` holds the text of package.json files; projects
    whose manifest is missing or unreadable there count as ``node``.
    """
    found = directory_facts(listing).where("is_root")
    selves = found.where("is_self")
    taken = selves.select("root", F.lit(True).alias("taken"))
    below = attach(found.where(~F.col("is_self")), taken, "root", spread_by=("path",)).where("taken IS NULL").drop("taken")
    projects = selves.unionByName(below)
    # roots may overlap: a manifest may be listed under several of them
    text = manifests.groupBy(F.col("project_path").alias("path")).agg(F.min("content").alias("manifest"))
    typed = projects.join(text, "path", "left")
    name = base_name(F.col("path"))
    return typed.select(
        "root", name.alias("name"), "path",
        project_type(*[F.col(c) for c in ("manifest", "has_manifest", "has_assets", "has_settings", "has_csproj")]
                     ).alias("project_type"),
        project_url(base_url, name).alias("github_url"),
    )


def default_globs(spark: SparkSession) -> DataFrame:
    """The catalogue of default ignore globs as a table."""
    return spark.createDataFrame([(t, g) for t, globs in IGNORE_GLOBS.items() for g in globs],
                                 "project_type string, glob string")


def effective_globs(projects: DataFrame, user_globs=()) -> DataFrame:
    """User globs and the defaults of every project type present, each once.

    They hold for all projects of a scan, whatever their own type.
    """
    spark = projects.sparkSession
    types = projects.select("project_type").distinct()
    out = default_globs(spark).join(types, "project_type", "left_semi").select("glob")
    if user_globs:
        out = out.union(spark.createDataFrame([(g,) for g in user_globs], "glob string"))
    return out.distinct()


def collect_globs(projects: DataFrame, user_globs=()) -> list[str]:
    """The effective globs as a list: at most the catalogue plus what the caller gave."""
    return sorted(r["glob"] for r in effective_globs(projects, user_globs).collect())


def assign_projects(files: DataFrame, projects: DataFrame) -> DataFrame:
    """Rows of ``files(root, path, ...)`` that lie in a project, with ``project_path`` and
    ``project_name``. A file lies in its root if that is a project, else in a direct child.

    Roots may overlap: a row belongs to a project of its own root only. Give it narrow rows
    (listings, findings): they are shuffled.
    """
    spread = ("path", "line_number") if "line_number" in files.columns else ("path",)
    paths = projects.select("root", F.col("path").alias("project_path")).distinct()
    selves = paths.where("project_path = root")
    placed = attach(files, selves, "root", spread_by=spread)
    placed = placed.withColumn("project_path", F.coalesce("project_path", child_of(F.col("path"), F.col("root"))))
    known = paths.withColumn("is_project", F.lit(True))
    placed = attach(placed, known, ("root", "project_path"), spread_by=spread).where("is_project").drop("is_project")
    return placed.withColumn("project_name", base_name(F.col("project_path")))


def child_of(path: Column, root: Column) -> Column:
    """The directory or file directly below ``root`` that ``path`` is or lies in."""
    first = F.substring_index(relative_path(path, root), "/", 1)
    return F.concat(F.rtrim(root, F.lit("/")), F.lit("/"), first)


def count_own_findings(projects: DataFrame, findings: DataFrame) -> DataFrame:
    """``projects`` with ``findings_count``, each project's own: by scan root and project path."""
    counts = findings.groupBy("root", F.col("project_path").alias("path")).agg(F.count("*").alias("findings_count"))
    rest = [c for c in projects.columns if c != "findings_count"]
    return (projects.select(*rest).join(counts, ["root", "path"], "left")
            .select(*rest, F.coalesce("findings_count", F.lit(0)).cast("bigint").alias("findings_count")))


def count_findings(projects: DataFrame, findings: DataFrame) -> DataFrame:
    """``projects`` with ``findings_count`` by project name, zero where there are none: the recount of filters.

    Findings are counted before they meet the projects, so a project holding most of
    them adds one row to the join like any other.
    """
    counts = findings.groupBy("project_name").agg(F.count("*").alias("findings_count"))
    rest = [c for c in projects.columns if c != "findings_count"]
    return (projects.select(*rest).join(counts, projects["name"] == counts["project_name"], "left")
            .select(*rest, F.coalesce("findings_count", F.lit(0)).cast("bigint").alias("findings_count")))
