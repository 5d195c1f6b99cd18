"""A whole scan as one plan: files in, projects and findings out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from beaconaudit.functions import urls
from beaconaudit.operators.findings import detect
from beaconaudit.operators.joins import attach
from beaconaudit.operators.lines import CONTEXT
from beaconaudit.operators.store import stored
from beaconaudit.rules import LIVE, Rulebook
from beaconaudit.sources import corpus, overlaps, projects as project_source
from beaconaudit.sources.repos import repository_info

FINDING_COLUMNS = (
    "file_path", "line_number", "code_snippet", "operation_type", "data_being_sent", "data_category",
    "context_lines", "github_url", "project_name", "extracted_parameters",
)
# What a scan adds: where a finding's project is, which tells projects of one name apart.
PLACE_COLUMNS = ("root", "project_path")


@dataclass
class ScanResult:
    projects: DataFrame
    findings: DataFrame
    total_files: DataFrame


def _linked(found: DataFrame, repo_meta: DataFrame | None, base_url: str, default_branch: str, wanted) -> DataFrame:
    """Adds links and project names to ``found(project_path, path, line_number, ...)``, as far as they are wanted."""
    found = found.withColumnRenamed("path", "file_path")
    if "project_name" in wanted:
        found = found.withColumn("project_name", urls.base_name(F.col("project_path")))
    if "github_url" not in wanted:
        return found
    branch = F.lit(default_branch)
    if repo_meta is not None:
        # one row per project, whatever the table holds
        branches = repository_info(repo_meta, default_branch).groupBy("project_path").agg(F.min("branch").alias("branch"))
        found = attach(found, branches, "project_path", spread_by=("file_path", "line_number"))
        branch = F.coalesce("branch", branch)
    return found.withColumn("github_url", urls.file_url(
        base_url, F.col("file_path"), F.col("line_number"), urls.parent(F.col("project_path")), branch))


def _built(wanted) -> tuple[str, ...]:
    return (*wanted, "line_number")


def scan_files(files: DataFrame, repo_meta: DataFrame | None = None, *, base_url: str,
               default_branch: str = urls.DEFAULT_BRANCH, globs=(), rulebook: Rulebook = LIVE,
               context: int = CONTEXT, wanted: tuple[str, ...] = FINDING_COLUMNS, observation: Observation | None = None) -> DataFrame:
    """Findings of ``files(project_path, path, content)``, content being text or bytes.

    Filters run cheapest first: extension and globs see only the path, then the keyword
    test sees the text, then lines are made. Branches are looked up for findings, not
    for files, so file contents never move. ``wanted`` names the columns to build.
    ``observation`` gets ``total_files_scanned`` on the way, once the findings have been written or collected, so
    totals need no pass of their own.
    """
    counted = corpus.eligible(files, globs, rulebook)
    if observation is not None:
        counted = counted.observe(observation, F.count(F.lit(1)).alias("total_files_scanned"))
    eligible = corpus.decoded(counted).where(F.length("content") > 0)
    found = detect(corpus.keyword_filter(eligible), rulebook, context, _built(wanted))
    return _linked(found, repo_meta, base_url, default_branch, wanted).select(*wanted)


def total_files(files: DataFrame, globs=(), rulebook: Rulebook = LIVE) -> DataFrame:
    """Files a scan looked at: routed and not ignored, empty and unreadable ones included."""
    return corpus.eligible(files, globs, rulebook).agg(F.count("*").alias("total_files_scanned"))


def near_root(path: Column, root: Column) -> Column:
    """True for entries of a root and of its direct children: where a project's manifest lies."""
    return F.size(F.split(corpus.relative_path(path, root), "/")) <= 2


def readable(files: DataFrame, globs, rulebook: Rulebook = LIVE) -> DataFrame:
    """``files(root, path, ...)`` of a scanned language that not every reading of the globs ignores."""
    return corpus.route(files, rulebook).drop("language").where(~corpus.surely_ignored(globs))


def each_once(files: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``files(root, path, content)`` with every file under one root only, and which files other roots share (None: no path is listed twice).

    Where paths are listed under several roots, files get a ``digest``: rows are one file if path and content agree.
    """
    files = files.where(F.col("content").isNotNull())
    if not overlaps.overlap(files.select("root", "path")):
        return files, None
    files = files.withColumn("digest", overlaps.digest_of(F.col("content")))
    rows = stored(files.select("root", "path", "digest"))
    shared = stored(overlaps.shared_files(rows))
    return overlaps.read_once(files, rows, shared), shared


def scan(listing: DataFrame, files: DataFrame, repo_meta: DataFrame | None = None, *, base_url: str,
         manifests: DataFrame | None = None, user_globs=(), rulebook: Rulebook = LIVE, **options) -> ScanResult:
    """Projects, findings and totals of ``listing(root, path, is_dir)`` and
    ``files(root, path, content)``, content being text or bytes.

    ``manifests(project_path, content)`` holds the projects' package.json texts; without
    it they are picked from ``files``, from places where a project's manifest lies.

    Roots may overlap: each has its own projects and findings, as often as it is given, but a file that
    several of them hold is searched once (``overlaps``). Findings are
    detected first and placed in projects afterwards, so a file's text is joined to
    nothing; what every reading of the globs ignores goes before. Projects and findings
    are stored, findings with ``root`` and ``project_path``; counts read what is stored.
    """
    if manifests is None:
        near = near_root(F.col("path"), F.col("root")) & F.col("path").endswith("/" + project_source.MANIFEST)
        manifests = corpus.decoded(files.where(near)).select(urls.parent(F.col("path")).alias("project_path"), "content")
    projects = stored(project_source.discover(listing, manifests, base_url))
    globs = project_source.collect_globs(projects, user_globs)
    texts, shared = each_once(readable(files.select("root", "path", "content"), globs, rulebook))
    return _scanned(listing, texts, shared, projects, globs, repo_meta, base_url, rulebook, **options)


def _scanned(listing: DataFrame, texts: DataFrame, shared: DataFrame | None, projects: DataFrame, globs, repo_meta: DataFrame | None,
             base_url: str, rulebook: Rulebook, default_branch: str = urls.DEFAULT_BRANCH, context: int = CONTEXT,
             wanted: tuple[str, ...] = FINDING_COLUMNS) -> ScanResult:
    """The scan of files that are each under one root, ``shared`` being the other roots they belong to."""
    texts = corpus.decoded(texts).where(F.length("content") > 0)
    found = detect(corpus.keyword_filter(texts), rulebook, context, _built(wanted))
    if shared is not None:
        found = overlaps.to_all_roots(found, shared)
    found = corpus.ignore_filter(project_source.assign_projects(found, projects).drop("project_name"), globs)
    findings = stored(_linked(found, repo_meta, base_url, default_branch, wanted).select(*wanted, *PLACE_COLUMNS))

    paths = corpus.route(listing.where(~F.col("is_dir")).select("root", "path"), rulebook).drop("language")
    listed = project_source.assign_projects(paths, projects)
    return ScanResult(project_source.count_own_findings(projects, findings), findings, total_files(listed, globs, rulebook))


def scan_directories(spark: SparkSession, roots, repo_meta: DataFrame | None = None, *, base_url: str, user_globs=(),
                     rulebook: Rulebook = LIVE, **options) -> ScanResult:
    """Scans mounted directories, names starting with ``_`` or ``.`` included.

    The tree is walked once and its listing stored; only manifests of possible projects
    and files of a scanned language are opened, and each of them once, however many roots hold it.
    """
    listing = stored(corpus.list_tree(spark, roots))
    near = listing.where(F.col("path").endswith("/" + project_source.MANIFEST) & near_root(F.col("path"), F.col("root")))
    manifests = corpus.decoded(corpus.read_listed(near)).select(urls.parent(F.col("path")).alias("project_path"), "content")
    entries = listing.select("root", "path", "is_dir")
    projects = stored(project_source.discover(entries, manifests, base_url))
    globs = project_source.collect_globs(projects, user_globs)
    sources, shared = readable(listing.where(~F.col("is_dir")), globs, rulebook), None
    if overlaps.overlap(sources.select("root", "path")):
        rows = stored(sources.select("root", "path", F.lit("").alias("digest")))  # on a disk a path is one file
        shared = stored(overlaps.shared_files(rows))
        sources = overlaps.read_once(sources, rows, shared)
    texts = corpus.read_listed(sources).where(F.col("content").isNotNull())
    texts = texts if shared is None else texts.withColumn("digest", F.lit(""))
    return _scanned(entries, texts, shared, projects, globs, repo_meta, base_url, rulebook, **options)
