"""Filters, counts and orderings over findings. Findings are a bag: nothing is made distinct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from beaconaudit.functions.urls import base_name
from beaconaudit.operators.joins import attach_measured
from beaconaudit.operators.store import stored
from beaconaudit.rules import DATA_TYPES
from beaconaudit.sources.projects import count_findings

GROUPINGS = {"project": "project_name", "category": "data_category", "operation": "operation_type"}
# Labels the search also looks at.
LABEL_LINE, LABEL_DATA, LABEL_LINK, LABEL_COPY = "Line ", "Data Being Sent:", "View on GitHub", "Copy Code"


def by_project(findings: DataFrame, name: str) -> DataFrame:
    return findings.where(F.col("project_name") == name)


def by_category(findings: DataFrame, category: str) -> DataFrame:
    return findings.where(F.col("data_category") == category)


def by_operation(findings: DataFrame, operation: str) -> DataFrame:
    return findings.where(F.col("operation_type") == operation)


def filter_data_type(findings: DataFrame, projects: DataFrame, data_type: str | None):
    """Findings of one data type and all projects, recounted. Unknown types change nothing."""
    category = DATA_TYPES.get(data_type or "")
    if category is None:
        return findings, projects
    kept = by_category(findings, category)
    return kept, count_findings(projects, kept)


def filter_project(findings: DataFrame, projects: DataFrame, name: str | None):
    """Findings and projects of one name, recounted."""
    if not name:
        return findings, projects
    kept = by_project(findings, name)
    return kept, count_findings(projects.where(F.col("name") == name), kept)


def page_json(record: Column) -> Column:
    """A map as the report page shows it: keys sorted, one per line, ASCII only, ``<>&'`` written as escapes."""
    def scalar(value: Column) -> Column:
        text = F.to_json(F.array(value), {"writeNonAsciiCharacterAsCodePoint": "true"})
        text = F.substring(text, F.lit(2), F.length(text) - 2)
        for char in "<>&'\x7f":
            text = F.replace(text, F.lit(char), F.lit(f"\\u{ord(char):04x}"))
        return text

    lines = F.transform(F.sort_array(F.map_entries(record)), lambda e: F.concat(
        F.lit("  "), scalar(e["key"]), F.lit(": "), scalar(e["value"])))
    return F.concat(F.lit("{\n"), F.array_join(lines, ",\n"), F.lit("\n}"))


def search_text(data_json: Column) -> Column:
    """The words a finding is shown with. The last context line is not shown."""
    context = F.slice("context_lines", F.lit(1), F.greatest(F.size("context_lines") - 1, F.lit(0)))
    has_data = F.size("data_being_sent") > 0
    return F.concat_ws(
        " ", base_name(F.col("file_path")), "operation_type",
        F.concat(F.lit(LABEL_LINE), F.col("line_number").cast("string")),
        F.array_join(context, " "), "code_snippet",
        F.when(has_data, F.lit(LABEL_DATA)), F.when(has_data, data_json),
        F.lit(LABEL_LINK), F.lit(LABEL_COPY))


def shown_text(findings: DataFrame) -> Column:
    """What ``search`` looks for a term in."""
    return F.lower(search_text(page_json(F.col("data_being_sent"))))


def search(findings: DataFrame, term: str = "", project: str = "", category: str = "", operation: str = "",
           shown: Column | None = None) -> DataFrame:
    """All given conditions must hold; blank ones do not count. The equalities come first,
    so text is put together only for rows they leave. ``shown`` is that text where it has been kept."""
    out = findings
    for column, value in (("project_name", project), ("data_category", category), ("operation_type", operation)):
        if value:
            out = out.where(F.col(column) == value)
    if term:
        out = out.where((shown_text(findings) if shown is None else shown).contains(term.lower()))
    return out


def statistics(findings: DataFrame) -> DataFrame:
    """Counts by project, category and operation, the total, and distinct files, in one pass.

    ``dimension`` says which grouping a row belongs to. Counting distinct files goes
    through (group, file) pairs that are spread by file, so a hot project is no hot task.
    """
    keys = list(GROUPINGS.values())
    counted = findings.select(*keys, "file_path").groupingSets(
        [[k] for k in keys] + [[]], *keys,
    ).agg(F.count("*").alias("findings"), F.count_distinct("file_path").alias("files"),
          F.grouping_id().alias("gid"))
    bits = {3: "project", 5: "category", 6: "operation", 7: "total"}
    dimension = None
    for gid, name in bits.items():
        dimension = F.when(F.col("gid") == gid, name) if dimension is None else dimension.when(F.col("gid") == gid, name)
    return counted.select(dimension.alias("dimension"), F.coalesce(*keys).alias("value"), "findings", "files")


def statistics_sketch(findings: DataFrame) -> DataFrame:
    """``statistics`` with a sketch of the files in place of their number: what a scan keeps so that later ones can be added.

    A sketch has a bounded size whatever it has seen (some 4 kB at 2 ** 12 counters); the number it gives is off by
    1.6 % of the true one, as a standard deviation, and exact for small groups.
    """
    keys = list(GROUPINGS.values())
    counted = findings.select(*keys, "file_path").groupingSets([[k] for k in keys] + [[]], *keys).agg(
        F.count("*").alias("findings"), F.hll_sketch_agg("file_path", F.lit(12)).alias("sketch"), F.grouping_id().alias("gid"))
    named = F.create_map(*(x for gid, name in ((3, "project"), (5, "category"), (6, "operation"), (7, "total")) for x in (F.lit(gid), F.lit(name))))
    return counted.select(F.element_at(named, F.col("gid").cast("int")).alias("dimension"), F.coalesce(*keys).alias("value"), "findings", "sketch")


def merged_statistics(*sketches: DataFrame) -> DataFrame:
    """Counts of several scans together from their sketches alone: (dimension, value, findings, files), files being estimates."""
    every = union_scans(*sketches)
    return every.groupBy("dimension", "value").agg(
        F.sum("findings").alias("findings"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("files"))


def grouped_rows(findings: DataFrame, by: str) -> DataFrame:
    """All findings, grouped: rows of a group are next to each other and carry its size.

    A group is never held in one row. Findings are stored once, since they are read for
    the counts, for the sort's sample and for the result. The sort ranges over group,
    file and line, so a large group fills many partitions.
    """
    key = GROUPINGS[by]
    findings = stored(findings)
    sizes = findings.groupBy(key).agg(F.count("*").alias("group_size"))
    return attach_measured(findings, sizes, key, spread_by=("file_path", "line_number"), how="inner").orderBy(
        key, "file_path", "line_number")


def files_with_findings(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count_distinct("file_path").alias("files_with_findings"))


def category_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("data_category").agg(F.count("*").alias("findings")).orderBy("data_category")


def scan_totals(projects: DataFrame, findings: DataFrame, total_files: DataFrame) -> DataFrame:
    """The totals of a scan, one row each."""
    def row(metric: str, counted: DataFrame) -> DataFrame:
        return counted.toDF("value").select(F.lit(metric).alias("metric"), "value")

    return (row("projects", projects.agg(F.count("*")))
            .union(row("files_scanned", total_files))
            .union(row("findings", findings.agg(F.count("*")))))


def report_order(findings: DataFrame, projects: DataFrame) -> DataFrame:
    """Findings under their project's heading, by file and line.

    Two projects of one name both show the findings of that name.
    """
    heads = projects.select(F.col("name").alias("project_name"), "project_type", F.col("path").alias("project_path"))
    rest = [c for c in findings.columns if c not in ("project_type", "project_path")]
    return attach_measured(stored(findings.select(*rest)), heads, "project_name", spread_by=("file_path", "line_number"), how="inner").orderBy(
        "project_name", "project_path", "file_path", "line_number")


def union_scans(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Findings of several scans together. Overlapping scans report a line more than once."""
    for other in others:
        first = first.unionByName(other)
    return first
