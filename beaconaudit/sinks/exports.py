"""Exports. Every sink writes from the executors; nothing is gathered into one row or task."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from beaconaudit.operators import report
from beaconaudit.operators.store import PACKED, stored
from beaconaudit.plans.scan import FINDING_COLUMNS

PROJECT_COLUMNS = ("name", "path", "project_type", "github_url", "findings_count")

# The table export's columns, in order.
TABLE_COLUMNS = ("Project", "File Path", "Line Number", "Operation Type", "Data Category", "Code Snippet",
                 "Data Being Sent", "GitHub URL")


#: Items of a document that one task makes distinct, about.
ITEM_ROWS = 50_000
#: Bytes of findings that one task of a report sorts, about, and files a grouping may have without its groups being brought together.
TASK_BYTES, MOST_FILES = 32 << 20, 20_000


def json_scalar(value: Column) -> Column:
    """A string as JSON text: quoted and escaped, or ``null``."""
    text = F.to_json(F.array(value))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def json_object(record: Column) -> Column:
    """A map as JSON text with a blank after commas and colons."""
    pairs = F.transform(F.map_entries(record), lambda e: F.concat(
        json_scalar(e["key"]), F.lit(": "), json_scalar(e["value"])))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def table_rows(findings: DataFrame) -> DataFrame:
    cells = ("project_name", "file_path", "line_number", "operation_type", "data_category", "code_snippet")
    values = [F.col(c) for c in cells] + [json_object(F.col("data_being_sent")), F.col("github_url")]
    return findings.select(*[v.alias(n) for v, n in zip(values, TABLE_COLUMNS)])


def exported(frame: DataFrame, columns: tuple[str, ...]) -> list[str]:
    """The columns an export has; what a scan adds to tell places apart stays out."""
    return [c for c in columns if c in frame.columns]


def row_json(frame: DataFrame, columns: tuple[str, ...]) -> Column:
    return F.to_json(F.struct(*exported(frame, columns)), {"ignoreNullFields": "false"})


def finding_json(findings: DataFrame) -> Column:
    return row_json(findings, FINDING_COLUMNS)


def write_csv(findings: DataFrame, path: str) -> None:
    (table_rows(findings).write.mode("errorifexists").option("header", True).option("escape", '"')
     .option("quote", '"').csv(path))


def write_json(findings: DataFrame, projects: DataFrame, path: str) -> None:
    """One JSON object per line, findings and projects in their own folders."""
    for frame, name, columns in ((findings, "findings", FINDING_COLUMNS), (projects, "projects", PROJECT_COLUMNS)):
        frame.select(*exported(frame, columns)).write.mode("errorifexists").option("ignoreNullFields", False).json(f"{path}/{name}")


def document_lines(projects: DataFrame, findings: DataFrame, total_files: DataFrame, seconds: float) -> DataFrame:
    """The whole scan as one JSON document in pieces, one line of text per row.

    Rows sort by ``document_order()``; joined in that order they are one document.
    Commas lead, so a row needs to know only whether it is its list's first, which is
    found by a minimum. Equal rows are told apart by a number within their equals.
    Projects and findings are counted and read twice, so they should be tables.
    """
    def items(frame: DataFrame, section: int, keys: list[str], columns: tuple[str, ...]) -> DataFrame:
        place = [F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)]
        number = F.col(keys[-1]).cast("bigint") if keys[-1] == "line_number" else F.lit(0).cast("bigint")
        rows = frame.select(*place[:2], number.alias("number"), row_json(frame, columns).alias("text"))
        keys = ("k0", "k1", "number", "text")
        here = F.struct(*keys)
        lead = F.when(here == rows.agg(F.min(here)).scalar(), "").otherwise(",")
        # identical rows become one row with a count; tasks grow in number with the rows, so what one holds does not
        tasks = max(1, -(-frame.count() // ITEM_ROWS))
        rows = rows.repartition(tasks, *keys).groupBy(*keys).agg(F.count("*").alias("copies"))
        marked = rows.withColumn("lead", lead)
        more = F.transform(F.sequence(F.lit(1).cast("bigint"), "copies"),
                           lambda i: F.concat(F.when(i == 1, F.col("lead")).otherwise(","), F.col("text")))
        return marked.select(F.lit(section).alias("section"), "k0", "k1", "number",
                             F.posexplode(more).alias("copy", "line"))

    def fixed(section: int, text: Column, frame: DataFrame | None = None) -> DataFrame:
        base = projects.sparkSession.range(1) if frame is None else frame
        nothing = F.lit("")
        return base.select(F.lit(section).alias("section"), nothing.alias("k0"), nothing.alias("k1"),
                           F.lit(0).cast("bigint").alias("number"), F.lit(0).alias("copy"), text.alias("line"))

    tail = F.concat(F.lit('],"total_files_scanned":'), F.col("total_files_scanned").cast("string"),
                    F.lit(f',"scan_duration":{seconds!r}}}'))
    return (fixed(0, F.lit('{"projects":['))
            .unionByName(items(projects, 1, ["path", "name"], PROJECT_COLUMNS))
            .unionByName(fixed(2, F.lit('],"findings":[')))
            .unionByName(items(findings, 3, ["project_name", "file_path", "line_number"], FINDING_COLUMNS))
            .unionByName(fixed(4, tail, total_files)))


def document_order() -> list[Column]:
    """Places of the pieces of a document: by section and place, then by text without its comma."""
    text = F.regexp_replace("line", "^,", "")
    return [F.col("section"), F.col("k0"), F.col("k1"), F.col("number"), text, F.col("copy")]


def write_document(projects: DataFrame, findings: DataFrame, total_files: DataFrame, seconds: float,
                   path: str) -> None:
    """Text files that, joined in name order, are one JSON document of the scan."""
    lines = document_lines(stored(projects), stored(findings), total_files, seconds)
    lines.orderBy(*document_order()).select("line").write.mode("errorifexists").text(path)


@contextmanager
def _tasks_of(spark: SparkSession, size: int) -> Iterator[None]:
    """While it lasts, a task of a job reads ``size`` bytes of files, about."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def write_report(findings: DataFrame, projects: DataFrame, total_files: DataFrame, path: str) -> None:
    """The tables a report page reads: statistics, findings grouped three ways, projects, totals.

    Findings are stored once and read back for the rest, so the scan runs once and a
    lost executor costs a task. Every task sorts what it read by group, file and line and writes
    it to its own file of each group: a large group is spread over many files, each in order, and
    no finding is shuffled. Only groupings of very many groups are brought together first, by ranges.
    """
    spark = findings.sparkSession
    findings.write.mode("errorifexists").options(**PACKED, **{"parquet.block.size": TASK_BYTES}).parquet(f"{path}/findings")
    stored = spark.read.parquet(f"{path}/findings")
    report.statistics(stored).write.mode("errorifexists").parquet(f"{path}/statistics")
    groups = {r["dimension"]: r["count"] for r in spark.read.parquet(f"{path}/statistics").groupBy("dimension").count().collect()}
    with _tasks_of(spark, TASK_BYTES):
        for name, column in report.GROUPINGS.items():
            keyed = stored.withColumn("group", F.col(column))
            if groups.get(name, 0) * keyed.rdd.getNumPartitions() > MOST_FILES:
                keyed = keyed.repartitionByRange("group", "file_path", "line_number")
            (keyed.sortWithinPartitions("group", "file_path", "line_number")
             .write.mode("errorifexists").options(**PACKED).partitionBy("group").parquet(f"{path}/by_{name}"))
    projects.write.mode("errorifexists").parquet(f"{path}/projects")
    report.scan_totals(projects, stored, total_files).write.mode("errorifexists").parquet(f"{path}/totals")
