"""CSV register scans with logical row numbers, header checks and missing-register findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom import fixed
from auditloom.operators.findings import Rule, apply_rules, union_all
from auditloom.operators.registers import stage_order
from auditloom.sources.paths import below, project_of

# A quoted cell may hold anything and has its quotes doubled; what follows its closing quote, up to the next
# comma, belongs to it too. A quote inside any other cell is an ordinary character. Repeats never give back
# what they took, so cells and records of any length are matched without recursion.
QUOTED = '"[^"]*+(?:""[^"]*+)*+'
IN_RECORD = rf'(?:{QUOTED}(?:"[^,\r\n]*+)?+|[^",\r\n][^,\r\n]*+|)'
ONE_RECORD = rf"({IN_RECORD}(?:,{IN_RECORD})*+)(?:\r\n|[\r\n]|\z)"
ONE_CELL = rf',({QUOTED}(?:"[^,]*+)?+|[^",][^,]*+|)'
CANDIDATE_OPTIONS = {"multiLine": "true", "escape": '"', "quote": '"', "encoding": "UTF-8", "maxCharsPerColumn": "-1"}


def records_of(text: Column) -> Column:
    """The records of a CSV text. Carriage return, line feed and both end one; blank lines are none."""
    return F.filter(F.regexp_extract_all(text, F.lit(ONE_RECORD), F.lit(1)), lambda r: r != "")


def cells_of(record: Column) -> Column:
    """The cells of one record."""
    def plain(cell: Column) -> Column:
        inner = F.regexp_extract(cell, rf"^({QUOTED})", 1)
        return F.when(F.startswith(cell, F.lit('"')), F.concat(
            F.replace(F.substring(inner, F.lit(2), F.length(inner)), F.lit('""'), F.lit('"')),
            F.substring(cell, F.length(inner) + 2, F.length(cell)))).otherwise(cell)

    return F.transform(F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(ONE_CELL), F.lit(1)), plain)


def scan_cells(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(project_id, row_no, header, cells, surplus) of one register file name over all projects.

    The header counts as record 1. A file with quoted line breaks cannot be cut before it is read,
    so a file is one row, which Spark limits to 2 GB; built-in patterns cut it to records and these
    to cells, whatever their number. Records keep their order in the row, so they are numbered and
    get their header without a join, a sort or a shuffle. ``surplus`` marks files whose first row
    has more cells than the header.
    """
    files = spark.read.text(f"{root.rstrip('/')}/*/{name}", wholetext=True)
    cut = files.select(F.col("_metadata.file_path").alias("file"), records_of(F.make_valid_utf8("value")).alias("records"))
    headed = cut.select("file", "records", cells_of(F.get("records", F.lit(0))).alias("header"),
                        F.coalesce(F.size(cells_of(F.get("records", F.lit(1)))), F.lit(0)).alias("width"))
    rows = headed.select("file", "header", (F.col("width") > F.size("header")).alias("surplus"),
                         F.posexplode(F.slice("records", F.lit(2), F.size("records"))).alias("place", "record"))
    return rows.select(project_of(below(root, F.col("file"))).alias("project_id"), (F.col("place") + 2).cast("long").alias("row_no"),
                       "header", cells_of(F.col("record")).alias("cells"), "surplus")


def value_of(column: Column | str) -> Column:
    """The cell of a named column: of columns of one name the last; null if the file has none."""
    name = F.lit(column) if isinstance(column, str) else column
    place = F.array_position(F.reverse("header"), name).cast("int")
    return F.when(place > 0, F.coalesce(F.get("cells", F.size("header") - place), F.lit("")))


def list_runs(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(run_id, run_ord) of every folder that has the file, with or without rows, in name order."""
    files = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/*/{name}")
    run = project_of(below(root, F.col("path"))).alias("run_id")
    return files.select(run).distinct().withColumn("run_ord", F.col("run_id"))


def expected_headers(spark: SparkSession) -> DataFrame:
    """(contract, register, expected), thirteen fixed rows, marked for broadcast."""
    rows = [(contract, name, columns)
            for (name, contract), columns in fixed.REGISTER_HEADERS.items()]
    return F.broadcast(spark.createDataFrame(
        rows, "contract string, register string, expected array<string>"))


def _judged(cells: DataFrame, projects: DataFrame, name: str) -> DataFrame:
    dim = expected_headers(cells.sparkSession).filter(F.col("register") == name).drop("register")
    legacy = F.array(*[F.lit(c) for c in fixed.DECISION_COLUMNS_LEGACY])
    # Columns of one name are one column to a reader by name; a first row that is longer than the
    # header fits no contract.
    named = F.array_distinct("header")
    exact = named == F.col("expected")
    if name == "decisions.csv":
        fits = exact | ((F.col("contract") != "v0.3") & (named == legacy))
    elif name == "claims.csv":
        fits = F.size(F.array_except("expected", "header")) == 0
    else:
        fits = exact
    return cells.join(projects, "project_id").join(dim, "contract").withColumn(
        "fits", fits & ~F.col("surplus"))


def header_findings(judged: DataFrame, name: str) -> DataFrame:
    """Headers that do not fit, and the domain columns an open register adds."""
    arm = "FEASIBILITY" if name == "feasibility.csv" else "MANIFEST"
    one = judged.groupBy("project_id").agg(
        F.first("fits").alias("fits"), F.first("header").alias("header"),
        F.first("expected").alias("expected"))
    extra = F.array_except("header", "expected")
    return apply_rules(one, arm, [
        Rule("header_differs", ~F.col("fits"), F.array_join("header", ",")),
        Rule("domain_columns", F.col("fits") & F.lit(name == "claims.csv") & (F.size(extra) > 0),
             F.array_join(extra, ", "), "note"),
    ], F.lit(name))


def register_rows(judged: DataFrame, name: str) -> DataFrame:
    """The rows of fitting files as named string columns, never null; extras in a map.

    ``named`` lists the columns the file itself has; the others are filled with ''.
    """
    columns = []
    for (register, _), header in fixed.REGISTER_HEADERS.items():
        if register == name:
            columns += [c for c in header if c not in columns]

    fields = [F.coalesce(value_of(c), F.lit("")).alias(c) for c in columns]
    fields.append(F.array_distinct("header").alias("named"))
    if name == "claims.csv":
        known = F.array(*[F.lit(c) for c in columns])
        extra = F.filter(F.array_distinct("header"), lambda c: ~F.array_contains(known, c))
        fields.append(F.map_from_entries(F.transform(extra, lambda c: F.struct(c, value_of(c)))).alias("extra"))
    return judged.filter("fits").select("project_id", "row_no", "contract", "through_ord", *fields)


def read_register(spark: SparkSession, root: str, name: str, projects: DataFrame,
                  files: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, header findings) of one register for ``projects`` (contract and through_ord).

    ``files`` is the pattern of the file names where they are not the register's own.
    """
    judged = _judged(scan_cells(spark, root, files or name), projects, name)
    return register_rows(judged, name), header_findings(judged, name)


def presence_findings(projects: DataFrame, rows: dict[str, DataFrame], refused: DataFrame,
                      held: DataFrame) -> DataFrame:
    """Registers that are missing, or empty at a stage that needs them.

    ``refused`` holds (project_id, subject_id) of registers whose header did not fit, which are not
    reported a second time as empty. ``held`` is the file listing.
    """
    spark = projects.sparkSession
    frames = []
    for name, frame in rows.items():
        needed = fixed.REGISTER_NEEDED_AT[name]
        dim = expected_headers(spark).filter(F.col("register") == name).select("contract")
        counts = frame.groupBy("project_id").agg(F.count("*").alias("n"))
        there = held.filter(F.col("rel_path") == name).select(
            "project_id", F.lit(True).alias("there"))
        bad = refused.filter(F.col("subject_id") == name).select(
            "project_id", F.lit(True).alias("bad")).distinct()
        state = (projects.join(dim, "contract").join(counts, "project_id", "left")
                 .join(there, "project_id", "left").join(bad, "project_id", "left"))
        missing = F.col("there").isNull()
        empty = ~missing & F.col("n").isNull() & F.col("bad").isNull()
        v03 = F.col("contract") == "v0.3"
        rules = {
            fixed.REGISTER_ARM[name]: [Rule("register_missing", missing & v03)],
            "MANIFEST": [Rule("register_missing", missing & ~v03)],
        }
        if needed is not None:
            early = F.col("through_ord") < stage_order(needed)
            rules["MANIFEST"] += [Rule("register_empty", empty & ~early),
                                  Rule("register_empty_so_far", empty & early, severity="note")]
        frames += [apply_rules(state, arm, some, F.lit(name)) for arm, some in rules.items()]
    return union_all(frames)


def read_decision_runs(spark: SparkSession, root: str, files: str = "decisions.csv") -> DataFrame:
    """Decision registers of several runs, one folder per run, for the diff: any header fits.

    A column the register does not have is null, unlike an empty cell.
    """
    cells = scan_cells(spark, root, files)
    return cells.select(F.col("project_id").alias("run_id"), "row_no",
                        *[value_of(c).alias(c) for c in fixed.DECISION_COLUMNS])


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """The candidate register: nineteen fixed string columns, blanks for nulls."""
    schema = ", ".join(f"{c} string" for c in fixed.CANDIDATE_COLUMNS)
    rows = spark.read.schema(schema).options(**{**CANDIDATE_OPTIONS, "header": "true"}).csv(path)
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in fixed.CANDIDATE_COLUMNS])
