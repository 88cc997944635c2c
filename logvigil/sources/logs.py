"""Reading log files and pasted log text (S1..S5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from logvigil.constants import (
    BINARY_MAGIC, BINARY_SAMPLE_BYTES, COLUMN_ALIASES, MAX_FILE_BYTES, MAX_TEXT_CHARS,
    REQUIRED_LOG_COLUMNS, UPLOAD_SOURCES,
)
from logvigil.functions.text import settle, strip

INV = "investigation_id"
PASTED_NAME = "pasted-text"
SURPLUS = "A row has more cells than the header"
_WHOLE = "_whole_record"

# --- fixed values: cell texts that mean "missing" in a log CSV ---
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_logs(spark: SparkSession, path: str, multi_line: bool = False, surplus: str = "fail") -> DataFrame:
    """CSV files that share one header, every column as text.

    Splittable, so it suits files of any size.  A file whose header differs, also
    in the order of its columns, fails the job; for uploads with headers of their own
    use ``read_log_files``.  Line breaks inside quotes need ``multi_line``, which reads
    each file in one task.  A row with more cells than the header fails the job too; with
    ``surplus="mark"`` it stays, and ``reject_reason`` says so.  Missing cells are null.
    """
    options = {"header": True, "escape": '"', "enforceSchema": False, "multiLine": multi_line,
               "pathGlobFilter": "*.[cC][sS][vV]", "columnPruning": False}
    names = spark.read.options(**options).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*names, _WHOLE)])
    frame = spark.read.options(**options, columnNameOfCorruptRecord=_WHOLE).schema(schema).csv(path)
    # Spark reads the whole record only beside another column, so one is looked at too
    beside = F.length(F.coalesce(F.col(f"`{names[0]}`"), F.lit(""))) >= 0
    too_many = F.coalesce((F.size(_fields(F.col(_WHOLE))) > len(names)) & beside, F.lit(False))
    cells = [missing_to_null(F.col(f"`{c}`")).alias(c) for c in names]
    if surplus == "mark":
        return frame.select(*cells, F.when(too_many, SURPLUS).alias("reject_reason"))
    return frame.where(F.when(too_many, F.raise_error(F.lit(SURPLUS)).cast("boolean")).otherwise(True)).select(*cells)


def missing_to_null(c: Column) -> Column:
    return F.when(~c.isin(*MISSING_TEXTS), c)


def safe_name(path: Column) -> Column:
    """The last part of a path with either slash; null when there is none."""
    name = strip(F.regexp_extract(
        F.regexp_replace(strip(path), r"[/\\]+$", ""), r"[^/\\]*$", 0
    ))
    return F.when(~name.isin("", ".", ".."), name)


def upload_source(name: Column) -> Column:
    """Csv or excel by extension; null for other types."""
    extension = F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))
    source = F.lit(None).cast("string")
    for suffix, kind in UPLOAD_SOURCES.items():
        source = F.when(extension == suffix, F.lit(kind)).otherwise(source)
    return source


def with_provenance(df: DataFrame, path_col: str = "path") -> DataFrame:
    """Filename, upload_source and the reason to reject, if any."""
    named = df.withColumn("filename", safe_name(F.col(path_col)))
    typed = named.withColumn("upload_source", upload_source(F.col("filename")))
    reason = F.when(F.col("filename").isNull(), "A valid filename is required").when(
        F.col("upload_source").isNull(),
        "Unsupported file type. Supported types are .csv, .xlsx and .xls",
    )
    return typed.withColumn("reject_reason", reason)


def size_gate(df: DataFrame, max_bytes: int = MAX_FILE_BYTES, max_chars: int = MAX_TEXT_CHARS,
              length_col: str = "length", text_col: str = "text") -> DataFrame:
    """The reason to reject rows whose file or text is too large."""
    reason = F.lit(None).cast("string")
    if length_col in df.columns:
        reason = F.when(F.col(length_col) > max_bytes, "File exceeds the upload limit")
    if text_col in df.columns:
        reason = F.coalesce(
            reason, F.when(F.length(text_col) > max_chars, "Text exceeds the character limit")
        )
    return df.withColumn("size_reason", reason)


def looks_binary(content: Column) -> Column:
    """S3: a NUL byte or a known binary signature in the first 4096 bytes."""
    sample = F.substring(content, 1, BINARY_SAMPLE_BYTES)
    hit = F.contains(sample, F.lit(b"\0"))
    for magic in BINARY_MAGIC:
        hit = hit | F.startswith(sample, F.lit(magic))
    return hit


def reject_binary(files: DataFrame) -> DataFrame:
    """S3: the reason to reject files named .csv that hold binary content.

    ``files`` is the output of the binaryFile source.
    """
    is_csv = F.lower(F.col("path")).endswith(".csv")
    return files.withColumn(
        "binary_reason",
        F.when(is_csv & looks_binary(F.col("content")), "CSV upload contains unsupported binary content"),
    )


def _records(text: Column) -> Column:
    """Lines of a CSV text; a newline inside quotes does not end a line."""
    unified = F.regexp_replace(F.regexp_replace(text, r"\A\x{FEFF}", ""), r"\r\n?", "\n")
    plain = F.split(unified, "\n")
    quoted = F.regexp_extract_all(
        unified, F.lit(r'((?:[^"\n]++|"(?:[^"]++|"")*+"|")++)'), F.lit(1)
    )
    lines = F.when(unified.contains('"'), quoted).otherwise(plain)
    return F.filter(lines, lambda x: F.trim(x) != "")


def _fields(line: Column) -> Column:
    """Cells of a CSV line, with quotes removed."""
    # a leading comma makes every cell start the same way
    cells = F.regexp_extract_all(
        F.concat(F.lit(","), line), F.lit(r',("(?:[^"]++|"")*+"[^,]*+|[^,]*+)'), F.lit(1)
    )
    unquoted = F.transform(
        cells,
        lambda c: F.when(
            c.startswith('"'),
            F.regexp_replace(F.regexp_replace(c, r'^"((?:[^"]++|"")*+)"(.*)$', "$1$2"), '""', '"'),
        ).otherwise(c),
    )
    return F.when(line.contains('"'), unquoted).otherwise(F.split(line, ",", -1))


def _passing_names(places: list[str]) -> Column:
    """Names of the columns that pass through; null for those that serve a canonical name.

    A name that occurred before, or is a canonical name already served, gets a
    ``__dupN`` suffix, as ``rename_columns`` does it.
    """
    used = F.array(*[F.col(p) for p in places])
    passing = F.transform("_header", lambda name, i: F.when(
        ~F.array_contains(used, (i + 1).cast("bigint")), name))
    served = F.array_compact(F.array(*[F.when(F.col(p) > 0, F.lit(p.removeprefix("_at_"))) for p in places]))
    before = lambda names, name, i: F.size(F.filter(
        F.concat(served, F.slice(names, F.lit(1), i)), lambda x: x == name))
    return F.transform(passing, lambda name, i: F.when(
        before(passing, name, i) > 0,
        F.concat(name, F.lit("__dup"), before(passing, name, i).cast("string")),
    ).otherwise(name))


def parse_text_logs(documents: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows of many CSV texts, each with a header of its own.

    ``documents`` has investigation_id and the text.  The header travels with
    its lines, so texts with any number of different headers are parsed in one
    pass, without a look at them from the driver.  Returns the raw log table
    (canonical columns as text, the other columns in the map ``extra``) and the
    rejected documents with the reason.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lined = settle(documents, {"_lines": _records(text)})
    lined = settle(lined, {"_table": F.transform("_lines", _fields)})
    first = F.coalesce(F.get("_table", F.lit(0)), F.array().cast("array<string>"))
    lined = settle(lined, {"_header": F.transform(first, lambda c: F.lower(strip(c)))})
    # position of the column that serves each canonical name, 0 when there is none; an
    # intersection keeps the order of its first array, so the name of highest rank comes first
    places = {
        f"_at_{canonical}": F.coalesce(F.array_position("_header", F.get(F.array_intersect(
            F.array(*[F.lit(n) for n in (canonical, *aliases)]), F.col("_header")), F.lit(0))), F.lit(0).cast("bigint"))
        for canonical, aliases in COLUMN_ALIASES.items()
    }
    placed = settle(settle(lined, places), {"_names": _passing_names(list(places))})
    missing = F.array_join(F.array_compact(F.array(*[
        F.when(F.col(f"_at_{c}") == 0, F.lit(c)) for c in REQUIRED_LOG_COLUMNS
    ])), ", ")
    too_long = F.exists("_table", lambda x: F.size(x) > F.size("_header"))
    reason = (
        F.when(strip(text) == "", "Log text must not be empty")
        .when(too_long, "Unable to parse pasted CSV log text")
        .when(missing != "", F.concat(F.lit("Missing required columns: "), missing))
    )
    checked = settle(placed, {"reject_reason": reason})
    rejected = checked.where(F.col("reject_reason").isNotNull()).select(INV, "reject_reason")

    rows = (
        checked.where(F.col("reject_reason").isNull())
        .select(INV, "_names", *places, F.posexplode(F.expr("slice(_table, 2, size(_table))"))
                .alias("line_number", "_raw"))
    )
    rows = settle(rows, {"_cells": F.transform("_raw", missing_to_null)})
    extra = F.map_from_entries(F.filter(
        F.transform("_names", lambda name, i: F.when(
            name.isNotNull(), F.struct(name.alias("key"), F.get("_cells", i).alias("value")),
        )),
        lambda e: e.isNotNull(),
    ))
    cell = lambda c: F.when(F.col(f"_at_{c}") > 0, F.get("_cells", F.col(f"_at_{c}") - 1))
    logs = rows.select(
        INV, F.col("line_number").cast("long").alias("line_number"),
        *[cell(c).alias(c) for c in COLUMN_ALIASES],
        extra.alias("extra"),
    )
    return logs, rejected


def read_log_files(spark: SparkSession, path: str,
                   max_bytes: int = MAX_FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """S1, S3..S5 for a folder of uploads with differing headers.

    Each accepted file becomes one investigation.  Returns the raw log rows and
    the rejected files with the reason.  Names and sizes are judged from the
    listing alone; only files of ``max_bytes`` at most are opened, so
    reading one whole is bounded.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    listed = size_gate(with_provenance(files.drop("content")), max_bytes=max_bytes)
    by_name = F.coalesce(
        "reject_reason", "size_reason",
        F.when(F.col("upload_source") == "excel", "Convert Excel files to CSV first"),
    )
    opened = with_provenance(files.where(F.col("length") <= max_bytes)).where(
        F.col("upload_source") == "csv"
    )
    text = F.col("content").cast("string")
    read = reject_binary(opened).select(
        F.sha1("path").alias(INV), "path", text.alias("text"),
        F.coalesce("binary_reason", F.when(~F.is_valid_utf8(text), "Unable to read .csv log file"))
        .alias("reject_reason"),
    )
    texts = read.where(F.col("reject_reason").isNull()).select(INV, "path", "text")
    logs, unparsed = parse_text_logs(texts)
    rejected = (
        listed.select(F.sha1("path").alias(INV), "path", by_name.alias("reject_reason"))
        .unionByName(read.select(INV, "path", "reject_reason"))
        .where(F.col("reject_reason").isNotNull())
        .unionByName(
            unparsed.join(listed.select(F.sha1("path").alias(INV), "path"), INV)
            .select(INV, "path", "reject_reason")
        )
    )
    return logs, rejected
