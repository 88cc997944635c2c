"""Bring heterogeneous log tables to the canonical schema (N1..N7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from logvigil.constants import COLUMN_ALIASES, REQUIRED_LOG_COLUMNS
from logvigil.functions.skew import balanced_join
from logvigil.functions.text import settle, strip
from logvigil.session import cut_lineage

BAD_TIMESTAMP = "Unable to parse one or more timestamp values"

# --- fixed values: accepted date layouts by the shape of the text; where a shape has two,
# the first is month-first and the second day-first ---
_CLOCK = "[ H:mm[:ss[.SSSSSS]]]"
_CLOCK_12 = " h:mm[:ss][ ]a"
LAYOUTS = {
    r"^\d{4}-.*[AaPp][Mm]$": (f"yyyy-M-d{_CLOCK_12}",),
    r"^\d{8}$": ("yyyyMMdd",),
    r"^\d{8} \d{6}$": ("yyyyMMdd HHmmss",),
    r"^\d{1,2}/\d{1,2}/\d{4} .*[AaPp][Mm]$": (f"M/d/yyyy{_CLOCK_12}", f"d/M/yyyy{_CLOCK_12}"),
    r"^\d{1,2}/\d{1,2}/\d{2} .*[AaPp][Mm]$": (f"M/d/yy{_CLOCK_12}", f"d/M/yy{_CLOCK_12}"),
    r"^\d{1,2}/\d{1,2}/\d{4}": (f"M/d/yyyy{_CLOCK}", f"d/M/yyyy{_CLOCK}"),
    r"^\d{1,2}/\d{1,2}/\d{2}(?!\d)": (f"M/d/yy{_CLOCK}", f"d/M/yy{_CLOCK}"),
    r"^\d{1,2}-\d{1,2}-\d{4}": (f"M-d-yyyy{_CLOCK}", f"d-M-yyyy{_CLOCK}"),
    r"^\d{1,2}[.]\d{1,2}[.]\d{4}": (f"M.d.yyyy{_CLOCK}", f"d.M.yyyy{_CLOCK}"),
    r"^\d{4}/": (f"yyyy/M/d{_CLOCK}",),
    r"^\d{1,2} [A-Za-z]{3} ": (f"d MMM yyyy{_CLOCK}",),
    r"^\d{1,2} [A-Za-z]": (f"d MMMM yyyy{_CLOCK}",),
    r"^\d{1,2}-[A-Za-z]": (f"d-MMM-yyyy{_CLOCK}",),
    r"^[A-Za-z]{3} ": (f"MMM d yyyy{_CLOCK}",),
    r"^[A-Za-z]": (f"MMMM d yyyy{_CLOCK}",),
}
_ZONE = r"(?i)(?<=\d)\s*(Z|GMT|UTC|[+-]\d{2}:?\d{2})$"
_DECIMAL = r"(?i)^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf|infinity)\s*$"

def column_mapping(columns: Sequence[str]) -> dict[str, str]:
    """Source column -> canonical name.

    A column already bearing the canonical name goes first, then the aliases in
    their listed order.  A source column serves one canonical name only.
    """
    cleaned = [c.strip().lower() for c in columns]
    taken: dict[int, str] = {}
    for canonical, aliases in COLUMN_ALIASES.items():
        ranked = [
            i for wanted in (canonical, *aliases)
            for i, name in enumerate(cleaned) if name == wanted and i not in taken
        ]
        if ranked:
            taken[ranked[0]] = canonical
    return {columns[i]: canonical for i, canonical in taken.items()}


def rename_columns(df: DataFrame) -> DataFrame:
    """Canonical names for mapped columns, all others pass through.

    Spark resolves names without letter case, so a second column whose name
    differs only in case (or collides with a canonical name) gets a ``__dupN``
    suffix.
    """
    mapping = column_mapping(df.columns)
    positions = {c: i for i, c in reversed(list(enumerate(df.columns)))}
    mapped = {positions[source]: name for source, name in mapping.items()}
    used = {name: 0 for name in mapped.values()}
    names = []
    for i, original in enumerate(df.columns):
        name = mapped.get(i)
        if name is None:
            key = original.lower()
            if key in used:
                used[key] += 1
                name = f"{original}__dup{used[key]}"
            else:
                used[key] = 0
                name = original
        names.append(name)
    return df.toDF(*names)


def check_columns(df: DataFrame, required: Sequence[str] = REQUIRED_LOG_COLUMNS) -> None:
    """Raise with the missing names in canonical order."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")


def trim_strings(df: DataFrame) -> DataFrame:
    """Strip white space from every string column."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: strip(F.col(f"`{c}`")) for c in strings})


def _plain(value: Column) -> Column:
    """Without a weekday in front; a comma that starts the fraction becomes a point."""
    return F.regexp_replace(
        F.regexp_replace(value, r"^[A-Za-z]{3,9}, +(?=\d)", ""), r"(:\d{2}),(\d{1,6})", "$1.$2")


def _clock(plain: Column) -> tuple[Column, Column]:
    """The text in local time, and the zone behind its clock."""
    clocked = plain.rlike(r"\d:\d{2}|^\d{8}T")
    zone = F.when(clocked, F.upper(F.regexp_extract(plain, _ZONE, 1)))
    local = F.when(clocked, F.regexp_replace(plain, _ZONE, "")).otherwise(plain)
    return F.regexp_replace(F.regexp_replace(local, r"(?<=\d)T(?=\d)", " "), r"(?<=[A-Za-z0-9]),(?= )", ""), zone


def _layout(local: Column) -> Column:
    """The layout of a text by its shape; where month and day could be either way round, a
    first number above 12 is a day."""
    found = F.lit(None).cast("array<string>")
    for shape, layouts in reversed(LAYOUTS.items()):
        found = F.when(local.rlike(shape), F.array(*[F.lit(x) for x in layouts])).otherwise(found)
    day_first = F.regexp_extract(local, r"^(\d{1,2})\D", 1).try_cast("int") > 12
    return F.when(day_first, F.element_at(found, -1)).otherwise(F.get(found, F.lit(0)))


def _moment(plain: Column, local: Column, zone: Column, layout: Column) -> Column:
    is_iso = plain.rlike(r"^\d{4}(-|$)") & ~plain.rlike(r"[AaPp][Mm]$")
    minutes = F.when(zone.rlike(r"^[+-]"), F.concat(F.substring(zone, 1, 1), F.lit("1")).cast("int") * (
        F.substring(zone, 2, 2).cast("int") * 60 + F.substring(zone, -2, 2).cast("int"))).otherwise(0)
    parsed = F.unix_micros(F.try_to_timestamp(local, layout)) - minutes.cast("long") * 60_000_000
    return F.when(is_iso, plain.try_cast("timestamp")).otherwise(F.timestamp_micros(parsed))


def parse_timestamp(value: Column) -> Column:
    """ISO, and the layouts above; else null.

    ``value`` is trimmed.  Its shape selects the layout, a column that one parser
    call reads.  A weekday in front is passed over, a comma may start the fraction, and a
    zone behind the clock shifts the time to UTC.
    """
    plain = _plain(value)
    local, zone = _clock(plain)
    return _moment(plain, local, zone, _layout(local))


def with_timestamp(df: DataFrame, source: str, name: str) -> DataFrame:
    """``parse_timestamp`` of a column, its steps computed once each."""
    col = F.col
    df = settle(df, {"_plain": _plain(col(source))})
    local, zone = _clock(col("_plain"))
    df = settle(df, {"_local": local, "_zone": zone})
    df = settle(df, {"_layout": _layout(col("_local"))})
    df = settle(df, {name: _moment(col("_plain"), col("_local"), col("_zone"), col("_layout"))})
    return df.drop("_plain", "_local", "_zone", "_layout")


def _decimal(c: Column, kind: T.DataType | None) -> Column:
    """A double for decimal notation and infinities; null for all other texts, such as 1d or 0x1p3.

    A column whose ``kind`` is a number is not written out as a text first.
    """
    if isinstance(kind, T.NumericType):
        return F.when(~F.isnan(c.try_cast("double")), c.try_cast("double"))
    return F.when(c.cast("string").rlike(_DECIMAL), c.try_cast("double"))


def to_bytes(c: Column, kind: T.DataType | None = None) -> Column:
    """A double; what is no number becomes 0.0."""
    return F.coalesce(_decimal(c, kind), F.lit(0.0))


def to_port(c: Column, kind: T.DataType | None = None) -> Column:
    """An int cut towards zero; what is no number becomes 0."""
    return F.coalesce(_decimal(c, kind).try_cast("int"), F.lit(0))


def _typed(df: DataFrame) -> DataFrame:
    renamed = rename_columns(df)
    check_columns(renamed)
    clean = trim_strings(renamed)
    raw, have = F.col("timestamp"), set(clean.columns)
    if isinstance(clean.schema["timestamp"].dataType, T.StringType):
        timed = with_timestamp(clean.withColumnRenamed("timestamp", "_time"), "_time", "timestamp")
        bad = (F.col("_time") != "") & raw.isNull()
    else:
        timed = clean.withColumns({"_time": F.lit(""), "timestamp": raw.cast("timestamp")})
        bad = F.lit(False)
    typed = timed.withColumns({
        "_bad": F.coalesce(bad, F.lit(False)),
        "bytes_transferred":
            to_bytes(F.col("bytes_transferred")) if "bytes_transferred" in have else F.lit(0.0),
        "dst_port": to_port(F.col("dst_port")) if "dst_port" in have else F.lit(0),
    })
    added = [c for c in ("bytes_transferred", "dst_port") if c not in have]
    return typed.select(*[F.col(f"`{c}`") for c in clean.columns], *added, "_bad")


def normalise_logs(df: DataFrame) -> DataFrame:
    """Canonical log table; one unreadable timestamp fails the job.

    The failure is raised where the row is read, without a pass of its own.
    """
    guarded = F.when(F.col("_bad"), F.raise_error(F.lit(BAD_TIMESTAMP)).cast("timestamp"))
    return _typed(df).withColumn("timestamp", guarded.otherwise(F.col("timestamp"))).drop("_bad")


def normalise_with_quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonical rows with readable timestamps, and the rows set aside."""
    typed = _typed(df)
    return typed.where(~F.col("_bad")).drop("_bad"), typed.where("_bad").drop("_bad")


def reject_bad_investigations(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whole-file rule for many files in one job.

    An investigation with any unreadable timestamp is rejected as a whole;
    returns the rows that remain and the rejected ids with a row count.
    """
    # read four times below: parsed once
    typed = cut_lineage(_typed(df))
    rejected = (
        typed.where("_bad").groupBy("investigation_id").agg(F.count(F.lit(1)).alias("bad_rows"))
    )
    sizes = typed.groupBy("investigation_id").agg(F.count(F.lit(1)).alias("_rows"))
    kept = balanced_join(
        typed, rejected.select("investigation_id"), ["investigation_id"], weights=sizes,
        weight="_rows", row_id=["timestamp", "src_ip", "dst_ip", "event_type"], how="left_anti",
    )
    return (
        kept.select(*[F.col(f"`{c}`") for c in typed.columns if c != "_bad"]),
        rejected.withColumn("reason", F.lit(BAD_TIMESTAMP)),
    )


def with_event_id(df: DataFrame) -> DataFrame:
    """Give rows the ``event_id`` that settles ties, where they have none.

    The line number of a parsed text, else a hash of the whole row, maps
    included: only rows that are equal in every column share an id, and which
    of them comes first does not matter.
    """
    if "event_id" in df.columns:
        return df
    if "line_number" in df.columns:
        return df.withColumnRenamed("line_number", "event_id")
    hashable = [
        F.array_sort(F.map_entries(F.col(f"`{f.name}`"))) if isinstance(f.dataType, T.MapType)
        else F.col(f"`{f.name}`") for f in df.schema.fields
    ]
    return df.withColumn("event_id", F.xxhash64(*hashable))
