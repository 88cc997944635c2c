"""Per-source context of each event (F1..F5) and event bursts.

Everything a rule needs to know about other events of the same source is first
aggregated to one row per (investigation, source, clock hour).  Events then meet
that table in a single join on the finest key, with heavy keys sliced.  No
source, however busy, is ever gathered in one task:

* counts, means and distinct ports combine on the map side;
* a burst (k events of one source within w) is found by looking k - 1 times back in the hours of a
  source; where a source has a very busy hour, from at most k first and k - 1 last times of each
  w-wide cell, which Spark limits before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logvigil.constants import (
    BRUTE_EVENTS, BRUTE_SECONDS, FAILED_TERMS, RAPID_EVENTS, RAPID_SECONDS,
)
from logvigil.functions.network import cross_border
from logvigil.functions.skew import UNIT, balanced_join, heavy_keys
from logvigil.functions.text import contains_any
from logvigil.session import cut_lineage

SOURCE = ["investigation_id", "src_ip"]
HOUR_US = 3_600_000_000
_NO_HOUR = -(2**60)
#: A source with more events in an hour has its bursts found by cells.
DENSE_HOUR = 100_000
BURSTS = {"rapid": (RAPID_EVENTS, RAPID_SECONDS), "brute": (BRUTE_EVENTS, BRUTE_SECONDS)}
SPANS = "array<struct<lo:bigint,hi:bigint>>"


def local_time(timestamp: Column, zone: str) -> Column:
    return F.from_utc_timestamp(timestamp, zone) if zone != "UTC" else timestamp


def hour_of_day(timestamp: Column, zone: str = "UTC") -> Column:
    return F.hour(local_time(timestamp, zone))


def day_of_week(timestamp: Column, zone: str = "UTC") -> Column:
    """Monday is 0."""
    return F.weekday(local_time(timestamp, zone))


def clock_hour(ts_us: Column, zone: str = "UTC") -> Column:
    """Number of the clock hour in ``zone`` that holds an instant."""
    local = F.unix_micros(local_time(F.timestamp_micros(ts_us), zone)) if zone != "UTC" else ts_us
    return whole_steps(local, HOUR_US)


def is_failed(event_type: Column) -> Column:
    return contains_any(F.lower(event_type), FAILED_TERMS)


def whole_steps(c: Column, width: int) -> Column:
    """floor(c / width) on integers."""
    return F.call_function("div", c - F.pmod(c, F.lit(width)), F.lit(width).cast("long"))


def burst_spans(rows: DataFrame, keys: list[str], bursts: dict[str, tuple[int, int]]) -> DataFrame:
    """Time spans that hold a burst: so many events of a key within so many seconds.

    ``rows`` has the key columns, ``ts_us`` and ``burst``, the array of burst
    names a row may take part in; ``bursts`` gives (events, seconds) per name.
    An event belongs to a burst exactly when its time lies in one of the
    returned [lo, hi] spans:

    * a cell of the burst's width holding enough events is a span of its own,
      because any two of its events are closer than the width;
    * any other burst crosses one cell border, so it is a run over the last
      k - 1 times before the border and the first k - 1 after it.

    So each cell needs its first k and last k - 1 times only.  Both ends come
    from one pass: the rows of the far end are ordered by negated time, and the
    row limit is applied before the shuffle.
    """
    by_name = lambda values: "case burst " + " ".join(
        f"when '{name}' then {value}" for name, value in values.items()) + " end"
    widths = {name: seconds * 1_000_000 for name, (_, seconds) in bursts.items()}
    size = by_name({name: events for name, (events, _) in bursts.items()})
    cell = by_name({n: f"(ts_us - pmod(ts_us, {w}L)) div {w}L" for n, w in widths.items()})
    most = max(events for events, _ in bursts.values())
    known = " and ".join(f"{c} is not null" for c in [*keys, "ts_us"])

    slim = (
        rows.where(known)
        .selectExpr(*keys, "ts_us", "explode(burst) as burst")
        .selectExpr("*", f"{cell} as cell", "explode(array(false, true)) as far")
    )
    # the number first: it settles most comparisons of the sort by itself
    group = Window.partitionBy("cell", *keys, "burst", "far").orderBy(
        F.expr("if(far, -ts_us, ts_us)")
    )
    # the place of each time in its end: t1, t2, ... from the border outwards
    places = [F.max(F.expr(f"if(far and _n = {i}, ts_us, null)")).alias(f"b{i}")
              for i in range(1, most)]
    places += [F.max(F.expr(f"if(not far and _n = {i}, ts_us, null)")).alias(f"a{i}")
               for i in range(1, most + 1)]
    before = ", ".join(f"b{i}" for i in range(most - 1, 0, -1))
    after = ", ".join(f"a{i}" for i in range(1, most + 1))
    borders = (
        slim.withColumn("_n", F.row_number().over(group))
        .where(F.col("_n") <= most)
        .where(f"_n <= {size} - int(far)")
        .withColumn("border", F.expr("cell + int(far)"))
        .groupBy(*keys, "burst", "border")
        .agg(*places)
        .selectExpr(
            *keys, "burst", "border", f"{size} as size", f"{by_name(widths)} as width",
            f"array_compact(array({before})) as before", f"array_compact(array({after})) as after",
        )
        .where("size(after) >= size or (size(before) + size(after) >= size and size(before) > 0)")
        .selectExpr("*", "concat(before, slice(after, 1, size - 1)) as run")
    )
    return borders.selectExpr(*keys, "burst", """explode(concat(
        if(size(after) >= size,
           array(struct(border * width as lo, border * width + width - 1 as hi)), array()),
        if(size(run) >= size,
           filter(transform(sequence(1, size(run) - size + 1),
                            i -> struct(run[i - 1] as lo, run[i + size - 2] as hi)),
                  s -> s.hi - s.lo <= width), array()))) as span""",
    ).select(*keys, "burst", "span.lo", "span.hi")


def sparse_burst_spans(rows: DataFrame, keys: list[str], bursts: dict[str, tuple[int, int]]) -> DataFrame:
    """The spans of ``burst_spans`` for keys whose rows of an hour fit in one window.

    A row is placed in its own hour and in the hour a burst it begins may end in, which is the next
    at most.  So the hour of a burst's last event holds all its events, and k events in a row are a burst
    when the last is within the width of the first.
    """
    by_name = lambda values: "case burst " + " ".join(
        f"when '{name}' then {value}" for name, value in values.items()) + " end"
    width = by_name({name: f"{seconds * 1_000_000}L" for name, (_, seconds) in bursts.items()})
    hour = lambda t: f"({t} - pmod({t}, {HOUR_US}L)) div {HOUR_US}L"
    known = " and ".join(f"{c} is not null" for c in [*keys, "ts_us"])
    placed = (
        rows.where(known).selectExpr(*keys, "ts_us", "explode(burst) as burst")
        .selectExpr("*", f"{hour('ts_us')} as own", f"{hour(f'(ts_us + {width})')} as last")
        .selectExpr(*keys, "ts_us", "burst", "own", "explode(if(own = last, array(own), array(own, last))) as place")
    )
    # the number first: it settles most comparisons of the sort by itself
    order = Window.partitionBy("place", *keys, "burst").orderBy("ts_us")
    for events in sorted({events for events, _ in bursts.values()}):
        placed = placed.withColumn(f"back{events}", F.lag("ts_us", events - 1).over(order))
    first = by_name({name: f"back{events}" for name, (events, _) in bursts.items()})
    return (
        placed.where("own = place").selectExpr(*keys, "burst", f"{first} as lo", "ts_us as hi", f"{width} as width")
        .where("hi - lo <= width").select(*keys, "burst", "lo", "hi")
    )


def _merged(spans: str) -> Column:
    """Join touching spans of an array, so that lookups in it stay short."""
    return F.expr(f"""aggregate(sort_array({spans}), cast(array() as {SPANS}),
        (acc, s) -> if(size(acc) > 0 and s.lo <= get(acc, size(acc) - 1).hi + 1,
            concat(slice(acc, 1, size(acc) - 1),
                   array(struct(get(acc, size(acc) - 1).lo as lo,
                                greatest(get(acc, size(acc) - 1).hi, s.hi) as hi))),
            concat(acc, array(s))))""")


def _spans_by_hour(spans: DataFrame, names: list[str], zone: str) -> DataFrame:
    """One row per source and clock hour; a span reaches two hours at most.

    An hour holds a bounded number of cells and so a bounded number of spans.
    """
    hours = F.array(clock_hour(F.col("lo"), zone), clock_hour(F.col("hi"), zone))
    span = F.struct("lo", "hi")
    lists = [F.collect_list(F.when(F.col("burst") == n, span)).alias(n) for n in names]
    return (
        spans.withColumn("hour", F.explode(F.array_distinct(hours)))
        .groupBy(*SOURCE, "hour")
        .agg(*lists)
        .select(*SOURCE, "hour", *[_merged(n).alias(n) for n in names])
    )


def hourly_ports(events: DataFrame, zone: str = "UTC") -> DataFrame:
    """Events and bytes per source, clock hour and port: the one aggregate F1..F3 come from."""
    return (
        _keyed(events, zone)
        .where("investigation_id is not null and src_ip is not null")
        .groupBy(*SOURCE, "hour", "dst_port")
        .agg(F.count(F.lit(1)).alias("events"), F.sum("bytes_transferred").alias("bytes"),
             F.count("bytes_transferred").alias("amounts"))
    )


def profile_of(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy(*SOURCE).agg(
        F.sum("events").alias("source_events"),
        F.try_divide(F.sum("bytes"), F.sum("amounts")).alias("source_mean_bytes"),
        F.count_distinct("dst_port").alias("source_ports"),
    )


def counts_of(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy(*SOURCE, "hour").agg(F.sum("events").alias("source_hour_events"))


def source_profile(events: DataFrame) -> DataFrame:
    """events, mean bytes and distinct ports of each source."""
    return profile_of(hourly_ports(events))


def _keyed(events: DataFrame, zone: str) -> DataFrame:
    ts_us = F.unix_micros("timestamp")
    return events.withColumns({
        "ts_us": ts_us,
        "hour": F.coalesce(clock_hour(ts_us, zone), F.lit(_NO_HOUR)),
    })


def hourly_counts(events: DataFrame, zone: str = "UTC") -> DataFrame:
    """events per source and clock hour."""
    return counts_of(hourly_ports(events, zone))


def source_ledger(events: DataFrame, hourly: DataFrame, zone: str = "UTC",
                  dense: int = DENSE_HOUR) -> DataFrame:
    """All facts about a source in one clock hour, bursts included."""
    candidates = events.select(
        *SOURCE, F.unix_micros("timestamp").alias("ts_us"),
        F.when(is_failed(F.col("event_type")), F.array(F.lit("rapid"), F.lit("brute")))
        .otherwise(F.array(F.lit("rapid"))).alias("burst"),
    )
    counts = counts_of(hourly)
    busiest = counts.groupBy(*SOURCE).agg(F.max("source_hour_events").alias("busiest"))
    busy = heavy_keys(busiest, SOURCE, "busiest", dense)
    if busy.isEmpty():
        spans = sparse_burst_spans(candidates, SOURCE, BURSTS)
    else:
        spans = sparse_burst_spans(candidates.join(busy, SOURCE, "left_anti"), SOURCE, BURSTS).unionByName(
            burst_spans(candidates.join(busy, SOURCE, "left_semi"), SOURCE, BURSTS))
    return (
        counts
        .join(profile_of(hourly), SOURCE)
        .join(_spans_by_hour(spans, list(BURSTS), zone), [*SOURCE, "hour"], "left")
    )


def with_source_context(events: DataFrame, zone: str = "UTC", unit: int = UNIT) -> DataFrame:
    """Each event with the ledger of its source and hour.

    Adds source_events, source_mean_bytes, source_ports, source_hour_events and
    the flags in_rapid_burst, in_brute_burst and is_abroad.  Events without a source match
    nothing.  Three scans of the events: one for the small hourly table, which is
    written once, one for the bursts, and one for the events themselves.
    """
    hourly = cut_lineage(hourly_ports(events, zone))
    # the address test is the costliest rule: below the join it runs once per event
    keyed = _keyed(events, zone).withColumn("is_abroad", cross_border("dst_ip"))
    joined = balanced_join(
        keyed, source_ledger(events, hourly, zone), [*SOURCE, "hour"],
        weights=counts_of(hourly), weight="source_hour_events",
        row_id=["event_id"], unit=unit,
    )

    def inside(spans: str) -> Column:
        hit = F.exists(spans, lambda s: F.col("ts_us").between(s["lo"], s["hi"]))
        return F.coalesce(hit, F.lit(False))

    added = {
        "source_events": F.coalesce("source_events", F.lit(0).cast("long")),
        "source_ports": F.coalesce("source_ports", F.lit(0).cast("long")),
        "source_hour_events": F.coalesce("source_hour_events", F.lit(0).cast("long")),
        "in_rapid_burst": inside("rapid"),
        "in_brute_burst": is_failed(F.col("event_type")) & inside("brute"),
    }
    out = joined.withColumns(added).drop("hour", "ts_us", "rapid", "brute")
    return out.select(*events.columns, *CONTEXT_COLUMNS)


CONTEXT_COLUMNS = ["source_events", "source_mean_bytes", "source_ports", "source_hour_events",
                   "in_rapid_burst", "in_brute_burst", "is_abroad"]


def feature_vector(zone: str = "UTC") -> Column:
    """bytes, port, hour, weekday, events per source hour, ports per source."""
    ts = F.col("timestamp")
    parts = [F.col("bytes_transferred"), F.col("dst_port"), hour_of_day(ts, zone),
             day_of_week(ts, zone), F.col("source_hour_events"), F.col("source_ports")]
    return F.array(*[F.coalesce(p.cast("double"), F.lit(0.0)) for p in parts])
