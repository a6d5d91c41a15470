"""Events in time windows around an anchor (an encounter's start).

Every operator cuts time into chunks as wide as the window and works per
(key, chunk). The work of one key, however many encounters and events it has,
is thus spread along its time line, and apart from ``interval_join``, whose
result is the list of matches, nothing forms pairs of anchors and events:
anchors are placed between the events of their chunk and read running
aggregates there, so cost grows with rows, not with matches.

All bounds are closed on both ends: [anchor - lower, anchor + upper].
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.times import epoch_seconds, seconds


def _chunk(ts: Column, width: int) -> Column:
    return F.floor(epoch_seconds(ts) / F.lit(width)).cast("long")


def _near(events: DataFrame, anchors: DataFrame, key: str, start: Column, end: Column, width: int) -> DataFrame:
    """Rows of ``events`` (key, chunk, ..) in a chunk that some anchor's window touches.

    A small cohort thus leaves only its own events to sort. Where the anchors
    are a small table Spark broadcasts these cells and no event moves for it.
    """
    touched = F.explode(F.sequence(_chunk(start, width), _chunk(end, width)))
    cells = anchors.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), touched.alias("chunk"))
    return events.join(cells, ["key", "chunk"], "left_semi")


def interval_join(
    anchors: DataFrame,
    events: DataFrame,
    key: str,
    anchor_time: str,
    event_time: str,
    lower: int,
    upper: int,
) -> DataFrame:
    """Inner join on ``key`` where the event lies in the anchor's window (seconds).

    The result holds every match, so its size is the user's choice of window.
    Joining on (key, chunk) instead of the key alone leaves as candidates only
    events of the two chunks that the window touches.
    """
    width = max(lower + upper, 1)
    first = _chunk(F.col(anchor_time) - seconds(lower), width)
    last = _chunk(F.col(anchor_time) + seconds(upper), width)
    placed = anchors.filter(F.col(anchor_time).isNotNull() & F.col(key).isNotNull()).withColumn(
        "__chunk", F.explode(F.sequence(first, last))
    )
    timed = events.filter(F.col(event_time).isNotNull() & F.col(key).isNotNull()).withColumn(
        "__chunk", _chunk(F.col(event_time), width)
    )
    inside = F.col(event_time).between(
        F.col(anchor_time) - seconds(lower), F.col(anchor_time) + seconds(upper)
    )
    return placed.join(timed, [key, "__chunk"]).filter(inside).drop("__chunk")


def first_in_window(
    anchors: DataFrame,
    events: DataFrame,
    anchor_id: str,
    key: str,
    anchor_time: str,
    event_time: str,
    tie: str,
    category: str,
    categories: list[str],
    lower: int,
    upper: int,
    value: str | None = None,
) -> DataFrame:
    """Earliest event per anchor and category in the widest window.

    Returns one row per anchor with, for category number i, a struct ``c{i}``
    of (at, tie, value), null where the window has no such event. The earliest
    event of the widest window is also that of every narrower one that reaches
    it, so a narrower window only compares ``at`` with its own end.
    """
    width = max(lower + upper, 1)
    start = F.col(anchor_time) - seconds(lower)
    end = F.col(anchor_time) + seconds(upper)
    seen = events.filter(
        F.col(event_time).isNotNull() & F.col(key).isNotNull() & F.col(category).isin(categories)
    ).select(
        F.col(key).alias("key"),
        _chunk(F.col(event_time), width).alias("chunk"),
        F.col(event_time).alias("at"),
        F.lit(0).alias("side"),
        F.col(tie).cast("long").alias("tie"),
        F.col(category).alias("category"),
        (F.col(value).cast("double") if value else F.lit(None).cast("double")).alias("value"),
        F.lit(None).cast("long").alias("id"),
        F.lit(None).cast("timestamp_ntz").alias("until"),
    )
    probes = anchors.select(
        F.col(key).alias("key"),
        F.explode(F.sequence(_chunk(start, width), _chunk(end, width))).alias("chunk"),
        start.alias("at"),
        F.lit(1).alias("side"),
        F.lit(None).cast("long").alias("tie"),
        F.lit(None).cast("string").alias("category"),
        F.lit(None).cast("double").alias("value"),
        F.col(anchor_id).cast("long").alias("id"),
        end.alias("until"),
    ).filter(F.col("key").isNotNull() & F.col("at").isNotNull())
    seen = _near(seen, anchors, key, start, end, width)
    # Newest first: the last event read before an anchor is the next one in time.
    # At equal times events are read before the anchor (closed bound) and the
    # smallest (tie, value) is read last.
    backwards = (
        W.partitionBy("key", "chunk")
        .orderBy(F.col("at").desc(), F.col("side"), F.col("tie").desc(), F.col("value").desc())
        .rowsBetween(W.unboundedPreceding, 0)
    )
    event = F.struct("at", "tie", "value")
    found = (
        seen.unionByName(probes)
        .withColumns(
            {
                f"c{i}": F.last(F.when(F.col("category") == c, event), ignorenulls=True).over(backwards)
                for i, c in enumerate(categories)
            }
        )
        .filter(F.col("side") == 1)
    )
    in_time = {
        f"c{i}": F.when(F.col(f"c{i}.at") <= F.col("until"), F.col(f"c{i}")) for i in range(len(categories))
    }
    best = (
        found.withColumns(in_time)
        .groupBy("id")
        .agg(*[F.min(f"c{i}").alias(f"c{i}") for i in range(len(categories))])
    )
    ids = anchors.select(F.col(anchor_id).cast("long").alias(anchor_id))
    return ids.join(best, F.col(anchor_id) == F.col("id"), "left").drop("id")


def windowed_first_values(found: DataFrame, anchors: DataFrame, anchor_id: str, anchor_time: str,
                          names: list[str], windows: dict[str, int]) -> DataFrame:
    """Wide table per (anchor, window): first value per category, null beyond the window's end.

    ``found`` comes from ``first_in_window``; ``windows`` maps a label to seconds
    after the anchor. All windows come out of the one pass.
    """
    times = anchors.select(F.col(anchor_id).cast("long").alias(anchor_id), anchor_time)
    rows = F.explode(
        F.array(*[F.struct(F.lit(w).alias("time_window"), F.lit(s).alias("__secs")) for w, s in windows.items()])
    )
    spread = found.join(times, anchor_id).select("*", rows.alias("__w")).select("*", "__w.*").drop("__w")
    end = F.col(anchor_time) + F.make_dt_interval(secs=F.col("__secs"))
    values = [
        F.when(F.col(f"c{i}.at") <= end, F.col(f"c{i}.value")).alias(n) for i, n in enumerate(names)
    ]
    any_event = reduce(
        lambda a, b: a | b, [F.coalesce(F.col(f"c{i}.at") <= end, F.lit(False)) for i in range(len(names))]
    )
    return spread.select(anchor_id, "time_window", *values, any_event.alias("has_event"))


def window_extremes(
    anchors: DataFrame,
    events: DataFrame,
    anchor_id: str,
    key: str,
    anchor_time: str,
    event_time: str,
    lower: int,
    windows: dict[str, int],
    minima: dict[str, Column],
    maxima: dict[str, Column],
) -> DataFrame:
    """Minima and maxima of event columns per (anchor, window), all windows in one pass.

    A window is as wide as its chunks, so it is a tail of one chunk plus a head
    of the next: the tail extreme is a running extreme read backwards, the head
    extreme one read forwards. Only (anchor, window) pairs with an event appear.
    ``minima`` / ``maxima`` map output names to numeric event expressions.
    """
    outputs = {**{n: ("min", c) for n, c in minima.items()}, **{n: ("max", c) for n, c in maxima.items()}}
    labels = list(windows.items())

    def per_window(build):
        return F.explode(F.array(*[build(label, secs) for label, secs in labels]))

    start = F.col(anchor_time) - seconds(lower)
    longest = max(windows.values())
    width = lower + longest
    timed = events.filter(F.col(event_time).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).alias("key"),
        _chunk(F.col(event_time), width).alias("chunk"),
        F.col(event_time).alias("at"),
        *[c.cast("double").alias(n) for n, (_, c) in outputs.items()],
    )
    seen = (
        _near(timed, anchors, key, start, F.col(anchor_time) + seconds(longest), width)
        .groupBy("key", "chunk", "at")
        .agg(F.count("*").alias("hits"), *[getattr(F, kind)(n).alias(n) for n, (kind, _) in outputs.items()])
        .select(
            "key", "at", "hits", *outputs,
            per_window(
                lambda label, secs: F.struct(
                    F.lit(label).alias("time_window"), _chunk(F.col("at"), lower + secs).alias("chunk")
                )
            ).alias("w"),
        )
        .select("key", "w.*", "at", F.lit("event").alias("kind"), F.lit(None).cast("long").alias("id"),
                "hits", *outputs)
    )
    probes = (
        anchors.select(
            F.col(key).alias("key"),
            F.col(anchor_id).cast("long").alias("id"),
            per_window(
                lambda label, secs: F.array(
                    F.struct(
                        F.lit(label).alias("time_window"),
                        _chunk(start, lower + secs).alias("chunk"),
                        start.alias("at"),
                        F.lit("tail").alias("kind"),
                    ),
                    F.struct(
                        F.lit(label).alias("time_window"),
                        (_chunk(start, lower + secs) + 1).alias("chunk"),
                        (F.col(anchor_time) + seconds(secs)).alias("at"),
                        F.lit("head").alias("kind"),
                    ),
                )
            ).alias("pair"),
        )
        .select("key", "id", F.explode("pair").alias("p"))
        .select("key", "p.*", "id", F.lit(None).cast("long").alias("hits"),
                *[F.lit(None).cast("double").alias(n) for n in outputs])
        .filter(F.col("key").isNotNull() & F.col("at").isNotNull())
    )
    # "event" sorts before "head" and "tail": events at a bound count on both sides.
    cell = W.partitionBy("key", "time_window", "chunk")
    forwards = cell.orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0)
    backwards = cell.orderBy(F.col("at").desc(), "kind").rowsBetween(W.unboundedPreceding, 0)
    placed = seen.unionByName(probes)
    measures = {"hits": "sum", **{n: kind for n, (kind, _) in outputs.items()}}
    running = {}
    for n, kind in measures.items():
        fold = getattr(F, kind)
        running[f"h_{n}"] = fold(n).over(forwards)
        running[f"t_{n}"] = fold(n).over(backwards)
    read = placed.withColumns(running).filter(F.col("kind") != "event")
    chosen = {
        n: F.when(F.col("kind") == "head", F.col(f"h_{n}")).otherwise(F.col(f"t_{n}")) for n in measures
    }
    return (
        read.select(F.col("id").alias(anchor_id), "time_window", *[c.alias(n) for n, c in chosen.items()])
        .groupBy(anchor_id, "time_window")
        .agg(*[getattr(F, kind)(n).alias(n) for n, kind in measures.items()])
        .filter(F.col("hits") > 0)
        .withColumnRenamed("hits", "n_events")
    )


def flag_within(found: DataFrame, column: str) -> Column:
    """1 where ``first_in_window`` found an event, else 0."""
    return F.when(found[column].isNotNull(), 1).otherwise(0)
