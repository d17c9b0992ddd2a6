"""Ordered scans over long, possibly lopsided sequences.

A gap to the previous row, or a running total, needs rows in time order, but a
single ordered window over a sensor would put all its rows in one task. Here the
sequence is cut into pieces that follow one another in (ts, seq) order:

* a *slot* of fixed width where traffic is ordinary;
* inside a slot of over ``HEAVY_FLOOR`` rows, one piece per
  timestamp and block of ``PIECE_ROWS`` sequence numbers.

Every piece is small, whatever the data looks like. A per-piece summary, computed
by a map-side combined aggregate, gives each piece the state it starts with, and
that state enters the piece's window as one extra row, so packets need no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowwatch.session import materialize

SLOT_US = 15_000_000
PIECE_ROWS = 1 << 20

# A group is heavy if it holds more rows than this, whatever the size of the table.
HEAVY_FLOOR = 1 << 20
# So many heavy groups at most are listed on the driver and broadcast; beyond that they are a table to join.
HEAVY_LISTED = 20_000


def heavy_groups(loads: DataFrame, keys: list[str], rows: str = "n_rows", floor: int = HEAVY_FLOOR) -> DataFrame | None:
    """Keys (as ``h_<key>``) and ``h_rows`` of the heavy groups; None if no
    group is heavy, as is usual. ``loads`` has one row per group and should be written or
    cheap, since this looks at it at once."""
    found = loads.filter(F.col(rows) > floor).select(
        *[F.col(k).alias(f"h_{k}") for k in keys], F.col(rows).alias("h_rows")
    )
    listed = found.limit(HEAVY_LISTED + 1).collect()
    if not listed:
        return None
    if len(listed) <= HEAVY_LISTED:
        return F.broadcast(loads.sparkSession.createDataFrame(listed, found.schema))
    return materialize(found, "heavy")


def in_heavy(keys: list[str]) -> Column:
    return F.expr(" and ".join(f"{k} <=> h_{k}" for k in keys))


def same(left: str, right: str, keys: list[str]) -> Column:
    """Null-safe equality of two aliased tables on all keys."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def slot_of(ts: Column, width: int) -> Column:
    """Start of the aligned slot a time falls in."""
    return ts - F.pmod(ts, F.lit(width).cast("bigint"))


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    ts: str = "ts_us",
    seq: str = "seq",
    weight: str = "1L",
    slot_us: int = SLOT_US,
    floor: int = HEAVY_FLOOR,
    piece_rows: int = PIECE_ROWS,
    basis: DataFrame | None = None,
) -> DataFrame:
    """Add ``prev_ts`` (time of the row before, per key) and ``running`` (sum of weights
    up to and including the row) in (ts, seq) order.

    ``basis`` is the table the rows were made from or are a part of; the summaries are read
    from it, so that costly columns are computed once. The slot summary is written at once.
    """
    group = [*keys, "_slot"]

    def slotted(rows: DataFrame) -> DataFrame:
        return rows.withColumns({"_w": F.expr(weight).cast("bigint"), "_slot": slot_of(F.col(ts), slot_us)})

    rows = slotted(df)
    thin = slotted(df if basis is None else basis)
    slots = materialize(
        thin.groupBy(*group).agg(F.count("*").alias("n_rows"), F.sum("_w").alias("_sum"), F.max(ts).alias("_last")),
        "slots",
    )
    # One row per slot: bounded by the time the data spans, not by its volume.
    over_key = Window.partitionBy(*keys).orderBy("_slot")
    ahead = F.sum("_sum").over(over_key.rowsBetween(Window.unboundedPreceding, -1))
    starts = slots.select(
        *group, F.lag("_last").over(over_key).alias("_prev"), F.coalesce(ahead, F.lit(0)).alias("_base")
    )
    heavy = heavy_groups(slots, group, floor=floor)
    whole_slot = {"_piece_ts": F.col("_slot"), "_piece_no": F.lit(-1).cast("bigint")}
    pieces = starts.withColumns(whole_slot)
    marked = rows.withColumns(whole_slot)
    if heavy is not None:
        piece = {"_piece_ts": F.col(ts), "_piece_no": F.expr(f"{seq} div {piece_rows}")}
        inside = thin.join(heavy, in_heavy(group), "left_semi").withColumns(piece)
        pieces = (
            pieces.join(heavy, in_heavy(group), "left_anti")
            .unionByName(_pieces_inside(inside, starts, group))
        )
        hot = F.col("h__slot").isNotNull()
        marked = rows.join(heavy, in_heavy(group), "left").select(
            *rows.columns, *[F.when(hot, v).otherwise(whole_slot[n]).alias(n) for n, v in piece.items()]
        )

    openings = pieces.select(
        *keys,
        "_piece_ts",
        "_piece_no",
        F.col("_prev").alias(ts),
        F.lit(None).cast("bigint").alias(seq),
        F.col("_base").alias("_w"),
        F.lit(0).alias("_kind"),
    )
    in_piece = Window.partitionBy(*keys, "_piece_ts", "_piece_no").orderBy("_kind", ts, seq)
    return (
        marked.withColumn("_kind", F.lit(1))
        .unionByName(openings, allowMissingColumns=True)
        .withColumns(
            {
                "prev_ts": F.lag(ts).over(in_piece),
                "running": F.sum("_w").over(in_piece.rowsBetween(Window.unboundedPreceding, 0)),
            }
        )
        .filter("_kind = 1")
        .select(*df.columns, "prev_ts", "running")
    )


def _pieces_inside(rows: DataFrame, starts: DataFrame, group: list[str]) -> DataFrame:
    """Start states of the pieces of heavy slots, at most one per microsecond of the slot and
    ``PIECE_ROWS`` rows."""
    over_slot = Window.partitionBy(*group).orderBy("_piece_ts", "_piece_no")
    ahead = F.sum("_sum").over(over_slot.rowsBetween(Window.unboundedPreceding, -1))
    inside = (
        rows.groupBy(*group, "_piece_ts", "_piece_no")
        .agg(F.sum("_w").alias("_sum"))
        .withColumns({"_in_prev": F.lag("_piece_ts").over(over_slot), "_in_base": F.coalesce(ahead, F.lit(0))})
    )
    return (
        inside.alias("p")
        .join(starts.alias("s"), same("p", "s", group))
        .select(
            *[F.col(f"p.{c}").alias(c) for c in group],
            F.coalesce("p._in_prev", "s._prev").alias("_prev"),
            (F.col("s._base") + F.col("p._in_base")).alias("_base"),
            "p._piece_ts",
            "p._piece_no",
        )
    )


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in the given order.

    Catalyst turns the rank filter into a group limit below the exchange, so each
    task sends at most one row per key and a hot key does not pile up.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")
