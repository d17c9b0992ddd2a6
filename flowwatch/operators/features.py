"""Per-packet features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowwatch.functions.ports import is_ephemeral
from flowwatch.operators.ordered import HEAVY_FLOOR, heavy_groups, in_heavy, ordered_scan, slot_of
from flowwatch.schemas import FEATURES
from flowwatch.session import materialize

HORIZON_US = 15_000_000
SKETCH_BITS = 12
SENSOR = ["sensor_id"]
SOURCE = ["sensor_id", "src_ip"]
_REQUIRED = ["ts_us", "src_ip", "packet_size", "sport", "seq", "sensor_id"]
_BEFORE_ALL = -(1 << 62)
_SEQ_RANGE = 10**19
_AFTER_ALL = 1 << 62

# Rows of one source that share a window in the capped mode, by arrival index.
_INDEX_SLOT = 1 << 18
# Span buckets that share a window; neighbours at the edge are copied across.
_CHUNK = 4096


def require_columns(df: DataFrame, names: list[str] = _REQUIRED) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"packets lack required columns: {', '.join(missing)}")
    return df


def size_log(size: Column) -> Column:
    return F.log1p(size.cast("double"))


def direction(src: Column, local_ips: list[str]) -> Column:
    """1.0 if the source is this host, else 0.0. The local set is one host's addresses."""
    if not local_ips:
        return F.lit(0.0)
    return F.coalesce(src.isin(list(local_ips)), F.lit(False)).cast("double")


def with_direction_by_sensor(df: DataFrame, local: DataFrame) -> DataFrame:
    """``direction`` where each sensor has its own local addresses: rows (sensor_id, ip) of ``local``."""
    known = local.select(F.col("sensor_id").alias("_sensor"), F.col("ip").alias("_ip")).distinct()
    own = (df["sensor_id"] == known["_sensor"]) & (df["src_ip"] == known["_ip"])
    return df.join(known, own, "left").withColumn("direction", F.col("_ip").isNotNull().cast("double")).drop("_sensor", "_ip")


def with_time_diff(df: DataFrame, **scan) -> DataFrame:
    """Seconds since the previous packet of the sensor; 0 for its first."""
    return (
        ordered_scan(df, SENSOR, **scan)
        .withColumn("time_diff", F.coalesce((F.col("ts_us") - F.col("prev_ts")) / F.lit(1e6), F.lit(0.0)))
        .drop("prev_ts", "running")
    )


def with_arrival_index(df: DataFrame, **scan) -> DataFrame:
    """1-based position of each packet in its sensor's (ts, seq) order."""
    return ordered_scan(df, SENSOR, **scan).withColumnRenamed("running", "arrival_index").drop("prev_ts")


def _copy_edges(df: DataFrame, bucket: str) -> DataFrame:
    """Add ``_chunk``; rows in a chunk's first and last bucket also go to the neighbour chunk,
    with ``_own`` false there."""
    b = F.col(bucket)
    mine = F.floor(b / _CHUNK).cast("bigint")
    at = F.pmod(b, F.lit(_CHUNK))
    homes = F.array_compact(F.array(mine, F.when(at == _CHUNK - 1, mine + 1), F.when(at == 0, mine - 1)))
    return df.withColumn("_mine", mine).withColumn("_chunk", F.explode(homes)).withColumn(
        "_own", F.col("_mine") == F.col("_chunk")
    )


def port_spans(packets: DataFrame, horizon_us: int = HORIZON_US) -> DataFrame:
    """One row per sensor, source, port and horizon-wide slot: first and last packet, and how many.

    The first packet's (time, sequence) travels as one decimal, so that the aggregate keeps
    fixed-width buffers and combines in a hash table on the map side. Sequence numbers are
    not negative and a slot is narrower than the decimal's head.
    """
    place = F.expr(
        f"cast(pmod(ts_us, {horizon_us}L) as decimal(18,0)) * {_SEQ_RANGE}BD + cast(seq as decimal(19,0))"
    )
    return (
        packets.groupBy(*SOURCE, "dport", slot_of(F.col("ts_us"), horizon_us).alias("_slot"))
        .agg(
            F.min("ts_us").alias("_first"),
            F.min(place).alias("_place"),
            F.max("ts_us").alias("_last"),
            F.count("*").alias("n_rows"),
        )
        .selectExpr(
            *SOURCE,
            "dport",
            "_slot",
            "_first",
            f"cast(_place - cast(_first - _slot as decimal(18,0)) * {_SEQ_RANGE}BD as bigint) as _first_seq",
            "_last",
            "n_rows",
        )
    )


def _port_steps(spans: DataFrame, horizon_us: int) -> DataFrame:
    """How a source's number of recent ports moves inside each slot, as weighted rows.

    Slots are as wide as the horizon. So a slot opens with the ports seen in the slot before
    it, each port of that slot falls out one horizon after its last packet there, and a port
    comes in with its first packet here, unless it has stayed in throughout. A slot needs
    nothing but the two span rows of each port, and no slot waits for another. Slots in which
    the source is silent get no rows, so one source and slot has at most three per port.
    """
    both = spans.filter("dport is not null").selectExpr(
        *SOURCE,
        "dport",
        f"""inline(array(
            named_struct('_slot', _slot, '_gone', cast(null as bigint), '_first', _first, '_first_seq', _first_seq),
            named_struct('_slot', _slot + {horizon_us}, '_gone', _last + {horizon_us + 1},
                         '_first', cast(null as bigint), '_first_seq', cast(null as bigint))))""",
    )
    opening = f"'ts_us', {_BEFORE_ALL}L, 'seq', {_BEFORE_ALL}L"
    return (
        # One partitioning serves the aggregate and the window; a source and slot has at
        # most two rows per port.
        both.repartition(*SOURCE, "_slot")
        .groupBy(*SOURCE, "dport", "_slot")
        .agg(F.max("_gone").alias("_gone"), F.max("_first").alias("_first"), F.max("_first_seq").alias("_first_seq"))
        .withColumn("_active", F.expr("max(_first) over (partition by sensor_id, src_ip, _slot)"))
        .filter("_active is not null")
        .selectExpr(
            *SOURCE,
            "_slot",
            f"""inline(array_compact(array(
                if(_gone is not null, named_struct({opening}, '_w', 1L), null),
                if(_gone < _slot + {horizon_us} and coalesce(_first >= _gone, true),
                   named_struct('ts_us', _gone, 'seq', {_BEFORE_ALL}L, '_w', -1L), null),
                if(_first is not null and coalesce(_first >= _gone, true),
                   named_struct('ts_us', _first, 'seq', _first_seq, '_w', 1L), null))))""",
        )
        .withColumn("_kind", F.lit(0))
    )


def with_unique_dports(
    df: DataFrame,
    horizon_us: int = HORIZON_US,
    max_rows: int | None = None,
    floor: int = HEAVY_FLOOR,
    name: str = "unique_dports_15s",
    spans: DataFrame | None = None,
) -> DataFrame:
    """Distinct destination ports of the packet's source in the trailing horizon, this
    packet included and later arrivals excluded.

    ``max_rows`` also limits the look-back to the sensor's last ``max_rows`` arrivals.
    ``spans`` is ``port_spans`` of the whole table, if at hand; ``df`` may then be a part of
    the table.
    """
    if max_rows is not None:
        return _capped_unique_dports(df, horizon_us, max_rows, floor, name)

    spans = materialize(port_spans(df, horizon_us), "spans") if spans is None else spans
    return _dealt_dports(df, spans, _port_steps(spans, horizon_us), horizon_us, floor, name)


def _dealt_dports(
    df: DataFrame, spans: DataFrame, steps: DataFrame, horizon_us: int, floor: int, name: str
) -> DataFrame:
    """Port counts by (source, slot). A heavy one is dealt out over several windows, each
    with its own copy of the steps, so that no task gets all of its packets."""
    group = [*SOURCE, "_slot"]
    heavy = heavy_groups(spans.groupBy(*group).agg(F.sum("n_rows").alias("n_rows")), group, floor=floor)
    rows = df.withColumn("_slot", slot_of(F.col("ts_us"), horizon_us))
    packet = ["0L as _w", "1 as _kind"]
    if heavy is None:
        dealt = rows.selectExpr("*", "0 as _salt", *packet)
        copies = steps.withColumn("_salt", F.lit(0))
    else:
        salts = f"coalesce(cast(ceil(h_rows / {floor}) as int), 1)"
        dealt = rows.join(heavy, in_heavy(group), "left").selectExpr(
            *rows.columns, f"cast(pmod(xxhash64(seq), {salts}) as int) as _salt", *packet
        )
        copies = steps.join(heavy, in_heavy(group), "left").selectExpr(
            *steps.columns, f"explode(sequence(0, {salts} - 1)) as _salt"
        )
    w = (
        Window.partitionBy(*group, "_salt")
        .orderBy("ts_us", "seq", "_kind")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        dealt.unionByName(copies, allowMissingColumns=True)
        .withColumn(name, F.sum("_w").over(w).cast("double"))
        .filter("_kind = 1")
        .select(*df.columns, name)
    )


def _light_features(df: DataFrame, spans: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """Gap and port count for packets in ordinary slots, from one exchange of the packets.

    Both windows live inside a (sensor, slot), so the second reuses the partitioning of the
    first. Port steps and each slot's previous packet time come in as extra rows. ``skip``
    lists heavy slots to leave out.
    """
    slots = spans.groupBy(*SENSOR, "_slot").agg(F.max("_last").alias("_last"))
    previous = slots.selectExpr(
        *SENSOR,
        "_slot",
        # One row per slot: bounded by the time the data spans.
        "lag(_last) over (partition by sensor_id order by _slot) as _seen",
        f"{_BEFORE_ALL}L as ts_us",
        f"{_BEFORE_ALL}L as seq",
        "0 as _kind",
    )
    slot = slot_of(F.col("ts_us"), HORIZON_US).alias("_slot")
    rows = df.select("*", slot, F.expr("ts_us as _seen"), F.expr("0L as _w"), F.expr("1 as _kind"))
    marked = rows.unionByName(previous, allowMissingColumns=True).unionByName(
        _port_steps(spans, HORIZON_US), allowMissingColumns=True
    )
    if skip is not None:
        marked = marked.join(skip, in_heavy([*SENSOR, "_slot"]), "left_anti")
    return (
        marked.selectExpr(
            *df.columns,
            "_kind",
            """last(_seen, true) over (partition by sensor_id, _slot order by ts_us, seq, _kind
                rows between unbounded preceding and 1 preceding) as _before""",
            """sum(_w) over (partition by sensor_id, _slot, src_ip order by ts_us, seq, _kind
                rows between unbounded preceding and current row) as _ports""",
        )
        .filter("_kind = 1")
        .selectExpr(
            *df.columns,
            "coalesce((ts_us - _before) / 1e6D, 0D) as time_diff",
            "cast(_ports as double) as unique_dports_15s",
        )
    )


def _per_event(df: DataFrame, floor: int) -> DataFrame:
    """Gap and port count of every packet.

    The span summary is written once to the shared folder: it tells whether slots are heavy,
    and every later step reads it instead of the packets.
    """
    spans = materialize(port_spans(df), "spans")
    # What a slot's window will hold: its packets, and up to three step rows per port.
    loads = (
        spans.selectExpr(
            *SENSOR,
            f"""inline(array(named_struct('_slot', _slot, 'n_rows', n_rows + 1L),
                             named_struct('_slot', _slot + {HORIZON_US}, 'n_rows', 2L)))""",
        )
        .groupBy(*SENSOR, "_slot")
        .agg(F.sum("n_rows").alias("n_rows"))
    )
    heavy = heavy_groups(loads, [*SENSOR, "_slot"], floor=floor)
    light = _light_features(df, spans, heavy)
    if heavy is None:
        return light

    def inside(rows: DataFrame) -> DataFrame:
        return rows.join(heavy, in_heavy([*SENSOR, "_slot"]), "left_semi")

    crowded = inside(df.withColumn("_slot", slot_of(F.col("ts_us"), HORIZON_US))).drop("_slot")
    steps = inside(_port_steps(spans, HORIZON_US))
    counted = _dealt_dports(crowded, spans, steps, HORIZON_US, floor, "unique_dports_15s")
    return light.unionByName(with_time_diff(counted, floor=floor, basis=df).select(*light.columns))


def _capped_unique_dports(df: DataFrame, horizon_us: int, max_rows: int, floor: int, name: str) -> DataFrame:
    """The same count in arrival-index space, where slots are even by construction."""
    if max_rows < 1:
        raise ValueError("max_rows must be at least 1")
    # Four steps read the index, so it is written once.
    rows = materialize(with_arrival_index(df, floor=floor), "arrivals")
    keys = [*SOURCE, "dport"]
    spans = (
        rows.filter(F.col("dport").isNotNull())
        .groupBy(
            *keys,
            F.expr(f"arrival_index div {max_rows}").alias("_ib"),
            F.floor(F.col("ts_us") / horizon_us).cast("bigint").alias("_tb"),
        )
        .agg(
            F.min("arrival_index").alias("_first"),
            F.max("arrival_index").alias("_last"),
            F.min("ts_us").alias("_first_ts"),
            F.max("ts_us").alias("_last_ts"),
        )
    )
    w = Window.partitionBy(*keys, "_chunk").orderBy("_first")

    def broken(index_gap: Column, time_gap: Column) -> Column:
        return F.coalesce((index_gap >= max_rows) | (time_gap > horizon_us), F.lit(True))

    runs = (
        _copy_edges(spans, "_ib")
        .withColumn(
            "_opened", broken(F.col("_first") - F.lag("_last").over(w), F.col("_first_ts") - F.lag("_last_ts").over(w))
        )
        .withColumn(
            "_closed", broken(F.lead("_first").over(w) - F.col("_last"), F.lead("_first_ts").over(w) - F.col("_last_ts"))
        )
        .filter("_own")
    )
    opens = runs.filter("_opened").select(*SOURCE, F.col("_first").alias("_at"), F.lit(1).cast("bigint").alias("_w"))

    # A run ends at the earlier of two positions: max_rows arrivals after its last packet,
    # or the first arrival past the horizon. The latter is looked up by sending the closing
    # times through the same running count as weightless rows.
    probes = runs.filter("_closed").select(
        *SOURCE,
        F.col("_last"),
        (F.col("_last_ts") + horizon_us).alias("ts_us"),
        F.lit(_AFTER_ALL).cast("bigint").alias("seq"),
        F.lit(0).alias("_weight"),
    )
    ticks = rows.select("sensor_id", "ts_us", "seq", F.lit(1).alias("_weight"))
    counted = ordered_scan(
        probes.unionByName(ticks, allowMissingColumns=True), SENSOR, weight="_weight", floor=floor
    ).filter("_weight = 0")
    closes = counted.select(
        *SOURCE,
        F.least(F.col("_last") + max_rows, F.col("running") + 1).alias("_at"),
        F.lit(-1).cast("bigint").alias("_w"),
    )

    marks = opens.unionByName(closes).withColumn("_slot", F.expr(f"_at div {_INDEX_SLOT}"))
    rows = rows.withColumn("_slot", F.expr(f"arrival_index div {_INDEX_SLOT}"))
    group = [*SOURCE, "_slot"]
    changes = (
        marks.groupBy(*group)
        .agg(F.sum("_w").alias("_net"))
        .unionByName(rows.groupBy(*group).agg(F.lit(0).cast("bigint").alias("_net")))
        .groupBy(*group)
        .agg(F.sum("_net").alias("_net"))
    )
    before = Window.partitionBy(*SOURCE).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    openings = changes.select(
        *group, F.lit(-1).cast("bigint").alias("_at"), F.coalesce(F.sum("_net").over(before), F.lit(0)).alias("_w")
    )
    steps = marks.unionByName(openings).withColumnRenamed("_at", "arrival_index").withColumn("_kind", F.lit(0))
    running = Window.partitionBy(*group).orderBy("arrival_index", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("_w", F.lit(0).cast("bigint"))
        .withColumn("_kind", F.lit(1))
        .unionByName(steps, allowMissingColumns=True)
        .withColumn(name, F.sum("_w").over(running).cast("double"))
        .filter("_kind = 1")
        .drop("_slot", "_w", "_kind", "arrival_index")
    )


def dports_per_source(df: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct("dport") if approximate else F.count_distinct("dport")
    return df.groupBy("src_ip").agg(count.alias("unique_dports"))


def port_sketches(df: DataFrame, slot_us: int = HORIZON_US) -> DataFrame:
    """A HyperLogLog sketch of the ports of each (source, time slot), a table to keep.

    Sketches of any slots of a source merge, so a range of time is answered without its packets.
    """
    return df.groupBy("src_ip", F.expr(f"ts_us div {slot_us}").alias("slot")).agg(F.hll_sketch_agg("dport", F.lit(SKETCH_BITS)).alias("ports"))


def ports_from_sketches(sketches: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Estimated distinct ports per source over the slots ``first`` to ``last``, by default all."""
    chosen = sketches
    if first is not None:
        chosen = chosen.filter(F.col("slot") >= first)
    if last is not None:
        chosen = chosen.filter(F.col("slot") <= last)
    return chosen.groupBy("src_ip").agg(F.hll_sketch_estimate(F.hll_union_agg("ports")).alias("estimate"))


def with_batch_dports(df: DataFrame, horizon_us: int = HORIZON_US, name: str = "unique_dports_15s") -> DataFrame:
    """One cutoff for the whole table: ports per source in its last 15 seconds, on every row."""
    cutoff = df.agg((F.max("ts_us") - horizon_us).alias("cutoff")).scalar()
    counts = dports_per_source(df.filter(F.col("ts_us") >= cutoff)).withColumnRenamed("src_ip", "_src")
    # No broadcast hint: the number of sources is open. Adaptive execution picks the join
    # by measured size and splits a hot source if it has to shuffle.
    return (
        df.join(counts, df["src_ip"].eqNullSafe(counts["_src"]), "left")
        .withColumn(name, F.coalesce(F.col("unique_dports"), F.lit(0)).cast("double"))
        .drop("_src", "unique_dports")
    )


def engineer(
    df: DataFrame,
    local_ips: list[str],
    mode: str = "per_event",
    max_rows: int | None = None,
    floor: int = HEAVY_FLOOR,
) -> DataFrame:
    """Packets with the five derived columns.

    ``per_event`` counts ports up to each packet; ``batch_reference`` counts them once, at
    the end of the table, and puts that count on every row of the source.
    """
    require_columns(df)
    for optional in ("protocol", "dport"):
        if optional not in df.columns:
            df = df.withColumn(optional, F.lit(0))
    if mode == "per_event" and max_rows is None:
        out = _per_event(df, floor)
    elif mode == "per_event":
        out = with_time_diff(with_unique_dports(df, max_rows=max_rows, floor=floor), floor=floor, basis=df)
    elif mode == "batch_reference":
        out = with_time_diff(with_batch_dports(df), floor=floor, basis=df)
    else:
        raise ValueError(f"unknown mode: {mode}")
    return out.withColumns(
        {
            "packet_size_log": size_log(F.col("packet_size")),
            "is_ephemeral_sport": is_ephemeral(F.col("sport")),
            "direction": direction(F.col("src_ip"), local_ips),
        }
    )


def zero_filled(c: Column) -> Column:
    return F.nanvl(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0))


def feature_vector(df: DataFrame, names: list[str] = FEATURES) -> Column:
    """Features in fixed order as an array; absent and null become 0."""
    return F.array(*[zero_filled(F.col(n)) if n in df.columns else F.lit(0.0) for n in names])


def value_entropy(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Base-2 Shannon entropy of a column's value counts, NULL counted as a value."""
    by = by or []
    counts = df.groupBy(*by, column).agg(F.count("*").alias("n"))
    c = F.col("n").cast("double")
    total = F.sum(c)
    bits = F.log2(total) - F.sum(c * F.log2(c)) / total
    # Empty input still gives one row, with entropy 0. Rounding noise below zero is cut.
    return counts.groupBy(*by).agg(F.coalesce(F.greatest(bits, F.lit(0.0)), F.lit(0.0)).alias("entropy"))


def scan_windows(df: DataFrame, width_us: int = 15_000_000, slide_us: int = 5_000_000) -> DataFrame:
    """Distinct ports and packets per source in sliding windows.

    Packets are counted per port and slide first, so only counts are copied to the windows
    they belong to, and ports are told apart by grouping, not by collecting sets.
    """
    if width_us % slide_us:
        raise ValueError("the width must be a multiple of the slide")
    slide = slot_of(F.col("ts_us"), slide_us)
    counts = df.groupBy("src_ip", "dport", slide.alias("_slide")).agg(F.count("*").alias("n"))
    return (
        counts.withColumn("_start", F.explode(F.expr(f"sequence(_slide - {width_us - slide_us}L, _slide, {slide_us}L)")))
        .groupBy("_start", "src_ip", "dport")
        .agg(F.sum("n").alias("n"))
        .groupBy("_start", "src_ip")
        .agg(F.count("dport").alias("unique_dports"), F.sum("n").alias("packets"))
        .select(
            F.timestamp_micros("_start").alias("window_start"),
            F.timestamp_micros(F.col("_start") + width_us).alias("window_end"),
            "src_ip",
            "unique_dports",
            "packets",
        )
    )
