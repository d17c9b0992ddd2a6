"""Bans and trust: current state, expiry, guards, and the ordered command fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowwatch.functions.ips import is_ip
from flowwatch.functions.text import ban_expiry
from flowwatch.operators.alerts import alert_id
from flowwatch.operators.folds import BLOCK_ROWS, KEEP, Machine, fold_commands
from flowwatch.operators.ordered import keep_first


def latest_action(blocks: DataFrame) -> DataFrame:
    """The newest block or unblock per address."""
    return keep_first(blocks, ["ip"], [F.col("ts").desc(), F.col("id").desc()])


def expired_bans(blocks: DataFrame, as_of: Column) -> DataFrame:
    """Unblock rows for bans that are an address's latest action and ended before ``as_of``.

    Rows that tie for an address's newest time all count as latest.
    """
    newest = blocks.groupBy("ip").agg(F.max("ts").alias("ts"))
    ended = blocks.filter((F.col("action") == "block") & (F.col("expires_at") < as_of))
    return ended.join(newest, ["ip", "ts"], "left_semi").select(
        alert_id(F.col("id"), F.lit("auto-expired")).alias("id"),
        as_of.alias("ts"),
        "ip",
        F.lit("unblock").alias("action"),
        F.lit("auto-expired").alias("reason"),
        F.lit(None).cast("timestamp").alias("expires_at"),
    )


def with_trust(blocks: DataFrame, trusted: DataFrame) -> DataFrame:
    """Blocks with a flag for trusted addresses; adaptive execution broadcasts a small list."""
    known = trusted.select(F.col("ip").alias("_ip")).distinct()
    return blocks.join(known, blocks["ip"] == known["_ip"], "left").select(
        *blocks.columns, F.col("_ip").isNotNull().alias("trusted")
    )


def block_candidates(blocks: DataFrame, trusted: DataFrame) -> DataFrame:
    """Block commands that trust does not forbid."""
    return blocks.filter(F.col("action") == "block").join(trusted.select("ip"), "ip", "left_anti")


def rejected_trust(requests: DataFrame, blocks: DataFrame) -> DataFrame:
    """Trust requests for addresses whose latest action is a block."""
    blocked = latest_action(blocks).filter(F.col("action") == "block").select("ip")
    return requests.join(blocked, "ip", "left_semi")


def block_state(commands: DataFrame, trusted: DataFrame) -> DataFrame:
    """One row per address after block and unblock commands: the latest accepted one.

    ``commands`` has ``seq, ts, ip, command, minutes, reason``. Blank addresses and blocks
    of trusted ones are refused.
    """
    ip = F.trim("ip")
    accepted = (
        commands.filter(F.col("command").isin("block", "unblock"))
        .withColumn("ip", ip)
        .filter(F.col("ip") != "")
        .join(trusted.select("ip", F.lit(True).alias("_trusted")), "ip", "left")
        .filter((F.col("command") == "unblock") | F.col("_trusted").isNull())
    )
    block = F.col("command") == "block"
    reason = F.trim(F.coalesce("reason", F.lit("")))
    return keep_first(accepted, ["ip"], [F.col("ts").desc(), F.col("seq").desc()]).select(
        "ip",
        "ts",
        F.col("command").alias("action"),
        F.when(block, reason).otherwise(F.coalesce(F.nullif(reason, F.lit("")), F.lit("manual"))).alias("reason"),
        F.when(block, ban_expiry(F.col("ts"), F.coalesce("minutes", F.lit("")))).alias("expires_at"),
    )


# The states an address can be in between two commands. Guards keep it from being trusted
# and blocked at once.
NEUTRAL, TRUSTED, BLOCKED = 0, 1, 2
_OPS = ["block", "unblock", "trust", "untrust"]


def _contain(state: int, op: int, seconds: int) -> tuple[int, str, int]:
    """Next state, verdict and timer after one command."""
    name = _OPS[op]
    if name == "block":
        if state == TRUSTED:
            return state, "trusted_ip", KEEP
        return BLOCKED, "ok", seconds
    if name == "unblock":
        return (NEUTRAL, "ok", 0) if state == BLOCKED else (state, "ok", KEEP)
    if name == "trust":
        if state == BLOCKED:
            return state, "ip_blocked", KEEP
        return TRUSTED, "ok", KEEP
    return (NEUTRAL, "ok", KEEP) if state == TRUSTED else (state, "ok", KEEP)


CONTAINMENT = Machine(step=_contain, entries=(NEUTRAL, TRUSTED, BLOCKED), timed=BLOCKED, after=NEUTRAL, grace=1)


def containment_verdicts(commands: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every command with its verdict, applied per address in (ts, seq) order.

    Block is refused for a trusted address, trust for a blocked one; a ban ends by itself
    at its expiry. Blank addresses are refused, malformed ones cannot be trusted, and a command
    that is unknown or missing, or has no time, changes nothing. A missing ``seq`` comes first
    in its second.
    """
    cleaned = commands.withColumn("ip", F.trim(F.coalesce("ip", F.lit(""))))
    known = F.coalesce(F.col("command").isin(_OPS), F.lit(False))
    refused = (
        F.when(F.col("ip") == "", "ip_required")
        .when(~known, "bad_command")
        .when(F.col("ts").isNull(), "bad_time")
        .when((F.col("command") == "trust") & ~is_ip(F.col("ip")), "bad_ip")
    )
    judged = cleaned.withColumn("_refused", refused)
    names = F.array(*[F.lit(o) for o in _OPS])
    ban = F.unix_seconds(ban_expiry(F.col("ts"), F.coalesce("minutes", F.lit("")))) - F.unix_seconds("ts")
    folded = fold_commands(
        judged.filter("_refused is null").select(
            F.col("ip").alias("key"),
            F.unix_seconds("ts").alias("tick"),
            "seq",
            (F.array_position(names, F.col("command")) - 1).cast("int").alias("op"),
            F.coalesce(ban, F.lit(0)).alias("arg"),
        ),
        CONTAINMENT,
        block_rows,
    ).select(
        F.col("seq"),
        F.timestamp_seconds("tick").alias("ts"),
        F.col("key").alias("ip"),
        F.element_at(names, F.col("op") + 1).alias("command"),
        "verdict",
    )
    return folded.unionByName(
        judged.filter("_refused is not null").select("seq", "ts", "ip", "command", F.col("_refused").alias("verdict"))
    )


def merge_trusted(current: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The trusted list after additions (the newest per address wins) and removals."""
    both = current.withColumn("_new", F.lit(0)).unionByName(added.withColumn("_new", F.lit(1)))
    merged = keep_first(
        both, ["ip"], [F.col("_new").desc(), F.col("created_ts").desc(), F.col("note").desc()]
    ).drop("_new")
    return merged.join(removed.select("ip"), "ip", "left_anti")
