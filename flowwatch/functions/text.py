"""Alert text: line formats, labels, label parsing and time text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from flowwatch.functions.coerce import text_to_double

# Fixed formats.
ANOMALY_LINE = (
    "ANOMALY: ts=%.6f %s -> %s proto=%d size=%d dport=%d eph_sport=%d "
    "unique_dports_15s=%d direction=%s score=%.3f severity=%s"
)
SIGNATURE_LINE = 'SIGNATURE: %s severity=%s | %s -> %s dport=%d desc="%s"'
SCORE_MARK = " score="


def anomaly_line(
    ts_us: Column,
    src: Column,
    dest: Column,
    protocol: Column,
    size: Column,
    dport: Column,
    ephemeral: Column,
    unique_dports: Column,
    direction: Column,
    score: Column,
    severity: Column,
) -> Column:
    return F.format_string(
        ANOMALY_LINE,
        ts_us / F.lit(1e6),
        src,
        dest,
        protocol.cast("int"),
        size.cast("int"),
        dport.cast("int"),
        ephemeral.cast("int"),
        unique_dports.cast("int"),
        F.when(direction == 1, "out").otherwise("in"),
        score,
        severity,
    )


def signature_line(name, severity, src, dest, dport, description) -> Column:
    return F.format_string(SIGNATURE_LINE, name, severity, src, dest, dport.cast("int"), description)


def anomaly_label(dest: Column, dport: Column, score: Column) -> Column:
    return F.format_string("%s:%d score=%.3f", dest, dport.cast("int"), score)


def signature_label(name: Column, dest: Column, dport: Column) -> Column:
    return F.format_string("%s %s:%d", name, dest, dport.cast("int"))


def _behind_mark(label: Column) -> Column:
    """What follows the last " score=" in letters of either case, or NULL."""
    folded = F.translate(label, "SCORE", "score")
    rest = F.length(F.substring_index(folded, SCORE_MARK, -1))
    return F.when(folded.contains(SCORE_MARK), F.right(label, rest))


def label_score(label: Column) -> Column:
    """The number that follows the last " score=", or NULL."""
    return text_to_double(F.regexp_substr(_behind_mark(label), F.lit("^[-+.0-9eE]+")))


def label_text(label: Column) -> Column:
    """The part before the score, or the whole label where there is none."""
    head = F.substring(label, F.lit(1), F.length(label) - F.length(_behind_mark(label)) - len(SCORE_MARK))
    return F.when(label_score(label).isNotNull(), F.trim(head)).otherwise(F.coalesce(label, F.lit("")))


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def ts_from_us(us: Column) -> Column:
    return F.timestamp_micros(us)


def ban_expiry(ts: Column, minutes_text: Column) -> Column:
    """End of a ban given its start and a minutes text.

    Blank, unreadable and non-positive minutes mean no expiry (NULL).
    """
    minutes = F.when(minutes_text.rlike(r"^\s*[-+]?\d+\s*$"), F.trim(minutes_text).try_cast("int"))
    return F.when(minutes > 0, F.timestamp_micros(F.unix_micros(ts) + minutes.cast("bigint") * 60_000_000))


def feature_checksum(names: Column) -> Column:
    """SHA-256 of the comma-joined names; '' for no names."""
    return F.when(F.size(names) > 0, F.sha2(F.array_join(names, ","), 256)).otherwise("")
