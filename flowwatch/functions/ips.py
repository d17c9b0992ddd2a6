"""IP address text: validity, class and network expansion, all as JVM expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_DOTTED = rf"(?:{_OCTET}\.){{3}}{_OCTET}"
_V4 = rf"\A{_DOTTED}\z"
_H = r"[0-9a-fA-F]{1,4}"
_SCOPE = r"(?:%[^%/]+)?"
# Eight groups, or fewer around one "::"; the last two may be written as a dotted address.
_V6 = (
    rf"\A(?:(?:{_H}:){{7}}{_H}"
    rf"|(?!(?::*{_H}\b){{8}})(?:{_H}(?::{_H})*)?::(?:{_H}(?::{_H})*)?"
    rf"|(?:{_H}:){{6}}{_DOTTED}"
    rf"|(?!(?::*{_H}:){{6}})(?:{_H}(?::{_H})*)?::(?:{_H}:)*{_DOTTED}){_SCOPE}\z"
)
_MAPPED = "0" * 20 + "ffff"
_MOST_IN_ARRAY = 1 << 20

# The IANA special-purpose IPv4 blocks that are not globally reachable.
_PRIVATE_V4 = [
    ("0.0.0.0", 8),
    ("10.0.0.0", 8),
    ("127.0.0.0", 8),
    ("169.254.0.0", 16),
    ("172.16.0.0", 12),
    ("192.0.0.0", 24),
    ("192.0.2.0", 24),
    ("192.168.0.0", 16),
    ("198.18.0.0", 15),
    ("198.51.100.0", 24),
    ("203.0.113.0", 24),
    ("240.0.0.0", 4),
]
# Two addresses inside 192.0.0.0/24 are globally reachable.
_PUBLIC_V4 = ["192.0.0.9", "192.0.0.10"]

# The IANA special-purpose IPv6 blocks that are not globally
# reachable, and the globally reachable parts inside them, as hex prefix and length.
_PRIVATE_V6 = [
    ("00000000000000000000000000000000", 128),
    ("00000000000000000000000000000001", 128),
    ("0064ff9b000100000000000000000000", 48),
    ("01000000000000000000000000000000", 64),
    ("20010000000000000000000000000000", 23),
    ("20010db8000000000000000000000000", 32),
    ("20020000000000000000000000000000", 16),
    ("fc000000000000000000000000000000", 7),
    ("fe800000000000000000000000000000", 10),
]
_PUBLIC_V6 = [
    ("20010001000000000000000000000001", 128),
    ("20010001000000000000000000000002", 128),
    ("20010003000000000000000000000000", 32),
    ("20010004011200000000000000000000", 48),
    ("20010020000000000000000000000000", 28),
    ("20010030000000000000000000000000", 28),
]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_ipv4(ip: Column) -> Column:
    return F.coalesce(ip.rlike(_V4), F.lit(False))


def is_ipv6(ip: Column) -> Column:
    return F.coalesce(ip.rlike(_V6), F.lit(False))


def is_ip(ip: Column) -> Column:
    return F.coalesce(ip.rlike(f"{_V4}|{_V6}"), F.lit(False))


def ipv4_to_long(ip: Column) -> Column:
    """Number of a dotted address; NULL where the text is not one."""
    part = F.split(ip, r"\.")
    value = sum((F.get(part, F.lit(i)).try_cast("bigint") * (256 ** (3 - i)) for i in range(1, 4)),
                F.get(part, F.lit(0)).try_cast("bigint") * 256**3)
    return F.when(is_ipv4(ip), value)


def long_to_ipv4(n: Column) -> Column:
    octets = [F.shiftright(n, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)]
    return F.concat_ws(".", *octets)


def _octets_hex(dotted: Column) -> Column:
    pairs = F.transform(F.split(dotted, r"\."), lambda o: F.lpad(F.lower(F.hex(o.try_cast("bigint"))), 2, "0"))
    return F.array_join(pairs, "")


def _groups_hex(part: Column) -> Column:
    groups = F.filter(F.split(part, ":"), lambda g: g != "")
    return F.array_join(F.transform(groups, lambda g: F.lpad(F.lower(g), 4, "0")), "")


def _v6_hex(ip: Column) -> Column:
    def expand(text: Column) -> Column:
        tail = F.regexp_extract(text, f"{_DOTTED}$", 0)
        last = F.when(tail != "", _octets_hex(tail)).otherwise("")
        colons = F.regexp_replace(text, f"{_DOTTED}$", "")
        head = _groups_hex(F.substring_index(colons, "::", 1))
        rest = F.when(colons.contains("::"), _groups_hex(F.substring_index(colons, "::", -1))).otherwise("")
        return _let(F.array(head, F.concat(rest, last)), fill)

    def fill(ends: Column) -> Column:
        missing = F.lit(32) - F.length(ends[0]) - F.length(ends[1])
        return F.concat(ends[0], F.repeat(F.lit("0"), missing), ends[1])

    return _let(F.regexp_replace(ip, "%.*$", ""), expand)


def address_hex(ip: Column) -> Column:
    """32 hex digits that sort like the address, IPv4 in its IPv6-mapped form; NULL if invalid."""
    return F.when(is_ipv4(ip), F.concat(F.lit(_MAPPED), _octets_hex(ip))).when(is_ipv6(ip), _v6_hex(ip))


def _hex_ranges() -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """Private blocks and the public parts inside them, as ranges of address hex."""

    def block(prefix: str, length: int) -> tuple[str, str]:
        return prefix, f"{int(prefix, 16) | ((1 << (128 - length)) - 1):032x}"

    def mapped(address: str, length: int) -> tuple[str, str]:
        return block(_MAPPED + "".join(f"{int(o):02x}" for o in address.split(".")), 96 + length)

    private = [mapped(a, n) for a, n in _PRIVATE_V4] + [block(p, n) for p, n in _PRIVATE_V6]
    public = [mapped(a, 32) for a in _PUBLIC_V4] + [block(p, n) for p, n in _PUBLIC_V6]
    return private, public


def _within(digits: Column, ranges: list[tuple[str, str]]) -> Column:
    out = F.lit(False)
    for low, high in ranges:
        out = out | digits.between(low, high)
    return out


def is_loopback(ip: Column) -> Column:
    v4 = (_MAPPED + "7f000000", _MAPPED + "7fffffff")
    v6 = ("0" * 31 + "1",) * 2
    return F.coalesce(_let(address_hex(ip), lambda h: _within(h, [v4, v6])), F.lit(False))


def is_private(ip: Column) -> Column:
    """Not globally reachable, documentation networks included."""
    private, public = _hex_ranges()
    return F.coalesce(
        _let(address_hex(ip), lambda h: _within(h, private) & ~_within(h, public)), F.lit(False)
    )


def ip_class(ip: Column) -> Column:
    return (
        F.when(~is_ip(ip), "invalid")
        .when(is_loopback(ip), "loopback")
        .when(is_private(ip), "private")
        .otherwise("public")
    )


def cidr_hosts(cidr: Column, limit: int | None = None) -> Column:
    """Host addresses of an IPv4 network or single address, lowest first, at most ``limit`` if given.

    Network and broadcast addresses are left out, except in /31 (both are hosts)
    and /32 (the address itself). Host bits in the text are ignored. Bad text
    gives NULL, which ``explode`` drops. The array is for small networks: without a limit, one of over
    a million hosts is an error; ``expand_targets`` gives those, and IPv6, row by row.
    """
    address = F.substring_index(cidr, "/", 1)
    length = F.when(cidr.contains("/"), F.substring_index(cidr, "/", -1).try_cast("int")).otherwise(32)
    number = ipv4_to_long(address)
    span = F.pow(F.lit(2.0), (F.lit(32) - length).cast("double")).cast("bigint")
    first = number - F.pmod(number, span)
    last = first + span - 1
    inner = length <= 30
    low = F.when(inner, first + 1).otherwise(first)
    high = F.when(inner, last - 1).otherwise(last)
    if limit is None:
        high = F.when(high - low < _MOST_IN_ARRAY, high).otherwise(F.raise_error(F.concat(F.lit("too many hosts for an array: "), cidr)).cast("bigint"))
    else:
        high = F.least(high, low + (limit - 1))
    hosts = F.transform(F.sequence(low, high), long_to_ipv4)
    return F.when(number.isNotNull() & length.between(0, 32), hosts)


def _signed(digits: Column) -> Column:
    """A 64-bit number from 16 hex digits."""
    return F.conv(digits, 16, -10).try_cast("bigint")


def _digits(number: Column) -> Column:
    return F.lpad(F.lower(F.hex(number)), 16, "0")


def hex_to_text(digits: Column) -> Column:
    """The usual text of an address from its 32 hex digits."""

    def shorten(text: Column) -> Column:
        # The longest run of zero groups, the first of several, becomes two colons.
        out = text
        for n in range(2, 9):
            run = rf"^((?:[0-9a-f]+:)*?)0(?::0){{{n - 1}}}((?::[0-9a-f]+)*)$"
            found = F.concat(F.regexp_extract(text, run, 1), F.lit(":"), F.regexp_extract(text, run, 2))
            whole = F.when(found.startswith(":"), F.concat(F.lit(":"), found)).otherwise(found)
            out = F.when(text.rlike(run), F.when(whole.endswith(":"), F.concat(whole, F.lit(":"))).otherwise(whole)).otherwise(out)
        return F.regexp_replace(out, ":::+", "::")

    v4 = F.concat_ws(".", *(F.conv(F.substring(digits, i, 2), 16, 10) for i in (25, 27, 29, 31)))
    groups = [F.regexp_replace(F.substring(digits, 1 + 4 * i, 4), "^0{1,3}", "") for i in range(8)]
    v6 = _let(F.concat_ws(":", *groups), shorten)
    return F.when(digits.startswith(_MAPPED), F.concat(F.lit("::ffff:"), v4)).otherwise(v6)


def expand_targets(rows: DataFrame, column: str, limit: int | None = None, name: str = "host") -> DataFrame:
    """The rows with each host address of the network or single address in ``column``, lowest first.

    IPv4 without network and broadcast address, IPv6 without the first address of a network; of /31, /127, /32, /128 and
    single addresses all. Host bits are ignored. Rows with bad text go. ``limit``: at most so many hosts of each.

    Hosts come out of nested generators of at most 65,536 values, so no network is held as an array. Without a
    limit its parts are dealt to all tasks first.
    """
    text = F.trim(F.col(column))
    address, bare = F.substring_index(text, "/", 1), ~text.contains("/")
    asked = F.regexp_extract(text, r"^[^/]*/(\d{1,3})$", 1).try_cast("int")
    scope = F.when(bare, F.regexp_extract(address, "%.*$", 0)).otherwise("")
    v4 = is_ipv4(address)
    width = F.when(v4, 32).when(is_ipv6(address) & (bare | ~address.contains("%")), 128)
    kept = rows.withColumns({"_v4": v4, "_scope": scope, "_width": width, "_bits": width - F.when(bare, width).otherwise(asked), "_hex": address_hex(address)})
    kept = kept.filter("_bits between 0 and _width")
    high, low = _signed(F.substring("_hex", 1, 16)), _signed(F.substring("_hex", 17, 16))
    # Host bits off: those of the low half, and those of the high half where there are more than 64.
    low = F.expr("case when _bits < 64 then shiftleft(-1L, _bits) else 0L end").bitwiseAND(low)
    high = F.expr("case when _bits <= 64 then -1L when _bits < 128 then shiftleft(-1L, _bits - 64) else 0L end").bitwiseAND(high)
    size = F.expr("case when _bits < 62 then shiftleft(1L, _bits) else shiftleft(1L, 62) end")
    first = F.expr("if(_bits < 2, 0L, 1L)")
    last = size - F.expr("if(_v4 and _bits > 1, 2L, 1L)")
    last = last if limit is None else F.least(last, first + (limit - 1))
    now = kept.withColumns({"_high": high, "_low": low, "_a": first, "_b": last})
    for shift in (48, 32, 16):
        now = now.withColumn("_k", F.explode(F.expr(f"sequence(shiftright(_a, {shift}), shiftright(_b, {shift}))")))
        now = now.withColumns({"_a": F.greatest("_a", F.expr(f"shiftleft(_k, {shift})")), "_b": F.least("_b", F.expr(f"shiftleft(_k + 1, {shift}) - 1"))})
    if limit is None:
        now = now.repartition(*rows.columns, "_k")
    now = now.withColumn("_k", F.explode(F.sequence("_a", "_b")))
    found = F.concat(_digits(F.col("_high")), _digits(F.col("_low") + F.col("_k")))
    host = F.when(F.col("_v4"), long_to_ipv4((F.col("_low") + F.col("_k")).bitwiseAND(F.lit(0xFFFFFFFF)))).otherwise(F.concat(hex_to_text(found), F.col("_scope")))
    return now.select(*rows.columns, host.alias(name))
