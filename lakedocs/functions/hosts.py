"""Literal addresses of hosts, and whether they are public: blocks as sorted ranges of both families."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame, functions as F

# Blocks that aren't public, and public ones within those, by the registries of special addresses.
V4 = {
    "public": ["192.0.0.9/32", "192.0.0.10/32"],
    "loopback": ["127.0.0.0/8"],
    "link_local": ["169.254.0.0/16"],
    "multicast": ["224.0.0.0/4"],
    "private": ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16"],
    "reserved": ["0.0.0.0/8", "100.64.0.0/10", "192.0.0.0/24", "192.0.2.0/24", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4"],
}
V6 = {
    "public": ["2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28"],
    "loopback": ["::1/128"],
    "link_local": ["fe80::/10"],
    "multicast": ["ff00::/8"],
    "private": ["fc00::/7", "fec0::/10"],
    "reserved": ["::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "2001::/23", "2001:db8::/32", "2002::/16", "3fff::/20", "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fe00::/9"],
}


def ranges(blocks: dict[str, list[str]]) -> list[tuple[int, int, str]]:
    """(first, last, what) in order, apart from each other: where blocks overlap, the narrower one holds."""
    nets = sorted(((int(n.network_address), int(n.broadcast_address), what) for what, each in blocks.items() for n in map(ipaddress.ip_network, each)), key=lambda x: x[0] - x[1])
    out: list[tuple[int, int, str]] = []
    for low, high, what in nets:  # the wider ones first, narrower ones cut into them
        cut = []
        for a, b, w in out:
            if b < low or a > high:
                cut.append((a, b, w))
                continue
            cut += [(a, low - 1, w)] * (a < low) + [(high + 1, b, w)] * (b > high)
        out = [*cut, (low, high, what)]
    return sorted(x for x in out if x[2] != "public")


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without brackets, zone and a last dot; empty if there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    return F.regexp_replace(host, r"^\[|(%[^\]]*)?\]$|\.$", "")


_LONG = "decimal(20,0)"


def _v4(df: DataFrame, host: str, out: str) -> DataFrame:
    """Adds the number of an IPv4 literal as systems read it: one to four parts, each decimal, octal (0..) or hexadecimal
    (0x..), the last one filling the rest. Null if it is none. Each step is a column, as later ones use it often."""
    value = lambda x: F.when(x.rlike("^0x[0-9a-f]{1,16}$"), F.conv(F.substring(x, 3, 16), 16, 10)).when(x.rlike("^0[0-7]{0,20}$"), F.conv(x, 8, 10)).when(x.rlike("^[1-9][0-9]{0,14}$"), x).cast(_LONG)
    df = df.withColumn("_n", F.transform(F.split(host, r"\."), value))
    n = F.size("_n")
    df = df.withColumn("_head", F.slice("_n", 1, F.greatest(n - 1, F.lit(0))))
    fine = (n <= 4) & F.forall("_n", lambda x: x.isNotNull()) & F.forall("_head", lambda x: x < 256)
    room = F.element_at(F.array(*[F.lit(1 << 8 * (5 - k)).cast(_LONG) for k in range(1, 5)]), F.least(n, F.lit(4)))
    shifts = F.array(F.lit(1 << 24), F.lit(1 << 16), F.lit(1 << 8))
    head = F.aggregate(F.transform(F.slice("_head", 1, 3), lambda x, i: x.cast("long") * F.element_at(shifts, i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    last = F.element_at("_n", -1)
    return df.withColumn(out, F.when(fine & (last < room), head + last.cast("long"))).drop("_n", "_head")


def _v6(df: DataFrame, host: str, out: str) -> DataFrame:
    """Adds the 32 hexadecimal digits of an IPv6 literal, with an IPv4 literal as its end or not. Null if it is none."""
    df = df.withColumn("_tail", F.regexp_extract(host, r":(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})$", 1))
    df = _v4(df.withColumn("_plain", F.regexp_replace("_tail", r"(^|\.)0+(?=\d)", "$1")), "_plain", "_end")
    word = lambda x: F.lpad(F.lower(F.hex(x)), 4, "0")
    ended = F.concat(F.substring(host, F.lit(1), F.length(host) - F.length("_tail")), word(F.shiftright("_end", 16)), F.lit(":"), word(F.col("_end").bitwiseAND(F.lit(0xFFFF))))
    df = df.withColumn("_flat", F.when(F.col("_tail") == "", F.col(host)).when(F.col("_end").isNotNull(), ended)).withColumn("_sides", F.split("_flat", "::"))
    groups = lambda k: F.filter(F.split(F.coalesce(F.get("_sides", F.lit(k)), F.lit("")), ":"), lambda x: x != "")
    df = df.withColumns({"_left": groups(0), "_right": groups(1)}).withColumn("_missing", 8 - F.size("_left") - F.size("_right"))
    whole = F.concat("_left", F.when(F.col("_missing") > 0, F.array_repeat(F.lit("0"), F.col("_missing"))).otherwise(F.array().cast("array<string>")), "_right")
    shape = F.col("_flat").rlike(r"^[0-9a-f:]+$") & F.contains("_flat", F.lit(":")) & ~F.col("_flat").rlike(r":::|::.*::|^:[^:]|[^:]:$|[0-9a-f]{5}")
    fine = shape & F.when(F.size("_sides") == 2, F.col("_missing") >= 1).otherwise(F.col("_missing") == 0)
    return df.withColumn(out, F.when(fine, F.array_join(F.transform(whole, lambda x: F.lpad(x, 4, "0")), ""))).drop("_tail", "_plain", "_end", "_flat", "_sides", "_left", "_right", "_missing")


def _lookup(value: str, table: list[tuple]) -> Column:
    """What the range that holds a value says."""
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(w).alias("w")) for a, b, w in table])
    return F.get(F.filter(rows, lambda r: (r["a"] <= F.col(value)) & (F.col(value) <= r["b"])), F.lit(0))["w"]


def with_not_public(df: DataFrame, host: str, out: str) -> DataFrame:
    """Adds what keeps the literal address in column ``host`` from being public; null for public ones and for names."""
    hexed = [(f"{a:032x}", f"{b:032x}", w) for a, b, w in ranges(V6)]
    df = _v6(_v4(df, host, "_four"), host, "_six")
    # An IPv4 address in IPv6's clothes is judged as what it is.
    mapped = F.when(F.col("_six").startswith("0" * 20 + "ffff"), F.conv(F.substring("_six", 25, 8), 16, 10).cast("long"))
    df = df.withColumn("_four", F.coalesce("_four", mapped))
    return df.withColumn(out, F.when(F.col("_four").isNotNull(), _lookup("_four", ranges(V4))).when(F.col("_six").isNotNull(), _lookup("_six", hexed))).drop("_four", "_six")
