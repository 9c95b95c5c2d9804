"""Column helpers shared by every job: time, severity, addresses, text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity words in ascending order, scores and factors.
SEVERITIES = ["info", "low", "medium", "high", "critical"]
RULE_SCORE = {"info": 10, "low": 30, "medium": 50, "high": 70, "critical": 90}
CRITICALITY_TENTHS = {"critical": 20, "high": 15, "medium": 10, "low": 7, "unknown": 5}
SEVERITY_FLOORS = [(80, "critical"), (60, "high"), (40, "medium"), (20, "low")]


def c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def micros(ts) -> Column:
    """Microseconds since the epoch of a timestamp column (with or without zone; session zone is UTC)."""
    return F.unix_micros(c(ts).cast("timestamp"))


def from_micros(us) -> Column:
    return F.timestamp_micros(c(us)).cast("timestamp_ntz")


def seconds(n) -> Column:
    """Day-time interval of ``n`` seconds."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n.cast("decimal(18,6)"))


def choose(pairs, default=None) -> Column:
    """First matching ``(condition, value)``."""
    out = None
    for cond, value in pairs:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out if default is None else out.otherwise(default)


def word_map(col, mapping: dict, default=None) -> Column:
    """Small literal lookup compiled to a CASE expression."""
    d = F.lit(default) if default is not None else None
    return choose([(c(col) == k, F.lit(v)) for k, v in mapping.items()], d)


def any_of(conds) -> Column:
    return reduce(lambda a, b: a | b, conds, F.lit(False))


def all_of(conds) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def true_only(cond: Column) -> Column:
    """Two-valued logic: unknown counts as false."""
    return F.coalesce(cond, F.lit(False))


def severity_rank(col) -> Column:
    return word_map(col, {s: i for i, s in enumerate(SEVERITIES)})


def severity_from_rank(rank: Column) -> Column:
    return choose([(rank == i, F.lit(s)) for i, s in enumerate(SEVERITIES)])


def severity_from_score(score) -> Column:
    return choose([(c(score) >= n, F.lit(s)) for n, s in SEVERITY_FLOORS], F.lit("info"))


# ---- addresses -----------------------------------------------------------

# Fixed value: strict dotted quad without leading zeros.
_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_PATTERN = "^" + r"\.".join([_OCTET] * 4) + "$"


def is_ipv4(col) -> Column:
    return true_only(c(col).rlike(IPV4_PATTERN))


def ipv4(col) -> Column:
    """The text if it is a dotted quad, else NULL."""
    return F.when(is_ipv4(col), c(col))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hextets(text: Column) -> Column:
    """Eight groups in lower case without leading zeros, NULL when malformed."""
    groups = lambda half: F.when(F.coalesce(half, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(half, ":"))

    def joined(halves):
        sides = F.struct(groups(F.get(halves, F.lit(0))).alias("a"), groups(F.get(halves, F.lit(1))).alias("b"), F.size(halves).alias("n"))
        return let(sides, filled)

    def filled(x):
        given = F.size(x["a"]) + F.size(x["b"])
        fits = ((x["n"] == 1) & (given == 8)) | ((x["n"] == 2) & (given <= 7))
        return F.when(fits, F.concat(x["a"], F.array_repeat(F.lit("0"), 8 - given), x["b"]))
    clean = lambda all8: F.when(F.forall(all8, lambda g: g.rlike("^[0-9a-fA-F]{1,4}$")), F.transform(all8, lambda g: F.lower(F.regexp_replace(g, "^0+(?=.)", ""))))
    return let(let(F.split(text, "::"), joined), clean)


def _ipv6_text(groups: Column) -> Column:
    low = lambda i: F.conv(F.get(groups, F.lit(i)), 16, 10).cast("int")
    dotted = F.concat(F.lit("::ffff:"), F.concat_ws(".", *[x.cast("string") for i in (6, 7) for x in (F.shiftright(low(i), 8), low(i).bitwiseAND(F.lit(255)))]))

    def squeezed(flags):
        # One letter a group: the first longest run of zeros is found as text.
        join = lambda start, length: F.array_join(F.slice(groups, start, length), ":")
        runs = [(F.locate("0" * run, flags) > 0, F.concat(join(F.lit(1), F.locate("0" * run, flags) - 1), F.lit("::"), join(F.locate("0" * run, flags) + run, F.lit(8)))) for run in range(8, 1, -1)]
        return choose([(flags.startswith("00000x") & (F.get(groups, F.lit(5)) == "ffff"), dotted), *runs], F.array_join(groups, ":"))
    return let(F.array_join(F.transform(groups, lambda g: F.when(g == "0", "0").otherwise("x")), ""), squeezed)


def ipv6(col) -> Column:
    """IPv6 text in canonical form (lower case, no leading zeros, the first longest run of zero groups as ``::``,
    a mapped IPv4 address dotted), NULL when malformed."""
    t = c(col)
    tail = F.regexp_extract(t, r"^.*:([0-9.]*\.[0-9.]*)$", 1)
    two = lambda number: F.concat(F.hex(F.shiftright(number, 16)), F.lit(":"), F.hex(number.bitwiseAND(F.lit(65535))))
    text = F.when(tail == "", t).otherwise(F.concat(F.regexp_extract(t, r"^(.*:)[0-9.]*$", 1), let(ip_number(tail), two)))
    return F.when(t.contains(":"), let(_hextets(text), _ipv6_text))


def ip_number(col) -> Column:
    """IPv4 text as BIGINT, NULL when malformed."""
    part = lambda i: F.split_part(c(col), F.lit("."), F.lit(i)).cast("bigint")
    value = part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4)
    return F.when(is_ipv4(col), value)


def ip_number_of(text: str):
    """Driver-side IPv4 literal, None when malformed."""
    parts = text.split(".")
    if len(parts) != 4 or not all(p.isascii() and p.isdigit() and str(int(p)) == p and int(p) < 256 for p in parts):
        return None
    a, b, g, d = map(int, parts)
    return (a << 24) | (b << 16) | (g << 8) | d


def number_in_cidr(number: Column, cidr: str) -> Column:
    """Membership of an address number in ``a.b.c.d/n``; no prefix means equality; malformed text is false."""
    net, slash, bits = cidr.partition("/")
    base = ip_number_of(net)
    if base is None:
        return F.lit(False)
    if not slash:
        return true_only(number == base)
    if not bits.isdigit() or int(bits) > 32:
        return F.lit(False)
    mask = (0xFFFFFFFF << (32 - int(bits))) & 0xFFFFFFFF
    return true_only(number.bitwiseAND(F.lit(mask).cast("bigint")) == (base & mask))


def in_cidr(col, cidr: str) -> Column:
    return number_in_cidr(ip_number(col), cidr)


# Address blocks never looked up in location tables.
PRIVATE_BLOCKS = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8",
                  "169.254.0.0/16", "255.255.255.255", "0.0.0.0"]


def is_private_number(number: Column) -> Column:
    return any_of([number_in_cidr(number, b) for b in PRIVATE_BLOCKS])


def is_private_ip(col) -> Column:
    return is_private_number(ip_number(col))


# ---- text ----------------------------------------------------------------

def quote_regex(text: str) -> str:
    """Escape every character that is special in Java regular expressions."""
    return "".join("\\" + ch if not (ch.isalnum() or ch in " _") and ch.isascii() else ch for ch in text)


def sanitize(col) -> Column:
    """Lower-case letters and digits, everything else an underscore."""
    return F.lower(F.regexp_replace(c(col), r"[^\p{IsAlphabetic}\p{N}]", "_"))


def contains_any(col, words) -> Column:
    return any_of([c(col).contains(w) for w in words])


def category_by_words(col, rules, default) -> Column:
    """Ordered substring classification: first rule with a word inside the text."""
    return let(F.lower(c(col)), lambda low: choose([(contains_any(low, words), F.lit(name)) for name, words in rules],
                                                   None if default is None else F.lit(default)))


def duration_text(secs: Column) -> Column:
    """``1h 2m`` / ``3m 4s`` / ``5s``."""
    s = secs.cast("bigint")
    h = F.floor(s / 3600).cast("string")
    m = F.floor((s % 3600) / 60).cast("string")
    r = (s % 60).cast("string")
    return (F.when(s.isNull(), F.lit("N/A"))
            .when(s >= 3600, F.concat(h, F.lit("h "), m, F.lit("m")))
            .when(s >= 60, F.concat(m, F.lit("m "), r, F.lit("s")))
            .otherwise(F.concat(r, F.lit("s"))))
