"""Raw log lines to event columns. Every step is a column expression: one projection over the lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwatch.functions.scalars import (c, category_by_words, choose, ipv4, let, micros, sanitize, seconds, true_only)

# Alias lists, severity words and category words of each dialect.
AGENT_SOURCES = ["linux_ebpf", "windows_etw"]
CEF_ALIASES = {
    "src_ip": ["src", "sourceAddress"], "dst_ip": ["dst", "destinationAddress"],
    "src_port": ["spt", "sourcePort"], "dst_port": ["dpt", "destinationPort"],
    "protocol": ["proto", "transportProtocol"], "bytes_in": ["in", "bytesIn"], "bytes_out": ["out", "bytesOut"],
    "hostname": ["shost", "sourceHostName"], "user_name": ["suser", "sourceUserName", "duser", "destinationUserName"],
    "process_name": ["sproc", "sourceProcessName"], "process_pid": ["spid", "sourceProcessId"],
    "file_name": ["fname", "filePath"], "ts": ["rt", "deviceReceiptTime", "end", "start"],
    "message": ["msg", "message"], "category": ["cat", "deviceEventCategory"], "dst_hostname": ["dhost", "destinationHostName"],
}
LEEF_ALIASES = {
    "src_ip": ["src"], "dst_ip": ["dst"], "src_port": ["srcPort"], "dst_port": ["dstPort"], "protocol": ["proto"],
    "user_name": ["usrName", "identUsername"], "severity": ["sev", "severity"], "category": ["cat", "devEventCategory"],
    "ts": ["devTime", "eventTime"], "hostname": ["identSrc", "srcHost"], "message": ["msg", "message"],
}
JSON_ALIASES = {
    "ts": ["timestamp", "ts", "@timestamp", "time", "eventTime"], "src_ip": ["src_ip", "sourceAddress", "src"],
    "dst_ip": ["dst_ip", "destinationAddress", "dst"], "src_port": ["src_port", "sourcePort"], "dst_port": ["dst_port", "destinationPort"],
    "protocol": ["protocol", "proto"], "bytes_in": ["bytes_in", "bytesIn"], "bytes_out": ["bytes_out", "bytesOut"],
    "hostname": ["hostname", "host", "srcHost"], "user_name": ["username", "user", "user_name", "actor"],
    "user_domain": ["user_domain", "domain"], "process_name": ["process_name", "proc", "process", "comm"],
    "process_pid": ["pid", "process_pid"], "process_ppid": ["ppid", "process_ppid"],
    "process_cmdline": ["cmdline", "process_cmdline", "args"], "process_path": ["exe", "process_path"],
    "file_path": ["file_path", "filePath", "path"], "file_name": ["file_name", "fileName"],
    "file_hash": ["file_hash", "sha256", "hash"], "file_size": ["file_size", "fileSize"],
    "event_type": ["event_type", "eventType", "type"], "severity": ["severity", "sev", "level"],
    "category": ["category", "event_category"], "message": ["message", "msg", "description"],
}
CEF_SEVERITY = [(["0", "1", "2", "3", "low"], "low"), (["4", "5", "6", "medium"], "medium"), (["7", "8", "high"], "high"), (["9", "10", "very-high"], "critical")]
LEEF_SEVERITY = [(["1", "2", "3", "Low", "low"], "low"), (["4", "5", "6", "Medium", "medium", "Informational"], "medium"),
                 (["7", "8", "High", "high"], "high"), (["9", "10", "Critical", "critical", "Very-High"], "critical")]
JSON_SEVERITY = [(["info", "informational", "debug", "notice"], "info"), (["low", "minor"], "low"), (["medium", "moderate", "warning", "warn"], "medium"),
                 (["high", "major", "error", "err"], "high"), (["critical", "crit", "fatal", "emergency", "emerg", "alert"], "critical")]
CEF_CATEGORY = [("authentication", ["auth", "login", "logon"]), ("network", ["network", "traffic", "flow"]), ("file", ["file", "disk"]),
                ("process", ["process", "exec"]), ("account", ["account", "user"])]
LEEF_CATEGORY = [("authentication", ["auth", "login"]), ("network", ["network", "traffic"]), ("file", ["file"]), ("process", ["process"])]
JSON_CATEGORY = [("authentication", ["auth", "login", "logon"]), ("network", ["network", "traffic"]), ("file", ["file", "fs"]), ("process", ["process", "exec"]),
                 ("account", ["account", "user_mgmt"]), ("cloud", ["cloud", "aws", "azure"])]
# Timestamp patterns tried in order after the internet formats and the epoch, each with the shape of
# text it can read (a parser is only called on text of its shape).
NAIVE_PATTERNS = [
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d+$", "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][.SSSSSSSS][.SSSSSSS][.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{8}T\d{6}$", "yyyyMMdd'T'HHmmss"),
    (r"^[A-Za-z]{3} \d{1,2} \d{4} \d{2}:\d{2}:\d{2}$", "MMM d yyyy HH:mm:ss"),
    (r"^\d{1,2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}$", "d/MMM/yyyy:HH:mm:ss"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2} [AaPp][Mm]$", "M/d/yyyy h:mm:ss a"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{2}:\d{2}:\d{2}$", "M/d/yyyy HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
]
EPOCH_MILLIS_ABOVE = 10_000_000_000


# ---- timestamps --------------------------------------------------------------

def _ntz(text: Column, pattern: str) -> Column:
    return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")


def epoch(text: Column) -> Column:
    """Whole number: milliseconds above the threshold, else seconds; decimal: seconds."""
    def read(t):
        ms = let(F.when(t.rlike(r"^[+-]?[0-9]{1,18}$"), t.try_cast("bigint")), lambda n: F.when(n > EPOCH_MILLIS_ABOVE, n).otherwise(n * 1000))
        sec = F.when(t.rlike(r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))
        return F.coalesce(let(ms, lambda x: F.when(x.between(-62135596800000, 253402300799999), x * 1000)),
                          let(sec, lambda x: F.when(x.between(-62135596800.0, 253402300799.0), F.round(x * 1000000).cast("bigint"))))
    return F.timestamp_micros(F.when(text.isNotNull(), let(F.regexp_replace(text, "Z$", ""), read))).cast("timestamp_ntz")


def bsd(text: Column, now) -> Column:
    """``Mon d HH:MM:SS`` in the year of ``now``, or the year before if more than a day ahead."""
    ref = F.lit(now).cast("timestamp_ntz") if isinstance(now, str) else now.cast("timestamp_ntz")
    t = F.regexp_replace(F.trim(text), " +", " ")
    this = F.when(t.rlike(r"^[A-Za-z]{3} [0-9]{1,2} [0-9]{2}:[0-9]{2}:[0-9]{2}$"), F.concat(F.year(ref).cast("string"), F.lit(" "), t))
    prev = F.when(this.isNotNull(), F.concat((F.year(ref) - 1).cast("string"), F.lit(" "), t))
    ts, before = _ntz(this, "yyyy MMM d HH:mm:ss"), _ntz(prev, "yyyy MMM d HH:mm:ss")
    return F.when(ts > ref + seconds(86400), before).otherwise(ts)


def parse_timestamp(text, now) -> Column:
    """Internet formats, epoch, named patterns as UTC, then the year-less form; else NULL."""
    t = F.trim(c(text))
    rfc3339 = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"), F.regexp_replace(F.upper(t), "T", " ").try_cast("timestamp").cast("timestamp_ntz"))
    mail = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "^[A-Za-z]{3}, *", ""), "(GMT|UTC|UT)$", "+0000"), " +", " ")
    rfc2822 = F.when(t.contains(" ") & mail.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$"), _ntz(mail, "d MMM yyyy HH:mm:ss xx"))
    squeezed = F.regexp_replace(t, " +", " ")
    named = [_ntz(F.when(squeezed.rlike(shape), squeezed), p) for shape, p in NAIVE_PATTERNS]
    return F.coalesce(rfc3339, rfc2822, epoch(t), *named, bsd(t, now))


# ---- small typed reads -----------------------------------------------------------

def unsigned(text: Column, limit: int) -> Column:
    """Whole number up to ``limit`` (below 2^63), however many leading zeros it has."""
    digits = F.regexp_extract(text, r"^\+?0*([0-9]{1,20})$", 1)
    return F.when(text.isNotNull(), let(digits.try_cast("bigint"), lambda n: F.when(n <= F.lit(limit).cast("bigint"), n)))


PORT, U32, U64 = 65535, 4294967295, 9223372036854775807


def severity_words(text: Column, table, default="info") -> Column:
    return F.when(text.isNotNull(), let(text, lambda t: choose([(t.isin(words), F.lit(name)) for words, name in table], F.lit(default)))).otherwise(default)


def cef_severity(text) -> Column:
    return severity_words(F.lower(F.trim(c(text))), CEF_SEVERITY)


def leef_severity(text) -> Column:
    return severity_words(F.trim(c(text)), LEEF_SEVERITY)


def syslog_severity(pri) -> Column:
    code = c(pri).bitwiseAND(F.lit(7))
    return F.when(code <= 2, "critical").when(code == 3, "high").when(code == 4, "medium").when(code == 5, "low").otherwise("info")


def cef_category(text) -> Column:
    return F.when(c(text).isNotNull(), category_by_words(text, CEF_CATEGORY, "other"))


def leef_category(text) -> Column:
    return F.when(c(text).isNotNull(), category_by_words(text, LEEF_CATEGORY, "other"))


def json_category(text) -> Column:
    return F.when(c(text).isNotNull(), category_by_words(text, JSON_CATEGORY, "other"))


def detect_format(source="source_type", raw="raw") -> Column:
    """Agent sources first, then the markers; only the first occurrence of a marker counts."""
    def marked(word):
        at = F.locate(word, c(raw))
        return (at > 0) & F.substr(c(raw), at + len(word), F.lit(1)).rlike("[0-9]")
    return (F.when(c(source).isin(AGENT_SOURCES), "agent").when(marked("CEF:"), "cef").when(marked("LEEF:"), "leef")
            .when(F.ltrim(c(raw)).startswith("{"), "json").otherwise("collector_parsed"))


# ---- alias lookups -------------------------------------------------------------

def claimed_pairs(d: DataFrame, aliases: dict, first=(), spare=()) -> DataFrame:
    """Adds ``_x``, the pairs ``_k``, ``_w`` as one map in which the last pair of a field stands, whichever alias it used.

    Claimed pairs are keyed by ``@field``, all others by ``.key``. A field of ``first`` keeps its first pair; the later
    ones are plain pairs, or dropped if the field is not in ``spare``.
    """
    owner = F.create_map(*[F.lit(x) for field, names in aliases.items() for n in names for x in (n, f"@{field}")])
    d = d.withColumn("_c", F.transform("_k", lambda k: F.coalesce(F.try_element_at(owner, k), F.concat(F.lit("."), k))))

    def settle(x, i):
        late = F.array_position("_c", x) <= i
        plain = F.concat(F.lit("."), F.get("_k", i))
        return (F.when(x.isin([f"@{f}" for f in spare]) & late, plain)
                .when(x.isin([f"@{f}" for f in first if f not in spare]) & late, F.lit("@")).otherwise(x))
    d = d.withColumn("_c", F.transform("_c", settle))
    return d.withColumn("_x", pairs_map(c("_c"), c("_w")))


def with_pairs(d: DataFrame, keys: Column, values: Column) -> DataFrame:
    """Adds ``_k`` and ``_w``; a NULL line has none, so no later step works on it."""
    return d.withColumns({"_k": F.when(c("raw").isNotNull(), keys), "_w": F.when(c("raw").isNotNull(), values)})


def claimed(field: str) -> Column:
    return F.try_element_at("_x", F.lit(f"@{field}"))


def plain_fields(header: dict) -> Column:
    """Header entries, replaced by pairs of the same name, then message and the pairs that no field claims."""
    keys = F.map_filter("_x", lambda k, _: k.startswith(".") & ~k.isin([f".{n}" for n in header]))
    own = {n: F.coalesce(F.try_element_at("_x", F.lit(f".{n}")), x) for n, x in header.items()}
    fixed = F.map_filter(F.create_map(*[x for n, v in own.items() for x in (F.lit(n), v)]), lambda _, v: v.isNotNull())
    return F.map_concat(F.transform_keys(keys, lambda k, _: F.substr(k, F.lit(2))), fixed)


def last_readable(texts: Column, now) -> Column:
    """The last text that is a time. A single one needs no look, as it is parsed later anyway."""
    return F.when(F.size(texts) == 1, F.get(texts, F.lit(0))).otherwise(
        F.try_element_at(F.filter(texts, lambda x: parse_timestamp(x, now).isNotNull()), F.lit(-1)))


def time_text(now) -> Column:
    pairs = F.filter(F.arrays_zip(c("_c").alias("key"), c("_w").alias("value")), lambda x: x["key"] == "@ts")
    return last_readable(F.transform(pairs, lambda x: x["value"]), now)


# ---- CEF ---------------------------------------------------------------------

def cef_parts(raw) -> Column:
    at = F.locate("CEF:", c(raw))
    return F.when(at > 0, F.split(F.substr(c(raw), at), r"\|", 8))


def cef_header(parts="p") -> dict:
    names = ["version", "vendor", "product", "device_version", "class_id", "name", "cef_severity"]
    return {n: F.try_element_at(c(parts), F.lit(i + 1)) for i, n in enumerate(names)}


KEY = r"(?:^|\s)([a-zA-Z][a-zA-Z0-9_]*)="


def cef_pairs(text) -> tuple[Column, Column]:
    """Keys and values of the extension; a value runs to the next key."""
    t = F.trim(F.coalesce(c(text), F.lit("")))
    # The space after a value belongs to the value, so it is cut with the key that follows it.
    cells = F.split(F.regexp_replace(t, r"\s+$", ""), r"(?:^|\s+)[a-zA-Z][a-zA-Z0-9_]*=")
    return F.regexp_extract_all(t, F.lit(KEY), 1), F.slice(cells, F.lit(2), F.size(cells))


def cef_extension(text) -> Column:
    keys, values = cef_pairs(text)
    return pairs_map(keys, values)


def pairs_map(keys: Column, values: Column) -> Column:
    """A map in which the last duplicate wins. Duplicates are rare, so they are looked for first. Keys and values are computed once, not once a pair."""
    def build(x):
        repeated = F.size(F.array_distinct(x["k"])) < F.size(x["k"])
        return F.when(repeated, last_wins(x["k"], x["w"])).otherwise(F.map_from_arrays(x["k"], x["w"]))
    return let(F.struct(keys.alias("k"), values.alias("w")), build)


def last_wins(keys: Column, values: Column) -> Column:
    """Keys and values to a map, later duplicates replacing earlier ones: a pair stays if it is the first of its key from the end."""
    def build(x):
        last = F.filter(x["pairs"], lambda p, i: F.array_position(x["back"], p["key"]) == F.size(x["back"]) - i)
        return F.map_from_entries(last)
    return let(F.struct(F.arrays_zip(keys.alias("key"), values.alias("value")).alias("pairs"), F.reverse(keys).alias("back")), build)


def cef_columns(lines: DataFrame, now: str) -> DataFrame:
    """Lines (with ``raw``) to typed columns; ``parse_error`` is set when the header is short."""
    d = lines.withColumn("_p", cef_parts("raw"))
    h = cef_header("_p")
    keys, values = cef_pairs(F.try_element_at("_p", F.lit(8)))
    known = {**CEF_ALIASES, "dst_hostname": [*CEF_ALIASES["dst_hostname"], "dst_hostname"]}
    d = claimed_pairs(with_pairs(d, keys, values), known, ["hostname", "user_name"], ["hostname", "user_name"])
    d, g = d.withColumn("ts_text", time_text(now)), claimed
    header = {"cef_vendor": h["vendor"], "cef_product": h["product"], "cef_name": h["name"], "cef_class_id": h["class_id"],
              "message": g("message"), "dst_hostname": g("dst_hostname")}
    return d.withColumns({
        "parse_error": F.when(F.size("_p") < 7, "short header").when(c("_p").isNull(), "no marker"),
        "event_type": F.concat(sanitize(h["product"]), F.lit("_"), sanitize(h["class_id"])), "severity": cef_severity(h["cef_severity"]),
        "src_ip": ipv4(g("src_ip")), "dst_ip": ipv4(g("dst_ip")), "src_port": unsigned(g("src_port"), PORT).cast("int"), "dst_port": unsigned(g("dst_port"), PORT).cast("int"),
        "protocol": F.lower(g("protocol")), "bytes_in": unsigned(g("bytes_in"), U64), "bytes_out": unsigned(g("bytes_out"), U64),
        "hostname": g("hostname"), "user_name": g("user_name"), "process_name": g("process_name"), "process_pid": unsigned(g("process_pid"), U32),
        "file_name": g("file_name"), "event_category": cef_category(g("category")), "event_ts": parse_timestamp("ts_text", now),
        "fields": F.when(c("_x").isNull(), F.create_map().cast("map<string,string>")).otherwise(plain_fields(header)),
    }).drop("_p", "_x", "_k", "_w", "_c")


# ---- LEEF --------------------------------------------------------------------

def leef_parts(raw) -> Column:
    at = F.locate("LEEF:", c(raw))
    return F.when(at > 0, F.split(F.substr(c(raw), at), r"\|", 6))


def leef_delimiter(version: Column, attrs: Column) -> Column:
    """Version 2 names its delimiter (character or ``xHH``); otherwise a tab."""
    field = F.split_part(attrs, F.lit("|"), F.lit(1))
    hexed = F.when(field.rlike(r"^[xX]\+?[0-9a-fA-F]{1,2}$"), F.chr(F.conv(F.regexp_replace(F.substring(field, 2, 3), r"\+", ""), 16, 10).cast("bigint")))
    two = F.when(field == "", "\t").when(field.rlike("^[xX]"), F.coalesce(hexed, F.lit("\t"))).otherwise(F.substring(field, 1, 1))
    return F.when(version.startswith("2"), two).otherwise("\t")


def leef_body(version: Column, attrs: Column) -> Column:
    return F.when(version.startswith("2") & attrs.contains("|"), F.substr(attrs, F.locate("|", attrs) + 1)).otherwise(attrs)


def leef_pairs(body: Column, delimiter: Column) -> tuple[Column, Column]:
    quoted = F.concat(F.lit("\\Q"), delimiter, F.lit("\\E"))
    parts = F.filter(F.split(body, quoted), lambda x: (F.locate("=", x) > 0) & (F.trim(F.split_part(x, F.lit("="), F.lit(1))) != ""))
    return (F.transform(parts, lambda x: F.trim(F.split_part(x, F.lit("="), F.lit(1)))),
            F.transform(parts, lambda x: F.trim(F.substr(x, F.locate("=", x) + 1))))


def leef_attributes(body: Column, delimiter: Column) -> Column:
    return pairs_map(*leef_pairs(body, delimiter))


def leef_columns(lines: DataFrame, now: str) -> DataFrame:
    part = lambda i: F.try_element_at("_p", F.lit(i))
    attrs = F.coalesce(part(6), F.lit(""))
    d = lines.withColumn("_p", leef_parts("raw")).withColumn("version", F.regexp_replace(part(1), "^(LEEF:)+", ""))
    d = d.withColumn("delimiter", leef_delimiter(c("version"), attrs))
    keys, values = leef_pairs(leef_body(c("version"), attrs), c("delimiter"))
    d = claimed_pairs(with_pairs(d, keys, values), LEEF_ALIASES, ["hostname", "user_name"], ["hostname"])
    d, g = d.withColumn("ts_text", time_text(now)), claimed
    header = {"leef_vendor": part(2), "leef_product": part(3), "leef_event_id": part(5), "message": g("message")}
    return d.withColumns({
        "parse_error": F.when(F.size("_p") < 5, "short header").when(c("_p").isNull(), "no marker"),
        "vendor": part(2), "product_name": part(3), "leef_event_id": part(5),
        "event_type": F.concat(sanitize(part(3)), F.lit("_leef_"), sanitize(part(5))), "severity": F.coalesce(F.when(g("severity").isNotNull(), leef_severity(g("severity"))), F.lit("info")),
        "src_ip": ipv4(g("src_ip")), "dst_ip": ipv4(g("dst_ip")), "src_port": unsigned(g("src_port"), PORT).cast("int"), "dst_port": unsigned(g("dst_port"), PORT).cast("int"),
        "protocol": F.lower(g("protocol")), "hostname": g("hostname"), "user_name": g("user_name"),
        "event_category": leef_category(g("category")), "event_ts": parse_timestamp("ts_text", now),
        "fields": F.when(c("_x").isNull(), F.create_map().cast("map<string,string>")).otherwise(plain_fields(header)),
    }).drop("_p", "_x", "_k", "_w", "_c")


# ---- JSON --------------------------------------------------------------------

def json_severity(text: Column, number: Column) -> Column:
    """Words by synonym, whole numbers by band, anything else info."""
    n = number.cast("bigint")
    band = F.when(n < 0, "info").when(n <= 2, "info").when(n <= 4, "low").when(n <= 6, "medium").when(n <= 8, "high").otherwise("critical")
    return F.when(text.isNotNull(), severity_words(F.lower(text), JSON_SEVERITY)).when(n.isNotNull(), band).otherwise("info")


def json_columns(lines: DataFrame, now: str) -> DataFrame:
    """JSON object lines to typed columns, from one parse of the line.

    Members count in the order of their names: the last alias of a field stands, even if its type does not fit (then the
    field is NULL); a host and a user keep the first text, an event type and a message the last text, the time the last
    text that is a time. Process ids are taken modulo 2^32.
    """
    members = F.try_variant_get(F.try_parse_json("raw"), "$", "map<string,variant>")
    text = lambda x: F.when(x["kind"] == "STRING", F.try_variant_get(x["x"], "$", "string")).when(x["kind"] != "VOID", F.to_json(x["x"]))
    read = lambda x: F.struct(x["kind"].alias("kind"), F.coalesce(text(x), F.lit("")).alias("text"))
    kinds = F.transform_values(members, lambda _, x: let(F.struct(F.schema_of_variant(x).alias("kind"), x.alias("x")), read))
    d = lines.withColumn("_kinds", kinds)
    of_kind = lambda name: F.transform_values(F.map_filter("_kinds", lambda _, x: x["kind"] == name), lambda _, x: x["text"])
    d = d.withColumns({"_str": of_kind("STRING"), "_int": of_kind("BIGINT")})
    at = lambda m, n: F.try_element_at(m, F.lit(n))
    ordered = {f: sorted(names) for f, names in JSON_ALIASES.items()}

    def last(m, f):
        return choose([(F.map_contains_key("_kinds", n), at(m, n)) for n in reversed(ordered[f])], F.lit(None))
    texts = lambda f: last("_str", f)
    nums = lambda f, lim: unsigned(last("_int", f), lim)
    pid = lambda f: nums(f, U64) % F.lit(U32 + 1)
    port = lambda f: F.coalesce(nums(f, PORT), unsigned(texts(f), PORT)).cast("int")
    first_text = lambda f: F.coalesce(*[at("_str", n) for n in ordered[f]])
    last_text = lambda f: F.coalesce(*[at("_str", n) for n in reversed(ordered[f])])
    times = F.filter(F.array(*[at("_str", n) for n in ordered["ts"]]), lambda x: x.isNotNull())
    d = d.withColumn("ts_text", last_readable(times, now))
    has_severity = F.arrays_overlap(F.map_keys("_kinds"), F.array(*[F.lit(n) for n in JSON_ALIASES["severity"]]))
    known = [n for names in JSON_ALIASES.values() for n in names]
    rest = F.transform_values(F.map_filter("_kinds", lambda k, _: ~k.isin(known)), lambda _, x: x["text"])
    msg = F.map_filter(F.create_map(F.lit("message"), last_text("message")), lambda _, v: v.isNotNull())
    return d.withColumns({
        "parse_error": F.when(c("_kinds").isNull(), "not an object"),
        "src_ip": ipv4(texts("src_ip")), "dst_ip": ipv4(texts("dst_ip")), "src_port": port("src_port"), "dst_port": port("dst_port"),
        "protocol": F.lower(texts("protocol")), "bytes_in": nums("bytes_in", U64), "bytes_out": nums("bytes_out", U64),
        "hostname": first_text("hostname"), "user_name": first_text("user_name"), "user_domain": texts("user_domain"), "process_name": texts("process_name"),
        "process_pid": pid("process_pid"), "process_ppid": pid("process_ppid"), "process_cmdline": texts("process_cmdline"), "process_path": texts("process_path"),
        "file_path": texts("file_path"), "file_name": texts("file_name"), "file_hash": texts("file_hash"), "file_size": nums("file_size", U64),
        "event_type": last_text("event_type"), "severity": F.when(has_severity, json_severity(texts("severity"), last("_int", "severity"))),
        "event_category": json_category(texts("category")), "event_ts": parse_timestamp("ts_text", now), "fields": F.map_concat(rest, msg),
    }).drop("_kinds", "_str", "_int")


# ---- syslog --------------------------------------------------------------------

def syslog_columns(lines: DataFrame, received="ts_received") -> DataFrame:
    raw = c("raw")
    pri = F.regexp_extract(raw, r"^<([^>]*)>", 1)
    n = F.coalesce(unsigned(pri, 255), F.lit(0)).cast("int")
    rest = F.ltrim(F.when(raw.rlike(r"^<[^>]*>"), F.regexp_replace(raw, r"(?s)^<[^>]*>", "")).otherwise(raw))
    d = lines.withColumns({"priority": n, "_rest": rest}).withColumn("_new", c("_rest").rlike("^[0-9]"))
    tok = F.split("_rest", " ", 8)
    at = lambda i: F.coalesce(F.try_element_at(tok, F.lit(i)), F.lit("-"))
    dash = lambda x: F.nullif(F.nullif(x, F.lit("-")), F.lit(""))
    iso = at(2)
    ts_new = F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"), iso.try_cast("timestamp").cast("timestamp_ntz"))
    stamped = F.length("_rest") >= 15
    stamp = F.regexp_replace(F.trim(F.substring("_rest", 1, 15)), " +", " ")
    ts_old = _ntz(F.when(stamped, F.concat(F.year(received).cast("string"), F.lit(" "), stamp)), "yyyy MMM d HH:mm:ss")
    after = F.when(stamped, F.ltrim(F.substr("_rest", F.lit(16)))).otherwise(c("_rest"))
    old = F.split(after, " ", 3)
    tag = F.trim(F.concat(F.coalesce(F.try_element_at(old, F.lit(2)), F.lit("")), F.coalesce(F.try_element_at(old, F.lit(3)), F.lit(""))))
    app = F.regexp_extract(tag, r"^([^\[: ]*)", 1)
    msg_old = F.regexp_replace(F.substr(tag, F.length(app) + 1), r"^[\[\]: ]+", "")
    pick = lambda new, other: F.when(c("_new"), new).otherwise(other)
    return d.withColumns({
        "event_type": F.lit("syslog_message"), "event_category": F.lit("other"), "severity": syslog_severity("priority"),
        "hostname": pick(dash(at(3)), F.nullif(F.coalesce(F.try_element_at(old, F.lit(1)), F.lit("")), F.lit(""))), "process_name": pick(dash(at(4)), F.nullif(app, F.lit(""))),
        "message": pick(F.coalesce(F.try_element_at(tok, F.lit(8)), F.lit("")), msg_old),
        "event_ts": F.coalesce(pick(ts_new, ts_old), c(received)),
    }).drop("_rest", "_new")


# ---- whole-event steps ---------------------------------------------------------

def ingest_lag_ms(ts="ts", received="ts_received") -> Column:
    ms = F.floor((micros(received) - micros(ts)) / 1000).cast("bigint")
    return F.greatest(F.lit(0), F.least(ms, F.lit(U32)))


# Fixed value: bytes of the raw line that enter the fingerprint.
RAW_BYTES = 256


def fingerprint_text(bucket_s: int | None = None) -> Column:
    empty = lambda x: F.coalesce(c(x).cast("string"), F.lit(""))
    head = F.substring(F.coalesce(c("raw"), F.lit("")).cast("binary"), 1, RAW_BYTES).cast("string")
    parts = [empty("tenant_id"), empty("hostname"), empty("event_type"), empty("src_ip"), empty("dst_ip"), empty("process_name"), head]
    if bucket_s:
        parts.append(F.floor(micros("ts") / (bucket_s * 1_000_000)).cast("string"))
    return F.concat_ws("\0", *parts)


def fingerprint(bucket_s: int | None = None) -> Column:
    """64-bit value over the canonical parts; a value already set is kept."""
    return F.xxhash64(fingerprint_text(bucket_s))


def newest_per_key(df: DataFrame, keys, received="ts_received", tie="event_id") -> DataFrame:
    """Replacement semantics: per key the row received last stays."""
    rest = [x for x in df.columns if x not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(received, tie)).alias("x")).select(*keys, "x.*")


def apply_defaults(df: DataFrame, defaults: dict, required) -> DataFrame:
    """Fill defaults and name the missing required columns in ``reject_reason`` (NULL = accepted)."""
    filled = {k: F.coalesce(c(k), F.lit(v)) if k in df.columns else F.lit(v) for k, v in defaults.items()}
    missing = F.concat_ws(",", *[F.when(c(k).isNull(), k) for k in required])
    return df.withColumns(filled).withColumn("reject_reason", F.when(missing != "", F.concat(F.lit("missing "), missing)))


def enum_or_default(col, words, default) -> Column:
    d = F.lit(default) if default is not None else F.lit(None).cast("string")
    return F.when(F.lower(c(col)).isin(words), F.lower(c(col))).otherwise(d)


def read_enums(df: DataFrame, enums: dict) -> DataFrame:
    """Every column that has a closed word set, read as its word in lower case or its default."""
    return df.withColumns({n: enum_or_default(n, *words) for n, words in enums.items() if n in df.columns})


def pretriage_severity(category="event_category", auth_result="auth_result") -> Column:
    """First severity before any rule ran (our definition): failed logins medium, other security
    relevant categories low, the rest info."""
    return (F.when(true_only(c(auth_result) == "failure"), "medium")
            .when(true_only(c(category).isin("authentication", "process", "account")), "low").otherwise("info"))


#: What a line can set, and the types; ``ts_text``, ``syslog_ts`` and ``parse_error`` are of the parsing itself.
PARSED = {
    "event_type": "string", "event_category": "string", "severity": "string", "hostname": "string", "user_name": "string", "user_domain": "string",
    "src_ip": "string", "dst_ip": "string", "src_port": "int", "dst_port": "int", "protocol": "string", "bytes_in": "bigint", "bytes_out": "bigint",
    "process_name": "string", "process_pid": "bigint", "process_ppid": "bigint", "process_path": "string", "process_cmdline": "string",
    "file_path": "string", "file_name": "string", "file_hash": "string", "file_size": "bigint", "message": "string", "fields": "map<string,string>",
}
_OWN = {"ts_text": "string", "syslog_ts": "timestamp_ntz", "parse_error": "string"}
KEPT_IF_SET = ["hostname", "user_name"]


def normalize(lines: DataFrame, now: str) -> DataFrame:
    """All dialects in one scan: lines with tenant_id, source_type, raw, ts_received to events.

    Columns of ``PARSED`` (and ``ts``) that the lines bring along are kept where parsing gives nothing: rows of agents
    pass through as they are. A host or user that is set already stays. Each dialect sees NULL instead of the lines of
    the others, so its expressions fall through cheaply, and its columns are packed into one struct that is only made for
    its own lines.
    """
    prior = [x for x in PARSED if x in lines.columns]
    keep = [x for x in lines.columns if x not in PARSED and x != "parse_error"]
    given = F.struct(*[c(x).cast(PARSED[x]).alias(x) for x in prior], F.lit(None).alias("_none"))
    d = lines.select(*keep, given.alias("_prior"), detect_format().alias("format"), c("raw").alias("_line"))
    dialects = [("cef", lambda x: cef_columns(x, now)), ("leef", lambda x: leef_columns(x, now)),
                ("json", lambda x: json_columns(x, now)), ("collector_parsed", syslog_columns)]
    for name, build in dialects:
        base = d.columns
        out = build(d.withColumn("raw", F.when(c("format") == name, c("_line"))))
        if name == "collector_parsed":
            out = out.withColumnRenamed("event_ts", "syslog_ts")
        cells = [(c(x) if x in out.columns else F.lit(None)).cast(kind).alias(x) for x, kind in {**PARSED, **_OWN}.items()]
        d = out.select(*base, F.when(c("format") == name, F.struct(*cells)).alias(f"_{name}"))
    picked = F.coalesce(*[c(f"_{n}") for n, _ in dialects])
    out = d.withColumn("raw", c("_line")).withColumn("_one", picked)

    def cell(x):
        new, old = c(f"_one.{x}"), c(f"_prior.{x}") if x in prior else F.lit(None).cast(PARSED[x])
        return (F.coalesce(F.nullif(old, F.lit("")), new) if x in KEPT_IF_SET else F.coalesce(new, old)).alias(x)

    out = out.select(*keep, "format", *[cell(x) for x in PARSED], *[c(f"_one.{x}") for x in _OWN])
    # One timestamp parser for all dialects: the text is chosen first.
    known = [c("ts")] if "ts" in keep else []
    return (out.withColumn("ts", F.coalesce("syslog_ts", parse_timestamp("ts_text", now), *known, "ts_received")).drop("syslog_ts", "ts_text")
            .withColumn("ingest_lag_ms", ingest_lag_ms()).withColumn("dedup_hash", fingerprint()))
