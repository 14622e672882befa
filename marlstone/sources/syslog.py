"""Syslog: framing, both message formats, and log rows.

Both formats are read by expressions.  Structured data may have escapes, which no regular expression follows; such
messages, and those whose parameters repeat, are read by an Arrow UDF.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.columns import NIL

MOST_FRAME, MOST_DIGITS = 64 * 1024, 20
#: Names by the low three bits of a priority, as they are stored.
SEVERITY_BY_CODE = ("emergency", "alert", "critical", "error", "warn", "notice", "info", "debug")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
PRIORITY = r"^<(0|[1-9][0-9]{0,2})>"
STAMP = r"^(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) ([ 0-9][0-9]) ([0-9]{2}):([0-9]{2}):([0-9]{2})"
TAG = r"^([A-Za-z0-9_.\-]{1,32})(?:\[([^\]]*)\]:?|:)"


def frames(data: bytes) -> tuple[list[str], bytes, str | None]:
    """Messages of a TCP stream so far, what is left of it, and what is wrong with that: octet-counted if it begins with
    a digit, else lines; blank lines are skipped. After a bad count or a frame over 64 KiB nothing can be told apart, so
    the rest stays unread; the messages before it count."""
    out: list[str] = []
    counted = data[:1].isdigit()
    while data:
        if counted:
            head, space, rest = data.partition(b" ")
            if not head.isdigit() and (space or len(head) > MOST_DIGITS) or len(head) > MOST_DIGITS:
                return out, data, "not an octet count"
            if not space:
                break
            n = int(head)
            if n > MOST_FRAME:
                return out, data, "a frame is too long"
            if len(rest) < n:
                break
            message, data = rest[:n], rest[n:]
        else:
            message, feed, rest = data.partition(b"\n")
            if len(message) > MOST_FRAME:
                return out, data, "a line is too long"
            if not feed:
                break
            data = rest
        text = decode(message)
        if text.strip():
            out.append(text)
    return out, data, None


def decode(data: bytes) -> str:
    """UTF-8 with replacements, without line ends."""
    return data.decode("utf-8", "replace").rstrip("\r\n")


def framed(streams: DataFrame, data: str = "data") -> DataFrame:
    """Rows of whole captured streams (binary ``data``) as one row a message: ``raw``; what a stream ends with
    unfinished is a message if it is a line. Messages before an error count; :func:`unframed` tells what is lost."""
    return streams.withColumn("raw", F.explode(_frames(F.col(data))["messages"])).drop(data)


def unframed(streams: DataFrame, data: str = "data") -> DataFrame:
    """Streams of which something could not be told apart: without ``data``, with ``frame_error`` and ``bytes_lost``."""
    out = streams.withColumn("_f", _frames(F.col(data))).where("_f.error IS NOT NULL")
    return out.withColumns({"frame_error": F.col("_f.error"), "bytes_lost": F.col("_f.lost")}).drop("_f", data)


def _frames(data: Column) -> Column:
    @F.pandas_udf("messages array<string>, error string, lost long")
    def run(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            whole = bytes(v or b"")
            got, rest, error = frames(whole)
            if not error and rest.strip() and whole[:1].isdigit():
                error = "ends within a frame"
            elif not error and rest.strip():
                got.append(decode(rest))
            rows.append((got, error, len(rest) if error else 0))
        return pd.DataFrame(rows, columns=["messages", "error", "lost"])

    return run(data)


def structured(tail: str) -> tuple[dict[str, str], str, str | None]:
    """Parameters as id.name, the message, and what was wrong: of the part that begins with structured data."""
    if tail.startswith("-"):
        return {}, tail[1:].removeprefix(" "), None
    found: dict[str, str] = {}
    at = 0
    while tail.startswith("[", at):
        name, value, ident = [], None, None
        i, ended = at + 1, False
        while i < len(tail):
            c = tail[i]
            if value is not None:
                if c == "\\" and i + 1 < len(tail) and tail[i + 1] in '"\\]':
                    value.append(tail[i + 1])
                    i += 1
                elif c == '"':
                    if ident and name:
                        found[f"{ident}.{''.join(name)}"] = "".join(value)
                    name, value = [], None
                else:
                    value.append(c)
            elif c == "]":
                ended = True
                break
            elif c == '"' and name and name[-1] == "=":
                name.pop()
                value = []
            elif c.isspace():
                if ident is None:
                    ident = "".join(name)
                name = []
            else:
                name.append(c)
            i += 1
        if not ended:
            return {}, tail[at:], "rfc5424: unterminated structured data"
        at = i + 1
    return found, tail[at:].removeprefix(" ") if at else tail, None


#: Structured data without escapes or brackets in its values, one element of it, and one parameter.
ELEMENT = r'\[[^\s\]"=]+(?: [^\s\]"=]+="[^"\\\]]*")*\]'
PARAMETER = r' ([^\s\]"=]+)="([^"\\\]]*)"'
PLAIN_DATA = f"^(?:{ELEMENT})+"


def plain_pairs(tail: Column) -> Column:
    """The parameters, as structs of id.name and value, of structured data that PLAIN_DATA matches."""
    def of(element: Column) -> Column:
        ident = F.regexp_extract(element, r'^\[([^\s\]"=]+)', 1)
        names, values = (F.regexp_extract_all(element, F.lit(PARAMETER), F.lit(i)) for i in (1, 2))
        return F.zip_with(names, values, lambda n, v: F.struct(F.concat(ident, F.lit("."), n).alias("key"), v.alias("value")))

    return F.flatten(F.transform(F.regexp_extract_all(F.regexp_extract(tail, PLAIN_DATA, 0), F.lit(ELEMENT), F.lit(0)), of))


def _structured(tail: Column) -> Column:
    @F.pandas_udf("data map<string,string>, body string, error string")
    def run(tails: pd.Series) -> pd.DataFrame:
        rows = [structured(t or "") for t in tails]
        return pd.DataFrame({"data": [d for d, _, _ in rows], "body": [b for _, b, _ in rows], "error": [e for _, _, e in rows]})

    return run(tail)


def _none(c: Column) -> Column:
    return F.when((c != "-") & (c != ""), c)


def parse(rows: DataFrame, raw: str = "raw", received_at: str = "received_at") -> DataFrame:
    """``rows`` with facility, severity, timestamp, hostname, app_name, proc_id, msg_id, structured_data, body and
    parse_error. No message is refused: what can't be read stays in the body, with the reason.

    A time without a year is of the year in which the message came, or the one before if that puts it more
    than a day ahead.
    """
    text = F.regexp_replace(F.coalesce(F.col(raw), F.lit("")), r"[\r\n]+$", "")
    out = rows.withColumn("_t", text).withColumn("_pri", F.regexp_extract("_t", PRIORITY, 1))
    out = out.withColumn("_pri", F.when((F.col("_pri") != "") & (F.col("_pri").try_cast("int") <= 191), F.col("_pri").try_cast("int")))
    out = out.withColumn("_rest", F.when(F.col("_pri").isNotNull(), F.regexp_replace("_t", PRIORITY, "")))
    out = out.withColumn("_new", F.coalesce(F.col("_rest").rlike("^[1-9] "), F.lit(False)))
    # the newer format: six fields, the last with structured data and message
    parts = F.split(F.expr("substring(_rest, 3)"), " ", 6)
    field = lambda i: F.when(F.col("_new"), _none(F.get(parts, F.lit(i))))
    tail = F.when(F.col("_new") & (F.size(parts) > 5), F.get(parts, F.lit(5)))
    out = out.withColumns({"_at5": field(0), "_host5": field(1), "_app5": field(2), "_proc5": field(3), "_msg5": field(4), "_tail": tail})
    none = F.coalesce(~F.startswith(F.col("_tail"), F.lit("[")), F.lit(True))
    out = out.withColumn("_pairs", F.when(~none & F.col("_tail").rlike(PLAIN_DATA), plain_pairs(F.col("_tail"))))
    keys = F.transform("_pairs", lambda x: x["key"])
    out = out.withColumn("_plain", F.coalesce(F.size("_pairs") == F.size(F.array_distinct(keys)), F.lit(False)))
    out = out.withColumn("_sd", F.when(~none & ~F.col("_plain"), _structured(F.when(~none & ~F.col("_plain"), F.col("_tail")))))
    body5 = (
        F.when(none, F.regexp_replace(F.coalesce("_tail", F.lit("")), "^-( |$)?", ""))
        .when(F.col("_plain"), F.regexp_replace("_tail", f"{PLAIN_DATA} ?", "")).otherwise(F.col("_sd.body"))
    )
    # the time alone decides whether it is one
    time5 = F.when(F.col("_at5").rlike(r"^\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"), F.try_to_timestamp(F.upper("_at5")))
    # the older format: a stamp of fifteen characters, a host, a tag
    old = F.col("_rest").isNotNull() & ~F.col("_new")
    # the stamp has a fixed width
    stamped = old & F.col("_rest").rlike(STAMP)
    number = lambda at, n: F.trim(F.substring("_rest", at, n)).cast("int")
    month = ((F.position(F.substring("_rest", 1, 3), F.lit("".join(MONTHS))) + 2) / 3).cast("int")
    now = F.col(received_at)
    of_year = lambda y: F.try_make_timestamp(y, month, number(5, 2), number(8, 2), number(11, 2), number(14, 2))
    out = out.withColumn("_this", F.when(stamped, of_year(F.year(now))))
    late = F.col("_this") > now + F.expr("INTERVAL 1 DAY")
    time3 = F.when(late, of_year(F.year(now) - 1)).otherwise(F.col("_this"))
    out = out.withColumns({"_time3": time3, "_time5": time5})
    out = out.withColumn("_after", F.when(F.col("_time3").isNotNull(), F.ltrim(F.expr("substring(_rest, 17)"))))
    out = out.withColumns({"_host3": F.nullif(F.substring_index("_after", " ", 1), F.lit("")), "_text3": F.ltrim(F.regexp_replace("_after", r"^[^ ]* ?", ""))})
    tag = F.nullif(F.regexp_extract("_text3", TAG, 1), F.lit(""))
    pid = F.when(F.col("_text3").rlike(r"^[A-Za-z0-9_.\-]{1,32}\["), F.regexp_extract("_text3", TAG, 2))
    body3 = F.when(tag.isNotNull(), F.ltrim(F.regexp_replace("_text3", TAG, ""))).otherwise(F.col("_text3"))
    short = F.length("_rest") < 15
    error = (
        F.when(F.col("_t") == "", "empty message").when(F.col("_rest").isNull(), "no priority")
        .when(F.col("_new") & F.col("_at5").isNotNull() & F.col("_time5").isNull(), "rfc5424: unreadable timestamp")
        .when(F.col("_new") & F.col("_tail").isNull(), "rfc5424: header ended early").when(F.col("_new"), F.col("_sd.error"))
        .when(short, "rfc3164: too short for a timestamp").when(F.col("_time3").isNull(), "rfc3164: unreadable timestamp")
        .when(F.col("_host3").isNull(), "rfc3164: no hostname")
    )
    pri = F.coalesce("_pri", F.lit(13))
    body = F.when(F.col("_rest").isNull(), F.col("_t")).when(F.col("_new"), body5).when(F.col("_time3").isNull(), F.col("_rest")).otherwise(F.coalesce(body3, F.lit("")))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return out.select(
        *rows.columns, F.shiftright(pri, 3).cast("smallint").alias("facility"),
        F.element_at(F.array(*map(F.lit, SEVERITY_BY_CODE)), pri.bitwiseAND(F.lit(7)) + 1).alias("severity"),
        F.coalesce("_time5", "_time3").alias("timestamp"), F.coalesce("_host5", "_host3").alias("hostname"), F.coalesce("_app5", tag).alias("app_name"),
        F.coalesce("_proc5", pid).alias("proc_id"), F.col("_msg5").alias("msg_id"), F.when(F.col("_plain"), F.map_from_entries("_pairs")).otherwise(F.coalesce("_sd.data", empty)).alias("structured_data"),
        F.regexp_replace(body, "^\\uFEFF", "").alias("body"), error.alias("parse_error"),
    )


def log_rows(parsed: DataFrame, peer: str = "peer", received_at: str = "received_at") -> DataFrame:
    """Log rows of parsed messages, with attributes under their conventional names."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (
        ("host.name", F.col("hostname")), ("service.name", F.col("app_name")), ("process.pid", F.col("proc_id")), ("syslog.facility", F.col("facility").cast("string")),
        ("syslog.msgid", F.col("msg_id")), ("syslog.source.address", F.col(peer)), ("parse.error", F.col("parse_error")),
        ("syslog.timestamp.missing", F.when(F.col("timestamp").isNull(), "true")))])
    sd = F.transform(F.map_entries("structured_data"), lambda e: F.struct(F.concat(F.lit("syslog.sd."), e["key"]).alias("key"), e["value"].alias("value")))
    attributes = F.map_from_entries(F.array_sort(F.filter(F.concat(pairs, sd), lambda e: e["value"].isNotNull())))
    have = set(parsed.columns)
    given = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in have else F.lit(d)
    return parsed.select(
        given("tenant_id", NIL).alias("tenant_id"), given("resource_id", NIL).alias("resource_id"), given("site_id", NIL).alias("site_id"),
        F.coalesce("timestamp", received_at).alias("observed_at"), F.col(received_at).alias("ingested_at"), F.lit("syslog").alias("source_kind"), given("source_vendor", "").alias("source_vendor"),
        "severity", "facility", "body", attributes.alias("attributes"), F.lit("").alias("trace_id"), F.lit("").alias("span_id"),
    )


def identifiers(parsed: DataFrame, obs_id: str, peer: str = "peer") -> DataFrame:
    """Observed identifiers: the sender's address, and the name it gives itself in lower case."""
    both = F.array(F.struct(F.lit("mgmt_ip").alias("kind"), F.col(peer).alias("value")), F.struct(F.lit("hostname").alias("kind"), F.lower("hostname").alias("value")))
    return parsed.select(F.col(obs_id).alias("obs_id"), F.inline(F.filter(both, lambda x: x["value"].isNotNull())))
