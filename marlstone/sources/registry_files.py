"""Profiles (a subset of YAML), the address registry (TSV), and bus subjects."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.plans.errors import Invalid

#: Hex digits of a prefix by its registry.
WIDTHS = {"L": 6, "M": 7, "S": 9}


def oui_registry(spark: SparkSession, path: str) -> DataFrame:
    """(prefix, registry, organisation) of a tab-separated file; lines of another form are left out."""
    return oui_rows(spark.read.text(path))


def oui_rows(text: DataFrame) -> DataFrame:
    """The same of lines (value) that are read already."""
    lines = text.select(F.split("value", "\t").alias("p")).where(F.size("p") >= 3)
    out = lines.select(F.lower(F.trim(F.col("p")[0])).alias("prefix"), F.trim(F.col("p")[1]).alias("registry"), F.trim(F.col("p")[2]).alias("organisation"))
    return out.where(F.col("prefix").rlike("^([0-9a-f]{6}|[0-9a-f]{7}|[0-9a-f]{9})$") & (F.col("organisation") != ""))


def parse_yaml(text: str):
    """Mappings, lists and scalars by indentation; what device profiles are written in. JSON is read too."""
    if text.lstrip().startswith(("{", "[")):
        return json.loads(text)
    lines = []
    for raw in text.splitlines():
        bare = _uncomment(raw).rstrip()
        if bare.strip() and bare.strip() != "---":
            lines.append((len(bare) - len(bare.lstrip(" ")), bare.strip()))
    value, rest = _block(lines, 0)
    if rest != len(lines):
        raise Invalid(f"not understood: {lines[rest][1]}")
    return value


def _uncomment(line: str) -> str:
    quote = None
    for i, c in enumerate(line):
        if quote:
            quote = None if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "#" and (i == 0 or line[i - 1] == " "):
            return line[:i]
    return line


def _block(lines, at):
    depth, first = lines[at]
    out = [] if first.startswith("- ") or first == "-" else {}
    while at < len(lines) and lines[at][0] == depth:
        text = lines[at][1]
        if isinstance(out, list):
            if not (text.startswith("- ") or text == "-"):
                break
            item = text[1:].strip()
            if item and _is_pair(item):
                inner = depth + len(text) - len(item)
                lines[at] = (inner, item)
                value, at = _block(lines, at)
            elif item:
                value, at = _scalar(item), at + 1
            else:
                value, at = _block(lines, at + 1)
            out.append(value)
            continue
        key, _, rest = text.partition(":")
        if not _is_pair(text):
            raise Invalid(f"not understood: {text}")
        at += 1
        if rest.strip():
            out[_scalar(key.strip())] = _scalar(rest.strip())
        elif at < len(lines) and (lines[at][0] > depth or lines[at][0] == depth and lines[at][1].startswith("- ")):
            out[_scalar(key.strip())], at = _block(lines, at)
        else:
            out[_scalar(key.strip())] = None
    return out, at


def _is_pair(text: str) -> bool:
    if text[:1] in "\"'[{":
        return False
    return text.endswith(":") or ": " in text


def _scalar(text: str):
    if text[:1] in "\"'" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        inner = text[1:-1].strip()
        return [_scalar(x.strip()) for x in inner.split(",")] if inner else []
    if text in ("true", "false"):
        return text == "true"
    if text in ("null", "~"):
        return None
    for kind in (int, float):
        try:
            return kind(text) if not (text.count(".") > 1) else text
        except ValueError:
            continue
    return text


def profiles(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """(profile_id, prefix, definition) of profile files by name: one row for each prefix that a profile matches."""
    rows = []
    for name, text in sorted(texts.items()):
        body = parse_yaml(text)
        match = body.get("match") or {}
        prefixes = match.get("sysobjectid") or match.get("sysobjectid_prefix") or match.get("sysobjectids") or []
        prefixes = prefixes if isinstance(prefixes, list) else [prefixes]
        rows += [(str(body.get("id") or body.get("name") or name), str(p), json.dumps(body)) for p in prefixes or [""]]
    return spark.createDataFrame(rows, "profile_id string, prefix string, definition string")


@dataclass(frozen=True)
class Pattern:
    """A pattern of bus subjects ``telemetry.<tenant>.<signal>.<source>``: * stands for one token, a final > for the
    rest, one token or more."""

    text: str

    def __post_init__(self):
        parts = self.text.split(".")
        if not self.text or any(not p for p in parts) or ">" in parts[:-1] or any(len(p) > 1 and ("*" in p or ">" in p) for p in parts):
            raise Invalid(f"not a subject pattern: {self.text!r}")

    def matches(self, subject: Column) -> Column:
        import re

        parts = ["[^.]+" if p == "*" else r"[^.]+(\.[^.]+)*" if p == ">" else re.escape(p) for p in self.text.split(".")]
        return subject.rlike("^" + r"\.".join(parts) + "$")


def subject(tenant: Column, signal: Column, source: Column) -> Column:
    return F.concat_ws(".", F.lit("telemetry"), tenant, signal, source)
