"""JSON, YAML, time and base64 forms of values (F18-F20), CRC (V29), name globs (P21), URIs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_json(value: Column) -> Column:
    return F.to_json(value)


def from_json(text: Column, schema: str) -> Column:
    """A value of the given schema; null where the text is no such JSON."""
    return F.from_json(text, schema)


def to_yaml(fields: dict[str, Column]) -> Column:
    """A flat mapping as YAML lines; nulls are `null` and texts are quoted."""
    lines = []
    for name, c in fields.items():
        text = F.when(c.isNull(), "null").when(F.typeof(c) == "string", F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))).otherwise(c.cast("string"))
        lines.append(F.concat(F.lit(f"{name}: "), text, F.lit("\n")))
    return F.concat(*lines)


def from_yaml(text: Column) -> Column:
    """A flat mapping's lines as a map of texts; comments and blank lines go, quotes are taken off, null stays null."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"^[^#\s][^:]*:")))

    def value(x: Column) -> Column:
        raw = F.trim(F.regexp_extract(x, r"^[^:]+:(.*)$", 1))
        quoted = F.regexp_like(raw, F.lit("^'.*'$"))
        return F.when(quoted, F.replace(F.substr(raw, F.lit(2), F.length(raw) - 2), F.lit("''"), F.lit("'"))).when(~raw.isin("null", "~", ""), raw)

    return F.map_from_arrays(F.transform(lines, lambda x: F.regexp_extract(x, r"^([^:]+):", 1)), F.transform(lines, value))


def to_epoch(ts: Column) -> Column:
    """Seconds since 1970 (UTC), with their fraction."""
    return F.unix_micros(ts) / F.lit(1e6)


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_micros((seconds * 1_000_000).cast("long"))


def to_iso(ts: Column) -> Column:
    """ISO 8601 to the second, in the session's time zone."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def to_base64(data: Column) -> Column:
    return F.base64(data)


def from_base64(text: Column) -> Column:
    """The bytes of a base64 text; null where it is none."""
    return F.try_to_binary(text, F.lit("base64"))


def crc(data: Column) -> Column:
    """CRC-32 as an unsigned number."""
    return F.crc32(data)


def glob(name: Column, pattern: str) -> Column:
    """Whether a whole name matches a shell pattern: * any run, ? any character, [abc] and [!abc] sets."""
    out, at = "", 0
    while at < len(pattern):
        c = pattern[at]
        end = pattern.find("]", at + 2) if c == "[" else -1
        if c == "[" and end > 0:
            body = pattern[at + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("^", "\\^")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            at = end
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
        at += 1
    return F.regexp_like(name, F.lit(f"(?s)^{out}$"))


def parse_uri(uri: Column) -> Column:
    """(scheme, host, path) of a URI; a plain path has null scheme and host."""
    part = lambda i: F.regexp_extract(uri, r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*)://([^/]*))?(.*)$", i)
    return F.struct(F.nullif(part(1), F.lit("")).alias("scheme"), F.nullif(part(2), F.lit("")).alias("host"), part(3).alias("path"))
