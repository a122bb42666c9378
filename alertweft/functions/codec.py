"""Base64, UTF-16LE, hex and URL codecs that never raise on bad input."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from alertweft.fixed import ENCODED_ARGUMENT


def base64_bytes(token: Column) -> Column:
    """Bytes of a base64 token; padding is optional, garbage and a lone last character give null."""
    body = F.regexp_replace(token, "=+$", "")
    return F.try_to_binary(F.when(F.length(body) % 4 != 1, body), F.lit("base64"))


def base64_text(data: Column) -> Column:
    """Base64 in one line, without the MIME line breaks."""
    return F.translate(F.base64(data), "\r\n", "")


def utf16le_text(data: Column) -> Column:
    """Text of UTF-16LE bytes; an odd last byte and undecodable units are dropped."""
    even = F.substring(data, F.lit(1), (F.length(data) - F.length(data) % 2).cast("int"))
    return F.replace(F.decode(even, "UTF-16LE"), F.lit("\ufffd"), F.lit(""))


def utf8_text(data: Column) -> Column:
    """UTF-8 text; bytes that are not valid UTF-8 are dropped."""
    return F.replace(F.make_valid_utf8(data.cast("string")), F.lit("\ufffd"), F.lit(""))


def encoded_command(command: Column) -> Column:
    """Decoded text of an ``-enc`` style argument, '' when there is none or it is broken."""
    token = F.regexp_extract(command, "(?i)" + ENCODED_ARGUMENT, 2)
    return F.coalesce(F.when(token != "", utf16le_text(base64_bytes(token))), F.lit(""))


def quoted_concat(command: Column) -> Column:
    """Join ``('a' + 'b')`` fragments and apply a following ``.Replace('x',[char]n)``."""
    group = F.regexp_extract(command, r"\(\s*((?:'[^']*'\s*\+\s*)+'[^']*')\s*\)", 1)
    text = F.array_join(F.regexp_extract_all(group, F.lit("'([^']*)'"), F.lit(1)), "")
    swap = r"(?i)\.replace\(\s*'([^']*)'\s*,\s*(?:\[[^\]]*\]\s*)*\[char\]\s*(\d+)"
    needle = F.regexp_extract(command, swap, 1)
    code = F.regexp_extract(command, swap, 2)
    char = F.decode(F.unhex(F.lpad(F.hex(code.try_cast("bigint")), 4, "0")), "UTF-16BE")
    replaced = F.when((code != "") & (needle != ""), F.replace(text, needle, char)).otherwise(text)
    return F.when(group == "", F.lit("")).otherwise(replaced)


def hex_text(value: Column) -> Column:
    """Text of hex-encoded UTF-8 bytes."""
    return utf8_text(F.unhex(value))


def url_json_array(parameter: Column) -> Column:
    """URL-decode, base64-decode and parse a JSON array of strings."""
    data = base64_bytes(F.try_url_decode(parameter))
    return F.from_json(utf8_text(data), "array<string>")


# Registry of derivation methods: name -> Column builder.
DERIVERS = {"base64_utf16le": encoded_command, "ps_deobfuscate_concat": quoted_concat}


def derive(method: str, field: Column) -> Column:
    """Look a derivation method up; an unknown name is an analysis-time error."""
    if method not in DERIVERS:
        raise ValueError(f"unknown derivation method {method!r}; known: {sorted(DERIVERS)}")
    return DERIVERS[method](F.coalesce(field, F.lit("")))
