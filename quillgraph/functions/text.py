"""Text functions with the white space, lengths and trimming of ECMAScript strings.

All are Catalyst expressions. Lengths count UTF-16 units; white space includes the
no-break, typographic and byte-order characters that Java's \\s leaves out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the white space characters, for a regular expression class.
WS = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def trim_ws(column: Column | str) -> Column:
    return F.regexp_replace(_c(column), rf"\A[{WS}]+|[{WS}]+\z", "")


def collapse_ws(column: Column | str) -> Column:
    return F.regexp_replace(_c(column), rf"[{WS}]+", " ")


def utf16_length(column: Column | str) -> Column:
    return (F.octet_length(F.encode(_c(column), "UTF-16BE")) / 2).cast("int")


def estimate_tokens(column: Column | str) -> Column:
    """Four UTF-16 units a token, rounded up."""
    return F.floor((utf16_length(column) + 3) / 4).cast("int")


def norm_key(column: Column | str) -> Column:
    """Lower case, one leading article off, all but letters and digits to blanks, blanks collapsed, trimmed."""
    bare = F.regexp_replace(F.lower(_c(column)), rf"\A(the|a|an)[{WS}]+", "")
    return trim_ws(collapse_ws(F.regexp_replace(bare, rf"[^\p{{L}}\p{{N}}{WS}]", " ")))


def sanitize_title(column: Column | str) -> Column:
    """First line with text, without quotes, marks and closing stops around it, 80 characters at most; null if nothing is left."""
    lines = F.filter(F.transform(F.split(_c(column), "\n"), trim_ws), lambda s: s != "")
    bare = F.regexp_replace(F.try_element_at(lines, F.lit(1)), rf"\A[\"'“”‘’#*{WS}]+|[\"'“”‘’.!*{WS}]+\z", "")
    return F.nullif(trim_ws(F.substring(bare, 1, 80)), F.lit(""))


def file_extension(column: Column | str) -> Column:
    """Lower-cased text after the last dot; the whole name where there is none."""
    return F.element_at(F.split(F.lower(file_name(column)), r"\."), -1)


def file_name(column: Column | str) -> Column:
    return F.element_at(F.split(_c(column), "/"), -1)


def file_title(column: Column | str) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(file_name(column), r"\.[^.]+\z", "")


def xml_escape(column: Column | str) -> Column:
    out = _c(column)
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def yaml_string(column: Column | str) -> Column:
    out = F.replace(F.replace(_c(column), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), out, F.lit('"'))


def slug_title(column: Column | str) -> Column:
    """A file name from a title: illegal characters to underscores, trimmed, `graph` if nothing is left."""
    raw = F.coalesce(F.nullif(_c(column), F.lit("")), F.lit("graph"))
    return F.coalesce(F.nullif(trim_ws(F.regexp_replace(raw, r'[\\/:*?"<>|]', "_")), F.lit("")), F.lit("graph"))


def number_text(column: Column | str, digits: int = 15) -> Column:
    """A double as a plain decimal number without trailing zeros: 1 for 1.0, 0.0001 for 1.0E-4."""
    plain = F.format_string(f"%.{digits}f", _c(column))
    return F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+\z", "$1"), r"\.\z", "")


def round_half_up(column: Column | str) -> Column:
    """To the nearest whole number, halves towards positive infinity."""
    return F.floor(_c(column) + 0.5)
