"""Text columns: white space in the Unicode sense, splitting, escaping, paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: All Unicode white space, with the four separators that (?U)\s leaves out.
WS = r"[\s\x1c-\x1f]"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    return F.regexp_replace(_col(x), rf"(?U)^{WS}+|{WS}+\z", "")


def collapse(x: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(_col(x), rf"(?U){WS}+", " "))


def paragraphs(x: Column | str) -> Column:
    """Parts between blank lines, stripped, in order, without empty ones."""
    parts = F.transform(F.split(strip(x), rf"(?U)\n{WS}*\n"), strip)
    return F.filter(parts, lambda p: p != "")


def answer_parts(x: Column | str) -> Column:
    """Parts between blank lines, stripped; empty ones count."""
    return F.transform(F.split(strip(x), rf"(?U)\n{WS}*\n"), strip)


def escape_html(x: Column | str) -> Column:
    out = _col(x)
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def spaced_controls(x: Column | str) -> Column:
    return F.regexp_replace(_col(x), r"[\x00-\x1f]+", " ")


def estimate_tokens(x: Column | str) -> Column:
    """A token for every four code points begun."""
    return F.ceil(F.length(_col(x)) / 4).cast("int")


def dirname(x: Column | str) -> Column:
    return F.regexp_extract(_col(x), r"^(.*)/[^/]*$", 1)


def basename(x: Column | str) -> Column:
    return F.substring_index(_col(x), "/", -1)


def path_join(folder: Column, name: Column) -> Column:
    return F.when(folder == "", name).otherwise(F.concat(folder, F.lit("/"), name))
