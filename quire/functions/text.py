"""Text as column expressions: escaping, trimming, names, paths, normalising for comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters that markup escapes with a backslash, after the backslash itself and the double slash.
MARKUP = "@$#*_<>[]"
#: The five entities of XML text, in the order of replacing.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z only."""
    return F.translate(text, UPPER, LOWER)


def ascii_upper(text: Column) -> Column:
    return F.translate(text, LOWER, UPPER)


def escape_markup(text: Column) -> Column:
    """Text so that markup shows it as it is."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("//"), F.lit("\\/\\/"))
    return F.regexp_replace(out, r"([@$#*_<>\[\]])", r"\\$1")


def escape_string(text: Column) -> Column:
    """Text inside a quoted string."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def escape_xml(text: Column) -> Column:
    for character, entity in ENTITIES:
        text = F.replace(text, F.lit(character), F.lit(entity))
    return text


def trim_space(text: Column) -> Column:
    """Without white space, in the Unicode sense, at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def trim_end(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "")


def shorten(text: Column, limit: int) -> Column:
    """The trimmed text, cut with an ellipsis so that it has at most `limit` characters."""
    trimmed = trim_space(text)
    return F.when(F.char_length(trimmed) <= limit, trimmed).otherwise(F.concat(F.substring(trimmed, 1, limit - 1), F.lit("…")))


def slug(text: Column) -> Column:
    """Letters and digits of ASCII in lower case, all others as hyphens, none at the ends."""
    return F.regexp_replace(ascii_lower(F.regexp_replace(text, "[^0-9A-Za-z]", "-")), "^-+|-+$", "")


def normalize_path(path: Column) -> Column:
    """Path without empty parts and dots; a double dot takes back one part, and none at the root."""
    keep = lambda held, part: F.when(part.isin("", "."), held).when(part == "..", F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))).otherwise(F.array_append(held, part))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), keep), "/")


def resolve_target(source: Column, target: Column, mode: Column) -> Column:
    """What a relationship of a part points to: external targets as they are, others from the part's folder or the root."""
    folder = F.regexp_extract(source, "^(.*)/[^/]*$", 1)
    joined = F.when(target.startswith("/"), target).otherwise(F.concat_ws("/", folder, target))
    return F.when(mode.eqNullSafe("External"), target).otherwise(normalize_path(joined))


def relationships_part(part: Column) -> Column:
    """The part that holds the relationships of a part."""
    return F.regexp_replace(part, "^(.*/)?([^/]*)$", "$1_rels/$2.rels")


def normalize_for_comparison(text: Column) -> Column:
    """Letters and digits, A-Z in lower case, all others as a space."""
    return ascii_lower(F.regexp_replace(text, r"[^\p{IsAlphabetic}\p{N}]", " "))


def comparison_tokens(text: Column) -> Column:
    return F.filter(F.split(normalize_for_comparison(text), " +"), lambda t: t != "")


def heading_level(name: Column) -> Column:
    """The level that a style's name gives: `heading N` or `headingN` for N up to 255, else null."""
    digits = F.regexp_extract(ascii_lower(name), r"^heading ?\+?([0-9]+)$", 1)
    level = digits.try_cast("int")
    return F.when(level <= 255, level)


def is_page_field(instruction: Column) -> Column:
    return ascii_upper(trim_space(instruction)).rlike("^PAGE( |$)")
