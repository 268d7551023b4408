"""Text functions as Column builders; all run inside the JVM.

Offsets are code points, half open. White space is Unicode white space, non-breaking space included.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)[\s ]+"
NULL_TOKENS = ("", "n/a", "na", "none", "null")


def collapse(text: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def null_token(value: Column) -> Column:
    """Trimmed text; null for blank text and words that mean none."""
    trimmed = F.trim(value.cast("string"))
    return F.when(~F.lower(trimmed).isin(*NULL_TOKENS), trimmed)


def dedupe_key(value: Column) -> Column:
    """Case and white space do not count; null for blank text."""
    return F.nullif(F.lower(collapse(value)), F.lit(""))


def tokens(text: Column) -> Column:
    """ASCII letters, digits and apostrophes of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[A-Za-z0-9']+"), F.lit(0))


def token_overlap(query: Column, document: Column) -> Column:
    """Share of the query's distinct tokens that the document has; 0 where either has none."""
    wanted = F.array_distinct(query)
    shared = F.size(F.array_intersect(wanted, document))
    return F.when((F.size(wanted) > 0) & (F.size(document) > 0), shared / F.size(wanted)).otherwise(0.0)


def heading_text(line: Column) -> Column:
    """A heading without its markers; inner markers become a space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(line), r"^#+\s*", ""), r"\s#+\s", " "))


def is_reference_title(title: Column) -> Column:
    """True for titles that open a list of references."""
    plain = F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " "))
    return plain.rlike("^(bibliography|literature cited|references|works cited)")


def is_reference_heading(line: Column) -> Column:
    """True for a line that is such a heading by itself, colons and case aside."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(line)), r"^#+\s*", ""), r"[:\s]+$", "")
    return plain.rlike("^(bibliography|literature cited|references?|references and notes|works cited)$")


def is_appendix_heading(line: Column) -> Column:
    return F.lower(line).rlike("appendix|supplement|supporting information")


def is_heading(line: Column) -> Column:
    """Marked lines, and lines of capitals up to 60 characters."""
    trimmed = F.trim(line)
    capitals = (F.upper(trimmed) == trimmed) & (F.lower(trimmed) != trimmed) & (F.length(trimmed) <= 60)
    return (trimmed != "") & (trimmed.startswith("#") | capitals)


def is_reference_line(line: Column) -> Column:
    """Numbered entries, years in brackets, identifiers and links."""
    trimmed = F.trim(line)
    return trimmed.rlike(r"^\[?\d+\]?[).]?\s") | trimmed.rlike(r"\((19|20)\d{2}\)") | F.lower(trimmed).contains("doi:") | trimmed.rlike("https?://")


def safe_name(value: Column) -> Column:
    """Letters, digits, dot, underscore and dash stay; other runs become one underscore."""
    return F.regexp_replace(value, r"[^\w.-]+", "_")


def table_ref(value: Column) -> Column:
    """The form in which table references are compared."""
    return F.regexp_replace(F.lower(value), "[^a-z0-9]+", "")


def table_number(value: Column) -> Column:
    """The number of a table as captions give it; null without one."""
    return F.nullif(F.regexp_extract(value, r"(?i)(?:table|tab|tbl)\D{0,3}(\d+)", 1), F.lit(""))


def document_id(pmid: Column, doi: Column, pmcid: Column, store: Column, fallback: Column) -> Column:
    """Identifiers joined by dashes, or the store's id, or the fallback."""
    clean = [F.nullif(safe_name(F.trim(c)), F.lit("")) for c in (pmid, doi, pmcid)]
    return F.coalesce(F.nullif(F.concat_ws("-", *clean), F.lit("")), F.nullif(F.trim(store), F.lit("")), fallback)


def enum_text(value: Column) -> Column:
    """Underscores, slashes and camel case become spaces; lower case."""
    spaced = F.regexp_replace(F.regexp_replace(value, "[_/]", " "), "(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.lower(collapse(spaced))


def mapped(value: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """Lookup in a constant map; ``default`` (null if not given) for values it lacks."""
    pairs = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    found = F.try_element_at(pairs, value)
    return found if default is None else F.coalesce(found, default)


def aliases(value: Column, table: dict[str, list[str]]) -> Column:
    """The value itself and its synonyms, each once."""
    pairs = F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.array_distinct(F.concat(F.array(value), F.coalesce(F.try_element_at(pairs, value), F.array().cast("array<string>"))))


def filled(template: Column, **values: Column) -> Column:
    """A template with {name} replaced by values."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def first_label(*candidates: Column, prefix: str = "") -> Column:
    """The first candidate that is not blank, after a prefix."""
    found = F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in candidates))
    return F.when(found.isNotNull(), F.concat(F.lit(prefix), found))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def truncated(text: Column, most: int) -> Column:
    """The first ``most`` characters; all for 0."""
    return F.substring(text, 1, most) if most > 0 else text


def sibling_path(path: Column, suffix: str) -> Column:
    """The path with another ending in place of that after the file name's first dot."""
    return F.concat(F.regexp_replace(path, r"\.[^/]*$", ""), F.lit(suffix))


def merged_header(cells: Column) -> Column:
    """One header cell of several rows' texts: distinct ones joined by a slash."""
    return F.array_join(F.array_distinct(F.filter(cells, lambda c: F.trim(c) != "")), " / ")


def table_row(cells: Column, width: Column | int) -> Column:
    """A line of a pipe table, padded to ``width`` cells."""
    width = F.lit(width) if isinstance(width, int) else width
    padded = F.concat(cells, F.array_repeat(F.lit(""), F.greatest(width - F.size(cells), F.lit(0))))
    escaped = F.transform(padded, lambda c: F.replace(c, F.lit("|"), F.lit("\\|")))
    return F.concat(F.lit("| "), F.array_join(escaped, " | "), F.lit(" |"))


def mentions(text: Column, term: Column) -> Column:
    """Occurrences of a term between characters that are not ASCII word characters; terms are taken literally."""
    quoted = F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), term, F.lit(r"\E(?![A-Za-z0-9_])"))
    return F.size(F.regexp_extract_all(text, quoted, F.lit(0)))
