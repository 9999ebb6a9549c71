"""Text functions as column expressions: tokens, names, sentences, windows, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sextant.functions.arrays import let, running

#: Unicode white space, spelled out: the engines' own \\s classes differ.
WHITE = "[\\x09-\\x0D\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
#: The English stop words of the best-known full-text library's default analyzer: fixed values.
STOPWORDS = tuple("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens of ASCII letters, digits and underscores; other characters vanish, white space separates."""
    clean = F.regexp_replace(F.lower(text), "[^a-z0-9_ \\t\\n\\r\\f\\x0B]", "")
    return F.array_distinct(F.filter(F.split(clean, "[ \\t\\n\\r\\f\\x0B]+"), lambda t: t != ""))


def query_terms(text: Column) -> Column:
    """A query's tokens without stop words."""
    return F.filter(tokens(text), lambda t: ~t.isin(*STOPWORDS))


def word_set(text: Column) -> Column:
    """Distinct lower-case words of letters, digits and underscores of any script."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0)))


def token_estimate(text: Column, chars_per_token: int = 4) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / chars_per_token)).cast("long")


def normalized_name(name: Column) -> Column:
    """Lower case; runs of _ and -, then runs of white space, to one space; trimmed. Null stays null."""
    spaced = F.regexp_replace(F.regexp_replace(F.lower(name), "[_-]+", " "), WHITE, " ")
    return F.trim(spaced)


def entity_text(name: Column, description: Column) -> Column:
    """What of an entity is embedded: its name, and its description if it has one."""
    return F.when(F.coalesce(F.length(description), F.lit(0)) > 0, F.concat_ws(": ", name, description)).otherwise(name)


def prefixed(text: Column, role: str) -> Column:
    """Asymmetric embedders want their inputs marked as query or passage."""
    if role not in ("query", "passage"):
        raise ValueError(f"role must be query or passage, not {role!r}")
    return F.concat(F.lit(f"{role}: "), text)


def sentences(text: Column) -> Column:
    """array<struct(text, start, end)>: sentences after . ! or ? and white space, with byte offsets, the end exclusive."""
    parts = F.split(text, "(?<=[.!?])[ \\t\\n\\r\\f\\x0B]+", -1)
    gaps = F.regexp_extract_all(text, F.lit("(?<=[.!?])[ \\t\\n\\r\\f\\x0B]+"), F.lit(0))

    def next_start(at: Column, pair: Column) -> Column:
        return at + F.octet_length(pair["part"]) + F.coalesce(F.octet_length(pair["gap"]), F.lit(0))

    def sentence(at: Column, pair: Column) -> Column:
        return F.struct(pair["part"].alias("text"), at.alias("start"), (at + F.octet_length(pair["part"])).alias("end"))

    pairs = F.arrays_zip(parts.alias("part"), gaps.alias("gap"))
    return F.filter(running(pairs, F.lit(0), next_start, sentence, "struct<text:string,start:int,end:int>"), lambda s: F.trim(s["text"]) != "")


def fixed_windows(text: Column, size: int, overlap: int) -> Column:
    """array<string> of windows of `size` characters, each beginning size - overlap after the one before."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size)))


def page_ranges(raw: Column, trimmed: Column | int = 0, kept: Column | None = None) -> Column:
    """array<struct(number, start, end)> of byte ranges of form-feed separated pages; one trailing form feed is dropped.

    trimmed: leading bytes that the stored text lacks; ranges move back by as many. kept: the stored text's bytes; ranges
    end there at the latest.
    """
    def ranges(body: Column) -> Column:
        return let(F.octet_length(body) - trimmed if kept is None else kept, lambda last: running(F.split(body, "\\f", -1), F.struct(F.lit(0).alias("n"), F.lit(0).alias("at")), after, lambda s, own: page(s, own, last), "struct<number:int,start:int,end:int>"))

    def page(state: Column, own: Column, last: Column) -> Column:
        inside = lambda at: F.least(F.greatest(at - trimmed, F.lit(0)), last)
        return F.struct((state["n"] + 1).alias("number"), inside(state["at"]).alias("start"), inside(state["at"] + F.octet_length(own)).alias("end"))

    def after(state: Column, own: Column) -> Column:
        return F.struct((state["n"] + 1).alias("n"), (state["at"] + F.octet_length(own) + 1).alias("at"))

    return let(F.regexp_replace(raw, "\\f\\z", ""), ranges)


def byte_position(text: Column, part: Column) -> Column:
    """Byte offset of the first place of part in text, null if it isn't there."""
    at = F.position(part, text)
    return F.when(at > 0, F.octet_length(F.substring(text, F.lit(1), at - 1)))


def content_type(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))
    return F.when(extension.isin("md", "markdown"), "text/markdown").when(extension == "pdf", "application/pdf").when(extension == "html", "text/html").otherwise("text/plain")


def entities_in(text: Column) -> Column:
    """array<string>: distinct runs of capitalized ASCII words by first place, a deterministic stand-in for a trained extractor.

    Possessive groups: the engine loops over a run of any length instead of going deeper with each word.
    """
    word = "[A-Z][a-z]++(?![A-Za-z0-9_])"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?<![A-Za-z0-9_]){word}(?:[ \\t\\n\\r\\f\\x0B]++{word})*+"), F.lit(0)))


def entity_type(name: Column, place: Column) -> Column:
    """The stand-in's type of the entity at a place in its text's list: persons have a space in their names; of the others
    the text's first is an organization, the rest are concepts."""
    return F.when(F.instr(name, " ") > 0, "person").when(place == 0, "organization").otherwise("concept")


def label_type(label: Column) -> Column:
    """Tagger labels, with or without B- and I-, to entity types."""
    bare = F.regexp_replace(label, "^[BI]-", "")
    return F.when(bare == "PER", "person").when(bare == "ORG", "organization").when(bare == "LOC", "location").when(bare == "MISC", "concept").otherwise("other")


def relation_type(raw: Column, collapse: bool = True) -> Column:
    """Upper snake case; with collapse, runs of underscores become one and the outer ones go."""
    out = F.regexp_replace(F.upper(raw), "[^A-Z0-9_]", "_")
    return F.regexp_replace(F.regexp_replace(out, "_+", "_"), "^_|_$", "") if collapse else out


def clamped(value: Column, low: float, high: float) -> Column:
    """The value within its bounds; null stays null."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def merged_metadata(declared: Column, extra: Column) -> Column:
    """Two string maps; declared keys win."""
    return F.map_concat(F.map_filter(extra, lambda k, v: ~F.array_contains(F.map_keys(declared), k)), declared)


def first_json_object(text: Column) -> Column:
    """The first {...} without nested braces in a model's answer, code fences aside; null if there is none."""
    found = F.regexp_extract(text, "\\{[^{}]*\\}", 0)
    return F.when(found != "", found)


def is_uuid(value: Column) -> Column:
    """Whether a text is a UUID: anything else names nothing, it isn't an error."""
    return F.coalesce(F.rlike(value, F.lit("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")), F.lit(False))


def relation_line(source: Column, kind: Column, target: Column, description: Column) -> Column:
    """A relationship as a line of a prompt."""
    head = F.concat(source, F.lit(" -"), kind, F.lit("-> "), target)
    return F.when(F.coalesce(F.length(description), F.lit(0)) > 0, F.concat_ws(": ", head, description)).otherwise(head)
