"""JSON that language models write: fenced, with trailing commas, wrapped in prose, or cut off."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from codexlake.functions import rules as R, text as T

#: Fixed element names of a source description, by the criterion they give.
ELEMENTS = {"script": "Schrift", "lang": "Sprache", "date": "Datierung", "document_type": "Dokumenttyp", "content": "Inhalt"}


def strip_fences(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(text), r"^```(?:[a-zA-Z]+)?\s*|\s*```$", ""))


def without_trailing_commas(text: Column) -> Column:
    return F.regexp_replace(text, r",(\s*[}\]])", "$1")


def tolerant(text: Column) -> Column:
    """A VARIANT: as it is, repaired, or from the first to the last brace; null if none of them parses. What follows a whole value is ignored."""
    bare = strip_fences(text)
    inner = F.regexp_extract(bare, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(without_trailing_commas(bare)), F.try_parse_json(without_trailing_commas(F.nullif(inner, F.lit("")))))


def salvage(text: Column) -> Column:
    """The flat objects of a text that is cut off or broken elsewhere, as an array of VARIANTs."""
    parsed = F.transform(F.regexp_extract_all(text, F.lit(r"\{[^{}]*\}"), F.lit(0)), lambda x: F.try_parse_json(without_trailing_commas(x)))
    return F.filter(parsed, lambda x: x.isNotNull())


def element(description: Column, name: str) -> Column:
    """The text of a description's element, plain or wrapped."""
    return T.unwrap(F.try_variant_get(description, f"$.{name}", "variant"))


def criteria(description: Column) -> Column:
    """script, lang, century, document_type of a source description, normalised; empty texts give null.

    The kind of document is named, or follows from a word of the content.
    """
    get = lambda k, f: T.let(F.nullif(F.trim(element(description, ELEMENTS[k])), F.lit("")), f)
    return F.struct(
        get("script", R.normalise_script).alias("script"),
        get("lang", lambda s: F.nullif(R.normalise_lang(s), F.lit(""))).alias("lang"),
        get("date", R.parse_century).alias("century"),
        F.coalesce(get("document_type", lambda s: s), get("content", lambda s: R.first_spelling(s, R.DOCUMENT_TYPES))).alias("document_type"),
    )


def mentioned_criteria(text: Column) -> Column:
    """The same from a description in prose, by the first word of each list that it holds; null where it holds none."""
    found = lambda t: F.struct(
        R.first_spelling(t, {name: name for name in R.SCRIPTS}).alias("script"),
        R.first_spelling(t, R.LANGUAGES).alias("lang"),
        R.mentioned_century(t).alias("century"),
        R.first_spelling(t, R.DOCUMENT_TYPES).alias("document_type"),
    )
    return T.let(text, found)


def criteria_with_prose(description: Column, text: Column) -> Column:
    """criteria() of a structured description, each one that is missing from the prose."""
    both = lambda x: F.struct(*[F.coalesce(x["own"][c], x["prose"][c]).alias(c) for c in ("script", "lang", "century", "document_type")])
    return T.let(F.struct(T.let(description, criteria).alias("own"), mentioned_criteria(text).alias("prose")), both)


def marked_uncertain(description: Column) -> Column:
    """Whether an element that routing depends on says it is uncertain."""
    flags = [F.coalesce(F.contains(F.lower(element(description, ELEMENTS[k])), F.lit("unsicher")), F.lit(False)) for k in ("date", "lang", "script")]
    return flags[0] | flags[1] | flags[2]


def missing_elements(description: Column, names: list[str]) -> Column:
    """Those of the names that the description has no text for."""
    return F.array_compact(F.array(*[F.when(F.coalesce(F.trim(element(description, n)), F.lit("")) == "", F.lit(n)) for n in names]))


def care_flag(text: Column) -> Column:
    """is_care_related, care_context, care_types, beteiligte of a model's answer; what is missing, of another kind or unreadable is false or empty."""

    def typed(v: Column) -> Column:
        get = lambda k, kind: F.try_variant_get(v, f"$.{k}", kind)
        names = lambda k: F.coalesce(F.array_compact(get(k, "array<string>")), F.array().cast("array<string>")).alias(k)
        return F.struct(
            F.coalesce(get("is_care_related", "boolean"), F.lit(False)).alias("is_care_related"),
            F.coalesce(get("care_context", "string"), F.lit("")).alias("care_context"),
            names("care_types"),
            names("beteiligte"),
        )

    return T.let(tolerant(text), typed)


def both_ends(text: Column, size: int = 2000) -> Column:
    """A text, or its first and last ``size`` characters around a mark if it is longer than both."""
    cut = F.concat(F.substring(text, 1, size), F.lit("\n\n[...]\n\n"), F.substring(text, -size, size))
    return F.when(F.length(text) > 2 * size, cut).otherwise(text)


def choice(text: Column, key: str, allowed: list[str]) -> Column:
    """A field of a model's answer, if it is one of the allowed values."""
    value = F.lower(F.trim(F.try_variant_get(tolerant(text), f"$.{key}", "string")))
    return F.when(value.isin(*allowed), value)


def coordinates(value: Column) -> Column:
    """(lat, lon) of an array of exactly two numbers within range."""
    pair = F.try_variant_get(value, "$", "array<double>")
    lat, lon = F.get(pair, F.lit(0)), F.get(pair, F.lit(1))
    return F.when((F.size(pair) == 2) & lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon")))


def source_url(base: str, name: Column) -> Column:
    """The base and the file name; null without either."""
    return F.when((F.lit(base) != "") & (F.coalesce(name, F.lit("")) != ""), F.concat(F.lit(base.rstrip("/") + "/"), F.url_encode(name)))
