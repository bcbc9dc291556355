"""Text and value functions as Column expressions; one step (NFC) needs an Arrow UDF."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

REDACTED = "[REDACTED]"

#: ISO 639-1 to three-letter OCR codes; anything else is read as English.
OCR_CODES = {
    "en": "eng", "de": "deu", "fr": "fra", "es": "spa", "it": "ita", "pt": "por", "nl": "nld", "pl": "pol", "ru": "rus", "uk": "ukr",
    "cs": "ces", "sk": "slk", "sv": "swe", "no": "nor", "da": "dan", "fi": "fin", "hu": "hun", "ro": "ron", "bg": "bul", "el": "ell",
    "tr": "tur", "ar": "ara", "he": "heb", "hi": "hin", "th": "tha", "vi": "vie", "ko": "kor", "ja": "jpn", "zh": "chi_sim", "id": "ind",
}


def word_count(text: Column) -> Column:
    """Words parted by white space; 0 for empty text."""
    return F.regexp_count(text, F.lit("\\S+"))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def clean_name(name: Column) -> Column:
    """A column or table name: lower case, other characters become one underscore, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9_]", "_"), "_+", "_"), F.lit("_"))


def printable_ratio(text: Column) -> Column:
    """Share of printable ASCII, with tab, line feeds, returns, vertical tab and form feed; 0 for empty text."""
    kept = F.length(F.regexp_replace(text, "[^\\x20-\\x7E\\t\\n\\r\\x0B\\x0C]", ""))
    return F.when(F.length(text) == 0, 0.0).otherwise(kept / F.length(text))


def extraction_score(coverage: Column, printable: Column, words_per_page: Column) -> Column:
    return 0.4 * coverage + 0.4 * F.least(printable, F.lit(1.0)) + 0.2 * F.least(words_per_page / 100, F.lit(1.0))


def quality_grade(score: Column) -> Column:
    return F.when(score >= 0.9, "high").when(score >= 0.6, "medium").otherwise("low")


def redact(text: Column, patterns: list[str]) -> Column:
    for pattern in patterns:
        text = F.regexp_replace(text, pattern, REDACTED)
    return text


def content_type(text: Column) -> Column:
    """table, list, form_field or narrative, by shares of lines."""
    lines = F.split(F.trim(text), "\n")
    n = F.size(lines)
    count = lambda pattern: F.size(F.filter(lines, lambda x: x.rlike(pattern)))
    return (
        F.when(F.trim(text) == "", "narrative")
        .when(count("\\|") > n / 2, "table")
        .when(count("^\\s*(?:[-*]|\\d+\\.)\\s+") > n / 2, "list")
        .when(count("\\[\\s*[xX ]?\\s*\\]|_{3,}") > n / 3, "form_field")
        .otherwise("narrative")
    )


#: Common words of the languages that `language` tells apart, in the order in which ties are settled.
STOPWORDS = {
    "en": ["the", "and", "of", "to", "is", "that", "in", "it", "was", "for"],
    "de": ["der", "die", "und", "das", "ist", "nicht", "ein", "zu", "mit", "den"],
    "fr": ["le", "la", "les", "et", "des", "est", "une", "dans", "que", "pour"],
    "es": ["el", "la", "de", "que", "los", "una", "por", "con", "para", "las"],
}


def language(text: Column, stopwords: dict[str, list[str]] | None = None, default: str = "en") -> Column:
    """(language, confidence) by common words: the default with 1.0 for an empty text, 0.5 under ten characters, 0.0 without any."""
    known = stopwords or STOPWORDS
    words = F.transform(F.split(F.lower(text), " "), lambda x: F.regexp_replace(x, "^[.,\\n]+|[.,\\n]+$", ""))

    def among(w: Column, common: list[str]) -> Column:
        return F.size(F.filter(w, lambda x: x.isin(common)))

    def scored(w: Column) -> Column:
        return F.array(*(among(w, common) for common in known.values()))

    def named(counts: Column) -> Column:
        most, total = F.array_max(counts), F.aggregate(counts, F.lit(0), lambda a, b: a + b)
        first = F.element_at(F.array(*map(F.lit, known)), F.array_position(counts, most).cast("int"))
        short, none = F.length(text) < 10, most == 0
        confidence = F.when(F.length(text) == 0, 1.0).when(short, 0.5).when(none, 0.0).otherwise(most / total)
        return F.struct(F.when(short | none, default).otherwise(first).alias("language"), confidence.alias("confidence"))

    return F.element_at(F.transform(F.transform(F.array(words), scored), named), 1)


def matches(value: Column, pattern: str, longest: int = 10_000) -> Column:
    """Whether the whole value matches; null for a pattern that isn't valid and for a value too long to be tried."""
    try:
        re.compile(pattern)
    except re.error:
        return F.lit(None).cast("boolean")
    return F.when(F.length(value) <= longest, value.rlike(f"^(?:{pattern})$"))


def is_toc_page(text: Column) -> Column:
    """Three lines or more, of which over 30 % end in dot leaders and a number."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return (F.size(lines) >= 3) & (F.size(F.filter(lines, lambda x: x.rlike("\\.{2,}\\s*\\d+\\s*$"))) / F.greatest(F.size(lines), F.lit(1)) > 0.3)


def is_blank_page(text: Column, min_words: int = 10) -> Column:
    return word_count(text) < min_words


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no function for it."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def ocr_clean(text: Column, normalize: bool = True) -> Column:
    """Joins words hyphenated at line ends, composes (normalize), narrows white space, drops stray ASCII letters but I, a and A,
    and shortens runs of four or more equal ASCII marks to one. Text of white space alone gives an empty one."""
    out = F.regexp_replace(text, "([a-zA-Z])-\\r?\\n([a-zA-Z])", "$1$2")
    if normalize:
        out = nfc(out)
    out = F.regexp_replace(F.regexp_replace(out, "\\r\\n?", "\n"), "[ \\t]+", " ")
    out = F.regexp_replace(F.regexp_replace(out, "[ \\t]+(?=\\n|$)", ""), "\\n{3,}", "\n\n")
    out = F.regexp_replace(out, "(?U)(?<!\\S)(?![IaA])[a-zA-Z](?!\\S)", "")
    out = F.regexp_replace(out, "([!-/:-@\\[-`{-~])\\1{3,}", "$1")
    out = F.regexp_replace(F.regexp_replace(out, " {2,}", " "), "[ \\t]+(?=\\n|$)", "")
    return F.when(text.rlike("\\S"), out).otherwise(F.when(text.isNotNull(), ""))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def ocr_value(value: Column, kind: Column) -> Column:
    """An OCR reading by field type, less white space at its ends: numbers keep digits, point, minus and comma; dates have single spaces."""
    bare = strip(value)
    return F.when(kind == "number", F.regexp_replace(bare, "[^\\p{Nd}.\\-,]", "")).when(kind == "date", F.regexp_replace(bare, "\\s+", " ")).otherwise(bare)


def ocr_code(lang: Column) -> Column:
    codes = F.create_map(*(F.lit(x) for pair in OCR_CODES.items() for x in pair))
    base = F.lower(F.element_at(F.split(lang, "-"), 1))
    return F.coalesce(F.try_element_at(codes, base), F.lit("eng"))


def coerce_number(value: Column) -> Column:
    return strip(value).try_cast("double")


def coerce_checkbox(value: Column) -> Column:
    """A spreadsheet cell's mark: x, yes, true or 1 is checked, all else isn't."""
    return F.coalesce(F.lower(strip(value)).isin("x", "yes", "true", "1"), F.lit(False))


DATE_FORMS = (
    ("^\\d{4}-\\d{1,2}-\\d{1,2}$", "yyyy-M-d"),
    ("^\\d{1,2}/\\d{1,2}/\\d{4}$", "M/d/yyyy"),
    ("^\\d{1,2}/\\d{1,2}/\\d{4}$", "d/M/yyyy"),
    ("^\\d{4}-\\d{1,2}-\\d{1,2}T\\d{1,2}:\\d{1,2}:\\d{1,2}$", "yyyy-M-d'T'H:m:s"),
)


def coerce_date(value: Column) -> Column:
    """The string as it is where it is a date in one of the four accepted spellings, else null."""
    known = F.lit(False)
    for shape, form in DATE_FORMS:
        known = known | (value.rlike(shape) & F.coalesce(F.try_to_timestamp(F.when(value.rlike(shape), value), F.lit(form)).isNotNull(), F.lit(False)))
    return F.when(known, value)


def widget_value(raw: Column, kind: Column) -> Column:
    """A form widget's value by field type, as a struct (number, checked, text).

    Numbers that can't be read stay as text, for the validation to find; checkbox and radio are checked by yes, on, true and 1;
    a signature is checked if there is anything but white space; an empty widget of these three kinds is unchecked.
    """
    number = F.when(kind == "number", raw.try_cast("double"))
    marked = F.coalesce(F.lower(raw).isin("yes", "on", "true", "1"), F.lit(False))
    checked = F.when(kind.isin("checkbox", "radio"), marked).when(kind == "signature", F.coalesce(raw.rlike("\\S"), F.lit(False)))
    text = F.when(~kind.isin("checkbox", "radio", "signature") & number.isNull(), raw)
    return F.struct(number.alias("number"), checked.alias("checked"), text.alias("text"))


def serial_date(days: Column) -> Column:
    """A spreadsheet's day number (day 0: 1899-12-30; fractions are times) as a timestamp."""
    return F.timestamp_add("SECOND", F.round(days * 86400).cast("long"), F.lit("1899-12-30").cast("timestamp_ntz")).cast("timestamp_ntz")


def backend_error(message: Column) -> Column:
    """A stable code read from a back-end's message: which back-end, and whether it was too slow or not reached."""
    text = F.lower(message)
    has = lambda *words: reduce(lambda x, y: x | y, (text.contains(w) for w in words))
    name = F.when(has("embed"), "EMBED").when(has("vector", "qdrant", "collection"), "VECTOR").otherwise("DB")
    code = lambda what: F.concat(F.lit("E_BACKEND_"), name, F.lit(f"_{what}"))
    return F.when(has("timeout", "timed out"), code("TIMEOUT")).when(has("connect"), code("CONNECT")).otherwise("E_PROCESS_SCHEMA_GEN")


def merge_codes(first: Column, second: Column) -> Column:
    """Codes of both arrays in order, each once."""
    return F.array_distinct(F.concat(first, second))


def fatal(codes: Column) -> Column:
    return F.filter(codes, lambda c: c.startswith("E_"))


def warnings(codes: Column) -> Column:
    return F.filter(codes, lambda c: c.startswith("W_"))


def field_confidence(raw: Column, coerced: Column, native: Column | bool = True) -> Column:
    """Native readings are held within 0.90 and 0.99, then lose 0.02 (not below 0.90) where the value was converted; others within 0 and 1."""
    held = F.greatest(F.lit(0.90), F.least(raw, F.lit(0.99)))
    held = F.when(coerced, F.greatest(F.lit(0.90), held - 0.02)).otherwise(held)
    return F.when(F.lit(native) if isinstance(native, bool) else native, held).otherwise(F.greatest(F.lit(0.0), F.least(raw, F.lit(1.0))))


def confidence_action(confidence: Column, vlm: Column | bool = False, field_min: float = 0.5, vlm_below: float = 0.4) -> Column:
    """What becomes of a field: accept; accept with a warning; below that, a vision model's turn (vlm), or no value (null)."""
    vlm = F.lit(vlm) if isinstance(vlm, bool) else vlm
    return F.when(confidence >= field_min, "accept").when(confidence >= vlm_below, "warn").when(vlm, "vlm").otherwise("null")


def mark_confidence(ratio: Column, threshold: float) -> Column:
    """How far a fill ratio is from its threshold, 0 to 1."""
    return F.least(F.abs(ratio - threshold) / threshold, F.lit(1.0))


def fill_level(ratio: Column) -> Column:
    """0 to 3 at the limits 0.05, 0.25 and 0.60."""
    return F.when(ratio < 0.05, 0).when(ratio < 0.25, 1).when(ratio < 0.60, 2).otherwise(3)


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of boxes with x, y, w, h."""
    w = F.greatest(F.lit(0.0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    h = F.greatest(F.lit(0.0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    both = w * h
    union = a["w"] * a["h"] + b["w"] * b["h"] - both
    return F.when(union > 0, both / union).otherwise(0.0)


def box_pixels(x: Column, y: Column, w: Column, h: Column, width: int, height: int) -> Column:
    """A box of shares as whole pixels within the page: left, top, right, bottom."""
    at = lambda share, size: F.greatest(F.lit(0), F.least(F.lit(size), F.floor(share * size).cast("int")))
    return F.struct(at(x, width).alias("left"), at(y, height).alias("top"), at(x + w, width).alias("right"), at(y + h, height).alias("bottom"))


def html_text(html: Column) -> Column:
    """Text of HTML: comments, scripts and styles go, br and p break lines, the five basic entities are decoded."""
    text = F.regexp_replace(html, "(?is)<!--.*?-->|<!doctype[^>]*>", "")
    text = F.regexp_replace(text, "(?is)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>", "")
    text = F.regexp_replace(text, "(?i)<br\\b[^>]*>|</?p\\b[^>]*>", "\n")
    text = F.regexp_replace(text, "<[^>]*>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(text, "\\n{3,}", "\n\n"), "^\\s+|\\s+$", ""))
