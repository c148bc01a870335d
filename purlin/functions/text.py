"""Text functions as Spark column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANKS = " \t\n\x0b\f\r"
# Letters and digits that are brought to one form, and the dashes that become a hyphen.
ARABIC_LETTERS = ("يىكۀةؤإأٱ", "ییکههوااا")
DROPPED = "ـ"  # the tatweel
AS_BLANKS = "\u200c\u200d\u200e\u200f"  # zero-width joiners and direction marks
LOCAL_DIGITS = ("۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩", "01234567890123456789")
DASHES = "[‐‑‒–—−﹘﹣－]"
# Material categories by the first list with a term that occurs in the name.
CATEGORIES = (
    ("concrete", ("concrete", "cement", "بتن", "سیمان")),
    ("steel", ("steel", "stainless", "فولاد", "آهن")),
    ("aluminium", ("aluminium", "aluminum", "آلومینیوم")),
    ("timber", ("timber", "wood", "plywood", "چوب")),
    ("glass", ("glass", "glazing", "شیشه")),
    ("gypsum", ("gypsum", "plasterboard", "drywall", "گچ")),
    ("insulation", ("insulation", "mineral wool", "rockwool", "عایق")),
    ("masonry", ("brick", "masonry", "block", "آجر", "بلوک")),
)
# Factors to the canonical unit of each dimension.
UNIT_SCALES = {
    ("mass", "kg"): 1.0, ("mass", "kilogram"): 1.0, ("mass", "g"): 1e-3, ("mass", "gram"): 1e-3, ("mass", "lb"): 0.45359237, ("mass", "pound"): 0.45359237,
    ("length", "m"): 1.0, ("length", "metre"): 1.0, ("length", "meter"): 1.0, ("length", "mm"): 1e-3, ("length", "millimetre"): 1e-3, ("length", "cm"): 1e-2, ("length", "ft"): 0.3048, ("length", "foot"): 0.3048,
    ("area", "m2"): 1.0, ("area", "m^2"): 1.0, ("area", "square metre"): 1.0, ("area", "mm2"): 1e-6, ("area", "mm^2"): 1e-6, ("area", "ft2"): 0.09290304, ("area", "ft^2"): 0.09290304, ("area", "square foot"): 0.09290304,
    ("volume", "m3"): 1.0, ("volume", "m^3"): 1.0, ("volume", "cubic metre"): 1.0, ("volume", "mm3"): 1e-9, ("volume", "mm^3"): 1e-9, ("volume", "ft3"): 0.028316846592, ("volume", "ft^3"): 0.028316846592, ("volume", "cubic foot"): 0.028316846592,
}


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


@F.pandas_udf(T.StringType())
def _composed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def _folded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def nfkc(text: Column) -> Column:
    """NFKC form. Plain ASCII is its own; only other texts travel to Python."""
    other = text.rlike(r"[^\x00-\x7F]")
    return F.when(other, _composed(F.when(other, text))).otherwise(text)


def casefolded(text: Column) -> Column:
    """NFKC form, folded; ASCII stays in the JVM."""
    other = text.rlike(r"[^\x00-\x7F]")
    return F.when(other, _folded(F.when(other, text))).otherwise(F.lower(text))


def normalise_text(text: Column, compose: bool = True) -> Column:
    """One form of Arabic and Persian letters, digits, dashes and marks, and of blanks within lines.

    Within a lambda, where Python can't be called, ``compose`` must be off and the text in NFKC form already.
    """
    text = F.translate(nfkc(text) if compose else text, ARABIC_LETTERS[0] + AS_BLANKS + DROPPED, ARABIC_LETTERS[1] + " " * len(AS_BLANKS))
    text = F.translate(text, *LOCAL_DIGITS)
    text = F.regexp_replace(text, DASHES, "-")
    text = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[ \t\f\x0b]+", " ")
    return F.regexp_replace(text, "\n +", "\n")


def word_table() -> dict[int, str | None]:
    """``normalise_text``'s changes of single characters, for ``str.translate``."""
    first = str.maketrans(ARABIC_LETTERS[0] + AS_BLANKS, ARABIC_LETTERS[1] + " " * len(AS_BLANKS), DROPPED)
    digits = str.maketrans(*LOCAL_DIGITS)
    return digits | {c: to if to is None else digits.get(to if isinstance(to, int) else ord(to), to) for c, to in first.items()}


def normalise_material(name: Column) -> Column:
    """Stable lookup key of a material name; null counts as empty."""
    text = F.translate(casefolded(F.coalesce(name, F.lit(""))), "يك", "یک")
    text = F.regexp_replace(text, "&", " and ")
    text = F.regexp_replace(text, r"[_/\\|:;,+]+", " ")
    text = F.regexp_replace(text, "[-‐‑‒–—−]+", " ")
    text = F.regexp_replace(text, r"(?U)[^\w\s؀-ۿ]", " ")
    return stripped(F.regexp_replace(text, r"(?U)\s+", " "))


def normalisation_metadata(name: Column) -> Column:
    """struct(raw_name, normalized_name, category, normalization_version)."""
    key = normalise_material(name)
    return F.struct(F.coalesce(name, F.lit("")).alias("raw_name"), key.alias("normalized_name"), material_category(key).alias("category"), F.lit("1.0").alias("normalization_version"))


def material_category(normalised: Column) -> Column:
    out = None
    for category, terms in CATEGORIES:
        hit = F.lit(False)
        for t in terms:
            hit = hit | F.contains(normalised, F.lit(t))
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out.otherwise("other")


def unit_scale(kind: Column, unit: Column) -> Column:
    """Factor to the canonical unit; null where the unit isn't known for the dimension."""
    key = F.concat_ws("|", kind, F.regexp_replace(F.lower(stripped(F.coalesce(unit, F.lit("")))), r"\s+", " "))
    table = F.create_map(*[x for (k, u), s in UNIT_SCALES.items() for x in (F.lit(f"{k}|{u}"), F.lit(s))])
    return F.try_element_at(table, key)


def normalised_quantity(value: Column, kind: Column, unit: Column) -> Column:
    """Value in the canonical unit; null for unknown units and for values that aren't finite and at least zero."""
    fine = value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value != F.lit(float("inf")))
    return F.when(fine, value * unit_scale(kind, unit))


def si_scale(prefix: Column, power: int) -> Column:
    """Multiplier of an SI prefix for length, area or volume."""
    base = F.when(F.coalesce(prefix, F.lit("")) == "", 1.0)
    for name, exponent in (("MILLI", -3), ("CENTI", -2), ("DECI", -1), ("KILO", 3), ("MICRO", -6)):
        base = base.when(F.upper(prefix) == name, 10.0**exponent)
    return F.pow(base, F.lit(power))


def parent_section(section: Column, least: int = 3) -> Column:
    """The section one level up; empty for sections of fewer than ``least`` parts."""
    parts = F.split(section, "-")
    return F.when(F.size(parts) >= least, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "-")).otherwise("")


def tag_of(name: Column) -> Column:
    """Digits after the last colon at the end of an element's name; null if there are none."""
    return F.nullif(F.regexp_extract(name, r":(\d+)\n?\z", 1), F.lit(""))


def guid_of(composite: Column) -> Column:
    return F.substring_index(composite, "::", -1)


def safe_id(text: Column, fallback: str = "item") -> Column:
    """Letters, digits, dot, underscore and hyphen, at most 80; never empty."""
    slug = F.substring(F.btrim(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "-"), F.lit("-._")), 1, 80)
    return F.when(slug == "", fallback).otherwise(slug)


def clean_scalar(text: Column) -> Column:
    return F.when(F.lower(stripped(text)).isin("none", "null", "nan"), "").otherwise(F.coalesce(text, F.lit("")))


def heading(text: Column) -> Column:
    """First line with text, without a leading clause number, at most 200 characters."""
    lines = F.filter(F.transform(F.split(text, "\n"), stripped), lambda x: x != "")
    return stripped(F.substring(F.regexp_replace(F.get(lines, F.lit(0)), r"^\d+(?:\s*[-.]\s*\d+)+\s*[-.]?\s*", ""), 1, 200))


def numbers_in(text: Column) -> Column:
    """Distinct numbers of a text, as doubles, localised digits included."""
    plain = F.translate(text, *LOCAL_DIGITS)
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(plain, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double"))))


def terms_in(text: Column, least: int = 2) -> Column:
    """Distinct Latin, Arabic-script or numeric terms, lower case."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]+(?:[.-]?\d+)*|[؀-ۿ]+|\d+(?:[.-]\d+)*"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: F.length(t) >= least))


def fixed_windows(text: Column, size: int, overlap: int) -> Column:
    """Trimmed windows of ``size`` characters every ``size - overlap``; the last one reaches the end; blanks are dropped."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - size) / F.lit(float(step))), F.lit(0)).cast("int")
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: stripped(F.substring(text, i * step + 1, F.lit(size))))
    return F.when(F.length(text) > 0, F.filter(windows, lambda w: w != "")).otherwise(F.array().cast("array<string>"))


def packed_blocks(blocks: Column, size: int) -> Column:
    """Blocks joined by line ends into chunks of at most ``size`` characters; longer blocks are cut into windows."""
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, block: Column) -> Column:
        flushed = F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"])))
        proposed = F.when(acc["now"] == "", block).otherwise(F.concat(acc["now"], F.lit("\n"), block))
        large = F.struct(F.concat(flushed, fixed_windows(block, size, 0)).alias("done"), F.lit("").alias("now"))
        fits = F.struct(acc["done"].alias("done"), proposed.alias("now"))
        starts = F.struct(flushed.alias("done"), block.alias("now"))
        return F.when(F.length(block) > size, large).when(F.length(proposed) <= size, fits).otherwise(starts)

    return F.aggregate(blocks, state, step, lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["now"]))))


# Words that say nothing of what a question is about; what is put right in questions, in this order.
STOP_TERMS = ("است", "هست", "برای", "مورد", "در", "از", "به", "را", "چه", "که", "این", "the", "is", "for", "of", "in", "what", "according", "to")
QUERY_REPAIRS = (
    ("بازرسی چشمی", "بازدید عینی"),
    ("بازرسی ظاهری", "بازدید عینی"),
    ("تاسیسات الکتریکی", "تاسیسات برقی"),
    ("استاندراد", "استاندارد"),
    ("استاندرادها", "استانداردها"),
    ("فلنچ", "فلنج"),
    ("تاسيسات", "تاسیسات"),
    ("سيستم", "سیستم"),
)


def normalise_query(text: Column, compose: bool = True) -> Column:
    """A question in one form: normalised, folded, known slips put right, single blanks. ``compose``: see normalise_text."""
    text = normalise_text(F.coalesce(text, F.lit("")), compose)
    text = casefolded(text) if compose else F.lower(text)
    for wrong, right in QUERY_REPAIRS:
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return stripped(F.regexp_replace(text, r"(?U)\s+", " "))


def terms_of(text: Column) -> Column:
    """Distinct Latin, Arabic-script or numeric terms of two characters or more, without stop terms, in order."""
    found = F.regexp_extract_all(normalise_query(text), F.lit(r"[A-Za-z]+(?:[.-]?\d+)*|[\u0600-\u06ff]+|\d+(?:[.-]\d+)*"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(list(STOP_TERMS))))


def heading_score(query: Column, heading_: Column) -> Column:
    """Share of the heading's terms that the question has; 1 where it holds the whole heading."""
    asked, own = terms_of(query), terms_of(heading_)
    recall = F.size(F.array_intersect(asked, own)) / F.size(own)
    whole = F.contains(normalise_query(query), normalise_query(heading_))
    return F.when(F.size(own) == 0, 0.0).otherwise(F.greatest(recall, F.when(whole, 1.0).otherwise(0.0)))


def document_score(query: Column, number: Column, source: Column) -> Column:
    """1 where the question names the document's number; that may stand at the start of the source's name."""
    asked = F.regexp_extract(normalise_query(query), r"(?i)(?:مبحث|mabhas)\s*(\d{1,2})", 1)
    own = F.when(F.coalesce(number, F.lit("")) != "", number).otherwise(F.regexp_extract(F.coalesce(source, F.lit("")), r"^\s*(\d{1,2})(?:\D|$)", 1))
    return F.when((asked != "") & (asked == own), 1.0).otherwise(0.0)


def parent_by_drop(section: Column) -> Column:
    """The section one level up, unconditionally: the last part is dropped; empty for a single part."""
    parts = F.split(section, "-")
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "-")


def stable_id(*parts: Column) -> Column:
    """SHA-256 of the parts joined by bars; null counts as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def valid_source(name: Column) -> Column:
    return ~F.lower(stripped(F.coalesce(name, F.lit("")))).isin("", "unknown", "none", "null")


def boolean_text(text: Column) -> Column:
    return F.lower(stripped(F.coalesce(text, F.lit("")))).isin("1", "true", "yes", "enabled")


def domain_of(domain: Column, known: tuple[str, ...] = ("regulation", "leed", "standard", "sustainability")) -> Column:
    """A known domain, else the legacy default."""
    low = F.lower(stripped(F.coalesce(domain, F.lit(""))))
    return F.when(low.isin(list(known)), low).otherwise("regulation")


def embedding_text(document: Column, section: Column, heading_: Column, text: Column) -> Column:
    """What is embedded for a chunk: labels that exist, then the text."""
    present = F.filter(F.array(document, section, heading_), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.when(F.size(present) > 0, F.concat(F.array_join(present, " | "), F.lit("\n"), text)).otherwise(text)


def optional_filter(values: list[str] | None) -> list[str] | None:
    """Trimmed, without blanks; None where nothing is left: an empty filter means all."""
    kept = [v.strip() for v in values or [] if v and v.strip()]
    return kept or None
