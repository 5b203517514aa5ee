"""Scalar text functions: classification, extraction, formatting, sanitising."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Grade patterns, first match wins (fixed values; order matters: "grade 10" also matches grade 1).
GRADES: dict[str, list[str]] = {
    "PreK": [r"\bpre-?k\b", r"\bpre-?kindergarten\b", r"\bpreschool\b"],
    "K": [r"\bkindergarten\b", r"grade\s*k", "gradek"],
    "1": [r"grade\s*1", "grade1", r"\bfirst grade\b", r"\b1st grade\b"],
    "2": [r"grade\s*2", "grade2", r"\bsecond grade\b", r"\b2nd grade\b"],
    "3": [r"grade\s*3", "grade3", r"\bthird grade\b", r"\b3rd grade\b"],
    "4": [r"grade\s*4", "grade4", r"\bfourth grade\b", r"\b4th grade\b"],
    "5": [r"grade\s*5", "grade5", r"\bfifth grade\b", r"\b5th grade\b"],
    "6": [r"grade\s*6", "grade6", r"\bsixth grade\b", r"\b6th grade\b"],
    "7": [r"grade\s*7", "grade7", r"\bseventh grade\b", r"\b7th grade\b"],
    "8": [r"grade\s*8", "grade8", r"\beighth grade\b", r"\b8th grade\b"],
    "9": [r"grade\s*9", "grade9", r"\bninth grade\b", r"\b9th grade\b", r"\bfreshman\b"],
    "10": [r"grade\s*10", "grade10", r"\btenth grade\b", r"\b10th grade\b", r"\bsophomore\b"],
    "11": [r"grade\s*11", "grade11", r"\beleventh grade\b", r"\b11th grade\b", r"\bjunior\b"],
    "12": [r"grade\s*12", "grade12", r"\btwelfth grade\b", r"\b12th grade\b", r"\bsenior\b"],
    "K-2": [r"\bk-2\b", r"\bearly elementary\b", r"grades\s*k-2"],
    "3-5": [r"\b3-5\b", r"\bupper elementary\b", r"grades\s*3-5"],
    "6-8": [r"\b6-8\b", r"\bmiddle school\b", r"grades\s*6-8"],
    "9-12": [r"\b9-12\b", r"\bhigh school\b", r"grades\s*9-12", r"\bsecondary\b"],
    "College": [r"\bcollege\b", r"\buniversity\b", r"\bundergraduate\b", r"\bpost-secondary\b"],
}

#: Subject patterns, in order (fixed values).
SUBJECTS: dict[str, list[str]] = {
    "Mathematics": ["math(?:ematics)?", "algebra", "geometry", "calculus", "trigonometry", "arithmetic", "statistics"],
    "Science": ["science", "physics", "chemistry", "biology", "earth science", "environmental science", "astronomy"],
    "English Language Arts": [r"\bela\b", "english", "reading", "writing", "literature", "grammar", "composition", "language arts"],
    "Social Studies": ["social studies", "history", "geography", "civics", "government", "economics", "world history", "us history"],
    "Arts & Design": [r"\bart\b", "music", "drama", "theatre", "visual art", "performing arts", "design"],
    "Physical Education": [r"\bpe\b", "physical education", "health", "fitness", "athletics", "sports"],
    "World Languages": ["spanish", "french", "italian", "german", "foreign language", "world language", "mandarin"],
    "Technology": ["computer science", "technology", "coding", "programming", "digital literacy", r"\bit\b"],
    "Career & Technical Education": [r"\bcte\b", "career", "vocational", "technical education", "trade"],
}

#: Image-type keywords, in order (fixed values).
IMAGE_TYPES: dict[str, list[str]] = {
    "logo": ["logo", "brand", "trademark", "company logo", "branding", "brand mark"],
    "screenshot": ["screenshot", "screen capture", "interface", "ui", "user interface", "application window"],
    "diagram": ["diagram", "flowchart", "architecture", "schematic", "flow", "process", "workflow", "system design", "blueprint", "illustration", "drawing"],
    "chart": ["chart", "graph", "plot", "bar", "line", "pie", "histogram", "scatter", "trend", "data visualization", "axis", "x-axis", "y-axis", "legend"],
    "photo": ["photo", "photograph", "image of", "picture of", "showing", "depicts", "portrait"],
}

#: Words that make a description technical (fixed values).
TECHNICAL = ["revenue", "profit", "margin", "growth", "metric", "api", "database", "server", "algorithm", "function", "architecture", "system", "process", "workflow"]


def first_match(text: Column, cases: dict[str, list[str]], default: str | None = None) -> Column:
    """Name of the first case any of whose patterns occurs in ``text``."""
    chain = F
    for name, patterns in cases.items():
        chain = chain.when(text.rlike("|".join(patterns)), name)
    return chain.otherwise(default)


def grade_of(text: Column) -> Column:
    return first_match(F.lower(text), GRADES)


def subject_of(text: Column) -> Column:
    return first_match(F.lower(text), SUBJECTS)


def all_subjects(text: Column) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.rlike("|".join(p)), name) for name, p in SUBJECTS.items()]))


def image_type(description: Column) -> Column:
    return F.when(description.isNull() | (description == ""), "unknown").otherwise(
        first_match(F.lower(description), IMAGE_TYPES, "unknown")
    )


def _grade_bound(grade: Column, upper: bool) -> Column:
    """Lower or upper year of a grade: PreK -1, K 0, College 13, a-b a range; null if it does not parse."""
    def year(part: Column) -> Column:
        return F.when(part == "K", 0).when(part == "PreK", -1).when(part == "College", 13).otherwise(
            F.when(part.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(part).cast("int"))
        )

    parts = F.split(grade, "-")
    ranged = F.when(F.size(parts) == 2, year(parts[1] if upper else parts[0]))
    return F.when(grade.contains("-"), ranged).otherwise(year(grade))


def grade_match(grade: Column, wanted: Column) -> Column:
    """Whether two grades or ranges overlap; what does not parse matches."""
    overlap = (_grade_bound(grade, False) <= _grade_bound(wanted, True)) & (_grade_bound(wanted, False) <= _grade_bound(grade, True))
    return F.when(grade == wanted, True).otherwise(F.coalesce(overlap, F.lit(True)))


def subject_match(subject: Column, wanted: Column) -> Column:
    return F.lower(subject) == F.lower(wanted)


def sentences(text: Column) -> Column:
    """Trimmed, non-empty sentences, cut after . ! ? and white space."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def token_estimate(text: Column) -> Column:
    """Whole part of 1.3 tokens a word."""
    return F.floor(word_count(text) * F.lit(1.3)).cast("int")


def description_stats(text: Column) -> Column:
    cleaned = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.struct(
        cleaned.alias("cleaned"), word_count(cleaned).alias("word_count"),
        F.lower(cleaned).rlike("|".join(TECHNICAL)).alias("has_technical_terms"),
    )


def image_tag(text: Column) -> Column:
    """Description, type and presence of the first ``<img>...</img>``."""
    found = F.trim(F.regexp_extract(text, r"(?is)<img>(.*?)</img>", 1))
    return F.struct(found.alias("description"), image_type(found).alias("image_type"), (found != "").alias("has_description"))


def citations(text: Column) -> Column:
    """Distinct ``[n]``, by number, as strings."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("bigint"))
    return F.transform(F.array_sort(F.array_distinct(numbers)), lambda x: x.cast("string"))


def missing_citations(text: Column, expected: Column) -> Column:
    """Numbers 1 to ``expected`` that the text does not cite."""
    found = F.transform(citations(text), lambda x: x.cast("int"))
    return F.when(expected >= 1, F.array_except(F.sequence(F.lit(1), expected), found)).otherwise(F.array().cast("array<int>"))


def citation_label(number: Column, document: Column, pages: Column, slide: Column) -> Column:
    """``[n] doc, pages p`` or ``[n] doc, slide s``; page and slide 0 count as absent."""
    place = F.when(F.coalesce(pages, F.lit("")).isin("", "0"), F.when(F.coalesce(slide, F.lit(0)) != 0, F.concat(F.lit(", slide "), slide.cast("string"))))
    place = F.coalesce(place, F.when(~F.coalesce(pages, F.lit("")).isin("", "0"), F.concat(F.lit(", pages "), pages)), F.lit(""))
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), document, place)


def json_or_empty(text: Column, element: str) -> Column:
    """A JSON array of ``element``, empty if the text is no such array."""
    return F.coalesce(F.from_json(text, f"array<{element}>"), F.array().cast(f"array<{element}>"))


def safe_file_name(name: Column) -> Column:
    """Base name without parent steps, separators and control characters."""
    base = F.element_at(F.split(F.regexp_replace(name, r"\\", "/"), "/"), -1)
    return F.regexp_replace(F.regexp_replace(base, r"\.\.", ""), r"[\x00-\x1f\x7f]", "")


def safe_collection(name: Column) -> Column:
    """Collection name with separators and parent steps replaced; blank gives null."""
    cleaned = F.regexp_replace(F.trim(name), r"/|\\|\.\.", "_")
    return F.when(cleaned != "", cleaned)


def quoted_url(part: Column) -> Column:
    """Percent-encoded with %20 for a blank and ``/`` kept."""
    return F.replace(F.replace(F.url_encode(part), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def image_url(base: Column, collection: Column, name: Column) -> Column:
    return F.concat_ws("/", base, quoted_url(collection), quoted_url(name))


def content_name(data: Column) -> Column:
    """First 16 hex digits of the content's SHA-256."""
    return F.substring(F.sha2(data, 256), 1, 16)


def partial_hash(data: Column, part: int = 1 << 20) -> Column:
    """MD5 of the first part, the last part of files over two parts, and the size."""
    size = F.length(data)
    tail = F.when(size > 2 * part, F.substring(data, size - part + 1, F.lit(part))).otherwise(F.lit(b""))
    return F.md5(F.concat(F.substring(data, F.lit(1), F.lit(part)), tail, size.cast("string").cast("binary")))


def image_markdown(alt: Column, path: Column, caption: Column) -> Column:
    return F.concat(F.lit("!["), alt, F.lit("]("), path, F.lit(")"), F.when(F.coalesce(caption, F.lit("")) != "", F.concat(F.lit("\n*"), caption, F.lit("*"))).otherwise(""))


def queue_of(size_mb: Column) -> Column:
    return F.when(size_mb > 50, "high").when(size_mb > 10, "default").otherwise("low")


def job_timeout(size_mb: Column) -> Column:
    return F.when(size_mb > 50, 7200).otherwise(3600)


def is_distributed(suffix: Column, size_mb: Column, threshold: float = 10.0) -> Column:
    return F.lower(suffix).isin(".pdf", ".pptx") & (size_mb > threshold)


def memory_pressure(percent: Column) -> Column:
    return F.when(percent > 95, "critical").when(percent > 90, "high").otherwise("normal")


def resized(width: Column, height: Column, max_pixels: int) -> Column:
    """Width and height scaled down to at most ``max_pixels``, cut to whole pixels."""
    pixels = width.cast("double") * height
    scale = F.when(pixels > max_pixels, F.sqrt(F.lit(float(max_pixels)) / pixels)).otherwise(1.0)
    return F.struct(F.floor(width * scale).cast("int").alias("width"), F.floor(height * scale).cast("int").alias("height"))


def image_valid(width: Column, height: Column, max_pixels: int) -> Column:
    return (F.least(width, height) >= 10) & (width.cast("long") * height <= 4 * max_pixels)


def progress(done: Column, total: Column) -> Column:
    return F.concat(done.cast("string"), F.lit("/"), total.cast("string"))


def relevance(text: Column) -> Column:
    """First token of a reply as a number clamped to 0..1; 0.5 if it is none."""
    value = F.element_at(F.split(F.trim(text), r"\s+"), 1).try_cast("double")
    return F.when(value.isNull() | F.isnan(value), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching characters by the longest-block method."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def first_difference(a: Column, b: Column) -> Column:
    """0-based index of the first differing character, the shorter length if one is a prefix, null if equal."""
    differs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~x.eqNullSafe(y))
    return F.when(a != b, F.array_position(differs, True).cast("int") - 1)


def wrapped(text: Column, width: int) -> Column:
    """Lines of whole words of at most ``width`` characters; a longer word has its own line."""
    def step(lines: Column, word: Column) -> Column:
        last = F.try_element_at(lines, F.lit(-1))
        longer = F.concat(F.slice(lines, F.lit(1), F.size(lines) - 1), F.array(F.concat(last, F.lit(" "), word)))
        fits = (F.size(lines) > 0) & (F.length(last) + 1 + F.length(word) <= width)
        return F.when(fits, longer).otherwise(F.concat(lines, F.array(word)))

    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.aggregate(words, F.array().cast("array<string>"), step)


#: Content types by suffix (fixed values).
_MIME = {".pdf": "application/pdf", ".txt": "text/plain", ".md": "text/markdown", ".py": "text/x-python", ".json": "application/json", ".csv": "text/csv"}


def content_type(path: Column) -> Column:
    """Content type by the suffix of a path."""
    known = F.create_map(*[F.lit(x) for pair in _MIME.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))), F.lit("application/octet-stream"))
