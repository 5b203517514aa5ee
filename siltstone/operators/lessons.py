"""Lesson markdown: frontmatter, sections, references, round trips."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import citations

_BLOCK = r"(?s)\A---\n(.*?)\n---"


def frontmatter(text: Column) -> Column:
    """``key: value`` lines of the first block as a map of unquoted strings."""
    lines = F.filter(F.split(F.regexp_extract(text, _BLOCK, 1), "\n"), lambda x: x.contains(":"))
    strip = lambda c: F.regexp_replace(F.trim(c), r"^[\"']|[\"']$", "")
    entries = F.transform(
        lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), strip(F.regexp_replace(x, r"^[^:]*:", "")).alias("value"))
    )
    # as a lambda's argument the entries are computed once, not for each of them
    last = lambda all_: F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda later: later["key"] == e["key"]))
    return F.get(F.transform(F.array(entries), lambda all_: F.map_from_entries(last(all_))), F.lit(0))


def number_field(fields: Column, key: str) -> Column:
    """A field of digits as a number."""
    return F.when(fields[key].rlike(r"^\d+$"), fields[key].cast("int"))


def flag_field(fields: Column, key: str) -> Column:
    return F.when(F.lower(fields[key]) == "true", True).when(F.lower(fields[key]) == "false", False)


def without_frontmatter(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?sm)^---\n.*?\n---[ \t]*(?:\n|\z)", ""), r"^\s+|\s+$", ""))


def sections(text: Column) -> Column:
    """Array of (level, title, content) of headings of level 1 to 3; non-blank lines below belong to them."""
    section = "array<struct<level:int,title:string,content:string>>"
    lines = F.split(F.regexp_replace(text, _BLOCK, ""), "\n")

    def step(acc: Column, line: Column) -> Column:
        marks = F.regexp_extract(line, r"^(#{1,3}) ", 1)
        opened = F.concat(acc, F.array(F.struct(
            F.length(marks).alias("level"), F.trim(F.substring(line, F.length(marks) + 2, F.length(line))).alias("title"), F.lit("").alias("content"),
        )))
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(
            last["level"].alias("level"), last["title"].alias("title"),
            F.concat(last["content"], F.when(last["content"] != "", "\n").otherwise(""), line).alias("content"),
        )))
        return F.when(marks != "", opened).when((F.size(acc) == 0) | (F.trim(line) == ""), acc).otherwise(grown)

    return F.aggregate(lines, F.array().cast(section), step)


def as_json(text: Column) -> Column:
    """{metadata, sections, citations, raw_markdown} as JSON text."""
    return F.to_json(
        F.struct(
            frontmatter(text).alias("metadata"), sections(text).alias("sections"),
            citations(text).alias("citations"), text.alias("raw_markdown"),
        )
    )


def as_markdown(metadata: Column, parts: Column) -> Column:
    """Markdown from a metadata map and sections."""
    head = F.array_join(F.transform(F.array_sort(F.map_entries(metadata)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    body = F.transform(
        parts, lambda s: F.concat(F.repeat(F.lit("#"), s["level"]), F.lit(" "), s["title"], F.lit("\n\n"), s["content"])
    )
    return F.concat(F.lit("---\n"), head, F.lit("\n---\n\n"), F.array_join(body, "\n\n"))


def images(text: Column) -> Column:
    """Array of (alt_text, path, figure, source): images with their figure number and cited source or ordinal."""
    whole = F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\([^)]+\)(?:\s*\*?[^\n]*\*?)?"), F.lit(0))
    return F.transform(
        whole,
        lambda m, i: F.struct(
            F.coalesce(F.nullif(F.regexp_extract(m, r"!\[([^\]]*)\]", 1), F.lit("")), F.lit("Image")).alias("alt_text"),
            F.regexp_extract(m, r"\]\(([^)]+)\)", 1).alias("path"),
            F.nullif(F.regexp_extract(m, r"(Figure \d+)", 1), F.lit("")).alias("figure"),
            F.coalesce(F.nullif(F.regexp_extract(m, r"\[IMG-(\d+)\]", 1), F.lit("")).cast("int"), i + 1).alias("source"),
        ),
    )


def frontmatter_block(**fields: Column) -> Column:
    """A frontmatter block of the given fields, in order."""
    lines = [F.concat(F.lit(f"{k}: "), v.cast("string")) for k, v in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))


def enriched(metadata: Column, grade: Column, subject: Column) -> Column:
    """Chunk metadata with ``edu_*`` keys that are not null; chunk keys win over older ones."""
    kind = F.when(grade.isNotNull() | subject.isNotNull(), "educational")
    more = F.create_map(F.lit("edu_grade"), grade, F.lit("edu_subject"), subject, F.lit("edu_content_type"), kind)
    present = F.map_filter(more, lambda _, v: v.isNotNull())
    kept = F.map_filter(metadata, lambda k, _: ~F.map_contains_key(present, k))
    return F.map_concat(kept, present)


def hints(text: Column, file_name: Column | None = None) -> Column:
    """(grade, subject, content_type) that a text, behind its file name if there is one, speaks of; all null if it does not."""
    from siltstone.functions.text import grade_of, subject_of

    own = text if file_name is None else F.when(F.coalesce(file_name, F.lit("")) != "", F.concat_ws(" ", file_name, text)).otherwise(text)
    grade, subject = grade_of(own), subject_of(own)
    return F.struct(grade.alias("grade"), subject.alias("subject"), F.when(grade.isNotNull() | subject.isNotNull(), "educational").alias("content_type"))


#: Fields of the metadata box and their labels, in order (fixed values).
_BOX = {"grade": "Grade Level", "subject": "Subject", "duration": "Duration", "teaching_style": "Teaching Style", "generated": "Generated"}


def metadata_box(text: Column, style: str = "color") -> Column:
    """The second frontmatter block as a labelled HTML box; empty without one."""
    tail = "-bw" if style == "bw" else ""
    second = F.get(F.regexp_extract_all(text, F.lit(r"(?sm)^---\n(.*?)\n---"), F.lit(1)), F.lit(1))
    # a lambda's argument is computed once, however often it is used
    return F.get(F.transform(F.array(frontmatter(F.concat(F.lit("---\n"), second, F.lit("\n---\n")))), lambda fields: _box(fields, tail)), F.lit(0))


def _box(fields: Column, tail: str) -> Column:
    at = F.try_to_timestamp(F.regexp_replace(fields["generated"], "Z$", "+00:00"))
    shown = {
        "duration": F.concat(fields["duration"], F.lit(" minutes")), "teaching_style": F.initcap(F.translate(fields["teaching_style"], "_", " ")),
        "generated": F.coalesce(F.date_format(at, "MMMM dd, yyyy 'at' hh:mm a"), fields["generated"]),
    }
    item = lambda k, label: F.concat(
        F.lit(f'<div class="metadata-item"><span class="metadata-label">{label}:</span> <span class="metadata-value">'), shown.get(k, fields[k]), F.lit("</span></div>")
    )
    title = F.concat(F.lit(f'<h1 class="lesson-title{tail}">'), fields["title"], F.lit("</h1>"))
    lines = F.array_compact(F.array(
        F.lit(f'<div class="lesson-metadata{tail}">'), title, F.lit('<div class="metadata-grid">'), *[item(k, v) for k, v in _BOX.items()], F.lit("</div>"), F.lit("</div>")
    ))
    return F.when(F.size(fields) > 0, F.array_join(lines, "\n")).otherwise("")


def lesson_prompt(topic: Column, grade: Column, subject: Column, minutes: Column, sources: Column) -> Column:
    """Request for a plan: the lesson's data and previews of its sources, cut at 500 characters."""
    from siltstone.operators.context import preview

    lines = F.transform(sources, lambda s, i: F.concat(F.format_string("[%d] ", i + 1), preview(s)))
    return F.concat(
        F.lit("Topic: "), topic, F.lit("\nGrade: "), grade, F.lit("\nSubject: "), subject,
        F.lit("\nDuration: "), minutes.cast("string"), F.lit(" minutes\n\nSources:\n"), F.array_join(lines, "\n"),
    )


def assembled_lesson(text: Column, topic: Column, head: Column) -> Column:
    """(title, markdown): the frontmatter's title or the topic; the frontmatter is replaced by ``head``."""
    title = F.coalesce(F.nullif(frontmatter(text)["title"], F.lit("")), topic)
    return F.struct(title.alias("title"), F.concat(head, F.lit("\n"), without_frontmatter(text)).alias("markdown"))
