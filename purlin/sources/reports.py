"""Reports of several sections with different columns as one CSV, HTML or JSON-lines text, and tables as CSV for spreadsheets.

Each section is sorted by its own keys over ranges and written by many tasks below ``<path>/<number>``; the parts' names keep their
order, so the parts joined in order of name are the file. Lines are built as column expressions; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from purlin.sources.store import Files

BOM = "﻿"


@dataclass(frozen=True)
class Section:
    """``frame``: the section's rows, any of the report's fields; ``order``: what sorts them, unique together."""

    name: str
    frame: DataFrame
    order: Sequence[str] = ()
    columns: Sequence[str] = field(default=())  # of the HTML table; default: the frame's

    def sorted(self) -> DataFrame:
        return self.frame.orderBy(*self.order) if self.order else self.frame.coalesce(1)  # unsorted sections are single rows


def shown(value: Column) -> Column:
    """A value as text; null is empty."""
    return F.coalesce(value.cast("string"), F.lit(""))


def csv_field(value: Column, always: bool = False) -> Column:
    """Quoted where it must be: commas, quotes and line ends; quotes are doubled."""
    text = shown(value)
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return quoted if always else F.when(text.rlike('[",\\r\\n]'), quoted).otherwise(text)


def html_text(value: Column) -> Column:
    text = shown(value)
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def _line(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(text,)], "value string").coalesce(1)


def _write(parts: Sequence[DataFrame], path: str, line_end: str) -> None:
    """One folder a part, numbered; they become visible together: the marker is written last."""
    spark = parts[0].sparkSession
    files = Files(spark, path)
    files.delete("")
    for i, frame in enumerate(parts):
        frame.select("value").write.option("lineSep", line_end).text(f"{path}/{i:05d}")
    files.create("_COMPLETE", "")


def parts_in_order(spark: SparkSession, path: str) -> list[str]:
    """The names of the files whose bytes, joined, are the report; none of an unfinished one."""
    files = Files(spark, path)
    if not files.exists("_COMPLETE"):
        return []
    return [f"{d}/{n}" for d in files.names("") if d[0] not in "._" for n in files.names(d) if n.startswith("part-")]


def write_csv(sections: Sequence[Section], path: str, fields: Sequence[str], first: str = "section") -> None:
    """A header, and the rows of all sections under one set of fields; the first field names the section."""
    spark = sections[0].frame.sparkSession
    parts = [_line(spark, ",".join([first, *fields]))]
    for s in sections:
        values = [csv_field(F.lit(s.name)), *[csv_field(F.col(f"`{c}`")) if c in s.frame.columns else F.lit("") for c in fields]]
        parts.append(s.sorted().select(F.concat_ws(",", *values).alias("value")))
    _write(parts, path, "\r\n")


def write_table_csv(rows: DataFrame, path: str, columns: dict[str, str], order: Sequence[str]) -> None:
    """A table for spreadsheets: byte order mark, every value quoted, CRLF. ``columns``: column to heading."""
    heading = BOM + ",".join('"' + h.replace('"', '""') + '"' for h in columns.values())
    body = rows.orderBy(*order).select(F.concat_ws(",", *[csv_field(F.col(f"`{c}`"), always=True) for c in columns]).alias("value"))
    _write([_line(rows.sparkSession, heading), body], path, "\r\n")


def write_html(sections: Sequence[Section], path: str, title: str, notice: str = "") -> None:
    """A page with a table for each section."""
    spark = sections[0].frame.sparkSession
    escape = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    head = f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>'
    parts = [_line(spark, head + (f"<p>{escape(notice)}</p>" if notice else ""))]
    for s in sections:
        columns = list(s.columns or s.frame.columns)
        parts.append(_line(spark, f"<h2>{escape(s.name)}</h2><table><tr>" + "".join(f"<th>{escape(c)}</th>" for c in columns) + "</tr>"))
        cells = [x for c in columns for x in (F.lit("<td>"), html_text(F.col(f"`{c}`")), F.lit("</td>"))]
        parts.append(s.sorted().select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("value")))
        parts.append(_line(spark, "</table>"))
    _write([*parts, _line(spark, "</body></html>")], path, "\n")


def write_json(sections: Sequence[Section], path: str) -> None:
    """A line for each row: its section and the row, nulls included."""
    parts = []
    for s in sections:
        item = F.to_json(F.struct(F.lit(s.name).alias("section"), F.struct(*[F.col(f"`{c}`") for c in s.frame.columns]).alias("item")), {"ignoreNullFields": "false"})
        parts.append(s.sorted().select(item.alias("value")))
    _write(parts, path, "\n")
