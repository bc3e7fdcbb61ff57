"""Rows from a table of web pages (S21-S24): links, result lists, game headers, player tables, competition lists.

Everything is a Column expression: tables are cut at the tags that open rows and cells, which pages that forget to close
them have as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def codes(pages: DataFrame, pattern: str, html: str = "html", key: str = "page_id") -> DataFrame:
    """The distinct values of the pattern's first group in each page."""
    return pages.select(key, F.explode(F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), 1))).alias("code"))


def first_by_name(pages: DataFrame, pattern: str, html: str = "html", key: str = "page_id") -> DataFrame:
    """(value, name) pairs of a two-group pattern in document order; the first value of each name wins."""
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), 1).alias("value"), F.regexp_extract_all(html, F.lit(pattern), 2).alias("name"))
    rows = pages.select(key, F.posexplode(pairs).alias("pos", "p")).select(key, "pos", F.col("p.value").alias("value"), F.trim("p.name").alias("name"))
    w = Window.partitionBy(key, "name").orderBy("pos")
    return rows.where("name <> ''").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def game_headers(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """Season, date, time and final score that a page's text states; null where it states none."""
    text = F.regexp_replace(F.regexp_replace(html, r"(?s)<[^>]*>", " "), r"\s+", " ")
    found = lambda pattern, g=1: F.nullif(F.regexp_extract(text, pattern, g), F.lit(""))
    score = r"\b(\d{1,3})\s*[-–]\s*(\d{1,3})\b(?![-/])"
    return pages.select(
        key,
        found(r"\b(\d{4}[-/]\d{4})\b").alias("season"),
        found(r"\b(\d{2}/\d{2}/\d{4})\b").alias("date"),
        found(r"\b(\d{1,2}:\d{2})\b").alias("time"),
        found(r"(?i)(?:resultado|score)\D{0,20}" + score, 1).cast("int").alias("home_score"),
        found(r"(?i)(?:resultado|score)\D{0,20}" + score, 2).cast("int").alias("away_score"),
    )


def game_boxes(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """Venue, city, referees, teams, final and quarter scores that a page's marked-up fields state; null or an empty list where it states none."""
    clean = lambda x: F.nullif(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]*>", " "), "&nbsp;|\u00a0", " "), r"\s+", " ")), F.lit(""))
    found = lambda text, pattern: F.regexp_extract(text, "(?is)" + pattern, 1)
    field = lambda name: clean(found(F.col(html), rf"<span[^>]*\bid=[\"'][^\"']*_{name}[\"'][^>]*>(.*?)</span>"))
    text = F.regexp_replace(F.regexp_replace(html, r"(?s)<[^>]*>", " "), r"\s+", " ")
    named = F.filter(F.array(*[field(f"arbitro{i}Nombre") for i in (1, 2, 3)]), lambda x: x.isNotNull())
    stated = F.slice(F.regexp_extract_all(text, F.lit(r"([A-Z]{3,}\s+[A-Z]{3,},\s+[A-Z]{3,})"), 1), 1, 3)
    part = r"<div[^>]*\bclass=[\"'][^\"']*\bparciales\b"
    # generators, so that what follows uses the cut pieces and does not cut them again
    once = lambda df, *values: df.select(key, html, F.inline(F.array(F.struct(*values))))
    pages = once(pages, found(F.col(html), r"(<div[^>]*\bclass=[\"'][^\"']*\bbox-marcador\b.*)").alias("__box"))
    pages = once(pages, F.regexp_replace("__box", rf"(?is){part}.*", "").alias("__head"), found(F.col("__box"), rf"({part}.*)").alias("__rows"))
    head, rows = F.col("__head"), F.col("__rows")
    # a side's block ends where the other side's begins
    side = lambda area, own, other: found(area, rf"<div[^>]*\bclass=[\"'][^\"']*\bequipo {own}\b[^>]*>(.*?)(?:<div[^>]*\bclass=[\"'][^\"']*\bequipo {other}\b|\z)")
    span = lambda area, name: found(area, rf"<span[^>]*\bclass=[\"'][^\"']*\b{name}\b[^>]*>(.*?)</span>")
    sides = (("home", "local", "visitante"), ("away", "visitante", "local"))
    pages = once(pages, *[v.alias(f"__{prefix}_{k}") for prefix, own, other in sides for k, v in (("block", side(head, own, other)), ("quarters", found(side(rows, own, other), r"^(.*?)(?:</div>|\z)")))])
    columns = []
    for prefix, _, _ in sides:
        block, quarters = F.col(f"__{prefix}_block"), F.col(f"__{prefix}_quarters")
        columns += [
            clean(span(block, "nombre")).alias(f"{prefix}_team"),
            F.nullif(F.regexp_extract(clean(span(block, "resultado")), r"^(\d+)$", 1), F.lit("")).cast("int").alias(f"{prefix}_score"),
            F.transform(F.regexp_extract_all(quarters, F.lit(r"(?is)<span[^>]*>\s*(\d+)\s*</span>"), 1), lambda x: x.cast("int")).alias(f"{prefix}_quarters"),
        ]
    return pages.select(key, field("pabellon").alias("venue"), field("localidad").alias("city"), F.when(F.size(named) > 0, named).otherwise(stated).alias("referees"), *columns)


def _text(x: Column) -> Column:
    """Markup without tags, with plain blanks for the named and other white space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]*>", ""), "&nbsp;|\u00a0", " "), r"\s+", " "))


def _rows(html: Column) -> Column:
    """The rows of a page's tables in order: ``(kind, body)``, the row tag's attributes and what is between it and the next row or the row's end; header rows are left out."""
    pieces = F.slice(F.split(html, r"(?i)<tr\b"), 2, 1 << 30)
    row = lambda p: F.struct(F.regexp_extract(p, r"^([^>]*)>", 1).alias("kind"), F.regexp_replace(F.regexp_replace(p, r"(?is)</(?:tr|table)\b.*$", ""), r"^[^>]*>", "").alias("body"))
    return F.filter(F.transform(pieces, row), lambda r: ~r["body"].rlike(r"(?i)<th\b"))


def _cells(body: Column) -> Column:
    """The texts of a row's cells."""
    return F.transform(F.slice(F.split(body, r"(?i)<td\b[^>]*>"), 2, 1 << 30), lambda c: _text(F.regexp_replace(c, r"(?is)</td\b.*$", "")))


def table_rows(pages: DataFrame, least_cells: int = 20, html: str = "html", key: str = "page_id") -> DataFrame:
    """``(key, row, cells)``: the cells of each table row with at least so many, without header and total rows, numbered in order."""
    rows = F.filter(_rows(F.col(html)), lambda r: ~r["kind"].contains("row-total"))
    cells = F.filter(F.transform(rows, lambda r: _cells(r["body"])), lambda c: F.size(c) >= least_cells)
    return pages.select(key, F.posexplode(cells).alias("row", "cells"))


def result_rows(pages: DataFrame, pattern: str, html: str = "html", key: str = "page_id") -> DataFrame:
    """``(key, code, date)``: the codes that links of result tables name, each once with the date of its row; header rows and rows without such a link don't count."""
    rows = pages.select(key, F.posexplode(_rows(F.col(html))).alias("at", "r"))
    found = rows.select(key, "at", F.explode(F.regexp_extract_all("r.body", F.lit(pattern), 1)).alias("code"), F.nullif(F.regexp_extract(_text(F.col("r.body")), r"(\d{2}/\d{2}/\d{4})", 1), F.lit("")).alias("date"))
    return found.groupBy(key, "code").agg(F.min_by("date", "at").alias("date"))


def made_attempted(cell) -> tuple:
    """``7/12 58,3%`` as made, attempted and percentage columns; null where it is no such cell."""
    part = lambda p: F.nullif(F.regexp_extract(cell, p, 1), F.lit(""))
    return part(r"^\s*(\d+)/\d+").cast("int"), part(r"^\s*\d+/(\d+)").cast("int"), F.replace(part(r"([\d,.]+)\s*%"), F.lit(","), F.lit(".")).cast("double")
