"""Signals that a page is an index or glossary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.trees import page_lines
from .text import collapse

#: How an entry names its pages, and what an entry looks like.
_PAGE = r"(?:\d{1,4}(?:[-–]\d{1,4})?|[♣♦•·*†‡§¶])"
_ENTRY = r"[A-Za-z0-9].{1,160},\s*" + _PAGE + r"(?:\s*,\s*" + _PAGE + ")*"
#: Name, weight and pattern of each signal, in order of report.
SIGNALS = (
    ("href_hint", 25, r"(?i)(?:^|/)(?:index|glossary|idx|ix\d+)"),
    ("epub_type", 40, r'(?i)(?:epub:|data-)type="(?:index|glossary)"|role="doc-index"'),
    ("css_class", 20, r'(?i)class="[^"]*\b(?:index|glossary|idx|searchable-terms)\b[^"]*"'),
    ("anchor_id", 10, r'(?i)id="(?:index|glossary)[-_a-z0-9]*"'),
    ("heading", 10, r"(?i)<h[1-6][^>]*>\s*(?:index|glossary|searchable terms|terminology)\s*</h[1-6]>"),
    # an entry somewhere: found from its comma, so that text without one costs nothing
    ("line_shape", 20, r",(?=\s*(?:\d|[♣♦•·*†‡§¶]))(?<=[A-Za-z0-9].{1,160},)"),
)
STRONG = 35
#: All that a converter leaves on a page without a text.
STOCK = ("converted ebook", "converted ebook dead simple python")
#: Words that mark the heading of an index, and pages that hold nothing else.
HEADING_HINTS = ("index", "glossary", "searchable terms", "terminology")
HEADING_WORDS = ("index", "glossary", "searchable", "terms", "索引", "术语表")
#: Names of index pages, bars of letters, names of tables of contents.
PATH_HINTS = ("index", "idx", "glossary")
NAV_MARKERS = ("[ a ][ b ][ c ]", "[ a ][ b ]")
TOC_NAME = r"(?i)(?<![a-z0-9])(?:toc|contents)(?![a-z0-9])"


def signals(href: Column, html: Column) -> list[Column]:
    subject = {"href_hint": F.lower(href), "line_shape": collapse(F.regexp_replace(html, "<[^>]+>", " "))}
    return [subject.get(name, html).rlike(pattern) for name, _, pattern in SIGNALS]


def score(href: Column, html: Column) -> tuple[Column, Column]:
    """Total weight, and the names of the signals met."""
    met = signals(href, html)
    total = sum((F.when(m, weight).otherwise(0) for m, (_, weight, _) in zip(met, SIGNALS)), F.lit(0))
    return total, F.array_compact(F.array(*[F.when(m, name) for m, (name, _, _) in zip(met, SIGNALS)]))


def is_entry(line: Column) -> Column:
    """4 to 180 characters, at most 16 words, a heading word and its pages."""
    flat = collapse(line)
    return F.length(flat).between(4, 180) & (F.size(F.split(flat, " ")) <= 16) & flat.rlike("^" + _ENTRY + "$")


def looks_like_index(lines: Column) -> Column:
    """Enough lines, and a large enough share of them, are entries; less is asked
    for under a heading."""
    flat = F.filter(F.transform(lines, collapse), lambda x: x != "")
    hint = F.exists(F.slice(flat, 1, 3), lambda x: F.lower(x).rlike("|".join(HEADING_HINTS)))
    n, hits = F.size(flat), F.size(F.filter(flat, is_entry))
    return (n >= 3) & F.when(hint, (hits >= 3) & (hits * 100 >= n * 45)).otherwise((hits >= 4) & (hits * 10 >= n * 6))


def index_page(html: Column) -> Column:
    """Whether the lines of a page, by its tags where it is well-formed, are an index."""
    return looks_like_index(page_lines(html))


def is_index_path(path: Column) -> Column:
    return F.lower(path).rlike("|".join(PATH_HINTS))


def has_alphabet_bar(text: Column) -> Column:
    head = F.lower(F.left(text, F.lit(500)))
    return F.contains(head, F.lit(NAV_MARKERS[0])) | F.contains(head, F.lit(NAV_MARKERS[1]))


def is_placeholder(text: Column) -> Column:
    """Nothing but a heading, or a converter's stock text."""
    flat = F.lower(collapse(text))
    words = F.regexp_extract_all(flat, F.lit(r"(?U)\w+"), F.lit(0))
    return (flat == "") | flat.isin(*STOCK) | (F.size(F.array_except(words, F.array(*[F.lit(w) for w in HEADING_WORDS]))) == 0)


def is_toc_name(path: Column) -> Column:
    """toc or contents anywhere in the file name; the reader's test."""
    return F.lower(F.regexp_extract(path, "[^/]*$", 0)).rlike("toc|contents")


def is_toc_href(path: Column) -> Column:
    """toc or contents as a word of the file stem; the extractor's test."""
    return F.regexp_replace(F.regexp_extract(path, "[^/]*$", 0), r"\.[^.]*$", "").rlike(TOC_NAME)
