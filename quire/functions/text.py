"""Column functions on text. Each takes and returns columns and stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Glossary priorities from most to least urgent.
PRIORITIES = ("critical", "high", "medium", "low")
#: Language names by code.
LANGUAGES = {"zh": "Chinese", "en": "English", "ja": "Japanese", "ko": "Korean", "fr": "French", "de": "German", "es": "Spanish", "pt": "Portuguese", "ru": "Russian", "ar": "Arabic", "it": "Italian"}

#: Fixed value: what a source with addresses or imprint lines looks like.
URL_HINT = r"(?i)https?://|www\.|\.com\b|\.org\b|\.net\b|\.co\.\w{2}\b|@\w|©|ISBN\b|First\s+published\b"
#: Where a text's lines end.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
EXCERPT_CHARS, CLIP_CHARS, CLIP_LEAD = 120, 400, 180


def collapse(c: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def term_key(term: Column) -> Column:
    """Lower case, hyphens as spaces, only a-z, 0-9 and spaces, no leading article."""
    plain = F.regexp_replace(F.replace(F.lower(term), F.lit("-"), F.lit(" ")), "[^a-z0-9 ]", "")
    return F.regexp_replace(F.trim(F.regexp_replace(plain, " +", " ")), "^(?:the|a|an) ", "")


def excerpt(text: Column, chars: int = EXCERPT_CHARS) -> Column:
    return F.concat(F.left(text, F.lit(chars)), F.when(F.length(text) > chars, "...").otherwise(""))


def clip(sentence: Column, position: Column, chars: int = CLIP_CHARS) -> Column:
    """At most chars around a 0-based position, with an ellipsis at each cut end."""
    start = F.greatest(F.lit(0), F.least(position - CLIP_LEAD, F.length(sentence) - chars))
    cut = F.concat(F.when(start > 0, "…").otherwise(""), F.substr(sentence, start + 1, F.lit(chars)), F.when(start + chars < F.length(sentence), "…").otherwise(""))
    return F.when(F.length(sentence) <= chars, sentence).otherwise(cut)


def cjk_count(text: Column) -> Column:
    """Unified ideographs, U+4E00 to U+9FFF."""
    return F.length(F.regexp_replace(text, "[^一-鿿]", ""))


def high_count(text: Column) -> Column:
    """Everything above U+4E00, emoji and Hangul too; the line splitter's test."""
    return F.length(F.regexp_replace(text, r"[^\x{4E01}-\x{10FFFF}]", ""))


def cjk_density(text: Column) -> Column:
    """Ideographs over stripped length without ASCII letters, at least 1."""
    stripped = F.regexp_replace(text, r"^\s+|\s+$", "")
    letters = F.length(F.regexp_replace(stripped, "[^A-Za-z]", ""))
    return cjk_count(stripped) / F.greatest(F.length(stripped) - letters, F.lit(1))


def is_high_script_line(line: Column) -> Column:
    """Lines of which more than three tenths lie above U+4E00."""
    stripped = F.regexp_replace(line, r"^\s+|\s+$", "")
    return (F.length(stripped) > 0) & (high_count(stripped) * 10 > F.length(stripped) * 3)


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(html, "<[^>]+>", " "))


def candidate_lines(html: Column) -> Column:
    """Stripped non-empty lines once tags have become line ends."""
    lines = F.split(F.regexp_replace(html, "<[^>]+>", "\n"), LINE_END)
    return F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def sentences(text: Column) -> Column:
    return F.filter(F.split(collapse(text), r"(?<=[.!?])\s+"), lambda s: s != "")


def options_of(translation: Column) -> Column:
    """A translation's choices, split at slashes."""
    return F.filter(F.split(translation, r"\s*[/／]\s*"), lambda x: x != "")


def offers_choice(translation: Column) -> Column:
    return translation.rlike("[/／]")


def clean_alternatives(alternatives: Column) -> Column:
    return F.filter(F.transform(alternatives, lambda x: F.trim(x)), lambda x: x != "")


def priority_rank(priority: Column) -> Column:
    """0 for the most urgent; unknown counts as medium."""
    out = F.lit(PRIORITIES.index("medium"))
    for i, name in enumerate(PRIORITIES):
        out = F.when(priority == name, i).otherwise(out)
    return out


def escape_regex(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\.\[\]{}()*+?^$|/#&~-])", r"\\$1")


def term_pattern(term: Column) -> Column:
    """Words joined by any white space, whole words only, any case."""
    words = F.transform(F.split(F.regexp_replace(term, r"(?U)^\s+|\s+$", ""), r"(?U)\s+"), escape_regex)
    return F.concat(F.lit(r"(?iU)(?<!\w)"), F.array_join(words, r"\s+"), F.lit(r"(?!\w)"))


def phrase_pattern(term: Column) -> Column:
    """As term_pattern, words joined by spaces or hyphens, with an optional plural."""
    words = F.transform(F.filter(F.split(F.regexp_replace(term, r"\(.*?\)", ""), r"(?U)[\s/-]+"), lambda w: w != ""), escape_regex)
    return F.concat(F.lit(r"(?iU)(?<!\w)"), F.array_join(words, r"[\s-]+"), F.lit(r"(?:s|es)?(?!\w)"))


def stems(term: Column) -> Column:
    """Of words of four letters or more: all but the last three, four at least."""
    words = F.filter(F.split(F.regexp_replace(term, r"\(.*?\)", ""), r"(?U)[\s/-]+"), lambda w: F.length(w) >= 4)
    return F.transform(words, lambda w: F.left(F.lower(w), F.greatest(F.lit(4), F.length(w) - 3)))


def strip_fence(reply: Column) -> Column:
    """A model reply without the Markdown fence around its JSON."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.when(F.contains(reply, F.lit("```")), inner).otherwise(F.trim(reply))


def language_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, code), code)


def elapsed_seconds(text: Column) -> Column:
    """``[[dd-]hh:]mm:ss`` as seconds; null when malformed."""
    day = F.when(F.contains(text, F.lit("-")), F.substring_index(text, "-", 1)).otherwise("0")
    clock = F.split(F.substring_index(text, "-", -1), ":")
    n = F.size(clock)
    part = lambda i: F.expr("0").cast("bigint") if i is None else F.get(clock, i).try_cast("bigint")
    whole = F.when(n == 3, part(0) * 3600 + part(1) * 60 + part(2)).when(n == 2, part(0) * 60 + part(1))
    return F.when(text.rlike(r"^(?:(?:\d+-)?\d+:)?\d+:\d+$"), day.try_cast("bigint") * 86400 + whole)


def retry_after(message: Column) -> Column:
    """Whole seconds to wait, from the JSON form or else the prose form of an error."""
    found = F.coalesce(
        F.nullif(F.regexp_extract(message, r'"retryDelay":\s*"(\d+)s"', 1), F.lit("")),
        F.nullif(F.regexp_extract(message, r"(?i)retry after (\d+)", 1), F.lit("")),
    )
    return found.try_cast("bigint")


def progress_value(value: Column) -> Column:
    """A log value, quoted as JSON when it holds anything but plain characters."""
    return F.when(value.rlike(r"^[A-Za-z0-9_./:+-]+$"), value).otherwise(F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(value, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"')))


def resolve_href(base_dir: Column, href: Column) -> Column:
    """A relative reference joined to a directory, ``.`` and ``..`` resolved, POSIX style."""
    joined = F.when((base_dir == "") | href.startswith("/"), href).otherwise(F.concat_ws("/", base_dir, href))
    parts = F.filter(F.split(joined, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda a, p: F.when((p == "..") & (F.size(a) > 0) & (F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit("")) != ".."), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))),
    )
    return F.concat(F.when(joined.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))
