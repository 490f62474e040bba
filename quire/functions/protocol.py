"""Batches of segments as one prompt and back, prompts, and identities of saved work.
Each function takes and returns columns and stays in the JVM, but for the folding of
file names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types

from .text import language_name

#: What separates segments, and how a tagged segment and a fence look.
SEPARATOR = "\n\n%%\n\n"
LOOSE_SEPARATOR = r"(?U)\n\s*%%\s*\n"
TAGGED = r"""(?isU)<segment\s+id\s*=\s*['"](\d+)['"]\s*>(.*?)</segment>"""
FENCED = r"(?sU)^\s*```[a-zA-Z0-9_-]*\s*\n(.*)\n```\s*$"
#: Headings of the two tiers of a glossary block.
FIXED_HEADING = "【关键术语约束】以下术语必须严格遵守标准译法："
PREFERRED_HEADING = "【建议术语】以下译法一般情况下采用；如果某句的语境需要，可以改用更贴切、更通顺的译法，但不得改变原意："


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def framed(segments: Column, tagged: bool = True) -> Column:
    """Segments of a batch as one text; a single one stands alone."""
    if tagged:
        parts = F.transform(segments, lambda s, i: F.concat(F.lit('<segment id="'), (i + 1).cast("string"), F.lit('">'), s, F.lit("</segment>")))
    else:
        parts = segments
    return F.when(F.size(segments) == 1, F.get(segments, F.lit(0))).otherwise(F.array_join(parts, "\n\n" if tagged else SEPARATOR))


#: What a prompt says about batches of more than one segment.
DELIMITED_ADDENDUM = (
    "\n\nIMPORTANT: The input contains multiple text sections separated"
    " by %%. Translate each section independently and preserve the %%"
    " separators in your output. Output exactly the same number of"
    " sections as the input."
)
TAGGED_ADDENDUM = (
    "\n\n[STRICT OUTPUT CONTRACT]\n"
    "Return exactly one XML block per section using this structure:\n"
    '<segment id="1">...</segment>\n'
    '<segment id="2">...</segment>\n'
    "...\n"
    "Rules:\n"
    "1) Preserve every segment id from 1..N exactly once.\n"
    "2) Do NOT merge, split, reorder, add, or drop segments.\n"
    "3) Output only <segment> blocks (no prose, no markdown fences).\n"
    "4) Keep empty sections as empty content inside their original tags.\n"
    "If any id is missing or duplicated, the task is considered failed."
)


def with_contract(prompt: Column, n: Column, tagged: bool) -> Column:
    """A prompt with what it must say of a batch of n segments; of one it says nothing."""
    return F.when(n <= 1, prompt).otherwise(F.concat(prompt, F.lit(TAGGED_ADDENDUM if tagged else DELIMITED_ADDENDUM)))


def _result(n: Column, whole: Column, error: Column, parts: Column) -> Column:
    """The rules that all protocols share: nothing was asked, or one segment alone."""
    none = F.array().cast("array<string>")
    error = F.when(n <= 0, None).when((n == 1) & (whole == ""), "empty reply").when(n > 1, error)
    parts = F.when(n <= 0, none).when(n == 1, F.array(whole)).otherwise(parts)
    return F.struct(error.alias("error"), F.when(error.isNull(), parts).alias("parts"))


def split_tagged(reply: Column, n: Column) -> Column:
    """``error`` and ``parts`` of a reply to a tagged batch of n segments: every id from
    1 to n once, in any order, and nothing outside the tags."""
    whole = stripped(reply)
    body = F.when(whole.rlike(FENCED), stripped(F.regexp_extract(whole, FENCED, 1))).otherwise(whole)
    ids = F.transform(F.regexp_extract_all(body, F.lit(TAGGED), F.lit(1)), lambda x: x.try_cast("bigint"))
    texts = F.transform(F.regexp_extract_all(body, F.lit(TAGGED), F.lit(2)), stripped)
    wanted = F.when(n > 0, F.sequence(F.lit(1).cast("bigint"), F.greatest(n, F.lit(1)).cast("bigint")))
    error = (
        F.when(F.size(ids) == 0, "no segment tags")
        .when(stripped(F.regexp_replace(body, TAGGED, "")) != "", "text outside tags")
        .when(F.size(ids) != n, "wrong number of segments")
        .when(F.size(F.array_distinct(ids)) != F.size(ids), "repeated ids")
        .when(F.array_sort(ids) != wanted, "wrong ids")
    )
    return _result(n, whole, error, F.transform(wanted, lambda i: F.get(texts, (F.array_position(ids, i) - 1).cast("int"))))


def split_delimited(reply: Column, n: Column) -> Column:
    """``error`` and ``parts`` of a reply to a delimited batch of n segments: cut at the
    separator, or else at looser ones; blank parts don't count."""
    whole = stripped(reply)
    cut = lambda pattern: F.filter(F.transform(F.split(whole, pattern, -1), stripped), lambda x: x != "")
    strict, loose = cut(SEPARATOR), cut(LOOSE_SEPARATOR)
    parts = F.when(F.size(strict) == n, strict).when(F.size(loose) == n, loose)
    return _result(n, whole, F.when(parts.isNull(), "wrong number of segments"), parts)


# ---------------------------------------------------------------- prompts


def glossary_line(term: Column, translation: Column, negative: Column, alternatives: Column | None = None) -> Column:
    """A term as the prompt states it, with its alternatives where given."""
    line = F.concat(F.lit("  • "), F.coalesce(term, F.lit("")), F.lit(" → "), F.coalesce(translation, F.lit("")))
    if alternatives is not None:
        some = F.filter(F.transform(alternatives, stripped), lambda x: x != "")
        line = F.concat(line, F.when(F.size(some) > 0, F.concat(F.lit("（也可："), F.array_join(some, "、"), F.lit("）"))).otherwise(""))
    return F.concat(line, F.when(F.coalesce(negative, F.lit("")) != "", F.concat(F.lit("（"), negative, F.lit("）"))).otherwise(""))


def rendered(template: Column, language: Column, glossary: Column, custom: Column) -> Column:
    """A prompt template with its three places filled in. language: a code, or a name
    as it is."""
    out = F.replace(template, F.lit("{TARGET_LANGUAGE}"), language_name(language))
    out = F.replace(out, F.lit("{GLOSSARY_BLOCK}"), F.coalesce(glossary, F.lit("")))
    return F.replace(out, F.lit("{CUSTOM_INSTRUCTIONS_BLOCK}"), F.coalesce(custom, F.lit("")))


def reason(vendors: Column, keepers: Column, judges: Column) -> Column:
    """Why a term is in the glossary."""
    named = F.concat(F.lit("Term Panel: nominated by "), F.array_join(F.array_sort(vendors), ", "))
    return F.concat(named, F.when(judges == 0, ".").otherwise(F.concat(F.lit("; kept by "), keepers.cast("string"), F.lit(" of "), judges.cast("string"), F.lit(" judges."))))


# ---------------------------------------------------------------- identities


def json_string(text: Column) -> Column:
    """A JSON string in ASCII; other characters as ``\\uXXXX`` of their UTF-16 units."""
    units = lambda c: F.hex(F.encode(c, "UTF-16BE"))
    escaped = lambda c: F.concat(F.lit("\\u"), F.lower(F.left(units(c), F.lit(4))), F.when(F.length(units(c)) > 4, F.concat(F.lit("\\u"), F.lower(F.right(units(c), F.lit(4))))).otherwise(""))
    short = F.create_map(*[F.lit(x) for pair in {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}.items() for x in pair])
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    plain = text.rlike(r"^[\x20\x21\x23-\x5B\x5D-\x7E]*$")
    odd = F.array_join(F.transform(chars, lambda c: F.coalesce(F.try_element_at(short, c), F.when(c.rlike(r"^[\x20-\x7E]$"), c).otherwise(escaped(c)))), "")
    return F.concat(F.lit('"'), F.when(plain, text).otherwise(odd), F.lit('"'))


def canonical_json(**fields: Column) -> Column:
    """An object with sorted keys and ``": "`` and ``", "`` between; null values are
    null. Strings are escaped, other types stand as their text."""
    parts = []
    for name in sorted(fields):
        text, value = name.endswith("__raw"), fields[name]
        parts += [F.lit(f'"{name.removesuffix("__raw")}": '), F.coalesce(value.cast("string") if text else json_string(value.cast("string")), F.lit("null")), F.lit(", ")]
    return F.concat(F.lit("{"), *parts[:-1], F.lit("}"))


def identity(**fields: Column) -> Column:
    """SHA-256 of the canonical JSON; numbers under a name that ends in ``__raw``."""
    return F.sha2(canonical_json(**fields), 256)


def reply_digest(model: Column, prompt: Column) -> Column:
    """What a saved reply is found by: its model and exact prompt."""
    return F.sha2(F.concat(model, F.lit("\n"), prompt), 256)


# ---------------------------------------------------------------- file names


@F.pandas_udf(types.StringType())
def folded_name(names: pd.Series) -> pd.Series:
    """A name as file systems that ignore letter case and composition see it: composed
    (NFC), then with full case folding, which no column function has."""
    return names.map(lambda x: None if x is None else unicodedata.normalize("NFC", x).casefold())


def same_name(a: Column, b: Column) -> Column:
    """Whether a file system that ignores letter case and composition would take two
    names for one."""
    return folded_name(a) == folded_name(b)


def output_name(given: Column, source: Column) -> Column:
    """``name`` and ``error``: the given name, or one from the source's, with ``.epub``
    after a name without a suffix; null with an error when it will not do."""
    suffix = lambda n: F.regexp_extract(n, r"^.*[^.].*(\.[^.]+)$", 1)
    stem = F.when(suffix(source) != "", F.left(source, F.length(source) - F.length(suffix(source)))).otherwise(source)
    asked = stripped(F.coalesce(given, F.lit("")))
    name = F.when(asked == "", F.concat(stem, F.lit(".zh.epub"))).otherwise(asked)
    name = F.when(suffix(name) == "", F.concat(name, F.lit(".epub"))).otherwise(name)
    error = (
        F.when(name.rlike(r"[/\\]|[\p{C}\p{Z}&&[^ ]]") | name.startswith("."), "not a plain file name")
        .when(F.octet_length(name) > 255, "too long")
        .when(F.lower(suffix(name)) != ".epub", "does not end in .epub")
        .when(same_name(name, source), "is the uploaded file")
    )
    return F.struct(F.when(error.isNull(), name).alias("name"), error.alias("error"))
