"""Pages as trees whose nodes are numbered intervals.

A well-formed page is read once. Its text is one string in document order, and each
node is an interval of it, beside the interval of node numbers that it spans: what a
node holds is a slice, what lies inside it has numbers within its own. So lines come
from slices, and questions on containment are joins of intervals, without a tree.

A page that is no XML has no nodes; its tags are cut out by pattern."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

from ..functions import text as T
from .dom import local

#: Tags whose text is a line of its own.
LINE_TAGS = {"h1", "h2", "h3", "p", "li", "dd", "dt"}

READ = types.StructType().add("text", types.StringType()).add("lines", types.ArrayType(types.StringType()))


def intervals(page: str | None) -> tuple[list[str], list[tuple[int, int, int, str, int, int]]] | None:
    """The pieces of text of a page in order, and its nodes in order of their start
    tags: number, the last number inside, depth, tag, and the first and the end of
    its pieces. None for what is no XML."""
    try:
        top = ET.fromstring(page or "")
    except ET.ParseError:
        return None
    pieces, nodes, stack = [], [], [(top, 0, False)]
    open_: list[int] = []
    while stack:
        e, depth, ended = stack.pop()
        if ended:
            at, _, depth, tag, begin, _ = nodes[i := open_.pop()]
            nodes[i] = (at, len(nodes) - 1, depth, tag, begin, len(pieces))
            if e.tail and depth:
                pieces.append(e.tail)
            continue
        open_.append(len(nodes))
        nodes.append((len(nodes), 0, depth, local(e.tag), len(pieces), 0))
        if e.text:
            pieces.append(e.text)
        stack.append((e, depth, True))
        stack += [(child, depth + 1, False) for child in reversed(e)]
    return pieces, nodes


def collapsed(text: str) -> str:
    return " ".join(text.split())


@F.pandas_udf(READ)
def read(pages: pd.Series) -> pd.DataFrame:
    """The text of a well-formed page, pieces joined by spaces, and its lines; null else."""
    rows = []
    for page in pages:
        if (found := intervals(page)) is None:
            rows.append((None, None))
            continue
        pieces, nodes = found
        at, flat = [0], "".join(pieces)
        for p in pieces:
            at.append(at[-1] + len(p))
        lines = (collapsed(flat[at[a] : at[b]]) for _, _, _, tag, a, b in nodes if tag in LINE_TAGS)
        rows.append((" ".join(pieces).strip(), [x for x in lines if x]))
    return pd.DataFrame(rows, columns=["text", "lines"])


def visible_text(html: Column) -> Column:
    """The text of a page; of one that is no XML what is left without its tags."""
    return F.coalesce(read(html)["text"], T.strip_tags(html))


def page_lines(html: Column) -> Column:
    """Lines of a page: the text of each heading, paragraph and list or definition item,
    nested ones too; of a page that is no XML whatever stands between tags."""
    return F.coalesce(read(html)["lines"], T.candidate_lines(html))


NODES = "at int, last int, depth int, tag string, text string"


def nodes(pages: DataFrame, id_: str, html: str) -> DataFrame:
    """One row a node of each well-formed page: id, ``at`` (its number, from 0), ``last``
    (the last number inside it), ``depth``, ``tag`` and its own ``text``, collapsed. A
    page without nodes gives no row; a null id stays null, repeated pages give their rows
    as often."""
    kind = pages.schema[id_].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id_", "at", "last", "depth", "tag", "text"]
        types_ = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        for batch in batches:
            for i, page in enumerate(batch.column(1)):  # a page's nodes at a time
                pieces, found = intervals(page.as_py()) or ([], [])
                if found:
                    rows = [(at, last, depth, tag, collapsed("".join(pieces[a:b]))) for at, last, depth, tag, a, b in found]
                    own = batch.column(0).take(pa.array([i] * len(rows)))
                    yield pa.RecordBatch.from_arrays([own, *[pa.array(c, t) for c, t in zip(zip(*rows), types_)]], names)

    out = pages.select(F.col(id_).alias("id_"), F.col(html).alias("html_")).mapInArrow(run, f"id_ {kind}, {NODES}")
    return out.withColumnRenamed("id_", id_)


def inside(outer: str, inner: str, id_: str) -> Column:
    """Join condition: the inner node lies inside the outer one of the same page."""
    a, b = (lambda c: F.col(f"{outer}.{c}")), (lambda c: F.col(f"{inner}.{c}"))
    return a(id_).eqNullSafe(b(id_)) & (b("at") > a("at")) & (b("at") <= a("last"))
