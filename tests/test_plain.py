"""Queries without SQL, over whole tables, against plain forms that share no code with
the operators but their fixed values."""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

from quire import catalog
from quire.operators import terms

SF = "/root/testdata/sf0.001"
TITLE = re.compile(r"[A-Z][a-z]+")
CHAIN = re.compile(r"\b[A-Z][a-z]+(?:\s+(?:" + "|".join(terms.CONNECTORS) + r")\s+[A-Z][a-z]+)+\b")


def plain_phrases(text: str) -> set[str]:
    """A text's words as a string of kinds, in which terms are matches of one pattern: N a
    title-case word that is no stopword, C a connector, - any other."""
    words = [w.strip(terms.EDGES) for w in text.split()]
    kinds = "".join("N" if TITLE.fullmatch(w) and w.lower() not in terms.STOPWORDS else "C" if w in terms.CONNECTORS else "-" for w in words)
    found = {" ".join(words[i : i + len(m[1])]) for i in range(len(words)) if (m := re.match(r"(N(?:N|C(?=N)){0,6})", kinds[i:]))}
    usable = lambda t: len(t) > 1 and not all(w in terms.STOPWORDS for w in t.lower().split())
    return found | {m for m in CHAIN.findall(text) if usable(m) and m.lower() not in terms.STOPWORDS}


def test_candidates_of_all_documents(spark):
    docs = sorted((r.source, r.doc_id, r.text or "") for r in catalog.table(spark, SF, "documents").collect())
    books = defaultdict(list)
    for source, _, text in docs:
        books[source].append(text)
    held, weight, labels = defaultdict(int), defaultdict(float), defaultdict(set)
    for texts in books.values():
        edge = max(1, len(texts) // 10)
        for i, text in enumerate(texts):
            label, w = ("front", 1.5) if i < edge else ("back", 1.2) if i >= len(texts) - edge else ("body", 1.0)
            for t in plain_phrases(text):
                held[t] += 1
                weight[t] += w
                labels[t].add(label)
    best = sorted(held, key=lambda t: (-round(weight[t], 6), t))[:300]
    got = catalog.local_candidates_full(spark, SF).collect()
    assert len(got) == len(best) == 300
    assert {(r.term, r.frequency, round(r.weighted_score, 6), r.sources, r.kind) for r in got if round(r.weighted_score, 6) > round(weight[best[-1]], 6)} == {
        (t, held[t], round(weight[t], 6), ",".join(sorted(labels[t])), "technical" if " " in t else "entity") for t in best if round(weight[t], 6) > round(weight[best[-1]], 6)
    }


def plain_blocks(html: str) -> list[str]:
    """Text between block tags, for pages in which no block holds another."""
    body = re.sub(r"(?s)<!--.*?-->|<(script|style)\b.*?</\1>", "", html.partition("<body")[2].partition(">")[2])
    found, now = [], None
    for close, tag, text in re.findall(r"<(/?)([a-zA-Z0-9]+)[^>]*>|([^<]+)", body + "<p>"):
        if tag.lower() in ("p", "li", "div", "h1", "ul", "nav", "article", "footer", "html", "body"):
            if now is not None:
                found.append("\n".join(" ".join(line.split()) for line in now.split("\n")).strip("\n"))
            now = "" if not close and tag.lower() in ("p", "li", "div") else None
        elif now is not None:
            now = now + "\n" if tag.lower() == "br" else (now + (unescape(text).lstrip() if now.endswith("\n") else unescape(text)) if text else now)
    return [x for x in found if x]


def test_blocks_of_all_pages(spark):
    pages = catalog.table(spark, SF, "pages").collect()
    got = defaultdict(list)
    for r in catalog.block_segments(spark, SF).orderBy("page_id", "idx").collect():
        assert r.idx == len(got[r.page_id])
        got[r.page_id].append(r.text)
    assert len(pages) == 50 and all(got[p.page_id] == plain_blocks(p.html) for p in pages)
