"""Progress of streaming queries as quoted log lines."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener


def value(x: object) -> str:
    """A value as it stands, or as a JSON string where it is empty or holds white space, a
    quote or an equals sign."""
    text = str(x)
    return json.dumps(text, ensure_ascii=False) if not text or re.search(r'[\s="]', text) else text


def line(event: str, **fields: object) -> str:
    """``[progress:event] name=value ...``; fields of None are left out."""
    return " ".join([f"[progress:{event}]", *(f"{k}={value(v)}" for k, v in fields.items() if v is not None)])


class ProgressLines(StreamingQueryListener):
    """A line for each start, micro-batch with rows, and end of the session's queries.
    write: where lines go; it is called on the driver."""

    def __init__(self, write: Callable[[str], None] = print):
        self.write = write

    def onQueryStarted(self, event):
        self.write(line("started", query=event.name or event.id))

    def onQueryProgress(self, event):
        p = event.progress
        if p.numInputRows:
            self.write(line("batch", query=p.name or p.id, batch=p.batchId, rows=p.numInputRows, seconds=round(p.batchDuration / 1000, 3)))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.write(line("ended", query=event.id, error=event.exception and event.exception.splitlines()[0]))
