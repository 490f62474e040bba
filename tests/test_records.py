from __future__ import annotations

import hashlib
import os

from pyspark.sql import functions as F

from quire import tables
from quire.operators import replies as S
from quire.sources import files
from quire.streaming import progress, resume


def test_changed_files_are_read_again(spark, tmp_path):
    for name, text in (("page2.md", "two\nlines"), ("page10.md", "ten"), ("other.txt", "x"), ("page é.md", "")):
        (tmp_path / name).write_text(text)
    folder = f"file://{tmp_path}"
    first = spark.createDataFrame(files.listed(spark, folder, "page*.md").collect(), "path string, name string, size long, modified timestamp, signature string")
    assert {(r.name, r.size) for r in first.collect()} == {("page2.md", 9), ("page10.md", 3)}  # Spark lists no empty file
    assert files.changed(files.listed(spark, folder, "page*.md"), first).count() == 0
    (tmp_path / "page10.md").write_text("eleven")
    (tmp_path / "page3.md").write_text("new")
    os.utime(tmp_path / "page2.md", (1, 1))
    now = files.changed(files.listed(spark, folder, "page*.md"), first)
    got = {r.path.rsplit("/", 1)[1]: (bytes(r.content), r.digest) for r in files.contents(spark, now).collect()}
    want = {"page10.md": b"eleven", "page3.md": b"new", "page2.md": b"two\nlines"}
    assert got == {k: (v, "sha256:" + hashlib.sha256(v).hexdigest()) for k, v in want.items()}
    assert files.contents(spark, now.limit(0)).count() == 0
    (tmp_path / "page é.md").write_text("last")
    assert [(r.ord, r.name, r.text) for r in files.texts(spark, folder, "page*.md").orderBy("ord").collect()] == [(1, "page é.md", "last"), (2, "page10.md", "eleven"), (3, "page2.md", "two\nlines"), (4, "page3.md", "new")]


def test_progress_lines(spark, tmp_path):
    assert progress.line("x", a=1, b=None, c="two words", d="", e='q"', f="k=v", g="é/x:1") == '[progress:x] a=1 c="two words" d="" e="q\\"" f="k=v" g=é/x:1'
    said: list[str] = []
    listener = progress.ProgressLines(said.append)
    spark.streams.addListener(listener)
    try:
        schema = "id int, text string"
        spark.createDataFrame([(i, "t") for i in range(5)], schema).write.parquet(f"{tmp_path}/in")
        q = resume.resume_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/state", f"{tmp_path}/cp", "id", lambda rows: rows.withColumn("translated", F.col("text")))
        q.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(listener)
    assert said[0].startswith("[progress:started] query=") and said[-1].startswith("[progress:ended] query=") and "error" not in said[-1]
    assert [x.split()[2:4] for x in said if x.startswith("[progress:batch]")] == [["batch=0", "rows=5"]]


def test_saved_replies(spark, tmp_path):
    path = f"file://{tmp_path}/replies"
    assert S.saved(spark, path).count() == 0
    frame = lambda *rows: spark.createDataFrame(rows, "digest string, reply string, error string")
    S.save(frame(("a", "1", None), ("a", "1", None), ("b", "bad", "no JSON"), (None, "x", None)), path)
    S.save(frame(("a", "later", None), ("b", "2", None)), path)
    assert {(r.digest, r.reply) for r in S.saved(spark, path).collect()} == {("a", "1"), ("b", "2")}
    assert spark.read.parquet(path).count() == 2
    # another run wrote the same digest at the same time
    frame(("a", "0", None)).select("digest", "reply", F.current_timestamp().alias("saved_at")).write.mode("append").parquet(path)
    assert {(r.digest, r.reply) for r in S.saved(spark, path).collect()} == {("a", "1"), ("b", "2")}
    asked = spark.createDataFrame([("vote", "a"), ("vote", "c"), ("vote", "c"), ("name", "d"), ("name", None)], "purpose string, digest string")
    assert {tuple(r) for r in S.calls(asked, S.saved(spark, path)).collect()} == {("vote", 1, 1), ("name", 1, 0)}


def test_runs_end_once(spark):
    records = spark.createDataFrame([("a", 0, 5), ("b", None, None), ("c", None, None), ("d", None, None)], "run string, exit_code int, ended_at int")
    ends = spark.createDataFrame([("a", 1, 9), ("b", 2, 7), ("b", 3, 6), ("c", None, 4)], "run string, exit_code int, at int")
    assert {tuple(r) for r in S.finished(records, ends).select("run", "exit_code", "ended_at").collect()} == {("a", 0, 5), ("b", 3, 6), ("c", None, 4), ("d", None, None)}
    certificates = spark.createDataFrame([("m", "1")], "model string, version string")
    probes = spark.createDataFrame([("m", "1", []), ("m", "2", []), ("m", "2", ["empty"]), ("n", "1", [])], "model string, version string, problems array<string>")
    assert [tuple(r) for r in S.certified_anew(certificates, probes, "model", "version").collect()] == [("n", "1")]


def test_kept_tables_are_released(spark):
    df = tables.keep(spark.range(5))
    path = tables._kept[-1]
    assert df.count() == 5 and tables.exists(spark, path)
    before, tables._kept[:] = tables._kept[:-1], [path]
    tables.release()
    tables._kept[:] = before
    assert not tables.exists(spark, path)
