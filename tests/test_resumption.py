from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quire import catalog, reply_catalog  # noqa: F401 (the second adds its queries to the first)
from quire.operators import resumption as R

FIELDS = ["input_signature", "output_lang", "system_prompt_hash"]
IDENTITY = "run string, input_signature string, output_lang string, system_prompt_hash string"
RECORD = "run string, ord int, segment_id string, translated string, profile string, provider string, backend string, model string"


def names(*x):
    return F.array(*map(F.lit, x)).cast("array<string>")


def tables(spark, stored=("sig", "zh", "p"), now=("sig", "zh", "p"), force=False, model="m", rows=(("s1", "t", "cli", "m"),), claimed=None, saved=True):
    expected = spark.createDataFrame([("r", *now, model, force)], IDENTITY + ", model string, force boolean")
    old = spark.createDataFrame([("r", *stored, len(rows) if claimed is None else claimed)] * saved, IDENTITY + ", claimed long")
    records = spark.createDataFrame([("r", i, s, t, "pro", p, "codex", m) for i, (s, t, p, m) in enumerate(rows)], RECORD)
    segments = spark.createDataFrame([("r", "s1"), ("r", "s2")], "run string, segment_id string")
    return expected, old, records, segments


def outcome(spark, settled="p", **how):
    expected, saved, records, segments = tables(spark, **how)
    told = R.verify(saved, expected, records, segments, FIELDS, ["cli"], ["codex"], names("m", "n", "trial"), names("trial"))
    late, released = R.restore(told, saved, expected.withColumn("system_prompt_hash", F.lit(settled)), records, FIELDS)
    first = told.first()
    return first.may_reuse, first.refused, late.first().refused, released.count()


@pytest.mark.parametrize(
    ("how", "want"),
    [
        ({}, (True, None, None, 1)),
        ({"saved": False}, (False, None, None, 0)),
        # a hard field refuses even when forced, and names all that differs
        ({"now": ("other", "fr", "p"), "force": True}, (True, "mismatch: input_signature, output_lang", "mismatch: input_signature, output_lang", 0)),
        ({"now": ("sig", "fr", "p")}, (True, "mismatch: output_lang", "mismatch: output_lang", 0)),
        ({"now": ("sig", "fr", "p"), "force": True}, (True, None, None, 1)),
        # the prompt is looked at only once it is known
        ({"stored": ("sig", "zh", "old")}, (True, None, "mismatch: system_prompt_hash", 0)),
        ({"stored": ("sig", "zh", "old"), "force": True}, (True, None, None, 1)),
        ({"stored": ("sig", None, "p"), "now": ("sig", None, "p")}, (True, None, None, 1)),
        ({"rows": (("s1", "t", "cli", "m"), ("gone", "t", "cli", "m"))}, (True, "unknown segment", "unknown segment", 0)),
        ({"rows": (("s1", "  ", "cli", "m"), ("gone", "t", "cli", "m")), "force": True}, (True, "empty translation", "empty translation", 0)),
        ({"rows": (("s1", "t", None, "m"),)}, (True, "invalid origin", "invalid origin", 0)),
        ({"claimed": 3}, (True, "wrong number of records", "wrong number of records", 0)),
        ({"rows": (), "claimed": 0}, (True, None, None, 0)),
        # another model is no hindrance unless one of them is on trial
        ({"model": "n"}, (True, None, None, 1)),
        ({"model": "trial"}, (True, "model on trial, with: m", "model on trial, with: m", 0)),
        ({"model": "n", "rows": (("s1", "t", "cli", "trial"), ("s2", "t", "cli", "m"))}, (True, "model on trial, with: m, trial", "model on trial, with: m, trial", 0)),
        ({"model": "trial", "force": True}, (True, None, None, 1)),
        ({"model": "trial", "rows": (("s1", "t", "cli", "unlisted"),)}, (True, None, None, 1)),
    ],
)
def test_verify_and_restore(spark, how, want):
    assert outcome(spark, **how) == want


def test_upgrade(spark):
    base = {"run": "r", "schema_version": 1, "input_signature": "s", "input_format": "epub", "segmenter_signature": "epub-leaf-block-v3", "output_lang": "zh", "system_prompt_hash": "h", "max_batch_chars": 10, "separator_overhead": 6, "model": "gemini-2.5-pro", "provider": "api", "claimed": 2}
    schema = ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in base.items())
    texts = spark.createDataFrame([("r", "1", "x"), ("r", "2", "y")], "run string, segment_id string, translated string")
    now = lambda sig="s", force=True: spark.createDataFrame([("r", "sha", sig, "flash", force)], "run string, input_signature string, legacy_signature string, profile string, force boolean")
    old = lambda **x: spark.createDataFrame([tuple({**base, **x}.values())], schema)

    identities, records = R.upgrade(old(), texts, now())
    row = identities.first()
    assert (row.refused, row.input_signature, row.profile, row.effort, row.protocol) == (None, "sha", "pro", None, "segment_tags")
    assert {(r.segment_id, r.backend, r.source_verification) for r in records.collect()} == {("1", "gemini_api", "legacy_metadata_only"), ("2", "gemini_api", "legacy_metadata_only")}
    for change, current, why in (({"schema_version": 2}, now(), "unsupported layout"), ({"output_lang": None}, now(), "missing: output_lang"), ({"model": "x"}, now(force=False), "unknown model"), ({}, now("t"), "another file"), ({}, now(None), "another file"), ({}, now(force=False), "unverified source, not forced"), ({"claimed": 1}, now(), "wrong number of records")):
        identities, records = R.upgrade(old(**change), texts, current)
        assert identities.first().refused == why and records.count() == 0
    row = R.upgrade(old(model="x", segmenter_signature="v1", provider="web"), texts, now())
    assert (row[0].first().profile, row[0].first().protocol, row[1].first().backend) == ("flash", "legacy_unknown", "legacy_unknown")


@pytest.mark.parametrize("name", ["verify_runs", "restore_runs", "upgraded_runs"])
def test_runs_are_dealt_out_and_never_sent_whole(spark, name):
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan
