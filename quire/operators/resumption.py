"""Saved runs: verified before any work, restored once their prompt is known, and
upgraded from the older layout.

Every table has a column ``run`` and any number of runs. A run's identity is a set of
named fields; its records are saved segments. Refusals are values, not exceptions: one
row a run, with the reason or null, so that one broken run stops no other.

* ``verify`` checks all that can be known before work: hard fields, which always
  refuse, the content of the records, and, unless the run is forced, a change of a model
  on trial and the soft fields other than those that are not settled yet.
* ``restore`` settles those too and releases the records of the runs that pass both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import spread

#: Identity fields that always refuse, the one that is settled last, and
#: what a record may name.
HARD = ("input_signature", "input_format", "segmenter_signature")
DEFERRED = ("system_prompt_hash",)
PROFILES = ("flash", "pro")
#: Models, providers and segmenters of the older layout in today's terms.
OLD_PROFILES = {"gemini-2.5-flash": "flash", "gemini-2.5-pro": "pro"}
OLD_BACKENDS = {"cli": "gemini_cli", "api": "gemini_api"}
OLD_PROTOCOLS = {"epub-leaf-block-v3": "segment_tags"}
UNKNOWN = "legacy_unknown"


def differences(saved: DataFrame, expected: DataFrame, fields: list[str], hard: tuple[str, ...] = HARD) -> DataFrame:
    """``run, fields`` (those that differ, in order) ``, hard`` (whether a hard one does) of
    each run that has saved state. A field of null equals null only."""
    a, b = saved.alias("a"), expected.alias("b")
    both = a.join(spread(b), F.col("a.run") == F.col("b.run"))
    differ = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in fields]))
    own = F.array(*[F.lit(c) for c in fields if c in hard]).cast("array<string>")
    return both.select("b.run", differ.alias("fields")).withColumn("hard", F.size(F.array_intersect("fields", own)) > 0)


def content_problems(saved: DataFrame, records: DataFrame, segments: DataFrame, providers: list[str], backends: list[str]) -> DataFrame:
    """``run, problem`` of each run whose records can't be used: the first defect in order
    of ``ord`` (a segment that the book does not have, a blank translation, an unknown
    origin), else a number of records other than ``claimed``."""
    known = segments.select("run", "segment_id").distinct().withColumn("there_", F.lit(True))
    origin = F.col("profile").isin(*PROFILES) & F.col("provider").isin(*providers) & F.col("backend").isin(*backends)
    defect = F.when(F.col("there_").isNull(), "unknown segment").when(~F.coalesce(F.col("translated").rlike(r"(?U)\S"), F.lit(False)), "empty translation").when(~F.coalesce(origin, F.lit(False)), "invalid origin")
    told = records.join(spread(known), ["run", "segment_id"], "left").withColumn("defect_", defect)
    first = told.groupBy("run").agg(F.min_by("defect_", F.when(F.col("defect_").isNotNull(), F.col("ord"))).alias("first_"), F.count("*").alias("n_"))
    out = saved.select("run", "claimed").join(spread(first), "run", "left")
    wrong = F.when(~F.col("claimed").eqNullSafe(F.coalesce("n_", F.lit(0))), "wrong number of records")
    return out.select("run", F.coalesce("first_", wrong).alias("problem")).filter("problem is not null")


def mixed_models(expected: DataFrame, records: DataFrame, enabled: Column, trial: Column) -> DataFrame:
    """``run, others``: runs that would go on with another model than their records have,
    where one of them is on trial. others: the enabled models of the records."""
    used = records.groupBy("run").agg(F.collect_set("model").alias("used"))
    rows = expected.select("run", "model").join(spread(used), "run")
    rows = rows.withColumn("others", F.array_sort(F.array_intersect(F.array_except("used", F.array("model")), enabled)))
    risky = F.array_contains(trial, F.col("model")) | (F.size(F.array_intersect("others", trial)) > 0)
    return rows.filter((F.size("others") > 0) & risky).select("run", "others")


def told(kind: str, names: Column) -> Column:
    return F.concat(F.lit(f"{kind}: "), F.array_join(names, ", "))


def verify(saved: DataFrame, expected: DataFrame, records: DataFrame, segments: DataFrame, fields: list[str], providers: list[str], backends: list[str], enabled: Column, trial: Column, deferred: tuple[str, ...] = DEFERRED) -> DataFrame:
    """``run, may_reuse, refused`` of each run of expected (run, the identity fields, model,
    force). A run without saved state has nothing to reuse and is not refused."""
    all_ = differences(saved, expected, fields)
    all_ = all_.withColumn("soft", F.array_except("fields", F.array(*map(F.lit, deferred)).cast("array<string>")))
    rows = expected.select("run", F.coalesce("force", F.lit(False)).alias("force"))
    rows = rows.join(spread(all_), "run", "left").join(spread(content_problems(saved, records, segments, providers, backends)), "run", "left")
    rows = rows.join(spread(mixed_models(expected, records, enabled, trial)), "run", "left")
    refused = (
        F.when(F.col("hard"), told("mismatch", F.col("fields")))
        .when(F.col("problem").isNotNull(), F.col("problem"))
        .when(~F.col("force") & F.col("others").isNotNull(), told("model on trial, with", F.col("others")))
        .when(~F.col("force") & (F.size("soft") > 0), told("mismatch", F.col("soft")))
    )
    return rows.select("run", F.col("fields").isNotNull().alias("may_reuse"), refused.alias("refused"))


def restore(verified: DataFrame, saved: DataFrame, settled: DataFrame, records: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """``run, refused`` of each verified run under its settled identity (as expected,
    deferred fields filled in), and the records of those that pass."""
    now = differences(saved, settled, fields).join(spread(settled.select("run", F.coalesce("force", F.lit(False)).alias("force"))), "run")
    rows = verified.join(spread(now.drop("hard")), "run", "left")
    late = F.when(~F.col("force") & (F.size("fields") > 0), told("mismatch", F.col("fields")))
    out = rows.select("run", F.coalesce("refused", late).alias("refused"))
    passed = rows.filter(F.coalesce("refused", late).isNull() & F.col("may_reuse")).select("run")
    return out, records.join(spread(passed), "run", "left_semi")


def upgrade(old: DataFrame, translations: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """State of the older layout in today's: identities with ``refused``, and records.

    old: run, schema_version, input_signature, input_format, segmenter_signature,
    output_lang, system_prompt_hash, max_batch_chars, separator_overhead, model, provider,
    claimed. translations: run, segment_id, translated. current: run, input_signature,
    legacy_signature (of the file as it was told apart then), profile, force.

    An old state names no content, so it is taken over only when it is forced and the
    file's old signature is the same; from then on it is bound to the content of today.
    A run that is refused has no records."""
    n = translations.groupBy("run").agg(F.count("*").alias("n_"), F.count("translated").alias("told_"))
    now = current.select("run", F.col("input_signature").alias("signature_"), "legacy_signature", F.col("profile").alias("profile_"), F.coalesce("force", F.lit(False)).alias("force_"))
    rows = old.join(spread(now), "run").join(spread(n), "run", "left").na.fill(0, ["n_", "told_"])
    look = lambda table, c: F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), c)
    known = look(OLD_PROFILES, F.col("model"))
    texts = ["input_signature", "input_format", "segmenter_signature", "output_lang", "system_prompt_hash", "model", "provider"]
    lacking = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(c)) for c in [*texts, "max_batch_chars", "separator_overhead"]]))
    refused = (
        F.when(~F.col("schema_version").eqNullSafe(F.lit(1)), "unsupported layout")
        .when(F.size(lacking) > 0, told("missing", lacking))
        .when(known.isNull() & ~F.col("force_"), "unknown model")
        .when(~F.col("input_signature").eqNullSafe(F.col("legacy_signature")), "another file")
        .when(~F.col("force_"), "unverified source, not forced")
        .when(F.col("told_") < F.col("n_"), "invalid translation")
        .when(~F.col("claimed").eqNullSafe(F.col("n_")), "wrong number of records")
    )
    kept = [c for c in old.columns if c not in ("input_signature", "schema_version", "model", "provider")]
    fresh = {
        "input_signature": F.col("signature_"),
        "profile": F.coalesce(known, F.col("profile_")),
        "effort": F.lit(None).cast("string"),
        "protocol": F.coalesce(look(OLD_PROTOCOLS, F.col("segmenter_signature")), F.lit(UNKNOWN)),
    }
    whole = rows.withColumn("refused", refused)
    identities = whole.select(*kept, *[F.when(F.col("refused").isNull(), v).alias(k) for k, v in fresh.items()], "refused")
    origin = whole.filter("refused is null").select("run", "model", "provider", fresh["profile"].alias("profile"), F.coalesce(look(OLD_BACKENDS, F.col("provider")), F.lit(UNKNOWN)).alias("backend"))
    records = translations.join(spread(origin), "run").withColumn("source_verification", F.lit("legacy_metadata_only"))
    return identities, records
