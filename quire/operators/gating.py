"""From attempts at a page to its checkpoint, as reductions over an attempt table.

An attempt has job_id, page_number, attempt, dpi, reference_kind, markdown, coverage, verdict, misses, floor_score, prompt_tokens, completion_tokens,
ms and envelope_error (null if the response was well-formed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as X

_KEYS = ["job_id", "page_number"]


def passes(threshold: int = 95, floor: float = X.FLOOR) -> Column:
    return F.col("envelope_error").isNull() & X.page_gate(F.col("verdict"), F.col("coverage"), F.col("floor_score"), threshold, floor)


def retry_note(floor: float = X.FLOOR) -> Column:
    """What the next attempt is told: the defect, else the floor failure, else the judge's misses."""
    failure = X.floor_failure(F.col("floor_score"), floor)
    return (
        F.when(F.col("envelope_error").isNotNull(), F.concat(F.lit("\n\nThe previous attempt was malformed ("), "envelope_error", F.lit("); send it again with care.")))
        .when(failure.isNotNull(), F.concat(F.lit("\n\nThe coverage floor FAILED ("), failure, F.lit("). Transcribe the COMPLETE page again, word for word; leave out and paraphrase nothing.")))
        .otherwise(F.concat(F.lit("\n\nMisses to fix: "), F.to_json(F.coalesce("misses", F.array().cast("array<string>")))))
    )


def reduced(attempts: DataFrame, threshold: int = 95, floor: float = X.FLOOR, reference_compatible: bool = True) -> DataFrame:
    """One checkpoint a page: the first attempt that passes, else needs_review.

    With ``reference_compatible`` a page that never passes keeps its last attempt, and nothing if that was malformed; else the well-formed attempt of the best coverage.
    Tokens and milliseconds add up over the attempts until the page passed.
    """
    own = attempts.withColumn("_ok", passes(threshold, floor))
    first = F.min(F.when(F.col("_ok"), F.col("attempt"))).alias("_first")
    own = own.join(own.groupBy(*_KEYS).agg(first), _KEYS).where("_first is null or attempt <= _first")
    well = F.col("envelope_error").isNull()
    best = F.col("attempt") if reference_compatible else F.when(well, F.struct(F.coalesce("coverage", F.lit(0)), "attempt")).otherwise(F.struct(F.lit(-1), F.col("attempt")))
    held = set(attempts.columns)
    text = lambda c: F.col(c) if c in held else F.lit(None).cast("string").alias(c)
    fields = F.struct("attempt", "dpi", "reference_kind", "markdown", "coverage", "floor_score", "envelope_error", text("figures"), text("reference"))
    timed = [c for c in ("transcribe_ms", "verify_ms") if c in held]
    out = own.groupBy(*_KEYS).agg(
        F.max_by(fields, best).alias("r"),
        F.max("_ok").alias("ok"),
        F.max("attempt").alias("retries"),
        *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("prompt_tokens", "completion_tokens", "ms", *timed)],
    )
    failed = X.floor_failure(F.col("r.floor_score"), floor).isNotNull()
    note = F.when(~F.col("ok"), F.when(failed, "coverage floor failed: judge score alone is insufficient").otherwise("verification cap reached"))
    sound = F.col("r.envelope_error").isNull()
    return out.select(
        *_KEYS,
        F.when(F.col("ok"), "verified").otherwise("needs_review").alias("status"),
        F.col("r.dpi").alias("render_dpi"),
        "r.reference_kind",
        F.when(sound, F.col("r.markdown")).otherwise("").alias("markdown"),
        F.when(sound, F.coalesce("r.coverage", F.lit(0))).otherwise(0).alias("coverage_score"),
        "retries",
        (~F.col("ok")).alias("needs_review"),
        F.col("r.floor_score").alias("floor_score"),
        note.alias("notes"),
        F.when(sound, F.col("r.figures")).alias("figures"),
        F.struct(F.col("prompt_tokens").alias("prompt"), F.col("completion_tokens").alias("completion")).alias("token_usage"),
        "ms",
        *timed,
        F.sha2("r.reference", 256).alias("reference_hash"),
        F.when(sound, F.sha2("r.markdown", 256)).alias("markdown_hash"),
    )


def retry_delay(status: Column, kind: Column, retry_after: Column, attempt: Column, base: float = 1.0, cap: float = 120.0) -> Column:
    """Seconds to wait before the next attempt, null if the failure isn't retried. ``kind`` is timeout, connect, protocol, status or other."""
    backoff = F.lit(base) * F.pow(F.lit(2.0), attempt - 1)
    by_status = F.when(status == 429, F.coalesce(F.least(retry_after.try_cast("double"), F.lit(cap)), backoff)).when(status >= 500, backoff)
    return F.when(kind == "status", by_status).when(kind.isin("timeout", "connect", "protocol"), backoff)
