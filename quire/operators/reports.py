"""Aggregates and lines of conversion reports.

The report is built as rows (job_id, part, ord, line) by unions of projections, so that the reports of many jobs are made at once; ``rendered`` puts a job's lines
together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import percent
from quire.operators.store import FINAL_PAGES


def token_totals(pages: DataFrame, keys: list[str]) -> DataFrame:
    return pages.groupBy(*keys).agg(F.sum(F.coalesce("token_usage.prompt", F.lit(0))).alias("prompt"), F.sum(F.coalesce("token_usage.completion", F.lit(0))).alias("completion"))


def conversion_summary(images: DataFrame, keys: list[str]) -> DataFrame:
    """Figures by representation, and the whole percentage that became diagrams; an unknown status counts as image."""
    status = F.coalesce("conversion_status", F.lit("image"))
    mermaid, table = F.count_if(status == "mermaid"), F.count_if(status == "table")
    out = images.groupBy(*keys).agg(F.count("*").alias("figures"), mermaid.alias("mermaid"), table.alias("tables"))
    return out.withColumn("images", F.col("figures") - F.col("mermaid") - F.col("tables")).withColumn("rate", F.bround(F.col("mermaid").cast("double") / F.col("figures") * 100.0, 0).cast("long"))


def progress(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Pages done, all pages, and the percentage as shown, half up."""
    out = pages.groupBy(*keys).agg(F.count_if(F.col("status").isin(*FINAL_PAGES)).alias("done"), F.count("*").alias("total"))
    return out.withColumn("pct", F.round(F.col("done") * 100.0 / F.col("total")).cast("long"))


def needs_review(pages: DataFrame, keys: list[str]) -> DataFrame:
    """The page numbers to review, in order."""
    return pages.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col("needs_review"), F.col("page_number")))).alias("pages"))


def wall_clock(started: Column, finished: Column) -> Column:
    """Elapsed time as text."""
    seconds = (F.unix_micros(F.coalesce(finished, F.current_timestamp())) - F.unix_micros(started)) / 1e6
    return F.when(started.isNull(), "not started").otherwise(F.format_string("%.1fs", F.bround(seconds, 1)))


def health(probes: DataFrame, keys: list[str]) -> DataFrame:
    return probes.groupBy(*keys).agg(F.when(F.bool_and("ok"), "ok").otherwise("degraded").alias("status"))


def _shown(value: Column | str) -> Column:
    """A value as the report shows it: None for null."""
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(value.cast("string"), F.lit("None"))


def _held(frame: DataFrame, column: str) -> Column:
    """A column that the frame may lack."""
    return F.col(column) if column in frame.columns else F.lit(None).cast("string")


def report_lines(jobs: DataFrame, pages: DataFrame, images: DataFrame, furniture: DataFrame, orphans: DataFrame, warnings: DataFrame) -> DataFrame:
    """(job_id, part, ord, line) of every job's report. ``pages`` is the current view; furniture (job_id, text, pages), orphans (job_id, page, index, alt, reason), warnings (job_id, warning)."""
    ids = jobs.select("job_id")

    def fixed(part: int, *lines: str) -> DataFrame:
        return ids.select("job_id", F.lit(part).alias("part"), F.posexplode(F.array(*map(F.lit, lines))).alias("ord", "line"))

    def rows(frame: DataFrame, part: int, order: list[Column], line: Column, none: str | None = "none") -> DataFrame:
        own = frame.select("job_id", F.lit(part).alias("part"), F.row_number().over(Window.partitionBy("job_id").orderBy(*order)).alias("ord"), line.alias("line"))
        absent = ids.join(frame.select("job_id").distinct(), "job_id", "left_anti").select("job_id", F.lit(part).alias("part"), F.lit(0).alias("ord"), F.lit(none).alias("line"))
        return own.union(absent) if none is not None else own

    totals = token_totals(pages, ["job_id"])
    n_warn = warnings.groupBy("job_id").agg(F.count("*").alias("n_warn"))
    head = jobs.join(totals, "job_id", "left").join(n_warn, "job_id", "left")
    texts = [
        F.concat(F.lit("# Conversion report — "), "filename"),
        F.lit(""),
        F.concat(F.lit("- job_id: "), "job_id"),
        F.concat(F.lit("- status: "), "status"),
        F.concat(F.lit("- pages: "), "page_count"),
        F.concat(F.lit("- wall-clock: "), wall_clock(F.col("started_at"), F.col("finished_at"))),
        F.concat(F.lit("- tokens: prompt="), F.coalesce("prompt", F.lit(0)), F.lit(" completion="), F.coalesce("completion", F.lit(0))),
        F.concat(F.lit("- pipeline_version: "), _shown("pipeline_version")),
        F.concat(F.lit("- prompts: "), _shown(_held(jobs, "prompts"))),
        F.concat(F.lit("- models: agent="), _shown(_held(jobs, "agent_model")), F.lit(" ocr="), _shown(_held(jobs, "ocr_model"))),
        F.concat(F.lit("- dpi: "), _shown(_held(jobs, "render_dpi"))),
        F.concat(F.lit("- lint warnings: "), F.coalesce("n_warn", F.lit(0))),
    ]
    parts = [head.select("job_id", F.lit(0).alias("part"), F.posexplode(F.array(*texts)).alias("ord", "line"))]
    table = "| page | status | coverage | retries | dpi | prompt_tok | completion_tok | needs_review |"
    parts.append(fixed(1, "", "## Per-page coverage", "", table, "| --- | --- | --- | --- | --- | --- | --- | --- |"))
    used = lambda c: F.coalesce(F.col(f"token_usage.{c}"), F.lit(0)).cast("string")
    flag = F.when(F.col("needs_review"), "True").otherwise("False")
    cells = F.concat_ws(" | ", F.col("page_number").cast("string"), "status", _shown("coverage_score"), _shown("retries"), _shown("render_dpi"), used("prompt"), used("completion"), flag)
    by_page = [F.col("page_number")]
    parts.append(rows(pages, 2, by_page, F.concat(F.lit("| "), cells, F.lit(" |")), None))
    parts.append(fixed(3, "", "## needs_review pages", ""))
    review = needs_review(pages, ["job_id"]).where(F.size("pages") > 0)
    parts.append(rows(review, 4, [F.lit(0)], F.concat(F.lit("["), F.array_join("pages", ", "), F.lit("]"))))
    parts.append(fixed(5, "", "## Diagram → Mermaid conversion", ""))
    counted = conversion_summary(images, ["job_id"])
    summary = F.array(
        F.concat(F.lit("- figures: "), "figures"),
        F.concat(F.lit("- converted to Mermaid: "), "mermaid", F.lit(" ("), "rate", F.lit("%)")),
        F.concat(F.lit("- data-table fallbacks: "), "tables"),
        F.concat(F.lit("- image fallbacks: "), "images"),
        F.lit(""),
        F.lit("| page | index | type | status | confidence |"),
        F.lit("| --- | --- | --- | --- | --- |"),
    )
    parts.append(counted.select("job_id", F.lit(6).alias("part"), F.posexplode(summary).alias("ord", "line")))
    figure = F.concat_ws(" | ", F.col("page_number").cast("string"), F.col("image_id").cast("string"), F.coalesce("diagram_type", F.lit("")), F.coalesce("conversion_status", F.lit("image")), F.coalesce(F.col("confidence").cast("string"), F.lit("")))
    parts.append(rows(images, 7, [F.col("page_number"), F.coalesce("image_id", F.lit(0))], F.concat(F.lit("| "), figure, F.lit(" |"))))
    parts.append(fixed(8, "", "## Omissions log", ""))
    parts.append(rows(pages.where("notes <> ''"), 9, by_page, F.concat(F.lit("- page "), "page_number", F.lit(": "), "notes")))
    parts.append(fixed(10, "", "## Running furniture stripped", ""))
    parts.append(rows(furniture, 11, [F.col("text")], F.concat(F.lit("- '"), "text", F.lit("' (on "), "pages", F.lit(" pages)"))))
    parts.append(fixed(12, "", "## Per-page telemetry (FR-AGT-10)", ""))
    floor = F.coalesce(percent(F.col("floor_score")), F.lit("n/a"))
    floor = F.when(F.col("floor_score").isNull(), "n/a").otherwise(floor)
    own = lambda c: _shown(_held(pages, c))
    took = lambda c: _shown(F.bround(_held(pages, c).cast("double"), 1))
    hashes = F.concat_ws("/", *map(own, ("source_page_hash", "render_hash", "reference_hash", "markdown_hash")))
    telemetry = F.concat(
        F.concat(F.lit("- page "), "page_number", F.lit(": dpi="), _shown("render_dpi"), F.lit(" image="), own("image_width"), F.lit("x"), own("image_height"), F.lit(" "), own("image_bytes"), F.lit("B")),
        F.concat(F.lit(" model="), own("model"), F.lit(" effort="), own("effort"), F.lit(" transcribe_ms="), took("transcribe_ms"), F.lit(" verify_ms="), took("verify_ms"), F.lit(" ocr_ms="), took("ocr_ms")),
        F.concat(F.lit(" retries="), _shown("retries"), F.lit(" verification_score="), _shown("coverage_score"), F.lit(" floor="), floor, F.lit(" hashes="), hashes),
    )
    parts.append(rows(pages, 13, by_page, telemetry, None))
    parts.append(fixed(14, "", "## Figures placed without placeholder (appended at page end)", ""))
    parts.append(rows(orphans, 15, [F.col("page"), F.col("index")], F.concat(F.lit("- page "), "page", F.lit(" index="), "index", F.lit(" alt='"), F.substring("alt", 1, 80), F.lit("' reason="), F.coalesce("reason", F.lit("")))))
    parts.append(fixed(16, "", "## Lint warnings (non-fatal)", ""))
    parts.append(rows(warnings, 17, [F.col("warning")], F.concat(F.lit("- "), "warning")))
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    return every


def rendered(lines: DataFrame) -> DataFrame:
    """(job_id, report): each job's lines as one text."""
    own = lines.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("part", "ord", "line"))).alias("ls"))
    return own.select("job_id", F.concat(F.array_join(F.col("ls.line"), "\n"), F.lit("\n")).alias("report"))
