"""From finished pages to deliverables: diagrams, figures, documents, checks, reports.

Every step works on the pages of all jobs at once. Models, pictures and formatters are injected: ``crop`` takes boxes (doc_id, page_number, idx, x0, y0, x1, y1) and
gives (doc_id, page_number, idx, png) with null where a box can't be cut; ``natives`` has (doc_id, page_number, pos, ext, data, x0, y0, x1, y1) in pixels of the
render, ``spans`` the words of the text layer as ``documents.text_spans`` gives them.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import markdown as M
from quire.functions import mathspans, mermaid
from quire.operators import assembly, envelope, figures, reports, store
from quire.plans.conversion import Reply
from quire.plans.prompts import VERSIONS
from quire.plans.resilience import resilient
from quire.sources import workspace
from quire.sources.settings import Settings

_PAGE = ["doc_id", "page_number"]
_BOX = ["x0", "y0", "x1", "y1"]
NATIVES = "doc_id string, page_number int, pos int, ext string, data binary, x0 double, y0 double, x1 double, y1 double"
SPANS = "doc_id string, page_number int, pos int, text string, x0 double, y0 double, x1 double, y1 double"
_REPLIES = "doc_id string, page_number int, idx int, raw string, judged string, failure string"
#: What a conversion adds to a payload.
_CONVERTED = ["convertible", "diagram_type", "confidence", "reason", "mermaid", "description", "columns", "rows"]


@dataclass(frozen=True)
class Tools:
    """Injected calls; they must pickle. ``diagram`` and ``check`` take (job, page, index, png, text in the box) and, for check, the diagram's source, and give a Reply."""

    crop: Callable[[DataFrame], DataFrame]
    diagram: Callable[..., Reply] | None = None
    check: Callable[..., Reply] | None = None
    formatter: Callable[[str], str] = str
    linter: Callable[[str], list[str]] = lambda text: []


def payloads(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, pos, idx, alt, caption, x0, y0, x1, y1) of the figures that pages (doc_id, page_number, figures as JSON) describe, one an index."""
    rows = pages.select(*_PAGE, F.posexplode(envelope.figures_from_payload(F.col("figures"))).alias("pos", "f"))
    return figures.last_payloads(rows.select(*_PAGE, "pos", F.col("f.index").alias("idx"), "f.alt", "f.caption", *[F.col("f.bbox")[k].alias(c) for k, c in enumerate(_BOX)]))


def diagrams(found: DataFrame, crops: DataFrame, spans: DataFrame, tools: Tools, settings: Settings) -> DataFrame:
    """The payloads with what the diagram models say (``_CONVERTED``), all figures in parallel. A figure that can't be cut, or whose call fails, is not convertible; the verifier is asked about confident ones only."""
    none = [F.lit(False).alias("convertible"), F.lit("").alias("diagram_type"), F.lit(None).cast("int").alias("confidence"), F.lit("").alias("reason"), *[F.lit(None).cast("string").alias(c) for c in ("mermaid", "description")], F.array().cast("array<string>").alias("columns"), F.array().cast("array<array<string>>").alias("rows")]
    if not settings.diagram_to_mermaid or tools.diagram is None:
        return found.select("*", *none)
    ground = figures.spans_in_box(spans, found.select(*_PAGE, "idx", *_BOX)).withColumnRenamed("text", "ground")
    asked = found.select(*_PAGE, "idx").join(crops, [*_PAGE, "idx"], "left").join(ground, [*_PAGE, "idx"], "left")
    least, verify = settings.diagram_min_confidence, settings.diagram_verify and tools.check is not None

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                if r.png is None:
                    out.append((r.doc_id, r.page_number, r.idx, None, None, "figure crop failed"))
                    continue
                at = (r.doc_id, r.page_number, r.idx, bytes(r.png), r.ground or "")
                got = resilient(lambda: tools.diagram(*at), name="diagram")  # noqa: B023
                raw, judged, failure = (got.value.raw if got.error is None else None), None, got.error
                parsed = envelope.attempted(envelope.diagram, raw)
                if verify and failure is None and parsed["error"] is None and parsed["convertible"] and parsed["confidence"] >= least:
                    again = resilient(lambda: tools.check(*at, parsed["mermaid"]), name="diagram check")  # noqa: B023
                    judged = again.value.raw if again.error is None else ""
                out.append((*at[:3], raw, judged, failure))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _REPLIES.split(", ")])

    replies = asked.select(*_PAGE, F.col("idx").cast("int").alias("idx"), "png", "ground").mapInPandas(ask, _REPLIES)
    replies = replies.withColumn("d", envelope.parsed_diagram(F.col("raw"))).withColumn("v", envelope.parsed_verdict(F.col("judged")))
    parsed = {k: F.col(f"d.{k}") for k in ("error", "convertible", "mermaid", "diagram_type", "confidence")}
    approved = F.col("v.error").isNull() & (F.coalesce("v.verdict", F.lit("")) == "pass")
    end = mermaid.conversion(parsed, least=least, allowed=F.array(*map(F.lit, settings.diagram_types)), verify=F.lit(verify), approved=approved, fidelity=F.coalesce("v.coverage", F.lit(0)))
    failed = F.col("failure").isNotNull()
    own = replies.withColumn("o", end).select(
        *_PAGE,
        "idx",
        F.when(failed, False).otherwise(F.col("o.convertible")).alias("convertible"),
        F.when(failed, "").otherwise(F.col("o.diagram_type")).alias("diagram_type"),
        F.when(~failed, F.col("o.confidence")).alias("confidence"),
        F.when(failed, F.col("failure")).otherwise(F.col("o.reason")).alias("reason"),
        F.when(F.col("o.convertible") & ~failed, mermaid.without_fences(F.col("d.mermaid"))).alias("mermaid"),
        F.col("d.description").alias("description"),
        F.coalesce("d.data.columns", F.array().cast("array<string>")).alias("columns"),
        F.coalesce("d.data.rows", F.array().cast("array<array<string>>")).alias("rows"),
    )
    return found.join(own, [*_PAGE, "idx"])


def diagram_events(converted: DataFrame) -> DataFrame:
    """(job_id, ts, level, stage, message) of each figure's conversion."""
    end = F.when(F.col("convertible"), F.concat(F.lit("mermaid "), "diagram_type", F.lit(" (confidence "), F.col("confidence"), F.lit(")"))).otherwise(F.concat(F.lit("image fallback ("), "reason", F.lit(")")))
    message = F.concat(F.lit("page "), "page_number", F.lit(" figure "), "idx", F.lit(": "), end)
    return converted.select(*store.logged(F.col("doc_id"), F.lit("info"), F.lit("transcribing"), message))


@dataclass
class Resolved:
    """Pages with their figures in place; ``assets`` (doc_id, file, data) to write, ``images`` to record, ``orphans`` for the report."""

    pages: DataFrame
    assets: DataFrame
    images: DataFrame
    orphans: DataFrame


def _blocks(rows: DataFrame, settings: Settings) -> DataFrame:
    """Rows with data, ext and a payload's columns, with kind, file, block and what is written; all null where there is no picture."""
    has_data = F.size("columns") > 0
    kind = mermaid.representation(F.coalesce("convertible", F.lit(False)), F.coalesce("mermaid", F.lit("")), F.coalesce("diagram_type", F.lit("")), F.coalesce(has_data, F.lit(False)), F.lit(settings.diagram_fallback))
    out = rows.withColumn("kind", kind).withColumn("file", F.concat(M.asset_name(F.col("page_number"), F.col("idx"), ""), F.coalesce("ext", F.lit("png"))))
    image = M.image_block(F.col("file"), F.col("alt"), F.coalesce("caption", F.lit("")), settings.fig_details)
    drawn = M.mermaid_block(F.col("mermaid"), F.coalesce("description", F.lit("")), image, F.lit(settings.diagram_keep_image))
    table = M.table_block(F.col("columns"), F.col("rows"), F.coalesce("description", F.lit("")), image)
    there = F.col("data").isNotNull()
    kept = there & ((F.col("kind") != "mermaid") | F.lit(settings.diagram_keep_image))
    return out.withColumn("block", F.when(there, M.figure_block(F.col("kind"), image, drawn, table))).withColumn("written", F.when(kept, F.col("data")))


def resolved(pages: DataFrame, converted: DataFrame, payload_crops: DataFrame, natives: DataFrame, tools: Tools, settings: Settings) -> Resolved:
    """Places figures in pages (doc_id, page_number, text).

    A token takes its payload's text, and as picture the native object that its box matches (only if it has a payload), else its box cut from the render. Tokens whose box
    can't be cut stay, for the integrity check to find. Payloads without a token are appended at the page's end.
    """
    tokens = figures.tokens(pages)
    cut = tools.crop(tokens.select(*_PAGE, F.col("ord").alias("idx"), *_BOX)).withColumnRenamed("idx", "ord").withColumnRenamed("png", "_png")
    taken = figures.greedy_matches(figures.scored_pairs(tokens, natives)).select(*_PAGE, "ord", F.col("pos").alias("_pos"))
    own = natives.select(*_PAGE, F.col("pos").alias("_pos"), F.col("ext").alias("_ext"), F.col("data").alias("_native"))
    placed = figures.described(tokens, converted).join(converted.select(*_PAGE, "idx", *_CONVERTED), [*_PAGE, "idx"], "left")
    placed = placed.join(cut, [*_PAGE, "ord"], "left").join(taken, [*_PAGE, "ord"], "left").join(own, [*_PAGE, "_pos"], "left")
    native = F.col("matched") & F.col("_native").isNotNull()
    placed = placed.withColumn("data", F.when(native, F.col("_native")).otherwise(F.col("_png"))).withColumn("ext", F.when(native, F.col("_ext")).otherwise(F.lit("png"))).withColumn("source", F.when(native, "native").otherwise("crop"))
    columns = [*_PAGE, "idx", "alt", "caption", *_BOX, *_CONVERTED, "data", "ext", "source"]
    anchored = _blocks(placed.select(*columns, "ord", "token"), settings)
    loose = figures.unanchored(tokens, converted).join(payload_crops.withColumnRenamed("png", "data"), [*_PAGE, "idx"], "left").withColumn("ext", F.lit("png")).withColumn("source", F.lit("crop"))
    loose = _blocks(loose.select(*columns), settings)
    every = anchored.drop("ord", "token").unionByName(loose).where("block is not null")
    written = every.where("written is not null").groupBy("doc_id", "file").agg(F.max_by("written", F.sha2("written", 256)).alias("data"))
    images = every.select(
        F.col("doc_id").alias("job_id"),
        "page_number",
        F.col("idx").cast("long").alias("image_id"),
        F.when(F.col("written").isNotNull(), F.concat(F.lit("assets/"), "file")).otherwise("").alias("asset_path"),
        "source",
        F.array(*_BOX).alias("bbox"),
        M.short_alt(F.col("alt")).alias("alt_text"),
        "caption",
        "mermaid",
        "diagram_type",
        F.col("kind").alias("conversion_status"),
        "confidence",
    )
    reason = F.when(F.col("block").isNull(), "bbox outside render; needs_review").otherwise("no placeholder token in markdown; appended at page end")
    orphans = loose.select(F.col("doc_id").alias("job_id"), F.col("page_number").alias("page"), F.col("idx").alias("index"), "alt", reason.alias("reason"))
    return Resolved(figures.resolved_pages(pages, anchored.select(*_PAGE, "ord", "token", "block"), loose.select(*_PAGE, "idx", "block")), written, images, orphans)


def documents(pages: DataFrame, settings: Settings, tools: Tools) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) of the joined documents, formatted and safe to show, and the running furniture (doc_id, key, pages) that was taken out."""
    furniture = assembly.furniture_similar(pages)
    whole = assembly.joined_pages(assembly.without_furniture(pages, furniture))
    assembled = whole.select("doc_id", assembly.assembled(F.col("document"), settings.toc_enabled).alias("text"))

    def tidy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(text=[mathspans.formatted(t, tools.formatter) for t in frame["text"]])

    # a step of its own: the optimiser would put a function of a column into the expressions that use it
    formatted = assembled.mapInPandas(tidy, assembled.schema)
    return formatted.withColumn("text", mathspans.github_math_safe(F.col("text"))), assembly.furniture_pages(pages, furniture)


def deliver(spark: SparkSession, path: str, jobs: DataFrame, natives: DataFrame, spans: DataFrame, tools: Tools, settings: Settings | None = None) -> DataFrame:
    """Makes the documents and reports of a store's finished jobs and returns (job_id, hard_fail, reasons, warnings).

    Written below ``path``: documents (job_id, text), assets (job_id, file, data), images, reports (job_id, report), events. A second run replaces them, so it is idempotent.
    ``jobs`` is the current view of the jobs.
    """
    settings = settings or Settings()
    current = store.latest(spark.read.parquet(f"{path}/checkpoints"), ["job_id", "page_number"]).join(jobs.select("job_id"), "job_id", "left_semi")
    pages = current.select(F.col("job_id").alias("doc_id"), "page_number", F.col("markdown").alias("text"), "figures")

    def kept(frame: DataFrame, name: str) -> DataFrame:
        frame.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    found = kept(payloads(pages), "work/payloads")
    crops = kept(tools.crop(found.select(*_PAGE, "idx", *_BOX)), "work/crops")
    converted = kept(diagrams(found, crops, spans, tools, settings), "work/diagrams")
    kept(diagram_events(converted), "figure_events")
    placed = resolved(pages.drop("figures"), converted, crops, natives, tools, settings)
    assets = kept(placed.assets.withColumnRenamed("doc_id", "job_id"), "assets")
    images = kept(placed.images, "images")
    texts, furniture = documents(placed.pages, settings, tools)
    texts = kept(texts.withColumnRenamed("doc_id", "job_id"), "documents").withColumnRenamed("job_id", "doc_id")
    warnings = texts.select("doc_id", F.explode(mathspans.linted(F.col("text"), tools.linter)).alias("warning"))
    judged = figures.classified(figures.integrity(texts, assets.withColumnRenamed("job_id", "doc_id")), warnings).withColumnRenamed("doc_id", "job_id")
    judged = kept(judged, "quality")
    told = jobs.withColumn("prompts", F.lit(str(VERSIONS))).withColumn("agent_model", F.lit(settings.agent_model)).withColumn("ocr_model", F.lit(settings.ocr_model)).withColumn("render_dpi", F.lit(settings.render_dpi))
    lines = reports.report_lines(told, current, images, furniture.select(F.col("doc_id").alias("job_id"), F.col("key").alias("text"), "pages"), placed.orphans, judged.select("job_id", F.explode("warnings").alias("warning")))
    kept(reports.rendered(lines), "reports")
    return judged


def write(spark: SparkSession, path: str, job_id: str, name: str, out: str) -> dict[str, Path]:
    """Writes one job's deliverable to a folder of the driver; its pictures pass one after the other."""
    own = F.col("job_id") == job_id
    text = spark.read.parquet(f"{path}/documents").where(own).first()
    report = spark.read.parquet(f"{path}/reports").where(own).first()
    if text is None or report is None:
        raise KeyError(f"nothing delivered for {job_id}")
    with tempfile.TemporaryDirectory() as folder:
        for r in spark.read.parquet(f"{path}/assets").where(own).toLocalIterator():
            Path(folder, workspace.docname(r["file"])).write_bytes(bytes(r["data"]))
        return workspace.write_deliverable(workspace.output_dir(out), name, text["text"], folder, report["report"])


def finished(judged: DataFrame) -> Column:
    """The status that a delivered job gets."""
    return F.when(judged["hard_fail"], "failed").otherwise("completed")
