"""Prompt templates, versioned: a changed text needs a new version, which changes every fingerprint."""

from __future__ import annotations

from quire.operators.envelope import DIAGRAM, TRANSCRIPTION, VERDICT

VERSIONS = {"transcribe": "v1", "verify": "v1", "diagram": "v1", "diagram_verify": "v1"}


def _format(names: tuple[str, ...]) -> str:
    return "\n".join(f"<<<{n}>>>\n...\n<<<END_{n}>>>" for n in names)


TRANSCRIBE = f"""Transcribe the page picture to GitHub-flavoured markdown. Keep every word of the source, in reading order; invent, summarise and translate nothing.
The reference text gives the characters; the picture gives the structure. Where a figure stands put <!--FIG:page:INDEX:x0,y0,x1,y1--> with its number and its box in pixels of the picture, origin top left.
Running headers, footers and page numbers belong into FURNITURE and not into the text. FIGURES is a JSON array of objects with index, bbox, alt and caption; FURNITURE a JSON object with header, footer and page-number.
Answer with these sections only, each marker alone at the start of its line:
{_format(TRANSCRIPTION)}"""

VERIFY = f"""Compare the candidate markdown with the page picture and the reference text. Count what is missing, changed or out of order.
VERDICT is a JSON object: coverage (whole number from 0 to 100), misses and structure_issues (arrays of strings), verdict ("pass" or "retry").
{_format(VERDICT)}"""

DIAGRAM_TO_MERMAID = f"""Say whether the figure can be given as a Mermaid diagram without guessing. If so give its source; never make up labels, numbers or edges. For data charts give the table that the figure shows.
DIAGRAM is a JSON object: convertible, type, confidence (whole number from 0 to 100), description. DATA is a JSON object with columns and rows, or empty.
{_format(DIAGRAM)}"""

DIAGRAM_VERIFY = f"""Compare the Mermaid source with the figure: every label, edge and number must be there and nothing else.
{_format(VERDICT)}"""


def user_content(reference: str, width: int, height: int, page: int, context: str = "", outline: str = "") -> str:
    """What a call says beside the picture."""
    parts = [f"Page {page}, picture of {width}x{height} pixels.", f"REFERENCE TEXT:\n{reference}"]
    if outline:
        parts.append(f"OUTLINE SO FAR:\n{outline}")
    if context:
        parts.append(f"CONTEXT:\n{context}")
    return "\n\n".join(parts)
