import random

import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import markdown as M
from quire.functions import mathspans, mermaid, spec
from quire.functions import text as X


@pytest.fixture(scope="module")
def one(spark):
    """Values of an expression over texts."""

    def run(texts, expression):
        rows = [(i, t) for i, t in enumerate(texts)]
        got = spark.createDataFrame(rows, "i int, t string").select("i", expression(F.col("t")).alias("v")).collect()
        return [r.v for r in sorted(got, key=lambda r: r.i)]

    return run


def samples(n=300):
    r = random.Random(7)
    bits = ["# Head", "## A b!", "```py", "![](x.png)", "![alt t](x)", "[](y)", "[l](y)", "*b*", "word 12", "É-x", "", " ", "\t", "| a |", "|---|", "- i", "1. j", "\r", "\x0b", "\x85", "ß_z", "a![](c)d", "#tag"]
    return ["\n".join(" ".join(r.choice(bits) for _ in range(r.randint(0, 4))) for _ in range(r.randint(0, 6))) for _ in range(n)]


def test_tokens_equal_the_plain_twin(one):
    texts = samples()
    assert one(texts, X.tokens) == [spec.tokens(t) for t in texts]
    assert one(["Hello, World! 123x A-B"], X.tokens) == [["hello", "world", "123x", "a", "b"]]


def test_lines_and_candidates(one):
    texts = samples()
    assert one(texts, X.lines) == [t.splitlines() for t in texts]
    assert one(texts, X.candidate_lines) == [spec.candidate_lines(t) for t in texts]
    assert one(texts, X.collapsed) == [" ".join(t.split()) for t in texts]


@pytest.mark.parametrize(("kept", "want"), [(40, 1.0), (30, 0.75), (29, 29 / 40)])
def test_recall(one, kept, want):
    words = [f"word{i}" for i in range(40)]
    got = one([" ".join(words)], lambda t: X.recall(X.tokens(t), X.tokens(F.lit(" ".join(words[:kept]) + " new"))))
    assert got == [pytest.approx(want)]
    assert one(["tiny", ""], lambda t: X.recall(X.tokens(t), X.tokens(t))) == [None, None]
    assert one([" ".join(words[:30])], lambda t: X.recall(X.tokens(t), X.tokens(t))) == [1.0]


def test_floor(one):
    got = one(["", "0.85", "0.80", "0.42", "0.125"], lambda t: X.floor_failure(F.when(t != "", t.cast("double"))))
    assert got[:3] == [None] * 3 and "42% < 80%" in got[3] and got[3] == spec.floor_failure(0.42, 0.8) and got[4] == spec.floor_failure(0.125, 0.8)


def test_viability_and_routes(one):
    texts = ["w " * 25, "two labels", "x" * 12, "漢" * 70, "", "a b c d e f g h i j k l", " \n"]
    assert one(texts, X.native_viable) == [True, False, False, True, False, False, False]
    assert one(texts[:2], lambda t: X.reference_route(t, F.lit(True), F.lit(True))) == ["native", "ocr"]
    assert one(texts[1:2], lambda t: X.reference_route(t, F.lit(True), F.lit(False))) == ["vision"]


def test_degenerate_and_ladder(one):
    fence = "`" * 3
    texts = [fence * 26, fence * 25, (fence + "\n") * 12, "abcdefghijklmnopqrst" * 201, "abc " * 2000, "", "x" * 4001]
    assert one(texts, X.degenerate) == [spec.degenerate(t) for t in texts]
    assert one(["72", "80", "81", "200"], lambda t: X.dpi_ladder(t.cast("int"))) == [spec.ladder(d) for d in (72, 80, 81, 200)]


def test_headings(one):
    assert one(["## A\n### B", "# A\n## B", "none", "### x\n"], M.shifted_headings) == ["# A\n## B", "# A\n## B", "none", "# x"]
    assert one(["Hello, World!", "What's New?", " çà  été! ", "a_b-c"], M.slug) == ["hello-world", "whats-new", "çà-été", "a_b-c"]
    assert one(["# A\n### B c\n#no"], M.table_of_contents) == ["- [A](#a)\n    - [B c](#b-c)"]
    assert one(["#tag\n # H\nx"], X.outline) == [["#tag", "# H"]]


def test_line_kinds(one):
    texts = ["| a | b |", "|---|---|", "---", ":--", "-", "- x", "* y", "1. z", "2) q", "plain", "", "| a"]
    assert one(texts, M.is_separator) == [False, True, True, True, True] + [False] * 7
    assert one(texts, M.ends_in_row) == [True] + [False] * 11
    assert one(texts, M.starts_with_item) == [False] * 5 + [True] * 4 + [False] * 3
    assert one(["\n|--|\n| a |", "x\n|--|", ""], M.without_leading_separator) == ["\n| a |", "x\n|--|", ""]


def test_placeholders(one):
    text = "<!--FIG:2:3:1,2,3,4--> <!--FIG:page:1:5,6,7.5,8--> <!--FIG:page:idx:1,2,3,4--> <!--FIG:2:9:1,2,3--> <!--FIG:1:1:1..2,2,3,4-->"
    got = one([text], M.placeholders)[0]
    assert [(g.page, g.idx, g.x0, g.y1) for g in got] == [(2, 3, 1.0, 4.0), (None, 1, 5.0, 8.0)]
    assert one([text], M.leftover_tokens)[0] == [got[0].token, got[1].token, "<!--FIG:page:idx:1,2,3,4-->", "<!--FIG:2:9:1,2,3-->", "<!--FIG:1:1:1..2,2,3,4-->"]
    assert one(["x <!--FIG:1", "clean"], M.leftover_tokens) == [["<!--FIG: (unterminated)"], []]


def test_blocks(one):
    alt = "a " * 80
    assert one([alt], M.short_alt) == [("a " * 62).rstrip() + "…"]
    long = one([alt], lambda t: M.image_block(F.lit("f.png"), t, F.lit("c")))[0]
    assert long.startswith("![a a") and "](assets/f.png)\n\n*c*\n\n<details>\n<summary>Image description</summary>\n\n" in long
    table = one(["x|y"], lambda t: M.pipe_table(F.array(F.lit("h|h")), F.array(F.array(t))))[0]
    assert table == "| h|h |\n| --- |\n| x\\|y |"
    assert one(["a T b T"], lambda t: M.first_replaced(t, F.lit("T"), F.lit("$1"))) == ["a $1 b T"]


def test_geometry(spark):
    rows = [((0, 0, 10, 10), (0, 0, 10, 10), 1.0), ((0, 0, 10, 10), (20, 20, 30, 30), None), ((0, 0, 0, 5), (0, 0, 10, 10), None), ((0, 0, 100, 100), (10, 10, 12, 12), None), ((0, 0, 10, 10), (0, 0, 40, 40), None), ((0, 0, 100, 100), (50, 0, 150, 100), 5000 / 15000)]
    names = [f"{p}{c}" for p in ("r", "n") for c in ("x0", "y0", "x1", "y1")]
    frame = spark.createDataFrame([(i, *map(float, a), *map(float, b)) for i, (a, b, _) in enumerate(rows)], "i int, " + ", ".join(f"{n} double" for n in names))
    got = [r.s for r in frame.select("i", G.match_score(G.box("r"), G.box("n")).alias("s")).orderBy("i").collect()]
    assert got == [pytest.approx(w) if w is not None else None for *_, w in rows]


def test_mermaid(one):
    texts = ["graph TD\nA-->B", "%% c\npie:\n a", "bogus", "", "```mermaid\nerDiagram\n x\n```", "StateDiagram"]
    assert one(texts, lambda t: mermaid.diagram_type(mermaid.without_fences(t))) == ["flowchart", "pie", None, None, "erDiagram", "stateDiagram-v2"]
    allowed = F.array(F.lit("flowchart"))
    got = one([*texts[:4], "graph TD", "graph TD\n<<<X>>>", "%% c\ngraph TD"], lambda t: mermaid.problem(t, F.array(F.lit("flowchart"))))
    assert got[0] is None and "not in allowlist" in got[1] and "unrecognized" in got[2] and "empty" in got[3] and "no body" in got[4] and "leftover" in got[5] and got[6] is None
    assert allowed is not None


def test_math(one):
    safe = lambda *texts: one(list(texts), mathspans.github_math_safe)
    assert safe(r"$\text{old\_way}$ \text{a\_b}", r"$\{a\}$") == [r"$\text{old}\rule[-0.05em]{0.35em}{0.5pt}\text{way}$ \text{a\_b}", r"$\lbrace a \rbrace$"]
    texts = [r"$\text{a\_b\_c}$", r"$$x_{1} \{ y \}$$", "costs $5 and $6", "x_1", "$a$$b$", "", "$$\n\\{x\n$$ and $\\}$ $"]
    assert safe(*safe(*texts)) == safe(*texts)
    assert safe(*texts)[0].count("rule") == 2 and safe(*texts)[1:5] == texts[1:5] and safe(*texts)[6] == "$$\n\\lbrace x\n$$ and $ \\rbrace$ $"
    assert mathspans.formatted(r"a_b $x\_y$", str.upper) == r"A_B $x\_y$"
    assert mathspans.formatted("\ue000 a $x$ b $$y$$", str.upper) == "\ue000 A $x$ B $$y$$"
    assert mathspans.formatted("a $x$ b", lambda t: t.split()[0]) == "a $x$ b"
