"""Queries over figures, payloads, diagrams and responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import markdown as M
from quire.functions import mermaid as D
from quire.operators import envelope, figures
from quire.plans.fingerprint import canonical, options_rows
from quire.plans.registry import query

#: Orders as pages: a customer is a document, an order its page.
_LINES = "(SELECT o_custkey AS l_orderkey, o_orderkey AS l_linenumber, o_orderkey * 31 % 2000 AS l_partkey, o_custkey % 100 AS l_suppkey FROM orders)"
_PAGE = "l_orderkey AS doc_id, l_linenumber::BIGINT AS page_number"
_TOKEN = "'<!--FIG:' || CASE WHEN l_partkey % 2 = 0 THEN 'page:' ELSE l_linenumber || ':' END || l_partkey % 7 || ':' || l_suppkey || ',2.5,' || (l_suppkey + 10) || ',40-->'"


def _pages(read):
    """Pages with one good token, one malformed, and on some pages an open mark."""
    page, part, supp = F.col("o_orderkey"), F.col("o_orderkey") * 31 % 2000, F.col("o_custkey") % 100
    token = F.concat(F.lit("<!--FIG:"), F.when(part % 2 == 0, "page:").otherwise(F.concat(page, F.lit(":"))), part % 7, F.lit(":"), supp, F.lit(",2.5,"), supp + 10, F.lit(",40-->"))
    text = F.concat(F.lit("a "), token, F.when(part % 3 == 0, " <!--FIG:page:idx:1,2-->").otherwise(""), F.lit(" b"))
    return read("orders").select(F.col("o_custkey").alias("doc_id"), page.alias("page_number"), text.alias("text"), (part % 5).alias("p5"), part.alias("part"), token.alias("token"))


def _payloads(read):
    pages = _pages(read)
    return pages.where("p5 < 4").select("doc_id", "page_number", F.lit(0).alias("pos"), (F.col("part") % 7 + F.when(F.col("p5") == 1, 100).otherwise(0)).alias("idx"), F.concat(F.lit("alt "), "part").alias("alt"), F.when(F.col("p5") == 0, F.concat(F.lit("cap "), "part")).alias("caption"))


_PAYLOADS = f"SELECT {_PAGE}, l_partkey % 7 + CASE WHEN l_partkey % 5 = 1 THEN 100 ELSE 0 END AS idx, 'alt ' || l_partkey AS alt, CASE WHEN l_partkey % 5 = 0 THEN 'cap ' || l_partkey END AS caption FROM {_LINES} WHERE l_partkey % 5 < 4"
_TOKENS = f"SELECT {_PAGE}, {_TOKEN} AS token, CASE WHEN l_partkey % 2 = 1 THEN l_linenumber END::BIGINT AS page, l_partkey % 7 AS idx, l_suppkey::DOUBLE AS x0, 2.5::DOUBLE AS y0, (l_suppkey + 10)::DOUBLE AS x1, 40::DOUBLE AS y1 FROM {_LINES}"


@query(_TOKENS)
def placeholder_parse(read):
    return figures.tokens(_pages(read)).drop("ord")


@query(f"WITH t AS ({_TOKENS}), p AS ({_PAYLOADS}) SELECT t.doc_id, t.page_number, t.idx, coalesce(p.alt, 'Figure on page ' || t.page_number) AS alt, p.caption, p.idx IS NOT NULL AS matched FROM t LEFT JOIN p ON p.doc_id = t.doc_id AND p.page_number = t.page_number AND p.idx = t.idx")
def placeholder_left_join(read):
    return figures.described(figures.tokens(_pages(read)), _payloads(read)).select("doc_id", "page_number", "idx", "alt", "caption", "matched")


@query(f"WITH t AS ({_TOKENS}), p AS ({_PAYLOADS}) SELECT p.doc_id, p.page_number, p.idx, p.alt FROM p WHERE NOT EXISTS (SELECT 1 FROM t WHERE p.doc_id = t.doc_id AND p.page_number = t.page_number AND p.idx = t.idx)")
def orphan_payload_anti(read):
    return figures.unanchored(figures.tokens(_pages(read)), _payloads(read)).select("doc_id", "page_number", "idx", "alt")


@query(f"SELECT {_PAGE}, {_TOKEN} || CASE WHEN l_partkey % 3 = 0 THEN '|<!--FIG:page:idx:1,2-->' ELSE '' END AS leftovers FROM {_LINES}")
def leftover_tokens(read):
    return _pages(read).select("doc_id", "page_number", F.array_join(M.leftover_tokens(F.col("text")), "|").alias("leftovers"))


_BLOCK = "'![alt ' || l_partkey || '](assets/' || printf('page-%03d-img-%02d.png', l_linenumber, l_partkey % 7) || ')'"


@query(f"SELECT {_PAGE}, 'a ' || CASE WHEN l_partkey % 5 IN (0, 2, 3) THEN {_BLOCK} ELSE {_TOKEN} END || CASE WHEN l_partkey % 3 = 0 THEN ' <!--FIG:page:idx:1,2-->' ELSE '' END || ' b' || CASE WHEN l_partkey % 5 = 1 THEN chr(10) || chr(10) || 'extra' || chr(10) ELSE '' END AS text FROM {_LINES}")
def figure_resolution(read):
    pages = _pages(read)
    found = figures.described(figures.tokens(pages), _payloads(read).withColumn("caption", F.lit(None).cast("string")))
    blocks = found.withColumn("block", F.when(F.col("matched"), M.image_block(M.asset_name(F.col("page_number"), F.col("idx")), F.col("alt"), F.col("caption"))))
    more = figures.unanchored(figures.tokens(pages), _payloads(read)).select("doc_id", "page_number", "idx", F.lit("extra").alias("block"))
    return figures.resolved_pages(pages.select("doc_id", "page_number", "text"), blocks.select("doc_id", "page_number", "ord", "token", "block"), more)


@query("""SELECT p_partkey, '![' || p_name || '](assets/page-001-img-' || printf('%02d', p_size) || '.png)' || CASE WHEN p_size % 2 = 0 THEN chr(10) || chr(10) || '*' || p_type || '*' ELSE '' END AS image,
'```mermaid' || chr(10) || 'pie' || chr(10) || p_brand || chr(10) || '```' || chr(10) || chr(10) || '*' || p_type || '*' || CASE WHEN p_size % 3 = 0 THEN chr(10) || chr(10) || '<details>' || chr(10) || '<summary>Original figure</summary>' || chr(10) || chr(10) || 'img' || chr(10) || '</details>' ELSE '' END AS mermaid FROM part""")
def figure_block(read):
    caption = F.when(F.col("p_size") % 2 == 0, F.col("p_type"))
    image = M.image_block(M.asset_name(F.lit(1), F.col("p_size")), F.col("p_name"), caption)
    mermaid = M.mermaid_block(F.concat(F.lit("pie\n"), "p_brand"), F.col("p_type"), F.lit("img"), F.col("p_size") % 3 == 0)
    return read("part").select("p_partkey", image.alias("image"), mermaid.alias("mermaid"))


@query(r"""SELECT n_regionkey, '| name | key |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | a\|' || n_nationkey || ' |', chr(10) ORDER BY n_nationkey) AS md FROM nation GROUP BY n_regionkey""")
def gfm_table(read):
    rows = read("nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.array("n_name", F.concat(F.lit("a|"), "n_nationkey")).alias("r")))).alias("rs"))
    return rows.select("n_regionkey", M.pipe_table(F.array(F.lit("name"), F.lit("key")), F.col("rs.r")).alias("md"))


@query("SELECT p_partkey, '![x](' || p_brand || '/assets/' || p_partkey || '.png) [y](assets) (' || p_brand || '/assets/z)' AS md FROM part")
def link_rewrite(read):
    text = F.concat(F.lit("![x](assets/"), "p_partkey", F.lit(".png) [y](assets) (assets/z)"))
    return read("part").select("p_partkey", M.top_level_links(text, F.col("p_brand")).alias("md"))


# boxes from the first components of vectors: label is the page
_BOXES = "SELECT vec_id, label, 100 * (embedding[1]::DOUBLE) AS x0, 100 * (embedding[2]::DOUBLE) AS y0, 100 * (embedding[1]::DOUBLE) + 30 + 50 * abs(embedding[3]::DOUBLE) AS x1, 100 * (embedding[2]::DOUBLE) + 30 + 50 * abs(embedding[4]::DOUBLE) AS y1 FROM embeddings"


def _boxes(read):
    e = [F.col("embedding")[i].cast("double") for i in range(4)]
    x0, y0 = 100 * e[0], 100 * e[1]
    box = [x0.alias("x0"), y0.alias("y0"), (x0 + 30 + 50 * F.abs(e[2])).alias("x1"), (y0 + 30 + 50 * F.abs(e[3])).alias("y1")]
    return read("embeddings").select("vec_id", "label", *box)


_AREA = "(greatest(0.0, {0}.x1 - {0}.x0) * greatest(0.0, {0}.y1 - {0}.y0))"
_A, _B = _AREA.format("a"), _AREA.format("b")
_I = "(greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0)))"
_PAIRS = f"WITH x AS ({_BOXES}) SELECT a.label, a.vec_id AS a, b.vec_id AS b, {_A} AS ra, {_B} AS rb, {_I} AS inter FROM x a JOIN x b ON a.label = b.label AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1"
_SCORE = "CASE WHEN ra > 0 AND rb > 0 AND inter / least(ra, rb) >= 0.5 AND rb / ra BETWEEN 0.25 AND 4.0 THEN inter / (ra + rb - inter) END"


@query(f"SELECT a, b, round(inter, 6) AS inter, round(ra, 6) AS area FROM ({_PAIRS}) WHERE inter > 0")
def rect_overlap(read):
    x = _boxes(read)
    left = x.where("vec_id % 2 = 0").select("label", F.col("vec_id").alias("a"), *[F.col(c).alias(f"r{c}") for c in ("x0", "y0", "x1", "y1")])
    right = x.where("vec_id % 2 = 1").select("label", F.col("vec_id").alias("b"), *[F.col(c).alias(f"n{c}") for c in ("x0", "y0", "x1", "y1")])
    pairs = left.join(right, "label").withColumn("inter", G.intersection(G.box("r"), G.box("n"))).where("inter > 0")
    return pairs.select("a", "b", F.round("inter", 6).alias("inter"), F.round(G.area(G.box("r")), 6).alias("area"))


def _scored(read):
    x = _boxes(read).select(F.lit(0).alias("doc_id"), F.col("label").alias("page_number"), F.col("vec_id").alias("ord"), F.col("vec_id").alias("pos"), "x0", "y0", "x1", "y1")
    return figures.scored_pairs(x.where("ord % 2 = 0"), x.where("pos % 2 = 1"))


@query(f"SELECT label AS page_number, a AS ord, b AS pos, round(s, 6) AS score FROM (SELECT *, {_SCORE} AS s FROM ({_PAIRS})) WHERE s IS NOT NULL")
def native_match_score(read):
    return _scored(read).select("page_number", "ord", "pos", F.round("score", 6).alias("score"))


#: In order of reference, score and picture a pair is taken if neither of its two is.
@query(f"""WITH p AS (SELECT label, a, b, s FROM (SELECT *, {_SCORE} AS s FROM ({_PAIRS})) WHERE s IS NOT NULL),
l AS (SELECT label, list([{{'a': a, 'b': b}}] ORDER BY a, s DESC, b) AS ps FROM p GROUP BY label),
g AS (SELECT label, unnest(list_reduce(list_concat([[]::STRUCT(a BIGINT, b BIGINT)[]], ps), lambda t, x: CASE WHEN len(list_filter(t, lambda y: y.a = x[1].a OR y.b = x[1].b)) > 0 THEN t ELSE list_concat(t, x) END)) AS m FROM l)
SELECT label AS page_number, m.a AS ord, m.b AS pos FROM g""")
def native_match_greedy(read):
    return figures.greedy_matches(_scored(read)).select("page_number", "ord", "pos")


def _linked(read):
    docs = read("pages").select(F.col("page_id").alias("doc_id"), F.concat(F.lit("![a](assets/p"), F.col("page_id") % 10, F.lit(".png) [b](assets/q"), F.col("page_id"), F.lit(".png)")).alias("text"))
    files = read("pages").select(F.col("page_id").alias("doc_id"), F.explode(F.array(F.concat(F.lit("p"), F.col("page_id") % 7, F.lit(".png")), F.concat(F.lit("q"), "page_id", F.lit(".png")))).alias("file"))
    return docs, files


@query("SELECT page_id AS doc_id, 'assets/p' || page_id % 10 || '.png' AS link FROM pages WHERE page_id % 10 <> page_id % 7")
def asset_missing(read):
    docs, files = _linked(read)
    return figures.missing_files(figures.links(docs), files)


@query("SELECT page_id AS doc_id, 'p' || page_id % 7 || '.png' AS file FROM pages WHERE page_id % 10 <> page_id % 7")
def asset_orphan(read):
    docs, files = _linked(read)
    return figures.orphan_files(figures.links(docs), files)


@query("SELECT page_id AS doc_id, page_id % 10 = page_id % 7 AS ok, CASE WHEN page_id % 10 <> page_id % 7 THEN 'assets/p' || page_id % 10 || '.png' ELSE '' END AS missing FROM pages")
def asset_integrity(read):
    return figures.integrity(*_linked(read)).select("doc_id", "ok", F.array_join("missing", ",").alias("missing"))


@query("SELECT page_id AS doc_id, page_id % 10 <> page_id % 7 AS hard_fail, (CASE WHEN page_id % 10 <> page_id % 7 THEN 2 ELSE 0 END)::INT AS n_reasons FROM pages")
def qa_classify(read):
    docs, files = _linked(read)
    none = docs.select("doc_id", F.lit("").alias("warning")).limit(0)
    return figures.classified(figures.integrity(docs, files), none).select("doc_id", "hard_fail", F.size("reasons").alias("n_reasons"))


@query("SELECT sha256(options) AS fingerprint FROM (VALUES " + ", ".join("('" + canonical(o).replace("'", "''") + "')" for o in options_rows()) + ") t(options)")
def pipeline_fingerprint(read):
    spark = read("region").sparkSession
    return spark.createDataFrame([(canonical(o),) for o in options_rows()], "options string").select(F.sha2("options", 256).alias("fingerprint"))


_BREAKS = r"string_split_regex(text, '\r\n|[\n\r\v\f\x1c-\x1e\x{85}\x{2028}\x{2029}]')"


@query(rf"""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'line ' || (len({_BREAKS}) + 8) || ': content outside any section: ''stray''' END AS error,
CASE WHEN doc_id % 5 <> 0 THEN length(regexp_replace(array_to_string({_BREAKS}, chr(10)), '^\s+|\s+$', '', 'g'))::INT END AS n, CASE WHEN doc_id % 5 <> 0 THEN 1 END AS n_figures, CASE WHEN doc_id % 5 <> 0 THEN 'n' END AS notes FROM documents""")
def envelope_sections(read):
    figures_json = F.concat(F.lit('[{"index": '), F.col("doc_id") % 9, F.lit(', "bbox": [1, 2, 3, 4], "alt": "a"}]'))
    raw = F.concat(F.lit("<<<MARKDOWN>>>\n"), "text", F.lit("\n<<<END_MARKDOWN>>>\n<<<FIGURES>>>\n"), figures_json, F.lit("\n<<<END_FIGURES>>>\n<<<FURNITURE>>>\n<<<END_FURNITURE>>>\n"), F.when(F.col("doc_id") % 5 == 0, "stray").otherwise("<<<NOTES>>>\nn\n<<<END_NOTES>>>"))
    got = read("documents").select("doc_id", envelope.parsed_transcription(raw).alias("e"))
    return got.select("doc_id", "e.error", F.length("e.markdown").alias("n"), F.size("e.figures").alias("n_figures"), "e.notes")


_COVERAGE = "CASE doc_id % 5 WHEN 0 THEN '90' WHEN 1 THEN '101' WHEN 2 THEN 'true' WHEN 3 THEN '98.0' ELSE '7' END"


def _verdict_payload():
    n = F.col("doc_id") % 5
    coverage = F.when(n == 0, "90").when(n == 1, "101").when(n == 2, "true").when(n == 3, "98.0").otherwise("7")
    return F.concat(F.lit('{"coverage": '), coverage, F.lit(', "misses": ["a"], "verdict": "'), F.when(F.col("quality") == 1, "pass").otherwise("retry"), F.lit('"}'))


@query("SELECT doc_id, doc_id % 5 IN (0, 4) AS ok, (CASE doc_id % 5 WHEN 0 THEN 90 WHEN 4 THEN 7 END)::BIGINT AS coverage, CASE WHEN doc_id % 5 IN (0, 4) THEN CASE WHEN quality = 1 THEN 'pass' ELSE 'retry' END END AS verdict FROM labels")
def verdict_parse(read):
    return read("labels").select("doc_id", envelope.verdict_fields(_verdict_payload()).alias("v")).select("doc_id", "v.*")


@query("SELECT doc_id, doc_id % 5 IN (0, 4) AS ok, CASE doc_id % 5 WHEN 0 THEN 90 WHEN 4 THEN 7 END::INT AS coverage FROM labels")
def verdict_envelope(read):
    raw = F.concat(F.lit("<<<VERDICT>>>\n"), _verdict_payload(), F.lit("\n<<<END_VERDICT>>>"))
    return read("labels").select("doc_id", envelope.parsed_verdict(raw).alias("v")).select("doc_id", F.col("v.error").isNull().alias("ok"), "v.coverage")


@query("SELECT event_id, (props->>'$.k')::INT AS k FROM events")
def props_json(read):
    return read("events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))


@query("SELECT p_partkey, p_size AS idx, 1.5::DOUBLE AS x0, p_name AS alt FROM part WHERE p_size % 4 <> 0")
def figures_explode(read):
    box = F.when(F.col("p_size") % 4 == 0, "[1.5, 2]").otherwise("[1.5, 2, 3, 4]")
    payload = F.concat(F.lit('[{"index": '), "p_size", F.lit(', "bbox": '), box, F.lit(', "alt": "'), "p_name", F.lit('"}]'))
    rows = read("part").select("p_partkey", F.explode(envelope.figures_from_payload(payload)).alias("f"))
    return rows.select("p_partkey", F.col("f.index").alias("idx"), F.col("f.bbox")[0].alias("x0"), F.col("f.alt").alias("alt"))


_SOURCES = ("graph TD", "pie:", "%% note", "unknown x", "sequenceDiagram", "")


def _source():
    head = F.element_at(F.array(*map(F.lit, _SOURCES)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return F.concat(F.lit("```mermaid\n"), head, F.lit("\n"), F.when(F.col("p_size") % 2 == 0, F.lit("  A --> B\n")).otherwise(""), F.lit("```"))


_TYPE = "CASE p_partkey % 6 WHEN 0 THEN 'flowchart' WHEN 1 THEN 'pie' WHEN 4 THEN 'sequenceDiagram' END"


@query(f"SELECT p_partkey, {_TYPE} AS type FROM part")
def mermaid_type(read):
    return read("part").select("p_partkey", D.diagram_type(D.without_fences(_source())).alias("type"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN CASE WHEN p_size % 2 = 1 THEN 'flowchart diagram has no body' END WHEN 1 THEN 'Mermaid type ''pie'' not in allowlist'
WHEN 2 THEN CASE WHEN p_size % 2 = 0 THEN 'unrecognized Mermaid diagram type: ''A --> B''' ELSE 'unrecognized Mermaid diagram type: ''''' END WHEN 3 THEN 'unrecognized Mermaid diagram type: ''unknown x'''
WHEN 4 THEN CASE WHEN p_size % 2 = 1 THEN 'sequenceDiagram diagram has no body' END ELSE CASE WHEN p_size % 2 = 0 THEN 'unrecognized Mermaid diagram type: ''A --> B''' ELSE 'empty Mermaid source' END END AS reason FROM part""")
def mermaid_validate(read):
    allowed = F.array(*[F.lit(t) for t in D.ALLOWED if t != "pie"])
    return read("part").select("p_partkey", D.problem(_source(), allowed).alias("reason"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND p_partkey % 3 > 0 THEN 'mermaid' WHEN p_partkey % 4 = 0 AND p_size % 5 > 0 AND p_partkey % 7 IN (0, 1) THEN 'table' ELSE 'image' END AS kind FROM part""")
def representation_choice(read):
    key, size = F.col("p_partkey"), F.col("p_size")
    fallback = F.when(key % 7 == 0, "table").when(key % 7 == 1, "both").otherwise("image")
    kind = D.representation(size % 2 == 0, F.when(key % 3 > 0, "pie\nx").otherwise(""), F.when(key % 4 == 0, "pie").otherwise("gantt"), size % 5 > 0, fallback)
    return read("part").select("p_partkey", kind.alias("kind"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'malformed diagram envelope: line 1: x' WHEN p_partkey % 5 = 1 THEN 'agent reported not convertible' WHEN p_size * 2 < 80 THEN 'confidence ' || p_size * 2 || ' < 80'
WHEN p_size % 2 = 1 THEN 'pie diagram has no body' WHEN p_partkey % 7 = 0 THEN 'verifier rejected Mermaid (fidelity 40)' ELSE '' END AS reason FROM part""")
def figure_conversion(read):
    key, size = F.col("p_partkey"), F.col("p_size")
    parsed = {"error": F.when(key % 5 == 0, "line 1: x"), "convertible": key % 5 != 1, "mermaid": F.when(size % 2 == 0, "pie\n a").otherwise("pie"), "diagram_type": F.lit("pie"), "confidence": size * 2}
    out = D.conversion(parsed, allowed=F.array(*map(F.lit, D.ALLOWED)), verify=F.lit(True), approved=key % 7 != 0, fidelity=F.lit(40))
    return read("part").select("p_partkey", out["reason"].alias("reason"))


@query("SELECT p_partkey, (p_size * 3)::BIGINT AS width, 17::BIGINT AS height FROM part")
def png_header(read):
    four = lambda n: F.unhex(F.lpad(F.hex(n), 8, "0"))
    content = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), four(F.col("p_size") * 3), four(F.lit(17)), F.unhex(F.lit("0806")))
    return read("part").select("p_partkey", G.png_size(content).alias("s")).select("p_partkey", "s.*")


@query("SELECT vec_id, round_even(x0, 0)::BIGINT AS x0, greatest(0, round_even(x1, 0)::BIGINT - round_even(x0, 0)::BIGINT) AS width, x0 >= 0 AND y0 >= 0 AND x1 <= 60 AND y1 <= 60 AS valid FROM (" + _BOXES + ")")
def crop_boxes(read):
    b = G.box("")
    return _boxes(read).select("vec_id", G.rounded_box(b).alias("r"), G.crop_valid(b, F.lit(60), F.lit(60)).alias("valid")).select("vec_id", "r.x0", "r.width", "valid")
