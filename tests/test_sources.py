import json
import logging

import pytest

from quire.plans import monitor
from quire.sources import documents as D
from quire.sources import workspace as W
from quire.sources.settings import Settings, load, overridden


class Fake:
    """Documents as JSON: {"pages": [text, ...], "encrypted": bool}."""

    def open(self, content):
        own = json.loads(content)
        return D.Document([D.Page(text=t, images=[(5, "png", b"a", None), (5, "png", b"a", None), (6, "png", b"m", None)], masks=[6], spans=[(t, 0.0, 0.0, 1.0, 1.0)]) for t in own["pages"]], {"title": "t"}, own.get("encrypted", False))

    def render(self, content, page, dpi):
        return f"{page}@{dpi}".encode()

    def crop(self, png, box):
        return bytes(box)

    def shrink(self, image, ext, edge):
        raise ValueError


@pytest.fixture
def files(spark, tmp_path):
    for name, body in {"good": {"pages": ["x" * 60, "b"]}, "scan": {"pages": [" ", ""]}, "locked": {"pages": ["a"], "encrypted": True}, "long": {"pages": ["p"] * 9}, "none": {"pages": []}}.items():
        (tmp_path / f"{name}.pdf").write_text(json.dumps(body))
    (tmp_path / "bad.pdf").write_bytes(b"\x00junk")
    (tmp_path / "big.pdf").write_bytes(b" " * 5000)
    return D.files(spark, str(tmp_path))


def test_preflight(files):
    got = {r.path.rsplit("/", 1)[1][:-4]: r for r in D.preflight(files, Fake(), max_mb=0.002, max_pages=5).collect()}
    assert got["good"].valid and got["good"].born_digital and got["good"].page_count == 2 and got["good"].metadata == {"title": "t"}
    assert got["scan"].valid and not got["scan"].born_digital
    errors = {k: r.error for k, r in got.items() if not r.valid}
    assert "exceeds cap" in errors["big"] and "corrupt" in errors["bad"] and "password" in errors["locked"] and "page count 9" in errors["long"] and "no pages" in errors["none"]


def test_scans(spark, files):
    assert D.native_pages(files, Fake()).where("path like '%good%'").count() == 2
    assert D.native_pages(files, Fake()).where("path like '%bad%'").count() == 0
    images = D.native_images(files, Fake()).where("doc_id like '%good%'").collect()
    assert [(r.page_number, r.xref, bytes(r.data)) for r in images] == [(1, 5, b"a"), (2, 5, b"a")]
    assert D.text_spans(files, Fake()).where("doc_id like '%good%'").count() == 2
    path = files.where("path like '%good%'").first().path
    wanted = spark.createDataFrame([(path, 1, 200), (path, 0, 200), (path, 9, 200), (path, 1, 500)], "path string, page_number int, dpi int")
    got = {(r.page_number, r.dpi): (r.png and bytes(r.png), r.error) for r in D.rendered(files, wanted, Fake()).collect()}
    assert got[1, 200] == (b"1@200", None) and all(got[k][1] for k in ((0, 200), (9, 200), (1, 500)))
    renders = spark.createDataFrame([(path, 1, b"png", 100, 50)], "path string, page_number int, png binary, width int, height int")
    boxes = spark.createDataFrame([(path, 1, 0, 1.0, 2.0, 3.0, 4.0), (path, 1, 1, 9.0, 2.0, 3.0, 4.0)], "path string, page_number int, idx int, x0 double, y0 double, x1 double, y1 double")
    assert {r.idx: r.png and bytes(r.png) for r in D.crops(renders, boxes, Fake()).collect()} == {0: bytes([1, 2, 3, 4]), 1: None}


def test_settings(tmp_path):
    (tmp_path / ".env").write_text("RENDER_DPI=150\n# x\nOCR_ENABLED=off\nAGENT_API_KEY='secret'\n")
    own = load(str(tmp_path / ".env"), {"RENDER_DPI": "300"})
    assert (own.render_dpi, own.ocr_enabled, own.shown()["agent_api_key"]) == (300, False, "***") and "secret" not in repr(own)
    for bad in ({"render_dpi": 10}, {"coverage_floor": 1.5}, {"diagram_fallback": "x"}, {"thinking_diagram": "medium"}, {"diagram_types": ("no",)}):
        with pytest.raises(ValueError):
            Settings(**bad)
    assert overridden(own, {"render_dpi": 100, "toc_enabled": 1, "unknown": 2, "agent_api_key": "x"}) == overridden(own, {"render_dpi": 100})


def test_workspace(tmp_path):
    w = W.Workspace(tmp_path / "w")
    (w.job("j", "renders") / "a").write_text("x")
    for bad in ("..", "a/b", "", "a\\b"):
        with pytest.raises(W.UnsafePath):
            w.job(bad)
    assert w.clean("j") and not (tmp_path / "w" / "j").exists()
    (w.job("k") / W.MARKER).touch()
    assert w.clean_marked() == 1
    with pytest.raises(ValueError):
        W.output_dir("relative")
    assert W.output_dir(str(tmp_path / "new")).is_dir()


def test_deliverable(tmp_path):
    assets = tmp_path / "assets"
    assets.mkdir()
    (assets / "p.png").write_bytes(b"1")
    out = tmp_path / "out"
    W.write_deliverable(out, "a", "![x](assets/p.png)", assets, "r1")
    (out / "a" / "assets" / "stale.png").write_bytes(b"2")
    got = W.write_deliverable(out, "a", "![x](assets/p.png)", assets, "r2")
    W.write_deliverable(out, "b", "t", tmp_path / "missing", "r")
    assert got["document"].read_text() == "![x](a/assets/p.png)" and [p.name for p in got["assets"].iterdir()] == ["p.png"] and got["report"].read_text() == "r2"
    for bad in ("", ".", "..", "a/b", "a\\b"):
        with pytest.raises(ValueError):
            W.docname(bad)
    assert W.artifact(None, out / "no", out / "a.md") == out / "a.md" and W.folders(str(out)) == ["a", "b"]


def test_health_and_options(tmp_path):
    from quire.sources import settings as S

    def down():
        raise ConnectionError("host:port")

    own = S.Settings(agent_api_key="k")
    calls = dict(version=lambda: "1.2", local_models=lambda: ["ocr"], remote_models=lambda: ["other"], ask_database=down)
    got = {r["name"]: r for r in W.probe(monitor.health_checks(own, str(tmp_path), **calls))}
    assert [got[n]["ok"] for n in ("recognition", "local_models", "agent", "database")] == [True, True, False, False] and got["database"]["detail"] == "ConnectionError"
    assert {r["name"]: r for r in W.probe(monitor.health_checks(S.Settings(), str(tmp_path), **calls))}["agent"]["detail"] == "PermissionError"
    assert S.options(None) == {} and S.options('{"render_dpi": 300}') == {"render_dpi": 300}
    for bad in ("[1]", "{", "3"):
        with pytest.raises(ValueError):
            S.options(bad)


def test_probes_and_logs(tmp_path, capsys):
    def broken():
        raise RuntimeError("secret")

    got = W.probe({"disk": lambda: W.disk_probe(str(tmp_path), 1), "db": broken})
    assert [g["ok"] for g in got] == [True, False] and "secret" not in str(got)
    logger = monitor.configure(as_json=True)
    with monitor.stage("ocr", job="j"):
        logger.info("hello")
    lines = [json.loads(x) for x in capsys.readouterr().err.splitlines() if x.startswith("{")]
    assert lines[0]["stage"] == "ocr" and lines[0]["job"] == "j" and "duration_ms" in lines[1]
    logging.getLogger("quire").handlers.clear()
