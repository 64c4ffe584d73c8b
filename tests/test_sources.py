"""Archives and reports."""

import io
import zipfile

import pytest

from tarnlens.plans import analysis, catalogue, catalogue_project, enrich, fixtures, report  # noqa: F401
from tarnlens.sources import archive


def packed(files: dict[str, str], **attributes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            info = zipfile.ZipInfo(name)
            info.external_attr = attributes.get(name, 0)
            z.writestr(info, text)
    return out.getvalue()


@pytest.mark.parametrize(("files", "attributes", "said"), [({}, {}, "empty"), ({"../a.java": ""}, {}, "leaves"), ({"/a.java": ""}, {}, "leaves"), ({"a\\..\\..\\b.java": ""}, {}, "leaves"), ({"a.java": "x"}, {"a.java": 0o120777 << 16}, "link")])
def test_guards(files, attributes, said):
    with pytest.raises(archive.ArchiveError, match=said):
        list(archive.members(packed(files, **attributes)))


def test_limits(monkeypatch):
    monkeypatch.setattr(archive, "MAX_MEMBERS", 1)
    with pytest.raises(archive.ArchiveError, match="more than 1 files"):
        list(archive.members(packed({"a": "", "b": ""})))
    monkeypatch.setattr(archive, "MAX_MEMBERS", 9)
    monkeypatch.setattr(archive, "MAX_BYTES", 3)
    with pytest.raises(archive.ArchiveError, match="more than 3 bytes"):
        list(archive.members(packed({"a": "xxxx"})))
    with pytest.raises(archive.ArchiveError, match="not a zip"):
        list(archive.members(b"no"))


def test_root_and_names():
    assert archive.source_root(["p/a.java", "p/q/b.xml", "__MACOSX/x"]) == "p/"
    assert archive.source_root(["p/a.java", "readme"]) == "" and archive.source_root(["p/a.txt"]) == ""
    assert archive.repository("https://github.com/a-b/c.d.git") == ("a-b", "c.d") and archive.repository("http://x/y") is None
    assert archive.branch_candidates("main") == ["main", "master"]


def test_archive_to_report(spark, tmp_path):
    (tmp_path / "one.zip").write_bytes(packed({f"top/{k}": v for k, v in fixtures.SOURCES.items()}))
    files = archive.read_archives(spark, str(tmp_path))
    found = analysis.prioritize(analysis.findings(files)).cache()
    assert [(r.id, r.file) for r in found.orderBy("id").collect()] == [(i, f) for i, _, f, *_ in fixtures.EXPECTED]
    top = report.overview(found, analysis.scores(found, files)).first()
    assert (top.findings, top.impacted_files, top.overall) == (10, 4, 75)
    assert report.by_type(found).count() == 8
    assert {r.file: r.lines for r in report.file_table(found).collect()}["shop/Tools.java"] == "8, 18, 28, 32 +1"
    assert report.file_detail(found, "other/Tools.java").count() == 5 and report.file_detail(found, "shop/Page.java").count() == 2
    full = report.with_reports(enrich.enriched(found, catalogue_project._guides(spark), "https://github.com/org/shop", "main")).cache()
    assert full.columns == [c for c, _ in enrich.FIELDS] and enrich.invalid(full).isEmpty()
    one = full.filter("id = 'VULN-001'").first()
    assert "```java" in one.finding_report.markdown and "```diff" in one.finding_report.proposed_patch and one.finding_report_status == "static_fallback"
    short = report.compact(full).filter("id = 'VULN-006'").first()
    assert short.finding_report_title.startswith("cross-site scripting in greet") and 200 < len(short.finding_report_markdown_preview) <= 221


def test_guards_of_a_folder(spark, tmp_path, monkeypatch):
    (tmp_path / "A.java").write_text("class A {}")
    (tmp_path / "B.java").write_text("class B { " + " " * 200 + "}")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert archive.guarded(files).count() == 2
    monkeypatch.setattr(archive, "MAX_JAVA_BYTES", 100)
    with pytest.raises(Exception, match="has more than 100 bytes"):
        archive.guarded(files).collect()
    monkeypatch.setattr(archive, "MAX_MEMBERS", 1)
    with pytest.raises(archive.ArchiveError, match="more than 1 Java files"):
        archive.guarded(files)
    with pytest.raises(archive.ArchiveError, match="no Java files"):
        archive.guarded(files.limit(0))
