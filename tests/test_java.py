"""The Java reader and the detectors."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnlens.operators.detectors import analyse, mapper_xml
from tarnlens.sources import java


def found(body: str, spring: bool = True) -> list[tuple[str, str]]:
    return [(f.type, f.function) for f in analyse("A.java", "class A {" + body + "}", spring)]


def test_intervals_nest():
    root = java.parse("class A { int f(int a) { return g(a + 1, new B() { void h() { } }); } }")
    rows = list(java.rows("A.java", root))
    for r in rows:
        if r[3] is not None:
            assert rows[r[3]][1] < r[1] <= r[2] <= rows[r[3]][2]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc {}();=+<>.,\"'@[]?:-\n", max_size=120))
def test_reader_never_raises(text):
    list(java.rows("x", java.parse("class A { void f() { " + text + " } }")))


def test_deep_nesting():
    root = java.parse("class A { int f() { return " + "(" * 2000 + "1" + ")" * 2000 + "; } int g() { return 1; } }")
    assert "g" in [n.get("name").text for n in root.of("method_declaration")]


def test_syntax_forms():
    root = java.parse('class A<T> implements I<T> { @X(1) <R> R f(final List<? extends T> a, int... b) { for (T t : a) g(t); String s = """\n<b>"""; return (R) h.k().m[0]; } enum E { P, Q } record R(int x) { } interface I { void z(); } }')
    assert not list(root.of("ERROR"))
    assert [n.get("name").text for n in root.of("method_declaration")] == ["f", "z"]


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ('void q(String a) { String s = "SELECT " + a; st.executeQuery(s); }', [("SQL_INJECTION", "q")]),
        ('void q(String a) { st.executeQuery(String.format("SELECT %s", a)); }', [("SQL_INJECTION", "q")]),
        ('void q(String a) { log.info("SELECT " + a); }', []),
        ('void q(String a) { String s = "SELECT " + 1; st.execute(s); }', []),
        ('void q(String a) { /* SELECT */ String s = "x" + a; st.execute(s); }', []),
        ('@Select("SELECT * FROM t WHERE a = ${a}") T q(String a);', [("SQL_INJECTION", "q")]),
        ('@Select("SELECT * FROM t WHERE a = #{a}") T q(String a);', []),
        ('void x(@RequestParam String a) { out.print("<b>" + a); }', [("XSS", "x")]),
        ('void x(@RequestParam String a) { out.print("<b>" + htmlEscape(a)); }', []),
        ("void p(R req) { Cookie[] all = req.getCookies(); for (Cookie c : all) { String v = c.getValue(); new File(v); } }", [("PATH_TRAVERSAL", "p")]),
        ("void p(R req) { Header[] all = load(); for (Header c : all) { String v = c.getValue(); new File(v); } }", []),
        ('void p(@RequestParam String a) { Path t = base.resolve(a).normalize(); if (!t.startsWith(base)) return; new File(t.toString()); }', []),
        ('void p(@RequestParam String a) { Path t = base.resolve(a).normalize(); if (!t.startsWith(base)) return; new File(a); }', [("PATH_TRAVERSAL", "p")]),
        ('void p(@RequestParam String a) { Path t = base.resolve(a); if (!t.startsWith(base)) return; new File(t.toString()); }', [("PATH_TRAVERSAL", "p")]),
        ('void p(@RequestParam String a) { new FileReader(new File(a)); }', [("PATH_TRAVERSAL", "p")]),
        ('void p(R req) { String v = req.getHeader("x"); v = "fixed"; new File(v); }', []),
        ("void c(@RequestParam String a) { List<String> l = new ArrayList<>(); l.add(a); new ProcessBuilder(l); }", [("COMMAND_INJECTION", "c")]),
        ("void c(@RequestParam String a) { if (!allowed.contains(a)) return; new ProcessBuilder(a); }", []),
        ("String makeToken() { Random r = new Random(); return r.next(); }", [("INSECURE_RANDOM", "makeToken")]),
        ("int rollDice() { Random r = new Random(); return r.next(); }", []),
        ('byte[] h(String password) { MessageDigest md = MessageDigest.getInstance("SHA-256"); return md.digest(password.getBytes()); }', [("WEAK_HASH", "h")]),
        ('byte[] h(String password) { MessageDigest md = MessageDigest.getInstance("SHA-256"); md.update(salt); return md.digest(password.getBytes()); }', []),
        ('byte[] h(byte[] data) { return MessageDigest.getInstance("sha_1").digest(data); }', [("WEAK_HASH", "h")]),
        ("void u(MultipartFile f) { f.transferTo(p); }", [("DANGEROUS_FILE_UPLOAD", "u")]),
        ('void x(@RequestParam String a) { resp.setContentType("text/html"); out.format(a); }', [("XSS", "x")]),
        ('void x(@RequestParam String a) { out.format(a); }', []),
        ('void x(@RequestParam String a) { a = null; out.print("<b>" + a); }', [("XSS", "x")]),
        ('byte[] h(byte[] data) { return MessageDigest.getInstance("SHA-256").digest(data); }', []),
        ('void b() { String v = "7e5tc4s3"; DriverManager.getConnection(u, n, v); }', [("HARDCODED_SECRET", "b")]),
        ('void b() { String v = "foo"; DriverManager.getConnection(u, n, v); }', []),
        ('void b() { String v = "7e5tc4s3"; v = load(); DriverManager.getConnection(u, n, v); }', []),
        ('String dbPassword = "${DB_PASSWORD}";', []),
    ],
)
def test_rules(body, want):
    assert found(body) == want


def test_framework_parameters_are_no_sources_in_one_file():
    assert found('void x(@RequestParam String a) { out.print("<b>" + a); }', spring=False) == []


def test_mapper():
    text = '<mapper><select id="a">SELECT ${x}</select><!-- <select id="b">SELECT ${x}</select> --><select id="c">SELECT #{x}</select></mapper>'
    assert [f.function for f in mapper_xml(text)] == ["a"]


def test_folder(spark, tmp_path):
    from tarnlens.plans import analysis, fixtures

    for name, text in fixtures.SOURCES.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "shop/pom.xml").write_text("<project/>")
    rows = analysis.analyze(spark, str(tmp_path)).orderBy("id").collect()
    assert [(r.id, r.type, r.line, r.function, r.confidence) for r in rows] == [(i, t, n, m, c) for i, t, _, n, m, c in fixtures.EXPECTED]
    assert rows[0].snippet.split("\n")[3].startswith("> ")
