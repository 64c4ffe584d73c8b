"""Flows across files, stores, guidelines, jobs."""

import pytest
from pyspark.sql import functions as F

from tarnlens.operators import closure, flows, guidelines
from tarnlens.sources.store import ResultStore, upsert_users
from tarnlens.streaming import jobs

PROJECT = {
    "Web.java": """class Web {
      private Finder finder;
      void search(@RequestParam String q) { finder.find(q); }
      void safe(@RequestParam String q) { finder.find("fixed"); }
      void run(@RequestParam String q) { Shell s = new Shell(); s.first(q); }
    }""",
    "Finder.java": "interface Finder { void find(String name); }",
    "FinderImpl.java": """class FinderImpl implements Finder {
      private Dao dao;
      public void find(String name) { dao.load(name, 1); }
    }""",
    "Dao.java": """class Dao {
      void load(String key, int n) { String sql = "SELECT * FROM t WHERE k = '" + key + "'"; st.executeQuery(sql); }
      void load(int n) { st.executeQuery("SELECT 1"); }
    }""",
    "Shell.java": """class Shell {
      void first(String a) { second(a); }
      void second(String b) { Runtime.getRuntime().exec(b); }
    }""",
}


def test_flows_across_files(spark):
    files = spark.createDataFrame(list(PROJECT.items()), "file string, content string")
    rows = sorted((r.type, r.function, tuple(r.call_chain)) for r in flows.cross_method_findings(files).collect())
    assert rows == [
        ("COMMAND_INJECTION", "run", ("Web.run", "request parameter `q` → `q` → `a`", "Shell.first", "Shell.second", "command variable `b`", "Runtime.exec(...)")),
        ("SQL_INJECTION", "search", ("Web.search", "request parameter `q` → `q` → `name`", "FinderImpl.find", "Dao.load", "SQL variable `sql`", "st.executeQuery")),
    ]


def test_flows_need_a_callee_that_is_known(spark):
    """Two methods of one name and arity leave a call open; a callee that calls itself comes to an end."""
    two = "class A { void in(@RequestParam String q) { x.go(q); } }\nclass B { void go(String a) { Runtime.getRuntime().exec(a); } }\nclass C { void go(String a) { } }"
    own = "class D { void in(@RequestParam String q) { again(q); } void again(String a) { again(a); Runtime.getRuntime().exec(a); } }"
    files = lambda text: spark.createDataFrame([("A.java", text)], "file string, content string")
    assert flows.cross_method_findings(files(two)).count() == 0
    assert [r.function for r in flows.cross_method_findings(files(own)).collect()] == ["in"]
    assert flows.cross_method_findings(files("")).count() == 0


def test_a_bound_that_is_reached_is_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "src int, dst int")
    assert closure.transitive(edges).count() == 40 * 41 // 2
    step = lambda delta, everything: delta.selectExpr("src", "dst + 1 AS dst").filter("dst < 30")
    with pytest.raises(RuntimeError, match="still new"):
        closure.fixpoint(edges.limit(1), step, ["src", "dst"], max_rounds=3)


def test_flows_through_long_chains(spark):
    """A sink twenty calls below its source, and calls that go round in a circle."""
    links = "\n".join(f"void m{i}(String a) {{ m{i + 1}(a); }}" for i in range(1, 20))
    chain = "class Chain {\n void in(@RequestParam String q) { m1(q); }\n" + links + "\n void m20(String a) { Runtime.getRuntime().exec(a); m1(a); }\n}"
    (found,) = flows.cross_method_findings(spark.createDataFrame([("Chain.java", chain)], "file string, content string")).collect()
    assert found.function == "in" and list(found.call_chain[:-2]) == ["Chain.in", "request parameter `q` → `q` → `a`", *(f"Chain.m{i}" for i in range(1, 21))]


def test_store(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "results"))
    assert store.list_results(1).count() == 0
    a, b, c = store.save(1, "{}"), store.save(2, "{}"), store.save(2, "{}", public=True)
    assert [r.analysis_id for r in store.list_results(1).collect()] == [c, a]
    assert store.list_results(1, 0).count() == 0 and store.get_latest(2).first().analysis_id == c
    assert store.get(b, 1).count() == 0 and store.get(b, 2).count() == 1
    assert not store.update(b, 1, '{"x": 1}') and store.update(b, 2, '{"x": 1}')
    assert store.get(b, 2).first().result_json == '{"x": 1}'
    assert store.set_visibility(b, True) and store.get(b, 1).count() == 1 and not store.set_visibility("none", True)


def test_users(spark):
    old = spark.createDataFrame([("1", "ann"), ("2", "bob")], "github_id string, github_login string")
    new = spark.createDataFrame([("1", "anna")], "github_id string, github_login string")
    assert {tuple(r) for r in upsert_users(old, new).collect()} == {("1", "anna"), ("2", "bob")}


def test_guidelines(spark):
    book = spark.createDataFrame([("g1", "input", "SQL", 178, ["SQL_INJECTION"], "o", "m"), ("g2", "input", "XSS", 200, ["XSS"], "o", "m"), ("g3", "input", "SQL", 100, [], "o", "m")], "id string, category string, item string, page_start int, detector_types array<string>, overview string, security_measures string")
    found = spark.createDataFrame([("sql_injection", "SQL", "input"), ("OTHER", "none", "input")], "type string, guide_item string, guide_category string")
    rows = {r.type: ([x.id for x in r.guideline_refs], r.guideline_grounding_status) for r in guidelines.attach(found, book).collect()}
    assert rows == {"sql_injection": (["g1", "g3"], "matched"), "OTHER": ([], "missing")}
    assert [r.page_end for r in guidelines.page_ends(book, 472).orderBy("page_start").collect()] == [177, 199, 472]
    assert guidelines.search(book, "sql", 1).first().id == "g3" and guidelines.by_detector(book, "xss").first().id == "g2"


def test_verify(spark):
    rows = spark.createDataFrame([("see A.java line 3", ["g1"], ["g1"], "src/A.java", [3]), ("see B.java line 9", ["g9"], ["g1"], "src/A.java", [3])], "text string, cited_ids array<string>, ref_ids array<string>, file string, lines array<int>")
    got = guidelines.verify(rows).orderBy("text").collect()
    assert got[0].grounded and (got[1].unknown_ids, got[1].unknown_files, got[1].unknown_lines) == (["g9"], ["B.java"], [9])


def test_jobs_in_batch_and_stream(spark, tmp_path):
    rows = [("j", 1, 1, "running", "scan", "m", 5, None, None, None, None, None), ("j", 1, 2, "running", None, None, 50, 3, None, None, "a", None), ("j", 1, 3, "failed", None, None, None, None, None, None, None, "e"), ("k", 2, 1, "queued", "queued", None, 0, None, None, None, None, None)]
    spark.createDataFrame(rows, jobs.SCHEMA).write.parquet(str(tmp_path / "log"))
    batch = jobs.fold_jobs(spark.read.parquet(str(tmp_path / "log")))
    assert {r.job_id: (r.status, r.phase, r.percent, r.analysis_id, r.error) for r in batch.collect()} == {"j": ("failed", "scan", 50, None, "e"), "k": ("queued", "queued", 0, None, None)}
    assert jobs.owned(batch, "j", 2).count() == 0
    query = jobs.stream_jobs(spark.readStream.schema(jobs.SCHEMA).parquet(str(tmp_path / "log")), "jobs", str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("jobs").select(*batch.columns).collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)
