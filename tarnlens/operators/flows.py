"""Flows across methods and files: facts of each method, and fixed points of joins over them.

One pass over each file yields, method by method in text order, which origins its expressions hold. An origin is a
parameter, a request source, or the value of a call, which only the project can tell. Calls are resolved by joins; then

- what a call's value holds follows from what its callee returns: returned(callee, place) joined to held(argument, origin);
- what a method passes on to a sink makes it a sink itself: sinks(callee, place) joined to held(argument, parameter);
- a call whose argument holds a source, and whose callee is such a sink, is a finding.

Both fixed points only add rows, which are finite by key, so they end however long a chain is. A callee that is known but
returns none of its parameters blocks a flow, as one that masks a value should.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlens.functions import rules as R
from tarnlens.operators import closure
from tarnlens.operators.detectors import Finding, Unit, allowed_values, annotated_statement, builders_of, calls, chain_details, checked_paths, command_sink, concatenates, context, file_sink, framework_labels, function_of, has_sql, identifiers, joins, label, member_label, name_of, normalises, parameters, sink_name, upload_stores, uploads_of, written
from tarnlens.sources.java import Node
from tarnlens.sources.tables import settled

#: How values are followed: "sql" by what calls return, "plain" through any expression, "html" but for escaped ones.
FLAVOURS = ("sql", "plain", "html")
KINDS = {"SQL_INJECTION": "sql", "PATH_TRAVERSAL": "plain", "COMMAND_INJECTION": "plain", "DANGEROUS_FILE_UPLOAD": "upload"}
FACT = "record string, kind string, file string, method int, call int, pos int, class string, name string, arity int, target string, origin string, of int, line int, label string, sink string, steps array<string>"

#: ("param", place, None), ("source", -1, label) or ("value", call, None)
Origin = tuple[str, int, str | None]


def declared_type(n: Node) -> str | None:
    """A declaration's type without its arguments and brackets."""
    made = n.get("type")
    return made.text.split("<")[0].split("[")[0].strip() or None if made is not None else None


def field_types(cls: Node) -> dict[str, str]:
    """Types of a class's fields; a field that a constructor sets from a parameter has its declared type or the parameter's."""
    out: dict[str, str] = {}
    for n in cls.of("field_declaration"):
        if n.above("class_declaration") is cls and (made := declared_type(n)):
            out.update({name_of(c): made for c in n.children if c.kind == "variable_declarator"})
    injected: dict[str, str] = {}
    for made in cls.of("constructor_declaration"):
        given = {name_of(p): declared_type(p) for p in made.of("formal_parameter")}
        for n in made.of("assignment_expression"):
            left, right = n.get("left"), n.get("right")
            if left is None or right is None or right.kind != "identifier" or not given.get(right.text):
                continue
            field = left.get("field").text if left.kind == "field_access" and left.get("field") is not None else left.text if left.kind == "identifier" else None
            if field:
                injected[field] = out.get(field, given[right.text])
    return out | injected


def variable_types(method: Node) -> dict[str, str]:
    """Types of the fields and locals that a method sees, by name; locals win."""
    cls = method.above("class_declaration")
    out = field_types(cls) if cls is not None else {}
    for n in method.of("local_variable_declaration"):
        if made := declared_type(n):
            out.update({name_of(c): made for c in n.children if c.kind == "variable_declarator"})
    return out


class MethodFlow:
    """The facts of one method, gathered in one walk over it."""

    def __init__(self, unit: Unit, at: int, method: Node):
        self.unit, self.at, self.method = unit, at, method
        self.nodes = unit.nodes(method)
        self.names = [name_of(p) for p in parameters(method)]
        self.calls = {id(n): i for i, n in enumerate(n for n in self.nodes if n.kind == "method_invocation")}
        self.labels: dict[str, str] = framework_labels(method)
        self.held: dict[str, dict[str, tuple[Origin, ...]]] = {f: {v: (("param", i, None), *((("source", -1, self.labels[v]),) if v in self.labels else ())) for i, v in enumerate(self.names)} for f in FLAVOURS}

    def origins(self, n: Node | None, flavour: str) -> tuple[Origin, ...]:
        if n is None:
            return ()
        if flavour == "sql" and n.kind == "method_invocation" and calls_itself(n, R.HTTP_SOURCES) is None:
            return (("value", self.calls[id(n)], None),) if id(n) in self.calls else ()
        return self.read(n, flavour)

    def read(self, n: Node, flavour: str) -> tuple[Origin, ...]:
        """What all names in an expression hold, and request calls in it."""
        env = self.held[flavour]
        found: dict[tuple[str, int], Origin] = {}
        call = calls(n, R.HTTP_SOURCES)
        if call is not None:
            found["source", -1] = ("source", -1, f"`{call.text}`")
        used = [v for v in identifiers(n) if v in env]
        shown = {v: o[2] for v in used for o in env[v] if o[0] == "source"}
        told = member_label(n, {v: x or f"`{v}`" for v, x in shown.items()})
        for v in used:
            for kind, of, text in env[v]:
                found.setdefault((kind, of), (kind, of, told or text if kind == "source" else None))
        return tuple(found.values())

    def write(self, var: str, value: Node) -> None:
        for flavour in FLAVOURS:
            got = () if flavour == "html" and calls(value, R.XSS_SANITIZERS) is not None else self.origins(value, flavour)
            if got:
                self.held[flavour][var] = got
            elif not (flavour == "html" and value.kind == "null_literal"):
                self.held[flavour].pop(var, None)

    def facts(self) -> Iterator[dict]:
        me = {"method": self.at}
        method = self.method
        yield me | {"record": "method", "kind": "body" if method.get("body") is not None else "none", "class": type_around(method), "name": name_of(method), "arity": len(self.names), "line": method.line, "label": label(method), "target": name_of(method.above("class_declaration")), "steps": self.names}
        if (mapped := annotated_statement(method)) is not None:
            sink, put = mapped
            for v in put:
                yield me | {"record": "sink", "kind": "SQL_INJECTION", "call": -1, "origin": "param", "of": self.names.index(v), "line": method.line, "sink": sink, "steps": [sink]}
        yield from self.uploads(me)
        types = variable_types(method)
        sql: dict[str, tuple[Origin, ...]] = {}
        made_html: dict[str, list[Origin]] = {}
        normal: set[str] = set()
        checked: set[str] = set()
        lists: dict[str, tuple[Origin, ...]] = {}
        cleared: set[str] = set()
        builders = builders_of(self.nodes)
        sinks = 0
        for n in self.nodes:
            for var, value, _ in written(n):
                used = [v for v in identifiers(value) if v in made_html]
                self.write(var, value)
                sql.pop(var, None)
                if has_sql(value) and joins(value) and (got := self.origins(value, "sql")):
                    sql[var] = got
                self.note_html(var, value, used, made_html)
                plain = self.held["plain"].get(var)
                (normal.add if plain and normalises(value) else normal.discard)(var)
                if not plain:
                    checked.discard(var)
                    cleared.discard(var)
            if n.kind == "return_statement" and n.children:
                yield from self.returned(n, n.children[0], made_html, me)
            args, base = n.get("arguments"), n.get("object")
            if n.kind not in ("method_invocation", "object_creation_expression"):
                continue
            plain = self.held["plain"]
            checked |= checked_paths(n, plain, normal)
            cleared |= allowed_values(n, plain)
            if args is None:
                continue
            if n.kind == "method_invocation" and name_of(n) in ("add", "addAll") and base is not None and (got := self.read(args, "plain")):
                lists[base.text] = got
            for kind, got, sink, steps in self.reached(n, args, sql, checked, lists, cleared, builders):
                sinks += 1
                for what, of, text in got:
                    yield me | {"record": "sink", "kind": kind, "call": sinks, "origin": what, "of": of, "line": n.line, "sink": sink, "steps": [*steps, sink], "label": text}
            if n.kind == "method_invocation":
                yield from self.called(n, args.children, base, types, me)
                yield from self.printed(n, args, made_html, me)

    def uploads(self, me: dict) -> Iterator[dict]:
        for k, (n, sink, uploads, controls) in enumerate(upload_stores(self.unit, self.method)):
            missing = [text for ok, text in controls.values() if not ok]
            given = [v for v in uploads if v in self.names]
            for v in given:
                yield me | {"record": "sink", "kind": "DANGEROUS_FILE_UPLOAD", "call": 1_000_000 + k, "origin": "param", "of": self.names.index(v), "line": n.line, "sink": sink, "steps": [f"{', '.join(given)} → {sink}", *missing]}

    def note_html(self, var: str, value: Node, used: list[str], made_html: dict[str, list[Origin]]) -> None:
        """Whether a variable now holds markup with something unescaped in it: joined here, or the value of a call."""
        made_html.pop(var, None)
        if calls(value, R.XSS_SANITIZERS) is not None:
            return
        got = [("value", self.calls[id(value)], None)] if id(value) in self.calls else []
        if self.read(value, "html") and ("<" in value.text or ">" in value.text) and concatenates(value):
            got += [o for o in self.read(value, "html")]
        elif not got and used:
            got = made_html.get(used[0], [])
        if got:
            made_html[var] = got

    def returned(self, n: Node, value: Node, made_html: dict[str, list[Origin]], me: dict) -> Iterator[dict]:
        for what, of, text in self.origins(value, "sql"):
            yield me | {"record": "return", "kind": "sql", "origin": what, "of": of, "label": text, "line": n.line}
        if calls(value, R.XSS_SANITIZERS) is not None:
            return
        used = next((v for v in identifiers(value) if v in made_html), None)
        if id(value) in self.calls:
            got = [("value", self.calls[id(value)], None)]
        elif used is not None:
            got = made_html[used]
        else:
            got = self.read(value, "html") if ("<" in value.text or ">" in value.text) and concatenates(value) else ()
        for what, of, text in got:
            yield me | {"record": "return", "kind": "html", "origin": what, "of": of, "label": text, "line": n.line}

    def reached(self, n: Node, args: Node, sql, checked, lists, cleared, builders) -> Iterator[tuple[str, tuple[Origin, ...], str, list[str]]]:
        """(kind, origins, sink, steps) of the sinks that a call or a creation is."""
        if n.kind == "method_invocation" and name_of(n) in R.SQL_SINKS:
            var = next((v for v in identifiers(args) if v in sql), None)
            if var is not None:
                yield "SQL_INJECTION", sql[var], sink_name(n), [f"SQL variable `{var}`"]
            elif has_sql(args) and joins(args):
                yield "SQL_INJECTION", self.read(args, "sql"), sink_name(n), []
        plain = self.held["plain"]
        used = [v for v in identifiers(args) if v in plain]
        if (sink := file_sink(n)) is not None and used and not any(v in checked for v in used):
            yield "PATH_TRAVERSAL", tuple({o[:2]: o for v in used for o in plain[v]}.values()), sink, [f"path variable `{used[0]}`"]
        if (sink := command_sink(n, builders)) is not None:
            taken = next((v for v in identifiers(args) if v in lists), None)
            if taken is not None:
                yield "COMMAND_INJECTION", lists[taken], sink, [f"list of arguments `{taken}`"]
            elif used and not any(v in cleared for v in used):
                yield "COMMAND_INJECTION", tuple({o[:2]: o for v in used for o in plain[v]}.values()), sink, [f"command variable `{used[0]}`"]

    def called(self, n: Node, args: list[Node], base: Node | None, types: dict[str, str], me: dict) -> Iterator[dict]:
        call = self.calls[id(n)]
        on = base.text.removeprefix("this.") if base is not None else None
        target = type_around(self.method) if base is None else types.get(on, on)
        yield me | {"record": "call", "call": call, "name": name_of(n), "arity": len(args), "target": target, "line": n.line, "label": n.text, "sink": function_of(n)}
        uploads = uploads_of(self.method)
        for pos, arg in enumerate(args):
            given = me | {"record": "argument", "call": call, "pos": pos, "name": arg.text}
            for flavour in FLAVOURS:
                got = () if flavour == "html" and calls(arg, R.XSS_SANITIZERS) is not None else self.origins(arg, flavour)
                for what, of, text in got:
                    yield given | {"kind": flavour, "origin": what, "of": of, "label": text}
            for v in uploads:
                if v in identifiers(arg):
                    yield given | {"kind": "upload", "origin": "source", "of": -1, "label": f"upload `{v}`"}
        # what the value holds where the callee isn't known: whatever the call mentions
        for what, of, text in self.read(n, "sql"):
            yield me | {"record": "value", "kind": "sql", "call": call, "origin": what, "of": of, "label": text}

    def printed(self, n: Node, args: Node, made_html: dict[str, list[Origin]], me: dict) -> Iterator[dict]:
        if name_of(n) in R.XSS_OUTPUTS and calls(args, R.XSS_SANITIZERS) is None:
            for v in identifiers(args):
                for what, of, _ in made_html.get(v, ()):
                    if what == "value":
                        yield me | {"record": "output", "kind": "XSS", "call": of, "line": n.line, "sink": sink_name(n), "name": v, "target": function_of(n)}


def type_around(n: Node) -> str | None:
    return name_of(n.above("class_declaration", "interface_declaration")) or None


def calls_itself(n: Node, names: tuple[str, ...]) -> Node | None:
    """The call itself, if it is one of these."""
    return n if name_of(n) in names else None


def facts(file: str, text: str) -> Iterator[dict]:
    """Rows of FACT: 'method', 'implements', 'call', and what holds which origin: 'argument', 'value', 'return', 'sink', 'output'."""
    unit = Unit(text)
    for n in unit.root.of("class_declaration"):
        for listed in n.children:
            if listed.kind == "super_interfaces":
                for t in dict.fromkeys(t.text.split("<")[0] for t in listed.children):
                    yield {"record": "implements", "class": name_of(n), "target": t}
    for at, method in enumerate(unit.methods):
        yield from MethodFlow(unit, at, method).facts()


def fact_table(files: DataFrame) -> DataFrame:
    names = [f.split()[0] for f in FACT.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
    types = [kinds[f.split()[1]] for f in FACT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column("file").to_pylist(), b.column("content").to_pylist(), strict=True):
                out = [r | {"file": file} for r in facts(file, content or "")]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in out], k) for n, k in zip(names, types, strict=True)], names=names)

    return files.filter(F.lower("file").endswith(".java")).select("file", "content").mapInArrow(run, FACT)


ME = ["file", "method"]


def method_table(table: DataFrame) -> DataFrame:
    """(file, method, class, name, arity, body, line, label, params): one row for each method declaration."""
    return table.filter("record = 'method'").select(*ME, "class", "name", "arity", (F.col("kind") == "body").alias("body"), "line", "label", F.col("steps").alias("params"), F.col("target").alias("in_class"))


def resolved_calls(table: DataFrame) -> DataFrame:
    """Calls (file, method, call, ...) with the method that they mean (to_file, to_method), or null.

    In order: the only method of the target class, the name and the arity, if it has a body; the only one with a body among
    the classes that implement the target; the only one of the class without a body; the only one of name and arity at all.
    """
    methods = method_table(table)
    to = F.struct(F.col("file").alias("file"), F.col("method").alias("method"))
    one = methods.groupBy("class", "name", "arity").agg(F.count(F.lit(1)).alias("n"), F.min(to).alias("to"), F.max("body").alias("body")).filter("n = 1 AND class IS NOT NULL").drop("n")
    listed = table.filter("record = 'implements'").select("class", F.col("target").alias("interface")).distinct()
    behind = listed.join(one.filter("body"), "class").groupBy(F.col("interface").alias("target"), "name", "arity").agg(F.when(F.count(F.lit(1)) == 1, F.min("to")).alias("behind"))
    alone = methods.groupBy("name", "arity").agg(F.when(F.count(F.lit(1)) == 1, F.min(to)).alias("alone"))
    here = one.select(F.col("class").alias("target"), "name", "arity", F.when(F.col("body"), F.col("to")).alias("whole"), F.col("to").alias("bare"))
    rows = table.filter("record = 'call'").select(*ME, "call", "name", "arity", "target", "line", F.col("label").alias("text"), F.col("sink").alias("function"))
    key = ["target", "name", "arity"]
    found = rows.join(here, key, "left").join(behind, key, "left").join(alone, ["name", "arity"], "left")
    meant = F.coalesce("whole", "behind", "bare", "alone")
    return found.select(*ME, "call", "line", "text", "function", F.col("name").alias("to_name"), meant["file"].alias("to_file"), meant["method"].alias("to_method"))


HOLD = ["what", *ME, "call", "pos", "origin", "of"]


def held_values(table: DataFrame, calls_: DataFrame) -> DataFrame:
    """What SQL arguments, returns and sinks hold once the values of calls are known: rows of HOLD with a label for sources."""
    known = calls_.filter("to_file IS NOT NULL").select(*ME, "call", "to_file", "to_method", "text", ((F.col("file") == F.col("to_file")) & (F.col("method") == F.col("to_method"))).alias("itself"))
    zero = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    sql = (F.col("kind") == "sql") | ((F.col("record") == "sink") & (F.col("kind") == "SQL_INJECTION"))
    base = table.filter(sql & F.col("record").isin("argument", "value", "return", "sink")).select(F.col("record").alias("what"), *ME, zero("call"), zero("pos"), "origin", "of", "label")
    base = settled(base.join(known.select(*ME, "call", F.lit(True).alias("known")), [*ME, "call"], "left").filter("what <> 'value' OR known IS NULL").drop("known"), "held")
    seed = base.filter("origin <> 'value'")
    via = base.filter("origin = 'value'").select("what", *ME, "call", "pos", F.col("of").alias("value"))
    passes = settled(known.filter("NOT itself").drop("itself"), "known")

    def step(delta: DataFrame, everything: DataFrame) -> DataFrame:
        args = lambda rows: rows.filter("what = 'argument'").join(passes, [*ME, "call"])
        rets = lambda rows: rows.filter("what = 'return' AND origin = 'param'").select(F.col("file").alias("to_file"), F.col("method").alias("to_method"), F.col("of").alias("pos")).distinct()
        on = ["to_file", "to_method", "pos"]
        met = args(delta).join(rets(everything), on).unionByName(args(everything).join(rets(delta), on))
        told = F.when(F.col("origin") == "source", F.concat(F.lit("`"), "text", F.lit("` return value ("), "label", F.lit(")")))
        values = met.select(F.lit("value").alias("what"), *ME, "call", F.lit(-1).alias("pos"), "origin", "of", told.alias("label"))
        new = delta.filter("what = 'value'").select(*ME, F.col("call").alias("value"), "origin", "of", "label")
        return values.unionByName(via.join(new, [*ME, "value"]).select(*HOLD, "label"))

    return closure.fixpoint(seed.select(*HOLD, "label"), step, HOLD, max_rounds=None)


def cross_method_findings(files: DataFrame) -> DataFrame:
    """(file, type, line, function, sink, evidence, confidence, call_chain): sources that reach a sink in another method."""
    table = settled(fact_table(files), "facts")
    calls_ = settled(resolved_calls(table), "calls")
    methods = settled(method_table(table), "methods")
    values = held_values(table, calls_)
    # a caller is followed if its class, name and arity name it alone
    alone = methods.filter("in_class <> ''").groupBy("in_class", "name", "arity").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*ME)).alias("m")).filter("n = 1").select("m.*")

    args = table.filter("record = 'argument'")
    plain = args.filter("kind <> 'sql'").select(F.col("kind").alias("flavour"), *ME, "call", "pos", "origin", "of", "label")
    bysql = values.filter("what = 'argument'").select(F.lit("sql").alias("flavour"), *ME, "call", "pos", "origin", "of", "label")
    given = settled(plain.unionByName(bysql).join(calls_.filter("to_file IS NOT NULL AND NOT (file = to_file AND method = to_method)"), [*ME, "call"]), "given")

    flavour = F.create_map(*(x for k, f in KINDS.items() for x in (F.lit(k), F.lit(f))))[F.col("kind")]
    own = table.filter("record = 'sink'").select("kind", *ME, "call", "line", "sink", "steps").dropDuplicates(["kind", *ME, "call"])
    reached = values.filter("what = 'sink' AND origin = 'param'").select(F.lit("SQL_INJECTION").alias("kind"), *ME, "call", "of")
    reached = reached.unionByName(table.filter("record = 'sink' AND kind <> 'SQL_INJECTION' AND origin = 'param'").select("kind", *ME, "call", "of"))
    named = methods.select(*ME, "label")
    seed = reached.join(own, ["kind", *ME, "call"]).join(named, ME).select("kind", *ME, "of", F.col("file").alias("sink_file"), F.col("line").alias("sink_line"), F.col("call").alias("sink_call"), "sink", F.concat(F.array("label"), "steps").alias("chain"))
    key = ["kind", *ME, "of", "sink_file", "sink_line", "sink_call"]

    def met(sinks: DataFrame, what: str) -> DataFrame:
        """Arguments that hold an origin of this sort, with the sinks that their callee's parameter reaches."""
        at = sinks.select("kind", flavour.alias("flavour"), F.col("file").alias("to_file"), F.col("method").alias("to_method"), F.col("of").alias("pos"), "sink_file", "sink_line", "sink_call", "sink", "chain")
        return given.filter(F.col("origin") == what).join(at, ["flavour", "to_file", "to_method", "pos"])

    def step(delta: DataFrame, everything: DataFrame) -> DataFrame:
        up = met(delta.filter("kind <> 'DANGEROUS_FILE_UPLOAD'"), "param").withColumnRenamed("label", "_label")
        return up.join(named, ME).select("kind", *ME, "of", "sink_file", "sink_line", "sink_call", "sink", F.concat(F.array("label"), "chain").alias("chain"))

    sinks = closure.fixpoint(seed, step, key, max_rounds=None, first=F.struct(F.size("chain"), "chain"))
    hits = met(sinks, "source").join(alone, ME).join(named.withColumnRenamed("label", "caller"), ME)
    texts = args.select(*ME, "call", "pos", F.col("name").alias("argument")).distinct()
    params = methods.select(F.col("file").alias("to_file"), F.col("method").alias("to_method"), "params")
    told = hits.join(texts, [*ME, "call", "pos"]).join(params, ["to_file", "to_method"])
    step_ = F.struct("pos", "label", F.concat(F.lit("`"), "argument", F.lit("` → `"), F.get("params", F.col("pos")), F.lit("`")).alias("handed"))
    per_sink = told.groupBy("kind", *ME, "call", "line", "function", "caller", "text", "to_file", "to_method", "sink_file", "sink_line", "sink_call", "sink", "chain").agg(F.array_sort(F.collect_set(step_)).alias("handed"))
    sources = F.array_join(F.array_distinct(F.transform("handed", lambda x: x["label"])), ", ")
    handed = F.array_join(F.transform("handed", lambda x: x["handed"]), ", ")
    placed = per_sink.withColumn("places", F.transform("handed", lambda x: x["pos"])).withColumn("sources", sources).withColumn("given", handed)
    # of several sinks that the same call reaches by the same parameters one is told, the one of the shortest chain
    best = F.struct(F.size("chain"), "chain", "sink_file", "sink_line", "sink_call")
    first = placed.groupBy("kind", *ME, "line", "to_file", "to_method", "places").agg(F.min_by(F.struct("function", "caller", "sink", "chain", "sources", "given", "sink_line"), best).alias("x"))
    chain = F.concat(F.array("x.caller", F.concat("x.sources", F.lit(" → "), "x.given")), "x.chain")
    evidence = F.concat("x.sources", F.lit(" is passed on as "), "x.given", F.lit(" and reaches `"), "x.sink", F.lit("` in line "), F.col("x.sink_line").cast("string"), F.lit(" of `"), F.element_at("x.chain", 1), F.lit("` or what it calls"))
    found = first.select("file", F.col("kind").alias("type"), "line", F.col("x.function").alias("function"), F.col("x.sink").alias("sink"), evidence.alias("evidence"), F.lit("HIGH").alias("confidence"), chain.alias("call_chain"))
    return found.unionByName(script_findings(table, given, alone, named))


def script_findings(table: DataFrame, given: DataFrame, alone: DataFrame, named: DataFrame) -> DataFrame:
    """Markup that another method builds from a source, and that is written to a response."""
    html = table.filter("record = 'return' AND kind = 'html'").select(*ME, "origin", "of", "line")
    seed = html.filter("origin = 'param'").join(named, ME).select(*ME, "of", F.array("label", F.lit("return of unescaped HTML")).alias("chain"))
    # within chains a callee must build markup in one place only
    single = html.groupBy(*ME).agg(F.count_distinct("line").alias("n")).filter("n = 1").select(F.col("file").alias("to_file"), F.col("method").alias("to_method"))
    via = html.filter("origin = 'value'").select(*ME, F.col("of").alias("call"))
    markup = given.filter("flavour = 'html'")

    def at(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("file").alias("to_file"), F.col("method").alias("to_method"), F.col("of").alias("pos"), "chain")

    def step(delta: DataFrame, everything: DataFrame) -> DataFrame:
        up = markup.filter("origin = 'param'").join(via, [*ME, "call"]).join(single, ["to_file", "to_method"]).drop("label").join(at(delta), ["to_file", "to_method", "pos"])
        return up.join(named, ME).select(*ME, "of", F.concat(F.array("label"), "chain").alias("chain"))

    made = closure.fixpoint(seed, step, [*ME, "of"], max_rounds=None, first=F.struct(F.size("chain"), "chain"))
    out = table.filter("record = 'output'").select(*ME, "call", F.col("line").alias("at_line"), F.col("sink").alias("out"), F.col("name").alias("var"), F.col("target").alias("in_function"))
    hits = out.join(markup.filter("origin = 'source'").drop("function"), [*ME, "call"]).join(at(made), ["to_file", "to_method", "pos"]).join(alone, ME).join(named.withColumnRenamed("label", "caller"), ME)
    best = F.struct(F.size("chain"), "chain", "label")
    first = hits.groupBy(*ME, "at_line", "in_function", "out").agg(F.min_by(F.struct("chain", "label", "var", "caller"), best).alias("x"))
    chain = F.concat(F.array(F.concat("x.label", F.lit(" → "), "x.var")), "x.chain", F.array("x.caller", "out"))
    evidence = F.concat("x.label", F.lit(" becomes HTML in `"), F.element_at("x.chain", 1), F.lit("`, and `"), "out", F.lit("` writes it unescaped"))
    return first.select("file", F.lit("XSS").alias("type"), F.col("at_line").alias("line"), F.col("in_function").alias("function"), F.col("out").alias("sink"), evidence.alias("evidence"), F.lit("HIGH").alias("confidence"), chain.alias("call_chain"))


def with_context(found: DataFrame, files: DataFrame) -> DataFrame:
    """Findings with the lines around them and the places of their chains' steps. Only files that have findings are read
    again and brought to them; a file's findings travel as one array."""
    rows = found.groupBy("file").agg(F.collect_list(F.struct("type", "line", "function", "sink", "evidence", "confidence", "call_chain")).alias("found"))
    names = ["file", "type", "line", "function", "sink", "evidence", "confidence", "call_chain", "snippet", "steps"]
    step = pa.struct([("label", pa.string()), ("kind", pa.string()), ("line", pa.int32())])
    types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.list_(step)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for file, content, own in zip(b.column("file").to_pylist(), b.column("content").to_pylist(), b.column("found").to_pylist(), strict=True):
                lines = (content or "").splitlines()
                for x in own:
                    f = Finding(x["type"], x["line"], x["function"], x["sink"], x["evidence"], x["confidence"], x["call_chain"])
                    out.append((file, *f, context(lines, f), [dict(zip(("label", "kind", "line"), d, strict=True)) for d in chain_details(lines, f)]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(types)], names=names)

    return rows.join(files.select("file", "content"), "file").select("file", "content", "found").mapInArrow(run, "file string, type string, line int, function string, sink string, evidence string, confidence string, call_chain array<string>, snippet string, steps array<struct<label:string,kind:string,line:int>>")
