"""Imports, types, calls and references of small sources against what they mean."""

import pytest

from sparkloom.operators import legacy, names, pack, resolve

STANDARD = ["os", "re", "json", "test"]


@pytest.fixture(scope="module")
def files(spark):
    found = ["app/__init__.py", "app/core.py", "app/util/__init__.py", "app/util/text.py", "app/util/json.py", "src/lone/__init__.py", "src/lone/deep.py", "tools/run.py", "tools/helper.py", "utils/requests.py", "test/__init__.py", "test/helpers.py", "stub.pyi"]
    return spark.createDataFrame([(f,) for f in found], "path string")


def test_python_imports(spark, files):
    asked = [
        ("app/core.py", 1, "os", 0, None, "os"),
        ("app/core.py", 2, "json", 0, None, "json"),  # never util/json.py
        ("app/core.py", 3, "requests", 0, None, "requests"),  # never utils/requests.py
        ("app/core.py", 4, "app.util.text", 0, None, "app"),
        ("app/core.py", 5, "app.util.text.clean", 0, None, "app"),  # longest prefix
        ("app/core.py", 6, "app.util", 0, "text", "text"),  # a submodule
        ("app/core.py", 7, "app.util", 0, "wrap", "w"),  # a symbol
        ("app/core.py", 8, "util.text", 1, "clean", "clean"),
        ("app/util/text.py", 9, "core", 2, "main", "main"),
        ("app/util/text.py", 10, "", 1, "json", "json"),
        ("app/util/text.py", 11, "nothing", 1, "x", "x"),
        ("tools/run.py", 12, "helper", 0, None, "helper"),  # beside the script
        ("app/core.py", 13, "lone.deep", 0, "f", "f"),  # below src
        ("app/core.py", 14, "test.helpers", 0, None, "test"),  # a real local package of a standard name
        ("app/core.py", 15, "re.thing", 0, None, "re"),
        ("app/core.py", 16, "stub", 0, None, "stub"),
        ("app/core.py", 17, "utils.absent", 0, None, "utils"),  # a local folder is no package
        ("app/core.py", 18, "app.util", 0, "*", "*"),
    ]
    imports = spark.createDataFrame(asked, "path string, line int, module string, level int, name string, alias string")
    got = {r["line"]: (r["how"], r["target"], r["symbol"]) for r in names.python_imports(imports, files, STANDARD).collect()}
    assert got == {
        1: ("none", None, None), 2: ("none", None, None), 3: ("package", "requests", None), 4: ("file", "app/util/text.py", None), 5: ("file", "app/util/text.py", None),
        6: ("file", "app/util/text.py", None), 7: ("file", "app/util/__init__.py", "wrap"), 8: ("file", "app/util/text.py", "clean"), 9: ("file", "app/core.py", "main"),
        10: ("file", "app/util/json.py", None), 11: ("none", None, None), 12: ("file", "tools/helper.py", None), 13: ("file", "src/lone/deep.py", "f"),
        14: ("file", "test/helpers.py", None), 15: ("none", None, None), 16: ("file", "stub.pyi", None), 17: ("none", None, None), 18: ("file", "app/util/__init__.py", "*"),
    }


@pytest.fixture(scope="module")
def code(spark):
    symbols = [
        ("a.py", "Base", "Base", "class"), ("a.py", "Base.run", "run", "method"), ("a.py", "helper", "helper", "function"),
        ("b.py", "Child", "Child", "class"), ("b.py", "Child.go", "go", "method"), ("b.py", "local", "local", "function"),
        ("c.py", "helper", "helper", "function"), ("c.py", "only_here", "only_here", "function"), ("c.py", "Tool", "Tool", "class"), ("c.py", "Tool.make", "make", "method"),
        *[(f"m{k}.py", "common", "common", "function") for k in range(5)],
    ]
    return (
        spark.createDataFrame(symbols, "path string, qualname string, name string, kind string"),
        spark.createDataFrame([("b.py", "Child", "Base")], "path string, qualname string, base string"),
        spark.createDataFrame([("b.py", "Base", "a.py", "Base"), ("b.py", "c", "c.py", None), ("b.py", "Tool", "c.py", "Tool")], "path string, alias string, to_path string, symbol string"),
    )


def test_calls(spark, code):
    symbols, bases, aliases = code
    asked = [
        ("b.py", "Child.go", "self.run"), ("b.py", "Child.go", "run"), ("b.py", "Child.go", "local"), ("b.py", "Child.go", "c.only_here"), ("b.py", "Child.go", "c.absent"),
        ("b.py", "Child.go", "Tool.make"), ("b.py", "Child.go", "helper"), ("b.py", "Child.go", "common"), ("b.py", "Child.go", "x.make"), ("d.py", "f", "helper"),
        ("tests/test_d.py", "f", "only_here"), ("d.py", "f", "Tool.make"),
    ]
    got = {}
    for r in names.calls(spark.createDataFrame(asked, "path string, owner string, raw string"), symbols, bases, aliases).collect():
        got.setdefault((r["path"], r["raw"]), set()).add((r["to_path"], r["to_name"], round(r["weight"], 3)))
    assert got == {
        ("b.py", "self.run"): {("a.py", "Base.run", 1.0)},
        ("b.py", "run"): {("a.py", "Base.run", 1.0)},
        ("b.py", "local"): {("b.py", "local", 1.0)},
        ("b.py", "c.only_here"): {("c.py", "only_here", 1.0)},
        ("b.py", "Tool.make"): {("c.py", "Tool.make", 1.0)},
        ("b.py", "helper"): {("a.py", "helper", 0.45), ("c.py", "helper", 0.45)},
        ("b.py", "x.make"): {("c.py", "Tool.make", 0.9)},
        ("d.py", "helper"): {("a.py", "helper", 0.3), ("c.py", "helper", 0.3)},
        ("tests/test_d.py", "only_here"): {("c.py", "only_here", 0.21)},
        ("d.py", "Tool.make"): {("c.py", "Tool.make", 1.0)},
    }


def test_types_and_references(spark, code):
    symbols, bases, aliases = code
    asked = spark.createDataFrame([("b.py", "Base"), ("b.py", "Child"), ("b.py", "c.Tool"), ("d.py", "Tool"), ("d.py", "Absent")], "path string, raw string")
    assert {(r["path"], r["raw"]): (r["to_path"], r["to_name"]) for r in names.types(asked, symbols, aliases).collect()} == {
        ("b.py", "Base"): ("a.py", "Base"), ("b.py", "Child"): ("b.py", "Child"), ("b.py", "c.Tool"): ("c.py", "Tool"), ("d.py", "Tool"): ("c.py", "Tool"),
    }
    asked = spark.createDataFrame([("b.py", "helper"), ("d.py", "only_here"), ("d.py", "helper"), ("d.py", "Tool"), ("c.py", "Tool")], "path string, name string")
    got = {(r["path"], r["name"], r["to_path"]): r["weight"] for r in names.references(asked, symbols, aliases).collect()}
    assert got == {("b.py", "helper", "a.py"): 0.3, ("b.py", "helper", "c.py"): 0.3, ("d.py", "only_here", "c.py"): 0.3}


def test_near(spark):
    rows = spark.createDataFrame([("k", "x/y/f.py", "x/z/a.py"), ("k", "x/y/f.py", "x/y/b.py"), ("k", "x/y/f.py", "x/y/a.py"), ("k", "x/y/f.py", "a.py")], "key string, frm string, path string")
    assert resolve.near(rows, ["key"]).first()["path"] == "x/y/a.py"


def test_legacy(spark):
    own = "row long, text string, created_at timestamp, session_id string"
    at = __import__("datetime").datetime(2024, 1, 1)
    pins = spark.createDataFrame([(1, "Use tabs", at, "s"), (2, "Phase 3 done: all green", at, "s"), (3, "  ", at, "s")], own)
    decisions = spark.createDataFrame([(1, "A", at, "s", True, False), (2, "B", at, "s", False, True), (3, "C", at, None, None, None)], own + ", accepted boolean, rejected boolean")
    tasks = spark.createDataFrame([(1, "x", at, "s", "Closed "), (2, "it is done", at, "s", None), (3, "y", at, "s", "wontfix"), (4, "complete the docs", at, "s", "")], own + ", status string")
    errors = spark.createDataFrame([(1, "boom", at, "s", "fixed in v2"), (2, "bang", at, "s", None)], own + ", context string")
    checkpoints = spark.createDataFrame([(1, "pre-compact", at, "s"), (2, "half way", at, "s"), (3, "nearly", at, "s")], own)
    out = legacy.records({"pins": pins, "decisions": decisions, "tasks": tasks, "errors": errors, "checkpoints": checkpoints})
    assert sorted((r["kind"], r["status"], r["text"]) for r in out.collect()) == sorted([
        ("pin", "active", "Use tabs"), ("note", "active", "Phase 3 done: all green"), ("decision", "accepted", "A"), ("decision", "rejected", "B"), ("note", "active", "C"),
        ("task", "done", "x"), ("task", "done", "it is done"), ("task", "dropped", "y"), ("task", "open", "complete the docs"),
        ("error", "fixed", "boom\nfixed in v2"), ("error", "open", "bang"), ("handoff", "active", "half way"), ("handoff", "active", "nearly"),
    ])
    nested = legacy.records({"pins": pins.union(pins), "checkpoints": checkpoints}, "sub")
    more = legacy.records({"pins": spark.createDataFrame([(9, "New  one", at, "s"), (8, "new one", at, "s")], own)}, "sub")
    merged = legacy.merge(out, nested.unionByName(more))
    assert merged.count() == 13 + 2 + 1 and merged.where("text = 'new one'").count() == 1
    chained = {r["row"]: (r["status"], r["superseded_by"]) for r in legacy.chain(out).where("kind = 'handoff'").collect()}
    assert chained == {2: ("superseded", 3), 3: ("active", None)}
    assert sum(r["n"] for r in legacy.tally(out).collect()) == 13


def test_routes_are_imported_once(spark):
    routes = spark.createDataFrame([(1, "p", True, "pin", "A b"), (2, "p", True, "pin", "a  b"), (3, "p", False, "pin", "c"), (4, None, True, "pin", "d"), (5, "q", True, "pin", "a b"), (6, "p", True, "note", "have")], "id long, project string, accept boolean, kind string, text string")
    have = spark.createDataFrame([("p", "note", "Have")], "project string, kind string, text string")
    out = legacy.apply_routes(routes, have)
    assert {r["id"]: r["outcome"] for r in out.collect()} == {1: "imported", 2: "duplicate", 3: "skipped", 4: "skipped", 5: "imported", 6: "duplicate"}
    done = routes.join(out.where("outcome = 'imported'").select("id"), "id").select("project", "kind", "text")
    assert legacy.apply_routes(routes, have.unionByName(done)).where("outcome = 'imported'").count() == 0


@pytest.mark.parametrize("budget", [100, 1500, 6000])
def test_pack_keeps_to_its_budget(spark, budget):
    """Against a plain scan of all rows in order."""
    import datetime
    import random

    from pyspark.sql import functions as F

    from sparkloom.functions import text as T
    from sparkloom.sources import tables as S

    rng = random.Random(budget)
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for k in range(400):
        kind = rng.choice(S.KINDS)
        body = " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(1, 90)))
        rows.append((k, "p" if k % 3 else "q", kind, rng.choice(S.STATUSES[kind]), rng.random() < 0.5, body, body[:40], start + datetime.timedelta(days=rng.randint(0, 40))))
    rows.append((999, "empty", "pin", "retired", False, "x", "x", start))
    items = spark.createDataFrame(rows, "id long, source string, kind string, status string, priority boolean, text string, title string, created_at timestamp_ntz")
    now = F.lit("2024-02-10 00:00:00").cast("timestamp_ntz")
    asked = max(400, budget)
    found = {r["source"]: r for r in pack.build(items, now, budget=budget).collect()}
    assert set(found) == {"p", "q", "empty"} and "Nothing is recorded" in found["empty"]["pack"]
    all_rows = pack.rows(items.where("kind <> 'pin' or not priority"), now, "source", asked, [], None)
    critical = items.where("kind = 'pin' and priority and status = 'active'").withColumn("line", F.concat(F.lit("- P"), F.col("id").cast("string"), F.lit(" "), T.truncate(F.col("text"), 300)))
    for source in "pq":
        listed = [tuple(r) for r in all_rows.where(F.col("source") == source).select("section", "ord", "id", "title", "line", "most").collect()]
        listed += [(2, n, r["id"], "## Constraints", r["line"], 9000) for n, r in enumerate(critical.where(F.col("source") == source).orderBy(F.desc("created_at"), F.desc("id")).collect())]
        live = found[source]["live"]
        text, shown, section, seen, opened, base, indexed = "", [], 0, 0, False, 0, 0
        for sec, _, i, title, line, most in sorted(listed):
            if sec != section:
                section, seen, opened, full = sec, 0, False, False
            if sec < 6:
                base = len(shown)
            elif sec == 6 and not seen:
                base = len(shown)
            room = asked - len(pack.FOOTER) - 2 - pack.MORE_ROOM - len(f"# Memory {source}")
            room -= int(asked * 0.2) if sec in (6, 7) and live > base + 20 else 0
            if i in shown or (sec == 8 and full):
                continue
            glue = (" | " if sec == 8 else "\n") if opened else f"\n\n{title}\n"
            if seen < most and len(text) + len(glue) + len(line) <= room:
                text, opened = text + glue + line, True
                if sec == 8:
                    indexed += 1
                else:
                    shown.append(i)
            else:
                full = True
            seen += 1
        r = found[source]
        assert r["chars"] <= asked and r["pack"].endswith(pack.FOOTER) and (r["shown"], r["indexed"]) == (len(shown), indexed)
        assert r["pack"].startswith(f"# Memory {source}{text}")
