"""Panels, error logs and the lines in which hits are shown."""

import datetime as dt

from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import facts, panels

def now():
    return F.lit(dt.datetime(2024, 1, 2, 12))



def test_error_log(spark, tmp_path):
    (tmp_path / "hook.log").write_text("--- 2024-01-01T00:00:00Z stop\nold\n--- 2024-01-02T10:00:00Z prompt\nTraceback\n  x\nValueError: late \n\n--- 2024-01-02T09:00:00Z edit\nKeyError\n--- nonsense\n")
    entries = panels.log_entries(spark, str(tmp_path / "hook.log"))
    assert [(r.event, r.last) for r in entries.orderBy("at").collect()] == [(None, "nonsense"), ("stop", "old"), ("edit", "KeyError"), ("prompt", "ValueError: late")]
    assert tuple(panels.log_errors(entries, now()).first()) == (2, "ValueError: late")
    assert tuple(panels.log_errors(entries.limit(0), now()).first()) == (0, None)


def test_sessions_and_handoffs(spark):
    sessions = spark.createDataFrame([("a", 5, "p"), ("b", 9, "p"), ("c", 9, "q"), ("d", None, "q")], "session_id string, last_seen_at int, project string")
    items = spark.createDataFrame([("a", "task", "agent"), ("b", "handoff", "auto"), ("b", "pin", "agent"), ("c", "handoff", "agent"), (None, "pin", "x")], "session_id string, kind string, source string")
    found = {r.session_id: (r["items"], r.handoff) for r in panels.session_panel(sessions, items, 3).collect()}
    assert found == {"b": (1, False), "c": (0, True), "a": (1, False)}
    rows = [(1, "p", "handoff", "active", "agent", 1), (2, "p", "handoff", "active", "auto", 9), (3, "q", "handoff", "active", "auto", 2), (4, "q", "handoff", "superseded", "agent", 3), (5, "p", "pin", "active", "agent", 9)]
    held = spark.createDataFrame(rows, "id int, project string, kind string, status string, source string, created_at int")
    assert {r.project: r.id for r in panels.present_handoff(held, "project").collect()} == {"p": 1, "q": 3}


def test_the_present_session(spark):
    at = dt.datetime(2024, 1, 2, 12)
    rows = [("a", at - dt.timedelta(hours=1), "p"), ("b", at - dt.timedelta(hours=1), "p"), ("c", at - dt.timedelta(hours=13), "q"), ("d", None, "q")]
    sessions = spark.createDataFrame(rows, "session_id string, last_seen_at timestamp, project string")
    assert [tuple(r) for r in panels.newest_session(sessions, now(), ["project"]).collect()] == [("p", "b")]
    assert [r.session_id for r in panels.newest_session(sessions, now()).collect()] == ["b"] and panels.newest_session(sessions, now(), hours=0).collect() == []


def test_lines_of_hits(spark):
    rows = [("item", "D3", "rejected", False, "", "2 d ago", "text"), ("item", "P1", "active", True, "[auto]", "now", "text"), ("turn", "M7", "user", None, "", "now", "said"), ("fold", "F2", "tool", None, "", "now", "t"), ("code", "f", "function", None, "", None, "a.py:3 def f")]
    df = spark.createDataFrame(rows, "source string, label string, status string, priority boolean, tag string, at string, text string")
    lines = [r[0] for r in df.select(T.hit_line(*[F.col(c) for c in ("source", "label", "status", "priority", "tag", "at", "text")])).collect()]
    assert lines == ["D3 ✗ rejected · 2 d ago · text", "P1 !critical · now · [auto] text", "M7 user · now · said", "F2 fold:tool · now · t", "code function a.py:3 def f"]


def test_small_texts(spark):
    names = spark.createDataFrame([("parseConfig.test.py",), ("a/b-file_name.md",), (".env",), ("",)], "n string")
    assert [sorted(r[0]) for r in names.select(T.name_terms(F.col("n"))).collect()] == [["config", "parse", "parseconfig", "test"], ["file", "file_name", "name"], ["env"], []]
    one = spark.createDataFrame([("a\nb\nc", 0), ("a\nb\nc", 2), ("a\nb\nc", 99)], "t string, p int")
    assert [r[0] for r in one.select(T.line_of(F.col("t"), F.col("p"))).collect()] == [1, 2, 3]
    sizes = spark.createDataFrame([(1,), (1500,), (2_500_000,)], "n long")
    assert [tuple(r) for r in sizes.select(T.size_text(F.col("n")), T.counted(F.col("n"), "file")).collect()] == [("0 KB", "1 file"), ("2 KB", "1,500 files"), ("2.5 MB", "2,500,000 files")]
    lines = ["#include <x>", "// First words.", "// More", "@Override", "void f() {", "", "int g;"]
    assert facts.doc_above(lines, 5) == "First words." and facts.doc_above(lines, 7) == "" and facts.doc_above(lines, 1) == ""
