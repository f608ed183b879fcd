"""Facts of sources, import rules, edges, the incremental index and snapshots."""

import json

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import codegraph, imports, pyfacts
from sparkloom.operators.codegraph import CodeIndex
from sparkloom.sources.snapshots import Conflict, NewerStore, Snapshots, reconciled

BASE = '''"""What this is.

More."""
import os, numpy.linalg as la
from . import helper
from .shapes import Shape as S
from .more import *

LIMIT = 3
limit: int = 4
MIN: int = 5


@staticmethod
async def load(path: str, *, n=LIMIT) -> dict:
    """Loads a file."""
    def inner():
        return os.path.join(path)
    return inner() or helper.run(n)


class Box(S, la.Base):
    """A box."""

    size = compute()

    def area(self):
        self.check()
        return super().area() * S.factor()

    def area(self):
        return 2

    class Lid:
        def close(self): ...


if __name__ == "__main__":
    load("x")[0].go()
'''


def facts(text, path="a/b.py"):
    return dict(zip(pyfacts.NAMES, pyfacts.one(path, text), strict=True))


def test_python_facts():
    f = facts(BASE)
    assert (f["doc"], f["entry"], f["error"]) == ("What this is.", True, None)
    by = {s["qualname"]: s for s in f["symbols"]}
    assert list(by) == ["LIMIT", "MIN", "load", "Box", "Box.area", "Box.area#2", "Box.Lid", "Box.Lid.close"]
    assert by["load"]["sig"] == "async def load(path: str, *, n=LIMIT) -> dict" and by["load"]["decorators"] == ["staticmethod"] and by["load"]["doc"] == "Loads a file."
    assert by["Box"]["sig"] == "class Box(S, la.Base)" and by["Box.area"]["kind"] == "method" and by["Box.Lid.close"]["parent"] == "Box.Lid"
    assert by["Box.area"]["hash"] != by["Box.area#2"]["hash"] and by["LIMIT"]["kind"] == "const"
    assert {(c["owner"], c["raw"]) for c in f["calls"]} == {("load", "os.path.join"), ("load", "inner"), ("load", "helper.run"), ("Box.area", "self.check"), ("Box.area", ".area"), ("Box.area", "super"), ("Box.area", "S.factor"), ("", "load"), ("", ".go")}
    assert [(b["qualname"], b["base"]) for b in f["bases"]] == [("Box", "S"), ("Box", "la.Base")]
    assert [(i["raw"], i["level"], [(n["name"], n["alias"]) for n in i["names"]]) for i in f["imports"]] == [("os", 0, [("*mod", "os")]), ("numpy.linalg", 0, [("*mod", "la")]), ("", 1, [("helper", "helper")]), ("shapes", 1, [("Shape", "S")]), ("more", 1, [("*", "*")])]
    assert "path" in f["refs"] and "la" not in f["refs"]


def test_bounds_and_broken_files():
    many = "\n".join(f"NAME{i} = {i}" for i in range(60)) + "\n" + "\n".join(f"print(word{i})" for i in range(2000))
    f = facts(many)
    assert sum(s["kind"] == "const" for s in f["symbols"]) == 40 and len(f["refs"]) == 1500
    assert facts("def (")["error"].startswith("SyntaxError") and facts("")["symbols"] == [] and facts(None)["loc"] == 0
    deep = "x = " + "(" * 5000 + ")" * 5000
    assert facts(deep)["error"] and facts("a\0b")["error"]


SOURCES = {
    "web/app.ts": "import React, {useState as us, type FC} from 'react';\nimport * as util from './lib/util.js';\nexport { go } from '@/store';\nconst fs = require('node:fs');\nconst {a: b} = require('../shared');\nimport('./lazy');\nimport x from '@scope/pkg/deep';\nimport 'tools/run';",
    "web/lib/util.ts": "", "src/store/index.ts": "", "shared/index.js": "", "web/lazy.tsx": "", "src/tools/run.ts": "",
    "go.mod": "module example.com/proj\nrequire github.com/pkg/errors v0.9.1\n", "cmd/main.go": 'package main\nimport (\n\t"fmt"\n\tlog "example.com/proj/internal/log"\n\t"github.com/pkg/errors/sub/x"\n)\nimport "example.com/proj"\n',
    "internal/log/log.go": "", "internal/log/log_test.go": "", "root.go": "",
    "rs/src/main.rs": "mod net;\nmod deep;\nuse crate::net::{client::Client, self};\nuse serde::Deserialize;\nuse std::io;\n", "rs/src/net.rs": "mod client;", "rs/src/net/client.rs": "use super::thing;", "rs/src/deep/mod.rs": "",
    "j/src/com/acme/App.java": "import com.acme.util.Strings;\nimport java.util.List;\nimport org.lib.core.Thing;\nimport static com.acme.util.Strings.join;", "j/src/com/acme/util/Strings.java": "", "other/com/acme/util/Strings.java": "",
    "c/main.c": '#include "inc/a.h"\n#include "b.h"\n#include <stdio.h>\n', "c/inc/a.h": "", "c/deep/b.h": "", "x/b.h": "",
    "r/a.rb": "require_relative 'lib/b'\nrequire 'json'\nrequire 'lib/b'", "r/lib/b.rb": "",
    "p/index.php": "<?php\nuse App\\Models\\User as U;\nrequire __DIR__ . '/lib.php';", "p/app/App/Models/User.php": "", "p/lib.php": "",
    "pubspec.yaml": "name: myapp\ndependencies:\n  http: ^1.0\n", "lib/a.dart": "import 'dart:io';\nimport 'package:myapp/b.dart';\nimport 'package:http/http.dart';\nimport 'c/d.dart';", "lib/b.dart": "", "lib/c/d.dart": "",
    "s/A.swift": "import UIKit\nimport Alamofire", "sh/run.sh": ". ./env.sh\nsource lib.sh", "sh/env.sh": "", "lib.sh": "", "README.md": "see [the app](web/app.ts) and [none](nowhere.md)",
    "package.json": json.dumps({"dependencies": {"react": "1"}, "devDependencies": {"jest": "2"}}), "requirements.txt": "requests>=2\n# no\nnumpy\n",
}
EXPECTED = {
    ("web/app.ts", "react"): ("package", "react"), ("web/app.ts", "./lib/util.js"): ("file", "web/lib/util.ts"), ("web/app.ts", "@/store"): ("file", "src/store/index.ts"), ("web/app.ts", "node:fs"): ("none", None),
    ("web/app.ts", "../shared"): ("file", "shared/index.js"), ("web/app.ts", "./lazy"): ("file", "web/lazy.tsx"), ("web/app.ts", "@scope/pkg/deep"): ("package", "@scope/pkg"), ("web/app.ts", "tools/run"): ("file", "src/tools/run.ts"),
    ("go.mod", "github.com/pkg/errors"): ("package", "github.com/pkg/errors"), ("cmd/main.go", "fmt"): ("none", None), ("cmd/main.go", "example.com/proj/internal/log"): ("dir", "internal/log"), ("cmd/main.go", "github.com/pkg/errors/sub/x"): ("package", "github.com/pkg/errors"), ("cmd/main.go", "example.com/proj"): ("dir", ""),
    ("rs/src/main.rs", "net"): ("file", "rs/src/net.rs"), ("rs/src/main.rs", "deep"): ("file", "rs/src/deep/mod.rs"), ("rs/src/main.rs", "crate::net::client::Client"): ("file", "rs/src/net/client.rs"), ("rs/src/main.rs", "crate::net"): ("file", "rs/src/net.rs"),
    ("rs/src/main.rs", "serde::Deserialize"): ("package", "serde"), ("rs/src/main.rs", "std::io"): ("none", None), ("rs/src/net.rs", "client"): ("file", "rs/src/net/client.rs"), ("rs/src/net/client.rs", "super::thing"): ("none", None),
    ("j/src/com/acme/App.java", "com.acme.util.Strings"): ("file", "j/src/com/acme/util/Strings.java"), ("j/src/com/acme/App.java", "com.acme.util.Strings.join"): ("file", "j/src/com/acme/util/Strings.java"), ("j/src/com/acme/App.java", "java.util.List"): ("none", None), ("j/src/com/acme/App.java", "org.lib.core.Thing"): ("package", "org.lib"),
    ("c/main.c", "inc/a.h"): ("file", "c/inc/a.h"), ("c/main.c", "b.h"): ("file", "c/deep/b.h"), ("r/a.rb", "lib/b"): ("file", "r/lib/b.rb"), ("r/a.rb", "json"): ("package", "json"),
    ("p/index.php", "App\\Models\\User"): ("file", "p/app/App/Models/User.php"), ("p/index.php", "lib.php"): ("file", "p/lib.php"), ("pubspec.yaml", "http"): ("package", "http"),
    ("lib/a.dart", "dart:io"): ("none", None), ("lib/a.dart", "package:myapp/b.dart"): ("file", "lib/b.dart"), ("lib/a.dart", "package:http/http.dart"): ("package", "http"), ("lib/a.dart", "c/d.dart"): ("file", "lib/c/d.dart"),
    ("s/A.swift", "UIKit"): ("none", None), ("s/A.swift", "Alamofire"): ("package", "Alamofire"), ("sh/run.sh", "./env.sh"): ("file", "sh/env.sh"), ("sh/run.sh", "lib.sh"): ("file", "lib.sh"),
    ("README.md", "web/app.ts"): ("file", "web/app.ts"), ("README.md", "nowhere.md"): ("none", None), ("package.json", "react"): ("package", "react"), ("package.json", "jest"): ("package", "jest"), ("requirements.txt", "requests"): ("package", "requests"), ("requirements.txt", "numpy"): ("package", "numpy"),
}


def sources(spark, texts):
    return spark.createDataFrame(list(texts.items()), "path string, text string")


def test_import_rules(spark):
    from sparkloom.functions import paths

    files = sources(spark, SOURCES)
    found = imports.source_imports(files.withColumn("lang", paths.language(F.col("path"))))
    out = imports.resolve(found, files, imports.project_names(files)).collect()
    assert {(r.path, r.raw): (r.how, r.target) for r in out} == EXPECTED
    bound = {(r.path, r.raw): [(n.name, n.alias) for n in r.names] for r in out}
    assert bound["web/app.ts", "react"] == [("useState", "us"), ("FC", "FC"), ("default", "React")] and bound["web/app.ts", "./lib/util.js"] == [("*mod", "util")] and bound["web/app.ts", "../shared"] == [("a", "b")]
    assert bound["cmd/main.go", "example.com/proj/internal/log"] == [("*mod", "log")] and bound["p/index.php", "App\\Models\\User"] == [("User", "U")]


def test_paths_are_normal(spark):
    df = spark.createDataFrame([("a/./b/../c",), ("../x",), ("a/../../y",), ("",), ("/a//b/",)], "p string")
    assert [r[0] for r in df.select(imports.normal(F.col("p"))).collect()] == ["a/c", "../x", "../y", "", "a/b"]


PROJECT = {
    "pkg/__init__.py": "", "pkg/shapes.py": "from .base import Root\nclass Shape(Root):\n    def area(self):\n        return self.check() + helper()\n\ndef helper():\n    return 1\n",
    "pkg/base.py": "class Root:\n    def check(self):\n        return 2\n", "main.py": "import requests\nfrom pkg.shapes import Shape, helper as h\n\ndef run():\n    h()\n    Shape.area(None)\n\nrun()\n",
    "tests/test_main.py": "from main import run\nrun()\n", "web/a.ts": "import { go } from './b';\nfunction start() {\n  go();\n}\n", "web/b.ts": "export function go() {\n  return 1;\n}\n", "broken.py": "def (\nclass Old:\n    pass\n",
}
EDGES = {
    ("d:.", "d:pkg", "contains"), ("d:.", "f:main.py", "contains"), ("d:pkg", "f:pkg/base.py", "contains"), ("f:pkg/shapes.py", "s:pkg/shapes.py::Shape", "contains"), ("s:pkg/shapes.py::Shape", "s:pkg/shapes.py::Shape.area", "contains"),
    ("f:main.py", "f:pkg/shapes.py", "imports"), ("f:main.py", "x:requests", "imports"), ("f:pkg/shapes.py", "f:pkg/base.py", "imports"), ("f:tests/test_main.py", "f:main.py", "imports"), ("f:web/a.ts", "f:web/b.ts", "imports"),
    ("s:pkg/shapes.py::Shape", "s:pkg/base.py::Root", "inherits"), ("s:pkg/shapes.py::Shape.area", "s:pkg/base.py::Root.check", "calls"), ("s:pkg/shapes.py::Shape.area", "s:pkg/shapes.py::helper", "calls"), ("s:main.py::run", "s:pkg/shapes.py::helper", "calls"),
    ("s:main.py::run", "s:pkg/shapes.py::Shape.area", "calls"), ("f:main.py", "s:main.py::run", "calls"), ("f:tests/test_main.py", "s:main.py::run", "calls"), ("s:web/a.ts::start", "s:web/b.ts::go", "calls"),
}


def edge_set(df):
    return {(r.src, r.dst, r.kind): round(r.weight, 6) for r in df.collect()}


def test_facts_to_edges(spark):
    parsed = codegraph.parse(sources(spark, PROJECT))
    found = edge_set(codegraph.edges(parsed))
    assert EDGES <= set(found)
    assert found["f:tests/test_main.py", "f:main.py", "imports"] == found["f:tests/test_main.py", "s:main.py::run", "calls"] == 0.35
    assert not any(s == d for s, d, _ in found)
    errors = {r.path: r.error for r in parsed.where("error is not null").collect()}
    assert set(errors) == {"broken.py"} and ("f:broken.py", "s:broken.py::Old", "contains") in found


def test_index_after_changes_is_a_whole_index(spark, tmp_path, monkeypatch):
    index = CodeIndex(spark, str(tmp_path / "index"))
    assert index.sync(sources(spark, PROJECT))["added"] == len(PROJECT)
    first = edge_set(index.edges())
    changed = {"pkg/base.py": "class Root:\n    def verify(self):\n        return 2\n", "main.py": PROJECT["main.py"], "new.py": "from pkg.base import Root\n", "web/b.ts": "export function other() {\n  return 1;\n}\n"}
    assert index.touch(sources(spark, changed), sources(spark, {"broken.py": ""}).select("path")) == 4  # main.py has the text it had
    assert index.open().meta["stale"]
    now = {k: v for k, v in (PROJECT | changed).items() if k != "broken.py"}
    assert edge_set(index.edges()) == edge_set(codegraph.edges(codegraph.parse(sources(spark, now)))) != first
    assert not index.ensure_resolved()
    journal = {r.path: r for r in index.journal().where("scan = 2").collect()}
    assert {p: r.change for p, r in journal.items()} == {"pkg/base.py": "modify", "new.py": "add", "web/b.ts": "modify", "broken.py": "delete"}
    assert (journal["pkg/base.py"].added, journal["pkg/base.py"].changed, journal["pkg/base.py"].removed) == (["Root.verify"], ["Root"], ["Root.check"])
    assert index.touch(sources(spark, changed)) == 0 and index.open().meta["scan"] == 2
    assert index.sync(sources(spark, now)) == {"changed": 0, "added": 0, "modified": 0, "deleted": 0, "resolved": False, "scan": 2}


def test_only_changed_files_are_parsed(spark, tmp_path):
    index = CodeIndex(spark, str(tmp_path / "index"))
    index.touch(sources(spark, PROJECT))
    before = index.open()
    index.touch(sources(spark, PROJECT | {"main.py": "x = 1\n"}))
    journal = index.journal().where("scan = 2").collect()
    assert [(r.path, r.loc) for r in journal] == [("main.py", 1)]
    assert before.read("facts").where("path = 'main.py'").first().loc > 1  # who has opened it, sees what was there


def test_changes_as_a_stream(spark, tmp_path):
    index = CodeIndex(spark, str(tmp_path / "index"))
    for k, part in enumerate([PROJECT, {"main.py": "x = 1\n", "broken.py": None}]):
        sources(spark, part).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    changes = spark.readStream.schema("path string, text string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = index.follow(changes, str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    now = {k: v for k, v in (PROJECT | {"main.py": "x = 1\n"}).items() if k != "broken.py"}
    assert edge_set(index.edges()) == edge_set(codegraph.edges(codegraph.parse(sources(spark, now))))


def test_seeds(spark):
    focus = spark.createDataFrame([("a.py",), ("a.py",), ("b.py",)], "path string")
    hits = spark.createDataFrame([("a.py", "f", 4.0), ("c.py", None, 2.0), ("c.py", "g", 1.0)], "path string, qualname string, score double")
    found = {r.id: round(r.p, 6) for r in codegraph.seeds(focus, hits).collect()}
    assert found == {"f:a.py": 1.6, "f:b.py": 1.0, "s:a.py::f": 0.24, "f:c.py": 0.45, "s:c.py::g": 0.06}
    assert codegraph.seeds(focus.limit(0), hits.limit(0)).collect() == []


def test_ranks_are_stored_with_their_edges(spark, tmp_path):
    index = CodeIndex(spark, str(tmp_path / "index"))
    index.touch(sources(spark, {"a.py": "import b\n", "b.py": "def f():\n    return 1\n", "c.py": "import b\nb.f()\n"}))
    found = {r.id: r for r in index.ranks().collect()}
    assert abs(sum(r.rank for r in found.values()) - 1) < 1e-6 and found["f:b.py"].rank > found["f:a.py"].rank
    assert found["s:b.py::f"].community == found["f:b.py"].community and found["d:."].community is None
    at = index.open().at
    assert index.ranks().count() == len(found) and index.open().at == at


def test_an_empty_index(spark, tmp_path):
    index = CodeIndex(spark, str(tmp_path / "index"))
    assert index.facts().collect() == [] and index.sync(sources(spark, {}).limit(0))["changed"] == 0
    assert index.edges().collect() == []


def test_symbol_diff(spark):
    kind = "path string, qualname string, hash string, line int"
    old = spark.createDataFrame([("a", "x", "1", 1), ("a", "y", "2", 2), ("b", "z", None, 1), ("c", "same", "5", 1)], kind)
    new = spark.createDataFrame([("a", "x", "9", 3), ("b", "z", None, 7), ("b", "w", "1", 1), ("c", "same", "5", 9), *[("d", f"n{i:02}", "0", i) for i in range(40)]], kind)
    found = {r.path: (r.added, r.changed, r.removed) for r in codegraph.symbol_diff(old, new).collect()}
    assert found == {"a": ([], ["x"], ["y"]), "b": (["w"], [], []), "d": ([f"n{i:02}" for i in range(25)], [], [])}


def test_snapshots(spark, tmp_path):
    folder = str(tmp_path / "store")
    store = Snapshots(spark, folder)
    assert store.at == 0 and store.read("t") is None and store.read("t", "a int").collect() == []
    store.commit({"t": spark.createDataFrame([(1,)], "a int"), "u": spark.createDataFrame([(5,)], "b int")}, {"x": 1})
    other = Snapshots(spark, folder)
    store.commit({"t": spark.createDataFrame([(2,)], "a int")})
    assert other.read("t").collect()[0].a == 1 and Snapshots(spark, folder).read("t").collect()[0].a == 2
    with pytest.raises(Conflict):
        other.commit({"t": spark.createDataFrame([(3,)], "a int")})
    now = Snapshots(spark, folder)
    assert now.at == 2 and now.meta == {"x": 1} and now.read("u").first().b == 5
    assert [tuple(r) for r in now.read("t", "a int, more string").collect()] == [(2, None)]
    now.rewrite()
    assert now.vacuum(keep=1) == 2 and Snapshots(spark, folder).read("u").first().b == 5
    with pytest.raises(NewerStore):
        Snapshots(spark, folder, version=0)


def test_reconciled(spark):
    schema = spark.createDataFrame([], "a long, b string").schema
    assert [tuple(r) for r in reconciled(spark.createDataFrame([(1, 2)], "A int, c int"), schema).collect()] == [(1, None)]
