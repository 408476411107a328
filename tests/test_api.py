"""Looking at inputs by kind, comparing them, taking a snapshot."""

import os

import pytest

from tracewell import api
from tracewell.errors import Unsupported
from tracewell.operators import bundle


def test_inspect_and_compare(spark, tmp_path):
    (tmp_path / "a.log").write_text("2024-01-01 00:00:00 ERROR x\n")
    (tmp_path / "a.xml").write_text('<testsuite><testcase name="a"/></testsuite>')
    (tmp_path / "b.xml").write_text('<testsuite><testcase name="a"><failure/></testcase></testsuite>')
    (tmp_path / "a.json").write_text('[{"directory": "/w", "file": "a.c", "command": "cc -DX a.c"}]')
    (tmp_path / "b.json").write_text('[{"directory": "/w", "file": "a.c", "command": "cc a.c"}]')
    (tmp_path / "a.st").write_text("read(3) = 1\nread(3) = -1 EIO (x)\n")
    p = lambda n: str(tmp_path / n)
    kind, df = api.inspect(spark, p("a.log"))
    assert kind == "log" and df.first().level == "error"
    assert api.inspect(spark, p("a.st"))[1].first().calls == 2 and api.inspect(spark, p("a.json"))[1].first().defines == ["X"]
    assert api.inspect(spark, str(tmp_path))[0] == "directory"
    assert [r.change for r in api.compare(spark, p("a.xml"), p("b.xml"))[1].collect()] == ["regression"]
    assert [r.removed_defines for r in api.compare(spark, p("a.json"), p("b.json"))[1].collect()] == [["X"]]
    with pytest.raises(Unsupported):
        api.compare(spark, p("a.log"), p("a.log"))


def test_snapshot(spark, tmp_path):
    path = str(tmp_path / api.snapshot_name("h o"))
    (tmp_path / "x.log").write_text("line\n")
    m = api.host_snapshot(spark, path, log=str(tmp_path / "x.log"))
    names = {s["path"] for s in m["sources"]}
    assert {"reports/host.json", "logs/x.log"} <= names and os.path.exists(path)
    assert bundle.checked_entries(open(path, "rb").read())["logs/x.log"] == b"line\n"
