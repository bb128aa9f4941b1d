import io
import json

import pytest
from lodestone import cli, tools
from lodestone.config import Config, configure_logging
from lodestone.errors import ConfigError, UnsupportedFormat


@pytest.fixture
def data(tmp_path):
    (tmp_path / "log.csv").write_text("ts,level,module,n\n" + "".join(f"2026-01-0{k % 9 + 1},{'error' if k % 3 else 'info'},m{k % 4},{k}\n" for k in range(40)) + "2026-01-01,error,m0,9999\n")
    (tmp_path / "a.md").write_text("hello world of search\n")
    (tmp_path / "b.txt").write_text("nothing to see\nhello again\n")
    return tmp_path


def call(*argv):
    out = io.StringIO()
    cli.run(cli.parser().parse_args([str(a) for a in argv]), out)
    return out.getvalue()


def test_tools(spark, data):
    f = str(data / "log.csv")
    assert [r["path"].rpartition("/")[2] for r in tools.find_files(spark, str(data), kind="text")] == ["a.md", "b.txt"]
    assert tools.get_schema(spark, f)["rows"] == 41 and len(tools.sample_data(spark, f, 4)) == 4
    assert tools.query_data(spark, f, "SELECT module, COUNT(*) AS c FROM log WHERE level = 'error' GROUP BY module ORDER BY c DESC, module LIMIT 1") == [{"module": "m0", "c": 7}]
    q = tools.quality_check(spark, f)
    assert q["rows"] == 41 and q["outliers"][0]["column"] == "n" and q["outliers"][0]["rows"] == [40]
    assert tools.index_files(spark, str(data), str(data / "idx"), kind="text") == {"files": 2, "added": 2, "skipped": 0}
    hits = tools.search_index(spark, str(data / "idx"), "hello")
    assert {(h["path"].rpartition("/")[2], h["line"], h["column"]) for h in hits} == {("a.md", 1, 1), ("b.txt", 2, 1)} and "<b>hello</b>" in hits[0]["snippet"]
    assert [h["path"].rpartition("/")[2] for h in tools.search_index(spark, str(data / "idx"), "hello", "md")] == ["a.md"]
    assert tools.semantic_search(spark, str(data), "hello world of search")[0]["path"].endswith("a.md")
    with pytest.raises(UnsupportedFormat):
        tools.get_schema(spark, str(data / "a.md"))


def test_command_line(spark, data, monkeypatch):
    monkeypatch.setenv("HOME", str(data))
    f = data / "log.csv"
    assert "module" in call("process", f, "SELECT module, COUNT(*) c FROM this GROUP BY module") and "41 rows" in call("p", f)
    assert "outliers n: 1" in call("process", f, "--quality-check") and json.loads(call("process", f, "-o", data / "o.jsonl"))["bytes"] > 100
    assert call("query", f, "SELECT n FROM this ORDER BY n LIMIT 2", "--format", "csv") == "n\n0\n1\n"
    assert json.loads(call("query", f, "SELECT MAX(n) AS m FROM log")) == [{"m": 9999}]
    assert "a.md" in call("find", "A.MD", "--root", data) and "a.md" in call("history", "top").lower()
    assert json.loads(call("config", "get", "search.limit", "--file", data / "c.json")) == {"search.limit": 100}
    call("config", "set", "search.limit", "7", "--file", data / "c.json")
    assert Config.load(str(data / "c.json")).search.limit == 7
    assert json.loads(call("bench", f, "--runs", "2"))["runs"] == 2 and "Scan csv" in call("explain", f, "SELECT n FROM this")
    assert {t["name"] for t in json.loads(call("tools"))} == set(tools.TOOLS) and "a.md" in call("peek", data)
    assert cli.main(["query", str(data / "a.md"), "SELECT 1"]) == 1


def test_config(tmp_path):
    c = Config.load(str(tmp_path / "none.json"), {"LODESTONE_THREADS": "3", "LODESTONE_LOG": "info"})
    assert (c.threads, c.log_level) == (3, "info")
    with pytest.raises(ConfigError):
        c.set("nope.x", 1)
    with pytest.raises(ConfigError):
        c.set("threads", "many")
    assert configure_logging(quiet=True, verbose=True) == 40
