"""Index a small tree and ask it everything."""

import io
import json
import subprocess

import pytest
from pyspark.sql import functions as F

from cairn import cli
from cairn.engine import Engine, federate, federated_graph, workspace_context, workspace_report, workspace_trace
from cairn.extract.rows import IR
from cairn.functions.identity import address
from cairn.sources.store import FileCache, Store, StoredOverlay

MAIN = "fn leaf() {}\nfn middle() { leaf(); }\nfn top() {\n    let a = 1;\n    let b = a;\n    if b > 0 { middle(); } else { leaf(); }\n}\n"
DECOY = "fn decoy_leaf() {}\nfn middle() { decoy_leaf(); }\n"


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "main.rs").write_text(MAIN)
    (root / "decoy.rs").write_text(DECOY)
    (root / "app.ts").write_text("function go() { stop(); }\nfunction stop() {}\n")
    (root / "util.py").write_text("def one():\n    return two()\n\ndef two():\n    return 2\n")
    (root / "readme.md").write_text("no source")
    (root / "target").mkdir()
    (root / "target" / "gen.rs").write_text("fn generated() {}")
    git = ["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t"]
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    subprocess.run([*git, "add", "-A"], check=True)
    subprocess.run([*git, "commit", "-qm", "one"], check=True)
    return root


@pytest.fixture(scope="module")
def engine(spark, tree, tmp_path_factory):
    e = Engine(spark, str(tree), str(tmp_path_factory.mktemp("store")))
    assert e.index()["status"] == "indexed"
    return e


def test_index_is_fresh_and_leaves_build_folders_out(engine):
    assert engine.index()["status"] == "fresh"
    assert engine.store.load_meta()["file_count"] == 4
    assert [o["overlay"] for o in engine.status()["overlays"]] == ["custom_fused"]
    assert engine.derive() == ["process", "pdg"] and engine.store.overlays() == ["custom_fused", "pdg", "process"]


def test_calls_stay_in_their_file(engine):
    g = engine.graph()
    calls = g.edges.where("relation = 'Calls'")
    at = {name: engine.locate(g, f, line) for name, f, line in (("leaf", "main.rs", 1), ("middle", "main.rs", 2), ("top", "main.rs", 4), ("decoy_middle", "decoy.rs", 2), ("decoy_leaf", "decoy.rs", 1))}
    pairs = {(r.source, r.target) for r in calls.collect()}
    assert (at["middle"], at["leaf"]) in pairs and (at["top"], at["middle"]) in pairs
    assert (at["decoy_middle"], at["decoy_leaf"]) in pairs and (at["decoy_middle"], at["leaf"]) not in pairs


def test_impact_is_the_best_product(engine):
    scores = {r["node"]: r["score"] for r in engine.impact("main.rs", 4)["impact"]}
    g = engine.graph()
    assert scores[engine.locate(g, "main.rs", 4)] == 1.0
    assert scores[engine.locate(g, "main.rs", 2)] == pytest.approx(0.7)
    assert scores[engine.locate(g, "main.rs", 1)] == pytest.approx(0.7)


def test_context_and_trace(engine):
    assert len(engine.context("main.rs", 4)["nodes"]) == 3
    assert [r["hop"] for r in engine.trace("main.rs:2", 2)["chain"]] == [0, 1]
    with pytest.raises(LookupError):
        engine.trace("nothing")
    with pytest.raises(LookupError):
        engine.locate(engine.graph(), "missing.rs", 1)


def test_changes_beliefs_and_staleness(engine, tree):
    (tree / "main.rs").write_text(MAIN.replace("let a = 1;", "let a = 2;"))
    got = engine.detect_changes()
    assert got["changed"] >= 1 and got["blast_radius"]
    assert engine.freshness()["files_changed"] == 1
    with pytest.raises(PermissionError):
        engine.assert_belief("unused", "main.rs", 1, 0.9, "me")
    assert engine.reindex("me")["status"] == "indexed"
    with pytest.raises(PermissionError):
        engine.reindex(" ")
    first, second = engine.assert_belief("unused", "main.rs", 1, 0.9, "me"), engine.assert_belief("slow", "main.rs", 2, 0.9, "me")
    kept = {r.address for r in engine.store.read("beliefs").nodes.collect()}
    assert kept == {first, second}


def test_experiment_verify_analyze(engine, tmp_path):
    log = str(tmp_path / "log.tsv")
    assert engine.experiment(log, 2, "GraphDensity").fitness > 0
    assert engine.verify(log) == 2
    assert engine.analyze(log)["fitness_count"] == 2
    assert len(engine.experiment_results(log, 5)) == 2
    engine.experiment(log, 1, "GraphDensity")  # goes on from the checkpoint
    assert engine.verify(log) == 3


def test_visualize_and_cli(engine, spark, tmp_path, capsys):
    page = str(tmp_path / "g.html")
    engine.visualize(page, 0.5, ("Calls",))
    assert "GRAPH_DATA" not in open(page).read()
    cli.main(["status", "--source-dir", engine.source_dir, "--store-dir", engine.store_dir], spark)
    assert json.loads(capsys.readouterr().out)["freshness"]["is_fresh"]
    out = io.StringIO()
    asked = ['{"tool": "status"}', '{"tool": "nope"}', "{", '{"list": true}', '{"tool": "impact", "args": {"file": "main.rs"}}', '{"tool": "impact", "args": {"file": "main.rs", "line": "4"}}', '{"tool": "context", "args": {"file": "main.rs", "line": 4}}']
    cli.serve(engine, asked, out)
    answers = [json.loads(x) for x in out.getvalue().splitlines()]
    assert "overlays" in answers[0] and "error" in answers[2] and len(answers[6]["nodes"]) == 3
    assert [a.get("kind") for a in answers] == [None, "invalid_params", None, None, "invalid_params", "invalid_params", None]
    catalogue = {t["name"]: t["inputSchema"] for t in answers[3]["tools"]}
    assert len(catalogue) == 11 and catalogue["context"]["required"] == ["file", "line"] and catalogue["context"]["properties"]["depth"]["default"] == 1
    assert cli.shown({"n": 1, "rows": [{"a": 1, "bb": "x"}]}, "table") == "n: 1\nrows:\na  bb\n1  x"
    for name in cli.COMMANDS:
        required = {"query": ["--file", "a", "--line", "1"], "verify": ["--log", "x"], "analyze": ["--log", "x"], "experiment": ["--log", "x"], "federate": ["--config", "c"]}
        assert cli.parser().parse_args([name, *required.get(name, [])]).command == name


def test_only_changed_files_are_read_again(spark, tmp_path, monkeypatch):
    (tmp_path / "src").mkdir()
    for n in ("a", "b"):
        (tmp_path / "src" / f"{n}.py").write_text(f"def {n}():\n    return 1\n")
    (tmp_path / "src" / "bad.py").write_text("def (:\n")
    (tmp_path / "src" / "blank.py").write_text("\n")
    e = Engine(spark, str(tmp_path / "src"), str(tmp_path / "store"))
    assert [f["path"] for f in e.index()["failed"]] == ["bad.py"]
    cache = FileCache(spark, str(tmp_path / "store"))
    assert cache.rows(IR).where("kind = 'file'").count() == 4
    (tmp_path / "src" / "a.py").write_text("def changed():\n    return 1\n")
    assert e.freshness()["files_changed"] == 1
    e.index()
    assert cache.rows(IR).where("kind = 'file'").count() == 5  # one more file was read
    names = {r.name for r in e.read_rows(e.sources()).where("kind = 'symbol'").collect()}
    assert names == {"changed", "b"} and e.index()["status"] == "fresh"


def test_overlays_and_embeddings_are_stored(engine, tmp_path):
    (tmp_path / "t.tsv").write_text("caller\tcallee\tcount\tduration\ntop\tleaf\t50\t1\n")
    assert engine.add_trace(str(tmp_path / "t.tsv")) == 1
    (tmp_path / "s.json").write_text(json.dumps([{"relative_path": "a", "occurrences": [{"symbol": "s", "role": "definition", "line": 1}, {"symbol": "s", "role": "ref", "line": 4}]}]))
    assert engine.add_scip(str(tmp_path / "s.json")) == 1 and engine.store.read("custom_scip").nodes.count() == 2
    assert engine.store.read_embeddings().count() == 0
    (tmp_path / "e.json").write_text(json.dumps([{"address": "a", "vector": [1, 2], "model": "m"}]))
    assert engine.add_embeddings(str(tmp_path / "e.json")) == 1 and engine.store.read_embeddings().first().model == "m"
    engine.derive()
    overlay = StoredOverlay(engine.store, "pdg")
    assert overlay.edges().where("relation = 'DataFlow'").count() >= 1 and overlay.nodes().count() > 0


def test_processes_start_at_their_entry_point(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "m.rs").write_text("fn work() {}\npub fn main() { work(); }\n")
    e = Engine(spark, str(tmp_path / "src"), str(tmp_path / "store"))
    e.index()
    assert [r["hop"] for r in e.trace("main", 2)["chain"]] == [0, 1]


def test_init_writes_where_the_server_is(spark, tmp_path):
    (tmp_path / "m.py").write_text("def one():\n    pass\n")
    e = Engine(spark, str(tmp_path), str(tmp_path / ".store"))
    assert cli.init(e, str(tmp_path))["status"] == "indexed" and cli.init(e, str(tmp_path))["status"] == "exists"
    assert json.loads((tmp_path / ".mcp.json").read_text())["mcpServers"]["cairn"]["args"][2] == "serve"


def test_workspace(spark, tmp_path):
    for name, text, deps in (("a", "pub fn helper() {}\n", ""), ("b", "use a::helper;\nfn run() { helper(); }\n", 'a = "1"')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "lib.rs").write_text(text)
        (tmp_path / name / "Cargo.toml").write_text(f'[package]\nname = "{name}"\n[dependencies]\n{deps}\n')
        Engine(spark, str(tmp_path / name), str(tmp_path / f"store-{name}")).index()
    spec = "workspace_id = 'w'\n" + "".join(f"[[repositories]]\nname='{n}'\nsource_dir='{tmp_path / n}'\nstore_dir='{tmp_path / f'store-{n}'}'\n" for n in "ab")
    (tmp_path / "ws.toml").write_text(spec)
    federate(spark, str(tmp_path / "ws.toml"), str(tmp_path / "fed"))
    g = Store(spark, str(tmp_path / "fed")).read("custom_federated")
    assert g.edges.where("relation = 'Imports' and confidence = 0.7").count() == 1
    assert len(workspace_trace(spark, str(tmp_path / "fed"), "b", "a")) == 1
    assert workspace_trace(spark, str(tmp_path / "fed"), "b", "c") == []
    report = workspace_report(spark, str(tmp_path / "fed"))
    assert report["pairs"] >= 1 and report["coverage"] > 0 and report["evidence"]["dependency"] == 1
    assert g.nodes.where(F.col("kind") == "Scope").count() == 2
    whole = federated_graph(spark, str(tmp_path / "ws.toml"), str(tmp_path / "fed"))
    file = address("file:lib.rs")
    got = workspace_context(spark, str(tmp_path / "ws.toml"), str(tmp_path / "fed"), address("b"), 2)
    assert whole.edges.count() > g.edges.count() and whole.node(file).count() == 2
    assert {n["address"] for n in got["nodes"]} >= {address("a"), address("b")}
