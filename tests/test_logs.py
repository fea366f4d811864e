"""Chains, policies, statistics, sources and streams."""

import json

import pytest
from pyspark.sql import functions as F

from cairn.extract import braces, python
from cairn.functions import identity as I
from cairn.operators import chain, evidence, experiment, governance, measurement, stats
from cairn.sources import git, logs
from cairn.streaming import logtail


def test_chain_and_tampering(spark, tmp_path):
    path = str(tmp_path / "log.tsv")
    w = chain.ChainWriter(path, "experiment", list(logs.COLUMNS["experiment"]))
    for i in range(1, 6):
        w.append(i, 0.1 * i, 0.9, 5, "pass", json.dumps({"alpha": float(i)}), "x")
    rows = logs.read_log(spark, path, "experiment")
    assert rows.count() == 5 and chain.last_hash(rows, "") == w.previous
    assert [r.iteration for r in logs.tail(rows, 2).collect()] == [4, 5]
    again = chain.ChainWriter(path, "experiment", [])
    assert again.previous == w.previous
    text = open(path).read()
    open(path, "w").write(text.replace("0.500000", "0.999999", 1))
    with pytest.raises(logs.ChainError, match="Chain integrity failure"):
        logs.read_log(spark, path, "experiment")
    open(path, "w").write(text.replace('{"alpha": 2.0}', "{no"))
    with pytest.raises(ValueError, match="params_json"):
        logs.read_log(spark, path, "experiment")


def test_statistics(spark):
    runs = spark.createDataFrame([(i, 0.2 * i, 0.5, "pass", {"alpha": float(i), "flat": 1.0}) for i in (1, 2, 3)], "iteration bigint, fitness double, stability double, status string, params map<string,double>")
    report = stats.experiment_report(runs).first()
    assert report.fitness_count == 3 and report.fitness_median == pytest.approx(0.4) and report.convergence_rate == 1.0
    got = {r.parameter: r.correlation for r in stats.parameter_correlations(runs).collect()}
    assert list(got) == ["alpha"] and got["alpha"] > 0.99
    empty = stats.experiment_report(runs.limit(0)).first()
    assert empty.fitness_mean == 0 and empty.fitness_p90 == 0 and empty.convergence_rate == 0
    idle = spark.createDataFrame([("r", i, 1.0) for i in range(40)], "run string, iteration bigint, fitness double")
    replay = [r.action for r in experiment.review_log(idle).orderBy("iteration").collect()]
    live = experiment.Review()
    assert replay == [live.assess(1.0)[0] for i in range(40)]


def test_policies(spark, tmp_path):
    path = tmp_path / "p.toml"
    path.write_text('[[rules]]\noperation="write"\ncondition="impact_nodes > 10"\naction="require-approval"\n[[rules]]\noperation="drop"\ncondition="always"\naction="deny"\n[[rules]]\noperation="x"\ncondition="impact_nodes <= 10"\naction="deny"\n')
    rules = governance.rules_frame(spark, governance.load_rules(str(path)))
    c = spark.createDataFrame([("write", 15, 0), ("write", 5, 0), ("drop", 0, 0), ("x", 1, 0), ("other", 0, 0)], "operation string, impact_nodes bigint, changed_files bigint")
    got = {(r.operation, r.impact_nodes): r.decision for r in governance.decide(c, rules).collect()}
    assert got == {("write", 15): "RequireApproval", ("write", 5): "Allow", ("drop", 0): "Deny", ("x", 1): "Allow", ("other", 0): "Allow"}
    assert governance.load_rules(str(tmp_path / "none")) == []
    for bad in (("", True, 0.8), ("me", False, 0.8), ("me", True, 0.4)):
        with pytest.raises(PermissionError):
            governance.check_write(*bad)


def test_text_functions(spark):
    df = spark.createDataFrame([("./a\\b/c.tsx/",), ("x/target/y.rs",), ("src/.git/z.py",), ("m.go",)], "p string")
    rows = df.select(I.normalize_path("p").alias("n"), I.is_excluded("p").alias("x"), I.detect_language("p").alias("l"), I.entrypoint_parts(F.concat("p", F.lit(":7"))).alias("e")).collect()
    assert rows[0].n == "a/b/c.tsx" and [r.x for r in rows] == [False, True, True, False]
    assert [r.l for r in rows][1:] == ["rust", "python", None] and rows[1].e.line == 7
    with pytest.raises(ValueError):
        I.Direction.parse("sideways")
    assert I.Direction.parse("sideways", strict=False) is I.Direction.DOWNSTREAM
    assert experiment.parse_advice("WIDEN or SWITCH_FITNESS(Stability)") == ("Switch", "Stability") and experiment.parse_advice("?") == ("Continue", None)


def test_readers(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("caller\tcallee\tcount\tduration\na\tb\t50\t1\na\tb\n\na\tc\tmany\t1\n")
    assert logs.read_trace(spark, str(tmp_path / "t.tsv")).count() == 1
    (tmp_path / "s.json").write_text(json.dumps([{"relative_path": "a", "occurrences": [{"symbol": "s", "role": "definition", "line": 1}, {"symbol": "s", "role": "ref", "line": 4}]}]))
    from cairn.operators.overlays import scip_edges

    assert scip_edges(logs.read_scip(spark, str(tmp_path / "s.json"))).first().confidence == 1.0
    (tmp_path / "e.json").write_text(json.dumps([{"address": "a", "vector": [1, 2], "model": "m"}]))
    assert logs.read_embeddings(spark, str(tmp_path / "e.json")).first().address == I.address("a")
    text = "diff --git a/x b/x\nnew file mode 1\n@@ -0,0 +1,3 @@\ndiff --git a/y b/z\nrename to z\n@@ -4 +5,2 @@ fn\n"
    assert git.parse_diff(text) == [("x", "Added", 0, 0, 1, 3), ("z", "Renamed", 4, 1, 5, 2)]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    prev, lines = "g", []
    for i in range(4):
        h = chain.row_hash(f"r{i}", prev)
        lines.append(json.dumps({"log": "a", "pos": i, "row": f"r{i}" if i != 2 else "forged", "chain_hash": h, "fitness": float(i % 2)}))
        prev = h
    (src / "1.json").write_text("\n".join(lines))
    q = logtail.verified(logtail.read_stream(spark, str(src), logtail.LOG), "g").writeStream.format("memory").queryName("checked").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.pos, r.ok) for r in spark.table("checked").orderBy("pos").collect()] == [(0, True), (1, True), (2, False), (3, True)]
    calls = tmp_path / "calls"
    calls.mkdir()
    (calls / "1.json").write_text("\n".join(json.dumps({"caller": "a", "callee": "b", "count": 4, "at": f"2024-01-01T00:0{m}:00"}) for m in (0, 0, 3)))
    (calls / "2.json").write_text(json.dumps({"caller": "a", "callee": "b", "count": 1, "at": "2024-01-01T01:00:00"}))
    q = logtail.windowed_calls(logtail.read_stream(spark, str(calls), logtail.TRACE, 1)).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.confidence for r in spark.table("windows").collect()) == [0.1, 0.4, 0.8]


def test_hill_climb_decisions():
    r = lambda fitness, stability=0.5, status="pass": experiment.Result(fitness, stability, 0, status, {})
    assert experiment.better(r(0.50005), r(0.5)) and not experiment.better(r(0.5), r(0.5))
    assert experiment.better(r(0.49995, 0.6), r(0.5)) and not experiment.better(r(0.4, 0.9), r(0.5)) and not experiment.better(r(float("nan"), status="fail"), r(0.5))
    live = experiment.Review()
    assert [live.assess(0.5)[0] for _ in range(32)] == ["Continue"] * 10 + ["Widen"] + ["Continue"] * 9 + ["Widen"] + ["Continue"] * 9 + ["Restart", "Continue"]
    assert experiment.Review().assess(0.1) == ("Continue", None)


def test_advice():
    assert experiment.parse_advice("I say SWITCH_FITNESS( GraphDensity ), not restart") == ("Switch", "GraphDensity")
    assert experiment.parse_advice("switch_fitness()") == ("Continue", None) and experiment.parse_advice("Restart!") == ("Restart", None)
    asked = []
    past = [{"iteration": i, "fitness": i / 10, "stability": 1.0, "cycle_ms": 5, "description": "d"} for i in range(30)]
    assert experiment.advise(lambda p: asked.append(p) or "WIDEN", past) == ("Widen", 0.4)
    assert "29\t2.9000" in asked[0] and "\n9\t" not in asked[0] and "SWITCH_FITNESS(CycleTime)" in asked[0]

    def broken(_):
        raise RuntimeError

    assert experiment.advise(broken, past) == ("Continue", None)


def test_evidence_and_ledger(spark, tmp_path):
    path, ledger = str(tmp_path / "e.tsv"), str(tmp_path / "l.tsv")
    for i, op in enumerate(("Index", "DetectChanges", "Fuse")):
        evidence.log_evidence(path, i, op, f"in{i}", f"out{i}")
        evidence.append_ledger(ledger, i, 100 + i, op, "me", "a", "b")
    rows = logs.read_log(spark, path, "evidence").orderBy("pos").collect()
    assert [(r.pos, r.operation) for r in rows] == [(1, "index"), (2, "detect_changes"), (3, "fuse")]
    assert [r.seq for r in logs.read_log(spark, ledger, "ledger").orderBy("pos").collect()] == [0, 1, 2]
    with pytest.raises(ValueError):
        evidence.log_evidence(path, 9, "Nothing", "", "")
    text = open(path).read().replace("in1", "in9")
    (tmp_path / "e.tsv").write_text(text)
    with pytest.raises(logs.ChainError):
        logs.read_log(spark, path, "evidence")
    chained = measurement.ChainIntact("evidence")
    wrong = chained.detect_wrong(2)
    assert wrong.failure_mode is measurement.FailureMode.OBSERVABLE and not chained.correct(2) and chained.detect_wrong(None) is None and chained.ground_truth_level() is measurement.GroundTruth.AVAILABLE
    entry = evidence.TypedEvidence.chained(1, 5, "Gate", "me", "t", "content", I.address("x"))
    assert evidence.TypedEvidence.from_json(entry.to_json()) == entry and entry.chain_hash == I.address(I.address("content") + I.address("x"))
    for bad in ('{"entry_id": 1}', "{", entry.to_json().replace("Gate", "Other")):
        with pytest.raises(ValueError):
            evidence.TypedEvidence.from_json(bad)


def test_a_long_log_is_read_in_splits(spark, tmp_path):
    path = str(tmp_path / "long.tsv")
    w = chain.ChainWriter(path, "evidence", evidence.EVIDENCE_COLUMNS)
    for i in range(300):
        w.append(i, "index", "a" * 50, "b")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "4096")
    try:
        lines = logs.numbered_lines(spark, path)
        assert lines.rdd.getNumPartitions() > 1 and sorted(r.pos for r in lines.collect()) == list(range(1, 301))
        assert logs.read_log(spark, path, "evidence").count() == 300
    finally:
        spark.conf.set(key, before)


def test_deep_sources_are_read():
    deep = b"fn a() { " + b"{" * 4000 + b" b(); " + b"}" * 4000 + b" }\nfn b() {}\n"
    assert [(r[2], r[3]) for r in braces.rust("p", deep).out if r[2] == "call"] == [("call", "b")]
    assert len(braces.rust("p", b"fn a() { if x {} " + b"else if y {} " * 2000 + b"}").out) > 2000
    assert len(braces.typescript("p", b"function a() { " + b"if (x) " * 2000 + b"b(); }").out) > 2000
    assert len(python.extract("p", b"x = " + b"+".join([b"a"] * 4000)).out) == 4001
    assert [r[2:4] for r in python.extract("p", b"x = " + b"(" * 5000).out][0][0] == "failed"


def test_blocks_of_a_single_log(spark, monkeypatch):
    monkeypatch.setattr(chain, "BLOCK_ROWS", 7)
    monkeypatch.setattr(stats, "BLOCK_ROWS", 7)
    rows = [(i, f"h{i}", float((i * 37) % 23)) for i in range(3, 60)]
    df = spark.createDataFrame(rows, "pos bigint, chain_hash string, fitness double").repartition(4)
    got = {r.pos: r.before for r in chain.before(df, "chain_hash", "g").collect()}
    assert got == {i: "g" if i == 3 else f"h{i - 1}" for i, *_ in rows}
    best, want = -1.0, {}
    for i, _, f in rows:
        want[i], best = f > best, max(best, f)
    assert {r.pos: r.improved for r in stats.improvements(df, "pos").collect()} == want
