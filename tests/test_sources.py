"""Archives and streams on small files."""

import json
import zipfile

import pytest

from stepwright.operators import gates
from stepwright.sources import archives
from stepwright.sources import lines as lines_source
from stepwright.sources.schemas import EVALUATION, METRIC, PROBLEM, PRM_SHEET, TRAJECTORY
from stepwright.streaming import latest, log_table


@pytest.mark.parametrize("schema", [PROBLEM, TRAJECTORY, METRIC, EVALUATION, f"sheet {PRM_SHEET}"])
def test_schemas_parse(spark, schema):
    assert spark.createDataFrame([], schema).count() == 0


def test_tolerant_log_keeps_the_last_line_of_a_key(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"k":"a","n":1}\n\n{"k":"a","n":2}\n{"k":"b","n":1}\n{"k": broken\n')
    df = archives.read_jsonl(spark, str(tmp_path / "log.jsonl"), "k string, n int", strict=False)
    assert sorted((r["k"], r["n"]) for r in archives.last_per_key(df, ["k"], ["n"]).collect()) == [("a", 2), ("b", 1)]
    assert [tuple(r) for r in archives.bad_lines(spark, str(tmp_path / "log.jsonl")).collect()] == [("log.jsonl", 5, '{"k": broken')]
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        archives.read_jsonl(spark, str(tmp_path / "log.jsonl"), "k string, n int").collect()


def make_archive(tmp_path, broken: str = ""):
    d = tmp_path / "run"
    d.mkdir()
    (d / "problems.jsonl").write_text('{"id":"p"}\n')
    (d / "trajectories.jsonl").write_text('{"problem_id":"p"}\n{"problem_id":"p"}\n')
    (d / "generation_health.csv").write_text("agent,records\na,2\n")
    import hashlib

    sha = {n: hashlib.sha256((d / n).read_bytes()).hexdigest() for n in ("problems.jsonl", "trajectories.jsonl", "generation_health.csv")}
    if broken == "digest":
        sha["problems.jsonl"] = "0" * 64
    (d / "generation_manifest.json").write_text(json.dumps({"problem_count": 1, "trajectory_count": 3 if broken == "count" else 2, "sha256": sha}))
    return archives.export_zip(str(d), str(tmp_path / "run.zip"))


def test_archive_validates(spark, tmp_path):
    assert archives.validate_archive(spark, make_archive(tmp_path)) == {"problems": 1, "trajectories": 2}


def test_an_archive_of_600_rows_by_the_command(spark, tmp_path, capsys):
    import hashlib

    d = tmp_path / "batch"
    d.mkdir()
    (d / "problems.jsonl").write_text("".join(json.dumps({"id": f"p{i}"}) + "\n" for i in range(100)))
    (d / "trajectories.jsonl").write_text("".join(json.dumps({"agent_name": f"a{k}", "problem_id": f"p{i}"}) + "\n" for k in range(6) for i in range(100)))
    (d / "generation_health.csv").write_text("agent,records\n" + "".join(f"a{k},100\n" for k in range(6)))
    sha = {f.name: hashlib.sha256(f.read_bytes()).hexdigest() for f in d.iterdir()}
    (d / "generation_manifest.json").write_text(json.dumps({"problem_count": 100, "trajectory_count": 600, "sha256": sha}))
    path = archives.export_zip(str(d), str(tmp_path / "batch.zip"))
    assert archives.main([path]) == 0 and "trajectories: 600" in capsys.readouterr().out
    (d / "trajectories.jsonl").write_text("{}\n")
    assert archives.main([archives.export_zip(str(d), str(tmp_path / "bad.zip"))]) == 1


def test_bundles_are_extracted_in_the_shared_folder(tmp_path):
    from types import SimpleNamespace as Has

    session = lambda folder, master: Has(conf=Has(get=lambda name, default: folder), sparkContext=Has(master=master))
    path = make_archive(tmp_path)
    assert archives.open_bundle(path, session(f"file://{tmp_path}/shared", "spark://host")).startswith(f"{tmp_path}/shared/")
    with pytest.raises(ValueError, match="share"):
        archives.open_bundle(path, session(None, "spark://host"))


@pytest.mark.parametrize(("broken", "says"), [("digest", "mismatch"), ("count", "declared")])
def test_archive_with_a_fault_is_refused(spark, tmp_path, broken, says):
    with pytest.raises(ValueError, match=says):
        archives.validate_archive(spark, make_archive(tmp_path, broken))


def test_zip_members_stay_inside(tmp_path):
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../out.txt", "x")
    with pytest.raises(ValueError, match="outside"):
        archives.open_bundle(str(tmp_path / "bad.zip"))


def test_writers_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "k int, v string")
    archives.write_jsonl(df, str(tmp_path / "j"))
    archives.append_jsonl(df, str(tmp_path / "j"))
    assert archives.read_jsonl(spark, str(tmp_path / "j"), "k int, v string").count() == 4
    archives.write_csv(df, str(tmp_path / "c"))
    assert archives.read_csv(spark, str(tmp_path / "c"), "k int, v string").count() == 2
    m = archives.build_manifest(spark, str(tmp_path / "c"), "tables", {"rows": 2}, "2024-01-01T00:00:00Z")
    assert m["rows"] == 2 and all(len(x) == 64 for x in m["sha256"].values())


def test_secret_scan(spark):
    df = spark.createDataFrame([("a", "key = hf_" + "A" * 30), ("b", "nothing")], "name string, text string")
    assert [r["name"] for r in archives.scan_secrets(df).collect()] == ["a"]


def test_stream_upsert_over_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, rows in enumerate(([("a", 1), ("b", 1)], [("a", 2)], [("b", 0), ("c", 5)])):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps({"k": k, "n": n}) for k, n in rows) + "\nbroken\n")
    stream = latest.read_log(spark, str(tmp_path / "in"), "k string, n int", per_trigger=1)
    latest.upsert_latest(stream, ["k"], ["n"], str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    got = latest.latest_rows(spark, str(tmp_path / "t")).collect()
    assert sorted((r["k"], r["n"]) for r in got) == [("a", 2), ("b", 1), ("c", 5)]


def test_stream_windows(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:00:10", "x", 1.0), ("2024-01-01 00:00:50", "x", 3.0), ("2024-01-01 00:05:00", "y", 2.0)], "ts string, k string, v double").selectExpr("timestamp(ts) ts", "k", "v").write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema("ts timestamp, k string, v double").parquet(str(tmp_path / "e"))
    q = latest.windowed_rates(s, "ts", "k", "v", "1 minute", "10 minutes").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["k"], r["n"], r["mean"]) for r in spark.sql("SELECT * FROM w").collect()) == [("x", 2, 2.0), ("y", 1, 2.0)]


def test_exported_run_loads_again(spark, tmp_path):
    tables = {"metrics.jsonl": spark.createDataFrame([(1, None), (2, "x")], "k int, v string"), "core.csv": spark.createDataFrame([("a", 0.5)], "agent string, c double")}
    m = archives.export_run(str(tmp_path / "run"), tables, "metrics", "2024-01-01T00:00:00Z")
    assert m["metrics_count"] == 2 and set(m["sha256"]) == set(tables)
    schemas = {"metrics.jsonl": "k int, v string", "core.csv": "agent string, c double"}
    path = archives.export_zip(str(tmp_path / "run"), str(tmp_path / "run.zip"))
    loaded = archives.load_run(spark, path, schemas)
    assert loaded["metrics.jsonl"].count() == 2 and loaded["core.csv"].first()["c"] == 0.5
    (tmp_path / "run" / "core.csv").write_text("agent,c\na,0.9\n")
    with pytest.raises(ValueError, match="mismatch"):
        archives.load_run(spark, str(tmp_path / "run"), schemas)


@pytest.mark.parametrize("split_bytes", [7, 64, 1000, 1 << 20])
def test_lines_of_several_splits_have_their_numbers(spark, tmp_path, split_bytes):
    import random

    rng, want = random.Random(4), []
    for k in range(3):
        data = b"".join(b"x" * rng.choice([0, 0, 1, 5, 30, 200]) + rng.choice([b"\n", b"\r\n", b"\n\n"]) for _ in range(60)) + rng.choice([b"", b"tail"])
        (tmp_path / f"f{k}.jsonl").write_bytes(data)
        lines = data.split(b"\n")
        want += [(f"f{k}.jsonl", i + 1, x.removesuffix(b"\r").decode()) for i, x in enumerate(lines[:-1] if lines[-1] == b"" else lines)]
    (tmp_path / "_hidden").write_text("x\n")
    (tmp_path / "empty.jsonl").write_text("")
    assert sorted(map(tuple, lines_source.numbered_lines(spark, str(tmp_path), split_bytes).collect())) == sorted(want)


@pytest.mark.parametrize("split_bytes", [50, 1 << 20])
def test_bad_lines_are_named_by_file_and_line(spark, tmp_path, split_bytes):
    lines = ['{"a": %d}' % i if i % 7 else ["", "  ", "[1]", "7", '{"a"', "null", '"x"'][i // 7 % 7] for i in range(200)]
    (tmp_path / "rows.jsonl").write_text("\n".join(lines))
    want = []
    for n, line in enumerate(lines, 1):
        try:
            good = not line.strip() or isinstance(json.loads(line), dict)
        except ValueError:
            good = False
        if not good:
            want.append(("rows.jsonl", n, line))
    assert sorted(map(tuple, archives.bad_lines(spark, str(tmp_path / "rows.jsonl"), split_bytes).collect())) == sorted(want)


def test_archives_are_read_and_counted_by_agent(spark, tmp_path):
    (tmp_path / "all").mkdir()
    make_archive(tmp_path)
    (tmp_path / "run.zip").rename(tmp_path / "all" / "one.zip")
    with zipfile.ZipFile(tmp_path / "all" / "two.zip", "w") as z:
        z.writestr("sub/trajectories.jsonl", "".join(json.dumps({"agent_name": f"a{i % 6}", "problem_id": i}) + "\n" for i in range(600)))
        z.writestr("sub/problems.jsonl", '{"id": 1}\n[2]\n')
        z.writestr("other/problems.jsonl", '{"id": 1}\n')
    rows = archives.read_archive(spark, str(tmp_path / "all"))
    got = {(r["archive"], r["agent"]): r["records"] for r in archives.records_by_agent(rows).collect()}
    assert got == {("one.zip", None): 2, **{("two.zip", f"a{i}"): 100 for i in range(6)}}
    assert {(r["archive"], r["name"]): r["problem"] for r in archives.archive_problems(rows).collect() if r["problem"]} == {("two.zip", "generation_manifest.json"): "missing", ("two.zip", "generation_health.csv"): "missing", ("two.zip", "problems.jsonl"): "doubled"}
    with pytest.raises(Exception, match="line 2"):
        archives.archive_records(rows.filter("archive = 'two.zip' and bytes is null"), "problems.jsonl", "id int").collect()


def test_folders_are_validated_as_archives_are(spark, tmp_path):
    make_archive(tmp_path)
    assert archives.validate_archive(spark, str(tmp_path / "run")) == {"problems": 1, "trajectories": 2}
    (tmp_path / "run" / "problems.jsonl").unlink()
    with pytest.raises(ValueError, match="missing"):
        archives.validate_archive(spark, str(tmp_path / "run"))


def folder_bytes(path) -> dict:
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*") if f.is_file() and not f.name.startswith(".")}


def test_log_table_keeps_the_last_row_and_writes_what_came(spark, tmp_path):
    import random

    rng, want = random.Random(2), {}
    table = log_table.LogTable(spark, str(tmp_path / "t"), ["k"], ["n"], "k string, n int, v string", buckets=4, max_deltas=3)
    for epoch in range(9):
        rows = [(f"k{rng.randint(0, 40)}", rng.randint(0, 1000), f"{epoch}-{i}") for i in range(25)]
        for r in rows:
            want[r[0]] = max(want.get(r[0], r), r, key=lambda r: (r[1], r[2]))
        assert table.append(spark.createDataFrame(rows, "k string, n int, v string"), epoch)
        assert all(len(f) <= 4 for f in table.live().values())
        assert sorted((r["k"], r["n"]) for r in table.read().collect()) == sorted((k, r[1]) for k, r in want.items())
    before = folder_bytes(tmp_path / "t")
    assert not table.append(spark.createDataFrame([("new", 1, "x")], "k string, n int, v string"), 5)
    assert folder_bytes(tmp_path / "t") == before
    one = [("k1", 2000, "last")]
    table.max_deltas = 100
    assert table.append(spark.createDataFrame(one, "k string, n int, v string"), 9)
    new = [f for f in folder_bytes(tmp_path / "t") if f not in before and f.endswith(".parquet")]
    assert len(new) == 1  # one row, one bucket, one file
    assert table.vacuum() and {r["k"]: r["n"] for r in log_table.LogTable(spark, str(tmp_path / "t")).read().collect()}["k1"] == 2000
    assert table.compact(1) and all(len(f) == 1 for f in table.live().values())
    assert len(table.read().collect()) == len(want)


def test_log_table_of_nothing(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        log_table.LogTable(spark, str(tmp_path / "no"))
    table = log_table.LogTable(spark, str(tmp_path / "t"), ["k"], ["n"], "k string, n int")
    assert table.append(spark.createDataFrame([], "k string, n int"), 0) and table.read().collect() == []


def attempts_of(spark, rows):
    return spark.createDataFrame(rows, "agent string, problem_id int, stop_reason string, valid boolean, truncated_steps int, needs_judge boolean, critic_errors int")


GOOD = [("a", 1, "explicit_final_answer", True, 0, False, 0), ("a", 2, "max_steps", True, 1, None, None), ("b", 1, "explicit_final_answer", True, 0, False, 0)]


def test_gates_let_a_sound_run_pass_in_one_job(spark, tmp_path):
    all_gates = [gates.count_gate(3), gates.infrastructure_gate(), *gates.smoke_gates(["a", "b"], 0.9, 1)]
    report = gates.publish(attempts_of(spark, GOOD), str(tmp_path), "run", all_gates)
    assert all(ok for _, _, ok, _ in report) and spark.read.parquet(str(tmp_path / "run")).count() == 3
    assert [p.name for p in tmp_path.iterdir()] == ["run"]
    with pytest.raises(FileExistsError):
        gates.publish(attempts_of(spark, GOOD), str(tmp_path), "run", all_gates)


@pytest.mark.parametrize(
    ("rows", "says"),
    [(GOOD[:2], "rows: 2"), ([*GOOD[:2], ("b", 1, "api_error", True, 0, False, 0)], "infrastructure: 1, first .*api_error"), ([*GOOD[:2], ("b", 1, "x", False, 0, False, 0)], "b.completion: 0.0"), ([*GOOD[:2], ("b", 1, "x", True, 2, True, 1)], "b.truncated: 2; b.judge_queue: 1; b.critic_errors: 1"), ([*GOOD[:2], (None, 1, "x", True, 0, False, 0)], "unknown_agents: 1; b.completion: None"), ([], "rows: 0")],
)
def test_gates_fail_closed(spark, tmp_path, rows, says):
    with pytest.raises(gates.GateError, match=says):
        gates.publish(attempts_of(spark, rows), str(tmp_path), "run", [gates.count_gate(3), gates.infrastructure_gate(), *gates.smoke_gates(["a", "b"], 0.9, 1)])
    assert list(tmp_path.iterdir()) == []
