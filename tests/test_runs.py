"""Run settings, datasets of every form, sinks, statistics, parent choice and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import corpus, evaluation, flywheel
from millrace.sources import files


def test_run_config():
    text = "run:\n  id: demo  # name\n  target: 5\n  share: 0.5\n  resume: true\n\n# pools\npaths:\n  pool: []\n  seeds:\n    - a.jsonl\n    - 'b c'\nmodes: [DP, DT]\nnothing:\n"
    assert files.run_config(text) == {"run": {"id": "demo", "target": 5, "share": 0.5, "resume": True}, "paths": {"pool": [], "seeds": ["a.jsonl", "b c"]}, "modes": ["DP", "DT"], "nothing": None}
    assert files.run_config("") == {}
    with pytest.raises(ValueError):
        files.run_config("a: 1\n    b: 2\n")


def test_datasets_of_every_form(spark, tmp_path):
    rows = [{"q": "a"}, {"q": "b"}]
    (tmp_path / "l.json").write_text(json.dumps(rows))
    (tmp_path / "d.json").write_text(json.dumps({"data": rows, "n": 2}))
    (tmp_path / "r.json").write_text(json.dumps({"records": rows}))
    (tmp_path / "x.jsonl").write_text("\n".join(map(json.dumps, rows)))
    spark.createDataFrame([("a",), ("b",)], "q string").write.parquet(str(tmp_path / "p.parquet"))
    for name in ("l.json", "d.json", "r.json", "x.jsonl", "p.parquet"):
        path = str(tmp_path / name)
        got = spark.read.parquet(path) if name == "p.parquet" else files.read_dataset(spark, path)
        assert sorted(r.q for r in got.collect()) == ["a", "b"], name
    folder = tmp_path / "set"
    folder.mkdir()
    (folder / "dev.jsonl").write_text('{"q": "c"}')
    assert files.resolve_dataset(spark, str(folder), "dev").endswith("dev.jsonl")
    (folder / "OptiBench.json").write_text('[{"q": "d"}]')
    assert files.read_dataset(spark, str(folder), "dev").first().q == "d"
    with pytest.raises(FileNotFoundError):
        files.read_dataset(spark, str(tmp_path / "none"))
    ids = files.with_sample_id(files.read_dataset(spark, str(tmp_path / "l.json")))
    assert sorted((r.sample_id, r.q) for r in ids.collect()) == [(0, "a"), (1, "b")]
    assert files.with_sample_id(ids).columns == ids.columns


def test_bad_lines_are_named(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{broken\n[2]\n')
    got = files.bad_lines(spark, str(tmp_path / "a.jsonl")).collect()
    assert [(r.line, r.text) for r in got] == [(3, "{broken")] and got[0].path.endswith("a.jsonl")


def test_sinks(spark, tmp_path):
    path, one, two = str(tmp_path / "t"), spark.range(1), spark.range(2)
    files.replace_table(one, path)
    files.replace_table(spark.read.parquet(path).union(two), path)
    assert spark.read.parquet(path).count() == 3 and [p.name for p in tmp_path.iterdir()] == ["t"]
    once = str(tmp_path / "o")
    assert not files.ready(spark, once) and files.write_once(one, once) and files.ready(spark, once)
    assert not files.write_once(two, once) and spark.read.parquet(once).count() == 1 and files.write_once(two, once, overwrite=True)
    files.write_json(one, str(tmp_path / "m"))
    assert json.loads("\n".join(r.value for r in spark.read.text(str(tmp_path / "m"), wholetext=True).collect())) == {"id": 0}
    files.clear_outputs(spark, str(tmp_path), ["t"], resume=True)
    assert files.exists(spark, path)
    files.clear_outputs(spark, str(tmp_path), ["t", "none"])
    assert not files.exists(spark, path) and files.exists(spark, once)


def test_statistics(spark):
    df = spark.createDataFrame([(True, False), (False, False), (True, True), (False, None)], "ok boolean, no boolean")
    r = evaluation.final_statistics(df, F.col("ok"), F.col("no"), ~F.col("ok")).first()
    assert (r.total, r.evaluated, r.unsupported, r.successful, r.api_errors, r.accuracy) == (4, 3, 1, 1, 2, 1 / 3)
    assert evaluation.final_statistics(df.limit(0), F.col("ok"), F.col("no"), F.col("ok")).first().accuracy == 0
    assert [x.id for x in evaluation.at_places(spark.range(10), "id", 2, 8, 3).collect()] == [2, 3, 4]
    v = corpus.training_volume(spark.createDataFrame([(10,), (30,)], "t long"), F.col("t"), 8, 2, 5).first()
    assert (v.tokens, v.sequences, v.consumed, v.epochs) == (40, 2, 80, 2.0)


def test_parents(spark):
    dims = ["a", "b"]
    jobs = spark.createDataFrame([(j, "x", "y") for j in range(200)], "job long, a string, b string")
    seeds = spark.createDataFrame([(p, "x", "y" if p < 2 else "z") for p in range(6)], "parent long, a string, b string")
    made = spark.createDataFrame([(100 + p, "x", "z") for p in range(6)], "parent long, a string, b string")
    pick = lambda mode, **kw: flywheel.parent_candidates(jobs, seeds, made, dims, "s", mode, k=4, **kw).collect()
    assert {r.parent < 100 for r in pick("seed_only")} == {True} and {r.parent < 100 for r in pick("synthetic_only")} == {False}
    from_made = {r.job for r in pick("hybrid", share=0.3) if r.parent >= 100}
    assert 30 < len(from_made) < 90
    assert all(r.score < 2 for r in pick("seed_only", exact_probability=0.0))
    kept = {r.job for r in pick("seed_only", exact_probability=0.5) if r.score == 2}
    assert 60 < len(kept) < 140
    both = flywheel.parent_candidates(jobs, seeds, made, dims, "s", "snowball", k=4)
    out, usage = flywheel.choose_parents(both, {0: 10_000}, "s", penalty=1.0)
    assert len(out) == 200 and sum(usage.values()) == 10_200 and usage[0] < 10_020
    again, _ = flywheel.choose_parents(both, {0: 10_000}, "s", penalty=1.0)
    assert again == out


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from millrace import __main__ as cli

    monkeypatch.setattr(cli, "session", lambda: spark)
    assert cli.main(["list"]) == 0 and "jaccard_pairs" in capsys.readouterr().out
    assert cli.main(["run", "none", str(tmp_path)]) == 2
    good = {"id": "1", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "metadata": dict(mode="DP", domain="generic", structure="blending", difficulty="small", data_interface="inline_text", answer_style="math_model")}
    (tmp_path / "r.jsonl").write_text(json.dumps(good) + "\n")
    assert cli.main(["validate", str(tmp_path / "r.jsonl")]) == 0 and "rows 1, with issues 0" in capsys.readouterr().out
    (tmp_path / "r.jsonl").write_text(json.dumps(good) + "\n" + json.dumps({"id": "2", "messages": []}) + "\n")
    assert cli.main(["validate", str(tmp_path / "r.jsonl")]) == 1
    assert cli.main(["inspect", str(tmp_path), "r.jsonl", "none.jsonl"]) == 0 and "r.jsonl" in capsys.readouterr().out
