"""Core operators on small hand-written cases and against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from millrace import vocab
from millrace.functions import text as T
from millrace.functions.lineage import numbered
from millrace.operators import code, corpus, evaluation, flywheel, lp, records, retrieval, similarity
from millrace.sources import files
from millrace.streaming import attempts


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,want",
    [
        ("plain", "plain"),
        ("intro Problem: a\r\nb", "a\nb"),
        ("Question: x Question: y", "y"),
        ("[TAG]\ndropped\nalso\n\nkept", "kept"),
        ("[note] gone\nkept\n\n\n\nend  ", "kept\n\nend"),
    ],
)
def test_strip_prompt(spark, text, want):
    assert one(spark, T.strip_prompt("t"), t=text) == want


def test_messages(spark):
    df = spark.createDataFrame([([("system", "s"), ("user", " u1 "), ("assistant", "a1"), ("user", "u2")],), ([],)], "messages array<struct<role:string,content:string>>")
    got = df.select(T.last_message("messages", "user").alias("l"), T.first_message("messages", "user").alias("f"), T.last_message("messages", "assistant").alias("a")).collect()
    assert [tuple(g) for g in got] == [("u2", "u1", "a1"), ("", "", "")]
    shots = df.limit(1).select(retrieval.with_examples(F.col("messages"), F.array(F.struct(F.lit("q").alias("user"), F.lit("r").alias("assistant")))).alias("m")).first()["m"]
    assert [m["content"] for m in shots] == ["s" + vocab.EXAMPLES_SYSTEM, "[Few-shot example 1; not the current problem]\nq", "r", "[Current problem to solve]\n u1 ", "a1", "[Current problem to solve]\nu2"]


@pytest.mark.parametrize(
    "reply,first,solver",
    [
        ("a ```python\nx=1\n``` b ```python\nlonger=2\n```", "longer=2", "longer=2"),
        ("```python\nhidden_long_code=1\n``` </think> ```python\ny=2\n```", "y=2", "hidden_long_code=1"),
        ("```\nbare\n```", "bare", "bare"),
        ("<python>tag()</python>", "<python>tag()</python>", "tag()"),
        ("no </think> after", "after", "after"),
        ("none", "none", "none"),
        (None, "", ""),
    ],
)
def test_python_code(spark, reply, first, solver):
    df = spark.createDataFrame([(reply,)], "r string")
    got = df.select(T.python_code("r").alias("a"), T.python_code("r", after_thought_first=False).alias("b")).first()
    assert (got.a, got.b) == (first, solver)


def test_text_issues_and_gate(spark):
    meta = dict(mode="DP", domain="generic", structure="blending", difficulty="small", data_interface="inline_text", answer_style="math_model")
    pair = lambda u, a: [("user", u), ("assistant", a)]
    rows = [
        (pair("good question", "good answer"), meta),
        (pair("a TODO here", "N/A"), meta),
        (pair("", "x"), meta),
        ([("user", "x")], meta),
        (pair("no table", "x"), {**meta, "mode": "DT", "data_interface": "markdown_table"}),
        (pair("a | b", "x"), {**meta, "mode": "DT", "data_interface": "inline_text"}),
        (pair("### data.csv\n```csv\n1\n```", "x"), {**meta, "mode": "DPS", "data_interface": "attached_files"}),
        (pair("x", "y"), {**meta, "domain": "odd", "difficulty": ""}),
    ]
    df = spark.createDataFrame(rows, "m array<struct<role:string,content:string>>, d struct<mode:string,domain:string,structure:string,difficulty:string,data_interface:string,answer_style:string>")
    got = [g.x for g in df.select(records.sft_issues(F.col("m"), F.col("d")).alias("x")).collect()]
    assert got == [
        [],
        ["user:forbidden:todo", "assistant:forbidden:na"],
        ["user:empty_text"],
        ["messages_must_be_user_assistant_pair"],
        ["mode_content_mismatch:DT_requires_markdown_table"],
        ["mode_data_interface_mismatch:DT_requires_markdown_table"],
        [],
        ["missing_metadata:difficulty", "invalid_metadata:domain"],
    ]
    lengths = spark.createDataFrame([("p" * 39, "a" * 80), ("p" * 40, "a" * 79), ("p" * 40, "a" * 80), ("sk-A" + "p" * 50, "a" * 30000)], "p string, a string").crossJoin(df.select("d").limit(1))
    got = [g.x for g in lengths.select(records.candidate_issues(F.col("p"), F.col("a"), F.col("d")).alias("x")).collect()]
    assert got == [["problem_too_short"], ["answer_too_short"], [], ["sample_too_long", "problem:private_api_or_key"]]


def test_sanitize_and_ir(spark):
    df = spark.createDataFrame([(0, None, "Problem: what | is", None, "ans", "dt", "energy"), (1, [("user", "u"), ("assistant", "a")], None, None, None, None, None)], "index long, messages array<struct<role:string,content:string>>, question string, problem string, output string, mode string, domain string")
    got = records.sanitize(df).orderBy("index" if "index" in records.sanitize(df).columns else "problem").collect()
    by = {g.problem: g for g in got}
    assert by["what | is"].metadata.mode == "DT" and by["what | is"].metadata.data_interface == "markdown_table" and by["what | is"].metadata.domain == "energy"
    assert by["u"].answer == "a" and by["u"].metadata.difficulty == "medium" and by["u"].id.startswith("seed_")
    ir = records.seed_to_ir(records.sanitize(df))
    assert {tuple(g.x) for g in ir.select(records.ir_issues().alias("x")).collect()} == {()}


def test_first_without_conflict_is_the_greedy_loop(spark):
    r = random.Random(0)
    for _ in range(3):
        n = 60
        edges = {tuple(sorted(r.sample(range(n), 2))) for _ in range(90)}
        place = list(range(n))
        r.shuffle(place)
        taken = set()
        for i in sorted(range(n), key=lambda i: place[i]):
            if not any((min(i, j), max(i, j)) in edges for j in taken):
                taken.add(i)
        got = similarity.first_without_conflict(spark.createDataFrame(list(enumerate(place)), "id long, place long"), spark.createDataFrame(sorted(edges), "a long, b long"))
        assert {g.id for g in got.collect()} == taken


def test_jaccard_pairs_against_brute_force(spark):
    r = random.Random(1)
    sets = [(i, sorted({r.choice("abcdefghijkl") + r.choice("xyz") for _ in range(r.randint(0, 14))})) for i in range(120)]
    sets += [(200 + i, s) for i, (_, s) in enumerate(sets[:20])]
    for limit in (0.5, 0.82):
        got = {(g.a, g.b): g.jaccard for g in similarity.jaccard_pairs(spark.createDataFrame(sets, "id long, tokens array<string>"), limit).collect()}
        want = {(a, b): len(set(x) & set(y)) / len(set(x) | set(y)) for a, x in sets for b, y in sets if a < b and x and y and len(set(x) & set(y)) / len(set(x) | set(y)) > limit}
        assert got == pytest.approx(want)


def test_mode_targets():
    assert records.mode_targets({"DP": 999, "DT": 999, "DPS": 999}, 200) == {"DP": 70, "DT": 50, "DPS": 80}
    assert records.mode_targets({"DP": 10, "DT": 999, "DPS": 5}, 100) == {"DP": 10, "DT": 85, "DPS": 5}
    assert sum(records.mode_targets({"DP": 1, "DT": 1, "DPS": 1}, 10).values()) == 3


def test_numbered_shards_epochs(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "k long")
    assert [g.n for g in numbered(df, "k").orderBy("k").collect()] == list(range(101))
    assert sorted({g.shard for g in corpus.shards(df, ["k"], 10).collect()}) == list(range(11))
    with pytest.raises(ValueError):
        corpus.shards(df, ["k"], 500)
    e = corpus.epochs(df, "k", 150, "1").orderBy("position").collect()
    assert len(e) == 202 and sorted(x.id for x in e[:101]) == list(range(101)) and [x.id for x in e[:101]] != [x.id for x in e[101:]]
    assert numbered(df.limit(0), "k").count() == 0


def test_mixture_and_logs(spark):
    lines = spark.createDataFrame([("# c",), ("",), ("0.5 /a b",), ("/only/path",), ("x /p",)], "value string")
    assert {tuple(g) for g in corpus.mixture(lines).collect()} == {(0.5, "/a b"), (1.0, "/only/path"), (1.0, "x /p")}
    log = " iteration       12/  280 | consumed | learning rate: 1.000E-05 | lm loss: 2.5E+00 | grad norm: 0.7 | throughput per device (TFLOP/s): 123.4 |"
    got = spark.createDataFrame([(log,), ("nothing",)], "l string").select(*corpus.log_metrics(F.col("l"))).collect()
    assert tuple(got[0]) == (12, 2.5, 1e-5, 123.4, 0.7) and set(got[1]) == {None}
    plan = corpus.conversions(spark.createDataFrame([("#x",), ("n in out 4",)], "value string")).first()
    assert tuple(plan) == ("n", "in", "out", 4, 1, 1000)


@pytest.mark.parametrize(
    "answer,items,question,want",
    [
        ("1,200", [], "q", (1200.0, "answer")),
        (None, [("x", 3.0)], "q", (3.0, "single")),
        (None, [("Total cost", 5.0), ("x", 1.0), ("maximum profit", 7.0)], "q", (7.0, "objective")),
        (None, [("number of buses", 2.0), ("number of cars", 4.0)], "How to minimize the total number of vehicles?", (6.0, "question")),
        (None, [("buses", 2.0), ("cars", 4.0)], "Minimize the total number of buses needed.", (2.0, "question")),
        (None, [("buses", 2.0), ("cars", 4.0)], "q", None),
    ],
)
def test_ground_truth(spark, answer, items, question, want):
    df = spark.createDataFrame([(answer, items, question)], "a string, i array<struct<k:string,v:double>>, q string")
    got = df.select(T.ground_truth(F.col("a"), F.col("i"), F.col("q")).alias("x")).first()["x"]
    assert (got and tuple(got)) == want


def test_errors_and_tolerance(spark):
    df = spark.createDataFrame([("API_ERROR: timeout",), ("KeyError: NameError",), ("IndexError",), ("can't multiply sequence",), ("fine",), (None,)], "p string")
    assert [g.x for g in df.select(T.build_error("p").alias("x")).collect()] == ["api_error", "name_error", "index_error", "type_error", "other_build_error", "other_build_error"]
    checks = spark.createDataFrame([({"var_num_check": True, "cons_num_check": False}, ""), ({"wl_check": False}, ""), ({"b": False, "a": False}, ""), (None, "No reference LP"), ({}, "x")], "c map<string,boolean>, t string")
    got = [g.x for g in checks.select(T.equivalence_error(F.coalesce("c", F.create_map().cast("map<string,boolean>")), F.col("t")).alias("x")).collect()]
    assert got == ["constraint_count_mismatch", "wl_graph_mismatch", "structure_mismatch:a,b", "missing_reference_lp", "other_equivalence_error"]
    near = spark.createDataFrame([(1.0, 1.0 + 9e-7), (1.0, 1.0 + 2e-6), (None, 1.0)], "a double, b double")
    assert [g.x for g in near.select(evaluation.within(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False, False]


LP = """\\ comment
Maximize
  obj: 3 x[0] + 2 y - 1e-1 z + [ x[0] ^ 2 + 2 x[0] * y ] / 2
Subject To
 c1: x[0] + 2 y
   + z <= 10
 c2: x[0] - y >= -2
 lim: 2 z <= 8
Bounds
 y free
 -1 <= z <= 5
Binaries
 x[0]
End
"""


def test_parse_lp(spark):
    m = lp.parse_lp(LP)
    assert m["sense"] == "max" and m["quadratic"]
    assert m["vars"] == {"x[0]": [3.0, "B", 0.0, 1.0], "y": [2.0, "C", -lp.INF, lp.INF], "z": [-0.1, "C", -1.0, 5.0]}
    assert m["cons"] == [("c1", "<", 10.0, {"x[0]": 1.0, "y": 2.0, "z": 1.0}), ("c2", ">", -2.0, {"x[0]": 1.0, "y": -1.0}), ("lim", "<", 8.0, {"z": 2.0})]
    kinds = lp.read_lp(spark.createDataFrame([("m", LP), ("bad", "Minimize\n x\nSubject To\n nonsense\nEnd")], "model string, text string")).groupBy("model", "kind").count().collect()
    assert {(k.model, k.kind): k["count"] for k in kinds} == {("m", "model"): 1, ("m", "var"): 3, ("m", "con"): 3, ("m", "coef"): 6, ("bad", "error"): 1}


def model(cons, bounds="", obj="2 a + 3 b + 5 c"):
    return f"Minimize\n {obj}\nSubject To\n" + "\n".join(f" r{i}: {c}" for i, c in enumerate(cons)) + f"\nBounds\n{bounds}\nEnd\n"


def test_equivalence(spark):
    base = ["a + 2 b >= 3", "b + 4 c <= 7"]
    same = lambda x, y, **k: lp.equivalent(model(x), model(y), **k)["equal"]
    assert same(base, base) and same(base, base[::-1])
    renamed = lp.equivalent(model(base), model(["q + 2 r >= 3", "r + 4 s <= 7"], obj="2 q + 3 r + 5 s"))
    assert renamed["equal"]
    assert not same(base, ["a + 2 b >= 3", "b + 5 c <= 7"])
    assert lp.equivalent(model(base), model([*base, "a + c >= 1"]))["cons_num_check"] is False
    assert same([*base, "2 a <= 4"], base) is False and lp.equivalent(model([*base, "2 a <= 4"]), model(base, " a <= 2"))["equal"]
    assert same([*base, "a - b <= 0"], [*base, "- a + b >= 0"])
    assert not same([*base, "a + b >= 5"], [*base, "- a - b <= -5"])
    assert same([*base, "- a <= 0"], [*base, "- a <= 0"])
    twins = "Minimize\n a + b + c + d\nSubject To\n r: a + b >= 1\n s: c + d >= 1\nEnd\n"
    got = lp.equivalent(twins, twins)
    assert got["wl_check"] and not got["equal"] and lp.equivalent(twins, twins, sufficiency=False)["equal"]
    pairs = spark.createDataFrame([("p", model(base), model(base)), ("q", model(base), "Minimize\n x\nSubject To\n junk\nEnd")], "pair string, a string, b string")
    assert {g.pair: g.equal for g in lp.compare(pairs).collect()} == {"p": True, "q": None}


def test_code_rewriting(spark):
    src = "m = gp.Model('x')\nx = m.addVar()\nm.write('old.lp')\nm.optimize()\nprint(1)\n"
    assert 'm.write("/o.lp")' in code.writes_lp(src, "/o.lp") and "old.lp" not in code.writes_lp(src, "/o.lp")
    early = code.writes_lp(src, "/o.lp", before_solving=True)
    assert "optimize" not in early and early.index("m.update()") < early.index('m.write("/o.lp")')
    assert code.free_lower_bounds("x = model.addVars(3)\ny = model.addVars(2, lb=0)") == "x = model.addVars(3, lb=-GRB.INFINITY)\ny = model.addVars(2, lb=0)"
    assert code.model_name("q.addVar(1)\nq.addConstr(2)") == "q"
    with pytest.raises(ValueError):
        code.writes_lp(" ", "p")
    assert spark.createDataFrame([("m = Model()", "p"), ("", "p")], "c string, p string").select(code.lp_code("c", "p").alias("x")).collect()[1].x is None


def test_rounds_cache_and_quota(spark):
    def plan(first, n):
        df = spark.range(first, first + n).withColumnRenamed("id", "idx")
        return df.select("idx", F.sha2((F.col("idx") % 40).cast("string"), 256).alias("request_hash"), (F.col("idx") % 40).cast("string").alias("messages"))

    gate = lambda df: df.withColumn("ok", F.coalesce(F.col("content").isNotNull() & (F.col("idx") % 3 != 0), F.lit(False)))
    empty = spark.createDataFrame([], "request_hash string, content string")
    log, cache = flywheel.rounds(plan, gate, flywheel.echo, empty, target=20)
    got = log.groupBy("status").count().collect()
    count = {g.status: g["count"] for g in got}
    assert count["accepted"] == 20 and cache.count() <= 40
    assert [g.idx for g in log.where("status = 'accepted'").orderBy("idx").collect()] == [i for i in range(100) if i % 3][:20]
    again, more = flywheel.ask(plan(0, 10), cache, lambda m: 1 / 0)
    assert again.where("cached").count() == 10 and more.count() == 0
    assert flywheel.planned(10, 10, 5, 2.0, 100) == 0 and flywheel.planned(10, 8, 5, 1.5, 100) == 3 and flywheel.planned(10, 0, 95, 9, 100) == 5
    tries = []
    with pytest.raises(ZeroDivisionError):
        flywheel.with_retries(lambda m: tries.append(m) or 1 / 0, wait=0)("x")
    assert len(tries) == 3


def test_solver_backend(spark):
    s = flywheel.SubprocessSolver(timeout=5)
    assert s('print("x"); print(\'{"value": 2.5}\')') == {"status": "ok", "value": 2.5}
    assert s("import os\nos.system('true')")["status"] == "refused" and s("1/0")["status"] == "error"
    assert flywheel.SubprocessSolver(timeout=0.5)("while True: pass")["status"] == "timeout"


def test_retrieval(spark):
    pool = spark.createDataFrame([(i, ["w%d" % (i % 7), "w%d" % (i % 5), "all"]) for i in range(50)], "item long, tokens array<string>")
    q = spark.createDataFrame([(1, ["w1", "all"]), (2, ["w9"])], "query long, tokens array<string>")
    got = retrieval.bm25(q, pool, 3).collect()
    assert sorted(g.query for g in got) == [1, 1, 1, 2, 2, 2] and all(g["item"] != g.query for g in got)
    assert all(g.score == 0 for g in got if g.query == 2)  # no shared token: filled up in the order of ties
    picks = retrieval.random_examples(q.select("query"), pool.select("item"), 5, "s").collect()
    assert len(picks) == 10 and len({(p.query, p["item"]) for p in picks}) == 10


def test_files(spark, tmp_path):
    p = str(tmp_path / "a.jsonl")
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": null}\n')
    assert files.read_jsonl(spark, p, "a long").count() == 2
    assert files.read_jsonl(spark, [p, str(tmp_path / "none")], "a long").count() == 2
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "none"), "a long", strict=True).count()
    (tmp_path / "b.jsonl").write_text("{broken\n")
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "b.jsonl"), "a long").collect()
    files.write_jsonl(spark.createDataFrame([(None, "é")], "a long, b string"), str(tmp_path / "out"))
    assert '{"a":null,"b":"é"}' in "".join(f.read_text() for f in (tmp_path / "out").glob("part-*"))
    (tmp_path / "list.json").write_text('{"data": [{"x": 1}, {"x": 2}]}')
    assert files.read_json_list(spark, str(tmp_path / "list.json"), "data").count() == 2
    assert files.markdown(spark.createDataFrame([("a", 1.234)], "n string, p double"), percent=("p",)) == "| n | p |\n| --- | --- |\n| a | 1.23 |\n"
    (tmp_path / "o.json").write_text('{"k": [1]}')
    assert files.read_objects(spark, str(tmp_path / "o.json")).count() == 1


def test_streaming_append_is_once_per_key(spark, tmp_path):
    for k, rows in enumerate(['{"k": 1, "v": "a"}\n{"k": 1, "v": "b"}\n{"k": 2, "v": "c"}\n', '{"k": 2, "v": "d"}\n{"k": 3, "v": "e"}\n']):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.json").write_text(rows)
        stream = spark.readStream.schema("k long, v string").json(str(tmp_path / "in"))
        attempts.append_results(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), "k").awaitTermination(60)
    assert sorted((g.k, g.v) for g in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "a"), (2, "c"), (3, "e")]


def test_helpers(spark):
    assert one(spark, T.safe_name("t"), t="a b/é:c.1") == "a-b---c.1"
    assert one(spark, T.number("t"), t=" 1,234.5 ") == 1234.5 and one(spark, T.number("t"), t="x") is None
    assert one(spark, T.words_only("t"), t=" A-b  C! ") == "a b c"
    assert one(spark, T.map_domain("t"), t="health_pharma") == "healthcare" and one(spark, T.map_structure("t"), t="zzz") == "generic_lp_mip"
    assert str(one(spark, T.json_object("t").cast("string"), t='say ```json {"a": 1}``` ok')).replace(" ", "") == '{"a":1}'
    assert corpus.index_map_name("p", "train", 10, 3) == "p_train_indexmap_10ns_3s_shuffle_decoder_packed_idx.npy"
    assert set(vocab.MODE_SHARES) == set(vocab.PROBLEM_MODES)


def test_pairs_are_settled_by_centres(spark):
    """Groups of near sets, chains that no centre settles, copies and empty sets; no pair travels with its sets."""
    r = random.Random(5)
    base = [sorted({f"g{g}w{r.randrange(400)}" for _ in range(60)}) for g in range(4)]
    sets = [(i, sorted({*r.sample(base[i % 4], len(base[i % 4]) - 3), *(f"x{i}{k}" for k in range(r.randint(0, 5)))})) for i in range(60)]
    sets += [(100 + i, [f"c{k}" for k in range(3 * i, 3 * i + 40)]) for i in range(25)] + [(200 + i, sets[i][1]) for i in range(8)] + [(300, []), (301, [])]
    df = spark.createDataFrame(sets, "id long, tokens array<string>")
    jaccard = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    want = {(a, b): j for a, x in sets for b, y in sets if a < b and x and y and (j := jaccard(x, y)) > 0.82}
    assert {(g.a, g.b): g.jaccard for g in similarity.jaccard_pairs(df, 0.82).collect()} == pytest.approx(want)
    ids = [i for i, x in sets if x]
    cand = spark.createDataFrame([(a, b) for a in ids for b in ids if a < b and r.random() < 0.3], "a long, b long")
    ranked = similarity._ranked(df.where("size(tokens) > 0").selectExpr("id", "transform(tokens, x -> xxhash64(x)) AS hs"))
    tokens = dict(sets)
    for rounds in (1,):  # what one round leaves is compared by whole sets
        got = {(g.a, g.b): g.jaccard for g in similarity._verify(cand, ranked, rounds).collect()}
        assert got == pytest.approx({(c.a, c.b): jaccard(tokens[c.a], tokens[c.b]) for c in cand.collect()})
