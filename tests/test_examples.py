"""Few-shot pools and choices, candidates, selections, and the texts of records, against plain loops."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace import vocab
from millrace.functions import text as T
from millrace.operators import records, retrieval, similarity


def value(spark, column, **fields):
    return spark.createDataFrame([tuple(fields.values())], list(fields)).select(column.alias("x")).first()["x"] if fields else spark.range(1).select(column.alias("x")).first()["x"]


def test_white_space_of_any_kind_is_cut(spark):
    df = spark.createDataFrame([([("user", "\n hi\t\n"), ("assistant", "\r\nyes \n")],)], "messages array<struct<role:string,content:string>>")
    assert tuple(df.select(T.last_message("messages", "user"), T.first_message("messages", "assistant")).first()) == ("hi", "yes")
    assert value(spark, T.normalize_mode(F.lit("\ndps\t"))) == "DPS"
    assert value(spark, T.number(F.lit("\n1,234.5 "))) == 1234.5


def test_file_blocks(spark):
    head = "\n\nThe following structured data files are provided:"
    df = spark.createDataFrame([([("a.csv", "CSV", "x,y"), (None, None, "plain"), ("b.json", None, '{"k": 1}'), ("big.txt", "", "z" * 50)],), ([],), (None,)], "f array<struct<path:string,kind:string,content:string>>")
    got = [g.x for g in df.select(T.render_files("f", 20).alias("x")).collect()]
    assert got == [head + "\n\n### a.csv\n```csv\nx,y\n```" + "\n\n### data.txt\n```\nplain\n```" + '\n\n### b.json\n```json\n{"k": 1}\n```', "", ""]
    assert [g.x for g in df.select(T.render_files("f", 20, all_or_nothing=True).alias("x")).collect()] == ["", "", ""]
    assert value(spark, T.shorten(F.lit("a" * 300 + "b" * 300), 10)) == "aaaaa...bbbbb"


def test_geometry_and_prices(spark):
    box = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in (("Length of side of the square base", 3.0), ("The height of the box", 2.0))])
    q = F.lit("A box with an open top and a square base: find its surface area.")
    assert value(spark, T.open_top_box(q, box)) == 33.0
    assert value(spark, T.open_top_box(F.lit("A closed box"), box)) is None
    five = F.array(*[F.struct(F.lit(f"The quantity of Fertilizer {i}").alias("k"), F.lit(float(i)).alias("v")) for i in range(1, 6)])
    said = F.lit(" ".join(f"${i}.5 per 100 pounds," for i in range(1, 6)))
    assert value(spark, T.fertilizer_cost(said, five)) == sum(i * (i + 0.5) for i in range(1, 6))
    assert value(spark, T.fertilizer_cost(F.lit("$1 per 100 pounds"), five)) is None
    table = F.lit("\n".join(f"| Fertilizer {i} | x | {i} |" for i in range(1, 6)))
    assert value(spark, T.fertilizer_cost(table, five)) == 55.0
    none = F.lit(None).cast("string")
    assert value(spark, T.ground_truth(none, five, said))["source"] == "fertilizer_cost"


def test_questions_and_prompts(spark):
    none = F.lit(None).cast("string")
    chat = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in (("user", "first"), ("user", "asked"), ("user", ""))])
    assert value(spark, T.question_text(none, F.lit("en"), F.lit("p"))) == "en"
    assert value(spark, T.question_text(none, none, none, chat)) == "asked"
    got = value(spark, T.chat_prompt("x SYSTEM: use {{V}} \nUSER:\n {{Q}} ", {"V": F.lit("12"), "Q": F.lit("how many?")}))
    assert [tuple(m) for m in got] == [("system", "use 12"), ("user", "how many?")]
    with pytest.raises(ValueError):
        T.chat_prompt("no sections", {})
    got = value(spark, T.payload_messages("Do this.", F.struct(F.lit("ü").alias("a"))))
    assert got[1]["content"].startswith('Do this.\n\nINPUT JSON:\n{') and '"a" : "ü"' in got[1]["content"]
    assert value(spark, T.stated_optimum(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit("1,5"), F.lit("3"))) == 15.0
    assert value(spark, T.sample_data(F.lit('{"n": 3}'), none, none).cast("string")) == '{"n":3}'
    assert value(spark, T.sample_data(none, F.lit("q?"), none).cast("string")) == '{"question":"q?"}'
    assert value(spark, T.nested(F.parse_json(F.lit('{"a": {"b": "c"}}')), "a.b", F.lit("d"))) == "c"
    assert value(spark, T.nested(F.parse_json(F.lit("{}")), "a.b", F.lit("d"))) == "d"
    assert value(spark, T.target_id(F.lit("[Target ID] nl4opt_solver"), none)) == "nl4opt_solver"
    assert value(spark, T.target_id(F.lit("?"), F.lit("x_optibench_solver_1"))) == "optibench_solver"
    md = value(spark, T.retrieval_metadata(F.lit("p"), F.lit(""), none, none, F.lit("w"), F.lit("# Domain: energy \n# Problem Type: blending")))
    assert tuple(md) == ("energy", "blending", "", "w", "p\nenergy\nblending\nw")
    ids = spark.createDataFrame([("a_10",), ("a_9",), ("b",), ("a_x",)], "i string")
    assert [r.i for r in ids.orderBy(*T.numeric_id_order(F.col("i"))).collect()] == ["a_9", "a_10", "a_x", "b"]
    assert value(spark, T.row_id(F.lit(""), F.lit("ir_1"), F.lit("t"))) == "ir_1"
    assert value(spark, T.result_name(F.lit("t"), F.lit("a/b c"), F.lit(0), F.lit(5))) == "t_a-b-c_0_5.json"


def test_nulls_match_no_parent(spark):
    jobs = spark.createDataFrame([(1, None, "x"), (2, "a", "")], "job int, d string, e string")
    pool = spark.createDataFrame([(1, None, "x"), (2, "a", ""), (3, "b", "y")], "parent int, d string, e string")
    got = {(g.job, g.parent): g.score for g in similarity.top_parents(jobs, pool, ["d", "e"], 3, F.sha2(F.col("parent").cast("string"), 256)).collect()}
    assert got == {(1, 1): 1, (1, 2): 0, (1, 3): 0, (2, 1): 0, (2, 2): 1, (2, 3): 0}


def plain_bm25(query, pool, k, tie):
    """One query at a time over every candidate."""
    text = str(query["query"])
    cands = [x for x in pool if str(x["item"]) != text and x["source_key"] != text and text not in [p for p in x["source_key"].split("|") if p]]
    avg = max(sum(len(x["tokens"]) for x in cands) / len(cands), 1.0)
    df = Counter(t for x in cands for t in set(x["tokens"]))
    scored = []
    for x in cands:
        tf, s = Counter(x["tokens"]), 0.0
        for t, n in Counter(query["tokens"]).items():
            if tf[t]:
                s += n * math.log(1 + (len(cands) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(x["tokens"]) / avg))
        s += sum(w for d, w in retrieval.BONUS.items() if query[d] and query[d] == x[d])
        scored.append((-round(s, 6), tie(query["query"], x["item"]), x))
    out, seen = [], set()
    for _, _, x in sorted(scored, key=lambda s: s[:2]):
        if x["source_key"] not in seen:
            seen.add(x["source_key"])
            out.append(x["item"])
    return out[:k]


def test_bm25_against_a_loop(spark):
    import hashlib

    r = random.Random(3)
    pool = [{"item": i, "tokens": [r.choice("abcdefgh") for _ in range(r.randint(0, 9))], "source_key": f"{i // 2}|z{i % 5}" if i % 4 else str(100 + i), "domain": r.choice(["x", "y", "", None]), "problem_type": r.choice(["p", "q"]), "wp_type": r.choice(["m", None])} for i in range(60)]
    queries = [{"query": i, "tokens": [r.choice("abcdefghij") for _ in range(r.randint(0, 4))], "domain": r.choice(["x", "", None]), "problem_type": r.choice(["p", None]), "wp_type": "m"} for i in [*range(20), 104]]
    dims = "domain string, problem_type string, wp_type string"
    p = spark.createDataFrame([tuple(x.values()) for x in pool], f"item long, tokens array<string>, source_key string, {dims}")
    q = spark.createDataFrame([tuple(x.values()) for x in queries], f"query long, tokens array<string>, {dims}")
    tie = lambda a, b: F.sha2(F.concat_ws(":", a.cast("string"), b.cast("string")), 256)
    got = {}
    for g in retrieval.bm25(q, p, 6, tie, retrieval.BONUS).orderBy("query", "rank").collect():
        got.setdefault(g.query, []).append(g["item"])
    for x in queries:
        assert got[x["query"]] == plain_bm25(x, pool, 6, lambda a, b: hashlib.sha256(f"{a}:{b}".encode()).hexdigest()), x


def test_random_examples_reach_the_whole_pool(spark):
    pool = spark.createDataFrame([(i, f"k{i // 2}") for i in range(300)], "item long, source_key string")
    q = spark.range(400).select(F.col("id").alias("query"))
    got = retrieval.random_examples(q, pool, 4, "7").collect()
    per = {}
    for g in got:
        per.setdefault(g.query, []).append(g["item"])
    assert len(per) == 400 and all(len({i // 2 for i in v}) == 4 and k not in v for k, v in per.items())
    assert len({g["item"] for g in got}) > 290
    # neighbours in the pool are drawn together by some and not by others
    assert len({frozenset(v) for v in per.values()}) > 380
    with pytest.raises(ValueError):
        retrieval.random_examples(q.limit(1), pool.limit(2), 4, "7").count()


def test_pools(spark):
    chat = "id string, messages array<struct<role:string,content:string>>, answer_id string"
    rec = spark.createDataFrame([("1", [("user", "[Target ID] nl4opt_solver\nq"), ("assistant", "a")], None), ("2", [("user", "q2"), ("assistant", "a2")], "nl4opt_solver_7"), ("3", [("user", "q3")], "nl4opt_solver"), ("4", [("user", "q4"), ("assistant", "a4")], "other")], chat)
    assert sorted(g.source_key for g in retrieval.sft_pool(rec, "nl4opt_solver", "s").collect()) == ["1", "2"]
    assert retrieval.sft_pool(rec, "nl4opt_solver", "s", most=1).count() == 1
    res = spark.createDataFrame([(1, True, " done ", (0.0, 0.0)), (2, False, "x", (1.0, 1.0)), (3, False, "x", (1.0, 0.0)), (4, True, " \n", (1.0, 1.0)), (None, True, "x", None), (9, True, "x", None)], "sample_id long, success boolean, completion string, reward struct<code_reward:double,wl_reward:double>")
    samples = spark.createDataFrame([("1", "u1"), ("2", "u2"), ("3", "u3")], "sample_id string, user string")
    got = sorted((g["item"], g.user, g.assistant) for g in retrieval.result_pool(res, samples, "r").collect())
    assert got == [("r:1", "u1", "done"), ("r:2", "u2", "x")]
    shots = F.array(F.struct(F.lit("u").alias("user"), F.lit("a").alias("assistant")))
    assert value(spark, retrieval.prompt_with_examples(F.lit("now"), shots)) == vocab.EXAMPLES_PROMPT + "\n\n### Few-shot example 1 (not current problem)\n[Example prompt]\nu\n[Example answer]\na\n### End few-shot example 1\n\n### Current problem\n\nnow"
    assert value(spark, retrieval.prompt_with_examples(F.lit("now"), F.slice(shots, 1, 0))) == "now"


def test_candidates(spark):
    pool = spark.createDataFrame([("a", "DT", "finance_marketing", "x", "small", None, 1), ("a", "DP", "energy_utilities", "blending_mixing", "odd", None, 2), ("", "DP", "healthcare", "", "", None, 3)], "ir_id string, mode string, domain string, structure string, difficulty string, data_interface string, at int")
    long_p, long_a = "Minimise the cost of a plan that feeds all the cities.", "import gurobipy " + "x = 1; " * 20
    rows = spark.createDataFrame([(long_p, long_a, "a", None, None, 1), (long_p, "short", "a", None, None, 2), (f"\n{long_p}\n", long_a, "", "DPS", [("d.csv", "csv", "1,2")], 3)], "problem string, answer string, source_ir_id string, problem_mode string, data_files array<struct<path:string,kind:string,content:string>>, at int")
    good, bad = records.candidates(rows, pool, "at")
    got = sorted((tuple(g.metadata), g.problem) for g in good.collect())
    assert got[0][0] == ("DP", "energy", "blending", "medium", "inline_text", "code_only")
    assert got[1][0] == ("DPS", "generic", "generic_lp_mip", "medium", "attached_files", "code_only") and got[1][1].startswith(long_p + "\n\nThe following")
    assert [b.issues for b in bad.collect()] == [["answer_too_short"]]


def test_generated_records(spark):
    rows = spark.createDataFrame([(" dt ", "a | b", "inline_text", None, "")], "mode string, synthetic_problem_brief string, data_interface string, domain string, structure string")
    got = records.normalize_ir(rows).first()
    assert (got["mode"], got.data_interface, got.domain, got.structure, got.difficulty, got.answer_style) == ("DT", "markdown_table", "generic", "generic_lp_mip", "medium", "math_model")
    both = spark.createDataFrame([("", ("energy", "small"))], "domain string, metadata struct<domain:string,difficulty:string>")
    md = both.select(records.row_metadata(both).alias("m")).first()["m"]
    assert (md["domain"], md["difficulty"], md["mode"]) == ("energy", "small", None)
    assert rows.select(records.first_problem(rows).alias("x")).first()["x"] == "a | b"


def plain_selection(items, total, most):
    """The loop: modes in order, round-robin over buckets until a round adds nothing, then the rest with and without the test."""
    quota, chosen, visits = records.mode_targets(Counter(x["mode"] for x in items), total), [], []
    jac = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    fits = lambda x: all(jac(x["t"], y["t"]) <= most for y in chosen)
    for mode in vocab.PROBLEM_MODES:
        buckets = {}
        for x in sorted((x for x in items if x["mode"] == mode), key=lambda x: x["id"]):
            buckets.setdefault(x["b"], []).append(x)
        n, turn, going = 0, 0, True
        visits += [xs[t] for t in range(len(items)) for _, xs in sorted(buckets.items()) if t < len(xs)]
        while going and n < quota.get(mode, 0):
            going = False
            for _, xs in sorted(buckets.items()):
                if turn < len(xs) and n < quota[mode] and fits(xs[turn]):
                    chosen.append(xs[turn])
                    n, going = n + 1, True
            turn += 1
    for test in (fits, lambda x: True):
        for x in visits:
            if len(chosen) < total and x not in chosen and test(x):
                chosen.append(x)
    return {x["id"] for x in chosen}


@pytest.mark.parametrize("total", [12, 30, 50])
def test_diverse_selection_is_the_loop(spark, total):
    r = random.Random(total)
    items = [{"id": i, "t": {r.choice("abcdefghij") for _ in range(r.randint(1, 5))}, "mode": r.choice(["DP", "DT", "DPS"]), "b": r.choice("xyz")} for i in range(60)]
    df = spark.createDataFrame([(x["id"], sorted(x["t"]), x["mode"], x["b"]) for x in items], "id long, tokens array<string>, mode string, b string")
    got = {g.id for g in records.select_diverse(df, "mode", ["b"], ["id"], total, 0.6).collect()}
    assert got == plain_selection(items, total, 0.6)


def test_table_equivalence_is_the_pairs(spark):
    """Colours, their comparison and the ambiguous parts as tables, against the function on one pair."""
    from millrace.operators import lp

    a = "Minimize\n obj: x + 2 y + z\nSubject To\n c1: x + y >= 2\n c2: y + z >= 3\n c3: x + z <= 9\nEnd\n"
    b = "Minimize\n obj: q + 2 r + p\nSubject To\n d1: r + p >= 3\n d2: q + r >= 2\n d3: q + p <= 9\nEnd\n"
    c = "Minimize\n obj: x + 2 y + z\nSubject To\n c1: x + y >= 2\n c2: y + z >= 3\n c3: x + y <= 9\nEnd\n"
    d = "Minimize\n obj: x + y + z + w\nSubject To\n c1: x + y >= 2\n c2: z + w >= 2\nEnd\n"
    e = "Minimize\n obj: x + y + z + w\nSubject To\n c1: x + y >= 2\n c2: y + z >= 2\n c3: z + w >= 2\n c4: w + x >= 2\nEnd\n"
    texts = {"a": a, "b": b, "c": c, "d": d, "e": e}
    nodes, edges = [], []
    for m, t in texts.items():
        color, near = lp.initial(lp.parse_lp(t))
        nodes += [(f"{m}{i}", m, x) for i, x in enumerate(color)]
        edges += [(f"{m}{i}", f"{m}{j}", w) for i, ns in enumerate(near) for j, w in ns]
    n, g = spark.createDataFrame(nodes, "node string, model string, color string"), spark.createDataFrame(edges, "a string, b string, w string")
    colors = n.select("node", "model").join(lp.stable_colors(n.select("node", "color"), g), "node")
    same = {(r.a, r.b): r.wl_check for r in lp.compare_colors(colors).collect()}
    sure = {r.model: r.determinable for r in lp.determinable(colors, g).collect()}
    for x in texts:
        assert sure[x] == lp.equivalent(texts[x], texts[x])["equal"], x
        for y in texts:
            if x < y:
                want = lp.equivalent(texts[x], texts[y])
                if want["cons_num_check"]:
                    assert same[x, y] == want["wl_check"], (x, y)
    assert same["a", "b"] and not same["a", "c"] and not sure["d"] and not sure["e"]
