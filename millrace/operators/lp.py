"""Linear and mixed-integer programs: parsing, normal forms, colour refinement and structural equivalence.

Models are rows of three tables keyed by ``model``: variables (name, obj, vtype, lb, ub), constraints (name, sense,
rhs) and coefficients (con, var, coef). ``compat`` keeps three quirks that known results depend on: a one-variable row
replaces declared bounds, a negative coefficient in it doesn't turn its sense, and colours are compared as sets.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INF = float("inf")
_NUMBER = r"[+-]?\s*(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|inf(?:inity)?)"
_TERM = re.compile(r"([+-])?\s*(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)?\s*\*?\s*([A-Za-z_!\"#$%&()/,;?@'`{}|~][^\s<>=+*^:]*(?:\[[^\]]*\])?)?")
_SECTIONS = {"minimize": "min", "minimise": "min", "min": "min", "maximize": "max", "maximise": "max", "max": "max", "subject to": "st", "such that": "st", "st": "st", "s.t.": "st", "bounds": "bounds", "bound": "bounds", "binaries": "bin", "binary": "bin", "bin": "bin", "generals": "int", "general": "int", "gen": "int", "integers": "int", "end": "end"}


def _value(s: str) -> float:
    s = s.replace(" ", "").lower()
    return -INF if s.startswith("-inf") else INF if "inf" in s else float(s)


def _linear(s: str) -> tuple[dict[str, float], float]:
    """Coefficients and constant of a linear expression."""
    out, const = {}, 0.0
    for sign, num, name in _TERM.findall(s):
        if not (num or name):
            continue
        c = (float(num) if num else 1.0) * (-1 if sign == "-" else 1)
        if name:
            out[name] = out.get(name, 0.0) + c
        else:
            const += c
    return out, const


def parse_lp(text: str) -> dict:
    """``sense, quadratic, vars {name: [obj, vtype, lb, ub]}, cons [(name, sense, rhs, {var: coef})]`` of an LP file.

    Default bounds are 0 and infinity, binaries 0 and 1; a quadratic objective part is noted and left out; numbers of
    a constraint's left side move to its right side. An unreadable line raises ValueError."""
    section, statements, buffer = "", [], ""
    for line in text.splitlines():
        line = line.split("\\", 1)[0].strip()
        if not line:
            continue
        key = _SECTIONS.get(line.lower())
        if key:
            if buffer:
                statements.append((section, buffer))
            section, buffer = key, ""
            continue
        if section == "st":
            if re.match(r"[^\s:<>=]+\s*:", line) and buffer:
                statements.append((section, buffer))
                buffer = ""
            buffer = f"{buffer} {line}".strip()
            if re.search(rf"[<>=]\s*{_NUMBER}\s*$", buffer):
                statements.append((section, buffer))
                buffer = ""
        elif section in ("bounds", "bin", "int"):
            statements.append((section, line))
        else:
            buffer = f"{buffer} {line}".strip()
    if buffer:
        statements.append((section, buffer))
    sense, quadratic, variables, cons = "min", False, {}, []
    var = lambda v: variables.setdefault(v, [0.0, "C", 0.0, INF])
    for section, s in statements:
        if section in ("min", "max"):
            sense = section
            s = re.sub(r"^[^\s:]+\s*:", "", s)
            # a quadratic part stands in brackets of its own, "[ ... ] / 2"; brackets of names have no space before them
            linear = re.sub(r"[+-]?\s*(?<!\S)\[\s.*?\s\](\s*/\s*2)?", " ", s)
            quadratic, s = quadratic or linear != s, linear
            for v, c in _linear(s)[0].items():
                var(v)[0] += c
        elif section == "st":
            m = re.match(r"^([^\s:<>=]+)\s*:\s*(.*)$", s)
            name, body = (m[1], m[2]) if m else (f"R{len(cons)}", s)
            m = re.match(rf"^(.*?)(<=|>=|=<|=>|<|>|=)\s*({_NUMBER})\s*$", body)
            if not m:
                raise ValueError(f"not a constraint: {s[:80]}")
            row, const = _linear(m[1])
            for v in row:
                var(v)
            cons.append((name, "<" if "<" in m[2] else ">" if ">" in m[2] else "=", _value(m[3]) - const, row))
        elif section == "bounds":
            if m := re.match(r"^(\S+)\s+free$", s, re.I):
                var(m[1])[2:] = [-INF, INF]
            elif m := re.match(rf"^({_NUMBER})\s*<=?\s*(\S+)\s*<=?\s*({_NUMBER})$", s, re.I):
                var(m[2])[2:] = [_value(m[1]), _value(m[3])]
            elif m := re.match(rf"^(\S+)\s*(<=?|>=?|=)\s*({_NUMBER})$", s, re.I):
                x = _value(m[3])
                if "<" in m[2] or m[2] == "=":
                    var(m[1])[3] = x
                if ">" in m[2] or m[2] == "=":
                    var(m[1])[2] = x
            elif m := re.match(rf"^({_NUMBER})\s*(<=?|>=?)\s*(\S+)$", s, re.I):
                var(m[3])[2 if "<" in m[2] else 3] = _value(m[1])
            else:
                raise ValueError(f"not a bound: {s[:80]}")
        elif section in ("bin", "int"):
            for v in s.split():
                x = var(v)
                x[1] = "B" if section == "bin" else "I"
                if section == "bin":
                    x[2], x[3] = max(x[2], 0.0), min(x[3], 1.0)
    return {"sense": sense, "quadratic": quadratic, "vars": variables, "cons": cons}


def read_lp(files: DataFrame) -> DataFrame:
    """One row per part of each ``files(model, text)``: ``kind`` is model, var, con, coef or error."""
    schema = "model string, kind string, con string, var string, sense string, vtype string, value double, lb double, ub double, quadratic boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split()[0] for c in schema.split(", ")]
        for b in batches:
            out = []
            for model, text in zip(b["model"], b["text"]):
                try:
                    m = parse_lp(text or "")
                except ValueError as e:
                    out.append((model, "error", str(e), *[None] * 7))
                    continue
                out.append((model, "model", None, None, m["sense"], None, None, None, None, m["quadratic"]))
                out += [(model, "var", None, v, None, t, o, lo, hi, None) for v, (o, t, lo, hi) in m["vars"].items()]
                for c, s, rhs, row in m["cons"]:
                    out.append((model, "con", c, None, s, None, rhs, None, None, None))
                    out += [(model, "coef", c, v, None, None, a, None, None, None) for v, a in row.items()]
            yield pd.DataFrame(out, columns=cols)

    return files.select("model", "text").mapInPandas(run, schema)


def singleton_bounds(cons: DataFrame, coefs: DataFrame, compat: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows of one variable as bounds ``model, var, lb, ub`` (the tightest), and the other rows' keys ``model, con``."""
    rows = coefs.where("abs(coef) >= 1e-12").groupBy("model", "con").agg(F.count("*").alias("k"), F.min(F.struct("var", "coef")).alias("x"))
    one = cons.join(rows.where("k = 1"), ["model", "con"]).withColumn("b", F.col("rhs") / F.col("x.coef"))
    sense = F.col("sense") if compat else F.when(F.col("x.coef") < 0, F.translate("sense", "<>", "><")).otherwise(F.col("sense"))
    low, high = sense.isin(">", "="), sense.isin("<", "=")
    bounds = one.groupBy("model", F.col("x.var").alias("var")).agg(F.max(F.when(low, F.col("b"))).alias("lb"), F.min(F.when(high, F.col("b"))).alias("ub"))
    return bounds, cons.select("model", "con").join(one.select("model", "con"), ["model", "con"], "left_anti")


def zero_rhs_sign(cons: DataFrame, coefs: DataFrame) -> DataFrame:
    """``model, con, sense, sign``: rows with a right side of zero have one direction: ``<=`` is negated to ``>=``, and
    an equation whose coefficients sum below zero is negated; sign multiplies the coefficients."""
    total = coefs.groupBy("model", "con").agg(F.sum("coef").alias("s"))
    c = cons.join(total, ["model", "con"], "left")
    zero = F.abs("rhs") < 1e-9
    less, neg = zero & (F.col("sense") == "<"), zero & (F.col("sense") == "=") & (F.col("s") < 0)
    return c.select("model", "con", F.when(less, ">").otherwise(F.col("sense")).alias("sense"), F.when(less | neg, -1.0).otherwise(1.0).alias("sign"))


def refine(nodes: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """``node, color`` after rounds of colour refinement over ``nodes(node, color)`` and ``edges(a, b, w)`` (both
    directions, w a string): a colour becomes the MD5 of itself and the sorted colours and weights around it."""
    from millrace.functions.lineage import cut

    for k in range(rounds):
        near = edges.join(nodes.select(F.col("node").alias("b"), F.col("color").alias("bc")), "b").groupBy("a").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("|", "bc", "w"))), "|").alias("around"))
        nodes = nodes.join(near, nodes["node"] == near["a"], "left").select("node", F.md5(F.concat_ws("|", "color", F.coalesce("around", F.lit("")))).alias("color"))
        if k % 3 == 2:
            nodes = cut(nodes)
    return nodes


def stable_colors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, color`` refined (see refine) until a round splits no class any more, over all models at once; the driver
    sees one count a round, and every round splits a class, so they end."""
    from millrace.functions.lineage import cut

    nodes = cut(nodes.select("node", "color"))
    classes = nodes.agg(F.count_distinct("color")).first()[0]
    while True:
        nodes = cut(refine(nodes, edges, 1))
        now = nodes.agg(F.count_distinct("color")).first()[0]
        if now <= classes:
            return nodes
        classes = now


def compare_colors(colors: DataFrame) -> DataFrame:
    """``a, b, wl_check`` for every two models of ``colors(model, node, color)``: whether their sets of colours are equal.
    Models are compared by one digest of their sets."""
    sets = colors.groupBy("model", "color").agg(F.lit(1)).groupBy("model").agg(F.sum(F.xxhash64("color").cast("decimal(38,0)")).alias("h"), F.sum(F.xxhash64(F.lit(1), "color").cast("decimal(38,0)")).alias("g"), F.count("*").alias("n"))
    other = sets.select(F.col("model").alias("b"), *[F.col(c).alias(f"{c}2") for c in "hgn"])
    return sets.join(other, F.col("model") < F.col("b")).select(F.col("model").alias("a"), "b", ((F.col("h") == F.col("h2")) & (F.col("g") == F.col("g2")) & (F.col("n") == F.col("n2"))).alias("wl_check"))


def ambiguous_components(colors: DataFrame, edges: DataFrame) -> DataFrame:
    """``model, node, color, component`` of the nodes of ``colors(model, node, color)`` that share their colour with another of
    their model; component is the least node that edges between such nodes lead to."""
    from millrace.functions.lineage import cut

    many = colors.groupBy("model", "color").agg(F.count("*").alias("k")).where("k > 1").select("model", "color")
    nodes = cut(colors.join(many, ["model", "color"]))
    near = cut(edges.join(nodes.select(F.col("node").alias("a")), "a", "left_semi").join(nodes.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b").distinct())
    label = cut(nodes.select("node", F.col("node").alias("component")))
    while True:
        around = near.join(label.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        # to the least around, and then to where that one points
        step = label.join(around, "node", "left").select("node", F.least("component", F.coalesce("c", "component")).alias("component"))
        ahead = step.select(F.col("node").alias("component"), F.col("component").alias("next"))
        new = cut(step.join(ahead, "component").select("node", F.least("component", "next").alias("component")))
        if new.exceptAll(label).isEmpty():
            return nodes.join(new, "node").select("model", "node", "color", "component")
        label = new


def determinable(colors: DataFrame, edges: DataFrame) -> DataFrame:
    """``model, determinable``: whether all colours of a model are single, or every ambiguous component holds each once."""
    twice = ambiguous_components(colors, edges).groupBy("model", "component", "color").agg(F.count("*").alias("k")).where("k > 1").select("model").distinct()
    return colors.select("model").distinct().join(twice.withColumn("bad", F.lit(True)), "model", "left").select("model", F.col("bad").isNull().alias("determinable"))


def _text(*xs: float) -> str:
    return ",".join(f"{np.float32(x):.6f}" for x in xs)


def _normal(m: dict, compat: bool, zero_rows: bool) -> dict:
    bounds, cons = defaultdict(lambda: [None, None]), []
    for name, sense, rhs, row in m["cons"]:
        row = {v: c for v, c in row.items() if abs(c) >= 1e-12}
        if len(row) == 1:
            (v, c), b = next(iter(row.items())), rhs / next(iter(row.values()))
            s = sense if compat or c > 0 else {"<": ">", ">": "<", "=": "="}[sense]
            if s != "<":
                bounds[v][0] = b if bounds[v][0] is None else max(bounds[v][0], b)
            if s != ">":
                bounds[v][1] = b if bounds[v][1] is None else min(bounds[v][1], b)
            continue
        if zero_rows and abs(rhs) < 1e-9:
            if sense == "<" or (sense == "=" and sum(row.values()) < 0):
                sense, row = (">" if sense == "<" else "="), {v: -c for v, c in row.items()}
        cons.append((sense, rhs, row))
    variables = {v: list(x) for v, x in m["vars"].items()}
    for v, (lo, hi) in bounds.items():
        x = variables[v]
        x[2] = (lo if compat else max(lo, x[2])) if lo is not None else x[2]
        x[3] = (hi if compat else min(hi, x[3])) if hi is not None else x[3]
    return {"vars": variables, "cons": cons}


def initial(m: dict, compat: bool = True, zero_rows: bool = True) -> tuple[list[str], list[list[tuple[int, str]]]]:
    """First colours of variable then constraint nodes of a parsed program, normalised, and neighbours with weights: the
    rows of the tables that ``stable_colors`` takes."""
    return _start(_normal(m, compat, zero_rows))


def _start(m: dict) -> tuple[list[str], list[list[tuple[int, str]]]]:
    names = {v: i for i, v in enumerate(m["vars"])}
    kind, sense = {"C": 0, "B": 1, "I": 2}, {"=": 0, "<": -1, ">": 1}
    color = [_text(o, kind[t], lo, hi) for o, t, lo, hi in m["vars"].values()]
    near = [[] for _ in range(len(names) + len(m["cons"]))]
    for k, (s, rhs, row) in enumerate(m["cons"]):
        color.append(_text(rhs, sense[s]))
        for v, c in row.items():
            near[names[v]].append((len(names) + k, _text(c)))
            near[len(names) + k].append((names[v], _text(c)))
    return color, near


def _colors(m: dict) -> tuple[list[str], list[list[int]]]:
    """Stable colours of variable then constraint nodes, and adjacency."""
    color, near = _start(m)
    n = len(set(color))
    for _ in range(len(color)):
        color = [md5("|".join([c, *sorted(f"{color[j]}|{w}" for j, w in near[i])]).encode()).hexdigest() for i, c in enumerate(color)]
        if len(set(color)) <= n:
            break
        n = len(set(color))
    return color, [[j for j, _ in x] for x in near]


def _determinable(color: list[str], near: list[list[int]]) -> tuple[bool, str]:
    """All colours single, or every connected part of the others holds each colour once."""
    count = Counter(color)
    many = {i for i, c in enumerate(color) if count[c] > 1}
    if not many:
        return True, "all classes are single"
    seen = set()
    for i in many:
        if i in seen:
            continue
        part, todo = [], [i]
        seen.add(i)
        while todo:
            x = todo.pop()
            part.append(color[x])
            new = [j for j in near[x] if j in many and j not in seen]
            seen.update(new)
            todo += new
        if len(set(part)) < len(part):
            return False, "a part holds a class twice"
    return True, "decomposable"


def equivalent(a: str, b: str, compat: bool = True, zero_rows: bool = True, sufficiency: bool = True) -> dict:
    """Whether two LP files have the same structure, and the checks in order: counts, colours, determinability. Names,
    direction of optimisation and quadratic parts don't count."""
    x, y = (_normal(parse_lp(t), compat, zero_rows) for t in (a, b))
    out = {"var_num_check": len(x["vars"]) == len(y["vars"]), "cons_num_check": None, "wl_check": None, "info": ""}
    out["equal"] = False
    if not out["var_num_check"]:
        return out
    out["cons_num_check"] = len(x["cons"]) == len(y["cons"])
    if not out["cons_num_check"]:
        return out
    (ca, na), (cb, nb) = _colors(x), _colors(y)
    out["wl_check"] = set(ca) == set(cb) if compat else Counter(ca) == Counter(cb)
    if not out["wl_check"]:
        return out
    if sufficiency:
        (fine_a, info_a), (fine_b, info_b) = _determinable(ca, na), _determinable(cb, nb)
        out["equal"], out["info"] = fine_a and fine_b, f"{info_a}; {info_b}"
    else:
        out["equal"] = True
    return out


def compare(pairs: DataFrame, **kw) -> DataFrame:
    """``pair`` and the checks for ``pairs(pair, a, b)`` of LP texts; each pair is one model's size, so it is one
    task's work. Unreadable files give ``error``."""
    schema = "pair string, equal boolean, var_num_check boolean, cons_num_check boolean, wl_check boolean, info string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            out = []
            for pair, a, b in zip(t["pair"], t["a"], t["b"]):
                try:
                    got = equivalent(a or "", b or "", **kw)
                    out.append((pair, got["equal"], got["var_num_check"], got["cons_num_check"], got["wl_check"], got["info"], None))
                except ValueError as e:
                    out.append((pair, None, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return pairs.select("pair", "a", "b").mapInPandas(run, schema)
