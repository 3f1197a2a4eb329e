"""Rewriting generated model code so that running it writes an LP file. Text work per row, in Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_ASSIGN = re.compile(r"^\s*(\w+)\s*=\s*(?:gp\.|gurobipy\.)?Model\(", re.M)
_USED = re.compile(r"\b(\w+)\.(?:optimize|addConstrs?|addVars?|setObjective)\(")


def model_name(code: str) -> str:
    """The variable a model is assigned to, else the one most used like a model, else ``model``."""
    if m := _ASSIGN.search(code):
        return m[1]
    used = _USED.findall(code)
    return max(dict.fromkeys(used), key=used.count) if used else "model"


def free_lower_bounds(code: str) -> str:
    """Unstated lower bounds of ``model.addVars`` calls become minus infinity."""
    return re.sub(r"model\.addVars\(([^()]*)\)", lambda m: m[0] if "lb=" in m[1] else f"model.addVars({m[1]}, lb=-GRB.INFINITY)", code)


def with_imports(code: str) -> str:
    need = [x for x in ("import gurobipy as gp", "from gurobipy import GRB") if x not in code]
    return "\n".join([*need, code]) if need else code


def writes_lp(code: str, path: str, before_solving: bool = False, free_bounds: bool = False) -> str:
    """Code that writes its model to ``path``: existing writes go there, or one is added at the end; with
    ``before_solving``, all writes are replaced by one before the first ``optimize``, and what follows is dropped."""
    if not code.strip():
        raise ValueError("no code")
    name = model_name(code)
    write = f'{name}.write("{path}")'
    if before_solving:
        code = re.sub(r"^.*\.write\(.*\).*$\n?", "", code, flags=re.M)
        m = re.search(rf"^([ \t]*){re.escape(name)}\.optimize\(", code, re.M)
        if m:
            head, tail = code[: m.start()], code[m.start() :]
            main = re.search(r"^if __name__", tail, re.M)
            code = f"{head}{m[1]}{name}.update()\n{m[1]}{write}\n" + (tail[main.start() :] if main else "")
        else:
            code = f"{code.rstrip()}\n{write}\n"
    else:
        code, n = re.subn(rf"\b{re.escape(name)}\.write\([^)]*\)", write, code)
        if not n:
            code = f"{code.rstrip()}\n{write}\n"
    return with_imports(free_lower_bounds(code) if free_bounds else code)


@F.pandas_udf(StringType())
def lp_code(code: pd.Series, path: pd.Series) -> pd.Series:
    """``writes_lp`` as a column function; null for empty code."""
    return pd.Series([writes_lp(c, p) if isinstance(c, str) and c.strip() else None for c, p in zip(code, path)])
