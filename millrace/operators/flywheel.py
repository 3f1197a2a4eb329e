"""Quota-driven generation rounds with a reply cache, resumable logs and pluggable backends.

A round plans jobs, answers what the cache knows, sends the rest to a backend in Arrow batches (one client a task),
gates the rows and appends them. State lives in tables; a round that is repeated meets its own cache.
"""

from __future__ import annotations

import hashlib
import json
import math
import subprocess
import sys
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.lineage import cut


class ChatBackend(Protocol):
    def __call__(self, messages: str) -> str: ...


def echo(messages: str) -> str:
    """The stub: a reply that depends on the request alone."""
    return json.dumps({"reply": hashlib.sha256(messages.encode()).hexdigest()[:16]})


def with_retries(call: ChatBackend, tries: int = 3, wait: float = 2.0) -> ChatBackend:
    """Retry errors, waiting wait ** attempt seconds; the last error is raised."""

    def go(messages: str) -> str:
        for k in range(tries):
            try:
                return call(messages)
            except Exception:
                if k + 1 == tries:
                    raise
                time.sleep(wait**k)
        raise RuntimeError("no tries")

    return go


def canonical(payload) -> str:
    return json.dumps(payload, ensure_ascii=False, sort_keys=True, default=str, separators=(",", ":"))


def request_hash(model: Column, temperature: Column, top_p: Column, max_tokens: Column, messages: Column) -> Column:
    """Identity of a request; the endpoint isn't part of it."""
    return F.sha2(F.to_json(F.struct(max_tokens.alias("max_tokens"), messages.alias("messages"), model.alias("model"), temperature.alias("temperature"), top_p.alias("top_p")), {"ignoreNullFields": "false"}), 256)


def ask(requests: DataFrame, cache: DataFrame, backend: ChatBackend, endpoints: int = 1) -> tuple[DataFrame, DataFrame]:
    """Replies to ``requests(request_hash, messages, ...)`` and the new cache rows ``request_hash, content, error``.
    Equal requests are sent once; errors aren't cached."""
    misses = requests.select("request_hash", "messages").dropDuplicates(["request_hash"]).join(cache.select("request_hash"), "request_hash", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for h, m in zip(b["request_hash"], b["messages"]):
                try:
                    out.append((h, backend(m), None))
                except Exception as e:
                    out.append((h, None, f"api_error: {e}"))
            yield pd.DataFrame(out, columns=["request_hash", "content", "error"])

    new = cut(misses.repartition(max(1, endpoints), "request_hash").mapInPandas(run, "request_hash string, content string, error string"))
    known = cache.select("request_hash", "content", F.lit(None).cast("string").alias("error"), F.lit(True).alias("cached")).unionByName(new.withColumn("cached", F.lit(False)))
    return requests.join(known, "request_hash", "left"), new.where("error is null").select("request_hash", "content")


def planned(target: int, accepted: int, attempts: int, oversample: float, max_attempts: int) -> int:
    """Attempts of the next round; 0 when the target or the bound is reached."""
    left = target - accepted
    return max(0, min(max(1, math.ceil(left * oversample)), max_attempts - attempts)) if left > 0 else 0


def draw(key: Column, seed: str, dims: dict[str, list[str]]) -> list[Column]:
    """One value of each dimension per key, drawn by a hash, so the draw doesn't depend on partitions."""
    return [F.element_at(F.array(*[F.lit(v) for v in vs]), F.pmod(F.xxhash64(F.lit(seed), F.lit(d), key), F.lit(len(vs))).cast("int") + 1).alias(d) for d, vs in dims.items()]


def usage_weight(usage: Column, penalty: float) -> Column:
    return 1.0 / (1.0 + usage * penalty)


def rounds(plan: Callable[[int, int], DataFrame], gate: Callable[[DataFrame], DataFrame], backend: ChatBackend, cache: DataFrame, target: int, oversample: float = 1.5, max_attempts: int = 10_000, max_rounds: int = 10) -> tuple[DataFrame, DataFrame]:
    """Run rounds until ``target`` rows are accepted. ``plan(first, n)`` makes requests with ``idx, request_hash,
    messages``; ``gate`` adds a boolean ``ok``. Returns attempts with ``status`` and ``round``, and the cache."""
    from millrace.operators.records import accept

    log, done, attempts = None, 0, 0
    for r in range(max_rounds):
        n = planned(target, done, attempts, oversample, max_attempts)
        if not n:
            break
        replies, new = ask(plan(attempts, n), cache, backend)
        judged = cut(accept(gate(replies), F.col("ok"), "idx", target - done).withColumn("round", F.lit(r)))
        cache = cut(cache.select("request_hash", "content").unionByName(new))
        log = judged if log is None else log.unionByName(judged)
        done, attempts = done + judged.where("status = 'accepted'").count(), attempts + n
    return log, cache


class SubprocessSolver:
    """Runs code in a process of its own with a time limit; the last JSON line that it prints is the result. This
    limits accidents and isn't a sandbox."""

    def __init__(self, timeout: float = 360.0, memory_mb: int = 2048):
        self.timeout, self.memory_mb = timeout, memory_mb

    def __call__(self, code: str) -> dict:
        if "input(" in code or "os.system(" in code:
            return {"status": "refused"}
        limit = f"import resource; resource.setrlimit(resource.RLIMIT_AS, ({self.memory_mb << 20}, {self.memory_mb << 20}))\n"
        try:
            p = subprocess.run([sys.executable, "-I", "-c", limit + code], capture_output=True, text=True, timeout=self.timeout)
        except subprocess.TimeoutExpired:
            return {"status": "timeout"}
        for line in reversed(p.stdout.splitlines()):
            try:
                got = json.loads(line)
            except ValueError:
                continue
            if isinstance(got, dict):
                return {"status": "ok", **got}
        return {"status": "error", "message": p.stderr[-400:]}


def solve(samples: DataFrame, solver: Callable[[str], dict], id_col: str = "sample_id") -> DataFrame:
    """``id, status, value, message`` of ``samples(id, code)``."""
    kind = samples.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [solver(c or "") for c in b["code"]]
            yield pd.DataFrame({"id": b["id"], "status": [g.get("status") for g in got], "value": [g.get("value") for g in got], "message": [g.get("message") for g in got]})

    return samples.select(F.col(id_col).alias("id"), "code").mapInPandas(run, f"id {kind}, status string, value double, message string")


def _uniform(seed: str, what: str, key: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), key.cast("string")), F.lit(1 << 53)) / float(1 << 53)


def parent_candidates(jobs: DataFrame, seeds: DataFrame, synthetic: DataFrame, dims: list[str], seed: str, mode: str = "hybrid", share: float = 0.5, k: int = 8, exact_probability: float = 0.5) -> DataFrame:
    """``job, parent, score, rank`` of the parents that each of ``jobs(job, *dims)`` may take, best first, from the pools
    ``(parent, *dims)`` that the mode allows: seeds (seed_only, semantic_only, or no synthetic ones), synthetic ones
    (synthetic_only), both (snowball), or one of them drawn by ``share`` (hybrid). Where some of a job's candidates
    match in all dimensions and some don't, the former are dropped with a chance of 1 - ``exact_probability``."""
    from millrace.operators.similarity import top_parents

    tie = F.sha2(F.concat_ws(":", F.lit(seed), F.col("job").cast("string"), F.col("parent").cast("string")), 256)
    ranked = lambda j, pool: top_parents(j, pool, dims, k, tie)
    pool = lambda df: df.select("parent", *dims)
    if mode in ("seed_only", "semantic_only") or synthetic.isEmpty():
        got = ranked(jobs, pool(seeds))
    elif mode == "synthetic_only" or (mode == "hybrid" and seeds.isEmpty()):
        got = ranked(jobs, pool(synthetic))
    elif mode == "snowball":
        got = ranked(jobs, pool(seeds).unionByName(pool(synthetic)))
    else:
        drawn = _uniform(seed, "pool", F.col("job")) < share
        got = ranked(jobs.where(drawn), pool(synthetic)).unionByName(ranked(jobs.where(~drawn), pool(seeds)))
    exact = F.col("score") >= len(dims)
    per = got.groupBy("job").agg(F.count_if(exact).alias("e"), F.count("*").alias("c"))
    drop = (F.col("e") > 0) & (F.col("c") > F.col("e")) & (_uniform(seed, "exact", F.col("job")) > exact_probability)
    return got.join(per, "job").where(~(drop & exact)).select("job", "parent", "score", "rank")


def choose_parents(candidates: DataFrame, usage: dict, seed: str, penalty: float = 0.25) -> tuple[list[tuple], dict]:
    """``(job, parent)`` for each job of a round, and the usage after it. A parent's weight falls with its uses so far, the
    jobs of this round included in their order, so the choice is a fold; it streams the round's jobs (a round plans
    at most its attempts, and a job has at most k candidates) and holds one job at a time."""
    usage, out = dict(usage), []
    rows = candidates.select("job", "parent", "rank", _uniform(seed, "choice", F.col("job")).alias("u")).groupBy("job", "u").agg(F.sort_array(F.collect_list(F.struct("rank", "parent"))).alias("c")).orderBy("job")
    for r in rows.toLocalIterator():
        weights = [1.0 / (1.0 + usage.get(c["parent"], 0) * penalty) for c in r["c"]]
        pick, running, chosen = r["u"] * sum(weights), 0.0, r["c"][-1]["parent"]
        for c, w in zip(r["c"], weights):
            running += w
            if running >= pick:
                chosen = c["parent"]
                break
        usage[chosen] = usage.get(chosen, 0) + 1
        out.append((r["job"], chosen))
    return out, usage
