"""Queries of the core operators, by name, with the DuckDB SQL of the same result. Every query reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace import vocab
from millrace.functions import text as T
from millrace.functions.lineage import numbered
from millrace.operators import corpus, evaluation, flywheel, graphs, lp, records, retrieval, similarity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(*tables: str, sql: str | None = None):
    """Register a query; it gets the named tables as DataFrames."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


TOKENS = "list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda w: length(w) >= 3))"
STOP = ", ".join(f"'{w}'" for w in vocab.STOPWORDS)
RETRIEVAL = f"list_filter(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_]*|[0-9]+(?:\\.[0-9]+)?'), lambda w: lower(w)), lambda w: length(w) > 1 AND w NOT IN ({STOP}))"
#: Patterns that occur in the documents.
FLAGS = (("email", r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[a-z]+"), ("dotted_ip", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), ("license", r"licen[sc]e"), ("pipe", r"\|"), ("key", r"sk-[A-Za-z0-9]"), ("path", r"/home/|/root/|/mnt/|/tmp/"))
_FLAG_SQL = "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN '{n}' END" for n, p in FLAGS) + ")"


# ---- records and text

@query("conversations", sql="SELECT conv_id, coalesce(trim(arg_max(text, turn) FILTER (WHERE role = 'user'), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), '') AS problem, coalesce(trim(arg_max(text, turn) FILTER (WHERE role = 'assistant'), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), '') AS answer FROM (SELECT conv_id, turn, role, max(text) AS text FROM conversations GROUP BY ALL) GROUP BY conv_id")
def last_turn_pair(c):
    t = c.groupBy("conv_id", "turn", "role").agg(F.max("text").alias("text"))
    last = lambda r: F.coalesce(T.bare_ends(F.max_by("text", F.when(F.col("role") == r, F.col("turn")))), F.lit(""))
    return t.groupBy("conv_id").agg(last("user").alias("problem"), last("assistant").alias("answer"))


@query("conversations", sql="SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS text FROM (SELECT conv_id, turn, role, max(text) AS text FROM conversations GROUP BY ALL) GROUP BY conv_id")
def first_user_message(c):
    t = c.groupBy("conv_id", "turn", "role").agg(F.max("text").alias("text"))
    return t.groupBy("conv_id").agg(F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("text"))


@query("conversations", sql="SELECT conv_id, count(*) AS n_turns, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn, role, text) AS said FROM conversations GROUP BY conv_id")
def messages_text(c):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    said = F.array_join(F.transform(turns, lambda m: F.concat(m["role"], F.lit(": "), F.coalesce(m["text"], F.lit("")))), "\n")
    return c.groupBy("conv_id").agg(F.count("*").alias("n_turns"), said.alias("said"))


_STRIP = "text"
for _m in vocab.QUESTION_MARKERS:
    _STRIP = f"list_last(string_split({_STRIP}, '{_m}'))"


@query("documents", sql=f"SELECT doc_id, regexp_replace({_STRIP}, '\\n{{3,}}', chr(10) || chr(10), 'g') AS text FROM documents")
def strip_prompt_newlines(d):
    return d.select("doc_id", T.fold_newlines(T.after_markers("text")).alias("text"))


@query("documents", sql=f"SELECT doc_id, len({TOKENS}) AS n_tokens FROM documents")
def token_counts(d):
    return d.select("doc_id", F.size(T.token_set("text")).cast("long").alias("n_tokens"))


@query("documents", sql="SELECT doc_id, 'seed_' || substr(sha256(text), 1, 16) AS id, md5(text) AS digest FROM documents")
def content_ids(d):
    return d.select("doc_id", F.concat(F.lit("seed_"), F.substring(F.sha2("text", 256), 1, 16)).alias("id"), F.md5("text").alias("digest"))


@query("documents", sql="SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def exact_dedup(d):
    return records.first_of_each(d.select("doc_id", "lang", "source", F.sha2("text", 256).alias("sha")), ["sha"], ["doc_id"]).drop("sha")


@query("documents", sql=f"SELECT doc_id, {_FLAG_SQL} AS issues FROM documents")
def text_issue_flags(d):
    return d.select("doc_id", F.array_join(T.flags("text", FLAGS), ",").alias("issues"))


@query("documents", sql=f"SELECT issue, count(*) AS n FROM (SELECT unnest(string_split({_FLAG_SQL}, ',')) AS issue FROM documents) WHERE issue <> '' GROUP BY issue")
def issue_counts(d):
    return records.issue_counts(d.select(T.flags("text", FLAGS).alias("issues")))


@query("conversations", sql="""
WITH c AS (SELECT conv_id, count(*) AS n, bool_or(role = 'system') AS sys, arg_min(role, (turn, role)) AS first FROM conversations GROUP BY conv_id),
g AS (SELECT CASE WHEN n <> 2 THEN 'messages_must_be_user_assistant_pair' WHEN first <> 'user' OR sys THEN 'invalid_roles' ELSE 'ok' END AS issue FROM c)
SELECT issue, count(*) AS conversations FROM g GROUP BY issue""")
def gate_summary(c):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    got = c.groupBy("conv_id").agg(F.count("*").alias("n"), F.bool_or(F.col("role") == "system").alias("sys"), F.get(turns, F.lit(0))["role"].alias("first"))
    issue = F.when(F.col("n") != 2, "messages_must_be_user_assistant_pair").when((F.col("first") != "user") | F.col("sys"), "invalid_roles").otherwise("ok")
    return got.groupBy(issue.alias("issue")).agg(F.count("*").alias("conversations"))


@query("documents", sql="""
WITH m AS (SELECT doc_id, text, CASE WHEN upper(trim(source)) IN ('DP', 'DT', 'DPS') THEN upper(trim(source)) WHEN lang = 'de' THEN 'DT' WHEN lang = 'fr' THEN 'DPS' ELSE 'DP' END AS mode FROM documents)
SELECT doc_id, mode, CASE WHEN mode = 'DT' OR contains(text, '|') THEN 'markdown_table' WHEN mode = 'DPS' THEN 'attached_files' ELSE 'inline_text' END AS data_interface,
  CASE WHEN regexp_matches(text, '^[ ]*(import|from) ') THEN 'code_only' WHEN contains(text, '<python>') OR contains(text, 'gurobipy') OR contains(text, 'model.optimize()') THEN 'math_model_with_code' ELSE 'math_model' END AS answer_style FROM m""")
def mode_inference(d):
    mode = T.normalize_mode(F.when(F.col("lang") == "de", "dt ").when(F.col("lang") == "fr", "DPS").otherwise(F.col("source")))
    return d.select("doc_id", mode.alias("mode"), T.infer_interface(mode, F.col("text")).alias("data_interface"), T.answer_style("text").alias("answer_style"))


@query("documents", sql="SELECT doc_id, length(text) < 40 AS short_problem, length(text) > 30000 AS long_problem, CAST(floor(length(text) / 4) AS BIGINT) AS tokens_est FROM documents")
def token_estimate(d):
    return d.select("doc_id", (F.length("text") < 40).alias("short_problem"), (F.length("text") > 30000).alias("long_problem"), T.token_estimate("text").cast("long").alias("tokens_est"))


@query("events", sql="""
SELECT event_type, CASE event_type WHEN 'view' THEN 'logistics' WHEN 'click' THEN 'production' WHEN 'purchase' THEN 'finance' ELSE 'generic' END AS domain, count(*) AS n FROM events GROUP BY ALL""")
def vocabulary_map(e):
    table = {"view": "logistics", "click": "production", "purchase": "finance"}
    return e.groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", T.mapped("event_type", table, vocab.DOMAINS, "generic").alias("domain"), "n")


@query("documents", sql="SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def bucket_distribution(d):
    return d.groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("pages", sql="""
WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1)) AS x, generate_subscripts(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), 1) AS i FROM pages)
SELECT p.page_id, arg_max(x, (length(x), -i)) AS block FROM pages p LEFT JOIN b USING (page_id) GROUP BY p.page_id""")
def longest_block(p):
    return p.select("page_id", T.longest(F.regexp_extract_all("html", F.lit(r"(?s)<p>(.*?)</p>"), 1)).alias("block"))


# ---- similarity and selection

_SETS = f"SELECT doc_id AS id, {TOKENS} AS tokens FROM documents"
_PAIRS = f"""
s AS ({_SETS}), t AS (SELECT id, len(tokens) AS n, unnest(tokens) AS tok FROM s),
c AS (SELECT x.id AS a, y.id AS b, x.n AS na, y.n AS nb, count(*) AS k FROM t x JOIN t y ON x.tok = y.tok AND x.id < y.id GROUP BY ALL),
pairs AS (SELECT a, b, k / (na + nb - k) AS jaccard FROM c WHERE k / (na + nb - k) > {vocab.MAX_SIMILARITY})"""


def _sets(d: DataFrame) -> DataFrame:
    return d.select(F.col("doc_id").alias("id"), T.token_set("text").alias("tokens"))


@query("documents", sql=f"WITH {_PAIRS} SELECT a, b, jaccard FROM pairs")
def jaccard_pairs(d):
    return similarity.jaccard_pairs(_sets(d))


@query("documents", "benchmark", sql=f"""
WITH s AS ({_SETS}), t AS (SELECT id, len(tokens) AS n, unnest(tokens) AS tok FROM s),
r AS (SELECT item_id, {TOKENS} AS tokens FROM benchmark), u AS (SELECT item_id, len(tokens) AS n, unnest(tokens) AS tok FROM r),
c AS (SELECT t.id, t.n, u.item_id, u.n AS m, count(*) AS k FROM t JOIN u USING (tok) GROUP BY ALL),
b AS (SELECT id, max(k / (n + m - k)) AS best FROM c GROUP BY id)
SELECT s.id AS doc_id, coalesce(best, 0.0) AS best FROM s LEFT JOIN b USING (id)""")
def similarity_to_reference(d, b):
    return similarity.best_similarity(_sets(d), b.select(F.col("item_id").alias("id"), T.token_set("text").alias("tokens"))).withColumnRenamed("id", "doc_id")


@query("documents")
def near_dup_select(d):
    """Of equal sets the first decides: those after it conflict with it, or with what it conflicts with."""
    pairs, of = similarity.class_pairs(_sets(d))
    heads = d.select(F.col("doc_id").alias("id")).join(of.where("id <> class").select("id").distinct(), "id", "left_anti")
    return similarity.first_without_conflict(heads.withColumn("place", F.col("id")), pairs).select(F.col("id").alias("doc_id"))


@query("documents", sql="SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS turn FROM documents")
def round_robin_turns(d):
    return records.round_robin(d.select("lang", "source", "doc_id"), ["lang"], ["source"], ["doc_id"]).select("lang", "source", "doc_id", F.col("turn").cast("long").alias("turn"))


@query("documents", sql="WITH t AS (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS turn FROM documents) SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY turn, source, doc_id) AS rank FROM t")
def round_robin_order(d):
    got = records.round_robin(d.select("lang", "source", "doc_id"), ["lang"], ["source"], ["doc_id"])
    return got.select("lang", "doc_id", F.col("rank").cast("long").alias("rank"))


@query("documents", sql="""
WITH c AS (SELECT CASE lang WHEN 'en' THEN 'DP' WHEN 'de' THEN 'DT' ELSE 'DPS' END AS mode, count(*) AS n FROM documents GROUP BY 1)
SELECT mode, n, least(n, CAST(round_even(80 * CASE mode WHEN 'DP' THEN 0.35 WHEN 'DT' THEN 0.25 ELSE 0.40 END, 0) AS BIGINT)) AS quota FROM c""")
def mode_quota(d):
    mode = F.when(F.col("lang") == "en", "DP").when(F.col("lang") == "de", "DT").otherwise("DPS")
    n = d.groupBy(mode.alias("mode")).agg(F.count("*").alias("n"))
    share = F.element_at(F.create_map(*[F.lit(x) for kv in vocab.MODE_SHARES.items() for x in kv]), F.col("mode"))
    return n.select("mode", "n", F.least("n", F.bround(80 * share).cast("long")).alias("quota"))


@query("benchmark", "documents", sql="""
WITH j AS (SELECT item_id AS job, CASE item_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'fr' END AS lang, 'src' || (item_id % 20) AS source FROM benchmark),
x AS (SELECT job, doc_id AS parent, CAST(j.lang = d.lang AS INTEGER) + CAST(j.source = d.source AS INTEGER) AS score FROM j CROSS JOIN documents d),
r AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY score DESC, sha256(job || ':' || parent)) AS rank FROM x)
SELECT job, parent, score, rank FROM r WHERE rank <= 8""")
def parent_topk(b, d):
    jobs = b.select(F.col("item_id").alias("job"), F.element_at(F.array(*map(F.lit, ("en", "de", "fr"))), (F.col("item_id") % 3 + 1).cast("int")).alias("lang"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("source"))
    pool = d.select(F.col("doc_id").alias("parent"), "lang", "source")
    got = similarity.top_parents(jobs, pool, ["lang", "source"], 8, F.sha2(F.concat_ws(":", F.col("job").cast("string"), F.col("parent").cast("string")), 256))
    return got.withColumn("rank", F.col("rank").cast("long"))


@query("events", sql="SELECT user_id, event_type, count(*) AS usage, 1.0 / (1.0 + count(*) * CAST(0.5 AS DOUBLE)) AS weight FROM events GROUP BY ALL")
def usage_weight(e):
    return e.groupBy("user_id", "event_type").agg(F.count("*").alias("usage")).withColumn("weight", flywheel.usage_weight(F.col("usage"), 0.5))


@query("documents", "labels", sql="""
WITH l AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id), j AS (SELECT d.doc_id, coalesce(q = 1, false) AS ok FROM documents d LEFT JOIN l USING (doc_id)),
g AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM j WHERE ok)
SELECT j.doc_id, CASE WHEN r IS NULL THEN 'rejected' WHEN r <= 100 THEN 'accepted' ELSE 'surplus' END AS status FROM j LEFT JOIN g USING (doc_id)""")
def accept_surplus(d, lab):
    q = lab.groupBy("doc_id").agg(F.max("quality").alias("q"))
    j = d.select("doc_id").join(q, "doc_id", "left").select("doc_id", F.coalesce(F.col("q") == 1, F.lit(False)).alias("ok"))
    return records.accept(j, F.col("ok"), "doc_id", 100).select("doc_id", "status")


# ---- rounds, resuming, results

@query("events", sql="SELECT CAST(max(event_id) + 1 AS BIGINT) AS next_idx, max(CAST(floor(event_id / 1000) AS BIGINT)) AS last_round, count(*) FILTER (WHERE event_type = 'purchase') AS accepted FROM events")
def attempt_summary(e):
    return e.agg((F.max("event_id") + 1).alias("next_idx"), F.max(F.floor(F.col("event_id") / 1000).cast("long")).alias("last_round"), F.count_if(F.col("event_type") == "purchase").alias("accepted"))


@query("events", sql="SELECT CAST(floor(event_id / 1000) AS BIGINT) AS round, count(*) AS attempts, count(*) FILTER (WHERE value > 50) AS accepted, greatest(1, CAST(ceil((1000 - count(*) FILTER (WHERE value > 50)) * 1.5) AS BIGINT)) AS planned FROM events GROUP BY 1")
def round_plan(e):
    ok = F.count_if(F.col("value") > 50)
    g = e.groupBy(F.floor(F.col("event_id") / 1000).cast("long").alias("round")).agg(F.count("*").alias("attempts"), ok.alias("accepted"))
    return g.withColumn("planned", F.greatest(F.lit(1), F.ceil((1000 - F.col("accepted")) * 1.5)).cast("long"))


@query("events", sql="""
WITH r AS (SELECT event_id, sha256(event_type || ':' || user_id) AS h FROM events), c AS (SELECT DISTINCT sha256(event_type || ':' || user_id) AS h FROM events WHERE event_type = 'view' OR value > 100)
SELECT h AS request_hash, count(*) AS requests FROM r WHERE h NOT IN (SELECT h FROM c) GROUP BY h""")
def cache_misses(e):
    r = e.select("event_type", "value", F.sha2(F.concat_ws(":", "event_type", F.col("user_id").cast("string")), 256).alias("request_hash"))
    return r.join(r.where("event_type = 'view' or value > 100").select("request_hash").distinct(), "request_hash", "left_anti").groupBy("request_hash").agg(F.count("*").alias("requests"))


@query("documents", "labels", sql="SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_pending(d, lab):
    return evaluation.pending(d.select("doc_id"), lab, "doc_id")


@query("events", sql="SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def last_result_wins(e):
    return records.last_wins(e.select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query("documents", "benchmark", sql="SELECT 'seed' AS pool, count(*) AS n, count(DISTINCT text) AS texts FROM documents GROUP BY ALL UNION ALL SELECT 'all', count(*), count(DISTINCT text) FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark)")
def pool_union(d, b):
    size = lambda df, name: df.agg(F.count("*").alias("n"), F.countDistinct(F.sha2("text", 256)).alias("texts")).select(F.lit(name).alias("pool"), "n", "texts")
    return size(d.select("text"), "seed").unionByName(size(d.select("text").unionByName(b.select("text")), "all"))


@query("events", sql="""
WITH a AS (SELECT user_id, value > 120 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
g AS (SELECT user_id, count(*) AS n, min(i) FILTER (WHERE ok) AS f FROM a WHERE i <= 16 GROUP BY user_id)
SELECT user_id, coalesce(f, n) AS attempts, f IS NOT NULL AS success, CAST(f AS INTEGER) AS first_success FROM g""")
def pass_at_k(e):
    return evaluation.pass_at_k(e, "user_id", ["ts", "event_id"], F.col("value") > 120, 16)


@query("lineitem", sql="SELECT l_returnflag AS target, l_linestatus AS model, count(*) AS total, count(*) FILTER (WHERE abs(l_extendedprice - 900 * l_quantity) <= 5000) AS success, count(*) FILTER (WHERE l_quantity > 10) AS code_pass, count(*) FILTER (WHERE l_tax > 0.07) AS api_errors, 100.0 * CAST(count(*) FILTER (WHERE abs(l_extendedprice - 900 * l_quantity) <= 5000) AS DOUBLE) / count(*) AS success_rate, 100.0 * CAST(count(*) FILTER (WHERE l_quantity > 10) AS DOUBLE) / count(*) AS code_pass_rate FROM lineitem GROUP BY ALL")
def target_summary(li):
    t = li.withColumnRenamed("l_returnflag", "target").withColumnRenamed("l_linestatus", "model")
    return evaluation.summary(t, ["target", "model"], evaluation.within(F.col("l_extendedprice"), 900 * F.col("l_quantity"), 5000), F.col("l_quantity") > 10, F.col("l_tax") > 0.07)


@query("lineitem", sql="SELECT l_shipdate < TIMESTAMP '1995-01-01' AS early, count(*) AS n, count(*) FILTER (WHERE abs(l_discount * 100 - round(l_discount * 100)) <= 1e-6) AS within, avg(CAST(abs(l_discount * 100 - round(l_discount * 100)) <= 1e-6 AS INTEGER)) AS accuracy FROM lineitem GROUP BY 1")
def tolerance_accuracy(li):
    ok = evaluation.within(F.col("l_discount") * 100, F.round(F.col("l_discount") * 100))
    return li.groupBy((F.col("l_shipdate") < F.lit("1995-01-01").cast("timestamp")).alias("early")).agg(F.count("*").alias("n"), F.count_if(ok).alias("within"), F.avg(ok.cast("int")).alias("accuracy"))


@query("events", sql="SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type <> 'login') AS evaluated, count(*) FILTER (WHERE event_type = 'login') AS unsupported, count(*) FILTER (WHERE value > 50 AND event_type <> 'login') AS successful, count(*) FILTER (WHERE value < 1) AS api_errors, CASE WHEN count(*) FILTER (WHERE event_type <> 'login') = 0 THEN 0.0 ELSE count(*) FILTER (WHERE value > 50 AND event_type <> 'login') / count(*) FILTER (WHERE event_type <> 'login') END AS accuracy FROM events GROUP BY user_id")
def final_statistics(e):
    return evaluation.final_statistics(e, F.col("value") > 50, F.col("event_type") == "login", F.col("value") < 1, ["user_id"])


@query("documents", "benchmark", sql="SELECT 'benchmark' AS output, count(*) AS rows FROM benchmark UNION ALL SELECT 'documents', count(*) FROM documents")
def inspect_outputs(d, b):
    return evaluation.inspect_run({"documents": d, "benchmark": b})


@query("documents", sql="SELECT CAST(sum(floor(length(text) / 4)) AS BIGINT) AS tokens, count(*) AS sequences, CAST(128 * 8192 * 250 AS BIGINT) AS consumed, round(128.0 * 8192 * 250 / sum(floor(length(text) / 4)), 2) AS epochs FROM documents")
def training_volume(d):
    return corpus.training_volume(d, T.token_estimate("text"), 8192, 128, 250)


@query("benchmark", "documents")
def parent_choice(b, d):
    """Parents that each job may take, under the hybrid pool: documents of even ids are seeds, the others synthetic."""
    jobs = b.select(F.col("item_id").alias("job"), F.element_at(F.array(*map(F.lit, ("en", "de", "fr"))), (F.col("item_id") % 3 + 1).cast("int")).alias("lang"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("source"))
    pool = d.select(F.col("doc_id").alias("parent"), "lang", "source")
    return flywheel.parent_candidates(jobs, pool.where("parent % 2 = 0"), pool.where("parent % 2 = 1"), ["lang", "source"], "17")


_PAYLOAD = "CASE event_type WHEN 'view' THEN 'Timeout after 360 s' WHEN 'click' THEN 'NameError: x is not defined' WHEN 'purchase' THEN 'TypeError: KeyError' WHEN 'login' THEN 'invalid literal for addConstr' ELSE 'unknown' END"
_LADDER = "CASE " + " ".join(f"WHEN {' OR '.join(f"contains(lower(p), '{x.replace(chr(39), chr(39) * 2)}')" for x in parts)} THEN '{name}'" for name, parts in vocab.BUILD_ERRORS) + " ELSE 'other_build_error' END"


def _classified(e: DataFrame) -> DataFrame:
    p = F.when(F.col("event_type") == "view", "Timeout after 360 s").when(F.col("event_type") == "click", "NameError: x is not defined").when(F.col("event_type") == "purchase", "TypeError: KeyError").when(F.col("event_type") == "login", "invalid literal for addConstr").otherwise("unknown")
    return e.select("event_id", F.when(F.col("value") > 100, "correct").otherwise(T.build_error(p)).alias("error"))


@query("events", sql=f"SELECT event_id, CASE WHEN value > 100 THEN 'correct' ELSE {_LADDER} END AS error FROM (SELECT event_id, value, {_PAYLOAD} AS p FROM events)")
def error_taxonomy(e):
    return _classified(e)


@query("events", sql=f"WITH k AS (SELECT CASE WHEN value > 100 THEN 'correct' ELSE {_LADDER} END AS error FROM (SELECT value, {_PAYLOAD} AS p FROM events)), n AS (SELECT error, count(*) AS n FROM k GROUP BY error) SELECT error, n, n / sum(n) OVER () AS share, CASE WHEN error <> 'correct' THEN n / sum(CASE WHEN error <> 'correct' THEN n ELSE 0 END) OVER () END AS failure_share FROM n")
def error_shares(e):
    return evaluation.error_shares(_classified(e))


@query("orders", sql="SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN o_totalprice WHEN o_orderstatus = 'F' THEN CAST(o_custkey AS DOUBLE) END AS value, CASE WHEN o_totalprice > 200000 THEN 'answer' WHEN o_orderstatus = 'F' THEN 'single' END AS source FROM orders")
def numeric_ladder(o):
    none = F.array().cast("array<struct<k:string,v:double>>")
    items = F.when(F.col("o_orderstatus") == "F", F.array(F.struct(F.lit("x").alias("k"), F.col("o_custkey").cast("double").alias("v")))).otherwise(none)
    truth = T.ground_truth(F.when(F.col("o_totalprice") > 200000, F.col("o_totalprice").cast("string")), items, F.lit("which is it"))
    return o.select("o_orderkey", truth["value"].alias("value"), truth["source"].alias("source"))


# ---- retrieval

@query("benchmark", "documents", sql=f"""
WITH p AS (SELECT doc_id, {RETRIEVAL} AS tokens FROM documents), d AS (SELECT doc_id, len(tokens) AS n, unnest(tokens) AS tok FROM p),
tf AS (SELECT doc_id, n, tok, count(*) AS tf FROM d GROUP BY ALL), df AS (SELECT tok, count(*) AS df FROM tf GROUP BY tok),
st AS (SELECT count(*) AS nn, greatest(avg(len(tokens)), 1.0) AS av FROM p),
q AS (SELECT item_id, tok, count(*) AS qtf FROM (SELECT item_id, unnest({RETRIEVAL}) AS tok FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, round(sum(qtf * ln(1 + (nn - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * n / av))), 6) AS score FROM q JOIN tf USING (tok) JOIN df USING (tok) CROSS JOIN st GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, sha256(CAST(doc_id AS VARCHAR))) AS rank FROM s)
SELECT item_id, doc_id, rank FROM r WHERE rank <= 5""")
def bm25_topk(b, d):
    # ids of items and documents are numbers of different things
    got = retrieval.bm25(b.select(F.concat(F.lit("b"), "item_id").alias("query"), T.retrieval_tokens("text").alias("tokens")), d.select(F.col("doc_id").alias("item"), T.retrieval_tokens("text").alias("tokens")), 5)
    return got.select(F.expr("cast(substring(query, 2) as bigint)").alias("item_id"), F.col("item").alias("doc_id"), F.col("rank").cast("long").alias("rank"))


_BONUS_ITEMS = "SELECT item_id, text, CASE item_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' END AS domain, 'src' || (item_id % 20) AS problem_type FROM benchmark"


@query("benchmark", "documents", sql=f"""
WITH b AS ({_BONUS_ITEMS}), p AS (SELECT doc_id, lang, source, {RETRIEVAL} AS tokens FROM documents), e AS (SELECT item_id, doc_id FROM b JOIN p ON item_id = doc_id),
q AS (SELECT item_id, tok, count(*) AS qtf FROM (SELECT item_id, unnest({RETRIEVAL}) AS tok FROM b) GROUP BY ALL),
d AS (SELECT doc_id, len(tokens) AS n, unnest(tokens) AS tok FROM p), tf AS (SELECT doc_id, n, tok, count(*) AS tf FROM d GROUP BY ALL), df AS (SELECT tok, count(*) AS df FROM tf GROUP BY tok),
st AS (SELECT b.item_id, (SELECT count(*) FROM p) - count(e.doc_id) AS nn, (SELECT sum(len(tokens)) FROM p) - coalesce(sum(len(x.tokens)), 0) AS ll FROM b LEFT JOIN e USING (item_id) LEFT JOIN p x ON x.doc_id = e.doc_id GROUP BY b.item_id),
qd AS (SELECT q.item_id, q.tok, qtf, df - (SELECT count(*) FROM e JOIN tf USING (doc_id) WHERE e.item_id = q.item_id AND tf.tok = q.tok) AS df, nn, greatest(ll / greatest(nn, 1), 1.0) AS av FROM q JOIN df USING (tok) JOIN st ON st.item_id = q.item_id),
s AS (SELECT item_id, doc_id, sum(qtf * ln(1 + (nn - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * n / av))) AS base FROM qd JOIN tf USING (tok) GROUP BY ALL),
a AS (SELECT b.item_id, p.doc_id, p.source, round(coalesce(base, 0) + CASE WHEN b.domain = p.lang THEN {vocab.DOMAIN_BONUS} ELSE 0 END + CASE WHEN b.problem_type = p.source THEN {vocab.TYPE_BONUS} ELSE 0 END, 6) AS score FROM b CROSS JOIN p LEFT JOIN s ON s.item_id = b.item_id AND s.doc_id = p.doc_id WHERE b.item_id <> p.doc_id),
u AS (SELECT *, sha256('17:' || item_id || ':' || doc_id) AS tie FROM a QUALIFY row_number() OVER (PARTITION BY item_id, doc_id // 2 ORDER BY score DESC, sha256('17:' || item_id || ':' || doc_id)) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, tie) AS rank FROM u)
SELECT item_id, doc_id, rank FROM r WHERE rank <= 5""")
def bm25_bonus(b, d):
    """Examples by BM25 with bonuses, without the query's own item, one of each pair of documents that share a source key."""
    domain = F.when(F.col("item_id") % 3 == 0, "en").when(F.col("item_id") % 3 == 1, "de")
    queries = b.select(F.col("item_id").alias("query"), T.retrieval_tokens("text").alias("tokens"), domain.alias("domain"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("problem_type"))
    key = F.concat(F.lit("k"), F.floor(F.col("doc_id") / 2).cast("string"))
    pool = d.select(F.col("doc_id").alias("item"), T.retrieval_tokens("text").alias("tokens"), F.col("lang").alias("domain"), F.col("source").alias("problem_type"), key.alias("source_key"))
    tie = lambda q, i: F.sha2(F.concat_ws(":", F.lit("17"), q.cast("string"), i.cast("string")), 256)
    got = retrieval.bm25(queries, pool, 5, tie, {k: retrieval.BONUS[k] for k in ("domain", "problem_type")})
    return got.select(F.col("query").alias("item_id"), F.col("item").alias("doc_id"), F.col("rank").cast("long").alias("rank"))


_DRAW = "CAST('0x' || substr(sha256('17:{}:' || item_id), 1, 15) AS BIGINT)"


@query("benchmark", "documents", sql=f"""
WITH n AS (SELECT count(*) AS n FROM documents), pr AS (SELECT min(x) AS p FROM (SELECT unnest(range(greatest(n, 2), n + 1000)) AS x FROM n) c WHERE NOT EXISTS (SELECT 1 FROM range(2, 40000) t(d) WHERE d * d <= x AND x % d = 0)),
p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents),
v AS (SELECT item_id, turn, ({_DRAW.format('start')} % p + turn * (1 + {_DRAW.format('step')} % (p - 1))) % p AS place FROM benchmark, pr, range(0, 64) t(turn)),
m AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY turn) AS rank FROM v JOIN p USING (place) WHERE item_id <> doc_id)
SELECT item_id, doc_id, rank FROM m WHERE rank <= 5""")
def fewshot_random(b, d):
    got = retrieval.random_examples(b.select(F.col("item_id").alias("query")), d.select(F.col("doc_id").alias("item")), 5, "17")
    return got.select(F.col("query").alias("item_id"), F.col("item").alias("doc_id"), F.col("rank").cast("long").alias("rank"))


@query("documents")
def diverse_selection(d):
    """A tenth of the documents by mode quotas, round-robin over sources, none too similar to one before."""
    mode = F.when(F.col("lang") == "en", "DP").when(F.col("lang") == "de", "DT").otherwise("DPS")
    items = d.select(F.col("doc_id").alias("id"), T.token_set("text").alias("tokens"), mode.alias("mode"), "source")
    return records.select_diverse(items, "mode", ["source"], ["id"], max(d.count() // 10, 1)).select(F.col("id").alias("doc_id"), "mode")


# ---- linear programs, from orders and parts

def _program(li: DataFrame) -> tuple[DataFrame, DataFrame]:
    coefs = li.groupBy(F.lit("m").alias("model"), F.col("l_orderkey").alias("con"), F.col("l_partkey").alias("var")).agg(F.sum(F.col("l_quantity") - 25).alias("coef"))
    cons = li.groupBy(F.lit("m").alias("model"), F.col("l_orderkey").alias("con")).agg(F.max("l_returnflag").alias("f"), F.sum(F.when(F.col("l_linestatus") == "O", F.lit(0.0)).otherwise(F.col("l_quantity"))).alias("rhs"))
    return cons.select("model", "con", F.when(F.col("f") == "A", "<").when(F.col("f") == "R", "=").otherwise(">").alias("sense"), "rhs"), coefs


_PROGRAM = """
coefs AS (SELECT l_orderkey AS con, l_partkey AS var, sum(l_quantity - 25) AS coef FROM lineitem GROUP BY ALL),
cons AS (SELECT l_orderkey AS con, CASE max(l_returnflag) WHEN 'A' THEN '<' WHEN 'R' THEN '=' ELSE '>' END AS sense, sum(CASE WHEN l_linestatus = 'O' THEN 0.0 ELSE l_quantity END) AS rhs FROM lineitem GROUP BY l_orderkey)"""


@query("lineitem", sql=f"""
WITH {_PROGRAM}, one AS (SELECT con, any_value(var) AS var, any_value(coef) AS coef FROM coefs WHERE abs(coef) >= 1e-12 GROUP BY con HAVING count(*) = 1),
b AS (SELECT var, max(rhs / coef) FILTER (WHERE sense IN ('>', '=')) AS lb, min(rhs / coef) FILTER (WHERE sense IN ('<', '=')) AS ub FROM one JOIN cons USING (con) GROUP BY var)
SELECT var, CASE WHEN lb = 0 THEN 0.0 ELSE lb END AS lb, CASE WHEN ub = 0 THEN 0.0 ELSE ub END AS ub FROM b""")
def singleton_bounds(li):
    got = lp.singleton_bounds(*_program(li))[0]
    return got.select("var", *[F.when(F.col(c) == 0, 0.0).otherwise(F.col(c)).alias(c) for c in ("lb", "ub")])  # no negative zero


@query("lineitem", sql=f"""
WITH {_PROGRAM}, t AS (SELECT con, sum(coef) AS s FROM coefs GROUP BY con)
SELECT con, CASE WHEN abs(rhs) < 1e-9 AND sense = '<' THEN '>' ELSE sense END AS sense, CASE WHEN abs(rhs) < 1e-9 AND (sense = '<' OR (sense = '=' AND s < 0)) THEN -1.0 ELSE 1.0 END AS sign FROM cons JOIN t USING (con)""")
def zero_rhs_sign(li):
    return lp.zero_rhs_sign(*_program(li)).select("con", "sense", "sign")


_COLORS = """
e AS (SELECT DISTINCT 'o' || l_orderkey AS a, 'p' || l_partkey AS b, l_returnflag AS w FROM lineitem), ee AS (SELECT a, b, w FROM e UNION ALL SELECT b, a, w FROM e),
c0 AS (SELECT DISTINCT a AS node, left(a, 1) AS color FROM ee),
c1 AS (SELECT c.node, md5(c.color || '|' || string_agg(n.color || '|' || w, '|' ORDER BY n.color || '|' || w)) AS color FROM c0 c JOIN ee ON ee.a = c.node JOIN c0 n ON n.node = ee.b GROUP BY c.node, c.color),
c2 AS (SELECT c.node, md5(c.color || '|' || string_agg(n.color || '|' || w, '|' ORDER BY n.color || '|' || w)) AS color FROM c1 c JOIN ee ON ee.a = c.node JOIN c1 n ON n.node = ee.b GROUP BY c.node, c.color)"""


def _colors(li: DataFrame) -> DataFrame:
    e = li.select(F.concat(F.lit("o"), "l_orderkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b"), F.col("l_returnflag").alias("w")).distinct()
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    return lp.refine(both.select(F.col("a").alias("node"), F.left("a", F.lit(1)).alias("color")).distinct(), both, 2)


@query("lineitem", sql=f"WITH {_COLORS} SELECT node, color FROM c2")
def wl_colors(li):
    return _colors(li)


@query("lineitem", sql=f"WITH {_COLORS}, n AS (SELECT left(node, 1) AS side, color, count(*) AS n FROM c2 GROUP BY ALL) SELECT side, count(*) AS classes, max(n) AS largest, max(n) = 1 AS determinable FROM n GROUP BY side")
def wl_determinable(li):
    n = _colors(li).groupBy(F.left("node", F.lit(1)).alias("side"), "color").agg(F.count("*").alias("n"))
    return n.groupBy("side").agg(F.count("*").alias("classes"), F.max("n").alias("largest"), (F.max("n") == 1).alias("determinable"))


_MODELS = """
e AS (SELECT DISTINCT 'm' || l_linenumber AS model, 'm' || l_linenumber || 'o' || l_orderkey AS a, 'm' || l_linenumber || 'p' || l_partkey AS b, l_returnflag AS w FROM lineitem), ee AS (SELECT model, a, b, w FROM e UNION ALL SELECT model, b, a, w FROM e),
c0 AS (SELECT DISTINCT model, a AS node, substr(a, length(model) + 1, 1) AS color FROM ee),
c1 AS (SELECT c.model, c.node, md5(c.color || '|' || string_agg(n.color || '|' || w, '|' ORDER BY n.color || '|' || w)) AS color FROM c0 c JOIN ee ON ee.a = c.node JOIN c0 n ON n.node = ee.b GROUP BY c.model, c.node, c.color)"""


def _models(li: DataFrame) -> tuple[DataFrame, DataFrame]:
    model = F.concat(F.lit("m"), "l_linenumber")
    name = lambda kind, key: F.concat(model, F.lit(kind), key)
    e = li.select(name("o", "l_orderkey").alias("a"), name("p", "l_partkey").alias("b"), F.col("l_returnflag").alias("w"), model.alias("model")).distinct()
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w", "model"))
    return both.select("model", F.col("a").alias("node"), F.substring("a", F.length("model") + 1, F.lit(1)).alias("color")).distinct(), both.select("a", "b", "w")


@query("lineitem", sql=f"WITH {_MODELS}, s AS (SELECT model, list_sort(list(DISTINCT color)) AS colors FROM c1 GROUP BY model) SELECT x.model AS a, y.model AS b, x.colors = y.colors AS wl_check FROM s x JOIN s y ON x.model < y.model")
def wl_equivalence(li):
    """Whether the order-part graphs of two line numbers have the same colours after one round."""
    nodes, edges = _models(li)
    return lp.compare_colors(nodes.select("node", "model").join(lp.refine(nodes.select("node", "color"), edges, 1), "node"))


def _incidences(li: DataFrame) -> DataFrame:
    """The graphs of _models as graphs.ambiguous_parts takes them. A node is a long: its key, side and line number as digits
    of one number; where they don't fit, numbers are counted out."""
    line, keys = F.col("l_linenumber").cast("long"), ("l_orderkey", "l_partkey")
    e = li.select(line.alias("model"), *[F.col(k).cast("long").alias(k) for k in keys], F.xxhash64("l_returnflag").alias("w")).where("model is not null")
    ends = e.agg(*[f(c) for c in ("model", *keys) for f in (F.min, F.max)]).first()
    least, width = ends[0] or 0, (ends[1] or 0) - (ends[0] or 0) + 1
    if max(abs(x or 0) for x in ends[2:]) < (1 << 61) // width:
        node = lambda key, side: (F.col(key) * 2 + side) * width + (F.col("model") - F.lit(least))
        e = e.select("model", "w", node("l_orderkey", 0).alias("a"), node("l_partkey", 1).alias("b"))
    else:
        named = [e.select("model", F.lit(side).alias("side"), F.col(k).alias("key")) for side, k in enumerate(keys)]
        ids = numbered(named[0].union(named[1]).where("key is not null").distinct(), "model", "side", "key", name="node")
        of = lambda side, k, name: ids.where(F.col("side") == side).select("model", F.col("key").alias(k), F.col("node").alias(name))
        e = e.join(of(0, keys[0], "a"), ["model", keys[0]], "left").join(of(1, keys[1], "b"), ["model", keys[1]], "left").select("model", "w", "a", "b")
    both = F.inline(F.array(*[F.struct(F.col(x).alias("node"), F.lit(side).cast("long").alias("color"), F.col("model"), F.col(y).alias("other"), F.col("w")) for side, (x, y) in enumerate(("ab", "ba"))]))
    return e.select(both)


@query("lineitem")
def ambiguous_components(li):
    """Ambiguous parts of the line numbers' graphs under stable colours: their nodes, parts, and whether a part holds a colour twice."""
    got = graphs.ambiguous_parts(_incidences(li))
    colors = got.groupBy("model", "component", "color").agg(F.count("*").alias("k"))
    parts = colors.groupBy("model", "component").agg(F.sum("k").alias("n"), (F.max("k") > 1).alias("twice"))
    return parts.groupBy(F.concat(F.lit("m"), "model").alias("model")).agg(F.sum("n").alias("nodes"), F.count("*").alias("parts"), F.bool_or("twice").alias("undecided"))


# ---- corpus preparation

_WEIGHTS = "SELECT 'src' || i AS path, CAST(i + 1 AS DOUBLE) AS weight FROM range(20) t(i)"


@query("documents", sql=f"""
WITH s AS (SELECT source AS path, CAST(sum(floor(length(text) / 4)) AS BIGINT) AS total_tokens, count(*) AS total_seqs FROM documents GROUP BY source),
w AS ({_WEIGHTS}), j AS (SELECT *, weight / (SELECT sum(weight) FROM w) AS sh FROM s JOIN w USING (path))
SELECT path, total_tokens, total_seqs, weight, round(100 * sh, 2) AS weight_pct, CAST(floor(sh * 146800640) AS BIGINT) AS consumed_tokens_est, round(floor(sh * 146800640) / total_tokens, 2) AS epochs_est FROM j""")
def mixture_stats(d):
    s = d.groupBy(F.col("source").alias("path")).agg(F.sum(T.token_estimate("text")).cast("long").alias("total_tokens"), F.count("*").alias("total_seqs"))
    lines = d.sparkSession.createDataFrame([("# weights",), ("",), *[(f"{i + 1} src{i}",) for i in range(20)]], "value string")
    return corpus.mixture_stats(s, corpus.mixture(lines), 146800640.0)


@query("documents", sql="SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / (SELECT count(*) // 7 FROM documents)) AS BIGINT) AS shard FROM documents")
def shard_split(d):
    return corpus.shards(d.select("doc_id"), ["doc_id"], 7)


@query("documents", sql="""
WITH n AS (SELECT count(*) AS n FROM documents), e AS (SELECT doc_id AS id, unnest(range(0, CAST(ceil((2 * n + 1) / n) AS BIGINT))) AS epoch FROM documents, n)
SELECT CAST(epoch AS INTEGER) AS epoch, id, row_number() OVER (ORDER BY epoch, sha256('42:' || epoch || ':' || id), id) - 1 AS position FROM e""")
def epoch_shuffle(d):
    return corpus.epochs(d.select("doc_id"), "doc_id", 2 * d.count() + 1, "42")


@query("events", sql="SELECT event_id AS iter, value AS lm_loss, CASE WHEN user_id % 2 = 0 THEN 0.0001 END AS lr FROM events")
def log_metrics(e):
    line = F.concat(F.lit(" iteration "), F.col("event_id").cast("string"), F.lit("/ 280 | lm loss: "), F.col("value").cast("string"), F.when(F.col("user_id") % 2 == 0, " | learning rate: 1.0E-04 |").otherwise(" |"))
    return e.select(*corpus.log_metrics(line)[:3])


@query("orders", sql="SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS place FROM orders")
def result_order(o):
    return numbered(o.select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", name="place").select("o_orderkey", "place")
