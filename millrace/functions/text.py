"""Scalar functions as Column expressions: text, messages, vocabularies, code and numbers. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace import vocab


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def first_of(*values: Column) -> Column:
    """The first value that is neither null nor empty text."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def messages_of(messages: Column | str, role: str) -> Column:
    return F.transform(F.filter(_c(messages), lambda m: m["role"] == role), lambda m: m["content"])


def last_message(messages: Column | str, role: str) -> Column:
    """Trimmed content of the last message of a role; empty if none."""
    return bare_ends(F.coalesce(F.try_element_at(messages_of(messages, role), F.lit(-1)), F.lit("")))


def first_message(messages: Column | str, role: str) -> Column:
    return bare_ends(F.coalesce(F.try_element_at(messages_of(messages, role), F.lit(1)), F.lit("")))


def after_markers(text: Column | str) -> Column:
    """What follows the last occurrence of each question marker, tried in order."""
    out = F.replace(_c(text), F.lit("\r\n"), F.lit("\n"))
    for m in vocab.QUESTION_MARKERS:
        out = F.substring_index(out, m, -1)
    return out


def fold_newlines(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), "\n{3,}", "\n\n")


def strip_prompt(text: Column | str) -> Column:
    """The question of a wrapped prompt: after the markers, without ``[TAG]`` blocks (up to their blank line) and
    lines that open with a bracket, trimmed, blank lines folded."""
    state = F.struct(F.lit(False).alias("skip"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, line: Column) -> Column:
        bare = bare_ends(line)
        tag = F.regexp_like(bare, F.lit(r"^\[[A-Z_ ]+\]$"))
        drop = tag | s["skip"] | (bare.startswith("[") & F.contains(F.substring(bare, 1, 80), F.lit("]")))
        skip = F.when(tag, True).when(s["skip"] & (bare == ""), False).otherwise(s["skip"])
        return F.struct(skip.alias("skip"), F.when(drop, s["out"]).otherwise(F.array_append(s["out"], line)).alias("out"))

    kept = F.aggregate(F.split(after_markers(text), "\n", -1), state, step, lambda s: s["out"])
    return fold_newlines(bare_ends(F.array_join(kept, "\n")))


def token_set(text: Column | str) -> Column:
    """Distinct lower-case ASCII words of three characters or more."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(_c(text)), F.lit("([a-z0-9_]+)"), 1), lambda w: F.length(w) >= 3))


def retrieval_tokens(text: Column | str) -> Column:
    """Words and numbers of over one character that aren't stopwords, lower-cased, repeats kept."""
    found = F.regexp_extract_all(_c(text), F.lit(r"([A-Za-z][A-Za-z0-9_]*|[0-9]+(?:\.[0-9]+)?)"), 1)
    return F.filter(F.transform(found, F.lower), lambda w: (F.length(w) > 1) & ~w.isin(*vocab.STOPWORDS))


def flags(text: Column | str, patterns, prefix: str = "") -> Column:
    """Names of the patterns (name, regex), matched without case, that occur in the text, in order."""
    hits = [F.when(F.regexp_like(_c(text), F.lit(f"(?i){p}")), F.lit(f"{prefix}{n}")) for n, p in patterns]
    return F.array_compact(F.array(*hits))


def text_issues(text: Column | str) -> Column:
    t = F.coalesce(_c(text), F.lit(""))
    return F.when(F.regexp_like(t, F.lit(r"^\s*$")), F.array(F.lit("empty_text"))).otherwise(flags(t, vocab.FORBIDDEN_TEXT, "forbidden:"))


def normalize_mode(value: Column | str) -> Column:
    v = F.upper(bare_ends(F.coalesce(_c(value), F.lit(""))))
    return F.when(v.isin(*vocab.PROBLEM_MODES), v).otherwise("DP")


def infer_interface(mode: Column, problem: Column, rule_row: bool = False) -> Column:
    """A table for mode DT or any pipe (with ``rule_row``, a table rule), files for DPS, else inline text."""
    if rule_row:
        table = (mode == "DT") | F.regexp_like(problem, F.lit(r"\|[ \t:-]+\|"))
        return F.when(mode == "DPS", "attached_files").when(table, "markdown_table").otherwise("inline_text")
    return F.when((mode == "DT") | F.contains(problem, F.lit("|")), "markdown_table").when(mode == "DPS", "attached_files").otherwise("inline_text")


def answer_style(answer: Column | str) -> Column:
    a = _c(answer)
    code = F.regexp_like(a, F.lit(r"^\s*(import|from) "))
    mixed = F.contains(a, F.lit("<python>")) | F.contains(a, F.lit("gurobipy")) | F.contains(a, F.lit("model.optimize()"))
    return F.when(code, "code_only").when(mixed, "math_model_with_code").otherwise("math_model")


def mapped(value: Column | str, table: dict[str, str], known, default: str) -> Column:
    v = bare_ends(F.coalesce(_c(value), F.lit("")))
    v = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), v), v) if table else v
    return F.when(v.isin(*known), v).otherwise(default)


def map_domain(v: Column | str) -> Column:
    return mapped(v, vocab.DOMAIN_MAP, vocab.DOMAINS, "generic")


def map_structure(v: Column | str) -> Column:
    return mapped(v, vocab.STRUCTURE_MAP, vocab.STRUCTURES, "generic_lp_mip")


def map_difficulty(v: Column | str) -> Column:
    return mapped(v, {}, vocab.DIFFICULTIES, "medium")


def short_hash(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the joined parts."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 16)


def json_object(text: Column | str) -> Column:
    """The JSON object in a reply, as a variant: fences cut off, else the widest brace pair; null if there is none."""
    t = F.regexp_replace(bare_ends(_c(text)), r"(?s)^```(?:json)?\s*(.*?)\s*```$", "$1")
    return F.coalesce(F.try_parse_json(t), F.try_parse_json(F.nullif(F.regexp_extract(t, r"(?s)(\{.*\})", 1), F.lit(""))))


def render_files(files: Column | str, limit: int = 6000, all_or_nothing: bool = False) -> Column:
    """The heading, and a headed, fenced block for each of ``files(path, kind, content)``; empty without any. A file over
    the limit is left out, or (``all_or_nothing``) empties the whole. Content is text; JSON text (kind or name) is
    fenced as json if it is an object or a list."""
    f = F.coalesce(_c(files), F.array().cast("array<struct<path:string,kind:string,content:string>>"))
    fits = F.filter(f, lambda x: F.length(F.coalesce(x["content"], F.lit(""))) <= limit)

    def block(x: Column) -> Column:
        path, kind, text = first_of(x["path"], F.lit("data.txt")), F.lower(F.coalesce(x["kind"], F.lit(""))), F.coalesce(x["content"], F.lit(""))
        is_json = F.regexp_like(text, F.lit(r"^\s*[\[{]")) & ((kind == "json") | path.endswith(".json"))
        fence = F.when(is_json, "json").when((kind == "csv") | path.endswith(".csv"), "csv").otherwise("")
        return F.concat(F.lit("\n### "), path, F.lit("\n```"), fence, F.lit("\n"), text, F.lit("\n```"))

    blocks = F.array_join(F.concat(F.array(F.lit("\n\nThe following structured data files are provided:")), F.transform(fits, block)), "\n")
    none = F.size(fits) == 0
    if all_or_nothing:
        none = none | (F.size(fits) < F.size(f))
    return F.when(none, "").otherwise(blocks)


def longest(blocks: Column) -> Column:
    """The longest, of equals the first; null of an empty array."""
    return F.aggregate(blocks, F.lit(None).cast("string"), lambda a, b: F.when(a.isNull() | (F.length(b) > F.length(a)), b).otherwise(a))


def bare_ends(text: Column) -> Column:
    """Without white space of any kind, line ends included, at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def python_code(reply: Column | str, after_thought_first: bool = True) -> Column:
    """Code of a reply: the longest python fence, else the longest fence, else the text; what follows a closing
    ``</think>`` counts before the whole, or (``after_thought_first`` off) after it, and ``<python>`` tags too."""
    r = F.coalesce(_c(reply), F.lit(""))
    closed = F.regexp_like(r, F.lit(r"(?i)</(?:think|redacted_reasoning)>"))
    after = bare_ends(F.regexp_replace(r, r"(?is)^.*</(?:think|redacted_reasoning)>", ""))
    py = lambda t: longest(F.regexp_extract_all(t, F.lit(r"(?s)```python\s*(.*?)```"), 1))
    bare = lambda t: longest(F.regexp_extract_all(t, F.lit(r"(?s)```\s*(.*?)```"), 1))
    tail = F.when(closed & (after != ""), after).otherwise(r)
    if after_thought_first:
        return bare_ends(F.coalesce(py(after), py(r), bare(after), bare(r), tail))
    big = longest(F.filter(F.regexp_extract_all(r, F.lit(r"(?s)```\s*(.*?)```"), 1), lambda b: F.length(b) > 50))
    tagged = longest(F.regexp_extract_all(r, F.lit(r"(?s)<python>(.*?)</python>"), 1))
    return bare_ends(F.coalesce(py(r), big, bare(r), tagged, tail))


def words_only(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(_c(text)), "[^a-z0-9]+", " "))


def number(text: Column | str) -> Column:
    """A number, or text of one with thousands commas; else null."""
    return F.replace(bare_ends(_c(text).cast("string")), F.lit(","), F.lit("")).try_cast("double")


def safe_name(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), r"[^A-Za-z0-9._-]", "-")


def token_estimate(text: Column | str) -> Column:
    return F.floor(F.length(_c(text)) / 4)


def shorten(text: Column | str, most: int = 400) -> Column:
    t = _c(text)
    half = most // 2
    return F.when(F.length(t) > most, F.concat(F.left(t, F.lit(half)), F.lit("..."), F.right(t, F.lit(half)))).otherwise(t)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def build_error(payload: Column | str) -> Column:
    """Class of a build error: the first whose substrings occur."""
    t, out = F.lower(F.coalesce(_c(payload), F.lit(""))), None
    for name, parts in vocab.BUILD_ERRORS:
        hit = F.contains(t, F.lit(parts[0]))
        for p in parts[1:]:
            hit = hit | F.contains(t, F.lit(p))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other_build_error")


def equivalence_error(checks: Column, text: Column) -> Column:
    """Class of a failed comparison from ``checks`` (map of flag to boolean, may be null) and its text."""
    flag = lambda k: F.coalesce(~F.try_element_at(checks, F.lit(k)), F.lit(False))
    false = F.array_sort(F.map_keys(F.map_filter(checks, lambda k, v: ~v)))
    t = F.lower(F.coalesce(text, F.lit("")))
    out = F.when(flag("var_num_check"), "var_count_mismatch").when(flag("cons_num_check"), "constraint_count_mismatch").when(flag("wl_check"), "wl_graph_mismatch")
    out = out.when(F.size(false) > 0, F.concat(F.lit("structure_mismatch:"), F.array_join(false, ",")))
    return out.when(F.contains(t, F.lit("no reference lp")), "missing_reference_lp").when(F.contains(t, F.lit("normalization")), "normalization_error").otherwise("other_equivalence_error")


def objective(items: Column) -> Column:
    """Value of the last of ``items(k, v)`` whose key names an objective."""
    hit = lambda k: F.array_max(F.array(*[F.regexp_like(k, F.lit(f"(?i){p}")) for p in vocab.OBJECTIVE_KEYS]))
    return F.try_element_at(F.filter(items, lambda x: hit(x["k"])), F.lit(-1))["v"]


def open_top_box(question: Column, items: Column) -> Column:
    """Surface of an open box with a square base, side**2 + 4 * side * height, if the question asks for it and the
    results hold both; else null."""
    q = words_only(F.coalesce(question, F.lit("")))
    asked = F.contains(q, F.lit("square base")) & F.contains(q, F.lit("surface area")) & F.contains(q, F.lit("open top"))
    last = lambda hit: F.try_element_at(F.filter(items, lambda x: hit(words_only(x["k"]))), F.lit(-1))["v"]
    base = lambda k: F.contains(k, F.lit("side of the square base"))
    side, height = last(base), last(lambda k: k.endswith("height of the box") & ~base(k))
    return F.when(asked, side * side + 4.0 * side * height)


def fertilizer_cost(question: Column, items: Column) -> Column:
    """Cost of exactly five fertilizer quantities at the prices that the question gives, in order; else null."""
    found = lambda p: F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(f"(?i){p}"), 1)
    said, listed = found(vocab.FERTILIZER_PRICE), found(vocab.FERTILIZER_TABLE_PRICE)
    prices = F.when(F.size(said) >= 5, said).otherwise(listed)
    ok = (F.size(items) == 5) & F.forall(items, lambda x: F.regexp_like(x["k"], F.lit(vocab.FERTILIZER_KEY))) & (F.size(prices) >= 5)
    cost = F.aggregate(F.zip_with(items, F.slice(prices, 1, 5), lambda x, p: x["v"] * p.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return F.when(ok, cost)


def ground_truth(answer: Column, items: Column, question: Column) -> Column:
    """``struct(value, source)``: the given answer, the single result, the objective, what the question asks to minimise
    (the one matching key, the sum of matching counts, or of all if all are counts), the surface of an open box, or
    the cost of fertilizers; nulls if none."""
    q = F.lower(F.regexp_replace(F.trim(question), r"[.?!]+$", ""))
    target = F.coalesce(*[F.nullif(F.regexp_extract(q, f"({p})", 2), F.lit("")) for p in vocab.QUESTION_TARGETS])
    known = F.filter(items, lambda x: x["v"].isNotNull())
    match = F.filter(known, lambda x: F.contains(words_only(x["k"]), words_only(target)))
    count = lambda x: F.regexp_like(x["k"], F.lit(f"(?i){vocab.COUNT_KEYS}"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x["v"])
    counts = F.filter(match, count)
    asked = F.when(F.size(match) == 1, match[0]["v"]).when(F.size(counts) > 1, total(counts)).when(F.forall(known, count) & (F.size(known) > 0), total(known))
    steps = [("answer", number(answer)), ("single", F.when(F.size(known) == 1, F.try_element_at(known, F.lit(1))["v"])), ("objective", objective(known)), ("question", F.when(target.isNotNull(), asked)), ("open_top_box", open_top_box(question, known)), ("fertilizer_cost", fertilizer_cost(question, known))]
    out = None
    for name, v in steps:
        s = F.struct(v.cast("double").alias("value"), F.lit(name).alias("source"))
        out = F.when(v.isNotNull(), s) if out is None else out.when(v.isNotNull(), s)
    return out


def stated_optimum(optimal: Column, nested_optimal: Column, en_answer: Column, answer: Column) -> Column:
    """Ground truth of a sample that states it: its own field, the nested one, or an answer that is a number."""
    return F.coalesce(optimal, nested_optimal, number(en_answer), number(answer))


def question_text(question: Column, en_question: Column, prompt: Column, messages: Column | None = None) -> Column:
    """The question: its field, its English field, the last user message with any content, else all contents of the
    prompt's messages joined by blank lines, else the prompt's text; null if there is none."""
    out = F.coalesce(question, en_question)
    if messages is None:
        return F.coalesce(out, prompt)
    said = F.filter(messages, lambda m: (m["role"] == "user") & (F.coalesce(m["content"], F.lit("")) != ""))
    joined = F.array_join(F.transform(messages, lambda m: F.coalesce(m["content"], F.lit(""))), "\n\n")
    return F.coalesce(out, F.try_element_at(said, F.lit(-1))["content"], joined, prompt)


def sample_data(data: Column, question: Column, en_question: Column) -> Column:
    """Data of a sample as a variant: its JSON, or an object with its question."""
    said = F.coalesce(question, en_question)
    return F.coalesce(F.try_parse_json(data), F.when(said.isNotNull(), F.parse_json(F.to_json(F.struct(said.alias("question"))))))


def chat_prompt(template: str, values: dict[str, Column]) -> Column:
    """System and user message of a template with SYSTEM: and USER: sections, ``{{name}}`` replaced by the values."""
    if "SYSTEM:" not in template or "USER:" not in template:
        raise ValueError("a template needs a SYSTEM: and a USER: section")
    system, user = template.split("SYSTEM:", 1)[1].split("USER:", 1)

    def filled(text: str) -> Column:
        out = F.lit(text.strip())
        for name, value in values.items():
            out = F.replace(out, F.lit("{{" + name + "}}"), value)
        return out

    return F.array(*[F.struct(F.lit(role).alias("role"), filled(text).alias("content")) for role, text in (("system", system), ("user", user))])


def payload_messages(template: str, payload: Column) -> Column:
    """System message of the generator, and a user message of the template with the payload as indented JSON."""
    body = F.concat(F.lit(template + "\n\nINPUT JSON:\n"), F.to_json(payload, {"pretty": "true", "ignoreNullFields": "false"}))
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(said("system", F.lit("You create high-quality optimization modeling training data.")), said("user", body))


def nested(data: Column, path: str, default: Column) -> Column:
    """A path of a variant as text, or the default where it is missing or null."""
    return F.coalesce(F.try_variant_get(data, f"$.{path}", "string"), default)


def row_id(row_id: Column, ir_id: Column, *content: Column) -> Column:
    """The row's id, its record's id, or a short hash of its content."""
    return F.coalesce(F.nullif(row_id.cast("string"), F.lit("")), F.nullif(ir_id.cast("string"), F.lit("")), short_hash(*content))


def target_id(user_text: Column, answer_id: Column) -> Column:
    """The target that the user text names, else the first known one that the answer's id contains; null if none."""
    a = F.coalesce(answer_id, F.lit(""))
    return F.coalesce(F.nullif(F.regexp_extract(user_text, r"\[Target ID\]\s*([A-Za-z0-9_]+)", 1), F.lit("")), *[F.when(F.contains(a, F.lit(t)), t) for t in vocab.TARGET_IDS])


def retrieval_metadata(problem: Column, domain: Column, problem_type: Column, variant: Column, wp_type: Column, reference_code: Column | None = None) -> Column:
    """``struct(domain, problem_type, variant, wp_type, retrieval_text)``: fields, else the comments of the reference code
    that name them, and the text that retrieval reads."""
    empty = F.lit("")

    def of(field: Column, name: str) -> Column:
        noted = F.regexp_extract(F.coalesce(reference_code, empty), rf"(?m)^#\s*{name}:\s*(.+?)\s*$", 1) if reference_code is not None else empty
        return F.coalesce(F.nullif(field, empty), noted)

    d, t, v, w = of(domain, "Domain"), of(problem_type, "Problem Type"), of(variant, "Variant"), F.coalesce(wp_type, empty)
    text = F.array_join(F.filter(F.array(F.coalesce(problem, empty), d, t, v, w), lambda x: x != ""), "\n")
    return F.struct(d.alias("domain"), t.alias("problem_type"), v.alias("variant"), w.alias("wp_type"), text.alias("retrieval_text"))


def attempt_seed(base: Column, attempt: Column) -> Column:
    return base + attempt


def numeric_id_order(result_id: Column) -> list[Column]:
    """Sort keys of result ids: the number after their first underscore, those without one last, by text."""
    n = F.try_element_at(F.split(result_id, "_"), F.lit(2)).try_cast("int")
    return [n.asc_nulls_last(), result_id]


def result_name(target: Column, model: Column, start: Column, end: Column) -> Column:
    """Name of a result file: target, safe model name, and the range if one is given."""
    span = F.when(start.isNotNull() | end.isNotNull(), F.concat(F.lit("_"), F.coalesce(start.cast("string"), F.lit("0")), F.lit("_"), F.coalesce(end.cast("string"), F.lit("end")))).otherwise("")
    return F.concat(target, F.lit("_"), safe_name(model), span, F.lit(".json"))
