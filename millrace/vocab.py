"""Closed vocabularies, maps and patterns of the record formats."""

# The record formats name these, and results must equal them.
PROBLEM_MODES = ("DP", "DT", "DPS")
DATA_INTERFACES = ("inline_text", "markdown_table", "attached_files")
ANSWER_STYLES = ("math_model", "math_model_with_code", "code_only")
DOMAINS = ("logistics", "production", "energy", "healthcare", "finance", "agriculture", "education", "environment", "computing", "generic")
STRUCTURES = ("assignment", "scheduling", "routing", "transportation", "blending", "capacity_planning", "facility_location", "production_planning", "portfolio", "generic_lp_mip")
DIFFICULTIES = ("small", "medium", "large", "industrial")

# Raw domain and structure names, and what they count as.
DOMAIN_MAP = {
    "logistics_transport": "logistics",
    "production_manufacturing": "production",
    "scheduling_workforce": "production",
    "finance_marketing": "finance",
    "network_flow_graph": "logistics",
    "energy_utilities": "energy",
    "inventory_supply": "production",
    "assignment_selection": "generic",
    "health_pharma": "healthcare",
    "healthcare": "healthcare",
    "education_public": "education",
    "environment_sustainability": "environment",
    "other_domain": "generic",
}
STRUCTURE_MAP = {
    "assignment_matching": "assignment",
    "scheduling_timing": "scheduling",
    "network_flow": "routing",
    "transportation_distribution": "transportation",
    "blending_mixing": "blending",
    "inventory_balance": "capacity_planning",
    "capacity_planning": "capacity_planning",
    "facility_location": "facility_location",
    "production_planning": "production_planning",
    "portfolio_budget": "portfolio",
    "selection_knapsack": "generic_lp_mip",
    "covering_set": "generic_lp_mip",
    "packing_cutting": "generic_lp_mip",
}

# What precedes a question in a wrapped prompt, in the order tried.
QUESTION_MARKERS = (
    "Answer the following mathematical modeling question:",
    "Mathematical modeling question:",
    "Optimization problem:",
    "Problem:",
    "Question:",
)

# Patterns of unfinished text, matched without case.
FORBIDDEN_TEXT = (
    ("placeholder", r"\bplaceholder\b"),
    ("todo", r"\bTODO\b|\bTBD\b"),
    ("na", r"\bN/A\b"),
    ("locked", r"\bLocked\b"),
    ("sc0", r"\bSc0\b"),
    ("skip_artifact", r"\)\s*Skip\b|\bSkip the rest\b"),
)
SOURCE_TRACES = (
    ("private_api_or_key", r"sk-[A-Za-z0-9]|(?:10|192\.168|172\.(?:1[6-9]|2\d|3[01]))(?:\.\d{1,3}){2}"),
    ("local_path", r"/home/[^\s\"']+|/root/|/mnt/|/tmp/"),
    ("unfinished", r"\bplaceholder\b|\bTODO\b|\bTBD\b|\bN/A\b|\bLocked\b|\bSc0\b|\)\s*Skip\b"),
)

# Words that retrieval ignores, the weights of its bonuses, and BM25's constants.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "with")
BM25_K1, BM25_B = 1.2, 0.75
DOMAIN_BONUS, TYPE_BONUS, WP_BONUS = 2.0, 1.0, 0.25
TARGET_IDS = ("nl4opt_solver", "optibench_solver", "bench4opt_feasible_solver", "bench4opt_orgeval")

# Build errors in the order tested, each with the lower-case substrings that tell it.
BUILD_ERRORS = (
    ("api_error", ("api_error",)),
    ("timeout", ("timeout",)),
    ("syntax_error", ("syntaxerror", "positional argument follows keyword argument")),
    ("model_not_found", ("model_not_found",)),
    ("name_error", ("nameerror", "is not defined")),
    ("key_error", ("keyerror",)),
    ("index_error", ("indexerror", "out of bounds")),
    ("type_error", ("typeerror", "unsupported operand type", "unhashable type", "not subscriptable", "can't multiply sequence")),
    ("value_error", ("valueerror", "could not convert", "invalid literal")),
    ("gurobi_api_error", ("addconstr", "addvars", "duplicate keys in model.addvars")),
    ("lp_build_failure", ("lp_build_error", "lp file was not created")),
)

# Keys of a result that name its objective, the count-like keys, and the questions that name a target.
OBJECTIVE_KEYS = (
    r"(optimal|maximum|minimum|maximized|minimized|max|min|profit|cost|revenue|objective|ratio|value|area|volume|perimeter|surface|time|distance|earnings|income|wage|npv|exposure|audience|utility|output|pollution|sodium|sugar|fat|calories?|radiation|light|donations|payout|energy|total)",
    r"amount of .* (used|required|needed|produced|processed|transported|delivered|picked|extracted|consumed|converted)",
    r"number of .* (delivered|processed|transported|stored|treated|performed)",
    r"seating availability",
    r"product of the two numbers",
    r"length of the rope required",
    r"mass that can be supported",
)
COUNT_KEYS = r"^(the )?(number|quantity|hours|workers|acres|amount invested|investment)"
QUESTION_TARGETS = (
    r"minimize the total number of ([a-z\- ]+?)(?: needed| used| required)?$",
    r"reduce the total number of ([a-z\- ]+?)(?: needed| used| required)?$",
    r"decrease the total number of ([a-z\- ]+?)(?: needed| used| required)?$",
    r"find the minimum number of ([a-z\- ]+?)(?: that can be used)?$",
    r"minimize the total number of ([a-z\- ]+?)$",
)

FERTILIZER_KEY = r"^The quantity of Fertilizer \d+$"
FERTILIZER_PRICE = r"\$([0-9]+(?:\.[0-9]+)?)\s*per\s*100\s*pounds"
FERTILIZER_TABLE_PRICE = r"\|\s*Fertilizer\s+\d+\s*\|[^\n]*?\|\s*([0-9]+(?:\.[0-9]+)?)\s*(?:\n|\|)"

# What a prompt with examples says around them.
EXAMPLES_SYSTEM = "\n\nYou will see solved examples from the same target before the current question. Use them only as format and modeling examples. Do not copy example-specific data."
EXAMPLES_PROMPT = "The following are solved examples from the same target. They are not the current problem. Use them only as output-format and modeling examples. Do not copy example-specific data."

# The shares of a selection by mode, and the largest similarity within it.
MODE_SHARES = {"DP": 0.35, "DT": 0.25, "DPS": 0.40}
MAX_SIMILARITY = 0.82
