"""Word lists and tables that results depend on. Fixed values."""

STATUS_ALIASES = {
    "covered": "Covered", "fully covered": "Covered", "fully_covered": "Covered",
    "partially covered": "Partially covered", "partially_covered": "Partially covered",
    "ambiguous": "Ambiguous / not yet plannable", "ambiguous / not yet plannable": "Ambiguous / not yet plannable",
    "uncovered": "Uncovered", "not covered": "Uncovered", "not_covered": "Uncovered",
}
STATUS_WEIGHTS = {"Covered": 1.0, "Partially covered": 0.5, "Ambiguous / not yet plannable": 0.0, "Uncovered": 0.0}
TRACE_FIELDS = ["requirement_id", "source_requirement_id", "source_section", "section", "section_id", "table_id", "figure_id", "rule_id", "page", "page_number", "paragraph", "source_reference", "source_refs", "traceability"]
TRACE_PATTERNS = {
    "section": r"\b[A-Z]\d+(?:\.\d+)*\b",
    "requirement": r"\bREQ_[A-Z0-9_]+\b",
    "table": r"\bTABLE_[A-Z0-9_]+\b|\bTable\s+[A-Z]?\d+(?:\.\d+)*\b",
    "figure": r"\bFIG_[A-Z0-9_]+\b|\bFigure\s+[A-Z]?\d+(?:\.\d+)*\b",
    "page": r"\bpage\s+\d+\b",
}
STRONG_WORDS = ["must", "shall", "required", "requires", "require"]
WEAK_WORDS = """may|might|can|could|is permitted to|are permitted to|permitted|allowed|allowable|may be|can be|could be|might be|optional|optionally|if supported|when supported|where supported|if implemented|when implemented|where implemented|implementation defined|implementation-defined|implementation specific|implementation-specific|platform dependent|platform-dependent|device dependent|device-dependent|configuration dependent|configuration-dependent|configurable|programmable|where applicable|if applicable|when applicable|as applicable|as appropriate|where appropriate|if appropriate|when appropriate|as needed|if needed|when needed|where needed|as required|where required|if required|when required|should|recommended|recommend|recommendation|preferably|preferred|it is recommended|it is preferable|best effort|best-effort|typically|normally|generally|usually|commonly|often|in general|by default|default|timely|timely manner|reasonable time|as soon as possible|eventually|soon|later|early|earliest|latest|where possible|if possible|when possible|as possible|approximately|about|around|roughly|near|minimum necessary|sufficient|sufficiently|adequate|adequately|appropriate|reasonable|minimal|maximum possible|up to|at least where possible|including but not limited to|for example|such as|etc|and so on|among others|support|supports|is supported|is included|provided|available|capable of|intended to|designed to|aims to|allows|enables|unless otherwise specified|where not otherwise specified|except where|except when|subject to|depending on|depends on|based on""".split("|")
COMMON_TOKENS = "the and for with that this from shall must should will may can are was were has have not when then than into only value values section figure table".split()
NUMBER_PATTERN = r"[-+]?\d+(?:\.\d+)?(?:\s*(?:%|v|a|hz|khz|mhz|ghz|ms|us|ns|s|kb|mb|gb|bit|bits|byte|bytes))?"
OBLIGATION_PATTERN = r"\b(shall|must|will|should|required to|may not|is prohibited|may|can)\b"
REFERENCE_PATTERN = r"\b((?:section|figure|fig\.?|table)\s+[A-Za-z]?\d+(?:[-.]\d+)*)"
#: Dollars per million tokens: (model, input, output).
MODEL_PRICES = [("gpt-5.6-sol", "5.00", "30.00"), ("gpt-5.6-terra", "2.50", "15.00"), ("gpt-5.6-luna", "1.00", "6.00"), ("gpt-5.5", "5.00", "30.00"), ("gpt-5.4", "2.50", "15.00"), ("gpt-5.4-mini", "0.75", "4.50")]
#: Least similarity of a pair by content area; class limits of a changed wording.
MATCH_LIMITS = {"requirement": 0.78, "note": 0.78, "figure": 0.70, "table": 0.65, "page": 0.30}
WORDING_LIMITS = (0.90, 0.65)
TOKENS_USED, CANDIDATES, LENGTH_RATIO, TOKEN_OVERLAP = 40, 20, 0.35, 0.08
