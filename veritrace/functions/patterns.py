"""Patterns and word lists of extraction and quality checks. Results depend on each.

Spark reads them as Java patterns; (?i) and (?U) stand where case and Unicode words matter."""

# What a numbered section, a table and a figure look like.
SECTION_LINE = r"^((?:\d+(?:\.\d+)*|[A-C]\d+(?:\.\d+)*))\s+(.+)$"
SECTION_ID = r"^(?:\d+(?:\.\d+)*|[A-Z]\d+(?:\.\d+)*)$"
TABLE_LINE = r"(?i)^(Table)\s+([A-Za-z]?\d+(?:[-.]\d+)*)"
TABLE_REFERENCE = r"(?i)(Table\s+[A-Za-z]?\d+(?:[-.]\d+)*)"
SECTION_REFERENCE = r"(?i)(Section\s+\d+(?:\.\d+)*)"
FIGURE_REFERENCE = r"(?i)\b(?:Figure|Fig\.?)\s+[A-Za-z]?\d+(?:\.\d+)*"
NOTE_LINE = r"(?i)^(NOTE|WARNING|CAUTION|IMPORTANT|ASSUMPTION)\b"
CONTENTS_LINE = r"\.{3,}\s*\d+$"

# Wording that states a requirement, a feature, a behaviour, a condition.
REQUIREMENT_PHRASES = [
    "shall not", "shall", "must not", "must", "should not", "should", "cannot", "can not", "may not",
    "must have", "must not have", "must be", "must not be", "must issue", "must not issue", "must complete", "must not complete",
    "must be consistent", "must not cross", "must be able to", "must be given",
    "is required to", "are required to", "required to", "requires that",
    "is prohibited", "are prohibited", "prohibited to", "is not allowed to", "are not allowed to", "not allowed to",
    "is allowed to", "are allowed to", "allowed to", "is not permitted to", "are not permitted to", "not permitted to",
    "is permitted to", "are permitted to", "permitted to",
    "must remain", "shall remain", "must be held", "must be stable", "shall be stable", "remain stable",
    "shall be asserted", "must be asserted", "shall be deasserted", "must be deasserted",
    "is valid only when", "are valid only when", "is only valid", "are only valid", "occurs only when", "is not valid", "are not valid",
    "can only be", "may only be", "is not supported", "are not supported", "is optional", "are optional", "it is recommended to",
    "length can be", "can discard", "can omit", "can be lower than", "can be higher than", "can be up to", "may be up to",
    "can range from", "may range from", "can be asserted", "can be deasserted", "may be asserted", "may be deasserted", "can be sent",
]
FEATURE_PHRASES = ["to transfer", "permits", "supports", "control", "can either", "can pass", "requires that"]
STATES = "set cleared asserted deasserted updated written read returned terminated handled ignored reserved preserved discarded completed accepted rejected generated".split()
ACTIONS = "resumes? terminates? asserts? deasserts? updates? returns? generates? produces? accepts? rejects? completes? discards?".split()
CONDITION_VERBS = "asserts? deasserts? uses? transfers? accepts? rejects? generates? returns? occurs? completes? indicates? encodes? enables? disables? gives? receives?".split()
LEAD_INS = ["In Figure", "As shown in Figure", "The figure shows", "This assertion indicates", "In this case", "For example"]
DESCRIPTIVE_PHRASES = ["this section describes", "this chapter describes", "this document describes", "provides information", "is shown in", "is illustrated in", "for example", "the following example", "the purpose of"]

REQUIREMENT = r"(?i)\b(" + "|".join(REQUIREMENT_PHRASES) + r")\b"
FEATURE = r"(?i)\b(" + "|".join(FEATURE_PHRASES) + r")\b"
DECLARATIVE = r"(?i)\b(?:causes?\s+(?:an?\s+|the\s+)?[A-Za-z0-9_-]+\s+to|(?:is|are)\s+(?:" + "|".join(STATES) + r")|(?:" + "|".join(STATES) + r")\b|(?:" + "|".join(ACTIONS) + r")\s+|can\s+be\s+either\s+[A-Za-z0-9_-]+\s+or\s+[A-Za-z0-9_-]+)"
CONDITIONAL = r"(?i)\b(?:when|if)\b.+\b(?:" + "|".join(CONDITION_VERBS) + r")\b"
LEAD_IN = r"(?i)^(?:" + "|".join(LEAD_INS) + r")\b"
ENCODING_ROW = r"(?s)(0b[01]+)\s+([A-Za-z][A-Za-z0-9_-]*)\s+(.*?)(?=\s+0b[01]+\s+[A-Za-z][A-Za-z0-9_-]*\s+|\s+(?:\d+(?:\.\d+)*|[A-C]\d+(?:\.\d+)*)\s+|\s+Table\s+[A-Za-z]?\d+|$)"
DESCRIPTION_COLUMNS = "description meaning behavior behaviour function definition operation effect".split()

# Sentences that state nothing testable: removed from the beginning, or dropped as a whole.
PAGE_FURNITURE = [r"(?i)Figure\s+[A-Za-z]?\d+(?:\.\d+)*:\s*[^\n.]*", r"(?i)Table\s+[A-Za-z]?\d+(?:\.\d+)*:\s*[^\n.]*", r"(?:\b\d+\s+){3,}(?:[A-Z][A-Z0-9_-]*(?:\s+|$)){2,}"]
SENTENCE_HEADS = [r"^[A-Z][A-Za-z0-9\- ]{2,80}\s+[–-]\s+(?=(?:If|When|The|A|An|For|It)\b)", r"(?i)^(Name\s+Width\s+Default\s+Description\s+)+"]
SENTENCE_HEADS_LATER = [r"•\s*", r"(?i)^.*?The required behavior .*?:\s*", r"^[A-Z0-9_, ]+\s+\d+\s+0x[0-9A-Fa-f]+\s+"]
PRESENCE_SENTENCE = r"(?i)^[A-Z0-9_, ]+\s+(?:are|is)\s+(?:present|not present)\.?$"
SKIPPED_SENTENCES = [
    r":$", r"^(?:Name|Width|Default|Description)(?:\s+\w+){2,}$", r"^.*This section describes .*$", r"^[A-C]\d+(?:\.\d+)*\s+", r"^\[\d+\]\s+", r"^Table ", r"^In this specification",
    r"(?i)can either:$", r"^[A-Z][A-Za-z ]+\s+[A-C]\d+(?:\.\d+)*\.?$", r"^Chapter\s+[A-Z]\d+\.?$", r"^ARM IHI", r"Copyright", r"^All rights reserved\.$", r"^Non-confidential\s+\d+$", r"^See ", r"(?i)^however,",
]
PARENT_START = r"(?i)\b(Must|Must not|Shall|Should|Cannot|Can|May|If|When|The)\b"
ACRONYM_STOPLIST = "THE AND FOR WITH FROM THIS THAT ARE NOT BUT ITS ALL ANY CAN HAS HAVE BEEN WILL MAY SHALL MUST WHEN THEN EACH SUCH BOTH ALSO INTO OVER UPON USED ONLY MORE THAN WHICH THERE THEIR THESE THOSE WHAT PAGE NOTE TYPE DATA BASE TRUE FALSE".split()

# Quality checks: keys of a whole document, categories in their order, and structural tokens.
REQUIRED_KEYS = "document_name metadata total_pages sections requirements figures tables notes acronyms cross_references semantic_chunks pages".split()
CATEGORY_KEYWORDS = {
    "Performance": ["latency", "throughput", "timing", "frequency", "bandwidth", "clock rate", "cycles per", "ipc", "mhz", "ghz", "performance"],
    "Electrical": ["voltage", "current", "power", "vdd", "vcc", "vref", "amperage", "watt", "dissipation", "impedance"],
    "Environmental": ["temperature", "humidity", "thermal", "esd", "altitude", "vibration"],
    "Safety": ["safety", "hazard", "fault", "asil", "functional safety", "redundant", "ecc", "parity", "error correction", "watchdog"],
    "Security": ["encryption", "authentication", "secure boot", "pmp", "tee", "cryptograph", "attestation", "tamper"],
    "Protocol": ["axi", "amba", "ahb", "apb", "ace", "chi", "tilelink", "burst", "handshake", "arvalid", "awvalid", "wready", "bvalid", "arbiter", "master", "slave", "manager", "subordinate", "outstanding transaction", "beat", "strobe"],
    "Memory": ["cache", "tlb", "mmu", "dram", "sram", "memory-mapped", "memory map", "address space", "page table", "coherenc", "physical address", "virtual address"],
    "Architecture": ["instruction", "opcode", "register", "risc-v", "riscv", "isa", "extension", "privilege mode", "csr", "trap", "exception", "interrupt", "pipeline", "hart", "atomic", "vector unit"],
    "Interface": ["interface", "pin", "signal", "spi", "uart", "i2c", "can", "gpio", "jtag", "pcie"],
}
CATEGORY_PRIORITY = ["Protocol", "Architecture", "Memory", "Security", "Safety", "Electrical", "Performance", "Environmental", "Interface"]
#: Type of a requirement by keywords, the first that occurs.
TYPE_KEYWORDS = {
    "Performance": ["latency", "throughput", "timing", "frequency", "bandwidth"], "Electrical": ["voltage", "current", "power"],
    "Environmental": ["temperature", "humidity"], "Safety": ["safety", "hazard", "fault"], "Interface": ["interface", "spi", "uart", "i2c", "can"],
}
BUS_SIGNAL = r"(?i)(\b[AR][RW](?:VALID|READY|LEN|SIZE|BURST|ID|ADDR|LOCK|CACHE|PROT|QOS|REGION)\b|\b[RWB](?:VALID|READY|DATA|LAST|STRB|RESP|ID)\b)"
CONTROL_REGISTER = r"(?i)\b(mstatus|mtvec|mepc|mcause|mtval|mie|mip|mscratch|mideleg|medeleg|satp|sstatus|stvec|sepc|scause|stval|sie|sip|sscratch|pmpcfg\d*|pmpaddr\d*|misa|mhartid|RV(?:32|64|128)[IEMAFDQC]*)\b"
QUALITY_SECTION_ID = r"(?i)^[A-Z]?\d+(?:[.-]\d+)*$"
QUALITY_TABLE_REFERENCE = r"(?i)\bTable\s+([A-Z]?\d+(?:[.-]\d+)*)\b"
QUALITY_SECTION_REFERENCE = r"(?i)\bSection\s+([A-Z]?\d+(?:[.-]\d+)*)\b"
QUALITY_REQUIREMENT = r"(?i)\b(?:shall|must|required\s+to|may\s+not|is\s+prohibited)\b"
QUALITY_FIGURE_CAPTION = r"(?i)^\b(?:Figure|Fig\.?)\s+([A-Za-z]?\d+(?:[-.]\d+)*)"
QUALITY_TABLE_CAPTION = r"(?i)^(?:Table)\s+([A-Za-z]?\d+(?:[-.]\d+)*)"
CROSS_REFERENCE = r"(?i)^(Section|Table|Figure)\s+([A-Za-z]?\d+(?:[-.]\d+)*)$"

# Technical tokens that no normalising may touch, and what a version report is laid out in.
TECHNICAL_TOKEN = r"\b(0[xX][0-9A-Fa-f]+|RV(?:32|64|128)[A-Za-z0-9_]*|[A-Za-z][A-Za-z0-9]*(?:\.[A-Za-z0-9]+)+|[a-z][a-z0-9]{2,}(?:status|cause|tval|tvec|epc|scratch|ie|ip|atp|cfg\d*|addr\d*))\b"
REPORT_LAYOUT = [
    ("Critical Changes", "Requirement changes", "requirement_changes"), ("Critical Changes", "Numeric changes", "numeric_changes"), ("Critical Changes", "Requirement strength changes", "requirement_strength_changes"),
    ("Content Changes", "Modified tables", "modified_tables"), ("Content Changes", "Modified figures", "modified_figures"), ("Content Changes", "Modified notes", "modified_notes"),
    ("Structural Changes", "Sections added", "sections_added"), ("Structural Changes", "Sections removed", "sections_removed"), ("Structural Changes", "Pages added", "pages_added"), ("Structural Changes", "Pages removed", "pages_removed"),
    ("Relocations", "Moved tables", "moved_tables"), ("Relocations", "Moved notes", "moved_notes"), ("Relocations", "Moved figures", "moved_figures"), ("Relocations", "Page shifts", "page_shifts"),
    ("Metadata", "Title", "metadata_title"), ("Metadata", "Version", "metadata_version"), ("Metadata", "Revision", "metadata_revision"),
]
