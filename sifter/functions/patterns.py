"""Regular expressions and word lists, once for each engine that has to agree on them.

``WS`` is the white space that scripts trim (NBSP, BOM and line separators included); ``{L}`` and ``{R}`` are ASCII word
boundaries: lookarounds for the JVM, whose own boundary is Unicode-aware, and a plain boundary for RE2, which has no
lookarounds and whose boundary is ASCII.
"""

from __future__ import annotations

WS = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_JVM = {"L": r"(?<![A-Za-z0-9_])", "R": r"(?![A-Za-z0-9_])", "W": f"[{WS}]", "N": f"[^{WS}]", "C": WS}
_RE2 = {"L": r"\b", "R": r"\b", "W": f"[{WS}]", "N": f"[^{WS}]", "C": WS}


def _fill(pattern: str, values: dict[str, str]) -> str:
    for k, v in values.items():
        pattern = pattern.replace("{%s}" % k, v)
    return pattern


def jvm(pattern: str) -> str:
    return _fill(pattern, _JVM)


def re2(pattern: str) -> str:
    return _fill(pattern, _RE2)


# These must equal the rules whose results are reproduced.
ANSI = r"\x1b\[[0-9;?]*[ -/]*[@-~]|\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)|\x1b[@-_]"
INLINE_SPACE = r"[\t\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
CJK_MARKERS = (
    "[，。、；：！？]", "的", "是", "和", "与", "或", "了", "在", "有", "不", "这", "那", "也", "都", "就", "还", "又", "被", "把", "给",
    "因为", "所以", "虽然", "但是", "因此", "如果", "可以", "需要", "应该",
)
ENGLISH_MARKERS = (
    "the", "an", "is", "are", "was", "were", "been", "being", "has", "have", "had", "would", "could", "should", "might", "must",
    "because", "although", "however", "therefore", "very", "more", "most", "some", "any", "each", "every", "both", "also", "only", "just", "really",
)
#: The same markers, looked for behind one test of the character: all of them are of East Asian blocks, and few characters are.
STRONG_PROSE = r"(?=[\x{2E80}-\x{FFFF}])(?:" + "|".join(CJK_MARKERS) + ")"
STRONG_PROSE_RE2 = "|".join(CJK_MARKERS)
PROSE = STRONG_PROSE + "|{L}(?=[a-z])(?:" + "|".join(ENGLISH_MARKERS) + ")(?:{R})" + r"|[.!?]{W}+"
PROSE_RE2 = STRONG_PROSE_RE2 + "|{L}(?:" + "|".join(ENGLISH_MARKERS) + ")(?:{R})" + r"|\.{W}+|!{W}+|\?{W}+"
TAG = r"</?[a-zA-Z][a-zA-Z0-9]*(?:{W}[^>]*)?/?>"
TAG_START = r"</?[a-zA-Z]"
SYMBOLS = r"[{};]"
#: What a line that isn't blank and isn't a list, quotation or numbered line looks like.
PLAIN_LINE = r"^{W}*+(?!(?:[-*+](?:{W}|[^-*+{C}])|>{W}?|[0-9]+[.)]{W})){N}"
LIST_LINE = r"^(?:[-*+](?:{W}|[^-*+{C}])|>{W}?|[0-9]+[.)]{W})"
CONTROL_CLASSIFIER = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
CONTROL_DIGEST = r"[\x00-\x08\x0E-\x1F]"

#: Signal lines: (kind, pattern), in order; the first that is found decides.
MARKUP_LINE = r"^{W}*<[A-Za-z0-9_](?:{W}|[/>])"
SIGNALS = (
    ("err", r"(?i)^{W}*\*?{W}*(?:[A-Za-z0-9_]*Error|Exception|Traceback|Panic|FATAL|CRIT(?:ICAL)?|EMERG|SEGFAULT|ABORT|ASSERTION){R}"),
    ("fail", r"(?i)^{W}*(?:[A-Za-z0-9_]+{W})?\]?{W}*(?:FAIL(?:ED|URES?)?|ERROR|ERR|WARNING?S?|WARN(?:ING)?)(?:{R})!?"),
    ("fail", r"^{W}*[✗✘⚠]"),
    ("fail", r"(?i)^not ok{R}"),
    ("stack", r"^{W}*at{W}+{N}"),
    ("stack", r"^Caused by"),
    ("stack", r"^{W}*#[0-9]+{W}"),
    ("err", r"(?i)^{N}+:[0-9]+:[0-9]+:{W}*(?:error|warning|note){R}"),
    ("summary", r"(?i)^{W}*[0-9]+{W}*(?:passed|failed|tests?|cases?|suites?|skipped){R}"),
    ("summary", r"(?i)^Tests?{W}*:{W}*[0-9]"),
    ("summary", r"(?i)^Tests?{W}+[0-9]+{W}*(?:failed|passed|skipped)"),
    ("summary", r"(?i)^{W}*[0-9]+{W}*(?:failing|passing){R}"),
)
LOG_PREFIX = r"^{W}*[0-9]{2,4}[-/][0-9]{2}(?:[-/][0-9]{2,4})?(?:{W}|T)[0-9]{2}:[0-9]{2}"
LOG_LEVEL = r"(?i){L}(?:ERROR|ERR|FATAL|PANIC|CRIT(?:ICAL)?|EMERG|WARN(?:ING)?|FAIL(?:ED|URES?)?){R}"
LOG_LETTER = r"(?:^|{W}|\|)[EWF](?:{W}|\||$)"
LOG_ERROR = r"(?i){L}(?:FATAL|PANIC|CRIT|EMERG|SEGFAULT|ABORT|ERROR|ERR|EXCEPTION|ASSERTION){R}"
LOG_ERROR_LETTER = r"(?:^|{W}|\|)E(?:{W}|\||$)"
LOG_WARNING = r"(?i){L}WARN(?:ING)?{R}"
LOG_WARNING_LETTER = r"(?:^|{W}|\|)W(?:{W}|\||$)"

STRUCTURED_EXTENSIONS = (
    "js", "ts", "jsx", "tsx", "cjs", "mjs", "cts", "mts", "py", "rb", "go", "rs", "java", "c", "cpp", "cc", "h", "hpp", "cs", "swift", "kt", "kts",
    "scala", "lua", "php", "pl", "sh", "bash", "zsh", "css", "scss", "less", "html", "htm", "xml", "ejs", "jst", "hbs", "vue", "svelte", "astro",
    "json", "yaml", "yml", "toml", "ini", "conf", "properties", "env", "csv", "tsv", "map", "wasm", "lock", "log", "gz", "gzip", "zip", "tar", "tmp",
    "temp", "cache", "bak", "bin", "dat", "db", "sqlite", "node", "pack", "idx", "snap", "def", "png", "jpg", "jpeg", "gif", "ico", "webp", "mp4",
    "svg", "woff", "woff2", "ttf", "otf", "eot",
)
AMBIGUOUS_EXTENSIONS = ("txt", "md", "markdown", "mdown", "mdwn", "rst", "tex", "org", "adoc", "asciidoc", "pug", "jade", "styl", "text")
FILTER_KEYWORDS = (
    "log", "logs", "kernel_log", "radio_log", "main_log", "sys_log", "events_log", "crash_log", "scp_log", "adsp", "atf", "cpuinfo", "diskinfo",
    "meminfo", "bootprof", "last_kmsg", "pl_lk", "bootup", "current_log",
)
DECISION_KEYWORDS = (
    "log", "logs", "info", "stat", "stats", "conf", "config", "prop", "properties", "history", "tree", "ver", "version", "cache", "dump", "trace",
    "prof", "mem", "cpu", "disk", "boot", "kernel", "radio", "event", "crash",
)
LANGUAGES = {
    "ts": "typescript", "cts": "typescript", "mts": "typescript", "tsx": "tsx",
    "js": "javascript", "jsx": "javascript", "cjs": "javascript", "mjs": "javascript",
}
IMPORT_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".cts", ".mts", ".cjs", ".mjs")
SIGNAL_TOOLS = ("Bash", "Read", "Grep", "Glob")
HOOK_TOOLS = ("Bash", "Read")

HOOK_MIN, PIPELINE_MIN, STRIP_MIN = 2048, 512, 256
SNIP_HEAD, SNIP_TAIL, SNIP_MIN_LINES = 30, 30, 120
DIGEST_MIN_LINES, DIGEST_MAX_SIGNALS, DIGEST_DENSITY, SYMBOL_RATIO, MAX_TAGS = 40, 50, 0.35, 0.008, 30
CHUNK_LINES, MAX_FULL_TEXT, MAX_DEPTH = 20, 60000, 3
