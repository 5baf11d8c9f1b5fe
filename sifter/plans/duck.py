"""DuckDB expressions for the rules in sifter.functions, written for RE2 and DuckDB's own functions."""

from __future__ import annotations

from ..functions import patterns as P
from ..functions.patterns import re2


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def rx(pattern: str) -> str:
    return text(re2(pattern))


def lines(x: str) -> str:
    return f"string_split({x}, chr(10))"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {rx(pattern)}))"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {rx(pattern)})"


def trim(x: str) -> str:
    return f"regexp_replace({x}, {rx('^{W}+|{W}+$')}, '', 'g')"


def trim_start(x: str) -> str:
    return f"regexp_replace({x}, {rx('^{W}+')}, '')"


def blank(x: str) -> str:
    return f"(NOT regexp_matches({x}, {rx('{N}')}))"


def units(x: str) -> str:
    return f"(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def words(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(map(text, values)) + ")"


def strip_steps(x: str) -> tuple[str, str, str]:
    one = f"regexp_replace({x}, {rx(P.ANSI)}, '', 'g')"
    two = f"regexp_replace({one}, {rx(P.INLINE_SPACE)}, ' ', 'g')"
    return one, two, f"regexp_replace({two}, '(?m) +$', '', 'g')"


def strip_cte(source: str, keep: str, minimum: int = P.STRIP_MIN) -> str:
    """keep, text0, text1 (stripped) and method of a subquery with columns keep and text."""
    return f"""(SELECT {keep}, text AS text0, CASE WHEN {units('text')} < {minimum} THEN text ELSE s3 END AS text1,
      CASE WHEN {units('text')} < {minimum} OR length(text) = length(s3) AND length(text) = length(s1) AND length(s1) = length(s2) THEN 'format-strip:noop'
      ELSE 'format-strip:' || array_to_string(list_filter([CASE WHEN length(text) <> length(s1) THEN 'ansi' END, CASE WHEN length(s1) <> length(s2) THEN 'inline-ws' END, CASE WHEN length(s2) <> length(s3) THEN 'trailing-ws' END], lambda z: z IS NOT NULL), '+') END AS method
      FROM (SELECT *, regexp_replace(s2, '(?m) +$', '', 'g') AS s3 FROM (SELECT *, regexp_replace(s1, {rx(P.INLINE_SPACE)}, ' ', 'g') AS s2 FROM (SELECT *, regexp_replace(text, {rx(P.ANSI)}, '', 'g') AS s1 FROM {source}))))"""


def kind(x: str) -> str:
    whens = " ".join(f"WHEN {has(x, p)} THEN '{k}'" for k, p in P.SIGNALS)
    log = f"({has(x, P.LOG_PREFIX)} AND ({has(x, P.LOG_LEVEL)} OR {has(x, P.LOG_LETTER)}))"
    return f"""(CASE WHEN {has(x, P.MARKUP_LINE)} THEN NULL {whens} WHEN NOT {log} THEN NULL WHEN {has(x, P.LOG_ERROR)} OR {has(x, P.LOG_ERROR_LETTER)} THEN 'err'
      WHEN {has(x, P.LOG_WARNING)} OR {has(x, P.LOG_WARNING_LETTER)} THEN 'warn' ELSE 'fail' END)"""


def extension(path: str) -> str:
    return f"lower(regexp_extract({path}, '\\.([^./\\\\]*)$', 1))"


def file_name(path: str) -> str:
    return f"lower(regexp_extract({path}, '([^/\\\\]*)$', 1))"


def keywords(name: str, values: tuple[str, ...]) -> str:
    def test(w: str) -> str:
        at = f"instr({name}, '{w}')"
        left, right = f"substr({name}, {at} - 1, 1)", f"substr({name}, {at} + {len(w)}, 1)"
        return f"({at} > 0 AND ({at} = 1 OR NOT regexp_matches({left}, '[a-z0-9]')) AND NOT regexp_matches({right}, '[a-z0-9]'))"

    return "list_filter([" + ", ".join(f"CASE WHEN {test(w)} THEN '{w}' END" for w in values) + "], lambda z: z IS NOT NULL)"


def language(ext: str) -> str:
    return f"(CASE {ext} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.LANGUAGES.items()) + " END)"


def binary(x: str) -> str:
    head = f"substr({x}, 1, 2048)"
    return f"(contains({x}, chr(0)) OR {count(head, P.CONTROL_CLASSIFIER)} > 0.1 * length({head}))"


def binary_for_digest(x: str) -> str:
    head = f"substr({x}, 1, 20000)"
    # The running rule is tested at its first place only: control characters of the derived data stand at the front.
    front = f"substr({x}, 1, 2002)"
    return f"({count(head, P.CONTROL_DIGEST)} > 0.05 * length({head}) OR (length({x}) > 2001 AND {count(front, P.CONTROL_DIGEST)} > 0.05 * 2002))"


def symbol_ratio(x: str) -> str:
    return f"(CASE WHEN length({x}) > 0 THEN {count(x, P.SYMBOLS)} / {units(x)} ELSE 0 END)"


def prose_ratio(x: str) -> str:
    return f"({count(x, P.PROSE_RE2)} / greatest(1.0::DOUBLE, {units(x)} / 100))"


def tag_density(x: str) -> str:
    return f"({count(x, P.TAG)} / greatest(1.0::DOUBLE, {units(x)} / 100))"


def prose_run(x: str) -> str:
    marks = f"array_to_string(list_transform(list_filter({lines(x)}, lambda y: NOT {blank('y')}), lambda y: CASE WHEN {count('y', P.STRONG_PROSE_RE2)} >= 2 THEN '1' ELSE '0' END), '')"
    return f"coalesce(list_max(list_transform(regexp_extract_all({marks}, '1+'), lambda z: length(z))), 0)"


def plain_lines(x: str) -> str:
    return f"list_filter({lines(x)}, lambda y: NOT {blank('y')} AND NOT regexp_matches({trim_start('y')}, {rx(P.LIST_LINE)}))"


def line_structured(kept: str) -> str:
    return f"(len({kept}) > 5 AND 1 - len(list_distinct(list_transform({kept}[1:50], lambda y: substr(y, 1, 6)))) / len({kept}[1:50]) > 0.5)"


def classified(source: str) -> str:
    """The columns of ``source`` plus type, confidence and signals. json_valid takes [NaN] and [1,] as well, which no capture is."""
    tests = [
        ("is_json", "'json-valid'"), ("symbol_ratio > 0.008", "'strong-symbol'"), ("tags > 1", "'markup-tag'"), ("has_ansi", "'ansi'"), ("coalesce(repeated, false)", "'line-structured'"), ("ratio > 1.5", "'prose-heavy'"), ("run >= 3", "'prose-lines'"), (f"tool IN {words(P.SIGNAL_TOOLS)}", "'tool:' || tool"),
    ]
    names = "list_filter([" + ", ".join(f"CASE WHEN {t} THEN {n} END" for t, n in tests) + "], lambda z: z IS NOT NULL)"
    has_signal = lambda n: f"list_contains(names, '{n}')"
    score = " + ".join(f"CASE WHEN {has_signal(n)} THEN 1.5::DOUBLE ELSE 0 END" for n in ("strong-symbol", "markup-tag", "ansi", "line-structured"))
    score = f"CASE WHEN {has_signal('json-valid')} THEN 2.0::DOUBLE ELSE 0 END + {score}"
    body = trim("full_text")
    return f"""(SELECT * EXCLUDE (is_json, symbol_ratio, tags, has_ansi, repeated, ratio, run, ext, words, names, s, p, prose, is_binary, full_text, kept, by_ext, by_path),
      CASE WHEN length(full_text) = 0 THEN 'empty' WHEN is_binary THEN 'structured' WHEN by_path THEN 'structured' WHEN prose AND s >= 1.5 THEN 'mixed' WHEN prose THEN 'prose' WHEN s >= 1.5 THEN 'structured' ELSE 'prose' END AS type,
      CASE WHEN length(full_text) = 0 THEN 1.0::DOUBLE WHEN is_binary THEN 0.95::DOUBLE WHEN by_path THEN 0.9::DOUBLE WHEN prose AND s >= 2.5 THEN 0.7::DOUBLE WHEN prose AND s >= 1.5 THEN 0.6::DOUBLE
        WHEN prose AND p > 0 THEN least(1.0::DOUBLE, 0.6::DOUBLE + (p - 0.6::DOUBLE) * 0.2::DOUBLE) WHEN prose THEN 0.55::DOUBLE WHEN s >= 2 THEN least(1.0::DOUBLE, s / 3) WHEN s >= 1.5 THEN 0.5::DOUBLE ELSE 0.5::DOUBLE END AS confidence,
      CASE WHEN length(full_text) = 0 THEN ['empty'] WHEN is_binary THEN ['binary'] WHEN by_path THEN [CASE WHEN len(words) > 0 AND NOT by_ext THEN 'name:' || words[1] ELSE 'ext:' || ext END] ELSE names END AS signals
      FROM (SELECT *, {score} AS s, CASE WHEN ratio > 1.5 THEN 0.6::DOUBLE + (ratio - 1.5::DOUBLE) * 0.8::DOUBLE ELSE 0::DOUBLE END AS p, {has_signal('prose-heavy')} OR {has_signal('prose-lines')} AS prose, by_ext OR len(words) > 0 AS by_path
      FROM (SELECT *, {names} AS names, coalesce(ext IN {words(P.STRUCTURED_EXTENSIONS)}, false) AS by_ext
      FROM (SELECT *, {symbol_ratio('full_text')} AS symbol_ratio, {tag_density('full_text')} AS tags, {has('full_text', P.ANSI)} AS has_ansi, {line_structured('kept')} AS repeated, {prose_ratio('full_text')} AS ratio, {prose_run('full_text')} AS run, CASE WHEN regexp_matches({body}, '^[\\[{{]') AND json_valid({body}) THEN true ELSE false END AS is_json,
        {extension('path')} AS ext, coalesce({keywords(file_name('path'), P.FILTER_KEYWORDS)}, []) AS words, {binary('full_text')} AS is_binary FROM (SELECT *, {plain_lines('full_text')} AS kept FROM (SELECT *, coalesce(text, '') AS full_text FROM {source}))))))"""


def snip_parts(x: str) -> dict[str, str]:
    """SQL for the pieces of a snip of text x."""
    ls, n = lines(x), f"len({lines(x)})"
    middle = f"array_to_string(({ls})[31:{n} - 30], chr(10))"
    name = f"('snip-' || substr(sha256({middle}), 1, 12))"
    kept = f"array_to_string(({ls})[1:30], chr(10)) || chr(10) || chr(10) || '[' || ({n} - 60) || ' lines left out, kept as ' || {name} || ']' || chr(10) || chr(10) || array_to_string(({ls})[{n} - 29:{n}], chr(10))"
    return {"cut": f"({n} > 120)", "middle": middle, "name": name, "kept": kept, "total": n}


def digested(source: str, keep: str) -> str:
    """keep, text (input), d_text, d_method, signals, fails, warns, errors and gate of a subquery with columns keep and text."""
    mark = (
        "chr(10) || chr(10) || '[sifter: signals of ' || total || ' lines: ' || signals || ' (failures ' || fails || ', warnings ' || warns || ', errors ' || errors || ')' || CASE WHEN signals > 50 THEN '; ' || (signals - 50) || ' more signals not shown' ELSE '' END || "
        "'; ' || (total - least(signals, 50)) || ' lines left out, kept as ' || name || '. Ask retrieve(handle, query) for passages or retrieve(handle, start, count) for lines.]'"
    )
    n = lambda k: f"len(list_filter(found, lambda z: z.kind = '{k}'))"
    return f"""(SELECT {keep}, text, CASE WHEN done THEN full_text ELSE text END AS d_text, CASE WHEN done THEN 'structured-digest' ELSE 'structured-digest:noop' END AS d_method, signals, fails, warns, errors,
      CASE WHEN done THEN NULL ELSE coalesce(gate, 'size') END AS gate FROM (SELECT *, gate IS NULL AND {units('full_text')} < {units('text')} AS done FROM (SELECT *, array_to_string(list_transform(found[1:50], lambda z: '[L' || z.line || '] ' || z.text), chr(10)) || {mark} AS full_text
      FROM (SELECT *, CASE WHEN filled < 40 THEN 'lines' WHEN {binary_for_digest('text')} THEN 'binary' WHEN {symbol_ratio('text')} > 0.008 THEN 'symbols' WHEN {count('substr(text, 1, 100000)', P.TAG_START)} > 30 THEN 'markup' WHEN signals = 0 THEN 'signals' WHEN signals / greatest(filled, 1) > 0.35 THEN 'density' END AS gate
      FROM (SELECT *, len(found) AS signals, {n('fail')} AS fails, {n('warn')} AS warns, {n('err')} AS errors, 'digest-' || substr(sha256(text), 1, 12) AS name
      FROM (SELECT *, len({lines('text')}) AS total, len(list_filter({lines('text')}, lambda y: NOT {blank('y')})) AS filled,
        list_filter(list_transform({lines('text')}, lambda y, i: {{'line': i, 'kind': CASE WHEN NOT {blank('y')} THEN {kind('y')} END, 'text': y}}), lambda z: z.kind IS NOT NULL) AS found FROM {source}))))))"""
