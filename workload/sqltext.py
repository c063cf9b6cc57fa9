"""SQL expressions of the expected results, for the check with another engine."""

from __future__ import annotations

from venuesift import contracts as C
from workload import templates as TPL

NL = "chr(10)"
# White space that occurs in the tables and templates.
_WS = r"[ \t\n\r\f\x{b}\x{1c}-\x{1f}\x{85}\x{a0}]"
_LINE_WS = r"[ \t\r\f\x{b}\x{1c}-\x{1f}\x{85}\x{a0}]"
_ENTITIES = {
    "nbsp": "chr(160)", "lt": "'<'", "gt": "'>'", "quot": "'\"'", "copy": "'©'",
    "middot": "'·'", "egrave": "'è'", "ucirc": "'û'", "eacute": "'é'",
    "#8211": "'–'", "amp": "'&'",
}
_NO_SEMICOLON = ("lt", "gt", "quot", "copy", "middot", "amp")


def quote(text: str | None) -> str:
    if text is None:
        return "NULL"
    return "'" + text.replace("'", "''") + "'"


def pick(texts: list[str | None], key: str) -> str:
    return f"([{', '.join(map(quote, texts))}])[({key}) % {len(texts)} + 1]"


def fill(text: str, key: str, name: str) -> str:
    return f"replace(replace({text}, '{{k}}', CAST({key} AS VARCHAR)), '{{n}}', {name})"


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {quote(pattern)}, {to}, 'g')"


def strip(x: str) -> str:
    return sub(x, rf"\A{_WS}+|{_WS}+\z", "''")


def normalise(x: str) -> str:
    x = sub(x, r"\r\n?", NL)
    x = sub(x, r"[ \t]+", "' '")
    x = sub(x, rf"(?m)^{_LINE_WS}+|{_LINE_WS}+$", "''")
    x = sub(x, r"\n{3,}", f"{NL} || {NL}")
    return strip(x)


def strip_boilerplate(x: str) -> str:
    x = sub(x, "<[^>]+>", "' '")
    for name, char in _ENTITIES.items():
        x = sub(x, f"&{name};?" if name in _NO_SEMICOLON else f"&{name};", char)
    x = f"replace({x}, chr(160), ' ')"
    x = sub(x, r"(?im)^\s*(?:MENU|OUR MENU|Navigation|Skip to content)\s*$", "''")
    return sub(x, r"(?m)^\s*[-=*_]{3,}\s*$", "''")


def clean(x: str) -> str:
    return normalise(strip_boilerplate(x))


def snippet_key(x: str) -> str:
    return sub(f"lower({strip(x)})", f"{_WS}+", "' '")


def first_sentence(x: str) -> str:
    return (
        f"CASE WHEN regexp_matches({x}, '[^.!?]') "
        f"THEN {strip(f'''regexp_extract({x}, '[^.!?]+[.!?]?')''')} "
        f"ELSE {strip(f'substr({x}, 1, 120)')} END"
    )


def cut(x: str) -> str:
    x = f"split_part({x}, {quote(chr(10) * 2 + 'Return JSON')}, 1)"
    x = f"split_part({x}, {quote(chr(10) + 'Return JSON')}, 1)"
    return strip(x)


def any_of(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {quote(w)})" for w in words) + ")"


def json_list(x: str) -> str:
    return (
        f"'[' || array_to_string(list_transform({x}, lambda e: "
        f"coalesce(CAST(to_json(e) AS VARCHAR), 'null')), ', ') || ']'"
    )


def classify_ctes(source: str, text: str, prefix: str = "cls") -> str:
    """CTEs that add rule, label, confidence, quotes (a list) and reasoning to ``source``."""
    a, b, c, d = (f"{prefix}{n}" for n in range(1, 5))
    return f"""
    {a} AS (SELECT *, {cut(text)} AS ev_ FROM {source}),
    {b} AS (SELECT *, lower(ev_) AS low_ FROM {a}),
    {c} AS (SELECT *, CASE
        WHEN contains({text}, {quote(C.REPAIR_SENTENCE)}) THEN 0
        WHEN {any_of('low_', C.DENIAL_PHRASES)}
             AND {any_of('low_', C.DENIED_PLACE_HINTS)} AND contains(low_, {quote(C.DENIAL_EXCEPTION)}) THEN 1
        WHEN {any_of('low_', C.EXPLICIT_NO_PHRASES)} OR ({any_of('low_', C.INDOOR_HINTS)} AND NOT {any_of('low_', C.OUTDOOR_HINTS)}) THEN 2
        WHEN {any_of('low_', C.OUTDOOR_HINTS)} AND NOT {any_of('low_', C.INDOOR_HINTS)} THEN 3
        WHEN contains(low_, {quote(C.CONDITIONAL_HINT)}) THEN 4
        ELSE 5 END AS rule_ FROM {b}),
    {prefix} AS (SELECT * EXCLUDE (ev_, low_, rule_),
        CASE rule_ WHEN 2 THEN 'no' WHEN 3 THEN 'yes' ELSE 'unknown' END AS label,
        CAST(([0.5, 0.45, 0.91, 0.92, 0.55, 0.35])[rule_ + 1] AS DOUBLE) AS confidence,
        CASE WHEN rule_ IN (2, 3) AND {first_sentence('ev_')} <> ''
             THEN [{first_sentence('ev_')}] ELSE CAST([] AS VARCHAR[]) END AS quotes,
        CASE WHEN rule_ = 0 THEN 'Dry-run repair fallback returned unknown.'
             ELSE 'Dry-run heuristic classified the evidence as '''
                  || CASE rule_ WHEN 2 THEN 'no' WHEN 3 THEN 'yes' ELSE 'unknown' END || '''.'
             END AS reasoning
        FROM {c})"""


def sentence(key: str) -> str:
    return pick(TPL.SENTENCES, key)
