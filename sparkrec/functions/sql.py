"""SQL surface: the scalar operators as session SQL functions.

``register_sql_functions(spark)`` creates temporary SQL functions whose bodies
are plain SQL expressions (no Python UDF), so SQL users get the same semantics
as the Column API: ``SELECT normalize_imdb_id(imdbId), title_year(title) ...``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..config import DEFAULT
from . import text as T
from .text import _TITLE_YEAR, NON_WS, PY_WHITESPACE


def _lit(s: str) -> str:
    s = s.replace("\\", "\\\\").replace("'", "\\'")
    return "'" + "".join(c if c >= " " or c in "\t\n\r" else f"\\u{ord(c):04x}" for c in s) + "'"


def _fold(opening: str, closing: str, passes: list[tuple[str, str]]) -> str:
    """Matched pairs of ``x`` rewritten level by level, as :func:`text._fold_pairs`."""
    escape = [(T._ESCAPE, T._ESCAPE + "c"), (T._OPEN, T._ESCAPE + "a"), (T._CLOSE, T._ESCAPE + "b")]

    def swap(x: str, pairs) -> str:
        for old, new in pairs:
            x = f"replace({x}, {_lit(old)}, {_lit(new)})"
        return x

    level = "a"
    for pattern, put in passes:
        level = f"regexp_replace({level}, {_lit(pattern)}, {_lit(put)})"
    marked = swap("x", [*escape, (opening, T._OPEN), (closing, T._CLOSE)])
    folded = f"aggregate(sequence(1, greatest(wiki_nesting({marked}), 1)), {marked}, (a, i) -> {level})"
    folded = swap(folded, [(T._OPEN, opening), (T._CLOSE, closing), *[(new, old) for old, new in reversed(escape)]])
    return f"CASE WHEN instr(x, {_lit(opening)}) > 0 AND instr(x, {_lit(closing)}) > 0 THEN {folded} ELSE x END"


def _any(words) -> str:
    return "(" + " OR ".join(f"instr(t, {_lit(w)}) > 0" for w in words) + ")"


def _categories(keywords: dict) -> str:
    return "array_compact(array(" + ", ".join(f"CASE WHEN {_any(ws)} THEN {_lit(c)} END" for c, ws in keywords.items()) + "))"


_TY = _TITLE_YEAR
_STRIP = "btrim({0}, " + _lit(PY_WHITESPACE) + ")"
_WC = "regexp_count({0}, " + _lit(NON_WS + "+") + ")"

FUNCTIONS = {
    "normalize_imdb_id": (
        "x STRING", "STRING",
        "concat('tt', CASE WHEN length(regexp_replace(x, '^t+', '')) < 7 "
        "THEN lpad(regexp_replace(x, '^t+', ''), 7, '0') ELSE regexp_replace(x, '^t+', '') END)",
    ),
    "title_year": ("x STRING", "INT", f"try_cast(nullif(regexp_extract(x, {_lit(_TY)}, 2), '') AS INT)"),
    "title_name": (
        "x STRING", "STRING",
        f"CASE WHEN x RLIKE {_lit(_TY)} THEN {_STRIP.replace('{0}', f'regexp_extract(x, {_lit(_TY)}, 1)')} "
        f"ELSE {_STRIP.replace('{0}', 'x')} END",
    ),
    "word_count": ("x STRING", "INT", _WC.replace("{0}", "x")),
    "space_token_count": ("x STRING", "INT", "size(split(x, ' ', -1))"),
    "compute_alpha": (
        "q STRING, has_profile BOOLEAN", "DOUBLE",
        "CASE WHEN q IS NULL THEN (CASE WHEN has_profile THEN " + f"{DEFAULT.home_feed_alpha}D" + " ELSE 0.0D END) ELSE "
        f"greatest({DEFAULT.alpha_min}D, least({DEFAULT.alpha_max}D, 1.0D / (1.0D + exp(-(0.3D * " + _WC.replace("{0}", "q") + " - 1.0D))))) END",
    ),
    "vec_dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE",
                "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v)"),
    # markup and plot sections; each may use those before it
    "wiki_nesting": (
        "v STRING", "INT",
        f"aggregate(regexp_extract_all(v, {_lit(f'[{T._OPEN}{T._CLOSE}]')}, 0), named_struct('open', CAST(array() AS ARRAY<INT>), 'most', 0), "
        f"(a, t) -> CASE WHEN t = {_lit(T._OPEN)} THEN named_struct('open', array_append(a.open, 0), 'most', a.most) WHEN size(a.open) > 0 THEN named_struct('open', "
        "CASE WHEN size(a.open) > 1 THEN concat(slice(a.open, 1, greatest(size(a.open) - 2, 0)), array(greatest(element_at(a.open, -2), element_at(a.open, -1) + 1))) "
        "ELSE slice(a.open, 1, 0) END, 'most', greatest(a.most, element_at(a.open, -1) + 1)) ELSE a END, a -> a.most)",
    ),
    "wiki_templates": ("x STRING", "STRING", _fold("{{", "}}", T.TEMPLATE_PASSES)),
    "wiki_links": ("x STRING", "STRING", _fold("[[", "]]", T.LINK_PASSES)),
    "clean_wikitext": (
        "x STRING", "STRING",
        f"regexp_replace(regexp_replace(wiki_links(wiki_templates(regexp_replace(regexp_replace(x, {_lit(T.REF_PAIR)}, ''), {_lit(T.REF_SINGLE)}, ''))), '<[^>]+>', ''), {_lit(chr(39) * 3 + '?')}, '')",
    ),
    "plot_body": (
        "x STRING", "STRING",
        _STRIP.replace("{0}", f"regexp_replace(regexp_extract(x, {_lit(T._PLOT_SECTION)}, 0), {_lit(T._HEADING_LINE)}, '')"),
    ),
    "plot_section": ("x STRING", "STRING", f"CASE WHEN length(regexp_extract(x, {_lit(T._PLOT_SECTION)}, 0)) > 0 AND length(plot_body(x)) > 0 THEN clean_wikitext(plot_body(x)) END"),
    "plot_from_api": ("x STRING", "STRING", "CASE WHEN length(x) > 0 THEN plot_section(x) END"),
    "response_wikitext": ("body STRING", "STRING", "from_json(body, 'parse struct<wikitext: struct<`*`: string>>').parse.wikitext.`*`"),
    "response_failure": (
        "status INT, body STRING, error_type STRING", "STRING",
        "CASE WHEN error_type IS NOT NULL THEN concat('network_error: ', error_type) WHEN status = 429 THEN 'max_retries' WHEN status <> 200 THEN concat('http_', status) "
        "WHEN from_json(body, 'parse struct<x: string>, error struct<code: string>') IS NULL OR (from_json(body, 'parse struct<x: string>, error struct<code: string>').error IS NULL "
        "AND from_json(body, 'parse struct<x: string>, error struct<code: string>').parse IS NULL) THEN 'unknown' "
        "WHEN from_json(body, 'parse struct<x: string>, error struct<code: string>').error IS NOT NULL THEN coalesce(from_json(body, 'error struct<code: string>').error.code, 'api_error') "
        "WHEN plot_from_api(coalesce(response_wikitext(body), '')) IS NULL THEN 'no_plot_section' END",
    ),
    # encoder text and intent
    "media_type": ("genres STRING", "STRING", "CASE WHEN genres IS NOT NULL AND contains(genres, 'Animation') THEN 'Animated Film' ELSE 'Film' END"),
    "prepend_metadata": (
        "plot STRING, mtype STRING, genres STRING, year INT, title STRING", "STRING",
        "concat(concat_ws('. ', mtype, CASE WHEN length(genres) > 0 THEN genres END, CAST(year AS STRING), CASE WHEN length(title) > 0 THEN title END), '. ', plot)",
    ),
    "intent_mood": ("t STRING", "ARRAY<STRING>", _categories(T.MOOD_KEYWORDS)),
    "intent_genre": ("t STRING", "ARRAY<STRING>", _categories(T.GENRE_KEYWORDS)),
    "intent_era": ("t STRING", "ARRAY<STRING>", _categories(T.ERA_KEYWORDS)),
    "intent_constraints": (
        "t STRING", "STRUCT<max_duration: INT, min_duration: INT, family_friendly: BOOLEAN, mature_only: BOOLEAN>",
        f"named_struct('max_duration', CASE WHEN {_any(T.MAX_DURATION_WORDS)} THEN {T.MAX_DURATION} END, 'min_duration', CASE WHEN {_any(T.MIN_DURATION_WORDS)} THEN {T.MIN_DURATION} END, "
        f"'family_friendly', CASE WHEN {_any(T.FAMILY_WORDS)} THEN true END, 'mature_only', CASE WHEN {_any(T.MATURE_WORDS)} THEN true END)",
    ),
    "parse_intent": (
        "x STRING", "STRUCT<raw_text: STRING, mood: ARRAY<STRING>, genre: ARRAY<STRING>, era: ARRAY<STRING>, constraints: STRUCT<max_duration: INT, min_duration: INT, family_friendly: BOOLEAN, mature_only: BOOLEAN>>",
        "named_struct('raw_text', x, 'mood', intent_mood(lower(x)), 'genre', intent_genre(lower(x)), 'era', intent_era(lower(x)), 'constraints', intent_constraints(lower(x)))",
    ),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    for name, (args, ret, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {ret} RETURN {body}")
    return list(FUNCTIONS)
