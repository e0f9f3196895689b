"""String expressions (Column -> Column), all JVM-side regex / string functions.

Java regex needs ``(?U)`` for Python's Unicode ``\\s``/``\\S``/``\\d`` semantics
(Python ``str.split()`` / ``str.strip()`` treat e.g. NBSP as whitespace).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- whitespace

# The characters Python's str.strip() / str.split() treat as whitespace.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# End of fixed values.


# Java regex classes of exactly that set: Java's Unicode \s plus \x1c-\x1f
# (checked over the whole BMP against str.isspace(); far faster than listing
# the 29 characters one by one).
WS = r"(?U)[\s\x1c-\x1f]"
NON_WS = r"(?U)[^\s\x1c-\x1f]"


def py_strip(c) -> Column:
    """Python ``str.strip()``: Unicode whitespace on both ends (``trim`` only
    removes ASCII spaces); a character-set trim, no regex."""
    return F.btrim(_c(c), F.lit(PY_WHITESPACE))


def word_count(c) -> Column:
    """``len(s.split())``: the number of runs of non-whitespace (one regex
    pass, no token array). Null stays null."""
    return F.regexp_count(_c(c), F.lit(NON_WS + "+"))


def space_token_count(c) -> Column:
    """``len(s.split(" "))``: tokens by a single space, empty tokens counted
    (``''`` -> 1, ``'a  b '`` -> 4). Null stays null."""
    return F.size(F.split(_c(c), " ", -1))


# ---------------------------------------------------------------- ids, titles

def normalize_imdb_id(c) -> Column:
    """Strip leading ``t``s, zero-fill to 7 digits, prefix ``tt``. Longer ids
    are kept whole (``lpad`` alone would truncate them)."""
    x = F.regexp_replace(_c(c).cast("string"), r"^t+", "")
    return F.concat(F.lit("tt"), F.when(F.length(x) < 7, F.lpad(x, 7, "0")).otherwise(x))


_TITLE_YEAR = r"(?Ud)^(.+?)[\s\x1c-\x1f]*\((\d{4})\)[\s\x1c-\x1f]*$"


def title_name(c) -> Column:
    """Name part of ``Name (YYYY)``; the whole (stripped) title when no year."""
    c = _c(c)
    return F.when(c.rlike(_TITLE_YEAR), py_strip(F.regexp_extract(c, _TITLE_YEAR, 1))).otherwise(py_strip(c))


def title_year(c) -> Column:
    """Year of ``Name (YYYY)`` as int, null when absent. ``regexp_extract``
    yields ``''`` on no match, which must not reach an ANSI cast."""
    return F.nullif(F.regexp_extract(_c(c), _TITLE_YEAR, 2), F.lit("")).try_cast("int")


# ---------------------------------------------------------------- wikitext

# Section headings that hold a plot; patterns of references.
PLOT_HEADINGS = ("plot", "plot summary", "synopsis")
REF_PAIR = r"(?s)<ref[^>]*>.*?</ref>"
REF_SINGLE = r"<ref[^/]*/\s*>"
# End of fixed values.

_COMMENT = r"(?:<!--[^\n]*?-->[ \t]*)*"
_PLOT_SECTION = (
    r"(?imsd)^==[ \t]*(?:" + "|".join(PLOT_HEADINGS) + r")[ \t]*==[ \t]*" + _COMMENT + r"\r?$\n?(.*?)(?=^={1,2}[^=\n]|\z)"
)
# a line whose stripped text starts with "==" (Unix lines: only \n ends a line)
_HEADING_LINE = r"(?dmU)^[\s\x1c-\x1f&&[^\n]]*==[^\n]*\n?"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_OPEN, _CLOSE, _ESCAPE = "\1", "\2", "\3"  # stand for the tokens while pairs are rewritten


def _nesting(x: Column) -> Column:
    """How deep matched pairs of ``x`` nest (unmatched tokens do not count): one fold
    over the tokens with the height reached in each open one."""
    tokens = F.regexp_extract_all(x, F.lit(f"[{_OPEN}{_CLOSE}]"), F.lit(0))
    start = F.struct(F.array().cast("array<int>").alias("open"), F.lit(0).alias("most"))

    def step(a: Column, t: Column) -> Column:
        height = F.element_at(a["open"], -1) + 1
        rest = F.slice(a["open"], F.lit(1), F.size(a["open"]) - 1)
        raised = F.concat(F.slice(rest, F.lit(1), F.greatest(F.size(rest) - 1, F.lit(0))), F.array(F.greatest(F.element_at(rest, -1), height)))
        closed = F.struct(F.when(F.size(a["open"]) > 1, raised).otherwise(rest).alias("open"), F.greatest(a["most"], height).alias("most"))
        opened = F.struct(F.array_append(a["open"], F.lit(0)).alias("open"), a["most"].alias("most"))
        return F.when(t == _OPEN, opened).when(F.size(a["open"]) > 0, closed).otherwise(a)

    return F.aggregate(tokens, start, step, lambda a: a["most"])


def _swap(x: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def _fold_pairs(x: Column, opening: str, closing: str, passes: list[tuple[str, str]]) -> Column:
    """Replace every matched ``opening ... closing`` pair of ``x``, at any depth; unmatched
    tokens stay. Tokens become single characters first. ``passes`` are the (pattern,
    replacement) steps that rewrite pairs without a pair inside; they run once for each
    level that the row has, from the inside out."""
    escape = [(_ESCAPE, _ESCAPE + "c"), (_OPEN, _ESCAPE + "a"), (_CLOSE, _ESCAPE + "b")]

    def run(v: Column) -> Column:
        def level(a: Column, _: Column) -> Column:
            for pattern, put in passes:
                a = F.regexp_replace(a, F.lit(pattern), F.lit(put))
            return a

        def levels(depth: Column) -> Column:
            return F.when(depth > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), v, level)).otherwise(v)

        return _let(_nesting(v), levels)

    marked = _swap(x, [*escape, (opening, _OPEN), (closing, _CLOSE)])
    folded = _swap(_let(marked, run), [(_OPEN, opening), (_CLOSE, closing), *[(new, old) for old, new in reversed(escape)]])
    return F.when((F.instr(x, opening) > 0) & (F.instr(x, closing) > 0), folded).otherwise(x)


_INNER = f"[^{_OPEN}{_CLOSE}]"
TEMPLATE_PASSES = [(f"{_OPEN}{_INNER}*+{_CLOSE}", "")]
# what a wikilink shows: all after the first bar, or the page if that is empty
LINK_PASSES = [(rf"{_OPEN}[^{_OPEN}{_CLOSE}|]*+\|({_INNER}++){_CLOSE}", "$1"), (rf"{_OPEN}([^{_OPEN}{_CLOSE}|]*+)\|?{_CLOSE}", "$1")]


def clean_wikitext(c) -> Column:
    """Markup to plain text: references, templates and wikilinks (display text,
    links in link texts too) at any depth, HTML tags and bold/italic quotes."""
    c = _c(c)
    x = F.regexp_replace(F.regexp_replace(c, REF_PAIR, ""), REF_SINGLE, "")
    x = _let(x, lambda v: _fold_pairs(v, "{{", "}}", TEMPLATE_PASSES))
    x = _let(x, lambda v: _fold_pairs(v, "[[", "]]", LINK_PASSES))
    x = F.regexp_replace(F.regexp_replace(x, r"<[^>]+>", ""), "'''?", "")
    # every pass needs one of these tokens: markup-free text skips the chain
    has_markup = (F.instr(c, "<") > 0) | (F.instr(c, "{{") > 0) | (F.instr(c, "[[") > 0) | (F.instr(c, "''") > 0)
    return F.when(has_markup, x).otherwise(c)


def plot_section(c) -> Column:
    """Body of the first level-2 section headed plot / plot summary / synopsis
    (case-insensitive), heading lines dropped, stripped, cleaned. An empty
    first plot section gives null; later sections are not tried."""
    c = _c(c)
    # one pass of the section regex: the whole match always holds the heading,
    # so an empty match means "no plot section"
    whole = F.regexp_extract(c, _PLOT_SECTION, 0)
    body = py_strip(F.regexp_replace(whole, _HEADING_LINE, ""))
    return F.when((F.length(whole) > 0) & (F.length(body) > 0), clean_wikitext(body))


def plot_from_api(c) -> Column:
    """Null / empty wikitext -> null, else :func:`plot_section`."""
    c = _c(c)
    return F.when(F.length(c) > 0, plot_section(c))


# ---------------------------------------------------------------- text prep

QUERY_PREFIX = "Represent this sentence for searching relevant passages: "  # fixed value


def media_type(genres) -> Column:
    g = _c(genres)
    return F.when(g.isNotNull() & g.contains("Animation"), F.lit("Animated Film")).otherwise(F.lit("Film"))


def prepend_metadata(plot, mtype, genres, year, title) -> Column:
    """``type[. genres][. year][. title]. plot``; empty genres/title skipped."""
    def _nz(c):
        c = _c(c)
        return F.when(F.length(c) > 0, c)

    prefix = F.concat_ws(". ", _c(mtype), _nz(genres), _c(year).cast("string"), _nz(title))
    return F.concat(prefix, F.lit(". "), _c(plot))


def text_key(c) -> Column:
    """MD5 hex of the UTF-8 text (cache key)."""
    return F.md5(_c(c))


# ---------------------------------------------------------------- intent

# Keyword dictionaries of the intent parser, in dictionary order.
MOOD_KEYWORDS = {
    "cozy": ["cozy", "warm", "comfort", "heartwarming", "feel-good", "feelgood"],
    "exciting": ["exciting", "thrilling", "intense", "edge of seat", "adrenaline"],
    "scary": ["scary", "horror", "frightening", "terrifying", "creepy", "spooky"],
    "funny": ["funny", "comedy", "hilarious", "laugh", "humorous", "witty"],
    "sad": ["sad", "emotional", "cry", "tearjerker", "melancholy", "bittersweet"],
    "romantic": ["romantic", "love", "romance", "love story", "passionate"],
    "thoughtful": ["thoughtful", "deep", "philosophical", "thought-provoking", "cerebral", "mind-bending"],
    "relaxing": ["relaxing", "chill", "calm", "peaceful", "soothing", "easy-going"],
}
GENRE_KEYWORDS = {
    "action": ["action", "fight", "martial arts", "battle"],
    "comedy": ["comedy", "funny", "sitcom"],
    "drama": ["drama", "dramatic"],
    "horror": ["horror", "zombie", "slasher"],
    "scifi": ["sci-fi", "science fiction", "space", "futuristic", "cyberpunk"],
    "fantasy": ["fantasy", "magic", "wizard", "dragon"],
    "thriller": ["thriller", "suspense", "mystery", "detective"],
    "romance": ["romance", "romantic", "love story"],
    "documentary": ["documentary", "true story", "real life"],
    "animation": ["animated", "animation", "cartoon", "anime", "pixar"],
}
ERA_KEYWORDS = {
    "classic": ["classic", "old", "golden age", "vintage"],
    "80s": ["80s", "1980s", "eighties"],
    "90s": ["90s", "1990s", "nineties"],
    "2000s": ["2000s", "early 2000s"],
    "2010s": ["2010s", "twenty-tens"],
    "recent": ["recent", "new", "latest", "modern", "contemporary"],
}
MAX_DURATION_WORDS = ["short", "quick", "under 90", "90 min"]
MIN_DURATION_WORDS = ["long", "epic", "over 2 hours"]
FAMILY_WORDS = ["family", "kids", "children", "family-friendly"]
MATURE_WORDS = ["mature", "adult", "r-rated", "graphic"]
MAX_DURATION, MIN_DURATION = 90, 120
# End of fixed values.


def _any_substring(lower_text: Column, words) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | (F.instr(lower_text, w) > 0)
    return cond


def match_categories(lower_text: Column, keyword_dict: dict) -> Column:
    """Ordered array of categories whose keywords occur as raw substrings."""
    return F.array_compact(
        F.array(*[F.when(_any_substring(lower_text, kws), F.lit(cat)) for cat, kws in keyword_dict.items()])
    )


def parse_intent(c) -> Column:
    """``struct<raw_text, mood, genre, era, constraints>``; absent constraint
    keys are null."""
    raw = _c(c)
    t = F.lower(raw)
    constraints = F.struct(
        F.when(_any_substring(t, MAX_DURATION_WORDS), F.lit(MAX_DURATION)).alias("max_duration"),
        F.when(_any_substring(t, MIN_DURATION_WORDS), F.lit(MIN_DURATION)).alias("min_duration"),
        F.when(_any_substring(t, FAMILY_WORDS), F.lit(True)).alias("family_friendly"),
        F.when(_any_substring(t, MATURE_WORDS), F.lit(True)).alias("mature_only"),
    )
    return F.struct(
        raw.alias("raw_text"),
        match_categories(t, MOOD_KEYWORDS).alias("mood"),
        match_categories(t, GENRE_KEYWORDS).alias("genre"),
        match_categories(t, ERA_KEYWORDS).alias("era"),
        constraints.alias("constraints"),
    )


def with_plot_section(df, src: str, out: str = "plot_text", *, from_api: bool = False):
    """DataFrame form of :func:`plot_section` (``from_api``: of
    :func:`plot_from_api`) that evaluates the section regex once per row: the
    matched text and the stripped body are separate projections, which Catalyst
    keeps apart because they are expensive and used several times."""
    s = F.col(src)
    d = df.withColumn("_whole", F.regexp_extract(s, _PLOT_SECTION, 0))
    # the match starts with the heading line: drop it by position, and run the
    # heading-line regex only on bodies that contain another "=="
    nl = F.instr("_whole", "\n")
    d = d.withColumn("_raw", F.when(nl > 0, F.expr("substr(_whole, instr(_whole, '\\n') + 1)")).otherwise(F.lit("")))
    d = d.withColumn("_body", py_strip(F.when(F.instr("_raw", "==") > 0, F.regexp_replace("_raw", _HEADING_LINE, ""))
                                       .otherwise(F.col("_raw"))))
    ok = (F.length("_whole") > 0) & (F.length("_body") > 0)
    if from_api:
        ok = ok & (F.length(s) > 0)
    return d.withColumn(out, F.when(ok, clean_wikitext(F.col("_body")))).drop("_whole", "_raw", "_body")
