"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a labelled reference text recognises
every substring of that text. A document is parsed greedily into the longest
phrases that occur in the reference; a language whose reference explains the
document needs few phrases. With reference length ``n`` a phrase costs
``log2(n)`` bits (a pointer into the reference), so the normalised cost of a
language is ``phrases * log2(n)`` and the cheapest language wins. Each language
has its own length; one below ``LEAST_CHARS`` costs as much as that, or a sample
of a few words would be the cheapest for text of no language.

Greedy parsing needs no suffix links: a phrase is a walk from the root, and the
character that has no edge starts the next phrase at the root. That makes every
automaton one dense transition table in which a failed edge already points to
the restart state and carries the phrase count. Where that table would take more
than ``DENSE_BYTES``, it is a sorted list of the edges that there are instead, and a
failed edge is looked up in the language's row of restarts. Documents are cut at fixed
segment ends (a phrase does not span one), and all segments of an Arrow batch
step together in numpy, for all languages at once.

The references come from a bounded sample of labelled rows
(``buckets * rows_per_bucket`` rows a language, ``reference_chars`` characters a
language); prediction covers every whole text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrec.llm.common import ship_texts

UNDETERMINED = "und"
REFERENCE_CHARS, LEAST_CHARS = 40_000, 1_000  # of a reference: at most; least that counts in the cost
DENSE_BYTES = 64_000_000  # size up to which the table is dense; every Python worker holds one
SEGMENT = 2048  # code points after normalisation; a phrase ends at a segment's end
_STATE_BITS = 28
_STATE = (1 << _STATE_BITS) - 1
_OTHER, _GAP = 0, 1  # codes: letter outside the alphabet, run of non-letters


@dataclass(frozen=True)
class LangModel:
    langs: tuple  # learned labels, sorted
    alphabet: str  # letters with codes 2, 3, ...
    table: np.ndarray  # all automata, flat: (state * width + code) -> phrases << 28 | next state
    roots: np.ndarray  # root state of each language
    bits: np.ndarray  # cost of one phrase, log2(reference length)
    edges: np.ndarray | None = None  # sparse: state * width + code of each edge, sorted; ``table`` has their next states
    restarts: np.ndarray | None = None  # sparse: phrases << 28 | next state after a failed edge (languages x width)


def suffix_automaton(codes: list[int]) -> list[dict]:
    """Edges of the suffix automaton of a sequence (state 0 is the root)."""
    edges, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        cur = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = cur
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return edges


def _code_table(alphabet: str) -> np.ndarray:
    """Code of every Unicode code point, after lower-casing single letters."""
    out = np.full(0x110000, _GAP, dtype=np.uint16 if len(alphabet) < 60_000 else np.uint32)
    index = {ch: i + 2 for i, ch in enumerate(alphabet)}
    for cp in range(0x110000):
        ch = chr(cp)
        if ch.isalpha():
            low = ch.lower()
            out[cp] = index.get(low[0], _OTHER)
    return out


_TABLES: dict[str, np.ndarray] = {}


def encode(texts: list[str], alphabet: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts in one array and the start of each text in it.
    Every run of non-letters becomes one gap code."""
    if alphabet not in _TABLES:
        _TABLES[alphabet] = _code_table(alphabet)
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = _TABLES[alphabet][flat]
    first = np.zeros(len(codes) + 1, dtype=bool)
    starts = np.concatenate(([0], np.cumsum(lengths)))
    first[starts] = True
    gap = codes == _GAP
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    keep |= first[:-1]
    position = np.zeros(len(codes) + 1, dtype=np.int32)
    np.cumsum(keep, out=position[1:])
    return codes[keep], position[starts].astype(np.int64)


def _follow(model: LangModel, state: np.ndarray, code: np.ndarray) -> np.ndarray:
    """``phrases << 28 | next state`` for states (rows x languages) and a code a row, by the sorted edges."""
    key = state.astype(np.int64) * (len(model.alphabet) + 2) + code[:, None]
    at = np.minimum(np.searchsorted(model.edges, key), len(model.edges) - 1)
    failed = model.restarts[:, code].T
    # nothing is unfinished at the root: there a letter without an edge is one phrase
    failed = np.where(state == model.roots, 1 << _STATE_BITS | model.roots, failed)
    return np.where(model.edges[at] == key, model.table[at], failed).astype(np.int32)


def cross_parse(codes: np.ndarray, starts: np.ndarray, model: LangModel) -> np.ndarray:
    """Phrases of each text in each language (texts x languages)."""
    n, width, langs = len(starts) - 1, len(model.alphabet) + 2, len(model.langs)
    lengths = np.diff(starts)
    pieces = -(-lengths // SEGMENT)
    owner = np.repeat(np.arange(n), pieces)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    offset = starts[owner] + number * SEGMENT
    size = np.minimum(lengths[owner] - number * SEGMENT, SEGMENT)
    order = np.argsort(-size, kind="stable")
    owner, offset, size = owner[order], offset[order], size[order]
    state = np.tile(model.roots, (len(owner), 1))
    count = np.zeros((len(owner), langs), dtype=np.int32)
    active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
    codes = codes.astype(np.int32)
    for t, k in enumerate(active):
        if model.edges is None:
            step = state[:k] * width
            step += codes[offset[:k] + t][:, None]
            moved = model.table[step]
        else:
            moved = _follow(model, state[:k], codes[offset[:k] + t])
        count[:k] += moved >> _STATE_BITS
        np.bitwise_and(moved, _STATE, out=state[:k])
    count += state != model.roots  # the last, unfinished phrase
    out = np.zeros((n, langs), dtype=np.int64)
    np.add.at(out, owner, count)
    return out


def build_model(references: dict[str, str]) -> LangModel:
    """Automata of the reference texts (language -> text)."""
    langs = tuple(sorted(references))
    alphabet = "".join(sorted({ch for t in references.values() for ch in t.lower() if ch.isalpha()}))
    width = len(alphabet) + 2
    coded = [encode([references[lang]], alphabet)[0] for lang in langs]
    automata = [suffix_automaton([int(c) for c in codes if c != _OTHER]) for codes in coded]
    sparse = 4 * width * sum(map(len, automata)) > DENSE_BYTES
    keys, restarts = [], []
    parts, roots, bits, base = [], [], [], 0
    for codes, edges in zip(coded, automata):
        root = base
        restart = [(1 << _STATE_BITS | root + edges[0][c]) if c in edges[0] else (2 << _STATE_BITS | root) for c in range(width)]
        roots.append(root)
        bits.append(math.log2(max(2, len(codes))))
        base += len(edges)
        if sparse:
            restarts.append(restart)
            keys.append(np.array([(root + s) * width + c for s, out in enumerate(edges) for c in sorted(out)], dtype=np.int64))
            parts.append(np.array([root + out[c] for out in edges for c in sorted(out)], dtype=np.int32))
            continue
        part = np.tile(np.array(restart, dtype=np.int32), (len(edges), 1))
        for s, out in enumerate(edges):
            for c, d in out.items():
                part[s, c] = root + d
        for c in range(width):  # nothing is unfinished at the root
            part[0, c] = root + edges[0][c] if c in edges[0] else (1 << _STATE_BITS | root)
        parts.append(part)
    roots, bits = np.array(roots, dtype=np.int32), np.array(bits)
    if sparse:
        return LangModel(langs, alphabet, np.concatenate(parts), roots, bits, np.concatenate(keys), np.array(restarts, dtype=np.int32))
    return LangModel(langs, alphabet, np.concatenate(parts).ravel(), roots, bits)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", reference_chars: int = REFERENCE_CHARS, buckets: int = 16,
        rows_per_bucket: int = 2, chars_per_row: int = 2_500) -> LangModel | None:
    """Model of the labelled rows; None where no row has a label and a letter.

    Sampled rows are those of smallest hash in each of ``buckets`` hash buckets
    of a language, so no task orders a whole language. At most
    ``buckets * rows_per_bucket * chars_per_row`` characters a language reach
    the driver, of which ``reference_chars`` are used; a language with less uses
    all it has.
    """
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    rank = Window.partitionBy("lang", F.pmod("h", F.lit(buckets))).orderBy("h")
    picked = (rows.withColumn("text", F.substring("text", 1, chars_per_row)).withColumn("r", F.row_number().over(rank))
              .filter(F.col("r") <= rows_per_bucket).select("lang", "h", "text").distinct().collect())
    by: dict[str, list] = {}
    for r in picked:
        by.setdefault(r["lang"], []).append((r["h"], r["text"]))
    if not by:
        return None
    texts = {k: "\n".join(t for _, t in sorted(v)) for k, v in by.items()}
    return build_model({k: t[:reference_chars] for k, t in texts.items()})


def phrase_bits(model: LangModel) -> np.ndarray:
    """Cost of a phrase in each language."""
    return np.maximum(model.bits, math.log2(LEAST_CHARS))


def predict_batch(texts: list[str], model: LangModel, chars_at_once: int = 1_000_000) -> pd.DataFrame:
    lang, score, phrases, letters = [], [], [], []
    at, bits = 0, phrase_bits(model)
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end]) <= chars_at_once):
            chars += len(texts[end])
            end += 1
        codes, starts = encode(texts[at:end], model.alphabet)
        seen = np.zeros(len(codes) + 1, dtype=np.int32)
        np.cumsum(codes != _GAP, out=seen[1:])
        seen = seen[starts].astype(np.int64)
        n_letters = np.diff(seen)
        counts = cross_parse(codes, starts, model)
        cost = counts * bits
        best = cost.argmin(axis=1)
        low = cost[np.arange(len(best)), best]
        share = 1.0 / np.exp2(np.clip((low[:, None] - cost) / bits, -1000, 0)).sum(axis=1)
        lang += [model.langs[b] if k else UNDETERMINED for b, k in zip(best, n_letters)]
        score += np.where(n_letters > 0, share, 0.0).tolist()
        phrases += counts[np.arange(len(best)), best].tolist()
        letters += n_letters.tolist()
        at = end
    return pd.DataFrame({"lang": lang, "score": score, "phrases": phrases, "letters": letters})


def language(docs: DataFrame, model: LangModel | None, text: str = "text") -> Column:
    """Column struct(lang, score, phrases, letters) of the whole text.

    A null text, an empty one or one without a letter is ``und`` with score 0.
    Ties go to the alphabetically first language; extra columns play no part.
    """
    if model is None:
        return F.struct(F.lit(UNDETERMINED).alias("lang"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("phrases"), F.lit(0).cast("long").alias("letters"))
    shared = ship_texts(docs).sparkContext.broadcast(model)  # bounded: languages x reference_chars

    @F.pandas_udf("lang string, score double, phrases long, letters long")
    def run(texts: pd.Series) -> pd.DataFrame:
        return predict_batch([t or "" for t in texts], shared.value)

    return run(F.col(text))


def keep_identified(docs: DataFrame, model: LangModel | None, text: str = "text", most_phrases: float = 0.6) -> DataFrame:
    """The rows of ``docs`` that some learned language explains: they have a
    letter, and (from 20 letters on) at most ``most_phrases`` phrases a letter;
    text of no learned language falls apart into phrases of a letter or two.
    The limit is for a reference of ``REFERENCE_CHARS``; phrases get shorter as
    the logarithm of a reference's length does, so it grows by that ratio."""
    limits = [] if model is None else [max(1.0, math.log2(REFERENCE_CHARS) / b) * most_phrases for b in phrase_bits(model)]
    limit = F.lit(most_phrases)
    if limits:
        limit = F.element_at(F.create_map(*[F.lit(x) for pair in zip(model.langs, map(float, limits)) for x in pair]), F.col("_lang.lang"))
    found = docs.withColumn("_lang", language(docs, model, text))
    fits = (F.col("_lang.letters") < 20) | (F.col("_lang.phrases") <= limit * F.col("_lang.letters"))
    return found.filter((F.col("_lang.lang") != UNDETERMINED) & fits).select(*docs.columns)
