"""Secret scan in DataFrame functions: fixed patterns and sliding-window entropy.

*Patterns* (kinds ``assign``, ``access``, ``hex``) are the base. Regular
expressions give the matched strings but no positions; the pieces between the
matches (the same pattern given to ``split``) do: a match starts after all the
pieces and matches before it. The running sum is a window over the matches of
one document, so a document with very many matches stays linear and can spill.

*Entropy* (kind ``entropy``) looks at candidate strings: runs of at least
``MIN_RUN`` base64 characters. Each character class (hex digits, letters of one
case with digits, base64 characters) has its own threshold on the Shannon entropy
of a sliding window, and the class is that of the window: a hex secret behind a
prefix is judged as hex. Counts are kept incrementally: a step adds one character and drops one, and
``sum(c * log2(c))`` changes by four looked-up terms. A span reaches from the
first to the last window above the threshold. The allow-list suppresses strings
that are no secrets however mixed they are: letters only, digits only, UUIDs,
file paths of words, and stock sequences. Entropy spans inside a base span are
left out; base spans always stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrec.llm.common import broadcast_if_under, materialize

# Fixed patterns of the contract.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # the same matches as runs of any length, of which those under 32 are dropped
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 8, 16, 32

KINDS = ("assign", "access", "hex", "entropy")
ALPHABET = "0123456789abcdefABCDEFghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ+/_=-"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
MIN_RUN = 20
WINDOW = 20
HEX_BITS, CASE_BITS, BASE64_BITS = 2.8, 3.3, 3.75  # least entropy of a window, by character class
# Allow-list: a candidate that matches in full, or holds a stock sequence, is no secret.
ALLOW_WHOLE = (
    r"[A-Za-z+/_=-]+",
    r"[0-9+/_=-]+",
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"(?:[A-Za-z]+|[0-9]{1,4})(?:[/_=-]+(?:[A-Za-z]+|[0-9]{1,4}))+[/_=-]*",
)
ALLOW_PART = ("0123456789", "1234567890", "abcdefghij", "ABCDEFGHIJ", "EXAMPLE", "example")


def window_span(run: Column, window: int = WINDOW) -> Column:
    """struct(first, last): code points from the start of the first window above
    the threshold of its class to the end of the last; first 0 if none.

    A window of hex digits, or of letters of one case with digits, is of that
    class if it has both a digit and a letter (in a run of nothing but hex
    digits, always); any other is base64."""
    all_hex = run.rlike(r"\A[0-9a-fA-F]+\z")
    term = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])
    codes = F.transform(F.split(run, ""), lambda ch: F.position(ch, F.lit(ALPHABET)))
    start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("n"), F.lit(0.0).alias("s"), F.lit(0).alias("first"), F.lit(0).alias("last"),
                     *[F.lit(0).alias(c) for c in ("digit", "lower", "upper", "off", "mark")], codes.alias("codes"))

    def step(a: Column, i: Column) -> Column:
        x = F.element_at(a["codes"], i)
        y = F.when(i > window, F.element_at(a["codes"], F.greatest(i - window, F.lit(1)))).otherwise(F.lit(0))
        nx = F.element_at(a["n"], x)
        ny = F.when(y > 0, F.element_at(a["n"], F.greatest(y, F.lit(1)))).otherwise(F.lit(0))
        enter = F.element_at(term, F.least(nx + 2, F.lit(window + 1))) - F.element_at(term, nx + 1)
        leave = F.when(y > 0, F.element_at(term, F.greatest(ny, F.lit(1))) - F.element_at(term, ny + 1)).otherwise(F.lit(0.0))
        s = F.when(x == y, a["s"]).otherwise(a["s"] + enter + leave)
        n = F.transform(a["n"], lambda v, j: v + F.when(j + 1 == x, 1).otherwise(0) - F.when(j + 1 == y, 1).otherwise(0))
        # the last place of a digit, a letter of each case, a letter beyond hex and a mark (places in ALPHABET)
        last = {"digit": x <= 10, "lower": x.between(11, 16) | x.between(23, 42), "upper": x.between(17, 22) | x.between(43, 62), "off": x.between(23, 62), "mark": x > 62}
        last = {c: F.when(here, i).otherwise(a[c]) for c, here in last.items()}
        has = {c: at > i - window for c, at in last.items()}
        both = has["digit"] & (has["lower"] | has["upper"]) & ~has["mark"]
        floor = (F.when(all_hex | (both & ~has["off"]), F.lit(HEX_BITS)).when(both & ~(has["lower"] & has["upper"]), F.lit(CASE_BITS)).otherwise(F.lit(BASE64_BITS)))
        above = (i >= window) & (math.log2(window) - s / window >= floor)
        first = F.when(above & (a["first"] == 0), i - window + 1).otherwise(a["first"])
        return F.struct(n.alias("n"), s.alias("s"), first.alias("first"), F.when(above, i).otherwise(a["last"]).alias("last"),
                        *[at.alias(c) for c, at in last.items()], a["codes"].alias("codes"))

    return F.aggregate(F.sequence(F.lit(1), F.length(run)), start, step, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))


def allowed(run: Column) -> Column:
    whole = "|".join(f"(?:{p})" for p in ALLOW_WHOLE)
    out = run.rlike(rf"\A(?:{whole})\z")
    for part in ALLOW_PART:
        out = out | run.contains(part)
    return out


def spans(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``(keys..., kind, start, end)`` of all secrets; ``kind`` is the place in
    ``KINDS``, positions are code points, the end exclusive. ``keys`` must tell
    rows apart; rows that repeat are scanned once."""
    t = F.col(text)
    some = docs.filter(t.rlike(f"{ASSIGN}|{ACCESS}|{HEX}|{CANDIDATE}")).select(*keys, t.alias("t")).dropDuplicates(keys)
    patterns = (ASSIGN, ACCESS, HEX, CANDIDATE)
    per_kind = F.array(*[F.struct(F.lit(i).alias("kind"), F.split("t", p, -1).alias("gap"), F.regexp_extract_all("t", F.lit(p), F.lit(0)).alias("hit"),
                                  (F.regexp_extract_all("t", F.lit(p), F.lit(1)) if i == 0 else F.array().cast("array<string>")).alias("value"))
                         for i, p in enumerate(patterns)])
    rows = some.select(*keys, F.explode(per_kind).alias("k")).filter(F.size("k.hit") > 0)
    rows = rows.select(*keys, F.col("k.kind").alias("kind"), F.posexplode(F.arrays_zip(F.col("k.gap").alias("gap"), F.col("k.hit").alias("hit"), F.col("k.value").alias("value"))).alias("at", "z"))
    rows = rows.filter(F.col("z.hit").isNotNull()).select(*keys, "kind", "at", F.length("z.gap").alias("gap"), F.col("z.hit").alias("hit"), F.col("z.value").alias("value"))
    far = Window.partitionBy(*keys, "kind").orderBy("at")
    size = F.length("hit")
    rows = rows.withColumn("end", F.sum(F.col("gap") + size).over(far)).withColumn("start", F.col("end") - size)
    whole = F.array(F.struct(F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end")))
    good = F.when(F.col("kind") == 0, F.length("value") >= ASSIGN_MIN).when(F.col("kind") == 1, size >= ACCESS_MIN).when(F.col("kind") == 2, size >= HEX_MIN).otherwise(F.lit(False))
    candidate = (F.col("kind") == 3) & F.col("hit").rlike("[0-9]") & ~allowed(F.col("hit"))
    mixed = F.transform(F.filter(F.array(window_span(F.col("hit"))), lambda w: w["first"] > 0), lambda w: F.struct(
        (F.col("start") + w["first"] - 1).cast("bigint").alias("start"), (F.col("start") + w["last"]).cast("bigint").alias("end")))
    # exploded, so that the fold over a candidate's characters runs once
    each = rows.select(*keys, "kind", F.explode(F.when(good, whole).when(candidate, mixed)).alias("s"))
    both = each.select(*keys, "kind", F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    # an entropy span inside a base span says nothing new: no later-starting, longer base span can hold it, so a running maximum tells
    order = Window.partitionBy(*keys).orderBy("start", F.col("end").desc(), "kind").rowsBetween(Window.unboundedPreceding, 0)
    held = F.max(F.when(F.col("kind") < 3, F.col("end"))).over(order)
    return both.withColumn("held", held).filter((F.col("kind") < 3) | F.col("held").isNull() | (F.col("held") < F.col("end"))).drop("held")


def scan(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text_key, spans)`` for every row of ``docs``; ``spans`` is an
    array of struct(start, kind, end) by start, then kind.

    A null or empty text has no spans. Rows are told apart by id and text, so
    repeated rows get equal results and null ids are values like any other.
    """
    keyed = docs.select(F.col(doc).alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    keys = ["doc_id", "text_key"]
    found = spans(keyed, keys, "text").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    found = materialize(found).select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "spans")
    return keyed.select(*keys).join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left").select(
        *keys, F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")).alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span (overlapping ones together) replaced by ``mask``."""
    start = F.struct(F.array().cast("array<struct<a:bigint,b:bigint>>").alias("done"), F.lit(-1).cast("bigint").alias("a"), F.lit(-1).cast("bigint").alias("b"))

    def merge(m: Column, s: Column) -> Column:
        joins = (m["a"] >= 0) & (s["start"] < m["b"])
        closed = F.when(joins | (m["a"] < 0), m["done"]).otherwise(F.array_append(m["done"], F.struct(m["a"].alias("a"), m["b"].alias("b"))))
        return F.struct(closed.alias("done"), F.when(joins, m["a"]).otherwise(s["start"]).alias("a"), F.when(joins, F.greatest(m["b"], s["end"])).otherwise(s["end"]).alias("b"))

    merged = F.aggregate(spans, start, merge, lambda m: F.array_append(m["done"], F.struct(m["a"].alias("a"), m["b"].alias("b"))))
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(merged, lambda s: s["b"]))
    ends = F.concat(F.transform(merged, lambda s: s["a"]), F.array(F.length(text).cast("bigint")))
    kept = F.zip_with(starts, ends, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
    return F.when(F.size(spans) > 0, F.array_join(kept, mask)).otherwise(text)


def mask_documents(docs: DataFrame, doc: str = "doc_id", text: str = "text", mask: str = "[SECRET]", broadcast_spans: int = 200_000) -> DataFrame:
    """All rows and columns of ``docs``, every secret of ``text`` masked."""
    keyed = docs.select(F.col(doc).alias("_doc"), F.xxhash64(text).alias("_key"), F.col(text).alias("_text"))
    found = materialize(spans(keyed, ["_doc", "_key"], "_text").groupBy("_doc", "_key").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("_spans")))
    size = found.agg(F.coalesce(F.sum(F.size("_spans")), F.lit(0))).first()[0]
    side = broadcast_if_under(found, size, broadcast_spans)
    joined = docs.join(side, docs[doc].eqNullSafe(found["_doc"]) & (F.xxhash64(docs[text]) == found["_key"]), "left")
    return joined.select(*[F.when(F.col("_spans").isNull(), docs[c]).otherwise(masked(docs[c], F.col("_spans"), mask)).alias(c) if c == text else docs[c] for c in docs.columns])
