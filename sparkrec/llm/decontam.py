"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions.

A window is ``window`` consecutive words of an item (an item of fewer words is
one window). Its tokens are its word shingles of ``shingle`` words (a shorter
window is one token). Exact containment needs every token of the window, so one
token is a sufficient prefix: the rarest in the global order.

1. Each document is read once: its shingles that occur in the benchmark at all
   are kept with their word position.
2. Tokens are ordered by how often they occur there (rarity over all
   documents); each distinct window keeps its rarest token as prefix.
3. Occurrences join windows on the prefix token only. The token's place in the
   window fixes the start, so start and end must lie inside the document
   (positional and length bounds).
4. A candidate is verified word for word: the kept occurrences around the prefix
   must contain the window's every token at its place.

Hit words are the union of the verified spans of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrec.llm.common import ascii_lower, broadcast_if_under, materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # fixed by the contract: words of letters, digits and non-ASCII
BROADCAST_ROWS = 200_000  # benchmark tokens or windows sent to every executor at most


def words(text: Column) -> Column:
    """Lower-cased words; a null text has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def item_windows(items: DataFrame, item: str, text: str, window: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows ``(win, len, tokens)`` and which items hold them ``(win, item)``.

    Items that share an id count as one item; items without words have no window."""
    w = items.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    last = F.greatest(F.size("w") - window, F.lit(0))
    each = w.select("item", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(F.col("w"), i + 1, window))).alias("ws"))
    each = each.select("item", F.array_join("ws", " ").alias("win"), "ws").distinct()
    k = F.least(F.size("ws"), F.lit(shingle))
    tokens = F.transform(F.sequence(F.lit(0), F.size("ws") - k), lambda i: F.array_join(F.slice(F.col("ws"), i + 1, k), " "))
    wins = each.select("win", F.size("ws").alias("len"), tokens.alias("tokens")).dropDuplicates(["win"])
    return wins, each.select("win", "item")


def occurrences(docs: DataFrame, tokens: DataFrame, n_tokens: int, sizes: list[int], keys: list[str]) -> DataFrame:
    """``(keys..., pos, n_words, token)``: every place where a benchmark token stands.

    One pass over the documents: words are exploded with the words that follow,
    and each of the token lengths ``sizes`` is looked up by hash and compared word
    for word."""
    shingle = max(sizes)
    following = [F.col("w")] + [F.slice("w", i + 1, F.greatest(F.size("w") - i, F.lit(0))) for i in range(1, shingle)]
    rows = docs.select(*keys, F.size("w").alias("n_words"), F.posexplode(F.arrays_zip(*[c.alias(f"w{i}") for i, c in enumerate(following)])).alias("pos", "z"))
    rows = rows.select(*keys, "n_words", "pos", *[F.col("z").getField(f"w{i}").alias(f"w{i}") for i in range(shingle)])
    found = []
    for k in sizes:
        own = [f"w{i}" for i in range(k)]
        t = tokens.filter(F.size("tw") == k).select(F.xxhash64(*[F.col("tw")[i] for i in range(k)]).alias(f"h{k}"), F.col("token").alias(f"t{k}"),
                                                    *[F.col("tw")[i].alias(f"b{k}_{i}") for i in range(k)])
        same = F.xxhash64(*own) == F.col(f"h{k}")
        for i in range(k):
            same = same & (F.col(f"w{i}") == F.col(f"b{k}_{i}"))
        rows = rows.join(broadcast_if_under(t, n_tokens, BROADCAST_ROWS), same, "left" if len(sizes) > 1 else "inner")
        found.append(F.col(f"t{k}"))
    if len(found) == 1:
        return rows.select(*keys, "n_words", "pos", found[0].alias("token"))
    hit = rows.filter(F.coalesce(*found).isNotNull())
    return hit.select(*keys, "n_words", "pos", F.explode(F.array_compact(F.array(*found))).alias("token"))


def spans(docs: DataFrame, items: DataFrame, keys: list[str], text: str = "text", item: str = "item_id", item_text: str = "text",
          window: int = 10, shingle: int = 3) -> DataFrame:
    """``(keys..., start, len, win)``: every place in ``docs`` where an item window
    stands, by word numbers from 0, and the window's words; one row each however
    many items share the window. Null ids are values like any other."""
    wins, _ = item_windows(items, item, item_text, window, shingle)
    wins = materialize(wins)
    tokens = materialize(wins.select(F.explode("tokens").alias("token")).distinct().select("token", F.split("token", " ").alias("tw")))
    by_size = {r["k"]: r["count"] for r in tokens.groupBy(F.size("tw").alias("k")).count().collect()}  # shingle rows at most
    n_tokens, n_wins = sum(by_size.values()), wins.count()
    seen = materialize(occurrences(docs.select(*keys, words(F.col(text)).alias("w")), tokens, n_tokens, sorted(by_size) or [1], keys))
    rarity = seen.groupBy("token").count().withColumnRenamed("count", "df")
    # the rarest token that occurs at all: a window with a token that never occurs cannot occur
    place = wins.select("win", "len", "tokens", F.posexplode("tokens").alias("at", "token")).join(rarity, "token", "left")
    prefix = place.groupBy("win").agg(F.first("len").alias("len"), F.first("tokens").alias("tokens"), F.count("*").alias("n"), F.count("df").alias("known"),
                                      F.min(F.struct("df", "token", "at")).alias("p")).filter("n = known")
    prefix = prefix.select("win", "len", "tokens", F.col("p.at").alias("at"), F.col("p.token").alias("token"))
    reach = window - shingle
    near = Window.partitionBy(*keys).orderBy("pos").rangeBetween(-reach, reach)
    around = seen.withColumn("around", F.collect_list(F.struct("pos", "token")).over(near))
    cand = around.join(broadcast_if_under(prefix, n_wins, BROADCAST_ROWS), "token").withColumn("start", F.col("pos") - F.col("at"))
    cand = cand.filter((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words")))
    exact = F.forall(F.sequence(F.lit(0), F.size("tokens") - 1), lambda j: F.array_contains(
        F.col("around"), F.struct((F.col("start") + j).alias("pos"), F.element_at("tokens", j + 1).alias("token"))))
    return cand.filter(exact).select(*keys, "start", "len", "win").distinct()


def contamination(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
                  window: int = 10, shingle: int = 3) -> DataFrame:
    """``(doc_id, n_words, n_hit, items)`` for every row of ``docs``.

    ``n_hit`` counts the words inside any occurrence of a window, ``items`` is
    the sorted array of the item ids (as strings) with an occurring window. A
    null or empty text has no words; repeated rows stay, each with its result
    (rows are told apart by id and text); items with a null id count for the
    hits and are listed nowhere; an empty benchmark hits nothing.
    """
    keyed = docs.select(F.col(doc).alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    keys = ["doc_id", "text_key"]
    _, holders = item_windows(items, item, item_text, window, shingle)
    found = materialize(spans(keyed, items, keys, "text", item, item_text, window, shingle))
    before = Window.partitionBy(*keys).orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    cover = found.select(*keys, "start", "len").distinct().withColumn("reached", F.coalesce(F.max(end).over(before), F.lit(0)))
    hits = cover.groupBy(*keys).agg(F.sum(F.greatest(end - F.greatest("start", "reached"), F.lit(0))).alias("n_hit"))
    held = found.select(*keys, "win").distinct().join(holders, "win").select(*keys, "item").distinct()
    ids = held.groupBy(*keys).agg(F.sort_array(F.collect_set("item")).alias("items"))
    result = hits.join(ids, keys_equal(hits, ids, keys), "left").select(*[hits[k] for k in keys], "n_hit", "items")
    base = keyed.select(*keys, F.regexp_count("text", F.lit(WORD_ANY_CASE)).alias("n_words"))
    return base.join(result, keys_equal(base, result, keys), "left").select(
        base["doc_id"], F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def drop_contaminated(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
                      window: int = 10, shingle: int = 3) -> DataFrame:
    """The rows of ``docs`` in which no window of an item stands."""
    keyed = docs.select(F.col(doc).alias("d"), F.xxhash64(text).alias("k"), F.col(text).alias("text"))
    hit = materialize(spans(keyed, items, ["d", "k"], "text", item, item_text, window, shingle).select("d", "k").distinct())
    return docs.join(broadcast_if_under(hit, hit.count(), 500_000), docs[doc].eqNullSafe(hit["d"]) & (F.xxhash64(docs[text]) == hit["k"]), "left_anti")


WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the same words before lower-casing


def keys_equal(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    cond = a[keys[0]].eqNullSafe(b[keys[0]])
    for k in keys[1:]:
        cond = cond & a[k].eqNullSafe(b[k])
    return cond
