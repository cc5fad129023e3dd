"""Benchmark decontamination as a prefix-filtered set join.

A window is WINDOW consecutive words of an item, its token set the (word, repetition)
pairs. A document window of the same length equals it when all tokens are shared, so the containment
threshold is 1 and the necessary prefix of a window in order of rarity is its one rarest word. Rarity
is counted over all documents. Document words are joined with these prefix words, the positional bound
fixes where the window must begin and end, a bound on length drops what would pass the text's ends, the
next rarest word must stand at its own place, and only then are the words compared, one by one and exactly.
All of this happens where a document's words were split: no text is shuffled for it. The windows are joined
in blocks of at most BLOCK_WINDOWS, so that what is sent to all executors has a bound. Only DataFrame
functions are used.

Defined results: null and empty texts have no words; items without words have no window; a window of an
item shorter than WINDOW words is the whole item; repeated documents are rows each; an empty
benchmark leaves all documents clean; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, texts

#: Words that an item's window has.
WINDOW = 10
#: Windows that are sent to all executors at once; more are joined in further passes over the words.
BLOCK_WINDOWS = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = "".join(c for c in map(chr, range(128)) if not c.isalnum() and c != " ")


def line_of(text: Column) -> Column:
    """All words, A to Z in lower case, with one blank between them: letters and digits of ASCII and all beyond it make words."""
    spaced = F.translate(F.coalesce(text, F.lit("")), _UPPER + _BETWEEN, _LOWER + " " * len(_BETWEEN))
    return F.trim(F.regexp_replace(spaced, "  +", " "))


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, window): the windows of all items."""
    w = benchmark.select("item_id", line_of(F.col("text")).alias("line")).where("line <> ''").select("item_id", F.split("line", " ").alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    return w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, size))).alias("window"))


def prefixes(windows: DataFrame, rarity: DataFrame) -> DataFrame:
    """(wid, window, word, at, next_word, next_at) of (wid, window): the two rarest words with their places; of a window of one word, that word twice."""
    tokens = windows.select("wid", F.posexplode("window").alias("at", "word")).join(rarity, "word", "left").fillna(0, ["n"])
    order = F.array_sort(F.collect_list(F.struct("n", "word", "at")))
    two = tokens.groupBy("wid").agg(order.alias("o")).select("wid", F.col("o")[0].alias("p"), F.coalesce(F.get("o", F.lit(1)), F.col("o")[0]).alias("q"))
    return windows.join(two, "wid").select("wid", "window", F.col("p.word").alias("word"), F.col("p.at").alias("at"), F.col("q.word").alias("next_word"), F.col("q.at").alias("next_at"))


def equal_windows(held: DataFrame, block: DataFrame) -> DataFrame:
    """(_row, first, len, wid): the places of a block of windows in lines of words."""
    # an outer explode needs no check for empty arrays, for which the words would be split anew
    spots = held.select("_row", "n_words", F.split("line", " ").alias("words"))
    spots = spots.select("_row", "n_words", "words", F.posexplode_outer("words").alias("pos", "word"))
    first, size = F.col("pos") - F.col("at"), F.size("window")
    inside = (first >= 0) & (first + size <= F.col("n_words"))
    near = F.get("words", first + F.col("next_at")) == F.col("next_word")
    same = F.slice("words", F.greatest(first, F.lit(0)) + 1, size) == F.col("window")
    return spots.join(F.broadcast(block), "word").where(inside & near & same).select("_row", first.alias("first"), size.alias("len"), "wid")


def hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) per row; _kithgraph_made has the tables written for it, to be discarded once it is read."""
    items = cut(item_windows(benchmark, size), "windows")
    distinct = cut(items.select("window").distinct().withColumn("wid", F.monotonically_increasing_id()), "distinct-windows")
    # words are kept as one string, which takes half the bytes of an array
    lines = texts(docs).select(F.monotonically_increasing_id().alias("_row"), "doc_id", line_of(F.col("text")).alias("line"))
    blanks = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit("")))
    held = cut(lines.select("_row", "doc_id", "line", F.when(F.col("line") == "", 0).otherwise(blanks + 1).alias("n_words")), "words")
    blocks = -(-distinct.count() // BLOCK_WINDOWS)
    # a word's rarity: its number of occurrences in all documents, summed before the shuffle
    vocabulary = distinct.select(F.explode("window").alias("word")).distinct()
    small = (lambda d: F.broadcast(d)) if blocks <= 1 else (lambda d: d)
    rarity = cut(held.select(F.explode_outer(F.split("line", " ")).alias("word")).join(small(vocabulary), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n")), "rarity")
    ready = cut(prefixes(distinct, rarity).withColumn("block", F.pmod(F.xxhash64("wid"), F.lit(max(1, blocks)))), "prefixes")
    each = [cut(equal_windows(held, ready.where(F.col("block") == b).drop("block")), "found") for b in range(max(1, blocks))]
    found = reduce(DataFrame.unionByName, each)
    covered = found.select("_row", F.explode(F.sequence("first", F.col("first") + F.col("len") - 1)).alias("pos")).distinct().groupBy("_row").agg(F.count("*").alias("n_hit"))
    which = items.join(distinct, "window").select("wid", F.col("item_id").cast("string").alias("item"))
    named = found.select("_row", "wid").distinct().join(small(which), "wid").select("_row", "item").distinct()
    listed = named.groupBy("_row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    hit = cut(covered.join(listed, "_row"), "hit")
    whole = held.select("_row", "doc_id", F.col("n_words").cast("long").alias("n_words")).join(hit, "_row", "left")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    out = whole.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
    out._kithgraph_made = [items, distinct, held, rarity, ready, *each, hit]
    return out


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 10, 0) + 2), lambda i: w[i:i + 9])) AS win FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(win) AS n FROM win),
spots AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d, sizes WHERE len(w) >= n),
f AS (SELECT s.doc_id, s.pos, s.n, win.item_id FROM spots s JOIN win ON win.win = s.w[s.pos:s.pos + s.n - 1]),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM f) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM f) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)"""
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_decontaminate": op10_decontaminate}
SQL: dict[str, str] = {"op10_decontaminate": _SQL}
