"""Personal data, and the terms that reveal it, by information-theoretic sanitisation.

Base kinds are found by pattern. Terms are the runs of letters outside base spans, in lower case. They are
counted with each entity over whole documents of the whole corpus: a term t discloses an entity e when the entity
accounts for a share P(e | t) of the term's documents of SHARE at least, in at least SUPPORT different contexts (a text and
its copies are one), and the term carries information about it, log2(P(e | t) / P(e)) > 0.
All occurrences of such a term, in any document, are spans of the kind "term". The sanitised text has the kind in
place of a base span (generalised) and nothing in place of a term (removed). Only DataFrame functions are used; counts
are summed before they are shuffled.

Positions are code points. Defined results: null and empty texts have no spans; repeated rows are
rows each; copies of one text alone never make a term; an empty table gives no rows; columns other than doc_id
and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, texts

KINDS = ("email", "ip", "card", "phone")
SUPPORT, SHARE = 4, 0.6
_TERM = r"\p{L}+"
# The patterns match what the documented ones do; possessive parts and the look-behind keep long runs from being tried again at each start.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # fewer than 14 digits would fail: such runs are not listed
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_SPANS = "array<struct<start:int,end:int,value:string>>"


def positions(text: Column, pattern: str | Column, shift: Column | None = None) -> Column:
    """The matches of a pattern as (start, end, value): what stands between matches gives their places."""
    held = F.lit(pattern) if isinstance(pattern, str) else pattern
    found, gaps = F.regexp_extract_all(text, held, F.lit(0)), F.split(text, held, -1)
    zero = F.struct((shift if shift is not None else F.lit(0)).cast("int").alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(acc, x):
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        return F.struct(end.cast("int").alias("at"), F.concat(acc["out"], F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), x["m"].alias("value")))).alias("out"))

    pairs = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    return F.when(F.size(found) > 0, F.aggregate(pairs, zero, step)["out"]).otherwise(F.array().cast(_SPANS))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether every second digit from the right, doubled, and the others sum to a multiple of 10."""
    each = F.split(F.reverse(digits), "")
    worth = F.transform(each, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)))
    return F.aggregate(worth, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(f"^{_BYTE}(\\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.when(n.between(14, 19), luhn(_digits(value))).otherwise(False)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def _checked(found: Column, k: int) -> Column:
    """The valid spans with their kind's number."""
    good = F.filter(found, lambda s: _valid(KINDS[k], s["value"]))
    return F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))


def _number(k: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")


def base_spans(docs: DataFrame) -> DataFrame:
    """(_row, doc_id, text, spans): spans are (start, kind number, end, value) in order."""
    gate = {"email": F.col("text").contains("@"), "ip": F.col("text").rlike(r"[0-9]\.[0-9]"), "card": F.col("text").rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), "phone": F.col("text").contains("+")}
    of = []
    for k, kind in enumerate(KINDS):
        found = F.when(gate[kind], positions(F.col("text"), _PATTERNS[kind])).otherwise(F.array().cast(_SPANS))
        of.append(_checked(found, k))
    return texts(docs).select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text", F.array_sort(F.concat(*of)).alias("spans"))


def masked(found: DataFrame) -> DataFrame:
    """Blanks in place of the spans, so that all other text stands where it did."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        start, end = F.greatest(acc["at"], s["start"]), F.greatest(acc["at"], s["end"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.substring("text", acc["at"] + 1, start - acc["at"]), F.repeat(F.lit(" "), end - start)).alias("out"))

    blank = F.aggregate("spans", zero, step, lambda acc: F.concat(acc["out"], F.substring("text", acc["at"] + 1, F.length("text"))))
    return found.withColumn("text", F.when(F.size("spans") > 0, blank).otherwise(F.col("text")))


def _words() -> Column:
    """A masked text's distinct terms as they are written."""
    return F.array_remove(F.array_distinct(F.split("text", r"\P{L}+")), "")


def disclosing(found: DataFrame) -> DataFrame:
    """The terms whose co-occurrence with some entity over all documents discloses it; texts are masked."""
    total = F.lit(float(max(1, found.count())))
    values = F.array_distinct(F.transform("spans", lambda s: F.xxhash64(s["value"])))
    words = F.array_distinct(F.transform(_words(), lambda w: F.lower(w)))
    # a context is represented by one of its rows, with their number: a hot text's copies are never spread out
    holding = found.where(F.size("spans") > 0)
    least = holding.select("_row", F.xxhash64("text", values).alias("c")).groupBy("c").agg(F.min("_row").alias("_row"), F.count("*").alias("copies"))
    holding = holding.join(cut(least.select("_row", "copies"), "contexts"), "_row").select("text", "copies", F.explode(values).alias("entity"))
    counted = lambda n: (F.sum("copies").alias(n), F.count("*").alias("support"))
    # an entity in fewer contexts cannot reach the support with any term
    entities = cut(holding.groupBy("entity").agg(*counted("n_e")).where(F.col("support") >= SUPPORT).drop("support"), "entities")
    pair = holding.join(entities, "entity").select("entity", "n_e", "copies", F.explode(words).alias("term"))
    pair = cut(pair.groupBy("term", "entity", "n_e").agg(*counted("n_te")).where(F.col("support") >= SUPPORT).drop("support"), "term-entities")
    if pair.isEmpty():
        return pair.select("term")
    asked = cut(pair.select("term").distinct(), "terms")
    frequency = found.select(F.explode(words).alias("term")).join(asked, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t"))
    share = F.col("n_te") / F.col("n_t")
    return pair.join(frequency, "term").where((share >= SHARE) & (share * total > F.col("n_e"))).select("term").distinct()


def term_spans(found: DataFrame, bad: DataFrame) -> DataFrame:
    """(_row, extra): all places of the terms in the masked texts that hold any."""
    spelled = found.select("_row", F.explode(_words()).alias("word")).withColumn("term", F.lower("word")).join(bad, "term", "left_semi")
    spelled = spelled.groupBy("_row").agg(F.array_sort(F.collect_list("word")).alias("w"))
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join("w", "|"), F.lit(r")(?!\p{L})"))
    places = positions(F.col("text"), pattern)
    return found.select("_row", "text").join(spelled, "_row").select("_row", F.transform(places, lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), s["end"].alias("end"))).alias("extra"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, (*KINDS, "term")))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(text: Column, spans: Column) -> Column:
    """The text with [KIND] for each base span and without the terms; spans are (start, kind, end) in order, and of overlapping ones what is left of the later counts."""
    tags = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS), F.lit(""))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        start, end = F.greatest(acc["at"], s["start"]), F.greatest(acc["at"], s["end"])
        tag = F.when(end > start, F.element_at(tags, s["kind"] + 1)).otherwise("")
        return F.struct(end.alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, start - acc["at"]), tag).alias("out"))

    return F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term, sanitised) per row."""
    found = cut(masked(base_spans(docs)), "personal")
    bad = cut(disclosing(found), "disclosing")
    plain = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    out = found.select("_row", "doc_id", "text", plain.alias("base"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    out = out.withColumn("extra", none) if bad.isEmpty() else out.join(term_spans(found, bad), "_row", "left").withColumn("extra", F.coalesce("extra", none))
    count = [_number(k) for k in range(len(KINDS))]
    every = F.array_sort(F.concat("base", "extra"))
    # masked blanks lie inside spans, so the masked text gives the same result as the whole one
    return out.select(
        "doc_id",
        *count,
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(every).alias("spans"),
        F.size("extra").cast("long").alias("n_term"),
        sanitised(F.col("text"), every).alias("sanitised"),
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise(table(spark, sf_dir, "documents")).drop("sanitised")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_pii": op2_pii}
SQL: dict[str, str] = {}
