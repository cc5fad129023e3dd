"""Near duplicates by one-permutation MinHash with optimal densification.

A document's set is its distinct shingles of 4 words as 64-bit hashes. Documents
with one set are one class, represented by the smallest doc_id. A class has one minimum per bin of one hash
permutation; an empty bin takes the value of a bin that a universal hash of (bin, attempt) picks. Bands of
rows are bucket keys. In a bucket, edges go from one centre to the others (a star), so there are
no more candidates than bucket entries. Candidates whose sizes or parity bits rule
a link out go (a bound, so no link is lost), the others are confirmed on whole sets. Buckets that then still
hold several components are open: a link between two members that the centre is no part of may be hidden in them. They
get other centres as long as turns find links at a good rate, so that large groups grow together by stars. All
classes of open buckets go through an exact prefix-filtered join (rest_pairs), so no pair of
different components that shares a bucket is left untested, however large the bucket is.

Defined results: null and empty texts and texts of blanks have the empty set and are linked with nothing;
shorter texts than a shingle are one shingle; repeated rows with one doc_id are one document to
links and are returned each; an empty table gives no rows; columns other than doc_id and text
are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_view, chunks, cut, discard, mix64, prefix_hash, span_hash, table, texts

SHINGLE = 4
#: Bands of ROWS bins: a pair at similarity 0.8 misses all of them once in 20 million.
BANDS, ROWS = 32, 4
#: 64-bit words of a set's parities.
WORDS = 8
#: Star turns go on while one pair in so many of a turn is a link; the exact join then takes what is left.
STOP = 4
#: Up to so many doc_ids (32 MB) are broadcast to pick their texts; more are joined, which moves the texts.
BROADCAST_IDS = 4_000_000
_SCHEMA = "doc_id long, n_shingles long, set_hash long, bands array<long>"
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _lower(flat: np.ndarray) -> np.ndarray:
    out = flat.copy()
    out[(flat >= 65) & (flat <= 90)] += 32
    return out


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    flat = _lower(np.frombuffer(text, dtype=np.uint8))
    blank = _BLANK[flat]
    word = ~blank
    first = word & np.concatenate(([True], blank[:-1])) if len(flat) else word
    count = int(first.sum())
    if not count:
        return np.zeros(0, np.uint64)
    # every run of blanks becomes one space, so that equal words give equal bytes
    keep = word | (blank & np.concatenate(([False], word[:-1])))
    flat = np.where(blank, np.uint8(32), flat)[keep]
    starts = np.flatnonzero(first[keep])
    ends = np.append(starts[1:] - 1, len(flat) - (flat[-1] == 32))
    n = min(size, count)
    return np.unique(span_hash(prefix_hash(flat), starts[: count - n + 1], ends[n - 1 :]))


def one_permutation(hashes: np.ndarray, bins: int = BANDS * ROWS) -> np.ndarray:
    """The minimum in each bin; empty bins borrow from bins picked by (bin, attempt) alone."""
    mixed = mix64(hashes ^ np.uint64(0xA0761D6478BD642F))
    out = np.full(bins, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(out, (mixed % np.uint64(bins)).astype(np.int64), mixed // np.uint64(bins))
    full = np.zeros(bins, dtype=bool)
    full[(mixed % np.uint64(bins)).astype(np.int64)] = True
    empty, attempt, source = np.flatnonzero(~full), 1, out.copy()
    while len(empty):
        pick = (mix64(empty.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        good = full[pick]
        out[empty[good]] = source[pick[good]]
        empty, attempt = empty[~good], attempt + 1
    return out


def _ragged(rows: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate(rows)))


def _name(found: np.ndarray) -> int:
    """A 64-bit hash of a whole set; 0 for the empty one."""
    return int(np.bitwise_xor.reduce(mix64(found + np.arange(1, len(found) + 1, dtype=np.uint64))).view(np.int64)) if len(found) else 0


def signatures(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the set's size and hash, and its band keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, limit=4 << 20):
                flat, at = byte_view(batch.column(1))
                sizes, names, bands = [], [], []
                for i in range(len(at) - 1):
                    found = shingle_hashes(flat[at[i] : at[i + 1]].tobytes())
                    sizes.append(len(found))
                    if len(found):
                        sign = one_permutation(found).reshape(BANDS, ROWS)
                        key = np.full(BANDS, 0x51ED270B, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
                        for r in range(ROWS):
                            key = mix64(key ^ sign[:, r])
                        bands.append(key.view(np.int64))
                    else:
                        bands.append(np.zeros(0, np.int64))
                    names.append(_name(found))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), _ragged(bands)], names=["doc_id", "n_shingles", "set_hash", "bands"])

    return texts(docs).mapInArrow(sign, _SCHEMA)


def parities(found: np.ndarray) -> np.ndarray:
    """WORDS * 64 bits: whether an odd number of the set's hashes falls on each. Two sets differ in as many hashes as bits at least."""
    odd = np.bincount((mix64(found ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def may_link(bits: str, other: str, n: str, m: str, threshold: int) -> Column:
    """Whether sets of sizes n and m with these parities can have the similarity; false only where they cannot."""
    apart = reduce(lambda x, y: x + y, (F.bit_count(F.col(bits)[i].bitwiseXOR(F.col(other)[i])) for i in range(WORDS)))
    return apart * (100 + threshold) <= (F.col(n) + F.col(m)) * (100 - threshold)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(id, set_hash, bits, shingles) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, limit=4 << 20):
                flat, at = byte_view(batch.column(1))
                sets = [shingle_hashes(flat[at[i] : at[i + 1]].tobytes()) for i in range(len(at) - 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_name(s) for s in sets], pa.int64()), _ragged([parities(s) for s in sets]), _ragged([s.view(np.int64) for s in sets])], names=["id", "set_hash", "bits", "shingles"])

    return texts(docs).mapInArrow(run, "id long, set_hash long, bits array<long>, shingles array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) of all nodes of edges (a, b), comp the smallest reachable id: large and small stars in turn until nothing changes.

    A star's centre is a summed minimum; no node's neighbours are gathered."""
    both = lambda e: e.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))))
    now = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    before = None
    while True:
        near = both(now)
        least = cut(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "centres")
        large = near.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        large = cut(large, "large")
        down = cut(large.groupBy("b").agg(F.min("a").alias("m")), "minima")
        small = large.join(down, "b").select(F.inline(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))))
        spent, now = (now, least, large, down), cut(small.where("a < b").distinct(), "links")
        discard(*spent)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    stars = now.select(F.col("b").alias("id"), F.col("a").alias("comp"))
    out = stars.unionByName(stars.select(F.col("comp").alias("id"), "comp").distinct())
    out._kithgraph_made = [now]
    return out


def rest_pairs(classes: DataFrame, sets: DataFrame, threshold: int, bits: DataFrame | None = None) -> DataFrame:
    """(a, b, na, nb): pairs that hold all links between classes (id, n_shingles, comp) of different components.

    Shingles are ordered by their number of classes; those of one component only come first and are counted, not listed.
    The first common shingle of a link stands within a prefix of both sets: as long as the overlap with a
    set of equal size leaves for the smaller one, with any smaller set for the larger one. With the
    sets' parities (id, bits), pairs that these rule out are not listed."""
    sets = sets.select("id", "shingles")
    spread = classes.join(sets, "id").select("comp", F.explode("shingles").alias("shingle"))
    common = spread.groupBy("shingle").agg(F.count("*").alias("n"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("shingle", "n")
    common = cut(common, "common-shingles")
    # each row's shingles are dealt out by shingle and come back in order, as far as the prefix may reach
    listed = cut(classes.join(sets, "id").select("id", F.explode("shingles").alias("shingle")).join(common, "shingle").select("id", "n", "shingle"), "listed")
    ordered = listed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("order")).join(classes, "id")
    ordered = ordered.join(bits, "id") if bits is not None else ordered.withColumn("bits", F.lit(None).cast("array<long>"))
    least = F.ceil(F.col("n_shingles") * threshold / 100)
    own = F.col("n_shingles") - F.size("order")
    reach = F.greatest(F.col("n_shingles") - least + 1 - own, F.lit(0)).cast("int")
    prefix = ordered.select("id", "n_shingles", "comp", "bits", own.alias("own"), F.posexplode(F.slice("order", F.lit(1), reach)).alias("at", "s"))
    prefix = cut(prefix.select("id", "n_shingles", "comp", "bits", (F.col("own") + F.col("at")).alias("at"), F.col("s.shingle").alias("shingle")), "prefixes")
    small = prefix.where((F.col("n_shingles") - F.col("at")) * (100 + threshold) >= F.col("n_shingles") * (2 * threshold))
    large = prefix.select("shingle", F.col("id").alias("c"), F.col("n_shingles").alias("nc"), F.col("comp").alias("cc"), F.col("bits").alias("cb"), F.col("at").alias("ac"))
    first = (F.col("n_shingles") < F.col("nc")) | ((F.col("n_shingles") == F.col("nc")) & (F.col("id") < F.col("c")))
    close = F.col("n_shingles") * 100 >= F.col("nc") * threshold
    rest = F.least(F.col("n_shingles") - F.col("at"), F.col("nc") - F.col("ac"))
    enough = rest * (100 + threshold) >= (F.col("n_shingles") + F.col("nc")) * threshold
    may = may_link("bits", "cb", "n_shingles", "nc", threshold) if bits is not None else F.lit(True)
    pairs = small.join(large, "shingle").where((F.col("comp") != F.col("cc")) & first & close & enough & may)
    up = F.col("id") < F.col("c")
    size_a, size_b = F.when(up, F.col("n_shingles")).otherwise(F.col("nc")), F.when(up, F.col("nc")).otherwise(F.col("n_shingles"))
    out = cut(pairs.select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b"), size_a.alias("na"), size_b.alias("nb")).distinct(), "rest-pairs")
    discard(common, listed, prefix)
    return out


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(id, comp) after links (a, b) between ids; only the components that links join are worked on."""
    for end in ("a", "b"):
        links = links.join(labels.select(F.col("id").alias(end), F.col("comp").alias("_c")), end).drop(end).withColumnRenamed("_c", end)
    found = components(links)
    moved = found.select(F.col("id").alias("comp"), F.col("comp").alias("to"))
    out = cut(labels.join(moved, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")), "components")
    discard(labels, *found._kithgraph_made)
    return out


def open_buckets(entries: DataFrame, labels: DataFrame, bits: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """(entries with their component, centres (band, key, c, nc, cc, cb) of buckets that hold several components).

    A turn has one order for all bands: copies of one text then meet the same few centres."""
    held = cut(entries.join(labels.join(bits, "id"), "id").select("band", "key", "id", "n_shingles", "comp", "bits"), "labelled")
    centre = F.min_by(F.struct(F.col("id").alias("c"), F.col("n_shingles").alias("nc"), F.col("comp").alias("cc"), F.col("bits").alias("cb")), F.xxhash64(F.lit(turn), "id"))
    each = held.groupBy("band", "key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), centre.alias("s"))
    return held, cut(each.where("x < y").select("band", "key", "s.*"), "centres")


def star_pairs(held: DataFrame, centres: DataFrame, threshold: int) -> DataFrame:
    """(a, b, na, nb): the members of open buckets with their centre, where components differ and sizes and parities allow a link."""
    close = F.least("n_shingles", "nc") * 100 >= F.greatest("n_shingles", "nc") * threshold
    up = F.col("id") < F.col("c")
    size_a, size_b = F.when(up, F.col("n_shingles")).otherwise(F.col("nc")), F.when(up, F.col("nc")).otherwise(F.col("n_shingles"))
    met = held.join(centres, ["band", "key"]).where((F.col("comp") != F.col("cc")) & close & may_link("bits", "cb", "n_shingles", "nc", threshold))
    return met.select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b"), size_a.alias("na"), size_b.alias("nb")).distinct()


def near_groups(docs: DataFrame, threshold: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row; links have a similarity of threshold hundredths at least.

    _kithgraph_made has the tables that it reads, to be discarded once it is read."""
    signed = cut(signatures(docs), "signatures")
    filled = signed.where("n_shingles > 0")
    classes = cut(filled.groupBy("set_hash", "n_shingles").agg(F.min("doc_id").alias("id")), "classes")
    # all rows of a class have its bands: those of its representative are taken
    reps = filled.join(classes.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").join(classes, ["set_hash", "n_shingles"])
    reps = reps.where(F.col("doc_id") == F.col("id")).dropDuplicates(["id", "set_hash"])
    entries = cut(reps.select("id", "n_shingles", "set_hash", F.posexplode("bands").alias("band", "key")), "keys")
    shared = cut(entries.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").select("band", "key"), "shared")
    alone, entries = entries, cut(entries.join(shared, ["band", "key"]), "entries")
    discard(alone, shared)
    # whole sets only of those that share a bucket with another
    asked = cut(entries.select("id", "set_hash").distinct(), "asked")
    ids = asked.select(F.col("id").alias("doc_id"))
    ids = F.broadcast(ids) if asked.count() <= BROADCAST_IDS else ids
    sets = cut(shingle_sets(docs.join(ids, "doc_id", "left_semi")).join(asked, ["id", "set_hash"], "left_semi").dropDuplicates(["id", "set_hash"]).select("id", "bits", "shingles"), "sets")

    def confirm(pairs: DataFrame) -> DataFrame:
        left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
        whole = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
        both = F.size(F.array_intersect("sa", "sb"))
        return cut(whole.where(both * 100 >= (F.col("na") + F.col("nb") - both) * threshold).select("a", "b"), "confirmed")

    labels = cut(entries.select("id", F.col("id").alias("comp")).distinct(), "components")
    tried, turn, goes_on = [], 0, True
    while True:
        held, centres = open_buckets(entries, labels, sets.select("id", "bits"), turn)
        if not goes_on:
            break
        pairs = cut(star_pairs(held, centres, threshold), "candidates")
        new = confirm(pairs)
        discard(held, centres)
        tried.append(pairs)
        found, turn = new.count(), turn + 1
        goes_on = found > 0 and found * STOP >= pairs.count()
        if found:
            labels = merged(labels, new)
        discard(new)
    rest = cut(held.join(centres.select("band", "key"), ["band", "key"]).select("id", "n_shingles", "comp").distinct(), "rest")
    discard(held, centres)
    if not rest.isEmpty():
        pairs = rest_pairs(rest, sets, threshold, sets.select("id", "bits"))
        new = confirm(pairs.join(reduce(DataFrame.unionByName, (t.select("a", "b") for t in tried)), ["a", "b"], "left_anti"))
        if not new.isEmpty():
            labels = merged(labels, new)
        discard(pairs, new)
    discard(entries, sets, asked, rest, *tried)
    ids = cut(classes.join(labels, "id", "left").select("set_hash", "n_shingles", F.coalesce("comp", "id").alias("component_id")), "class-components")
    out = signed.select("doc_id", "n_shingles", "set_hash").join(ids, ["set_hash", "n_shingles"], "left")
    comp = F.coalesce("component_id", F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", comp.alias("component_id"), F.col("doc_id").eqNullSafe(comp).alias("kept"))
    out._kithgraph_made = [signed, classes, labels, ids]
    return out


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_near_dedup": op5_near_dedup}
SQL: dict[str, str] = {
    "op5_near_dedup": r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s), x AS MATERIALIZED (SELECT doc_id, hash(unnest(s)) AS h FROM s),
p AS MATERIALIZED (SELECT a, b FROM (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL) JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * i >= 80 * (u.n + v.n - i)),
e AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
c(id, comp) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, c.comp FROM c JOIN e ON e.a = c.id WHERE c.comp < e.b)
SELECT doc_id, n AS n_shingles, min(comp) AS component_id, doc_id = min(comp) AS kept FROM n JOIN c ON c.id = doc_id GROUP BY doc_id, n"""
}
