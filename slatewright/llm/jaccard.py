"""Exact Jaccard self-join of word n-gram sets: size-aware, heavy and light.

Small (light) sets enumerate the subsets of the sizes that a linked partner must share:
two sets of sizes a and b link exactly if they hold one equal subset of need(a, b)
shingles. Large (heavy) sets are found by scanning inverted lists of their rarest
shingles: linked sets share one of the first a - need + 1 in any common order. The
boundary is the size up to which subsets cost less than lists, from the sizes' counts.

Equal sets are one class. Classes that a list has in one component need no further
comparison, so a group of copies costs its size and not its square.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewright.llm import batches as B
from slatewright.llm.components import connected
from slatewright.llm.shared import bring, discard, settle, shared_path

PERCENT = 85
SHINGLE = 4
#: A set with more subsets than this is always heavy.
MOST_SUBSETS = 400
#: Shingles whose hash is below this share of all get their number of documents counted.
COUNTED = 0.5
SKETCH_WORDS = 8
SALT_ROWS = 4096


def need(a: int, b: int, percent: int = PERCENT) -> int:
    """The least common size with which sets of sizes a and b link: 100 c >= percent (a + b - c)."""
    return -(-percent * (a + b) // (100 + percent))


def partner_sizes(a: int, percent: int = PERCENT) -> range:
    return range(-(-percent * a // 100), 100 * a // percent + 1)


def subsets(a: int, percent: int = PERCENT) -> int:
    """How many subsets a light set of this size enumerates."""
    return sum(math.comb(a, need(a, b, percent)) for b in partner_sizes(a, percent) if need(a, b, percent) <= min(a, b))


def most_light(percent: int = PERCENT) -> int:
    size = 1
    while size < 64 and subsets(size + 1, percent) <= MOST_SUBSETS:
        size += 1
    return size


def _shingle_hashes(words: np.ndarray, word_ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document, by (document, hash); documents' ends."""
    starts = np.concatenate([np.zeros(1, np.int64), word_ends[:-1]])
    lens = word_ends - starts
    _, left = B.per_element(word_ends)
    at = np.flatnonzero(left >= width)
    hashes = B.fingerprints(words, at, width)
    doc = np.searchsorted(word_ends, at, "right")
    short = np.flatnonzero((lens > 0) & (lens < width))
    if len(short):  # the whole sequence as one, with its length
        own = [B.fingerprints(words[:word_ends[d]], np.array([starts[d]]), int(lens[d]))[0] + np.uint64(lens[d]) for d in short]
        hashes, doc = np.concatenate([hashes, np.array(own, np.uint64)]), np.concatenate([doc, short])
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(len(word_ends)), "right")


def _lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


#: Shingles whose documents leave a batch together.
SLICE_SHINGLES = 1 << 16
_SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("class_a", pa.int64()), ("class_b", pa.int64()), ("rare", pa.int32()),
                   ("sketch", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64())), ("shingles", pa.list_(pa.int64()))])
SETS = ("doc_id bigint, n_shingles bigint, class_a bigint, class_b bigint, rare int, sketch array<bigint>, "
        "prefix array<bigint>, shingles array<bigint>")


def shingle_sets(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row a document: its set's size and 128-bit class, and for candidates what the join needs.

    prefix: the shingles of the first size - need + 1 in the order (counted and rare
    first) that occur in another document as well, and for light sets none; shingles:
    the whole set if it has such a prefix or is light, else null; rare: how many counted
    shingles occur nowhere else; sketch: parities of the set's hashes.
    """
    path = shared_path(docs.sparkSession, "shingles")
    stored = B.store(docs, "shingles", path=path)
    n_buckets = B.bucket_count(stored, 8 * COUNTED / 6)
    limit = np.uint64(int(COUNTED * (1 << 64)) - 1)
    light = most_light(percent)

    def sets_of(ends: np.ndarray, data: np.ndarray):
        low = _lower(data)
        begin, stop, word_ends = B.words_of(low, ends)
        hashes, set_ends = _shingle_hashes(B.word_hashes(low, begin, stop), word_ends, width)
        counted = hashes <= limit
        keys, bounds, own, _ = B.sorted_keys(hashes[counted], B.scrambled(hashes[counted]), n_buckets)
        return hashes, set_ends, counted, keys, bounds, own

    def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _ids, ends, data, _ in B.each_batch(rows):
            _, _, _, keys, bounds, own = sets_of(ends, data)
            yield B.slices(batch, keys, bounds, np.minimum(np.bincount(own, minlength=len(keys)), 255).astype(np.uint8))

    def describe(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, ends, data, answers in B.each_batch(rows):
            hashes, set_ends, counted, _, bounds, own = sets_of(ends, data)
            known = np.full(len(hashes), 256, np.int64)
            known[counted] = B.read_answers(answers, bounds, bits=False)[own]
            out: dict[str, list] = {name: [] for name in _SETS.names}
            a = held = 0
            for doc_id, b in zip(ids, set_ends.tolist(), strict=True):
                if held > SLICE_SHINGLES:  # documents leave in slices, so that a batch's sets aren't held twice
                    yield pa.RecordBatch.from_pydict(out, schema=_SETS)
                    out, held = {name: [] for name in _SETS.names}, 0
                own_set, df = hashes[a:b], known[a:b]
                n, a = b - a, b
                order = np.lexsort((own_set, df))
                first = order[:n - need(n, _least_partner(n, percent), percent) + 1] if n else order
                prefix = own_set[first[df[first] > 1]]
                whole = len(prefix) > 0 or 0 < n <= light
                mixed = B.scrambled(own_set + np.uint64(0x9E3779B97F4A7C15))
                out["doc_id"].append(doc_id)
                out["n_shingles"].append(n)
                out["class_a"].append(int(np.bitwise_xor.reduce(mixed, initial=np.uint64(0)).astype(np.int64)))
                out["class_b"].append(int(np.add.reduce(own_set, initial=np.uint64(0), dtype=np.uint64).astype(np.int64)))
                out["rare"].append(int((df == 1).sum()))
                out["sketch"].append(_sketch(mixed) if whole else None)
                out["prefix"].append(prefix.astype(np.int64) if whole else None)
                out["shingles"].append(own_set.astype(np.int64) if whole else None)
                held += n
            yield pa.RecordBatch.from_pydict(out, schema=_SETS)

    replies = B.ask(stored.mapInArrow(send, B.SENT), n_buckets, B.holders, ids_type="uint8")
    found = settle(B.answered(stored, replies).mapInArrow(describe, SETS), "shingle-sets")
    discard(docs.sparkSession, path)  # the batches are answered
    return found


def _least_partner(n: int, percent: int) -> int:
    """The smallest size of a linked partner: with it the needed overlap is least."""
    return -(-percent * n // 100)


def _sketch(mixed: np.ndarray) -> np.ndarray:
    """Parity of the set's hashes in 64 * SKETCH_WORDS bits: two sketches differ in at most as many bits as the
    sets differ in shingles."""
    bit = (mixed >> np.uint64(7)) % np.uint64(64 * SKETCH_WORDS)
    odd = np.bincount(bit.astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _needed(a: Column, b: Column, percent: int) -> Column:
    return F.ceil((a + b) * percent / (100 + percent))


def _may_link(x: str, y: str, percent: int) -> Column:
    """What every linked pair fulfils, by sizes, rare shingles and sketches."""
    col = lambda side, name: F.col(f"{side}.{name}")
    a, b = col(x, "n_shingles"), col(y, "n_shingles")
    wanted = _needed(a, b, percent)
    apart = sum((F.bit_count(F.get(col(x, "sketch"), k).bitwiseXOR(F.get(col(y, "sketch"), k)))
                 for k in range(SKETCH_WORDS)), F.lit(0))
    return ((F.least(a - col(x, "rare"), b - col(y, "rare")) >= wanted)
            & (a * 100 >= b * percent) & (b * 100 >= a * percent)
            & (a + b - 2 * wanted >= apart))


def _verified(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (x, y) of classes whose sets link, by intersecting them."""
    sets = classes.select("class_id", "n_shingles", "shingles")
    left = pairs.join(sets.select(F.col("class_id").alias("x"), F.col("n_shingles").alias("nx"), F.col("shingles").alias("sx")), "x")
    both = left.join(sets.select(F.col("class_id").alias("y"), F.col("n_shingles").alias("ny"), F.col("shingles").alias("sy")), "y")
    common = F.size(F.array_intersect("sx", "sy"))
    return both.where(common * 100 >= (F.col("nx") + F.col("ny") - common) * percent).select("x", "y")


def _light_links(classes: DataFrame, boundary: int, percent: int) -> DataFrame:
    """Links between light classes. Sets of sizes lo and hi that hold the same subset of need(lo, hi) shingles
    link; in such a group all of one size link to the first of the other."""

    def enumerate_subsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for class_id, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = sorted(listed)
                n = len(own)
                values = np.array(own, np.int64).view(np.uint64)
                rows: list[tuple[int, int, int]] = []
                for b in partner_sizes(n, percent):
                    size = need(n, b, percent)
                    if size <= min(n, b) and b <= boundary:
                        total = np.add.reduce(values, dtype=np.uint64)
                        mixed = np.bitwise_xor.reduce(B.scrambled(values))
                        single = B.scrambled(values)
                        for missing in combinations(range(n), n - size):
                            gone = list(missing)
                            rest = np.array([total, mixed])
                            rest[:1] -= np.add.reduce(values[gone], dtype=np.uint64, initial=np.uint64(0))
                            rest[1:] ^= np.bitwise_xor.reduce(single[gone], initial=np.uint64(0))
                            rows.append((min(n, b) << 8 | max(n, b), *rest.view(np.int64).tolist()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([class_id] * len(rows), pa.int64()), pa.array([n] * len(rows), pa.int32()),
                     *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64())))],
                    names=["class_id", "n", "sizes", "sum", "mix"])

    light = classes.where((F.col("n_shingles") > 0) & (F.col("n_shingles") <= boundary)).select("class_id", "shingles")
    keys = light.mapInArrow(enumerate_subsets, "class_id bigint, n int, sizes int, sum bigint, mix bigint")
    low = F.col("n") == F.shiftright("sizes", 8)
    high = F.col("n") == F.col("sizes").bitwiseAND(255)
    heads = (keys.groupBy("sizes", "sum", "mix")
             .agg(F.min(F.when(low, F.col("class_id"))).alias("first_low"), F.min(F.when(high, F.col("class_id"))).alias("first_high"),
                  F.min("class_id").alias("least"), F.max("class_id").alias("most"))
             .where("least < most AND first_low IS NOT NULL AND first_high IS NOT NULL"))
    met = keys.join(heads, ["sizes", "sum", "mix"])
    other = F.when(low, F.col("first_high")).otherwise(F.col("first_low"))
    return met.select(F.least("class_id", other).alias("x"), F.greatest("class_id", other).alias("y")).where("x < y").distinct()


def boundary_by_cost(classes: DataFrame, postings: DataFrame, percent: int = PERCENT) -> int:
    """The size up to which enumerating subsets costs less than scanning lists.

    A light set costs its subsets; a heavy one its list entries times the mean length of a
    list. Both are summed over the sizes that occur; sizes are few, so the driver adds up.
    """
    top = most_light(percent)
    sizes = {r.n_shingles: r.n for r in classes.where(F.col("n_shingles").between(1, top)).groupBy("n_shingles").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    lists = postings.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("shingle").alias("lists")).first()
    mean = lists["rows"] / max(1, lists["lists"])
    entries = lambda s: s - need(s, _least_partner(s, percent), percent) + 1
    cost = lambda b: sum(n * (subsets(s, percent) if s <= b else 0) for s, n in sizes.items()) + sum(
        n * entries(s) * mean for s, n in sizes.items() if s >= _least_partner(b + 1, percent))
    return min(range(top + 1), key=lambda b: (cost(b), b))


def linked_components(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id: the smallest doc_id that links lead to.

    Links join documents whose sets of ``width``-word shingles (A-Z in lower case) have
    100 * intersection >= percent * union. Documents with fewer words have their whole
    sequence as one shingle; those without words, with empty or null text, are linked with
    nothing. Rows with equal doc_id keep their own sets and share the id; rows with null doc_id
    have no id to link by and get a null component. An empty table gives no rows.
    """
    sets = shingle_sets(docs, width, percent)
    classes = settle(
        sets.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("class_a", "class_b").agg(
            F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("rows"), F.first("n_shingles").alias("n_shingles"), F.first("rare").alias("rare"),
            F.first("sketch").alias("sketch"), F.first("prefix").alias("prefix"), F.first("shingles").alias("shingles")),
        "shingle-classes")
    links = settle(_links(classes, percent), "links")
    # rows that share a doc_id tie their classes together
    own = ["class_a", "class_b"]
    with_set = sets.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "n_shingles", *own)
    ids = classes.select(*own, "class_id", "rows")
    shared = with_set.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select("doc_id")
    tied = with_set.select("doc_id", *own).distinct().join(shared, "doc_id")
    ties = bring(tied, own, ids, "rows", ["class_id"]).where("class_id <> doc_id").select(
        F.least("doc_id", "class_id").alias("x"), F.greatest("doc_id", "class_id").alias("y"))
    label = connected(links.union(ties))
    # labels meet classes, one row each, and then the classes' documents, of which one class may have a third
    labelled = ids.join(label.select(F.col("node").alias("class_id"), "component"), "class_id", "left").select(
        *own, "rows", F.coalesce("component", "class_id").alias("component_id"))
    found = bring(with_set, own, labelled, "rows", ["component_id"]).select("doc_id", "n_shingles", "component_id")
    alone = sets.where("n_shingles = 0 OR doc_id IS NULL")
    alone = alone.join(label.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    return found.unionByName(alone.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")))


def _links(classes: DataFrame, percent: int) -> DataFrame:
    """Links between classes that connect what all links connect."""
    entries = classes.where("size(prefix) > 0").select(
        "class_id", "n_shingles", "rare", "sketch", F.explode("prefix").alias("shingle"))
    several = entries.groupBy("shingle").agg(F.count(F.lit(1)).alias("list_rows")).where("list_rows > 1")
    postings = settle(entries.join(several, "shingle"), "postings")
    boundary = boundary_by_cost(classes, postings, percent)
    light = settle(_light_links(classes, boundary, percent), "light-links")
    heavy = postings.where(F.col("n_shingles") >= _least_partner(boundary + 1, percent))

    # first every set of a list against its most central one: the one with the fewest rare shingles
    centre = heavy.groupBy("shingle").agg(F.min(F.struct(
        (F.col("rare") / F.col("n_shingles")).alias("share"), "class_id", "n_shingles", "rare", "sketch")).alias("c"))
    star = (heavy.alias("m").join(centre.select("shingle", "c.class_id", "c.n_shingles", "c.rare", "c.sketch").alias("r"), "shingle")
            .where((F.col("m.class_id") != F.col("r.class_id")) & _may_link("m", "r", percent))
            .select(F.least("m.class_id", "r.class_id").alias("x"), F.greatest("m.class_id", "r.class_id").alias("y")).distinct())
    star_links = settle(_verified(star, classes, percent), "star-links")

    # then the pairs of a list that are not connected yet: those outside the centre's component meet all
    label = connected(light.union(star_links))
    named = lambda df: df.join(label.select(F.col("node").alias("class_id"), "component"), "class_id", "left").withColumn(
        "component", F.coalesce("component", "class_id"))
    placed = settle(named(heavy), "placed")
    main = placed.groupBy("shingle").agg(
        F.min(F.struct((F.col("rare") / F.col("n_shingles")).alias("share"), "class_id", "component")).alias("c"),
        F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select(
        "shingle", F.col("c.component").alias("main"))
    mixed = placed.join(main, "shingle")
    salts = F.ceil(F.col("list_rows") / SALT_ROWS).cast("int")
    home = mixed.withColumn("salt", F.pmod(F.xxhash64("class_id"), salts).cast("int"))
    guests = mixed.where("component <> main").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    x, y = guests.alias("g"), home.alias("h")
    rest = x.join(y, (F.col("g.shingle") == F.col("h.shingle")) & (F.col("g.salt") == F.col("h.salt"))
                  & (F.col("g.component") != F.col("h.component")) & _may_link("g", "h", percent))
    rest = rest.select(F.least("g.class_id", "h.class_id").alias("x"), F.greatest("g.class_id", "h.class_id").alias("y")).distinct()
    return light.union(star_links).union(_verified(rest, classes, percent))
