"""Document fingerprints by I-Match with randomised lexicons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewright.llm.shared import position, settle

#: Terms in a smaller share of the documents than RARE, or in a larger one than COMMON, are left out.
RARE = 1 / 2048
COMMON = 1 / 20
#: Of each level's SUBSETS lexicon subsets, each holds one in so many terms.
LEVELS = (8, 32, 128, 1024)
#: Documents with at most so many lexicon terms are compared on that level.
LEVEL_TERMS = (12, 48, 300)
SUBSETS = 20
#: A lexicon has at most (mean distinct terms of a document) / RARE terms, whatever the number of documents;
#: up to this many it is broadcast.
BROADCAST_TERMS = 2_000_000
#: The mark of the whole lexicon among the subsets.
WHOLE = -1


def terms(text: Column) -> Column:
    """Distinct words in lower case: runs of letters, marks and digits."""
    cut = F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+")
    return F.array_remove(F.array_distinct(cut), "")


def lexicon(docs: DataFrame, rare: float = RARE, common: float = COMMON) -> DataFrame:
    """term (64-bit hash) and subsets: the terms whose share of documents lies in the band and that two documents
    hold, and the random subsets each is in (level * 32 + number), the whole lexicon first."""
    counted = docs.select(F.explode(terms(F.coalesce("text", F.lit("")))).alias("t")).groupBy(
        F.xxhash64("t").alias("term")).agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1))).first()[0]
    band = counted.where(F.col("df").between(max(2.0, rare * n), max(2.0, common * n)))
    drawn = [F.when(F.xxhash64("term", F.lit(32 * level + j)).bitwiseAND(F.lit(one_in - 1)) == 0, 32 * level + j)
             for level, one_in in enumerate(LEVELS) for j in range(SUBSETS)]
    return band.select("term", F.concat(F.array(F.lit(WHOLE)), F.array_compact(F.array(*drawn))).alias("subsets"))


def _level(n_terms: Column) -> Column:
    return reduce(lambda rest, k: F.when(n_terms <= LEVEL_TERMS[k], k).otherwise(rest),
                  reversed(range(len(LEVEL_TERMS))), F.lit(len(LEVEL_TERMS)))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal codes among the subsets that hold terms of either, on the level of the one with more terms
    (the one below it if the other has not got it); 1 for equal whole hashes, 0 without a common level."""
    high, low = F.greatest(_level(a["n"]), _level(b["n"])), F.least(_level(a["n"]), _level(b["n"]))
    level = F.when(high - low <= 1, high).otherwise(high - 1)
    on_level = [F.filter(x["codes"], lambda c: F.shiftright(c, 21) == level) for x in (a, b)]
    equal = F.size(F.array_intersect(*on_level))
    either = F.size(F.array_union(*[F.transform(x, lambda c: F.shiftright(c, 16)) for x in on_level]))
    share = F.when((either > 0) & (high - low <= 2), equal / either).otherwise(F.lit(0.0))
    return F.when(a["whole"] == b["whole"], F.lit(1.0)).otherwise(share)


def written(f: Column) -> Column:
    """The fingerprint as text: hash of all lexicon terms, their number, and subset and code of each kept subset."""
    codes = F.concat_ws("", F.transform(f["codes"], lambda c: F.lpad(F.lower(F.hex(c)), 6, "0")))
    return F.concat_ws(":", F.lower(F.hex(f["whole"])), f["n"].cast("string"), codes)


def fingerprints(texts: DataFrame, keys: list[str], known: DataFrame) -> DataFrame:
    """``keys`` and print: n (lexicon terms of the text), whole (their hash; without any,
    that of all words) and codes (subset << 16 | 16 bits of the hash of its terms in the text) of the subsets on the
    document's level and the two beside it.

    Hashes of the distinct terms are combined by exclusive or, which gives what sorting them first would and
    gathers no lists. Keys must be distinct; ``texts`` partitioned by keys is not shuffled.
    """
    few = known.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    # what is computed from the whole list comes before the list is taken apart
    whole_texts = texts.select(*keys, terms(F.col("text")).alias("_terms")).withColumn(
        "_all", F.xxhash64(F.sort_array("_terms")))
    rows = whole_texts.select(*keys, "_all", F.posexplode_outer("_terms").alias("_pos", "_t"))
    first = F.coalesce("_pos", F.lit(0)) == 0
    met = (rows.withColumn("term", F.xxhash64("_t")).join(F.broadcast(known) if few else known, "term", "left")
           .where(first | F.col("subsets").isNotNull())
           .select(*keys, "_all", "term", F.explode_outer("subsets").alias("_subset")))
    summed = met.groupBy(*keys, F.coalesce("_subset", F.lit(WHOLE)).alias("_subset")).agg(
        F.max("_all").alias("_all"), F.sum(F.col("_subset").isNotNull().cast("long")).alias("_n"),
        F.bit_xor(F.when(F.col("_subset").isNotNull(), F.xxhash64("term", F.lit(7)))).alias("_hash"))
    whole = F.col("_subset") == WHOLE
    code = F.shiftleft("_subset", 16) + F.col("_hash").bitwiseAND(F.lit(0xFFFF)).cast("int")
    listed = summed.groupBy(*keys).agg(
        F.sum(F.when(whole, F.col("_n"))).alias("_n"), F.max(F.when(whole, F.coalesce("_hash", "_all"))).alias("_whole"),
        F.sort_array(F.collect_list(F.when(~whole, code))).alias("_codes"))
    kept = F.filter("_codes", lambda c: F.abs(F.shiftright(c, 21) - _level(F.col("_n"))) <= 1)
    return listed.select(*keys, F.struct(F.col("_n").alias("n"), F.col("_whole").alias("whole"), kept.alias("codes")).alias("print"))


def document_prints(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), fingerprint: the plain use, without edits; null texts are empty."""
    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    prints = fingerprints(named.dropDuplicates(["doc_id", "h"]), ["doc_id", "h"], settle(lexicon(docs), "lexicon"))
    return prints.select("doc_id", "h", written(F.col("print")).alias("fingerprint"))


def neighbours(light: DataFrame) -> DataFrame:
    """The rows with next_id, next_h: each document and the one after it by doc_id, the first after the last."""
    placed = settle(position(light, ["id", "h"], "place", "fingerprint-order"), "fingerprint-places")
    total = placed.count()
    if not total:
        return placed.select("id", "h", "n_chars", "n_rows", F.col("id").alias("next_id"), F.col("h").alias("next_h"))
    after = placed.select(((F.col("place") + total - 1) % total).alias("place"), F.col("id").alias("next_id"),
                          F.col("h").alias("next_h"))
    return placed.join(after, "place").select("id", "h", "n_chars", "n_rows", "next_id", "next_h")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of whole texts, and how alike they are to an edited text and to the next document.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as
    many of the next document in doc_id order (null first). Null texts are empty. A text
    without lexicon terms has a fingerprint of all its words. Rows with equal doc_id and
    text are one document and come out as often as they occur; an empty table gives no
    rows; other columns are ignored. Texts are shuffled once; only the pieces that move
    to another document are shuffled besides.
    """
    keys = ["id", "h"]
    # null is smallest: it takes the place of a number that no table uses
    named = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"),
                        F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    known = settle(lexicon(docs), "lexicon")
    light = named.select("id", "h", F.length("text").cast("long").alias("n_chars")).groupBy(*keys, "n_chars").agg(
        F.count(F.lit(1)).alias("n_rows"))
    order = settle(neighbours(light), "fingerprint-neighbours")
    quarter = F.floor(F.col("n_chars") / 4).cast("int")

    bodies = named.select("id", "h", "text")
    wanted = order.select(F.col("next_id").alias("id"), F.col("next_h").alias("h"), F.col("id").alias("to_id"),
                          F.col("h").alias("to_h"), quarter.alias("n"))
    pieces = (bodies.join(wanted, keys).select("to_id", "to_h", F.substring(F.col("text"), F.lit(1), F.col("n")).alias("piece"))
              .dropDuplicates(["to_id", "to_h"]).select(F.col("to_id").alias("id"), F.col("to_h").alias("h"), "piece"))
    kept = F.substring(F.col("text"), F.lit(1), (F.length("text") - F.floor(F.length("text") / 4)).cast("int"))
    both = bodies.join(pieces, keys).dropDuplicates(keys).select(*keys, "text", F.concat(kept, "piece").alias("edited"))
    sides = both.select(*keys, F.inline(F.array(
        F.struct(F.lit(0).alias("side"), F.col("text"), F.lit(None).cast("binary").alias("sha")),
        F.struct(F.lit(1).alias("side"), F.col("edited").alias("text"), F.unhex(F.sha2("edited", 256)).alias("sha")))))
    prints = fingerprints(sides, [*keys, "side", "sha"], known)
    own = settle(prints.groupBy(*keys).agg(
        F.first("sha", ignorenulls=True).alias("sha"),
        F.first(F.when(F.col("side") == 0, F.col("print")), ignorenulls=True).alias("print"),
        F.first(F.when(F.col("side") == 1, F.col("print")), ignorenulls=True).alias("edited_print")), "fingerprints")
    following = own.select(F.col("id").alias("next_id"), F.col("h").alias("next_h"), F.col("print").alias("next_print"))
    ahead = order.join(following, ["next_id", "next_h"]).select(*keys, "n_chars", "n_rows", "next_print")
    whole = own.join(ahead, keys)
    return whole.select(
        F.when(F.col("id") != -(1 << 63), F.col("id")).alias("doc_id"), "n_chars",
        F.lower(F.hex("sha")).alias("edited_sha256"),
        written(F.col("print")).alias("fingerprint"), written(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
        F.explode(F.sequence(F.lit(1).cast("long"), "n_rows")).alias("_row")).drop("_row")
