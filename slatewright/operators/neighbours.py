"""Session-based nearest neighbours as joins, aggregates and top-n cuts.

What is learned from the training log is a :class:`slatewright.operators.index.NeighbourIndex`:
numbered lists of the sessions of each item, and the items of each session. A prompt whose items'
lists are short together meets all their sessions. Otherwise only what the sample needs is read:

* random: the case draws (item, number) pairs by hash, rejects repeats and sessions it was to reach
  by a rarer item, and so gets a uniform sample of its own;
* recent: lists are numbered by recency, so the first ``sample_size`` of each suffice;
* greedy idf: rare items' lists are read whole, the item that overfills the sample is drawn from;
* idf: rare items' lists are read whole; hot items' only for prompts that a session with hot
  items alone could still enter, and then once for each set of hot items, as all its sessions
  score alike.

What the sampled sessions share with the prompt is then taken from the sessions' own items.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slatewright.functions.decay import NEIGHBOUR_FLOOR, check_decay, decay_weight
from slatewright.functions.hashing import seeded_key
from slatewright.functions.similarity import MEASURES, measure
from slatewright.functions.vectors import cosine, dot
from slatewright.operators.blocks import held_items
from slatewright.operators.draws import drawn_places
from slatewright.operators.embedding import session_vectors
from slatewright.operators.index import NeighbourIndex, described_weights, inverse_frequency, session_item_weights, successors
from slatewright.operators.pairs import held_similarity
from slatewright.operators.ranking import rank_within, spread, top_n
from slatewright.session import cut_lineage

__all__ = ["NeighbourIndex", "NeighbourOptions", "described_weights", "inverse_frequency", "recommend_neighbours",
           "recommend_one", "session_item_weights", "successors"]

SAMPLINGS = ("random", "recent", "idf", "idf_greedy")

#: Items of a prompt that a session's items are looked up in at once.
LOOKUP = 1024
#: A case's hot lists are read whole up to so many times the length of its light lists.
HOT_SHARE = 1
#: Items that follow a case's last one which are looked up in its task; longer lists are joined.
FOLLOWERS = 4096


@dataclass(frozen=True)
class NeighbourOptions:
    """All switches of the neighbour recommender, checked on construction."""

    k: int = 100
    sample_size: int = 500
    sampling: str = "random"
    seed: int = 42
    similarity: str = "cosine"
    decay: str | None = None
    train_decay: str | None = None
    last_n_items: int | None = None
    filter_prompt_items: bool = True
    sequential_weighting: bool = False
    sequential_filter: bool = False
    idf_weighting: bool = False
    use_item_embeddings: bool = False
    prompt_strategy: str = "last"
    train_strategy: str = "last"
    hot_df: int = 50_000
    draw_factor: int = 8  #: lists longer than this many samples together are drawn from, not read whole

    def __post_init__(self):
        if self.sample_size < 1:
            raise ValueError(f"sample_size must be a positive integer, got {self.sample_size}")
        if not 1 <= self.k <= self.sample_size:
            raise ValueError(f"k must lie between 1 and sample_size, got {self.k}")
        if self.draw_factor < 1:
            raise ValueError(f"draw_factor must be a positive integer, got {self.draw_factor}")
        if self.sampling not in SAMPLINGS:
            raise ValueError(f"unknown sampling {self.sampling!r}; choose one of {SAMPLINGS}")
        if self.similarity not in ("cosine", "dot", *MEASURES):
            raise ValueError(f"unknown similarity {self.similarity!r}")
        check_decay(self.decay)
        check_decay(self.train_decay)
        if self.decay is not None and self.similarity not in ("cosine", "dot"):
            raise ValueError("a decay needs the cosine or dot similarity")
        if self.use_item_embeddings and self.similarity not in ("cosine", "dot"):
            raise ValueError("embeddings need the cosine or dot similarity")
        if (self.prompt_strategy == "concat") != (self.train_strategy == "concat"):
            raise ValueError("concat must be used on both sides or on neither")
        if self.last_n_items is not None and self.last_n_items < 1:
            raise ValueError("last_n_items must be positive")

    def model_name(self) -> str:
        """Name of the variant the switches describe."""
        if self.use_item_embeddings:
            return "SKNN_EMB"
        if self.sequential_filter:
            return "SF-SKNN"
        if self.sequential_weighting:
            return "S-SKNN"
        return "V-SKNN" if self.decay is not None else "SKNN"


def normalised_prompts(prompts: DataFrame, train: DataFrame,
                       last_n_items: int | None = None) -> DataFrame:
    """``case_id, item_id, pos, n``: last items, first occurrences, known items, renumbered."""
    rows = prompts.select("case_id", "pos", "item_id")
    if last_n_items is not None:
        lengths = rows.groupBy("case_id").agg(F.max("pos").alias("_n"))
        rows = rows.join(lengths, "case_id").where(F.col("pos") > F.col("_n") - last_n_items)
    firsts = rows.groupBy("case_id", "item_id").agg(F.min("pos").alias("_old"))
    known = firsts.join(train.select("item_id").distinct(), "item_id", "left_semi")
    lengths = prompts.groupBy("case_id").agg(F.max("pos").alias("_rows"))
    numbered = rank_within(known, ["case_id"], [F.col("_old")], sizes=lengths).drop("_old")
    sizes = numbered.groupBy("case_id").agg(F.max("pos").alias("n"))
    return numbered.join(sizes, "case_id")


def prompt_vectors(prompt_items: DataFrame, decay: str | None) -> DataFrame:
    """Adds ``pw`` (decayed value of the item) and ``p_norm``."""
    weighted = prompt_items.withColumn(
        "pw", decay_weight(decay, F.col("pos"), F.col("n"), NEIGHBOUR_FLOOR))
    norms = weighted.groupBy("case_id").agg(
        F.sqrt(F.sum(F.col("pw") * F.col("pw"))).alias("p_norm"))
    return spread(weighted.join(norms, "case_id"), "case_id")


def _sample_order(options: NeighbourOptions):
    """Of sessions in a case; ``draw`` is null for those that were not drawn."""
    shuffle = [F.asc_nulls_last("draw"), seeded_key(options.seed, "case_id", "session_id"), F.col("session_id")]
    return {
        "random": shuffle,
        "recent": [F.desc("s_end"), F.desc("session_id")],
        "idf": [F.desc("idf_sum"), F.col("session_id")],
        "idf_greedy": [F.col("best"), *shuffle],
    }[options.sampling]


def _item_rank(df="df", item="item_id"):
    """The rarity of an item as one sortable number: frequency, then item id."""
    rank = F.col(df).cast("decimal(18,0)") * F.lit("1" + "0" * 19).cast("decimal(20,0)") + F.col(item)
    return rank.cast("decimal(38,0)")


def _pair_aggregates(rows: DataFrame, *more: str) -> DataFrame:
    """One row per (case, session, ``more``) from rows of shared items.

    ``best`` is the rarest shared item. Every aggregate is of fixed width, so Spark hashes instead of sorting.
    """
    pairs = rows.groupBy("case_id", "session_id", *more).agg(
        F.count(F.lit(1)).alias("both"), F.sum(F.col("pw") * F.col("w")).alias("dot"),
        F.sum("idf").alias("idf_sum"), F.max("pos").alias("last_pos"), F.min(_item_rank()).alias("best"),
        *[F.max(c).alias(c) for c in ("n", "p_norm", "s_norm", "s_size", "s_end")])
    return pairs.withColumn("idf_sum", F.round("idf_sum", 9))


def overlaps(keys: DataFrame, scored: DataFrame, index: NeighbourIndex, *more: str) -> DataFrame:
    """What the prompts and sessions of ``keys`` (case_id, session_id, ``more``) share.

    The sessions' items lie by session. They go to the case's task as one row a key, and are met there with the
    prompt's items; a prompt of more than LOOKUP items is met in parts. Spark takes a gathered list for one item, so it
    would broadcast far larger ones than it means to.
    """
    longest = scored.agg(F.max("n")).first()[0] or 1
    parts = -(-longest // LOOKUP)
    split = [] if parts == 1 else [F.pmod(F.xxhash64("item_id"), F.lit(parts)).alias("_part")]
    theirs = index.cells.groupBy("session_id", *split).agg(
        F.collect_list(F.struct("item_id", "w")).alias("_cells"), *[F.max(c).alias(c) for c in ("s_norm", "s_size", "s_end")])
    # plain arrays are half as wide as one of pairs
    theirs = theirs.withColumn("_items", F.col("_cells.item_id")).withColumn("_weights", F.col("_cells.w")).drop("_cells")
    ours = scored.groupBy("case_id", *split).agg(
        F.collect_list(F.struct("item_id", "pos", "pw", "idf", "df")).alias("_prompt"), *[F.max(c).alias(c) for c in ("n", "p_norm")])
    met = keys.join(theirs.hint("merge"), "session_id").join(
        ours.withColumn("_ids", F.col("_prompt.item_id")).hint("shuffle_hash"), ["case_id"] if parts == 1 else ["case_id", "_part"])
    kept = ["case_id", "session_id", *more, "n", "p_norm", "s_norm", "s_size", "s_end"]
    items = met.withColumn("item_id", F.explode(F.array_intersect("_ids", "_items")))
    place = {c: F.array_position(c, F.col("item_id")).cast("int") for c in ("_ids", "_items")}
    shared = items.select(*kept, F.element_at("_weights", place["_items"]).alias("w"),
                          F.element_at("_prompt", place["_ids"]).alias("_p"))
    return _pair_aggregates(shared.select(*kept, "w", "_p.*"), *more)


def _whole_pairs(scored: DataFrame, index: NeighbourIndex) -> DataFrame:
    """All pairs of a case and a session that share an item, from the items' whole lists.

    Rows of shared items are shuffled once, by case, where they are summed up and, later, ranked. Their number is the
    sum of the lists' lengths; by their bytes, which compress well, Spark would give a task many times TASK_ROWS."""
    n_rows = scored.agg(F.sum("df")).first()[0] or 0
    met = scored.join(index.postings.drop("number"), "item_id")
    return _pair_aggregates(spread(met, "case_id", rows=n_rows))


def sampled_pairs(prompt_items: DataFrame, index: NeighbourIndex, options: NeighbourOptions) -> DataFrame:
    """Sampled (case, session) pairs with their overlap statistics.

    Columns: ``both, dot, idf_sum, last_pos`` over the shared items, and the sizes and
    norms of both sides.
    """
    scored = prompt_items.join(index.items, "item_id")
    if options.sampling == "idf":
        return _idf_pairs(scored, index, options)
    at_most = options.draw_factor * options.sample_size
    # a greedy sample draws from a single list only, the others' lists are read whole
    reach = F.max("df") if options.sampling == "idf_greedy" else F.sum("df")
    totals = scored.groupBy("case_id").agg(reach.alias("_total"))
    marked = cut_lineage(scored.join(totals, "case_id"))
    long = marked.where(F.col("_total") > at_most).drop("_total")

    def sampled(pairs: DataFrame) -> DataFrame:
        return top_n(pairs, ["case_id"], _sample_order(options), options.sample_size, name="sample_rank").drop("draw")

    short = marked.where(F.col("_total") <= at_most).drop("_total")
    whole = sampled(_whole_pairs(short, index).withColumn("draw", F.lit(None).cast("long")))
    if long.isEmpty():
        return whole
    few = {"random": _drawn_pairs, "recent": _recent_pairs, "idf_greedy": _greedy_pairs}[options.sampling]
    return whole.unionByName(sampled(few(long, index, options)))


def _recent_pairs(scored: DataFrame, index: NeighbourIndex, options: NeighbourOptions) -> DataFrame:
    lists = index.postings.where(F.col("number") <= options.sample_size).select("item_id", "session_id", "s_end")
    seen = (scored.select("case_id", "item_id").join(lists, "item_id").select("case_id", "session_id", "s_end")
            .repartition("case_id").distinct())
    latest = top_n(seen, ["case_id"], _sample_order(options), options.sample_size, name="_r").select("case_id", "session_id")
    return overlaps(latest, scored, index).withColumn("draw", F.lit(None).cast("long"))


def _drawn_pairs(scored: DataFrame, index: NeighbourIndex, options: NeighbourOptions) -> DataFrame:
    """A uniform sample of the sessions that share an item with the case, drawn from its items' lists laid end to end."""
    return _draws(scored, scored.select("case_id", "item_id", "df"), index, options)


def _greedy_pairs(scored: DataFrame, index: NeighbourIndex, options: NeighbourOptions) -> DataFrame:
    """Sessions of the rare items, and draws from the first item that is sure to overfill the sample."""
    overfull = scored.where(F.col("df") > options.draw_factor * options.sample_size)
    first = overfull.groupBy("case_id").agg(F.min(_item_rank()).alias("_stop"))
    marked = scored.join(first, "case_id", "left")
    rare = marked.where(F.col("_stop").isNull() | (_item_rank() < F.col("_stop"))).select("case_id", "item_id", "df")
    seen = rare.join(index.postings.select("item_id", "session_id"), "item_id").repartition("case_id")
    # the rarest shared item of these sessions is among the items read, so they are ranked before their overlaps are made
    best = seen.groupBy("case_id", "session_id").agg(F.min(_item_rank()).alias("best")).withColumn("draw", F.lit(None).cast("long"))
    enough = top_n(best, ["case_id"], _sample_order(options), options.sample_size, name="_r").select("case_id", "session_id")
    read = overlaps(enough, scored, index).withColumn("draw", F.lit(None).cast("long"))
    last = marked.where(_item_rank() == F.col("_stop")).select("case_id", "item_id", "df")
    return read.unionByName(_draws(scored, last, index, options))


def _draws(scored: DataFrame, lists: DataFrame, index: NeighbourIndex, options: NeighbourOptions) -> DataFrame:
    """Pairs with the number of the draw that found them, ``sample_size`` a case or more.

    Each place in the case's ``lists`` (case_id, item_id, df) is as likely as any other. A session counts only if it
    is drawn by the rarest item that it shares with the case, so all sessions are equally likely; repeats keep their
    first draw. Cases that still lack sessions draw twice as often in the next round. One that has drawn as often as
    its lists are long reads the rest of them, in the order of its own hashes (``draw`` is null).
    """
    n, seed = options.sample_size, options.seed
    spans = cut_lineage(lists.withColumn("lo", F.sum("df").over(
        Window.partitionBy("case_id").orderBy("item_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("df")))
    waiting = spans.groupBy("case_id").agg(F.sum("df").alias("_total"))
    places = index.postings.select("item_id", "number", "session_id")
    found, start, size = None, 0, 2 * n
    while True:
        drawn = drawn_places(waiting, spans, "case_id", "_total", "df", seed, start, start + size)
        hits = (drawn.withColumn("number", F.col("place") + 1).join(places, ["item_id", "number"])
                .groupBy("case_id", "session_id", F.col("item_id").alias("_by"), "df").agg(F.min("draw").alias("draw")))
        new = overlaps(hits.select("case_id", "session_id", "_by", F.col("df").alias("_df"), "draw"), scored, index, "_by", "_df", "draw")
        new = new.where(F.col("best") == _item_rank("_df", "_by")).drop("_by", "_df")
        if found is not None:
            new = found.unionByName(new.join(found.select("case_id", "session_id"), ["case_id", "session_id"], "left_anti"))
        found, start, size = cut_lineage(new), start + size, 2 * size
        enough = found.groupBy("case_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n)
        waiting = cut_lineage(waiting.join(enough, "case_id", "left_anti"))
        if waiting.isEmpty():
            return found
        exhausted = waiting.where(F.col("_total") <= start).select("case_id")
        if not exhausted.isEmpty():
            rest = (lists.join(exhausted, "case_id", "left_semi").join(places.drop("number"), "item_id")
                    .select("case_id", "session_id", F.col("item_id").alias("_by"), F.col("df").alias("_df"))
                    .join(found.select("case_id", "session_id"), ["case_id", "session_id"], "left_anti"))
            own = overlaps(rest, scored, index, "_by", "_df").where(F.col("best") == _item_rank("_df", "_by")).drop("_by", "_df")
            found = cut_lineage(found.unionByName(own.withColumn("draw", F.lit(None).cast("long"))))
            waiting = cut_lineage(waiting.where(F.col("_total") > start))
            if waiting.isEmpty():
                return found


def _idf_pairs(scored: DataFrame, index: NeighbourIndex, options: NeighbourOptions) -> DataFrame:
    """Sessions with the largest sums of idf. Cases whose hot lists are no longer than their light ones (HOT_SHARE) read all
    of them. Of the others, sessions that share a light item are met through the light items' lists and summed up whole. A
    session without one reaches no more than the sum of the case's hot items; where the sample is full of larger sums, hot
    lists stay unread."""
    n, order = options.sample_size, _sample_order(options)
    hot = index.items.where(F.col("df") > options.hot_df).select("item_id")
    weights = index.postings.drop("number")
    is_hot = F.col("df") > options.hot_df
    sizes = scored.groupBy("case_id").agg(F.coalesce(F.sum(F.when(is_hot, F.col("df"))), F.lit(0)).alias("_hot"),
                                          F.coalesce(F.sum(F.when(~is_hot, F.col("df"))), F.lit(0)).alias("_light"))
    marked = cut_lineage(scored.join(sizes, "case_id"))
    few = (F.col("_hot") == 0) | (F.col("_hot") <= HOT_SHARE * F.col("_light"))
    whole = top_n(_whole_pairs(marked.where(few).drop("_hot", "_light"), index), ["case_id"], order, n, name="sample_rank")
    scored = marked.where(~few).drop("_hot", "_light")
    if scored.isEmpty():
        return whole
    light = scored.join(hot, "item_id", "left_anti").select("case_id", "item_id")
    met = light.join(weights.select("item_id", "session_id"), "item_id").select("case_id", "session_id").distinct()
    best = cut_lineage(top_n(overlaps(met, scored, index), ["case_id"], order, n, name="_r").drop("_r"))
    hot_prompts = scored.join(hot, "item_id", "left_semi")
    within = _open_cases(best, hot_prompts, n)
    hot_weights = weights.join(hot, "item_id", "left_semi")
    more = _hot_idf_keys(hot_prompts.join(within, "case_id", "left_semi"), hot_weights, options)
    new = more.join(best.select("case_id", "session_id"), ["case_id", "session_id"], "left_anti")
    return whole.unionByName(top_n(best.unionByName(overlaps(new, scored, index)), ["case_id"], order, n, name="sample_rank"))


def _open_cases(best: DataFrame, hot_prompts: DataFrame, n: int) -> DataFrame:
    """``case_id`` of the cases whose sample a session with hot items alone may still enter."""
    most = hot_prompts.groupBy("case_id").agg(F.round(F.sum("idf"), 9).alias("_most"))
    filled = best.groupBy("case_id").agg(F.count(F.lit(1)).alias("_n"), F.min("idf_sum").alias("_least"))
    still = F.col("_n").isNull() | (F.col("_n") < n) | (F.col("_least") <= F.col("_most"))
    return cut_lineage(most.join(filled, "case_id", "left").where(still).select("case_id"))


def _signatures(rows: DataFrame, key: str) -> DataFrame:
    """``key, sig``: the sorted set of hot items of a prompt or session."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set("item_id")).alias("sig"))


def _signature_scores(prompt_sigs, session_sigs, hot_prompts):
    """``p_sig, s_sig, rest``: idf of the common hot items of two item sets."""
    idf = hot_prompts.select("item_id", "idf").distinct()
    left = prompt_sigs.select(F.col("sig").alias("p_sig")).distinct()
    right = session_sigs.select(F.col("sig").alias("s_sig")).distinct()
    left = left.select("p_sig", F.explode("p_sig").alias("item_id")).join(idf, "item_id")
    right = right.select("s_sig", F.explode("s_sig").alias("item_id"))
    return left.join(right, "item_id").groupBy("p_sig", "s_sig").agg(F.sum("idf").alias("rest"))


def _hot_idf_keys(hot_prompts, hot_weights, options):
    """``case_id, session_id``: the best sessions of each prompt judged by hot items alone.

    Sessions with the same set of hot items score alike, so the first ``sample_size`` of a set stand for it."""
    prompt_sigs = _signatures(hot_prompts, "case_id")
    session_sigs = _signatures(hot_weights, "session_id")
    lists = top_n(session_sigs, ["sig"], [F.col("session_id")], options.sample_size, name="_r")
    scores = _signature_scores(prompt_sigs, session_sigs, hot_prompts)
    ranked = scores.withColumn("_score", F.round("rest", 9))
    members = ranked.join(lists.select(F.col("sig").alias("s_sig"), "session_id"), "s_sig")
    best = top_n(members, ["p_sig"], [F.desc("_score"), F.col("session_id")],
                 options.sample_size, name="_q").select("p_sig", "session_id")
    return prompt_sigs.withColumnRenamed("sig", "p_sig").join(best, "p_sig").select("case_id", "session_id")


def item_similarity(pairs: DataFrame, name: str, n_items) -> DataFrame:
    """Adds ``sim`` from the shared items of each pair."""
    if name == "dot":
        value = F.col("dot")
    elif name == "cosine":
        value = F.col("dot") / (F.col("p_norm") * F.col("s_norm"))
    else:
        value = measure(name, F.col("both"), F.col("s_size"), F.col("n"), n_items)
    return pairs.withColumn("sim", F.round(value, 9))


def vector_similarity(pairs: DataFrame, prompt_vecs: DataFrame, session_vecs: DataFrame, name: str) -> DataFrame:
    """Adds ``sim`` from one vector a prompt and one a session."""
    joined = (pairs.join(prompt_vecs.select("case_id", F.col("vector").alias("_x")), "case_id")
              .join(session_vecs.select("session_id", F.col("vector").alias("_y")), "session_id"))
    value = dot(F.col("_x"), F.col("_y")) if name == "dot" else cosine(F.col("_x"), F.col("_y"))
    return joined.withColumn("sim", F.round(value, 9)).drop("_x", "_y")


def nearest_sessions(pairs: DataFrame, k: int) -> DataFrame:
    """The k most similar sampled sessions of each case."""
    return top_n(pairs, ["case_id"], [F.desc("sim"), F.col("session_id")], k, name="sim_rank")


def sequential_weight(neighbours: DataFrame) -> DataFrame:
    """Adds ``seq``: position of the latest shared prompt item over the prompt length."""
    return neighbours.withColumn("seq", F.col("last_pos") / F.col("n"))


def scored_candidates(neighbours: DataFrame, weights: DataFrame, prompt_items: DataFrame,
                      idf: DataFrame, options: NeighbourOptions, follow: DataFrame | None = None) -> DataFrame:
    """``case_id, item_id, score`` over the items of the neighbours.

    With ``follow`` (item_id, next_item) only over those that follow the last prompt item in some session."""
    worth = F.coalesce("sim", F.lit(0.0))
    if options.sequential_weighting:
        worth = worth * (F.col("last_pos") / F.col("n"))
    cells = weights.where("w <> 0").select("session_id", "item_id")
    if options.idf_weighting:
        cells = cells.join(idf.select("item_id", F.col("df").cast("long").alias("df")), "item_id")
    # a neighbour's items go to the case's task as one row; a cell is met as often as its session has cells, on average
    n_votes = options.k * prompt_items.where("pos = n").count() * (weights.agg(F.avg("s_size")).first()[0] or 0)
    others = [c for c in cells.columns if c != "session_id"]
    packed = cells.groupBy("session_id").agg(F.collect_list(F.struct(*others)).alias("_l")).select(
        "session_id", *[F.col(f"_l.{c}").alias(f"_{c}s") for c in others])
    voters = neighbours.select("case_id", "session_id", worth.alias("_v")).join(packed.hint("merge"), "session_id")
    votes = spread(voters.drop("session_id"), "case_id", rows=n_votes)

    def of_case(rows: DataFrame, item: str, name: str) -> DataFrame:
        # in as many tasks as the votes, or both would be shuffled into the usual number
        return spread(rows.select("case_id", item), "case_id", rows=n_votes).groupBy("case_id").agg(F.collect_list(item).alias(name)).hint("shuffle_hash")

    shown, limit = [], None
    if options.filter_prompt_items:
        votes = votes.join(of_case(prompt_items, "item_id", "_seen"), "case_id", "left")
        shown.append(~F.coalesce(F.array_contains("_seen", F.col("item_id")), F.lit(False)))
    if follow is not None:
        after = _after_last(prompt_items, follow)
        limit = after.groupBy("case_id").count().agg(F.max("count")).first()[0] or 0
        if limit <= FOLLOWERS:  # looked up before votes are summed up, as most items don't follow
            votes = votes.join(of_case(after, "item_id", "_next"), "case_id")
            shown.insert(0, F.array_contains("_next", F.col("item_id")))
    lists = F.arrays_zip(*[F.col(f"_{c}s").alias(c) for c in others])
    items = votes.select("case_id", "_v", *[c for c in ("_seen", "_next") if c in votes.columns], F.inline(lists).alias(*others))
    for condition in shown:
        items = items.where(condition)
    if options.idf_weighting:  # items of one frequency have one idf, so frequencies travel, which are short
        by_df = idf.groupBy(F.col("df").cast("long").alias("df")).agg(F.max("idf").alias("idf"))
        summed = items.groupBy("case_id", "item_id").agg(F.sum("_v").alias("_sum"), F.max("df").alias("df"))
        # there are fewer different frequencies than the root of twice the cells
        out = summed.join(F.broadcast(by_df), "df").select("case_id", "item_id", (F.col("_sum") * F.col("idf")).alias("score"))
    else:
        out = items.groupBy("case_id", "item_id").agg(F.sum("_v").alias("score"))
    return out if follow is None or limit <= FOLLOWERS else following_only(out, prompt_items, follow)


def _after_last(prompt_items: DataFrame, follow: DataFrame) -> DataFrame:
    """``case_id, item_id``: what follows the last prompt item in some session."""
    last = prompt_items.where("pos = n").select("case_id", F.col("item_id").alias("_last"))
    edges = follow.select(F.col("item_id").alias("_last"), F.col("next_item").alias("item_id"))
    return last.join(edges, "_last").select("case_id", "item_id").distinct()


def following_only(candidates: DataFrame, prompt_items: DataFrame,
                   follow: DataFrame) -> DataFrame:
    """Candidates that follow the last prompt item in some session."""
    last = prompt_items.where("pos = n").select("case_id", F.col("item_id").alias("_last"))
    edges = follow.select(F.col("item_id").alias("_last"), F.col("next_item").alias("item_id"))
    return candidates.join(last, "case_id").join(
        edges, ["_last", "item_id"], "left_semi").drop("_last")


def recommend_neighbours(prompts: DataFrame, train: DataFrame | NeighbourIndex, k: int,
                         options: NeighbourOptions = NeighbourOptions(),
                         items: DataFrame | None = None, model: str | None = None,
                         allowed: DataFrame | None = None) -> DataFrame:
    """``model, case_id, rank, item_id, score`` for all prompts in one job.

    ``train`` is a fitted index, or a log from which one is built for this call. ``allowed`` (``item_id``)
    restricts the items that may be shown, before they are ranked.
    """
    index = train if isinstance(train, NeighbourIndex) else NeighbourIndex.of(train)
    prompt_items = cut_lineage(prompt_vectors(
        normalised_prompts(prompts, index.items, options.last_n_items), options.decay))
    pairs = sampled_pairs(prompt_items, index, options)
    held = held_items(items) if options.use_item_embeddings else None
    if held is not None:
        pairs = held_similarity(pairs, *clicked_items(prompt_items, index, options), held, options.similarity, options.prompt_strategy == "concat")
    elif options.use_item_embeddings and options.prompt_strategy == "concat":
        pairs = trailing_similarity(pairs, prompt_items, index, items, options)
    elif options.use_item_embeddings:
        pairs = vector_similarity(pairs, *embedding_lookups(prompt_items, index, items, options), options.similarity)
    else:
        n_items = index.items.agg(F.count(F.lit(1))).scalar()
        pairs = item_similarity(pairs, options.similarity, n_items)
    close = nearest_sessions(pairs, options.k)
    scores = scored_candidates(close, index.cells, prompt_items, index.items, options, index.follow if options.sequential_filter else None)
    if allowed is not None:
        scores = scores.join(allowed.select("item_id").distinct(), "item_id", "left_semi")
    scores = scores.withColumn("score", F.round("score", 9))
    best = top_n(scores, ["case_id"], [F.desc("score"), F.col("item_id")], k)
    return best.select(F.lit(model or options.model_name()).alias("model"), "case_id", "rank",
                       "item_id", "score")


def clicked_items(prompt_items: DataFrame, index: NeighbourIndex, options: NeighbourOptions) -> tuple[DataFrame, DataFrame]:
    """``_back, item_id, _w`` by case_id and by session_id: the items that count for each side's vector, each with its own decay."""
    def side(rows: DataFrame, key: str, strategy: str, decay: str | None) -> DataFrame:
        if strategy == "last":
            rows, weight = rows.where(F.col("pos") == F.col("n")), F.lit(1.0)
        else:
            weight = decay_weight(decay, F.col("pos"), F.col("n"), NEIGHBOUR_FLOOR)
        return rows.select(key, (F.col("n") - F.col("pos")).alias("_back"), "item_id", weight.alias("_w"))

    return (side(prompt_items, "case_id", options.prompt_strategy, options.decay),
            side(index.sequence, "session_id", options.train_strategy, options.train_decay))


def embedding_lookups(prompt_items: DataFrame, index: NeighbourIndex, items: DataFrame,
                      options: NeighbourOptions) -> tuple[DataFrame, DataFrame]:
    """Vectors of the prompts and of the training sessions, each with its own decay."""
    rows = prompt_items.select("case_id", "pos", "n", "item_id")
    ours = session_vectors(rows, items, options.prompt_strategy, options.decay,
                           floor=NEIGHBOUR_FLOOR)
    theirs = session_vectors(index.sequence.select("session_id", "pos", "item_id"), items,
                             options.train_strategy, options.train_decay, key="session_id",
                             floor=NEIGHBOUR_FLOOR)
    return ours, theirs


def trailing_similarity(pairs: DataFrame, prompt_items: DataFrame, index: NeighbourIndex, items: DataFrame,
                        options: NeighbourOptions) -> DataFrame:
    """Adds ``sim`` of the item vectors laid end to end, compared from the last one backwards over the shorter side.

    Places from the end are joined, so nothing is gathered: a pair has one row for each place both sides have.
    """
    vectors = items.select("item_id", "embedding")

    def side(rows: DataFrame, key: str, decay: str | None, name: str) -> DataFrame:
        weight = decay_weight(decay, F.col("pos"), F.col("n"), NEIGHBOUR_FLOOR)
        return (rows.join(vectors, "item_id")
                .select(key, (F.col("n") - F.col("pos")).alias("_back"), F.transform("embedding", lambda v: v * weight).alias(name)))

    ours = side(prompt_items, "case_id", options.decay, "_x")
    theirs = side(index.sequence, "session_id", options.train_decay, "_y")
    met = pairs.select("case_id", "session_id").join(ours, "case_id").join(theirs, ["session_id", "_back"])
    sums = met.groupBy("case_id", "session_id").agg(*[F.sum(dot(F.col(a), F.col(b))).alias(c) for a, b, c in (
        ("_x", "_y", "_xy"), ("_x", "_x", "_xx"), ("_y", "_y", "_yy"))])
    value = F.col("_xy") if options.similarity == "dot" else F.col("_xy") / F.sqrt(F.col("_xx") * F.col("_yy"))
    return pairs.join(sums, ["case_id", "session_id"]).withColumn("sim", F.round(value, 9)).drop("_xy", "_xx", "_yy")


def recommend_one(prompt: DataFrame | list[int], train: DataFrame | NeighbourIndex, k: int = 20,
                  options: NeighbourOptions = NeighbourOptions(), items: DataFrame | None = None,
                  allowed: DataFrame | None = None) -> DataFrame:
    """Slate of a single prompt; ``allowed`` restricts the items that may be shown.

    A prompt that is a table already (case_id, pos, item_id) stays in Spark, however long;
    a list is for one at hand.
    """
    if isinstance(prompt, DataFrame):
        rows = prompt.select("case_id", "pos", "item_id")
    else:
        spark = (train.items if isinstance(train, NeighbourIndex) else train).sparkSession
        rows = spark.createDataFrame([(0, i + 1, int(x)) for i, x in enumerate(prompt)],
                                     "case_id long, pos long, item_id long")
    return recommend_neighbours(rows, train, k, options, items, allowed=allowed)
