"""Queries on prompt tables and completions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from slatewright.functions import chat
from slatewright.operators import completions as C
from slatewright.operators import prompts as L
from slatewright.plans import workload
from slatewright.plans.prepared import dataset
from slatewright.plans.registry.common import sql
from slatewright.plans.registry.embeddings import NEED as VECTOR_NEED
from slatewright.plans.registry.evaluating import NEED, RECS, two_models
from slatewright.session import ensure_checkpoint_dir
from slatewright.sources import writers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name, query, text=None, *needs):
    QUERIES[name] = query
    if text is not None:
        SQL[name] = sql(text, *needs)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


NAMES = "names AS (SELECT p_partkey AS item_id, p_name || ' #' || p_partkey AS name FROM part)"


def prompt_names(spark, sf_dir):
    data = dataset(spark, sf_dir)
    return L.named_lists(data.prompts, workload.names(spark, sf_dir))


add("prompt_lines_l1", lambda s, d: L.as_lines(prompt_names(s, d)), f""", {NAMES}
  SELECT case_id, string_agg(name, chr(10) ORDER BY pos) AS text FROM prompts JOIN names USING (item_id) GROUP BY 1""",
    "prompts")

LINES = f"""{NAMES},
  pl AS (SELECT case_id, string_agg(name, chr(10) ORDER BY pos) AS t, count(*) AS n
         FROM prompts JOIN names USING (item_id) GROUP BY 1),
  gl AS (SELECT case_id, name AS g FROM truths JOIN names USING (item_id))"""


def filled(template: str, user: str = "t", choices: str = "''", answer: str = "''") -> str:
    return (f"replace(replace(replace({quoted(template)}, '{{user_item_list}}', {user}),"
            f" '{{choices}}', {choices}), '{{answer}}', {answer})")


def single_examples(spark, sf_dir):
    data = dataset(spark, sf_dir)
    answers = L.named_lists(data.truths, workload.names(spark, sf_dir))
    return L.chat_examples("single", prompt_names(spark, sf_dir), answers)


def shown(df):
    return df.select("case_id", F.inline("messages"))


add("single_examples_l2", lambda s, d: shown(single_examples(s, d)), f""", {LINES}
  SELECT case_id, unnest(['system', 'user', 'assistant']) AS role,
         unnest([{quoted(chat.SINGLE_SYSTEM)}, {filled(chat.SINGLE_USER)}, g]) AS content
  FROM pl JOIN gl USING (case_id)""", "prompts", "truths")


def grounded(spark, sf_dir, k=None):
    data, recs = two_models(spark, sf_dir)
    return data, L.grounded_slates(recs.where("model = 'follow'"), data.truths, k)


GROUNDED = f""", {RECS},
  fr AS (SELECT r.case_id, r.rank, r.item_id, t.item_id AS g, max(rank) OVER (PARTITION BY r.case_id) AS last_rank,
                bool_or(r.item_id = t.item_id) OVER (PARTITION BY r.case_id) AS found
         FROM recs r JOIN truths t USING (case_id) WHERE model = 'follow'),
  gr AS (SELECT case_id, 1 AS rank, any_value(g) AS item_id, NOT any_value(found) AS was_missing FROM fr GROUP BY 1
         UNION ALL
         SELECT case_id, 1 + row_number() OVER (PARTITION BY case_id ORDER BY rank), item_id, NOT found FROM fr
         WHERE CASE WHEN found THEN item_id <> g ELSE rank < last_rank END)"""

add("grounded_slates_l3", lambda s, d: grounded(s, d)[1], GROUNDED + """
  SELECT case_id, rank::INTEGER AS rank, item_id, was_missing FROM gr""", *NEED)
add("missing_share_l3", lambda s, d: L.missing_share(grounded(s, d, 10)[1]).select(
    F.round("share", 6).alias("share")), GROUNDED + """
  SELECT round(avg(was_missing::INT), 6) AS share FROM gr WHERE rank = 1""", *NEED)


def fully_named(spark, sf_dir):
    unnamed = workload.table(spark, sf_dir, "part").where("p_size = 7").select(
        F.col("p_partkey").alias("item_id"))
    return L.fully_named(grounded(spark, sf_dir)[1], unnamed).select("case_id", "rank", "item_id")


add("fully_named_slates_l4", fully_named, GROUNDED + """
  SELECT case_id, rank::INTEGER AS rank, item_id FROM gr WHERE case_id NOT IN (
    SELECT case_id FROM gr JOIN part ON p_partkey = item_id WHERE p_size = 7)""", *NEED)

NUMBERED = """
  na AS (SELECT case_id, string_agg(rank || '. ' || name || chr(10), '' ORDER BY rank) AS a
         FROM gr JOIN names USING (item_id) GROUP BY 1)"""


def slate_names(spark, sf_dir, rows=None):
    rows = grounded(spark, sf_dir)[1] if rows is None else rows
    return L.named_lists(rows, workload.names(spark, sf_dir), order="rank")


def numbered(spark, sf_dir):
    from slatewright.functions.text import numbered_list
    return slate_names(spark, sf_dir).select("case_id", numbered_list(F.col("names")).alias("text"))


add("numbered_lists_l5", numbered, GROUNDED + f", {NAMES},{NUMBERED} SELECT case_id, a AS text FROM na", *NEED)

add("list_examples_l6", lambda s, d: shown(L.chat_examples("list", prompt_names(s, d), slate_names(s, d))),
    GROUNDED + f", {LINES},{NUMBERED}" + f"""
  SELECT case_id, unnest(['system', 'user', 'assistant']) AS role, unnest([{quoted(chat.LIST_SYSTEM)},
         {filled(chat.LIST_USER)}, {filled(chat.LIST_ASSISTANT, answer='a')}]) AS content
  FROM pl JOIN na USING (case_id)""", *NEED)


def rank_examples(spark, sf_dir):
    rows = grounded(spark, sf_dir)[1]
    shuffled = slate_names(spark, sf_dir, L.shuffled_within(rows, 42))
    return L.chat_examples("rank", prompt_names(spark, sf_dir), slate_names(spark, sf_dir, rows), shuffled)


SHUFFLED = """
  sh AS (SELECT case_id, string_agg(name, chr(10) ORDER BY md5('42:' || case_id || ':' || item_id)) AS c
         FROM gr JOIN names USING (item_id) GROUP BY 1)"""
add("rank_examples_l6", lambda s, d: shown(rank_examples(s, d)),
    GROUNDED + f", {LINES},{NUMBERED},{SHUFFLED}" + f"""
  SELECT case_id, unnest(['system', 'user', 'assistant']) AS role, unnest([{quoted(chat.RANK_SYSTEM)},
         {filled(chat.CHOICE_USER, choices='c')}, a]) AS content
  FROM pl JOIN na USING (case_id) JOIN sh USING (case_id)""", *NEED)


def brand_choices(spark, sf_dir):
    """One name per brand (the smallest part) as the list of categories."""
    part = workload.table(spark, sf_dir, "part")
    names = part.groupBy("p_brand").agg(F.min("p_partkey").alias("item_id")).join(
        workload.names(spark, sf_dir), "item_id")
    return names.agg(F.array_sort(F.collect_list("name"))).scalar()


BRANDS = """
  br AS (SELECT string_agg(name, chr(10) ORDER BY name) AS c FROM names WHERE item_id IN (
           SELECT min(p_partkey) FROM part GROUP BY p_brand))"""
add("classify_examples_l6", lambda s, d: shown(L.chat_examples(
    "classify", prompt_names(s, d), slate_names(s, d), brand_choices(s, d))),
    GROUNDED + f", {LINES},{NUMBERED},{BRANDS}" + f"""
  SELECT case_id, unnest(['system', 'user', 'assistant']) AS role, unnest([{quoted(chat.CLASSIFY_SYSTEM)},
         {filled(chat.CHOICE_USER, choices='c')}, a]) AS content FROM pl JOIN na USING (case_id), br""", *NEED)


def training(spark, sf_dir, max_tokens=None):
    lengths = dataset(spark, sf_dir).prompts.groupBy("case_id").agg(F.count(F.lit(1)).alias("length"))
    return L.training_split(single_examples(spark, sf_dir), lengths, 0.2, 42, 2, max_tokens)


TOKENS = " + ".join(f"len(regexp_split_to_array(trim({x}, ' ' || chr(10)), '\\s+')) + 4" for x in (
    quoted(chat.SINGLE_SYSTEM), filled(chat.SINGLE_USER), "g"))
TRAINING = f""", {LINES},
  sides AS (SELECT case_id, n, CASE WHEN row_number() OVER (ORDER BY md5('42:' || case_id), case_id)
              <= floor(0.2 * count(*) OVER ()) THEN 'validation' ELSE 'train' END AS split FROM pl),
  ex AS (SELECT case_id, split, {TOKENS} AS n_tokens FROM pl JOIN gl USING (case_id) JOIN sides USING (case_id)
         WHERE sides.n >= 2)"""
add("training_split_l7", lambda s, d: training(s, d, 180).select("case_id", "split", "n_tokens"), TRAINING + """
  SELECT case_id, split, n_tokens::INTEGER AS n_tokens FROM ex WHERE n_tokens <= 180""", "prompts", "truths")
add("token_cost_l8", lambda s, d: L.token_cost(training(s, d), 0.008, 400.0).withColumn(
    "cost", F.round("cost", 6)), TRAINING + """
  SELECT split, count(*) AS n_examples, sum(n_tokens)::BIGINT AS n_tokens, round(sum(n_tokens) * 0.008, 6)::DOUBLE AS cost,
         sum(n_tokens) * 0.008 <= 400.0 AS within_bound FROM ex GROUP BY 1""",
    "prompts", "truths")
CHAT_LINES = TRAINING + f"""
  SELECT split, to_json(struct_pack(messages := [
           struct_pack("role" := 'system', content := {quoted(chat.SINGLE_SYSTEM)}),
           struct_pack("role" := 'user', content := {filled(chat.SINGLE_USER)}),
           struct_pack("role" := 'assistant', content := g)]))::VARCHAR AS value
  FROM ex JOIN pl USING (case_id) JOIN gl USING (case_id)"""
add("chat_json_lines_s12", lambda s, d: L.to_json_lines(training(s, d)), CHAT_LINES, "prompts", "truths")


def chat_files(spark, sf_dir):
    """The lines as files below a folder for each split."""
    path = f"{ensure_checkpoint_dir(spark)}/chat-{uuid.uuid4().hex}"
    writers.write_chat_examples(L.to_json_lines(training(spark, sf_dir)), path)
    return spark.read.option("basePath", path).text(path).select("split", "value")


add("chat_files_s12", chat_files, CHAT_LINES, "prompts", "truths")


def conversation_lines(spark, sf_dir):
    """The conversation table as one JSON object per conversation, turns in order."""
    turns = workload.table(spark, sf_dir, "conversations")
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    messages = F.transform(rows, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    lines = L.to_json_lines(turns.groupBy("conv_id").agg(messages.alias("messages")), ["conv_id"])
    parsed = F.from_json("value", "messages array<struct<role:string,content:string>>")
    return lines.select("conv_id", F.inline(parsed["messages"]))


add("conversation_lines_s12", conversation_lines,
    "SELECT conv_id, role, text AS content FROM conversations")

add("history_prompts_l9", lambda s, d: shown(L.test_prompts("single", prompt_names(s, d))), f""", {LINES}
  SELECT case_id, unnest(['system', 'user']) AS role,
         unnest([{quoted(chat.SINGLE_SYSTEM)}, {filled(chat.SINGLE_USER)}]) AS content FROM pl""",
    "prompts", "truths")
add("category_prompts_l9", lambda s, d: shown(L.test_prompts(
    "classify", prompt_names(s, d), brand_choices(s, d))), f""", {LINES},{BRANDS}
  SELECT case_id, unnest(['system', 'user']) AS role,
         unnest([{quoted(chat.CLASSIFY_SYSTEM)}, {filled(chat.CHOICE_USER, choices='c')}]) AS content FROM pl, br""",
    "prompts", "truths")
add("flat_prompts_l18", lambda s, d: L.flat_prompt(L.test_prompts("list", prompt_names(s, d))), f""", {LINES}
  SELECT case_id, {quoted(chat.LIST_SYSTEM)} || chr(10) || {filled(chat.LIST_USER)} AS prompt FROM pl""",
    "prompts", "truths")


# --- completions --------------------------------------------------------------------------
# Completions are derived from slates: every third name is altered, two candidates per case
# (the second one repeats the first half), half of them between markers.
def slates_with_names(spark, sf_dir, k=20):
    _, recs = two_models(spark, sf_dir, k)
    rows = recs.where("model = 'follow'").join(workload.names(spark, sf_dir), "item_id")
    odd = (F.col("item_id") + F.col("case_id")) % 3 == 0
    return rows.withColumn("name", F.when(odd, F.concat(F.lit("the "), "name")).otherwise(F.col("name")))


def completions_table(spark, sf_dir):
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), "name", F.lit("\n"))
    packed = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    body = F.array_join(F.transform(packed, lambda x: x["line"]), "")
    rows = slates_with_names(spark, sf_dir).groupBy("case_id").agg(body.alias("body"))
    wrapped = F.concat(F.lit(chat.LIST_ASSISTANT.replace("{answer}\nEND\n", "")), "body", F.lit("END\nEND\n"))
    text = F.when(F.col("case_id") % 2 == 0, wrapped).otherwise(F.col("body"))
    return rows.select("case_id", F.lit(0).alias("candidate"), text.alias("text"))


SLATE_NAMES = f""", {RECS}, {NAMES},
  sn AS (SELECT case_id, rank, item_id, CASE WHEN (item_id + case_id) % 3 = 0 THEN 'the ' || name ELSE name END AS name
         FROM recs JOIN names USING (item_id) WHERE model = 'follow')"""

def list_parse(spark, sf_dir):
    return C.parsed(completions_table(spark, sf_dir), "list", 10).select("case_id", "rank", "name")


def choice_parse(spark, sf_dir):
    return C.parsed(completions_table(spark, sf_dir), "rank", 15).select("case_id", "rank", "name")


PARSED = "SELECT case_id, rank::INTEGER AS rank, name FROM sn WHERE rank <= {k}"
add("parse_list_l11", list_parse, SLATE_NAMES + PARSED.format(k=10), *NEED)
add("parse_choices_l12", choice_parse, SLATE_NAMES + PARSED.format(k=15), *NEED)


def single_parse(spark, sf_dir):
    """Conversation turns as single-name completions."""
    turns = workload.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("case_id"), F.col("turn").alias("candidate"),
        F.concat(F.lit(" \n"), "role", F.lit(" \n")).alias("text"))
    return C.parsed(turns, "single")


add("parse_single_l10", lambda s, d: single_parse(s, d).select("case_id", "candidate", "name"), """
  SELECT conv_id AS case_id, turn AS candidate, role AS name FROM conversations""")
add("answer_counts_l13", lambda s, d: C.answer_counts(single_parse(s, d)).select("case_id", "name", "n"), """
  SELECT conv_id AS case_id, role AS name, count(*) AS n FROM conversations GROUP BY 1, 2""")


def matched_rows(spark, sf_dir, k=10):
    rows = C.parsed(completions_table(spark, sf_dir), "list", k)
    return C.matched(rows, workload.names(spark, sf_dir))


add("match_names_l14", lambda s, d: matched_rows(s, d).select("case_id", "rank", "name", "item_id"),
    SLATE_NAMES + """SELECT case_id, rank::INTEGER AS rank, sn.name, n.item_id
  FROM sn LEFT JOIN names n ON n.name = sn.name WHERE rank <= 10""", *NEED)
add("unmatched_names_l14", lambda s, d: C.unmatched_names(matched_rows(s, d)), SLATE_NAMES + """
  SELECT DISTINCT name FROM sn WHERE rank <= 10 AND name NOT IN (SELECT name FROM names)""", *NEED)


def vector_names(spark, sf_dir):
    """Names of the embedding items; an altered name keeps the vector of its item."""
    items = workload.vectors(spark, sf_dir)
    names = items.select("item_id", F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("name"))
    altered = names.join(items, "item_id").select(
        F.concat(F.lit("the "), "name").alias("name"), F.col("embedding").alias("vector"))
    plain = names.join(items, "item_id").select("name", F.col("embedding").alias("vector"))
    return items, names, plain.unionByName(altered)


def vector_completions(spark, sf_dir):
    """The prompt items of a case as answers, every third one altered."""
    data = dataset(spark, sf_dir, on_vectors=True)
    rows = data.prompts
    odd = (F.col("item_id") + F.col("case_id")) % 3 == 0
    name = F.concat(F.when(odd, "the item ").otherwise("item "), F.col("item_id").cast("string"))
    return data, rows.select("case_id", F.lit(0).alias("candidate"), F.col("pos").cast("int").alias("rank"),
                             name.alias("name"))


def fill_unmatched(spark, sf_dir):
    _, rows = vector_completions(spark, sf_dir)
    items, names, vectors = vector_names(spark, sf_dir)
    return C.fill_unmatched(C.matched(rows, names), vectors, items, 8)


# The walk as recursion over ranks: used items are carried along.
FILL = """
  , rows AS MATERIALIZED (SELECT case_id, pos AS rank, CASE WHEN (item_id + case_id) % 3 <> 0 THEN item_id END AS own, item_id AS src
             FROM vprompts),
  given AS (SELECT case_id, coalesce(list(DISTINCT own) FILTER (WHERE own IS NOT NULL), []) AS used FROM rows GROUP BY 1),
  lengths AS (SELECT src, max(n) AS n FROM rows JOIN (SELECT case_id, count(*) AS n FROM rows GROUP BY 1) USING (case_id)
              WHERE own IS NULL GROUP BY 1),
  near AS (SELECT src, b.item_id AS near_id, n, row_number() OVER (PARTITION BY src
             ORDER BY round(list_inner_product(a.v, b.v), 9) DESC, b.item_id) AS place
           FROM lengths JOIN vecs a ON a.item_id = src, vecs b QUALIFY place <= greatest(8, n)),
  short AS MATERIALIZED (SELECT src, list(near_id ORDER BY place) AS l FROM near GROUP BY 1),
  walk AS (
    SELECT case_id, 0::BIGINT AS rank, NULL::BIGINT AS item_id, used FROM given
    UNION ALL
    SELECT w.case_id, r.rank, coalesce(r.own, list_filter(l, lambda x: NOT list_contains(w.used, x))[1]),
           CASE WHEN r.own IS NOT NULL THEN w.used
                ELSE list_append(w.used, list_filter(l, lambda x: NOT list_contains(w.used, x))[1]) END
    FROM walk w JOIN rows r ON r.case_id = w.case_id AND r.rank = w.rank + 1 LEFT JOIN short s ON s.src = r.src)
  SELECT case_id, rank::INTEGER AS rank, item_id FROM walk WHERE rank > 0"""
QUERIES["fill_unmatched_l15"] = fill_unmatched
SQL["fill_unmatched_l15"] = sql(FILL, *VECTOR_NEED).replace("WITH ", "WITH RECURSIVE ", 1)


def replace_repeats(spark, sf_dir):
    """Whole prompts as single answers, so repeated items are repeated answers."""
    data, rows = vector_completions(spark, sf_dir)
    items, names, vectors = vector_names(spark, sf_dir)
    other = data.truths.select("case_id", "item_id")
    return C.replace_repeats(C.answer_counts(rows), names, vectors, items, other, 10)


# Answers in order of their first place, one step a wanted replacement: what was taken is carried along.
REPEATS = """
  , answers AS (SELECT case_id, (item_id + case_id) % 3 = 0 AS odd, item_id AS src, count(*) AS n, min(pos) AS first
                FROM vprompts GROUP BY 1, 2, 3),
  labelled AS (SELECT *, CASE WHEN NOT odd THEN src END AS item_id FROM answers),
  needs AS (SELECT case_id, src, n, first, n - (item_id IS NOT NULL)::INT AS more, row_number() OVER (PARTITION BY case_id ORDER BY first) AS turn
            FROM labelled WHERE n > 1 OR item_id IS NULL),
  lengths AS (SELECT src, max(n) + 10 AS n FROM needs GROUP BY 1),
  near AS (SELECT src, b.item_id AS near_id, n, row_number() OVER (PARTITION BY src
             ORDER BY round(list_inner_product(a.v, b.v), 9) DESC, b.item_id) AS place
           FROM lengths JOIN vecs a ON a.item_id = src, vecs b QUALIFY place <= n),
  barred AS (SELECT case_id, item_id FROM vtruths UNION SELECT case_id, item_id FROM labelled WHERE item_id IS NOT NULL),
  offered AS MATERIALIZED (SELECT case_id, turn, any_value(more) AS more, coalesce(list(near_id ORDER BY place) FILTER (WHERE near_id IS NOT NULL), []) AS l
              FROM (SELECT n.case_id, turn, more, place, CASE WHEN b.item_id IS NULL THEN near_id END AS near_id
                    FROM needs n JOIN near ON near.src = n.src AND place <= n.n + 10
                    LEFT JOIN barred b ON b.case_id = n.case_id AND b.item_id = near_id) GROUP BY 1, 2),
  walk AS (SELECT case_id, 0::BIGINT AS turn, []::BIGINT[] AS taken FROM (SELECT DISTINCT case_id FROM needs)
           UNION ALL
           SELECT w.case_id, o.turn, list_concat(w.taken, list_filter(l, lambda x: NOT list_contains(w.taken, x))[1:more])
           FROM walk w JOIN offered o ON o.case_id = w.case_id AND o.turn = w.turn + 1),
  extra AS (SELECT case_id, arg_max(taken, turn) AS taken FROM walk GROUP BY 1),
  direct AS (SELECT case_id, list(item_id ORDER BY first) FILTER (WHERE item_id IS NOT NULL) AS l FROM labelled GROUP BY 1),
  chosen AS (SELECT case_id, list_concat(coalesce(l, []), coalesce(taken, [])) AS l FROM direct LEFT JOIN extra USING (case_id))
  SELECT case_id, unnest(range(1, len(l) + 1)) AS rank, unnest(l) AS item_id FROM chosen"""
QUERIES["replace_repeats_l16"] = replace_repeats
SQL["replace_repeats_l16"] = sql(REPEATS, *VECTOR_NEED, "vtruths").replace("WITH ", "WITH RECURSIVE ", 1)


def match_allowed(spark, sf_dir):
    """Altered slate names against the case's own slate in another order."""
    rows = slates_with_names(spark, sf_dir, 12).select("case_id", "rank", "name")
    _, recs = two_models(spark, sf_dir, 12)
    allowed = recs.where("model = 'follow'").join(workload.names(spark, sf_dir), "item_id").select(
        "case_id", F.col("rank").alias("place"), F.col("name").alias("choice"))
    return C.match_allowed(rows, allowed)


# The same walk as recursion over ranks, choices ordered by likeness.
FUZZY = SLATE_NAMES + """,
  names12 AS (SELECT case_id, rank, name FROM sn WHERE rank <= 12),
  allowed AS (SELECT case_id, r.rank AS place, n.name AS choice FROM recs r JOIN names n USING (item_id)
              WHERE model = 'follow' AND r.rank <= 12),
  opts AS (SELECT n.case_id, n.rank, n.name, list(choice ORDER BY round(1.0::DOUBLE - levenshtein(n.name, choice)
             / greatest(length(n.name), length(choice), 1)::DOUBLE, 9) DESC, place) AS l
           FROM names12 n JOIN allowed a USING (case_id) GROUP BY 1, 2, 3),
  first AS (SELECT *, list_contains(l, name) AS is_exact, CASE WHEN list_contains(l, name) THEN name ELSE l[1] END AS best
            FROM opts),
  walk AS (
    SELECT case_id, 0::BIGINT AS rank, ''::VARCHAR AS choice, false AS is_exact, false AS is_duplicate, []::VARCHAR[] AS used
    FROM (SELECT DISTINCT case_id FROM first)
    UNION ALL
    SELECT w.case_id, f.rank, c.choice, f.is_exact, list_contains(w.used, f.best), list_append(w.used, c.choice)
    FROM walk w JOIN first f ON f.case_id = w.case_id AND f.rank = w.rank + 1,
      LATERAL (SELECT CASE WHEN list_contains(w.used, f.best)
        THEN coalesce(list_filter(f.l, lambda x: NOT list_contains(w.used, x))[1], f.best) ELSE f.best END AS choice) c)"""


def fuzzy(body: str) -> str:
    return sql(FUZZY + body, *NEED).replace("WITH ", "WITH RECURSIVE ", 1)


QUERIES["match_allowed_l17"] = match_allowed
SQL["match_allowed_l17"] = fuzzy("""
  SELECT case_id, rank::INTEGER AS rank, choice, is_exact, is_duplicate FROM walk WHERE rank > 0""")
SQL["match_report_l17"] = fuzzy("""
  SELECT count_if(is_exact)::BIGINT AS n_exact, count_if(NOT is_exact)::BIGINT AS n_inexact, count_if(is_duplicate)::BIGINT AS n_duplicate
  FROM walk WHERE rank > 0""")
add("match_report_l17", lambda s, d: C.match_report(match_allowed(s, d)))
