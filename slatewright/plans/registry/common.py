"""Shared SQL pieces of the oracle queries."""

from __future__ import annotations

# Name -> (CTE body, names of the CTEs it needs).
PARTS: dict[str, tuple[str, tuple[str, ...]]] = {}


def part(name: str, body: str, *needs: str) -> None:
    PARTS[name] = (body, needs)


def sql(body: str, *needs: str) -> str:
    """``body`` preceded by the needed CTEs, dependencies first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for other in PARTS[name][1]:
            visit(other)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        visit(name)
    if not ordered:
        return body
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({PARTS[n][0]})" for n in ordered)
    return f"WITH {ctes}\n{body}"


part("raw_log", """
  SELECT o_custkey AS session_id, l_partkey AS item_id, l_shipdate AS ts, 1.0::DOUBLE AS reward,
         row_number() OVER (PARTITION BY o_custkey ORDER BY l_shipdate, l_orderkey, l_linenumber,
                            l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")

part("ends", "SELECT session_id, max(ts) AS max_ts, count(*) AS n FROM raw_log GROUP BY 1",
     "raw_log")

part("roles", """
  SELECT session_id, CASE WHEN rn > total - ceil(0.2 * total) THEN 'test' ELSE 'train' END AS role
  FROM (SELECT session_id, row_number() OVER (ORDER BY max_ts, session_id) AS rn,
               count(*) OVER () AS total FROM ends)""", "ends")

part("train", """
  SELECT r.* FROM raw_log r JOIN roles USING (session_id) WHERE role = 'train'""",
     "raw_log", "roles")


def _test(log: str, train: str) -> str:
    return f"""
  SELECT session_id, item_id, ts, reward,
         row_number() OVER (PARTITION BY session_id ORDER BY pos) AS pos,
         count(*) OVER (PARTITION BY session_id) AS n
  FROM (SELECT r.*, count(*) OVER (PARTITION BY session_id) AS kept
        FROM {log} r JOIN roles USING (session_id)
        WHERE role = 'test' AND item_id IN (SELECT item_id FROM {train}))
  WHERE kept >= 2"""


part("test", _test("raw_log", "train"), "raw_log", "roles", "train")
part("prompts", "SELECT session_id AS case_id, pos, item_id FROM test WHERE pos < n", "test")
part("truths", "SELECT session_id AS case_id, item_id FROM test WHERE pos = n", "test")
part("counts", "SELECT item_id, count(*) AS c FROM train GROUP BY 1", "train")
part("popular", """
  SELECT item_id, c, row_number() OVER (ORDER BY c DESC, item_id) AS rank FROM counts""",
     "counts")

# The same dataset with items folded onto the embedding table.
part("vlog", """
  SELECT session_id, item_id % (SELECT count(*) FROM embeddings) AS item_id, ts, reward, pos
  FROM raw_log""", "raw_log")
part("vtrain", "SELECT r.* FROM vlog r JOIN roles USING (session_id) WHERE role = 'train'",
     "vlog", "roles")
part("vtest", _test("vlog", "vtrain"), "vlog", "roles", "vtrain")
part("vprompts", "SELECT session_id AS case_id, pos, n - 1 AS n, item_id FROM vtest WHERE pos < n",
     "vtest")
part("vtruths", "SELECT session_id AS case_id, item_id FROM vtest WHERE pos = n", "vtest")
part("vecs", """
  SELECT vec_id AS item_id, embedding::DOUBLE[] AS v, label FROM embeddings""")
part("vcounts", "SELECT item_id, count(*) AS c FROM vtrain GROUP BY 1", "vtrain")


def metrics_sql(recs: str, truths: str, counts: str, ks=(10, 20)) -> str:
    """CTE chain ``case_values, report`` over ``recs(model, case_id, rank, item_id)``."""
    k_list = ", ".join(f"({k})" for k in ks)
    return f"""
  ks AS (SELECT * FROM (VALUES {k_list}) t(top_k)),
  cut AS (SELECT model, case_id, top_k, item_id, min(rank) AS rank
          FROM {recs}, ks WHERE rank <= top_k GROUP BY ALL),
  placed AS (SELECT *, row_number() OVER (PARTITION BY model, case_id, top_k ORDER BY rank) AS p
             FROM cut WHERE case_id IN (SELECT case_id FROM {truths})),
  pop AS (SELECT item_id, row_number() OVER (ORDER BY c DESC, item_id) AS pr FROM {counts}),
  bits AS (SELECT item_id, -log2(c / (SELECT sum(c) FROM {counts})) AS b FROM {counts}),
  tsize AS (SELECT case_id, count(*) AS nt FROM {truths} GROUP BY 1),
  unexp AS (SELECT case_id, top_k, count(DISTINCT item_id) AS nu FROM {truths} JOIN ks ON true
            LEFT JOIN pop USING (item_id) WHERE coalesce(pr, 1000000) > top_k GROUP BY 1, 2),
  scored AS (
    SELECT model, case_id, top_k, count(*) AS ns,
           sum(CASE WHEN t.item_id IS NOT NULL THEN 1 / log2(p + 1.0) ELSE 0 END) AS dcg,
           sum(CASE WHEN t.item_id IS NOT NULL THEN 1.0 / p ELSE 0 END) AS rr,
           sum(CASE WHEN t.item_id IS NOT NULL THEN 1 ELSE 0 END) AS h,
           sum(CASE WHEN t.item_id IS NOT NULL AND coalesce(pr, 1000000) > top_k THEN 1 ELSE 0 END) AS uh,
           sum(coalesce(b, 0)) AS bits
    FROM placed LEFT JOIN (SELECT DISTINCT case_id, item_id FROM {truths}) t USING (case_id, item_id)
         LEFT JOIN pop ON pop.item_id = placed.item_id LEFT JOIN bits ON bits.item_id = placed.item_id
    GROUP BY 1, 2, 3),
  case_values AS (
    SELECT model, case_id, top_k,
           dcg / (SELECT sum(1 / log2(i + 1.0)) FROM range(1, least(nt, top_k) + 1) r(i)) AS ndcg,
           CASE WHEN h > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hr,
           CASE WHEN h > 0 THEN rr / h ELSE 0.0::DOUBLE END AS mrr,
           CASE WHEN least(coalesce(nu, 0), ns) > 0 THEN uh / least(nu, ns) ELSE 0 END AS ser,
           bits / ns AS nov
    FROM scored JOIN tsize USING (case_id) LEFT JOIN unexp USING (case_id, top_k)),
  report AS (
    SELECT model, top_k, 'NDCG' AS metric, avg(ndcg) AS value FROM case_values GROUP BY 1, 2
    UNION ALL SELECT model, top_k, 'HitRate', avg(hr) FROM case_values GROUP BY 1, 2
    UNION ALL SELECT model, top_k, 'MRR', avg(mrr) FROM case_values GROUP BY 1, 2
    UNION ALL SELECT model, top_k, 'Serendipity', avg(ser) FROM case_values GROUP BY 1, 2
    UNION ALL SELECT model, top_k, 'Novelty', avg(nov) FROM case_values GROUP BY 1, 2
    UNION ALL SELECT model, top_k, 'Catalog coverage',
              count(DISTINCT item_id) / (SELECT count(*) FROM {counts}) FROM placed GROUP BY 1, 2)"""
