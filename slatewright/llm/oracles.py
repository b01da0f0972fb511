"""SQL of the operators that SQL can express, for checking results side by side."""

SQL: dict[str, str] = {}

_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op2_substring_dedup"] = f"""
WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS words FROM documents),
spots AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS p, words FROM w WHERE len(words) >= 20),
win AS (SELECT doc_id, p, array_to_string(words[p:p + 19], ' ') AS g FROM spots),
later AS (SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM later),
marks AS (SELECT doc_id, list(i) AS l, count(*) AS n FROM gone GROUP BY 1),
numbered AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM numbered ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN marks USING (doc_id) LEFT JOIN kept USING (doc_id)"""

# CRC-32 by its public definition: polynomial 0xEDB88320, byte by byte over a table made from it.
_CRC_TABLE = """list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
    lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"""

SQL["op3_sharding"] = f"""
WITH crc_table AS (SELECT {_CRC_TABLE} AS t),
light AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS h FROM documents),
drawn AS (SELECT doc_id, source, (len(h) // 2 + 8)::BIGINT AS size, {_CRC} AS text_crc32,
                 md5('interleave|' || doc_id || '|1') AS draw FROM light, crc_table),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY draw) - 1 AS k, count(*) OVER (PARTITION BY source) AS n
           FROM drawn),
placed AS (SELECT *, row_number() OVER (ORDER BY (k + 0.5::DOUBLE) / n, draw, source) - 1 AS place, count(*) OVER () AS total
           FROM ranked),
cut AS (SELECT *, place * 24 // total AS s FROM placed)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, s::INTEGER AS shard,
       (place - (s * total + 23) // 24)::BIGINT AS slot, NULL::INTEGER AS grown_shard, source FROM cut"""

# log_p accumulates in the order of the operator, so that both sum alike.
SQL["op6_mixing"] = """
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
rates AS (SELECT source, sum(n) OVER () * pow(n::DOUBLE, 0.7) / sum(pow(n::DOUBLE, 0.7)) OVER () / n AS rate FROM counts),
steps AS (
  SELECT source, rate, 0 AS k, -rate AS log_p, exp(-rate) AS below FROM rates
  UNION ALL
  SELECT source, rate, k + 1, log_p + ln(rate) - ln((k + 1)::DOUBLE), below + exp(log_p + ln(rate) - ln((k + 1)::DOUBLE))
  FROM steps WHERE k < ceil(rate + 12 * sqrt(rate) + 20)),
drawn AS (SELECT doc_id, source, ('0x' || substr(md5('mixing|' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
          FROM documents),
copies AS (SELECT doc_id, source, rate, count(*) FILTER (WHERE below <= u) AS n FROM drawn JOIN steps USING (source) GROUP BY 1, 2, 3)
SELECT doc_id, source, unnest(range(1, n + 1))::INTEGER AS copy, round(rate, 9) AS rate FROM copies"""

_NORM = (r"list_filter(regexp_split_to_array(" + _LOWER + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')")

SQL["op9_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_NORM.format(text="coalesce(text, '')")} AS words FROM documents),
b AS (SELECT item_id, {_NORM.format(text="coalesce(text, '')")} AS words FROM benchmark),
known AS (SELECT DISTINCT item_id, least(len(words), 10) AS n, array_to_string(words[p:p + least(len(words), 10) - 1], ' ') AS g
          FROM (SELECT item_id, words, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS p FROM b WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT n FROM known),
spots AS (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS p FROM d, sizes WHERE len(words) >= n),
hits AS (SELECT doc_id, p, n, item_id FROM (SELECT doc_id, p, n, array_to_string(words[p:p + n - 1], ' ') AS g FROM spots)
         JOIN known USING (n, g)),
inside AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS i FROM hits) GROUP BY 1),
found AS (SELECT doc_id, count(i) AS n_items, string_agg(i, ',' ORDER BY i) AS l
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY 1)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN inside USING (doc_id) LEFT JOIN found USING (doc_id)"""

SQL["op10_jaccard_join"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=_LOWER.format(text="coalesce(text, '')"))} AS words FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(words[p:p + 3], ' ') AS g FROM (
            SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS p FROM w WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m AS component_id
FROM documents LEFT JOIN sizes USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS m FROM reach GROUP BY 1) USING (doc_id)"""

# Strengths of the levels are moments of beta-binomial laws; the tail is the incomplete beta function's continued fraction.
_REST = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
_NAME = r"regexp_extract(host, '^(?:.*@)?(.*?)\.?(?::[0-9]*)?$', 1)"
_SECOND = r"(?:ac|co|com|edu|go|gov|mil|ne|net|nom|or|org)\.[a-z][a-z]"
_SUFFIX = rf"regexp_extract(name, '(?:^|\.)((?:{_SECOND}|[^.]*))$', 1)"
_DOMAIN = rf"regexp_extract(name, '([^.]+\.(?:{_SECOND}|[^.]+))$', 1)"
_STRENGTH = """SELECT CASE WHEN coalesce(sum(room), 0) = 0 OR sum(excess) <= 0 THEN 1000.0
    ELSE least(1000.0, greatest(1.0, sum(room) / sum(excess) - 1)) END::DOUBLE AS s FROM (
    SELECT r2 - k * k / n - (k / n) * (1 - k / n) * (m - 1) AS excess, (k / n) * (1 - k / n) * (n - n2 / n - (m - 1)) AS room FROM (
      SELECT sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS k, count(*) AS m, sum(n * n)::DOUBLE AS n2, sum(bad::DOUBLE * bad / n) AS r2
      FROM {rows} WHERE n > 0 GROUP BY {parent}) WHERE n > 0)"""
_WEIGHED = "sum(n * ((s + 1) / (n + s))) AS n, sum(bad * ((s + 1) / (n + s))) AS bad"
_TERM = """CASE WHEN m::BIGINT % 2 = 0
    THEN (m // 2) * (b - m // 2) * y / ((a + 2 * (m // 2) - 1) * (a + 2 * (m // 2)))
    ELSE -(a + m // 2) * (a + b + m // 2) * y / ((a + 2 * (m // 2)) * (a + 2 * (m // 2) + 1)) END"""

SQL["op11_url_filter"] = f"""
WITH RECURSIVE p AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
rest AS (SELECT page_id, {_REST} AS r FROM p),
cut AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(rule, rule_verdict, rule_host, rule_path) AS (VALUES
  ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'),
  ('www.example.com/en/', 'allow', 'www.example.com', '/en/'), ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')),
seen AS (SELECT DISTINCT host, path FROM cut),
ruled AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(rule_verdict, length(rule)) AS rule_verdict
          FROM seen JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY 1, 2),
said AS (SELECT doc_id AS page_id, CASE WHEN toxic = 1 OR quality = 0 THEN 1 WHEN toxic IS NULL OR quality IS NULL THEN NULL ELSE 0 END AS bad FROM labels),
h AS (SELECT host, count(said.bad) AS n, coalesce(sum(said.bad), 0)::BIGINT AS bad FROM cut LEFT JOIN said USING (page_id) GROUP BY 1),
named AS (SELECT *, {_NAME} AS name FROM h),
placed AS (SELECT host, n, bad, {_SUFFIX} AS suffix,
             CASE WHEN regexp_matches(name, '^[0-9.]+$') OR {_DOMAIN} = '' THEN name ELSE {_DOMAIN} END AS domain FROM named),
sh AS ({_STRENGTH.format(rows="placed", parent="domain")}),
d0 AS (SELECT suffix, domain, {_WEIGHED} FROM placed, sh GROUP BY 1, 2),
sd AS ({_STRENGTH.format(rows="d0", parent="suffix")}),
s0 AS (SELECT suffix, {_WEIGHED} FROM d0, sd GROUP BY 1),
ss AS ({_STRENGTH.format(rows="s0", parent="()")}),
mean AS (SELECT (coalesce(sum(bad * ((s + 1) / (n + s))), 0) + 0.5::DOUBLE) / (coalesce(sum(n * ((s + 1) / (n + s))), 0) + 1.0::DOUBLE) AS m FROM s0, ss),
s1 AS (SELECT suffix, (bad + s * m) / (n + s) AS above FROM s0, ss, mean),
d1 AS (SELECT domain, (bad + s * above) / (n + s) AS above FROM d0 JOIN s1 USING (suffix), sd),
h1 AS (SELECT host, bad + s * above AS alpha, n - bad + s * (1 - above) AS beta FROM placed JOIN d1 USING (domain), sh),
sides AS (SELECT host, alpha, beta, 0.5 < (alpha + 1) / (alpha + beta + 2) AS under FROM h1),
turned AS (SELECT host, alpha, beta, under, CASE WHEN under THEN alpha ELSE beta END AS a, CASE WHEN under THEN beta ELSE alpha END AS b, 0.5::DOUBLE AS y FROM sides),
parts AS (SELECT *, exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(y) + b * ln(1 - y)) / a
            / list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(200, 0, -1), lambda x: x::DOUBLE)), lambda f, m: 1 + ({_TERM}) / f) AS part
          FROM turned),
judged AS (SELECT host, CASE WHEN alpha + beta <= 20000 THEN (CASE WHEN under THEN 1 - part ELSE part END) >= 0.9
             ELSE (alpha / (alpha + beta) - 0.5) / sqrt(alpha * beta / (pow(alpha + beta, 2) * (alpha + beta + 1))) >= 1.2815515655446004 END AS blocked
           FROM parts)
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM cut LEFT JOIN ruled USING (host, path) JOIN judged USING (host)"""

_RUNS = "regexp_extract_all(" + _LOWER.format(text="text") + r", '[A-Za-z\x{C0}-\x{FF}]{7,}')"

SQL["op12_spelling_variants"] = f"""
WITH RECURSIVE crc_table AS (SELECT {_CRC_TABLE} AS t),
runs AS (SELECT doc_id, unnest({_RUNS}) AS w FROM documents),
own AS (SELECT w, c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS h FROM (SELECT doc_id, w, count(*) AS c FROM runs GROUP BY 1, 2)),
hashed AS (SELECT w, c, {_CRC} AS crc FROM own, crc_table),
spelt AS (SELECT CASE WHEN crc % 31 = 0 THEN substr(w, 1, crc % length(w)) || substr(w, crc % length(w) + 2) ELSE w END AS word, c FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM spelt WHERE length(word) >= 7 GROUP BY 1 HAVING sum(c) >= 2),
gaps AS (SELECT word, n, substr(word, 1, i - 1) AS p, substr(word, i + 1) AS s
         FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word AS x, b.word AS y, b.n AS n FROM gaps a JOIN gaps b ON a.p = b.p AND a.s = b.s AND a.word <> b.word
         UNION SELECT a.word, b.word, b.n FROM gaps a JOIN words b ON a.p || a.s = b.word
         UNION SELECT b.word, a.word, a.n FROM gaps a JOIN words b ON a.p || a.s = b.word),
firsts AS (SELECT x, y, n, count(*) OVER (PARTITION BY x) AS n_near, row_number() OVER (PARTITION BY x ORDER BY n DESC, y) AS k FROM near),
known AS (SELECT word, words.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN firsts.n >= 10 * words.n THEN y END AS form,
                 CASE WHEN firsts.n >= 10 * words.n THEN firsts.n END AS form_n
          FROM words LEFT JOIN firsts ON x = word AND k = 1),
ways AS (SELECT word, form AS r FROM known WHERE form IS NOT NULL
         UNION ALL SELECT ways.word, known.form FROM ways JOIN known ON known.word = r WHERE known.form IS NOT NULL),
ends AS (SELECT ways.word, r FROM ways JOIN known ON known.word = r WHERE known.form IS NULL)
SELECT word, form, coalesce(r, word) AS root, n, n_near, form_n FROM known LEFT JOIN ends USING (word)"""
