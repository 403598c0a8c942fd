"""DuckDB SQL for the queries that SQL can express. The others are tested against plain versions."""

from __future__ import annotations

from . import urlfilter

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
_ALNUM = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
win AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
key AS (SELECT doc_id, i, list_aggregate(w[i:i + 49], 'string_agg', ' ') AS k FROM win),
low AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS m FROM key),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM low WHERE m < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT word.doc_id, count(gone.p) AS n_removed, string_agg(x, ' ' ORDER BY word.p) FILTER (WHERE gone.p IS NULL) AS t
         FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
r AS (SELECT *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS e FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length(role) + 1 + length(e) + 10 + 1) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_ALNUM.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM.format(_LOWER.format("coalesce(text, '')"))} AS w FROM benchmark),
s AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
pat AS (SELECT DISTINCT item_id, n, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM s)),
size AS (SELECT DISTINCT n FROM pat),
win AS (SELECT doc_id, n, i, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM d, size WHERE len(w) >= n)),
hit AS (SELECT win.doc_id, win.i, win.n, pat.item_id FROM win JOIN pat ON win.n = pat.n AND win.k = pat.k),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id),
word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN item ON d.doc_id = item.doc_id LEFT JOIN word ON d.doc_id = word.doc_id
"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER.format("text"))} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id <> b.doc_id JOIN size x ON x.doc_id = a.doc_id JOIN size y ON y.doc_id = b.doc_id
         GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(reach.b) AS component_id
FROM d LEFT JOIN size ON size.doc_id = d.doc_id JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id
"""


def _weights(terms: dict[str, float]) -> str:
    low = _LOWER.format("coalesce(url, '')")
    return "[" + ", ".join(f"CASE WHEN regexp_matches({low}, '(^|[^a-z0-9]){t}($|[^a-z0-9])') THEN {float(w)!r}::DOUBLE ELSE 0 END" for t, w in terms.items()) + "]"


def _fits(rule: str) -> str:
    host, path = rule.partition("/")[0], rule[rule.index("/") :]
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


def url_filter() -> str:
    longest = sorted(urlfilter.RULES, key=lambda r: -len(r[1]))
    rule = " ".join(f"WHEN {_fits(r)} THEN '{r}'" for _, r in longest)
    verdict = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in longest)
    return rf"""
WITH u AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
j AS (SELECT *, CASE {rule} END AS rule, {_weights(dict.fromkeys(urlfilter.STRICT, 1.0))} AS strict, {_weights(urlfilter.SOFT)} AS soft FROM h),
c AS (SELECT *, CAST(list_sum(strict) AS BIGINT) AS n_strict, len(list_filter(soft, lambda w: w > 0)) AS n_soft, round(list_sum(soft), 6) + 0 AS soft_weight FROM j)
SELECT page_id, host, path, rule, n_strict, n_soft, soft_weight,
  CASE {verdict} WHEN n_strict > 0 OR (n_soft >= {urlfilter.SOFT_TERMS} AND soft_weight >= {urlfilter.SOFT_WEIGHT}) THEN 'block' ELSE 'allow' END AS verdict
FROM c
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": SUBSTRING_DEDUP,
        "op3_chat_format": CHAT,
        "op4_decontaminate": DECONTAMINATE,
        "op9_jaccard": JACCARD,
        "op10_url_filter": url_filter(),
    }
