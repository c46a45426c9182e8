"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

import re

from stratafield.llm.chat_format import Template
from stratafield.llm.url_filter import RULES, VARIABLE

_FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_FOLD.format('''coalesce(text, '')''')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP1 = f"""
WITH doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
item_window AS (
  SELECT DISTINCT item_id, n, list_slice(w, i, i + n - 1) AS win
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM (SELECT item_id, w, least(13, len(w)) AS n FROM item WHERE len(w) > 0))),
doc_window AS (
  SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM doc, (SELECT DISTINCT n FROM item_window) WHERE len(w) >= n)),
found AS (SELECT doc_id, n, i, item_id FROM doc_window JOIN item_window USING (n, win)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM found)) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS joined
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


def _rule_case(what: str) -> str:
    ordered = sorted(RULES, key=lambda r: (-len(r.host + r.path), r.action != "block", r.host))
    return "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.host + r.path if what == 'rule' else r.action}'" for r in ordered) + " END"


_DEPTH = 3


def _level(k: int) -> str:
    above = "host" if k == 1 else "host, " + ", ".join(f"g{i}" for i in range(1, k))
    child = f"s{k + 1}" if k < _DEPTH else "tail"
    return f"""
h{k} AS (SELECT {above}, s{k}, sum(n) AS hn FROM l{k - 1} GROUP BY ALL),
p{k} AS (SELECT {above}, sum(hn) AS pn FROM h{k} GROUP BY ALL),
r{k} AS (SELECT l{k - 1}.*, CASE WHEN s{k} <> '' AND hn < 0.02::DOUBLE * pn THEN '*' ELSE s{k} END AS r
         FROM l{k - 1} JOIN h{k} USING ({above}, s{k}) JOIN p{k} USING ({above})),
every{k} AS (SELECT {above}, r, {child} AS child, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b, sum(n - a - b)::DOUBLE AS u FROM r{k} WHERE r <> '' GROUP BY ALL),
size{k} AS (SELECT * FROM (SELECT {above}, r, sum(a + b + u) AS mine FROM every{k} GROUP BY ALL) WHERE mine >= 8),
kid{k} AS (
  SELECT {above}, r, child, sum(a) / any_value(mine) AS a, sum(b) / any_value(mine) AS b, sum(u) / any_value(mine) AS u
  FROM (SELECT * REPLACE (CASE WHEN child <> '' AND a + b + u < 0.02::DOUBLE * mine THEN '*' ELSE child END AS child) FROM every{k} JOIN size{k} USING ({above}, r)) GROUP BY {above}, r, child),
heavy{k} AS (SELECT {above}, r AS model, row_number() OVER (PARTITION BY {above} ORDER BY mine DESC, r) AS place FROM size{k} QUALIFY place <= 4),
model{k} AS (SELECT h.*, child, a AS ma, b AS mb, u AS mu FROM heavy{k} h JOIN kid{k} k ON model = r AND {" AND ".join(f"h.{x} = k.{x}" for x in above.split(", "))}),
like{k} AS (
  SELECT {above}, r, min_by(model, place) AS model FROM (
    SELECT {above}, r, model, place FROM kid{k} JOIN model{k} USING ({above}, child) GROUP BY ALL HAVING sum(least(a, ma) + least(b, mb) + least(u, mu)) >= 0.75::DOUBLE) GROUP BY ALL),
l{k} AS (SELECT r{k}.* EXCLUDE (r), coalesce('~' || model, r) AS g{k} FROM r{k} LEFT JOIN like{k} USING ({above}, r))"""


OP8 = f"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, {_FOLD.format("regexp_extract(rest, '^[^/?#]*')")} AS host, substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) AS tail FROM cut),
base AS (SELECT page_id, host, regexp_extract(tail, '^[^?#]*') AS path FROM parts),
ruled AS (
  SELECT *, {_rule_case("rule")} AS rule, {_rule_case("action")} AS action,
    [CASE WHEN regexp_matches(x, '{VARIABLE}') THEN '*' ELSE x END FOR x IN string_split(path, '/')[2:]] AS seg FROM base),
general AS (
  SELECT page_id, host, path, rule, action, {", ".join(f"coalesce(seg[{k}], '') AS s{k}" for k in range(1, _DEPTH + 1))}, array_to_string(seg[{_DEPTH + 1}:], '/') AS tail
  FROM ruled),
l0 AS (SELECT host, {", ".join(f"s{k}" for k in range(1, _DEPTH + 1))}, tail, count(*) AS n, count(*) FILTER (action = 'block') AS b, count(*) FILTER (action = 'allow') AS a FROM general GROUP BY ALL),
{",".join(_level(k) for k in range(1, _DEPTH + 1))},
node AS (SELECT host, {", ".join(f"s{k}" for k in range(1, _DEPTH + 1))}, tail, a, b, concat_ws('/', {", ".join(f"g{k}" for k in range(1, _DEPTH + 1))}, tail) AS template FROM l{_DEPTH}),
template AS (SELECT host, template, sum(a)::DOUBLE AS ta, sum(b)::DOUBLE AS tb FROM node GROUP BY ALL),
corpus AS (SELECT CASE WHEN sum(ta + tb) > 0 THEN sum(tb) / sum(ta + tb) ELSE 0.5::DOUBLE END AS prior FROM template),
judged AS (
  SELECT host, {", ".join(f"s{k}" for k in range(1, _DEPTH + 1))}, tail, ta + tb > 0 AND (tb + 2.0::DOUBLE * prior) / (ta + tb + 2.0::DOUBLE) >= 0.7::DOUBLE AS bad
  FROM node JOIN template USING (host, template), corpus)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict
FROM general LEFT JOIN judged USING (host, {", ".join(f"s{k}" for k in range(1, _DEPTH + 1))}, tail)
"""

_TEMPLATE = Template()
_CONTROLS = "|".join(re.escape(c).replace("'", "''") for c in _TEMPLATE.controls)
_MARKED = "CASE role " + " ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b, _) in _TEMPLATE.turns.items()) + f" ELSE {sum(map(len, _TEMPLATE.other))} + length(role) + len(regexp_extract_all(role, '\\\\|{_CONTROLS}')) END"

OP10 = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
whole AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    {len(_TEMPLATE.begin)} + sum(length(text) + len(regexp_extract_all(text, '\\\\|{_CONTROLS}')) + {_MARKED}) AS formatted_chars
  FROM said GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars FROM whole
"""

ORACLE_SQL = {"op1_decontamination": OP1, "op8_url_filter": OP8, "op10_chat_format": OP10}
