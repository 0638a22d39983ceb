"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

import re
from itertools import permutations

from . import chat, mixing

OP5_EXACT_DEDUP = """
WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS body FROM documents)
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       text_sha256
FROM t WINDOW same AS (PARTITION BY body)
"""


def _draw(seed: str) -> str:
    p = mixing.PRIME
    base = f"(((coalesce(doc_id, -1) % {p}) + {p}) % {p})"
    a = f"(({base} * 48271 + {seed} * 69621 + 12345) % {p})"
    b = f"(({a} * ({a} + {seed} * 2 + 1)) % {p})"
    return f"(({b} * 16807 + {a}) % {p})"


def _mixing() -> str:
    p = mixing.PRIME
    seeds = ", ".join(f"({s})" for s in mixing.SEEDS)
    return rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w FROM per
), ratios AS (
  SELECT *, 3e0 * source_size / w AS ratio FROM weighed
), levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
             - coalesce(sum(3e0 * source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
           / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0)) AS level
  FROM ratios
), targets AS (
  SELECT source, source_size,
         least(3e0 * source_size, w * coalesce((SELECT l.level FROM levels l WHERE l.level <= l.ratio ORDER BY l.ratio, l.level LIMIT 1), 0e0)) AS target
  FROM levels
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3e0) ELSE 0e0 END AS rate FROM targets
), draws AS (
  SELECT r.source, s.seed, r.rate, r.source_size,
         sum(CASE WHEN {_draw("s.seed")} < (r.rate - floor(r.rate)) * {p} THEN d.size ELSE 0 END) AS extra
  FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source CROSS JOIN (VALUES {seeds}) s(seed)
  GROUP BY ALL
), best AS (
  SELECT source, CAST(arg_min(seed, (round(abs(extra - (rate - floor(rate)) * source_size), 3), seed)) AS BIGINT) AS seed FROM draws GROUP BY source
)
SELECT d.doc_id, d.size, r.source_size, round(r.target, 6) AS target,
       CAST((floor(r.rate) + CASE WHEN {_draw("b.seed")} < (r.rate - floor(r.rate)) * {p} THEN 1 ELSE 0 END) * d.size AS BIGINT) AS taken
FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source JOIN best b ON d.source IS NOT DISTINCT FROM b.source
"""


OP8_VANTAGE_POINT_NEIGHBOURS = """
WITH u AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))) AS score
  FROM u q JOIN u c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def _warc() -> str:
    bits = "(('0x' || substr(h, {}, 1))::INT)"
    digits = []
    for k in range(32):  # five bits of the digest a character, out of hexadecimal digits
        lo, hi = 5 * k, 5 * k + 4
        a, b = lo // 4, hi // 4
        value = bits.format(a + 1)
        if a == b:
            value = f"({value} >> {3 - hi % 4}) & 31"
        else:
            value = f"((({value} << 4) | {bits.format(b + 1)}) >> {3 - hi % 4}) & 31"
        digits.append(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({value}) AS BIGINT) + 1, 1)")
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS keep FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, {" || ".join(digits)} AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
FROM k
"""


def _chat() -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    control = "|".join(re.escape(m).replace("/", "/") for m in chat.CONTROL)
    found = f"regexp_extract_all(text, {quoted(control)})"
    conflict = f"(contains(text, chr(92)) OR len({found}) > 0)"
    escapes = f"CASE WHEN {conflict} THEN len(text) - len(replace(text, chr(92), '')) + len({found}) ELSE 0 END"
    marks = " ".join(f"WHEN {quoted(r)} THEN {len(a) + len(b)}" for r, (a, b) in chat.MARKS.items())
    own = "</s>[INST] ok [/INST]"
    return f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {quoted(own)} UNION ALL SELECT -7, 1, 'assistant', {quoted(own)}
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN len(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(len(text) + {escapes} + CASE role {marks} ELSE {len(chat.ROLE + chat.BODY + chat.END)} + len(role) END) AS BIGINT) AS formatted_chars
FROM rows_ GROUP BY conv_id
"""


def _replay() -> str:
    bits = " + ".join(f"CASE WHEN {f} THEN {1 << i} ELSE 0 END" for i, f in enumerate("ABCDE"))
    orders = ", ".join(f"('{''.join(p)}')" for p in permutations("ABCDE"))
    bit = "CAST(power(2, instr('ABCDE', substr(filter_order, {}, 1)) - 1) AS INTEGER)"
    first = " ".join(f"WHEN mask & {bit.format(s)} <> 0 THEN {s}" for s in range(1, 6))
    return rf"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), f AS (
  SELECT doc_id, part, len(words) < 200 AS A, 100 * len(list_distinct(words)) < 50 * len(words) AS B,
         100 * len(regexp_replace(body, '[^A-Z]', '', 'g')) > 3 * len(body) AS C, regexp_matches(body, '[#$%&*|]') AS D,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY body), false) AS E
  FROM t
), l AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, {bits} AS mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN l USING (doc_id)
), o AS (
  SELECT part, mask, good, toxic, filter_order, CASE {first} ELSE 6 END AS gone FROM m CROSS JOIN (VALUES {orders}) o(filter_order)
), s AS (
  SELECT *, {bit.format("step")} AS bit FROM o CROSS JOIN (VALUES (1), (2), (3), (4), (5)) s(step)
), c AS (
  SELECT part, filter_order, step,
         count(*) FILTER (WHERE gone > step) AS kept,
         count(*) FILTER (WHERE gone = step) AS removed,
         count(*) FILTER (WHERE mask & bit <> 0 AND gone < step) AS redundant,
         count(*) FILTER (WHERE mask = bit) AS unique_fails,
         count(*) FILTER (WHERE gone = step AND good) AS good_lost,
         count(*) FILTER (WHERE gone = step AND toxic) AS toxic_lost
  FROM s GROUP BY ALL
)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)) AS BIGINT) AS shapley FROM c
"""


def _url_rules(min_support: str = "0.01", min_confidence: str = "0.9", vocabulary: int = 64, max_items: int = 10) -> str:
    from .queries import POLICIES

    host = r"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')"
    lowered = f"translate({host}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = r"coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
    query = r"coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '')"
    when = " ".join(
        f"WHEN (host = '{p.host}' OR ends_with(host, '.{p.host}')) AND starts_with(path, '{p.path}') THEN {{'rule': '{p.name}', 'verdict': '{p.verdict}'}}"
        for p in sorted(POLICIES, key=lambda p: -len(p.name))
    )

    def parts(text: str, sep: str, kind: str, word: str = "w") -> str:
        digits = f"list_transform(string_split({text}, '{sep}'), lambda w: regexp_replace({word}, '[0-9]+', '0', 'g'))"
        return f"list_transform(list_filter({digits}, lambda w: w <> ''), lambda w: '{kind}' || w)"

    tokens = f"list_distinct(list_concat({parts('host', '.', 'h:')}, {parts('path', '/', 'p:')}, {parts('query', '&', 'q:', 'string_split(w, chr(61))[1]')}))"
    return f"""
WITH p AS (SELECT page_id, url, {lowered} AS host, {path} AS path, {query} AS query FROM pages),
u AS (SELECT *, CASE {when} END AS policy, {tokens} AS tokens FROM p),
lab AS (SELECT DISTINCT url, tokens, policy.verdict AS label FROM u WHERE policy IS NOT NULL AND url IS NOT NULL),
n AS (SELECT count(*) AS total FROM lab),
nl AS (SELECT label, count(*) AS n_label FROM lab GROUP BY label),
tl AS (SELECT token, label, count(*) AS n FROM (SELECT unnest(tokens) AS token, label FROM lab) GROUP BY ALL),
tt AS (SELECT token, sum(n) AS n_token FROM tl GROUP BY token),
gaps AS (
  SELECT tt.token, n_token, max(CAST(abs(CAST(coalesce(tl.n, 0) AS HUGEINT) * total - CAST(n_token AS HUGEINT) * n_label) AS DOUBLE)) AS gap
  FROM tt CROSS JOIN n CROSS JOIN nl LEFT JOIN tl ON tl.token = tt.token AND tl.label = nl.label GROUP BY ALL
), voc AS (
  SELECT list(token ORDER BY gap DESC, token) AS v
  FROM (SELECT token, gap FROM gaps CROSS JOIN n WHERE n_token >= ceil({min_support}::DOUBLE * total) AND gap > 0 ORDER BY gap DESC, token LIMIT {vocabulary})
), it AS (
  SELECT url, label, list_slice(list_filter(v, lambda t: list_contains(tokens, t)), 1, {max_items}) AS items FROM lab CROSS JOIN voc
), sets AS (
  SELECT label, list_sort(list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 1)) AS tokens
  FROM (SELECT label, items, unnest(range(1, CAST(power(2, len(items)) AS BIGINT))) AS m FROM it)
), sl AS (SELECT tokens, label, count(*) AS n FROM sets GROUP BY ALL),
rules AS (
  SELECT tokens, label, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY tokens) AS confidence, CAST(n AS DOUBLE) / total AS support, n >= ceil({min_support}::DOUBLE * total) AS frequent
  FROM sl CROSS JOIN n
), mined AS (SELECT * FROM rules WHERE frequent AND confidence >= {min_confidence}::DOUBLE),
want AS (SELECT DISTINCT list_slice(list_filter(v, lambda t: list_contains(tokens, t)), 1, {max_items}) AS items FROM u CROSS JOIN voc),
best AS (
  SELECT items, tokens, label, confidence,
         row_number() OVER (PARTITION BY items ORDER BY confidence DESC, support DESC, len(tokens), tokens, label) AS r
  FROM want JOIN mined ON list_has_all(items, tokens)
)
SELECT page_id, host, path, policy.rule AS rule, coalesce(policy.verdict, label, 'allow') AS verdict,
       CASE WHEN policy IS NULL THEN array_to_string(b.tokens, ' ') END AS mined_rule, CASE WHEN policy IS NULL THEN confidence END AS mined_confidence
FROM u CROSS JOIN voc LEFT JOIN best b ON b.r = 1 AND b.items = list_slice(list_filter(v, lambda t: list_contains(u.tokens, t)), 1, {max_items})
"""


def _lloyd(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    steps = [f"""
WITH valid AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = {dims}
), v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(e, lambda x: floor(1024 * x)) AS c FROM valid
  WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id), c) - 1 AS INTEGER) AS j, c FROM v WHERE vec_id IS NOT NULL
  ORDER BY j LIMIT {k}
)"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, arg_min(j, (d, j)) AS j, min(d) AS d FROM (
    SELECT r, j, list_dot_product(v.c, v.c) - 2 * list_dot_product(v.c, c{i}.c) + list_dot_product(c{i}.c, c{i}.c) AS d FROM v CROSS JOIN c{i}
  ) GROUP BY r
)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT j, coalesce(n.c, o.c) AS c FROM c{i} o LEFT JOIN (
    SELECT j, list(floor(s / n) ORDER BY p) AS c FROM (
      SELECT j, p, sum(x) AS s, count(*) AS n FROM (SELECT a{i}.j, unnest(v.c) AS x, unnest(range({dims})) AS p FROM v JOIN a{i} USING (r)) GROUP BY j, p
    ) GROUP BY j
  ) n USING (j)
)""")
    return ",\n".join(steps) + f"""
SELECT vec_id, j AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c{rounds}.c, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM v JOIN a{rounds} USING (r) JOIN c{rounds} USING (j)
"""


ORACLES = {
    "op11_relational_filter_replay": _replay(),
    "op12_association_rule_urls": _url_rules(),
    "op13_delta_lloyd": _lloyd(),
    "op3_warc_capture_index": _warc(),
    "op8_vantage_point_neighbours": OP8_VANTAGE_POINT_NEIGHBOURS,
    "op10_chat_grammar_round_trip": _chat(),
    "op5_exact_dedup": OP5_EXACT_DEDUP,
    "op7_source_mixing": _mixing(),
}
