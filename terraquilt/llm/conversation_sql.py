"""DuckDB SQL for the queries on conversations."""

#: CRC-32 of the ASCII text `{0}`, byte by byte and bit by bit.
CRC32 = """xor(list_reduce(
    [4294967295::BIGINT] || list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))::BIGINT),
    lambda c, b: list_reduce([xor(c, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))
  ), 4294967295)"""

_EDIT = "{{'c': {0}[{1}].c + {2}, 'a': {3} || {0}[{1}].a}}"


def _edit(source: str, state: int, cost: str, letters: str) -> str:
    return _EDIT.format(source, state, cost, f"'{letters}'")


def _repair_sql() -> str:
    """States: 1 nothing yet, 2 after s, 3 after u, 4 after a."""
    inserted = {1: 3, 2: 3, 3: 4, 4: 3}
    kept = {1: {"s": 2, "u": 3}, 2: {"u": 3}, 3: {"a": 4}, 4: {"u": 3}}
    bases, bests = [], []
    for s in range(1, 5):
        options = [_edit("v", s, "3", "D"), f"CASE WHEN stays THEN {_edit('v', inserted[s], '2 + cut', 'R')} END"]
        options += [f"CASE WHEN stays AND initial = '{r}' THEN {_edit('v', t, 'cut', 'K')} END" for r, t in kept[s].items()]
        bases.append(f"least({', '.join(options)})")
        once = inserted[s]
        bests.append(f"least(b[{s}], {_edit('b', once, '2', 'I')}, {_edit('b', inserted[once], '4', 'II')})")
    return f"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations
), d AS (
  SELECT conv_id, turn, text, role, {CRC32.format("k")} % 20 AS kind FROM c
), e AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM d WHERE kind <> 0
), f AS (
  SELECT *, left(role, 1) AS initial,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen
  FROM e
), g AS (
  SELECT *, row_number() OVER w AS i, lag(initial) OVER w AS before,
    CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault
  FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), seen)
), n AS (
  SELECT conv_id, count(i) AS n, coalesce(max(g.turn) - min(g.turn) + 1 - count(DISTINCT g.turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id AS id FROM conversations) q LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM q.id
  GROUP BY q.id, conv_id
), m AS (SELECT q.conv_id, n.* EXCLUDE (conv_id) FROM (SELECT DISTINCT conv_id FROM conversations) q
  LEFT JOIN (SELECT * FROM n WHERE n > 0) n ON n.conv_id IS NOT DISTINCT FROM q.conv_id
), z AS (
  SELECT conv_id, coalesce(n, 0) + 1 AS i, [{{'c': 0, 'a': ''}}, {{'c': 4, 'a': 'II'}}, {{'c': 2, 'a': 'I'}}, {{'c': 0, 'a': ''}}] AS v FROM m
  UNION ALL
  SELECT conv_id, i, [{", ".join(bests)}] FROM (
    SELECT conv_id, i, [{", ".join(bases)}] AS b FROM (
      SELECT z.conv_id, g.i, v, initial, fault NOT IN ('blank', 'duplicate') AS stays, CASE fault WHEN 'truncated' THEN 1 ELSE 0 END AS cut
      FROM z JOIN g ON g.conv_id IS NOT DISTINCT FROM z.conv_id AND g.i = z.i - 1
    )
  )
), a AS (SELECT conv_id, v[1].c AS cost, v[1].a AS audit FROM z WHERE i = 1
), l AS (
  SELECT conv_id, unnest(range(1, length(audit) + 1)) AS pos, audit FROM a
), r AS (
  SELECT conv_id, substr(audit, pos, 1) AS edit, length(replace(left(audit, pos), 'I', '')) AS i,
    length(replace(left(audit, pos), 'D', '')) AS place FROM l
), o AS (
  SELECT r.conv_id, r.place, edit, g.role, coalesce(CASE WHEN edit <> 'I' THEN g.text END, '') AS text, g.initial
  FROM r LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM r.conv_id AND g.i = r.i AND edit <> 'I' WHERE edit <> 'D'
), p AS (
  SELECT *, max(CASE WHEN place = 1 AND edit = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS headed FROM o
), s AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - headed) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text,
    chr(10) ORDER BY place)) AS repaired_sha256 FROM p GROUP BY conv_id
)
SELECT m.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, cost::BIGINT AS cost, audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM m JOIN a ON a.conv_id IS NOT DISTINCT FROM m.conv_id LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM m.conv_id
"""


REPAIR = _repair_sql()

TRIE = f"""
WITH t AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR) AS k, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS x
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (SELECT conv_id, x, {CRC32.format("k")} % 4 AS h FROM t
), r AS (
  SELECT a.conv_id, list_concat(coalesce(b.x[1:a.h], []), a.x[a.h + 1:]) AS x
  FROM h a LEFT JOIN t b ON b.conv_id = a.conv_id - a.conv_id % 20
), p AS (SELECT conv_id, x, unnest(range(0, len(x) + 1)) AS depth FROM r
), n AS (
  SELECT x[1:depth] AS x, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(x) = depth), '')) AS ends_sha256
  FROM p GROUP BY ALL
), c AS (SELECT x[1:depth - 1] AS x, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL
), b AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children,
    CASE WHEN depth > 0 THEN (n_convs - 1) * len(regexp_extract_all(n.x[-1].t, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS saved
  FROM n LEFT JOIN c ON c.x = n.x
), u AS (SELECT x, depth, n_children, saved, unnest(range(0, depth + 1)) AS above FROM b
), s AS (
  SELECT x[1:above] AS x, CAST(sum(saved) AS BIGINT) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM u GROUP BY ALL
)
SELECT b.conv_id, b.depth, a.conv_id AS parent_conv_id, b.n_convs, b.n_children, n_leaves, saved_tokens, b.ends_sha256
FROM b JOIN s ON s.x = b.x LEFT JOIN n a ON a.depth = b.depth - 1 AND a.x = b.x[1:b.depth - 1]
"""

FORMAT = r"""
WITH t AS (
  SELECT conv_id, turn, 0 AS place, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, 0, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(replace(text, '\', '\\')) + len(regexp_extract_all(text, '[<\[](s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\]|ROLE\]|/ROLE\])')) AS body,
    length(replace(role, '\', '\\')) + len(regexp_extract_all(role, '[<\[](s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\]|ROLE\]|/ROLE\])')) AS named
  FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, place, role, md5(text))) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, place, role, md5(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(body + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 15 WHEN 'assistant' THEN 4 ELSE 17 + named END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
