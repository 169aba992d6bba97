"""SQL that gives the rows of text queries."""

from __future__ import annotations


def linked_components(words: int, percent: int, kept: bool) -> str:
    """Components of documents whose sets of word shingles are similar, by all pairs that share a shingle."""
    shingles = " || ' ' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(words))
    return f"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), parts AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - {words - 1}, 1) + 1)) AS i FROM cut WHERE len(w) > 0
), shingle AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < {words} THEN array_to_string(w, ' ') ELSE {shingles} END AS s FROM parts
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id
  JOIN size na ON na.doc_id = a.doc_id JOIN size nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING {100 + percent} * count(*) >= {percent} * (na.n + nb.n)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM size
  UNION
  SELECT reach.a, CASE WHEN link.a = reach.b THEN link.b ELSE link.a END FROM reach JOIN link ON link.a = reach.b OR link.b = reach.b
), least AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT c.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, c.doc_id) AS component_id
  {", coalesce(component_id, c.doc_id) = c.doc_id AS kept" if kept else ""}
FROM cut c LEFT JOIN size ON size.doc_id = c.doc_id LEFT JOIN least ON least.doc_id = c.doc_id
"""


def repaired_conversations() -> str:
    """Damage, faults and the least repair of each conversation, row after row over the four states of a legal beginning.

    A value is ``cost`` in twelve digits and then the audit, so the least string is the least value.
    """

    def add(value: str, cost: str | int, letter: str) -> str:
        return f"CASE WHEN {value} = 'z' THEN 'z' ELSE lpad((left({value}, 12)::BIGINT + {cost})::VARCHAR, 12, '0') || substr({value}, 13) || '{letter}' END"

    def keep(state: str, initial: str) -> str:
        return f"CASE WHEN code = '{initial}' THEN {add(state, 'more', 'K')} ELSE 'z' END"

    def move(*states: str) -> str:
        return f"CASE WHEN code = 'd' THEN 'z' ELSE least({', '.join(add(s, '3 + more', 'R') for s in states)}) END"

    return f"""
WITH RECURSIVE table256 AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS t FROM range(256) r(n)
), given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    [ascii(x)::BIGINT for x in string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')] AS bytes FROM conversations
), hashed AS (
  SELECT given.*, xor(list_reduce(bytes, lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) % 20 AS fault FROM given, table256
), made AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, range(2) r(copy) WHERE fault <> 0 AND (copy = 0 OR fault = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 32), md5(text)) AS i,
    trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM made
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS copy FROM placed
), coded AS (
  SELECT conv_id, turn, i, role, text, left(role, 1) AS initial,
    CASE WHEN body = '' THEN 'blank' WHEN copy > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM seen
), letters AS (
  SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'd' WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'x' END AS code,
    CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more,
    coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal FROM coded
), ids AS (
  SELECT DISTINCT conv_id FROM conversations
), walk AS (
  SELECT conv_id, 0::BIGINT AS i, '000000000000' AS e, 'z' AS s, '000000000003I' AS u, '000000000006II' AS a FROM ids
  UNION ALL
  SELECT conv_id, i, e, s, least(u, {add("a", 3, "I")}, {add("e", 3, "I")}, {add("s", 3, "I")}),
    least(a, {add(f"least(u, {add('e', 3, 'I')}, {add('s', 3, 'I')})", 3, "I")})
  FROM (
    SELECT w.conv_id, l.i, {add("e", 4, "D")} AS e, least({add("s", 4, "D")}, {keep("e", "s")}) AS s,
      least({add("u", 4, "D")}, {keep("e", "u")}, {keep("s", "u")}, {keep("a", "u")}, {move("e", "s", "a")}) AS u,
      least({add("a", 4, "D")}, {keep("u", "a")}, {move("u")}) AS a
    FROM walk w JOIN letters l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.i = w.i + 1
  )
), ends AS (
  SELECT conv_id, least(e, a) AS value FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
), plans AS (
  SELECT conv_id, left(value, 12)::BIGINT AS cost, substr(value, 13) AS audit FROM ends
), edits AS (
  SELECT conv_id, k, audit[k] AS letter, len(replace(audit[:k], 'I', '')) AS i, len(replace(audit[:k], 'D', '')) AS place FROM plans, range(1, len(audit) + 1) r(k)
), output AS (
  SELECT d.conv_id, d.k, d.place, CASE WHEN letter = 'K' THEN l.role ELSE NULL END AS role, CASE WHEN letter = 'I' THEN '' ELSE l.text END AS text,
    max(CASE WHEN d.place = 1 AND letter = 'K' AND l.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY d.conv_id) AS led
  FROM edits d LEFT JOIN letters l ON l.conv_id IS NOT DISTINCT FROM d.conv_id AND l.i = d.i AND letter <> 'I' WHERE letter <> 'D'
), digests AS (
  SELECT conv_id, sha256(string_agg(coalesce(role, CASE WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY k)) AS h FROM output GROUP BY conv_id
), counted AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM letters GROUP BY conv_id
)
SELECT p.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, cost, audit, coalesce(h, sha256('')) AS repaired_sha256
FROM plans p LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM p.conv_id LEFT JOIN digests d ON d.conv_id IS NOT DISTINCT FROM p.conv_id
"""
