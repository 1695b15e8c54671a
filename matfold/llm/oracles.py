"""DuckDB SQL of queries whose results plain SQL can express on whole tables."""

from __future__ import annotations

# Table of the CRC-32 polynomial, one entry per byte, by eight shifts from the byte.
_STEP = "xor({0} >> 1, CASE WHEN ({0} & 1) = 1 THEN 3988292384 ELSE 0 END)"
_EIGHT = "b0"
for _ in range(8):
    _EIGHT = f"(SELECT {_STEP.format('x')} FROM (SELECT {_EIGHT} AS x))"
CRC = f"crc AS (SELECT list(v ORDER BY b0) AS t FROM (SELECT b0, {_EIGHT} AS v FROM (SELECT CAST(range AS BIGINT) AS b0 FROM range(256))))"


def crc32(of: str) -> str:
    """CRC-32 of a list of bytes, the table being ``t``."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {of}), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295)"


def _bytes(s: str) -> str:
    """UTF-8 bytes of a text of code points up to U+00FF."""
    return (f"flatten(list_transform(string_split({s}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] "
            "ELSE [(192 + (unicode(c) >> 6))::BIGINT, (128 + (unicode(c) & 63))::BIGINT] END))")


_BLANK = r"\x09-\x0D "
_NONE = "{'c': 1000000000, 'a': '', 'k': []::VARCHAR[]}"


def _add(s: str, cost: str, letter: str, kept: str | None = None) -> str:
    held = f"list_prepend({kept}, {s}.k)" if kept else f"{s}.k"
    return f"{{'c': {s}.c + {cost}, 'a': '{letter}' || {s}.a, 'k': {held}}}"


def _state(q: int) -> str:
    """Cheapest, then least way through the row from state q, before inserts."""
    to = (2, 2, 3, 2)[q]
    role = ("", "", "user", "assistant")[to]
    keep = {0: [("s", 1), ("u", 2)], 1: [("u", 2)], 2: [("a", 3)], 3: [("u", 2)]}[q]
    ways = [_add(f"s{q}", "2", "D")]
    ways += [f"CASE WHEN fault IN ('', 'truncated') AND mark = '{c}' THEN {_add(f's{p}', 'more', 'K', 'line')} ELSE {_NONE} END" for c, p in keep]
    ways.append(f"""CASE WHEN fault IN ('', 'truncated') THEN {_add(f's{to}', '1 + more', 'R', f"'{role}:' || text")} ELSE {_NONE} END""")
    return f"list_min([{', '.join(ways)}])"


def _insert(own: str, other: str, role: str) -> str:
    return f"""list_min([{own}, {_add(other, '5', 'I', f"'{role}:'")}])"""


OP11 = f"""
WITH RECURSIVE {CRC},
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {crc32(_bytes("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))"))} % 20 AS kind FROM conversations, crc),
damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM src WHERE kind <> 0),
placed AS (SELECT *, left(role, 1) AS mark, role || ':' || text AS line,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again FROM damaged),
rows_ AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^{_BLANK}]') THEN 'blank' WHEN again > 1 THEN 'duplicate'
    WHEN regexp_extract(text, '([^{_BLANK}])[{_BLANK}]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lag(mark) OVER (PARTITION BY conv_id ORDER BY i) || mark AS pair FROM placed),
stats AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
  count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY conv_id),
way AS (
  SELECT conv_id, n + 1 AS i, {{'c': 0, 'a': '', 'k': []::VARCHAR[]}} AS s0, {{'c': 10, 'a': 'II', 'k': ['user:', 'assistant:']}} AS s1,
    {{'c': 5, 'a': 'I', 'k': ['assistant:']}} AS s2, {{'c': 0, 'a': '', 'k': []::VARCHAR[]}} AS s3 FROM stats
  UNION ALL
  SELECT conv_id, i, {_insert('k0', 's2', 'user')}, {_insert('k1', 's2', 'user')}, s2, s3 FROM (
    SELECT conv_id, i, k0, k1, {_insert('k2', 'k3', 'assistant')} AS s2, {_insert('k3', 'k2', 'user')} AS s3 FROM (
      SELECT conv_id, i, {', '.join(f'{_state(q)} AS k{q}' for q in range(4))} FROM (
        SELECT w.*  EXCLUDE (i), r.i, r.fault, r.mark, r.line, r.text, CASE r.fault WHEN 'truncated' THEN 5 ELSE 0 END AS more
        FROM way w JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i - 1)))),
done AS (SELECT conv_id, s0 FROM way WHERE i = 1)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(s0.c, 0) AS BIGINT) AS cost,
  coalesce(s0.a, '') AS audit, sha256(coalesce(array_to_string(s0.k, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN stats s ON a.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN done d ON a.conv_id IS NOT DISTINCT FROM d.conv_id
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP12 = f"""
WITH RECURSIVE {CRC},
runs AS (SELECT doc_id, translate(run, '{_UPPER}', '{_LOWER}') AS w, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
hashed AS (SELECT w, c, {crc32(_bytes("(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)"))} AS h FROM runs, crc WHERE length(w) >= 6),
words AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, c FROM hashed),
vocab AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM words WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
cuts AS (SELECT word, n, i, left(word, i - 1) AS pre, substr(word, i + 1) AS post FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.i = b.i AND a.pre = b.pre AND a.post = b.post AND a.word <> b.word
  UNION SELECT c.word, v.word, v.n FROM cuts c JOIN vocab v ON v.word = c.pre || c.post
  UNION SELECT v.word, c.word, c.n FROM cuts c JOIN vocab v ON v.word = c.pre || c.post),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, encode(other)) AS other, max(n) AS other_n FROM near GROUP BY word),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * v.n THEN other END AS form, CASE WHEN other_n >= 5 * v.n THEN other_n END AS form_n
  FROM vocab v LEFT JOIN best b USING (word)),
way AS (SELECT word, word AS at FROM forms UNION ALL SELECT w.word, f.form FROM way w JOIN forms f ON f.word = w.at WHERE f.form IS NOT NULL),
roots AS (SELECT w.word, w.at AS root FROM way w JOIN forms f ON f.word = w.at WHERE f.form IS NULL)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM forms JOIN roots USING (word)
"""

# Windows of 400 bytes as 800 hex digits; a byte goes if it is within 400 of the start of a window that has another.
OP13 = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
starts AS (SELECT r, i, md5(substring(x, 2 * i + 1, 800)) AS h FROM (SELECT r, x, unnest(range(length(x) // 2 - 399)) AS i FROM docs)),
shared AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM starts) WHERE n > 1),
runs AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM (
  SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM (
    SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM shared)) GROUP BY r, run),
cut AS (SELECT r, sum(b - a) AS removed, count(*) AS spans, list({'a': a, 'b': b} ORDER BY a) AS s FROM runs GROUP BY r)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN s IS NULL THEN x ELSE array_to_string(list_transform(range(len(s) + 1), lambda k:
    substring(x, 2 * CASE k WHEN 0 THEN 0 ELSE s[k].b END + 1,
              2 * (CASE WHEN k = len(s) THEN length(x) // 2 ELSE s[k + 1].a END - CASE k WHEN 0 THEN 0 ELSE s[k].b END))), '') END)) AS kept_sha256
FROM docs LEFT JOIN cut USING (r)
"""
