"""DuckDB SQL for the corpus queries that SQL can express."""

SQL: dict[str, str] = {}

_H = ", ".join(f"CAST('0x' || substr(h, {1 + 8 * k}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))

SQL["op13_fill_in_middle"] = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
 u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, {_H} FROM d),
 k AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
 p AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS x, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM k)
 SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(x) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || x || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

# Costs and audits of ways are kept as text, the cost in twelve digits before the audit, so that the least text is the best way.
_CRC = "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(s, ''), lambda x: CAST(unicode(x) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END))"


def _add(way: str, price: str, letter: str) -> str:
    return f"lpad(CAST(CAST(substr({way}, 1, 12) AS BIGINT) + {price} AS VARCHAR), 12, '0') || substr({way}, 13) || '{letter}'"


_TO_USER = "least(" + ", ".join(_add(w, "{price}", "{letter}") for w in ("w0", "w1", "w3")) + ")"
_R2, _K2, _I2 = (_TO_USER.format(price=p, letter=x) for p, x in (("3 + more", "R"), ("more", "K"), ("3", "I")))

SQL["op12_conversation_repair"] = rf"""WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations),
 f AS (SELECT *, xor({_CRC}, CAST(4294967295 AS BIGINT)) % 20 AS fault FROM o),
 d AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE fault WHEN 0 THEN []::INTEGER[] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM f),
 p AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM d),
 q AS (SELECT conv_id, turn, role, text, i, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prev, body = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, right(body, 1) NOT IN ('.', '!', '?') AS open FROM p),
 r AS (SELECT *, NOT blank AND again AS dup, NOT blank AND NOT again AND open AS cut, blank OR again AS gone FROM q),
 g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM r GROUP BY 1),
 ids AS (SELECT DISTINCT conv_id FROM conversations),
 w AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, repeat('0', 12) AS w0, CAST(NULL AS VARCHAR) AS w1, CAST(NULL AS VARCHAR) AS w2, CAST(NULL AS VARCHAR) AS w3 FROM ids
  UNION ALL SELECT conv_id, i, {_add("w0", "4", "D")}, least({_add("w1", "4", "D")}, CASE WHEN NOT gone AND ini = 's' THEN {_add("w0", "more", "K")} END),
   least({_add("w2", "4", "D")}, CASE WHEN NOT gone THEN {_R2} END, CASE WHEN NOT gone AND ini = 'u' THEN {_K2} END), least({_add("w3", "4", "D")}, CASE WHEN NOT gone THEN {_add("w2", "3 + more", "R")} END, CASE WHEN NOT gone AND ini = 'a' THEN {_add("w2", "more", "K")} END)
   FROM (SELECT conv_id, i, gone, ini, more, w0, w1, w2, least(w3, {_add("w2", "3", "I")}) AS w3 FROM (SELECT w.conv_id, r.i, gone, ini, CASE WHEN cut THEN 3 ELSE 0 END AS more, w0, w1, least(w2, {_I2}) AS w2, w3 FROM w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1))),
 e AS (SELECT conv_id, least(w0, w3, {_add("least(w2, " + _I2 + ")", "3", "I")}) AS best FROM (SELECT w.* FROM w LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.i = coalesce(g.n, 0))),
 a AS (SELECT conv_id, CAST(substr(best, 1, 12) AS BIGINT) AS cost, substr(best, 13) AS audit FROM e),
 t AS (SELECT conv_id, audit, 0 AS k, CAST(0 AS BIGINT) AS i, '-' AS st, CAST(NULL AS VARCHAR) AS said FROM a
  UNION ALL SELECT conv_id, audit, k + 1, i, CASE WHEN letter = 'D' THEN st ELSE left(new, 1) END, CASE WHEN letter = 'D' THEN said ELSE concat_ws(chr(10), said, new || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END) END FROM (
   SELECT t.conv_id, t.audit, t.k, substr(t.audit, t.k + 1, 1) AS letter, t.i + CASE WHEN substr(t.audit, t.k + 1, 1) = 'I' THEN 0 ELSE 1 END AS i, t.st, t.said, r.text, CASE WHEN substr(t.audit, t.k + 1, 1) = 'K' THEN r.role WHEN t.st = 'u' THEN 'assistant' ELSE 'user' END AS new
   FROM t LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND r.i = t.i + 1 WHERE t.k < length(t.audit)))
 SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, a.cost, a.audit, sha256(coalesce(t.said, '')) AS repaired_sha256
 FROM a LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM a.conv_id JOIN t ON t.conv_id IS NOT DISTINCT FROM a.conv_id AND t.k = length(a.audit)"""

_PATTERNS = {
    "assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]{16,}",
    "hex": "[0-9a-f]{24,}",
    "identifier": "[A-Z]{4}[A-Z0-9]{12,}",
    "key": "[A-Za-z0-9+/_=-]{32,}",
    "endpoint": r"""[a-z][a-z0-9+]{1,20}://[^\x20\x09-\x0D"''<>]{4,}""",
}
_GOOD = {"assign": f"length(regexp_extract(m, '{_PATTERNS['assign']}', 2)) >= 6", "identifier": "regexp_matches(m, '[0-9]')", "key": "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')"}
_FOUND = " UNION ALL ".join(
    f"SELECT id, {n} AS kind, i, m, length(gap) AS gap, {_GOOD.get(kind, 'true')} AS good FROM (SELECT id, unnest(f) AS m, unnest(string_split_regex(t, '{p}')[1:len(f)]) AS gap, generate_subscripts(f, 1) AS i FROM (SELECT id, t, regexp_extract_all(t, '{p}') AS f FROM d) WHERE len(f) > 0)"
    for n, (kind, p) in enumerate(_PATTERNS.items())
)
_NAME = "['" + "', '".join(_PATTERNS) + "'][kind + 1]"
_ENTRY = f"{_NAME} || ':' || s || ':' || e"

SQL["op11_secret_scan"] = f"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents), f AS ({_FOUND}),
 p AS (SELECT id, kind, e - size AS s, e FROM (SELECT id, kind, good, length(m) AS size, CAST(sum(gap + length(m)) OVER (PARTITION BY id, kind ORDER BY i) AS BIGINT) AS e FROM f) WHERE good),
 n AS (SELECT a.id, a.kind, a.s, a.e, bool_or(b.kind IN (1, 3) AND (b.s >= a.e OR b.e <= a.s)) AS identifier, bool_or(b.kind IN (0, 2, 4) AND (b.s >= a.e OR b.e <= a.s)) AS secret, bool_or(b.kind < 3 AND b.s < a.e AND b.e > a.s) AS inside
  FROM p a JOIN p b ON a.id = b.id AND b.s <= a.e + 200 AND b.e + 200 >= a.s WHERE a.kind >= 3 GROUP BY 1, 2, 3, 4),
 x AS (SELECT id, kind, s, e FROM p WHERE kind < 3 UNION ALL SELECT id, kind, s, e FROM n WHERE NOT inside AND CASE kind WHEN 3 THEN secret WHEN 4 THEN identifier ELSE identifier AND secret END),
 z AS (SELECT id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg({_ENTRY}, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg({_ENTRY}, ',' ORDER BY s, kind) AS every FROM x GROUP BY 1)
 SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans FROM d LEFT JOIN z USING (id)"""
