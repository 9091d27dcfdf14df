"""SQL for the queries that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
 tri AS (SELECT r, i, array_to_string(w[i:i + 2], ' ') AS t FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
 twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS c FROM tri) WHERE c > 1),
 rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY 1),
 ln AS (SELECT r, source, text, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n, trim(regexp_replace(lower(l), '\s+', ' ', 'g')) AS k FROM (SELECT r, source, text, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
 dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM ln GROUP BY 1),
 host AS (SELECT source, count(DISTINCT text) AS docs FROM d GROUP BY 1),
 often AS (SELECT source, k FROM (SELECT source, k, count(DISTINCT text) AS c FROM ln GROUP BY 1, 2) JOIN host USING (source) WHERE c > 3 AND c > 0.02 * docs),
 gone AS (SELECT r, sum(n) AS n FROM ln JOIN often USING (source, k) GROUP BY 1),
 base AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_frequent_words
  FROM d LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r))
 SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_frequent_words >= 0.75 * n_words AS kept FROM base"""

OP5 = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
 win AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS t FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
 dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY t) AS c FROM win) WHERE c > 1),
 gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM dup),
 kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d) ANTI JOIN gone USING (r, p) GROUP BY 1)
 SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""

BITS = "array_to_string(list_transform(string_split(sha1(p), ''), lambda c: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', c)]), '')"
FIVE = " + ".join(f"CAST(substr(b, i * 5 + {k + 1}, 1) AS INTEGER) * {16 >> k}" for k in range(5))
OP10 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS p FROM pages), b AS (SELECT page_id, p, {BITS} AS b, max(page_id) OVER (PARTITION BY p) AS top FROM p)
 SELECT page_id, strlen(p) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', {FIVE} + 1, 1)), '') AS payload_digest,
 CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM b"""

#: CRC-32 of a text of ASCII characters, its table made from the polynomial's bits.
CRC_TABLE = "SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) r(i)"


def crc32(text: str) -> str:
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: xor(crc[(xor(a, b) & 255) + 1], a >> 8)), 4294967295)"


def _leaf(text: str) -> str:
    values = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


_SIDES = "string_agg(CASE WHEN b.i < a.i THEN b.d END, '' ORDER BY b.i) AS l, string_agg(CASE WHEN b.i > a.i THEN b.d END, '' ORDER BY b.i) AS h"
_CAPITALS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
OP11 = f"""WITH RECURSIVE c AS ({CRC_TABLE}),
 leaf AS (SELECT doc_id, coalesce('+' || lang, '') AS g, {_leaf("text")} AS d, CASE WHEN {crc32("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_leaf(f"translate(text, {_CAPITALS})")} END AS t FROM documents, c),
 doc AS (SELECT *, row_number() OVER (ORDER BY g, doc_id, d) AS r, row_number() OVER (PARTITION BY g ORDER BY doc_id, d) - 1 AS i FROM leaf),
 node AS (SELECT g, CAST(0 AS BIGINT) AS lv, i, d, count(*) OVER (PARTITION BY g) AS n FROM doc
  UNION ALL SELECT g, lv + 1, i // 8, sha256(string_agg(d, '' ORDER BY i)), (n + 7) // 8 FROM node WHERE n > 1 GROUP BY g, lv, i // 8, n),
 sub AS (SELECT g, d, lv, row_number() OVER (ORDER BY g) - 1 AS k FROM node WHERE n = 1),
 top AS (SELECT CAST(0 AS BIGINT) AS lv, k AS i, d, count(*) OVER () AS n FROM sub
  UNION ALL SELECT lv + 1, i // 8, sha256(string_agg(d, '' ORDER BY i)), (n + 7) // 8 FROM top WHERE n > 1 GROUP BY lv, i // 8, n),
 side AS (SELECT a.g, a.lv, a.i, {_SIDES} FROM node a JOIN node b ON a.g = b.g AND a.lv = b.lv AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY a.g, a.lv, a.i
  UNION ALL SELECT sub.g, sub.lv + a.lv, 0, {_SIDES} FROM sub JOIN top a ON a.i = sub.k // CAST(pow(8, a.lv) AS BIGINT) JOIN top b ON a.lv = b.lv AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY sub.g, sub.lv, a.lv, a.i),
 walk AS (SELECT r, g, CAST(0 AS BIGINT) AS lv, i, coalesce(t, d) AS cur, '' AS p FROM doc
  UNION ALL SELECT r, walk.g, walk.lv + 1, walk.i // 8, sha256(coalesce(l, '') || cur || coalesce(h, '')), p || coalesce(l, '') || coalesce(h, '') FROM walk JOIN side ON side.g = walk.g AND side.lv = walk.lv AND side.i = walk.i),
 last AS (SELECT r, arg_max(cur, lv) AS folded_root, sha256(arg_max(p, lv)) AS proof_sha256 FROM walk GROUP BY r)
 SELECT doc_id, doc.d AS leaf, sub.d AS subroot, root.d AS root, proof_sha256, folded_root, folded_root = root.d AS verified
 FROM doc JOIN sub USING (g) JOIN last USING (r) CROSS JOIN (SELECT d FROM top WHERE n = 1) root"""



def _step(s: str, cost: str, edit: str) -> str:
    """A way's cost, in nine digits, and its edits after one more."""
    return f"lpad(CAST(CAST(left({s}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({s}, 10) || {edit}"


def _taken(s: str, initial: str) -> str:
    return _step(s, f"more + CASE WHEN ini = '{initial}' THEN 0 ELSE 1 END", f"CASE WHEN ini = '{initial}' THEN 'K' ELSE 'R' END")


def _best(*ways: str) -> str:
    return f"least({', '.join(ways)})"


def _free(s: str) -> str:
    return f"CASE WHEN fault NOT IN (1, 2) THEN {s} END"


#: The best way to each place (start, after s, after u, after a), as text whose order is that of cost, then edits.
_INSERTED = f"s0, s1, s2, s3, {_best('s2', *(_step(f's{k}', '5', chr(39) + 'I' + chr(39)) for k in (0, 1, 3)))} AS c2"
_LAST = _best("s3", _step("c2", "5", "'I'"))
_BLANKS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
OP12 = f"""WITH RECURSIVE c AS ({CRC_TABLE}),
 d AS (SELECT conv_id, turn, coalesce(role, ' ') AS r0, coalesce(text, ' ') AS t0, {crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS code FROM conversations, c),
 e AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE r0 END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(t0, '[.!?]', '', 'g') ELSE t0 END AS text, unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS k FROM d),
 n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), k) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, k) AS seen, rtrim(text, {_BLANKS}) AS rt, left(role, 1) AS ini FROM e),
 f AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), '') AS g, CASE WHEN rt = '' THEN 1 WHEN seen > 1 THEN 2 WHEN right(rt, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM n),
 conv AS (SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), '') AS g, '000000000' AS s0 FROM conversations GROUP BY 1),
 way AS (SELECT g, CAST(0 AS BIGINT) AS pos, s0, CAST(NULL AS VARCHAR) AS s1, CAST(NULL AS VARCHAR) AS s2, CAST(NULL AS VARCHAR) AS s3 FROM conv
  UNION ALL SELECT g, pos + 1, {_step("s0", "2", "'D'")}, {_best(_step("s1", "2", "'D'"), _free("CASE WHEN ini = 's' THEN " + _step("s0", "more", "'K'") + " END"))},
   {_best(_step("c2", "2", "'D'"), *(_free(_taken(s, "u")) for s in ("s0", "s1", "c3")))}, {_best(_step("c3", "2", "'D'"), _free(_taken("c2", "a")))}
  FROM (SELECT *, {_LAST} AS c3 FROM (SELECT way.g, pos, fault, ini, CASE WHEN fault = 3 THEN 5 ELSE 0 END AS more, {_INSERTED} FROM way JOIN f ON f.g = way.g AND f.i = way.pos + 1))),
 done AS (SELECT g, arg_max({_best("s0", _LAST)}, pos) AS w FROM (SELECT g, pos, {_INSERTED} FROM way) GROUP BY g),
 audit AS (SELECT g, CAST(left(w, 9) AS BIGINT) AS cost, substr(w, 10) AS audit FROM done),
 ch AS (SELECT g, p, substr(audit, p, 1) AS ch FROM (SELECT g, audit, unnest(range(1, length(audit) + 1)) AS p FROM audit)),
 step AS (SELECT g, p, ch, CASE WHEN ch <> 'I' THEN count(*) FILTER (ch <> 'I') OVER w END AS i, count(*) FILTER (ch <> 'D') OVER w AS o FROM ch WINDOW w AS (PARTITION BY g ORDER BY p)),
 line AS (SELECT step.g, p, ch, role, text, o, max(CASE WHEN o = 1 AND ch = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY step.g) AS s FROM step LEFT JOIN f ON f.g = step.g AND f.i = step.i WHERE ch <> 'D'),
 said AS (SELECT g, string_agg(CASE WHEN ch = 'K' THEN role WHEN (o - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN ch = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS t FROM line GROUP BY g),
 pair AS (SELECT g, ini || lead(ini) OVER (PARTITION BY g ORDER BY i) AS x FROM f),
 bad AS (SELECT g, count(*) AS illegal FROM pair WHERE x NOT IN ('su', 'ua', 'au') GROUP BY g),
 cnt AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated FROM f GROUP BY g)
 SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(t, '')) AS repaired_sha256
 FROM conv JOIN audit USING (g) LEFT JOIN cnt USING (g) LEFT JOIN bad USING (g) LEFT JOIN said USING (g)"""

ORACLES = {"op2_quality_rules": OP2, "op5_substring_dedup": OP5, "op10_warc": OP10, "op11_merkle": OP11, "op12_structure_repair": OP12}
