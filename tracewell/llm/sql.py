"""DuckDB equivalents of the operators that SQL can express."""

LINES = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), owned AS (
  SELECT *, min(doc_id) OVER (PARTITION BY key) AS owner FROM keyed
), judged AS (
  SELECT *, length(key) >= 10 AND doc_id > owner AS dropped FROM owned
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

# Windows of an item's size; shingles of five words; weighted Jaccard similarity of at least 0.8.
LEAKS = r"""
WITH d AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents
), i AS (
  SELECT item_id, [x FOR x IN regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM benchmark
), ds AS (
  SELECT doc_id, unnest(range(len(w) - 4)) AS pos, len(w) - 4 AS n, w FROM d WHERE len(w) >= 5
), dsh AS (
  SELECT doc_id, pos, n, array_to_string(w[pos + 1 : pos + 5], ' ') AS sh FROM ds
), ish AS (
  SELECT item_id, len(w) - 4 AS m, array_to_string(w[p + 1 : p + 5], ' ') AS sh
  FROM (SELECT item_id, w, unnest(range(len(w) - 4)) AS p FROM i WHERE len(w) >= 5)
), items AS (
  SELECT item_id, m, sh, count(*) AS times FROM ish GROUP BY ALL
), hits AS (
  SELECT doc_id, pos, n, item_id, m, sh, times FROM dsh JOIN items USING (sh)
), starts AS (
  SELECT DISTINCT doc_id, item_id, n, m, unnest(range(greatest(0, pos - m + 1), least(pos, greatest(0, n - m)) + 1)) AS start FROM hits
), shared AS (
  SELECT s.doc_id, s.item_id, s.start, s.n, s.m, h.sh, least(count(*), any_value(h.times)) AS shared_times
  FROM starts s JOIN hits h ON h.doc_id = s.doc_id AND h.item_id = s.item_id AND h.pos BETWEEN s.start AND s.start + s.m - 1
  GROUP BY ALL
), scored AS (
  SELECT doc_id, item_id, start, sum(shared_times) / (any_value(least(m, n) + m) - sum(shared_times)) AS similarity
  FROM shared GROUP BY doc_id, item_id, start
)
SELECT doc_id, item_id, arg_max(start, (similarity, -start))::BIGINT AS word_start, round(max(similarity), 6) AS similarity
FROM scored WHERE similarity >= 0.8 GROUP BY doc_id, item_id
"""


def _spans(kind: str, rank: int, pattern: str, valid: str) -> str:
    """Spans of one kind: starts are the lengths of what stands before, from splitting by the pattern."""
    return f"""
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind, hit, start, start + length(hit) AS stop FROM (
    SELECT doc_id, hits[k] AS hit, (list_sum([length(x) FOR x IN gaps[1:k]]) + coalesce(list_sum([length(x) FOR x IN hits[1:k - 1]]), 0))::BIGINT AS start
    FROM (SELECT doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) AS k
          FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS hits, regexp_split_to_array(t, '{pattern}') AS gaps FROM texts)))
  WHERE {valid}"""


_LUHN = ("list_sum([CASE WHEN i % 2 = 0 THEN reverse(dg)[i + 1]::INT ELSE reverse(dg)[i + 1]::INT * 2 - "
         "CASE WHEN reverse(dg)[i + 1]::INT > 4 THEN 9 ELSE 0 END END FOR i IN range(length(dg))]) % 10 = 0")
_DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"
# Without lookarounds, what stands beside a match is looked at afterwards.
_BEFORE, _AFTER = "substr(t, start, 1)", "substr(t, stop + 1, 1)"
_AROUND = "lower(substr(t, greatest(start - 40, 0) + 1, start - greatest(start - 40, 0)) || ' ' || substr(t, stop + 1, 40))"
_MOD97 = """list_reduce(list_prepend(0, [ascii(m[i]) FOR i IN range(1, length(m) + 1)]),
    lambda a, c: CASE WHEN c >= 65 THEN (a * 100 + c - 55) % 97 ELSE (a * 10 + c - 48) % 97 END) = 1"""

PII = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
email AS ({_spans("email", 0, "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+", "true")}),
ip AS ({_spans("ip", 1, "[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+", "list_max([x::HUGEINT FOR x IN string_split(hit, '.')]) <= 255")}),
card AS ({_spans("card", 2, "[0-9](?:[ -]?[0-9])+", f"length({_DIGITS}) BETWEEN 14 AND 19")}),
good_card AS (SELECT * EXCLUDE (dg) FROM (SELECT *, {_DIGITS} AS dg FROM card) WHERE {_LUHN}),
phone AS ({_spans("phone", 3, "[+][0-9][ ().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15")}),
iban AS ({_spans("iban", 4, "[A-Z][A-Z][0-9][0-9](?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)", "true")}),
good_iban AS (
  SELECT iban.* FROM iban JOIN texts USING (doc_id), LATERAL (SELECT replace(hit, ' ', '') AS c) x, LATERAL (SELECT c[5:] || c[1:4] AS m) y
  WHERE length(c) BETWEEN 15 AND 34 AND NOT regexp_matches({_BEFORE}, '[A-Za-z0-9]') AND NOT regexp_matches({_AFTER}, '[A-Za-z0-9]') AND {_MOD97}),
ssn AS ({_spans("ssn", 5, "[0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9][0-9][0-9]", "true")}),
near_ssn AS (
  SELECT ssn.* FROM ssn JOIN texts USING (doc_id)
  WHERE NOT regexp_matches({_BEFORE}, '[0-9A-Za-z-]') AND NOT regexp_matches({_AFTER}, '[0-9A-Za-z-]')
    AND regexp_matches({_AROUND}, 'ssn|social|security|insurance')),
spans AS (SELECT * FROM email UNION ALL SELECT * FROM ip UNION ALL SELECT * FROM good_card UNION ALL SELECT * FROM phone
  UNION ALL SELECT * FROM good_iban UNION ALL SELECT * FROM near_ssn),
per_doc AS (
  SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 4) AS base,
         count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
         count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
         count(*) FILTER (kind = 'iban') AS n_iban, count(*) FILTER (kind = 'ssn') AS n_ssn
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_iban, 0) AS n_iban, coalesce(n_ssn, 0) AS n_ssn
FROM documents LEFT JOIN per_doc USING (doc_id)
"""


def _crc32(text: str) -> str:
    """Unsigned crc32 of ASCII text, bit by bit."""
    step = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    byte = f"list_reduce(list_prepend(xor(a, b), [0::BIGINT FOR i IN range(8)]), lambda c, z: {step})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split({text}, '')]), lambda a, b: {byte}), 4294967295)"


def _record(text: str) -> str:
    fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


# Runs of three nodes; a document's path is cut out of the strings of its runs and folded by a list.
MERKLE = f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, coalesce('s' || source, '-') AS tree, {_record("text")} AS node,
         CASE WHEN {_crc32("doc_id::VARCHAR")} % 2 = 0 THEN {_record("replace(text, chr(10), '')")} END AS altered
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, node) - 1 AS place, count(*) OVER (PARTITION BY tree) AS size FROM leaf
), nodes AS (
  SELECT 0 AS level, tree, place, node, size FROM placed
  UNION ALL
  SELECT level + 1, tree, place // 3, sha256(string_agg(node, '' ORDER BY place)), any_value((size + 2) // 3)
  FROM nodes WHERE size > 1 GROUP BY level, tree, place // 3
), subroot AS (
  SELECT tree, node, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS size FROM nodes WHERE size = 1
), tops AS (
  SELECT 0 AS level, place, node, size FROM subroot
  UNION ALL
  SELECT level + 1, place // 3, sha256(string_agg(node, '' ORDER BY place)), any_value((size + 2) // 3)
  FROM tops WHERE size > 1 GROUP BY level, place // 3
), runs AS (
  SELECT level, tree, place // 3 AS run, string_agg(node, '' ORDER BY place) AS s FROM nodes WHERE size > 1 GROUP BY ALL
), top_runs AS (
  SELECT level, place // 3 AS run, string_agg(node, '' ORDER BY place) AS s FROM tops WHERE size > 1 GROUP BY ALL
), path AS (
  SELECT p.doc_id, p.tree, p.node AS leaf, r.level AS step, (p.place // (3 ** r.level)::BIGINT) % 3 AS nth, r.s
  FROM placed p JOIN runs r ON r.tree = p.tree AND r.run = p.place // (3 ** (r.level + 1))::BIGINT
  UNION ALL
  SELECT p.doc_id, p.tree, p.node, 100 + r.level, (t.place // (3 ** r.level)::BIGINT) % 3, r.s
  FROM placed p JOIN subroot t USING (tree) JOIN top_runs r ON r.run = t.place // (3 ** (r.level + 1))::BIGINT
), proofs AS (
  SELECT doc_id, leaf, list({{'l': s[: nth * 64], 'r': s[(nth + 1) * 64 + 1 :]}} ORDER BY step) AS segments FROM path GROUP BY ALL
), folded AS (
  SELECT p.doc_id, p.node AS leaf, t.node AS subroot, (SELECT node FROM tops WHERE size = 1) AS root,
         sha256(coalesce(array_to_string([x.l || x.r FOR x IN segments], ''), '')) AS proof_sha256,
         list_reduce(list_prepend({{'l': coalesce(p.altered, p.node), 'r': ''}}, coalesce(segments, [])),
                     lambda a, x: {{'l': sha256(x.l || a.l || x.r), 'r': ''}}).l AS folded_root
  FROM placed p JOIN subroot t USING (tree) LEFT JOIN (SELECT doc_id, segments FROM proofs) USING (doc_id)
)
SELECT *, folded_root = root AS verified FROM folded
"""

# Bins by the first two hex digits of a run's md5, donors by the bin's own order, one hex digit stored.
FINGERPRINTS = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, lead(doc_id) OVER (ORDER BY doc_id DESC) AS below, max(doc_id) OVER () AS highest FROM documents
), pairs AS (
  SELECT a.doc_id, a.t, length(a.t) AS n_chars, b.doc_id AS next_id,
         substr(a.t, 1, length(a.t) - length(a.t) // 3) || substr(b.t, 1, length(a.t) // 3) AS edited
  FROM d a JOIN d b ON b.doc_id = coalesce(a.below, a.highest)
), texts AS (
  SELECT doc_id, 0 AS kind, t FROM pairs UNION ALL SELECT doc_id, 1, edited FROM pairs
), w AS (
  SELECT doc_id, kind, [x FOR x IN regexp_split_to_array(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM texts
), runs AS (
  SELECT doc_id, kind, md5(array_to_string(w[i : i + 4], ' ')) AS h
  FROM (SELECT doc_id, kind, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM w)
), least_of AS (
  SELECT doc_id, kind, ('0x' || h[1:2])::INT AS bin, min(h)[32] AS digit FROM runs GROUP BY ALL
), bins AS (
  SELECT j, ('0x' || md5(j::VARCHAR)[1:2])::INT | 1 AS step, ('0x' || md5(j::VARCHAR)[3:4])::INT AS start FROM range(256) AS r(j)
), filled AS (
  SELECT doc_id, kind, j, arg_min(digit, CASE WHEN bin = j THEN -1 ELSE (bin * step + start) % 256 END) AS digit
  FROM least_of, bins GROUP BY ALL
), fp AS (
  SELECT doc_id, kind, string_agg(digit, '' ORDER BY j) AS f FROM filled GROUP BY ALL
), met AS (
  SELECT p.*, coalesce(x.f, '') AS a, coalesce(y.f, '') AS e, coalesce(z.f, '') AS n
  FROM pairs p LEFT JOIN fp x ON x.doc_id = p.doc_id AND x.kind = 0 LEFT JOIN fp y ON y.doc_id = p.doc_id AND y.kind = 1
  LEFT JOIN fp z ON z.doc_id = p.next_id AND z.kind = 0
)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, a AS fingerprint, e AS edited_fingerprint,
       CASE WHEN a = '' OR e = '' THEN (a = e)::INT::DOUBLE ELSE greatest(((256 - hamming(a, e)) / 256 - 1 / 16) / (15 / 16), 0) END AS near_edited,
       CASE WHEN a = '' OR n = '' THEN (a = n)::INT::DOUBLE ELSE greatest(((256 - hamming(a, n)) / 256 - 1 / 16) / (15 / 16), 0) END AS near_next
FROM met
"""

FIM = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents
), cuts AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS c2,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
), parts AS (
  SELECT *, array_to_string(u[1 : least(c1, c2)], '') AS prefix, array_to_string(u[least(c1, c2) + 1 : greatest(c1, c2)], '') AS middle,
         array_to_string(u[greatest(c1, c2) + 1 :], '') AS suffix FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
