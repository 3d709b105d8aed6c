"""DuckDB text of the queries that SQL can express."""

from __future__ import annotations

MIXING = r"""
WITH docs AS (
  SELECT doc_id, source,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rnk
  FROM docs GROUP BY source),
weighted AS (
  SELECT *, CAST(rnk % 3 + 1 AS DOUBLE) AS w, 3 * source_size AS cap FROM sources),
levels AS (
  SELECT a.source, a.source_size, a.rnk, a.w, a.cap, a.cap / a.w AS ratio,
         ((SELECT sum(source_size) FROM weighted)
          - coalesce(sum(b.cap) FILTER (WHERE (b.cap / b.w, b.rnk) < (a.cap / a.w, a.rnk)), 0))
         / sum(b.w) FILTER (WHERE (b.cap / b.w, b.rnk) >= (a.cap / a.w, a.rnk)) AS share
  FROM weighted a CROSS JOIN weighted b GROUP BY ALL),
level AS (SELECT arg_min(share, (ratio, rnk)) AS share FROM levels WHERE cap > share * w),
targets AS (
  SELECT s.source, s.source_size, s.rnk,
         CASE WHEN l.share IS NULL THEN CAST(s.cap AS DOUBLE) ELSE least(CAST(s.cap AS DOUBLE), l.share * s.w) END AS target
  FROM weighted s CROSS JOIN level l),
placed AS (
  SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, t.source_size, t.target, t.rnk,
         CAST(round(t.target) AS BIGINT) AS goal,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id NULLS LAST, d.size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
taken AS (
  SELECT *, greatest(least(goal - start, size), 0) + greatest(least(goal - source_size - start, size), 0)
            + greatest(least(goal - 2 * source_size - start, size), 0) AS taken,
         start / target AS u
  FROM placed)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
       CASE WHEN taken = 0 THEN NULL ELSE round(CASE rnk % 3
         WHEN 0 THEN 2 * u / (1.5 + sqrt(greatest(2.25 - 2 * u, 0)))
         WHEN 1 THEN u
         ELSE 6 * u / (1.5 + sqrt(2.25 + 18 * u)) END, 9) END AS position
FROM taken
"""

CONTAMINATION = r"""
WITH doc AS (
  SELECT row_number() OVER () AS k, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws
  FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
phrase AS (
  SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS p
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM item WHERE len(ws) > 0)),
place AS (
  SELECT k, i, s.n, array_to_string(ws[i : i + s.n - 1], ' ') AS p
  FROM (SELECT k, ws, unnest(range(1, len(ws) + 1)) AS i FROM doc) d
  JOIN (SELECT DISTINCT n FROM phrase) s ON d.i + s.n - 1 <= len(d.ws)),
hit AS (SELECT k, i, place.n, item FROM place JOIN phrase USING (n, p)),
words AS (SELECT k, count(DISTINCT w) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS w FROM hit) GROUP BY k),
items AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT k, item FROM hit WHERE item IS NOT NULL) GROUP BY k)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (k) LEFT JOIN items USING (k)
"""

# (place, name, added, prior, likely words, unlikely words, pattern); account numbers by length and country, as in ISO 13616
_ACCOUNTS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT ST",
    26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU",
    31: "MT SC", 32: "LC"}
_ACCOUNT = "|".join(f"({c.replace(' ', '|')})[0-9]{{2}}( ?[A-Z0-9]){{{n - 4}}}" for n, c in _ACCOUNTS.items())
_CARDS, _NUMBERS = "card|visa|mastercard|amex|karte|carte|tarjeta", "order|invoice|isbn|serial|tracking|version"
_CALLS = "phone|tel|telephone|call|fax|mobile|telefon|téléphone|teléfono|anruf|appelez"
_KINDS = ",\n    ".join(f"({o}, '{n}', {a}, {p}, '{y}', '{x}', '{r}')" for o, n, a, p, y, x, r in (
    (0, "email", False, 70, "email|mail|contact|kontakt|correo|courriel", "example",
     r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    (1, "ip", False, 60, "ip|host|server|address", "version|release|section", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    (2, "card", False, 60, _CARDS, _NUMBERS, r"[0-9]([\x20-]?[0-9])+"),
    (3, "phone", False, 70, _CALLS, _NUMBERS, r"\+[0-9][\x20().0-9-]+[0-9]"),
    (2, "card", True, 30, _CARDS, _NUMBERS, r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{13,19}"),
    (4, "iban", True, 80, "iban|account|konto|bank|compte|cuenta", "", _ACCOUNT),
    (5, "ssn", True, 50, "ssn|social|security", _NUMBERS, r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    (6, "tel", True, 30, _CALLS, _NUMBERS, r"\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}")))
_NEAR = "'(^|[^a-z0-9])(' || {words} || ')([^a-z0-9]|$)'"
_NEARBY = ("({words} <> '' AND (regexp_matches(lo_before, " + _NEAR + ") OR regexp_matches(lo_after, " + _NEAR + ")))")

PERSONAL = rf"""
WITH kind(place, name, added, prior, likely, unlikely, pattern) AS (VALUES
    {_KINDS}),
doc AS (SELECT row_number() OVER () AS k, doc_id, translate(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
cut AS (
  SELECT k, kind.*, string_split(regexp_replace(t, '(' || pattern || ')', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS ps
  FROM doc CROSS JOIN kind),
piece AS (SELECT * EXCLUDE (ps), len(ps) AS n, unnest(ps) AS m, generate_subscripts(ps, 1) AS i FROM cut WHERE len(ps) > 1),
gap AS (
  SELECT *, sum(length(m)) OVER w - length(m) AS start, lag(m) OVER w AS b, lead(m) OVER w AS a
  FROM piece WINDOW w AS (PARTITION BY k, place, added ORDER BY i)),
proposed AS (
  SELECT * EXCLUDE (a, b), start + length(m) AS stop, regexp_replace(m, '[^0-9]', '', 'g') AS d, replace(m, ' ', '') AS x,
         CASE WHEN b = '' AND i > 2 THEN 'x' ELSE right(b, 40) END AS before,
         CASE WHEN a = '' AND i + 1 < n THEN 'x' ELSE left(a, 20) END AS after
  FROM gap WHERE i % 2 = 0),
judged AS (
  SELECT *, translate(before, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lo_before,
         translate(after, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lo_after,
         NOT regexp_matches(before, '[A-Za-z0-9-]$') AND NOT regexp_matches(after, '^[A-Za-z0-9-]') AS alone,
         CASE WHEN name = 'card' THEN length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda j:
                CASE WHEN j % 2 = 1 THEN CAST(d[-j] AS INTEGER)
                     ELSE (2 * CAST(d[-j] AS INTEGER)) // 10 + (2 * CAST(d[-j] AS INTEGER)) % 10 END)) % 10 = 0 END AS luhn,
         CASE WHEN name = 'iban' THEN list_reduce([0] || list_transform(string_split(x[5:] || x[1:4], ''), lambda c:
                CASE WHEN c BETWEEN '0' AND '9' THEN CAST(c AS INTEGER) ELSE ascii(c) - 55 END),
                lambda r, v: (r * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) END AS rest
  FROM proposed),
scored AS (
  SELECT *, greatest(0, least(100, prior
         + CASE WHEN name = 'card' AND regexp_full_match(d, '4[0-9]{{12}}([0-9]{{3}}){{0,2}}|5[1-5][0-9]{{14}}|2[2-7][0-9]{{14}}|3[47][0-9]{{13}}|6(011|5[0-9]{{2}})[0-9]{{12}}')
                THEN 20 ELSE 0 END
         + CASE WHEN {_NEARBY.format(words="likely")} THEN 25 ELSE 0 END
         - CASE WHEN {_NEARBY.format(words="unlikely")} THEN 25 ELSE 0 END)) AS score
  FROM judged
  WHERE CASE name
        WHEN 'email' THEN true
        WHEN 'ip' THEN list_bool_and(list_transform(string_split(m, '.'), lambda o: CAST(o AS HUGEINT) <= 255))
        WHEN 'card' THEN luhn AND (NOT added OR alone)
        WHEN 'phone' THEN length(d) BETWEEN 9 AND 15
        WHEN 'iban' THEN alone AND rest = 1
        WHEN 'ssn' THEN alone AND m[1:3] NOT IN ('000', '666') AND m[1] <> '9' AND m[5:6] <> '00' AND m[8:] <> '0000'
        ELSE alone AND NOT regexp_matches(before, '\+[0-9][\x20().0-9-]*$') END),
found AS (
  SELECT * FROM scored WHERE NOT added OR score >= 50
  QUALIFY row_number() OVER (PARTITION BY k, place, start, stop ORDER BY added) = 1)
SELECT doc_id,
       count(*) FILTER (WHERE name = 'email' AND NOT added) AS n_email, count(*) FILTER (WHERE name = 'ip' AND NOT added) AS n_ip,
       count(*) FILTER (WHERE name = 'card' AND NOT added) AS n_card, count(*) FILTER (WHERE name = 'phone' AND NOT added) AS n_phone,
       sha256(coalesce(string_agg(name || ':' || start || ':' || stop, ',' ORDER BY place, start) FILTER (WHERE NOT added), '')) AS base_sha256,
       coalesce(string_agg(name || ':' || start || ':' || stop, ',' ORDER BY place, start, stop), '') AS spans,
       coalesce(string_agg(CAST(score AS VARCHAR), ',' ORDER BY place, start, stop), '') AS scores
FROM doc LEFT JOIN found USING (k) GROUP BY k, doc_id
"""

# CRC-32 is taken byte by byte over the distinct words, with its table made from the polynomial
RESAMPLING = r"""
WITH RECURSIVE crc_bits(b, k, c) AS (
  SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL
  SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY b) AS tab FROM crc_bits WHERE k = 8),
doc AS (
  SELECT row_number() OVER () AS k, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws
  FROM documents),
word AS (SELECT k, unnest(ws) AS w FROM doc),
goal AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM benchmark),
hashed AS (
  SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM word UNION SELECT w FROM goal)),
bucketed AS (
  SELECT w, xor(list_reduce([CAST(4294967295 AS BIGINT)]
                            || list_transform(range(1, length(x), 2), lambda i: CAST('0x' || x[i : i + 1] AS BIGINT)),
                            lambda c, b: xor(c >> 8, tab[CAST(xor(c, b) & 255 AS INTEGER) + 1])),
                4294967295) % 10000 AS bucket
  FROM hashed, crc_table),
here AS (SELECT bucket, count(*) AS n FROM word JOIN bucketed USING (w) GROUP BY bucket),
there AS (SELECT bucket, count(*) AS n FROM goal JOIN bucketed USING (w) GROUP BY bucket),
gain AS (
  SELECT b.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM word) + 10000.0::DOUBLE)
           / ((coalesce(s.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM goal) + 10000.0::DOUBLE)))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM bucketed) b LEFT JOIN here s USING (bucket) LEFT JOIN there t USING (bucket)),
weighted AS (
  SELECT k, CAST(sum(gain) AS BIGINT) AS weight FROM word JOIN bucketed USING (w) JOIN gain USING (bucket) GROUP BY k),
scored AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8]
           AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM doc LEFT JOIN weighted USING (k)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id ASC NULLS LAST) AS place,
         count(*) FILTER (WHERE n_features >= 20) OVER () AS n
  FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= n * 10 // 100 THEN place END AS rank
FROM placed
"""

DIVERGENCE = r"""
WITH doc AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
word AS (SELECT k, lang, source, unnest(ts) AS term FROM doc),
kept AS (SELECT lang, term, count(*) AS c FROM word GROUP BY lang, term HAVING count(DISTINCT k) >= 30),
tongue AS (
  SELECT lang, count(term) AS v, coalesce(sum(c), 0) AS n
  FROM (SELECT DISTINCT lang FROM doc) LEFT JOIN kept USING (lang) GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM doc),
held AS (SELECT w.lang, w.source, w.term, count(*) AS c FROM word w JOIN kept USING (lang, term) GROUP BY ALL),
total AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM grp LEFT JOIN held USING (lang, source) GROUP BY ALL),
share AS (
  SELECT lang, source, k.term, coalesce(h.c, 0) AS c,
         1 + CAST(1000000000 AS HUGEINT) * (coalesce(h.c, 0) + 5) // (t.n + 5 * g.v) AS p,
         1 + CAST(1000000000 AS HUGEINT) * (k.c + 5) // (g.n + 5 * g.v) AS q
  FROM total t JOIN tongue g USING (lang) JOIN kept k USING (lang) LEFT JOIN held h USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN share x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN share y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL),
result AS (
  SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM share WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM result)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""

ORACLES: dict[str, str] = {"op2_mixing": MIXING, "op7_decontaminate": CONTAMINATION, "op11_personal": PERSONAL,
                           "op12_resampling": RESAMPLING, "op13_divergence": DIVERGENCE}
