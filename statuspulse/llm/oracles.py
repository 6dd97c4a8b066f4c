"""DuckDB SQL of the registered queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["op3_mixing"] = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
weighed AS (
  SELECT source, source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
         source_size * 2.0::DOUBLE AS cap
  FROM sizes),
levelled AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS own_level
  FROM weighed
  WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aims AS (
  SELECT source, source_size, coalesce(least(cap, weight * max(CASE WHEN NOT cap / weight < own_level
         THEN own_level END) OVER ()), cap) AS target
  FROM levelled),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1
         AS place
  FROM rows),
dealt AS (
  SELECT doc_id, size, source_size, target, place,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS each_doc,
         ('0x' || md5('mix|' || coalesce('=' || aims.source, ''))[1:5])::BIGINT / 1048576.0::DOUBLE AS shift
  FROM ranked JOIN aims ON ranked.source IS NOT DISTINCT FROM aims.source)
SELECT doc_id, size, source_size, target,
       (size * least(floor(shift + each_doc * (place + 1)) - floor(shift + each_doc * place), 2))::BIGINT AS taken
FROM dealt
"""

SQL["op4_substrings"] = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT doc_id, pos, array_to_string(words[pos:pos + 12], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS pos FROM split WHERE len(words) >= 13)),
earliest AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS pos
  FROM windows JOIN earliest USING (w) WHERE first < doc_id),
places AS (SELECT doc_id, list(pos) AS places FROM gone GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(len(places), 0) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN places IS NULL THEN words ELSE
         list_filter(words, lambda w, i: NOT list_contains(places, i)) END, ' '), '')) AS kept_sha256
FROM split LEFT JOIN places USING (doc_id)
"""

SQL["op11_fill_in_middle"] = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents),
numbers AS (
  SELECT doc_id, text, units, len(units) AS n,
         ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM drawn),
formed AS (
  SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
         least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b
  FROM numbers),
cut AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS prefix,
         array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix
  FROM formed)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
              ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op12_url_rules"] = rf"""
WITH rules(action, rule_host, rule_path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
rest AS (
  SELECT page_id, url, row_number() OVER () AS nth,
         CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest
  FROM pages),
parted AS (
  SELECT page_id, nth, {_LOWER.format("split_part(rest, '/', 1)")} AS host,
         CASE WHEN contains(rest, '/') THEN rest[strpos(rest, '/'):] ELSE '' END AS path
  FROM (SELECT page_id, nth, split_part(split_part(rest, '?', 1), '#', 1) AS rest FROM rest)),
fitting AS (
  SELECT nth, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(action, length(rule_host || rule_path)) AS action
  FROM parted JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY nth)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM parted LEFT JOIN fitting USING (nth)
"""

_TERMS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL["op13_search"] = rf"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS nth, {_TERMS.format(_LOWER.format("text"))} AS terms FROM documents),
sizes AS (SELECT doc_id, nth, len(terms)::BIGINT AS n FROM words WHERE len(terms) > 0),
whole AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS total FROM sizes),
counts AS (
  SELECT nth, term, count(*)::BIGINT AS tf FROM (SELECT nth, unnest(terms) AS term FROM words) GROUP BY nth, term),
asked AS (
  SELECT item_id, term, count(*)::BIGINT AS times
  FROM (SELECT item_id, unnest({_TERMS.format(_LOWER.format("text"))}) AS term FROM benchmark)
  GROUP BY item_id, term),
weighed AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM counts WHERE term IN (SELECT term FROM asked) GROUP BY term), whole),
scored AS (
  SELECT item_id, doc_id, nth,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // total))))::BIGINT AS score
  FROM asked JOIN weighed USING (term) JOIN counts USING (term) JOIN sizes USING (nth), whole
  GROUP BY item_id, doc_id, nth),
ranked AS (
  SELECT item_id, doc_id, score,
         row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
