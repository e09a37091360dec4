"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

#: Space characters of the contracts, as DuckDB writes them in a pattern and as a string.
SPACE = r"[\x20\x09-\x0D]"
SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

#: crc32 of doc_id in decimal: DuckDB has none, so the bits are folded one by one.
CRC32 = """(SELECT xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT))"""

OP2 = f"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT k, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM t),
y AS (SELECT *, translate(trim(line, {SPACES}), {AZ}) AS key FROM l),
g AS (SELECT key, max(doc_id) AS keeper FROM y WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k, y.doc_id, line, pos, keeper IS NOT NULL AND keeper <> y.doc_id AS gone FROM y LEFT JOIN g USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY k, doc_id
"""

OP3 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {AZ}), '{SPACE}+'), lambda s: s <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)]) END AS sh FROM d),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM s LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) ON a = doc_id
"""

OP5 = f"""
WITH u AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, url, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u
), p AS (
  SELECT page_id, url, coalesce(translate(raw, {AZ}), '') AS host,
         coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM h
), r(act, rhost, rpath) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'),
         ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), fit AS (
  SELECT p.*, (SELECT max_by(rhost || rpath || ' ' || act, length(rhost || rpath)) FROM r
    WHERE (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)) AS best,
    translate(url, {AZ}) AS low FROM p
), m AS (
  SELECT *, regexp_matches(low, '^[a-z][a-z0-9+.-]*://(?:[^/?#]*[.])?example\\.org/fr/.*\\.html(?:[^a-z0-9_.%-]|$)') AS ok,
    regexp_matches(low, '^[a-z][a-z0-9+.-]*://(?:[^/?#]*[.])?(?:ads-track|casino-win|cheap-pills|free-bets|spam-farm)\\..*(?:[^a-z0-9_.%-]|$)')
    OR regexp_matches(low, '(?:[^a-z0-9_.%-]|$)affiliate_id=.*(?:[^a-z0-9_.%-]|$)')
    OR regexp_matches(low, '/wp-login\\.php(?:[^a-z0-9_.%-]|$)') AS bad FROM fit
)
SELECT page_id, host, path, split_part(best, ' ', 1) AS rule,
       coalesce(split_part(best, ' ', 2), CASE WHEN ok THEN 'allow' WHEN bad THEN 'block' ELSE 'allow' END) AS verdict FROM m
""".replace("\\\\", "\\")

OP7 = rf"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT k, doc_id, x, list_filter(regexp_split_to_array(x, '{SPACE}+'), lambda s: s <> '') AS ws,
             length(regexp_replace(x, '{SPACE}', '', 'g')) AS word_chars FROM t),
win AS (SELECT k, unnest(range(1, len(ws) - 1)) AS i, ws FROM w),
tri AS (SELECT k, i, count(*) OVER (PARTITION BY k, ws[i], ws[i + 1], ws[i + 2]) AS n FROM win),
rep AS (SELECT k, count(DISTINCT j) AS n_repeat_words FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM tri WHERE n > 1) GROUP BY k),
ln AS (SELECT k, unnest(string_split(x, chr(10))) AS l, unnest(range(len(string_split(x, chr(10))))) AS pos FROM t),
lw AS (SELECT *, list_filter(regexp_split_to_array(l, '{SPACE}+'), lambda s: s <> '') AS ws,
              length(regexp_replace(l, '{SPACE}', '', 'g')) AS chars,
              right(rtrim(l, {SPACES}), 1) AS tail FROM ln),
lj AS (SELECT *, row_number() OVER (PARTITION BY k, l ORDER BY pos) > 1 AS dup,
              NOT contains('.!?:;…"''”’»)]', tail)
              OR len(list_filter(ws, lambda s: trim(s, '|>»·•/') = '')) > 0.25 * len(ws)
              OR length(regexp_replace(l, '[^#*$%&|<>]', '', 'g')) > 0.1 * chars
              OR regexp_matches(lower(l), 'all rights reserved|alle rechte vorbehalten|cookie policy|cookie-richtlinie|datenschutzerklärung|enable javascript|lorem ipsum|mentions légales|politique de confidentialité|política de cookies|política de privacidad|privacy policy|subscribe to our newsletter|terms of use|todos los derechos reservados|tous droits réservés')
              AS fails FROM lw WHERE len(ws) > 0),
ls AS (SELECT k, count(*) FILTER (dup) AS n_dup_lines, count(*) FILTER (fails) AS n_removed,
              coalesce(sum(chars) FILTER (fails), 0)::BIGINT AS removed_chars FROM lj GROUP BY k),
f AS (SELECT doc_id, len(ws)::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
             length(regexp_replace(x, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             len(string_split(x, chr(10)))::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
             coalesce(removed_chars, 0)::BIGINT AS removed_chars
      FROM w LEFT JOIN rep USING (k) LEFT JOIN ls USING (k))
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * removed_chars <= 50 * word_chars AS kept FROM f
"""

OP8 = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {AZ}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda s: s <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {AZ}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda s: s <> '') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, L, array_to_string(ws[i:i + L - 1], ' ') AS win FROM
       (SELECT item_id, ws, least(10, len(ws)) AS L, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT L FROM bw),
dw AS (SELECT k, L, i, array_to_string(ws[i:i + L - 1], ' ') AS win FROM
       (SELECT k, ws, L, unnest(range(1, len(ws) - L + 2)) AS i FROM d, sizes WHERE len(ws) >= L)),
m AS (SELECT k, item_id, i, dw.L FROM dw JOIN bw ON dw.win = bw.win AND dw.L = bw.L),
hit AS (SELECT k, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT k, unnest(range(i, i + L)) AS p FROM m) GROUP BY k),
its AS (SELECT k, count(*)::BIGINT AS n_items, string_agg(s, ',' ORDER BY s) AS listed FROM (SELECT DISTINCT k, item_id::VARCHAR AS s FROM m) GROUP BY k)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (k) LEFT JOIN its USING (k)
"""



OP12 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x::DOUBLE[], c.x::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""


def _op13(source_levels: int = 5, top_levels: int = 4) -> str:
    """Levels are written out one by one; 16 ** source_levels rows a source and 16 ** top_levels sources are enough."""
    value = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join([*map(value, ("doc_id", "source", "lang", "n_chars")), value(text)]) + ")"
    run = lambda k: f"SELECT source, p // 16 AS p, sha256(string_agg(d, '' ORDER BY p)) AS d, list(d ORDER BY p) AS ds, (n + 15) // 16 AS n FROM {k} WHERE n > 1 GROUP BY ALL"
    steps = [f"""l AS (SELECT doc_id, coalesce('=' || source, '') AS source, {leaf("text")} AS leaf, {leaf(f"translate(text, {AZ})")} AS changed FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM l),
a0 AS (SELECT source, p, leaf AS d, [leaf] AS ds, n FROM r)"""]
    steps += [f"a{k} AS ({run(f'a{k - 1}').replace('GROUP BY ALL', 'GROUP BY source, p // 16, (n + 15) // 16')})" for k in range(1, source_levels + 1)]
    steps.append("s AS (" + " UNION ALL ".join(f"SELECT source, d AS subroot FROM a{k} WHERE n = 1" for k in range(source_levels + 1)) + ")")
    steps.append("b0 AS (SELECT '' AS source, row_number() OVER (ORDER BY source) - 1 AS p, subroot AS d, [subroot] AS ds, count(*) OVER () AS n, source AS of FROM s)")
    steps += [f"b{k} AS ({run(f'b{k - 1}').replace('GROUP BY ALL', 'GROUP BY source, p // 16, (n + 15) // 16')})" for k in range(1, top_levels + 1)]
    steps.append("root AS (" + " UNION ALL ".join(f"SELECT d AS root FROM b{k} WHERE n = 1" for k in range(top_levels + 1)) + ")")
    joins, runs = [], []
    for letter, place, levels in (("a", "r.p", source_levels), ("b", "t.p", top_levels)):
        for k in range(1, levels + 1):
            on = f"{letter}{k}.p = {place} // {16**k}" + (" AND a%d.source = r.source" % k if letter == "a" else "")
            joins.append(f"LEFT JOIN {letter}{k} ON {on}")
            runs.append((f"{letter}{k}.ds", f"({place} // {16 ** (k - 1)}) % 16 + 1"))
    siblings = " || ".join(f"coalesce(array_to_string({ds}[:{i} - 1], '') || array_to_string({ds}[{i} + 1:], ''), '')" for ds, i in runs)
    steps.append(f"""j AS (SELECT r.doc_id, leaf, changed, subroot, root, sha256({siblings}) AS proof_sha256,
  CASE WHEN crc32_of % 5 = 0 THEN changed ELSE leaf END AS f0, {", ".join(f"{ds} AS g{n}, {i} AS i{n}" for n, (ds, i) in enumerate(runs))}
  FROM (SELECT *, {CRC32} AS crc32_of FROM r) r JOIN s USING (source) JOIN b0 t ON t.of = r.source CROSS JOIN root {" ".join(joins)})""")
    for n in range(len(runs)):
        fold = f"sha256(array_to_string(g{n}[:i{n} - 1], '') || f{n} || array_to_string(g{n}[i{n} + 1:], ''))"
        steps.append(f"f{n} AS (SELECT *, CASE WHEN g{n} IS NULL THEN f{n} ELSE {fold} END AS f{n + 1} FROM {'j' if n == 0 else f'f{n - 1}'})")
    end = len(runs)
    return f"WITH {', '.join(steps)} SELECT doc_id, leaf, subroot, root, proof_sha256, f{end} AS folded_root, f{end} = root AS verified FROM f{end - 1}"


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2, "op3_near_dedup": OP3, "op5_url_filter": OP5, "op7_quality_rules": OP7, "op8_decontamination": OP8, "op12_pivot_topk": OP12, "op13_merkle_manifest": _op13()}
