"""DuckDB SQL for the queries of this subpackage that SQL can express, written apart from the Spark code."""

from __future__ import annotations

from kindred.llm.personal import IBAN_LENGTHS, KINDS, SCORES

WORD = r"[^\x20\x09-\x0D]+"

SQL: dict[str, str] = {}

SQL["op2_quality_rules"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
        [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '{WORD}')] AS lines FROM documents),
placed AS (SELECT doc_id, unnest(range(1, greatest(length(w) - 6, 1))) AS i, w FROM d),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS g FROM placed),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
gaps AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS gap FROM twice),
covered AS (SELECT doc_id, CAST(sum(gap) AS BIGINT) AS n FROM gaps GROUP BY doc_id),
m AS (SELECT doc_id, CAST(length(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
        CAST(length(lines) - length(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
        length(lines) AS n_lines, length(regexp_replace(text, '\P{{Lu}}+', '', 'g')) AS n_upper FROM d LEFT JOIN covered USING (doc_id)),
rules AS (SELECT *, CAST(n_words < 20 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 30 * n_words AS BIGINT)
        + 4 * CAST(10 * n_symbols > n_words AS BIGINT) + 8 * CAST(10 * n_dup_lines > 3 * n_lines AS BIGINT)
        + 16 * CAST(word_chars < 3 * n_words AS BIGINT) + 32 * CAST(word_chars > 12 * n_words AS BIGINT)
        + 64 * CAST(2 * n_upper > word_chars AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM rules"""

_ESC = r"""replace(replace(coalesce({}, ''), '\', '\\'), '<|', '<\|')"""
SQL["op4_chat_format"] = f"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
made AS (SELECT *, '<|im_start|>' || replace({_ESC.format('role')}, chr(10), '\\n') || chr(10) || {_ESC.format('text')} || '<|im_end|>' || chr(10) AS marked FROM c),
each AS (SELECT conv_id, count(*) AS n_turns,
    string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '') AS loss,
    CAST(sum(length(marked)) AS BIGINT) AS formatted_chars FROM made GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM each"""

# the pages hold no redirects or canonical links (a test checks that), so every page is judged by its own rule
SQL["op6_url_filter"] = """
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
rules AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) r(verdict, suffix, prefix)),
met AS (SELECT page_id, suffix || prefix AS rule, verdict FROM h JOIN rules ON (host = suffix OR ends_with(host, '.' || suffix)) AND starts_with(path, prefix)
    QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(suffix || prefix) DESC) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict, CAST(NULL AS VARCHAR) AS component FROM h LEFT JOIN met USING (page_id)"""

SQL["op9_jaccard_join"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN length(w) = 0 THEN [] WHEN length(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] for i in range(1, length(w) - 2)] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (g) JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
    WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (min(x.n) + min(y.n) - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)"""

# two hexadecimal digits stand for a byte
SQL["op10_suffix_dedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, i, substring(h, 2 * i + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
later AS (SELECT doc_id, i FROM s QUALIFY doc_id > min(doc_id) OVER (PARTITION BY g)),
runs AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM later),
numbered AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM runs),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY ALL),
kept AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(CASE WHEN a IS NULL THEN h ELSE substring(h, 1, 2 * a[1]) || array_to_string(
        [substring(h, 2 * b[j] + 1, 2 * (coalesce(a[j + 1], length(h) // 2) - b[j])) FOR j IN range(1, length(a) + 1)], '') END)) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


def _personal_data() -> str:
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    groups = r"[0-9]+(?:[\x20./-][0-9]+)+"
    forms = (
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
        r"\+[0-9][\x20().0-9-]+[0-9]", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}", groups, groups,
    )
    free = "NOT regexp_matches(before, '[A-Za-z0-9+]$') AND NOT regexp_matches(after, '^[A-Za-z0-9]')"
    ssn = "'[0-9]{3}-[0-9]{2}-[0-9]{4}'"
    good = (
        "true", rf"regexp_full_match(s, '{part}\.{part}\.{part}\.{part}')",
        """length(n) BETWEEN 14 AND 19 AND list_sum([CASE WHEN i % 2 = 1 THEN CAST(reverse(n)[i] AS INT)
            ELSE 2 * CAST(reverse(n)[i] AS INT) - CASE WHEN reverse(n)[i] >= '5' THEN 9 ELSE 0 END END FOR i IN range(1, length(n) + 1)]) % 10 = 0""",
        "length(n) BETWEEN 10 AND 15",
        """size IS NOT NULL AND NOT regexp_matches(before, '[A-Za-z0-9]$') AND NOT regexp_matches(substring(s, size + 1) || after, '^[A-Za-z0-9]')
            AND list_reduce(list_concat([0], [strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1
                FOR c IN string_split(substring(replace(left(s, size), ' ', ''), 5) || left(s, 4), '')]), lambda a, v: (a * CASE WHEN v < 10 THEN 10 ELSE 100 END + v) % 97) = 1""",
        f"{free} AND regexp_full_match(s, {ssn}) AND NOT regexp_matches(s, '^(?:000|666|9)|-00-|-0000$')",
        rf"{free} AND regexp_full_match(s, '[0-9]{{2,4}}(?:[\x20./-][0-9]{{2,4}}){{1,4}}') AND length(n) BETWEEN 7 AND 12 AND NOT regexp_full_match(s, {ssn})",
    )
    said = lambda words: f"CAST(regexp_matches(near, '(?:^|[^a-z0-9])(?:{words})(?:[^a-z0-9]|$)') AS INT)"
    found = " UNION ALL ".join(f"SELECT doc_id, {k} AS k, regexp_extract_all(text, '{f}') AS found, string_split_regex(text, '{f}') AS gaps FROM d" for k, f in enumerate(forms))
    lengths = " ".join(f"WHEN '{c}' THEN {n}" for c, n in IBAN_LENGTHS.items())
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({found}),
each AS (SELECT doc_id, k, found, gaps, unnest(range(1, length(found) + 1)) AS i FROM m),
p AS (SELECT doc_id, k, found[i] AS s, right(gaps[i], 40) AS before, left(gaps[i + 1], 20) AS after,
    CAST(sum(length(gaps[i]) + length(found[i])) OVER (PARTITION BY doc_id, k ORDER BY i) AS BIGINT) AS e FROM each),
q AS (SELECT *, e - length(s) AS b, regexp_replace(s, '[^0-9]', '', 'g') AS n, translate(before || ' | ' || after, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS near,
    CASE WHEN k = 4 THEN [j FOR j IN range(1, length(s) + 1) IF length(replace(left(s, j), ' ', '')) = CASE left(s, 2) {lengths} END][1] END AS size FROM p),
r AS (SELECT doc_id, k, b, CASE WHEN k = 4 THEN b + size ELSE e END AS e,
    CASE k {' '.join(f"WHEN {k} THEN {SCORES[kind][0]} + 0.4 * {said(SCORES[kind][1])} - 0.3 * {said(SCORES[kind][2])}" for k, kind in enumerate(KINDS))} END AS score
    FROM q WHERE CASE k {' '.join(f"WHEN {k} THEN {g}" for k, g in enumerate(good))} END),
kept AS (SELECT *, k < 4 AS base, CASE k {' '.join(f"WHEN {k} THEN '{kind}'" for k, kind in enumerate(KINDS))} END || ':' || b || ':' || e AS said FROM r
    WHERE k < 4 OR (score >= 0.5 AND NOT EXISTS (SELECT 1 FROM r AS o WHERE o.doc_id = r.doc_id AND o.k < 4 AND o.b < r.e AND r.b < o.e))),
g AS (SELECT doc_id, {', '.join(f"count(*) FILTER (k = {k}) AS n_{kind}" for k, kind in enumerate(KINDS[:4]))},
    string_agg(said, ',' ORDER BY b, k) FILTER (base) AS base, string_agg(said, ',' ORDER BY b, k) AS spans FROM kept GROUP BY doc_id)
SELECT doc_id, {', '.join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in KINDS[:4])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""


SQL["op11_personal_data"] = _personal_data()


def _centroids(rounds: int = 10, k: int = 8) -> str:
    near = """SELECT row, vec_id, x, c, z, dist FROM (SELECT v.*, c, z, CAST(list_sum([(x[j] - z[j]) * (x[j] - z[j]) FOR j IN range(1, 65)]) AS BIGINT) AS dist
        FROM v, k{i}) QUALIFY row_number() OVER (PARTITION BY row ORDER BY dist, c) = 1"""
    moved = """SELECT c, coalesce(z, old) AS z FROM (SELECT c, z AS old FROM k{i}) LEFT JOIN
        (SELECT c, list(m ORDER BY j) AS z FROM (SELECT c, j, CAST((s - (s % n + n) % n) // n AS BIGINT) AS m FROM
            (SELECT c, j, sum(x[j]) AS s, count(*) AS n FROM (SELECT c, x, unnest(range(1, 65)) AS j FROM ({near})) GROUP BY c, j)) GROUP BY c) USING (c)"""
    steps = "".join(f",\nk{i + 1} AS MATERIALIZED ({moved.format(i=i, near=near.format(i=i))})" for i in range(rounds))
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, [CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT) FOR e IN embedding] AS x FROM embeddings
    WHERE length(embedding) = 64 AND length([e FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0),
k0 AS MATERIALIZED (SELECT c - 1 AS c, x AS z FROM (SELECT x, row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), ''))) AS c FROM v) WHERE c <= {k}){steps},
f AS MATERIALIZED ({near.format(i=rounds)})
SELECT vec_id, CAST(c AS INT) AS "cluster", dist AS distance, CAST(sum(dist) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
    CAST(sum(dist) OVER () AS BIGINT) AS inertia, sha256(array_to_string(z, ',')) AS centroid_sha256 FROM f"""


SQL["op13_centroids"] = _centroids()
