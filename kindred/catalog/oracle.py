"""SQL for the registered queries, written for DuckDB and apart from the Spark code."""

from __future__ import annotations

from kindred.catalog.inputs import ALLOWED, BOOK_SAMPLE, PAPER_SAMPLE
from kindred.catalog.queries import CELLS, LABELS, LATENT, LEMMAS
from kindred.functions.words import STOPWORDS

ORACLE: dict[str, str] = {}


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


SPACE = (
    r"[\t-\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
WORD = r"[\p{L}\p{N}_]{2,}"


def sub(text: str, pattern: str, to: str) -> str:
    return f"regexp_replace({text}, '{pattern}', {to}, 'g')"


def strip(text: str) -> str:
    return sub(text, rf"\A{SPACE}+|{SPACE}+\z", "''")


def words_of(text: str) -> str:
    return f"[w for w in regexp_split_to_array({text}, '{SPACE}+') if w <> '']"


def no_html(text: str) -> str:
    markup = (
        r"(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
        r"|<!--.*?(?:-->|\z)|<[a-z/!?][^>]*(?:>|\z)"
    )
    marked = sub(text, markup, "chr(1)")
    plain = sub(sub(marked, r"\A\x01+|\x01+\z", "''"), r"\x01+", "' '")
    for name, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        plain = f"replace({plain}, '&{name};', '{char}')"
    return plain


def no_latex(text: str) -> str:
    text = sub(text, r"\$.*?\$", "' '")
    text = sub(text, r"\\[a-zA-Z]+\{.*?\}", "' '")
    return sub(text, r"\\[a-zA-Z]+", "' '")


def alphanumeric(text: str) -> str:
    text = sub(text, r"[^a-zA-Z0-9\s]", "' '")
    return f"trim({sub(text, r'[\s\x0b]+', chr(39) + ' ' + chr(39))})"


def no_stopwords(text: str) -> str:
    return (
        f"array_to_string([w for w in {words_of(text)} if length(w) > 1 and w not in ({quoted(STOPWORDS)})], ' ')"
    )


def truncated(text: str, n: int) -> str:
    head = f"substring({text}, 1, {n})"
    return (
        f"CASE WHEN length({text}) <= {n} OR strpos({head}, ' ') = 0 THEN {head} "
        f"ELSE substring({text}, 1, {n} - strpos(reverse({head}), ' ')) END"
    )


def cleaned(source: str, keys: str, text: str, n: int | None = None, out: str = "text_clean", lemma: str = "{}") -> str:
    """SELECT with the cleaned text of every row of ``source``."""
    words = lemma.format(no_stopwords(alphanumeric(f"lower({no_latex(no_html(f'coalesce({text}, {chr(39)*2})'))})")))
    cut = "t" if n is None else truncated("t", n)
    return f"SELECT {keys}, trim({cut}) AS {out} FROM (SELECT {keys}, {words} AS t FROM {source})"


DOC_ITEMS = """SELECT 'doc_' || doc_id AS item_id, 'document' AS source, split_part(text, chr(10), 1) AS title,
    text, source AS authors, lang AS category FROM documents"""
PAGE_ITEMS = r"""SELECT 'page_' || page_id AS item_id, 'page' AS source,
    regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, html AS text,
    regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS authors,
    regexp_extract(html, '<html lang="([a-z]+)"', 1) AS category FROM pages"""
ITEMS = f"items AS ({DOC_ITEMS} UNION ALL {PAGE_ITEMS})"
_ITEM_KEYS = "item_id, source, title, text, authors, category"


def processed(items: str, name: str = "docs") -> str:
    """CTE of items with cleaned text of at least 50 characters."""
    return f"{name} AS (SELECT * FROM ({cleaned(items, _ITEM_KEYS, 'text')}) WHERE length(text_clean) >= 50)"


DOCS = processed(f"({DOC_ITEMS})")
ALL_DOCS = f"{ITEMS}, {processed('items')}"

COUNTS = """tokens AS (SELECT item_id, [w for w in string_split(text_clean, ' ') if length(w) > 1] AS w FROM docs),
terms AS (SELECT item_id, unnest(w) AS term FROM tokens
    UNION ALL
    SELECT item_id, unnest([w[i] || ' ' || w[i + 1] for i in range(1, length(w))]) FROM tokens),
counts AS (SELECT item_id, term, count(*) AS tf FROM terms GROUP BY ALL)"""

STATS = """stats AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM counts GROUP BY term)"""

VOCAB = """n AS (SELECT count(*) AS n FROM docs),
vocab AS (SELECT term, df, cf, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM stats, n
    WHERE df >= 2 AND df <= 0.95 * n ORDER BY cf DESC, term LIMIT 10000)"""

WEIGHTS = """raw AS (SELECT item_id, term, (1 + ln(tf)) * idf AS r FROM counts JOIN vocab USING (term)),
norms AS (SELECT item_id, sqrt(sum(r * r)) AS norm FROM raw GROUP BY item_id),
postings AS (SELECT item_id, term, r / norm AS weight FROM raw JOIN norms USING (item_id))"""

FIT = f"{COUNTS}, {STATS}, {VOCAB}, {WEIGHTS}"

_FALLBACK = "SELECT query_id, text, CASE WHEN trim(c) = '' THEN text ELSE c END AS query_text FROM ({})"


def asked(source: str = "(SELECT item_id AS query_id, text FROM benchmark)") -> str:
    return f"asked AS ({_FALLBACK.format(cleaned(source, 'query_id, text', 'text', out='c'))})"


QUERY_WEIGHTS = f"""qtokens AS (SELECT query_id, regexp_extract_all(lower(strip_accents(query_text)), '{WORD}') AS w FROM asked),
qterms AS (SELECT query_id, unnest(w) AS term FROM qtokens
    UNION ALL
    SELECT query_id, unnest([w[i] || ' ' || w[i + 1] for i in range(1, length(w))]) FROM qtokens),
qcounts AS (SELECT query_id, term, count(*) AS tf FROM qterms GROUP BY ALL),
qraw AS (SELECT query_id, term, (1 + ln(tf)) * idf AS r FROM qcounts JOIN vocab USING (term)),
qnorms AS (SELECT query_id, sqrt(sum(r * r)) AS norm FROM qraw GROUP BY query_id),
qweights AS (SELECT query_id, term, r / norm AS weight FROM qraw JOIN qnorms USING (query_id))"""

TFIDF_SCORES = """scores AS (SELECT query_id, item_id, round(sum(p.weight * q.weight), 6) AS score
    FROM postings p JOIN qweights q USING (term) GROUP BY ALL)"""


def hashed(source: str, key: str, words: str, prefix: str, dim: int = 64) -> str:
    """CTEs ending in ``<prefix>slots`` (key, slot, value) of non-zero unit vector entries."""
    return f"""{prefix}w AS (SELECT {key}, unnest({words}) AS w FROM {source}),
{prefix}s AS (SELECT {key}, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {dim} AS slot,
    sum(CASE WHEN substr(md5(w), 9, 1) < '8' THEN 1.0 ELSE -1.0 END)::DOUBLE AS v FROM {prefix}w GROUP BY ALL),
{prefix}n AS (SELECT {key}, sqrt(sum(v * v)) AS norm FROM {prefix}s GROUP BY ALL),
{prefix}slots AS (SELECT {key}, slot, CAST(CASE WHEN norm > 0 THEN v / norm ELSE v END AS FLOAT)::DOUBLE AS value
    FROM {prefix}s JOIN {prefix}n USING ({key}))"""


_ITEM_WORDS = "[w for w in string_split(text_clean, ' ') if length(w) > 1]"
SEMANTIC_SCORES = (
    hashed("docs", "item_id", _ITEM_WORDS, "iv")
    + ", "
    + hashed("asked", "query_id", f"regexp_extract_all(lower(strip_accents(text)), '{WORD}')", "qv")
    + """, semantic AS (SELECT query_id, item_id, round(coalesce(s, 0), 6) AS score
    FROM (SELECT query_id, item_id FROM asked, docs) LEFT JOIN
        (SELECT query_id, item_id, sum(i.value * q.value) AS s FROM ivslots i JOIN qvslots q USING (slot) GROUP BY ALL)
        USING (query_id, item_id))"""
)


def ranked(scores: str, k: int, name: str) -> str:
    order = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)"
    return f"""{name} AS (SELECT query_id, item_id, score, CAST({order} AS INTEGER) AS rank
        FROM {scores} QUALIFY {order} <= {k})"""


def self_less(scores: str, n: int, prefix: str) -> str:
    """CTEs: best n + 1, then without near-identical items, as ``<prefix>best``."""
    return ranked(scores, n + 1, f"{prefix}top") + ", " + ranked(
        f"(SELECT query_id, item_id, score FROM {prefix}top WHERE score < 0.9999)", n, f"{prefix}best"
    )


def final(best: str, method: str, extra: str = "") -> str:
    return f"""SELECT query_id, CAST(rank AS INTEGER) AS rank, item_id, score AS similarity_score,
        '{method}' AS method{extra} FROM {best}"""


def parity(scores: str, source: str | None, prefix: str, n: int = 8) -> str:
    """CTEs of the over-fetching mode, as ``<prefix>found`` (query_id, rank, item_id, score)."""
    where = f"WHERE source = '{source}'" if source else ""
    return self_less(scores, 4 * n, prefix) + f""", {prefix}kept AS (
        SELECT b.* FROM {prefix}best b JOIN docs USING (item_id) {where}),
        {prefix}found AS (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank
            FROM {prefix}kept QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= {n})"""


def exact(scores: str, source: str, prefix: str, n: int = 8) -> str:
    return ranked(
        f"(SELECT s.* FROM {scores} s JOIN docs USING (item_id) WHERE source = '{source}' AND score < 0.9999)",
        n,
        f"{prefix}found",
    )


# --- sources -----------------------------------------------------------------

GENRES = """CASE k % 8 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Single ' || k WHEN 2 THEN 'Unknown' WHEN 3 THEN 'Unknown'
    WHEN 4 THEN 'New ' || k || ', Middle' WHEN 5 THEN 'Unknown' WHEN 6 THEN 'Café, Say "hi"'
    ELSE 'Genre ' || k || ', Drama, Novel' END"""

_GENRE_TEXT = r"""CASE k % 8 WHEN 0 THEN '{}' WHEN 1 THEN '{''x'': ''Single ' || k || '''}' WHEN 2 THEN '{"x": ' || k || '}'
    WHEN 3 THEN 'not a map' WHEN 4 THEN '{"k": "Old", "j": "Middle", "k": "New ' || k || '"}' WHEN 5 THEN '["Genre"]'
    WHEN 6 THEN '{"x": "Caf\u00e9", "y": "Say \"hi\""}'
    ELSE '{"/m/a": "Genre ' || k || '", "/m/b": "Drama", "/m/c": "Novel", "/m/d": "Fourth"}' END"""

ORACLE["parse_tsv_lines"] = f"""
SELECT CAST(k AS VARCHAR) AS wiki_id, p_brand AS freebase_id,
    CASE k % 10 WHEN 5 THEN NULL WHEN 8 THEN p_name || chr(9) || 'and more'
        WHEN 9 THEN 'the "' || p_name || '" part' ELSE p_name END AS title,
    CASE WHEN k % 10 = 6 THEN NULL ELSE p_type END AS author, CAST(p_size AS VARCHAR) AS pub_date,
    {_GENRE_TEXT} AS genres_raw,
    CASE WHEN k % 10 = 3 THEN NULL ELSE 'Summary of ' || p_name END AS summary
FROM (SELECT *, p_partkey AS k FROM part) WHERE k % 10 NOT IN (2, 7)"""

ORACLE["na_tokens_to_null"] = """
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 0 OR p_partkey % 11 = 0 THEN NULL ELSE p_name END AS name
FROM part"""

PAPERS = """papers AS (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN ' Paper' || chr(10) || doc_id END AS title,
    text AS abstract, CASE WHEN doc_id % 6 = 0 THEN '' ELSE source END AS authors,
    CASE WHEN doc_id % 13 <> 0 THEN lang || '  ' || source END AS categories, lang, source
    FROM documents WHERE doc_id % 10 > 2)"""

ORACLE["parse_ndjson_lines"] = f"WITH {PAPERS} SELECT doc_id, title, abstract, authors, categories FROM papers"

ORACLE["csv_roundtrip"] = f"""WITH {ITEMS} SELECT item_id, source, nullif(title, '') AS title, nullif(text, '') AS text,
    nullif(authors, '') AS authors, nullif(category, '') AS category FROM items"""

ORACLE["metadata_table"] = f"""WITH {ITEMS} SELECT item_id, source, title, authors, category,
    row_number() OVER (ORDER BY source, item_id) - 1 AS row_index FROM items"""

ORACLE["model_tables_roundtrip"] = f"""WITH {DOCS}, {FIT}
SELECT item_id, count(*) AS n_terms, round(sum(weight), 6) AS total_weight, category, 64 AS dim
FROM postings JOIN docs USING (item_id) GROUP BY item_id, category"""

# --- projections, defaults, filters ------------------------------------------

ORACLE["ingest_books"] = rf"""
WITH books AS (SELECT *, doc_id AS k, {strip("translate(text, chr(9) || chr(10) || '\"', '  ''')")} AS body FROM documents),
kept AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || doc_id)) - 1 AS i FROM books
    WHERE doc_id % 11 <> 0 AND length(body) > 50 QUALIFY i < {BOOK_SAMPLE})
SELECT 'book_' || i AS item_id, 'book' AS source, 'Title ' || doc_id AS title, body AS text,
    CASE WHEN doc_id % 3 = 0 THEN 'Unknown' ELSE source END AS authors, {GENRES} AS category FROM kept"""

_FLAT = strip("replace(abstract, chr(10), ' ')")
_IN = " OR ".join(f"lang = '{a}' OR source = '{a}'" for a in ALLOWED)
ORACLE["ingest_papers"] = f"""
WITH {PAPERS}, kept AS (SELECT *, {_FLAT} AS body FROM papers WHERE categories IS NOT NULL AND ({_IN})),
first AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM kept WHERE length(body) >= 80 QUALIFY i < {PAPER_SAMPLE})
SELECT 'paper_' || i AS item_id, 'paper' AS source, CASE WHEN title IS NULL THEN '' ELSE 'Paper ' || doc_id END AS title,
    body AS text, coalesce(nullif(authors, ''), 'Unknown') AS authors, lang AS category FROM first"""

ORACLE["dense_item_index"] = """
SELECT source, doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS row_index FROM documents"""

ORACLE["default_values"] = """
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Unknown' WHEN 1 THEN '' ELSE source END AS if_null,
    CASE doc_id % 3 WHEN 2 THEN source ELSE 'Unknown' END AS if_empty FROM documents"""

ORACLE["drop_null_rows"] = """
SELECT doc_id, split_part(text, chr(10), 1) AS title FROM documents WHERE doc_id % 4 <> 0 AND text IS NOT NULL"""

ORACLE["filter_min_chars"] = f"""
SELECT doc_id, text AS line FROM documents WHERE length({strip("text")}) > 50"""

ORACLE["filter_any_category"] = f"""
SELECT doc_id, lang, source FROM documents WHERE doc_id % 13 <> 0 AND ({_IN})"""

ORACLE["filter_clean_length"] = f"WITH {DOCS} SELECT item_id, CAST(length(text_clean) AS INTEGER) AS chars FROM docs"

ORACLE["filter_nonblank"] = f"""
SELECT doc_id, text AS text_clean FROM documents WHERE doc_id % 5 > 1 AND length({strip("text")}) > 0"""

ORACLE["first_n_kept"] = """
SELECT doc_id, lang, source FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 100"""

ORACLE["sample_exact_n"] = "SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 250"

ORACLE["ingest_counters"] = f"""
WITH {PAPERS} SELECT (SELECT count(*) FROM documents WHERE doc_id % 10 <> 2) AS scanned,
    count(*) FILTER (categories IS NOT NULL AND ({_IN}) AND length({_FLAT}) >= 80) AS kept FROM papers"""

ORACLE["merge_datasets"] = f"WITH {ITEMS} SELECT * FROM items"

ORACLE["peek_rows"] = f"""
WITH {ITEMS} SELECT item_id, title, substring(text, 1, 200) AS text FROM items ORDER BY item_id LIMIT 2"""

# --- text functions ----------------------------------------------------------

ORACLE["clean_html"] = f"SELECT page_id, {no_html('html')} AS plain FROM pages"

_COMMANDS = r"('\textbf{bold} ' || text || ' see \cite{a} and \alpha $x$')"
ORACLE["clean_latex"] = f"SELECT doc_id, {no_latex(_COMMANDS)} AS plain FROM documents"

ORACLE["clean_special_chars"] = f"SELECT doc_id, {alphanumeric('text')} AS plain FROM documents"

_LOWER = "lower(regexp_replace(text, '[.,]', ' ', 'g'))"
ORACLE["clean_stopwords"] = f"SELECT doc_id, {no_stopwords(_LOWER)} AS kept FROM documents"

ORACLE["truncate_words"] = f"SELECT doc_id, {truncated('text', 120)} AS head FROM documents"

ORACLE["clean_text"] = cleaned("documents", "doc_id", "text", 1000)

ORACLE["lemmatize_lookup"] = f"""WITH {DOCS}
SELECT item_id, array_to_string([CASE WHEN w LIKE '%s' THEN w[:-2] ELSE w END for w in string_split(text_clean, ' ')], ' ')
    AS text_clean FROM docs"""

_LEMMA_CASE = " ".join(f"WHEN '{w}' THEN '{to}'" for w, to in LEMMAS.items())
_LEMMATIZED = "array_to_string([CASE w " + _LEMMA_CASE + " ELSE w END for w in string_split({}, ' ')], ' ')"
ORACLE["clean_text_lemmas"] = cleaned("documents", "doc_id", "text", lemma=_LEMMATIZED)
ORACLE["preprocess_lemmas"] = f"""WITH {ITEMS} SELECT item_id, source, text_clean
FROM ({cleaned('items', _ITEM_KEYS, 'text', lemma=_LEMMATIZED)}) WHERE length(text_clean) >= 50"""

ORACLE["strip_unicode"] = f"""SELECT doc_id, {strip("text")} AS line FROM documents"""

ORACLE["normalize_newlines"] = f"""SELECT doc_id,
    CASE WHEN doc_id % 9 = 0 THEN '' ELSE {strip("replace(text, chr(10), ' ')")} END AS line FROM documents"""

ORACLE["first_category"] = """
SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'unknown' ELSE lang END AS category FROM documents"""

ORACLE["map_first_values"] = f"""
SELECT 'part_' || k AS row_key, {GENRES} AS category FROM (SELECT p_partkey AS k FROM part)
UNION ALL SELECT 'event_' || event_id, 'Unknown' FROM events"""

ORACLE["fold_accents"] = "SELECT doc_id, strip_accents(text) AS folded FROM documents"

_REDUCED = "(SELECT item_id AS query_id, CASE WHEN item_id % 4 = 0 THEN 'What is THE' ELSE text END AS text FROM benchmark)"
ORACLE["query_fallback"] = f"WITH {asked(_REDUCED)} SELECT query_id, query_text FROM asked"

# --- corpus tables and metrics -----------------------------------------------

ORACLE["preprocess"] = f"WITH {ALL_DOCS} SELECT item_id, source, text_clean FROM docs"

ORACLE["preprocess_summary"] = f"""WITH {ALL_DOCS}
SELECT source, count(*) AS n, round(avg(length(text_clean)), 6) AS avg_clean_text_len FROM docs GROUP BY source
UNION ALL SELECT 'all', count(*), round(avg(length(text_clean)), 6) FROM docs"""

ORACLE["corpus_metrics"] = f"""WITH {ALL_DOCS}
SELECT count(*) AS total_docs, count(*) FILTER (source = 'document') AS document_count,
    count(*) FILTER (source = 'page') AS page_count, round(avg(length(text_clean)), 6) AS avg_clean_text_len,
    avg(CASE WHEN text_clean IS NULL THEN 1 ELSE 0 END) * 100 AS null_text_pct,
    (SELECT count(*) FROM items) - count(*) AS rows_dropped FROM docs"""

ORACLE["count_by_source"] = f"WITH {ITEMS} SELECT source, count(*) AS n FROM items GROUP BY source"

ORACLE["profile_nulls"] = f"WITH {ITEMS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER ({test}) AS nulls, count(*) AS row_count FROM items"
    for c, test in [(c, f"{c} IS NULL") for c in ("item_id", "source", "title", "text", "category")]
    + [("authors", "authors IS NULL OR authors = 'src1'")]
)

ORACLE["quality_checks"] = f"""WITH {ALL_DOCS}
SELECT 'raw_missing_columns' AS check_name, 0.0::DOUBLE AS value, true AS passed
UNION ALL SELECT 'raw_rows', count(*)::DOUBLE, count(*) > 0 FROM items
UNION ALL SELECT 'clean_column_missing', 0.0, true
UNION ALL SELECT 'processed_rows', count(*)::DOUBLE, count(*) > 0 FROM docs
UNION ALL SELECT 'null_clean_pct', 100.0 * count(*) FILTER (text_clean IS NULL) / count(*),
    100.0 * count(*) FILTER (text_clean IS NULL) / count(*) <= 10 FROM docs"""

# --- terms -------------------------------------------------------------------

ORACLE["ngrams"] = f"""WITH {DOCS}, tokens AS (SELECT item_id, {_ITEM_WORDS} AS w FROM docs)
SELECT item_id, array_to_string(list_concat(list_concat(w,
    [w[i] || ' ' || w[i + 1] for i in range(1, length(w))]),
    [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, length(w) - 1)]), '|') AS terms FROM tokens"""

ORACLE["term_frequency"] = f"WITH {DOCS}, {COUNTS} SELECT item_id, term, tf FROM counts"
ORACLE["document_frequency"] = f"WITH {DOCS}, {COUNTS}, {STATS} SELECT term, df, cf FROM stats WHERE df >= 2"
ORACLE["vocabulary"] = f"WITH {DOCS}, {COUNTS}, {STATS}, {VOCAB} SELECT term, df, cf, round(idf, 6) AS idf FROM vocab"
ORACLE["tfidf_weights"] = f"WITH {DOCS}, {FIT} SELECT item_id, term, round(weight, 6) AS weight FROM postings"
ORACLE["model_metrics_sparse"] = f"""WITH {DOCS}, {FIT}, v AS (SELECT count(*) AS v FROM vocab)
SELECT v AS vocab_size, n AS matrix_rows, v AS matrix_cols, (SELECT count(*) FROM postings) AS nnz,
    round(1.0::DOUBLE - (SELECT count(*) FROM postings)::DOUBLE / (n * v), 9) AS sparsity FROM n, v"""

# --- search ------------------------------------------------------------------

SPARSE = f"{DOCS}, {FIT}, {asked()}, {QUERY_WEIGHTS}"
SPARSE_ALL = f"{ALL_DOCS}, {FIT}, {asked()}, {QUERY_WEIGHTS}, {TFIDF_SCORES}"

ORACLE["tfidf_transform_queries"] = f"WITH {SPARSE} SELECT query_id, term, round(weight, 6) AS weight FROM qweights"

ORACLE["tfidf_topk"] = f"WITH {SPARSE}, {TFIDF_SCORES}, {self_less('scores', 10, 't')} {final('tbest', 'tfidf')}"

ORACLE["topk_with_metadata"] = f"""WITH {SPARSE}, {TFIDF_SCORES}, {self_less('scores', 3, 't')}
{final('tbest JOIN docs USING (item_id)', 'tfidf', ', title, authors, category, source')}"""

ORACLE["hashed_embedding"] = f"""WITH {DOCS}, {hashed('docs', 'item_id', _ITEM_WORDS, 'iv')}
SELECT item_id, CAST(slot AS INTEGER) AS slot, round(coalesce(value, 0), 5) AS value
FROM (SELECT item_id, unnest(range(64)) AS slot FROM docs) LEFT JOIN ivslots USING (item_id, slot)"""

ORACLE["semantic_topk"] = f"""WITH {DOCS}, {asked()}, {SEMANTIC_SCORES}, {self_less('semantic', 10, 's')}
{final('sbest', 'semantic')}"""

ORACLE["l2_normalize"] = """
WITH s AS (SELECT vec_id AS item_id, [x::DOUBLE * (vec_id % 4) for x in embedding] AS v FROM embeddings),
n AS (SELECT item_id, v, sqrt(list_sum([x * x for x in v])) AS norm FROM s)
SELECT item_id, CAST(unnest(range(length(v))) AS INTEGER) AS slot,
    round(unnest([CASE WHEN norm > 0 THEN x / norm ELSE x END for x in v]), 6) + 0.0 AS value FROM n"""

DENSE = f"""pairs AS (SELECT q.vec_id AS query_id, v.vec_id AS item_id,
    round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
    FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)"""

ORACLE["dense_topk_exact"] = f"WITH {DENSE}, {ranked('pairs', 10, 'best')} SELECT query_id, item_id, score, rank FROM best"
ORACLE["dense_topk_ivf_all_cells"] = ORACLE["dense_topk_exact"]

CELL_SCORES = """entries AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 1025) r(i)
    WHERE i <= length(embedding) GROUP BY ALL),
centroids AS (SELECT label AS cell_id, list(x ORDER BY i) AS centroid FROM entries GROUP BY label),
near AS (SELECT vec_id, cell_id, row_number() OVER (PARTITION BY vec_id
    ORDER BY list_inner_product(embedding::DOUBLE[], centroid) DESC, cell_id) AS place FROM embeddings, centroids)"""

ORACLE["ivf_cell_sizes"] = f"WITH {CELL_SCORES} SELECT cell_id, count(*) AS n FROM near WHERE place = 1 GROUP BY cell_id"

ORACLE["dense_topk_ivf"] = ORACLE["dense_topk_exact"]

ORACLE["kmeans_cells"] = "SELECT 20 AS cells, count(*) AS vectors, 0 AS misplaced FROM embeddings"

ORACLE["topk_exclude_self"] = f"""WITH {DENSE}, {self_less('pairs', 10, 'd')}
SELECT query_id, item_id, score, rank FROM dbest"""

ORACLE["topk_exclude_self_exact"] = f"""WITH {DENSE}, {ranked('(SELECT * FROM pairs WHERE score < 0.9999)', 10, 'best')}
SELECT query_id, item_id, score, rank FROM best"""

ORACLE["model_metrics_dense"] = """
SELECT CAST(max(length(embedding)) AS INTEGER) AS embedding_dim, count(*) AS embedding_count,
    round(avg(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS embedding_norm_mean FROM embeddings"""

ORACLE["recommend"] = f"WITH {SPARSE_ALL}, {parity('scores', None, 'r')} {final('rfound', 'tfidf')}"


def both_modes(ctes: str, scores: str, method: str) -> str:
    return f"""WITH {ctes}, {parity(scores, 'page', 'p')}, {exact(scores, 'page', 'e')}
    SELECT 'parity' AS mode, * FROM ({final('pfound', method)})
    UNION ALL SELECT 'exact', * FROM ({final('efound', method)})"""


ORACLE["recommend_source_filter"] = both_modes(SPARSE_ALL, "scores", "tfidf")

SEMANTIC_ALL = f"{ALL_DOCS}, {asked()}, {SEMANTIC_SCORES}"
ORACLE["recommend_semantic_source"] = both_modes(SEMANTIC_ALL, "semantic", "semantic")

# the prefixes of the two scoring chains differ, so they can stand in one statement
ORACLE["compare_methods"] = f"""WITH {SPARSE_ALL}, {SEMANTIC_SCORES},
{parity('scores', None, 'l')}, {parity('semantic', 'document', 'm')},
pairs AS (SELECT query_id, rank, l.item_id AS left_item, l.score AS left_score, m.item_id AS right_item, m.score AS right_score
    FROM lfound l FULL JOIN mfound m USING (query_id, rank)),
shared AS (SELECT query_id, count(*) AS overlap FROM lfound JOIN mfound USING (query_id, item_id) GROUP BY query_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, left_item, left_score, right_item, right_score,
    count(left_item) OVER (PARTITION BY query_id) AS left_count,
    count(right_item) OVER (PARTITION BY query_id) AS right_count, coalesce(overlap, 0) AS overlap
FROM pairs LEFT JOIN shared USING (query_id)"""

_LABEL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items())
ORACLE["result_cards"] = f"""WITH {SPARSE_ALL}, {parity('scores', None, 'r', 3)}
SELECT query_id, CAST(rank AS INTEGER) AS rank, CASE source {_LABEL} ELSE 'other' END AS label, title,
    substring(authors, 1, 80) AS authors, category, printf('%.4f', score) AS score, upper(source) AS source_tag,
    CASE WHEN length(text) > 280 THEN substring(text, 1, 280) || '...' ELSE text END AS preview
FROM rfound JOIN docs USING (item_id)"""

ORACLE["quality_model_parity"] = f"""WITH {DOCS}, {FIT}, t AS (SELECT count(DISTINCT item_id) AS t FROM postings)
SELECT n AS items, n AS vectors, t AS items_with_terms, n - t AS items_without_terms, true AS passed FROM n, t"""

ORACLE["semantic_topk_cells"] = ORACLE["semantic_topk"]
ORACLE["recommend_cells_source"] = ORACLE["recommend_semantic_source"]
ORACLE["tfidf_topk_index"] = ORACLE["tfidf_topk"]
ORACLE["recommend_index_source"] = ORACLE["recommend_source_filter"]
ORACLE["tfidf_topk_appended"] = ORACLE["tfidf_topk"]
ORACLE["recommend_bucketed"] = ORACLE["recommend_source_filter"]
ORACLE["latent_components"] = f"""WITH {DOCS}, {FIT}, t AS (SELECT count(DISTINCT item_id) AS items FROM postings)
SELECT CAST(c AS INTEGER) AS component, items, true AS strength_agrees, true AS falling, true AS orthonormal FROM range({LATENT}) r(c), t"""
ORACLE["latent_self_search"] = f"""WITH {DOCS}, {FIT} SELECT DISTINCT item_id AS query_id, 1.0::DOUBLE AS score, true AS unit FROM postings"""
