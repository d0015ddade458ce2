"""SQL counterparts of the registered queries, written independently for DuckDB."""

from __future__ import annotations

from gleaner.catalogue.specs import JSON, TEXT, Case, json_cases, plain_cases
from gleaner.catalogue.tables import DATABASE, PROBE, PROBE_NO, PROBE_YES, SHORTLIST, TOP
from gleaner.operators.judging import DEFAULT_NO, DEFAULT_YES

DOCS = "docs AS (SELECT source || '/' || doc_id || '.txt' AS path, text, NULL AS source FROM documents)"

LABELLED = """labelled AS (
  SELECT d.source || '/' || d.doc_id || '.txt' AS path, d.text, d.lang, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l USING (doc_id))"""

TAKEDOWN = """takedown AS (
  SELECT path, CASE WHEN lang = 'fr' THEN text || chr(10) || 'fin' ELSE text END AS text
  FROM labelled WHERE coalesce(toxic, 0) = 0
  UNION ALL SELECT 'benchmark/' || item_id || '.txt', text FROM benchmark)"""


def tokens(column: str) -> str:
    return rf"regexp_extract_all(strip_accents(lower({column})), '[\p{{L}}\p{{N}}]+')"


def passages(of: str = "docs", name: str = "passages", source: str = "source") -> str:
    count = "greatest(1, ceil((length(text) - 400) / 3600.0))::BIGINT"
    return f"""{name} AS (
  SELECT path, ordinal::INT AS ordinal, substring(whole, ordinal * 3600 + 1, 4000) AS text,
         sha256(substring(whole, ordinal * 3600 + 1, 4000)) AS digest, source
  FROM (SELECT path, text AS whole, {source} AS source, unnest(range({count})) AS ordinal FROM {of}))"""


KEYED_FIELDS = [
    ("documents", "text", """'{"doc_id":' || doc_id || '}'"""),
    ("conversations", "text", """'{"conv_id":' || conv_id || ',"turn":' || turn || '}'"""),
    ("part", "p_name", """'{"p_partkey":' || p_partkey || '}'"""),
    ("part", "p_type", """'{"p_partkey":' || p_partkey || '}'"""),
    ("customer", "c_mktsegment", """'{"c_custkey":' || c_custkey || '}'"""),
    ("nation", "n_name", """'{"n_nationkey":' || n_nationkey || '}'"""),
    ("region", "r_name", """'{"r_regionkey":' || r_regionkey || '}'"""),
]


def field_values(only: str | None = None) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{table}' AS \"table\", '{field}' AS field, {key} AS key, {field} AS value FROM {table}"
        for table, field, key in KEYED_FIELDS
        if only in (None, field)
    )
    return f"cells AS ({rows})"


RECORDS = f"""records AS (
  SELECT 'table://' || url_encode("table") || '/' || url_encode(field) || '?key=' || url_encode(key) AS path,
         value AS text,
         '{{"database":"{DATABASE}","field":"' || field || '","key":' || key
         || ',"table":"' || "table" || '","type":"table"}}' AS source
  FROM cells)"""

LEXICON = f"""tok AS (
  SELECT path, ordinal, unnest({tokens('path')}) AS term, 1 AS p, 0 AS t FROM passages
  UNION ALL SELECT path, ordinal, unnest({tokens('text')}), 0, 1 FROM passages),
tf AS (
  SELECT path, ordinal, term, sum(p)::INT AS tf_path, sum(t)::INT AS tf_text
  FROM tok GROUP BY path, ordinal, term),
sizes AS (
  SELECT path, ordinal, (len({tokens('path')}) + len({tokens('text')}))::INT AS dl FROM passages),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM sizes)"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def ask(criteria: bool = False, number: int = 0) -> str:
    yes, no = (quoted(PROBE_YES), quoted(PROBE_NO)) if criteria else ("NULL", "NULL")
    return (
        f"SELECT {number}::BIGINT AS query_id, {quoted(PROBE)} AS query, "
        f"{yes}::VARCHAR AS yes, {no}::VARCHAR AS no"
    )


BENCHMARK = "SELECT item_id AS query_id, text AS query, NULL::VARCHAR AS yes, NULL::VARCHAR AS no FROM benchmark"


def terms(of: str = "q") -> str:
    return f"""qtok AS (
  SELECT query_id, unnest({tokens('query')}) AS term,
         unnest(range(len({tokens('query')}))) AS pos FROM {of}),
qt AS (
  SELECT query_id, term, pos FROM (
    SELECT query_id, term, pos, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS nth
    FROM (SELECT query_id, term, min(pos) AS pos FROM qtok GROUP BY query_id, term))
  WHERE nth <= 64)"""


MATCHES = """df AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM qt) GROUP BY term),
matches AS (
  SELECT query_id, term, path, ordinal, tf_path, tf_text, dl,
         greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) AS idf, avgdl
  FROM qt JOIN df USING (term) JOIN tf USING (term) JOIN sizes USING (path, ordinal) CROSS JOIN stats)"""

BM25 = """bm25 AS (
  SELECT query_id, path, ordinal, round(sum(
    idf * (5 * tf_path + tf_text) * 2.2::DOUBLE
    / ((5 * tf_path + tf_text) + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS bm25
  FROM matches GROUP BY query_id, path, ordinal),
best AS (
  SELECT * FROM bm25
  QUALIFY row_number() OVER (PARTITION BY query_id, path ORDER BY bm25 DESC, ordinal) = 1)"""


def shortlist(limit: int = SHORTLIST) -> str:
    return f"""lex AS (
  SELECT * FROM best
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, path) <= {limit}),
taken AS (SELECT query_id, count(path) AS n FROM q LEFT JOIN lex USING (query_id) GROUP BY query_id),
fill AS (
  SELECT query_id, path, 0 AS ordinal FROM (
    SELECT query_id, path, n, row_number() OVER (PARTITION BY query_id ORDER BY path) AS place
    FROM taken CROSS JOIN (SELECT DISTINCT path FROM passages) d
    WHERE NOT EXISTS (SELECT 1 FROM lex WHERE lex.query_id = taken.query_id AND lex.path = d.path))
  WHERE place <= {limit} - n),
short AS (
  SELECT query_id, path, ordinal, bm25, 0 AS tier FROM lex
  UNION ALL SELECT query_id, path, ordinal, NULL, 1 FROM fill)"""


# A corpus within the limit offers every passage, a larger one its shortlist.
CANDIDATES = f"""corpus_size AS (SELECT count(DISTINCT path) AS documents FROM passages),
candidates AS (
  SELECT query_id, path, ordinal, text, digest, source FROM short JOIN passages USING (path, ordinal)
  WHERE (SELECT documents FROM corpus_size) > {SHORTLIST}
  UNION ALL
  SELECT query_id, path, ordinal, text, digest, source FROM q CROSS JOIN passages
  WHERE (SELECT documents FROM corpus_size) <= {SHORTLIST})"""
EVERYTHING = "candidates AS (SELECT query_id, p.* FROM q CROSS JOIN passages p)"

STATE = """CASE WHEN source IS NULL
  THEN regexp_extract(path, '[^/]*$') || chr(10) || chr(10) || text ELSE text END"""


SCORES = f"""judged AS (SELECT query_id, path, ordinal, source, {STATE} AS state FROM candidates),
wanted AS (
  SELECT query_id, 'query' AS kind, unnest(list_distinct({tokens('query')})) AS term FROM q
  UNION ALL SELECT query_id, 'yes', unnest(list_distinct({tokens('yes')})) FROM q WHERE yes IS NOT NULL
  UNION ALL SELECT query_id, 'no', unnest(list_distinct({tokens('no')})) FROM q WHERE no IS NOT NULL),
kinds AS (SELECT query_id, kind, count(*) AS size FROM wanted GROUP BY query_id, kind),
texts AS (SELECT DISTINCT path, ordinal, state FROM judged),
words AS (
  SELECT path, ordinal, term, count(*) AS tf
  FROM (SELECT path, ordinal, unnest({tokens('state')}) AS term FROM texts) GROUP BY path, ordinal, term),
lengths AS (SELECT path, ordinal, len({tokens('state')}) AS n FROM texts),
sat AS (
  SELECT query_id, path, ordinal, kind,
         sum(tf / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / 600))) / any_value(size) AS sat
  FROM judged JOIN words USING (path, ordinal) JOIN wanted USING (query_id, term)
  JOIN kinds USING (query_id, kind) JOIN lengths USING (path, ordinal)
  GROUP BY query_id, path, ordinal, kind),
scored AS (
  SELECT j.query_id, j.path, j.ordinal, j.source, round(CASE WHEN q.yes IS NULL
    THEN coalesce(any_value(s.sat) FILTER (s.kind = 'query'), 0)
    ELSE (1 + coalesce(any_value(s.sat) FILTER (s.kind = 'yes'), 0)
            - coalesce(any_value(s.sat) FILTER (s.kind = 'no'), 0)) / 2 END, 6) AS score
  FROM judged j JOIN q USING (query_id) LEFT JOIN sat s USING (query_id, path, ordinal)
  GROUP BY j.query_id, j.path, j.ordinal, j.source, q.yes),
pooled AS (
  SELECT query_id, path, score, ordinal AS passage, source FROM scored
  QUALIFY row_number() OVER (PARTITION BY query_id, path ORDER BY score DESC, ordinal) = 1)"""


def top(limit: int = TOP) -> str:
    return f"""results AS (
  SELECT query_id, rank::INT AS rank, path, score, passage, source FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM pooled)
  WHERE rank <= {limit})"""


def select(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def question(sql: str) -> str:
    return f"q AS ({sql})"


CORPUS = [DOCS, passages()]
LEXICAL = [*CORPUS, LEXICON, question(ask()), terms(), MATCHES, BM25]
SEARCH = [*LEXICAL, shortlist(), CANDIDATES, SCORES, top()]


def exhaustive(sql: str) -> list[str]:
    return [*CORPUS, question(sql), EVERYTHING, SCORES]


def with_criteria(base: list[str]) -> list[str]:
    plain = question(ask())
    return [question(ask(criteria=True)) if part == plain else part for part in base]


JUDGED_KEY = f"""keyed AS (
  SELECT path, ordinal, sha256(to_json([
    sha256(to_json([{quoted(PROBE)}, 'token-overlap', '1', {quoted(PROBE_YES)}, {quoted(PROBE_NO)}])),
    path, ordinal::VARCHAR, digest, NULL])) AS key
  FROM passages)"""

def specs(cases: list[Case]) -> str:
    def piece(value: str) -> str:
        return {TEXT: "text", JSON: "j"}.get(value, quoted(value))

    def part(value: str | None) -> str:
        return "NULL" if value is None else piece(value)

    return " UNION ALL ".join(
        f"SELECT item_id * 1000 + {form} AS query_id, {' || '.join(map(piece, case.spec))} AS spec, "
        f"{part(case.query)}::VARCHAR AS query, {part(case.yes)}::VARCHAR AS yes, "
        f"{part(case.no)}::VARCHAR AS no, {part(case.error)}::VARCHAR AS error "
        "FROM (SELECT item_id, text, to_json(text)::VARCHAR AS j FROM benchmark)"
        for form, case in enumerate(cases)
    )


DIFF = """diff AS (
  SELECT path, CASE WHEN b.text IS NULL THEN 'new' WHEN a.text IS NULL THEN 'removed'
                    WHEN a.text = b.text THEN 'unchanged' ELSE 'changed' END AS class
  FROM docs b FULL JOIN takedown a USING (path))"""

GOOD = """good AS (
  SELECT path, text, NULL AS source FROM labelled WHERE quality IS DISTINCT FROM 0),
good_later AS (
  SELECT t.path, t.text, NULL AS source FROM takedown t LEFT JOIN labelled l USING (path)
  WHERE l.quality IS DISTINCT FROM 0)"""
CYCLE = """a AS (SELECT count(DISTINCT path) AS documents, count(*) AS passages FROM before_p),
z AS (SELECT count(DISTINCT path) AS documents, count(*) AS passages FROM later_p),
lost AS (SELECT (SELECT count(*) FROM labelled WHERE quality = 0) AS first,
  (SELECT count(*) FROM takedown JOIN labelled USING (path) WHERE quality = 0) AS later),
moves AS (
  SELECT count(*) FILTER (g.path IS NULL OR g.text <> h.text) AS updated,
         (SELECT count(*) FROM good WHERE path NOT IN (SELECT path FROM good_later)) AS removed
  FROM good_later h LEFT JOIN good g USING (path))
SELECT 1 AS step, documents, passages, documents AS updated, first AS skipped, 0::BIGINT AS removed FROM a, lost
UNION ALL SELECT 2, documents, passages, 0, first, 0 FROM a, lost
UNION ALL SELECT 3, documents, passages, updated, later, removed FROM z, lost, moves
UNION ALL SELECT 4, documents, passages, documents, later, 0 FROM z, lost"""


def over(base: list[str], docs: str) -> list[str]:
    """The same search over other documents."""
    return [LABELLED, TAKEDOWN, GOOD, *(docs if part == DOCS else part for part in base)]


def oracle_sql() -> dict[str, str]:
    cells = [field_values(), RECORDS]
    changes = [DOCS, LABELLED, TAKEDOWN]
    probe_terms = [*CORPUS, LEXICON, question(ask()), terms(), MATCHES]
    ranked = "SELECT rank, path, score, passage FROM results"
    fields = [
        field_values(), RECORDS, passages("records"), LEXICON, question(ask()), terms(), MATCHES,
        BM25, shortlist(), CANDIDATES, SCORES, top(),
    ]
    batch = [
        *CORPUS, LEXICON, question(BENCHMARK), terms(), MATCHES, BM25, shortlist(), CANDIDATES,
        SCORES, top(),
    ]
    reach = [
        *CORPUS, LEXICON, question(BENCHMARK + " UNION ALL " + ask(number=-1)), terms(), MATCHES,
        BM25, shortlist(),
    ]
    both = ask() + " UNION ALL " + ask(criteria=True, number=1)
    return {
        "quarantine": select([LABELLED], """SELECT path,
            CASE WHEN toxic = 1 THEN 'not valid UTF-8'
                 WHEN quality = 0 THEN 'holds a NUL byte' END AS reason,
            CASE WHEN coalesce(toxic, 0) = 1 OR quality = 0 THEN NULL ELSE sha256(text) END AS digest
            FROM labelled"""),
        "field_union": select(cells[:1], 'SELECT "table", field, key, value FROM cells'),
        "record_keys": """SELECT '{"conv_id":' || conv_id || ',"turn":' || turn || '}' AS key,
            sha256(text) AS digest FROM conversations""",
        "key_fallback": """SELECT '{"label":' || l.doc_id || '}' AS key, sha256(text) AS digest
            FROM documents d JOIN labels l USING (doc_id)
            UNION ALL
            SELECT '{"copy":' || row_number() OVER (PARTITION BY text) || ',"row_sha256":"'
                   || sha256(to_json({'text': text})) || '"}', sha256(text)
            FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
        "synthetic_keys": """SELECT '{"copy":' || row_number() OVER (PARTITION BY lang, text)
                   || ',"row_sha256":"' || sha256(to_json({'lang': lang, 'text': text})) || '"}' AS key,
            lang, sha256(text) AS digest FROM documents""",
        "binary_key_hex": """SELECT '{"id":{"blob_hex":"' || lower(hex(encode(c_name))) || '"}}' AS key,
            c_mktsegment FROM customer""",
        "locators": """SELECT 'table://web%20pages/html?key=' || url_encode(key) AS path,
            '{"field":"html","key":' || key || ',"table":"web pages","type":"table"}' AS source,
            sha256(html) AS digest
            FROM (SELECT html, to_json({'page_id': page_id, 'url': url})::VARCHAR AS key FROM pages)""",
        "report_tsv": select(SEARCH, """SELECT query_id, rank, rank || chr(9) || printf('%.6f', score)
            || chr(9) || path || chr(9) || to_json(d.text)::VARCHAR AS line
            FROM results JOIN docs d USING (path)"""),
        "chunk_passages": select(CORPUS, "SELECT path, ordinal, text FROM passages"),
        "passage_digests": select(CORPUS, "SELECT path, ordinal, digest FROM passages"),
        "value_digests": select(
            cells[:1], 'SELECT "table", field, key, sha256(value) AS digest FROM cells'
        ),
        "skip_reasons": select([LABELLED], """SELECT CASE WHEN quality = 0 THEN 'null value'
            WHEN toxic = 1 THEN 'text holds a NUL character' ELSE 'indexed' END AS reason, count(*) AS n
            FROM labelled GROUP BY reason"""),
        "token_counts": select([*CORPUS, LEXICON], """SELECT term, path, ordinal, tf_path, tf_text, dl
            FROM tf JOIN sizes USING (path, ordinal)"""),
        "query_terms": select([question(BENCHMARK), terms()], """SELECT query_id,
            string_agg(term, ' ' ORDER BY pos) AS terms, count(*)::INT AS n_terms
            FROM qt GROUP BY query_id"""),
        "state_text": select(
            [field_values("p_name"), RECORDS, DOCS,
             "mixed AS (SELECT * FROM docs UNION ALL SELECT * FROM records)", passages("mixed")],
            f"SELECT path, ordinal, {STATE} AS state FROM passages",
        ),
        "oversized_states": select([DOCS], f"""SELECT path, state_bytes FROM (
            SELECT path, (strlen(to_json({{'query': {quoted(PROBE)}, 'text': {STATE}}})::VARCHAR) + 3)::INT
            AS state_bytes FROM docs) WHERE state_bytes > 28000"""),
        "query_specs": specs(plain_cases()),
        "query_specs_json": specs(json_cases()),
        "effective_criteria": f"""SELECT query_id, query,
            coalesce(yes, {quoted(DEFAULT_YES)}) AS yes, coalesce(no, {quoted(DEFAULT_NO)}) AS no
            FROM ({specs(plain_cases())}) WHERE error IS NULL""",
        "score_keys": select([*CORPUS, JUDGED_KEY], "SELECT path, ordinal, key FROM keyed"),
        "snapshot_diff": select([*changes, DIFF], "SELECT path, class FROM diff"),
        "removed_docs": select(
            changes, "SELECT path FROM docs WHERE path NOT IN (SELECT path FROM takedown)"
        ),
        "cascade_keep": select([*changes, passages()], """SELECT path, ordinal, digest FROM passages
            WHERE path IN (SELECT path FROM takedown)"""),
        "refresh_stats": select([*changes, DIFF], """SELECT
            count(*) FILTER (class IN ('new', 'changed')) AS updated,
            count(*) FILTER (class = 'removed') AS removed,
            count(*) FILTER (class <> 'removed') AS documents FROM diff"""),
        "refresh_cycle": "WITH " + ",\n".join([
            LABELLED, TAKEDOWN, GOOD, passages("good", "before_p"), passages("good_later", "later_p"), CYCLE,
        ]),
        "scan_agrees": select(over(SEARCH, "docs AS (SELECT * FROM good)"),
            """SELECT way, rank, path, score, passage
            FROM results CROSS JOIN (SELECT unnest(['stored', 'scanned']) AS way)"""),
        "compacted_cycle": select(over(SEARCH, "docs AS (SELECT * FROM good_later)"), ranked),
        "terms_left_out": select([question(BENCHMARK)], f"""SELECT query_id,
            greatest(0, len(list_distinct({tokens('query')})) - 8)::INT AS left_out FROM q"""),
        "report_json": select(with_criteria(SEARCH), f"""SELECT query_id, '{{"query":' || to_json(query)
            || ',"criteria":{{"yes":' || to_json(yes) || ',"no":' || to_json(no)
            || '}},"corpus":"documents","scorer":"token-overlap","exhaustive":'
            || (SELECT (documents <= {SHORTLIST})::VARCHAR FROM corpus_size) || ',"results":['
            || (SELECT string_agg('{{"rank":' || rank || ',"path":' || to_json(path) || ',"score":' || score
                || ',"passage":' || passage || '}}', ',' ORDER BY rank) FROM results)
            || '],"stats":{{"documents":' || (SELECT documents FROM corpus_size)
            || ',"scored":' || (SELECT count(*) FROM candidates) || '}}}}' AS report FROM q"""),
        "term_df": select(
            [*CORPUS, LEXICON, question(BENCHMARK), terms()], """SELECT term, count(*) AS df FROM tf
            WHERE term IN (SELECT term FROM qt) GROUP BY term"""
        ),
        "corpus_stats": select([*CORPUS, LEXICON], "SELECT n, round(avgdl, 6) AS avgdl FROM stats"),
        "term_matches": select(probe_terms, """SELECT query_id, term, path, ordinal, tf_path, tf_text,
            dl, round(idf, 6) AS idf FROM matches"""),
        "bm25_scores": select(LEXICAL, "SELECT query_id, path, ordinal, bm25 FROM bm25"),
        "best_passage": select(LEXICAL, "SELECT query_id, path, ordinal, bm25 FROM best"),
        "bm25_shortlist": select(
            [*LEXICAL, shortlist(100)], "SELECT query_id, path, ordinal, bm25 FROM lex"
        ),
        "shortlist": select(
            [*LEXICAL, shortlist()], "SELECT query_id, path, ordinal, bm25, tier FROM short"
        ),
        "shortlist_fill": select(
            [*LEXICAL, shortlist()], "SELECT query_id, path, ordinal FROM fill"
        ),
        "lexical_reach": select(reach, """SELECT query_id, count(*) FILTER (tier = 0) AS lexical,
            count(*) AS shortlisted FROM short GROUP BY query_id"""),
        "candidates": select(
            [*LEXICAL, shortlist(), CANDIDATES], "SELECT query_id, path, ordinal, digest FROM candidates"
        ),
        "exhaustive_candidates": select(
            CORPUS, "SELECT 0::BIGINT AS query_id, path, ordinal, digest FROM passages"
        ),
        "index_counts": select(CORPUS, """SELECT count(DISTINCT path) AS documents,
            count(*) AS passages FROM passages"""),
        "first_passages": select(CORPUS, "SELECT path, digest FROM passages WHERE ordinal = 0"),
        "passages_with_source": select(
            [*cells, DOCS, "mixed AS (SELECT * FROM docs UNION ALL SELECT * FROM records)",
             passages("mixed")],
            "SELECT path, ordinal, digest, source FROM passages",
        ),
        "cache_lookup": select([*CORPUS, LABELLED], """SELECT path, ordinal,
            (quality + toxic) / 2 AS score, quality IS NULL AS missing
            FROM passages JOIN labelled USING (path)"""),
        "cache_merge": select([*CORPUS, LABELLED, JUDGED_KEY], """SELECT key,
            CASE WHEN quality IS NULL OR toxic = 1 THEN 1.0::DOUBLE ELSE quality / 2 END AS score
            FROM keyed JOIN labelled USING (path)"""),
        "ranking_stats": select([*LEXICAL, shortlist(), CANDIDATES], """SELECT run::INT AS run,
            count(*) AS scored, CASE run WHEN 1 THEN 0 ELSE count(*) END AS cache_hits,
            CASE run WHEN 1 THEN count(*) ELSE 0 END AS scorer_calls,
            0::BIGINT AS input_tokens, 0::BIGINT AS output_tokens
            FROM candidates CROSS JOIN (SELECT unnest([1, 2]) AS run) GROUP BY run"""),
        "scorer_usage": select(CORPUS, f"""SELECT run::INT AS run, count(*) AS judged,
            CASE run WHEN 1 THEN 0 ELSE count(*) END AS known, CASE run WHEN 1 THEN count(*) ELSE 0 END AS asked,
            CASE run WHEN 1 THEN sum(length({STATE})) ELSE 0 END::BIGINT AS input_tokens,
            CASE run WHEN 1 THEN count(*) ELSE 0 END AS output_tokens
            FROM passages CROSS JOIN (SELECT unnest([1, 2]) AS run) GROUP BY run"""),
        "max_passage_score": select(
            exhaustive(ask(criteria=True)), "SELECT path, score, passage FROM pooled"
        ),
        "top_k": select(
            [*exhaustive(ask()), top(25)], "SELECT path, score, passage FROM results"
        ),
        "ranked_results": select(
            [*exhaustive(ask(criteria=True)), top(50)], "SELECT rank, path, score FROM results"
        ),
        "label_separation": select(
            [*exhaustive(both), LABELLED], """SELECT query_id,
            round(avg(score) FILTER (quality = 1) - avg(score) FILTER (quality = 0), 6) AS separation,
            count(*) FILTER (quality = 1) AS wanted, count(*) FILTER (quality = 0) AS unwanted
            FROM pooled JOIN labelled USING (path) WHERE quality IS NOT NULL GROUP BY query_id"""
        ),
        "rerank": select(with_criteria(SEARCH), ranked),
        "search_documents": select(SEARCH, ranked),
        "search_index": select(SEARCH, ranked),
        "search_fields": select(fields, "SELECT rank, path, score, passage, source FROM results"),
        "batch_search": select(batch, "SELECT query_id, rank, path, score, passage FROM results"),
        "document_text": select([DOCS], "SELECT path, text FROM docs"),
        "results_with_text": select(SEARCH, """SELECT query_id, rank, path, score, d.text
            FROM results JOIN docs d USING (path)"""),
    }
