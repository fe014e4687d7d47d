"""Pieces the oracle statements share (DuckDB dialect)."""

from __future__ import annotations

EDGE = "\"''“”‘’()[]{}<>:;,.|/\\-–—…!?*=+#&~`"


def linear(text: str) -> str:
    for pattern, new, flags in (
        ("<page_number>.*?</page_number>", " ", "gis"),
        (r"<br\s*/?>", " ", "gi"),
        ("</t[dh]>", " | ", "gi"),
        ("</tr>", "\\n", "gi"),
        ("<[^>]+>", " ", "g"),
        (r"[ \t\r\f\v]*(\|[ \t\r\f\v]*)+", " | ", "g"),
        (r"(?m)^ \| | \| $", "", "g"),
    ):
        new = "chr(10)" if new == "\\n" else f"'{new}'"
        text = f"regexp_replace({text}, '{pattern}', {new}, '{flags}')"
    return text


def ungroup(text: str) -> str:
    for _ in range(2):
        text = f"regexp_replace({text}, '([0-9]),([0-9][0-9][0-9])', '\\1\\2', 'g')"
    return text


def fold(text: str) -> str:
    return f"translate({text}, '๐๑๒๓๔๕๖๗๘๙', '0123456789')"


def tokens(text: str) -> str:
    clean = ungroup(fold(linear(text)))
    clean = f"regexp_replace(regexp_replace({clean}, '\\s*ๆ', '', 'g'), '[-–—/\\\\]', ' ', 'g')"
    pieces = f"list_transform(regexp_split_to_array({clean}, '\\s+'), lambda p: trim(p, '{EDGE}'))"
    kept = f"list_filter({pieces}, lambda p: regexp_matches(p, '[ก-ฮะ-์a-zA-Z0-9]'))"
    return f"list_transform({kept}, lambda p: lower(p))"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


def sentences(text: str) -> str:
    """Split after . ! ? or at line breaks; blank pieces dropped."""
    marked = f"regexp_replace({text}, '([.!?])\\s+', '\\1' || chr(1), 'g')"
    marked = f"regexp_replace({marked}, '\\n+', chr(1), 'g')"
    return f"list_filter(string_split({marked}, chr(1)), lambda s: trim(s) <> '')"


def match_key(text: str) -> str:
    return f"regexp_replace({fold(text)}, '\\s', '', 'g')"


def weight(tf: str, length: str) -> str:
    return f"({tf} * 2.2e0 / ({tf} + 1.2e0 * (0.25e0 + 0.75e0 * {length} / 256e0)))"


def sid(kind: str, *parts: str) -> str:
    return f"left(sha256(concat_ws('|', '{kind}', {', '.join(parts)})), 21)"


def hashed(out: str, terms_from: str, keys: str, terms: str = "terms", dims: int = 64) -> str:
    """CTE `out`(keys, v): term counts in hash buckets, as the built-in embedder makes them."""
    return f"""{out}_terms AS MATERIALIZED (SELECT {keys}, {terms} AS terms FROM {terms_from}),
{out}_buckets AS MATERIALIZED (
  SELECT {keys}, list_transform(terms, lambda t: ('0x' || left(md5(t), 8))::UBIGINT % {dims}) AS b FROM {out}_terms),
{out} AS MATERIALIZED (SELECT {keys}, list_transform(range({dims}), lambda d:
  len(list_filter(b, lambda x: x = d::UBIGINT))::DOUBLE) AS v FROM {out}_buckets)"""


def cosine(a: str, b: str) -> str:
    """0 when a vector is all zeros, where DuckDB has NaN."""
    sim = f"list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"
    return f"(CASE WHEN isnan({sim}) THEN 0 ELSE {sim} END)"


PARENTS = f"""parents AS (
  SELECT kb_id, doc_id, source, {sid('p', 'kb_id', 'doc_id', 'seq')} AS parent_id, seq,
         seq * 1024 AS start, substring(text, seq * 1024 + 1, 1024) AS content
  FROM (SELECT 'main' AS kb_id, doc_id, doc_id::VARCHAR AS source, text,
               unnest(range(0, ((length(text) + 1023) // 1024))) AS seq FROM documents))"""


def children_of(parents: str) -> str:
    return f"""
  SELECT kb_id, doc_id, source, parent_id, {sid('c', 'parent_id', 'seq')} AS child_id, seq, content
  FROM (SELECT kb_id, doc_id, source, parent_id, i - 1 AS seq, pieces[i] AS content
        FROM (SELECT *, unnest(range(1, len(pieces) + 1)) AS i
              FROM (SELECT kb_id, doc_id, source, parent_id, list_filter(list_transform(
                      range(0, greatest(0, ceil((length(content) - 512) / 472e0)::BIGINT) + 1),
                      lambda w: {strip('substring(content, w * 472 + 1, 512)')}),
                      lambda p: p <> '') AS pieces
                    FROM {parents})))"""


CHILDREN = f"children AS ({children_of('parents')})"

POSTINGS = f"""tokens AS (SELECT kb_id, doc_id, parent_id, child_id, {tokens('content')} AS terms FROM children),
postings AS (
  SELECT kb_id, doc_id, parent_id, child_id, term, tf, doc_len, {weight('tf', 'doc_len')} AS weight
  FROM (SELECT kb_id, doc_id, parent_id, child_id, doc_len, term, count(*) AS tf
        FROM (SELECT *, len(terms) AS doc_len, unnest(terms) AS term FROM tokens) GROUP BY ALL)),
sizes AS (SELECT kb_id, count(*) AS n_children FROM children GROUP BY kb_id),
idf AS (
  SELECT kb_id, term, df, n_children, ln(1 + (n_children - df + 0.5e0) / (df + 0.5e0)) AS idf
  FROM (SELECT kb_id, term, count(*) AS df FROM postings GROUP BY kb_id, term) JOIN sizes USING (kb_id))"""

QUERIES = "queries AS (SELECT item_id AS query_id, 'main' AS kb_id, text FROM benchmark)"


def sparse(queries: str, out: str = "sparse") -> str:
    """BM25 scores of every (query, child) that share a term."""
    return f"""{out}_terms AS (
  SELECT query_id, kb_id, term, {weight('tf', 'n')} AS w
  FROM (SELECT query_id, kb_id, term, n, count(*) AS tf
        FROM (SELECT *, len(terms) AS n, unnest(terms) AS term
              FROM (SELECT query_id, kb_id, {tokens('text')} AS terms FROM {queries})) GROUP BY ALL)),
{out} AS (
  SELECT q.query_id, p.kb_id, p.parent_id, p.child_id, round(sum(q.w * i.idf * p.weight), 9) AS score
  FROM {out}_terms q JOIN idf i USING (kb_id, term) JOIN postings p USING (kb_id, term)
  GROUP BY q.query_id, p.kb_id, p.parent_id, p.child_id)"""


def dense(queries: str, out: str = "near") -> str:
    """Cosine of hashed-term vectors for every (query, child)."""
    return f"""{hashed(out + '_q', queries, 'query_id, kb_id', tokens('text'))},
{hashed(out + '_c', 'tokens', 'kb_id, parent_id, child_id')},
{out} AS (
  SELECT q.query_id, c.kb_id, c.parent_id, c.child_id, round({cosine('q.v', 'c.v')}, 9) AS score
  FROM {out}_q q JOIN {out}_c c USING (kb_id))"""


def ranked(scored: str, limit: int) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY query_id ORDER BY score DESC, child_id) AS rank FROM {scored}) WHERE rank <= {limit}"""


def collapsed(scored: str, pool: int) -> str:
    """Best child per parent, then the best parents."""
    return f"""SELECT query_id, kb_id, parent_id, child_id, score, row_number() OVER (
      PARTITION BY query_id ORDER BY score DESC, child_id) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY score DESC, child_id) AS r
          FROM {scored}) WHERE r = 1 QUALIFY rank <= {pool}"""


def fused(legs: list[str], prefetch: int, k: int = 60) -> str:
    union = " UNION ALL ".join(f"({ranked(leg, prefetch)})" for leg in legs)
    return f"""SELECT query_id, kb_id, parent_id, child_id, round(sum(1e0 / ({k} + rank)), 9) AS score
  FROM ({union}) GROUP BY query_id, kb_id, parent_id, child_id"""


BASE = f"WITH {PARENTS}, {CHILDREN}, {POSTINGS}, {QUERIES}"
