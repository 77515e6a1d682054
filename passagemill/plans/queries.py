"""Registered queries of the corpus operators and their SQL counterparts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context, evidence, groups, lexical, people, registry, search, vectors
from ..sources import pages as html_pages
from ..sources import references
from ..sources.passages import CHRONOLOGICAL_SQL, PASSAGES_SQL, from_documents
from .scope import Scope

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PHRASE, OTHER = "thetion", "ering"
SEED, WORK = 7, "src3"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_documents(table(spark, sf_dir, "documents"))


def query(sql: str | None = None, with_passages: bool = True):
    """Register a query by its function's name; sql follows the passage view ``p`` unless told otherwise."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (f"WITH RECURSIVE {PASSAGES_SQL}{sql}" if with_passages else sql).replace("CHRONO", CHRONOLOGICAL_SQL).replace("PHRASE", PHRASE).replace("OTHER", OTHER)
        return f

    return keep


NORM = "zh_text_normalized"

# ------------------------------------------------------------------ search


@query(f" SELECT passage_id, source_work_id, period_rank, from_lb FROM p WHERE contains({NORM}, 'PHRASE') ORDER BY CHRONO LIMIT 20")
def search_exact(spark, sf):
    """Exact phrase, chronological (R2, O1)."""
    return search.search(passages(spark, sf), PHRASE).select("passage_id", "source_work_id", "period_rank", "from_lb")


@query(f" SELECT passage_id, canon, period FROM p WHERE contains({NORM}, 'ing') AND canon IN ('en', 'de') AND period IN ('P1', 'P4') AND origin = 'O0' AND list_has_any(traditions, ['T0', 'T4']) AND contains(lower(author), 'author') AND starts_with(heading_path, 'src')")
def search_scoped(spark, sf):
    """Every metadata filter at once."""
    scope = Scope(canon="en, de", period=["P1", "P4"], origin="O0", tradition="T0,T4", author="AUTHOR", heading_path_prefix="src")
    return search.hits(passages(spark, sf), "ing", scope).select("passage_id", "canon", "period")


@query(f" SELECT passage_id FROM p WHERE contains({NORM}, 'PHRASE') OR contains({NORM}, 'leanen') OR contains({NORM}, 'entheit')")
def search_variants(spark, sf):
    """Union of several spellings, each passage once."""
    return search.hits(passages(spark, sf), [PHRASE, "leanen", "entheit"]).select("passage_id")


@query(" SELECT passage_id, source_work_id, main_title, heading, substr(zh_text_raw, 1, 120) AS zh_quote FROM p WHERE doc_id BETWEEN 100 AND 140", True)
def brief_projection(spark, sf):
    """Six-field view with a cut quote over a document range."""
    return search.brief(passages(spark, sf).where(Scope(doc_range=(100, 140)).column()))


@query(" SELECT passage_id, author || ', ' || main_title || CASE WHEN canon <> '' THEN ', [' || canon || ']' ELSE '' END || CASE WHEN from_lb IS NOT NULL THEN ' (' || from_lb || '-' || to_lb || ')' ELSE '' END AS citation FROM p")
def citations(spark, sf):
    """Citation line of every passage."""
    return passages(spark, sf).select("passage_id", T.citation().alias("citation"))


@query(f" SELECT passage_id, heading FROM p WHERE contains(lower(heading), 'the') OR contains(lower(heading_path), 'the') OR contains({NORM}, 'the') ORDER BY CHRONO LIMIT 20")
def heading_search(spark, sf):
    """Heading, heading path or text."""
    return search.heading_search(passages(spark, sf), "the").select("passage_id", "heading")


@query(f" SELECT passage_id, source_work_id, main_title, heading, canon, period_rank, true AS is_canon_side FROM p WHERE canon IN ('en') AND contains({NORM}, 'PHRASE') ORDER BY CHRONO LIMIT 20")
def canonical_source(spark, sf):
    """Earliest hits in one canon."""
    return search.canonical_source(passages(spark, sf), PHRASE, "en")


@query(f" SELECT row_number() OVER (ORDER BY period_rank, doc_id)::INTEGER AS rank, passage_id, doc_id, period_rank, source_work_id FROM p WHERE contains({NORM}, 'PHRASE') ORDER BY 1 LIMIT 20")
def first_attestation(spark, sf):
    """Earliest by (rank, id) with its successors."""
    return search.first_attestations(passages(spark, sf), PHRASE)


@query(f", h AS (SELECT doc_id, passage_id FROM p WHERE contains({NORM}, 'PHRASE') AND canon = 'en') SELECT count(*) > 0 AS found, count(*) AS hit_count, (SELECT list(passage_id ORDER BY doc_id) FROM (SELECT * FROM h ORDER BY doc_id LIMIT 5)) AS sample_hits FROM h")
def absence_check(spark, sf):
    """Presence, count and samples in a scope (A10)."""
    return search.absence(passages(spark, sf), PHRASE, Scope(canon="en"))


@query(
    f""", q(position, phrase) AS (VALUES (0, 'PHRASE'), (1, 'OTHER'), (2, 'zzzz')),
h AS (SELECT position, doc_id, passage_id, row_number() OVER (PARTITION BY position ORDER BY doc_id) AS k FROM p JOIN q ON contains({NORM}, phrase)),
c AS (SELECT position, count(*) AS n, list(passage_id ORDER BY doc_id) FILTER (WHERE k <= 5) AS ids FROM h GROUP BY position)
SELECT q.position::INTEGER AS position, phrase, least(coalesce(n, 0), 20)::BIGINT AS hit_count, coalesce(n, 0) >= 20 AS possibly_truncated, coalesce(ids, []) AS sample_passage_ids FROM q LEFT JOIN c ON q.position = c.position"""
)
def batch_evidence(spark, sf):
    """Several phrases in one scan."""
    return search.batch_search(passages(spark, sf), [PHRASE, OTHER, "zzzz"])


@query(
    f""", h AS (SELECT passage_id, CASE WHEN contains({NORM}, 'theontion') THEN 'theontion' WHEN contains({NORM}, 'theontio') THEN 'theontio' WHEN contains({NORM}, 'heontion') THEN 'heontion'
  WHEN contains({NORM}, 'theont') THEN 'theont' WHEN contains({NORM}, 'heonti') THEN 'heonti' WHEN contains({NORM}, 'eontio') THEN 'eontio' WHEN contains({NORM}, 'ontion') THEN 'ontion' WHEN contains({NORM}, 'theo') THEN 'theo' END AS anchor FROM p)
SELECT passage_id, anchor, CASE WHEN anchor = 'theontion' THEN 'exact' ELSE 'partial_anchor' END AS match_class FROM h WHERE anchor IS NOT NULL ORDER BY passage_id LIMIT 20"""
)
def similar_phrase(spark, sf):
    """Anchors of a phrase, first that fits."""
    return search.similar_phrase(passages(spark, sf), "theontion")


_QUOTE = "theerandthingofthe"


@query(
    f""", e AS (SELECT passage_id FROM p WHERE contains({NORM}, '{_QUOTE}') ORDER BY doc_id LIMIT 20),
n AS (SELECT passage_id, doc_id, round((SELECT count(*) FROM (SELECT DISTINCT unnest(string_split('{_QUOTE}', '')) AS c) WHERE contains({NORM}, c)) / {float(len(set(_QUOTE)))}, 6) AS overlap_score FROM p
  WHERE ({' OR '.join(f"contains({NORM}, '{x}')" for x in dict.fromkeys(_QUOTE[i : i + 4] for i in range(0, len(_QUOTE) - 3, max(1, (len(_QUOTE) - 4) // 5))))}) AND NOT contains({NORM}, '{_QUOTE}'))
SELECT passage_id, 'exact' AS match, 1.0::DOUBLE AS overlap_score FROM e UNION ALL
SELECT * FROM (SELECT passage_id, 'near' AS match, overlap_score::DOUBLE FROM n WHERE overlap_score >= 0.5 AND NOT EXISTS (SELECT 1 FROM e) ORDER BY overlap_score DESC, doc_id LIMIT 10)"""
)
def citation_verify(spark, sf):
    """Exact quote, else near matches by character overlap."""
    return search.citation_verify(passages(spark, sf), _QUOTE)


@query(" SELECT passage_id, source_work_id, period_rank FROM p WHERE period = 'P2' AND list_has_any(traditions, ['T1']) AND doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY CHRONO LIMIT 20")
def seed_pick(spark, sf):
    """Seeds in scope that are not worked yet."""
    worked = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("passage_id"))
    return search.seed_pick(passages(spark, sf), worked, Scope(period="P2", tradition="T1"))


@query(" SELECT passage_id, canon FROM p WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def multi_lookup(spark, sf):
    """Passages of a table of ids."""
    ids = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("passage_id"))
    return search.lookup(passages(spark, sf), ids).select("passage_id", "canon")


# ------------------------------------------------------------------ groups


@query(
    """, f AS (SELECT 'canon' AS facet, canon AS value FROM p UNION ALL SELECT 'period', period FROM p UNION ALL SELECT 'origin', origin FROM p UNION ALL SELECT 'tradition', unnest(traditions) FROM p)
SELECT facet, value, count(*) AS n FROM f WHERE value <> '' GROUP BY 1, 2"""
)
def taxonomy(spark, sf):
    """Facet counts in one scan."""
    return groups.facet_summary(passages(spark, sf))


@query(f" SELECT period_rank, period, count(*) AS n, min_by(passage_id, doc_id) AS first_passage FROM p WHERE contains({NORM}, 'ing') GROUP BY 1, 2")
def timeline(spark, sf):
    """Hits and earliest passage per period."""
    return groups.timeline(search.hits(passages(spark, sf), "ing"))


@query(f" SELECT period_rank, period, count(*) AS n, count(DISTINCT source_work_id) AS works, list_sort(list(DISTINCT canon)) AS canons, min_by(passage_id, doc_id) AS first_passage FROM p WHERE contains({NORM}, 'PHRASE') GROUP BY 1, 2")
def phrase_history(spark, sf):
    """Spread of a phrase over periods."""
    return groups.phrase_history(passages(spark, sf), PHRASE)


@query(
    f""", h AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY period_rank, doc_id) AS k FROM p WHERE contains({NORM}, 'PHRASE'))
SELECT period AS key, count(*) AS hit_count, count(DISTINCT source_work_id) AS work_count, list_sort(list(DISTINCT source_work_id))[1:5] AS top_works, list(passage_id ORDER BY k) FILTER (WHERE k <= 5) AS representatives FROM h GROUP BY 1"""
)
def trace_term_usage(spark, sf):
    """Usage per period with representatives."""
    return groups.trace_usage(passages(spark, sf), PHRASE)


@query(f" SELECT source_work_id, div_path, count(*) AS hit_count FROM p WHERE contains({NORM}, 'PHRASE') GROUP BY 1, 2")
def outline_search(spark, sf):
    """Hits per division."""
    return groups.outline_search(passages(spark, sf), PHRASE)


@query(
    f""", h AS (SELECT *, source_corpus || '|' || canon || '|' || source_work_id AS node_id FROM p WHERE contains({NORM}, 'PHRASE')),
c AS (SELECT node_id, count(*) AS hit_count FROM h GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20),
k AS (SELECT node_id, passage_id, row_number() OVER (PARTITION BY node_id ORDER BY period_rank, doc_id) AS k FROM h)
SELECT c.node_id, hit_count, list(passage_id ORDER BY k) AS representatives FROM c JOIN k ON k.node_id = c.node_id AND k.k <= 3 GROUP BY 1, 2"""
)
def cluster_hits(spark, sf):
    """Hits per work node of the outline."""
    p = passages(spark, sf)
    return groups.cluster_hits(p, context.ancestor_rows(p), PHRASE)


_OFFSETS = "list_filter(range(length({n}) - {k} + 1), lambda o: substr({n}, o + 1, {k}) = '{t}')"


@query(
    f""", h AS (SELECT passage_id, {_OFFSETS.format(n=NORM, k=7, t=PHRASE)} AS a, {_OFFSETS.format(n=NORM, k=5, t=OTHER)} AS b FROM p WHERE contains({NORM}, '{PHRASE}') AND contains({NORM}, '{OTHER}'))
SELECT passage_id, list_min(flatten(list_transform(a, lambda x: list_transform(b, lambda y: abs(x - y)))))::INTEGER AS distance_chars FROM h WHERE list_min(flatten(list_transform(a, lambda x: list_transform(b, lambda y: abs(x - y))))) <= 80"""
)
def pair_appearance(spark, sf):
    """Two terms within a window."""
    return groups.pair_rows(passages(spark, sf), PHRASE, OTHER, unit="window").select("passage_id", "distance_chars")


@query(
    f""", s AS (SELECT doc_id, passage_id, CASE WHEN contains({NORM}, 'PHRASE') AND NOT contains({NORM}, 'OTHER') THEN 'term1_only' WHEN contains({NORM}, 'OTHER') AND NOT contains({NORM}, 'PHRASE') THEN 'term2_only' END AS side FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY doc_id) AS k FROM s WHERE side IS NOT NULL)
SELECT side, count(*) AS n, list(passage_id ORDER BY k) FILTER (WHERE k <= 10) AS samples FROM k GROUP BY 1"""
)
def pair_negative(spark, sf):
    """Passages with one of two terms."""
    return groups.pair_negative(passages(spark, sf), PHRASE, OTHER)


def _profile(unit: str) -> str:
    return f""", u AS (SELECT period AS g, {unit} AS unit, bool_or(contains({NORM}, 'PHRASE')) AS a, bool_or(contains({NORM}, 'OTHER')) AS b FROM p GROUP BY 1, 2),
c AS (SELECT g AS group_label, count(*) FILTER (WHERE a) AS term1_count, count(*) FILTER (WHERE b) AS term2_count, count(*) FILTER (WHERE a AND b) AS pair_count FROM u WHERE a OR b GROUP BY 1)
SELECT *, round(CASE WHEN term1_count > 0 THEN pair_count / term1_count ELSE 0 END, 6)::DOUBLE AS pair_rate_term1, round(CASE WHEN term2_count > 0 THEN pair_count / term2_count ELSE 0 END, 6)::DOUBLE AS pair_rate_term2 FROM c ORDER BY pair_count DESC, group_label LIMIT 20"""


@query(_profile("passage_id"))
def pair_profile(spark, sf):
    """Rates of a pair per period."""
    return groups.pair_profile(passages(spark, sf), PHRASE, OTHER)


@query(_profile("source_work_id || '/' || div_path"))
def pair_profile_section(spark, sf):
    """Rates of a pair per period with sections as units."""
    return groups.pair_profile(passages(spark, sf), PHRASE, OTHER, unit="section")


@query("SELECT event_type AS tool, count(*) AS calls, count(*) FILTER (WHERE value >= 10) AS ok, count(*) FILTER (WHERE NOT value >= 10) AS failed, round(avg(value), 6) AS avg_ms, list_sort(list(value))[(ceil((count(*) - 1) * 0.95) + 1)::BIGINT] AS p95_ms FROM events GROUP BY 1", False)
def tool_log_summary(spark, sf):
    """Calls, failures, mean and exact nearest-rank-up percentile."""
    events = table(spark, sf, "events").select(F.col("event_type").alias("tool"), (F.col("value") >= 10).alias("ok"), F.col("value").alias("elapsed_ms"))
    return groups.log_summary(events)


# ------------------------------------------------------------------ context


@query(", w AS (SELECT *, row_number() OVER (PARTITION BY source_rel_path ORDER BY passage_ord_in_file, passage_id) AS k FROM p), c AS (SELECT source_rel_path AS f, k AS c FROM w WHERE doc_id = 7) SELECT passage_id, (k - c)::INTEGER AS relative_index, k = c AS is_center FROM w JOIN c ON f = source_rel_path WHERE k BETWEEN c - 3 AND c + 3")
def expand_context(spark, sf):
    """Neighbours in the same file."""
    return context.context_window(passages(spark, sf), str(SEED), 3, 3).select("passage_id", "relative_index", "is_center")


@query("SELECT conv_id, turn, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start FROM conversations", False)
def running_offsets(spark, sf):
    """Running character offsets of turns."""
    rows = context.running_offsets(table(spark, sf, "conversations"), "conv_id", ["turn"], "text")
    return rows.select("conv_id", "turn", F.col("char_start").cast("long").alias("char_start"))


@query(
    f""", w AS (SELECT passage_id, doc_id, zh_text_raw AS t, coalesce(sum(length(zh_text_raw) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM p WHERE source_work_id = '{WORK}'),
e AS (SELECT *, s + length(t) AS e, max(s + length(t)) OVER () AS total FROM w)
SELECT passage_id, greatest(s, 2000) AS start, least(e, 6000) AS "end", substr(t, (greatest(s, 2000) - s + 1)::INTEGER, (least(e, 6000) - greatest(s, 2000))::INTEGER) AS text, total::BIGINT AS total_chars, round(least(least(e, 6000), total) * 100 / total, 2)::DOUBLE AS percent FROM e WHERE e > 2000 AND s < 6000"""
)
def source_read(spark, sf):
    """A slice of a work's running text."""
    return context.source_slice(passages(spark, sf), WORK, 2000)


@query(", r AS (SELECT *, CASE WHEN div_path IS NOT DISTINCT FROM lag(div_path) OVER (PARTITION BY source_work_id ORDER BY doc_id) THEN 0 ELSE 1 END AS f FROM p), q AS (SELECT *, sum(f) OVER (PARTITION BY source_work_id ORDER BY doc_id)::BIGINT AS run FROM r) SELECT source_work_id, div_path, run, min(doc_id) AS first_doc_id, max(doc_id) AS last_doc_id, count(*) AS n FROM q GROUP BY 1, 2, 3")
def passage_ranges(spark, sf):
    """Contiguous rows of one division."""
    rows = context.runs(passages(spark, sf), "source_work_id", ["doc_id"], "div_path")
    return rows.groupBy("source_work_id", "div_path", "run").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last_doc_id"), F.count("*").alias("n"))


@query(" SELECT passage_id, row_number() OVER (ORDER BY passage_id) - 1 AS doc_id FROM p")
def document_table(spark, sf):
    """Dense ids in byte order."""
    return context.dense_ids(passages(spark, sf).select("passage_id"))


@query(", b AS (SELECT passage_id, row_number() OVER (ORDER BY passage_id) - 1 AS doc_id FROM p WHERE doc_id < 100), n AS (SELECT passage_id FROM p WHERE passage_id NOT IN (SELECT passage_id FROM b)) SELECT passage_id, row_number() OVER (ORDER BY passage_id) - 1 + (SELECT count(*) FROM b) AS doc_id FROM n")
def append_documents(spark, sf):
    """Ids of new passages behind the base's."""
    p = passages(spark, sf)
    return context.append_ids(context.dense_ids(p.where("doc_id < 100").select("passage_id")), p.select("passage_id"))


_NODES = """, m AS (SELECT doc_id, length(zh_text_normalized) AS c, source_corpus AS a, source_corpus || '|' || canon AS b, source_corpus || '|' || canon || '|' || source_work_id AS w, split_part(div_path, ' / ', 1) AS d1, div_path AS d2 FROM p),
n AS (SELECT doc_id, c, 'corpus' AS node_kind, a AS node_id, NULL AS parent_id, 0 AS depth FROM m UNION ALL SELECT doc_id, c, 'canon', b, a, 1 FROM m UNION ALL SELECT doc_id, c, 'work', w, b, 2 FROM m
  UNION ALL SELECT doc_id, c, 'division', w || '|' || d1, w, 3 FROM m UNION ALL SELECT doc_id, c, 'division', w || '|' || d2, w || '|' || d1, 4 FROM m)"""


@query(_NODES + " SELECT node_kind, node_id, parent_id, depth, min(doc_id) AS first_doc_id, max(doc_id) AS last_doc_id, count(*) AS passage_count, sum(c)::BIGINT AS char_count FROM n GROUP BY 1, 2, 3, 4")
def catalog_outline(spark, sf):
    """Outline tree with ranges and counts."""
    return context.outline(passages(spark, sf))


@query(_NODES + ", s AS (SELECT node_id, depth, sum(c) AS chars FROM n WHERE depth >= 2 AND node_id IN (SELECT node_id FROM n WHERE doc_id = 7) GROUP BY 1, 2), k AS (SELECT node_id FROM s ORDER BY chars <= 20000 DESC, CASE WHEN chars <= 20000 THEN -depth ELSE depth END LIMIT 1) SELECT node_id, doc_id::VARCHAR AS passage_id, doc_id FROM n JOIN k USING (node_id)")
def adaptive_context(spark, sf):
    """Lowest node that fits a budget."""
    p = passages(spark, sf)
    return context.adaptive_context(p, context.outline(p), context.ancestor_rows(p), str(SEED), 20_000)


@query(" SELECT source_corpus, canon, source_work_id, count(*) AS passage_count, sum(length(zh_text_normalized))::BIGINT AS char_count, min(doc_id) AS first_doc_id, max(doc_id) AS last_doc_id FROM p GROUP BY ROLLUP (source_corpus, canon, source_work_id)")
def catalog_rollup(spark, sf):
    """Upper levels in one pass."""
    return context.roll_up(passages(spark, sf))


@query(" SELECT source_corpus, canon, source_work_id, min(main_title) AS main_title, count(*) AS passage_count, min(doc_id) AS first_doc_id FROM p WHERE list_contains(traditions, 'T1') GROUP BY 1, 2, 3 ORDER BY 1, 2, 3 LIMIT 20")
def works_listing(spark, sf):
    """Works of a tradition in catalog order."""
    return context.works(passages(spark, sf), Scope(tradition="T1").column())


# ------------------------------------------------------------------ lexical

_GRAMS = "list_transform(range(greatest(length({t}) - {n} + 1, 0)), lambda i: substr({t}, i + 1, {n}))"


@query(f", g AS (SELECT doc_id, unnest(list_distinct({_GRAMS.format(t=NORM, n=4)})) AS gram FROM p) SELECT gram, count(*) AS df FROM g GROUP BY 1")
def phrase_index(spark, sf):
    """Document frequency of every distinct 4-gram."""
    return lexical.document_frequency(passages(spark, sf), 4)


_STORED: dict[tuple[str, str], DataFrame] = {}


def stored_phrase_index(spark: SparkSession, sf: str) -> DataFrame:
    """The 4-gram index of a corpus, written once a session below the shared folder."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _STORED:
        _STORED[at] = lexical.store_index(lexical.phrase_index(passages(spark, sf)), f"{context.shared_folder(spark)}/phrase-index-{uuid.uuid4().hex[:12]}")
    return _STORED[at]


@query(f" SELECT doc_id, passage_id FROM p WHERE contains({NORM}, 'PHRASE')")
def phrase_index_search(spark, sf):
    """Index candidates and verification."""
    p = passages(spark, sf)
    return lexical.phrase_lookup(p, stored_phrase_index(spark, sf), PHRASE).select("doc_id", "passage_id")


_TFIDF = f""", n AS (SELECT count(*) AS n FROM p), g AS (SELECT doc_id, unnest(list_concat({_GRAMS.format(t=NORM, n=5)}, {_GRAMS.format(t=NORM, n=6)}, {_GRAMS.format(t=NORM, n=7)}, {_GRAMS.format(t=NORM, n=8)})) AS term FROM p),
c AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY 1, 2), k AS (SELECT * FROM c WHERE NOT (term = repeat(substr(term, 1, 1), length(term)) OR (length(term) % 2 = 0 AND substr(term, 1, length(term) // 2) = substr(term, length(term) // 2 + 1)))),
v AS (SELECT term, count(*) AS df FROM k GROUP BY 1 HAVING count(*) BETWEEN 5 AND greatest(1, floor(0.05 * (SELECT n FROM n))) ORDER BY df DESC, term LIMIT 200000),
i AS (SELECT term, df, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf FROM v, n),
r AS (SELECT doc_id, term, tf / sum(tf) OVER (PARTITION BY doc_id) * idf AS w FROM k JOIN i USING (term)),
w AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM r)"""


def _tfidf(p: DataFrame) -> lexical.TfIdf:
    return lexical.TfIdf(lexical.vocabulary(lexical.term_frequencies(p), p.count()))


@query(_TFIDF + " SELECT term, df, round(idf, 6) AS idf FROM i")
def tfidf_vocabulary(spark, sf):
    """Terms within the frequency bounds."""
    p = passages(spark, sf)
    return lexical.vocabulary(lexical.term_frequencies(p), p.count()).select("term", "df", F.round("idf", 6).alias("idf"))


@query(_TFIDF + ", s AS (SELECT term, w AS sw FROM w WHERE doc_id = 7) SELECT doc_id, round(sum(w * sw), 6) AS score FROM w JOIN s USING (term) WHERE doc_id <> 7 GROUP BY 1 HAVING round(sum(w * sw), 6) > 0 ORDER BY score DESC, doc_id LIMIT 20")
def tfidf_similar(spark, sf):
    """Cosine to a seed."""
    p = passages(spark, sf)
    return _tfidf(p).similar(p, SEED)


_ITEM = "SELECT regexp_replace(text, '[^\\pL\\pN\\pM]+', '', 'g') AS t FROM benchmark ORDER BY item_id LIMIT 1"


@query(_TFIDF + f", qt AS ({_ITEM}), qg AS (SELECT DISTINCT unnest(list_concat({_GRAMS.format(t='t', n=5)}, {_GRAMS.format(t='t', n=6)}, {_GRAMS.format(t='t', n=7)}, {_GRAMS.format(t='t', n=8)})) AS term FROM qt), qw AS (SELECT term, idf / (SELECT count(*) FROM qg) AS w FROM qg JOIN i USING (term)), s AS (SELECT term, w / sqrt(sum(w * w) OVER ()) AS sw FROM qw) SELECT doc_id, round(sum(w * sw), 6) AS score FROM w JOIN s USING (term) GROUP BY 1 HAVING round(sum(w * sw), 6) > 0 ORDER BY score DESC, doc_id LIMIT 20")
def tfidf_text_query(spark, sf):
    """Documents by a text's weights."""
    p = passages(spark, sf)
    item = table(spark, sf, "benchmark").orderBy("item_id").select(T.normalize(F.col("text")).alias("t")).first()
    return _tfidf(p).query(p, item.t if item else "")


@query(_TFIDF + ", s AS (SELECT term, w AS sw FROM w WHERE doc_id = 7), near AS (SELECT doc_id, round(sum(w * sw), 6) AS c FROM w JOIN s USING (term) WHERE doc_id <> 7 GROUP BY 1 HAVING round(sum(w * sw), 6) > 0 ORDER BY c DESC, doc_id LIMIT 20), sp AS (SELECT zh_text_normalized AS st, source_rel_path AS sf, canon AS sc, period AS sper FROM p WHERE doc_id = 7), b AS (SELECT p.*, near.c, sp.*, (SELECT count(*) FROM w JOIN s USING (term) WHERE w.doc_id = p.doc_id AND length(term) >= 6) AS lg FROM near JOIN p USING (doc_id), sp), lens AS (SELECT doc_id, n, CASE WHEN length(zh_text_normalized) < length(st) THEN zh_text_normalized ELSE st END AS sh, CASE WHEN length(zh_text_normalized) < length(st) THEN st ELSE zh_text_normalized END AS lo FROM b, unnest(range(4, 25)) AS r(n)), sub AS (SELECT doc_id, n, list_intersect(list_transform(range(greatest(length(sh) - n + 1, 0)), lambda i: substr(sh, i + 1, n)), list_transform(range(greatest(length(lo) - n + 1, 0)), lambda i: substr(lo, i + 1, n))) AS x FROM lens), best AS (SELECT doc_id, coalesce(max(n) FILTER (len(x) > 0), 0) AS m FROM sub GROUP BY 1) SELECT doc_id, c AS tfidf_cosine, round(c * CASE WHEN source_rel_path = sf THEN 0.60 ELSE 1.10 END * CASE WHEN length(zh_text_normalized) BETWEEN 1 AND 14 THEN 0.70 ELSE 1.0 END * CASE WHEN m >= 8 THEN 1.25 WHEN m >= 5 THEN 1.10 WHEN m = 0 THEN 0.75 ELSE 1.0 END * CASE WHEN lg >= 3 THEN 1.15 WHEN lg >= 1 THEN 1.05 ELSE 1.0 END * CASE WHEN period <> sper AND period <> '' THEN 1.05 ELSE 1.0 END, 6)::DOUBLE AS graph_candidate_score, CASE WHEN source_rel_path = sf THEN 'downrank_same_file' WHEN length(zh_text_normalized) BETWEEN 1 AND 14 THEN 'downrank_short_passage' WHEN m >= 6 AND lg >= 2 THEN 'ring1_candidate' WHEN lg >= 1 OR m >= 4 THEN 'ring2_motif' ELSE 'ring3_weak' END AS ring_hint, lg AS long_gram_count, m::INTEGER AS max_lcs_len FROM b JOIN best USING (doc_id)")
def similar_evidence(spark, sf):
    """A seed's neighbours with shared terms, common phrases and a weighed score."""
    p = passages(spark, sf)
    return _tfidf(p).evidence(p, SEED).select("doc_id", "tfidf_cosine", "graph_candidate_score", "ring_hint", "long_gram_count", "max_lcs_len")


@query(f", s AS (SELECT zh_text_normalized AS t FROM p WHERE doc_id = 7), g AS (SELECT DISTINCT substr(t, i + 1, n) AS phrase FROM s, unnest(range(4, 11)) AS r(n), unnest(range(greatest(length(t) - n + 1, 0))) AS o(i)), q AS (SELECT phrase FROM g WHERE phrase <> repeat(substr(phrase, 1, 1), length(phrase)) AND (length(phrase) % 2 = 1 OR substr(phrase, 1, length(phrase) // 2) <> substr(phrase, length(phrase) // 2 + 1)) ORDER BY length(phrase) DESC, phrase DESC LIMIT 40), h AS (SELECT phrase, source_work_id FROM p JOIN q ON contains({NORM}, phrase) WHERE doc_id <> 7), c AS (SELECT phrase, length(phrase)::INTEGER AS length, count(*) AS total, count(DISTINCT source_work_id) AS sources FROM h GROUP BY 1) SELECT phrase, length, total, sources, round(least(1.0, length / 8 + least(total, 20) / 40 + sources / 20), 6)::DOUBLE AS graph_value FROM c WHERE total BETWEEN 2 AND 200 ORDER BY graph_value DESC, sources DESC, length DESC, total, phrase LIMIT 20")
def frontier(spark, sf):
    """Phrases of a seed in other passages, in one scan."""
    p = passages(spark, sf)
    text = p.where(F.col("doc_id") == SEED).select(NORM).first()
    return lexical.frontier(p, SEED, lexical.frontier_phrases(text[0]) if text else [])


@query(
    f""", o AS (SELECT {NORM} AS t, unnest({_OFFSETS.format(n=NORM, k=7, t=PHRASE)}) AS o FROM p WHERE contains({NORM}, '{PHRASE}')), w AS (SELECT substr(t, greatest(o - 20, 0) + 1, o + 27 - greatest(o - 20, 0)) AS t FROM o),
a AS (SELECT term, count(*) AS near_count FROM (SELECT unnest(list_distinct({_GRAMS.format(t='t', n=2)})) AS term FROM w) GROUP BY 1 HAVING count(*) >= 2),
b AS (SELECT term, count(*) AS background_count FROM (SELECT unnest(list_distinct({_GRAMS.format(t=NORM, n=2)})) AS term FROM p) GROUP BY 1)
SELECT term, round(ln(((near_count + 1) / ((SELECT count(*) FROM w) + 1)) / ((background_count + 1) / ((SELECT count(*) FROM p) + 1))), 6) AS score, near_count, background_count FROM a JOIN b USING (term) ORDER BY score DESC, term LIMIT 30"""
)
def collocation_search(spark, sf):
    """Bigrams near a phrase."""
    return lexical.collocations(passages(spark, sf), PHRASE, n=2)


@query(
    f""", a AS (SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct({_GRAMS.format(t=NORM, n=2)})) AS term FROM p WHERE canon = 'en') GROUP BY 1), b AS (SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct({_GRAMS.format(t=NORM, n=2)})) AS term FROM p WHERE canon = 'de') GROUP BY 1),
j AS (SELECT coalesce(a.term, b.term) AS term, coalesce(a.n, 0) AS a_count, coalesce(b.n, 0) AS b_count FROM a FULL JOIN b ON a.term = b.term), t AS (SELECT sum(a_count) AS ta, sum(b_count) AS tb, count(*) AS v FROM j),
s AS (SELECT term, round(ln(((a_count + 0.01) / (ta + 0.01 * v)) / ((b_count + 0.01) / (tb + 0.01 * v))), 6) AS score, a_count, b_count FROM j, t)
SELECT * FROM (SELECT *, 'a' AS side FROM s ORDER BY score DESC, term LIMIT 50) UNION ALL SELECT * FROM (SELECT *, 'b' AS side FROM s ORDER BY score, term LIMIT 50)"""
)
def compare_usage(spark, sf):
    """Distinctive terms of two scopes."""
    p = passages(spark, sf)
    return lexical.compare_usage(p.where(Scope(canon="en").column()), p.where(Scope(canon="de").column()), 2)


# ------------------------------------------------------------------ vectors

_UNIT = ", u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings), d AS (SELECT u.vec_id, sqrt(list_sum(list_transform(list_zip(u.v, q.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM u, u q WHERE q.vec_id = 7 AND u.vec_id <> 7)"


@query("WITH " + _UNIT[2:] + " SELECT vec_id, round(d, 6) AS ann_distance, round(1 / (1 + d), 6) AS ann_score FROM d ORDER BY d, vec_id LIMIT 25", False)
def vector_neighbors(spark, sf):
    """Exact nearest vectors."""
    return vectors.nearest_to(table(spark, sf, "embeddings"), SEED)


@query("WITH " + _UNIT[2:] + f""", v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY d, vec_id)::INTEGER AS vector_rank FROM d ORDER BY d, vec_id LIMIT 25),
t AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id)::INTEGER AS lexical_rank FROM documents WHERE contains(regexp_replace(coalesce(text, ''), '[\\p{{P}}\\p{{S}}\\p{{Z}}\\s\\x{{85}}]+', '', 'g'), 'PHRASE') ORDER BY doc_id LIMIT 25)
SELECT coalesce(v.doc_id, t.doc_id) AS doc_id, vector_rank, lexical_rank, round(CASE WHEN vector_rank IS NOT NULL AND lexical_rank IS NOT NULL THEN 3 + 0.25 / vector_rank + 0.5 / lexical_rank WHEN lexical_rank IS NOT NULL THEN 2 + 0.5 / lexical_rank ELSE 1 + 0.25 / vector_rank END, 6)::DOUBLE AS final_score,
  CASE WHEN vector_rank IS NOT NULL AND lexical_rank IS NOT NULL THEN 'overlap' WHEN lexical_rank IS NOT NULL THEN 'lexical_only' ELSE 'semantic_only' END AS label FROM v FULL JOIN t ON v.doc_id = t.doc_id ORDER BY final_score DESC, vector_rank NULLS LAST, lexical_rank NULLS LAST, 1 LIMIT 10""", False)
def hybrid_discover(spark, sf):
    """Fusion of vector and lexical ranks."""
    near = vectors.nearest_to(table(spark, sf, "embeddings"), SEED).withColumnRenamed("vec_id", "doc_id")
    v = vectors.rank_rows(near, F.col("ann_distance"), F.col("doc_id"))
    t = vectors.rank_rows(search.hits(passages(spark, sf), PHRASE).orderBy("doc_id").limit(25), F.col("doc_id"))
    return vectors.hybrid(v, t)


@query("SELECT (SELECT count(*) FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)) AS covered, (SELECT count(*) FROM documents) AS total, round((SELECT count(*) FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)) / (SELECT count(*) FROM documents), 6)::DOUBLE AS ratio", False)
def vector_info(spark, sf):
    """Share of documents with a vector."""
    return vectors.coverage(table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id"), table(spark, sf, "documents"))


# ------------------------------------------------------------------ pages


_ENTITIES = "replace(replace(replace(replace(replace(replace(replace({x}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&')"


@query(rf"""WITH h AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages), b AS (SELECT *, trim(regexp_replace({_ENTITIES.format(x="regexp_extract(h, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '\s+', ' ', 'g')) AS title, coalesce(nullif(regexp_extract(h, '(?is)<body[^>]*>(.*)</body>', 1), ''), h) AS body FROM h),
c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?is)<div\s+id\s*=\s*["'']?toolbar["'']?[^>]*>.*?</div>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') AS x FROM b),
t AS (SELECT page_id, url, title, trim(regexp_replace({_ENTITIES.format(x="regexp_replace(x, '(?s)<[^>]+>', ' ', 'g')")}, '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, substr(sha256(coalesce(url, 'page:' || page_id)), 1, 16) AS passage_id, title, text FROM t WHERE length(text) >= 40 AND NOT regexp_matches(title, '^(404 |403 )|nem található|Tilos|^(?i:page not found)$')""", False)
def html_passages(spark, sf):
    """Pages as passages."""
    return html_pages.passages_of(table(spark, sf, "pages"))


@query(f" SELECT passage_id, {NORM} AS norm, length({NORM})::INTEGER AS n FROM p")
def normalised(spark, sf):
    """Normalised text of every passage."""
    return passages(spark, sf).select("passage_id", F.col(NORM).alias("norm"), F.length(NORM).alias("n"))


@query(f" SELECT passage_id, CASE WHEN strpos(zh_text_raw, 'the ') > 0 THEN substr(zh_text_raw, greatest(strpos(zh_text_raw, 'the ') - 25, 0) + 1, strpos(zh_text_raw, 'the ') - 1 + 52 - greatest(strpos(zh_text_raw, 'the ') - 25, 0)) ELSE substr(zh_text_raw, 1, 120) END AS quote FROM p")
def quotes(spark, sf):
    """Quotes around a phrase in the raw text."""
    return passages(spark, sf).select("passage_id", T.quote_for_phrase(F.col("zh_text_raw"), "the ").alias("quote"))


# ------------------------------------------------------- people and evidence

_MENTIONS = f""", m AS (SELECT *, list_filter(['PHRASE', 'OTHER'], lambda f: contains({NORM}, f)) AS name_forms FROM p),
n AS (SELECT passage_id, doc_id, period, period_rank, contains_person, name_forms, list_contains(name_forms, 'PHRASE') AS is_primary FROM m WHERE len(name_forms) > 0)"""


@query(_MENTIONS + " SELECT passage_id, name_forms, is_primary, 'name_mention' AS mention_class FROM n")
def person_mentions(spark, sf):
    """Passages with any form of a name, each once."""
    return people.mentions(passages(spark, sf), [PHRASE, OTHER]).select("passage_id", "name_forms", "is_primary", "mention_class")


@query(_MENTIONS + ", k AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY doc_id) AS k FROM n) SELECT 'name_mention' AS mention_class, period, count(*) AS n, list(passage_id ORDER BY k) FILTER (WHERE k <= 3) AS samples FROM k GROUP BY 2")
def person_history(spark, sf):
    """Mentions by class and period with samples."""
    return people.history_summary(people.mentions(passages(spark, sf), [PHRASE, OTHER]))


@query(_MENTIONS + ", f AS (SELECT period_rank AS r, doc_id AS d FROM n WHERE contains_person ORDER BY 1, 2 LIMIT 1) SELECT d AS doc_id, count(*) FILTER (WHERE period_rank < r OR period_rank = r AND n.doc_id < d) AS earlier_ambiguous FROM n, f GROUP BY d")
def person_earliest(spark, sf):
    """Earliest sure mention and the unsure ones before it."""
    return people.earliest_unambiguous(people.mentions(passages(spark, sf), [PHRASE, OTHER]))


@query(f""", h AS (SELECT * FROM p WHERE contains({NORM}, 'PHRASE')), q AS (SELECT period, min(period_rank) AS r FROM h GROUP BY 1)
SELECT * FROM (SELECT period AS source, lead(period) OVER (ORDER BY r, period) AS target, 'precedes' AS relation FROM q) WHERE target IS NOT NULL UNION ALL SELECT period, passage_id, 'member' FROM h""")
def timeline_graph(spark, sf):
    """Periods in order and their passages as edges."""
    return evidence.timeline_edges(search.hits(passages(spark, sf), PHRASE))


@query("WITH i AS (SELECT event_id, event_type, user_id FROM events) SELECT a.event_id AS source, b.event_id AS target, 'same_seed' AS relation FROM i a JOIN i b ON a.user_id = b.user_id AND a.event_id <> b.event_id WHERE a.event_type = (SELECT min(event_type) FROM events)", False)
def registry_edges(spark, sf):
    """Items of one seed linked to its packets."""
    events = table(spark, sf, "events")
    first = events.sparkSession.read.parquet(f"{sf}/events.parquet").agg(F.min("event_type").alias("t"))
    kind = F.when(F.col("event_type") == F.col("t"), "task_packet").otherwise("other")
    items = events.crossJoin(F.broadcast(first)).select(F.col("event_id").alias("item_id"), kind.alias("kind"), F.col("user_id").alias("seed_passage_id"))
    return evidence.same_seed(items)


# --------------------------------------------------------- sources and vectors


@query("WITH s AS (SELECT l_partkey AS w, l_returnflag AS s, sum(l_quantity) AS b FROM lineitem GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY b DESC, list_position(['A', 'N', 'R'], s) DESC) AS k FROM s) SELECT l_partkey AS work_id, l_returnflag AS source, count(*) AS files FROM lineitem JOIN k ON l_partkey = w AND l_returnflag = s AND k.k = 1 GROUP BY 1, 2", False)
def source_merge(spark, sf):
    """The source with most bytes of each work."""
    files = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("work_id"), F.col("l_returnflag").alias("source"), F.col("l_quantity").alias("bytes"))
    return references.largest_source(files, ["A", "N", "R"]).groupBy("work_id", "source").agg(F.count("*").alias("files"))


@query("SELECT user_id, event_type AS term, round(max(ln(1 + greatest(value, 0))), 6) AS weight FROM events GROUP BY 1, 2 HAVING max(value) > 0", False)
def sparse_weights(spark, sf):
    """Largest log(1 + relu) per term."""
    return vectors.splade(table(spark, sf, "events").select("user_id", F.col("event_type").alias("term"), F.col("value").alias("logit")), "user_id")


@query("WITH x AS (SELECT label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM x GROUP BY 1, 2) SELECT label, i::INTEGER AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM m", False)
def mean_pooling(spark, sf):
    """Mean vectors at unit length."""
    pooled = vectors.mean_pool(table(spark, sf, "embeddings").select("label", "embedding"), "label")
    return pooled.select("label", F.posexplode("embedding").alias("i", "v")).select("label", "i", F.round("v", 6).alias("x"))


@query(" SELECT passage_id, sha256('t1' || chr(0) || 'Work: ' || main_title || CASE WHEN heading <> '' THEN chr(10) || 'Section: ' || heading ELSE '' END || chr(10) || 'Period: ' || period) AS h FROM p WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE text LIKE '%' || chr(0) || '%')")
def embedding_inputs(spark, sf):
    """Template text and its hash."""
    text = T.embedding_text(("Work", F.col("main_title")), ("Section", F.col("heading")), ("Period", F.col("period")))
    return passages(spark, sf).select("passage_id", T.input_hash("t1", text).alias("h"))


@query(_TFIDF + ", a AS (SELECT term, w AS wa FROM w WHERE doc_id = 7), b AS (SELECT term, w AS wb FROM w WHERE doc_id = (SELECT doc_id FROM w JOIN a USING (term) WHERE doc_id <> 7 GROUP BY 1 ORDER BY round(sum(w * wa), 6) DESC, doc_id LIMIT 1)) SELECT term, round(wa * wb, 8) AS contribution FROM a JOIN b USING (term) ORDER BY contribution DESC, length(term) DESC, term LIMIT 12")
def shared_ngrams(spark, sf):
    """Terms of a seed and its nearest document."""
    p = passages(spark, sf)
    model = _tfidf(p)
    best = model.similar(p, SEED, 1).first()
    pair = model.weights(p.where(F.col("doc_id").isin([SEED, best.doc_id if best else SEED])))
    return lexical.shared_terms(pair, SEED, best.doc_id if best else SEED)


@query(" SELECT passage_id, strpos(zh_text_raw, 'the ') > 0 AS has, div_path, string_split(div_path, ' / ') AS parts, CASE WHEN from_lb IS NOT NULL THEN from_lb || '-' || to_lb ELSE '' END AS locator, trim(regexp_replace(heading, '\\s+', ' ', 'g')) AS heading FROM p")
def small_expressions(spark, sf):
    """Substring test, path parts, locator, collapsed white space."""
    p = passages(spark, sf)
    return p.select("passage_id", F.contains("zh_text_raw", F.lit("the ")).alias("has"), "div_path", F.split("div_path", " / ").alias("parts"), T.locator(F.col("from_lb"), F.col("to_lb")).alias("locator"), T.collapse_whitespace(F.col("heading")).alias("heading"))


# ------------------------------------------------ smaller operators, each with its SQL


@query(" SELECT passage_id, source_work_id, author || ', ' || main_title || CASE WHEN canon <> '' THEN ', [' || canon || ']' ELSE '' END || CASE WHEN from_lb IS NOT NULL THEN ' (' || from_lb || '-' || to_lb || ')' ELSE '' END AS citation FROM p WHERE passage_id = '7'")
def passage_lookup(spark, sf):
    """One passage with its citation (F8)."""
    return search.passage(passages(spark, sf), "7").select("passage_id", "source_work_id", "citation")


@query(f" SELECT passage_id FROM p WHERE contains({NORM}, 'ing') AND source_corpus = 'documents' AND canon = 'en' AND source_work_id = 'src3' AND (div_path = 'D1' OR starts_with(div_path, 'D1 / '))")
def search_in_node(spark, sf):
    """Hits below an outline node."""
    return search.hits(passages(spark, sf), "ing", Scope(node_id="documents|en|src3|D1")).select("passage_id")


@query(f", n AS (SELECT source_corpus || '|' || canon || '|' || source_work_id AS node_id, min(doc_id) AS lo, max(doc_id) AS hi FROM p GROUP BY 1) SELECT node_id, count(*) AS hits FROM p JOIN n ON doc_id BETWEEN lo AND hi WHERE contains({NORM}, 'PHRASE') GROUP BY 1")
def hits_in_ranges(spark, sf):
    """Hits within each work's range of ids."""
    p = passages(spark, sf)
    nodes = context.outline(p).where("node_kind = 'work'")
    return context.in_ranges(search.hits(p, PHRASE), nodes).groupBy("node_id").agg(F.count("*").alias("hits"))


@query(f" SELECT passage_id FROM p WHERE contains({NORM}, 'tion') AND contains({NORM}, 'OTHER') AND len(list_filter(regexp_split_to_array(zh_text_raw, '[。！？；\\n.!?;]'), lambda s: contains(s, 'tion') AND contains(s, 'OTHER'))) > 0")
def pair_in_sentence(spark, sf):
    """Passages with both terms in one sentence of the raw text."""
    return groups.pair_rows(passages(spark, sf), "tion", OTHER, "sentence").select("passage_id")


_AT = "list_filter(range(1, length({t}) + 1), lambda i: substr({t}, i, {n}) = '{p}')"


@query(f", o AS (SELECT period, {_AT.format(t=NORM, n=7, p=PHRASE)} AS a, {_AT.format(t=NORM, n=5, p=OTHER)} AS b FROM p WHERE contains({NORM}, 'PHRASE') OR contains({NORM}, 'OTHER')), u AS (SELECT period, len(a) > 0 AS a1, len(b) > 0 AS b1, coalesce(list_min(flatten(list_transform(a, lambda x: list_transform(b, lambda y: abs(x - y))))) <= 80, false) AS near FROM o), c AS (SELECT period AS group_label, count(*) FILTER (WHERE a1) AS term1_count, count(*) FILTER (WHERE b1) AS term2_count, count(*) FILTER (WHERE a1 AND b1 AND near) AS pair_count FROM u GROUP BY 1) SELECT *, round(CASE WHEN term1_count > 0 THEN pair_count / term1_count ELSE 0 END, 6)::DOUBLE AS pair_rate_term1, round(CASE WHEN term2_count > 0 THEN pair_count / term2_count ELSE 0 END, 6)::DOUBLE AS pair_rate_term2 FROM c ORDER BY pair_count DESC, group_label LIMIT 20")
def pair_profile_window(spark, sf):
    """Rates of a pair per period, near within a passage."""
    return groups.pair_profile(passages(spark, sf), PHRASE, OTHER, unit="window")


@query(f", o AS (SELECT passage_id, {NORM} AS t, {_AT.format(t=NORM, n=7, p=PHRASE)} AS a, {_AT.format(t=NORM, n=5, p=OTHER)} AS b FROM p WHERE contains({NORM}, 'PHRASE') AND contains({NORM}, 'OTHER')) SELECT passage_id, list_sort(list_distinct(list_concat(list_transform(a, lambda x: x - 1), list_transform(b, lambda x: x - 1)))) AS offsets, substr(t, greatest(least(a[1], b[1]) - 20, 1)::BIGINT, (greatest(a[1] + 7, b[1] + 5) + 20 - greatest(least(a[1], b[1]) - 20, 1))::BIGINT) AS snippet FROM o")
def pair_snippets(spark, sf):
    """All positions of two terms and the text around the first of each."""
    norm = F.col(NORM)
    rows = search.hits(passages(spark, sf), PHRASE).where(F.contains(NORM, F.lit(OTHER)))
    snippet = T.pair_snippet(norm, T.find_offsets(norm, PHRASE), T.find_offsets(norm, OTHER), len(PHRASE), len(OTHER))
    return rows.select("passage_id", T.find_all_offsets(norm, [PHRASE, OTHER]).alias("offsets"), snippet.alias("snippet"))


@query(f" SELECT v AS term, count(*) AS n FROM p, (VALUES ('thetionering'), ('thet'), ('thetio'), ('thetione'), ('thetioneri'), ('thetionerimg'), ('thitionering')) AS x(v) WHERE contains({NORM}, v) GROUP BY 1")
def variant_counts(spark, sf):
    """Passages per spelling variant and prefix of a phrase."""
    found = dict.fromkeys([*search.prefixes("thetionering"), *(v for v in search.variants("thetionering", {"n": "m", "e": "i"}) if v in ("thetionerimg", "thitionering"))])
    terms = F.array(*map(F.lit, found))
    p = passages(spark, sf)
    return p.select(F.explode(F.filter(terms, lambda t: F.contains(F.col(NORM), t))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


_LETTERS, _SIGNS = "abcdefghijklmnopqrstuvwxyz", "嗣法云曰示頌評拈答問祖師禪和尚一丁七三上下不中且丘丙"


def _signs(c):
    return F.translate(F.lower(c), _LETTERS, _SIGNS)


_CJK = f", c AS (SELECT *, translate(lower(regexp_replace(heading, '[^a-zA-Z]', '', 'g')), '{_LETTERS}', '{_SIGNS}') AS h FROM p)"


@query(_CJK + " SELECT passage_id, len(regexp_extract_all(h, '[㐀-䶿一-鿿豈-﫿]')) > 0 AS has_cjk, CASE WHEN contains(h, '嗣') THEN 'lineage_relation' WHEN contains(h, '不中云') OR contains(h, '不中曰') OR contains(h, '不中示') THEN 'attributed_saying' WHEN text_type = 'dialogue' THEN 'case_appearance' WHEN contains(h, '頌') OR contains(h, '評') OR contains(h, '拈') THEN 'commentarial_reference' ELSE 'name_mention' END AS mention_class FROM c")
def mention_classes(spark, sf):
    """Classes of mentions and ideograph tests on headings written in ideographs."""
    p = passages(spark, sf)
    h = _signs(F.regexp_replace("heading", "[^a-zA-Z]", ""))
    return p.select("passage_id", T.contains_cjk(h).alias("has_cjk"), T.mention_class("不中", h, F.col("text_type")).alias("mention_class"))


@query(_CJK + " , g AS (SELECT unnest(list_distinct(list_transform(range(greatest(length(h) - 1, 0)), lambda i: substr(h, i + 1, 2)))) AS term FROM c) SELECT term, count(*) AS df FROM g WHERE substr(term, 1, 1) <> substr(term, 2, 1) GROUP BY 1")
def cjk_bigrams(spark, sf):
    """Document frequency of ideograph bigrams; other characters are left out before the windows."""
    p = passages(spark, sf)
    rows = p.select("doc_id", F.concat_ws(" A1 ", _signs(F.regexp_replace("heading", "[^a-zA-Z]", "")), F.lit("zz")).alias(NORM))
    return lexical.term_frequencies(rows, (2,), "cjk")


@query(_CJK + " SELECT n AS source, passage_id AS target, 'appears in evidence' AS relation FROM (SELECT passage_id, unnest(list_distinct(regexp_extract_all(h, '(.{1,3})(?:祖|禪師|師|和尚)', 1))) AS n FROM c)")
def lineage_graph(spark, sf):
    """Names before titles of respect to their passages."""
    p = passages(spark, sf)
    return evidence.lineage_edges(p.select("passage_id", _signs(F.regexp_replace("heading", "[^a-zA-Z]", "")).alias("zh_text_raw")))


_TASKS = """ WITH d AS (SELECT doc_id, doc_id % 2 = 0 AS seeded, doc_id % 3 = 0 AS two, CASE WHEN doc_id % 5 = 0 THEN 'reuse' ELSE 'exact-reuse' END AS rel, CASE WHEN doc_id % 7 = 0 THEN 'accepted' ELSE 'needs_review' END AS st, doc_id % 4 / 2.0 AS conf, doc_id % 6 AS ring FROM documents)"""


@query(_TASKS + ", r AS (SELECT doc_id, unnest(list_filter([CASE WHEN NOT two THEN 'two_evidence' END, CASE WHEN two AND NOT seeded THEN 'seed_role' END, CASE WHEN rel = 'reuse' THEN 'relation_label' END, CASE WHEN st = 'accepted' THEN 'state' END, CASE WHEN conf > 1 THEN 'confidence' END, CASE WHEN ring NOT IN (1, 2, 3) THEN 'ring' END], lambda x: x IS NOT NULL)) AS rule FROM d) SELECT doc_id::VARCHAR AS task_id, 'c' AS claim_id, rule FROM r", False)
def adjudication_rules(spark, sf):
    """Broken rules of adjudications made from documents."""
    return evidence.violations(_tasks(spark, sf))


@query(_TASKS + " SELECT 'c' AS claim_id, doc_id::VARCHAR AS source, (doc_id + 1)::VARCHAR AS target, rel AS relation FROM d WHERE two AND seeded", False)
def evidence_graph(spark, sf):
    """Seed to candidate edges of accepted claims."""
    return evidence.edges(_tasks(spark, sf)).drop("confidence")


def _tasks(spark, sf):
    k = F.col("doc_id")
    item = lambda ident, role: F.struct(ident.cast("string").alias("passage_id"), role.alias("evidence_role"), F.lit(None).cast("string").alias("side"), F.lit("q").alias("zh_quote"), F.lit(None).cast("string").alias("quote_zh"))
    first = item(k, F.when(k % 2 == 0, "seed").otherwise("candidate"))
    hint = F.struct(F.lit("x").alias("research_lens"), F.lit(None).cast("string").alias("edge_label"), (k % 6).cast("int").alias("map_ring"), F.lit(None).cast("string").alias("render_policy"), F.lit(None).cast("string").alias("render"))
    none = F.lit(None).cast("string")
    claim = F.struct(F.lit("c").alias("claim_id"), F.when(k % 3 == 0, F.array(first, item(k + 1, F.lit("candidate")))).otherwise(F.array(first)).alias("evidence"), F.array(F.lit("q")).alias("matched_phrases"), F.when(k % 5 == 0, "reuse").otherwise("exact-reuse").alias("relation_label"), none.alias("claim_type"), F.when(k % 7 == 0, "accepted").otherwise("needs_review").alias("review_state"), (k % 4 / 2.0).cast("string").alias("confidence"), none.alias("ring"), none.alias("boilerplate_assessment"), hint.alias("graph_hint"))
    docs = table(spark, sf, "documents")
    return docs.select(k.cast("string").alias("task_id"), k.cast("string").alias("seed_passage_id"), F.array(claim).alias("accepted_claims"), F.array().cast("array<string>").alias("rejected_candidates"))


@query(f", u AS (SELECT passage_id, 0 AS k FROM p WHERE contains({NORM}, 'PHRASE') UNION ALL SELECT passage_id, 1 FROM p WHERE contains({NORM}, 'OTHER')) SELECT passage_id, CASE WHEN min(k) = 0 THEN 'PHRASE' ELSE 'OTHER' END AS phrase FROM u GROUP BY 1")
def merged_evidence(spark, sf):
    """Evidence of two searches, the first one's row of a passage winning."""
    p = passages(spark, sf)
    part = lambda phrase: search.hits(p, phrase).select("passage_id", F.lit(phrase).alias("phrase"))
    return evidence.merged(part(PHRASE), part(OTHER))


@query("WITH x AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), s AS (SELECT vec_id, sum(x * x) AS n FROM x GROUP BY 1) SELECT vec_id, i::INTEGER AS i, round(x / sqrt(n), 6) AS x FROM x JOIN s USING (vec_id) WHERE n > 0", False)
def unit_vectors(spark, sf):
    """Stored vectors of unit length, read back."""
    rows = vectors.store(table(spark, sf, "embeddings"), f"{context.shared_folder(spark)}/vectors-{uuid.uuid4().hex[:12]}")
    return rows.select("vec_id", F.posexplode("embedding").alias("i", "v")).select("vec_id", "i", F.round("v", 6).alias("x"))


@query("SELECT event_id, event_type AS tool, ts::VARCHAR AS at FROM events ORDER BY ts DESC, event_id DESC LIMIT 20", False)
def recent_calls(spark, sf):
    """The latest log rows."""
    rows = groups.recent(table(spark, sf, "events"), 20, "ts", "event_id")
    return rows.select("event_id", F.col("event_type").alias("tool"), F.col("ts").cast("string").alias("at"))


@query(_TFIDF + ", s AS (SELECT term, w AS sw FROM w WHERE doc_id = 7) SELECT doc_id, round(sum(w * sw), 6) AS score FROM w JOIN s USING (term) JOIN p USING (doc_id) WHERE doc_id <> 7 AND period IN ('P1', 'P4', 'P5') GROUP BY 1 HAVING round(sum(w * sw), 6) >= 0.001 ORDER BY score DESC, doc_id LIMIT 20")
def similar_in_scope(spark, sf):
    """Neighbours of a seed within a scope and above a similarity, filtered before the limit."""
    p = passages(spark, sf)
    model = _tfidf(p)
    return model.similar(p.where(Scope(period=["P1", "P4", "P5"]).column() | (F.col("doc_id") == SEED)), SEED).where("score >= 0.001 and doc_id != 7")


@query(_TFIDF + " SELECT term, round(max(w), 6) AS w_max FROM w GROUP BY 1 ORDER BY w_max DESC, term LIMIT 50")
def heaviest_terms(spark, sf):
    """Terms by their largest weight in a document."""
    p = passages(spark, sf)
    return _tfidf(p).weights(p).groupBy("term").agg(F.round(F.max("w"), 6).alias("w_max")).orderBy(F.desc("w_max"), "term").limit(50)


@query(f" SELECT canon, count(*) AS passages, sum(length({NORM})) AS chars, count(*) FILTER (WHERE contains_person) AS with_person FROM p GROUP BY 1")
def corpus_stats(spark, sf):
    """Passages and characters per canon."""
    return passages(spark, sf).groupBy("canon").agg(F.count("*").alias("passages"), F.sum(F.length(NORM)).alias("chars"), F.count_if("contains_person").alias("with_person"))


def table_fingerprint(spark, sf):
    """Count and order-free hash of the passage ids (T32, R28); the hash has no counterpart in SQL."""
    return context.fingerprint(passages(spark, sf), "passage_id")


QUERIES["table_fingerprint"] = table_fingerprint


# ------------------------------------------------------------------- registry

_ITEMS = "SELECT o_orderkey AS item_id, o_orderstatus AS artifact_type, o_custkey::VARCHAR AS seed_passage_id, o_orderkey % 7 AS change_count, o_orderdate::VARCHAR AS modified_utc FROM orders"


def _items(spark, sf):
    """Orders in the role of a registry's items."""
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderstatus").alias("artifact_type"), F.col("o_custkey").cast("string").alias("seed_passage_id"), (F.col("o_orderkey") % 7).alias("change_count"), F.col("o_orderdate").cast("string").alias("modified_utc"))


@query(_ITEMS + " WHERE o_custkey = 7 ORDER BY o_orderdate DESC, artifact_type, item_id LIMIT 20", False)
def prior_work(spark, sf):
    """Items of one seed, the latest first."""
    return registry.prior_work(_items(spark, sf), "7", 20)


@query(_ITEMS + " ORDER BY o_orderdate DESC, change_count DESC, item_id LIMIT 20", False)
def work_summary(spark, sf):
    """The latest items."""
    return registry.work_summary(_items(spark, sf), 20)


@query("SELECT o_orderkey AS item_id, o_orderpriority AS phrase, regexp_replace(o_orderpriority, '[^0-9A-Z]', '', 'g') AS normalized_phrase, o_custkey AS total_hits, o_orderkey % 7 AS result_count FROM orders WHERE regexp_replace(o_orderpriority, '[^0-9A-Z]', '', 'g') = '4NOTSPECIFIED' ORDER BY o_custkey DESC, result_count DESC, item_id LIMIT 20", False)
def phrase_status(spark, sf):
    """Observations of a phrase in any spelling."""
    phrase = F.col("o_orderpriority")
    seen = table(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id"), phrase.alias("phrase"), registry.T.normalize(phrase).alias("normalized_phrase"), F.col("o_custkey").alias("total_hits"), (F.col("o_orderkey") % 7).alias("result_count"))
    return registry.phrase_status(seen, "4 — NOT SPECIFIED", 20)
