"""Named tools over the operators: arguments in, rows or one record out, in an envelope; batches as a DAG."""

from __future__ import annotations

import inspect
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import context, evidence, groups, lexical, people, search, vectors
from .scope import Scope, check_passage_id

ROWS = 1000  # rows that a tool returns at most


@dataclass
class Corpus:
    """The tables that tools read; those that are missing make their tools fail, not others."""

    passages: DataFrame
    vectors: DataFrame | None = None
    weights: DataFrame | None = None
    index: DataFrame | None = None
    persons: DataFrame | None = None
    places: DataFrame | None = None
    log: DataFrame | None = None
    worked: DataFrame | None = None
    nodes: DataFrame | None = None
    members: DataFrame | None = None
    extra: dict[str, DataFrame] = field(default_factory=dict)

    def need(self, name: str) -> DataFrame:
        found = getattr(self, name, None)
        if found is None:
            raise LookupError(f"this corpus has no {name}")
        return found


Tool = Callable[..., DataFrame]
TOOLS: dict[str, Tool] = {}


def tool(name: str):
    def keep(f: Tool) -> Tool:
        TOOLS[name] = f
        return f

    return keep


def _scope(a: dict) -> Scope:
    pick = lambda k: a.get(f"scope_{k}", a.get(k))
    return Scope(canon=pick("canon"), period=pick("period"), origin=pick("origin"), tradition=pick("tradition"), source_work_id=pick("source_work_id"), author=a.get("author"), title=a.get("title"), heading_path_prefix=a.get("heading_path_prefix"), node_id=pick("node_id"))


@tool("status")
def status(c: Corpus) -> DataFrame:
    names = ["passages", "vectors", "weights", "index", "persons", "places", "log"]
    return c.passages.sparkSession.createDataFrame([(n, getattr(c, n) is not None) for n in names], "name string, available boolean")


@tool("tool-docs")
def tool_docs(c: Corpus, tool: str | None = None) -> DataFrame:
    rows = [(n, (f.__doc__ or "").strip()) for n, f in sorted(TOOLS.items()) if tool in (None, n)]
    return c.passages.sparkSession.createDataFrame(rows, "tool string, doc string")


@tool("tool-log-summary")
def tool_log_summary(c: Corpus) -> DataFrame:
    return groups.log_summary(c.need("log"))


@tool("tool-log-recent")
def tool_log_recent(c: Corpus, recent: int = 20) -> DataFrame:
    return groups.recent(c.need("log"), recent)


@tool("passage")
def passage(c: Corpus, id: str) -> DataFrame:
    return search.passage(c.passages, check_passage_id(id)).select("passage_id", "zh_text_raw", "source_work_id", "main_title", "heading", "citation")


@tool("source-read")
def source_read(c: Corpus, source_work_id: str | None = None, passage_id: str | None = None, cursor: str | None = None, start: int = 0, max_chars: int = 4000, overlap_chars: int = 400, include_previous_tail: bool = True, include_next_head: bool = True) -> DataFrame:
    """A page of a work from a cursor, a position or a passage, with its neighbours' text and cursors."""
    if cursor:
        source_work_id, start, max_chars = context.read_cursor(cursor)
    elif passage_id:
        rows = c.passages.where(F.col("passage_id") == check_passage_id(passage_id)).select("source_work_id", "doc_id").first()
        if rows is None:
            raise ValueError(f"no passage {passage_id}")
        source_work_id = rows.source_work_id
        before = c.passages.where((F.col("source_work_id") == source_work_id) & (F.col("doc_id") < rows.doc_id))
        start = before.agg(F.sum(F.length("zh_text_raw") + 1)).first()[0] or 0
    if not source_work_id:
        raise ValueError("source_work_id, passage_id or cursor is needed")
    got = context.source_read(c.passages, source_work_id, start, max_chars, overlap_chars, 200 if include_previous_tail else 0, 200 if include_next_head else 0)
    return c.passages.sparkSession.createDataFrame([(json.dumps(got["segments"], ensure_ascii=False), *got["cursor"].values(), got["position"]["char_start"], got["position"]["char_end"], got["position"]["total_chars"], got["position"]["percent"])], "segments string, cursor string, next_cursor string, prev_cursor string, char_start long, char_end long, total_chars long, percent double")


@tool("search")
def search_tool(c: Corpus, phrase: str, limit: int = 20, mode: str = "hits", group_by: str = "work", limit_per_group: int = 5, variants: list[str] | None = None, **filters) -> DataFrame:
    """Exact phrase hits, or their clusters or usage groups."""
    phrases, scope = [phrase, *(variants or [])], _scope(filters)
    brief = lambda: search.brief(search.search(c.passages, phrases, scope, limit), phrase)
    clusters = lambda: groups.outline_search(c.passages, phrases, "work" if group_by == "work" else "division", scope)
    trace = lambda: groups.trace_usage(c.passages, phrases, {"work": "source_work_id", "division": "div_path"}.get(group_by, group_by), scope, limit_per_group)
    if mode == "all":
        row = lambda kind, df: df.select(F.lit(kind).alias("block"), F.to_json(F.struct("*")).alias("row"))
        return row("hits", brief()).unionByName(row("clusters", clusters())).unionByName(row("trace", trace()))
    return {"hits": brief, "clusters": clusters, "trace": trace}[mode]()


@tool("heading-search")
def heading_search(c: Corpus, query: str, limit: int = 20, **filters) -> DataFrame:
    return search.heading_search(c.passages, query, _scope(filters), limit)


@tool("canonical-source")
def canonical_source(c: Corpus, phrase: str, limit: int = 20, canon: str | None = None) -> DataFrame:
    return search.canonical_source(c.passages, phrase, canon, limit)


@tool("works")
def works(c: Corpus, limit: int = 20, **filters) -> DataFrame:
    return context.works(c.passages, _scope(filters).column(), limit)


@tool("catalog-index-info")
def catalog_info(c: Corpus) -> DataFrame:
    return context.outline(c.passages).groupBy("node_kind").agg(F.count("*").alias("nodes"), F.sum("passage_count").alias("passages"))


@tool("vector-info")
def vector_info(c: Corpus) -> DataFrame:
    return vectors.coverage(c.need("vectors").withColumnRenamed("vec_id", "doc_id"), c.passages)


@tool("vector-neighbors")
def vector_neighbors(c: Corpus, seed: int | None = None, query_embedding: list[float] | None = None, query_text: str | None = None, k: int = 25) -> DataFrame:
    if query_text is not None or (seed is None) == (query_embedding is None):
        raise ValueError("give one of seed and query_embedding; texts need an embedder")
    return vectors.nearest_to(c.need("vectors"), seed, k) if seed is not None else vectors.nearest(c.need("vectors"), query_embedding, k)


@tool("similar")
def similar(c: Corpus, seed: int, limit: int = 20, min_similarity: float = 0.0, **filters) -> DataFrame:
    """Neighbours in scope by cosine; filters are applied before the limit."""
    scope = _scope(filters).column()
    rows = c.need("weights") if not filters else c.need("weights").join(c.passages.where(scope | (F.col("doc_id") == seed)).select("doc_id"), "doc_id", "left_semi")
    return lexical.similar(rows, seed, limit).where(F.col("score") >= min_similarity)


@tool("next-seeds")
def next_seeds(c: Corpus, seed: int, limit: int = 5) -> DataFrame:
    """The nearest passages that no packet has worked on yet."""
    near = lexical.similar(c.need("weights"), seed, 10 * limit).join(c.passages.select("doc_id", "passage_id"), "doc_id")
    near = near if c.worked is None else near.join(c.worked.select("passage_id"), "passage_id", "left_anti")
    return near.orderBy(F.desc("score"), "doc_id").limit(limit)


@tool("sql")
def sql_tool(c: Corpus, query: str, args: dict | None = None) -> DataFrame:
    """A query over the view ``passages`` with parameter markers (:name)."""
    c.passages.createOrReplaceTempView("passages")
    return c.passages.sparkSession.sql(query, args=args or {})


@tool("frontier")
def frontier(c: Corpus, seed: int, limit: int = 20, phrase_limit: int = 40) -> DataFrame:
    row = c.passages.where(F.col("doc_id") == seed).select("zh_text_normalized").first()
    if row is None:
        raise ValueError(f"no passage {seed}")
    return lexical.frontier(c.passages, seed, lexical.frontier_phrases(row[0], most=phrase_limit), limit=limit)


@tool("first-attestation")
def first_attestation(c: Corpus, phrase: str, limit: int = 20, **filters) -> DataFrame:
    return search.first_attestations(c.passages, phrase, _scope(filters), limit)


@tool("phrase-history")
def phrase_history(c: Corpus, phrase: str, **filters) -> DataFrame:
    return groups.phrase_history(c.passages, phrase, _scope(filters))


@tool("phrase-index-search")
def phrase_index_search(c: Corpus, phrase: str, limit: int = 20) -> DataFrame:
    if len(phrase) < 4:
        raise ValueError("the phrase is shorter than the index's n-grams")
    return lexical.phrase_lookup(c.passages, c.need("index"), phrase).orderBy("doc_id").limit(limit).select("doc_id", "passage_id")


@tool("seed-pick")
def seed_pick(c: Corpus, limit: int = 20, **filters) -> DataFrame:
    worked = c.worked if c.worked is not None else c.passages.select("passage_id").limit(0)
    return search.seed_pick(c.passages, worked, _scope(filters), limit)


@tool("expand-context-adaptive")
def expand_adaptive(c: Corpus, passage_id: str, max_chars: int = 5000) -> DataFrame:
    return context.adaptive_context(c.passages, context.outline(c.passages), context.ancestor_rows(c.passages), passage_id, max_chars)


@tool("expand-context")
def expand(c: Corpus, passage_id: str, before: int = 2, after: int = 2) -> DataFrame:
    return context.context_window(c.passages, passage_id, before, after)


@tool("trace-term-usage")
def trace(c: Corpus, phrase: str, group_by: str = "period", limit_per_group: int = 5, **filters) -> DataFrame:
    return groups.trace_usage(c.passages, phrase, {"work": "source_work_id"}.get(group_by, group_by), _scope(filters), limit_per_group)


@tool("query-expand-terms")
def expand_terms(c: Corpus, phrase: str, folds: dict[str, str] | None = None, max: int = 20) -> DataFrame:
    rows = [(v, "orthographic" if len(v) == len(phrase) else "prefix", search.language_guess(phrase)) for v in dict.fromkeys([*search.variants(phrase, folds or {}, max), *search.prefixes(phrase)])]
    return c.passages.sparkSession.createDataFrame(rows[:max], "term string, source string, input_lang_guess string")


@tool("compare-usage")
def compare(c: Corpus, scope_a: dict, scope_b: dict, gram_len: int = 1, limit_terms: int = 50) -> DataFrame:
    return lexical.compare_usage(c.passages.where(_scope(scope_a).column()), c.passages.where(_scope(scope_b).column()), gram_len, limit_terms)


@tool("scope-profile")
def scope_profile(c: Corpus, gram_len: int = 1, limit_terms: int = 50, **filters) -> DataFrame:
    inside = _scope(filters).column()
    return lexical.compare_usage(c.passages.where(inside), c.passages.where(~inside), gram_len, limit_terms)


@tool("collocation-search")
def collocation(c: Corpus, phrase: str, window_chars: int = 20, gram_len: int = 1, limit_collocates: int = 30, **filters) -> DataFrame:
    return lexical.collocations(c.passages.where(_scope(filters).column()), phrase, window_chars, gram_len, limit_collocates)


@tool("pair-appearance")
def pair_appearance(c: Corpus, term1: str, term2: str, unit: str = "passage", window_chars: int = 80, ordered: bool = False, limit: int = 20, **filters) -> DataFrame:
    return groups.pair_rows(c.passages, term1, term2, unit, window_chars, ordered, _scope(filters)).orderBy("doc_id").limit(limit).select("passage_id", "distance_chars", "a_offsets", "b_offsets")


@tool("pair-profile")
def pair_profile(c: Corpus, term1: str, term2: str, group_by: str = "period", unit: str = "passage", window_chars: int = 80, limit_groups: int = 20, **filters) -> DataFrame:
    return groups.pair_profile(c.passages, term1, term2, {"work": "main_title"}.get(group_by, group_by), unit, limit_groups, _scope(filters), window_chars)


@tool("outline-search")
def outline_search(c: Corpus, phrase: str, group_by: str = "division", **filters) -> DataFrame:
    return groups.outline_search(c.passages, phrase, group_by, _scope(filters))


@tool("cluster-hits")
def cluster_hits(c: Corpus, phrase: str, cluster_by: str = "work", limit_per_cluster: int = 20, **filters) -> DataFrame:
    return groups.cluster_hits(c.passages, context.ancestor_rows(c.passages), phrase, cluster_by, limit_per_cluster, scope=_scope(filters))


@tool("absence-check")
def absence_check(c: Corpus, phrase: str, **filters) -> DataFrame:
    return search.absence(c.passages, phrase, _scope(filters))


@tool("batch-evidence-search")
def batch_evidence(c: Corpus, phrases: list[str], limit: int = 20) -> DataFrame:
    return search.batch_search(c.passages, phrases, limit)


@tool("citation-verify")
def citation_verify(c: Corpus, quote: str, limit: int = 20, near_match_limit: int = 10, **filters) -> DataFrame:
    return search.citation_verify(c.passages, quote, _scope(filters), limit, near_match_limit)


@tool("hybrid-discover")
def hybrid_discover(c: Corpus, seed: int, limit: int = 10, max_candidates: int = 50) -> DataFrame:
    near = vectors.nearest_to(c.need("vectors"), seed, max_candidates).withColumnRenamed("vec_id", "doc_id")
    words = lexical.similar(c.need("weights"), seed, max_candidates)
    return vectors.hybrid(vectors.rank_rows(near, F.col("ann_distance"), F.col("doc_id")), vectors.rank_rows(words, F.desc("score"), F.col("doc_id")), limit=limit)


@tool("person-resolve")
def person_resolve(c: Corpus, name: str, aliases: list[str] | None = None) -> DataFrame:
    return people.resolve(c.need("persons"), [name, *(aliases or [])])


@tool("place-resolve")
def place_resolve(c: Corpus, name: str, aliases: list[str] | None = None) -> DataFrame:
    return people.resolve(c.need("places"), [name, *(aliases or [])], "place_id")


@tool("person-history")
def person_history(c: Corpus, name: str, aliases: list[str] | None = None, limit: int = 200, compact: bool = False) -> DataFrame:
    found = people.mentions(c.passages, [name, *(aliases or [])])
    return people.history_summary(found) if compact else found.orderBy("period_rank", "doc_id").limit(limit).select("passage_id", "name_forms", "is_primary", "mention_class", "period")


@tool("person-profile")
def person_profile(c: Corpus, name: str, aliases: list[str] | None = None) -> DataFrame:
    return people.history_summary(people.mentions(c.passages, [name, *(aliases or [])])).withColumn("false_positive_risk", F.lit(people.risk(name)))


@tool("taxonomy")
def taxonomy(c: Corpus) -> DataFrame:
    return groups.facet_summary(c.passages)


@tool("timeline")
def timeline(c: Corpus, phrase: str, **filters) -> DataFrame:
    return groups.timeline(search.hits(c.passages, phrase, _scope(filters)))


@tool("similar-phrase")
def similar_phrase(c: Corpus, phrase: str, limit: int = 20) -> DataFrame:
    return search.similar_phrase(c.passages, phrase, limit)


def _tasks(c: Corpus, path: str) -> DataFrame:
    return c.passages.sparkSession.read.schema(evidence.TASK).option("multiLine", "true").json(path)


@tool("validate-adjudication")
def validate_adjudication(c: Corpus, path: str) -> DataFrame:
    """Broken rules of adjudication files; none: valid."""
    return evidence.violations(_tasks(c, path))


@tool("graph-build")
def graph_build(c: Corpus, path: str, kind: str = "evidence", out: str | None = None) -> DataFrame:
    """Edges of the evidence, timeline or lineage graph of adjudicated passages; written as JSON lines if asked."""
    tasks = _tasks(c, path)
    if kind == "evidence":
        edges = evidence.edges(tasks)
    else:
        rows = search.lookup(c.passages, evidence.nodes(tasks).withColumnRenamed("id", "passage_id"))
        edges = {"timeline": evidence.timeline_edges, "lineage": evidence.lineage_edges}[kind](rows)
    if out:
        edges.write.json(out)
    return edges


@tool("report-build")
def report_build(c: Corpus, paths: list[str], title: str = "Report") -> DataFrame:
    """Markdown lines of a dossier: the passages of adjudicated claims, each once, in order of time."""
    tasks = _tasks(c, paths[0])
    for path in paths[1:]:
        tasks = tasks.unionByName(_tasks(c, path))
    rows = search.lookup(c.passages, evidence.nodes(tasks).withColumnRenamed("id", "passage_id"))
    section = F.concat(F.lit("## "), "passage_id", F.lit("\n\n> "), F.substring("zh_text_raw", 1, 240), F.lit("\n\n"), F.coalesce("main_title", F.lit("")))
    head = c.passages.sparkSession.createDataFrame([(0, -1, f"# {title}")], "period_rank int, doc_id long, markdown string")
    return head.unionByName(rows.select(F.coalesce("period_rank", F.lit(99)).alias("period_rank"), "doc_id", section.alias("markdown"))).orderBy("period_rank", "doc_id").select("markdown")


@tool("parquet-info")
def parquet_info(c: Corpus, path: str) -> DataFrame:
    """Files below a folder with size and row count."""
    rows = c.passages.sparkSession.read.option("recursiveFileLookup", "true").parquet(path)
    return rows.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))


# Composite tools: parts of one answer, each a tool of its own, with the argument that asks for it (None: always).
COMPOSITE = {
    "evidence-search": {"search": None, "first-attestation": "include_attestation", "phrase-history": "include_history", "trace-term-usage": "include_usage", "cluster-hits": "include_clusters", "absence-check": "include_absence_check", "query-expand-terms": "include_variants"},
    "source-investigate": {"passage": None, "expand-context-adaptive": "include_context", "frontier": "include_frontier", "similar": "include_similar", "vector-neighbors": "include_vector"},
}
DEFAULT_ON = {"include_context", "include_frontier"}


def composite(corpus: Corpus, name: str, args: dict) -> dict:
    """Parts of a composite from one set of arguments, one after the other, with what each took; within a time budget if one is given.

    Arguments named like a part are that part's own. Parts that a spent budget leaves out are told as skipped.
    """
    parts, stages, spent = {}, [], 0
    budget = args.get("max_elapsed_ms")
    own = {k: dict(v) for k, v in args.items() if k in COMPOSITE[name]}
    for part, flag in COMPOSITE[name].items():
        if own and not args.get("phrase") and not args.get("seed_passage_id"):
            wanted = part in own
        else:
            wanted = part in own or flag is None or args.get(flag, flag in DEFAULT_ON)
        if not wanted:
            continue
        if budget is not None and spent >= budget:
            stages.append({"part": part, "skipped": True})
            continue
        got = call(corpus, part, _arguments(part, args) | own.get(part, {}))
        spent += got["elapsed_ms"]
        stages.append({"part": part, "ok": got["ok"], "elapsed_ms": got["elapsed_ms"]})
        parts[part] = got
    out = {"ok": all(p["ok"] for p in parts.values()), "parts": parts, "stages": stages}
    if name == "source-investigate" and args.get("phrases"):
        out["phrase_histories"] = {p: call(corpus, "phrase-history", {"phrase": p}) for p in args["phrases"]}
        out["ok"] = out["ok"] and all(p["ok"] for p in out["phrase_histories"].values())
    return out


def _arguments(part: str, args: dict) -> dict:
    """What a part takes from the composite's arguments: its named ones and, if it has filters, the scope's."""
    seed = args.get("seed_passage_id")
    given = args | ({"id": seed, "passage_id": seed, "seed": int(seed) if str(seed).isdigit() else seed} if seed is not None else {})
    known = inspect.signature(TOOLS[part]).parameters
    scope = ("scope_canon", "scope_period", "scope_source_work_id", "scope_node_id", "canon", "period", "source_work_id", "node_id", "author", "title", "heading_path_prefix")
    filters = {k: args[k] for k in scope if k in args} if any(p.kind is p.VAR_KEYWORD for p in known.values()) else {}
    return filters | {k: given[k] for k in known if k in given and k != "c"}


def call(corpus: Corpus, name: str, args: dict, offset: int = 0) -> dict:
    """The envelope of one call: ok, rows or error, and elapsed time; nothing is raised.

    An answer of more than ``ROWS`` rows says that it is truncated and where it goes on.
    """
    began = time.perf_counter()
    out: dict = {"schema": "tool-envelope-v1", "tool": name}
    try:
        if name in COMPOSITE:
            out |= composite(corpus, name, args)
        elif name in TOOLS:
            df = TOOLS[name](corpus, **args)
            rows = [json.loads(r) for r in (df.offset(offset) if offset else df).limit(ROWS + 1).toJSON().collect()]
            more = len(rows) > ROWS
            out |= {"ok": True, "row_count": min(ROWS, len(rows)), "rows": rows[:ROWS], "truncated": more} | ({"next_offset": offset + ROWS} if more else {})
        else:
            raise LookupError(f"no tool {name}")
    except Exception as e:  # an envelope tells any failure
        out |= {"ok": False, "error": {"code": type(e).__name__, "message": str(e)[:500]}}
    return out | {"elapsed_ms": round((time.perf_counter() - began) * 1000)}


def run_batch(corpus: Corpus, jobs: list[dict]) -> list[dict]:
    """Envelopes of jobs (id, tool, args, depends_on, continue_on_error) in an order that respects dependencies.

    A job whose dependency failed is skipped unless it may continue; jobs in a
    cycle or with unknown dependencies are unresolved.
    """
    done: dict[str, dict] = {}
    out: list[dict] = []
    left = [dict(j, id=j.get("id") or f"job-{i}") for i, j in enumerate(jobs)]
    while left:
        ready = [j for j in left if all(d in done for d in j.get("depends_on") or [])]
        if not ready:
            break
        for j in ready:
            failed = [d for d in j.get("depends_on") or [] if not done[d]["ok"]]
            if failed and not j.get("continue_on_error"):
                e = {"tool": j["tool"], "ok": False, "skipped": True, "error": {"code": "DependencyFailed", "message": ", ".join(failed)}}
            else:
                e = call(corpus, j["tool"], j.get("args") or {})
            done[j["id"]] = e
            out.append({"id": j["id"]} | e)
        left = [j for j in left if j["id"] not in done]
    return out + [{"id": j["id"], "tool": j["tool"], "ok": False, "error": {"code": "Unresolved", "message": "a dependency is missing or circular"}} for j in left]


def assertions(result: dict, expect: dict) -> list[str]:
    """What of an expectation (ok, json_pointer_exists, json_pointer_absent, min_counts, equals) a result breaks."""

    def at(pointer: str):
        value = result
        for part in filter(None, pointer.split("/")):
            value = value[int(part)] if isinstance(value, list) else value[part]
        return value

    def has(pointer: str) -> bool:
        try:
            at(pointer)
        except (KeyError, IndexError, ValueError, TypeError):
            return False
        return True

    bad = []
    if "ok" in expect and result.get("ok") != expect["ok"]:
        bad.append("ok")
    bad += [f"missing {p}" for p in expect.get("json_pointer_exists", []) if not has(p)]
    bad += [f"present {p}" for p in expect.get("json_pointer_absent", []) if has(p)]
    bad += [f"count {c['pointer']}" for c in expect.get("min_counts", []) if not has(c["pointer"]) or len(at(c["pointer"])) < c["min"]]
    bad += [f"value {e['pointer']}" for e in expect.get("equals", []) if not has(e["pointer"]) or at(e["pointer"]) != e["value"]]
    return bad
