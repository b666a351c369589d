"""Catalogue: full-text search over tree nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy import fixtures as fx
from canopy.operators import search as S
from canopy.operators import segments as G
from canopy.plans.oracle_search import search_docs_sql, search_sql
from canopy.plans import artifacts
from canopy.plans.registry import register
from canopy.sources.scratch import scratch_dir


def _doc_index(spark, d):
    """The document-tree search index, written once per application and input folder."""
    def build():
        idx = S.build_index(fx.doc_tree(spark, d), fx.page_vector(spark, d), fx.page_log(spark, d))
        return idx.materialize(scratch_dir(spark, "search-index"))
    return artifacts.value(spark, d, "doc_search_index", build)


def _geo_index(spark, d):
    def build():
        pv = fx.geo_page(spark, d)
        return S.build_index(fx.geo_tree(spark, d), pv, pv).materialize(scratch_dir(spark, "search-index"))
    return artifacts.value(spark, d, "geo_search_index", build)


def _doc_sql(expr, ns, limit, detect=False):
    return search_sql(expr, ns, limit, "doc_tree", "page_vector", "page_log",
                      lambda body, extra: fx.with_views(body, "doc_tree", "page_vector", "page_log", extra=extra),
                      detect_match_type=detect)


def _geo_sql(expr, ns, limit):
    return search_sql(expr, ns, limit, "geo_tree", "geo_page", "geo_page",
                      lambda body, extra: fx.with_views(body, "geo_tree", "geo_page", extra=extra))


EN = "enwiki_namespace_0"
FR = "frwiki_namespace_0"

# query parameters (the terms are the query, the tables are searched whole)
Q_TERM = S.parse_query("the and", "en")
Q_PREFIX = S.parse_query("le ou", "fr")
Q_PHRASE = S.parse_query('"of the"', "en")
Q_BOOL = S.Not(S.Or([S.Phrase(["rewh"]), S.Phrase(["orantion"])]), S.Phrase(["hehely"]))
Q_TOP = S.parse_query("the", "en")
Q_GEO = S.parse_query("nation_1 buil", None)
Q_CROSS = S.parse_query('"source 1"', "en")


@register("search_docs", search_docs_sql("doc_tree", "page_vector", "page_log",
                                         lambda b, e: fx.with_views(b, "doc_tree", "page_vector", "page_log", extra=e)))
def search_docs(spark, d):
    return S.search_docs(fx.doc_tree(spark, d), fx.page_vector(spark, d), fx.page_log(spark, d))


@register("search_term", _doc_sql(Q_TERM, EN, 50))
def search_term(spark, d):
    return S.search(_doc_index(spark, d), Q_TERM, EN, 50)


@register("search_prefix", _doc_sql(Q_PREFIX, FR, 50))
def search_prefix(spark, d):
    return S.search(_doc_index(spark, d), Q_PREFIX, FR, 50)


@register("search_phrase", _doc_sql(Q_PHRASE, EN, 50))
def search_phrase(spark, d):
    return S.search(_doc_index(spark, d), Q_PHRASE, EN, 50)


@register("search_bool", _doc_sql(Q_BOOL, EN, 100))
def search_bool(spark, d):
    return S.search(_doc_index(spark, d), Q_BOOL, EN, 100)


@register("search_bm25_top", _doc_sql(Q_TOP, None, 100))
def search_bm25_top(spark, d):
    return S.search(_doc_index(spark, d), Q_TOP, None, 100)


@register("search_label_phrase", _doc_sql(Q_CROSS, None, 100))
def search_label_phrase(spark, d):
    return S.search(_doc_index(spark, d), Q_CROSS, None, 100)


@register("search_geo", _geo_sql(Q_GEO, "geo", 50))
def search_geo(spark, d):
    return S.search(_geo_index(spark, d), Q_GEO, "geo", 50)


Q_LABEL = S.parse_query("source", "en")
Q_MIXED = S.Or([S.Phrase(["wikipedia"]), S.Phrase(["the"])])


@register("search_match_type", _doc_sql(Q_LABEL, None, 100, detect=True))
def search_match_type(spark, d):
    """K8: match type reported per hit (label-only matches say node_label)."""
    return S.search(_doc_index(spark, d), Q_LABEL, None, 100, detect_match_type=True)


@register("search_match_type_mixed", _doc_sql(Q_MIXED, None, 100, detect=True))
def search_match_type_mixed(spark, d):
    return S.search(_doc_index(spark, d), Q_MIXED, None, 100, detect_match_type=True)


Q_REVISED = S.Or([S.Phrase(["revised"]), S.Phrase(["the"])])
BATCHES = 2
_REVISED_LOG = ("page_log2", """SELECT l.namespace, l.page_id, CASE WHEN e.event_kind = 'update' THEN concat('revised ', l.title) ELSE l.title END AS title
FROM page_log l LEFT JOIN (SELECT page_id, event_kind FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY date_published DESC, event_identifier DESC) AS rn FROM articles)
  WHERE rn = 1) e ON e.page_id = l.page_id WHERE coalesce(e.event_kind, '') <> 'delete'""")


def _changed_index(spark, d):
    """The document index after the article events, applied in batches as new segments."""
    def build():
        root = scratch_dir(spark, "search-segments")
        tree, pv, pl = fx.doc_tree(spark, d), fx.page_vector(spark, d), fx.page_log(spark, d).select("namespace", "page_id", "title")
        events = fx.articles(spark, d).select("page_id", "event_kind", "date_published", "event_identifier")
        G.create(spark, root, tree, pv, pl)
        for turn in range(BATCHES):
            last = events.where(F.col("event_identifier") % BATCHES <= turn).groupBy("page_id").agg(
                F.max_by("event_kind", F.struct("date_published", "event_identifier")).alias("kind"))
            now = pl.join(last, "page_id", "left").where("coalesce(kind, '') <> 'delete'").select(
                "namespace", "page_id", F.when(F.col("kind") == "update", F.concat(F.lit("revised "), "title"))
                .otherwise(F.col("title")).alias("title"))
            hit = events.where(F.col("event_identifier") % BATCHES == turn).select("page_id").distinct()
            touched = pv.join(hit, "page_id", "left_semi").select("namespace", F.col("cluster_node_id").alias("node_id"))
            G.apply_batch(spark, root, touched, tree, pv, now)
        return G.open_live(spark, root)
    return artifacts.value(spark, d, "changed_search_index", build)


@register("search_after_changes", search_sql(
    Q_REVISED, None, 100, "doc_tree", "page_vector", "page_log2",
    lambda body, extra: fx.with_views(body, "doc_tree", "page_vector", "page_log", "articles", extra=[_REVISED_LOG, *extra])))
def search_after_changes(spark, d):
    """The index kept current from the change stream gives what a rebuilt one gives."""
    return S.search(_changed_index(spark, d), Q_REVISED, None, 100)
