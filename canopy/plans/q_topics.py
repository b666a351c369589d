"""Catalogue: labelling evidence and passes."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy import fixtures as fx
from canopy.functions import lang
from canopy.operators import lookup as Lk
from canopy.operators import search as S
from canopy.operators import topics as T
from canopy.plans.registry import register

V = fx.with_views
WS = r"'\s+'"


def _doc_cleared(spark, d):
    return fx.doc_tree(spark, d).withColumn("first_label", F.lit(None).cast("string")).withColumn(
        "final_label", F.lit(None).cast("string"))


def _content(spark, d):
    return Lk.page_content(fx.page_log(spark, d), fx.page_vector(spark, d), 500)


_CONTENT_SQL = ("c", """SELECT pl.namespace, pv.cluster_node_id AS node_id, pl.page_id, pl.title,
       substring(pl.abstract, 1, 500) AS abstract
FROM page_vector pv JOIN page_log pl ON pl.namespace = pv.namespace AND pl.page_id = pv.page_id
WHERE pv.cluster_node_id IS NOT NULL""")


def _leaf_ev_sql(tree_sql: str, label_col: str) -> list[tuple[str, str]]:
    return [
        ("t", tree_sql),
        ("lv", f"""SELECT namespace, node_id FROM t x WHERE coalesce({label_col}, '') = ''
  AND NOT EXISTS (SELECT 1 FROM t c WHERE c.namespace = x.namespace AND c.parent_id = x.node_id)"""),
        _CONTENT_SQL,
        ("top", """SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY c.namespace, c.node_id ORDER BY c.page_id) AS rn
  FROM c JOIN lv ON lv.namespace = c.namespace AND lv.node_id = c.node_id) WHERE rn <= 100"""),
        ("ev", f"""SELECT lv.namespace, lv.node_id, trim(regexp_replace(coalesce(string_agg(
    CASE WHEN coalesce(top.abstract, '') = '' THEN top.title ELSE concat(top.title, ': ', top.abstract) END,
    '; ' ORDER BY top.page_id), ''), {WS}, ' ', 'g')) AS evidence
FROM lv LEFT JOIN top ON top.namespace = lv.namespace AND top.node_id = lv.node_id GROUP BY lv.namespace, lv.node_id"""),
    ]


_DOC_CLEARED = "SELECT namespace, node_id, parent_id, depth, NULL AS first_label, NULL AS final_label FROM doc_tree"
_DOC_FIRST = "SELECT namespace, node_id, parent_id, depth, first_label, NULL AS final_label FROM doc_tree"


@register("label_evidence_leaf", V("SELECT namespace, node_id, evidence FROM ev", "doc_tree", "page_log", "page_vector",
                                   extra=_leaf_ev_sql(_DOC_CLEARED, "first_label")))
def label_evidence_leaf(spark, d):
    """L1: evidence for every unlabelled leaf (first 100 pages, 'title: abstract' joined by '; ')."""
    return T.page_evidence(_doc_cleared(spark, d), _content(spark, d), "first_label")


_SIB_SQL = ("sib", """SELECT k.namespace, k.node_id, coalesce(string_agg(s.first_label, ', ' ORDER BY s.node_id), '')
         AS neighbours
FROM t k LEFT JOIN t s ON s.namespace = k.namespace AND s.parent_id = k.parent_id AND s.node_id <> k.node_id
  AND coalesce(s.first_label, '') <> ''
WHERE k.parent_id IS NOT NULL GROUP BY k.namespace, k.node_id""")


@register("label_evidence_leaf_adv", V("""SELECT ev.namespace, ev.node_id, ev.evidence, coalesce(sib.neighbours, '') AS neighbours
FROM ev LEFT JOIN sib ON sib.namespace = ev.namespace AND sib.node_id = ev.node_id""",
                                       "doc_tree", "page_log", "page_vector",
                                       extra=_leaf_ev_sql(_DOC_FIRST, "final_label") + [_SIB_SQL]))
def label_evidence_leaf_adv(spark, d):
    """L2: leaves already have first labels; final-label evidence adds sibling labels."""
    t = fx.doc_tree(spark, d).withColumn("final_label", F.lit(None).cast("string"))
    return T.page_evidence_adv(t, _content(spark, d))


_GEO_STEM = ("t", """SELECT namespace, node_id, parent_id, depth, CASE WHEN depth = 3 THEN final_label END AS first_label,
       NULL AS final_label FROM geo_tree""")
_GEO_STEM_ADV = ("t", """SELECT namespace, node_id, parent_id, depth, final_label AS first_label,
       CASE WHEN depth = 3 THEN final_label END AS final_label FROM geo_tree""")
_INNER = ("inn", """SELECT * FROM t x WHERE parent_id IS NOT NULL
  AND EXISTS (SELECT 1 FROM t c WHERE c.namespace = x.namespace AND c.parent_id = x.node_id)""")


def _child_sql(col: str) -> tuple[str, str]:
    return ("ch", f"""SELECT namespace, parent_id AS node_id, string_agg({col}, ', ' ORDER BY node_id) AS children
FROM t WHERE parent_id IS NOT NULL AND coalesce({col}, '') <> '' GROUP BY namespace, parent_id""")


@register("label_evidence_stem", V("""SELECT i.namespace, i.node_id, i.depth, coalesce(ch.children, '') AS evidence
FROM inn i LEFT JOIN ch ON ch.namespace = i.namespace AND ch.node_id = i.node_id
WHERE coalesce(i.first_label, '') = ''""", "geo_tree", extra=[_GEO_STEM, _INNER, _child_sql("first_label")]))
def label_evidence_stem(spark, d):
    """L3: inner nodes of the geo tree once its leaves are labelled."""
    g = fx.geo_tree(spark, d)
    t = g.select("namespace", "node_id", "parent_id", "depth",
                 F.when(F.col("depth") == 3, F.col("final_label")).alias("first_label"),
                 F.lit(None).cast("string").alias("final_label"))
    return T.stem_evidence(t)


@register("label_evidence_stem_adv", V("""SELECT i.namespace, i.node_id, i.depth, coalesce(ch.children, '') AS evidence,
       coalesce(sib.neighbours, '') AS neighbours,
       (SELECT count(*) FROM t s WHERE s.namespace = i.namespace AND s.parent_id = i.parent_id) = 1 AS only_child
FROM inn i LEFT JOIN ch ON ch.namespace = i.namespace AND ch.node_id = i.node_id
LEFT JOIN sib ON sib.namespace = i.namespace AND sib.node_id = i.node_id
WHERE coalesce(i.final_label, '') = ''""", "geo_tree", extra=[_GEO_STEM_ADV, _INNER, _child_sql("final_label"), _SIB_SQL]))
def label_evidence_stem_adv(spark, d):
    """L4: inner nodes' final-label evidence: child final labels + sibling first labels."""
    g = fx.geo_tree(spark, d)
    t = g.select("namespace", "node_id", "parent_id", "depth", F.col("final_label").alias("first_label"),
                 F.when(F.col("depth") == 3, F.col("final_label")).alias("final_label"))
    return T.stem_evidence_adv(t)


@register("root_label", V("""SELECT t.namespace, t.node_id, coalesce(l.local_name, t.namespace) AS label
FROM doc_tree t LEFT JOIN languages l ON l.namespace = t.namespace WHERE t.parent_id IS NULL""",
                          "doc_tree", "languages"))
def root_label(spark, d):
    """L5."""
    return T.root_labels(fx.doc_tree(spark, d), lang.languages(spark))


@register("system_text", V(f"""SELECT n.namespace, concat('{T.BASE_SYSTEM_TEXT} Generated output should only be in ',
       coalesce(l.language, 'English'), '.') AS system
FROM (SELECT DISTINCT namespace FROM page_log) n LEFT JOIN languages l ON l.namespace = n.namespace""",
                           "page_log", "languages"))
def system_text(spark, d):
    """L7."""
    return T.system_texts(fx.page_log(spark, d), lang.languages(spark))


_TOK = "list_filter(regexp_split_to_array(strip_accents(lower(title)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"


_TT = [
    ("tc", f"""SELECT namespace, node_id, term, count(*) AS c FROM (
    SELECT pv.namespace, pv.cluster_node_id AS node_id, unnest({_TOK}) AS term
    FROM page_vector pv JOIN page_log pl ON pl.namespace = pv.namespace AND pl.page_id = pv.page_id
    WHERE pv.cluster_node_id IS NOT NULL
      AND EXISTS (SELECT 1 FROM doc_tree t WHERE t.namespace = pv.namespace AND t.node_id = pv.cluster_node_id
                  AND t.final_label IS NOT NULL)) GROUP BY 1, 2, 3"""),
    ("nl", "SELECT namespace, node_id, sum(c) AS len FROM tc GROUP BY 1, 2"),
    ("al", "SELECT namespace, avg(len) AS avg_len FROM nl GROUP BY 1"),
    ("tt", "SELECT namespace, term, sum(c) AS tot FROM tc GROUP BY 1, 2"),
    ("sc", """SELECT tc.namespace, tc.node_id, tc.term, round(tc.c / nl.len * ln(1 + al.avg_len / tt.tot), 6) AS score
FROM tc JOIN nl USING (namespace, node_id) JOIN tt USING (namespace, term) JOIN al USING (namespace)"""),
]


@register("top_terms", V("""SELECT namespace, node_id, CAST(rank AS INTEGER) AS rank, term, score FROM (
  SELECT *, row_number() OVER (PARTITION BY namespace, node_id ORDER BY score DESC, term) AS rank FROM sc)
WHERE rank <= 5""", "doc_tree", "page_log", "page_vector", extra=_TT))
def top_terms(spark, d):
    """Top five title terms per node (class-based TF-IDF over the search index's postings)."""
    from canopy.plans.q_search import _doc_index
    return T.top_terms_from_postings(_doc_index(spark, d).postings, 5)


@register("label_budget", V("""SELECT namespace, node_id, evidence FROM ev ORDER BY namespace, node_id LIMIT 10""",
                            "doc_tree", "page_log", "page_vector", extra=_leaf_ev_sql(_DOC_CLEARED, "first_label")))
def label_budget(spark, d):
    """The first pass's work list under a budget of 10 model calls."""
    ev = T.page_evidence(_doc_cleared(spark, d), _content(spark, d), "first_label")
    return ev.orderBy("namespace", "node_id").limit(10)


@register("label_passes")
def label_passes(spark, d):
    """The four passes with the offline stand-in model over the cleared document tree."""
    t = _doc_cleared(spark, d).select("namespace", "node_id", "parent_id", "depth", "first_label", "final_label")
    out = T.run_passes(t, _content(spark, d), lang.languages(spark))
    return out.select("namespace", "node_id", "depth", "first_label", "final_label")
