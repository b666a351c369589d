"""Topic labelling, data side (L1-L8): evidence per node and the four bottom-up passes.

The label model is the caller's ``label_fn(pandas.DataFrame) -> pandas.DataFrame``
(columns in: namespace, node_id, system, evidence; out: namespace, node_id, label)
run through ``mapInPandas``.  Inner-node passes go level by level from the deepest
level up, so a parent is always labelled after all of its children.

Evidence sizes are bounded by construction: at most 100 pages per leaf (partial
per-group limit before the shuffle), abstracts cut to 500 characters, and a
node's children / siblings are one parent's fan-out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions import lang as L
from canopy.functions.text import collapse_ws, snippet
from canopy.operators.lookup import leaf_nodes
from canopy.operators.windows import first_n_per_group
from canopy.session import cut_lineage

KEY = ["namespace", "node_id"]
MAX_PAGES = 100
# Fixed value: default instruction the language sentence is appended to.
BASE_SYSTEM_TEXT = "You name topics of groups of encyclopedia pages."


def pending(c: str):
    """Falsy label: null or empty string."""
    return F.coalesce(F.col(c), F.lit("")) == ""


def _joined(df: DataFrame, keys, order: str, value: str, sep: str, out: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.concat_ws(sep, F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]))
        .alias(out))


def page_evidence(tree: DataFrame, content: DataFrame, label_col: str = "first_label") -> DataFrame:
    """L1: leaves with a pending ``label_col``: first 100 pages (page_id order) as
    'title[: abstract]' joined by '; ', whitespace collapsed.

    ``content``: (namespace, node_id, page_id, title, abstract) — abstracts already cut (C5).
    """
    todo = leaf_nodes(tree).where(pending(label_col)).select(*KEY)
    top = first_n_per_group(content.join(todo, KEY, "left_semi"), KEY, ["page_id"], MAX_PAGES)
    ev = _joined(top.withColumn("snip", snippet("title", "abstract")), KEY, "page_id", "snip", "; ", "evidence")
    return todo.join(ev, KEY, "left").select(*KEY, collapse_ws(F.coalesce("evidence", F.lit(""))).alias("evidence"))


def sibling_labels(tree: DataFrame, label_col: str = "first_label") -> DataFrame:
    """C9 for every node at once: its siblings' non-empty labels, ', '-joined by node_id.

    Each parent's labelled children are packed once (bounded by the fan-out) and
    every child drops itself from its parent's list — no sibling pairs as rows.
    """
    kids = tree.where(F.col("parent_id").isNotNull()).select("namespace", "parent_id", "node_id", label_col)
    lists = (kids.where(~pending(label_col))
             .groupBy("namespace", "parent_id")
             .agg(F.array_sort(F.collect_list(F.struct(F.col("node_id").alias("sib"),
                                                       F.col(label_col).alias("sl")))).alias("lst")))
    j = kids.join(lists, ["namespace", "parent_id"], "left")
    others = F.filter("lst", lambda x: x["sib"] != F.col("node_id"))
    return j.select(*KEY, F.concat_ws(", ", F.transform(others, lambda x: x["sl"])).alias("neighbours"))


def child_labels(tree: DataFrame, label_col: str) -> DataFrame:
    kids = tree.where(F.col("parent_id").isNotNull() & ~pending(label_col)).select(
        "namespace", F.col("parent_id").alias("node_id"), F.col("node_id").alias("child"), label_col)
    return _joined(kids, KEY, "child", label_col, ", ", "children")


def page_evidence_adv(tree: DataFrame, content: DataFrame) -> DataFrame:
    """L2: leaves with pending final label: page evidence + sibling first labels."""
    ev = page_evidence(tree, content, "final_label")
    sib = sibling_labels(tree, "first_label")
    return ev.join(sib, KEY, "left").select(*KEY, "evidence", F.coalesce("neighbours", F.lit("")).alias("neighbours"))


def stem_evidence(tree: DataFrame) -> DataFrame:
    """L3: inner non-root nodes with pending first label: child first labels, ', '-joined."""
    inner = tree.where(F.col("parent_id").isNotNull()).join(leaf_nodes(tree).select(*KEY), KEY, "left_anti")
    todo = inner.where(pending("first_label")).select(*KEY, "depth")
    return todo.join(child_labels(tree, "first_label"), KEY, "left").select(
        *KEY, "depth", F.coalesce("children", F.lit("")).alias("evidence"))


def stem_evidence_adv(tree: DataFrame) -> DataFrame:
    """L4: inner non-root nodes with pending final label: child final labels + sibling first labels."""
    inner = tree.where(F.col("parent_id").isNotNull()).join(leaf_nodes(tree).select(*KEY), KEY, "left_anti")
    todo = inner.where(pending("final_label")).select(*KEY, "depth")
    n_sib = tree.where(F.col("parent_id").isNotNull()).groupBy("namespace", "parent_id").agg(
        F.count("*").alias("n_sib"))
    par = tree.select(*KEY, "parent_id")
    return (todo.join(child_labels(tree, "final_label"), KEY, "left")
            .join(sibling_labels(tree, "first_label"), KEY, "left")
            .join(par, KEY).join(n_sib, ["namespace", "parent_id"])
            .select(*KEY, "depth", F.coalesce("children", F.lit("")).alias("evidence"),
                    F.coalesce("neighbours", F.lit("")).alias("neighbours"), (F.col("n_sib") == 1).alias("only_child")))


def root_labels(tree: DataFrame, langs: DataFrame) -> DataFrame:
    """Root label = local wiki name of the namespace (namespace itself if unknown)."""
    roots = tree.where(F.col("parent_id").isNull()).select(*KEY)
    return L.with_language(roots, langs).select(*KEY, F.coalesce("local_name", "namespace").alias("label"))


def system_texts(namespaces: DataFrame, langs: DataFrame, base: str = BASE_SYSTEM_TEXT) -> DataFrame:
    """L7."""
    j = L.with_language(namespaces.select("namespace").distinct(), langs)
    return j.select("namespace", L.system_text(base, F.coalesce("language", F.lit("English"))).alias("system"))


def top_terms(pages: DataFrame, n: int = 5) -> DataFrame:
    """Class-based TF-IDF of title tokens per node, top ``n`` (score desc, term asc).

    tf = count(term in node) / tokens(node); idf = ln(1 + mean tokens per node / count(term overall)),
    statistics per namespace.  ``pages``: (namespace, node_id, page_id, title).
    """
    from canopy.functions.text import tokens
    return top_terms_from_counts(
        pages.select(*KEY, F.explode(tokens("title")).alias("term")).groupBy(*KEY, "term")
        .agg(F.count("*").alias("c")), n)


def top_terms_from_postings(postings: DataFrame, n: int = 5) -> DataFrame:
    """L8 over an existing search index: the title column's postings are the token counts."""
    return top_terms_from_counts(
        postings.where(F.col("col") == 1).groupBy(*KEY, "term").agg(F.count("*").alias("c")), n)


def top_terms_from_counts(tc: DataFrame, n: int) -> DataFrame:
    node_len = tc.groupBy(*KEY).agg(F.sum("c").alias("len"))
    avg_len = node_len.groupBy("namespace").agg(F.avg("len").alias("avg_len"))
    term_tot = tc.groupBy("namespace", "term").agg(F.sum("c").alias("tot"))
    scored = (tc.join(node_len, KEY).join(term_tot, ["namespace", "term"]).join(F.broadcast(avg_len), "namespace")
              .withColumn("score", F.round(F.col("c") / F.col("len") * F.log(1 + F.col("avg_len") / F.col("tot")), 6)))
    w = Window.partitionBy(*KEY).orderBy(F.desc("score"), "term")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(
        *KEY, "rank", "term", "score")


# --- the passes ------------------------------------------------------------------------

WORD = regex.compile(r"[\p{L}\p{N}]{4,}")


def offline_label_fn(pdf: pd.DataFrame) -> pd.DataFrame:
    """Deterministic stand-in model: the three most frequent 4+-letter words of the evidence."""
    labels = []
    for ev in pdf["evidence"].fillna(""):
        words = Counter(w.lower() for w in WORD.findall(ev))
        top = sorted(words.items(), key=lambda kv: (-kv[1], kv[0]))[:3]
        labels.append(" ".join(w for w, _ in top).capitalize() or None)
    return pd.DataFrame({"namespace": pdf["namespace"], "node_id": pdf["node_id"], "label": labels})


def _apply_model(ev: DataFrame, systems: DataFrame, label_fn: Callable, text: str = "evidence") -> DataFrame:
    inp = ev.join(systems, "namespace", "left").select(*KEY, "system", F.col(text).alias("evidence"))

    def run(it):
        for pdf in it:
            yield label_fn(pdf)

    return inp.mapInPandas(run, "namespace string, node_id bigint, label string")


def _set(tree: DataFrame, labels: DataFrame, col: str) -> DataFrame:
    lab = labels.select(*KEY, F.col("label").alias("__l"))
    return (tree.join(lab, KEY, "left")
            .withColumn(col, F.when(F.col("__l").isNotNull(), F.col("__l")).otherwise(F.col(col))).drop("__l"))


def run_passes(tree: DataFrame, content: DataFrame, langs: DataFrame,
               label_fn: Callable = offline_label_fn, limit: int | None = None) -> DataFrame:
    """Four passes + root label; ``limit`` caps how many nodes get a model call in total
    (E4 budget: pass order, then deepest first, then node_id)."""
    systems = system_texts(tree, langs)
    budget = [limit]

    def take(ev: DataFrame, order) -> DataFrame:
        if budget[0] is None:
            return ev
        ev = ev.orderBy(*order).limit(max(budget[0], 0))
        budget[0] -= ev.count()
        return ev

    t = cut_lineage(tree)
    # pass 1: leaves, first labels from pages
    ev = take(page_evidence(t, content, "first_label"), ["node_id"])
    t = cut_lineage(_set(t, _apply_model(ev, systems, label_fn), "first_label"))
    # pass 2: leaves, final labels with sibling context
    ev = take(page_evidence_adv(t, content).withColumn(
        "evidence", F.concat_ws(" | ", "evidence", "neighbours")), ["node_id"])
    t = cut_lineage(_set(t, _apply_model(ev, systems, label_fn), "final_label"))
    max_depth = t.agg(F.max("depth")).first()[0] or 0
    # pass 3: inner nodes, deepest level first
    for depth in range(max_depth - 1, 0, -1):
        ev = take(stem_evidence(t).where(F.col("depth") == depth), ["node_id"])
        t = cut_lineage(_set(t, _apply_model(ev, systems, label_fn), "first_label"))
    # pass 4: inner nodes' final labels; an only child keeps its first label
    for depth in range(max_depth - 1, 0, -1):
        ev = stem_evidence_adv(t).where(F.col("depth") == depth)
        only = ev.where("only_child").join(t.select(*KEY, F.col("first_label").alias("label")), KEY).select(*KEY, "label")
        ev = take(ev.where(~F.col("only_child")).withColumn(
            "evidence", F.concat_ws(" | ", "evidence", "neighbours")), ["node_id"])
        t = cut_lineage(_set(_set(t, only, "final_label"), _apply_model(ev, systems, label_fn), "final_label"))
    roots = root_labels(t, langs)
    t = _set(_set(t, roots, "first_label"), roots, "final_label")
    return t
