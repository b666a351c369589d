"""Independent SQL statement of the search semantics (DuckDB dialect).

Built directly on the concatenated-document definition: tokens of the label and
of every title with positions offset by earlier titles (window running sum),
phrase hits by positional self-joins, BM25 with per-namespace statistics.
"""

from __future__ import annotations

from canopy.operators.search import B, IDF_FLOOR, K1, And, Not, Or, Phrase, phrases_of


def tok(x: str) -> str:
    return (f"list_filter(regexp_split_to_array(strip_accents(lower({x})), '[^\\p{{L}}\\p{{N}}]+'), "
            f"lambda t: t <> '')")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def index_ctes(tree: str, pv: str, pl: str) -> list[tuple[str, str]]:
    return [
        ("s_lab", f"SELECT namespace, node_id, final_label, depth, parent_id FROM {tree} WHERE final_label IS NOT NULL"),
        ("s_np", f"""SELECT pv.namespace, pv.cluster_node_id AS node_id, pv.page_id, pl.title, {tok('pl.title')} AS toks
FROM {pv} pv JOIN {pl} pl ON pl.namespace = pv.namespace AND pl.page_id = pv.page_id
WHERE pv.cluster_node_id IS NOT NULL
  AND EXISTS (SELECT 1 FROM s_lab l WHERE l.namespace = pv.namespace AND l.node_id = pv.cluster_node_id)"""),
        ("s_npo", """SELECT *, coalesce(len(toks), 0) AS ntok,
       coalesce(sum(coalesce(len(toks), 0)) OVER (PARTITION BY namespace, node_id ORDER BY page_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
FROM s_np"""),
        ("s_post", f"""SELECT namespace, node_id, 0 AS col, term, pos FROM (
  SELECT namespace, node_id, unnest(toks) AS term, unnest(range(len(toks))) AS pos
  FROM (SELECT namespace, node_id, {tok('final_label')} AS toks FROM s_lab))
UNION ALL
SELECT namespace, node_id, 1 AS col, term, off + i AS pos FROM (
  SELECT namespace, node_id, off, unnest(toks) AS term, unnest(range(len(toks))) AS i FROM s_npo)"""),
        ("s_docs", f"""SELECT l.namespace, l.node_id, l.final_label, l.depth, l.parent_id,
       coalesce(t.pc, 0) AS page_count, coalesce(len({tok('l.final_label')}), 0) + coalesce(t.tl, 0) AS doc_len
FROM s_lab l LEFT JOIN (SELECT namespace, node_id, sum(ntok) AS tl, count(*) AS pc FROM s_npo GROUP BY namespace, node_id) t
  ON t.namespace = l.namespace AND t.node_id = l.node_id"""),
        ("s_stats", "SELECT namespace, count(*) AS n_docs, avg(doc_len) AS avg_len FROM s_docs GROUP BY namespace"),
    ]


def _term_pred(alias: str, token: str, prefix: bool) -> str:
    return f"starts_with({alias}.term, {q(token)})" if prefix else f"{alias}.term = {q(token)}"


def phrase_sql(ph: Phrase, ns_pred: str) -> str:
    n = len(ph.tokens)
    joins = []
    preds = [ns_pred.replace("$", "p0"), _term_pred("p0", ph.tokens[0], ph.prefix and n == 1)]
    for j in range(1, n):
        joins.append(f"JOIN s_post p{j} ON p{j}.namespace = p0.namespace AND p{j}.node_id = p0.node_id "
                     f"AND p{j}.col = p0.col AND p{j}.pos = p0.pos + {j}")
        preds.append(_term_pred(f"p{j}", ph.tokens[j], ph.prefix and j == n - 1))
    return (f"SELECT p0.namespace, p0.node_id, p0.col, count(*) AS hits FROM s_post p0 {' '.join(joins)} "
            f"WHERE {' AND '.join(preds)} GROUP BY p0.namespace, p0.node_id, p0.col")


def _set_sql(expr, idx: dict[int, int]) -> str:
    if isinstance(expr, Phrase):
        return f"SELECT namespace, node_id FROM s_h{idx[id(expr)]}"
    if isinstance(expr, And):
        return "(" + " INTERSECT ".join(_set_sql(e, idx) for e in expr.parts) + ")"
    if isinstance(expr, Or):
        return "(" + " UNION ".join(_set_sql(e, idx) for e in expr.parts) + ")"
    if isinstance(expr, Not):
        return f"({_set_sql(expr.keep, idx)} EXCEPT {_set_sql(expr.drop, idx)})"
    raise TypeError(expr)


def search_sql(expr, namespace: str | None, limit: int | None, tree: str, pv: str, pl: str,
               views_prefix, detect_match_type: bool = False) -> str:
    ns_pred = f"$.namespace = {q(namespace)}" if namespace is not None else "TRUE"
    phrases = phrases_of(expr)
    idx = {id(p): i for i, p in enumerate(phrases)}
    extra = index_ctes(tree, pv, pl)
    extra += [(f"s_h{i}", phrase_sql(p, ns_pred)) for i, p in enumerate(phrases)]
    extra.append(("s_pp", " UNION ALL ".join(
        f"SELECT namespace, node_id, {i} AS i, sum(hits) AS f, "
        f"sum(CASE WHEN col = 0 THEN hits ELSE 0 END) AS f_label FROM s_h{i} GROUP BY namespace, node_id"
        for i in range(len(phrases)))))
    extra.append(("s_idf", """SELECT c.namespace, c.i,
       CASE WHEN ln((s.n_docs - c.n_i + 0.5) / (c.n_i + 0.5)) <= 0 THEN {floor}
            ELSE ln((s.n_docs - c.n_i + 0.5) / (c.n_i + 0.5)) END AS idf
FROM (SELECT namespace, i, count(*) AS n_i FROM s_pp GROUP BY namespace, i) c JOIN s_stats s ON s.namespace = c.namespace"""
                  .format(floor=IDF_FLOOR)))
    extra.append(("s_match", _set_sql(expr, idx)))
    extra.append(("s_sc", f"""SELECT pp.namespace, pp.node_id,
       -sum(i.idf * pp.f * {K1 + 1} / (pp.f + {K1} * (1 - {B} + {B} * d.doc_len / s.avg_len))) AS raw,
       min(pp.f_label) AS min_label, count(*) AS n_matched
FROM s_pp pp JOIN s_idf i ON i.namespace = pp.namespace AND i.i = pp.i
JOIN s_docs d ON d.namespace = pp.namespace AND d.node_id = pp.node_id
JOIN s_stats s ON s.namespace = pp.namespace
WHERE (pp.namespace, pp.node_id) IN (SELECT namespace, node_id FROM s_match)
GROUP BY pp.namespace, pp.node_id"""))
    match = (f"CASE WHEN sc.min_label > 0 AND sc.n_matched = {len(phrases)} THEN 'node_label' "
             f"ELSE 'page_titles' END" if detect_match_type else "'page_titles'")
    body = f"""SELECT d.node_id, d.namespace, d.final_label AS node_label, {match} AS match_type, d.depth, d.parent_id,
       round(sc.raw, 6) AS score
FROM s_sc sc JOIN s_docs d ON d.namespace = sc.namespace AND d.node_id = sc.node_id
ORDER BY score, d.node_id""" + (f" LIMIT {limit}" if limit is not None else "")
    return views_prefix(body, extra)


def search_docs_sql(tree: str, pv: str, pl: str, views_prefix) -> str:
    body = """SELECT l.namespace, l.node_id, l.final_label,
       coalesce(string_agg(np.title, ' ' ORDER BY np.page_id), '') AS page_titles,
       count(np.page_id) AS page_count
FROM s_lab l LEFT JOIN s_np np ON np.namespace = l.namespace AND np.node_id = l.node_id
GROUP BY l.namespace, l.node_id, l.final_label"""
    return views_prefix(body, index_ctes(tree, pv, pl)[:2])
