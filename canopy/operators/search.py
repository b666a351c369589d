"""Full-text search over tree nodes (K1-K10) with BM25 ranking.

One search document per labelled node with two indexed columns: the node label
(column 0) and the space-joined titles of the node's pages ordered by page_id
(column 1).  Instead of materialising that concatenated string and re-tokenising
it, the index is built as a postings table ``(namespace, node_id, col, term, pos)``
straight from the page rows; a title's positions are offset by the token count of
the earlier titles of its node (skew-safe running sum), so phrase adjacency across
title boundaries behaves exactly as on the concatenated text.

Ranking (lower = better, as an FTS engine's bm25 reports it), per namespace:
  idf_i = ln((N - n_i + 0.5) / (n_i + 0.5)), non-positive -> 1e-6
  score = - sum_i idf_i * f_i * (k1 + 1) / (f_i + k1 * (1 - b + b * len / avglen))
with f_i the phrase hits over both columns, len the node's token count over both
columns, N and avglen over the namespace's search documents.

Besides the positions, the index holds one weight row per (term, node) and one block row per
(term, bucket), a bucket being a hash range of about ``nodes_per_bucket`` nodes.  A block
knows how many nodes it has and its largest term weight.  The files are ranged over
(namespace, term, bucket), so the postings of a frequent term lie in many files.  A top-k
of whole words adds the largest weights up per bucket, reads the most promising buckets
first and then only those that can still reach the k-th score.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.functions import lang as langf
from canopy.functions.text import py_tokens, tokens
from canopy.operators.windows import grouped_prefix_sum

# BM25 parameters and the floor for non-positive idf.
K1 = 1.2
B = 0.75
IDF_FLOOR = 1e-6

MAX_QUERY_CHARS = 100
DEFAULT_LIMIT = 50
MAX_LIMIT = 100

KEY = ["namespace", "node_id"]


# ---------------------------------------------------------------------------
# query model (structured; a plain splitter turns text into it)
# ---------------------------------------------------------------------------

@dataclass
class Phrase:
    tokens: list[str]
    prefix: bool = False   # last token matches as a prefix


@dataclass
class And:
    parts: list


@dataclass
class Or:
    parts: list


@dataclass
class Not:
    keep: object
    drop: object


def phrases_of(expr) -> list[Phrase]:
    if isinstance(expr, Phrase):
        return [expr]
    if isinstance(expr, (And, Or)):
        return [p for e in expr.parts for p in phrases_of(e)]
    if isinstance(expr, Not):
        return phrases_of(expr.keep) + phrases_of(expr.drop)
    raise TypeError(expr)


def parse_query(query: str, language_code: str | None) -> And | None:
    """Text -> structured query.

    * a fully double-quoted query is one phrase;
    * otherwise every word is its own phrase (implicit AND); for languages not in
      the whole-word list the last word matches as a prefix.
    Returns None for a query that yields no tokens.  Bounds: 1..100 characters.
    """
    q = query.strip()
    if not 1 <= len(q) <= MAX_QUERY_CHARS:
        raise ValueError(f"query length must be 1..{MAX_QUERY_CHARS}")
    if len(q) >= 2 and q.startswith('"') and q.endswith('"'):
        toks = py_tokens(q[1:-1])
        return And([Phrase(toks)]) if toks else None
    toks = py_tokens(q)
    if not toks:
        return None
    use_prefix = (language_code or "") not in langf.WHOLE_WORD_LANGUAGES
    parts = [Phrase([t]) for t in toks]
    parts[-1].prefix = use_prefix
    return And(parts)


# ---------------------------------------------------------------------------
# index
# ---------------------------------------------------------------------------

@dataclass
class SearchIndex:
    docs: DataFrame        # namespace, node_id, final_label, depth, parent_id, page_count, doc_len
    postings: DataFrame    # namespace, term, bucket, node_id, col, pos
    weights: DataFrame     # namespace, term, bucket, node_id, f, f_label, doc_len
    blocks: DataFrame      # namespace, term, bucket, nodes, top (largest weight at avg_len), avg_len
    stats: DataFrame       # namespace, n_docs, avg_len
    extra: dict = field(default_factory=dict)

    def materialize(self, root: str, files: int | None = None) -> "SearchIndex":
        """Write the index once and serve searches from the files.

        Rows are range-partitioned on (namespace, term, bucket) and sorted so inside each
        file, then laid out by namespace: a lookup prunes the namespace folders and, through
        the Parquet min/max statistics of term and bucket, most files and row groups.
        """
        spark = self.postings.sparkSession
        n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
        shared = self.extra.get("pages")
        if shared is not None:          # tokenised pages feed both postings and docs: compute once
            shared.persist()
        try:
            (self.postings.repartitionByRange(n, "namespace", "term", "bucket", "node_id", "pos")
             .sortWithinPartitions("term", "bucket", "node_id", "pos")
             .write.mode("overwrite").partitionBy("namespace").parquet(f"{root}/postings"))
            self.docs.write.mode("overwrite").parquet(f"{root}/docs")
        finally:
            if shared is not None:
                shared.unpersist()
        docs, postings = spark.read.parquet(f"{root}/docs"), spark.read.parquet(f"{root}/postings")
        doc_stats(docs).write.mode("overwrite").parquet(f"{root}/stats")
        (term_weights(postings, docs).repartitionByRange(n, "namespace", "term", "bucket")
         .sortWithinPartitions("term", "bucket", "node_id")
         .write.mode("overwrite").partitionBy("namespace").parquet(f"{root}/weights"))
        stats, weights = spark.read.parquet(f"{root}/stats"), spark.read.parquet(f"{root}/weights")
        (block_tops(weights, stats).sortWithinPartitions("term", "bucket")
         .write.mode("overwrite").partitionBy("namespace").parquet(f"{root}/blocks"))
        return open_index(spark, root)


def open_index(spark, root: str) -> SearchIndex:
    return SearchIndex(*[spark.read.parquet(f"{root}/{t}") for t in ("docs", "postings", "weights", "blocks", "stats")],
                       {"root": root})


def term_weights(postings: DataFrame, docs: DataFrame) -> DataFrame:
    """Occurrences of each term in each node, with the node's length."""
    return (postings.groupBy("namespace", "term", "bucket", "node_id")
            .agg(F.count("*").alias("f"), F.count_if(F.col("col") == 0).alias("f_label"))
            .join(docs.select(*KEY, "doc_len"), KEY)
            .select("namespace", "term", "bucket", "node_id", "f", "f_label", "doc_len"))


def _weight(avg_len):
    """The part of a term's score that depends on the node."""
    return F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("doc_len") / avg_len))


def block_tops(weights: DataFrame, stats: DataFrame) -> DataFrame:
    return (weights.join(F.broadcast(stats.select("namespace", "avg_len")), "namespace")  # a row per namespace
            .groupBy("namespace", "term", "bucket", "avg_len")
            .agg(F.count("*").alias("nodes"), F.max(_weight(F.col("avg_len"))).alias("top"))
            .select("namespace", "term", "bucket", "nodes", "top", "avg_len"))


def _ntok(c):
    return F.coalesce(F.size(c), F.lit(0))


def node_pages(tree: DataFrame, page_vector: DataFrame, page_log: DataFrame) -> DataFrame:
    """Pages of labelled nodes with their titles: namespace, node_id, page_id, title."""
    labelled = tree.where(F.col("final_label").isNotNull()).select(*KEY)
    pv = (page_vector.where(F.col("cluster_node_id").isNotNull())
          .select("namespace", "page_id", F.col("cluster_node_id").alias("node_id")))
    return (pv.join(page_log.select("namespace", "page_id", "title"), ["namespace", "page_id"])
            .join(labelled, KEY, "left_semi"))


def search_docs(tree: DataFrame, page_vector: DataFrame, page_log: DataFrame) -> DataFrame:
    """One row per labelled node: titles joined by ' ' in page_id order, page count.

    Nodes without pages get '' and 0.  The concatenated text is the product here;
    the search path itself never builds it (see ``build_index``).
    """
    labelled = tree.where(F.col("final_label").isNotNull()).select(*KEY, "final_label")
    agg = (node_pages(tree, page_vector, page_log)
           .groupBy(*KEY)
           .agg(F.array_sort(F.collect_list(F.struct("page_id", "title"))).alias("pt"),
                F.count("page_id").alias("page_count")))
    return (labelled.join(agg, KEY, "left")
            .select(*KEY, "final_label",
                    F.coalesce(F.concat_ws(" ", F.transform("pt", lambda s: s["title"])), F.lit(""))
                    .alias("page_titles"),
                    F.coalesce("page_count", F.lit(0)).alias("page_count")))


def bucket_of(node_id, buckets: int):
    return F.pmod(F.xxhash64(node_id), F.lit(buckets))


def build_index(tree: DataFrame, page_vector: DataFrame, page_log: DataFrame, nodes_per_bucket: int = 256) -> SearchIndex:
    labelled = tree.where(F.col("final_label").isNotNull()).select(
        *KEY, "final_label", "depth", "parent_id")
    buckets = max(1, -(-labelled.count() // nodes_per_bucket))
    pages = (node_pages(tree, page_vector, page_log)
             .withColumn("toks", tokens("title"))
             .withColumn("ntok", _ntok(F.col("toks"))))
    offs = grouped_prefix_sum(pages, KEY, "page_id", "ntok", "off")
    title_post = offs.select(*KEY, F.lit(1).alias("col"), "off", F.posexplode("toks").alias("i", "term")) \
        .select(*KEY, "col", "term", (F.col("off") + F.col("i")).alias("pos"))
    label_post = labelled.select(*KEY, F.lit(0).alias("col"), F.posexplode(tokens("final_label")).alias("pos", "term")) \
        .select(*KEY, "col", "term", F.col("pos").cast("bigint").alias("pos"))
    postings = label_post.unionByName(title_post.withColumn("pos", F.col("pos").cast("bigint"))) \
        .withColumn("bucket", bucket_of("node_id", buckets))
    title_len = pages.groupBy(*KEY).agg(F.sum("ntok").alias("tl"), F.count("*").alias("pc"))
    docs = (labelled.join(title_len, KEY, "left")
            .select(*KEY, "final_label", "depth", "parent_id",
                    F.coalesce("pc", F.lit(0)).alias("page_count"),
                    (_ntok(tokens("final_label")) + F.coalesce("tl", F.lit(0))).alias("doc_len")))
    stats = doc_stats(docs)
    weights = term_weights(postings, docs)
    return SearchIndex(docs, postings, weights, block_tops(weights, stats), stats, {"pages": pages})


def doc_stats(docs: DataFrame) -> DataFrame:
    """Per namespace: number of search documents and their mean token length."""
    return docs.groupBy("namespace").agg(F.count("*").alias("n_docs"), F.avg("doc_len").alias("avg_len"))


# ---------------------------------------------------------------------------
# evaluation
# ---------------------------------------------------------------------------

def _match(post: DataFrame, token: str, prefix: bool) -> DataFrame:
    return post.where(F.col("term").startswith(token) if prefix else F.col("term") == token)


def phrase_hits(post: DataFrame, ph: Phrase) -> DataFrame:
    """namespace, node_id, col, hits for one phrase (adjacent positions within a column)."""
    last = len(ph.tokens) - 1
    cur = _match(post, ph.tokens[0], ph.prefix and last == 0).select(*KEY, "col", F.col("pos").alias("end"))
    for j, tok in enumerate(ph.tokens[1:], start=1):
        # equi-join on the next position itself: linear in the postings, never a per-node product
        nxt = _match(post, tok, ph.prefix and j == last).select(*KEY, "col", F.col("pos").alias("end"))
        cur = cur.select(*KEY, "col", (F.col("end") + 1).alias("end")).join(nxt, [*KEY, "col", "end"])
    return cur.groupBy(*KEY, "col").agg(F.count("*").alias("hits"))


def _holds(expr, found: dict[int, object]):
    """Whether a node matches, from a boolean (or block) column per phrase."""
    if isinstance(expr, Phrase):
        return found[id(expr)]
    if isinstance(expr, (And, Or)):
        out = _holds(expr.parts[0], found)
        for e in expr.parts[1:]:
            out = out & _holds(e, found) if isinstance(expr, And) else out | _holds(e, found)
        return out
    if isinstance(expr, Not):
        return _holds(expr.keep, found) & ~_holds(expr.drop, found)
    raise TypeError(expr)


def _may_hold(expr, found: dict[int, object]):
    """Whether a bucket may have matching nodes: what is to be dropped rules out no bucket."""
    if isinstance(expr, Not):
        return _may_hold(expr.keep, found)
    if isinstance(expr, (And, Or)):
        out = _may_hold(expr.parts[0], found)
        for e in expr.parts[1:]:
            out = out & _may_hold(e, found) if isinstance(expr, And) else out | _may_hold(e, found)
        return out
    return found[id(expr)]


def _kept(expr) -> list[Phrase]:
    """Phrases that can add to a score."""
    if isinstance(expr, Not):
        return _kept(expr.keep)
    return [p for e in expr.parts for p in _kept(e)] if isinstance(expr, (And, Or)) else [expr]


def _of_namespace(df: DataFrame, namespace: str | None) -> DataFrame:
    return df if namespace is None else df.where(F.col("namespace") == namespace)


def _term_is(ph: Phrase):
    return F.col("term").startswith(ph.tokens[0]) if ph.prefix else F.col("term") == ph.tokens[0]


def phrase_rows(index: SearchIndex, phrases: list[Phrase], namespace: str | None, within=None) -> DataFrame:
    """namespace, node_id, i, f, f_label, doc_len: a row per phrase and node that has it.

    Single words come from the weights in one read (``within`` restricts its buckets), longer
    phrases from the positions.
    """
    out = None
    words = [(i, p) for i, p in enumerate(phrases) if len(p.tokens) == 1]
    if words:
        any_term = _term_is(words[0][1])
        for _, p in words[1:]:
            any_term = any_term | _term_is(p)
        rows = _of_namespace(index.weights, namespace).where(any_term)
        rows = rows if within is None else within(rows)
        which = F.filter(F.array(*[F.when(_term_is(p), F.lit(i)) for i, p in words]), lambda x: x.isNotNull())
        out = rows.select(*KEY, F.explode(which).alias("i"), "f", "f_label", "doc_len")
        if any(p.prefix for _, p in words):
            out = out.groupBy(*KEY, "i", "doc_len").agg(F.sum("f").alias("f"), F.sum("f_label").alias("f_label"))
        out = out.select(*KEY, "i", "f", "f_label", "doc_len")
    for i, p in enumerate(phrases):
        if len(p.tokens) > 1:
            h = (phrase_hits(_of_namespace(index.postings, namespace), p).groupBy(*KEY)
                 .agg(F.sum("hits").alias("f"), F.sum(F.when(F.col("col") == 0, F.col("hits")).otherwise(0)).alias("f_label"))
                 .join(_of_namespace(index.docs, namespace).select(*KEY, "doc_len"), KEY)
                 .select(*KEY, F.lit(i).alias("i"), "f", "f_label", "doc_len"))
            out = h if out is None else out.unionByName(h)
    return out


def _idf(n_i: DataFrame, stats: DataFrame) -> DataFrame:
    raw = F.log((F.col("n_docs") - F.col("n_i") + 0.5) / (F.col("n_i") + 0.5))
    return (n_i.join(F.broadcast(stats), "namespace")  # a row per namespace
            .select("namespace", "i", "avg_len", F.when(raw <= 0, F.lit(IDF_FLOOR)).otherwise(raw).alias("idf")))


def _scored(rows: DataFrame, idf: DataFrame, expr, phrases: list[Phrase]) -> DataFrame:
    """Matching nodes with their score (higher is better), label hits and number of phrases."""
    found = {id(p): F.bool_or(F.col("i") == i) for i, p in enumerate(phrases)}
    return (rows.join(F.broadcast(idf), ["namespace", "i"])  # a row per namespace and phrase
            .withColumn("term_score", F.col("idf") * _weight(F.col("avg_len")))
            .groupBy(*KEY)
            .agg(F.sum("term_score").alias("gain"), F.min("f_label").alias("min_label_hits"),
                 F.count("*").alias("n_matched"), _holds(expr, found).alias("holds"))
            .where("holds").drop("holds"))


FIRST_BUCKETS = 32
#: Buckets named in a filter; more are matched by a join.
NAMED_BUCKETS = 1000


@dataclass
class BlockPlan:
    """Which buckets a top-k has to read: ``first`` by promise, the others by what the first ones gave."""

    idf: DataFrame
    bounds: DataFrame      # namespace, bucket, bound: no node of the bucket scores more
    first: list
    more: bool


def block_plan(index: SearchIndex, expr, namespace: str | None, first: int = FIRST_BUCKETS) -> BlockPlan:
    """Bounds for an expression of whole words, from the blocks alone."""
    phrases = phrases_of(expr)
    spark = index.blocks.sparkSession
    terms = sorted({p.tokens[0] for p in phrases})
    blocks = _of_namespace(index.blocks, namespace).where(F.col("term").isin(terms))
    counts = {(r.namespace, r.term): r.n for r in  # a row per namespace and word of the query
              blocks.groupBy("namespace", "term").agg(F.sum("nodes").alias("n")).collect()}
    rows = [(ns, i, n) for (ns, term), n in counts.items() for i, p in enumerate(phrases) if p.tokens[0] == term]
    stats = _of_namespace(index.stats, namespace)
    idf = _idf(spark.createDataFrame(rows, "namespace string, i int, n_i long"), stats)
    idf = spark.createDataFrame(idf.collect(), idf.schema)
    which = F.filter(F.array(*[F.when(F.col("term") == p.tokens[0], F.lit(i)) for i, p in enumerate(phrases)]),
                     lambda x: x.isNotNull())
    # a weight grows at most as much as the mean length has grown since its block was written
    grown = F.col("top") * F.greatest(F.lit(1.0), F.col("now") / F.col("avg_len"))
    kept = {id(p) for p in _kept(expr)}
    tops = (blocks.where(F.col("top").isNotNull()).withColumn("i", F.explode(which))
            .join(F.broadcast(idf.withColumnRenamed("avg_len", "now")), ["namespace", "i"])
            .groupBy("namespace", "bucket")
            .agg(*[F.max(F.when(F.col("i") == i, F.col("idf") * grown)).alias(f"t{i}") for i in range(len(phrases))]))
    gain = sum((F.coalesce(F.col(f"t{i}"), F.lit(0.0)) for i, p in enumerate(phrases) if id(p) in kept), F.lit(0.0))
    may = _may_hold(expr, {id(p): F.col(f"t{i}").isNotNull() for i, p in enumerate(phrases)})
    bounds = tops.where(may).select("namespace", "bucket", gain.alias("bound"))
    top = bounds.orderBy(F.desc("bound"), "namespace", "bucket").limit(first + 1).collect()
    return BlockPlan(idf, bounds, [(r.namespace, r.bucket) for r in top[:first]], len(top) > first)


def _named(buckets: list):
    """Restrict rows to the (namespace, bucket) pairs given, in a form that reaches the scan."""
    by_namespace: dict[str, list[int]] = {}
    for ns, b in buckets:
        by_namespace.setdefault(ns, []).append(b)

    def within(rows: DataFrame) -> DataFrame:
        keep = F.lit(False)
        for ns, names in by_namespace.items():
            keep = keep | ((F.col("namespace") == ns) & F.col("bucket").isin(sorted(names)))
        return rows.where(keep)
    return within


def later_buckets(plan: BlockPlan, threshold: float) -> DataFrame:
    """Buckets outside the first wave that may still hold a node of score ``threshold`` or more."""
    spark = plan.bounds.sparkSession
    read = spark.createDataFrame(plan.first, "namespace string, bucket long")
    return plan.bounds.where(F.col("bound") >= threshold - 1e-6).join(F.broadcast(read), ["namespace", "bucket"], "left_anti")


def _top_rows(index: SearchIndex, expr, phrases: list[Phrase], namespace: str | None, limit: int) -> DataFrame:
    """Scored nodes that include the ``limit`` best, read from as few blocks as their bounds allow."""
    plan = block_plan(index, expr, namespace)
    out = _scored(phrase_rows(index, phrases, namespace, _named(plan.first)), plan.idf, expr, phrases)
    if not plan.more:
        return out
    best = out.orderBy(F.desc("gain")).limit(limit).collect()
    spark = index.docs.sparkSession
    held = spark.createDataFrame(best, out.schema)
    # ties on the rounded score go to the smaller id, so nodes within a rounding step count too
    threshold = min(r.gain for r in best) - 1e-6 if len(best) == limit else float("-inf")
    ties = out.where(F.col("gain") >= threshold) if best else held
    later = later_buckets(plan, threshold)
    some = later.limit(NAMED_BUCKETS + 1).collect()
    if not some:
        return ties
    names = [(r.namespace, r.bucket) for r in some]
    within = _named(names) if len(names) <= NAMED_BUCKETS else \
        lambda rows: rows.join(later.select("namespace", "bucket"), ["namespace", "bucket"], "left_semi")
    return ties.unionByName(_scored(phrase_rows(index, phrases, namespace, within), plan.idf, expr, phrases))


def search(index: SearchIndex, expr, namespace: str | None = None, limit: int | None = DEFAULT_LIMIT,
           detect_match_type: bool = False) -> DataFrame:
    """Ranked nodes matching ``expr``: node_id, namespace, node_label, match_type, depth, parent_id, score.

    ``namespace=None`` searches every namespace (statistics stay per namespace).
    ``limit`` is the top-k of the feature (1..100); None returns every match.  A top-k of
    whole words runs its first reads when it is called; a prefix or a longer phrase has to
    count its nodes over all blocks, so it reads them all.
    """
    if limit is not None and not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be 1..{MAX_LIMIT}")
    docs = _of_namespace(index.docs, namespace)
    phrases = phrases_of(expr)
    if limit is not None and all(len(p.tokens) == 1 and not p.prefix for p in phrases):
        scored = _top_rows(index, expr, phrases, namespace, limit)
    else:
        rows = phrase_rows(index, phrases, namespace)
        n_i = rows.groupBy("namespace", "i").agg(F.count("*").alias("n_i"))
        scored = _scored(rows, _idf(n_i, _of_namespace(index.stats, namespace)), expr, phrases)
    match_type = F.lit("page_titles")
    if detect_match_type:
        match_type = F.when((F.col("min_label_hits") > 0) & (F.col("n_matched") == len(phrases)),
                            F.lit("node_label")).otherwise(match_type)
    # order on the rounded score so ties break on node_id identically everywhere
    out = scored.select(*KEY, match_type.alias("match_type"), F.round(-F.col("gain"), 6).alias("score"))
    if limit is not None:
        out = F.broadcast(out.orderBy("score", "node_id").limit(limit))  # at most MAX_LIMIT rows
    return (out.join(docs, KEY)
            .select("node_id", "namespace", F.col("final_label").alias("node_label"), "match_type", "depth", "parent_id",
                    "score").orderBy("score", "node_id"))


def search_text(index: SearchIndex, query: str, namespace: str, language_code: str | None,
                limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Text entry point; a query without tokens (or out of bounds) gives an empty result."""
    spark = index.docs.sparkSession
    try:
        expr = parse_query(query, language_code)
    except ValueError:
        expr = None
    if expr is None:
        return spark.createDataFrame([], "node_id bigint, namespace string, node_label string, match_type string, "
                                         "depth int, parent_id bigint, score double")
    return search(index, expr, namespace, limit)
