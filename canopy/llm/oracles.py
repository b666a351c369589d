"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from canopy.llm import chat, mixing, quality

WORD = r"[^\x20\x09-\x0D]+"


def quality_sql() -> str:
    stops = ", ".join(f"'{w}'" for w in quality._spellings(quality.STOP_WORDS))
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS w,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM d),
    g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
          FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
    r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
    c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
    m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                 (length(t) - length(translate(t, '{quality.SYMBOLS}', '')))::BIGINT AS n_symbols,
                 len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
                 coalesce(c.n, 0)::BIGINT AS n_repeat_words,
                 len(list_filter(w, lambda x: x IN ({stops})))::BIGINT AS n_stop_words
          FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
    f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, base_failed,
           (NOT base_failed AND {quality.verdict_sql()}) AS kept FROM f"""


def chat_sql(template: chat.Template = chat.CHATML) -> str:
    def grown(column: str) -> str:
        marks = [f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in template.controls]
        return f"length({column}) + length({column}) - length(replace({column}, chr(92), '')) + " + " + ".join(marks)

    fixed = len(template.start) + len(template.middle) + len(template.end)
    loss = ", ".join(f"'{r}'" for r in template.loss_roles)
    order = "ORDER BY turn NULLS LAST, role, text"
    return f"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
               UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    a AS (SELECT conv_id, count(*) AS n_turns,
                 string_agg(role || chr(10) || text || chr(10), '' {order}) AS said,
                 coalesce(string_agg(CASE WHEN role IN ({loss}) THEN text ELSE '' END, '' {order}), '') AS lost,
                 sum({fixed} + {grown('role')} + {grown('text')})::BIGINT AS formatted_chars
          FROM c GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(lost)::BIGINT AS loss_chars,
           sha256(lost) AS loss_sha256, formatted_chars FROM a"""


def mix_sql(mix: mixing.Mix = mixing.Mix()) -> str:
    b, weights = mix.block, list(mix.weights)
    return f"""
    WITH d AS (SELECT doc_id, coalesce('0' || source, '1') AS src,
                      len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
                      md5('{mix.seed}:' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM documents),
    p AS (SELECT *, (coalesce(sum(size) OVER (PARTITION BY src ORDER BY key, doc_id, size
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS pos FROM d),
    s0 AS (SELECT src, sum(size)::BIGINT AS source_size FROM d GROUP BY src),
    s1 AS (SELECT *, (row_number() OVER (ORDER BY src) - 1)::BIGINT AS rank FROM s0),
    s2 AS (SELECT *, ({weights}::DOUBLE[])[rank % {len(weights)} + 1] AS w, (source_size * {mix.repeats})::DOUBLE AS lim,
                  (sum(source_size) OVER ())::DOUBLE * {mix.volume}::DOUBLE AS total FROM s1),
    s3 AS (SELECT *, (total - coalesce(sum(lim) OVER (ORDER BY lim / w, src
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
                     / sum(w) OVER (ORDER BY lim / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
           FROM s2),
    s4 AS (SELECT *, max(CASE WHEN lim / w > level THEN level END) OVER () AS share FROM s3),
    t AS (SELECT src, source_size, rank, least(lim, coalesce(share * w, lim)) AS target,
                 ((source_size + {b} - 1) // {b})::BIGINT AS n_blocks FROM s4),
    h AS (SELECT *, sum(target) OVER () AS house FROM t),
    h1 AS (SELECT *, round(house / {b}) AS seats FROM h),
    h2 AS (SELECT *, floor(coalesce(target * seats / nullif(house, 0.0), 0.0) + 0.5) AS base FROM h1),
    h3 AS (SELECT *, seats - sum(base) OVER () AS open FROM h2),
    j AS (SELECT *, unnest(range(1, abs(open)::BIGINT + 1)) AS j FROM h3 WHERE open <> 0 AND target > 0),
    j1 AS (SELECT *, CASE WHEN open > 0 THEN base + j ELSE base - j + 1 END AS seat FROM j),
    j2 AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN open > 0 THEN -target / (2 * seat - 1)
                                                 ELSE target / (2 * seat - 1) END, src, j) AS place
           FROM j1 WHERE seat >= 1),
    j3 AS (SELECT src, sum(sign(open)) AS more FROM j2 WHERE place <= abs(open) GROUP BY src),
    q AS (SELECT h3.*, least(base + coalesce(more, 0), n_blocks * {mix.repeats})::BIGINT AS quota
          FROM h3 LEFT JOIN j3 ON h3.src = j3.src),
    x AS (SELECT p.*, q.n_blocks, q.rank, q.quota, unnest(range(pos // {b}, (pos + size - 1) // {b} + 1)) AS k
          FROM p JOIN q ON p.src = q.src WHERE size > 0),
    y AS (SELECT doc_id, src, key, pos, least((k + 1) * {b}, pos + size) - greatest(k * {b}, pos) AS n,
                 quota // n_blocks + CASE WHEN (k * ((CASE WHEN n_blocks % 1000003 = 0 THEN 999983 ELSE 1000003 END)
                     % n_blocks) + {mix.seed} * 7919 + rank * 104729) % n_blocks < quota % n_blocks
                     THEN 1 ELSE 0 END AS times FROM x),
    z AS (SELECT src, key, pos, sum(n * times) AS taken FROM y GROUP BY ALL)
    SELECT p.doc_id, p.size, q.source_size, q.target, coalesce(z.taken, 0)::BIGINT AS taken
    FROM p JOIN q ON p.src = q.src LEFT JOIN z ON p.src = z.src AND p.key = z.key AND p.pos = z.pos AND p.size > 0"""


def warc_sql() -> str:
    return """
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
                      sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND first_id IS DISTINCT FROM page_id AND first_id IS NOT NULL
                THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to
    FROM f"""


def top_k_sql(k: int = 20) -> str:
    return f"""
    WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
          FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""


def near_sql(percent: int = 80, size: int = 4) -> str:
    return f"""
    WITH RECURSIVE d AS (
      SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '{WORD}') AS w FROM documents),
    g AS (SELECT DISTINCT r, array_to_string(w[i:i + {size - 1}], ' ') AS g
          FROM (SELECT r, w, unnest(range(1, greatest(len(w) - {size - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
    s AS (SELECT r, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS sig FROM g GROUP BY r),
    o AS (SELECT sig, any_value(n) AS n, min(r) AS r FROM s GROUP BY sig),
    i AS (SELECT o.sig, o.n, g.g FROM o JOIN g ON g.r = o.r),
    l AS (SELECT a.sig AS a, b.sig AS b FROM i a JOIN i b ON a.g = b.g AND a.sig <> b.sig
          GROUP BY a.sig, b.sig, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
    reach AS (SELECT sig AS a, sig AS b FROM o UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
    low AS (SELECT reach.a AS sig, min(d.doc_id) AS component_id
            FROM reach JOIN s ON s.sig = reach.b JOIN d ON d.r = s.r GROUP BY reach.a)
    SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles,
           CASE WHEN s.sig IS NULL THEN d.doc_id ELSE low.component_id END AS component_id,
           (CASE WHEN s.sig IS NULL THEN d.doc_id ELSE low.component_id END IS NOT DISTINCT FROM d.doc_id) AS kept
    FROM d LEFT JOIN s ON s.r = d.r LEFT JOIN low ON low.sig = s.sig"""


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    codes = f"list_transform(string_split({text}, ''), lambda c: ord(c)::BIGINT)"
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {codes}), "
            "lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))")


def merkle_sql() -> str:
    def encoded(c: str) -> str:
        return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"

    leaf = " || ".join(encoded(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    more = " || ".join(encoded(c) for c in ("doc_id", "source", "lang", "(n_chars + 1)", "text"))
    return f"""
    WITH RECURSIVE d AS (
      SELECT doc_id, coalesce('=' || lang, '') AS g, sha256({leaf}) AS leaf,
             CASE WHEN n_chars IS NOT NULL AND ({crc32_sql('doc_id::VARCHAR')}) % 7 = 0 THEN sha256({more}) END AS other
      FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k,
                 count(*) OVER (PARTITION BY g) AS n FROM d),
    t AS (SELECT g, 0 AS lev, k, n, leaf AS h FROM r
          UNION ALL
          SELECT g, lev + 1, k // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY k)) FROM t WHERE n > 1 GROUP BY g, lev, k // 2),
    s AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS k, count(*) OVER () AS n FROM t WHERE n = 1),
    u AS (SELECT 0 AS lev, k, n, h FROM s
          UNION ALL
          SELECT lev + 1, k // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY k)) FROM u WHERE n > 1 GROUP BY lev, k // 2),
    a AS (SELECT g, 0 AS lev, k, n, leaf, '' AS proof, coalesce(other, leaf) AS f, doc_id, k AS k0 FROM r
          UNION ALL
          SELECT a.g, a.lev + 1, a.k // 2, (a.n + 1) // 2, a.leaf, a.proof || coalesce(b.h, ''),
                 sha256(CASE WHEN a.k % 2 = 0 THEN a.f || coalesce(b.h, '') ELSE b.h || a.f END), a.doc_id, a.k0
          FROM a LEFT JOIN t b ON b.g = a.g AND b.lev = a.lev AND b.k = xor(a.k, 1) WHERE a.n > 1),
    b AS (SELECT 0 AS lev, s.k, s.n, a.leaf, a.proof, a.f, a.doc_id, s.h AS subroot
          FROM a JOIN s ON a.g = s.g WHERE a.n = 1
          UNION ALL
          SELECT b.lev + 1, b.k // 2, (b.n + 1) // 2, b.leaf, b.proof || coalesce(c.h, ''),
                 sha256(CASE WHEN b.k % 2 = 0 THEN b.f || coalesce(c.h, '') ELSE c.h || b.f END), b.doc_id, b.subroot
          FROM b LEFT JOIN u c ON c.lev = b.lev AND c.k = xor(b.k, 1) WHERE b.n > 1)
    SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified
    FROM b, (SELECT h AS root FROM u WHERE n = 1) WHERE n = 1"""
