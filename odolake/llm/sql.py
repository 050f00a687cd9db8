"""What SQL can say of the queries: DuckDB text over the whole tables."""

from __future__ import annotations

_REACHED = """
, reached(node, root) AS (
    SELECT node, node FROM nodes
    UNION
    SELECT l.b, r.root FROM reached r JOIN links l ON l.a = r.node
)
, components AS (SELECT node, min(root) AS component_id FROM reached GROUP BY node)
"""

SQL = {
    "op3_minhash_near_dedup": rf"""
    WITH RECURSIVE split AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ), shingles AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
        FROM split
    ), sizes AS (
        SELECT d.doc_id, count(s) AS n FROM documents d LEFT JOIN shingles USING (doc_id) GROUP BY d.doc_id
    ), nodes AS (SELECT doc_id AS node FROM sizes)
    , common AS (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
    ), links AS (
        SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
    ){_REACHED}
    SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN components ON node = doc_id
    """,
    "op6_embedding_near_dedup": f"""
    WITH RECURSIVE nodes AS (SELECT vec_id AS node FROM embeddings), links AS (
        SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id <> y.vec_id
        WHERE list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) >= 0.93
    ){_REACHED}
    SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
    FROM embeddings JOIN components ON node = vec_id
    """,
    "op11_fill_in_middle": r"""
    WITH cut AS (
        SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens,
            sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
        FROM documents
    ), drawn AS (
        SELECT doc_id, text, tokens, len(tokens) AS n, list_transform([1, 2, 3, 4], lambda i: CAST('0x' || substr(h, 8 * i - 7, 8) AS BIGINT)) AS h FROM cut
    ), formed AS (
        SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS one, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS two,
            CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
                WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
        FROM drawn
    ), parts AS (
        SELECT *, array_to_string(tokens[1:one], '') AS prefix, array_to_string(tokens[one + 1:two], '') AS middle, array_to_string(tokens[two + 1:n], '') AS suffix
        FROM formed
    )
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
            ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
    FROM parts
    """,
    "op12_source_divergence": r"""
    WITH docs AS (
        SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found
        FROM documents
    ), words AS (
        SELECT row, lang, source, translate(unnest(found), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs
    ), kept AS (SELECT lang, term, count(*) AS c FROM words GROUP BY ALL HAVING count(DISTINCT row) >= 10)
    , counts AS (SELECT lang, source, term, count(*) AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL)
    , langs AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang)
    , sizes AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL)
    , groups AS (
        SELECT lang, source, coalesce(s.n, 0) AS n, coalesce(l.v, 0) AS v FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN sizes s USING (lang, source) LEFT JOIN langs l USING (lang)
    ), shares AS (
        SELECT lang, g.source, term, coalesce(c.c, 0) AS c, CAST(1 + 1000000000 * (coalesce(c.c, 0) + 2) // (g.n + 2 * g.v) AS BIGINT) AS p
        FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)
    ), wholes AS (SELECT lang, term, CAST(1 + 1000000000 * (c + 2) // (n + 2 * v) AS BIGINT) AS q FROM kept JOIN langs USING (lang))
    , sums AS (
        SELECT lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
        FROM shares x JOIN shares y USING (lang, term) WHERE x.source <> y.source GROUP BY ALL
    ), parts AS (
        SELECT lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
        FROM groups x JOIN groups y USING (lang) LEFT JOIN sums s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source WHERE x.source <> y.source
        UNION ALL
        SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares JOIN wholes USING (lang, term) WHERE c > 0 AND p > q
    )
    SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts
    QUALIFY part = 'pair' OR rank <= 10
    """,
    "op13_sharding": """
    WITH RECURSIVE steps(b, k, v) AS (
        SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
        UNION ALL
        SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8
    ), crc AS (SELECT list(v ORDER BY b) AS t FROM steps WHERE k = 8)
    , docs AS (
        SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS key, octet_length(encode(coalesce(text, ''))) + 16 AS size,
            xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT))),
                lambda a, x: xor(t[xor(a & 255, x) + 1], a >> 8)), 4294967295) AS text_crc32
        FROM documents, crc
    ), scores AS (SELECT *, list_transform(range(41), lambda i: CAST('0x' || substr(md5(key || ':' || i), 1, 13) AS BIGINT)) AS u FROM docs)
    , dealt AS (
        SELECT *, CAST(list_position(u, list_max(u[1:40])) - 1 AS INTEGER) AS shard, CAST(list_position(u, list_max(u)) - 1 AS INTEGER) AS grown_shard FROM scores
    )
    SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, shard,
        row_number() OVER (PARTITION BY shard ORDER BY md5(key), doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
    FROM dealt
    """,
}
