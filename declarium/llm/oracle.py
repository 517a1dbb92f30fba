"""Check SQL for DuckDB, where SQL can express a query of this package."""

EXACT_TOP_K = """
WITH v AS (
    SELECT vec_id,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vector
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, v.vec_id AS vec_id,
        CAST(list_sum(list_transform(list_zip(q.vector, v.vector), lambda p: p[1] * p[2])) AS BIGINT)
            AS score
    FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) q JOIN v ON q.vec_id <> v.vec_id
)
SELECT query_id,
    CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id, score
FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

# CRC-32 by its table, over a list of byte values.
CRC_TABLE = """crc_table AS MATERIALIZED (
    SELECT list(value ORDER BY i) AS crc FROM (
        SELECT i, list_reduce(list_prepend(i, range(8)),
            lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS value
        FROM (SELECT unnest(range(256)) AS i)))"""


def crc32(text: str) -> str:
    """CRC-32 of a text whose code points are below U+0100, beside the table ``crc``."""
    codes = f"list_transform(string_split({text}, ''), lambda x: unicode(x))"
    octets = f"flatten(list_transform({codes}, lambda u: CASE WHEN u < 128 THEN [CAST(u AS BIGINT)] " \
        "WHEN u < 192 THEN [194, CAST(u AS BIGINT)] ELSE [195, CAST(u AS BIGINT) - 64] END))"
    return f"""xor(list_reduce(list_prepend(4294967295, {octets}),
        lambda c, b: xor(c // 256, crc[xor(c % 256, b) + 1])), 4294967295)"""


SPELLING_VARIANTS = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
    SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run,
        count(*) AS times
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run
        FROM documents)
    WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (
    SELECT run, times, {crc32("doc_id || ':' || run")} AS h FROM runs, crc_table),
garbled AS (
    SELECT CASE WHEN h % 31 = 0
            THEN left(run, h % length(run)) || substring(run, h % length(run) + 2)
            ELSE run END AS word, times
    FROM hashed),
words AS MATERIALIZED (
    SELECT word, CAST(sum(times) AS BIGINT) AS n FROM garbled
    WHERE length(word) >= 7 GROUP BY 1 HAVING sum(times) >= 2),
holes AS MATERIALIZED (
    SELECT word, i, left(word, i - 1) || substring(word, i + 1) AS rest
    FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
    SELECT a.word, b.word AS other FROM holes a JOIN holes b USING (rest, i) WHERE a.word <> b.word
    UNION SELECT h.word, w.word FROM holes h JOIN words w ON h.rest = w.word
    UNION SELECT w.word, h.word FROM holes h JOIN words w ON h.rest = w.word),
best AS MATERIALIZED (
    SELECT near.word, count(*) AS n_near, max(o.n) AS top,
        arg_min(other, (-o.n, other)) AS form
    FROM near JOIN words o ON other = o.word GROUP BY 1),
found AS MATERIALIZED (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * n THEN form END AS form,
        CASE WHEN top >= 10 * n THEN top END AS form_n
    FROM words LEFT JOIN best USING (word)),
steps AS (
    SELECT word, word AS root FROM found
    UNION ALL SELECT steps.word, found.form FROM steps JOIN found ON found.word = root
    WHERE found.form IS NOT NULL),
roots AS (
    SELECT steps.word, root FROM steps JOIN found ON found.word = root WHERE found.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM found JOIN roots USING (word)
"""

CONVERSATION_TRIE = f"""
WITH {CRC_TABLE},
turns AS (
    SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
    FROM conversations WHERE conv_id IS NOT NULL),
own AS MATERIALIZED (
    SELECT conv_id, list(said ORDER BY place) AS said, any_value(h) AS h
    FROM turns JOIN (
        SELECT DISTINCT conv_id, {crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h
        FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), crc_table)
        USING (conv_id)
    GROUP BY 1),
built AS (
    SELECT own.conv_id, list_concat(coalesce(first.said[:own.h], []), own.said[own.h + 1:]) AS path
    FROM own LEFT JOIN own AS first ON first.conv_id = own.conv_id - own.conv_id % 5),
members AS (
    SELECT conv_id, path, d, path[:d] AS node
    FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM built)),
nodes AS MATERIALIZED (
    SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
            FILTER (WHERE len(path) = d), '')) AS ends_sha256
    FROM members GROUP BY ALL),
children AS (
    SELECT node[:d - 1] AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
own_part AS (
    SELECT node, d, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf,
        CASE WHEN d > 0 THEN (n_convs - 1) * strlen(node[d].text) ELSE 0 END AS saved
    FROM nodes LEFT JOIN children USING (node)),
below AS (
    SELECT node[:k] AS node, CAST(sum(leaf) AS BIGINT) AS n_leaves,
        CAST(sum(saved) AS BIGINT) AS saved_tokens
    FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM own_part) GROUP BY 1)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs,
    coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN below USING (node) LEFT JOIN children USING (node)
    LEFT JOIN nodes p ON n.d > 0 AND p.d = n.d - 1 AND p.node = n.node[:n.d - 1]
"""

LLM_ORACLE: dict[str, str] = {
    "op3_exact_top_k": EXACT_TOP_K,
    "op11_spelling_variants": SPELLING_VARIANTS,
    "op12_conversation_trie": CONVERSATION_TRIE,
}
