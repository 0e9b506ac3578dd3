"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    collision_search,
    decontaminate,
    hnsw,
    licenses,
    link_graph,
    minhash,
    packing,
    prefix_trie,
    secret_scan,
    token_alignment,
    tool_calls,
    toxicity,
    wrapper,
)
from .common import table


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.from_turns(table(spark, sf_dir, "conversations"))
    return tool_calls.link(calls, results, tool_calls.turn_schemas(spark))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(table(spark, sf_dir, "pages"))


def op5_hnsw_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.report(table(spark, sf_dir, "embeddings"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known_texts(spark))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.report(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_graph.judge(table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op12_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_documents(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_tool_calls,
        op2_secret_scan,
        op3_best_fit_packing,
        op4_wrapper_induction,
        op5_hnsw_links,
        op6_license_scan,
        op7_order_minhash,
        op8_decontamination,
        op9_link_graph,
        op10_toxicity,
        op11_prefix_trie,
        op12_collision_search,
        op13_token_alignment,
    )
}

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"



def _canonical(column: str) -> str:
    low = f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    form = f"trim(regexp_replace(regexp_replace({low}, '{licenses.COPYRIGHT_LINE}', chr(10), 'g'), '{licenses.SIGNS}', ' ', 'g'))"
    for spelling, chosen in licenses.EQUIVALENT:
        form = f"replace({form}, '{spelling}', '{chosen}')"
    return form


_KNOWN = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in licenses.KNOWN)

ORACLES = {
    "op5_hnsw_links": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
     links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
     reach AS (SELECT vec_id AS u, vec_id AS v FROM v UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
     degree AS (SELECT u, count(*) AS n FROM links GROUP BY u),
     low AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN low ON vec_id = low.u LEFT JOIN degree ON vec_id = degree.u
""",
    "op8_decontamination": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
     b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
     grams AS (SELECT DISTINCT item_id, w[i:i + 9] AS gram, least(len(w), 10) AS n
               FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
     placed AS (SELECT r, i, n, w[i:i + n - 1] AS gram
                FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM grams))),
     hits AS (SELECT r, i, placed.n, item_id FROM placed JOIN grams USING (gram)),
     covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
     named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
               FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
""",
    "op1_tool_calls": """
WITH t AS (SELECT conv_id, turn, role, text, coalesce(length(text), 0) AS size,
                  'call_' || conv_id || '_' || turn AS own, 'call_' || conv_id || '_' || (turn - 1) AS before FROM conversations),
     c AS (SELECT *, ['search', 'translate', 'summarise'][CAST(size % 3 + 1 AS INT)] AS tool FROM t WHERE role = 'user'),
     r AS (SELECT * FROM t WHERE role = 'assistant'),
     needs AS (SELECT DISTINCT conv_id, turn, need FROM (SELECT conv_id, turn, unnest([turn // 2, turn // 3]) AS need FROM c) WHERE need < turn),
     edges AS (SELECT n.* FROM needs n JOIN c ON n.conv_id = c.conv_id AND n.need = c.turn),
     lacking AS (SELECT DISTINCT n.conv_id, n.turn FROM needs n ANTI JOIN c ON n.conv_id = c.conv_id AND n.need = c.turn),
     paths AS (WITH RECURSIVE p AS (SELECT conv_id, turn, 0 AS level FROM c
                                    UNION SELECT e.conv_id, e.turn, p.level + 1 FROM p JOIN edges e ON e.conv_id = p.conv_id AND e.need = p.turn) SELECT * FROM p),
     levels AS (SELECT conv_id, turn, CAST(max(level) AS INT) AS level FROM paths GROUP BY ALL),
     made AS (SELECT c.conv_id, c.turn, own AS call_id, tool, level,
                     concat_ws('; ', CASE WHEN c.size % 7 = 0 THEN 'limit is not integer' END, CASE WHEN c.size % 11 = 0 THEN 'text is missing' END) AS errors,
                     lacking.turn IS NOT NULL AS lacks, r.turn IS NOT NULL AS answered,
                     '{"arguments":{"limit":' || CASE WHEN c.size % 7 = 0 THEN '"' || c.size || '"' ELSE CAST(c.size AS VARCHAR) END
                     || CASE WHEN c.size % 11 = 0 THEN '' ELSE ',"text":' || CAST(to_json(c.text) AS VARCHAR) END
                     || ',"turn":' || c.turn || '},"id":"' || own || '","name":"' || tool || '"}' AS call_json,
                     '{"content":' || CAST(to_json(r.text) AS VARCHAR) || ',"id":"' || own || '"}' AS result_json
              FROM c JOIN levels USING (conv_id, turn) LEFT JOIN lacking USING (conv_id, turn) LEFT JOIN (SELECT conv_id, turn - 1 AS turn, text FROM r) r USING (conv_id, turn))
SELECT conv_id, turn, call_id, tool, level,
       CASE WHEN errors <> '' THEN 'invalid' WHEN lacks THEN 'missing_need' WHEN NOT answered THEN 'unanswered' ELSE 'ok' END AS status, errors, call_json, result_json
FROM made
UNION ALL
SELECT r.conv_id, r.turn, before, NULL, NULL, 'orphan', '', NULL, '{"content":' || CAST(to_json(r.text) AS VARCHAR) || ',"id":"' || before || '"}'
FROM r ANTI JOIN c ON r.conv_id = c.conv_id AND r.turn - 1 = c.turn
""",
    "op6_license_scan": f"""
WITH known AS (SELECT {_canonical("text")} AS form, min(license) AS license FROM (VALUES {_KNOWN}) k(license, text) GROUP BY 1),
     d AS (SELECT row_number() OVER () AS r, doc_id, text, nullif({_canonical("text")}, '') AS form FROM documents),
     parts AS (SELECT DISTINCT r, unnest(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\n[ \t]*\n'))) AS text FROM d),
     notices AS (SELECT r, string_agg(license, ',' ORDER BY license) AS notices, count(*) AS n FROM
                 (SELECT DISTINCT r, license FROM (SELECT r, {_canonical("text")} AS form FROM parts) JOIN known USING (form)) GROUP BY r)
SELECT doc_id, sha256(form) AS digest, license, coalesce(notices, '') AS notices, coalesce(n, 0) AS n_notices
FROM d LEFT JOIN known USING (form) LEFT JOIN notices USING (r)
""",
    "op11_prefix_trie": r"""
WITH codes AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS crc
               FROM range(256) r(i)),
     own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS d
             FROM conversations WHERE conv_id IS NOT NULL),
     convs AS (SELECT conv_id AS c, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
                                       lambda a, b: xor(a // 256, crc[CAST(xor(a, b) & 255 AS INT) + 1])), 4294967295) % 4 AS h
               FROM (SELECT DISTINCT conv_id FROM own), codes),
     turns AS (SELECT c, d, role, text FROM convs JOIN own ON own.conv_id = c - c % 20 AND d <= h
               UNION ALL SELECT c, d - h + (SELECT count(*) FROM own b WHERE b.conv_id = c - c % 20 AND b.d <= h), role, text FROM convs JOIN own ON own.conv_id = c AND d > h),
     lists AS (SELECT convs.c, list(sha256(length(role) || ':' || role || text) ORDER BY d) FILTER (d IS NOT NULL) AS t,
                      list(len(list_filter(regexp_split_to_array(text, '[ 	-
]+'), lambda w: w <> '')) ORDER BY d) FILTER (d IS NOT NULL) AS w
               FROM convs LEFT JOIN turns ON turns.c = convs.c GROUP BY convs.c),
     members AS (SELECT c, depth, coalesce(t, [])[1:depth] AS path, depth = len(coalesce(t, [])) AS ends, CASE WHEN depth > 0 THEN w[depth] ELSE 0 END AS words
                 FROM (SELECT *, unnest(range(0, len(coalesce(t, [])) + 1)) AS depth FROM lists)),
     nodes AS (SELECT path, depth, min(c) AS low, count(*) AS n, max(words) AS words, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '') AS ids
               FROM members GROUP BY path, depth),
     upper AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
     below AS (SELECT a.path, count(*) FILTER (u.n_children IS NULL) AS n_leaves, sum((b.n - 1) * b.words) AS saved
               FROM nodes a JOIN nodes b ON b.depth >= a.depth AND b.path[1:a.depth] = a.path LEFT JOIN upper u ON u.path = b.path GROUP BY a.path)
SELECT nodes.low AS conv_id, nodes.depth, p.low AS parent_conv_id, nodes.n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(nodes.ids) AS ends_sha256
FROM nodes LEFT JOIN nodes p ON nodes.depth > 0 AND p.path = nodes.path[1:nodes.depth - 1] LEFT JOIN upper ON upper.path = nodes.path JOIN below ON below.path = nodes.path
""",
    "op12_collision_search": """
WITH v AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     p AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) AS score
           FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e))
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p) WHERE rank <= 10
""",
}
