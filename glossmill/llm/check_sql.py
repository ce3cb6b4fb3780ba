"""SQL for a second engine, where SQL can say what an operator does: plain windows, without index or minimiser."""

from __future__ import annotations

from glossmill.llm.fm_index import WINDOW as TEST_WINDOW
from glossmill.llm.induced import WINDOW as BYTES
from glossmill.llm.merkle import FANOUT, FIELDS
from glossmill.llm.superkmers import WINDOW
from glossmill.llm.vector_links import COSINE

SPACES = r"[ \t\n\x0b\f\r]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered_words(text: str) -> str:
    return f"regexp_extract_all(translate({text}, '{UPPER}', '{LOWER}'), '{WORD}')"


def merkle_leaf(**other: str) -> str:
    """SQL of a row's leaf, some fields given by another expression."""
    texts = [f"({other.get(f, f)})::VARCHAR" for f in FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen({t}) || ':' || {t}, '-')" for t in texts) + ")"


# The standard reflected polynomial of CRC-32, from which the table of its 256 bytes follows.
CRC_POLYNOMIAL = 0xEDB88320
CRC_TABLE = "list_transform(range(256), lambda b: " + "list_reduce([b::BIGINT] || range(8), lambda c, i: " + (
    f"CASE WHEN c & 1 = 1 THEN xor(c >> 1, {CRC_POLYNOMIAL}) ELSE c >> 1 END))")


def merkle_levels(name: str, start: str) -> str:
    """Recursive tables of nodes (tree, level, pos, digest, n nodes on the level) from the nodes of level 0."""
    return f"""{name} AS ({start} UNION ALL
          SELECT tree, level + 1, pos // {FANOUT}, sha256(string_agg(digest, '' ORDER BY pos)), (n + {FANOUT - 1}) // {FANOUT}
          FROM {name} WHERE n > 1 GROUP BY tree, level, pos // {FANOUT}, n)"""


def merkle_steps(source: str) -> str:
    """Siblings of each node of a run, as text before and behind it."""
    run = f"(PARTITION BY tree, level, pos // {FANOUT} ORDER BY pos ROWS BETWEEN"
    return f"""SELECT tree, level, pos, pos // {FANOUT} AS up,
          coalesce(string_agg(digest, '') OVER {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
          coalesce(string_agg(digest, '') OVER {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS behind
        FROM {source} WHERE n > 1"""


SQL = {
    "op8_superkmer_dedup": f"""
        WITH w AS (SELECT row_number() OVER () AS rid, doc_id,
                     list_filter(string_split_regex(coalesce(text, ''), '{SPACES}'), lambda x: x <> '') AS ws FROM documents),
        seen AS (SELECT rid, unnest(hs) AS h, generate_subscripts(hs, 1) AS i FROM (
                   SELECT rid, list_transform(range(1, len(ws) - {WINDOW - 2}),
                     lambda i: md5(array_to_string(ws[i : i + {WINDOW - 1}], ' '))) AS hs FROM w)),
        twice AS (SELECT h FROM seen GROUP BY h HAVING count(*) > 1),
        gone AS (SELECT DISTINCT rid, i + o AS p FROM (SELECT rid, i FROM seen SEMI JOIN twice USING (h)),
                   (SELECT unnest(range(0, {WINDOW})) AS o)),
        kept AS (SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS k FROM (
                   SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w) ANTI JOIN gone USING (rid, p) GROUP BY rid)
        SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
               sha256(coalesce(k, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (rid)""",
    "op1_fm_index_decontamination": f"""
        WITH w AS (SELECT row_number() OVER () AS rid, doc_id, {lowered_words("coalesce(text, '')")} AS ws FROM documents),
        item AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {lowered_words("text")} AS ws FROM benchmark WHERE text IS NOT NULL),
        phrase AS (SELECT DISTINCT item, size, unnest(ps) AS ph FROM (
                     SELECT item, least(len(ws), {TEST_WINDOW}) AS size, list_transform(range(1, greatest(1, len(ws) - {TEST_WINDOW - 1}) + 1),
                       lambda i: array_to_string(ws[i : i + {TEST_WINDOW - 1}], ' ')) AS ps FROM item WHERE len(ws) > 0)),
        seen AS (SELECT rid, size, unnest(ps) AS ph, generate_subscripts(ps, 1) AS i FROM (
                   SELECT rid, size, list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i : i + size - 1], ' ')) AS ps
                   FROM w, (SELECT DISTINCT size FROM phrase) WHERE len(ws) >= size)),
        hit AS (SELECT rid, i, size, item FROM seen JOIN phrase USING (size, ph)),
        covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM hit) GROUP BY rid),
        items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
                  FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM w LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)""",
    "op9_suffix_array_dedup": f"""
        WITH w AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents),
        seen AS (SELECT rid, unnest(hs) AS h, generate_subscripts(hs, 1) - 1 AS i FROM (
                   SELECT rid, list_transform(range(1, n - {BYTES - 2}), lambda i: md5(b[i : i + {BYTES - 1}])) AS hs FROM w)),
        twice AS (SELECT h FROM seen GROUP BY h HAVING count(*) > 1),
        hit AS (SELECT rid, i, coalesce(i - lag(i) OVER (PARTITION BY rid ORDER BY i) > {BYTES}, true) AS fresh FROM seen SEMI JOIN twice USING (h)),
        span AS (SELECT rid, min(i) AS a, max(i) + {BYTES} AS e FROM (
                   SELECT rid, i, count(*) FILTER (fresh) OVER (PARTITION BY rid ORDER BY i) AS run FROM hit) GROUP BY rid, run),
        cut AS (SELECT rid, a, e, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY a), 0) AS p FROM span),
        kept AS (SELECT rid, count(*) AS spans, sum(e - a) AS gone, max(e) AS last, string_agg(hex(b[p + 1 : a]), '' ORDER BY a) AS k
                 FROM cut JOIN w USING (rid) GROUP BY rid)
        SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
               sha256(unhex(coalesce(k, '') || hex(b[coalesce(last, 0) + 1 :]))) AS kept_sha256 FROM w LEFT JOIN kept USING (rid)""",
    "op12_pointer_jumping_manifest": f"""
        WITH RECURSIVE crc AS (SELECT {CRC_TABLE} AS t),
        doc AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS tree, {merkle_leaf()} AS leaf,
                  {merkle_leaf(text=f"translate(text, '{UPPER}', '{LOWER}')")} AS other,
                  xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
                    lambda acc, b: xor(acc >> 8, t[(xor(acc, b) & 255) + 1])), 4294967295) AS code FROM documents, crc),
        placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                     count(*) OVER (PARTITION BY tree) AS size FROM doc),
        {merkle_levels("node", "SELECT tree, 0 AS level, pos, leaf AS digest, size AS n FROM placed")},
        subs AS (SELECT tree, level, digest FROM node WHERE n = 1),
        ranked AS (SELECT *, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM subs),
        {merkle_levels("top", "SELECT '/' AS tree, 0 AS level, pos, digest, n FROM ranked")},
        steps AS ({merkle_steps("node")} UNION ALL {merkle_steps("top")}),
        fold AS (SELECT rid, tree, 0 AS level, pos, CASE WHEN code % 3 = 0 THEN other ELSE leaf END AS digest, '' AS proof FROM placed
          UNION ALL
          SELECT f.rid, coalesce(s.tree, '/'), CASE WHEN s.tree IS NULL THEN 0 ELSE f.level + 1 END, coalesce(s.up, r.pos),
            CASE WHEN s.tree IS NULL THEN f.digest ELSE sha256(s.before || f.digest || s.behind) END,
            f.proof || coalesce(s.before || s.behind, '')
          FROM fold f LEFT JOIN steps s USING (tree, level, pos) LEFT JOIN ranked r ON s.tree IS NULL AND f.tree = r.tree
          WHERE s.tree IS NOT NULL OR f.tree <> '/')
        SELECT p.doc_id, p.leaf, s.digest AS subroot, r.digest AS root, sha256(f.proof) AS proof_sha256, f.digest AS folded_root,
               f.digest = r.digest AS verified
        FROM placed p JOIN subs s USING (tree) JOIN fold f USING (rid) JOIN top r ON r.n = 1 AND f.tree = '/' AND f.level = r.level""",
    "op13_hyperplane_links": f"""
        WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        good AS (SELECT rid, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0
                   AND len(list_filter(e, lambda c: c <> 0)) > 0),
        link AS (SELECT a.rid AS a, b.rid AS b FROM good a JOIN good b ON a.rid <> b.rid AND len(a.e) = len(b.e)
                   WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
        reach AS (SELECT rid AS a, rid AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
        least AS (SELECT reach.a AS rid, min(v.vec_id) AS component_id FROM reach JOIN v ON v.rid = reach.b GROUP BY reach.a)
        SELECT vec_id, (SELECT count(*) FROM link WHERE link.a = v.rid) AS n_links, component_id,
               vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN least USING (rid)""",
}
