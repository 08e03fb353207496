"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

_WS = r"[\x20\x09-\x0D]"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINE_DEDUP = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k FROM lines
), held AS (
  SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT doc_id, pos, line, first IS NOT NULL AND doc_id <> first AS gone FROM keyed LEFT JOIN held USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

SUBSTRING = rf"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^{_WS[1:-1]}]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35)
), repeated AS (SELECT win FROM windows GROUP BY win HAVING count(*) > 1
), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM windows SEMI JOIN repeated USING (win)
), words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM docs
), judged AS (
  SELECT words.doc_id, count(gone.p) AS n_removed,
         string_agg(word, ' ' ORDER BY words.p) FILTER (gone.p IS NULL) AS kept
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p GROUP BY words.doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN judged USING (doc_id)
"""

WARC = """
WITH page AS (
  SELECT page_id, coalesce(html, '') AS body, sha256(coalesce(html, '')) AS digest,
         strlen(coalesce(html, '')) AS n FROM pages
), firsts AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM page)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to, true AS complete
FROM firsts
"""

DECONTAMINATE = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, list_slice(w, i, i + least(10, len(w)) - 1) AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM item_windows), places AS (
  SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n)
), hits AS (SELECT doc_id, i, n, item_id FROM places JOIN item_windows USING (n, win)
), hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY 1
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

CHAT = """
WITH said AS (
  SELECT conv_id, turn, coalesce(floor(turn / 64.0)::BIGINT, -1) AS part,
         CASE WHEN coalesce(role, '') = '' THEN 'unknown' ELSE replace(role, '<|im_', '< |im_') END AS name,
         replace(coalesce(text, ''), '<|im_', '< |im_') AS said
  FROM conversations
), speakers AS (SELECT DISTINCT conv_id, name AS perspective FROM said WHERE name <> 'system'), lines AS (
  SELECT s.conv_id, perspective, part, turn, name, said,
         '<|im_start|>' || CASE WHEN name = perspective THEN 'assistant' WHEN name = 'system' THEN 'system'
                           ELSE 'user name=' || name END || chr(10) AS head
  FROM said s JOIN speakers p ON s.conv_id IS NOT DISTINCT FROM p.conv_id
), placed AS (
  SELECT *, head || said || '<|im_end|>' || chr(10) AS line,
         sum(length(head || said) + 11) OVER (PARTITION BY conv_id, perspective, part ORDER BY turn, name, said
             ROWS UNBOUNDED PRECEDING)::BIGINT - 1 AS stop
  FROM lines
)
SELECT conv_id, perspective, part, count(*) AS n_turns,
       string_agg(line, '' ORDER BY turn, name, said) AS rendered,
       coalesce(string_agg((stop - length(said) - 10) || ':' || stop, ',' ORDER BY turn, name, said)
                FILTER (name = perspective), '') AS mask
FROM placed GROUP BY conv_id, perspective, part
"""


def _mixing() -> str:
    from ledgerlake.llm import mixing
    from ledgerlake.llm.queries import LANG_TARGETS, SOURCE_TARGETS, TOPIC_TARGETS

    targets = dict(zip(mixing.MARGINS, (SOURCE_TARGETS, LANG_TARGETS, TOPIC_TARGETS)))

    def named(column: str, values) -> str:
        return f"CASE WHEN {column} IN ({', '.join(map(repr, values))}) THEN {column} ELSE 'other' END"

    topic = " ".join(
        f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{name}'" for name, p in mixing.TOPIC_RULES
    )
    parts = [
        f"""tagged AS (
  SELECT doc_id, text, {named('source', SOURCE_TARGETS)} AS mix_source, {named('lang', LANG_TARGETS)} AS mix_lang,
         CASE {topic} ELSE '{mixing.DEFAULT_TOPIC}' END AS mix_topic,
         len(regexp_extract_all(coalesce(text, ''), '[^{_WS[1:-1]}]+'))::BIGINT AS mix_tokens
  FROM documents
)""",
        "cells AS (SELECT mix_source, mix_lang, mix_topic, sum(mix_tokens)::DOUBLE AS tokens FROM tagged GROUP BY ALL)",
    ]
    goals = []
    for margin, shares in targets.items():
        values = ", ".join(f"('{v}', {x!r})" for v, x in shares.items())
        parts.append(
            f"""goal_{margin} AS (
  SELECT {margin}, own, CASE WHEN share IS NULL THEN own ELSE share / (sum(share) FILTER (own > 0) OVER ())
         * (sum(own) OVER () - coalesce(sum(own) FILTER ({margin} = 'other') OVER (), 0)) END AS goal_{margin}
  FROM (SELECT {margin}, sum(tokens) AS own FROM cells GROUP BY 1) LEFT JOIN (VALUES {values}) AS t({margin}, share) USING ({margin})
)"""
        )
        goals.append(f"JOIN goal_{margin} USING ({margin})")
    parts.append(
        f"w0 AS (SELECT c.*, tokens * {mixing.KEEP_SHARE} AS weight, {', '.join('goal_' + m for m in targets)} FROM cells c {' '.join(goals)})"
    )
    last = "w0"
    for sweep in range(mixing.SWEEPS):
        for margin in targets:
            name = f"w{sweep}_{margin}"
            now = f"sum(weight) OVER (PARTITION BY {margin})"
            parts.append(
                f"{name} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN {now} > 0 THEN weight * (goal_{margin} * {mixing.KEEP_SHARE}) / {now} ELSE 0 END AS weight) FROM {last})"
            )
            last = name
        name = f"w{sweep + 1}"
        parts.append(f"{name} AS MATERIALIZED (SELECT * REPLACE (least(weight, tokens) AS weight) FROM {last})")
        last = name
    parts.append(f"rates AS (SELECT mix_source, mix_lang, mix_topic, CASE WHEN tokens > 0 THEN weight / tokens ELSE {mixing.KEEP_SHARE} END AS keep_p FROM {last})")
    return f"""WITH {', '.join(parts)}
SELECT doc_id, mix_source, mix_lang, mix_topic, mix_tokens, round(keep_p, 9) AS keep_p,
       ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 13))::BIGINT / {float(1 << 52)!r} < keep_p AS kept
FROM tagged JOIN rates USING (mix_source, mix_lang, mix_topic)
"""


def _clusters(k: int = 8, rounds: int = 10, dim: int = 64) -> str:
    """Plain rounds: every vector against every centroid."""
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}
)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY digest NULLS LAST, q) - 1 AS cluster, q
  FROM (SELECT sha256('3:' || vec_id::VARCHAR) AS digest, q FROM kept) ORDER BY digest NULLS LAST, q LIMIT {k}
)""",
    ]
    for r in range(rounds + 1):
        distance = f"list_sum(list_transform(range(1, {dim + 1}), lambda i: (kept.q[i] - c{r}.q[i]) * (kept.q[i] - c{r}.q[i])))::BIGINT"
        parts.append(
            f"""a{r} AS MATERIALIZED (
  SELECT n, any_value(vec_id) AS vec_id, any_value(q) AS q, (best % {k})::INTEGER AS cluster, best // {k} AS distance
  FROM (SELECT n, kept.vec_id, kept.q, min({distance} * {k} + cluster) OVER (PARTITION BY n) AS best FROM kept, c{r}) GROUP BY n, best
)"""
        )
        if r == rounds:
            break
        parts.append(
            f"""m{r} AS (
  SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS q
  FROM (SELECT cluster, i, sum(q[i]) AS s, count(*) AS n FROM (SELECT cluster, q, unnest(range(1, {dim + 1})) AS i FROM a{r}) GROUP BY cluster, i) GROUP BY cluster
), c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN m{r} m USING (cluster))"""
        )
    return f"""WITH {', '.join(parts)}
SELECT vec_id, a.cluster, distance, sum(distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia,
       sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.cluster = c.cluster
"""


#: CRC-32 of the decimal text of an id, a byte and a bit at a time.
_CRC32 = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""

TRIE = f"""
WITH said AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS n
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC32} % 6 AS h FROM (SELECT DISTINCT conv_id FROM said)
), rebuilt AS (
  SELECT c.conv_id, 0 AS part, n, role, text FROM convs c JOIN said s ON s.conv_id = c.base AND n < h
  UNION ALL SELECT c.conv_id, 1, n, role, text FROM convs c JOIN said s ON s.conv_id = c.conv_id AND n >= h
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, n) AS d, role, text FROM rebuilt
), paths AS MATERIALIZED (
  SELECT conv_id, d, length(text) AS chars, md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '')
         OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING)) AS node FROM turns
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM convs
), nodes AS (
  SELECT node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars FROM paths GROUP BY node, d
), edges AS (
  SELECT DISTINCT p.node, q.node AS parent FROM paths p JOIN paths q ON p.conv_id = q.conv_id AND q.d = p.d - 1
), kids AS (SELECT parent AS node, count(*) AS n_children FROM edges GROUP BY parent
), own AS (
  SELECT node, n_children IS NULL AS leaf, (n_convs - 1) * chars AS saved FROM nodes LEFT JOIN kids USING (node)
), pairs AS (
  SELECT DISTINCT q.node AS top, p.node FROM paths p JOIN paths q ON p.conv_id = q.conv_id AND q.d <= p.d
), totals AS (
  SELECT top AS node, count(*) FILTER (leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM pairs JOIN own USING (node) GROUP BY top
), ends AS (
  SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, arg_max(node, d) AS node FROM paths GROUP BY conv_id) GROUP BY node
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens,
       sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n JOIN totals USING (node) LEFT JOIN kids USING (node) LEFT JOIN ends USING (node)
LEFT JOIN edges USING (node) LEFT JOIN nodes p ON p.node = edges.parent
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": SUBSTRING,
        "op5_mixing": _mixing(),
        "op6_decontaminate": DECONTAMINATE,
        "op7_warc": WARC,
        "op9_line_dedup": LINE_DEDUP,
        "op10_chat": CHAT,
        "op11_clusters": _clusters(),
        "op12_prefix_trie": TRIE,
    }
