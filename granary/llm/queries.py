"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from granary.llm import decontaminate, divergence, language_id, merkle, near_dedup, quality_model, quality_rules, sharding, spiece, topk, toxicity, url_filter, warc

QUERIES = {
    "op1_template_decontamination": decontaminate.op1_template_decontamination,
    "op2_weak_quality_rules": quality_rules.op2_weak_quality_rules,
    "op3_weak_label_quality": quality_model.op3_weak_label_quality,
    "op4_piece_transducer": spiece.op4_piece_transducer,
    "op5_compression_toxicity": toxicity.op5_compression_toxicity,
    "op6_redirect_classes": url_filter.op6_redirect_classes,
    "op7_warc_salvage": warc.op7_warc_salvage,
    "op8_bigru_language": language_id.op8_bigru_language,
    "op9_best_fit_shards": sharding.op9_best_fit_shards,
    "op10_prob_minhash": near_dedup.op10_prob_minhash,
    "op11_merkle_blocks": merkle.op11_merkle_blocks,
    "op12_wide_term_divergence": divergence.op12_wide_term_divergence,
    "op13_block_pruned_topk": topk.op13_block_pruned_topk,
    # Parts of the second and the ninth that SQL can express.
    "quality_rule_counts": quality_rules.quality_rule_counts,
    "shard_report": sharding.shard_report,
    "shard_sizes": sharding.shard_sizes,
}

#: Classes of near duplicates by comparing all shingles and closing the links.
_NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rn, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT rn, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS g FROM w WHERE len(w) > 0
), n AS (
  SELECT rn, count(*) AS n FROM s GROUP BY rn
), c AS (
  SELECT x.rn AS a, y.rn AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.rn < y.rn GROUP BY 1, 2
), l AS (
  SELECT a, b FROM c JOIN n x ON x.rn = a JOIN n y ON y.rn = b WHERE c + 1e-9 >= 0.8 * (x.n + y.n - c)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(a, b) AS (
  SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
)
SELECT w.doc_id, CASE WHEN m.a IS NULL THEN w.doc_id ELSE least(w.doc_id, m.first) END AS class_id
FROM w LEFT JOIN (SELECT r.a, min(o.doc_id) AS first FROM r JOIN w o ON o.rn = r.b GROUP BY r.a) m ON m.a = w.rn
"""

#: Rules in SQL; aliases are the closure of all canonical and refresh links, resolved as the operator resolves them.
_URL_SQL = r"""
WITH RECURSIVE u AS (
  SELECT page_id, url, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
links AS (
  SELECT url, path, regexp_extract(url, '(?s)^(.*?)://', 1) AS scheme, regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) AS own, trim(replace(unnest(list_concat(
    list_transform(regexp_extract_all(html, '(?is)<link\b[^>]*[\s"''/]rel\s*=\s*["'']?canonical\b[^>]*>'), lambda t: regexp_extract(t, '(?is)[\s"''/]href\s*=\s*["'']?([^"''\s>]+)', 1)),
    list_transform(regexp_extract_all(html, '(?is)<meta\b[^>]*[\s"''/]http-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda t: regexp_extract(t, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)))), '&amp;', '&')) AS link
  FROM u WHERE contains(url, '://')
), resolved AS (
  SELECT url, CASE WHEN starts_with(link, '//') THEN scheme || ':' || link WHEN starts_with(link, '/') THEN scheme || '://' || own || link
    WHEN starts_with(link, '?') THEN scheme || '://' || own || path || link WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
    ELSE scheme || '://' || own || (CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '(?s)^(.*/)?') END) || link END AS target
  FROM links WHERE link <> '' AND NOT starts_with(link, '#')
), ends AS (
  SELECT url, target FROM resolved UNION ALL SELECT url, url FROM u WHERE contains(url, '://')
), nodes AS (
  SELECT DISTINCT x, translate(regexp_extract(x, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || (CASE WHEN regexp_extract(x, '(?s)^.*?://[^/?#]*([^#]*)', 1) = '' THEN '/' ELSE regexp_extract(x, '(?s)^.*?://[^/?#]*([^#]*)', 1) END) AS node
  FROM (SELECT url AS x FROM ends UNION SELECT target FROM ends)
), named AS (
  SELECT DISTINCT s.node AS a, t.node AS b FROM resolved JOIN nodes s ON s.x = url JOIN nodes t ON t.x = target WHERE s.node <> t.node
), both_ways AS (
  SELECT a, b FROM named UNION SELECT b, a FROM named
), reached(a, b) AS (
  SELECT a, b FROM both_ways UNION SELECT reached.a, both_ways.b FROM reached JOIN both_ways ON reached.b = both_ways.a
), ruled AS (
  SELECT node, arg_max(v, length(h || p)) AS verdict FROM (SELECT DISTINCT node, regexp_extract(node, '(?s)^([^/?#]*)', 1) AS host, regexp_extract(node, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM nodes) k
  JOIN rules ON (k.host = h OR ends_with(k.host, '.' || h)) AND starts_with(k.path, p) GROUP BY node
), aliased AS (
  SELECT a AS node, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' ELSE 'block' END AS verdict FROM reached JOIN ruled ON ruled.node = b GROUP BY a
), own AS (
  SELECT page_id, host, path, url, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM u LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL
)
SELECT page_id, host, path, rule, coalesce(own.verdict, aliased.verdict, 'allow') AS verdict FROM own LEFT JOIN nodes ON nodes.x = own.url LEFT JOIN aliased ON aliased.node = nodes.node
"""

#: What has to come back from the archives; base32 from the bits of the digest.
_WARC_SQL = """
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT *, array_to_string(list_transform(string_split(hex, ''), lambda x: lpad(to_base(strpos('0123456789abcdef', x) - 1, 2), 4, '0')), '') AS bits, max(page_id) OVER (PARTITION BY hex) AS latest FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
    + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN latest IS NULL OR page_id = latest THEN 'response' ELSE 'revisit' END AS record_type, (CASE WHEN page_id IS DISTINCT FROM latest THEN latest END)::BIGINT AS refers_to FROM b
"""

#: The counts that the quality rules look at.
_COUNTS_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 6)) AS p, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(list_slice(w, i, i + 7), ' '))) AS g FROM d WHERE len(w) >= 8
), twice AS (
  SELECT doc_id, p FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p + k) AS n FROM twice, range(0, 8) r(k) GROUP BY doc_id
), counts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN covered USING (doc_id)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts
"""

#: What the shards have to be, whatever goes where.
_SHARDS_SQL = """
SELECT count(*) AS n_rows, sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS bytes, 8::BIGINT AS shards, true AS gapless, true AS even, true AS copies_together FROM documents
"""
_SIZES_SQL = "SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size FROM documents"



def _merkle_sql(low: int = 5, high: int = 4) -> str:
    """The tree level by level: low levels below the subroots (16^low leaves a source at most), high ones above them."""
    field = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    # crc32 of the id as text: each byte is mixed in, then eight steps of one bit.
    turns = "list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])))"
    crc = f"xor(list_reduce({turns}, lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295)"
    parts = [
        f"""p AS (SELECT doc_id, coalesce('=' || source, '') AS g, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {leaf('text')} END AS other FROM documents)""",
        "d AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM p)",
        "s0 AS (SELECT g, i, leaf AS h FROM d)",
    ]

    def levels(name: str, n: int) -> None:
        for k in range(n):
            parts.append(f"{name}c{k} AS (SELECT g, count(*) AS n FROM {name}{k} GROUP BY g)")
            parts.append(f"{name}{k + 1} AS (SELECT g, i // 16 AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h FROM {name}{k} JOIN {name}c{k} USING (g) GROUP BY g, i // 16)")
            parts.append(f"{name}p{k} AS (SELECT x.g, x.i, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS l, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS r, any_value(n) > 1 AS there FROM {name}{k} x JOIN {name}{k} y ON x.g = y.g AND x.i // 16 = y.i // 16 JOIN {name}c{k} c ON c.g = x.g GROUP BY x.g, x.i)")

    levels("s", low)
    parts.append(f"r0 AS (SELECT '' AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS i, h, g AS source FROM s{low})")
    levels("r", high)
    parts.append("way0 AS (SELECT d.doc_id, d.leaf, d.g, d.i, d.other AS node, '' AS proof FROM d)")
    for k in range(low):
        parts.append(f"way{k + 1} AS (SELECT w.doc_id, w.leaf, w.g, w.i // 16 AS i, CASE WHEN there THEN sha256(l || node || r) ELSE node END AS node, proof || l || r AS proof FROM way{k} w JOIN sp{k} p ON p.g = w.g AND p.i = w.i)")
    parts.append(f"up0 AS (SELECT w.doc_id, w.leaf, r0.h AS subroot, r0.i, w.node, w.proof FROM way{low} w JOIN r0 ON r0.source = w.g)")
    for k in range(high):
        parts.append(f"up{k + 1} AS (SELECT w.doc_id, w.leaf, w.subroot, w.i // 16 AS i, CASE WHEN there THEN sha256(l || node || r) ELSE node END AS node, proof || l || r AS proof FROM up{k} w JOIN rp{k} p ON p.i = w.i)")
    return "WITH " + ", ".join(parts) + f" SELECT doc_id, leaf, subroot, r{high}.h AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = r{high}.h AS verified FROM up{high}, r{high}"


#: All terms of all groups against each other.
_TERMS_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rn, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), w AS (
  SELECT rn, lang, source, unnest(t) AS term FROM d
), kept AS (
  SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT rn) >= 3
), c AS (
  SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY ALL
), g AS (
  SELECT DISTINCT lang, source FROM d
), v AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), n AS (
  SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL
), p AS (
  SELECT lang, source, term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1)) // (coalesce(n, 0) + v) AS p
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source) LEFT JOIN c USING (lang, source, term)
), q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 1)) // (any_value(n) + any_value(v)) AS q FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS n FROM n GROUP BY lang) USING (lang) GROUP BY lang, term
), pairs AS (
  SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
), parts AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pairs z ON z.lang = x.lang AND z.source = x.source AND z.item = y.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q
)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INT AS rank FROM parts QUALIFY part = 'pair' OR rank <= 200
"""

#: All products of queries and rows.
_TOP_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), s AS (
  SELECT q.rn, q.vec_id AS query_id, e.vec_id, list_inner_product(q.v, e.v)::BIGINT AS score FROM e q JOIN e ON q.vec_id % 20 = 0 AND q.rn <> e.rn
)
SELECT query_id, (row_number() OVER (PARTITION BY rn ORDER BY score DESC, vec_id NULLS LAST))::INT AS rank, vec_id, score FROM s QUALIFY rank <= 20
"""

ORACLE_SQL: dict[str, str] = {
    "quality_rule_counts": _COUNTS_SQL,
    "shard_report": _SHARDS_SQL,
    "shard_sizes": _SIZES_SQL,
    "op6_redirect_classes": _URL_SQL,
    "op7_warc_salvage": _WARC_SQL,
    "op10_prob_minhash": _NEAR_SQL,
    "op11_merkle_blocks": _merkle_sql(),
    "op12_wide_term_divergence": _TERMS_SQL,
    "op13_block_pruned_topk": _TOP_SQL,
}
