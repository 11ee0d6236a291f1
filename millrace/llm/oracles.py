"""DuckDB SQL for the queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + 12], ' ') AS g
  FROM b, unnest(range(1, greatest(1, len(w) - 12) + 1)) t(i) WHERE len(w) > 0),
spot AS (
  SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS g
  FROM d, (SELECT DISTINCT k FROM win), unnest(range(1, len(w) - k + 2)) t(s)),
hit AS (SELECT doc_id, s, win.k AS k, item_id FROM spot JOIN win ON spot.k = win.k AND spot.g = win.g),
cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hit) GROUP BY doc_id),
item AS (
  SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(cover.n, 0) AS n_hit, coalesce(item.n, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(cover.n, 0) > 0 AND 20 * coalesce(cover.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cover ON cover.doc_id = d.doc_id LEFT JOIN item ON item.doc_id = d.doc_id
"""

NEAR_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.vec_id, link.b FROM reach JOIN link ON link.a = reach.other),
least_of AS (SELECT vec_id, min(other) AS c FROM reach GROUP BY vec_id),
degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, coalesce(n, 0) AS n_links, c AS component_id, v.vec_id = c AS kept
FROM v JOIN least_of ON least_of.vec_id = v.vec_id LEFT JOIN degree ON a = v.vec_id
"""

WORD_REPEATS = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
spot AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS g FROM d, unnest(range(1, len(w) - 18)) t(s)),
later AS (SELECT doc_id, s FROM spot QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM later),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS text FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

# The forest finds pairs at the threshold with a recall of 0.99 and better above it.
JACCARD_JOIN = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '\\S+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS x FROM d, unnest(range(1, greatest(1, len(w) - 4) + 1)) t(s) WHERE len(w) > 0),
size AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b, c = x.n AND c = y.n AS same FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
  WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other),
least_of AS (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id),
degree AS (SELECT a, count(*) AS n, min(b) FILTER (same) AS twin FROM link GROUP BY a)
SELECT d.doc_id, least(d.doc_id, coalesce(twin, d.doc_id)) AS class_id, coalesce(n, 0) AS n_links, c AS component_id
FROM d JOIN least_of ON least_of.doc_id = d.doc_id LEFT JOIN degree ON a = d.doc_id
"""


# Enough levels for 8 to the power of 8 leaves a lang, and of 3 langs. A lone node goes up unchanged.
_LEAF_LEVELS, _ROOT_LEVELS = 8, 3


def _merkle_tree(t: str, levels: int) -> str:
    """CTEs from ``{t}0`` (g, i, h, n: node i of n in group g) up, and the siblings of each node."""
    out = []
    for k in range(levels):
        out.append(
            f"{t}{k + 1} AS (SELECT g, i // 8 AS i, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, "
            f"(max(n) + 7) // 8 AS n FROM {t}{k} GROUP BY g, i // 8)"
        )
        out.append(
            f"{t}beside{k} AS (SELECT a.g, a.i, a.n, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, "
            f"coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r "
            f"FROM {t}{k} a JOIN {t}{k} b ON a.g = b.g AND a.i // 8 = b.i // 8 GROUP BY a.g, a.i, a.n)"
        )
    return ",\n".join(out)


def _merkle_fold(t: str, start: str, levels: int, group: str, place: str) -> str:
    """CTEs that extend ``node`` and ``proof`` of each leaf by one level at a time."""
    out, last = [], start
    for k in range(levels):
        out.append(
            f"{t}fold{k} AS (SELECT f.* EXCLUDE (node, proof), CASE WHEN b.n = 1 THEN node ELSE sha256(l || node || r) END AS node, "
            f"proof || l || r AS proof FROM {last} f JOIN {t}beside{k} b ON b.g = f.{group} AND b.i = f.{place} // {8**k})"
        )
        last = f"{t}fold{k}"
    return ",\n".join(out)


_FIELD = "coalesce(CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_HEAD = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# crc32 of the decimal id: eight steps for every digit
_CRC_STEPS = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: [CAST(ascii(d) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
_CRC = f"xor(list_reduce(list_prepend(4294967295, {_CRC_STEPS}), lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295)"

MANIFEST = f"""
WITH named AS (
  SELECT doc_id, lang, sha256({_HEAD} || {_FIELD.format("text")}) AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {_CRC} % 3 = 0 THEN sha256({_HEAD} || {_FIELD.format(_LOWERED)}) END AS other FROM documents),
langs AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS k FROM (SELECT DISTINCT lang FROM named)),
leaf AS (
  SELECT doc_id, leaf, coalesce(other, leaf) AS altered, k, count(*) OVER (PARTITION BY k) AS n,
    row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
  FROM named JOIN langs ON named.lang IS NOT DISTINCT FROM langs.lang),
t0 AS (SELECT k AS g, i, leaf AS h, n FROM leaf),
{_merkle_tree("t", _LEAF_LEVELS)},
u0 AS (SELECT 0 AS g, g AS i, h, (SELECT count(*) FROM langs) AS n FROM t{_LEAF_LEVELS}),
{_merkle_tree("u", _ROOT_LEVELS)},
start AS (SELECT doc_id, leaf, k, i, 0 AS top, altered AS node, '' AS proof FROM leaf),
{_merkle_fold("t", "start", _LEAF_LEVELS, "k", "i")},
{_merkle_fold("u", f"tfold{_LEAF_LEVELS - 1}", _ROOT_LEVELS, "top", "k")}
SELECT doc_id, leaf, t{_LEAF_LEVELS}.h AS subroot, u{_ROOT_LEVELS}.h AS root, sha256(proof) AS proof_sha256, node AS folded_root,
  node = u{_ROOT_LEVELS}.h AS verified
FROM ufold{_ROOT_LEVELS - 1} f JOIN t{_LEAF_LEVELS} ON t{_LEAF_LEVELS}.g = f.k JOIN u{_ROOT_LEVELS} ON u{_ROOT_LEVELS}.g = f.top
"""

_TERM_SCALE = "CAST(1000000000 AS HUGEINT)"
DIVERGENCE = f"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_LOWER}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT k, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
seen AS (SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
grp AS (SELECT DISTINCT lang, source FROM d),
cell AS (SELECT grp.lang, grp.source, kept.term, coalesce(c, 0) AS c FROM grp JOIN kept ON kept.lang = grp.lang
  LEFT JOIN seen ON seen.lang = grp.lang AND seen.source = grp.source AND seen.term = kept.term),
n AS (SELECT lang, source, sum(c) AS n FROM cell GROUP BY lang, source),
p AS (SELECT cell.lang, cell.source, term, c, 1 + ({_TERM_SCALE} * (c + 1)) // (n + v) AS p
  FROM cell JOIN n ON n.lang = cell.lang AND n.source = cell.source JOIN v ON v.lang = cell.lang),
whole AS (SELECT lang, term, sum(c) AS c FROM cell GROUP BY lang, term),
q AS (SELECT whole.lang, term, 1 + ({_TERM_SCALE} * (c + 1)) // (n + v) AS q
  FROM whole JOIN (SELECT lang, sum(n) AS n FROM n GROUP BY lang) m ON m.lang = whole.lang JOIN v ON v.lang = whole.lang),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
term AS (SELECT p.lang, source, p.term AS item, ((p - q) * (p - q)) // q AS value
  FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE c > 0 AND p > q),
every AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
