"""DuckDB SQL for the operators' queries that SQL can express."""

from __future__ import annotations

from cohortloom.llm.licenses import PHRASES, TEMPLATES

#: Components by a recursive closure over links (a, b) in both directions.
_REACH = """reach(id, other) AS (SELECT a, b FROM both_ways UNION SELECT r.id, l.b FROM reach r JOIN both_ways l ON l.a = r.other)"""

EMBEDDINGS = f"""WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
      AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
    WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.98),
both_ways AS (SELECT DISTINCT a, b FROM links),
{_REACH},
comp AS (SELECT id, least(id, min(other)) AS c FROM reach GROUP BY id)
SELECT e.vec_id, (SELECT count(*) FROM both_ways WHERE a = e.vec_id) AS n_links, coalesce(c, e.vec_id) AS component_id, e.vec_id = coalesce(c, e.vec_id) AS kept
FROM embeddings e LEFT JOIN comp ON comp.id = e.vec_id"""

MINHASH = f"""WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE len(ws) WHEN 0 THEN [] WHEN 1 THEN [ws[1]] ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM inter JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
{_REACH},
comp AS (SELECT id, least(id, min(other)) AS c FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, d.doc_id = coalesce(c, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp ON comp.id = d.doc_id"""


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def licenses() -> str:
    starts = [f"list_filter(range(1, len(ws) - {len(p.split()) - 2}), lambda i: list_slice(ws, i, i + {len(p.split()) - 1}) = {_list(p.split())})" for p in PHRASES]
    marks = [f"CASE WHEN len({s}) > 0 THEN '{label}' END" for s, label in zip(starts, PHRASES.values(), strict=True)]
    templates = ", ".join(f"('{label}', {_list(sorted(set(t.split())))})" for label, t in TEMPLATES)
    words = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    return f"""WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, {words}) AS ws FROM d),
p AS (SELECT doc_id, len(ws) AS n_words, list_sort(list_concat({', '.join(starts)})) AS st, list_filter([{', '.join(marks)}], lambda x: x IS NOT NULL) AS base FROM w),
lines AS (SELECT doc_id, list_distinct(regexp_extract_all(line, {words})) AS held FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
found AS (SELECT doc_id, label, len(list_intersect(held, need)) * 1.0 / len(need) AS share FROM lines, (VALUES {templates}) AS x (label, need)
    WHERE len(held) >= ceil(0.8 * len(need) - 1e-9) AND len(list_intersect(held, need)) >= ceil(0.8 * len(need) - 1e-9)),
more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM found GROUP BY 1)
SELECT p.doc_id, n_words, len(st) AS n_base, st[1] - 1 AS first_word, st[-1] - 1 AS last_word, array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(m.labels, [])))), ',') AS labels, CASE WHEN len(st) > 0 THEN 1.0 ELSE coalesce(m.share, 0.0) END AS score
FROM p LEFT JOIN more m ON m.doc_id = p.doc_id"""


#: CRC-32 of a text of ASCII characters: one step takes a byte in, eight divide.
_CRC = """list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({0}, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)"""


def crc32(text: str) -> str:
    return f"xor({_CRC.format(text)}, 4294967295)"


def _tree(name: str, source: str) -> str:
    """Levels (level, g, pos, h, n) of the trees over source (g, pos, h, n)."""
    return f"""{name}(level, g, pos, h, n) AS (SELECT 0, g, pos, h, n FROM {source} UNION ALL
    SELECT level + 1, g, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM {name} WHERE n > 1 GROUP BY level, g, pos // 8, n)"""


def _siblings(tree: str, source: str) -> str:
    """For each node (g, pos) of source the list of 'left|right' texts, level by level."""
    return f"""SELECT g, pos, list(l || '|' || r ORDER BY level) AS sib FROM (
      SELECT x.g, x.pos, t.level, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < x.pos // CAST(8 ** t.level AS BIGINT)), '') AS l,
        coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > x.pos // CAST(8 ** t.level AS BIGINT)), '') AS r
      FROM {source} x JOIN {tree} t ON t.g IS NOT DISTINCT FROM x.g AND t.n > 1 AND t.pos // 8 = x.pos // CAST(8 ** (t.level + 1) AS BIGINT)
      GROUP BY x.g, x.pos, t.level) GROUP BY g, pos"""


def manifest() -> str:
    cell = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join([*map(cell, ("doc_id", "source", "lang", "n_chars")), cell(text)]) + ")"
    lower = "CASE WHEN crc % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"
    return f"""WITH RECURSIVE d AS (SELECT *, {crc32("CAST(doc_id AS VARCHAR)")} AS crc FROM documents),
leaves AS (SELECT doc_id, lang AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id, {leaf("text")}) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, {leaf("text")} AS h, {leaf(lower)} AS other FROM d),
{_tree("levels", "leaves")},
subroots AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, g AS name, h FROM levels WHERE n = 1),
{_tree("upper", "subroots")},
low AS ({_siblings("levels", "leaves")}),
high AS ({_siblings("upper", "subroots")}),
proofs AS (SELECT l.doc_id, l.h AS leaf, s.h AS subroot, (SELECT h FROM upper WHERE n = 1) AS root, l.other, list_concat(coalesce(low.sib, []), coalesce(high.sib, [])) AS sib
  FROM leaves l JOIN subroots s ON s.name IS NOT DISTINCT FROM l.g LEFT JOIN low ON low.g IS NOT DISTINCT FROM l.g AND low.pos = l.pos LEFT JOIN high ON high.pos = s.pos),
folded AS (SELECT *, sha256(replace(array_to_string(sib, ''), '|', '')) AS proof_sha256,
  list_reduce(list_concat([other], sib), lambda a, e: sha256(split_part(e, '|', 1) || a || split_part(e, '|', 2))) AS folded_root FROM proofs)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded"""


DIVERGENCE = r"""WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT k, lang, source, unnest(ts) AS term FROM d),
v AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT k) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, v.term, coalesce(n, 0) AS n FROM g JOIN v ON v.lang = g.lang
    LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL) x ON x.lang = g.lang AND x.source = g.source AND x.term = v.term),
s AS (SELECT *, 1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p FROM c),
w AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
q AS (SELECT *, 1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q FROM w),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM s a JOIN s b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL
    UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source WHERE a.lang NOT IN (SELECT lang FROM v)
    UNION ALL SELECT s.lang, s.source, 'term', s.term, (p - q) * (p - q) // q FROM s JOIN q ON q.lang = s.lang AND q.term = s.term WHERE s.n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM r WHERE part = 'pair' OR rank <= 200"""


ORACLES = {"op1_embedding_dedup": EMBEDDINGS, "op2_license_scan": licenses(), "op7_minhash": MINHASH, "op12_merkle_manifest": manifest(), "op13_source_divergence": DIVERGENCE}
