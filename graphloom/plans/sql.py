"""The catalog's queries in SQL, over the same tables. A prelude defines nodes, edges and labelled edges."""

PRELUDE = """
nodes AS (
  SELECT CAST(r_regionkey AS BIGINT) * 8 AS id, ['Region'] AS labels, r_name AS name, NULL::DOUBLE AS acctbal, NULL AS segment, 1 AS n_props FROM region
  UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 8 + 1, ['Nation'], n_name, NULL, NULL, 1 FROM nation
  UNION ALL SELECT c_custkey * 8 + 2, ['Customer', 'Party'], c_name, c_acctbal, c_mktsegment, 3 FROM customer
  UNION ALL SELECT s_suppkey * 8 + 3, ['Party', 'Supplier'], s_name, s_acctbal, NULL, 2 FROM supplier
  UNION ALL SELECT p_partkey * 8 + 4, ['Part'], p_name, NULL, NULL, 5 FROM part
  UNION ALL SELECT o_orderkey * 8 + 5, ['Order'], CAST(o_orderkey AS VARCHAR), NULL, NULL, 3 FROM orders),
edges AS (
  SELECT 'PLACED|' || o_orderkey AS edge_id, o_custkey * 8 + 2 AS src, o_orderkey * 8 + 5 AS dst, 'PLACED' AS type FROM orders
  UNION ALL SELECT 'CONTAINS|' || l_orderkey || '|' || l_partkey || '|' || l_suppkey || '|' || l_linenumber, l_orderkey * 8 + 5, l_partkey * 8 + 4, 'CONTAINS'
    FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem)
  UNION ALL SELECT 'SUPPLIED_BY|' || l_partkey || '|' || l_suppkey, l_partkey * 8 + 4, l_suppkey * 8 + 3, 'SUPPLIED_BY' FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
  UNION ALL SELECT 'IN_NATION|' || (c_custkey * 8 + 2), c_custkey * 8 + 2, CAST(c_nationkey AS BIGINT) * 8 + 1, 'IN_NATION' FROM customer
  UNION ALL SELECT 'IN_NATION|' || (s_suppkey * 8 + 3), s_suppkey * 8 + 3, CAST(s_nationkey AS BIGINT) * 8 + 1, 'IN_NATION' FROM supplier
  UNION ALL SELECT 'IN_REGION|' || n_nationkey, CAST(n_nationkey AS BIGINT) * 8 + 1, CAST(n_regionkey AS BIGINT) * 8, 'IN_REGION' FROM nation
  UNION ALL SELECT 'SUBST|' || p_partkey, p_partkey * 8 + 4, (p_partkey // 2) * 8 + 4, 'SUBST' FROM part WHERE p_partkey > 0),
le AS (SELECT e.*, s.labels AS sl, d.labels AS dl FROM edges e JOIN nodes s ON s.id = e.src JOIN nodes d ON d.id = e.dst),
subst AS (SELECT DISTINCT src, dst FROM edges WHERE type = 'SUBST'),
same_region AS (SELECT DISTINCT a.src, b.src AS dst FROM edges a JOIN edges b ON a.dst = b.dst AND a.edge_id <> b.edge_id WHERE a.type = 'IN_REGION' AND b.type = 'IN_REGION'),
region_all AS (SELECT DISTINCT a.src, b.src AS dst FROM edges a JOIN edges b ON a.dst = b.dst WHERE a.type = 'IN_REGION' AND b.type = 'IN_REGION' AND a.src IN (SELECT src FROM same_region) AND b.src IN (SELECT src FROM same_region)),
q AS (SELECT c_custkey AS msg_id, substr(c_name, 1, length(c_name) - 1) AS name, c_acctbal AS acctbal, c_mktsegment AS segment, n_name AS nation , r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
qn AS (SELECT msg_id, 'Customer' AS label, name, acctbal, segment FROM q UNION ALL SELECT msg_id, 'Nation', nation, NULL, NULL FROM q),
sims AS (
  SELECT qn.msg_id, qn.label, d.id AS d_id,
    CASE WHEN qn.label = 'Nation' THEN 1 - levenshtein(substr(qn.name, 1, 20), substr(d.name, 1, 20)) / greatest(length(substr(qn.name, 1, 20)), length(substr(d.name, 1, 20)))
    ELSE 1 - (levenshtein(substr(qn.name, 1, 20), substr(d.name, 1, 20)) / greatest(length(substr(qn.name, 1, 20)), length(substr(d.name, 1, 20)))
      + (1 - 1 / (1 + abs(qn.acctbal - d.acctbal)))
      + CASE WHEN qn.segment = '' AND d.segment = '' THEN 0 ELSE levenshtein(qn.segment, d.segment) / greatest(length(qn.segment), length(d.segment)) END) / 3 END AS sim
  FROM qn JOIN nodes d ON list_contains(d.labels, qn.label)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY msg_id, label ORDER BY sim DESC, d_id) AS rank FROM sims WHERE sim >= 0.8) WHERE rank <= 3),
sup AS (SELECT a.msg_id, a.d_id AS d_src, b.d_id AS d_dst FROM top a JOIN top b ON a.msg_id = b.msg_id AND a.label = 'Customer' AND b.label = 'Nation'
  WHERE EXISTS (SELECT 1 FROM edges e WHERE e.type = 'IN_NATION' AND e.src = a.d_id AND e.dst = b.d_id)),
combos AS (
  SELECT m.msg_id, a.d_id AS c_id, a.rank AS c_rank, b.d_id AS n_id, b.rank AS n_rank, coalesce(a.sim, 0) + coalesce(b.sim, 0) + CASE WHEN s.msg_id IS NULL THEN 0 ELSE 1 END AS score
  FROM q m LEFT JOIN top a ON a.msg_id = m.msg_id AND a.label = 'Customer' LEFT JOIN top b ON b.msg_id = m.msg_id AND b.label = 'Nation'
  LEFT JOIN sup s ON s.msg_id = m.msg_id AND s.d_src = a.d_id AND s.d_dst = b.d_id),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY round(score, 9) DESC, n_rank, c_rank) AS r FROM combos) WHERE r = 1),
assigned AS (SELECT msg_id, 'Customer' AS label, c_id AS d_id FROM best WHERE c_id IS NOT NULL UNION ALL SELECT msg_id, 'Nation', n_id FROM best WHERE n_id IS NOT NULL),
given AS (SELECT a.d_id AS id, max_by(qn.name, qn.msg_id) AS name, max_by(qn.acctbal, qn.msg_id) AS acctbal, max_by(qn.segment, qn.msg_id) AS segment FROM assigned a JOIN qn ON qn.msg_id = a.msg_id AND qn.label = a.label GROUP BY a.d_id),
raw AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'pruning' ELSE 'default' END AS run, CAST(user_id % 3 + 1 AS INTEGER) AS round,
    ['autoPruningExistence', 'manualMeaningless', 'manualLabel', 'autoOther', 'skip'][user_id % 5 + 1] AS pattern_type, 'h' || CAST(event_id // 3 AS BIGINT) AS hash_code
  FROM events WHERE event_id % 7 <> 3),
pruning AS (SELECT * FROM raw WHERE run = 'pruning' AND hash_code IN (SELECT hash_code FROM raw WHERE run = 'default')),
others AS (SELECT * FROM raw WHERE run = 'default' AND hash_code IN (SELECT hash_code FROM raw WHERE run = 'pruning')),
hops AS (SELECT * FROM (VALUES ('PLACED', 'Customer', 'Order'), ('CONTAINS', 'Order', 'Part'), ('SUBST', 'Part', 'Part'), ('IN_NATION', 'Customer', 'Nation'), ('IN_NATION', 'Supplier', 'Nation')) h(t, s, e)),
oriented AS (SELECT t, s, e, inv, CASE WHEN inv THEN e ELSE s END AS a, CASE WHEN inv THEN s ELSE e END AS b FROM hops, (VALUES (false), (true)) i(inv)),
pats AS (SELECT concat_ws(' ', x.t, x.s, x.e, CAST(x.inv AS VARCHAR), y.t, y.s, y.e, CAST(y.inv AS VARCHAR)) AS pattern_id, x.t AS t1, x.s AS s1, x.e AS e1, x.inv AS i1, y.t AS t2, y.s AS s2, y.e AS e2, y.inv AS i2 FROM oriented x JOIN oriented y ON x.b = y.a)
"""


def _q(body: str) -> str:
    return f"WITH RECURSIVE {PRELUDE.strip()}\n{body}"


def _searched(sql: str) -> str:
    """The same for the messages that are queries of a search."""
    joined = "JOIN region ON n_regionkey = r_regionkey)"
    return sql.replace(joined, f"{joined[:-1]} WHERE c_custkey % 20 = 0)")


_TEXT = "concat_ws(';', CASE WHEN {a} IS NOT NULL THEN 'acctbal=' || CAST({a} AS DOUBLE) END, 'name=' || {n}, CASE WHEN {s} IS NOT NULL THEN 'segment=' || {s} END)"
_HAS = "list_contains({0}, '{1}')"
_PARTY_IN = "list_contains(sl, 'Customer') AND list_contains(dl, 'Nation') AND type = 'IN_NATION'"
_MERGED = f"SELECT n.id, {_TEXT.format(a='coalesce(g.acctbal, n.acctbal)', n='coalesce(g.name, n.name)', s='coalesce(g.segment, n.segment)')} AS props FROM nodes n LEFT JOIN given g ON g.id = n.id WHERE list_contains(n.labels, 'Customer') OR list_contains(n.labels, 'Nation')"
_BASE = """SELECT src, dst, type, 'rel' AS provenance FROM le WHERE (type = 'IN_REGION') OR (type = 'IN_NATION' AND list_contains(sl, 'Supplier'))"""
_VIEW = f"""{_BASE}
UNION ALL SELECT src, dst, 'SAME_REGION', 'vrel' FROM same_region
UNION ALL SELECT src, dst, 'SAME_REGION', 'vrel-closure' FROM (SELECT * FROM region_all EXCEPT SELECT * FROM same_region)
UNION ALL SELECT * FROM (SELECT DISTINCT a.src, b.dst, 'IN' AS type, 'vrel' AS provenance FROM le a JOIN edges b ON a.dst = b.src WHERE a.type = 'IN_NATION' AND list_contains(a.sl, 'Supplier') AND b.type = 'IN_REGION')
UNION ALL SELECT * FROM (SELECT DISTINCT a.src, b.dst, 'NEAR' AS type, 'vrel' AS provenance FROM le a JOIN region_all b ON a.dst = b.src WHERE a.type = 'IN_NATION' AND list_contains(a.sl, 'Supplier'))"""
# substitutions that hold both ways where three divides the part's number, and their closure
_LOOPS = "loops AS (SELECT src, dst FROM subst UNION SELECT dst, src FROM subst WHERE (src // 8) % 3 = 0),\nlooped(src, dst) AS (SELECT src, dst FROM loops UNION SELECT r.src, s.dst FROM looped r JOIN loops s ON r.dst = s.src)"
_REACH = "reach(src, dst) AS (SELECT src, dst FROM subst UNION SELECT r.src, s.dst FROM reach r JOIN subst s ON r.dst = s.src)"
_CLASSES = """(VALUES ('Customer', 'object', 'IN_NATION', 'Customer', 'Nation'), ('Customer', 'datatype', 'name', 'Customer', 'string'), ('Customer', 'datatype', 'acctbal', 'Customer', 'double'), ('Customer', 'datatype', 'segment', 'Customer', 'string'),
  ('Nation', 'object', 'IN_REGION', 'Nation', 'Region'), ('Nation', 'object', 'NEAR', 'Nation', 'Customer,Supplier'), ('Nation', 'object', 'ABOUT', 'Nation', ''), ('Nation', 'datatype', 'name', 'Nation', 'string'), ('Nation', 'datatype', 'lower', 'Nation', 'string'),
  ('Nation', 'datatype', 'code', 'Nation', 'string'), ('Nation', 'datatype', 'mark', 'Nation', 'string'), ('Nation', 'datatype', 'flag', 'Nation', 'boolean'), ('Nation', 'datatype', 'size', 'Nation', 'int')) v(class, kind, prop, domain, range)"""
_USED = "(SELECT l, count(*) AS n FROM (SELECT unnest(labels) AS l FROM nodes) GROUP BY l)"
_LINE = """SELECT c_custkey % 4 AS k, c_custkey % 3 AS g, CASE c_custkey % 4 WHEN 1 THEN substr(c_name, 1, 3) WHEN 2 THEN '{"host": "h", "data": ["' || c_name || '"]}' WHEN 3 THEN '{"gid": ' || c_custkey || ', "data": []}'
  ELSE '{"gid": ' || (c_custkey % 3) || ', "host": "h", "data": [{"label": "Customer", "name": "' || c_name || '"}, {"label": "Nation"}]}' END AS value FROM customer"""
_DIST = "levenshtein({0}, {1}) / greatest(length({0}), length({1}))"
_LEAST = lambda a, b: "least(" + ", ".join(_DIST.format(f"x.{i}", f"y.{j}") for i in (a, b) for j in (a, b)) + ")"
_WORDS = "regexp_extract_all({0}, '[A-Za-z0-9]+')"

SQL = {
    "nodes_by_label": _q("SELECT id, array_to_string(labels, ',') AS labels, name FROM nodes WHERE list_has_any(labels, ['Party', 'Region'])"),
    "copy_view_nodes": _q("SELECT id AS \"realId\", array_to_string(labels, ',') AS labels, CAST(n_props AS BIGINT) AS n_props FROM nodes WHERE list_has_any(labels, ['Customer', 'Nation'])"),
    "extract_rels": _q(f"SELECT DISTINCT src, dst FROM le WHERE {_PARTY_IN}"),
    "view_rels": _q("SELECT DISTINCT CAST(CASE type WHEN 'IN_NATION' THEN 0 ELSE 1 END AS BIGINT) AS conf, src, dst, type FROM le WHERE type IN ('IN_NATION', 'IN_REGION')"),
    "type_allowlist_view": _q("SELECT DISTINCT src, dst, type FROM le WHERE type IN ('SUBST', 'SUPPLIED_BY') AND list_contains(sl, 'Part') AND list_contains(dl, 'Part')"),
    "vrel_shared_nation": _q(f"SELECT DISTINCT a.src, b.src AS dst FROM (SELECT * FROM le WHERE {_PARTY_IN}) a JOIN (SELECT * FROM le WHERE {_PARTY_IN}) b ON a.dst = b.dst AND a.edge_id <> b.edge_id"),
    "vrel_customer_part": _q("SELECT DISTINCT a.src, b.dst FROM edges a JOIN edges b ON a.dst = b.src AND a.type = 'PLACED' AND b.type = 'CONTAINS'"),
    "vrel_inverse": _q("SELECT DISTINCT b.dst AS src, a.src AS dst FROM edges a JOIN edges b ON a.dst = b.src AND a.type = 'PLACED' AND b.type = 'CONTAINS'"),
    "symmetric_closure": _q("SELECT src, dst FROM subst UNION SELECT dst, src FROM subst"),
    "transitive_closure": _q("SELECT src, dst FROM reach").replace("pats AS", _REACH + ",\npats AS"),
    "equivalence_closure": _q("SELECT src, dst FROM region_all"),
    "strong_components": _q("""SELECT i.id, least(i.id, coalesce(m.least, i.id)) AS component FROM (SELECT src AS id FROM loops UNION SELECT dst FROM loops) i
LEFT JOIN (SELECT x.src AS id, min(x.dst) AS least FROM looped x JOIN looped y ON x.src = y.dst AND x.dst = y.src GROUP BY x.src) m ON m.id = i.id""").replace("pats AS", _LOOPS + ",\npats AS"),
    "closure_by_class": _q("SELECT src, dst FROM looped").replace("pats AS", _LOOPS + ",\npats AS"),
    "reach_by_class": _q("""SELECT p.a, p.b, l.src IS NOT NULL AS reach FROM (SELECT p_partkey * 8 + 4 AS a, (p_partkey // 4 + p_partkey % 3) * 8 + 4 AS b FROM part) p
LEFT JOIN looped l ON l.src = p.a AND l.dst = p.b""").replace("pats AS", _LOOPS + ",\npats AS"),
    "extended_closure": _q("SELECT src, dst FROM looped EXCEPT SELECT src, dst FROM reach").replace("pats AS", _LOOPS + ",\n" + _REACH + ",\npats AS"),
    "closure_delta": _q("SELECT src, dst FROM reach EXCEPT SELECT src, dst FROM subst").replace("pats AS", _REACH + ",\npats AS"),
    "gen_view": _q(_VIEW),
    "expand_view": _q(_VIEW),
    "pattern_exists_bulk": _q("""SELECT DISTINCT p.pattern_id, EXISTS (SELECT 1 FROM
  (SELECT edge_id, type, sl, dl, false AS inv, dst AS mid FROM le UNION ALL SELECT edge_id, type, sl, dl, true, src FROM le) a
  JOIN (SELECT edge_id, type, sl, dl, false AS inv, src AS mid FROM le UNION ALL SELECT edge_id, type, sl, dl, true, dst FROM le) b ON a.mid = b.mid AND a.edge_id <> b.edge_id
  WHERE a.type = p.t1 AND a.inv = p.i1 AND list_contains(a.sl, p.s1) AND list_contains(a.dl, p.e1) AND b.type = p.t2 AND b.inv = p.i2 AND list_contains(b.sl, p.s2) AND list_contains(b.dl, p.e2)) AS exists FROM pats p"""),
    "pattern_exists_one": _q(f"""SELECT 'a' AS pattern, EXISTS (SELECT 1 FROM le a JOIN le b ON a.dst = b.dst AND a.edge_id <> b.edge_id WHERE a.type = 'IN_NATION' AND list_contains(a.sl, 'Customer') AND b.type = 'IN_NATION' AND list_contains(b.sl, 'Customer')) AS exists
UNION ALL SELECT 'b', EXISTS (SELECT 1 FROM le WHERE type = 'IN_NATION' AND list_contains(sl, 'Nation') AND list_contains(dl, 'Customer'))"""),
    "rel_frequency": _q("SELECT coalesce(count(*) FILTER (type = 'IN_NATION') / nullif(count(*), 0), 0.0) AS frequency FROM le WHERE list_contains(sl, 'Party') AND list_contains(dl, 'Nation')"),
    "rel_frequency_all": _q("SELECT s AS start, type AS rel, e AS \"end\", n, n / sum(n) OVER (PARTITION BY s, e) AS frequency FROM (SELECT s, e, type, count(*) AS n FROM (SELECT unnest(sl) AS s, dl, type FROM le), unnest(dl) u(e) GROUP BY s, e, type)"),
    "domain_range": _q("SELECT d.type, domain, range FROM (SELECT type, string_agg(DISTINCT s, ',' ORDER BY s) AS domain FROM (SELECT type, unnest(sl) AS s FROM le) GROUP BY type) d JOIN (SELECT type, string_agg(DISTINCT e, ',' ORDER BY e) AS range FROM (SELECT type, unnest(dl) AS e FROM le) GROUP BY type) r ON d.type = r.type"),
    "rel_types": _q("SELECT DISTINCT type FROM edges"),
    "rel_types_page": _q("SELECT DISTINCT type FROM (SELECT type FROM edges ORDER BY edge_id LIMIT 20000 OFFSET 50000)"),
    "infer_view_config": _q("SELECT 'label' AS kind, x AS name, NULL AS label FROM (SELECT unnest(sl) AS x FROM le UNION SELECT unnest(dl) FROM le) UNION ALL SELECT DISTINCT 'start', type, unnest(sl) FROM le UNION ALL SELECT DISTINCT 'end', type, unnest(dl) FROM le"),
    "two_hop_type_pairs": _q("""SELECT t1 AS type1, t2 AS type2, CAST(sum(d1 * d2 - CASE WHEN t1 = t2 THEN d1 ELSE 0 END) AS BIGINT) AS n FROM (
  SELECT a.node, a.type AS t1, b.type AS t2, a.d AS d1, b.d AS d2 FROM deg a JOIN deg b ON a.node = b.node) GROUP BY t1, t2 HAVING n > 0""").replace("pats AS", "deg AS (SELECT node, type, count(*) AS d FROM (SELECT edge_id, type, src AS node FROM edges UNION SELECT edge_id, type, dst FROM edges) GROUP BY node, type),\npats AS"),
    "induced_subgraph": _q("SELECT 'node' AS kind, CAST(id AS VARCHAR) AS item FROM nodes WHERE list_has_any(labels, ['Nation', 'Supplier', 'Region']) UNION ALL SELECT 'edge', edge_id FROM le WHERE list_has_any(sl, ['Nation', 'Supplier', 'Region']) AND list_has_any(dl, ['Nation', 'Supplier', 'Region'])"),
    "graph_union": _q("""SELECT 'edge' AS kind, src || '|' || type || '|' || dst AS item FROM (SELECT DISTINCT src, type, dst FROM edges WHERE type IN ('IN_NATION', 'IN_REGION', 'SUBST'))
UNION ALL SELECT 'node', n.id || '|' || CASE WHEN list_has_any(n.labels, ['Nation', 'Part']) THEN array_to_string(n.labels, ',') ELSE '' END FROM nodes n
WHERE list_has_any(n.labels, ['Nation', 'Part']) OR n.id IN (SELECT src FROM edges WHERE type IN ('IN_NATION', 'IN_REGION', 'SUBST') UNION SELECT dst FROM edges WHERE type IN ('IN_NATION', 'IN_REGION', 'SUBST'))"""),
    "remove_edges_prune": _q("""SELECT 'edge' AS kind, edge_id AS item FROM edges WHERE type NOT IN ('PLACED', 'IN_NATION') UNION ALL SELECT 'node', CAST(id AS VARCHAR) FROM nodes
WHERE id NOT IN (SELECT src FROM edges WHERE type IN ('PLACED', 'IN_NATION') UNION SELECT dst FROM edges WHERE type IN ('PLACED', 'IN_NATION'))
OR id IN (SELECT src FROM edges WHERE type NOT IN ('PLACED', 'IN_NATION') UNION SELECT dst FROM edges WHERE type NOT IN ('PLACED', 'IN_NATION'))"""),
    "neighbour_rels": _q("SELECT DISTINCT a.edge_id, b.edge_id AS neighbour FROM edges a JOIN edges b ON a.edge_id <> b.edge_id AND a.type = 'SUBST' AND b.type = 'SUBST' AND (a.src = b.src OR a.src = b.dst OR a.dst = b.src OR a.dst = b.dst)"),
    "neighbour_counts": _q("""SELECT e.edge_id, CAST(CASE WHEN e.src = e.dst THEN s.d - 1 ELSE s.d + t.d - w.n - 1 END AS BIGINT) AS n FROM edges e
JOIN deg s ON s.node = e.src JOIN deg t ON t.node = e.dst JOIN (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS n FROM edges GROUP BY ALL) w ON w.a = least(e.src, e.dst) AND w.b = greatest(e.src, e.dst)""").replace("pats AS", "deg AS (SELECT node, count(*) AS d FROM (SELECT edge_id, src AS node FROM edges UNION SELECT edge_id, dst FROM edges) GROUP BY node),\npats AS"),
    "reach_in_k": _q("""SELECT p.a, p.b, EXISTS (SELECT 1 FROM both1 x WHERE x.a = p.a AND x.b = p.b) OR EXISTS (SELECT 1 FROM both1 x JOIN both1 y ON x.b = y.a WHERE x.a = p.a AND y.b = p.b) AS reach
FROM (SELECT s_suppkey * 8 + 3 AS a, (s_suppkey % 5) * 8 AS b FROM supplier) p""").replace("pats AS", "both1(a, b) AS (SELECT src, dst FROM edges WHERE type IN ('IN_NATION', 'IN_REGION') UNION SELECT dst, src FROM edges WHERE type IN ('IN_NATION', 'IN_REGION')),\npats AS"),
    "node_degree": _q("SELECT n.id, coalesce(o.d, 0) AS out, coalesce(i.d, 0) AS \"in\", coalesce(o.d, 0) + coalesce(i.d, 0) AS bi FROM nodes n LEFT JOIN (SELECT src, count(*) AS d FROM edges GROUP BY src) o ON o.src = n.id LEFT JOIN (SELECT dst, count(*) AS d FROM edges GROUP BY dst) i ON i.dst = n.id"),
    "list_graph": _q("SELECT 'node' AS kind, CAST(id AS VARCHAR) AS item FROM nodes UNION ALL SELECT DISTINCT 'edge', src || '|' || type || '|' || dst FROM edges"),
    "decode_messages": """SELECT CASE c_custkey % 4 WHEN 0 THEN c_custkey % 3 WHEN 3 THEN c_custkey END AS gid, CASE c_custkey % 4 WHEN 1 THEN 'malformed' WHEN 2 THEN 'no gid' WHEN 3 THEN 'no entities' END AS reason,
  count(*) AS n, CAST(sum(CASE c_custkey % 4 WHEN 0 THEN 2 WHEN 2 THEN 1 ELSE 0 END) AS BIGINT) AS entities FROM customer GROUP BY 1, 2""",
    "flatten_schema": _q(f"SELECT CAST(1 AS BIGINT) AS gid, v.class, v.kind, v.prop, v.domain, v.range, c.n FROM {_CLASSES} JOIN {_USED} c ON c.l = v.class"),
    "class_lookup": _q(f"SELECT CAST(2 AS BIGINT) AS gid, v.class, v.kind, v.prop, v.range, c.n FROM {_CLASSES} JOIN {_USED} c ON c.l = v.class WHERE v.class = 'Nation'"),
    "entity_links": """SELECT CAST(s_suppkey AS BIGINT) AS msg_id, n_name || '2' AS src, 'NEAR' AS type, 'Customer' AS dst_label, CASE WHEN s_suppkey % 3 > 0 THEN s_name ELSE '' END AS dst FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT CAST(s_suppkey AS BIGINT), n_name || '2', 'ABOUT', CASE WHEN s_suppkey % 3 > 0 THEN 'Nation' ELSE 'Customer' END, CASE WHEN s_suppkey % 3 > 0 THEN n_name || '2' ELSE '' END FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "entity_nodes": _q("SELECT msg_id, CAST(1 AS BIGINT) AS ordinal, 'Customer' AS label, name, CAST(3 AS BIGINT) AS n_props FROM q UNION ALL SELECT msg_id, 2, 'Nation', nation, 1 FROM q"),
    "entity_edges": _q("SELECT msg_id, name AS src, 'IN_NATION' AS type, nation AS dst FROM q"),
    "blocked_pairs": _q("SELECT msg_id, label, count(*) AS n, min(d_id) AS least, max(d_id) AS most FROM sims GROUP BY msg_id, label"),
    "node_similarity": _q("SELECT msg_id, label, d_id, round(sim, 6) AS sim FROM sims"),
    "mixed_similarity": f"""SELECT x.c AS msg_id, y.c AS d_id, round(1 - ((1 - 1 / (1 + abs(x.nation - y.nation))) + CASE WHEN x.rich = y.rich THEN 0 ELSE 1 END + {_LEAST('seg', 'tail')}) / 3, 6) AS sim, round({_LEAST('name', 'seg')}, 6) AS alias
FROM (SELECT c_custkey AS c, c_name AS name, c_mktsegment AS seg, substr(c_name, length(c_name) - 2, 3) AS tail, c_acctbal > 5000 AS rich, CAST(c_nationkey AS DOUBLE) AS nation FROM customer) x
JOIN (SELECT c_custkey AS c, c_name AS name, c_mktsegment AS seg, substr(c_name, length(c_name) - 2, 3) AS tail, c_acctbal > 5000 AS rich, CAST(c_nationkey AS DOUBLE) AS nation FROM customer) y ON y.c = x.c + 1""",
    "sparse_links": """WITH d AS (SELECT c_custkey AS d_id, CASE WHEN c_custkey % 4 <> 1 THEN substr(c_name, 1, 20) END AS name, CASE WHEN c_custkey % 4 <> 2 THEN c_acctbal::DOUBLE END AS acctbal, CASE WHEN c_custkey % 4 <> 3 THEN c_mktsegment END AS segment FROM customer),
q AS (SELECT s_suppkey AS msg_id, CASE WHEN s_suppkey % 3 <> 1 THEN substr(replace(s_name, 'Supplier', 'Customer'), 1, 20) END AS name, CASE WHEN s_suppkey % 3 <> 2 THEN s_acctbal::DOUBLE END AS acctbal,
  CASE WHEN s_suppkey % 2 = 0 THEN ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'][s_suppkey % 5 + 1] END AS segment FROM supplier),
x AS (SELECT msg_id, d_id, levenshtein(q.name, d.name) / greatest(length(q.name), length(d.name)) AS a, 1 - 1 / (1 + abs(q.acctbal - d.acctbal)) AS b, levenshtein(q.segment, d.segment) / greatest(length(q.segment), length(d.segment)) AS c FROM q, d),
y AS (SELECT msg_id, d_id, 1 - (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT, 0) AS sim FROM x)
SELECT msg_id::BIGINT AS msg_id, d_id::BIGINT AS d_id, round(sim, 6) AS sim FROM y WHERE sim >= 0.8""",
    "top_k_candidates": _q("SELECT msg_id, label, d_id, round(sim, 6) AS sim, rank FROM top"),
    "structural_support": _q("SELECT msg_id, 'IN_NATION' AS type, d_src, d_dst FROM sup"),
    "joint_assignment": _q("SELECT msg_id, label, d_id FROM assigned"),
    "joint_assignment_groups": _q("""SELECT msg_id, unnest(['Customer', 'Nation', 'Region']) AS label, unnest([c_id, n_id, r_id]) AS d_id FROM (SELECT m.msg_id, a.d_id AS c_id, b.d_id AS n_id, r.d_id AS r_id,
  row_number() OVER (PARTITION BY m.msg_id ORDER BY round(coalesce(a.sim, 0) + coalesce(b.sim, 0) + coalesce(r.sim, 0) + CASE WHEN s.msg_id IS NULL THEN 0 ELSE 1 END + CASE WHEN t.src IS NULL THEN 0 ELSE 1 END, 9) DESC, r.rank, b.rank, a.rank) AS pick
  FROM q m LEFT JOIN top a ON a.msg_id = m.msg_id AND a.label = 'Customer' LEFT JOIN top b ON b.msg_id = m.msg_id AND b.label = 'Nation' LEFT JOIN rtop r ON r.name = m.region
  LEFT JOIN sup s ON s.msg_id = m.msg_id AND s.d_src = a.d_id AND s.d_dst = b.d_id LEFT JOIN edges t ON t.type = 'IN_REGION' AND t.src = b.d_id AND t.dst = r.d_id) WHERE pick = 1 AND c_id IS NOT NULL""").replace(
        "pats AS", f"rtop AS (SELECT * FROM (SELECT name, d_id, sim, row_number() OVER (PARTITION BY name ORDER BY sim DESC, d_id) AS rank FROM (SELECT x.name, y.id AS d_id, 1 - {_DIST.format('x.name', 'y.name')} AS sim FROM nodes x JOIN nodes y ON list_contains(x.labels, 'Region') AND list_contains(y.labels, 'Region')) WHERE sim >= 0.8) WHERE rank <= 3),\npats AS"
    ),
    "merge_props": _q(_MERGED),
    "rewire_edges": _q("SELECT DISTINCT c_id AS src, 'IN_NATION' AS type, n_id AS dst FROM best WHERE c_id IS NOT NULL AND n_id IS NOT NULL"),
    "updated_labels": _q("SELECT l AS label, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM (SELECT DISTINCT n.id, unnest(n.labels) AS l FROM nodes n JOIN assigned a ON a.d_id = n.id) GROUP BY l"),
    "parse_logs": _q("SELECT run, round, pattern_type, hash_code FROM raw"),
    "read_logs": _q("SELECT run, round, pattern_type, hash_code FROM raw"),
    "joint_logs": _q("SELECT run, round, pattern_type, hash_code FROM pruning UNION ALL SELECT run, round, pattern_type, hash_code FROM others"),
    "joint_hashes": _q("SELECT DISTINCT hash_code FROM pruning"),
    "pattern_counts": _q("SELECT run, count(*) AS n FROM raw GROUP BY run"),
    "auto_ratio": _q("SELECT avg(CASE WHEN contains(pattern_type, 'auto') THEN 1.0 ELSE 0.0 END) AS auto_ratio FROM pruning"),
    "prune_metrics": _q("""SELECT tp, CAST(0 AS BIGINT) AS fp, fn, tn, (tp + tn) / nullif(tp + fn + tn, 0) AS accuracy, tp / nullif(tp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM (
  SELECT count(*) FILTER (contains(pattern_type, 'autoPruning')) AS tp, count(*) FILTER (contains(pattern_type, 'manualMeaningless')) AS fn, count(*) FILTER (contains(pattern_type, 'manualLabel')) AS tn FROM pruning)"""),
    "entity_csv": _q("SELECT id, name, unnest(labels) AS label FROM nodes"),
    "triples_to_graph": "SELECT DISTINCT 'part' || p_partkey AS src_name, 'brand' AS type, p_brand AS dst_name FROM part UNION SELECT 'part' || p_partkey, 'type', p_type FROM part",
    "edge_keywords": _q(f"""SELECT e.edge_id, array_to_string(list_sort(list_concat(list_distinct(list_concat(s.labels, d.labels, [s.name, d.name], v.words, w.words)),
  s.labels, s.labels, [s.name, d.name], {_WORDS.format('s.name')}, {_WORDS.format('d.name')})), ' ') AS keywords
FROM edges e JOIN nodes s ON s.id = e.src JOIN nodes d ON d.id = e.dst JOIN texts v ON v.id = e.src JOIN texts w ON w.id = e.dst""").replace("pats AS", f"""texts AS (SELECT n.id, list_distinct({_WORDS.format("concat_ws(' ', n.name, n.segment, p_brand, p_type, o_orderstatus)")}) AS words FROM nodes n LEFT JOIN part ON n.id = p_partkey * 8 + 4 LEFT JOIN orders ON n.id = o_orderkey * 8 + 5),
pats AS"""),
    "segmented_names": """WITH RECURSIVE runs AS (SELECT replace(p_name, ' ', '') AS run, count(*) AS n FROM part WHERE replace(p_name, ' ', '') <> '' GROUP BY 1),
spans AS (SELECT run, n, e, k, substr(run, e - k + 1, k) AS piece FROM (SELECT run, n, unnest(range(1, length(run) + 1)) AS e FROM runs), (SELECT unnest(range(1, 8)) AS k) WHERE k <= e),
counts AS (SELECT piece, length(piece) AS size, sum(n) AS c FROM spans GROUP BY piece HAVING length(piece) = 1 OR sum(n) >= 5),
total AS (SELECT CAST(sum(c) AS DOUBLE) AS t FROM counts WHERE size = 1),
continued AS (SELECT piece, max(c) AS most FROM (SELECT substr(piece, 1, size - 1) AS piece, c FROM counts WHERE size > 1 UNION ALL SELECT substr(piece, 2) AS piece, c FROM counts WHERE size > 1) GROUP BY piece),
halves AS (SELECT piece, c, substr(piece, 1, CAST(i AS INT)) AS a, substr(piece, CAST(i AS INT) + 1) AS b FROM (SELECT piece, c, unnest(range(1, size)) AS i FROM counts WHERE size BETWEEN 2 AND 6)),
bound AS (SELECT h.piece, h.c FROM halves h JOIN counts x ON x.piece = h.a JOIN counts y ON y.piece = h.b CROSS JOIN total GROUP BY h.piece, h.c HAVING min(ln(h.c * t / x.c / y.c)) >= 2.5),
lexicon AS (SELECT piece, ln(c / t) AS score FROM (SELECT b.piece, b.c FROM bound b LEFT JOIN continued USING (piece) WHERE most IS NULL OR most < 0.9 * b.c UNION ALL SELECT piece, c FROM counts WHERE size = 1), total),
paths AS (SELECT run, 0 AS done, CAST(0 AS DOUBLE) AS score, CAST([] AS BIGINT[]) AS sizes, CAST([] AS VARCHAR[]) AS words FROM runs
UNION ALL SELECT p.run, CAST(s.e AS INT), p.score + l.score, list_prepend(s.k, p.sizes), list_append(p.words, s.piece) FROM paths p JOIN spans s ON s.run = p.run AND s.e - s.k = p.done AND s.k <= 6 JOIN lexicon l ON l.piece = s.piece),
best AS (SELECT run, words FROM paths WHERE done = length(run) QUALIFY row_number() OVER (PARTITION BY run ORDER BY round(score, 8) DESC, len(sizes), sizes) = 1)
SELECT p_partkey, array_to_string(words, ' ') AS words FROM part JOIN best ON run = replace(p_name, ' ', '')""",
    "stream_ingest": _q(_MERGED),
    "stream_dead_letters": f"SELECT reason, count(*) AS n, min(value) AS least FROM (SELECT value, CASE k WHEN 1 THEN 'malformed' WHEN 2 THEN 'no gid' WHEN 3 THEN 'no entities' ELSE CASE WHEN g <> 1 THEN 'unknown class' END END AS reason FROM ({_LINE})) WHERE reason IS NOT NULL GROUP BY reason",
    "stream_new_entities": "SELECT CAST(s_suppkey % 2 + 1 AS BIGINT) AS gid, n_name AS name, CAST(max(s_suppkey) AS BIGINT) AS size FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2",
}
for _name in ("blocked_pairs", "node_similarity", "top_k_candidates", "structural_support", "joint_assignment", "joint_assignment_groups", "rewire_edges", "updated_labels"):
    SQL[_name] = _searched(SQL[_name])
