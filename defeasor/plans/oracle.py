"""SQL for DuckDB that computes what the queries of the same name return."""

from __future__ import annotations

_H = "CAST('0x' || substr(md5({}), 1, 7) AS BIGINT)"


def _num(purpose: str, *cols: str) -> str:
    return _H.format(" || '|' || ".join([f"'42|{purpose}'", *(f"CAST({c} AS VARCHAR)" for c in cols)]))


def _key(purpose: str, *cols: str) -> str:
    return "md5(" + " || '|' || ".join([f"'42|{purpose}'", *(f"CAST({c} AS VARCHAR)" for c in cols)]) + ")"


def _unit(purpose: str, *cols: str) -> str:
    return f"({_num(purpose, *cols)} / CAST(268435456.0 AS DOUBLE))"


S = """s AS (SELECT event_id, ts, user_id AS subject, CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS pol, 1 + CAST(json_extract_string(props, '$.k') AS INT) % 8 AS idx
 FROM events WHERE event_type IN ('purchase', 'signup', 'error'))"""
E = S + """, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject, idx ORDER BY ts DESC, event_id DESC) AS rn FROM s) WHERE rn = 1),
e AS (SELECT subject, idx, pol, event_id, CAST(row_number() OVER (PARTITION BY subject ORDER BY ts, event_id) AS INT) AS serial FROM l)"""


def _replayed(order: str = "serial", src: str = "e") -> str:
    w = f"PARTITION BY subject ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND"
    return f"""r0 AS (SELECT *, coalesce(max(CASE WHEN pol = 1 THEN idx END) OVER ({w} CURRENT ROW), 0) AS p, coalesce(max(CASE WHEN pol = -1 THEN idx END) OVER ({w} CURRENT ROW), -1) AS q,
 coalesce(max(CASE WHEN pol = 1 THEN idx END) OVER ({w} 1 PRECEDING), -1) AS pb, coalesce(max(CASE WHEN pol = -1 THEN idx END) OVER ({w} 1 PRECEDING), -1) AS qb FROM {src}),
r AS (SELECT *, CASE WHEN p >= q THEN 'ENTAILED' ELSE 'DEFEATED' END AS state, CASE WHEN greatest(pb, 0) >= qb THEN 'ENTAILED' ELSE 'DEFEATED' END AS before FROM r0)"""


DELTA = "CASE WHEN before = state THEN 'NO_EFFECT' WHEN state = 'ENTAILED' THEN 'STRENGTHENING' WHEN before = 'ENTAILED' THEN 'WEAKENING' ELSE 'NO_EFFECT' END"
SHORT = f"CASE WHEN pol = 1 AND before = 'ENTAILED' AND state = 'ENTAILED' THEN CASE WHEN idx >= greatest(pb, qb) THEN 'STRENGTHENING' ELSE 'NO_EFFECT' END ELSE {DELTA} END"
GROUPS = "SELECT idx, count(*) AS n_members, count(*) FILTER (pol = 1) AS n_pos, count(*) FILTER (pol = -1) AS n_neg, min(serial) AS first_serial FROM e GROUP BY idx HAVING count(*) >= 2 AND count(*) FILTER (pol = 1) > 0 AND count(*) FILTER (pol = -1) > 0"
T = """t AS (SELECT 'r' || r_regionkey AS src, 'root' AS dst, 1 AS layer FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 2 FROM nation
 UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 3 FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 3 FROM supplier)"""
ANC = T + ", anc(subject, node, dist) AS (SELECT src, src, 0 FROM t {} UNION ALL SELECT subject, dst, dist + 1 FROM anc JOIN t ON t.src = anc.node WHERE dist < 10)"
TEV = f", te AS (SELECT src AS node, layer, {_num('sign', 'src')} % 2 AS pol, row_number() OVER (ORDER BY {_key('ser', 'src')}, src) AS serial FROM t WHERE src NOT LIKE 'c%' AND {_unit('bern', 'src')} < 0.6)"
R = """WITH x AS (SELECT o_orderpriority AS model, CAST(o_custkey % 20 AS INT) AS seed, o_orderstatus AS topology, CASE WHEN l_linestatus = 'F' THEN 'easy' ELSE 'hard' END AS difficulty,
 CAST(l_linenumber AS INT) AS depth, CAST(l_discount >= CAST(0.04 AS DOUBLE) AS INT) AS correct, CASE l_returnflag WHEN 'A' THEN 'C1' WHEN 'R' THEN 'C2' ELSE 'C0' END AS cls, l_quantity AS confidence
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
SA = R + ", sa AS (SELECT model, seed, avg(correct) AS acc FROM x GROUP BY ALL)"
LIN = f"""g AS (SELECT i AS graph_id, CAST(4 + {_num('len', 'i')} % 3 AS INT) AS depth FROM (SELECT c_custkey AS i FROM customer) q),
st AS (SELECT graph_id, depth, CAST(unnest(range(1, depth + 1)) AS INT) AS i FROM g),
wt AS (SELECT *, least(depth - 1, greatest(1, depth // 2) + {_num('n', 'graph_id')} % (depth - greatest(1, depth // 2) + 1)) AS wanted, row_number() OVER (PARTITION BY graph_id ORDER BY {_key('pick', 'graph_id', 'i')}) AS r FROM st WHERE i < depth),
ev AS (SELECT graph_id, i, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY i) AS INT) AS serial, CASE WHEN {_unit('sign', 'graph_id', 'i')} < 0.5 THEN 'defeasible_has_property' ELSE 'defeasible_lacks_property' END AS type FROM wt WHERE r <= wanted),
lin AS (SELECT graph_id, 'Subclass_' || i AS src, 'Subclass_' || (i - 1) AS dst, 'inheritance' AS type, i AS layer, CAST(NULL AS INT) AS serial FROM st
 UNION ALL SELECT graph_id, 'Subclass_0', 'Property', 'has_property', 0, NULL FROM g UNION ALL SELECT graph_id, 'Subclass_' || depth, 'Property', 'hypothesis_edge', depth, NULL FROM g
 UNION ALL SELECT graph_id, 'Subclass_' || i, 'Property', type, i, serial FROM ev)"""
FP = """, fp AS (SELECT graph_id, md5(max(layer) || '|' || coalesce(string_agg(lpad(CAST(layer AS VARCHAR), 3, '0') || ':' || type, ',' ORDER BY lpad(CAST(layer AS VARCHAR), 3, '0') || ':' || type) FILTER (type LIKE 'defeasible%'), '')) AS fingerprint FROM lin GROUP BY graph_id)"""


def _tree(depth: int, breadth: int, fewest: int, most: int, survival: float) -> str:
    """Level by level; decay 1."""
    levels = ["n0 AS (SELECT i AS graph_id, '0' AS node, CAST(NULL AS VARCHAR) AS parent, 0 AS layer FROM (SELECT c_custkey AS i FROM customer) q)"]
    for d in range(depth):
        k = str(breadth) if d == 0 else f"{fewest} + {_num('kids', 'graph_id', 'node')} % {most - fewest + 1}"
        live = "" if d == 0 else f"WHERE {_unit('live', 'graph_id', 'node')} < CAST({survival} AS DOUBLE)"
        levels.append(f"n{d + 1} AS (SELECT graph_id, node || '.' || k AS node, node AS parent, {d + 1} AS layer FROM (SELECT *, unnest(range(1, {k} + 1)) AS k FROM n{d} {live}))")
    return ", ".join(levels) + ", tn AS (" + " UNION ALL ".join(f"SELECT * FROM n{d}" for d in range(depth + 1)) + ")"


BUSHY = _tree(2, 3, 1, 2, 0.7)
LEAF = f"""lf AS (SELECT graph_id, node AS leaf, layer FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY f, {_key('leaf', 'graph_id', 'node')}) AS r FROM (
 SELECT *, CASE WHEN {_unit('deep', 'graph_id')} < 0.8 AND layer = max(layer) OVER (PARTITION BY graph_id) THEN 0 ELSE 1 END AS f FROM tn a WHERE NOT EXISTS (SELECT 1 FROM tn b WHERE b.graph_id = a.graph_id AND b.parent = a.node))) WHERE r = 1)"""


def _prefixes(rules, otherwise):
    return "CASE " + " ".join(f"WHEN starts_with(predicate, '{a}') THEN '{b}' || substr(predicate, {len(a) + 1})" for a, b in rules) + f" ELSE '{otherwise}' || predicate END"


from ..functions.phrases import PLURAL_VERBS, QUESTIONS, VERBS  # noqa: E402

PRED = """pr AS (SELECT p_partkey, p_brand AS subject, ['is', 'has', 'can', 'serves as', 'appears', 'produces', 'tastes or smells', 'displays', 'thrives', 'are', 'have', 'utilizes'][p_partkey % 12 + 1] || ' ' || p_name AS predicate FROM part)"""
ASK = "CASE " + " ".join(f"WHEN starts_with(predicate, '{p}') THEN '{a}' || subject || '{m}' || substr(predicate, {len(p) + 1}) || '?'" for p, a, m in QUESTIONS) + " ELSE 'Does ' || subject || ' ' || predicate || '?' END"
EN = "en AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)"
TURNS = """tu AS (SELECT subject, serial, unnest([0, 1, 2, 3]) AS nth, CASE state WHEN 'ENTAILED' THEN 'yes' ELSE 'no' END AS says, CASE WHEN pol = 1 THEN 'strengthening' ELSE 'weakening' END AS eff,
 'Object_' || subject || CASE WHEN pol = 1 THEN ' has P' ELSE ' lacks P' END || idx || '.' AS fact FROM r)"""
_concepts = [("animal", 0.20), ("mammal", 0.15), ("vertebrate", 0.15), ("plant", 0.15), ("insect", 0.15), ("microorganism", 0.10), ("bird", 0.10)]
_total, _upto, _draw = sum(w for _, w in _concepts), 0.0, "CASE "
for _name, _w in _concepts[:-1]:
    _upto += _w / _total
    _draw += f"WHEN {_unit('w', 'c_custkey')} < CAST('{_upto!r}' AS DOUBLE) THEN '{_name}' "
_draw += "ELSE 'bird' END"
CONCEPT = _draw.replace("c_custkey", "graph_id")

#: Subject and value of class sentences s, in words.
ISA = r"""w AS (SELECT {cols}, regexp_split_to_array(trim(s), '\s+') AS w FROM s WHERE NOT regexp_matches(s, '[^\w\s-]')),
v AS (SELECT *, list_position(list_transform(w[2:len(w) - 1], lambda x: lower(x) IN ('is', 'are')), true) AS v FROM w),
p AS (SELECT {cols}, w[1:v] AS a, w[v + 2:] AS b FROM v WHERE v > 0),
x AS (SELECT {cols}, array_to_string(CASE WHEN len(a) > 1 AND lower(a[1]) IN ('a', 'an') THEN a[2:] ELSE a END, ' ') AS subject, array_to_string(CASE WHEN len(b) > 1 AND lower(b[1]) IN ('a', 'an') THEN b[2:] ELSE b END, ' ') AS value FROM p)"""

ORACLE_SQL = {
    "scan_filter_evidence": f"WITH {S} SELECT event_id, subject, pol, idx FROM s",
    "digraph_last_write_wins": f"WITH {E} SELECT subject, idx, event_id, pol FROM l",
    "serial_assignment": f"WITH {E} SELECT * FROM e",
    "signed_projection_cutoff": f"WITH {E} SELECT subject, 'P' || idx AS dst, CASE WHEN pol = 1 THEN '+' ELSE '-' END AS sign FROM e WHERE serial <= 3",
    "chain_state_by_reveal": f"WITH {E}, {_replayed()} SELECT subject, serial, p, q, state, before FROM r",
    "chain_state_before_after_label": f"WITH {E}, {_replayed()} SELECT subject, serial, CASE WHEN pol = 1 THEN 'STRENGTHENING' ELSE 'WEAKENING' END AS mode_a, {DELTA} AS delta FROM r",
    "chain_positive_path_shortening": f"WITH {E}, {_replayed()} SELECT subject, serial, idx, {SHORT} AS label FROM r WHERE pol = 1",
    "chain_random_order_replay": f"WITH {E}, k AS (SELECT *, {_key('reveal', 'subject', 'idx')} AS k FROM e), {_replayed('k, idx', 'k')} SELECT subject, CAST(row_number() OVER (PARTITION BY subject ORDER BY k, idx) AS INT) AS reveal, idx, state, {SHORT} AS label FROM r",
    "chain_hypothesis_distance": f"WITH {E} SELECT subject, serial, 9 - idx AS hyp_node_distance FROM e",
    "chain_bypass_fold": f"""WITH {E}, f AS (SELECT subject, list(idx) FILTER (pol = 1) AS a, coalesce(list(idx) FILTER (pol = -1), []) AS b FROM e GROUP BY subject),
 g AS (SELECT subject, list_concat([0], coalesce(a, [])) AS en, b FROM f),
 h AS (SELECT *, len(list_filter(en, lambda x: x <= 2 AND len(list_filter(b, lambda y: y > x AND y <= 2)) = 0)) > 0 AND NOT list_contains(b, 5) AS fires FROM g),
 k AS (SELECT subject, b, CASE WHEN fires THEN list_append(en, 5) ELSE en END AS en FROM h)
 SELECT subject, CASE WHEN len(list_filter(en, lambda x: len(list_filter(b, lambda y: y > x)) = 0)) > 0 THEN 'ENTAILED' ELSE 'DEFEATED' END AS state, list_contains(en, 5) AS enters_5 FROM k""",
    "bypass_option_pairs": f"""WITH c AS (SELECT s_suppkey AS subject, 5 + {_num('chain', 's_suppkey')} % 4 AS length FROM supplier), i AS (SELECT subject, CAST(unnest(range(length)) AS INT) AS i FROM c),
 p AS (SELECT a.subject, a.i AS j, b.i AS k FROM i a JOIN i b ON a.subject = b.subject AND b.i >= a.i + 2) SELECT p.subject, p.j, p.k, q.j AS b_j, q.k AS b_k FROM p JOIN p q ON p.subject = q.subject AND q.j > p.j AND q.k < p.k WHERE p.k - p.j >= 3""",
    "irrelevant_turns_interleaved": f"""WITH {E}, x AS (SELECT user_id AS subject, unnest(range(1, least(count(*), 3) + 1)) AS ord FROM events WHERE event_type = 'view' GROUP BY user_id),
 mk AS (SELECT subject, k, row_number() OVER (PARTITION BY subject ORDER BY k) AS serial FROM (SELECT subject, {_key('mix', 'subject', "'m' || serial")} AS k FROM e)),
 u AS (SELECT subject, k, 'main' AS kind, serial AS n FROM mk UNION ALL SELECT subject, {_key('mix', 'subject', "'x' || ord")}, 'irrelevant', ord FROM x)
 SELECT subject, CAST(row_number() OVER (PARTITION BY subject ORDER BY k, kind, n) AS INT) AS pos, kind, CAST(n AS BIGINT) AS n FROM u""",
    "irrelevant_records": "SELECT user_id AS subject, event_id, round((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) * CAST(0.1 AS DOUBLE), 1) AS serial, CASE WHEN event_id % 2 = 1 THEN 'trap_irr' ELSE 'safe_irr' END AS update_type, CASE WHEN event_id % 2 = 1 THEN 'DEFEATED' ELSE 'ENTAILED' END AS post_state FROM events WHERE event_type = 'view'",
    "quantified_groups": f"WITH {E} SELECT idx, n_members, n_pos, n_neg, CAST(first_serial - 0.5 AS DOUBLE) AS group_serial FROM ({GROUPS})",
    "generic_scope": f"WITH {E}, n AS (SELECT idx, count(*) AS n_neg FROM e WHERE pol = -1 GROUP BY idx) SELECT idx, n_neg, CAST((SELECT max(serial) FROM e) + row_number() OVER (ORDER BY idx) AS BIGINT) AS serial FROM n",
    "group_reveal_schedule": f"WITH {E} SELECT idx, 'edge' AS kind, subject, CAST(serial AS DOUBLE) AS at FROM e UNION ALL SELECT idx, 'group', NULL, CAST(first_serial - 0.5 AS DOUBLE) FROM ({GROUPS})",
    "section_partition_caps": f"""WITH {E}, u AS (SELECT DISTINCT subject FROM e), c AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY {_key('part', 'subject')}, subject) AS r FROM u),
 d AS (SELECT subject, r, CASE WHEN n < 2 THEN 0 ELSE least(greatest(1, round_even(n * CAST(0.4 AS DOUBLE), 0)), n - 1) END AS n4 FROM c),
 f AS (SELECT subject, CASE WHEN r <= n4 THEN 't4' ELSE 't12' END AS section, CAST(CASE WHEN r <= n4 THEN r ELSE r - n4 END AS BIGINT) AS rank_in_section FROM d) SELECT * FROM f WHERE rank_in_section <= 20""",
    "record_cap": f"WITH {E} SELECT subject, serial, idx, 'Object_' || subject || '_' || CASE WHEN pol = 1 THEN 'pos' ELSE 'neg' END || '_P' || idx || '_' || serial || '_000' AS record_id FROM e WHERE serial <= 2",
    "contradiction_plan": f"WITH {E}, a AS (SELECT *, count(*) OVER (PARTITION BY subject) AS n FROM e) SELECT subject, idx, serial, {_unit('between', 'subject', 'idx')} < 0.6 AS between FROM a WHERE serial > n // 2 AND pol = 1".replace("AS between", 'AS "between"'),
    "redundant_claims": f"WITH {S}, a AS (SELECT *, CAST(event_id % 3 AS INT) AS source FROM s) SELECT event_id, source, coalesce(min(source) OVER (PARTITION BY subject, idx, pol ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < source, false) AS redundant FROM a",
    "taxonomy_ancestors": "WITH RECURSIVE " + ANC.format("WHERE src LIKE 'c%'") + " SELECT * FROM anc",
    "taxonomy_depth_childcount": f"WITH {T}, a AS (SELECT src AS node, layer FROM t UNION ALL SELECT 'root', 0) SELECT node, layer, CAST(coalesce(n, 0) AS BIGINT) AS n_children FROM a LEFT JOIN (SELECT dst, count(*) AS n FROM t GROUP BY dst) k ON k.dst = node",
    "taxonomy_layers": f"WITH {T} SELECT layer, count(*) AS n, min(src) AS first_node FROM t GROUP BY layer",
    "inheritance_answer_by_reveal": "WITH RECURSIVE " + ANC.format("WHERE src LIKE 'c%'") + TEV + """, subj AS (SELECT DISTINCT subject FROM anc),
 al AS (SELECT subj.subject, te.serial, te.pol, a.node IS NOT NULL AS onp, max(CASE WHEN a.node IS NOT NULL THEN te.layer * 10 + te.pol END) OVER (PARTITION BY subj.subject ORDER BY te.serial) AS best
  FROM subj CROSS JOIN te LEFT JOIN anc a ON a.subject = subj.subject AND a.node = te.node)
 SELECT CASE WHEN best IS NULL OR best % 10 = 1 THEN 'yes' ELSE 'no' END AS answer, CASE WHEN NOT onp THEN 'no effect' WHEN pol = 1 THEN 'strengthen' ELSE 'weaken' END AS effect, CAST(count(*) AS BIGINT) AS n FROM al GROUP BY ALL""",
    "inheritance_final_answer": "WITH RECURSIVE " + ANC.format("WHERE src LIKE 'c%'") + TEV + " SELECT anc.subject, CASE WHEN max(te.layer * 10 + te.pol) IS NULL OR max(te.layer * 10 + te.pol) % 10 = 1 THEN 'yes' ELSE 'no' END AS answer FROM anc LEFT JOIN te USING (node) GROUP BY anc.subject",
    "tree_distance_to_subject": "WITH RECURSIVE " + ANC.format("") + f", pq AS (SELECT src AS a, 'n' || ({_num('far', 'src')} % 25) AS b FROM t WHERE src LIKE 'c%') SELECT a, b, CAST(min(x.dist + y.dist) AS BIGINT) AS distance FROM pq JOIN anc x ON x.subject = a JOIN anc y ON y.subject = b AND y.node = x.node GROUP BY a, b",
    "linear_distance": f"WITH {LIN} SELECT e.graph_id, e.serial, least(h.layer - e.layer, 2) AS distance FROM lin e JOIN lin h ON h.graph_id = e.graph_id AND h.type = 'hypothesis_edge' WHERE e.type LIKE 'defeasible%'",
    "skeptical_resolution": f"""WITH {LIN}, c AS (SELECT graph_id, graph_id AS gid, src AS subject, dst AS target, unnest([0, 1, 2, 3, 4]) AS cut FROM lin WHERE type = 'hypothesis_edge')
 SELECT graph_id, subject, target, cut AS cutoff, coalesce((SELECT CASE WHEN arg_max(e.type, e.layer) = 'defeasible_lacks_property' THEN 'False' END FROM lin e WHERE e.graph_id = gid AND e.type LIKE 'defeasible%' AND e.serial <= cut), 'True') AS answer FROM c""",
    "skeptical_taxonomy": f"""WITH RECURSIVE {T}{TEV}, up AS (SELECT src AS subject, src AS node, 0 AS d FROM t WHERE layer = 3 UNION ALL SELECT subject, t.dst, d + 1 FROM up JOIN t ON t.src = up.node)
 SELECT subject, CASE arg_min(pol, d) FILTER (pol IS NOT NULL) WHEN 1 THEN 'True' WHEN 0 THEN 'False' ELSE 'Skeptical/Unknown' END AS answer FROM up LEFT JOIN te ON te.node = up.node GROUP BY subject""",
    "subclass_superclass_lookup": "WITH e AS (SELECT n_name AS c, r_name AS p FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT DISTINCT lower(p) AS label, c AS found, 'sub' AS direction FROM e UNION SELECT DISTINCT lower(c), p, 'super' FROM e",
    "disjunctive_property_match": "WITH k AS (SELECT DISTINCT p_type, p_brand, p_type || '|' || p_brand AS kind FROM part) SELECT DISTINCT p.kind AS property, s.kind AS subject FROM k p JOIN k s ON p.p_type = s.p_type OR p.p_brand = s.p_brand",
    "relation_join_weight_ordered": "WITH w AS (SELECT l_suppkey, l_partkey, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY weight DESC, l_partkey) AS r FROM w) SELECT s_name AS start_label, p_name AS end_label, round(weight, 6) AS weight, r FROM t JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE r <= 3",
    "node_upsert_first_wins": "SELECT p_name AS id, arg_min(p_brand, p_partkey) AS label FROM part GROUP BY p_name",
    "alias_group_concat": "SELECT p_name, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS aliases FROM part GROUP BY p_name",
    "property_dedup": "SELECT p_name AS lemma, p_type AS frame, min(p_partkey) AS ord FROM part GROUP BY ALL",
    "conversation_turn_explode": f"""WITH {E}, {_replayed()}, {TURNS} SELECT subject, CAST((serial - 1) * 4 + nth AS BIGINT) AS turn_ord, CASE WHEN nth % 2 = 0 THEN 'user' ELSE 'assistant' END AS role,
 CASE nth WHEN 0 THEN fact WHEN 1 THEN says WHEN 2 THEN 'Does this update strengthen, weaken, or have no effect on the support for the hypothesis?' ELSE eff END AS content,
 CASE WHEN nth < 2 THEN 'update_answer' ELSE 'effect_of_update' END AS task_type, CASE nth WHEN 0 THEN says WHEN 2 THEN eff END AS ground_truth FROM tu""",
    "turn_budget": f"WITH {E} SELECT subject, serial FROM e WHERE (serial - 1) * 4 < 18",
    "conversation_roles": "WITH c AS (SELECT *, role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS ch FROM conversations) SELECT conv_id, count(*) AS n_turns, CAST(coalesce(sum(CAST(ch AS INT)), 0) AS BIGINT) AS n_changes, arg_min(role, turn) AS first_role FROM c GROUP BY conv_id",
    "first_turn_split": "WITH c AS (SELECT conv_id, text || CASE WHEN conv_id % 3 = 0 THEN '' ELSE '  Question: is it so?' END AS c FROM conversations WHERE turn = 0) SELECT conv_id, CASE WHEN instr(c, 'Question:') > 0 THEN rtrim(substr(c, 1, instr(c, 'Question:') - 1), ' ') ELSE c END AS prefix, CASE WHEN instr(c, 'Question:') > 0 THEN substr(c, instr(c, 'Question:')) ELSE '' END AS suffix FROM c",
    "negate_predicates": f"WITH {PRED} SELECT p_partkey, subject || ' ' || {_prefixes(VERBS, 'does not ')} || '.' AS negative, {_prefixes(PLURAL_VERBS, 'do not ')} AS rule, 'At least one ' || subject || ' object ' || {_prefixes(VERBS, 'does not ')} || '.' AS generic FROM pr",
    "question_forms": f"WITH {PRED} SELECT p_partkey, {ASK} AS question, upper(substr(predicate, 1, 1)) || lower(substr(predicate, 2)) AS cap_all, upper(substr(predicate, 1, 1)) || substr(predicate, 2) AS cap_first FROM pr",
    "edge_sentences": f"WITH {E} SELECT subject, serial, 'Object ' || subject || CASE WHEN pol = 1 THEN ' ' ELSE ' does not ' END || 'show P' || idx || '.' AS sentence FROM e",
    "pretext_listagg": "SELECT n_regionkey, string_agg(n_name || ' is a kind of region ' || n_regionkey || '.', ' ' ORDER BY n_nationkey) AS pretext FROM nation GROUP BY n_regionkey",
    "plural_article": "WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part) SELECT word, CASE WHEN regexp_matches(lower(word), '(s|sh|ch|x|z)$') THEN word || 'es' WHEN regexp_matches(lower(word), '[^aeiou]y$') THEN word[:-2] || 'ies' ELSE word || 's' END AS plural, CASE WHEN suffix(word, 's') THEN word ELSE word || 's' END AS naive, CASE WHEN lower(word[1]) IN ('a', 'e', 'i', 'o', 'u') THEN 'an' ELSE 'a' END AS article FROM w",
    "disjunction_lists": "WITH g AS (SELECT n_regionkey, list(n_name ORDER BY n_name) AS l FROM nation GROUP BY 1) SELECT n_regionkey, 'At least one of ' || CASE len(l) WHEN 1 THEN l[1] WHEN 2 THEN l[1] || ' or ' || l[2] ELSE array_to_string(l[:len(l) - 1], ', ') || ', or ' || l[len(l)] END || ' is not cold.' AS sentence FROM g",
    "reliability_pairs": "WITH a AS (SELECT s_nationkey, s_name, lead(s_name) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS less FROM supplier) SELECT s_nationkey, s_name || ' is more reliable than ' || less || '.' AS statement FROM a WHERE less IS NOT NULL",
    "template_fill": "SELECT p_partkey, 'is made of ' || lower(p_name) AS sentence FROM part",
    "url_concepts": "SELECT page_id, regexp_extract(url, '^https?://[^/]+/(?:[a-z]{2}/)?([^/?#]*)', 1) AS concept FROM pages",
    "fingerprint_linear": f"WITH {LIN}{FP} SELECT * FROM fp",
    "fingerprint_tree_canonical": f"""WITH {BUSHY}, a1 AS (SELECT n1.graph_id, n1.node, '(' || coalesce(string_agg('()', '') FILTER (n2.node IS NOT NULL), '') || ')' AS f FROM n1 LEFT JOIN n2 ON n2.graph_id = n1.graph_id AND n2.parent = n1.node GROUP BY 1, 2)
 SELECT graph_id, '(' || string_agg(f, '' ORDER BY f) || ')' AS form FROM a1 GROUP BY graph_id""",
    "fingerprint_subjects": f"WITH {E} SELECT subject, md5(string_agg(lpad(CAST(idx AS VARCHAR), 2, '0') || CASE WHEN pol = 1 THEN '+' ELSE '-' END, ',' ORDER BY idx)) AS fingerprint FROM e GROUP BY subject",
    "distinct_generation": f"""WITH {LIN}{FP}, d AS (SELECT graph_id, md5({CONCEPT} || '|' || fingerprint) AS fingerprint FROM fp),
 a AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY graph_id) = 1 AS is_new, row_number() OVER (ORDER BY graph_id) AS o FROM d), b AS (SELECT *, sum(is_new::INT) OVER (ORDER BY o) AS rank, o - coalesce(max(CASE WHEN is_new THEN o END) OVER (ORDER BY o), 0) AS run FROM a)
 SELECT graph_id, fingerprint FROM b WHERE is_new AND rank <= 500 AND o <= coalesce((SELECT min(o) FROM b WHERE run >= 15), o)""",
    "dedup_saturation": f"""WITH {LIN}{FP}, a AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY graph_id) = 1 AS is_new FROM fp),
 b AS (SELECT *, sum(CAST(is_new AS INT)) OVER (ORDER BY graph_id) AS isl FROM a), c AS (SELECT *, CAST(sum(CAST(NOT is_new AS INT)) OVER (PARTITION BY isl ORDER BY graph_id) AS BIGINT) AS run FROM b)
 SELECT graph_id, is_new, run, is_new AND NOT coalesce(bool_or(run >= 10) OVER (ORDER BY graph_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS accepted FROM c""",
    "weighted_choice": f"SELECT c_custkey, {_draw} AS choice FROM customer",
    "sample_without_replacement": f"SELECT * FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY {_key('s', 'c_nationkey', 'c_custkey')}, c_custkey) AS r FROM customer) WHERE r <= 3",
    "attribute_sampling": f"""WITH pool AS (SELECT p_name AS attribute, min(p_type) AS domain FROM part GROUP BY 1), own AS (SELECT DISTINCT p_type AS own FROM part),
 t AS (SELECT own, attribute, CAST(row_number() OVER (PARTITION BY own ORDER BY CAST(own = domain AS INT) DESC, {_key('attr', 'attribute')}, attribute) AS BIGINT) AS rank FROM own CROSS JOIN pool)
 SELECT p_partkey AS key, attribute, rank FROM part JOIN t ON own = p_type WHERE rank <= 3""",
    "linear_graph_generate": f"WITH {LIN} SELECT * FROM lin",
    "tree_generate": f"WITH {_tree(4, 5, 1, 1, 0.4)} SELECT * FROM tn",
    "tree_hypothesis_leaf": f"WITH {BUSHY}, {LEAF} SELECT * FROM lf",
    "tree_evidence": f"""WITH {BUSHY}, {LEAF}, k AS (SELECT tn.* FROM tn WHERE layer > 0 AND NOT EXISTS (SELECT 1 FROM lf WHERE lf.graph_id = tn.graph_id AND lf.leaf = tn.node) AND {_unit('ev', 'graph_id', 'node')} < 0.6)
 SELECT graph_id, node, layer, CASE WHEN {_unit('esign', 'graph_id', 'node')} < 0.5 THEN 'defeasible_has_property' ELSE 'defeasible_lacks_property' END AS type, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY {_key('eser', 'graph_id', 'node')}) AS INT) AS serial FROM k""",
    "markov_transitions": f"WITH {EN}, w AS (SELECT '^' || word || '$' AS w FROM en), a AS (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM w) SELECT substr(w, i, 2) AS state, substr(w, i + 2, 1) AS next, count(*) AS n FROM a GROUP BY ALL",
    "nonce_filter": f"WITH {EN}, d AS (SELECT DISTINCT word FROM en) SELECT word FROM d WHERE len(word) BETWEEN 4 AND 10 AND NOT regexp_matches(word, '[^aeiouy]{{4,}}') AND len(list_filter(range(1, len(word) - 1), lambda i: word[i] = word[i + 1] AND word[i] = word[i + 2])) = 0",
    "isa_extraction": r"""WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(text, '.'), lambda x: trim(replace(x, chr(10), ' '))), lambda x: x <> '') AS l FROM documents),
 s AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS s FROM d), """ + ISA.format(cols="doc_id, pos") + " SELECT doc_id, CAST(pos AS BIGINT) AS pos, subject, value FROM x",
    "batches": "SELECT conv_id, (row_number() OVER (ORDER BY conv_id) - 1) // 5 AS batch FROM conversations WHERE turn = 0",
    "accuracy_heatmap_pivot": R + ", a AS (SELECT model, topology, avg(correct) AS a FROM x GROUP BY ALL) SELECT model, round(max(a) FILTER (topology = 'F'), 6) AS acc_F, round(max(a) FILTER (topology = 'O'), 6) AS acc_O, round(max(a) FILTER (topology = 'P'), 6) AS acc_P, round(avg(a), 6) AS row_mean FROM a GROUP BY model",
    "depth_curve_sem": R + " SELECT model, topology, depth, round(avg(correct), 6) AS mean_accuracy, round(stddev_samp(correct) / sqrt(count(*)), 6) AS sem_accuracy, count(*) AS n FROM x GROUP BY ALL",
    "depth_bins_fixed": R + " SELECT model, CAST((depth - 1) // 2 * 2 + 1 AS INT) AS lo, round(avg(correct), 6) AS accuracy, count(*) AS n FROM x GROUP BY ALL",
    "depth_bins_quantile": R + """, e AS (SELECT difficulty, list_sort(list_distinct(quantile_cont(confidence, [0.0, 1/6, 2/6, 0.5, 4/6, 5/6, 1.0]))) AS e FROM x GROUP BY difficulty),
 b AS (SELECT x.difficulty, correct, e, greatest(1, len(list_filter(e, lambda q: q < confidence))) AS nth FROM x JOIN e USING (difficulty)) SELECT difficulty, round_even((e[nth] + e[nth + 1]) / 2, 1) AS midpoint, round(avg(correct), 6) AS accuracy, count(*) AS n FROM b GROUP BY ALL""",
    "seed_stability_mean_sd_cv": SA + " SELECT model, count(*) AS n_seeds, round(avg(acc), 6) AS mean_acc, round(stddev_samp(acc), 6) AS std_acc, round(100 * stddev_samp(acc) / avg(acc), 6) AS cv_pct FROM sa GROUP BY model",
    "seed_quartiles": SA + " SELECT model, round(quantile_cont(acc, 0.25), 6) AS q1, round(quantile_cont(acc, 0.5), 6) AS q2, round(quantile_cont(acc, 0.75), 6) AS q3 FROM sa GROUP BY model",
    "model_sd_per_seed": SA + " SELECT seed, round(avg(acc), 6) AS mean_acc, round(stddev_samp(acc), 6) AS sd_acc FROM sa GROUP BY seed HAVING stddev_samp(acc) IS NOT NULL",
    "trend_line": R + ", a AS (SELECT model, depth, avg(correct) AS acc FROM x GROUP BY ALL) SELECT model, round(regr_slope(acc, depth), 6) AS slope, round(regr_intercept(acc, depth), 6) AS intercept FROM a GROUP BY model HAVING count(*) >= 3",
    "kruskal_wallis": SA + """, s AS (SELECT model, round(acc, 6) AS acc FROM sa), k AS (SELECT *, rank() OVER (ORDER BY acc) + (count(*) OVER (PARTITION BY acc) - 1) / CAST(2 AS DOUBLE) AS rk FROM s),
 g AS (SELECT model, sum(rk) AS r, count(*) AS n FROM k GROUP BY model), t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*) AS c FROM s GROUP BY acc)), q AS (SELECT sum(r * r / n) AS q, sum(n) AS tt FROM g)
 SELECT round((CAST(12 AS DOUBLE) / (tt * (tt + 1)) * q - 3 * (tt + 1)) / (1 - ties / (CAST(tt AS DOUBLE) * tt * tt - tt)), 6) AS h, CAST(tt AS BIGINT) AS n FROM q, t""",
    "icc_2_1": SA + """, a AS (SELECT *, avg(acc) OVER (PARTITION BY model) AS rm, avg(acc) OVER (PARTITION BY seed) AS cm, avg(acc) OVER () AS gm FROM sa),
 b AS (SELECT count(DISTINCT model) AS n, count(DISTINCT seed) AS k, sum((rm - gm) ** 2) AS ssr, sum((cm - gm) ** 2) AS ssc, sum((acc - rm - cm + gm) ** 2) AS sse FROM a),
 c AS (SELECT n, k, ssr / (n - 1) AS r, ssc / (k - 1) AS c, sse / ((n - 1) * (k - 1)) AS e FROM b) SELECT n AS n_models, k AS n_seeds, round((r - e) / (r + (k - 1) * e + k * (c - e) / n), 6) AS icc FROM c""",
    "bias_gap": R + """, g AS (SELECT model, CAST(count(*) FILTER (cls = 'C1' AND correct = 1) AS DOUBLE) AS a, CAST(count(*) FILTER (cls = 'C1' AND correct = 0) AS DOUBLE) AS b, CAST(count(*) FILTER (cls = 'C2' AND correct = 1) AS DOUBLE) AS c, CAST(count(*) FILTER (cls = 'C2' AND correct = 0) AS DOUBLE) AS d FROM x GROUP BY model),
 h AS (SELECT *, ln((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))) AS l, sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (c + 0.5) + 1 / (d + 0.5)) AS se FROM g)
 SELECT model, round(a / (a + b) - c / (c + d), 6) AS bias_gap, round(exp(l), 6) AS odds_ratio, round(exp(l - 1.96 * se), 6) AS ci_low, round(exp(l + 1.96 * se), 6) AS ci_high FROM h""",
    "mcnemar": R + """, s AS (SELECT model, seed, depth, avg(correct) FILTER (cls = 'C1') AS a, avg(correct) FILTER (cls = 'C2') AS b FROM x WHERE cls IN ('C1', 'C2') GROUP BY ALL),
 g AS (SELECT model, count(*) FILTER (a > 0.5 AND b <= 0.5) AS b, count(*) FILTER (a <= 0.5 AND b > 0.5) AS c FROM s GROUP BY model) SELECT model, b, c, CASE WHEN b + c > 0 THEN round((abs(b - c) - CAST(1 AS DOUBLE)) ** 2 / (b + c), 6) END AS chi2 FROM g""",
    "spearman_depth": R + """, k AS (SELECT model, rank() OVER (PARTITION BY model ORDER BY depth) + (count(*) OVER (PARTITION BY model, depth) - 1) / CAST(2 AS DOUBLE) AS a, rank() OVER (PARTITION BY model ORDER BY confidence) + (count(*) OVER (PARTITION BY model, confidence) - 1) / CAST(2 AS DOUBLE) AS b FROM x)
 SELECT model, round(corr(a, b), 6) AS rho, count(*) AS n FROM k GROUP BY model""",
    "dataset_stats_grouping_sets": R + " SELECT coalesce(topology, 'all') AS topology, coalesce(difficulty, 'all') AS difficulty, count(*) AS n, round(avg(correct), 6) AS positive_share, max(depth) AS max_depth FROM x GROUP BY CUBE (topology, difficulty)",
    "complete_models": R + " SELECT model, count(DISTINCT (topology, difficulty)) AS n_cells FROM x GROUP BY model HAVING count(DISTINCT (topology, difficulty)) = (SELECT count(DISTINCT (topology, difficulty)) FROM x)",
    "latex_rows": R + r" SELECT model, model || ' & ' || printf('%.1f', avg(correct) * 100) || ' & ' || count(*) || ' \\' AS tex FROM x GROUP BY model",
}
