"""Queries on claims of sources, concept chains and layouts, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import claims, generate, knowledge, populate, text
from ..sources.views import evidence, graph_keys, table, taxonomy_edges
from .oracle import BUSHY, E, T, _key, _num, _unit
from .population import query

PLAN = f"""WITH {E}, u AS (SELECT subject, subject // 20 AS conversation, CASE WHEN {_unit('scenario', 'subject')} < 0.5 THEN 'contradiction' ELSE 'bypass' END AS scenario,
 CASE WHEN {_unit('ordering', 'subject')} < CAST(0.7 AS DOUBLE) THEN 'b_first' ELSE 'a_first' END AS ordering, CAST({_num('source_a', 'subject')} % 2 AS INT) AS source_a FROM (SELECT DISTINCT subject FROM e)),
u2 AS (SELECT *, CAST(source_a + 1 + {_num('source_b', 'subject')} % (2 - source_a) AS INT) AS source_b, row_number() OVER (PARTITION BY conversation, source_a, scenario ORDER BY subject) AS turn FROM u),
po AS (SELECT subject, idx, row_number() OVER (PARTITION BY subject ORDER BY serial) AS r, count(*) OVER (PARTITION BY subject) AS n FROM e WHERE pol = 1),
ct AS (SELECT subject, arg_min(idx, {_key('contested', 'subject', 'idx')}) AS contested FROM po WHERE r > n // 2 GROUP BY subject),
op AS (SELECT a.i AS a_src, b.i AS a_tgt FROM range(10) a(i) JOIN range(10) b(i) ON b.i >= a.i + 3),
ranked AS (SELECT conversation, source_a, a_src, a_tgt, row_number() OVER (PARTITION BY conversation, source_a ORDER BY {_key('bypass', 'conversation', 'source_a', 'a_src', 'a_tgt')}) AS turn FROM (SELECT DISTINCT conversation, source_a FROM u), op),
span AS (SELECT a_src, a_tgt, x.i AS b_src, y.i AS b_tgt, row_number() OVER (PARTITION BY a_src, a_tgt ORDER BY x.i, y.i) - 1 AS nth, count(*) OVER (PARTITION BY a_src, a_tgt) AS n
 FROM op JOIN range(10) x(i) ON x.i > a_src AND x.i < a_tgt - 1 JOIN range(10) y(i) ON y.i > x.i AND y.i < a_tgt),
p AS (SELECT u2.subject, u2.conversation, scenario, ordering, u2.source_a, source_b, CASE scenario WHEN 'contradiction' THEN contested END AS contested,
 CAST(ranked.a_src AS INT) AS a_src, CAST(ranked.a_tgt AS INT) AS a_tgt, CAST(span.b_src AS INT) AS b_src, CAST(span.b_tgt AS INT) AS b_tgt,
 CASE WHEN scenario = 'contradiction' AND contested IS NULL THEN 'no positive evidence' WHEN scenario = 'bypass' AND ranked.a_src IS NULL THEN 'no unclaimed bypass' END AS skipped
 FROM u2 LEFT JOIN ct USING (subject) LEFT JOIN ranked ON scenario = 'bypass' AND ranked.conversation = u2.conversation AND ranked.source_a = u2.source_a AND ranked.turn = u2.turn
 LEFT JOIN span ON span.a_src = ranked.a_src AND span.a_tgt = ranked.a_tgt AND nth = {_num('inside', 'u2.subject')} % span.n),
q AS (SELECT * FROM p WHERE skipped IS NULL),
bw AS (SELECT subject, idx, pol FROM (SELECT e.subject, idx, pol, row_number() OVER (PARTITION BY e.subject ORDER BY {_key('between', 'e.subject', 'idx')}) AS r FROM e JOIN q ON q.subject = e.subject
 WHERE (scenario = 'contradiction' AND idx < contested) OR (scenario = 'bypass' AND idx <= b_src)) WHERE r = 1),
pt AS (SELECT subject, idx, pol FROM (SELECT e.subject, e.idx, e.pol, row_number() OVER (PARTITION BY e.subject ORDER BY {_key('after', 'e.subject', 'e.idx')}) AS r FROM e JOIN q ON q.subject = e.subject LEFT JOIN bw ON bw.subject = e.subject
 WHERE (bw.idx IS NULL OR e.idx <> bw.idx) AND ((scenario = 'contradiction' AND e.idx <> contested AND {_unit('post', 'e.subject')} < CAST(0.6 AS DOUBLE)) OR (scenario = 'bypass' AND e.idx <= a_src))) WHERE r = 1),
ev AS (SELECT subject, kind, idx, pol, CAST(row_number() OVER (PARTITION BY subject ORDER BY slot) AS INT) AS ord FROM (
 SELECT subject, CASE ordering WHEN 'a_first' THEN 1 ELSE 3 END AS slot, 'a_claim' AS kind, coalesce(contested, a_tgt) AS idx, 1 AS pol FROM q
 UNION ALL SELECT subject, CASE ordering WHEN 'b_first' THEN 1 ELSE 3 END, 'b_claim', coalesce(contested, b_tgt), -1 FROM q
 UNION ALL SELECT subject, 2, 'reveal', idx, pol FROM bw UNION ALL SELECT subject, 4, 'reveal', idx, pol FROM pt))"""

SAID = "CASE WHEN pol = 1 THEN 'Object ' || subject || ' has P' || idx || '.' ELSE 'object ' || subject || ' does not have P' || idx || '.' END"
REPLAY = f"""{PLAN}, steps AS (SELECT q.*, n FROM q, range(5) t(n)),
act AS (SELECT s.subject, s.n, s.scenario, s.a_src, s.a_tgt, v.kind, v.idx, v.pol, bool_or(v.kind = 'a_claim') OVER (PARTITION BY s.subject, s.n) AS spoke FROM steps s JOIN ev v ON v.subject = s.subject AND v.ord <= s.n),
live AS (SELECT *, pol = 1 AND (kind = 'reveal' OR scenario = 'contradiction') AS isp, pol = -1 AND (kind = 'reveal' OR NOT (scenario = 'contradiction' AND spoke)) AS isn FROM act),
agg AS (SELECT subject, n, bool_or(spoke AND scenario = 'bypass') AS rule, any_value(a_tgt) AS tgt, coalesce(max(idx) FILTER (isp), -1) AS p, coalesce(max(idx) FILTER (isn), -1) AS q, coalesce(max(idx) FILTER (isp AND idx <= a_src), 0) AS pj,
 coalesce(max(idx) FILTER (isn AND idx <= a_src), -1) AS qj, coalesce(bool_or(isn AND idx = a_tgt), false) AS denied, len(list_intersect(coalesce(list(idx) FILTER (isp), []), coalesce(list(idx) FILTER (isn), []))) > 0 AS clash FROM live GROUP BY subject, n),
st AS (SELECT s.subject, s.n, coalesce(p, -1) AS p, coalesce(a.q, -1) AS q, CASE WHEN clash THEN 'UNDETERMINED' WHEN greatest(coalesce(p, -1), 0, CASE WHEN rule AND NOT denied AND pj >= qj THEN tgt ELSE 0 END) >= coalesce(a.q, -1) THEN 'ENTAILED' ELSE 'DEFEATED' END AS state
 FROM steps s LEFT JOIN agg a ON a.subject = s.subject AND a.n = s.n),
j AS (SELECT q.*, v.ord, v.kind, v.idx, v.pol, b.p AS pb, b.q AS qb, b.state AS before, a.state AS state FROM ev v JOIN q ON q.subject = v.subject JOIN st b ON b.subject = v.subject AND b.n = v.ord - 1 JOIN st a ON a.subject = v.subject AND a.n = v.ord),
k AS (SELECT *, CASE WHEN before = state THEN 'no_effect' WHEN state = 'ENTAILED' THEN 'strengthening' WHEN before = 'ENTAILED' THEN 'weakening' WHEN before = 'UNDETERMINED' AND state = 'DEFEATED' THEN 'weakening' ELSE 'no_effect' END AS delta FROM j)
SELECT subject, ord AS event_ord, 'type4_' || CASE kind WHEN 'reveal' THEN 'edge_reveal' ELSE kind END AS update_type, CAST(idx AS INT) AS idx, CAST(9 - idx AS INT) AS hyp_node_distance, before AS state_before, state,
 CASE state WHEN 'ENTAILED' THEN 'yes' WHEN 'DEFEATED' THEN 'no' ELSE 'unknown' END AS answer,
 CASE WHEN kind = 'reveal' AND pol = 1 AND before = 'ENTAILED' AND state = 'ENTAILED' THEN CASE WHEN idx >= greatest(pb, qb) THEN 'strengthening' ELSE 'no_effect' END
 WHEN kind = 'a_claim' AND (scenario = 'bypass' OR ordering = 'a_first') THEN 'strengthening' WHEN kind = 'b_claim' AND scenario = 'contradiction' AND ordering = 'a_first' THEN 'no_effect' ELSE delta END AS effect,
 CASE WHEN kind = 'reveal' THEN {SAID} ELSE 'Expert ' || chr(65 + CASE kind WHEN 'a_claim' THEN source_a ELSE source_b END) || ' reports: ' || CASE scenario WHEN 'contradiction' THEN {SAID}
 ELSE 'objects with property P' || CASE kind WHEN 'a_claim' THEN a_src ELSE b_src END || ' generally ' || CASE kind WHEN 'a_claim' THEN '' ELSE 'do not ' END || 'have P' || idx || '.' END END AS sentence FROM k"""


def _plans(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty subjects share a conversation."""
    e = evidence(spark, sf).withColumn("conversation", F.floor(F.col("subject") / 20).cast("bigint"))
    return claims.plan_claims(e, chain_length=10, sources=3)


@query(f"""{PLAN} SELECT subject, conversation, scenario, ordering, source_a, source_b, contested, a_src, a_tgt, b_src, b_tgt, CAST((SELECT count(*) FROM ev WHERE ev.subject = p.subject) AS INT) AS n_events, skipped FROM p""")
def source_claim_plan(spark, sf):
    """Who claims what, with evidence revealed between and after the claims."""
    n = F.coalesce(F.size("events"), F.lit(0))
    return _plans(spark, sf).select("subject", "conversation", "scenario", "ordering", "source_a", "source_b", "contested", "a_src", "a_tgt", "b_src", "b_tgt", F.greatest(n, F.lit(0)).alias("n_events"), "skipped")


@query(REPLAY)
def source_claim_replay(spark, sf):
    """States, answers, effects and sentences while the claims and reveals of a plan come in."""
    return claims.replay_claims(_plans(spark, sf), chain_length=10)


@query(f"""{PLAN} SELECT scenario, ordering, coalesce(skipped, 'planned') AS outcome, count(*) AS n FROM p GROUP BY ALL""")
def source_claim_report(spark, sf):
    """Plans and skipped subjects by kind."""
    return claims.plan_report(_plans(spark, sf))


# At layer 0 the root has height 4; a chain of five concepts therefore ends in one made-up word.
@query(f"""WITH {T}, kids AS (SELECT dst, src, {_key('step', 'dst', 'src')} AS k FROM t),
h3 AS (SELECT DISTINCT dst AS node FROM kids), h2 AS (SELECT DISTINCT dst AS node FROM kids WHERE src IN (SELECT node FROM h3)),
hh AS (SELECT src, dst, k, CASE WHEN src IN (SELECT node FROM h2) THEN 3 WHEN src IN (SELECT node FROM h3) THEN 2 ELSE 1 END AS h FROM kids),
best AS (SELECT dst, src FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY h DESC, k) AS r FROM hh) WHERE r = 1),
c AS (SELECT 'r' || r_regionkey AS start FROM region), c2 AS (SELECT start, src AS b FROM c LEFT JOIN best ON dst = start), c3 AS (SELECT start, b, src AS d FROM c2 LEFT JOIN best ON dst = b)
SELECT start, unnest([0, 1, 2, 3, 4]) AS pos, unnest([start, coalesce(b, 'w0'), coalesce(d, CASE WHEN b IS NULL THEN 'w1' ELSE 'w0' END),
 CASE WHEN d IS NOT NULL THEN 'w0' WHEN b IS NOT NULL THEN 'w1' ELSE 'nonce_entity_2' END, CASE WHEN d IS NOT NULL THEN 'w1' WHEN b IS NOT NULL THEN 'nonce_entity_2' ELSE 'nonce_entity_3' END]) AS label FROM c3""")
def ontology_chain(spark, sf):
    """Five concepts down from each region, filled up from two made-up words and then by number."""
    starts = table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("start"))
    return knowledge.concept_chains(taxonomy_edges(spark, sf), starts, 5, ["w0", "w1"])


@query(f"""WITH {BUSHY}, lf AS (SELECT graph_id, node, parent, layer, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY node) AS DOUBLE) AS x FROM tn a WHERE NOT EXISTS (SELECT 1 FROM tn b WHERE b.graph_id = a.graph_id AND b.parent = a.node)),
x1 AS (SELECT graph_id, node, parent, layer, x FROM lf WHERE layer = 1 UNION ALL SELECT t.graph_id, t.node, t.parent, t.layer, avg(lf.x) FROM tn t JOIN lf ON lf.graph_id = t.graph_id AND lf.parent = t.node WHERE t.layer = 1 GROUP BY ALL),
x0 AS (SELECT t.graph_id, t.node, avg(x1.x) AS x, t.layer FROM tn t JOIN x1 ON x1.graph_id = t.graph_id AND x1.parent = t.node WHERE t.layer = 0 GROUP BY ALL)
SELECT graph_id, node, round(x, 6) AS x, -layer AS y FROM (SELECT graph_id, node, x, layer FROM lf WHERE layer = 2 UNION ALL SELECT graph_id, node, x, layer FROM x1 UNION ALL SELECT * FROM x0)""")
def tree_layout(spark, sf):
    """Places of the nodes of class trees: leaves in order, parents above the middle of their children."""
    return populate.tree_layout(generate.tree_nodes(spark, graph_keys(spark, sf), "bushy"), depth=2)


@query(f"""WITH a AS (SELECT p_partkey, string_split(p_name, ' ')[1] AS modifier, string_split(p_type, ' ')[1] AS base FROM part),
w AS (SELECT DISTINCT upper(substr(modifier, 1, 1)) || lower(substr(modifier, 2)) || ' ' || upper(substr(base, 1, 1)) || lower(substr(base, 2)) AS word FROM a) SELECT word, length(word) AS n FROM w""")
def compound_words(spark, sf):
    """Distinct words of two capitalised parts."""
    p = table(spark, sf, "part").select(F.get(F.split("p_name", " "), F.lit(0)).alias("modifier"), F.get(F.split("p_type", " "), F.lit(0)).alias("base"))
    return text.compounds(p, ["modifier", "base"]).select("word", F.length("word").cast("bigint").alias("n"))
