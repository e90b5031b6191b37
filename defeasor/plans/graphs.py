"""Queries on graphs as tables, what is in force when, and intervals, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics, dialogues, distinct, generate, pools, records, structures, text
from ..sources.views import graph_keys, results, table
from .datasets import DG, _graphs
from .oracle import BUSHY, CONCEPT, ISA, LEAF, LIN, R, SA, _key, _unit
from .population import query


@query(f"""WITH {BUSHY}, {LEAF}, k AS (SELECT tn.* FROM tn WHERE layer > 0 AND NOT EXISTS (SELECT 1 FROM lf WHERE lf.graph_id = tn.graph_id AND lf.leaf = tn.node) AND {_unit('ev', 'graph_id', 'node')} < 0.6)
SELECT graph_id, node AS src, parent AS dst, 'inheritance' AS type, layer, CAST(NULL AS INT) AS serial FROM tn WHERE parent IS NOT NULL UNION ALL SELECT graph_id, node, 'Property', 'has_property', layer, NULL FROM tn WHERE parent IS NULL UNION ALL SELECT graph_id, leaf, 'Property', 'hypothesis_edge', layer, NULL FROM lf
 UNION ALL SELECT graph_id, node, 'Property', CASE WHEN {_unit('esign', 'graph_id', 'node')} < 0.5 THEN 'defeasible_has_property' ELSE 'defeasible_lacks_property' END, layer, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY {_key('eser', 'graph_id', 'node')}) AS INT) FROM k""")
def tree_graph_generate(spark, sf):
    return generate.tree_edges(generate.tree_nodes(spark, graph_keys(spark, sf), "bushy"))


@query(f"""WITH {DG} SELECT graph_id, 'Property_' || (length - 1) AS target, array_to_string([('Object_' || j) FOR j IN range(1, objects + 1)], ',') AS subjects FROM g""")
def hypothesis_discovery(spark, sf):
    """Targets with their subjects in the order of first sight."""
    return structures.hypotheses(_graphs(spark, sf)[1]).select("graph_id", "target", F.array_join("subjects", ",").alias("subjects"))


@query(f"""WITH {DG}, p AS (SELECT graph_id, 'Property_' || max(i) AS target, count(*) - 2 AS inner_nodes FROM ch GROUP BY graph_id) SELECT graph_id, target, CAST(inner_nodes AS BIGINT) AS inner_nodes FROM p""")
def leaf_targets(spark, sf):
    """The hypothesis' target of each graph and its number of inner properties."""
    n, e = _graphs(spark, sf)
    inner = structures.intermediate(n, e).groupBy("graph_id").agg(F.count(F.lit(1)).alias("inner_nodes"))
    return structures.leaf_target(n, e).join(inner, "graph_id").select("graph_id", "target", "inner_nodes")


@query(f"""WITH {DG} SELECT graph_id, 'property' AS kind, length AS n FROM g UNION ALL SELECT graph_id, 'entity', objects FROM g UNION ALL SELECT graph_id, 'irrelevant_property', irr FROM g UNION ALL SELECT graph_id, 'implies', length - 1 FROM g UNION ALL SELECT graph_id, 'is_a', objects FROM g
 UNION ALL SELECT graph_id, 'hypothesis_edge', objects FROM g UNION ALL SELECT graph_id, 'has_attribute', irr FROM g UNION ALL SELECT graph_id, CASE WHEN pol = 1 THEN 'defeasible_has_property' ELSE 'defeasible_lacks_property' END, count(*) FROM de GROUP BY 1, 2""")
def graph_summary(spark, sf):
    """Nodes and edges of each graph by kind."""
    n, e = _graphs(spark, sf)
    count = lambda t: t.groupBy("graph_id", F.col("type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return structures.union_of(count(n), count(e))


@query(f"""WITH {DG} SELECT graph_id, 'Property_' || i AS node_id, CAST(1 AS DOUBLE) AS x, CAST(i AS DOUBLE) AS y, '#82e0aa' AS colour FROM ch UNION ALL SELECT graph_id, 'Object_' || j, 0, j - 1, '#7fb3d5' FROM ob UNION ALL SELECT graph_id, 'Irrelevant_' || k, 2, k, '#d5d8dc' FROM ir""")
def graph_layouts(spark, sf):
    """Places in columns by kind, and colours."""
    n, e = _graphs(spark, sf)
    return structures.styles(n, e)[0].join(structures.layouts(n, e, "columns"), ["graph_id", "node_id"]).select("graph_id", "node_id", "x", "y", "colour")


@query(f"""WITH {DG}, n AS (SELECT graph_id, i AS node_ord, 'Property_' || i AS node_id FROM ch UNION ALL SELECT graph_id, j + 1000, 'Object_' || j FROM ob UNION ALL SELECT graph_id, k + 2000, 'Irrelevant_' || k FROM ir) SELECT * FROM n""")
def graph_round_trip(spark, sf):
    """Nodes after writing graphs as JSON and reading them back."""
    return structures.from_dictionaries(structures.dictionaries(*_graphs(spark, sf)))[0].select("graph_id", "node_ord", "node_id")


@query("""WITH e AS (SELECT s_suppkey AS subject, CASE WHEN s_suppkey % 2 = 0 THEN 'bypass' ELSE 'contradiction' END AS scenario, 'P' || s_nationkey AS node, s_suppkey % 3 AS b, s_suppkey % 3 + 2 AS a FROM supplier), m AS (SELECT *, unnest(range(0, 6)) AS serial FROM e)
SELECT subject, CAST(serial AS DOUBLE) AS serial, CASE WHEN b <= serial AND (scenario = 'bypass' OR serial < a) THEN node ELSE '' END AS denied, CASE WHEN scenario = 'bypass' AND a <= serial THEN 'P1>P4' ELSE '' END AS rules FROM m""")
def claims_in_force(spark, sf):
    """Denials and bypasses of older episodes that hold at each moment."""
    s = table(spark, sf, "supplier")
    bypass = F.col("s_suppkey") % 2 == 0
    b = (F.col("s_suppkey") % 3).cast("double")
    e = s.select(F.col("s_suppkey").alias("subject"), F.when(bypass, "bypass").otherwise("contradiction").alias("scenario"), F.concat(F.lit("P"), F.col("s_nationkey").cast("string")).alias("node"), b.alias("b_serial"), (b + 2).alias("a_serial"), F.when(bypass, "P1").alias("bypass_source"), F.when(bypass, "P4").alias("bypass_target"))
    m = s.select(F.col("s_suppkey").alias("subject"), F.explode(F.array(*[F.lit(float(t)) for t in range(6)])).alias("serial"))
    rule = F.transform("rules", lambda r: F.concat(r["bypass_source"], F.lit(">"), r["bypass_target"]))
    return records.in_force(e, m).select("subject", "serial", F.array_join("denied", ",").alias("denied"), F.array_join(rule, ",").alias("rules"))


@query("WITH t AS (SELECT unnest([" + ", ".join(f"'{x}'" for x in pools.TRAITS) + "]) AS x) SELECT c_custkey, array_to_string(list(x ORDER BY md5('42|source|' || c_custkey || '|' || x))[1:5], ',') AS traits FROM customer CROSS JOIN t GROUP BY 1")
def trait_sampling(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.array_join(pools.traits(F.col("c_custkey"), 5), ",").alias("traits"))


def _f(d1: str, d2: str) -> str:
    """The 0.975 quantile of F(d1, d2) in SQL: bisection over the angle t of the beta density in sin(t)^2, integrated by
    Simpson's rule."""
    density = f"CASE WHEN i = 0 THEN 0 ELSE exp(({d1} - 1) * ln(sin(t * i / 2000)) + ({d2} - 1) * ln(cos(t * i / 2000))) END"
    below = f"list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * ({density}))) * t / 6000"
    share = f"2 * exp(lgamma(({d1} + {d2}) / 2) - lgamma({d1} / 2) - lgamma({d2} / 2)) * {below}"
    half = f"SELECT v, d, (lo + hi) / 2 AS t, lo, hi, step FROM b WHERE step < 55"
    return f"(WITH RECURSIVE b(lo, hi, step, v, d) AS (SELECT 0::DOUBLE, pi() / 2, 0, v.v, v.n - 1 FROM v UNION ALL SELECT CASE WHEN {share} < 0.975 THEN t ELSE lo END, CASE WHEN {share} < 0.975 THEN hi ELSE t END, step + 1, v, d FROM ({half})) SELECT {d2} / {d1} * tan(lo) ** 2 FROM b WHERE step = 55)"


@query(SA + f""", a AS (SELECT *, avg(acc) OVER (PARTITION BY model) AS rm, avg(acc) OVER (PARTITION BY seed) AS cm, avg(acc) OVER () AS gm FROM sa),
b AS (SELECT count(DISTINCT model)::DOUBLE AS n, count(DISTINCT seed)::DOUBLE AS k, sum((rm - gm) ** 2) AS r, sum((cm - gm) ** 2) AS c, sum((acc - rm - cm + gm) ** 2) AS e FROM a),
m AS (SELECT n, k, r / (n - 1) AS r, c / (k - 1) AS c, e / ((n - 1) * (k - 1)) AS e FROM b), i AS (SELECT *, (r - e) / (r + (k - 1) * e + k * (c - e) / n) AS icc FROM m),
w AS (SELECT *, k * icc / (n * (1 - icc)) * c AS u, (1 + k * icc * (n - 1) / (n * (1 - icc))) * e AS t, k * c + (k * n - k - n) * e AS rest FROM i), v AS (SELECT *, (u + t) ** 2 / (u * u / (k - 1) + t * t / ((n - 1) * (k - 1))) AS v FROM w),
f AS (SELECT *, {_f('d', 'v')} AS lo, {_f('v', 'd')} AS hi FROM v) SELECT round(icc, 6) AS icc, round(n * (r - lo * e) / (lo * rest + n * r), 6) AS ci_low, round(n * (hi * r - e) / (rest + n * hi * r), 6) AS ci_high FROM f""")
def icc_with_interval(spark, sf):
    return analytics.icc_interval(results(spark, sf))


@query(SA + """, s AS (SELECT model, round(acc, 6) AS acc FROM sa), k AS (SELECT *, rank() OVER (ORDER BY acc) + (count(*) OVER (PARTITION BY acc) - 1) / CAST(2 AS DOUBLE) AS rk FROM s),
 g AS (SELECT model, sum(rk) AS r, count(*) AS n FROM k GROUP BY model), t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*) AS c FROM s GROUP BY acc)), q AS (SELECT sum(r * r / n) AS q, sum(n) AS tt FROM g),
 h AS (SELECT round((CAST(12 AS DOUBLE) / (tt * (tt + 1)) * q - 3 * (tt + 1)) / (1 - ties / (CAST(tt AS DOUBLE) * tt * tt - tt)), 6) AS h, CAST(tt AS BIGINT) AS n FROM q, t)
SELECT h, n, round(exp(-h / 2) * (1 + h / 2), 6) AS p, exp(-h / 2) * (1 + h / 2) < 0.05 AS significant FROM h""")
def kruskal_p_value(spark, sf):
    """The test of five models: four degrees of freedom."""
    return analytics.kruskal_test(results(spark, sf), 5)


@query(r"""WITH d AS (SELECT list_filter(list_transform(string_split(text, '.'), lambda x: trim(replace(x, chr(10), ' '))), lambda x: x <> '') AS l FROM documents), s AS (SELECT unnest(l) AS s FROM d), """ + ISA.format(cols="s") + " SELECT subject AS entity, count(DISTINCT value) AS n, md5(string_agg(DISTINCT value, '|' ORDER BY value)) AS subclasses FROM x GROUP BY 1")
def extracted_entities(spark, sf):
    """The distinct subclasses of each entity that sentences speak of."""
    s = table(spark, sf, "documents").select(F.explode(text.sentences(F.col("text"))).alias("s")).select("s", text.extract(F.col("s")).alias("e")).where("e.kind = 'isa'")
    e = pools.entity_sets(s.select(F.col("e.subject").alias("entity"), F.lit("isa").alias("kind"), F.col("e.value").alias("value"), F.lit("").alias("sentence")))
    return e.select("entity", F.size("subclasses").cast("bigint").alias("n"), F.md5(F.array_join("subclasses", "|").cast("binary")).alias("subclasses"))


@query(f"""WITH {DG}, e AS (SELECT graph_id, string_agg(j || ':' || (i + 1) || ':' || CASE WHEN pol = 1 THEN 'defeasible_has_property' ELSE 'defeasible_lacks_property' END, ',' ORDER BY j, i) AS e FROM de GROUP BY graph_id)
SELECT graph_id, md5({CONCEPT} || '|' || length || '|' || objects || '|' || irr || '|' || coalesce(e, '')) AS fingerprint FROM g LEFT JOIN e USING (graph_id)""")
def fingerprint_default(spark, sf):
    """Fingerprints of default graphs under a concept drawn for each."""
    return distinct.default_fingerprints(*_graphs(spark, sf), generate.drawn_choice("graph_id", generate.CONCEPTS))


@query()
def whole_conversations(spark, sf):
    """Evidence, irrelevant and quantified updates and episodes of two sources under a cap of 60 turns, one conversation for each
    customer's graph; tests hold it against a replay turn by turn."""
    return dialogues.whole_conversations(*_graphs(spark, sf), cap=60)


@query(f"""WITH {DG}, s AS (SELECT graph_id, 'Object_' || j AS subject, row_number() OVER (PARTITION BY graph_id ORDER BY {_key('late', 'graph_id', "'Object_' || j")}) AS o, objects FROM ob JOIN g USING (graph_id)),
t AS (SELECT * FROM s WHERE objects > 1 AND o <= least(objects - 1, greatest(1, round_even(objects * 0.5, 0)))), p AS (SELECT de.graph_id, subject, serial, i, row_number() OVER (PARTITION BY de.graph_id, j ORDER BY serial) AS r, count(*) OVER (PARTITION BY de.graph_id, j) AS n FROM de JOIN t ON t.graph_id = de.graph_id AND subject = 'Object_' || j WHERE pol = 1),
a AS (SELECT graph_id, subject, list(struct_pack(serial := serial, i := i) ORDER BY {_key('anchor', 'graph_id', 'subject', "'Property_' || i")}) AS a FROM p WHERE r > n // 2 GROUP BY ALL),
d AS (SELECT *, {", ".join(f"{_unit('source', 'graph_id', 'subject', str(k))} < 0.7 AS f{k}" for k in (0, 2, 4, 6))} FROM a),
e AS (SELECT graph_id, subject, 0 AS ep, a[1] AS x, f0 AS f, a, f0, f2, f4, f6 FROM d),
k AS (SELECT *, a[1].serial + CASE WHEN f0 THEN -0.5 ELSE 0.5 END AS b0, list_filter([f2, f4, f6], lambda f: a[2].serial + CASE WHEN f THEN -0.5 ELSE 0.5 END <> a[1].serial + CASE WHEN f0 THEN -0.5 ELSE 0.5 END) AS ok FROM e),
o AS (SELECT graph_id, subject, 0 AS ep, x, f0 AS first FROM k UNION ALL SELECT graph_id, subject, 1, a[2], ok[1] FROM k WHERE len(a) > 1 AND len(ok) > 0)
SELECT graph_id, subject, CAST(ep AS INT) AS ep, 'Property_' || x.i AS node, CAST(x.i AS INT) AS idx, first AS b_first, CAST(x.serial + CASE WHEN first THEN -0.5 ELSE 0.5 END AS DOUBLE) AS b_serial, CAST(x.serial AS DOUBLE) AS a_serial FROM o""")
def source_episodes(spark, sf):
    """Episodes of two sources on the subjects kept back for them, drawn with at most eight tries and two for a subject."""
    n, e = _graphs(spark, sf)
    late = dialogues.ordered_subjects(e, 0.5).where("late").select("graph_id", "subject")
    return dialogues.plan_episodes(records.chain_evidence(e).join(late, ["graph_id", "subject"], "left_semi"))


@query(f"""WITH {LIN}, evd AS (SELECT graph_id, src, layer, (type = 'defeasible_has_property')::INT AS pol, serial FROM lin WHERE type LIKE 'defeasible%'),
gr AS (SELECT graph_id, list(src) AS members, min(serial) AS f FROM evd GROUP BY graph_id HAVING count(*) >= 2 AND count(DISTINCT pol) = 2), sb AS (SELECT graph_id, 'Subclass_' || i AS subject, i AS own FROM st),
gev AS (SELECT graph_id, CAST(serial AS DOUBLE) AS tm, 'edge' AS kind, src, pol, members FROM evd AS e LEFT JOIN gr USING (graph_id) UNION ALL SELECT graph_id, f - 0.5, 'group', NULL, NULL, members FROM gr),
kn AS (SELECT e.*, CASE WHEN len(members) = 2 THEN f ELSE serial END AS since FROM evd AS e LEFT JOIN gr USING (graph_id)),
ans AS (SELECT gev.*, subject, CASE WHEN coalesce((SELECT max(layer * 2 + k.pol) FROM kn k WHERE k.graph_id = gev.graph_id AND since <= tm AND layer <= own), 1) % 2 = 1 THEN 'yes' ELSE 'no' END AS answer FROM gev JOIN sb USING (graph_id)),
eff AS (SELECT *, coalesce(lag(answer) OVER (PARTITION BY graph_id, subject ORDER BY tm), 'yes') AS before FROM ans)
SELECT graph_id, subject, CAST(tm AS DOUBLE) AS "at", kind, src AS source, answer, CASE WHEN kind = 'group' THEN 'no effect' WHEN coalesce(list_contains(members, subject) AND subject <> src, false) THEN CASE pol WHEN 0 THEN 'strengthen' ELSE 'weaken' END
 WHEN before <> 'yes' AND answer = 'yes' THEN 'strengthen' WHEN before = 'yes' AND answer <> 'yes' THEN 'weaken' WHEN pol = 1 THEN 'strengthen' ELSE 'weaken' END AS effect FROM eff""")
def linear_group_replay(spark, sf):
    """Class chains with exception groups: the announcement, inferred members of groups of two, and effects on every class."""
    lin = generate.linear_graphs(spark, graph_keys(spark, sf))
    layers = lin.where("type = 'inheritance'").select("graph_id", F.col("src").alias("node"), "layer")
    return records.grouped_replay(lin, layers, layers.select("graph_id", F.col("node").alias("subject")))


@query(R + """, k AS (SELECT topology, model, count(*) FILTER (cls = 'C1' AND correct = 1) + 0.5::DOUBLE AS a, count(*) FILTER (cls = 'C1' AND correct = 0) + 0.5::DOUBLE AS b, count(*) FILTER (cls = 'C2' AND correct = 1) + 0.5::DOUBLE AS c, count(*) FILTER (cls = 'C2' AND correct = 0) + 0.5::DOUBLE AS d FROM x GROUP BY ALL),
l AS (SELECT topology, model, ln(a * d / (b * c)) AS l, sqrt(1 / a + 1 / b + 1 / c + 1 / d) AS se FROM k), z AS (SELECT *, abs(l / se) AS z FROM l),
p AS (SELECT *, CASE WHEN z > 8 THEN 0 ELSE 1 - sqrt(2 / pi()) * z * exp(-z * z / 2) * list_reduce(list_reverse(range(1, 150)), lambda t, n: 1 + z * z / (2 * n + 1) * t, 1::DOUBLE) END AS p FROM z),
h AS (SELECT *, (count(*) OVER (PARTITION BY topology) - row_number() OVER (PARTITION BY topology ORDER BY p, model) + 1) * p AS step FROM p), s AS (SELECT *, least(1.0::DOUBLE, max(step) OVER (PARTITION BY topology ORDER BY p, model)) AS p_holm FROM h)
SELECT topology, model, round(exp(l), 6) AS odds_ratio, round(exp(l - 1.959963984540054::DOUBLE * se), 6) AS ci_low, round(exp(l + 1.959963984540054::DOUBLE * se), 6) AS ci_high, round(p_holm, 6) AS p_holm, p_holm < 0.05 AS significant FROM s""")
def bias_odds(spark, sf):
    """Odds ratios of congruent against incongruent items with intervals, p values corrected step by step for the models."""
    return analytics.bias_tests(results(spark, sf))
