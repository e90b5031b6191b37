"""Queries on pools, relation tables and statistics, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import pick
from ..operators import analytics, generate, pools
from ..sources.views import graph_keys, results, table, taxonomy_edges
from .datasets import SEEDS
from .oracle import ANC, LIN, R, T, _key, _num, _unit
from .population import query

CN = """e AS (SELECT 'n' || n_nationkey AS start_fk, 'r' || n_regionkey AS end_fk, 1 AS rel_fk, CAST(n_nationkey AS DOUBLE) AS weight FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 2 END, s_acctbal FROM supplier),
u AS (SELECT 'r' || r_regionkey AS pk, '/c/en/' || lower(r_name) || '/n' AS url FROM region UNION ALL SELECT 'n' || n_nationkey, '/c/en/' || lower(n_name) FROM nation UNION ALL SELECT 's' || s_suppkey, '/c/en/' || s_name || '/n/wn' FROM supplier),
x AS (SELECT a.url AS start, CASE rel_fk WHEN 1 THEN '/r/IsA' ELSE '/r/HasProperty' END AS relation, b.url AS "end", weight FROM e JOIN u a ON a.pk = start_fk JOIN u b ON b.pk = end_fk)"""


def _concepts(spark, sf):
    n, s, r = (table(spark, sf, t) for t in ("nation", "supplier", "region"))
    of = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = n.select(of("n", "n_nationkey").alias("start_fk"), of("r", "n_regionkey").alias("end_fk"), F.lit(1).alias("rel_fk"), F.col("n_nationkey").cast("double").alias("weight"))
    edges = edges.union(s.select(of("s", "s_suppkey"), of("n", "s_nationkey"), F.when(F.col("s_suppkey") % 2 == 0, 1).otherwise(2), "s_acctbal"))
    url = lambda p, key, name, tail: [of(p, key), F.concat(F.lit("/c/en/"), name, F.lit(tail))]
    k, u = url("r", "r_regionkey", F.lower("r_name"), "/n")
    nodes = r.select(k.alias("node_pk"), u.alias("node_url")).union(n.select(*url("n", "n_nationkey", F.lower("n_name"), ""))).union(s.select(*url("s", "s_suppkey", F.col("s_name"), "/n/wn")))
    return pools.concept_edges(edges, nodes, spark.createDataFrame([(1, "/r/IsA"), (2, "/r/HasProperty")], "rel_pk int, rel_url string"))


@query(f"WITH {CN} SELECT DISTINCT start, relation FROM x")
def concept_relations(spark, sf):
    """The distinct relations that start at each node."""
    return _concepts(spark, sf).select("start", "relation").distinct()


@query(f"WITH {CN} SELECT DISTINCT split_part(split_part(\"end\", '/c/en/', 2), '/', 1) AS parent, split_part(split_part(start, '/c/en/', 2), '/', 1) AS child FROM x WHERE relation = '/r/IsA'")
def concept_subclasses(spark, sf):
    """Distinct subclasses of each concept, without suffixes."""
    c = _concepts(spark, sf).where("relation = '/r/IsA'")
    return c.select(pools.concept(F.col("end")).alias("parent"), pools.concept(F.col("start")).alias("child")).distinct()


@query(f"WITH {CN} SELECT start, split_part(\"end\", '/c/en/', 2) AS target, weight, CAST(row_number() OVER (PARTITION BY start ORDER BY weight DESC, \"end\") AS INT) AS r FROM x WHERE relation = '/r/HasProperty'")
def concept_properties(spark, sf):
    """Properties of each node by weight, with their suffixes."""
    from pyspark.sql.window import Window

    c = _concepts(spark, sf).where("relation = '/r/HasProperty'")
    r = F.row_number().over(Window.partitionBy("start").orderBy(F.col("weight").desc(), "end"))
    return c.select("start", pools.concept(F.col("end"), suffix=True).alias("target"), "weight", r.alias("r"))


@query(f"""WITH RECURSIVE {T}, d(root, node, depth) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey, 0 FROM region UNION ALL SELECT root, src, depth + 1 FROM d JOIN t ON t.dst = d.node WHERE depth < 2) SELECT root, node, min(depth) AS depth FROM d GROUP BY root, node""")
def populated_nodes(spark, sf):
    """What is reached from each region within two steps, at its least depth."""
    e = taxonomy_edges(spark, sf).select(F.col("dst").alias("parent"), F.col("src").alias("child"))
    return pools.reached(e, table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("root")), 2)


@query("""WITH c AS (SELECT p_partkey AS child, CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 5 = 0 THEN 'Q' || p_partkey ELSE p_name END AS label FROM part), a AS (SELECT l_partkey AS child, string_agg(DISTINCT l_shipmode, '|' ORDER BY l_shipmode) AS aliases FROM (SELECT l_partkey, l_returnflag || l_linestatus AS l_shipmode FROM lineitem WHERE l_linenumber > 3) GROUP BY 1)
SELECT c.child, label, aliases FROM c LEFT JOIN a USING (child) WHERE label <> '' AND NOT starts_with(label, 'Q')""")
def children_with_alias(spark, sf):
    """Children with their optional aliases; rows without a real label are left out."""
    c = table(spark, sf, "part").select(F.col("p_partkey").alias("child"), F.when(F.col("p_partkey") % 7 == 0, "").when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("Q"), F.col("p_partkey").cast("string"))).otherwise(F.col("p_name")).alias("label"))
    a = table(spark, sf, "lineitem").where("l_linenumber > 3").select(F.col("l_partkey").alias("child"), F.concat("l_returnflag", "l_linestatus").alias("alias"))
    return pools.with_alias(c, a)


_LEX = """lx AS (SELECT p_brand AS word, ['ml', 'rel_gen', 'rel_com', 'sl', 'rel_trg', 'rel_syn', 'rel_ant'][p_partkey % 7 + 1] AS relation, split_part(p_name, ' ', 1) AS found FROM part)"""


@query(f"WITH {_LEX} SELECT DISTINCT word, found FROM (SELECT word, found FROM lx WHERE relation IN ('ml', 'rel_gen', 'rel_com', 'sl', 'rel_trg') AND regexp_matches(found, '^[A-Za-z]+$') UNION ALL SELECT word, word FROM lx)")
def lexical_corpus(spark, sf):
    """Words of five relations and the word itself, each once."""
    codes = F.array(*map(F.lit, ["ml", "rel_gen", "rel_com", "sl", "rel_trg", "rel_syn", "rel_ant"]))
    lx = table(spark, sf, "part").select(F.col("p_brand").alias("word"), F.element_at(codes, (F.col("p_partkey") % 7 + 1).cast("int")).alias("relation"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("found"))
    return pools.word_corpus(lx, lx.select("word").distinct())


_POOL = """pl AS (SELECT p_brand AS domain, CAST(split_part(p_brand, '#', 2) AS INT) AS domain_ord, p_type AS attribute, min(p_name) AS template FROM part GROUP BY ALL),
wt AS (SELECT s_suppkey AS key, CASE WHEN s_suppkey % 4 = 0 THEN 'nowhere' WHEN s_suppkey % 4 = 1 THEN upper(b) ELSE b END AS domain FROM (SELECT s_suppkey, (SELECT list(DISTINCT p_brand ORDER BY p_brand) FROM part)[s_suppkey % 5 + 1] AS b FROM supplier)),
ow AS (SELECT wt.*, (SELECT min(domain) FROM pl WHERE lower(pl.domain) = lower(wt.domain)) AS own FROM wt),
fl AS (SELECT attribute, arg_min(domain, domain_ord) AS domain, arg_min(template, domain_ord) AS template FROM pl GROUP BY attribute)"""


def _pool(spark, sf):
    pl = table(spark, sf, "part").groupBy(F.col("p_brand").alias("domain"), F.split_part("p_brand", F.lit("#"), F.lit(2)).cast("int").alias("domain_ord"), F.col("p_type").alias("attribute")).agg(F.min("p_name").alias("template"))
    brands = table(spark, sf, "part").agg(F.array_sort(F.collect_set("p_brand")).alias("bs"))
    b = F.get("bs", (F.col("s_suppkey") % 5).cast("int"))
    wt = table(spark, sf, "supplier").join(F.broadcast(brands)).select(F.col("s_suppkey").alias("key"), F.when(F.col("s_suppkey") % 4 == 0, "nowhere").when(F.col("s_suppkey") % 4 == 1, F.upper(b)).otherwise(b).alias("domain"))
    return pl, wt


@query(f"""WITH {_POOL}, own AS (SELECT ow.key, attribute, own AS from_domain, row_number() OVER (PARTITION BY ow.key ORDER BY {_key('dom', 'own', 'attribute')}, attribute) AS rank, count(*) OVER (PARTITION BY ow.key) AS size FROM ow JOIN pl ON pl.domain = own),
ns AS (SELECT ow.key, ow.own, (SELECT count(*) FROM pl WHERE pl.domain = ow.own) AS size FROM ow),
fi AS (SELECT ns.key, attribute, fl.domain AS from_domain, size, row_number() OVER (PARTITION BY ns.key ORDER BY {_key('cross', 'attribute')}, attribute) AS n FROM ns CROSS JOIN fl WHERE size < 200 AND NOT EXISTS (SELECT 1 FROM pl WHERE pl.domain = ns.own AND pl.attribute = fl.attribute))
SELECT key, attribute, from_domain, CAST(rank AS INT) AS rank FROM own WHERE rank <= 200 UNION ALL SELECT key, attribute, from_domain, CAST(size + n AS INT) FROM fi WHERE n <= 200 - size""")
def domain_attribute_sampling(spark, sf):
    """200 attributes of each key's domain; the rest from the first domain that has one."""
    return pools.domain_attributes(*_pool(spark, sf), 200)


@query(f"""WITH {_POOL}, ex AS (SELECT key, attribute FROM ow JOIN fl ON {_num('ex', 'key', 'attribute')} % 9 = 0),
r AS (SELECT ow.key, ow.own, attribute, template, CAST(row_number() OVER (PARTITION BY ow.key ORDER BY {_key('dirr', 'attribute')}, attribute) AS INT) AS rank FROM ow CROSS JOIN fl WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.key = ow.key AND ex.attribute = fl.attribute))
SELECT key, r.attribute, coalesce(pl.template, r.template) AS template, rank FROM r LEFT JOIN pl ON pl.domain = own AND pl.attribute = r.attribute WHERE rank <= 3""")
def domain_irrelevant_sampling(spark, sf):
    from ..functions.hashing import number

    pl, wt = _pool(spark, sf)
    ex = wt.select("key").join(pl.select("attribute").distinct()).where(number("ex", "key", "attribute") % 9 == 0)
    return pools.domain_irrelevant(pl, wt, ex, 3)


@query(f"""WITH b AS (SELECT DISTINCT n_name AS word, r_name AS domain FROM nation JOIN region ON n_regionkey = r_regionkey), nm AS (SELECT list(DISTINCT domain ORDER BY domain) AS l FROM b),
w AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN 'moon' ELSE lower(l[c_custkey % len(l) + 1]) END AS concept, l FROM customer, nm),
d AS (SELECT key, coalesce(list_filter(l, lambda x: lower(x) = lower(concept))[1], l[{_num('bank', 'key')} % len(l) + 1]) AS domain FROM w), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY domain ORDER BY {_key('nonce', 'domain', 'word')}, word) AS INT) AS rank FROM b)
SELECT key, word, rank FROM d JOIN k USING (domain) WHERE rank <= 2""")
def nonce_sampling(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    b = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("word"), F.col("r_name").alias("domain")).distinct()
    names = b.agg(F.array_sort(F.collect_set("domain")).alias("l"))
    w = table(spark, sf, "customer").join(F.broadcast(names)).select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 3 == 0, "moon").otherwise(F.lower(F.get("l", (F.col("c_custkey") % F.size("l")).cast("int")))).alias("concept"))
    return pools.nonce_sample(b, w, 2)


@query("""WITH n AS (SELECT unnest(['Ada', 'Bo', 'Cy']) AS x), k AS (SELECT c_custkey, list(x ORDER BY md5('42|source|' || c_custkey || '|' || x)) AS l FROM customer CROSS JOIN n GROUP BY 1) SELECT c_custkey, array_to_string(l, ',') || ',Source 4,Source 5' AS names FROM k""")
def source_name_sampling(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.array_join(pools.source_names(["Ada", "Bo", "Cy"], F.col("c_custkey"), 5), ",").alias("names"))


_LETTER = "substr('{0}', CAST(CAST('0x' || substr(md5('42|letter|' || k || '|' || (i - 1)), 1, 7) AS BIGINT) % {1} + 1 AS INT), 1)"


@query(f"""WITH w AS (SELECT p_partkey AS k, lower(split_part(p_name, ' ', 1)) AS s FROM part), c AS (SELECT k, s, i, substr(s, CAST(i AS INT), 1) AS ch FROM (SELECT k, s, unnest(range(1, len(s) + 1)) AS i FROM w)),
l AS (SELECT k, string_agg(CASE WHEN ch IN ('a', 'e', 'i', 'o', 'u') THEN {_LETTER.format('aeiou', 5)} ELSE {_LETTER.format('bcdfghjklmnpqrstvwxyz', 21)} END, '' ORDER BY i) AS v FROM c GROUP BY k) SELECT k AS p_partkey, upper(substr(v, 1, 1)) || substr(v, 2) AS word FROM l""")
def pseudowords(spark, sf):
    """Words of the same pattern of vowels and consonants as a reference word."""
    return table(spark, sf, "part").select("p_partkey", pools.pseudoword(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))), F.col("p_partkey")).alias("word"))


_WORDS = "['young cat', 'used for carrying', 'a kind of tree', 'ADULT bird', 'the role of a king', '', 'plain']"


@query(f"""SELECT p_partkey, CASE WHEN regexp_matches(lower({_WORDS}[p_partkey % 7 + 1]), 'young|immature|baby|juvenile|adult|female|male|castrated|used for|kept for|trained|raised|having powers of|role|state|condition|ability') THEN 'property' ELSE 'subclass' END AS kind FROM part""")
def definition_kinds(spark, sf):
    """Whether a definition is that of a property or of a subclass, by its words."""
    words = F.array(*map(F.lit, ["young cat", "used for carrying", "a kind of tree", "ADULT bird", "the role of a king", "", "plain"]))
    return table(spark, sf, "part").select("p_partkey", pools.edge_kind(F.element_at(words, (F.col("p_partkey") % 7 + 1).cast("int"))).alias("kind"))


@query(f"""WITH c AS (SELECT i AS graph_id, [4, 5, 6][{_num('variant', 'i')} % 3 + 1] AS length FROM (SELECT c_custkey AS i FROM customer) q), s AS (SELECT *, CASE length WHEN 4 THEN 0.8 WHEN 5 THEN 0.6 ELSE 0.5 END::DOUBLE AS lo, CASE length WHEN 4 THEN 1.0 WHEN 5 THEN 0.8 ELSE 0.75 END::DOUBLE AS hi FROM c),
m AS (SELECT *, CAST(least(greatest(greatest(1, floor(lo * length)), floor(hi * length)), length - 1) AS BIGINT) AS mx FROM s), n AS (SELECT *, CAST(least(greatest(1, floor(lo * length)), mx) AS BIGINT) AS mn FROM m), k AS (SELECT *, mn + {_num('share', 'graph_id')} % (mx - mn + 1) AS n FROM n),
d AS (SELECT graph_id, n, unnest(range(1, length)) AS depth FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY {_key('depth', 'graph_id', 'depth')}) AS serial FROM d)
SELECT graph_id, CAST(depth AS INT) AS depth, CASE WHEN {_unit('lsign', 'graph_id', 'depth')} < 0.5 THEN 'defeasible_has_property' ELSE 'defeasible_lacks_property' END AS type, CAST(serial AS INT) AS serial FROM r WHERE serial <= n""")
def linear_evidence_by_share(spark, sf):
    """Variants of easy chains, each with its share of evidence, revealed in hash order."""
    v = pools.LINEAR_VARIANTS["easy"]
    g = graph_keys(spark, sf).select(F.col("id").alias("graph_id"), pick([x[0] for x in v], "variant", "id").alias("length"))
    of = lambda i: F.when(F.col("length") == v[0][0], F.lit(v[0][i])).when(F.col("length") == v[1][0], F.lit(v[1][i])).otherwise(F.lit(v[2][i]))
    return pools.evidence_by_share(g.withColumns({"lo": of(1), "hi": of(2)}))


@query("SELECT c_custkey AS graph_id, c_custkey % 20 AS seed_index, CAST([" + ", ".join(map(str, SEEDS)) + "][c_custkey % 20 + 1] AS INT) AS seed FROM customer")
def seed_manifest(spark, sf):
    """The seed of the run that each graph is dealt to."""
    run = F.col("id") % len(SEEDS)
    return graph_keys(spark, sf).select(F.col("id").alias("graph_id"), run.alias("seed_index"), F.element_at(F.array(*map(F.lit, SEEDS)), (run + 1).cast("int")).alias("seed"))


@query(f"WITH {LIN} SELECT graph_id, src AS node, dst AS neighbour FROM lin WHERE type = 'inheritance'")
def typed_neighbours(spark, sf):
    from ..operators.structures import neighbours

    return neighbours(generate.linear_graphs(spark, graph_keys(spark, sf)), "inheritance")


@query(R + """, g AS (SELECT model, topology, avg(correct) AS a, avg(correct) FILTER (cls = 'C0') AS e, avg(correct) FILTER (cls <> 'C0') AS f FROM x GROUP BY ALL)
SELECT model, topology || ' entailment' AS config, round(e, 6) AS accuracy FROM g WHERE topology = 'F' UNION ALL SELECT model, topology || ' effect', round(f, 6) FROM g WHERE topology = 'F' UNION ALL SELECT model, topology, round(a, 6) FROM g WHERE topology <> 'F'""")
def accuracy_unpivot(spark, sf):
    return analytics.accuracy_by_task(results(spark, sf))


@query(R + """, s AS (SELECT model, seed, avg(correct) AS acc FROM x GROUP BY ALL), q AS (SELECT model, quantile_cont(acc, 0.25) AS q1, quantile_cont(acc, 0.5) AS q2, quantile_cont(acc, 0.75) AS q3 FROM s GROUP BY model),
m AS (SELECT *, acc >= q1 - 1.5::DOUBLE * (q3 - q1) AND acc <= q3 + 1.5::DOUBLE * (q3 - q1) AS ok FROM s JOIN q USING (model)) SELECT model, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3, round(min(acc) FILTER (ok), 6) AS low, round(max(acc) FILTER (ok), 6) AS high, count(*) FILTER (NOT ok) AS n_outliers FROM m GROUP BY model, q1, q2, q3""")
def accuracy_boxes(spark, sf):
    """Boxes over seeds."""
    return analytics.boxes(analytics.seed_accuracy(results(spark, sf)), ["model"], "acc")


@query(R + """, c AS (SELECT model, topology, depth, round(avg(correct), 6) AS mean_accuracy, coalesce(round(stddev_samp(correct) / sqrt(count(*)), 6), 0) AS s FROM x GROUP BY ALL)
SELECT model, topology, depth, mean_accuracy, round(greatest(0.0::DOUBLE, mean_accuracy - s), 6) AS low, round(least(1.0::DOUBLE, mean_accuracy + s), 6) AS high FROM c""")
def depth_bands(spark, sf):
    return analytics.depth_band(results(spark, sf))


@query(R + " SELECT model, seed, CAST((depth - 1) // 2 * 2 + 1 AS INT) AS lo, round(avg(correct), 6) AS accuracy FROM x GROUP BY ALL")
def depth_bins_by_seed(spark, sf):
    return analytics.seed_bins(results(spark, sf), "depth", 2)


@query(R + ", s AS (SELECT model, seed, avg(correct) AS a, avg(depth) AS d FROM x GROUP BY ALL) SELECT model, round(regr_slope(a, d), 6) AS slope, round(regr_intercept(a, d), 6) AS intercept, count(*) AS n FROM s GROUP BY model HAVING count(*) >= 3")
def chain_length_trend(spark, sf):
    return analytics.length_trend(results(spark, sf))


@query("""WITH k AS (SELECT l_orderkey, max(CAST(l_discount >= CAST(0.04 AS DOUBLE) AS INT)) FILTER (l_linenumber = 1) AS a, max(CAST(l_discount >= CAST(0.04 AS DOUBLE) AS INT)) FILTER (l_linenumber = 2) AS b FROM lineitem GROUP BY 1 HAVING a IS NOT NULL AND b IS NOT NULL)
SELECT o_orderpriority AS model, count(*) FILTER (a = 1 AND b = 0) AS b, count(*) FILTER (a = 0 AND b = 1) AS c FROM k JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def mcnemar_turns(spark, sf):
    """Discordant pairs of turns of one conversation."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    ok = (F.col("l_discount") >= 0.04).cast("int")
    one = lambda n, name: li.where(F.col("l_linenumber") == n).groupBy("l_orderkey").agg(F.max(ok).alias(name))
    pairs = one(1, "first").join(one(2, "second"), "l_orderkey").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderpriority").alias("model"), F.col("l_orderkey").alias("pair"), "first", "second")
    return analytics.paired_mcnemar(pairs).select("model", "b", "c")
