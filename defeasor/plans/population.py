"""Queries that name and fill graphs, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import generate, populate, text, walks
from ..functions.hashing import number
from ..functions.stored import fresh_path
from ..sources.documents import read_documents
from ..sources.views import graph_keys, results, table, taxonomy_edges
from .oracle import BUSHY, LIN, R, T, _key, _num, _unit

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _names(spark, sf) -> DataFrame:
    return table(spark, sf, "region").select(F.col("r_regionkey").alias("pos"), F.col("r_name").alias("name"))


@query(f"""WITH {BUSHY}, b AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY layer, node) - 1 AS pos FROM tn)
SELECT graph_id, node, CAST(pos AS INT) AS pos, coalesce(r_name, 'concept_' || pos) AS label FROM b LEFT JOIN region ON r_regionkey = pos""")
def tree_concept_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Class nodes in breadth-first order take the concepts of a list."""
    return populate.labelled_by_position(populate.breadth_first(generate.tree_nodes(spark, graph_keys(spark, sf), "bushy")), _names(spark, sf), "concept")


@query(f"""WITH {LIN} SELECT graph_id, src AS node, layer AS pos, coalesce(r_name, 'concept_' || layer) AS label
FROM (SELECT DISTINCT graph_id, src, layer FROM lin WHERE type IN ('inheritance', 'has_property')) LEFT JOIN region ON r_regionkey = layer""")
def linear_concept_labels(spark, sf):
    """Classes of a chain take the concept of their layer."""
    g = generate.linear_graphs(spark, graph_keys(spark, sf)).where("type in ('inheritance', 'has_property')")
    return populate.labelled_by_position(g.select("graph_id", F.col("src").alias("node"), F.col("layer").alias("pos")).distinct(), _names(spark, sf), "concept")


@query(f"""WITH p AS (SELECT grp, name, row_number() OVER (PARTITION BY grp ORDER BY {_key("pad", "grp", "name")}, name) - 1 AS r, count(*) OVER (PARTITION BY grp) AS size FROM (SELECT DISTINCT s_nationkey AS grp, s_name AS name FROM supplier)),
w AS (SELECT n_nationkey AS key, unnest(range(12)) AS i FROM nation), z AS (SELECT DISTINCT grp, size FROM p)
SELECT key, CAST(i AS INT) AS i, CASE WHEN name IS NULL THEN 'entity_' || i WHEN i < p.size THEN name ELSE name || ' #' || i END AS label
FROM w LEFT JOIN z ON z.grp = key LEFT JOIN p ON p.grp = key AND p.r = i % z.size""")
def entity_labels_padded(spark, sf):
    """Twelve entity names for each nation."""
    pool = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("grp"), F.col("s_name").alias("name"))
    return populate.padded_sample(table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_nationkey").alias("grp"), F.lit(12).alias("n")), pool)


@query(f"""WITH pool AS (SELECT DISTINCT p_name AS attribute FROM part), d AS (SELECT DISTINCT p_type AS domain FROM part),
c AS (SELECT domain, attribute FROM d, pool WHERE (domain, attribute) NOT IN (SELECT p_type, p_name FROM part))
SELECT domain, attribute, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY domain ORDER BY {_key("irr", "domain", "attribute")}, attribute) AS INT) AS rank FROM c) WHERE rank <= 3""")
def irrelevant_attribute_sampling(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_type").alias("domain"), F.col("p_name").alias("attribute"))
    return populate.irrelevant_sample(p, p, p.distinct(), p.distinct().where("false"), 3)


def _grown(chain: int) -> str:
    """Property trees in SQL: each step draws one of the nodes that still take a child, for every graph."""
    room = lambda i: f"CASE WHEN {_unit('wide', 'id', i)} < 0.3 THEN 2 + {_num('cap', 'id', i)} % 2 ELSE 1 END"
    node = lambda i, parent, layer: f"{{'node': CAST({i} AS INT), 'parent': CAST({parent} AS INT), 'layer': CAST({layer} AS INT), 'room': CAST({room(i)} AS INT)}}"
    return f"""RECURSIVE gr(id, i, ns) AS (SELECT id, 1, [{node('0', '-1', '1')}] FROM (SELECT c_custkey AS id FROM customer) UNION ALL SELECT id, i + 1, list_append(list_transform(ns, lambda x: {{'node': x.node, 'parent': x.parent, 'layer': x.layer, 'room': CAST(CASE WHEN x.node = c.node THEN x.room - 1 ELSE x.room END AS INT)}}), {node('i', 'c.node', 'c.layer + 1')})
 FROM (SELECT id, i, ns, free[{_num('parent', 'id', 'i')} % len(free) + 1] AS c FROM (SELECT id, i, ns, list_filter(ns, lambda x: x.room > 0) AS free FROM gr WHERE i < {chain}))),
tr AS (SELECT graph_id, x.node AS node, x.parent AS parent, x.layer AS layer FROM (SELECT id AS graph_id, unnest(ns) AS x FROM gr WHERE i = {chain}))"""


_OPEN = "EXISTS (SELECT 1 FROM tr k WHERE k.graph_id = tr.graph_id AND k.parent = tr.node)"


@query(f"WITH {_grown(5)} SELECT * FROM tr")
def default_tree_generate(spark, sf):
    """Grown node by node under a node that still takes a child."""
    return populate.grown_trees(spark, graph_keys(spark, sf))


@query(f"WITH {_grown(5)} SELECT graph_id, node AS target FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY layer DESC, CAST(node AS VARCHAR) DESC) AS r FROM tr WHERE NOT {_OPEN}) WHERE r = 1")
def default_tree_target(spark, sf):
    return populate.tree_target(populate.grown_trees(spark, graph_keys(spark, sf)))


@query(f"""WITH {_grown(7)}, p AS (SELECT * FROM (SELECT graph_id, node, layer, unnest(range(0, 4)) AS object FROM tr WHERE layer > 1 AND {_OPEN}) WHERE {_unit('oev', 'graph_id', 'node', 'object')} < 0.5)
SELECT graph_id, CAST(object AS INT) AS object, node, layer, CASE WHEN {_unit('osign', 'graph_id', 'node', 'object')} < 0.5 THEN 1 ELSE -1 END AS pol, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY layer, node, {_key('oord', 'graph_id', 'node', 'object')}, object) AS INT) AS serial FROM p""")
def default_object_evidence(spark, sf):
    return populate.object_evidence(populate.grown_trees(spark, graph_keys(spark, sf), chain=7), 4)


def _words(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.explode(text.alphabetic_tokens(F.col("text"))).alias("word"))


def _markov_sql(n: int = 500, longest: int = 10) -> str:
    draw = lambda at: f"CAST(floor({_num(f'mk{at}', 'id')} * total / CAST(268435456.0 AS DOUBLE)) AS BIGINT)"
    parts = [r"""WITH x AS (SELECT '^' || unnest(regexp_extract_all(lower(text), '[a-z]+')) || '$' AS w FROM documents), xw AS (SELECT w, count(*) AS c FROM x GROUP BY w),
m AS (SELECT substr(w, i, 2) AS state, substr(w, i + 2, 1) AS next, CAST(sum(c) AS BIGINT) AS n FROM (SELECT w, c, unnest(range(1, length(w) - 1)) AS i FROM xw) GROUP BY ALL),
st AS (SELECT state, next, CAST(sum(n) OVER (PARTITION BY state ORDER BY next ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hi, n, CAST(sum(n) OVER (PARTITION BY state) AS BIGINT) AS total FROM m),
s0 AS (SELECT state, n, CAST(sum(n) OVER (ORDER BY state ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hi, CAST(sum(n) OVER () AS BIGINT) AS total FROM (SELECT state, CAST(sum(n) AS BIGINT) AS n FROM m WHERE state LIKE '^%' GROUP BY state))""",
             f"w0 AS (SELECT id, state AS w FROM range({n}) q(id) JOIN s0 ON {draw(0)} >= hi - n AND {draw(0)} < hi)"]
    for at in range(1, longest):
        parts.append(f"w{at} AS (SELECT id, w FROM w{at - 1} WHERE w LIKE '%$' UNION ALL SELECT id, w || next FROM w{at - 1} JOIN st ON w NOT LIKE '%$' AND st.state = right(w, 2) AND {draw(at)} >= hi - n AND {draw(at)} < hi)")
    return ", ".join(parts) + f" SELECT id, upper(substr(v, 1, 1)) || substr(v, 2) AS word FROM (SELECT id, replace(replace(w, '^', ''), '$', '') AS v FROM w{longest - 1})"


@query(_markov_sql())
def markov_words(spark, sf):
    """Words drawn from the letters of all documents."""
    return populate.markov_words(text.markov_transitions(_words(spark, sf)), 500)


@query("SELECT conv_id // 5 AS batch, string_agg('BLOCK_' || rn || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY rn) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY conv_id // 5 ORDER BY conv_id) AS rn FROM conversations WHERE turn = 0) GROUP BY 1")
def paraphrase_prompts(spark, sf):
    """First turns in numbered blocks of five conversations."""
    c = table(spark, sf, "conversations").where("turn = 0").groupBy(F.expr("conv_id div 5").alias("batch")).agg(F.sort_array(F.collect_list(F.struct("conv_id", "text"))).alias("t"))
    return c.select("batch", populate.blocks_prompt(F.col("t.text")).alias("prompt"))


@query("""SELECT conv_id, v AS version, CASE v WHEN 1 THEN 'so: ' || text ELSE 'say: ' || text END AS paraphrase FROM (SELECT conv_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations WHERE turn = 0), (VALUES (1), (2)) q(v)""")
def paraphrase_replies(spark, sf):
    """Two versions of each first turn, out of a tagged reply."""
    c = table(spark, sf, "conversations").where("turn = 0").select("conv_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("t"))
    reply = c.select("conv_id", F.concat(F.lit("BLOCK_1_V1:\nso: "), F.col("t"), F.lit("\nBLOCK_1_V2: say: "), "t").alias("r"))
    both = F.array(*[F.struct(F.lit(v).alias("version"), populate.blocks_reply(F.col("r"), F.lit(1), v).alias("paraphrase")) for v in (1, 2)])
    return reply.select("conv_id", F.explode(both).alias("x")).select("conv_id", "x.version", "x.paraphrase")


@query(f"WITH {BUSHY} SELECT graph_id, coalesce(layer, 0) AS layer, string_agg(node, ',' ORDER BY node) AS nodes FROM tn GROUP BY ALL")
def layer_grouping(spark, sf):
    """The nodes of each graph by layer (missing: 0), in order; a list is a layer of one graph."""
    n = generate.tree_nodes(spark, graph_keys(spark, sf), "bushy")
    return n.groupBy("graph_id", F.coalesce("layer", F.lit(0)).alias("layer")).agg(F.array_join(F.sort_array(F.collect_list("node")), ",").alias("nodes"))


@query(R + " SELECT model, CASE model WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' ELSE split_part(model, '-', -1) END AS short_name, CASE WHEN count(*) = 0 THEN '—' ELSE printf('%.1f', round(100 * avg(correct), 1)) END AS pct, CASE model WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 99 END AS rank FROM x GROUP BY model")
def model_table(spark, sf):
    """Short names by a map (else the last part of the name), percentages as text, and a fixed order with unknown ones last."""
    short = F.when(F.col("model") == "1-URGENT", "urgent").when(F.col("model") == "2-HIGH", "high").otherwise(F.element_at(F.split("model", "-"), -1))
    rank = F.when(F.col("model") == "1-URGENT", 1).when(F.col("model") == "2-HIGH", 2).otherwise(99)
    m = results(spark, sf).groupBy("model").agg(F.avg("correct").alias("a"), F.count(F.lit(1)).alias("n"))
    return m.select("model", short.alias("short_name"), F.when(F.col("n") == 0, "—").otherwise(F.format_string("%.1f", F.round(100 * F.col("a"), 1))).alias("pct"), rank.alias("rank"))


@query(f"""SELECT n_regionkey, n_nationkey, CAST(r AS INT) AS r FROM (SELECT n_regionkey, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY {_key("hyp", "n_regionkey", "n_nationkey")}, n_nationkey) AS r, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation) WHERE r <= least(n, greatest(1, 3))""")
def hypothesis_subjects(spark, sf):
    """Three subjects of each region, or all if it has fewer."""
    out = generate.sample_without_replacement(table(spark, sf, "nation").select("n_regionkey", "n_nationkey"), "n_regionkey", "n_nationkey", 3, "hyp")
    return out.select("n_regionkey", "n_nationkey", "r")


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)\\b(is a|is an|kind of|type of)\\b') THEN 'subclass' ELSE 'property' END AS kind FROM conversations")
def statement_kinds(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", populate.classified(F.col("text")).alias("kind"))


@query("SELECT event_id, unnest(regexp_extract_all(lower(props), '[a-z]+')) AS token FROM events")
def json_tokens(spark, sf):
    """Alphabetic tokens anywhere in a JSON text."""
    return table(spark, sf, "events").select("event_id", F.explode(text.alphabetic_tokens(F.col("props"))).alias("token"))


@query(f"WITH {T}, k AS (SELECT dst AS node, min(src) AS a, max(src) AS b, count(*) AS n FROM t GROUP BY dst) SELECT node, n, a AS first_child, b AS last_child, (SELECT count(*) FROM t) AS n_edges FROM k")
def object_graph_children(spark, sf):
    k = taxonomy_edges(spark, sf).groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("first_child"), F.max("src").alias("last_child"))
    return k.join(F.broadcast(k.agg(F.sum("n").alias("n_edges"))))  # one row


def _links(spark, sf) -> DataFrame:
    """Urgent orders as relations between customers: the buyer is the parent of the customer that the order's hash names."""
    n = table(spark, sf, "customer").agg(F.count(F.lit(1)).alias("n"))
    o = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").join(F.broadcast(n))  # one row
    return o.select(F.col("o_custkey").alias("parent"), (1 + number("link", "o_orderkey") % F.col("n")).alias("child"))


_LINKS = f"""lk AS (SELECT o_custkey AS parent, 1 + {_num('link', 'o_orderkey')} % (SELECT count(*) FROM customer) AS child FROM orders WHERE o_orderpriority = '1-URGENT')"""


@query(f"""WITH RECURSIVE {_LINKS}, w(root, node, depth) AS (SELECT r, r, 0 FROM (SELECT min(c_custkey) AS r FROM customer GROUP BY c_nationkey) UNION SELECT root, child, depth + 1 FROM w JOIN lk ON lk.parent = w.node WHERE depth < 80)
SELECT root, node, CAST(min(depth) AS INT) AS depth FROM w GROUP BY ALL""")
def walk_to_the_end(spark, sf):
    """What is reached from the first customer of each nation, however far; the relations have cycles. (The SQL bounds its steps,
    which would not end on a cycle; the walk does not.)"""
    roots = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("root"))
    return walks.reached_all(_links(spark, sf), roots)


@query(f"""WITH RECURSIVE {_LINKS}, e AS (SELECT DISTINCT least(parent, child) AS parent, greatest(parent, child) AS child FROM lk WHERE parent <> child), w(node, depth) AS (SELECT c_custkey, 0 FROM customer UNION SELECT child, depth + 1 FROM w JOIN e ON e.parent = w.node),
k AS (SELECT parent AS node, count(*) AS n FROM e GROUP BY 1) SELECT node, CAST(max(depth) AS INT) AS depth, CAST(coalesce(max(n), 0) AS BIGINT) AS n_children FROM w LEFT JOIN k USING (node) GROUP BY node""")
def longest_ways(spark, sf):
    """The depth of each customer by its longest way, and its children, with the lower key of a relation as the parent."""
    e = _links(spark, sf).where("parent <> child").select(F.least("parent", "child").alias("parent"), F.greatest("parent", "child").alias("child"))
    return walks.longest_depths(e, table(spark, sf, "customer").select(F.col("c_custkey").alias("node")))


@query("""WITH m AS (SELECT n_name AS task, unnest([1, 2]) AS run FROM nation), s AS (SELECT n_name AS task, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT m.task, run, count(s_name) AS n, coalesce(string_agg(s_name, '|' ORDER BY s_name), '') AS entities FROM m LEFT JOIN s USING (task) GROUP BY ALL""")
def appended_runs(spark, sf):
    """Two runs of a task in one file, the second one appended right behind the first, read back document by document."""
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list("s_name")).alias("e"))  # names of one nation
    t = table(spark, sf, "nation").join(s, "n_nationkey", "left").select(F.col("n_name").alias("task"), F.coalesce("e", F.array().cast("array<string>")).alias("entities"))
    run = lambda i: F.to_json(F.struct("task", F.lit(i).alias("run"), "entities", F.lit('}{ "\\').alias("note")), {"pretty": "true"})
    path = fresh_path(spark, "runs")
    t.select(F.concat(run(1), run(2))).write.text(path)
    d = read_documents(spark, path).select(F.from_json("text", "task string, run int, entities array<string>").alias("d")).select("d.*")
    return d.select("task", "run", F.size("entities").cast("bigint").alias("n"), F.array_join("entities", "|").alias("entities"))
