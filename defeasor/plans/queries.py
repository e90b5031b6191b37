"""Queries over the shared tables, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import hashing, phrases, stored
from ..functions.unions import union_of
from ..operators import analytics, chain, converse, distinct, generate, inheritance, knowledge, ranking, resolving, text
from ..sources.views import evidence, graph_keys, last_edges, results, signed_events, table, taxonomy_edges, taxonomy_evidence
from . import datasets, dialogue, graphs, pools, population  # noqa: F401 (these add their queries to those of population)


QUERIES = dict(population.QUERIES)


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def scan_filter_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return signed_events(spark, sf).select("event_id", "subject", "pol", "idx")


@query
def digraph_last_write_wins(spark, sf):
    return last_edges(signed_events(spark, sf)).select("subject", "idx", "event_id", "pol")


@query
def serial_assignment(spark, sf):
    return evidence(spark, sf)


@query
def signed_projection_cutoff(spark, sf):
    return evidence(spark, sf).where("serial <= 3").select("subject", F.concat(F.lit("P"), F.col("idx").cast("string")).alias("dst"), F.when(F.col("pol") == 1, "+").otherwise("-").alias("sign"))


@query
def chain_state_by_reveal(spark, sf):
    return chain.replay(evidence(spark, sf)).select("subject", "serial", "p", "q", "state", F.col("state_before").alias("before"))


@query
def chain_state_before_after_label(spark, sf):
    r = chain.replay(evidence(spark, sf))
    kind = F.when(F.col("pol") == 1, "pos").otherwise("neg")
    return r.select("subject", "serial", chain.mode_a_label(kind, F.col("state_before"), F.col("state")).alias("mode_a"), chain.delta_label(F.col("state_before"), F.col("state")).alias("delta"))


@query
def chain_positive_path_shortening(spark, sf):
    r = chain.replay(evidence(spark, sf))
    return r.where("pol = 1").select("subject", "serial", "idx", chain.shortening_label(r).alias("label"))


@query
def chain_random_order_replay(spark, sf):
    r = chain.random_order(evidence(spark, sf))
    return r.select("subject", "reveal", "idx", "state", chain.shortening_label(r).alias("label"))


@query
def chain_hypothesis_distance(spark, sf):
    return evidence(spark, sf).select("subject", "serial", (9 - F.col("idx")).alias("hyp_node_distance"))


def _final_sets(spark, sf) -> DataFrame:
    sets = lambda p: F.array_sort(F.collect_set(F.when(F.col("pol") == p, F.col("idx"))))
    return evidence(spark, sf).groupBy("subject").agg(sets(1).alias("positives"), sets(-1).alias("negatives"))


@query
def chain_bypass_fold(spark, sf):
    return chain.bypass_fold(_final_sets(spark, sf), [(2, 5)]).select("subject", "state", F.array_contains("entries", 5).alias("enters_5"))


@query
def chain_bypass_fold_many(spark, sf):
    return chain.bypass_fold(_final_sets(spark, sf), [(0, 3), (3, 6), (1, 4), (6, 9)]).select("subject", F.array_join("entries", ",").alias("entries"), "state")


@query
def bypass_option_pairs(spark, sf):
    """Bypasses of each supplier's chain, whose length is drawn by hash, with the claims that lie strictly inside."""
    chains = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("subject"), (5 + hashing.number("chain", "s_suppkey") % 4).cast("int").alias("length"))
    return chain.bypass_options(chains)


@query
def irrelevant_turns_interleaved(spark, sf):
    extra = table(spark, sf, "events").where("event_type = 'view'").groupBy(F.col("user_id").alias("subject")).agg(F.least(F.count(F.lit(1)), F.lit(3)).alias("n"))
    extra = extra.select("subject", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("ord"))
    return chain.interleaved(evidence(spark, sf), extra).select("subject", "pos", "kind", F.col("n").cast("bigint").alias("n"))


@query
def irrelevant_records(spark, sf):
    """Serials 0.0, 0.1, ... of irrelevant updates; every second one is a trap."""
    v = table(spark, sf, "events").where("event_type = 'view'").select(F.col("user_id").alias("subject"), "event_id")
    v = v.withColumn("r", F.row_number().over(Window.partitionBy("subject").orderBy("event_id")))
    trap = F.col("event_id") % 2 == 1
    return v.select("subject", "event_id", F.round((F.col("r") - 1) * 0.1, 1).alias("serial"), F.when(trap, "trap_irr").otherwise("safe_irr").alias("update_type"), F.when(trap, "DEFEATED").otherwise("ENTAILED").alias("post_state"))


@query
def quantified_groups(spark, sf):
    g = chain.exception_groups(evidence(spark, sf))
    return g.select("idx", "n_members", "n_pos", "n_neg", (F.col("first_serial") - 0.5).cast("double").alias("group_serial"))


@query
def generic_scope(spark, sf):
    e = evidence(spark, sf)
    g = e.where("pol = -1").groupBy("idx").agg(F.count(F.lit(1)).alias("n_neg"))
    top = e.agg(F.max("serial").alias("m"))
    return g.join(F.broadcast(top)).withColumn("serial", F.col("m") + F.row_number().over(Window.orderBy("idx"))).select("idx", "n_neg", F.col("serial").cast("bigint").alias("serial"))


@query
def group_reveal_schedule(spark, sf):
    """For each node with both signs a group event right before the first member."""
    e = evidence(spark, sf)
    members = e.select("idx", F.lit("edge").alias("kind"), "subject", F.col("serial").cast("double").alias("at"))
    groups = chain.exception_groups(e).select("idx", F.lit("group").alias("kind"), F.lit(None).cast("bigint").alias("subject"), (F.col("first_serial") - 0.5).cast("double").alias("at"))
    return members.unionByName(groups)


@query
def section_partition_caps(spark, sf):
    return chain.partition_subjects(evidence(spark, sf).select("subject").distinct(), 0.4, 40)


@query
def record_cap(spark, sf):
    w = Window.partitionBy("subject").orderBy("serial")
    return evidence(spark, sf).withColumn("r", F.row_number().over(w)).where("r <= 2").select("subject", "serial", "idx", phrases.record_id(F.concat(F.lit("Object_"), F.col("subject").cast("string")), F.when(F.col("pol") == 1, "pos").otherwise("neg"), F.concat(F.lit("P"), F.col("idx").cast("string")), F.col("serial")).alias("record_id"))


@query
def contradiction_plan(spark, sf):
    """Anchors: positives in the later half of a subject's reveals; claims of the node by others in between."""
    e = evidence(spark, sf)
    n = F.count(F.lit(1)).over(Window.partitionBy("subject"))
    anchors = e.withColumn("n", n).where((F.col("serial") > F.floor(F.col("n") / 2)) & (F.col("pol") == 1))
    return anchors.withColumn("between", hashing.bernoulli(0.6, "between", "subject", "idx")).select("subject", "idx", "serial", "between")


@query
def redundant_claims(spark, sf):
    """A claim (subject, idx) is redundant if an earlier one of a higher-priority source (lower number) made it."""
    s = signed_events(spark, sf).withColumn("source", (F.col("event_id") % 3).cast("int"))
    w = Window.partitionBy("subject", "idx", "pol").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return s.select("event_id", "source", F.coalesce(F.min("source").over(w) < F.col("source"), F.lit(False)).alias("redundant"))


@query
def taxonomy_ancestors(spark, sf):
    e = taxonomy_edges(spark, sf)
    return inheritance.ancestors(e, e.where("src like 'c%'").select(F.col("src").alias("subject")), 3)


@query
def taxonomy_depth_childcount(spark, sf):
    e = taxonomy_edges(spark, sf)
    kids = inheritance.children_counts(e)
    return e.select(F.col("src").alias("node"), "layer").union(spark.sql("select 'root', 0")).join(kids, "node", "left").select("node", "layer", F.coalesce("n_children", F.lit(0).cast("bigint")).alias("n_children"))


@query
def taxonomy_layers(spark, sf):
    return taxonomy_edges(spark, sf).groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("first_node"))


@query
def inheritance_answer_by_reveal(spark, sf):
    e = taxonomy_edges(spark, sf)
    anc = inheritance.ancestors(e, e.where("src like 'c%'").select(F.col("src").alias("subject")), 3)
    return inheritance.answer_counts(anc, taxonomy_evidence(spark, sf))


@query
def inheritance_final_answer(spark, sf):
    e = taxonomy_edges(spark, sf)
    anc = inheritance.ancestors(e, e.where("src like 'c%'").select(F.col("src").alias("subject")), 3)
    best = anc.join(taxonomy_evidence(spark, sf), "node").groupBy("subject").agg(F.max(F.col("layer") * 10 + F.col("pol")).alias("best"))
    return anc.where("dist = 0").select("subject").join(best, "subject", "left").select("subject", F.when(F.col("best").isNull() | (F.col("best") % 10 == 1), "yes").otherwise("no").alias("answer"))


@query
def tree_distance_to_subject(spark, sf):
    e = taxonomy_edges(spark, sf)
    anc = inheritance.ancestors(e, e.select(F.col("src").alias("subject")), 3)
    c = e.where("src like 'c%'").select(F.col("src").alias("a"))
    return inheritance.tree_distance(anc, c.withColumn("b", F.concat(F.lit("n"), (hashing.number("far", "a") % 25).cast("string"))))


@query
def linear_distance(spark, sf):
    g = generate.linear_graphs(spark, graph_keys(spark, sf))
    subject = g.where("type = 'hypothesis_edge'").select("graph_id", F.col("layer").alias("depth"))
    return g.where("type like 'defeasible%'").join(subject, "graph_id").select("graph_id", "serial", F.least(F.col("depth") - F.col("layer"), F.lit(2)).alias("distance"))


@query
def skeptical_resolution(spark, sf):
    """The general resolver on generated class chains, one answer for each cutoff."""
    g = generate.linear_graphs(spark, graph_keys(spark, sf))
    edges = g.where("type <> 'hypothesis_edge'").select("graph_id", F.col("layer").alias("edge_ord"), "src", "dst", "type", "serial")
    hyp = g.where("type = 'hypothesis_edge'").select("graph_id", F.col("src").alias("subject"), F.col("dst").alias("target"), F.explode(F.array(*map(F.lit, range(5)))).alias("cutoff"))
    return resolving.resolve_all(resolving.signed_edges(edges), hyp)


@query
def skeptical_taxonomy(spark, sf):
    """The general resolver on one graph of all customers, suppliers, nations and regions: does evidence give a leaf the property?"""
    tree = taxonomy_edges(spark, sf)
    spine = tree.select("src", "dst", F.lit("+").alias("sign"))
    signs = taxonomy_evidence(spark, sf).select(F.col("node").alias("src"), F.lit("Property").alias("dst"), F.when(F.col("pol") == 1, "+").otherwise("-").alias("sign"))
    asked = tree.where("layer = 3").select(F.lit(0).alias("graph_id"), F.col("src").alias("subject"), F.lit("Property").alias("target"))
    return resolving.resolve_all(union_of(spine, signs).withColumn("graph_id", F.lit(0)), asked).select("subject", "answer")


@query
def subclass_superclass_lookup(spark, sf):
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.col("n_name").alias("label"))
    r = table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.col("r_name").alias("label"))
    e = table(spark, sf, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("child"))
    nodes = n.union(r)
    return knowledge.related(nodes, e, up=False).withColumn("direction", F.lit("sub")).union(knowledge.related(nodes, e, up=True).withColumn("direction", F.lit("super")))


@query
def disjunctive_property_match(spark, sf):
    """Kinds of parts (type and brand) against each other: as many as the two vocabularies have, whatever the table."""
    kinds = table(spark, sf, "part").select("p_type", "p_brand", F.concat_ws("|", "p_type", "p_brand").alias("kind")).distinct()
    p = kinds.select(F.col("kind").alias("property"), F.col("p_type").alias("domain"), F.array("p_brand").alias("allowed"))
    s = kinds.select(F.col("kind").alias("subject"), F.col("p_type").alias("subject_domain"), F.col("p_brand").alias("subject_type"))
    return knowledge.matching_properties(p, s)


@query
def relation_join_weight_ordered(spark, sf):
    """Edges with both labels and a weight: parts of suppliers by quantity."""
    li = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("weight"))
    w = Window.partitionBy("l_suppkey").orderBy(F.col("weight").desc(), "l_partkey")
    top = li.withColumn("r", F.row_number().over(w)).where("r <= 3")
    return top.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("s_name").alias("start_label"), F.col("p_name").alias("end_label"), F.round("weight", 6).alias("weight"), F.col("r").cast("bigint").alias("r"))


@query
def node_upsert_first_wins(spark, sf):
    n = table(spark, sf, "part").select(F.col("p_name").alias("id"), F.col("p_brand").alias("label"), F.col("p_partkey").alias("ord"))
    return knowledge.upsert_nodes(n)


@query
def alias_group_concat(spark, sf):
    """The brands of each name: a list has as many entries as there are brands."""
    return table(spark, sf, "part").groupBy("p_name").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), "|").alias("aliases"))


@query
def property_dedup(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_name").alias("lemma"), F.col("p_type").alias("frame"), F.col("p_partkey").alias("ord"))
    return knowledge.dedup_properties(p)


@query
def conversation_turn_explode(spark, sf):
    return converse.turns(chain.replay(evidence(spark, sf)))


@query
def conversation_nested_json(spark, sf):
    return converse.nested(converse.turns(chain.replay(evidence(spark, sf)))).select("subject", "n_turns", F.col("turns").alias("json"))


@query
def turn_budget(spark, sf):
    return converse.within_budget(evidence(spark, sf), 20).select("subject", "serial")


@query
def conversation_roles(spark, sf):
    return converse.role_stats(table(spark, sf, "conversations"))


@query
def first_turn_split(spark, sf):
    c = table(spark, sf, "conversations").where("turn = 0").withColumn("content", F.concat("text", F.when(F.col("conv_id") % 3 == 0, "").otherwise("  Question: is it so?")))
    a, b = text.split_first_turn(F.col("content"))
    return c.select("conv_id", a.alias("prefix"), b.alias("suffix"))


def _predicates(spark, sf) -> DataFrame:
    starts = ["is", "has", "can", "serves as", "appears", "produces", "tastes or smells", "displays", "thrives", "are", "have", "utilizes"]
    verb = F.element_at(F.array(*map(F.lit, starts)), (F.col("p_partkey") % len(starts) + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("subject"), F.concat(verb, F.lit(" "), "p_name").alias("predicate"))


@query
def negate_predicates(spark, sf):
    p = _predicates(spark, sf)
    return p.select("p_partkey", phrases.negative_sentence(F.col("subject"), F.col("predicate")).alias("negative"), phrases.negated_rule(F.col("predicate")).alias("rule"), phrases.at_least_one_object(F.col("subject"), F.col("predicate")).alias("generic"))


@query
def question_forms(spark, sf):
    return _predicates(spark, sf).select("p_partkey", phrases.question(F.col("subject"), F.col("predicate")).alias("question"), phrases.capitalized(F.col("predicate")).alias("cap_all"), phrases.first_upper(F.col("predicate")).alias("cap_first"))


@query
def edge_sentences(spark, sf):
    e = evidence(spark, sf)
    kind = F.when(F.col("pol") == 1, "defeasible_has_property").otherwise("defeasible_lacks_property")
    return e.select("subject", "serial", phrases.first_upper(phrases.template_sentence(kind, subject=F.concat(F.lit("object "), F.col("subject").cast("string")), object_predicate=F.concat(F.lit("show P"), F.col("idx").cast("string")))).alias("sentence"))


@query
def pretext_listagg(spark, sf):
    n = table(spark, sf, "nation").select("n_regionkey", "n_nationkey", F.concat("n_name", F.lit(" is a kind of region "), F.col("n_regionkey").cast("string"), F.lit(".")).alias("s"))
    return converse.pretext(n, "n_regionkey", "n_nationkey", "s")


@query
def plural_article(spark, sf):
    w = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return w.select("word", phrases.plural(F.col("word")).alias("plural"), phrases.naive_plural(F.col("word")).alias("naive"), phrases.article(F.col("word")).alias("article"))


@query
def disjunction_lists(spark, sf):
    g = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    return g.select("n_regionkey", phrases.at_least_one_of(phrases.listed(F.col("names")), F.lit("is cold")).alias("sentence"))


@query
def reliability_pairs(spark, sf):
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    return table(spark, sf, "supplier").withColumn("less", F.lead("s_name").over(w)).where("less is not null").select("s_nationkey", F.concat("s_name", F.lit(" is more reliable than "), "less", F.lit(".")).alias("statement"))


@query
def template_fill(spark, sf):
    return table(spark, sf, "part").select("p_partkey", phrases.filled(F.lit("is made of [value]"), F.col("p_name")).alias("sentence"))


@query
def url_concepts(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.url_concept(F.col("url")).alias("concept"))


@query
def fingerprint_linear(spark, sf):
    return generate.linear_fingerprints(generate.linear_graphs(spark, graph_keys(spark, sf)))


def _with_concept(ids: DataFrame) -> DataFrame:
    """Fingerprints of class chains under a concept drawn for each."""
    prints = generate.linear_fingerprints(generate.linear_graphs(ids.sparkSession, ids))
    drawn = generate.weighted_choice(prints, "graph_id", generate.CONCEPTS)
    return drawn.select("graph_id", F.md5(F.concat_ws("|", "choice", "fingerprint").cast("binary")).alias("fingerprint"))


@query
def distinct_generation(spark, sf):
    """The first 500 distinct class chains of the customers' graphs, or those before 15 duplicates in a row."""
    store = stored.fresh_path(spark, "accepted")
    return distinct.search(graph_keys(spark, sf), _with_concept, store, wanted=500, stop=15)[0]


@query
def fingerprint_tree_canonical(spark, sf):
    return generate.canonical_trees(generate.tree_nodes(spark, graph_keys(spark, sf), "bushy"), 2)


@query
def fingerprint_subjects(spark, sf):
    """Subjects with the same ordered (idx, sign) evidence share a fingerprint."""
    parts = F.concat(F.lpad(F.col("idx").cast("string"), 2, "0"), F.when(F.col("pol") == 1, "+").otherwise("-"))
    return evidence(spark, sf).groupBy("subject").agg(F.md5(F.array_join(F.sort_array(F.collect_list(parts)), ",").cast("binary")).alias("fingerprint"))


@query
def dedup_saturation(spark, sf):
    f = generate.linear_fingerprints(generate.linear_graphs(spark, graph_keys(spark, sf)))
    return generate.saturation(f, 10)


@query
def weighted_choice(spark, sf):
    return generate.weighted_choice(table(spark, sf, "customer").select("c_custkey"), "c_custkey", generate.CONCEPTS)


@query
def sample_without_replacement(spark, sf):
    return generate.sample_without_replacement(table(spark, sf, "customer").select("c_nationkey", "c_custkey"), "c_nationkey", "c_custkey", 3).select("c_nationkey", "c_custkey", F.col("r").cast("bigint").alias("r"))


@query
def attribute_sampling(spark, sf):
    pool = table(spark, sf, "part").groupBy(F.col("p_name").alias("attribute")).agg(F.min("p_type").alias("domain"))
    wanted = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_type").alias("domain"))
    return knowledge.sample_attributes(pool, wanted, 3).select("key", "attribute", F.col("rank").cast("bigint").alias("rank"))


@query
def linear_graph_generate(spark, sf):
    return generate.linear_graphs(spark, graph_keys(spark, sf)).select("graph_id", "src", "dst", "type", "layer", F.col("serial").cast("int").alias("serial"))


@query
def tree_generate(spark, sf):
    return generate.tree_nodes(spark, graph_keys(spark, sf), "jellyfish")


@query
def tree_evidence(spark, sf):
    return generate.tree_evidence(generate.tree_nodes(spark, graph_keys(spark, sf), "bushy"))


@query
def tree_hypothesis_leaf(spark, sf):
    return generate.hypothesis_leaf(generate.tree_nodes(spark, graph_keys(spark, sf), "bushy"))


@query
def phonotactic_corpus(spark, sf):
    return text.phonotactic_words(spark, graph_keys(spark, sf))


def _words(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.explode(text.alphabetic_tokens(F.col("text"))).alias("word"))


@query
def markov_transitions(spark, sf):
    return text.markov_transitions(_words(spark, sf))


@query
def nonce_filter(spark, sf):
    return _words(spark, sf).distinct().where(text.valid_nonce(F.col("word")))


@query
def isa_extraction(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("pos", "s"))
    return s.select("doc_id", "pos", text.extract(F.col("s")).alias("e")).where("e.kind = 'isa'").select("doc_id", F.col("pos").cast("bigint").alias("pos"), "e.subject", "e.value")


@query
def batches(spark, sf):
    c = table(spark, sf, "conversations").where("turn = 0").select("conv_id")
    at = ranking.numbered(c, ranking.number_bucket(c, "conv_id"), ["conv_id"], "at")
    return at.select("conv_id", F.floor((F.col("at") - 1) / 5).cast("bigint").alias("batch"))


@query
def accuracy_heatmap_pivot(spark, sf):
    return analytics.accuracy_pivot(results(spark, sf), ["F", "O", "P"])


@query
def depth_curve_sem(spark, sf):
    return analytics.depth_curve(results(spark, sf))


@query
def depth_bins_fixed(spark, sf):
    return analytics.fixed_bins(results(spark, sf), "depth", 2)


@query
def depth_bins_quantile(spark, sf):
    return analytics.quantile_bins(results(spark, sf), "confidence", 6)


@query
def seed_stability_mean_sd_cv(spark, sf):
    return analytics.seed_stability(results(spark, sf))


@query
def seed_quartiles(spark, sf):
    return analytics.seed_quartiles(results(spark, sf))


@query
def model_sd_per_seed(spark, sf):
    return analytics.model_spread(results(spark, sf))


@query
def trend_line(spark, sf):
    return analytics.trend(results(spark, sf))


@query
def kruskal_wallis(spark, sf):
    return analytics.kruskal_wallis(results(spark, sf))


@query
def icc_2_1(spark, sf):
    return analytics.icc_2_1(results(spark, sf))


@query
def bias_gap(spark, sf):
    return analytics.bias_gap(results(spark, sf))


@query
def mcnemar(spark, sf):
    return analytics.mcnemar(results(spark, sf))


@query
def spearman_depth(spark, sf):
    return analytics.spearman(results(spark, sf), "depth", "confidence")


@query
def dataset_stats_grouping_sets(spark, sf):
    return analytics.dataset_statistics(results(spark, sf))


@query
def complete_models(spark, sf):
    """Models with every pair of topology and difficulty that there is."""
    r = results(spark, sf).select("model", "topology", "difficulty").distinct()
    every = r.agg(F.count_distinct("topology", "difficulty").alias("cells"))
    return r.groupBy("model").agg(F.count(F.lit(1)).alias("n_cells")).join(F.broadcast(every), F.col("n_cells") == F.col("cells")).select("model", "n_cells")


@query
def latex_rows(spark, sf):
    return analytics.latex_rows(results(spark, sf))
