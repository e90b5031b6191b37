"""Pools of names, words and attributes, difficulty presets, and walks over relation tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import bernoulli, number, order_key, pick, unit
from ..functions.unions import union_of


def resolved_domains(wanted: DataFrame, pool: DataFrame) -> DataFrame:
    """wanted (key, domain, ...) with own: the pool's domain of the same name whatever its case, null if there is none."""
    names = pool.groupBy(F.lower("domain").alias("low")).agg(F.min_by("domain", "domain_ord").alias("own"))
    return wanted.withColumn("low", F.lower("domain")).join(names, "low", "left").drop("low")


def _flat(pool: DataFrame) -> DataFrame:
    """Each attribute once: the definition of its first domain."""
    return pool.groupBy("attribute").agg(F.min_by(F.struct("domain", "template"), "domain_ord").alias("d")).select("attribute", "d.domain", "d.template")


def domain_attributes(pool: DataFrame, wanted: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(key, attribute, from_domain, rank): k attributes of the key's domain in hash order, the rest from the other domains,
    each attribute once (the first other domain that has it); of all domains if the domain is unknown.

    pool: domain, domain_ord, attribute, template; wanted: key, domain. Attributes are ranked once for each domain and once
    over all, so a key meets at most 2 k of them plus those of its own domain.
    """
    asked = resolved_domains(wanted, pool)
    own = pool.select(F.col("domain").alias("own"), "attribute")
    mine = own.withColumn("rank", F.row_number().over(Window.partitionBy("own").orderBy(order_key("dom", "own", "attribute", seed=seed), "attribute")))
    size = own.groupBy("own").agg(F.count(F.lit(1)).alias("size"))
    from_own = asked.where("own is not null").join(mine.where(F.col("rank") <= k), "own").select("key", "attribute", F.col("own").alias("from_domain"), "rank")
    flat = _flat(pool)
    order = F.row_number().over(Window.orderBy("key_", "attribute"))
    top = flat.withColumn("key_", order_key("cross", "attribute", seed=seed)).orderBy("key_", "attribute").limit(_most(pool) + k)  # a domain's attributes and k more suffice
    top = top.withColumn("at", order).select("attribute", F.col("domain").alias("from_domain"), "at")
    short = asked.join(size, "own", "left").withColumn("size", F.coalesce("size", F.lit(0))).where(F.col("size") < k)
    other = short.join(F.broadcast(top)).join(own, ["own", "attribute"], "left_anti")  # top is bounded by one domain's size
    fill = other.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("at"))).where(F.col("n") <= k - F.col("size"))
    return union_of(from_own, fill.select("key", "attribute", "from_domain", (F.col("size") + F.col("n")).cast("int")))


def _most(pool: DataFrame) -> int:
    """The size of the largest domain."""
    return pool.groupBy("domain").count().agg(F.max("count")).first()[0] or 0


def domain_irrelevant(pool: DataFrame, wanted: DataFrame, excluded: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(key, attribute, template, rank): k attributes that are not excluded (key, attribute), drawn evenly over all domains;
    where a domain of the key defines one too, its definition is taken."""
    asked = resolved_domains(wanted, pool)
    most = excluded.groupBy("key").count().agg(F.max("count")).first()[0] or 0
    flat = _flat(pool).withColumn("o", order_key("dirr", "attribute", seed=seed)).orderBy("o", "attribute").limit(most + k)  # what the most exclusive key needs
    met = asked.join(F.broadcast(flat.select("attribute", F.col("template").alias("any"), "o"))).join(excluded, ["key", "attribute"], "left_anti")
    own = pool.select(F.col("domain").alias("own"), "attribute", "template")
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("o", "attribute"))).where(F.col("rank") <= k)
    return ranked.join(own, ["own", "attribute"], "left").select("key", "attribute", F.coalesce("template", "any").alias("template"), "rank")


def nonce_sample(banks: DataFrame, wanted: DataFrame, limit: int = 10, seed: int = 42) -> DataFrame:
    """(key, word, rank): at most `limit` words of the bank named like the key's concept (whatever the case), else of a bank
    drawn by hash. banks: domain, word."""
    names = banks.select("domain").distinct().agg(F.array_sort(F.collect_set("domain")).alias("names"))  # the few banks
    asked = wanted.join(F.broadcast(names))
    same = F.filter("names", lambda x: F.lower(x) == F.lower(F.col("concept")))
    drawn = F.get("names", (number("bank", "key", seed=seed) % F.greatest(F.size("names"), F.lit(1))).cast("int"))
    asked = asked.select("key", F.coalesce(F.get(same, F.lit(0)), drawn).alias("domain"))
    ranked = banks.withColumn("rank", F.row_number().over(Window.partitionBy("domain").orderBy(order_key("nonce", "domain", "word", seed=seed), "word"))).where(F.col("rank") <= limit)
    return asked.join(ranked, "domain").select("key", "word", "rank")


def source_names(pool: list[str], key: Column, n: int, seed: int = 42) -> Column:
    """n distinct names in hash order; all names and then "Source i" if there are fewer."""
    names = F.array(*map(F.lit, sorted(set(pool)))) if pool else F.array().cast("array<string>")
    mark = lambda x: F.md5(F.concat(F.lit(f"{seed}|source|"), key.cast("string"), F.lit("|"), x).cast("binary"))
    drawn = F.slice(F.array_sort(F.transform(names, lambda x: F.struct(mark(x).alias("k"), x.alias("x"))))["x"], 1, n)
    return F.concat(drawn, F.array(*[F.lit(f"Source {i}") for i in range(len(set(pool)) + 1, n + 1)]).cast("array<string>"))


def pseudoword(seed_word: Column, key: Column, seed: int = 42) -> Column:
    """A word of the same pattern: each vowel another or the same vowel by hash, each other letter a consonant; capitalised."""
    vowels, consonants = "aeiou", "bcdfghjklmnpqrstvwxyz"
    letters = F.split(seed_word, "")
    drawn = lambda i: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|letter|"), key.cast("string"), F.lit("|"), i.cast("string")).cast("binary")), 1, 7), 16, 10).cast("bigint")
    of = lambda s, i: F.substring(F.lit(s), (drawn(i) % len(s) + 1).cast("int"), F.lit(1))
    word = F.array_join(F.transform(letters, lambda c, i: F.when(c.isin(*vowels), of(vowels, i)).otherwise(of(consonants, i))), "")
    return F.when(seed_word == "", "").otherwise(F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1 << 30)))


def valid_pseudoword(word: Column, least: int = 4, most: int = 10) -> Column:
    return F.length(word).between(least, most) & word.rlike(r"^\p{L}+$") & ~word.rlike(r"(.)\1{2,}")


def first_valid(attempts: DataFrame, valid: Column, tries: int = 100, fallback: str = "Fallback") -> DataFrame:
    """(key, word): of a key's attempts (key, attempt, word) the first valid one, or the fallback."""
    good = F.min(F.when(valid & (F.col("attempt") <= tries), F.struct("attempt", "word")))
    return attempts.groupBy("key").agg(good.alias("g")).select("key", F.coalesce("g.word", F.lit(fallback)).alias("word"))


def outside_lexicon(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Words that are in no lexicon (word), whatever the case."""
    return words.join(lexicon.select(F.lower("word").alias("__low")).distinct(), F.lower("word") == F.col("__low"), "left_anti")


@dataclass(frozen=True)
class Task:
    """One kind of invented names."""

    corpus: str
    least: int
    most: int
    consonants: int = 3
    order: int = 2
    seeded: bool = False
    words: tuple[str, ...] = ()
    size: int = 3000


# Tasks that invent names.
TASKS: dict[str, tuple[Task, ...]] = {
    "zero_bias": (Task("phonotactic", 5, 8, 2),),
    "compound": (Task("reference", 4, 6, seeded=True, words=("silent", "tragic", "florid", "mystic", "crimson")), Task("reference", 4, 7, words=("dragon", "tiger", "eagle", "spider", "raven"))),
    "domain": (Task("rootword", 5, 7, 2, seeded=True, words=("food", "cuisine", "dish", "meal", "snack")),),
}


@dataclass(frozen=True)
class Variant:
    name: str
    values: dict[str, float] = field(default_factory=dict)
    weight: float = 1.0


# Variants of class chains (length, least and most share with evidence) and of class trees (depth, breadth,
# least and most children, survival, decay) by difficulty.
LINEAR_VARIANTS = {"easy": [(4, 0.80, 1.0), (5, 0.60, 0.80), (6, 0.50, 0.75)], "hard": [(20, 0.50, 0.85), (22, 0.50, 0.80), (26, 0.50, 0.75), (30, 0.50, 0.70)]}
TREE_VARIANTS = {
    "easy": {"jellyfish": (4, 5, 1, 1, 0.40, 1.0), "balanced": (3, 2, 2, 2, 1.0, 1.0), "bushy": (2, 3, 1, 2, 0.70, 1.0)},
    "hard": {"jellyfish": (8, 13, 1, 1, 0.60, 1.0), "balanced": (4, 3, 2, 2, 1.0, 1.0), "bushy": (4, 4, 1, 4, 0.80, 0.75)},
}


def chosen(options: list[str], key: Column | str, weights: dict[str, float] | None = None, purpose: str = "variant", seed: int = 42) -> Column:
    """One of the options by hash; weighted if weights are given (missing: 1)."""
    if not weights:
        return pick(options, purpose, key, seed=seed)
    w = [weights.get(o, 1.0) for o in options]
    out, upto, u = None, 0.0, unit(purpose, key, seed=seed)
    for o, x in zip(options[:-1], w):
        upto += x / sum(w)
        out = F.when(u < F.lit(upto), o) if out is None else out.when(u < F.lit(upto), o)
    return F.lit(options[-1]) if out is None else out.otherwise(options[-1])


def evidence_by_share(chains: DataFrame, *, shuffled: bool = True, seed: int = 42) -> DataFrame:
    """(graph_id, depth, type, serial): evidence on inner classes of chains (graph_id, length, lo, hi), between lo and hi of
    the length, at least one and at most all of them; revealed in hash order or from the top down."""
    inner = F.col("length") - 1
    most = F.least(F.greatest(F.greatest(F.lit(1), F.floor(F.col("lo") * F.col("length"))), F.floor(F.col("hi") * F.col("length"))), inner)
    least = F.least(F.greatest(F.lit(1), F.floor(F.col("lo") * F.col("length"))), most)
    c = chains.where(inner >= 1).withColumn("n", least + number("share", "graph_id", seed=seed) % (most - least + 1))
    d = c.withColumn("depth", F.explode(F.sequence(F.lit(1), inner.cast("int"))))
    of = Window.partitionBy("graph_id")
    d = d.withColumn("r", F.row_number().over(of.orderBy(order_key("depth", "graph_id", "depth", seed=seed)))).where(F.col("r") <= F.col("n"))
    serial = F.row_number().over(of.orderBy("r" if shuffled else "depth"))
    sign = F.when(bernoulli(0.5, "lsign", "graph_id", "depth", seed=seed), "defeasible_has_property").otherwise("defeasible_lacks_property")
    return d.select("graph_id", "depth", sign.alias("type"), serial.alias("serial"))


def concept_edges(edges: DataFrame, nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """(start, relation, end, weight) from edges (start_fk, end_fk, rel_fk, weight), nodes (node_pk, node_url) and relations
    (rel_pk, rel_url)."""
    a, b = nodes.select(F.col("node_pk").alias("start_fk"), F.col("node_url").alias("start")), nodes.select(F.col("node_pk").alias("end_fk"), F.col("node_url").alias("end"))
    return edges.join(relations.select(F.col("rel_pk").alias("rel_fk"), F.col("rel_url").alias("relation")), "rel_fk").join(a, "start_fk").join(b, "end_fk").select("start", "relation", "end", "weight")


def concept(url: Column, lang: str = "en", *, suffix: bool = False) -> Column:
    """The concept in /c/<lang>/<concept>/...; with its suffix for properties."""
    rest = F.split_part(url, F.lit(f"/c/{lang}/"), F.lit(2))
    return rest if suffix else F.split_part(rest, F.lit("/"), F.lit(1))


def reached(relations: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, node, depth): nodes within `depth` steps (parent, child) of each root, each at its least depth, the root at 0.
    The depth is a small constant; each step is one join and drops what has been seen."""
    level = roots.select("root", F.col("root").alias("node")).withColumn("depth", F.lit(0))
    seen, step = level, relations.select(F.col("parent").alias("node"), "child").distinct()
    for d in range(1, depth + 1):
        level = level.join(step, "node").select("root", F.col("child").alias("node")).distinct().join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(d))
        seen = union_of(seen, level)
    return seen


def with_alias(children: DataFrame, aliases: DataFrame) -> DataFrame:
    """children (child, label, description) with their aliases joined by "|", null without any; children that have no label or
    only an id for one are left out."""
    a = aliases.groupBy("child").agg(F.array_join(F.array_sort(F.collect_set("alias")), "|").alias("aliases"))
    return children.where((F.coalesce("label", F.lit("")) != "") & ~F.col("label").startswith("Q")).join(a, "child", "left")


def entity_sets(found: DataFrame) -> DataFrame:
    """(entity, subclasses, properties, sentences): sorted distinct values for each entity from (entity, kind, value, sentence)."""
    values = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("value"))))  # noqa: E731  one entity's
    return found.groupBy("entity").agg(values("isa").alias("subclasses"), values("property").alias("properties"), F.array_sort(F.collect_set("sentence")).alias("sentences"))


# Relations of a lexical table by what they give, and those that a corpus is made of.
LEXICAL = {"similar": "ml", "synonyms": "rel_syn", "subclasses": "rel_gen", "properties": "rel_jja", "superclasses": "rel_spc", "components": "rel_com", "wholes": "rel_par", "sounds_like": "sl", "rhymes": "rel_rhy", "near_rhymes": "rel_nry", "spelled_like": "sp", "triggers": "rel_trg", "followers": "rel_bga", "predecessors": "rel_bgb", "antonyms": "rel_ant"}
CORPUS_OF = ("similar", "subclasses", "components", "sounds_like", "triggers")


def related_words(lexical: DataFrame, words: DataFrame, kind: str, *, single: bool = True) -> DataFrame:
    """(word, found) of one kind of relation, from a table (word, relation, found); single: letters only."""
    hits = lexical.where(F.col("relation") == LEXICAL[kind]).join(words, "word")
    return (hits.where(F.col("found").rlike(r"^\p{L}+$")) if single else hits).select("word", "found")


def word_corpus(lexical: DataFrame, words: DataFrame) -> DataFrame:
    """(word, found): the words of several relations and the word itself, each once."""
    return union_of(*[related_words(lexical, words, k) for k in CORPUS_OF], words.select("word", F.col("word").alias("found"))).distinct()


# Words in a definition that make it a property.
PROPERTY_WORDS = ("young", "immature", "baby", "juvenile", "adult", "female", "male", "castrated", "used for", "kept for", "trained", "raised", "having powers of", "role", "state", "condition", "ability")


def edge_kind(definition: Column, *, domain_changes: Column | None = None) -> Column:
    """property if the definition has one of the words, or if the domain of words changes; else subclass."""
    has = F.coalesce(F.lower(definition).rlike("|".join(PROPERTY_WORDS)), F.lit(False))
    return F.when(has if domain_changes is None else has | domain_changes, "property").otherwise("subclass")


# Traits of animals.
TRAITS = "hasFur hasFeathers hasScales isWarmBlooded isColdBlooded canFly canSwim canRunFast hasSharpTeeth hasClaws hasWings hasTail hasNightVision isNocturnal isDiurnal isCarnivorous isHerbivorous isOmnivorous isDomesticated isWild isSocial isSolitary hasCamouflage isTerritorial hasKeenSmell hasGoodHearing isEndangered hasMigrationBehavior hasVenom hasHorns hasHooves hasGills laysEggs givesLiveBirth hasComplexCommunication".split()


def traits(key: Column, n: int = 5, seed: int = 42) -> Column:
    """n distinct traits by hash."""
    return source_names(TRAITS, key, n, seed)
