"""Sentences from predicates: negation, questions, disjunctions, plurals, templates. All are CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Predicate prefix, its plain verb. The order matters, as the first prefix that fits is used.
VERBS = [("is ", "is not "), ("has ", "does not have "), ("can ", "cannot "), ("serves as ", "does not serve as "), ("appears ", "does not appear "), ("produces ", "does not produce "), ("tastes or smells ", "does not taste or smell "), ("displays ", "does not display "), ("thrives ", "does not thrive ")]
PLURAL_VERBS = [("is ", "are not "), ("are ", "are not "), ("has ", "do not have "), ("have ", "do not have "), ("can ", "cannot "), ("serves as ", "do not serve as "), ("appears ", "do not appear "), ("produces ", "do not produce "), ("thrives ", "do not thrive "), ("displays ", "do not display ")]
# Beginnings of questions, templates of edges.
QUESTIONS = [("is ", "Is ", " "), ("has ", "Does ", " have "), ("can ", "Can ", " "), ("serves as ", "Does ", " serve as "), ("appears ", "Does ", " appear "), ("produces ", "Does ", " produce "), ("tastes or smells ", "Does ", " taste or smell ")]
TEMPLATES = {"is_a": "{subject} is a {object}.", "implies": "Objects that {subject_predicate} generally {object_predicate_plural}.", "conflict": "However, {subject} does not {object}.", "has_attribute": "{subject} {object_predicate}.", "inheritance": "{subject} is a kind of {object}.", "defeasible_has_property": "{subject} {object_predicate}.", "defeasible_lacks_property": "{subject} does not {object_predicate}.", "hypothesis_edge": "Does {subject} {object_predicate}?"}
FALLBACK = "{subject} is related to {object}."


def _by_prefix(predicate: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    out = None
    for prefix, instead in rules:
        value = F.concat(F.lit(instead), F.substring(predicate, len(prefix) + 1, 1 << 30))
        out = F.when(predicate.startswith(prefix), value) if out is None else out.when(predicate.startswith(prefix), value)
    return out.otherwise(F.concat(F.lit(otherwise), predicate))


def negated(predicate: Column) -> Column:
    return _by_prefix(predicate, VERBS, "does not ")


def negated_rule(predicate: Column) -> Column:
    return _by_prefix(predicate, PLURAL_VERBS, "do not ")


def negative_sentence(subject: Column, predicate: Column) -> Column:
    return F.concat(subject, F.lit(" "), negated(predicate), F.lit("."))


def at_least_one_of(subjects: Column, predicate: Column) -> Column:
    return F.concat(F.lit("At least one of "), subjects, F.lit(" "), negated(predicate), F.lit("."))


def at_least_one_object(label: Column, predicate: Column) -> Column:
    return F.concat(F.lit("At least one "), label, F.lit(" object "), negated(predicate), F.lit("."))


def question(subject: Column, predicate: Column) -> Column:
    out = None
    for prefix, start, middle in QUESTIONS:
        value = F.concat(F.lit(start), subject, F.lit(middle), F.substring(predicate, len(prefix) + 1, 1 << 30), F.lit("?"))
        out = F.when(predicate.startswith(prefix), value) if out is None else out.when(predicate.startswith(prefix), value)
    return out.otherwise(F.concat(F.lit("Does "), subject, F.lit(" "), predicate, F.lit("?")))


def template_sentence(edge_type: Column, **values: Column) -> Column:
    """The template of the edge type with its placeholders filled."""
    text = None
    for name, template in TEMPLATES.items():
        text = F.when(edge_type == name, F.lit(template)) if text is None else text.when(edge_type == name, F.lit(template))
    text = text.otherwise(F.lit(FALLBACK))
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return text


def filled(template: Column, value: Column) -> Column:
    return F.replace(template, F.lit("[value]"), F.lower(value))


def first_upper(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30))


def capitalized(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 30)))


def plural(word: Column) -> Column:
    low = F.lower(word)
    return F.when(word == "", "").when(low.rlike("(s|sh|ch|x|z)$"), F.concat(word, F.lit("es"))).when(low.rlike("[^aeiou]y$"), F.concat(F.substring(word, F.lit(1), F.length(word) - 1), F.lit("ies"))).otherwise(F.concat(word, F.lit("s")))


def naive_plural(word: Column) -> Column:
    return F.when(word.endswith("s"), word).otherwise(F.concat(word, F.lit("s")))


def article(word: Column) -> Column:
    return F.when(F.lower(F.substring(word, 1, 1)).isin(*"aeiou"), "an").otherwise("a")


def listed(names: Column, last: str = "or") -> Column:
    """'a', 'a or b', 'a, b, or c'."""
    n = F.size(names)
    head = F.concat_ws(", ", F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(0))))
    end = F.try_element_at(names, F.lit(-1))
    return F.when(n == 0, "").when(n == 1, end).when(n == 2, F.concat(head, F.lit(f" {last} "), end)).otherwise(F.concat(head, F.lit(f", {last} "), end))


def answer(resolved: Column) -> Column:
    return F.when(resolved == "True", "yes").when(resolved == "False", "no").when(resolved == "Skeptical/Unknown", "unknown").otherwise(F.lower(resolved))


def record_id(subject: Column, kind: Column, node: Column, serial: Column) -> Column:
    return F.concat_ws("_", subject, kind, node, F.replace(F.format_string("%.3f", serial.cast("double")), F.lit("."), F.lit("_")))


def last_part(s: Column, sep: str = "/") -> Column:
    return F.element_at(F.split(s, sep), -1)


def percent(x: Column) -> Column:
    """'12.3 %' style cells; a dash for null."""
    return F.when(x.isNull(), "—").otherwise(F.format_string("%.1f", x * 100))


def edge_sentence(stored: Column, edge_type: Column, subject: Column, predicate: Column, label: Column) -> Column:
    """The stored sentence of an edge if there is one, else one from its parts."""
    made = F.when(edge_type == "defeasible_has_property", F.concat(subject, F.lit(" "), predicate, F.lit("."))).when(edge_type == "defeasible_lacks_property", negative_sentence(subject, predicate)).otherwise(F.concat(subject, F.lit(" has attribute "), label, F.lit(".")))
    return F.coalesce(F.when(stored != "", stored), made)


def update_sentence(kind: Column, *, subject: Column, predicate: Column, plural: Column, parent: Column, parent_denied: Column, scope: Column, root: Column, told: Column) -> Column:
    """How an update is told, by its kind. told: the edge's own sentence; parent: label of the property before it on the
    chain; an exception to a property already denied is told plainly."""
    exception = F.concat(subject, F.lit(" is an exception to the rule that "), parent, F.lit(" objects "), plural, F.lit("."))
    out = F.when(kind == "exception", F.when(parent_denied, told).otherwise(exception)).when(kind.isin("pos", "neg", "safe_irr", "trap_irr"), told)
    out = out.when(kind == "quantified_inst", at_least_one_of(listed(scope), predicate)).when(kind == "quantified_gen", at_least_one_object(root, predicate))
    return out.otherwise(F.concat(F.lit("Update regarding "), subject, F.lit(" and "), predicate, F.lit(".")))


def rule_claim(parent: Column, predicate: Column, *, denied: bool) -> Column:
    return F.concat(F.lit("objects with property "), parent, F.lit(" generally "), negated_rule(predicate) if denied else predicate, F.lit("."))


def reliability(names: Column, key: Column) -> Column:
    """One text that orders sources by reliability: neighbours in hash order, each told from either end."""
    n = F.size(names)
    at = F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
    mark = lambda i, use: F.md5(F.concat(F.lit(f"42|{use}|"), key.cast("string"), F.lit("|"), i.cast("string")).cast("binary"))
    higher, lower = lambda i: F.get(names, i), lambda i: F.get(names, i + 1)
    said = lambda i: F.when(F.substring(mark(i, "rel"), 1, 1) < "8", F.concat(higher(i), F.lit(" is more reliable than "), lower(i))).otherwise(F.concat(lower(i), F.lit(" is less reliable than "), higher(i)))
    ordered = F.array_sort(F.transform(at, lambda i: F.struct(mark(i, "relorder").alias("k"), said(i).alias("s"))))
    return F.when(n > 1, F.concat(F.lit("For reference, "), F.array_join(ordered["s"], ". "), F.lit("."))).otherwise("")


def object_index(name: Column) -> Column:
    """The number in Object_<n>; null for other names."""
    return F.regexp_extract(name, r"^Object_(\d+)$", 1).try_cast("int")


def spaced(name: Column) -> Column:
    return F.replace(name, F.lit("_"), F.lit(" "))
