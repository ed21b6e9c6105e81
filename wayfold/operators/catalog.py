"""Ranking of catalogued relations for many evidence texts at once.

Texts are read once, for the words that the catalog knows. Names in references and mentions lead
straight to their relations. For shared terms every set of terms that some relation holds keeps only
its first relations in an order that no text changes (the bonus, then the name): a relation that shares
exactly this set with a text and is not among them has ``top`` better ones in every text. So
a list of thousands of relations with a common term is never followed to its end, and no result is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.text import relation_refs, term_set, unquoted_lower
from wayfold.operators.ordering import first_rows
from wayfold.session import cut_lineage

# Weights of the ranking and the limit of the fallback.
QUALIFIED_SQL, BARE_SQL, QUALIFIED_MENTION, BARE_MENTION = 1000, 800, 400, 150
PER_TERM, BASE_TABLE, OUTSIDE_MAIN, BACKUP = 8, 20, 5, -10
BACKUP_PATTERN = r"(?:^|_)(?:hist|backup|tmp|stg|v[0-9]+)(?:_|$)"
SMALL_CATALOG = 40
PLAIN_NAME = r"^[a-z0-9_]+$"
PLAIN_KEY = r"^[a-z0-9_]+\.[a-z0-9_]+$"
#: Names with other characters that one automaton holds; more of them are sought in several passes.
AUTOMATON_NAMES = 50_000
#: A vocabulary of at most so many words is sent to all tasks, so that the words of the texts need no shuffle.
BROADCAST_WORDS = 500_000
#: Relations of more terms are listed under every term instead of every set of terms.
MOST_TERMS = 6
#: Texts with more terms of the catalog meet all relations of each term instead of sets of terms.
MOST_TEXT_TERMS = 64


def relations(catalog: DataFrame) -> DataFrame:
    qualified = F.concat_ws(".", "table_schema", "table_name")
    return catalog.select(
        "table_schema", "table_name", "table_type",
        qualified.alias("qualified_name"),
        F.lower(qualified).alias("key"),
        F.lower("table_name").alias("name"),
    )


def references(texts: DataFrame) -> DataFrame:
    """(text_id, ref): relation names that follow FROM or JOIN."""
    return texts.select("text_id", F.explode(relation_refs("text")).alias("ref"))


def unresolved(texts: DataFrame, catalog: DataFrame) -> DataFrame:
    """References that name no relation of the catalog."""
    known = relations(catalog)
    names = known.select(F.col("key").alias("ref")).unionByName(known.select(F.col("name").alias("ref"))).distinct()
    return references(texts).join(names, "ref", "left_anti").select("text_id", "ref")


def _spoken(normal: Column) -> Column:
    """Identifiers of a text, and neighbours joined by a dot."""
    chains = F.regexp_extract_all(normal, F.lit(r"[a-z0-9_]+(?:\.[a-z0-9_]+)*"), F.lit(0))

    def words(chain):
        parts = F.split(chain, r"\.")
        neighbours = F.transform(
            F.slice(parts, F.lit(1), F.size(parts) - 1),
            lambda part, i: F.concat_ws(".", part, F.element_at(parts, i + 2)),
        )
        return F.concat(parts, neighbours)

    return F.array_distinct(F.flatten(F.transform(F.array_distinct(chains), words)))


def names_within(names: list[str], text: str | None, automaton) -> list[str]:
    """The names that stand in a text with no letter, digit or underscore of an identifier next to them."""
    if not text:
        return []
    edge = set("abcdefghijklmnopqrstuvwxyz0123456789_")
    found = set()
    for end, k in automaton.iter(text):
        begin = end - len(names[k]) + 1
        if (begin == 0 or text[begin - 1] not in edge) and (end + 1 == len(text) or text[end + 1] not in edge):
            found.add(k)
    return [names[k] for k in sorted(found)]


def _names_in(names: list[str]):
    """A function of a text column: which of the names it mentions; one automaton per task."""

    def seek(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for k, name in enumerate(names):
            automaton.add_word(name, k)
        automaton.make_automaton()
        for texts in batches:
            yield texts.map(lambda text: names_within(names, text, automaton))

    return F.pandas_udf(seek, "array<string>")


def odd_mentions(texts: DataFrame, known: DataFrame, block: int = AUTOMATON_NAMES) -> DataFrame | None:
    """(text_id, kind, word): names with blanks, hyphens, ``$`` and the like that stand in a text; None without such names.

    One pass of an automaton over the texts finds all names of a block; a catalog with more odd names
    than fit into one takes several passes.
    """
    odd = known.filter(~F.col("name").rlike(PLAIN_NAME) | ~F.col("key").rlike(PLAIN_KEY))
    words = odd.select(F.explode(F.array(
        F.when(~F.col("name").rlike(PLAIN_NAME), F.col("name")), F.when(~F.col("key").rlike(PLAIN_KEY), F.col("key"))
    )).alias("word")).filter("word IS NOT NULL AND word <> ''").distinct()
    count = words.count()
    blocks, whole = -(-count // block), None
    for b in range(blocks):
        names = sorted(r["word"] for r in words.filter(F.pmod(F.xxhash64("word"), F.lit(blocks)) == b).collect())
        if not names:
            continue

        found = texts.select(
            "text_id", F.lit("said").alias("kind"), F.explode(_names_in(names)(unquoted_lower("text"))).alias("word")
        )
        whole = found if whole is None else whole.unionByName(found)
    return whole if whole is None else _not_only_by_key(whole, odd)


def _not_only_by_key(mentions: DataFrame, odd: DataFrame) -> DataFrame:
    """The mentions without those names whose relations the text all mentions by their keys, which count for more."""
    mentions = cut_lineage(mentions)
    relations_of = odd.select(F.col("name").alias("word"), "key").filter("word <> key").distinct()
    keyed = mentions.select("text_id", F.col("word").alias("key"))
    open_names = mentions.join(relations_of, "word").join(keyed, ["text_id", "key"], "left_anti").select("text_id", "word").distinct()
    names = relations_of.select("word").distinct()
    keys = mentions.join(names, "word", "left_anti").unionByName(
        mentions.join(odd.select(F.col("key").alias("word")).distinct(), "word", "left_semi").join(names, "word", "left_semi")
    )
    return keys.unionByName(open_names.select("text_id", F.lit("said").alias("kind"), "word")).select("text_id", "kind", "word").distinct()


def _found_words(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(text_id, kind, word), once each: what the texts hold of the catalog's names and terms; stored."""
    tagged = lambda kind, words: F.transform(words, lambda w: F.struct(F.lit(kind).alias("kind"), w.alias("word")))
    refs = relation_refs("text")
    elsewhere = F.array_distinct(F.transform(F.filter(refs, lambda r: r.contains(".")), lambda r: F.substring_index(r, ".", -1)))
    said = texts.select("text_id", F.inline(F.concat(
        tagged("ref", refs), tagged("elsewhere", elsewhere), tagged("said", _spoken(unquoted_lower("text"))), tagged("term", term_set("text"))
    )))
    names = known.select(F.explode(F.array("key", "name")).alias("word"))
    vocabulary = (
        names.select(F.lit("ref").alias("kind"), "word").unionByName(names.select(F.lit("said").alias("kind"), "word"))
        .unionByName(known.filter("is_main").select(F.lit("elsewhere").alias("kind"), F.col("name").alias("word")))
        .unionByName(known.select(F.lit("term").alias("kind"), F.explode("terms").alias("word"))).distinct()
    )
    vocabulary = cut_lineage(vocabulary)
    if vocabulary.count() <= BROADCAST_WORDS:
        vocabulary = F.broadcast(vocabulary)
    found = said.join(vocabulary, ["kind", "word"], "left_semi")
    odd = odd_mentions(texts, known)
    return cut_lineage(found if odd is None else found.unionByName(odd.select("kind", "word", "text_id")).distinct())


def _by_terms(found: DataFrame, known: DataFrame, top: int) -> tuple[DataFrame, DataFrame]:
    """((text_id, has): each text's terms, (text_id, qualified_name): all that can be among the first by shared terms)."""
    has = found.filter("kind = 'term'").groupBy("text_id").agg(F.array_sort(F.collect_set("word")).alias("has"))
    hidden = found.filter("kind = 'elsewhere'").groupBy("text_id").count().agg(F.max("count")).first()[0] or 0
    # A text can hide at most ``hidden`` relations of main, so their heads are longer by as many.
    few = known.filter((F.size("terms") > 0) & (F.size("terms") <= MOST_TERMS))
    masks = F.sequence(F.lit(1), F.expr("CAST(power(2, size(terms)) AS INT) - 1"))
    sets = few.select("qualified_name", "is_main", "bonus", "terms", F.explode(masks).alias("mask")).withColumn(
        "shared", F.expr("filter(terms, (t, i) -> getbit(mask, i) = 1)")
    ).drop("mask", "terms")
    best = [F.col("bonus").desc(), F.col("qualified_name")]
    heads = first_rows(sets.filter("NOT is_main"), ["shared"], best, top).unionByName(
        first_rows(sets.filter("is_main"), ["shared"], best, top + hidden)
    ).select("shared", "qualified_name")
    short = has.filter(F.size("has") <= MOST_TEXT_TERMS)
    alone = heads.filter("size(shared) = 1").select(F.col("shared")[0].alias("term"), "qualified_name")
    singles = short.select("text_id", F.explode("has").alias("term")).join(alone, "term").select("text_id", "qualified_name")
    pairs = F.flatten(F.transform("has", lambda a, i: F.transform(F.slice(F.col("has"), i + 2, F.size("has")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    together = heads.filter("size(shared) > 1").select(F.col("shared")[0].alias("a"), F.col("shared")[1].alias("b"), "shared", "qualified_name")
    doubles = (
        short.select("text_id", "has", F.inline(pairs)).join(together, ["a", "b"])
        .filter(F.size(F.array_except("shared", "has")) == 0).select("text_id", "qualified_name")
    )
    listed = lambda rows: rows.select("qualified_name", F.explode("terms").alias("term"))
    words = has.select("text_id", "has", F.explode("has").alias("term"))
    rest = words.join(listed(known.filter(F.size("terms") > MOST_TERMS)), "term").select("text_id", "qualified_name")
    long = words.filter(F.size("has") > MOST_TEXT_TERMS).join(listed(few), "term").select("text_id", "qualified_name")
    return has, singles.unionByName(doubles).unionByName(rest).unionByName(long)


def rank(texts: DataFrame, catalog: DataFrame, top: int = 24, small_catalog: int = SMALL_CATALOG) -> DataFrame:
    """(text_id, qualified_name, score): the best relations of every text.

    A catalog of at most ``small_catalog`` relations is returned whole for texts that match none of them; 0 turns that off.
    """
    known = relations(catalog).withColumn("is_main", F.lower("table_schema") == "main").withColumn("terms", F.array_sort(term_set("qualified_name")))
    known = known.withColumn(
        "bonus",
        F.when(F.col("table_type") == "BASE TABLE", BASE_TABLE).otherwise(0)
        + F.when(~F.col("is_main"), OUTSIDE_MAIN).otherwise(0)
        + F.when(F.col("name").rlike(BACKUP_PATTERN), BACKUP).otherwise(0),
    )
    found = _found_words(texts, known)
    point = lambda kind, on, value: found.filter(F.col("kind") == kind).join(
        known.select("qualified_name", F.col(on).alias("word")), "word"
    ).select("text_id", "qualified_name", F.lit(value if kind == "ref" else 0).alias("sql"), F.lit(value if kind == "said" else 0).alias("mention"))
    named = (
        point("ref", "key", QUALIFIED_SQL).unionByName(point("ref", "name", BARE_SQL))
        .unionByName(point("said", "key", QUALIFIED_MENTION)).unionByName(point("said", "name", BARE_MENTION))
    )
    has, sharing = _by_terms(found, known, top)
    none = F.lit(0)
    candidates = named.unionByName(sharing.withColumn("sql", none).withColumn("mention", none)).groupBy("text_id", "qualified_name").agg(
        F.max("sql").alias("sql"), F.max("mention").alias("mention")
    )
    # A main relation yields to a namesake that the text names with its schema.
    elsewhere = found.filter("kind = 'elsewhere'").select("text_id", F.col("word").alias("name"), F.lit(True).alias("_elsewhere"))
    full = candidates.join(known, "qualified_name").join(has, "text_id", "left").join(elsewhere, ["text_id", "name"], "left")
    hidden = F.col("is_main") & (F.col("sql") == 0) & F.col("_elsewhere").isNotNull()
    shared = F.when(F.col("has").isNotNull(), F.size(F.array_intersect("has", "terms"))).otherwise(0)
    points = F.col("sql") + F.col("mention") + PER_TERM * shared
    ranked = full.filter(~hidden).select("text_id", "qualified_name", (points + F.col("bonus")).alias("score"))
    if small_catalog and catalog.limit(small_catalog + 1).count() <= small_catalog:
        ranked = ranked.unionByName(_fallback(texts, ranked, known, small_catalog))
    return first_rows(ranked, ["text_id"], [F.col("score").desc(), F.col("qualified_name")], top)


def _fallback(texts: DataFrame, ranked: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """All relations of a small catalog, for texts that match none of them."""
    unmatched = texts.select("text_id").join(ranked.select("text_id").distinct(), "text_id", "left_anti")
    names = [row["qualified_name"] for row in known.select("qualified_name").limit(most).collect()]
    return unmatched.select(
        "text_id", F.explode(F.array(*[F.lit(n) for n in names])).alias("qualified_name"), F.lit(0).alias("score")
    )
