"""Free text to catalogue category: candidate phrases, then one equi-join; no UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgrid.functions.text import canon, match_words, singular_forms


def surface_table(categories: DataFrame, aliases: DataFrame) -> DataFrame:
    """(surface, category): aliases override, a category's own name beats other categories'
    synonyms, the lowest id wins among equals.

    categories: id, name, synonyms ARRAY<STRING>; aliases: surface, name (skipped if unknown).
    """
    own = categories.select(canon(F.col("name")).alias("surface"), "id", F.lit(1).alias("tier"))
    syn = categories.select(F.explode("synonyms").alias("s"), "id").select(canon(F.col("s")).alias("surface"), "id", F.lit(2).alias("tier"))
    ali = aliases.join(categories.select("name", "id"), "name").select("surface", "id", F.lit(0).alias("tier"))
    every = own.unionByName(syn).unionByName(ali)
    return every.groupBy("surface").agg(F.min_by("id", F.struct("tier", "id")).alias("category"))


def candidates(text: Column) -> Column:
    """Phrases to look up, best first: the whole phrase, then ever shorter trailing phrases, each
    as it stands and with its last word made singular."""
    whole, words = match_words(text)
    n = F.size(words)
    last = F.element_at(words, -1)

    def tails(i: Column) -> Column:
        start = F.slice(words, i, n - i)
        forms = F.concat(F.array(last), singular_forms(last))
        return F.transform(forms, lambda f: F.array_join(F.concat(start, F.array(f)), " "))

    trailing = F.flatten(F.transform(F.sequence(F.lit(1), n), tails))
    return F.when(n > 0, F.concat(F.array(whole), trailing)).otherwise(F.array(whole))


def match_categories(phrases: DataFrame, surfaces: DataFrame, phrase: str) -> DataFrame:
    """Distinct phrases with their category, null where nothing matches.

    Repeats collapse first, so a phrase that fills a third of the rows is looked up once.
    """
    distinct = phrases.select(phrase).distinct()
    cand = distinct.select(phrase, F.posexplode(candidates(F.col(phrase))).alias("_at", "surface"))
    hit = cand.join(surfaces, "surface").groupBy(phrase).agg(F.min_by("category", "_at").alias("category"))
    return distinct.join(hit, phrase, "left")
