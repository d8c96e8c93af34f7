"""Entity resolution: grouping of mentions, candidate resolution, merge acceptance, merged records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import vocab
from ..functions.ordered import in_order
from ..session import bounded
from .graph import pair_counts
from ..functions.scalar import tokens_similar

# Words that say nothing about who is meant; those of them that say nothing at all; words for relations.
HONORIFICS = (
    "sir", "lord", "lady", "mr", "mrs", "ms", "miss", "dr", "doctor", "captain", "capt", "major", "colonel", "col", "general", "gen", "admiral", "rev", "father", "mother", "fr", "saint", "st",
    "king", "queen", "prince", "princess", "duke", "duchess", "earl", "count", "countess", "baron", "baroness", "the", "of", "a", "an",
)
DETERMINERS = ("the", "of", "a", "an")
RELATIONS = ("mom", "dad", "wife", "husband", "son", "daughter", "brother", "sister", "uncle", "aunt", "cousin", "nephew", "niece", "kid", "child", "spouse", "partner", "narrator", "author")


def grouped(mentions: DataFrame, norm: str, kind: str, name: str, fact: str, topic: str, pos: str) -> DataFrame:
    """Groups of mentions with one normalized name and type: the longest name (the first of equal ones) names the group."""
    longest = F.max_by(name, F.struct(F.length(name), -F.col(pos)))
    return mentions.groupBy(norm, kind).agg(
        longest.alias("canonical_name"), F.count("*").alias("mention_count"), F.sort_array(F.collect_set(name)).alias("aliases"),
        F.sort_array(F.collect_set(topic)).alias("topics"), F.countDistinct(fact).alias("facts"), F.min(pos).alias("first_pos"),
    )


def numbered(groups: DataFrame, order: list) -> DataFrame:
    return in_order(groups, order, "_place").withColumn("gid", F.concat(F.lit("g"), F.col("_place").cast("string"))).drop("_place")


def comentions(mentions: DataFrame, entity: str, fact: str) -> DataFrame:
    """For each entity the others it is mentioned with, and in how many facts: mentions are deduplicated before they meet."""
    return pair_counts(mentions, entity, fact, "facts")


def resolved(candidates: DataFrame, groups: DataFrame, name: str, kind: str) -> DataFrame:
    """For each candidate name its group: the one of the mention's own type first, then most mentions, then the larger name. The best group of each name, and of each
    name and type, is known before candidates meet it, so a candidate is one row however many groups have its name; of a candidate's rows the best stays."""
    rank = F.struct("mention_count", F.lower("canonical_name").alias("_l"))
    own_columns = [c for c in groups.columns if c != name]
    group = F.struct(*own_columns)
    best = bounded(groups.groupBy(name).agg(F.max_by(group, rank).alias("_any")))
    typed = bounded(groups.groupBy(name, "entity_type").agg(F.max_by(group, rank).alias("_own")).withColumnRenamed("entity_type", "_type"))
    met = candidates.join(best, name).join(typed.withColumnRenamed(name, "_name"), (F.col(name) == F.col("_name")) & (F.col(kind) == F.col("_type")), "left").drop("_name", "_type")
    met = met.withColumn("_got", F.coalesce("_own", "_any")).withColumn("_is", F.col("_own").isNotNull())
    order = F.struct("_is", F.col("_got.mention_count").alias("_m"), F.lower("_got.canonical_name").alias("_l"))
    row = F.struct(*[c for c in candidates.columns if c != "candidate"], "_got")
    one = met.groupBy("candidate").agg(F.max_by(row, order).alias("_r"))
    return one.select("candidate", *[f"_r.{c}" for c in candidates.columns if c != "candidate"], *[f"_r._got.{c}" for c in own_columns])


def disambiguated(df: DataFrame, slug: str, order: list) -> DataFrame:
    """Ids of slugs: the n-th of equal ones gets -n."""
    n = F.row_number().over(Window.partitionBy(slug).orderBy(*order))
    return df.withColumn("canonical_id", F.when(n == 1, F.col(slug)).otherwise(F.concat(F.col(slug), F.lit("-"), n.cast("string"))))


def names_overlap(a: Column, b: Column) -> Column:
    """Whether two normalized names share a token that says who is meant, or one is a word for a relation and the other holds a
    name of four letters or more. Where one has titles only, a shared title is enough."""
    words = lambda c, drop: F.filter(F.array_except(F.split(c, " "), F.array(*[F.lit(h) for h in drop])), lambda t: t != "")
    tokens = lambda c: words(c, HONORIFICS)
    ta, tb = tokens(a), tokens(b)
    similar = F.exists(ta, lambda x: F.exists(tb, lambda y: tokens_similar(x, y)))
    titles = F.arrays_overlap(words(a, DETERMINERS), words(b, DETERMINERS))
    short = lambda x, y: (F.size(x) == 1) & F.get(x, F.lit(0)).isin(*RELATIONS) & F.exists(y, lambda t: F.length(t) >= 4)
    return F.when((F.size(ta) == 0) | (F.size(tb) == 0), titles).otherwise(similar | short(ta, tb) | short(tb, ta))


def merge_verdict(valid: Column, confidence: Column, overlap: Column, same_type: Column) -> Column:
    """Why a merge is refused, or kept."""
    return (
        F.when(~valid, "invalid").when(confidence < vocab.MERGE_FLOOR, "low_confidence")
        .when(overlap | (same_type & (confidence >= vocab.MERGE_TRUST)), "kept").otherwise("no_overlap")
    )


def merged(records: DataFrame, comp: DataFrame) -> DataFrame:
    """One record a component: named by most mentions, then the longer name, then the least id; mentions add up, sets unite."""
    rows = records.join(comp, records["id"] == comp["node"], "left").withColumn("component", F.coalesce("component", "id"))
    best = F.max_by("name", F.struct("mention_count", F.length("name"), -F.col("id")))
    return rows.groupBy("component").agg(best.alias("canonical_name"), F.sum("mention_count").alias("mention_count"), F.count("*").alias("members"))


def winning_relations(relations: DataFrame) -> DataFrame:
    """Of the relations between two entities the one with most evidence, then confidence, then the least label; evidence unites."""
    by = relations.filter("from_id <> to_id").groupBy("from_id", "to_id", "relation").agg(F.countDistinct("evidence").alias("n"), F.max("confidence").alias("confidence"))
    total = relations.filter("from_id <> to_id").groupBy("from_id", "to_id").agg(F.countDistinct("evidence").alias("evidence"))
    rank = F.row_number().over(Window.partitionBy("from_id", "to_id").orderBy(F.desc("n"), F.desc("confidence"), "relation"))
    return by.withColumn("_r", rank).filter("_r = 1").select("from_id", "to_id", "relation", "confidence").join(total, ["from_id", "to_id"])


def subject(persons: DataFrame) -> DataFrame:
    """The person most likely the subject; without any likelihood the one mentioned most."""
    return persons.withColumn("_any", persons.agg((F.max("likelihood") > 0).alias("a")).scalar()).orderBy(F.desc(F.when(F.col("_any"), F.col("likelihood")).otherwise(F.lit(0.0))), F.desc("mention_count"), "canonical_name").limit(1).drop("_any")
