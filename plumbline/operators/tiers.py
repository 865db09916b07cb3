"""Building evaluation tiers from labelled texts: keys, cleaning, quotas, licence policy, converters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import text as T

#: The reasons why an item is dropped, in the order in which they are looked for.
OVERLAP, DUPLICATE = "overlaps an earlier tier", "duplicate in tier"
SENTENCE, PASSAGE, NEAR = "shares a sentence with an earlier tier", "shares a passage with an earlier tier", "near duplicate of an earlier tier"
#: Fixed value: options that are shown at most.
MAX_SHOWN = 10


def filled(column: str) -> Column:
    """Null for the empty text as well."""
    return F.nullif(F.col(column), F.lit(""))


def group_key() -> Column:
    """The group that an item was recorded with; else a digest of its evidence (stance), or state, passage or question; else its id."""
    general = F.coalesce(T.digest(F.col("state")), T.digest(T.passage_of(F.coalesce("question", F.lit("")))), T.digest(F.coalesce("question", F.lit(""))))
    return F.coalesce(F.concat(F.lit("group:"), filled("group")), F.when(F.col("format") == "stance", T.digest(F.col("evidence"))).otherwise(general), F.col("id"))


def dedup_key() -> Column:
    """Items with this key in common are one: the normalised texts, put together."""
    zero = F.lit("\x00")
    general = F.concat(T.norm(F.col("state")), zero, T.norm(F.coalesce("question", F.lit(""))), zero, F.array_join(F.transform("options", T.norm), "\x00"))
    return F.when(F.col("format") == "stance", F.concat(T.norm(F.col("claim")), zero, T.norm(F.col("evidence")))).otherwise(general)


def clean(items: DataFrame, against: DataFrame) -> DataFrame:
    """items (id, key, digests) with the reason why they go, null for those that stay.

    An item goes if one of its digests is in `against` (a column digest); of the others with equal keys the first in
    hash order stays. A minimum by key decides, without a window over the items.
    """
    hit = items.select("id", F.explode("digests").alias("digest")).join(against.select("digest").distinct(), "digest", "left_semi").select("id").distinct().withColumn("hit", F.lit(True))
    marked = items.join(hit, "id", "left")
    order = F.struct(T.unit(F.col("id")).alias("u"), "id")
    first = marked.where("hit IS NULL").groupBy("key").agg(F.min(order).alias("first")).select("key", F.col("first.id").alias("keeper"))
    named = marked.join(first, "key", "left")
    reason = F.when(F.col("hit"), OVERLAP).when(F.col("keeper") != F.col("id"), DUPLICATE)
    return named.withColumn("reason", reason).drop("hit", "keeper")


def strict(docs: DataFrame, key: str, others: DataFrame, other_key: str) -> DataFrame:
    """key and the first reason, of a shared sentence, a shared passage and a near duplicate, for which a text goes."""
    sentence = T.segments(docs, key, "text").join(T.segments(others, other_key, "text").select("segment").distinct(), "segment", "left_semi").select(key)
    passage = T.shared_passages(docs, key, others, other_key).select(key)
    near = T.near_duplicates(docs, key, others, other_key).select(key)
    reasons = [f.distinct().select(key, F.lit(i).alias("order")) for i, f in enumerate((sentence, passage, near))]
    found = reasons[0].unionByName(reasons[1]).unionByName(reasons[2]).groupBy(key).agg(F.min("order").alias("order"))
    return found.select(key, F.element_at(F.array(F.lit(SENTENCE), F.lit(PASSAGE), F.lit(NEAR)), F.col("order") + 1).alias("reason"))


def round_robin(rows: DataFrame, over: list[str], order: list[str], most: int, within: list[str] | None = None) -> DataFrame:
    """The first `most` rows, dealt out in turn over the values of some columns (within each value of others).

    Only the first `most` of a value can be taken, so only these go on to the second ranking.
    """
    within = within or []
    turn = F.row_number().over(Window.partitionBy(*within, *over).orderBy(*order))
    first = rows.withColumn("_turn", turn).where(F.col("_turn") <= most)
    place = F.row_number().over(Window.partitionBy(*within).orderBy("_turn", *over)) if within else None
    if place is None:
        return first.orderBy("_turn", *over).limit(most).drop("_turn")
    return first.withColumn("_place", place).where(F.col("_place") <= most).drop("_turn", "_place")


def sample_options(options: Column, right: Column, key: Column, most: int = MAX_SHOWN) -> Column:
    """Options of which at most so many are shown: the right one first, then the others in the order of a hash."""
    hashed = lambda o: F.struct(F.sha2(F.concat(key, F.lit(":"), o).cast("binary"), 256).alias("h"), o.alias("o"))
    others = F.transform(F.slice(F.array_sort(F.transform(F.filter(options, lambda o: o != right), hashed)), 1, most - 1), lambda x: x["o"])
    return F.when(F.size(options) > most, F.concat(F.array(right), others)).otherwise(options)


def fit_allowed(sources: DataFrame, permissive: list[str], share_alike: list[str], share_alike_formats: list[str]) -> DataFrame:
    """sources (name, format, licence, treat_as, reason, quote) with whether the policy lets them be fitted on, and why not.

    Without a decision (treat_as is null) every licence must be allowed for the format; a decision counts alone, and
    must name a reason and quote its evidence.
    """
    listed = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    allowed = F.when(F.col("format").isin(share_alike_formats), listed(permissive + share_alike)).otherwise(listed(permissive))
    unknown = F.array_except("licence", allowed)
    why = (
        F.when(F.size("licence") == 0, "no licence recorded")
        .when(F.col("treat_as").isNull() & (F.size(unknown) > 0), F.concat(F.lit("not allowed: "), F.array_join(unknown, ", ")))
        .when(F.col("treat_as").isNull(), F.lit(None))
        .when(filled("reason").isNull() | filled("quote").isNull(), "the decision names no reason or quotes no evidence")
        .when(~F.array_contains(allowed, F.col("treat_as")), F.concat(F.lit("treated as "), "treat_as"))
    )
    return sources.withColumn("why", why).withColumn("allowed", F.col("why").isNull())


def licence_used() -> Column:
    return F.when(F.col("treat_as").isNotNull(), F.array("treat_as")).otherwise(F.col("licence"))


def choice(rows: DataFrame, label: str, names: list[str]) -> DataFrame:
    """options and label (a name) of rows whose label is the number of a name; other rows go."""
    return rows.where(F.col(label).between(0, len(names) - 1)).withColumn("options", F.array(*map(F.lit, names))).withColumn("right", F.element_at("options", F.col(label) + 1))


def boolean(truth: Column) -> Column:
    return F.when(truth, "true").when(~truth, "false")


def banded(value: Column, bounds: list[float]) -> Column:
    """Levels from 1: how many bounds the value reaches, and one; null for null."""
    return F.when(value.isNotNull(), F.lit(1) + sum((F.when(value >= b, 1).otherwise(0) for b in bounds), F.lit(0)))
