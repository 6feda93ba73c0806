"""Agreement of raters, adjudication and merging of votes.

Votes are rows (unit, rater, label, labels): a primary label and an array of labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def raw_agreement(votes: DataFrame) -> DataFrame:
    """Units with two or more labels, and those of them where all agree."""
    u = votes.where(F.col("label").isNotNull()).groupBy("unit").agg(F.count(F.lit(1)).alias("m"), F.count_distinct("label").alias("d")).where("m >= 2")
    return u.agg(F.count(F.lit(1)).alias("units"), F.count_if(F.col("d") == 1).alias("agreed")).select("units", "agreed", (F.col("agreed") / F.nullif("units", F.lit(0))).alias("agreement"))


def krippendorff(votes: DataFrame) -> DataFrame:
    """Nominal alpha from counts by unit and label; 1 if all labels are the same one."""
    c = votes.where(F.col("label").isNotNull()).groupBy("unit", "label").agg(F.count(F.lit(1)).alias("c"))
    m = c.groupBy("unit").agg(F.sum("c").alias("m")).where("m >= 2")
    c = c.join(m, "unit")
    by_label = c.groupBy("label").agg(F.sum("c").alias("t"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same"))
    pairs = m.agg(F.sum(F.col("m") * (F.col("m") - 1)).alias("pairs"), F.sum("m").alias("n"))
    s = by_label.agg(F.sum("same").alias("same"), F.sum(F.col("t") * (F.col("t") - 1)).alias("expected_same"))
    observed = 1 - F.col("same") / F.col("pairs")
    expected = 1 - F.col("expected_same") / (F.col("n") * (F.col("n") - 1))
    return s.join(F.broadcast(pairs)).select(F.when(expected == 0, F.when(observed == 0, 1.0).otherwise(0.0)).otherwise(1 - observed / expected).alias("alpha"), observed.alias("observed"), expected.alias("expected"))


def pairwise_jaccard(votes: DataFrame) -> DataFrame:
    """Jaccard similarity of each two raters' label sets of a unit; two empty sets agree."""
    both = F.sort_array(F.collect_list(F.struct("rater", "labels")))
    v = votes.groupBy("unit").agg(both.alias("v"))  # a unit has few raters
    p = v.select("unit", F.explode(F.flatten(F.transform("v", lambda a: F.transform(F.filter("v", lambda b: b["rater"] > a["rater"]), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    union = F.size(F.array_union("p.a.labels", "p.b.labels"))
    jaccard = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("p.a.labels", "p.b.labels")) / union)
    return p.select("unit", F.col("p.a.rater").alias("a"), F.col("p.b.rater").alias("b"), jaccard.alias("jaccard"))


def confusion(votes: DataFrame) -> DataFrame:
    """Pairs of different labels that two raters gave one unit, by frequency."""
    c = votes.where(F.col("label").isNotNull()).groupBy("unit", "label").agg(F.count(F.lit(1)).alias("c"))
    v = c.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("label", "c"))).alias("v"))
    p = v.select(F.explode(F.flatten(F.transform("v", lambda a: F.transform(F.filter("v", lambda b: b["label"] > a["label"]), lambda b: F.struct(a["label"].alias("a"), b["label"].alias("b"), (a["c"] * b["c"]).alias("n")))))).alias("p"))
    return p.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.sum("p.n").alias("n"))


def label_agreement(votes: DataFrame) -> DataFrame:
    """For each label: units where all raters give it or none does, and where any does."""
    raters = votes.groupBy("unit").agg(F.count(F.lit(1)).alias("m"))
    units = raters.agg(F.count(F.lit(1)).alias("units"))
    given = votes.select("unit", F.explode("labels").alias("label")).groupBy("unit", "label").agg(F.count(F.lit(1)).alias("k")).join(raters, "unit")
    g = given.groupBy("label").agg(F.count(F.lit(1)).alias("any_units"), F.count_if(F.col("k") == F.col("m")).alias("all_units"))
    return g.join(F.broadcast(units)).select("label", "any_units", "all_units", ((F.col("units") - F.col("any_units") + F.col("all_units")) / F.col("units")).alias("agreement"))


def coverage(votes: DataFrame, other: tuple[str, ...] = ("OTHER", "UNKNOWN", "xx")) -> DataFrame:
    """Votes, abstentions, votes outside the taxonomy, and votes with any label, by rater."""
    return votes.groupBy("rater").agg(F.count(F.lit(1)).alias("votes"), F.count_if(F.col("label").isNull()).alias("abstained"), F.count_if(F.col("label").isin(*other)).alias("other"), F.avg((F.size("labels") > 0).cast("double")).alias("coverage"))


def adjudication_triggers(votes: DataFrame) -> DataFrame:
    """Why a unit needs an adjudicator: an abstention, different primary labels, label
    sets that are both broad and apart, or too few votes; '' if it needs none."""
    far = pairwise_jaccard(votes).groupBy("unit").agg(F.min("jaccard").alias("least"))
    u = votes.groupBy("unit").agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("label").isNull()).alias("abstained"), F.count_distinct("label").alias("d"), F.min(F.size("labels")).alias("breadth"))
    why = F.array_compact(F.array(F.when(F.col("abstained") > 0, "abstain"), F.when(F.col("d") > 1, "primary"), F.when((F.col("breadth") >= 2) & (F.col("least") < 0.5), "sets"), F.when(F.col("m") < 2, "single")))
    return u.join(far, "unit", "left").select("unit", F.array_join(why, ",").alias("reasons"))


def auto_merge(votes: DataFrame) -> DataFrame:
    """First label that isn't null by rater; the labels all raters share, or else all labels."""
    v = votes.groupBy("unit").agg(F.min_by("label", F.when(F.col("label").isNotNull(), F.col("rater"))).alias("label"), F.count(F.lit(1)).alias("m"))
    k = votes.select("unit", F.explode("labels").alias("l")).groupBy("unit", "l").agg(F.count(F.lit(1)).alias("k"))
    sets = k.join(v.select("unit", "m"), "unit").groupBy("unit").agg(F.array_sort(F.collect_list(F.when(F.col("k") == F.col("m"), F.col("l")))).alias("shared"), F.array_sort(F.collect_list("l")).alias("every"))
    merged = F.when(F.size("shared") > 0, F.col("shared")).otherwise(F.coalesce("every", F.array().cast("array<string>")))
    return v.join(sets, "unit", "left").select("unit", "label", F.array_join(merged, ",").alias("labels"))


def never_selected(votes: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Labels of the taxonomy (one column, label) that no vote has."""
    return taxonomy.join(votes.select(F.explode("labels").alias("label")).distinct(), "label", "left_anti")
