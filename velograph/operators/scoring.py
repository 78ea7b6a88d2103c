"""Suitability of routes for skating and running, with explained losses.

Input: stretches (request_id, island, kind, surface_class, surface_inferred, smoothness, hazards, length_m).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.exprs import half_up, lookup, sum_in_order
from . import polylines

ACTIVITIES = ("skate", "run")
UNSKATEABLE, LEAST_WALK_M, SECTION, PER_100M, MOST, CAP_ANY, LONG_M, CAP_LONG = 0.15, 5.0, 10.0, 5.0, 60.0, 84.0, 100.0, 69.0
LEAST_POINTS, NOTES, LEAST_SHARE = 1.5, 4, 0.25
C = F.col


def base_factor(activity: str) -> Column:
    by_surface = lookup(C("surface_class"), V.SURFACE_SCORES[activity])
    return F.coalesce(lookup(C("smoothness"), V.SMOOTHNESS_SCORES), by_surface) if activity == "skate" else by_surface


def suitability(activity: str) -> Column:
    risk = F.aggregate("hazards", F.lit(1.0), lambda a, h: a * F.coalesce(lookup(h, V.HAZARD_SCORES[activity]), F.lit(1.0)))
    return base_factor(activity) * lookup(C("kind"), V.KIND_SCORES[activity]) * risk


def rating(score: Column) -> Column:
    return F.when(score >= 85, "great").when(score >= 70, "good").when(score >= 50, "fair").otherwise("poor")


def metres_text(m: Column) -> Column:
    """Kilometres with one digit from 1 km on, else tens of metres. The digit is that of the double, half up."""
    x = m / 1000
    # at half a tenth it is the double that decides, which may lie just below what it stands for: 20 x as an exact sum
    p, q = x * 16, x * 4
    total = p + q
    part = total - p
    below = (m % 100 == 50) & ((total - m / 50) + ((p - (total - part)) + (q - part)) < 0)
    tenths = F.floor(m / 100 + F.lit(0.5)) - F.when(below, 1).otherwise(0)
    km = F.concat((F.floor(tenths / 10)).cast("long").cast("string"), F.lit("."), (tenths % 10).cast("long").cast("string"), F.lit(" km"))
    return F.when(m >= 1000, km).otherwise(F.concat((F.floor(m / 10 + F.lit(0.5)) * 10).cast("long").cast("string"), F.lit(" m")))


def walking(stretches: DataFrame) -> DataFrame:
    """(request_id, sections, walk_m, steps, penalty, cap): what can't be skated."""
    walk = (suitability("skate") < UNSKATEABLE) & ((C("length_m") >= LEAST_WALK_M) | (C("kind") == "steps"))
    runs = polylines.islands(stretches.withColumn("walk", walk).withColumnRenamed("island", "place"), "request_id", "place", ["walk"])
    per = runs.groupBy("request_id").agg(F.countDistinct(F.when(C("walk"), C("island"))).alias("sections"), sum_in_order("place", F.when(C("walk"), C("length_m")).otherwise(0.0)).alias("walk_m"), F.coalesce(F.bool_or(C("walk") & (C("kind") == "steps")), F.lit(False)).alias("steps"))
    penalty = F.least(F.lit(MOST), C("sections") * SECTION + C("walk_m") / 100 * PER_100M)
    return per.withColumn("penalty", penalty).withColumn("cap", F.when(C("sections") == 0, 100.0).when(C("walk_m") >= LONG_M, CAP_LONG).otherwise(CAP_ANY))


def confidence(stretches: DataFrame) -> DataFrame:
    known = sum_in_order("island", F.when(~C("surface_inferred") & (C("surface_class") != "unknown"), C("length_m")).otherwise(0.0)) / sum_in_order("island", C("length_m"))
    share = stretches.groupBy("request_id").agg(known.alias("share"))
    return share.withColumn("confidence", F.when(C("share") >= 0.8, "high").when(C("share") >= 0.55, "medium").otherwise("low"))


def losses(stretches: DataFrame, activity: str) -> DataFrame:
    """(request_id, cause, phrase, metres, loss): each stretch's shortfall shared among its factors below 1.

    Shares go by -ln(factor); if factors are zero, these share alike and the others get nothing.
    """
    phrases = V.SURFACE_PHRASES | (V.RUN_SURFACE_PHRASES if activity == "run" else {})
    smooth = C("smoothness").isNotNull() if activity == "skate" else F.lit(False)
    spaced = lambda x: F.regexp_replace(x, "^([^_]*)_", "$1 ")  # noqa: E731  the first underscore only

    def factor(cause: Column, phrase: Column, value: Column) -> Column:
        return F.struct(cause.alias("cause"), phrase.alias("phrase"), value.alias("value"))

    surface = factor(
        F.when(smooth, F.concat(F.lit("smoothness:"), "smoothness")).otherwise(F.concat(F.lit("surface:"), "surface_class")),
        F.when(smooth, F.concat(F.lit("tagged "), spaced(C("smoothness")), F.lit(" smoothness"))).otherwise(F.concat(F.lit("of "), lookup(C("surface_class"), phrases))),
        base_factor(activity),
    )
    kind = factor(F.concat(F.lit("kind:"), "kind"), F.coalesce(lookup(C("kind"), V.KIND_PHRASES), F.concat(F.lit("on "), spaced(C("kind")))), lookup(C("kind"), V.KIND_SCORES[activity]))
    risks = F.transform("hazards", lambda h: factor(F.concat(F.lit("hazard:"), h), F.coalesce(lookup(h, V.HAZARD_PHRASES), F.concat(F.lit("with "), spaced(h))), F.coalesce(lookup(h, V.HAZARD_SCORES[activity]), F.lit(1.0))))
    low = F.filter(F.concat(F.array(surface, kind), risks), lambda f: f["value"] < 1)
    d = stretches.withColumn("shortfall", (1 - suitability(activity)) * C("length_m")).withColumn("low", low).where("shortfall > 0 AND size(low) > 0")
    d = d.withColumn("zero", F.exists("low", lambda f: f["value"] <= 0))
    each = d.select("request_id", "island", "length_m", "shortfall", "zero", "low", F.explode("low").alias("f"))
    weight = lambda v: F.when(C("zero"), F.when(v <= 0, 1.0).otherwise(0.0)).otherwise(-F.ln(F.when(v > 0, v).otherwise(1.0)))
    total = F.aggregate("low", F.lit(0.0), lambda a, f: a + weight(f["value"]))
    shared = each.withColumns({"w": weight(C("f.value")), "total": total}).where("w > 0 OR (NOT zero)")
    return shared.groupBy("request_id", C("f.cause").alias("cause"), C("f.phrase").alias("phrase")).agg(sum_in_order("island", C("length_m")).alias("metres"), sum_in_order("island", C("shortfall") * C("w") / C("total")).alias("loss"))


def scores(stretches: DataFrame) -> DataFrame:
    """(request_id, activity, score, rating, confidence, cap_loss)"""
    out = None
    for activity in ACTIVITIES:
        mean = stretches.groupBy("request_id").agg((sum_in_order("island", suitability(activity) * C("length_m")) / sum_in_order("island", C("length_m")) * 100).alias("mean"))
        if activity == "skate":
            w = mean.join(walking(stretches), "request_id").withColumn("raw", C("mean") - C("penalty"))
            one = w.select("request_id", F.least("raw", "cap").alias("value"), F.greatest(F.lit(0.0), C("raw") - C("cap")).alias("cap_loss"))
        else:
            one = mean.select("request_id", C("mean").alias("value"), F.lit(0.0).alias("cap_loss"))
        one = one.withColumn("activity", F.lit(activity))
        out = one if out is None else out.unionByName(one)
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(half_up(C("value"), 9) + F.lit(0.5)))).cast("long")
    done = out.withColumn("score", score).join(confidence(stretches).drop("share"), "request_id")
    return done.select("request_id", "activity", "score", rating(C("score")).alias("rating"), "confidence", "cap_loss")


def walk_text(sections: Column, walk_m: Column, steps: Column) -> Column:
    short = F.concat(sections.cast("string"), F.lit(" short "), F.when(sections == 1, "stretch").otherwise("stretches"), F.lit(" you'd need to walk"))
    long = F.concat(metres_text(walk_m), F.lit(" you'd need to walk"), F.when(sections > 1, F.concat(F.lit(" across "), sections.cast("string"), F.lit(" stretches"))).otherwise(F.lit("")))
    return F.concat(F.when(walk_m >= 20, long).otherwise(short), F.when(steps, " (including steps)").otherwise(""))


def notes(stretches: DataFrame, activity: str) -> DataFrame:
    """(request_id, place, tone, text, metres, points): up to four losses, the cap, and what is good, in this order."""
    total = stretches.groupBy("request_id").agg(sum_in_order("island", C("length_m")).alias("total"))
    lost = losses(stretches, activity).join(total, "request_id").select("request_id", "cause", F.concat(metres_text(C("metres")), F.lit(" "), "phrase").alias("text"), "metres", (C("loss") / C("total") * 100).alias("points")).where(half_up(C("points"), 9) >= LEAST_POINTS)
    extra = None
    if activity == "skate":
        walk = walking(stretches)
        lost = lost.unionByName(walk.where("penalty > 0").select("request_id", F.lit("walk").alias("cause"), walk_text(C("sections"), C("walk_m"), C("steps")).alias("text"), C("walk_m").alias("metres"), C("penalty").alias("points")))
        capped = scores(stretches).where("activity = 'skate' AND cap_loss > 0").join(walk, "request_id")
        text = F.concat(F.lit("Having to walk caps the rating at "), F.when(C("cap") == CAP_LONG, "fair").otherwise("good"))
        extra = capped.select("request_id", F.lit(NOTES + 1).alias("place"), F.lit("negative").alias("tone"), text.alias("text"), C("walk_m").alias("metres"), half_up(C("cap_loss"), 1).alias("points"))
        good = F.when(C("smoothness").isNotNull(), C("smoothness").isin("excellent", "good")).otherwise(C("surface_class") == "smooth")
        praise = "% smooth asphalt or concrete"
    else:
        good, praise = C("kind").isin(*V.OFF_ROAD), "% off-road paths and trails"
    rank = F.row_number().over(W.partitionBy("request_id").orderBy(half_up(C("points"), 9).desc(), "cause"))
    worst = lost.withColumn("rank", rank).where(C("rank") <= NOTES).select("request_id", C("rank").alias("place"), F.lit("negative").alias("tone"), "text", "metres", half_up(C("points"), 1).alias("points"))
    fine = stretches.groupBy("request_id").agg(sum_in_order("island", F.when(good, C("length_m")).otherwise(0.0)).alias("metres"), sum_in_order("island", C("length_m")).alias("total")).where(C("metres") / C("total") >= LEAST_SHARE)
    share = F.floor(C("metres") / C("total") * 100 + F.lit(0.5)).cast("long").cast("string")
    positive = fine.select("request_id", F.lit(NOTES + 2).alias("place"), F.lit("positive").alias("tone"), F.concat(share, F.lit(praise)).alias("text"), "metres", F.lit(None).cast("double").alias("points"))
    out = worst.unionByName(positive)
    return out.unionByName(extra) if extra is not None else out
