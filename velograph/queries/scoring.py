"""Activity scores of routes and their explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.exprs import half_up
from ..operators import planning, scoring
from ..runtime import materialise
from . import base
from .base import case, query, strings
from .routes import STRETCHES, travelled

C = F.col


def _stretches(spark, sf_dir):
    return planning.stretches(travelled(spark, sf_dir))


#: Fixed values of the checking statement, written out here and not taken from the code that it checks.
HAND_MODELS = """
model AS (SELECT 'skate' AS activity, * FROM (VALUES ('surface', 'smooth', 1.0::DOUBLE), ('surface', 'paved', 0.85), ('surface', 'rough_paved', 0.35), ('surface', 'compacted', 0.1), ('surface', 'gravel', 0.0), ('surface', 'unpaved', 0.0), ('surface', 'unknown', 0.5),
    ('smoothness', 'excellent', 1.0), ('smoothness', 'good', 0.9), ('smoothness', 'intermediate', 0.55), ('smoothness', 'bad', 0.2), ('smoothness', 'very_bad', 0.05), ('smoothness', 'horrible', 0.0), ('smoothness', 'very_horrible', 0.0), ('smoothness', 'impassable', 0.0),
    ('kind', 'shared_use_path', 1.0), ('kind', 'separated_path', 1.0), ('kind', 'protected_lane', 0.95), ('kind', 'buffered_lane', 0.85), ('kind', 'painted_lane', 0.7), ('kind', 'shared_parking_lane', 0.6), ('kind', 'shared_street', 0.65), ('kind', 'informal', 0.55),
    ('kind', 'footpath', 0.8), ('kind', 'trail', 0.9), ('kind', 'track', 0.8), ('kind', 'steps', 0.0), ('kind', 'quiet_street', 0.75), ('kind', 'road', 0.5), ('kind', 'busy_road', 0.25), ('kind', 'unknown', 0.6), ('kind', 'connector', 0.7),
    ('hazard', 'tram_line', 0.4), ('hazard', 'traffic_merging', 0.7), ('hazard', 'parking', 0.85)) t(what, name, factor)
  UNION ALL SELECT 'run', * FROM (VALUES ('surface', 'smooth', 0.9::DOUBLE), ('surface', 'paved', 0.9), ('surface', 'rough_paved', 0.85), ('surface', 'compacted', 1.0), ('surface', 'gravel', 0.8), ('surface', 'unpaved', 0.85), ('surface', 'unknown', 0.85),
    ('kind', 'shared_use_path', 1.0), ('kind', 'separated_path', 1.0), ('kind', 'footpath', 0.9), ('kind', 'trail', 1.0), ('kind', 'track', 0.95), ('kind', 'steps', 0.7), ('kind', 'quiet_street', 0.8), ('kind', 'shared_street', 0.7), ('kind', 'protected_lane', 0.7),
    ('kind', 'buffered_lane', 0.65), ('kind', 'painted_lane', 0.6), ('kind', 'shared_parking_lane', 0.6), ('kind', 'informal', 0.55), ('kind', 'road', 0.6), ('kind', 'busy_road', 0.45), ('kind', 'unknown', 0.7), ('kind', 'connector', 0.8),
    ('hazard', 'tram_line', 0.95), ('hazard', 'traffic_merging', 0.85), ('hazard', 'parking', 1.0)) t(what, name, factor))
"""


@query(
    f"WITH {STRETCHES}, {HAND_MODELS}, met AS (SELECT 'surface' AS what, surface_class AS name, length_m FROM stretch UNION ALL SELECT 'smoothness', smoothness, length_m FROM stretch UNION ALL SELECT 'kind', kind, length_m FROM stretch UNION ALL SELECT 'hazard', unnest(hazards), length_m FROM stretch) "
    f"SELECT activity, m.what, m.name, factor, count(length_m) AS stretches, {base.half_up('coalesce(sum(length_m), 0)', 3)} AS metres FROM model m LEFT JOIN met ON met.what = m.what AND met.name = m.name GROUP BY ALL"
)
def score_models(spark, sf_dir):
    """The factors of both activities, with the stretches and metres of all routes that each applies to."""
    rows = [(a, w, k, float(v)) for a in scoring.ACTIVITIES for w, t in (("surface", V.SURFACE_SCORES[a]), ("kind", V.KIND_SCORES[a]), ("hazard", V.HAZARD_SCORES[a])) for k, v in t.items()]
    model = spark.createDataFrame(rows + [("skate", "smoothness", k, v) for k, v in V.SMOOTHNESS_SCORES.items()], "activity string, what string, name string, factor double")
    one = lambda what, name: F.struct(F.lit(what).alias("what"), name.alias("name"))
    each = F.concat(F.array(one("surface", C("surface_class")), one("smoothness", C("smoothness")), one("kind", C("kind"))), F.transform("hazards", lambda h: one("hazard", h)))
    met = _stretches(spark, sf_dir).select("length_m", F.explode(each).alias("e")).groupBy("e.what", "e.name").agg(F.count("*").alias("stretches"), F.sum("length_m").alias("metres"))
    return model.join(met, ["what", "name"], "left").select("activity", "what", "name", "factor", F.coalesce("stretches", F.lit(0)).alias("stretches"), half_up(F.coalesce("metres", F.lit(0.0)), 3).alias("metres"))


def _base(a: str) -> str:
    surface = case("surface_class", V.SURFACE_SCORES[a])
    return f"coalesce({case('smoothness', V.SMOOTHNESS_SCORES)}, {surface})" if a == "skate" else surface


def _suit(a: str) -> str:
    risk = f"list_reduce(list_prepend(1::DOUBLE, list_transform(hazards, lambda h: {case('h', V.HAZARD_SCORES[a], '1::DOUBLE')})), lambda a, b: a * b)"
    return f"({_base(a)} * {case('kind', V.KIND_SCORES[a])} * {risk})"


@query(f"WITH {STRETCHES} SELECT request_id, island, {base.half_up(_suit('skate'), 6)} AS skate, {base.half_up(_suit('run'), 6)} AS run FROM stretch")
def suitability(spark, sf_dir):
    return _stretches(spark, sf_dir).select("request_id", "island", *(half_up(scoring.suitability(a), 6).alias(a) for a in scoring.ACTIVITIES))


MEAN = "mean AS (SELECT request_id, sum(length_m) AS total, " + ", ".join(f"sum({_suit(a)} * length_m) / sum(length_m) * 100 AS {a}" for a in scoring.ACTIVITIES) + " FROM stretch GROUP BY request_id)"


@query(f"WITH {STRETCHES}, {MEAN} SELECT request_id, {base.half_up('skate', 6)} AS skate, {base.half_up('run', 6)} AS run FROM mean")
def weighted_suitability(spark, sf_dir):
    means = [half_up(F.sum(scoring.suitability(a) * C("length_m")) / F.sum("length_m") * 100, 6).alias(a) for a in scoring.ACTIVITIES]
    return _stretches(spark, sf_dir).groupBy("request_id").agg(*means)


WALK = (
    f"ws AS (SELECT *, {_suit('skate')} < 0.15::DOUBLE AND (length_m >= 5 OR kind = 'steps') AS walk FROM stretch), "
    "wn AS (SELECT *, walk AND NOT coalesce(lag(walk) OVER (PARTITION BY request_id ORDER BY island), false) AS starts FROM ws), "
    "walked AS (SELECT request_id, count(*) FILTER (starts) AS sections, coalesce(sum(length_m) FILTER (walk), 0) AS walk_m, coalesce(bool_or(walk AND kind = 'steps'), false) AS steps FROM wn GROUP BY request_id), "
    "wk AS (SELECT *, least(60::DOUBLE, sections * 10 + walk_m / 100 * 5) AS penalty, CASE WHEN sections = 0 THEN 100::DOUBLE WHEN walk_m >= 100 THEN 69::DOUBLE ELSE 84::DOUBLE END AS cap FROM walked)"
)


@query(f"WITH {STRETCHES}, {WALK} SELECT request_id, sections, {base.half_up('walk_m', 3)} AS walk_m, steps FROM wk")
def walk_sections(spark, sf_dir):
    return scoring.walking(_stretches(spark, sf_dir)).select("request_id", "sections", half_up(C("walk_m"), 3).alias("walk_m"), "steps")


@query(f"WITH {STRETCHES}, {WALK} SELECT request_id, {base.half_up('penalty', 6)} AS penalty, cap FROM wk")
def walk_penalty(spark, sf_dir):
    return scoring.walking(_stretches(spark, sf_dir)).select("request_id", half_up(C("penalty"), 6).alias("penalty"), "cap")


CONFIDENCE = "conf AS (SELECT request_id, sum(CASE WHEN NOT surface_inferred AND surface_class <> 'unknown' THEN length_m ELSE 0 END) / sum(length_m) AS share FROM stretch GROUP BY request_id)"
LEVEL = "CASE WHEN share >= 0.8 THEN 'high' WHEN share >= 0.55 THEN 'medium' ELSE 'low' END"


@query(f"WITH {STRETCHES}, {CONFIDENCE} SELECT request_id, {base.half_up('share', 6)} AS share, {LEVEL} AS confidence FROM conf")
def confidence(spark, sf_dir):
    return scoring.confidence(_stretches(spark, sf_dir)).withColumn("share", half_up(C("share"), 6))


RATING = "CASE WHEN score >= 85 THEN 'great' WHEN score >= 70 THEN 'good' WHEN score >= 50 THEN 'fair' ELSE 'poor' END"


SCORES = (
    f"{MEAN}, {WALK}, {CONFIDENCE}, val AS (SELECT m.request_id, 'skate' AS activity, least(skate - penalty, cap) AS v, greatest(0::DOUBLE, skate - penalty - cap) AS cap_loss FROM mean m JOIN wk USING (request_id) UNION ALL SELECT request_id, 'run', run, 0::DOUBLE FROM mean), "
    f"sc AS (SELECT request_id, activity, CAST(greatest(0, least(100, floor({base.half_up('v', 9)} + 0.5::DOUBLE))) AS BIGINT) AS score, cap_loss FROM val)"
)


@query(f"WITH {STRETCHES}, {SCORES} SELECT request_id, activity, score, {RATING} AS rating, {LEVEL} AS confidence, {base.half_up('cap_loss', 4)} AS cap_loss FROM sc JOIN conf USING (request_id)")
def route_scores(spark, sf_dir):
    return scoring.scores(_stretches(spark, sf_dir)).withColumn("cap_loss", half_up(C("cap_loss"), 4))


@query(f"WITH {STRETCHES}, {SCORES} SELECT activity, score, {RATING} AS rating, count(*) AS routes FROM sc GROUP BY ALL")
def rating(spark, sf_dir):
    """How many routes have each score, and its rating."""
    return scoring.scores(_stretches(spark, sf_dir)).groupBy("activity", "score", "rating").agg(F.count("*").alias("routes"))


def _loss_sql(a: str) -> str:
    phrases = V.SURFACE_PHRASES | (V.RUN_SURFACE_PHRASES if a == "run" else {})
    first = f"row('surface:' || surface_class, 'of ' || {case('surface_class', phrases)}, {case('surface_class', V.SURFACE_SCORES[a])})"
    if a == "skate":
        first = f"CASE WHEN smoothness IS NOT NULL THEN row('smoothness:' || smoothness, 'tagged ' || regexp_replace(smoothness, '_', ' ') || ' smoothness', {case('smoothness', V.SMOOTHNESS_SCORES)}) ELSE {first} END"
    kind = f"row('kind:' || kind, coalesce({case('kind', V.KIND_PHRASES)}, 'on ' || regexp_replace(kind, '_', ' ')), {case('kind', V.KIND_SCORES[a])})"
    risk = f"list_transform(hazards, lambda h: row('hazard:' || h, coalesce({case('h', V.HAZARD_PHRASES)}, 'with ' || regexp_replace(h, '_', ' ')), {case('h', V.HAZARD_SCORES[a], '1::DOUBLE')}))"
    return (
        f"fac AS (SELECT request_id, island, length_m, (1 - {_suit(a)}) * length_m AS shortfall, unnest(list_concat([{first}, {kind}], {risk})) AS f FROM stretch), "
        "low AS (SELECT request_id, island, length_m, shortfall, f[1] AS cause, f[2] AS phrase, f[3] AS v, min(f[3]) OVER (PARTITION BY request_id, island) <= 0 AS zero FROM fac WHERE f[3] < 1 AND shortfall > 0), "
        "wt AS (SELECT *, CASE WHEN zero THEN CASE WHEN v <= 0 THEN 1::DOUBLE ELSE 0::DOUBLE END ELSE -ln(v) END AS w FROM low WHERE NOT zero OR v <= 0), "
        "part AS (SELECT *, shortfall * w / sum(w) OVER (PARTITION BY request_id, island) AS loss FROM wt), "
        "lost AS (SELECT request_id, cause, any_value(phrase) AS phrase, sum(length_m) AS metres, sum(loss) AS loss FROM part GROUP BY request_id, cause)"
    )


@query(" UNION ALL ".join(f"(WITH {STRETCHES}, {_loss_sql(a)} SELECT request_id, '{a}' AS activity, cause, phrase, {base.half_up('metres', 3)} AS metres, {base.half_up('loss', 4)} AS loss FROM lost)" for a in scoring.ACTIVITIES))
def attribute_loss(spark, sf_dir):
    s = materialise(_stretches(spark, sf_dir))
    out = [scoring.losses(s, a).select("request_id", F.lit(a).alias("activity"), "cause", "phrase", half_up(C("metres"), 3).alias("metres"), half_up(C("loss"), 4).alias("loss")) for a in scoring.ACTIVITIES]
    return out[0].unionByName(out[1])


def _metres(m: str) -> str:
    km = f"CASE WHEN {m} % 500 = 250 THEN CAST(CAST(floor({m} / 100) AS BIGINT) // 10 AS VARCHAR) || '.' || CAST((CAST(floor({m} / 100) AS BIGINT) + 1) % 10 AS VARCHAR) ELSE printf('%.1f', {m} / 1000) END"
    return f"CASE WHEN {m} >= 1000 THEN {km} || ' km' ELSE CAST(CAST(floor({m} / 10 + 0.5::DOUBLE) * 10 AS BIGINT) AS VARCHAR) || ' m' END"


@query(f"SELECT event_id, {_metres('m')} AS text, CASE WHEN m >= 20 THEN {_metres('m')} || ' you''d need to walk' || CASE WHEN s > 1 THEN ' across ' || s || ' stretches' ELSE '' END ELSE s || ' short ' || CASE WHEN s = 1 THEN 'stretch' ELSE 'stretches' END || ' you''d need to walk' END || CASE WHEN s = 2 THEN ' (including steps)' ELSE '' END AS walk FROM (SELECT event_id, ((event_id * 50) % 9350)::DOUBLE AS m, event_id % 4 + 1 AS s FROM events)")
def note_text(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", ((C("event_id") * 50) % 9350).cast("double").alias("m"), (C("event_id") % 4 + 1).alias("s"))
    return e.select("event_id", scoring.metres_text(C("m")).alias("text"), scoring.walk_text(C("s"), C("m"), C("s") == 2).alias("walk"))


def _notes_sql(a: str) -> str:
    points = base.half_up("points", 9)
    neg = f"SELECT request_id, cause, {_metres('metres')} || ' ' || phrase AS text, metres, loss / total * 100 AS points FROM lost JOIN mean USING (request_id) WHERE {base.half_up('loss / total * 100', 9)} >= 1.5"
    if a == "skate":
        walk = f"CASE WHEN walk_m >= 20 THEN {_metres('walk_m')} || ' you''d need to walk' || CASE WHEN sections > 1 THEN ' across ' || sections || ' stretches' ELSE '' END ELSE sections || ' short ' || CASE WHEN sections = 1 THEN 'stretch' ELSE 'stretches' END || ' you''d need to walk' END || CASE WHEN steps THEN ' (including steps)' ELSE '' END"
        neg += f" UNION ALL SELECT request_id, 'walk', {walk}, walk_m, penalty FROM wk WHERE penalty > 0"
        good, praise = "CASE WHEN smoothness IS NOT NULL THEN smoothness IN ('excellent', 'good') ELSE surface_class = 'smooth' END", "% smooth asphalt or concrete"
        extra = f" UNION ALL SELECT request_id, 'negative', 'Having to walk caps the rating at ' || CASE WHEN cap = 69 THEN 'fair' ELSE 'good' END, walk_m, {base.half_up('cap_loss', 1)} FROM sc JOIN wk USING (request_id) WHERE activity = 'skate' AND cap_loss > 0"
    else:
        good, praise, extra = f"kind IN ({strings(V.OFF_ROAD)})", "% off-road paths and trails", ""
    return (
        f"(WITH {STRETCHES}, {SCORES}, {_loss_sql(a)}, neg AS ({neg}), rk AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY {points} DESC, cause) AS rank FROM neg), "
        f"pos AS (SELECT request_id, sum(CASE WHEN {good} THEN length_m ELSE 0 END) AS metres, sum(length_m) AS total FROM stretch GROUP BY request_id), "
        f"n AS (SELECT request_id, 'negative' AS tone, text, metres, {base.half_up('points', 1)} AS points FROM rk WHERE rank <= 4 UNION ALL SELECT request_id, 'positive', CAST(CAST(floor(metres / total * 100 + 0.5::DOUBLE) AS BIGINT) AS VARCHAR) || '{praise}', metres, NULL FROM pos WHERE metres / total >= 0.25{extra}) "
        f"SELECT request_id, '{a}' AS activity, tone, text, {base.half_up('metres', 3)} AS metres, points FROM n)"
    )


@query(" UNION ALL ".join(map(_notes_sql, scoring.ACTIVITIES)))
def score_notes(spark, sf_dir):
    s = materialise(_stretches(spark, sf_dir))
    out = [scoring.notes(s, a).select("request_id", F.lit(a).alias("activity"), "tone", "text", half_up(C("metres"), 3).alias("metres"), "points") for a in scoring.ACTIVITIES]
    return out[0].unionByName(out[1])
