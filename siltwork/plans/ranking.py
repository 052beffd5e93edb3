"""Scores, ranks, calibration and decisions over candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.functions import quant as Q
from siltwork.functions import scores as S
from siltwork.operators import calibration as K
from siltwork.operators.ranking import global_rank
from siltwork.operators.stages import active_weights, shortlist
from siltwork.plans.frames import CANDIDATES_SQL, DAY, NOW_SECONDS, SIMILARITY_SQL, VERDICTS_SQL, candidates, table, verdicts
from siltwork.plans.registry import query
from siltwork.plans.relational import best_theses

COMBINE_SQL = "greatest(0.0, least(1.0, (is_building * 0.25 + thesis_fit * 0.30 + founder_quality * 0.25 + timing * 0.15 + reachable * 0.05 - too_late * 0.30) / 1.0::DOUBLE))"
JUDGED_SQL = f"{SIMILARITY_SQL}, j AS (SELECT doc_id, quality AS good, s.similarity FROM labels JOIN s USING (doc_id))"
PENALTIES = S.curse_by_channel()

#: Penalties for the oracles, integrated on a grid of their own: the mean of the largest of n is 9 less the integral of F^n.
PENALTIES_SQL = """
ga AS (SELECT i, -9 + i * 0.005::DOUBLE AS x FROM range(3601) t(i)),
gp AS (SELECT i, x, exp(-x * x / 2) / sqrt(2 * pi()) AS p, exp(-(x - 0.0025) * (x - 0.0025) / 2) / sqrt(2 * pi()) AS m FROM ga),
gf AS (SELECT i, x, p, coalesce(sum(0.005 / 6 * (before + 4 * m + p)) OVER (ORDER BY i), 0) AS f FROM (SELECT *, lag(p) OVER (ORDER BY i) AS before FROM gp)),
au(channel, n, rho) AS (VALUES ('whatsapp', 3, 0.10), ('inbound', 8, 0.20), ('linkedin', 25, 0.35), ('reddit', 60, 0.45), ('substack', 80, 0.50), ('github', 120, 0.50), ('hackernews', 200, 0.60), ('other', 100, 0.40)),
pe AS (SELECT channel, 0.0625 / 0.085 * 0.15 * e AS penalty, 0.0625 / 0.085 * 0.15 * sqrt(1 - rho::DOUBLE) * e AS penalty_alike FROM (
    SELECT channel, rho, 9 - sum((CASE WHEN i IN (0, 3600) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * 0.005::DOUBLE / 3 * pow(f, n)) AS e FROM au, gf GROUP BY channel, rho))"""


def combined():
    return S.combine({k: F.col(k) for k in S.SIGNAL_WEIGHTS})


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("good")).join(best_theses(spark, sf_dir), "doc_id").select("doc_id", "good", "similarity")


@query(f"WITH {VERDICTS_SQL} SELECT doc_id, round({COMBINE_SQL}, 9) AS score FROM v")
def signal_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark, sf_dir).select("doc_id", F.round(combined(), 9).alias("score"))


@query(f"""
    WITH {VERDICTS_SQL}, p AS (SELECT doc_id, unnest([is_building * 0.25, thesis_fit * 0.30, founder_quality * 0.25, timing * 0.15, reachable * 0.05, too_late * -0.30]) AS c,
        unnest(['is_building','thesis_fit','founder_quality','timing','reachable','too_late']) AS signal FROM v)
    SELECT doc_id, signal, CASE WHEN round(c, 9) = 0 THEN 0.0 ELSE round(c, 9) END::DOUBLE AS contribution, row_number() OVER (PARTITION BY doc_id ORDER BY round(abs(c), 9) DESC, signal) AS place FROM p
""")
def signal_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each signal adds, the largest share first."""
    parts = S.explain({k: F.col(k) for k in S.SIGNAL_WEIGHTS})
    rows = verdicts(spark, sf_dir).select("doc_id", F.posexplode(parts).alias("at", "part"))
    return rows.select("doc_id", "part.signal", "part.contribution", (F.col("at") + 1).cast("long").alias("place"))


@query("""
    SELECT doc_id, (doc_id * 7 % 101) / 100.0::DOUBLE AS is_building, CASE WHEN doc_id % 5 = 0 THEN 0.0 ELSE 0.5 END::DOUBLE AS timing,
           (doc_id * 7 % 101) / 100.0::DOUBLE >= 0.5 AS is_startup, 'seed' AS stage FROM documents WHERE doc_id % 11 <> 0
    UNION ALL SELECT doc_id, 0.0, 0.0, false, NULL FROM documents WHERE doc_id % 11 = 0
""")
def verdict_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts out of JSON: missing scores are 0, broken JSON has none."""
    score = F.format_string("%.2f", F.col("doc_id") * 7 % 101 / 100)
    timing = F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.lit(', "timing": {"score": 0.5}'))
    text = F.when(F.col("doc_id") % 11 == 0, F.lit("no {json")).otherwise(F.concat(F.lit('{"is_building": {"score": '), score, F.lit(', "quote": "x"}'), timing, F.lit(', "stage": "seed"}')))
    kind = "is_building struct<score:double,quote:string>, timing struct<score:double,quote:string>, stage string"
    v = table(spark, sf_dir, "documents").select("doc_id", F.from_json(text, kind).alias("v"))
    building = F.coalesce("v.is_building.score", F.lit(0.0))
    return v.select("doc_id", building.alias("is_building"), F.coalesce("v.timing.score", F.lit(0.0)).alias("timing"), (building >= 0.5).alias("is_startup"), "v.stage")


RANKED_SQL = f"""
    r AS (SELECT c.doc_id, c.id, c.channel, s.thesis, round(0.3 * coalesce(s.similarity, 0) + 0.5 * v.thesis_fit + 0.2 * pow(0.5, ((1789171200 - c.posted_s) // 86400) / 90.0), 9) AS score
          FROM c JOIN v USING (doc_id) LEFT JOIN s USING (doc_id) WHERE v.is_building >= 0.5)"""


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.expr(f"({NOW_SECONDS} - posted_s) div {DAY}")
    rows = candidates(spark, sf_dir).join(verdicts(spark, sf_dir).where("is_building >= 0.5"), "doc_id").join(best_theses(spark, sf_dir), "doc_id", "left")
    return rows.select("doc_id", "id", "channel", "thesis", F.round(S.rank_score(F.col("similarity"), F.col("thesis_fit"), S.recency(age)), 9).alias("score"))


@query(f"WITH {CANDIDATES_SQL}, {VERDICTS_SQL}, {SIMILARITY_SQL}, {RANKED_SQL} SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM r")
def rank_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return global_rank(ranked(spark, sf_dir).select("doc_id", "score"), [F.desc("score"), F.col("doc_id")], "place")


@query(f"""
    WITH {CANDIDATES_SQL}, {VERDICTS_SQL}, {SIMILARITY_SQL}, {RANKED_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY thesis ORDER BY score DESC, doc_id) AS place FROM r WHERE thesis IS NOT NULL)
    SELECT thesis, place, doc_id, score FROM p WHERE place <= 20
""")
def fund_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best of each thesis."""
    from pyspark.sql import Window

    w = Window.partitionBy("thesis").orderBy(F.desc("score"), "doc_id")
    return ranked(spark, sf_dir).where("thesis IS NOT NULL").withColumn("place", F.row_number().over(w)).where("place <= 20").select("thesis", "place", "doc_id", "score")


@query(f"""
    WITH {CANDIDATES_SQL}, {VERDICTS_SQL}, p AS (SELECT v.doc_id, 1 / (1 + exp(-(ln(0.02 / 0.98) + ({COMBINE_SQL} - 0.5) * 7.2))) AS p FROM v),
    g AS (SELECT i, -7.5 + i * 0.075 AS x, CASE WHEN i IN (0, 200) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM range(201) t(i)),
    e AS (SELECT doc_id, p, sum(w * greatest(p * exp(-0.5 * (x - 0.75) * (x - 0.75)) * 30 - (1 - p) * exp(-0.5 * (x + 0.75) * (x + 0.75)), 0.0)) * 0.075 / 3 / sqrt(2 * pi()) AS total FROM p, g GROUP BY doc_id, p)
    SELECT doc_id, round(p, 9) AS posterior, round(greatest(0.0, total - greatest(p * 30 - (1 - p), 0.0)), 7) AS priority, round(CASE WHEN p < 1 / 31.0 THEN p * 30 ELSE 1 - p END, 9) AS perfect FROM e
""")
def evsi_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one review of each candidate is worth."""
    p = verdicts(spark, sf_dir).select("doc_id", S.posterior(combined()).alias("p"))
    return p.select("doc_id", F.round("p", 9).alias("posterior"), F.round(S.evsi(F.col("p")), 7).alias("priority"), F.round(S.evpi(F.col("p")), 9).alias("perfect"))


@query(f"""
    WITH {CANDIDATES_SQL}, {VERDICTS_SQL}, m AS (SELECT 'u' || (doc_id % 97) AS entity, doc_id, doc_id % 8 AS ch, unnest(['is_building','thesis_fit','founder_quality','timing','reachable','too_late']) AS signal,
        unnest([is_building, thesis_fit, founder_quality, timing, reachable, too_late]) AS score FROM v)
    SELECT entity, signal, max(score) AS score, min_by(doc_id, (-score, doc_id)) AS doc_id FROM m GROUP BY entity, signal
""")
def entity_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each author the best score of each signal and the candidate it comes from."""
    stacked = verdicts(spark, sf_dir).unpivot(["doc_id"], list(S.SIGNAL_WEIGHTS), "signal", "score")
    entity = F.concat(F.lit("u"), F.col("doc_id") % 97)
    return stacked.groupBy(entity.alias("entity"), "signal").agg(F.max("score").alias("score"), F.max_by("doc_id", F.struct("score", -F.col("doc_id"))).alias("doc_id"))


@query(f"""
    WITH {CANDIDATES_SQL}, {VERDICTS_SQL}, {PENALTIES_SQL}, m AS (SELECT author AS entity, max(is_building) AS is_building, max(thesis_fit) AS thesis_fit, max(founder_quality) AS founder_quality, max(timing) AS timing,
        max(reachable) AS reachable, max(too_late) AS too_late, count(DISTINCT channel) AS sources, count(*) AS evidence,
        min(penalty) AS penalty FROM c JOIN v USING (doc_id) JOIN pe USING (channel) GROUP BY author)
    SELECT entity, sources, evidence, round(greatest(0.0, {COMBINE_SQL} * CASE WHEN sources = 2 THEN 1.12 WHEN sources = 3 THEN 1.2 WHEN sources > 3 THEN 1.25 ELSE 1.0 END::DOUBLE - penalty), 9) AS score FROM m
""")
def entity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each author the combined best signals, raised for several sources, less the curse."""
    penalty = F.lit(PENALTIES[""])
    for channel, value in PENALTIES.items():
        penalty = F.when(F.col("channel") == channel, value).otherwise(penalty)
    rows = candidates(spark, sf_dir).join(verdicts(spark, sf_dir), "doc_id")
    best = rows.groupBy(F.col("author").alias("entity")).agg(*[F.max(k).alias(k) for k in S.SIGNAL_WEIGHTS], F.countDistinct("channel").alias("sources"), F.count(F.lit(1)).alias("evidence"), F.min(penalty).alias("penalty"))
    return best.select("entity", "sources", "evidence", F.round(F.greatest(F.lit(0.0), combined() * S.corroboration(F.col("sources")) - F.col("penalty")), 9).alias("score"))


SWEEP_SQL = f"""
    {JUDGED_SQL}, steps AS (SELECT i / 100.0::DOUBLE AS threshold FROM range(5, 96) r(i)), n AS (SELECT sum(good) AS positives FROM j),
    w AS (SELECT threshold, count(*) AS kept, CAST(sum(good) AS BIGINT) AS hits FROM steps JOIN j ON similarity >= threshold GROUP BY threshold),
    f AS (SELECT threshold, kept, hits / kept::DOUBLE AS precision, hits / positives::DOUBLE AS recall FROM w, n),
    b AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1, CASE WHEN precision + recall > 0 THEN 5 * precision * recall / (4 * precision + recall) ELSE 0.0 END AS score FROM f)"""


@query(f"WITH {SWEEP_SQL} SELECT threshold, kept, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, round(score, 9) AS score FROM b")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = K.sweep(judged(spark, sf_dir), "similarity", "good", 2.0)
    return t.select("threshold", "kept", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "score")])


@query(f"""
    WITH {SWEEP_SQL}, best AS (SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, threshold) AS place FROM b)
    SELECT threshold, round(precision, 9) AS precision, round(recall, 9) AS recall, round(score, 9) AS score, round(greatest(0.05, threshold * 0.7), 2) AS floor FROM best WHERE place = 1
""")
def threshold_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = K.fit_threshold(K.sweep(judged(spark, sf_dir), "similarity", "good", 2.0))
    return best.select("threshold", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "score")], "floor")


@query(f"""
    WITH {JUDGED_SQL}, p AS (SELECT good, row_number() OVER (ORDER BY similarity DESC, doc_id) AS place FROM j), h AS (SELECT place, row_number() OVER (ORDER BY place) AS hit FROM p WHERE good = 1)
    SELECT round(sum(hit / place::DOUBLE) / count(*), 9) AS average_precision FROM h
""")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.average_precision(judged(spark, sf_dir), F.col("similarity"), "good", "doc_id").select(F.round("average_precision", 9).alias("average_precision"))


@query(f"""
    WITH {JUDGED_SQL}, g AS (SELECT round(a * 0.05::DOUBLE, 2) AS ws, round(b * 0.05::DOUBLE, 2) AS wt, round((20 - a - b) * 0.05::DOUBLE, 2) AS wr FROM range(21) x(a), range(21) y(b) WHERE a + b <= 20),
    x AS (SELECT ws, wt, doc_id, good, round(ws * similarity + wt * ((doc_id * 11 % 101) / 100.0) + wr * pow(0.5, (doc_id * 37 % 720) / 90.0), 9) AS score FROM j, g),
    p AS (SELECT ws, wt, good, row_number() OVER (PARTITION BY ws, wt ORDER BY score DESC, doc_id) AS place FROM x),
    h AS (SELECT ws, wt, place, row_number() OVER (PARTITION BY ws, wt ORDER BY place) AS hit FROM p WHERE good = 1)
    SELECT ws, wt, round(sum(hit / place::DOUBLE) / count(*), 9) AS average_precision FROM h GROUP BY ws, wt
""")
def weight_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision for every triple of weights, in one pass."""
    grid = spark.createDataFrame(K.weight_grid(), "ws double, wt double, wr double")
    rows = judged(spark, sf_dir).crossJoin(F.broadcast(grid))
    score = F.round(F.col("ws") * F.col("similarity") + F.col("wt") * (F.col("doc_id") * 11 % 101 / 100) + F.col("wr") * F.pow(F.lit(0.5), F.col("doc_id") * 37 % 720 / 90), 9)
    found = K.average_precision(rows, score, "good", "doc_id", ["ws", "wt"])
    return found.select("ws", "wt", F.round("average_precision", 9).alias("average_precision"))


@query(f"""
    WITH {JUDGED_SQL}, g AS (SELECT round(a * 0.05::DOUBLE, 2) AS ws, round(b * 0.05::DOUBLE, 2) AS wt, round((20 - a - b) * 0.05::DOUBLE, 2) AS wr FROM range(21) x(a), range(21) y(b) WHERE a + b <= 20),
    x AS (SELECT ws, wt, wr, doc_id, good, round(ws * similarity + wt * ((doc_id * 11 % 101) / 100.0) + wr * pow(0.5, (doc_id * 37 % 720) / 90.0), 9) AS score FROM j, g),
    p AS (SELECT ws, wt, wr, good, row_number() OVER (PARTITION BY ws, wt ORDER BY score DESC, doc_id) AS place FROM x),
    h AS (SELECT ws, wt, wr, place, row_number() OVER (PARTITION BY ws, wt ORDER BY place) AS hit FROM p WHERE good = 1),
    m AS (SELECT ws, wt, wr, round(sum(hit / place::DOUBLE) / count(*), 9) AS average_precision FROM h GROUP BY ws, wt, wr)
    SELECT ws, wt, wr, average_precision FROM m WHERE (SELECT count(*) FROM j) >= 40 ORDER BY average_precision DESC, ws, wt LIMIT 1
""")
def weight_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights of the best average precision, if enough rows were judged."""
    return K.best_weights(weight_grid(spark, sf_dir), judged(spark, sf_dir).count())


@query(f"""
    WITH {JUDGED_SQL} SELECT round(avg(good), 9) AS positive_rate, round((min(j.similarity) - (SELECT min(similarity) FROM s)) / ((SELECT max(similarity) FROM s) - (SELECT min(similarity) FROM s)), 9) AS gap,
        concat_ws('; ', CASE WHEN avg(good) > 0.8 THEN 'labels come from the top of the ranking' END, CASE WHEN avg(good) < 0.05 THEN 'very few positives' END,
        CASE WHEN (min(j.similarity) - (SELECT min(similarity) FROM s)) / ((SELECT max(similarity) FROM s) - (SELECT min(similarity) FROM s)) > 0.25 THEN 'the low end was never labelled' END, 'the threshold keeps almost everything') AS caveats FROM j
""")
def fit_caveats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to mind about a fit whose threshold is 0.05."""
    found = K.fit_caveats(judged(spark, sf_dir), best_theses(spark, sf_dir), 0.05)
    return found.select(F.round("positive_rate", 9).alias("positive_rate"), F.round("gap", 9).alias("gap"), F.array_join("caveats", "; ").alias("caveats"))


@query(f"WITH {SIMILARITY_SQL} SELECT CAST(least(floor(greatest(0.0, least(1.0, similarity)) * 40), 39) AS INTEGER) AS bin, count(*) AS n FROM s GROUP BY 1")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.histogram(best_theses(spark, sf_dir), "similarity")


@query(f"""
    WITH RECURSIVE {SIMILARITY_SQL}, b AS (SELECT CAST(least(floor(greatest(0.0, least(1.0, similarity)) * 40), 39) AS INTEGER) AS bin, count(*) AS n FROM s GROUP BY 1),
    h AS (SELECT list({{'x': (bin + 0.5) / 40.0::DOUBLE, 'p': n / (SELECT sum(n) FROM b)::DOUBLE}}) AS h FROM b),
    v(k, w) AS (SELECT 0, list_transform(range(15), lambda i: 0.0::DOUBLE) UNION ALL SELECT k + 1, [0.0::DOUBLE] || list_transform(range(1, 15), lambda m: list_sum(list_transform(h, lambda q: q.p * greatest(q.x + w[m], w[m + 1])))) FROM v, h WHERE k < 176)
    SELECT CAST(k + 1 AS INTEGER) AS arrivals, 14 AS slots, round(greatest(0.0, w[15] - w[14]), 4) AS bar FROM v WHERE k + 1 IN (176, 147, 117, 88, 59, 29)
""")
def deployment_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acceptance bars for 176 arrivals and 14 slots over the scores' histogram."""
    counts = {r["bin"]: r["n"] for r in score_histogram(spark, sf_dir).collect()}
    total = sum(counts.values()) or 1
    bars = K.acceptance_bars({b: n / total for b, n in counts.items()}, 176, 14)
    left = F.greatest(F.lit(1), F.bround((6 - F.col("id")) * 176 / 6, 0).cast("int"))
    table = spark.createDataFrame([(k, row[14]) for k, row in enumerate(bars)], "arrivals int, worth double")
    return spark.range(6).select(left.alias("arrivals")).join(F.broadcast(table), "arrivals").select("arrivals", F.lit(14).alias("slots"), F.round("worth", 4).alias("bar"))


@query("""
    WITH r AS (SELECT avg(quality) AS rate, count(*) AS n, min(doc_id) AS low, max(doc_id) AS high FROM labels)
    SELECT n, round(rate, 9) AS rate, array_to_string(list_filter([CASE WHEN n < 40 THEN 'few labels' END, CASE WHEN rate > 0.8 THEN 'nearly all good' END, CASE WHEN rate < 0.05 THEN 'hardly any good' END,
        CASE WHEN low > (SELECT max(doc_id) FROM documents) * 0.25 THEN 'low end unlabelled' END, CASE WHEN high < (SELECT max(doc_id) FROM documents) * 0.75 THEN 'high end unlabelled' END], lambda x: x IS NOT NULL), '; ') AS caveats FROM r
""")
def calibration_caveats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to mind before the fitted values are believed."""
    r = table(spark, sf_dir, "labels").agg(F.avg("quality").alias("rate"), F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    top = table(spark, sf_dir, "documents").agg(F.max("doc_id").alias("top"))
    notes = F.array_compact(F.array(
        F.when(F.col("n") < 40, "few labels"),
        F.when(F.col("rate") > 0.8, "nearly all good"),
        F.when(F.col("rate") < 0.05, "hardly any good"),
        F.when(F.col("low") > F.col("top") * 0.25, "low end unlabelled"),
        F.when(F.col("high") < F.col("top") * 0.75, "high end unlabelled"),
    ))
    return r.crossJoin(top).select("n", F.round("rate", 9).alias("rate"), F.array_join(notes, "; ").alias("caveats"))


@query(f"WITH {PENALTIES_SQL} SELECT channel, round(penalty, 6) AS penalty, round(penalty_alike, 6) AS penalty_alike FROM pe")
def curse_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each channel's audience makes a score worth less."""
    plain, alike = S.curse_by_channel(), S.curse_by_channel(correlated=True)
    return spark.createDataFrame([(c or "other", round(plain[c], 6), round(alike[c], 6)) for c in plain], "channel string, penalty double, penalty_alike double")


@query("""
    WITH x AS (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice DESC) AS place, count(*) OVER () AS n FROM orders WHERE o_totalprice > 0),
    k AS (SELECT *, CAST(floor(sqrt(n)) AS INTEGER) AS k FROM x)
    SELECT n, k, round(1 / ((sum(CASE WHEN place <= k THEN ln(x) END) - k * ln(min(x))) / k), 6) AS alpha FROM k WHERE place <= k + 1 GROUP BY n, k
""")
def hill_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.hill_index(table(spark, sf_dir, "orders"), "o_totalprice").select("n", "k", F.round("alpha", 6).alias("alpha"))


@query("""
    WITH r AS (SELECT i AS place, least(1.0, 0.1 * pow(i, -0.35)) AS p FROM range(1, 201) t(i)), s AS (SELECT i AS n FROM range(1, 61) t(i)),
    q AS (SELECT n, p * pow(n::DOUBLE, -1.8) AS q FROM s JOIN r ON place <= n)
    SELECT n, round(1 - exp(sum(ln(1 - q))), 9) AS prob, round(sum(q), 9) AS expected FROM q GROUP BY n
""")
def portfolio_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.portfolio_curve(spark, 200).select("n", F.round("prob", 9).alias("prob"), F.round("expected", 9).alias("expected"))


@query("""
    WITH r AS (SELECT i AS place, least(1.0, 0.1 * pow(i, -0.35)) AS p FROM range(1, 201) t(i)), s AS (SELECT i AS n FROM range(1, 61) t(i)),
    q AS (SELECT n, p * pow(n::DOUBLE, -1.8) AS q FROM s JOIN r ON place <= n), t AS (SELECT n, 1 - exp(sum(ln(1 - q))) AS prob, sum(q) AS expected FROM q WHERE n >= 20 GROUP BY n)
    SELECT n, round(prob, 9) AS prob, round(expected, 9) AS expected, 20 AS n_floor, CASE WHEN n = 20 THEN 'capacity' ELSE 'objective' END AS binding FROM t ORDER BY t.prob DESC, n LIMIT 1
""")
def portfolio_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size with the best odds that keeps every cheque below a twentieth."""
    return K.choose_size(K.portfolio_curve(spark, 200)).select("n", F.round("prob", 9).alias("prob"), F.round("expected", 9).alias("expected"), "n_floor", "binding")


@query(f"""
    WITH {SIMILARITY_SQL}, p AS (SELECT doc_id, similarity, row_number() OVER (ORDER BY similarity DESC, doc_id) AS place FROM s)
    SELECT place, doc_id, similarity FROM p WHERE place <= 50
""")
def topk_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best rows; of equal ones the lowest index."""
    from pyspark.sql import Window

    best = best_theses(spark, sf_dir).orderBy(F.desc("similarity"), "doc_id").limit(50)
    return best.select(F.row_number().over(Window.orderBy(F.desc("similarity"), "doc_id")).alias("place"), "doc_id", "similarity")


@query("""
    SELECT event_id, CAST(floor(round(least(100.0, least(value * 10, 1000) * 0.055 + least(user_id, 200) * 0.16 + CASE WHEN user_id % 2 > 0 THEN 8 ELSE 0 END + CASE WHEN length(props) > 20 THEN 6 ELSE 0 END)::DOUBLE, 9) + 0.5) AS BIGINT) AS strength FROM events
""")
def launch_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", S.launch_strength(F.col("value") * 10, F.col("user_id"), F.col("user_id") % 2, F.col("props")).alias("strength"))


@query(f"""
    WITH {CANDIDATES_SQL}, {VERDICTS_SQL}, {SIMILARITY_SQL}, {RANKED_SQL}, k AS (SELECT r.doc_id, r.id, r.score, doc_id * 17 % 101 / 100.0::DOUBLE AS confidence FROM r WHERE thesis = 2)
    SELECT doc_id, score, confidence FROM k WHERE confidence >= 0.3 ORDER BY score DESC, id LIMIT 25
""")
def fund_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 best of one thesis that are sure enough."""
    rows = ranked(spark, sf_dir).withColumns({"is_startup": F.lit(1), "confidence": F.col("doc_id") * 17 % 101 / 100})
    return shortlist(rows, 2, 0.3, 25).select("doc_id", "score", "confidence")


#: Weights as a fit of labels would leave them.
FITTED = {"similarity": 0.45, "thesis_match": 0.35, "recency": 0.2}


@query(f"""
    WITH {CANDIDATES_SQL}, {VERDICTS_SQL}, {SIMILARITY_SQL}, w AS (SELECT CASE WHEN count(*) >= 40 THEN [0.45, 0.35, 0.2] ELSE [0.3, 0.5, 0.2] END AS w FROM labels)
    SELECT c.doc_id, round(w[1] * coalesce(s.similarity, 0) + w[2] * v.thesis_fit + w[3] * pow(0.5, ((1789171200 - c.posted_s) // 86400) / 90.0), 9) AS score FROM c JOIN v USING (doc_id) LEFT JOIN s USING (doc_id), w
""")
def rank_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by fitted weights where enough labels of this corpus's model stand behind them, else by the defaults."""
    weights = active_weights({"labels": table(spark, sf_dir, "labels").count(), "model": "m", "weights": FITTED}, "m")
    age = F.expr(f"({NOW_SECONDS} - posted_s) div {DAY}")
    rows = candidates(spark, sf_dir).join(verdicts(spark, sf_dir), "doc_id").join(best_theses(spark, sf_dir), "doc_id", "left")
    return rows.select("doc_id", F.round(S.rank_score(F.col("similarity"), F.col("thesis_fit"), S.recency(age), weights), 9).alias("score"))


@query(f"""
    WITH {CANDIDATES_SQL} SELECT doc_id, channel, round(greatest(0.0, doc_id * 7 % 101 / 100.0::DOUBLE - CASE channel {' '.join(f"WHEN '{c}' THEN {v!r}::DOUBLE" for c, v in Q.selection_by_channel().items() if c)} ELSE {Q.selection_by_channel()['']!r}::DOUBLE END), 9) AS score FROM c
""")
def adjusted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores less what the selection of each channel takes off."""
    score = F.col("doc_id") * 7 % 101 / 100
    return candidates(spark, sf_dir).select("doc_id", "channel", F.round(Q.adjusted(score, F.col("channel"), Q.selection_by_channel()), 9).alias("score"))
