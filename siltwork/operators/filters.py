"""The rejection chain: the first rule that holds gives the reason."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltwork.functions import text as T

RULES = {"promo": T.PROMO, "job_ad": T.JOB_AD, "question": T.QUESTION, "builder": T.BUILDER}
MIN_CHARS, MAX_AGE_DAYS = 40, 540


def reject(text: Column, posted_s: Column, now_s: int, rules: Mapping[str, str] = RULES) -> Column:
    """Name of the first rule that rejects a candidate, or null.

    Too short after trimming, promotion, advert for a job, a question of somebody who builds
    nothing, too old in whole days. An unknown date is not old; a null text is too short.
    """
    days = F.floor((F.lit(now_s) - posted_s) / 86400)
    return (
        F.when(F.coalesce(F.length(T.strip(text)), F.lit(0)) < MIN_CHARS, "too_short")
        .when(text.rlike(rules["promo"]), "promo")
        .when(text.rlike(rules["job_ad"]), "job_ad")
        .when(T.strip(text).rlike(rules["question"]) & ~text.rlike(rules["builder"]), "question")
        .when(F.coalesce(days > MAX_AGE_DAYS, F.lit(False)), "too_old")
    )


def rejection(text: Column, posted_s: Column, now_s: int, rules: Mapping[str, str] = RULES) -> Column:
    """struct(filter, reason) of the first rule that rejects a candidate, with what it found; or null."""
    days = F.floor((F.lit(now_s) - posted_s) / 86400)
    length = F.coalesce(F.length(T.strip(text)), F.lit(0))

    def found(name: Column) -> Column:
        return F.when(name.isNotNull(), F.struct(name.alias("filter"), reason(name).alias("reason")))

    def reason(name: Column) -> Column:
        return (
            F.when(name == "too_short", F.concat(length, F.lit(f" chars, under {MIN_CHARS}")))
            .when(name == "promo", F.concat(F.lit("promotional: "), F.regexp_extract(text, rules["promo"], 0)))
            .when(name == "job_ad", F.concat(F.lit("reads as a vacancy: "), F.regexp_extract(text, rules["job_ad"], 0)))
            .when(name == "question", "opens as a question with no sign of building")
            .when(name == "too_old", F.concat(days, F.lit(f" days old, over {MAX_AGE_DAYS}")))
        )

    # Through a list of one, so that the rules run once and not once per mention of their name.
    return F.get(F.transform(F.array(reject(text, posted_s, now_s, rules)), found), F.lit(0))
