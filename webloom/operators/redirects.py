"""Redirect chains over stored answers, each hop judged like a request of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.session import written

#: Statuses that redirect where a location is given, and the most redirects that are followed. Fixed values.
REDIRECTS, MOST = (301, 302, 303, 307, 308), 10


def judged(answers: DataFrame, starts: DataFrame, strict: bool = True) -> DataFrame:
    """Every url that a chain can pass (url), with its status and the url it leads to (``next``, absolute and without a fragment; null where none), and whether it may be
    asked at all (``safe``). Of several answers of a url the least counts, by status, then by location."""
    told = answers.where("url IS NOT NULL").groupBy("url").agg(F.min(F.struct("status", "location")).alias("a")).select("url", "a.status", "a.location")
    leads = F.col("status").isin(*REDIRECTS) & (F.coalesce(F.trim("location"), F.lit("")) != "")
    told = told.select("url", "status", F.when(leads, U.strip_fragment(U.canonical(F.col("url"), F.col("location")))).alias("next"))
    names = told.select("url").union(told.where("next IS NOT NULL").select("next")).union(starts.where("url IS NOT NULL").select("url")).distinct()
    safe = F.coalesce(U.safe_url(F.col("url"), F.lit(strict)), F.lit(False))
    return names.join(told, "url", "left").select("url", "status", "next", safe.alias("safe"))


def follow(starts: DataFrame, answers: DataFrame, most: int = MOST, strict: bool = True) -> DataFrame:
    """Where each start (url) ends in the stored answers (url, status, location), by at most ``most`` redirects.

    A hop is made from a url that is safe to one that its answer names; so a chain that turns to a refused address ends there, however it came to it. Pointers are doubled:
    a table of one hop joined with itself gives two, then four and eight, so that a chain of ten takes two joins of the starts instead of ten.
    Returns a row a start: url, final, hops, status (null if no answer is stored), outcome: ok, refused, or too_many where ``most`` redirects lead to another (cycles
    do). A null start: null final, refused. Repeated starts: a row each. Extra columns are ignored."""
    nodes = written(judged(answers, starts, strict))
    goes = F.col("safe") & F.col("next").isNotNull()
    jump = nodes.select("url", F.when(goes, F.col("next")).otherwise(F.col("url")).alias("end"), goes.cast("int").alias("made"))
    at = starts.select("url", F.col("url").alias("final"), F.lit(0).alias("hops"))
    left, size = most, 1
    while left:
        if left & 1:
            step = jump.select(F.col("url").alias("final"), "end", "made")
            at = at.join(step, "final", "left").select("url", F.coalesce("end", "final").alias("final"), (F.col("hops") + F.coalesce("made", F.lit(0))).alias("hops"))
        left >>= 1
        if left:
            # Only what goes on for as many hops as there were can go further.
            on = jump.select(F.col("url").alias("end"), F.col("end").alias("far"), F.col("made").alias("more"))
            longer = jump.where(F.col("made") == size).join(on, "end").select("url", F.col("far").alias("end"), (F.col("made") + F.col("more")).alias("made"))
            jump, size = written(longer.unionByName(jump.where(F.col("made") < size))), 2 * size
    last = nodes.select(F.col("url").alias("final"), "status", "next", "safe")
    outcome = F.when(~F.coalesce("safe", F.lit(False)), "refused").when(F.col("next").isNotNull(), "too_many").otherwise("ok")
    return at.join(last, "final", "left").select("url", "final", "hops", "status", outcome.alias("outcome"))
