"""Claims of a level under the rule that limits links before it looks what is known.

A record may take as many links, in page order, as its crawl has URLs left when
the record comes up; known URLs among them use up a place each. So what a record
takes depends on what earlier records of the level claimed, and the other way
round. The rule is causal: places of a record follow from the claims before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlweave.functions.records import NO_LIMIT
from crawlweave.operators import frontier as steps
from crawlweave.operators.ordering import running_before
from crawlweave.workspace import Workspace

_RECORD = ["crawl_id", "parent_seq"]


def claims_within_slots(
    candidates: DataFrame, visited: DataFrame, limits: DataFrame, ws: Workspace, name: str
) -> DataFrame:
    """``crawl_id, url, parent_seq, pos`` of the URLs that the level's records claim.

    ``candidates(crawl_id, parent_seq, pos, url)`` are links in scope of records
    that can be read, ``limits(crawl_id, known, max_urls)`` one row per crawl.

    All records start with the places that are left when the level begins. Every
    round claims with the places so far and counts anew. Up to the first record
    of a crawl for which fewer places would change its claims, all is final; that
    record gets its right number, and those after it no more than that. A round
    that is not a crawl's last finds a new URL before that record, so a crawl
    takes at most as many rounds as it has places, and two or three as a rule;
    crawls that are done leave the loop.
    """
    links = candidates.groupBy(*_RECORD, "url").agg(F.min("pos").alias("pos"))
    links = ws.save(links, f"{name}/links")
    ranked = running_before(links, _RECORD, "pos", F.lit(1), "nth")
    links = ws.save(steps.not_visited(ranked, visited), f"{name}/open")
    reach = links.groupBy(*_RECORD).agg((F.max("nth") + 1).alias("reach"))
    left = F.when(F.col("max_urls") > 0, F.greatest(F.col("max_urls") - F.col("known"), F.lit(0)))
    asked = ws.save(
        reach.join(limits, "crawl_id").select(
            *_RECORD, "reach", left.cast("bigint").alias("left"),
            F.coalesce(left, F.lit(NO_LIMIT)).cast("bigint").alias("slots"),
        ),
        f"{name}/slots-0",
    )
    turn = 0
    while True:
        able = links.join(asked.select(*_RECORD, "slots"), _RECORD).where("nth < slots")
        claims = ws.save(steps.claim_first(able), f"{name}/claims-{turn}")
        per_record = claims.groupBy(*_RECORD).agg(F.count("*").alias("new"))
        log = asked.join(per_record, _RECORD, "left").fillna(0, ["new"])
        log = running_before(log, ["crawl_id"], "parent_seq", F.col("new"), "before")
        exact = F.when(F.col("left").isNull(), F.col("slots")).otherwise(
            F.greatest(F.col("left") - F.col("before"), F.lit(0))
        )
        judged = ws.save(log.withColumn("exact", exact).drop("new", "before"), f"{name}/judged-{turn}")
        moved = F.least("exact", "reach") != F.least("slots", "reach")
        first = ws.save(
            judged.where(moved)
            .groupBy("crawl_id")
            .agg(F.min(F.struct("parent_seq", "exact")).alias("f"))
            .select("crawl_id", F.col("f.parent_seq").alias("at"), F.col("f.exact").alias("most")),
            f"{name}/first-{turn}",
        )
        settled = claims.join(first.select("crawl_id"), "crawl_id", "left_anti")
        done = ws.save(settled, f"{name}/settled", mode="overwrite" if turn == 0 else "append")
        if first.isEmpty():
            return done
        turn += 1
        slots = F.when(F.col("parent_seq") <= F.col("at"), F.col("exact")).otherwise(F.col("most"))
        asked = ws.save(
            judged.join(first, "crawl_id").select(*_RECORD, "reach", "left", slots.alias("slots")),
            f"{name}/slots-{turn}",
        )
