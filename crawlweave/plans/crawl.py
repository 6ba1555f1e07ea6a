"""Bounded breadth-first crawl over page snapshots.

One turn of the loop handles one level of all crawls at once. A level leaves
its tables behind (reads, claims, records, the next frontier), so a lost
executor costs no more than the step it was working on, and plans do not grow.
Records keep a number ``seq`` that is dense per crawl, which makes first-come
order and URL budgets a matter of comparing numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlweave.functions import html, records
from crawlweave.operators import frontier as steps
from crawlweave.operators import gate
from crawlweave.operators.links import explode_links, in_scope, with_links
from crawlweave.operators.ordering import running_before
from crawlweave.plans.slots import claims_within_slots
from crawlweave.plans.store import CrawlStore
from crawlweave.schemas import INHERITED
from crawlweave.sources.documents import doc_key
from crawlweave.sources.pages import cap_body, fetch, latest_by_url
from crawlweave.sources.requests import normalize_requests, rejected_requests, seed_records
from crawlweave.workspace import Workspace

#: Stop signals, or a function that reads them anew.
Control = DataFrame | Callable[[], DataFrame]

_FACT_COLUMNS = ["text_length", "status_code", "robots_txt"]


@dataclass
class Snapshot:
    """Pages after one pass over their HTML."""

    texts: DataFrame  # page_id, url, title, content, text_length, status_code, robots_txt
    facts: DataFrame  # url (unique), page_id, text_length, status_code, robots_txt
    links: DataFrame  # page_id, src_url, pos, dst_url


@dataclass
class CrawlResult:
    visited: DataFrame  # crawl_id, url, distance, seq
    records: DataFrame  # one row per record taken from the frontier
    docs: DataFrame
    errors: DataFrame  # crawl_id, url, message
    status: DataFrame


def take_snapshot(pages: DataFrame, ws: Workspace) -> Snapshot:
    """Read every page's HTML once and keep what the crawl needs.

    ``status_code`` and ``robots_txt`` are optional; a page without a status
    was fetched without error.
    """
    ws = ws.child("snapshot")
    if "status_code" not in pages.columns:
        pages = pages.withColumn("status_code", F.lit(200))
    if "robots_txt" not in pages.columns:
        pages = pages.withColumn("robots_txt", F.lit(None).cast("string"))
    pages = cap_body(pages.select("page_id", "url", "html", "status_code", "robots_txt"))
    read = ws.save(
        with_links(pages).select(
            "page_id",
            "url",
            html.title(F.col("html")).alias("title"),
            html.body_text(F.col("html")).alias("content"),
            "status_code",
            "robots_txt",
            "links",
        ),
        "pages",
    )
    texts = read.drop("links").withColumn("text_length", F.length("content"))
    facts = ws.save(latest_by_url(texts, _FACT_COLUMNS), "facts")
    return Snapshot(texts, facts, explode_links(read))


def crawl(
    requests: DataFrame,
    snapshot: Snapshot,
    ws: Workspace,
    now: Column,
    control: Control | None = None,
    budget: str = "discovered",
    scope: str = "prefix",
    normalize: bool = True,
    store: CrawlStore | None = None,
) -> CrawlResult:
    """Run all ``requests`` to the end of their budgets.

    Addresses are normalised first, unless told otherwise. Stop signals
    (``crawl_id, stopped_at, reason``) are looked up again at every level; pass
    a function to have them read anew each time.

    ``budget="discovered"`` counts a URL against ``max_urls`` when it is first
    seen, so known but unfetched URLs use up the budget; ``"fetched"`` counts
    pages read. ``"literal"`` counts as ``"discovered"`` does, but a record may only
    take as many links from the top of its page as URLs are left, known ones included.
    ``now`` is the clock for deadlines and stop signals.

    With a ``store``, what it holds of these crawls is reset before they begin and
    replaced when they end; other crawls' files are not touched.
    """
    if budget not in ("discovered", "fetched", "literal"):
        raise ValueError(f"unknown budget {budget!r}")
    ws = ws.child("crawl")
    if normalize:
        requests = normalize_requests(requests)
    if store is not None:
        store.begin(requests, now)
    columns = ["crawl_id", "seq", "url", "distance", *INHERITED]
    seeds = seed_records(requests).select(columns)
    buckets = ws.buckets_for(snapshot.facts.count())
    current = ws.save(seeds, "levels/level=0")
    frontier = _add_to_frontier(current, ws, buckets, "overwrite")
    level = 0
    # The first level runs even when no request is valid, and leaves empty tables.
    while level == 0 or not current.isEmpty():
        signals = _signals(control, now, ws, level)
        children = _run_level(
            level, current, frontier, signals, columns, snapshot, ws, now, budget, scope
        )
        level += 1
        # A level is read from its own table; all records are for checking claims only.
        current = ws.save(children, f"levels/level={level}")
        frontier = _add_to_frontier(current, ws, buckets, "append")
    result = _collect_result(
        requests, snapshot, frontier, ws, scope, now, _signals(control, now, ws, level)
    )
    if store is not None:
        store.publish(requests, result.visited, result.status)
    return result


def _signals(control: Control | None, now: Column, ws: Workspace, level: int) -> DataFrame | None:
    """The first signal of each crawl stopped by now, as a table of its own."""
    if control is None:
        return None
    rows = control() if callable(control) else control
    first = F.min_by(F.struct("stopped_at", "reason"), "stopped_at")
    up = rows.where(F.col("crawl_id").isNotNull() & (F.col("stopped_at") <= now))
    return ws.save(
        up.groupBy("crawl_id").agg(first.alias("_c")).select("crawl_id", "_c.*"),
        f"signals-{level}",
    )


def _add_to_frontier(records: DataFrame, ws: Workspace, buckets: int, mode: str) -> DataFrame:
    """All records so far. Bucketed the way claims are grouped, so that checking
    claims against it moves none of it, however large it has grown."""
    return ws.save_bucketed(
        records, "frontier", ["crawl_id", "url"], buckets=buckets, mode=mode
    )


def _run_level(
    level: int,
    current: DataFrame,
    frontier: DataFrame,
    signals: DataFrame | None,
    columns: list[str],
    snapshot: Snapshot,
    ws: Workspace,
    now: Column,
    budget: str,
    scope: str,
) -> DataFrame:
    """The records that the level's records, ``current``, add to the ``frontier``."""
    fetched = fetch(current, snapshot.facts)
    if signals is None:
        fetched = fetched.withColumn("stopped", F.lit(False))
    else:
        up = signals.select("crawl_id", F.lit(True).alias("_up"))
        fetched = fetched.join(up, "crawl_id", "left").withColumn(
            "stopped", F.coalesce("_up", F.lit(False))
        )
    found = gate.with_access(fetched)
    static_stop = records.stop_reason(
        F.col("distance"),
        F.col("max_distance"),
        F.lit(0),
        F.lit(0),
        now,
        F.col("max_time"),
        F.col("stopped"),
    )
    # Written before it is used: facts are joined once, and a level's true size
    # decides whether it is broadcast to the links or both are shuffled.
    able = ws.save(
        found.select(
            *columns,
            "stopped",
            "page_id",
            "text_length",
            "accessible",
            "message",
            (static_stop.isNull() & F.col("accessible")).alias("able"),
        ),
        f"reads/level={level}",
    )

    parents = able.where("able").select(
        "crawl_id", F.col("seq").alias("parent_seq"), "base_url", "page_id"
    )
    targets = snapshot.links.select("page_id", "pos", F.col("dst_url").alias("url"))
    candidates = parents.join(targets, "page_id").where(
        in_scope(F.col("url"), F.col("base_url"), scope)
    )
    state = current.groupBy("crawl_id").agg(
        (F.max("seq") + 1).alias("known"), F.max("max_urls").alias("max_urls")
    )
    if budget == "literal":
        name = f"slots/level={level}"
        claims = claims_within_slots(
            candidates.select("crawl_id", "parent_seq", "pos", "url"), frontier, state, ws, name
        )
    else:
        claims = ws.save(
            steps.not_visited(steps.claim_first(candidates), frontier), f"claims/level={level}"
        )

    per_parent = claims.groupBy("crawl_id", F.col("parent_seq").alias("seq")).agg(
        F.count("*").alias("new_urls")
    )
    log = (
        able.join(per_parent, ["crawl_id", "seq"], "left")
        .join(state.select("crawl_id", "known"), "crawl_id")
        .withColumn("new_urls", F.coalesce("new_urls", F.lit(0)).cast("bigint"))
    )
    if budget == "fetched":
        log = _with_fetched_so_far(log, level, ws)
        got = F.col("able").cast("bigint")
        log = running_before(log, ["crawl_id"], "seq", got, "_got")
        counted = F.col("fetched_so_far") + F.col("_got")
    else:
        # The seed counts only once it is processed.
        start = F.lit(0) if level == 0 else F.col("known")
        log = steps.running_visited(log, F.col("new_urls"))
        counted = start + F.col("before")
    reason = records.stop_reason(
        F.col("distance"),
        F.col("max_distance"),
        F.col("counted"),
        F.col("max_urls"),
        now,
        F.col("max_time"),
        F.col("stopped"),
    )
    done = ws.save(
        log.withColumn("counted", counted)
        .withColumn("stop_reason", reason)
        .select(
            *columns,
            "known",
            "page_id",
            "text_length",
            "accessible",
            "message",
            "stop_reason",
            (F.col("able") & F.col("stop_reason").isNull()).alias("fetched"),
        ),
        f"records/level={level}",
    )

    parent = done.where("fetched").select(
        "crawl_id", F.col("seq").alias("parent_seq"), "known", "distance", *INHERITED
    )
    numbered = steps.number_claims(claims).join(parent, ["crawl_id", "parent_seq"])
    seq = F.col("known") + F.col("nth")
    children = numbered.withColumn("seq", seq).withColumn("distance", F.col("distance") + 1)
    if budget == "discovered":
        children = children.where((F.col("max_urls") <= 0) | (F.col("seq") < F.col("max_urls")))
    return children.select(columns)


def _with_fetched_so_far(log: DataFrame, level: int, ws: Workspace) -> DataFrame:
    if level == 0:
        return log.withColumn("fetched_so_far", F.lit(0))
    done = ws.load("records").where("fetched")
    counts = done.groupBy("crawl_id").agg(F.count("*").alias("fetched_so_far"))
    return log.join(counts, "crawl_id", "left").withColumn(
        "fetched_so_far", F.coalesce("fetched_so_far", F.lit(0))
    )


def _collect_result(
    requests: DataFrame,
    snapshot: Snapshot,
    frontier: DataFrame,
    ws: Workspace,
    scope: str,
    now: Column,
    signals: DataFrame | None,
) -> CrawlResult:
    log = ws.load("records")
    seen_seed = log.where("fetched").select("crawl_id", "seq")
    seeds = frontier.where("seq = 0").join(seen_seed, ["crawl_id", "seq"], "left_semi")
    visited = (
        frontier.where("seq > 0").unionByName(seeds).select("crawl_id", "url", "distance", "seq")
    )

    fetched = log.where("fetched")
    worth, minimal = gate.split_by_content(fetched, snapshot.links, scope)
    # Both are asked for more than once; the links are read for them once.
    minimal = ws.save(minimal, "minimal")
    worth = ws.save(worth, "worth")
    docs = (
        worth.select("crawl_id", "url", "base_url", "distance", "page_id")
        .join(snapshot.texts.select("page_id", "title", "content"), "page_id")
        .select(
            doc_key().alias("doc_id"),
            "crawl_id",
            "url",
            "base_url",
            "title",
            "content",
            F.col("distance").alias("level"),
            F.lit("html").alias("content_type"),
        )
    )
    minimal_message = F.concat(F.lit(records.MSG_MINIMAL), F.col("url"))
    unreachable = log.where(F.col("stop_reason").isNull() & ~F.col("accessible"))
    rejected = rejected_requests(requests)
    errors = (
        rejected
        .unionByName(gate.error_rows(unreachable, F.col("message")))
        .unionByName(gate.error_rows(minimal, minimal_message))
    )

    events = log.join(
        minimal.select("crawl_id", "seq", minimal_message.alias("thin_message")),
        ["crawl_id", "seq"],
        "left",
    ).withColumn(
        "error_message",
        F.when(
            F.col("stop_reason").isNull(),
            F.coalesce("thin_message", F.when(~F.col("accessible"), F.col("message"))),
        ),
    )
    last = F.max_by(
        F.struct(
            "distance",
            F.when(F.col("error_message").isNotNull(), "userInitiated")
            .otherwise(F.col("stop_reason"))
            .alias("stop_reason"),
            "error_message",
        ),
        "seq",
    )
    counts = visited.groupBy("crawl_id").agg(F.count("*").alias("num_pages"))
    status = (
        events.groupBy("crawl_id")
        .agg(last.alias("_l"), F.min("start_time").alias("start_time"))
        .join(counts, "crawl_id", "left")
        .select(
            "crawl_id",
            "_l.distance",
            "start_time",
            F.coalesce("num_pages", F.lit(0)).cast("bigint").alias("num_pages"),
            "_l.stop_reason",
            "_l.error_message",
        )
    )
    return CrawlResult(
        visited, log, docs, errors, _whole_status(status, requests, rejected, now, signals)
    )


def _whole_status(
    status: DataFrame,
    requests: DataFrame,
    rejected: DataFrame,
    now: Column,
    signals: DataFrame | None,
) -> DataFrame:
    """Every crawl's row: rejected requests keep the zero row they began with."""
    began = requests.groupBy("crawl_id").agg(F.min("requested_at").alias("start_time"))
    refused = (
        rejected.where(F.col("crawl_id").isNotNull())
        .groupBy("crawl_id")
        .agg(F.max("message").alias("error_message"))
        .join(status.select("crawl_id"), "crawl_id", "left_anti")
        .join(began, "crawl_id")
        .select(
            "crawl_id",
            F.lit(0).alias("distance"),
            "start_time",
            F.lit(0).cast("bigint").alias("num_pages"),
            F.lit("userInitiated").alias("stop_reason"),
            "error_message",
        )
    )
    whole = status.unionByName(refused).withColumn("last_modified", now)
    if signals is None:
        return whole
    told = F.coalesce("stop_reason", F.lit("userInitiated")) == "userInitiated"
    hit = F.col("stopped_at").isNotNull() & told & F.col("error_message").isNull()
    return whole.join(signals, "crawl_id", "left").select(
        "crawl_id",
        "distance",
        "start_time",
        "num_pages",
        F.when(hit, "userInitiated").otherwise(F.col("stop_reason")).alias("stop_reason"),
        F.when(hit, F.coalesce("reason", F.lit(records.MSG_STOPPED)))
        .otherwise(F.col("error_message"))
        .alias("error_message"),
        "last_modified",
    )


def expand(
    edges: DataFrame, seeds: DataFrame, ws: Workspace, max_distance: int = -1
) -> DataFrame:
    """Distance of every node reachable from ``seeds`` over ``edges(src, dst)``.

    ``(node, distance)``, each node once at its least distance. Ends when a
    level finds nothing new, so cycles are no matter.
    """
    ws = ws.child("expand")
    level = ws.save(seeds.select("node").distinct(), "level-0")
    distance, buckets = 0, ws.buckets_for(edges.count())
    reached = _reach(level, distance, ws, buckets, "overwrite")
    while not level.isEmpty() and distance != max_distance:
        distance += 1
        found = (
            level.join(edges, level["node"] == edges["src"])
            .select(F.col("dst").alias("node"))
            .distinct()
            .join(reached, "node", "left_anti")
        )
        level = ws.save(found, f"level-{distance}")
        reached = _reach(level, distance, ws, buckets, "append")
    return reached


def _reach(
    level: DataFrame, distance: int, ws: Workspace, buckets: int, mode: str
) -> DataFrame:
    nodes = level.withColumn("distance", F.lit(distance).cast("bigint"))
    return ws.save_bucketed(nodes, "reached", ["node"], buckets=buckets, mode=mode)
