"""Fetch attempts and as-of values against plain loops."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from crawlweave.operators.ordering import latest_as_of
from crawlweave.sources.attempts import TRIES, UNSEEN, fetch_attempts

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
ASKS = "ask_id long, url string, asked_at timestamp"
SEEN = "url string, seen_at timestamp, page_id long, error string"


def at(seconds):
    return START + timedelta(milliseconds=round(seconds * 1000))


def brute(asks, seen):
    out = {}
    for ask, url, when in asks:
        for k in range(TRIES):
            time = None if when is None else when + timedelta(seconds=2**k - 1)
            states = [s for s in seen if s[0] == url and time and s[1] and s[1] <= time]
            last = max(states, key=lambda s: (s[1], s[3] is not None, s[3] or "", s[2]), default=None)
            error = UNSEEN if last is None or url is None else last[3]
            if error is None:
                out[ask] = (k + 1, time, last[2], None)
                break
        else:
            out[ask] = (TRIES, None, None, error)
    return out


def test_attempts_like_a_loop(spark):
    rnd = random.Random(5)
    urls = ["hot"] * 6 + ["a", "b", "c"]
    seen = [
        (rnd.choice(urls), at(rnd.randrange(0, 9000) / 2), i, rnd.choice([None, "down", "slow"]))
        for i in range(1500)
    ]
    # Two states at one time, an unknown time and an unknown address.
    seen += [("a", at(10), 9000, None), ("a", at(10), 9001, "down"), ("a", None, 1, None), (None, at(0), 2, None)]
    asks = [(i, rnd.choice([*urls, "never"]), at(rnd.randrange(-10, 9500) / 2)) for i in range(600)]
    asks += [(900, None, at(5)), (901, "a", None), (902, "a", at(9)), (903, "a", at(10))]
    found = fetch_attempts(spark.createDataFrame(asks, ASKS), spark.createDataFrame(seen, SEEN))
    got = {
        r.ask_id: (r.attempts, r.fetched_at and r.fetched_at.astimezone(timezone.utc), r.page_id, r.error)
        for r in found.collect()
    }
    want = brute(asks, seen)
    assert got == want
    assert {w[0] for w in want.values()} == {1, 2, 3}


def test_no_asks_and_nothing_observed(spark):
    none = spark.createDataFrame([], SEEN)
    ask = spark.createDataFrame([(1, "u", START)], ASKS)
    assert fetch_attempts(ask.where("false"), none).count() == 0
    assert fetch_attempts(ask, none).first().error == UNSEEN


def test_as_of_in_any_blocks(spark):
    rnd = random.Random(2)
    facts = [(rnd.choice("xy"), at(rnd.randrange(1000)), rnd.randrange(50)) for _ in range(200)]
    asks = [(rnd.choice("xyz"), at(rnd.randrange(-5, 1100)), i) for i in range(200)]
    want = {}
    for g, t, i in asks:
        known = [(f[1], f[2]) for f in facts if f[0] == g and f[1] <= t]
        want[i] = max(known)[1] if known else None
    left = spark.createDataFrame(asks, "g string, t timestamp, i long")
    right = spark.createDataFrame(facts, "g string, t timestamp, v long")
    for micros in (1_000_000, 7_000_000, 10**12):
        got = latest_as_of(left, right, "g", "t", F.col("v"), "now", block_micros=micros)
        assert {r.i: r.now for r in got.collect()} == want
