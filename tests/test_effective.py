from __future__ import annotations

from datetime import timedelta

from tidewright.plans import all_queries


def test_all_events_are_thinned(spark, sf_dir):
    events = sorted(spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_id", "user_id").collect())
    chosen = []
    for ts, event_id, user in events:
        book, own = user % 10, {f"a{user % 4}", f"b{user % 3}"}
        if not any(b == book and own & c and ts < end + timedelta(minutes=5) for b, _, end, c in chosen):
            chosen.append((book, event_id, ts + timedelta(hours=4), own))
    got = all_queries()["effective_samples"](spark, sf_dir).collect()
    assert sorted((r["book"], r["id"]) for r in got) == sorted((b, i) for b, i, _, _ in chosen)
