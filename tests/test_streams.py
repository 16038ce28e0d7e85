"""Streams over several batches and a restart against their batch results."""

import datetime as dt
import random

from pyspark.sql import functions as F

from spanforge.sources.ingest import ingest_call_events
from spanforge.streaming import jobs

DAY = dt.datetime(2024, 3, 1)


def parts(spark, tmp_path, rows, schema, n=3):
    """Rows dealt to ``n`` files in order, and what writes file i."""
    size = -(-len(rows) // n)

    def put(i):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def stream():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    return put, stream


def in_steps(put, start):
    """Two files, then a third after a restart from the checkpoint."""
    put(0), put(1)
    start().awaitTermination()
    put(2)
    start().awaitTermination()


def test_ingest_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"cll_{rng.randrange(40)}", '{"phone":"+1555000%04d"}' % i if i % 5 else "{}", f"z{i}" if i % 3 else None, DAY + dt.timedelta(minutes=i)) for i in range(120)]
    put, stream = parts(spark, tmp_path, rows, "interaction_id string, raw_snapshot_json string, zap_id string, ingested_at_utc timestamp")
    in_steps(put, lambda: jobs.idempotent_ingest(stream(), f"{tmp_path}/accepted", f"{tmp_path}/audit", f"{tmp_path}/c"))
    whole = ingest_call_events(spark.read.parquet(f"{tmp_path}/in"), spark.createDataFrame([], "interaction_id string"))
    cols = whole.columns
    audit = spark.read.parquet(f"{tmp_path}/audit")
    assert audit.select("batch").distinct().count() == 3
    assert sorted(map(str, audit.select(*cols).collect())) == sorted(map(str, whole.collect()))
    accepted = spark.read.parquet(f"{tmp_path}/accepted")
    assert accepted.count() == accepted.select("interaction_id").distinct().count() == whole.where("gate_status = 'pass'").count() > 0


def test_contact_stats_equal_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"u{rng.randrange(5)}" if i % 17 else None, f"i{rng.randrange(25)}", DAY + dt.timedelta(minutes=i), rng.randrange(100) if i % 7 else None) for i in range(150)]
    put, stream = parts(spark, tmp_path, rows, "contact_id string, interaction_id string, event_at_utc timestamp, chars long")
    in_steps(put, lambda: jobs.running_contact_stats(stream(), f"{tmp_path}/out", f"{tmp_path}/c"))
    seen, want = set(), {}
    for contact, interaction, at, chars in rows:
        if contact is None:
            continue
        n, total, last, again = want.get(contact, (0, 0, None, 0))
        if (contact, interaction) in seen:
            want[contact] = (n, total, last, again + 1)
        else:
            seen.add((contact, interaction))
            want[contact] = (n + 1, total + (chars or 0), at, again)
    got = {r.contact_id: (r.interaction_count, r.total_chars, r.last_interaction_at, r.suppressed) for r in jobs.contact_totals(spark, f"{tmp_path}/out").collect()}
    assert got == want
    # A batch reads no output: each folder has its own contacts' additions alone.
    assert spark.read.parquet(f"{tmp_path}/out").groupBy("batch", "contact_id").count().where("count > 1").isEmpty()


def plain_chains(rows):
    days: dict = {}
    for contact, project, at, seconds, shadow in rows:
        if not shadow:
            days.setdefault((contact, at.date()), []).append((at, project, seconds))
    out = {}
    for key, calls in days.items():
        named = [p for _, p, _ in calls if p is not None]
        top = min(sorted(set(named)), key=lambda p: -named.count(p), default=None)
        times = sorted(at for at, _, _ in calls)
        gap = int((times[-1] - times[0]).total_seconds()) / (len(times) - 1) if len(times) > 1 else None
        out[key] = (len(calls), times[0], times[-1], round(sum(s for *_, s in calls), 2), len(set(named)), top, gap)
    return out


def test_chains_equal_batch_once_their_day_is_over(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"u{rng.randrange(4)}", rng.choice(["p1", "p2", "p3", None]), DAY + dt.timedelta(minutes=rng.randrange(5 * 1440)), float(rng.randrange(60)), rng.random() < 0.1) for i in range(240)]
    rows.sort(key=lambda r: r[2])
    put, stream = parts(spark, tmp_path, rows, "contact_id string, project_id string, event_at_utc timestamp, duration_seconds double, is_shadow boolean")
    in_steps(put, lambda: jobs.call_chains(stream(), f"{tmp_path}/out", f"{tmp_path}/c", late="0 seconds"))
    got = {(r.contact_id, r.day): (r.n_calls, r.first_at, r.last_at, r.duration, r.n_projects, r.dominant_project_id, r.mean_gap_s) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = plain_chains(rows)
    last = max(d for _, d in want)
    assert {k: v for k, v in want.items() if k[1] < last} == got


def test_first_payloads(spark, tmp_path):
    rows = [(f"cll_{i % 10}", DAY + dt.timedelta(minutes=i)) for i in range(60)]
    put, stream = parts(spark, tmp_path, rows, "interaction_id string, ingested_at_utc timestamp")
    in_steps(put, lambda: jobs.append_to(jobs.first_payloads(stream()), f"{tmp_path}/out", f"{tmp_path}/c").start())
    assert spark.read.parquet(f"{tmp_path}/out").agg(F.count("*"), F.countDistinct("interaction_id")).first() == (10, 10)
