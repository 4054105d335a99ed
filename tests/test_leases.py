"""The life of a lease with a clock of our own, and the event log as a stream."""

import datetime as dt

from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.streaming import leases

T0 = dt.datetime(2024, 1, 1, 12)
JOB = (
    "job_id string, status string, priority int, attempt int, max_attempts int, available_at timestamp, requested_at timestamp, lease_agent_id string, lease_token string, "
    "lease_expires_at timestamp, last_failure_agent_id string, last_error_code string, cancellation_requested_at timestamp"
)


def job(name, status="queued", priority=0, attempt=1, left=None, **more):
    held = status == "running"
    row = (name, status, priority, attempt, 3, T0, T0, "agent" if held else None, "token" if held else None, left and T0 + dt.timedelta(seconds=left), None, None, more.get("cancelled"))
    return row


def now():
    return F.lit("2024-01-01 12:00:00").cast("timestamp")


def of(df):
    return {r.job_id: r for r in df.collect()}


def test_expired_leases_return_or_fail(spark):
    jobs = spark.createDataFrame([job("a", "running", left=-1), job("b", "running", attempt=3, left=-1), job("c", "running", left=60), job("d")], JOB)
    got = of(leases.recover_expired(jobs, now(), 5000))
    assert {k: r.status for k, r in got.items()} == {"a": "queued", "b": "failed", "c": "running", "d": "queued"}
    assert got["a"].available_at == T0 + dt.timedelta(seconds=5) and got["a"].lease_token is None and got["a"].last_error_code == "LEASE_EXPIRED"
    assert got["c"].lease_token == "token" and got["d"].last_error_code is None


def test_the_most_urgent_job_is_next(spark):
    jobs = spark.createDataFrame([job("a"), job("b", priority=5), job("c", priority=9, cancelled=T0), job("d", "running", 10, left=60), job("e", priority=5)], JOB)
    assert leases.next_job(jobs, now()).first().job_id == "b"
    assert leases.next_job(jobs.where("job_id = 'c'"), now()).isEmpty()


def test_only_the_holder_extends_a_lease(spark):
    jobs = spark.createDataFrame([job("a", "running", left=60), job("b", "running", left=60), job("c", "running", left=-1)], JOB)
    beats = spark.createDataFrame([("a", "agent", 1, "token"), ("b", "agent", 1, "stolen"), ("c", "agent", 1, "token")], "job_id string, agent_id string, attempt int, lease_token string")
    got = of(leases.heartbeat(jobs, beats, now(), 120_000))
    assert [got[k].lease_expires_at for k in "abc"] == [T0 + dt.timedelta(seconds=x) for x in (120, 60, -1)]


def test_reports_end_live_leases_only(spark):
    jobs = spark.createDataFrame([job(k, "running", left=60, attempt=3 if k == "c" else 1) for k in "abcd"], JOB)
    reports = [("a", "agent", 1, "token", "succeeded", False), ("b", "agent", 1, "token", "failed", True), ("c", "agent", 3, "token", "failed", True), ("d", "agent", 2, "token", "succeeded", False)]
    got = of(leases.finish(jobs, spark.createDataFrame(reports, "job_id string, agent_id string, attempt int, lease_token string, outcome string, retryable boolean"), now(), 1000))
    assert {k: r.status for k, r in got.items()} == {"a": "succeeded", "b": "queued", "c": "failed", "d": "running"}


def test_a_claim_is_repeated_and_fences_the_attempt(spark):
    able = {"svn-sync": True, "clang-index": True, "module-index": True}
    agents = spark.createDataFrame([("agent", "online", able), ("b", "online", able), ("c", "online", {}), ("d", "offline", able)], "id string, status string, capabilities map<string,boolean>")
    jobs = spark.createDataFrame([job("a", "running", left=60), job("b", priority=1), job("c", priority=5)], JOB).withColumns({"started_at": F.lit(T0), "finished_at": F.lit(T0)})
    after, claims = leases.claim(jobs, agents, now(), 60_000, "n")
    got = {r.agent_id: r for r in claims.collect()}
    assert {k: (r.job_id, r.attempt, r.repeated) for k, r in got.items()} == {"agent": ("a", 1, True), "b": ("c", 2, False)}
    rows = of(after)
    assert (rows["c"].status, rows["c"].lease_agent_id, rows["c"].lease_token, rows["c"].attempt, rows["c"].finished_at) == ("running", "b", got["b"].lease_token, 2, None)
    assert rows["b"].status == "queued" and rows["a"].lease_token == "token"
    _, again = leases.claim(after, agents, now(), 60_000, "other")
    assert {(r.agent_id, r.job_id, r.lease_token, r.repeated) for r in again.collect()} == {("agent", "a", "token", True), ("b", "c", got["b"].lease_token, True)}


def test_replayed_reports_are_applied_already(spark):
    more = {c: F.lit(None).cast(t) for c, t in (("completion_agent_id", "string"), ("completion_attempt", "int"), ("last_failure_attempt", "int"), ("finished_at", "timestamp"), ("started_at", "timestamp"), ("last_error_retryable", "boolean"))}
    jobs = spark.createDataFrame([job(k, "running", left=60) for k in "ab"], JOB).withColumns(more)
    said = [("a", "agent", 1, "token", "succeeded", False), ("b", "agent", 1, "token", "failed", True), ("b", "thief", 1, "token", "failed", True)]
    reports = spark.createDataFrame(said, "job_id string, agent_id string, attempt int, lease_token string, outcome string, retryable boolean")
    results = lambda jobs: {(r.job_id, r.agent_id): r.result for r in leases.outcomes(jobs, reports, now()).collect()}
    assert results(jobs) == {("a", "agent"): "applied", ("b", "agent"): "applied", ("b", "thief"): "lease_lost"}
    after = leases.finish(jobs, reports, now(), 1000)
    assert results(after) == {("a", "agent"): "already_applied", ("b", "agent"): "already_applied", ("b", "thief"): "lease_lost"}
    got = of(after)
    assert (got["a"].completion_agent_id, got["a"].finished_at) == ("agent", T0) and (got["b"].status, got["b"].last_failure_attempt, got["b"].last_error_retryable) == ("queued", 1, True)
    assert of(leases.finish(after, reports, now(), 1000))["b"].attempt == got["b"].attempt


def test_a_pass_takes_the_leases_that_ended_first(spark):
    jobs = spark.createDataFrame([job(k, "running", left=-i) for i, k in enumerate("abcd", 1)], JOB).withColumn("finished_at", F.lit(None).cast("timestamp"))
    assert {k: r.status for k, r in of(leases.recover_expired(jobs, now(), 0, limit=2)).items()} == {"a": "running", "b": "running", "c": "queued", "d": "queued"}


def test_capable_agents(spark):
    agents = spark.createDataFrame([("a", "online", {"svn-sync": True, "clang-index": True, "module-index": True}), ("b", "online", {"svn-sync": True}), ("c", "offline", {})], "id string, status string, capabilities map<string,boolean>")
    assert [r.id for r in leases.capable(agents).collect()] == ["a"]


def test_event_log_stream(spark, tmp_path):
    live = spark.createDataFrame([("j", 1, "t")], "job_id string, attempt int, lease_token string")
    steps = [
        [("j", 1, "t", 0, "info", "started", None), ("j", 1, "t", 1, "info", "phase", "x")], [("j", 1, "t", 1, "info", "phase", "x")], [("j", 1, "t", 1, "info", "phase", "other"), ("j", 1, "t", 5, "info", "gap", None)],
        [("j", 1, "old", 2, "info", "phase", "y")], [("j", 1, "t", 2, "info", "phase", "y")],
    ]
    for i, rows in enumerate(steps):
        spark.createDataFrame(rows, schemas.JOB_EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    for i in range(len(steps)):  # one run a step: the state goes through the checkpoint
        stream = spark.readStream.schema(schemas.JOB_EVENT).parquet(f"{tmp_path}/in/{{{','.join(map(str, range(i + 1)))}}}" if i else f"{tmp_path}/in/0")
        out = leases.append_events(stream, live).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True)
        out.start().awaitTermination()
    got = sorted((r.sequence, r.event_type, r.status) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted([
        (0, "started", "accepted"), (1, "phase", "accepted"), (1, "phase", "already_applied"), (1, "phase", "sequence_conflict"), (5, "gap", "sequence_conflict"),
        (2, "phase", "lease_lost"), (2, "phase", "accepted"),
    ])


def test_a_stale_event_alone_forgets_nothing(spark, tmp_path):
    """Events of an older attempt come alone; what the live attempt has said is still known afterwards. A log without a lease ends."""
    live = spark.createDataFrame([("j", 2, "t")], "job_id string, attempt int, lease_token string")
    said = [("j", 2, "t", i, "info", "phase", str(i)) for i in range(3)]
    steps = [said, [("j", 1, "old", 9, "info", "phase", "late")], said[:2], [("k", 1, "t", 0, "info", "phase", None)]]
    for i, rows in enumerate(steps):
        spark.createDataFrame(rows, schemas.JOB_EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = leases.append_events(spark.readStream.schema(schemas.JOB_EVENT).parquet(f"{tmp_path}/in"), live)
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.job_id, r.sequence, r.status) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted([*[("j", i, "accepted") for i in range(3)], ("j", 9, "lease_lost"), ("j", 0, "already_applied"), ("j", 1, "already_applied"), ("k", 0, "lease_lost")])


def test_digests_go_after_a_while(spark, tmp_path):
    """A stream with a clock always has another batch to run, so it is run one batch at a time."""
    live = spark.createDataFrame([("j", 1, "t")], "job_id string, attempt int, lease_token string")
    for _ in range(2):
        spark.createDataFrame([("j", 1, "t", 0, "info", "phase", "x")], schemas.JOB_EVENT).write.mode("append").parquet(f"{tmp_path}/in")
        out = leases.append_events(spark.readStream.schema(schemas.JOB_EVENT).parquet(f"{tmp_path}/in"), live, keep_ms=1)
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(once=True).start().awaitTermination()
    assert sorted(r.status for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["accepted", "sequence_conflict"]


MESSAGE = "job_id string, at timestamp, id long, agent_id string, kind string, attempt int"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def by_steps(spark, jobs, messages, lease_s):
    """The same messages through the batch functions, one moment after another."""
    able = {c: True for c in leases.NEEDED}
    said, now = [], of(jobs)
    frame = lambda rows: spark.createDataFrame([tuple(r[c] for c in jobs.columns) for r in rows], jobs.schema)
    for job_id, when, id, agent, kind, attempt in sorted(messages, key=lambda m: (m[1], m[2])):
        clock = F.lit(when).cast("timestamp")
        for k, row in of(leases.recover_expired(frame(now.values()), clock, 0)).items():
            if row.status != now[k].status:
                said.append((k, now[k].lease_expires_at, None, "expire", row.attempt, row.status))
                now[k] = row
        held, own = now[job_id], frame([now[job_id]])
        if kind == "claim":
            agents = spark.createDataFrame([(agent, "online", able)], "id string, status string, capabilities map<string,boolean>")
            own, claims = leases.claim(own, agents, clock, lease_s * 1000, "n")
            found = claims.collect()
            result = ("repeated" if found[0].repeated else "claimed") if found else "refused"
        elif kind == "beat":
            beats = spark.createDataFrame([(job_id, agent, attempt, held.lease_token or "none")], "job_id string, agent_id string, attempt int, lease_token string")
            own = leases.heartbeat(own, beats, clock, lease_s * 1000)
            result = None
        else:
            reports = spark.createDataFrame([(job_id, agent, attempt, held.lease_token or "none", "succeeded", False)], "job_id string, agent_id string, attempt int, lease_token string, outcome string, retryable boolean")
            own, result = leases.finish(own, reports, clock, 0), None
        now[job_id] = own.first()
        changed = now[job_id].lease_expires_at != held.lease_expires_at
        result = result or (("extended" if kind == "beat" else "succeeded") if changed else "lease_lost")
        said.append((job_id, when, id, kind, now[job_id].attempt, result))
    return said


def test_lease_stream_gives_the_rows_of_the_batch_functions(spark, tmp_path):
    """Batches out of order, repeated and late messages, leases that end by themselves, and jobs that were there before."""
    jobs = spark.createDataFrame([(*r, None, None) for r in (job("a", attempt=0), job("b", "running", attempt=3, left=5))], f"{JOB}, started_at timestamp, finished_at timestamp")
    rows = [
        ("a", at(1), 1, "x", "claim", None), ("a", at(2), 2, "y", "claim", None), ("a", at(8), 3, "x", "beat", 1), ("a", at(9), 4, "x", "claim", None), ("a", at(30), 5, "x", "beat", 1), ("a", at(31), 6, "y", "claim", None),
        ("a", at(33), 8, "y", "done", 2), ("b", at(4), 10, "agent", "beat", 2),
    ]
    want = by_steps(spark, jobs, rows, 10)
    steps = [[rows[2], rows[0], rows[7], rows[0]], [rows[1], rows[3], rows[2]], [rows[6], rows[4], rows[5]], [(None, at(9000), 0, None, "beat", None)]]
    for part in steps:
        spark.createDataFrame(part, MESSAGE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(MESSAGE).parquet(f"{tmp_path}/in")
        out = leases.lease_stream(stream, 10_000, 0, 3, "60 seconds", jobs)
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = [(r.job_id, r.at, r.id, r.kind, r.attempt, r.result) for r in spark.read.parquet(f"{tmp_path}/out").where("job_id is not null").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_windows_close_in_a_stream(spark, tmp_path):
    schema = "ts timestamp, kind string"
    rows = [(T0 + dt.timedelta(hours=h), "a") for h in (0, 1, 30, 80)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = leases.windowed_counts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "ts", "1 day", "1 hour", "kind")
    stream.writeStream.format("memory").queryName("windows").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.n for r in spark.table("windows").collect()) == [1, 2]
