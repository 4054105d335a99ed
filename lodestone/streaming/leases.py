"""Jobs under leases: an ordered event log as a stateful stream, and the batch steps of the lease's life.

An event is accepted if it comes with the live attempt and token and the next sequence number; an exact repeat is
``already_applied``, any other number a ``sequence_conflict``, and another token or an ended lease ``lease_lost``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestone.storage import new_path, stash

STORE = "spark.sql.streaming.stateStore.providerClass"
RESULT = "job_id string, sequence long, event_type string, status string"
NEEDED = ("svn-sync", "clang-index", "module-index")
#: Expired leases that one pass takes back; events that end a log.
EXPIRED_AT_ONCE, FINAL = 1000, ("succeeded", "failed", "cancelled")


class EventLog(StatefulProcessor):
    """Per job: the next sequence number and a digest of each accepted event, for exact repeats.

    Once an event of ``FINAL`` is accepted, or the job has no live lease at all (``held``; an event of an older attempt or
    another token says nothing about that), the digests go but the last: a log that has ended holds one. With ``keep_ms``
    each digest also goes that long after it came, by the clock; a later repeat is a conflict then. (Such a stream always
    has another batch to run: give it a trigger of its own, as ``availableNow`` never ends.)
    """

    def __init__(self, keep_ms: int | None = None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "sequence long")
        self.seen = handle.getMapState("seen", "sequence long", "digest string", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        # The order of arrival within a batch isn't defined, so the rows of a job are put in order first.
        pdf = pd.concat(list(rows)).sort_values(["sequence", "digest"], kind="stable")
        following = self.next.get()[0] if self.next.exists() else 0
        out = []
        for seq, kind, digest, live in zip(pdf["sequence"], pdf["event_type"], pdf["digest"], pdf["live"]):
            seq = int(seq)
            if not live:
                status = "lease_lost"
            elif seq == following:
                self.seen.updateValue((seq,), (digest,))
                status, following = "accepted", following + 1
            elif seq < following and self.seen.containsKey((seq,)) and self.seen.getValue((seq,))[0] == digest:
                status = "already_applied"
            else:
                status = "sequence_conflict"
            out.append((key[0], seq, kind, status))
        self.next.update((following,))
        ended = not pdf["held"].any() or any(status == "accepted" and kind in FINAL for _, _, kind, status in out)
        if ended and following and self.seen.containsKey((following - 1,)):
            last = self.seen.getValue((following - 1,))
            self.seen.clear()
            self.seen.updateValue((following - 1,), last)
        yield pd.DataFrame(out, columns=["job_id", "sequence", "event_type", "status"])

    def close(self) -> None:
        pass


def event_digest() -> Column:
    return F.sha2(F.to_json(F.struct("level", "event_type", "fields")), 256)


def append_events(events: DataFrame, leases: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """(job_id, sequence, event_type, status) from events, a stream or a finished table, and a table of live leases (job_id,
    attempt, lease_token). A stream needs the RocksDB state store; a table is judged as one batch that begins a log."""
    live = leases.select("job_id", F.col("attempt").alias("_a"), F.col("lease_token").alias("_t"))
    rows = events.join(live, "job_id", "left").withColumn("live", F.coalesce((F.col("attempt") == F.col("_a")) & (F.col("lease_token") == F.col("_t")), F.lit(False)))
    rows = rows.select("job_id", "sequence", "event_type", event_digest().alias("digest"), "live", F.col("_t").isNotNull().alias("held"))
    if events.isStreaming:
        return rows.groupBy("job_id").transformWithStateInPandas(EventLog(keep_ms), RESULT, "append", "none" if keep_ms is None else "processingTime")
    # The first event of a number is accepted if all smaller numbers are there; of the others, its repeats are applied already.
    place = F.dense_rank().over(Window.partitionBy("job_id", "live").orderBy("sequence")) - 1
    same = Window.partitionBy("job_id", "live", "sequence").orderBy("digest")
    nth, first = F.row_number().over(same), F.first("digest").over(same)
    reached = F.col("sequence") == place
    status = F.when(~F.col("live"), "lease_lost").when(reached & (nth == 1), "accepted").when(reached & (F.col("digest") == first), "already_applied").otherwise("sequence_conflict")
    return rows.withColumn("status", status).select("job_id", "sequence", "event_type", "status")


#: What a lease stream says: one row for each message, and one for each lease that ends by itself (kind ``expire``, no id).
SAID = "job_id string, at_us long, id long, agent_id string, kind string, attempt int, result string, expires_us long"
_LEASE = "status string, attempt int, agent_id string, expires_us long, available_us long"


@dataclass
class Lease:
    """Where a job stands: the rules of ``recover_expired``, ``claim``, ``heartbeat`` and ``finish``, one message at a time."""

    status: str = "queued"
    attempt: int = 0
    agent_id: str | None = None
    expires_us: int | None = None
    available_us: int = 0

    def expire(self, now: int, delay: int, most: int):
        """The row of a lease that has ended by ``now``, if it has: back into the queue after a delay, or failed without attempts left."""
        if self.status != "running" or self.expires_us > now:
            return None
        at, agent = self.expires_us, self.agent_id
        self.status = "queued" if self.attempt < most else "failed"
        self.agent_id, self.expires_us, self.available_us = None, None, at + delay
        return at, None, agent, "expire", self.attempt, self.status, None

    def take(self, at: int, id: int, agent: str, kind: str, attempt: int | None, lease: int):
        """The row that a message gets. The attempt stands for the token, which is made of job, attempt and agent."""
        mine = self.status == "running" and self.agent_id == agent and (kind == "claim" or attempt is None or attempt == self.attempt)
        if kind == "claim":
            result = "repeated" if mine else "refused"
            if self.status == "queued" and self.available_us <= at:
                self.status, self.attempt, self.agent_id, self.expires_us = "running", self.attempt + 1, agent, at + lease
                result = "claimed"
        elif not mine:
            result = "lease_lost"
        elif kind == "beat":
            self.expires_us, result = at + lease, "extended"
        else:
            self.status, self.agent_id, self.expires_us, result = "succeeded", None, None, "succeeded"
        return at, id, agent, kind, self.attempt, result, None if result in ("refused", "lease_lost") else self.expires_us


class LeaseStream(StatefulProcessor):
    """Leases that end by themselves: messages wait until the watermark has passed them, and are then taken in order.

    So what comes out doesn't depend on the order of arrival. A timer stands at the first message that waits and at the end
    of the lease, in event time. A message that comes again (one time and id) is one message while it waits. Messages go to
    the state and come from it by the batch, as each call of the state costs more than a message.
    """

    def __init__(self, lease_ms: int, delay_ms: int, most: int):
        self.lease, self.delay, self.most = lease_ms * 1000, delay_ms * 1000, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", _LEASE)
        self.waiting = handle.getListState("waiting", "at_us long, id long, agent_id string, kind string, attempt int")

    def _wake(self, at_us: int) -> None:
        self.handle.registerTimer(-(-at_us // 1000))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        whole = lambda c, other: other if pd.isna(row[c]) else int(row[c])
        self.job.update((row["status"], whole("attempt", 0), None if pd.isna(row["lease_agent_id"]) else row["lease_agent_id"], whole("expires_us", None), whole("available_us", 0)))
        if row["status"] == "running":
            self._wake(whole("expires_us", None))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            if len(pdf):
                attempts = [None if pd.isna(x) else int(x) for x in pdf["attempt"]]
                self.waiting.appendList(list(zip(map(int, pdf["at_us"]), map(int, pdf["id"]), pdf["agent_id"], pdf["kind"], attempts)))
                first = int(pdf["at_us"].min()) if first is None else min(first, int(pdf["at_us"].min()))
        if first is not None:
            self._wake(first)
        yield pd.DataFrame(columns=[c.split()[0] for c in SAID.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentWatermarkInMs() * 1000, []
        lease = Lease(*self.job.get()) if self.job.exists() else Lease()
        waiting = sorted({(m[0], m[1]): tuple(m[2:]) for m in self.waiting.get()}.items())
        for (at, id), (agent, kind, attempt) in [w for w in waiting if w[0][0] <= now]:
            out += [lease.expire(at, self.delay, self.most), lease.take(at, id, agent, kind, attempt, self.lease)]
        rest = [(*k, *v) for k, v in waiting if k[0] > now]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        out.append(lease.expire(now, self.delay, self.most))
        self.job.update((lease.status, lease.attempt, lease.agent_id, lease.expires_us, lease.available_us))
        later = [w[0][0] for w in waiting if w[0][0] > now][:1] + ([lease.expires_us] if lease.status == "running" else [])
        for at in later:
            self._wake(at)
        yield pd.DataFrame([(key[0], *row) for row in out if row], columns=[c.split()[0] for c in SAID.split(", ")])

    def close(self) -> None:
        pass


def lease_stream(messages: DataFrame, lease_ms: int, delay_ms: int, most: int, late: str, jobs: DataFrame | None = None) -> DataFrame:
    """What comes of a stream of messages (job_id, at, id, agent_id, kind: claim/beat/done, attempt), and of leases that nobody extends.

    Messages may come up to ``late`` after others of later times; Spark drops what is later than that. ``jobs`` (job_id, status,
    attempt, lease_agent_id, lease_expires_at, available_at) is where jobs stand when the stream begins; others are queued.
    """
    rows = messages.withWatermark("at", late).select(F.col("job_id").cast("string").alias("job_id"), "at", F.unix_micros("at").alias("at_us"), F.coalesce(F.col("id").cast("long"), F.lit(0)).alias("id"), "agent_id", "kind", F.col("attempt").cast("int").alias("attempt"))
    begin = None
    if jobs is not None:
        micros = lambda c: F.unix_micros(c).alias(c.replace("lease_", "").replace("_at", "_us"))
        begin = jobs.select(F.col("job_id").cast("string").alias("job_id"), "status", "attempt", "lease_agent_id", micros("lease_expires_at"), micros("available_at")).groupBy("job_id")
    out = rows.groupBy("job_id").transformWithStateInPandas(LeaseStream(lease_ms, delay_ms, most), SAID, "append", "eventTime", begin)
    at = lambda c: F.timestamp_micros(c)
    return out.select("job_id", at("at_us").alias("at"), "id", "agent_id", "kind", "attempt", "result", at("expires_us").alias("lease_expires_at"))


def run_to_end(spark: SparkSession, messages: DataFrame, over, end: Column) -> DataFrame:
    """All rows of a stream over a finished table of messages: ``over`` makes the stream's plan of a stream of messages.

    The messages are written to the shared folder and streamed, then a message of no job at ``end`` lets the watermark pass
    all others. State and rows go through a checkpoint there.
    """
    path, rows = new_path(spark, "messages"), new_path(spark, "rows")
    kept = spark.conf.get(STORE, None)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in (messages, spark.range(1).select(*[(end if c == "at" else F.lit(None)).cast(messages.schema[c].dataType).alias(c) for c in messages.columns])):
            part.write.mode("append").parquet(path)
            out = over(spark.readStream.schema(messages.schema).parquet(path))
            out.writeStream.format("parquet").option("path", rows).option("checkpointLocation", f"{rows}-state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(STORE) if kept is None else spark.conf.set(STORE, kept)
    return spark.read.schema(out.schema).parquet(rows)


def windowed_counts(events: DataFrame, time: str, width: str, late: str, *by: str) -> DataFrame:
    """Counts per window of event time, batch or stream; a stream waits for events that are ``late`` and then closes it."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


def _set(jobs: DataFrame, changes: dict[str, Column]) -> DataFrame:
    """``jobs`` with the columns that it has of ``changes`` changed; all see the row as it was."""
    return jobs.withColumns({c: v for c, v in changes.items() if c in jobs.columns})


def _released(when: Column) -> dict[str, Column]:
    return {c: F.when(when, None).otherwise(F.col(c)) for c in ("lease_agent_id", "lease_token", "lease_expires_at")}


def _failed(ended: Column, again: Column, now: Column, delay_ms: int, code: Column, retryable: Column) -> dict[str, Column]:
    """What a failure writes: back into the queue after a delay, or failed for good."""
    later = F.timestamp_millis(F.unix_millis(now) + delay_ms)
    return {
        "status": F.when(again, "queued").when(ended, "failed").otherwise(F.col("status")),
        "available_at": F.when(again, later).otherwise(F.col("available_at")),
        "started_at": F.when(~again, F.col("started_at")), "finished_at": F.when(again, None).when(ended, now).otherwise(F.col("finished_at")),
        "last_failure_agent_id": F.when(ended, F.col("lease_agent_id")).otherwise(F.col("last_failure_agent_id")),
        "last_failure_attempt": F.when(ended, F.col("attempt")).otherwise(F.col("last_failure_attempt")),
        "last_error_code": F.when(ended, code).otherwise(F.col("last_error_code")),
        "last_error_retryable": F.when(ended, retryable).otherwise(F.col("last_error_retryable")), **_released(ended),
    }


def recover_expired(jobs: DataFrame, now: Column, delay_ms: int, limit: int = EXPIRED_AT_ONCE, key: str = "job_id") -> DataFrame:
    """``jobs`` with running leases that have ended put back into the queue after a delay, or failed without attempts left.

    A pass takes the ``limit`` leases that ended first. Columns of a failure that ``jobs`` lacks are left out.
    """
    ended = (F.col("status") == "running") & (F.col("lease_expires_at") <= now)
    first = jobs.where(ended).orderBy("lease_expires_at", key).limit(limit).select(F.col(key).alias("_ended"))
    marked = jobs.join(first, jobs[key] == first["_ended"], "left").withColumn("_ended", F.col("_ended").isNotNull())
    again = F.col("_ended") & (F.col("attempt") < F.col("max_attempts"))
    return _set(marked, _failed(F.col("_ended"), again, now, delay_ms, F.lit("LEASE_EXPIRED"), again)).drop("_ended")


def capable(agents: DataFrame, needed: tuple[str, ...] = NEEDED) -> DataFrame:
    """Online agents whose capabilities (a map of booleans) hold all that is needed."""
    cond = F.col("status") == "online"
    for c in needed:
        cond = cond & F.coalesce(F.col("capabilities")[c], F.lit(False))
    return agents.where(cond)


def queue(jobs: DataFrame, now: Column) -> DataFrame:
    """The jobs that may be claimed, with their place in the queue: the highest priority, then the longest available."""
    ready = (F.col("status") == "queued") & (F.col("available_at") <= now) & F.col("cancellation_requested_at").isNull()
    for c, cond in (("type", F.col("type") == "reindex"), ("agent_payload", F.col("agent_payload").isNotNull())):
        ready = ready & cond if c in jobs.columns else ready
    return jobs.where(ready)


def next_job(jobs: DataFrame, now: Column) -> DataFrame:
    """The job that a claim would take."""
    return queue(jobs, now).orderBy(F.desc("priority"), "available_at", "requested_at", "job_id").limit(1)


def claim(jobs: DataFrame, agents: DataFrame, now: Column, lease_ms: int, nonce: str) -> tuple[DataFrame, DataFrame]:
    """(jobs after, claims: agent_id, job_id, attempt, lease_token, lease_expires_at, repeated) of all ``agents`` that ask at once.

    An agent that holds a live lease gets this one again, the earliest started if it holds several. The others, online and
    capable, get the first jobs of the queue, in the order of their ids. The token fences the attempt: it is made of the
    ``nonce``, job, attempt and agent, so that a repeated task gives the same. Agents of one call are few: ``agents`` is
    what sets the number of jobs that are looked at.
    """
    fit = stash(capable(agents).select(F.col("id").alias("agent_id")).distinct(), "agents")
    online = agents.where("status = 'online'").select(F.col("id").alias("lease_agent_id"))
    live = jobs.where((F.col("status") == "running") & F.col("lease_token").isNotNull() & (F.col("lease_expires_at") > now)).join(online, "lease_agent_id", "left_semi")
    first = F.min(F.struct(F.col("started_at"), "job_id", "attempt", "lease_token", "lease_expires_at")).alias("j")
    held = live.groupBy(F.col("lease_agent_id").alias("agent_id")).agg(first).select("agent_id", "j.job_id", "j.attempt", "j.lease_token", "j.lease_expires_at", F.lit(True).alias("repeated"))
    free = fit.join(held, "agent_id", "left_anti")
    n = free.count()
    places = free.withColumn("place", F.row_number().over(Window.orderBy("agent_id")))
    order = [F.desc("priority"), F.col("available_at"), F.col("requested_at"), F.col("job_id")]
    ready = queue(jobs, now).orderBy(*order).limit(n).select("job_id", "attempt", F.row_number().over(Window.orderBy(*order)).alias("place"))
    token = F.sha2(F.concat_ws("\x1f", F.lit(nonce), F.col("job_id").cast("string"), F.col("attempt").cast("string"), F.col("agent_id").cast("string")), 256)
    new = places.join(ready, "place").withColumn("attempt", F.col("attempt") + 1).withColumn("lease_token", token)
    ends = F.timestamp_millis(F.unix_millis(now) + lease_ms)
    new = stash(new.select("agent_id", "job_id", "attempt", "lease_token", ends.alias("lease_expires_at"), F.lit(False).alias("repeated")), "claims")
    taken = new.select(F.col("job_id").alias("_job"), F.col("agent_id").alias("_agent"), F.col("lease_token").alias("_token"))
    joined = jobs.join(taken, jobs["job_id"] == taken["_job"], "left")
    mine = F.col("_job").isNotNull()
    after = _set(joined, {
        "status": F.when(mine, "running").otherwise(F.col("status")), "attempt": F.when(mine, F.col("attempt") + 1).otherwise(F.col("attempt")),
        "lease_agent_id": F.coalesce("_agent", "lease_agent_id"), "lease_token": F.coalesce("_token", "lease_token"), "lease_expires_at": F.when(mine, ends).otherwise(F.col("lease_expires_at")),
        "started_at": F.when(mine, now).otherwise(F.col("started_at")), "finished_at": F.when(~mine, F.col("finished_at")),
    })
    return after.drop("_job", "_agent", "_token"), held.unionByName(new)


def heartbeat(jobs: DataFrame, beats: DataFrame, now: Column, lease_ms: int) -> DataFrame:
    """``jobs`` with the leases extended that a beat (job_id, agent_id, attempt, lease_token) of their holder names."""
    b = beats.dropDuplicates(["job_id", "agent_id", "attempt", "lease_token"]).withColumns({"_b": F.lit(True)})
    b = b.select("job_id", F.col("agent_id").alias("lease_agent_id"), "attempt", "lease_token", "_b")
    joined = jobs.join(b, ["job_id", "lease_agent_id", "attempt", "lease_token"], "left")
    alive = F.coalesce("_b", F.lit(False)) & (F.col("status") == "running") & (F.col("lease_expires_at") > now)
    return joined.withColumn("lease_expires_at", F.when(alive, F.timestamp_millis(F.unix_millis(now) + lease_ms)).otherwise(F.col("lease_expires_at"))).select(*jobs.columns)


def outcomes(jobs: DataFrame, reports: DataFrame, now: Column) -> DataFrame:
    """``reports`` (job_id, agent_id, attempt, lease_token, outcome: succeeded/failed, retryable) with what comes of each.

    applied: its lease lives. already_applied: the job says that this agent and attempt have ended it in this way. Any
    other is lease_lost. A report that comes several times counts once.
    """
    asked = ["job_id", "agent_id", "attempt", "lease_token"]
    more = [c for c in ("error_code",) if c in reports.columns]
    r = reports.groupBy(*asked).agg(F.min(F.struct("outcome", "retryable", *more)).alias("r")).select(*asked, "r.*")
    null = lambda c, kind: F.col(c) if c in jobs.columns else F.lit(None).cast(kind)
    own = jobs.select(
        F.col("job_id").alias("_job"), "status", F.col("attempt").alias("_attempt"), F.col("lease_token").alias("_token"), "lease_agent_id", "lease_expires_at", "last_failure_agent_id",
        null("last_failure_attempt", "int").alias("last_failure_attempt"), null("completion_agent_id", "string").alias("completion_agent_id"), null("completion_attempt", "int").alias("completion_attempt"),
    )
    joined = r.join(own, F.col("job_id") == F.col("_job"), "left")
    live = (F.col("status") == "running") & (F.col("lease_agent_id") == F.col("agent_id")) & (F.col("attempt") == F.col("_attempt")) & (F.col("lease_token") == F.col("_token")) & (F.col("lease_expires_at") > now)
    done = (F.col("outcome") == "succeeded") & (F.col("status") == "succeeded") & (F.col("completion_agent_id") == F.col("agent_id")) & (F.col("completion_attempt") == F.col("attempt"))
    gone = (F.col("outcome") == "failed") & (F.col("last_failure_agent_id") == F.col("agent_id")) & (F.col("last_failure_attempt") == F.col("attempt"))
    said = F.when(F.coalesce(live, F.lit(False)), "applied").when(F.coalesce(done | gone, F.lit(False)), "already_applied").otherwise("lease_lost")
    return joined.withColumn("result", said).select(*r.columns, "result")


def finish(jobs: DataFrame, reports: DataFrame, now: Column, delay_ms: int) -> DataFrame:
    """``jobs`` after the reports that ``outcomes`` applies."""
    r = outcomes(jobs, reports, now).where("result = 'applied'")
    code = F.col("error_code") if "error_code" in r.columns else F.lit("FAILED")
    r = r.select(F.col("job_id").alias("_job"), F.col("outcome").alias("_outcome"), F.coalesce("retryable", F.lit(False)).alias("_retryable"), code.alias("_code"))
    live = jobs.join(r, jobs["job_id"] == r["_job"], "left")
    failed, won = F.coalesce(F.col("_outcome") == "failed", F.lit(False)), F.coalesce(F.col("_outcome") == "succeeded", F.lit(False))
    again = failed & F.col("_retryable") & (F.col("attempt") < F.col("max_attempts"))
    changes = _failed(failed, again, now, delay_ms, F.col("_code"), F.col("_retryable"))
    changes["status"] = F.when(won, "succeeded").otherwise(changes["status"])
    changes["finished_at"] = F.when(won, now).otherwise(changes["finished_at"])
    changes |= {"completion_agent_id": F.when(won, F.col("lease_agent_id")).otherwise(F.col("completion_agent_id")), "completion_attempt": F.when(won, F.col("attempt")).otherwise(F.col("completion_attempt"))}
    changes |= _released(failed | won)
    return _set(live, {c: v for c, v in changes.items() if c in jobs.columns}).select(*jobs.columns)


def next_sequence(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """(job_id, next_sequence): one more than the largest number of a job's events, 0 without any."""
    top = events.groupBy("job_id").agg(F.max("sequence").alias("_top"))
    return jobs.select("job_id").join(top, "job_id", "left").select("job_id", (F.coalesce("_top", F.lit(-1)) + 1).alias("next_sequence"))
