"""Usage, quotas and progress: the same functions for batch tables and for streams.

The reference data has no late rows; a watermark is added to streams only to bound their state, and rows that
come later than it are dropped.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coursemill.operators.scans import running, sliced
from coursemill.session import shared_path

# fixed values: limits of a user, and the budget of all
LIMITS = {"minute": 5, "day": 30, "uploads": 3, "budget": 2.0}
# fixed values: the stages of a run in order; one from a link downloads first
STAGES = ["probe", "audio", "asr", "slides", "ocr", "read_slides", "timeline", "chapters", "draft_notes", "notes", "embed", "index", "save"]
FETCH = "fetch"


def daily_usage(ledger: DataFrame, delay: str = "1 day") -> DataFrame:
    """(day, user_id, questions, uploads): counts of each user and UTC day; events without a user are left out."""
    rows = ledger.withWatermark("created_at", delay) if ledger.isStreaming else ledger
    own = rows.where("user_id is not null and kind in ('question', 'upload')")
    counts = own.groupBy(F.window("created_at", "1 day").alias("w"), "user_id").agg(F.sum((F.col("kind") == "question").cast("long")).alias("questions"), F.sum((F.col("kind") == "upload").cast("long")).alias("uploads"))
    return counts.select(F.to_date("w.start").alias("day"), "user_id", "questions", "uploads")


def daily_spend(ledger: DataFrame, delay: str = "1 day") -> DataFrame:
    """(day, spend) of everyone, users or none."""
    rows = ledger.withWatermark("created_at", delay) if ledger.isStreaming else ledger
    return rows.groupBy(F.window("created_at", "1 day").alias("w")).agg(F.sum("cost_usd").alias("spend")).select(F.to_date("w.start").alias("day"), "spend")


def minute_rate(ledger: DataFrame) -> DataFrame:
    """Each question with the questions of its user in the 60 seconds up to it, both ends included."""
    micros = F.unix_micros(F.col("created_at").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("_us").rangeBetween(-60_000_000, 0)
    return ledger.where("kind = 'question' and user_id is not null").withColumn("_us", micros).withColumn("rate", F.count("*").over(w)).drop("_us")


def minute_windows(ledger: DataFrame, delay: str = "1 minute") -> DataFrame:
    """The stream's form of minute_rate: sliding windows of a minute every ten seconds."""
    rows = ledger.withWatermark("created_at", delay) if ledger.isStreaming else ledger
    counts = rows.where("kind = 'question' and user_id is not null").groupBy(F.window("created_at", "1 minute", "10 seconds").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), "user_id", "n")


MINUTE_US = 60_000_000


def minute_rate_stream(ledger: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """(user_id, id, rate): minute_rate of a stream, row by row; a question is answered once the watermark has passed it.

    A user's state is a deque of the times of the last minute and the questions that wait for an answer; questions of one batch
    or of several may come in any order within ``delay``. A timer answers what the watermark has passed; with none waiting
    it drops the times a minute later, so idle users keep nothing. Rows of other kinds only move the watermark. Needs
    the state store that transformWithState asks for (see run_to_end).
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Rates(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("times", "times array<long>, ids array<long>, at array<long>")

        def read(self) -> tuple[list[int], list[int], list[int]]:
            return tuple(map(list, self.state.get())) if self.state.exists() else ([], [], [])

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            times, ids, at = self.read()
            for part in rows:
                asked = part[part.asks]
                times += asked.us.tolist()
                at += asked.us.tolist()
                ids += asked.id.tolist()
            if at:
                self.state.update((sorted(times), ids, at))
                self.handle.registerTimer(-(-min(at) // 1000))
            yield pd.DataFrame({"user_id": [], "id": [], "rate": []}, dtype="int64")

        def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            times, ids, at = self.read()
            passed = timerValues.getCurrentWatermarkInMs() * 1000
            due = [i for i, us in enumerate(at) if us <= passed]
            rates = [bisect_right(times, at[i]) - bisect_left(times, at[i] - MINUTE_US) for i in due]
            left = [i for i, us in enumerate(at) if us > passed]
            yield pd.DataFrame({"user_id": [key[0]] * len(due), "id": [ids[i] for i in due], "rate": rates}, dtype="int64")
            times = times[bisect_left(times, passed - MINUTE_US) :]
            if left or times:
                self.state.update((times, [ids[i] for i in left], [at[i] for i in left]))
                self.handle.registerTimer(-(-min((at[i] for i in left), default=passed + MINUTE_US) // 1000))
            elif self.state.exists():
                self.state.clear()

        def close(self) -> None:
            pass

    asks = (F.col("kind") == "question") & F.col("user_id").isNotNull()
    rows = ledger.withWatermark("created_at", delay).select(F.coalesce(F.col("user_id").cast("long"), F.lit(-1)).alias("user_id"), F.col("id").cast("long"), asks.alias("asks"), F.unix_micros("created_at").alias("us"), "created_at")
    return rows.groupBy("user_id").transformWithStateInPandas(Rates(), "user_id long, id long, rate long", "Append", "EventTime")


def quota_decisions(requests: DataFrame, ledger: DataFrame, limits: dict = LIMITS) -> DataFrame:
    """(id, decision, retry_s) of requests (id, user_id, kind, admin, created_at) against the ledger of admitted events.

    In order: the minute's limit, the day's limit, everyone's budget; what has reached its limit is refused. Only
    ledger rows count, so a refused request never does. Spending is one running sum a day (see scans.running): no request
    meets the spends before it.
    """
    us = F.unix_micros(F.col("created_at").cast("timestamp"))
    day = F.to_date("created_at")
    old = ledger.where("user_id is not null and kind <> 'llm'").select("user_id", "kind", us.alias("us"), day.alias("day"), F.lit(0).alias("ask"), F.lit(None).cast("long").alias("id"), F.lit(False).alias("admin"))
    new = requests.select("user_id", "kind", us.alias("us"), day.alias("day"), F.lit(1).alias("ask"), F.col("id").cast("long"), "admin")
    counted = F.count(F.when(F.col("ask") == 0, 1))
    minute = counted.over(Window.partitionBy("user_id", "kind").orderBy("us").rangeBetween(-60_000_000, 0))
    today = counted.over(Window.partitionBy("user_id", "kind", "day").orderBy("us").rangeBetween(Window.unboundedPreceding, 0))
    rows = old.unionAll(new).withColumns({"minute": minute, "today": today}).where("ask = 1")
    # everyone's spending of the day up to a request: a running sum over spends and requests together
    order = ["us", "ask", "id"]
    spends = ledger.where("cost_usd > 0").select(day.alias("day"), us.alias("us"), F.lit(0).alias("ask"), F.lit(None).cast("long").alias("id"), F.col("cost_usd").cast("double").alias("cost"))
    both = spends.unionAll(rows.select("day", "us", "ask", "id", F.lit(0.0).alias("cost")))
    spent_by = running(sliced(both, ["day"], order), ["day"], order, {"spent": F.col("cost")}).where("ask = 1").select("id", "spent")
    full, spent = rows.join(spent_by, "id"), F.col("spent")
    most = F.when(F.col("kind") == "upload", limits["uploads"]).otherwise(limits["day"])
    decision = F.when(F.col("admin"), "ok").when((F.col("kind") == "question") & (F.col("minute") >= limits["minute"]), "minute").when(F.col("today") >= most, "day").when(spent >= limits["budget"], "budget").otherwise("ok")
    midnight = F.ceil((F.unix_micros((F.col("day") + F.expr("INTERVAL 1 DAY")).cast("timestamp")) - F.col("us")) / 1e6)
    return full.select("id", decision.alias("decision"), "us", "day").select("id", "decision", F.when(F.col("decision") == "minute", 60).when(F.col("decision") != "ok", midnight).cast("long").alias("retry_s"))


def usage_snapshot(ledger: DataFrame, day: str, limits: dict = LIMITS) -> DataFrame:
    """Counts and limits of each user on a day, whether the budget is spent, and when the day ends."""
    use = daily_usage(ledger).where(F.col("day") == F.lit(day).cast("date"))
    spend = daily_spend(ledger).where(F.col("day") == F.lit(day).cast("date")).agg(F.coalesce(F.sum("spend"), F.lit(0.0)).alias("spend"))
    out = use.crossJoin(F.broadcast(spend))  # one row
    return out.select("user_id", "questions", "uploads", F.lit(limits["day"]).alias("question_limit"), F.lit(limits["minute"]).alias("minute_limit"), F.lit(limits["uploads"]).alias("upload_limit"), (F.col("spend") >= limits["budget"]).alias("paused"), F.date_add(F.lit(day).cast("date"), 1).cast("timestamp").alias("resets_at"))


def progress_changes(events: DataFrame) -> DataFrame:
    """Events (run_id, ord, payload, status) whose payload differs from the last one, up to the first that is not running."""
    order = Window.partitionBy("run_id").orderBy("ord")
    ended = F.coalesce(F.max((F.col("status") != "running").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    changed = ~F.col("payload").eqNullSafe(F.lag("payload").over(order)) | F.lag("ord").over(order).isNull()
    return events.withColumns({"_ended": ended, "_changed": changed}).where("_ended = 0 and _changed").drop("_ended", "_changed")


def progress_changes_stream(events: DataFrame) -> DataFrame:
    """progress_changes of a stream: a run's state is its last payload and whether it ended."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, ended = state.get if state.exists else (None, False)
        seen = state.exists
        rows = pd.concat(list(batches)).sort_values("ord")
        out = []
        for r in rows.itertuples():
            if ended:
                break
            if not seen or r.payload != last:
                out.append((key[0], r.ord, r.payload, r.status))
            last, seen, ended = r.payload, True, r.status != "running"
        state.update((last, ended))
        yield pd.DataFrame(out, columns=["run_id", "ord", "payload", "status"])

    kind = dict(events.dtypes)["run_id"]
    return events.groupBy("run_id").applyInPandasWithState(step, f"run_id {kind}, ord long, payload string, status string", "last string, ended boolean", "append", GroupStateTimeout.NoTimeout)


def run_progress(events: DataFrame, stages: list[str] = STAGES) -> DataFrame:
    """(run_id, done, total, percent, states) of stage events (run_id, stage, status done or running, run_status).

    With a column from_link, a run that has it true downloads first: FETCH is a stage of it, and of no other. Stages that are
    not of a run do not count. A run that succeeded has done all of them and is at 100 percent. states maps each stage
    to done, running or pending.
    """
    link = F.coalesce("from_link", F.lit(False)) if "from_link" in events.columns else F.lit(False)
    marked = events.withColumn("_link", link)
    counts = F.col("stage").isin(stages) | ((F.col("stage") == FETCH) & F.col("_link"))
    names = lambda s: F.collect_set(F.when((F.col("status") == s) & counts, F.col("stage")))
    rows = marked.groupBy("run_id").agg(names("done").alias("d"), names("running").alias("r"), (F.max((F.col("run_status") == "succeeded").cast("int")) == 1).alias("ok"), (F.max(F.col("_link").cast("int")) == 1).alias("link"))
    state = lambda s: F.when(F.col("ok") | F.array_contains("d", s), "done").when(F.array_contains("r", s), "running").otherwise("pending")
    every = [FETCH, *stages]
    states = F.map_filter(F.create_map(*(x for s in every for x in (F.lit(s), state(s)))), lambda k, _: (k != FETCH) | F.col("link"))
    total = F.lit(len(stages)) + F.col("link").cast("int")
    done = F.when(F.col("ok"), total).otherwise(F.size("d"))
    return rows.select("run_id", done.alias("done"), total.alias("total"), F.when(F.col("ok"), 100).otherwise(F.floor(F.size("d") / total * 100 + 0.5)).cast("int").alias("percent"), states.alias("states"))


def latest_runs(runs: DataFrame, newest: int = 20) -> DataFrame:
    w = Window.partitionBy("lecture_id").orderBy(F.desc("started_at"), F.desc("run_id"))
    return runs.withColumn("n", F.row_number().over(w)).where(F.col("n") <= newest)


def newest_runs(runs: DataFrame) -> DataFrame:
    """(lecture_id, run_id): the newest run of each lecture; the form of latest_runs that a stream can keep up."""
    return runs.groupBy("lecture_id").agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))


def quota_replay(requests: DataFrame, limits: dict = LIMITS) -> DataFrame:
    """(user_id, id, decision) of raw requests (id, user_id, kind, created_at), each decision feeding the next: admitted ones count.

    Per user, for the limits of a minute and a day; a table or a stream (whose batches come in order). Everyone's budget
    is not a user's state: see quota_decisions.
    """
    schema = "user_id long, id long, decision string"

    def fold(rows: pd.DataFrame, recent: list[int], day: int, used: dict[str, int]) -> tuple[list[tuple], list[int], int, dict[str, int]]:
        out = []
        for r in rows.sort_values(["us", "id"]).itertuples():
            if r.us // 86_400_000_000 != day:
                day, used = r.us // 86_400_000_000, {}
            recent = [t for t in recent if t >= r.us - 60_000_000]
            most = limits["uploads"] if r.kind == "upload" else limits["day"]
            if r.kind == "question" and len(recent) >= limits["minute"]:
                decision = "minute"
            else:
                decision = "day" if used.get(r.kind, 0) >= most else "ok"
            if decision == "ok":
                used = used | {r.kind: used.get(r.kind, 0) + 1}
                recent = [*recent, r.us] if r.kind == "question" else recent
            out.append((r.user_id, r.id, decision))
        return out, recent, day, used

    rows = requests.where("user_id is not null and kind in ('question', 'upload')").select(F.col("user_id").cast("long"), F.col("id").cast("long"), "kind", F.unix_micros(F.col("created_at").cast("timestamp")).alias("us"))
    names = ["user_id", "id", "decision"]
    if not requests.isStreaming:
        return rows.groupBy("user_id").applyInPandas(lambda t: pd.DataFrame(fold(t, [], -1, {})[0], columns=names), schema)
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent, day, questions, uploads = state.get if state.exists else ([], -1, 0, 0)
        out, recent, day, used = fold(pd.concat(list(batches)), list(recent), day, {"question": questions, "upload": uploads})
        state.update((recent, day, used.get("question", 0), used.get("upload", 0)))
        yield pd.DataFrame(out, columns=names)

    return rows.groupBy("user_id").applyInPandasWithState(step, schema, "recent array<long>, day long, questions long, uploads long", "append", GroupStateTimeout.NoTimeout)


def running_conflicts(runs: DataFrame) -> DataFrame:
    """Lectures with more than one running run."""
    return runs.where("status = 'running'").groupBy("lecture_id").agg(F.count("*").alias("n")).where("n > 1")


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_end(stream: DataFrame, mode: str = "complete", own_state: bool = False) -> DataFrame:
    """Run a stream over all that is there now and return its last output (complete) or all of it (append).

    own_state: the stream uses transformWithState, whose state needs the RocksDB store; the session's setting comes back.
    """
    spark: SparkSession = stream.sparkSession
    path = shared_path(spark, "stream")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/out")

    before = spark.conf.get(STORE)
    try:
        if own_state:
            spark.conf.set(STORE, ROCKS)
        query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def upsert_feedback_stream(ratings: DataFrame, path: str) -> DataFrame:
    """Keep the last rating of each answer under ``path`` from a stream of ratings; returns what is stored.

    A batch changes the buckets of its answers and no others (see sources.buckets); one that is tried again after its
    commit changes nothing.
    """
    from coursemill.operators.qa import latest_feedback
    from coursemill.sources import buckets

    spark = ratings.sparkSession
    older = lambda rows: rows.withColumn("id", F.lit(-1).cast("long"))  # noqa: E731  at one time a stored rating yields

    def merge(batch: DataFrame, number: int) -> None:
        new = latest_feedback(batch.select("id", "message_id", "rating", "updated_at"))
        merged = lambda old, rows: latest_feedback(older(old).unionByName(rows.withColumn("id", F.lit(0).cast("long"))))
        buckets.change(path, {"ratings": buckets.Change(new, ["message_id"], merged)}, batch=number)

    query = ratings.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if buckets.manifest(spark, path):
        return buckets.read(spark, path, "ratings")
    return latest_feedback(spark.createDataFrame([], "id long, message_id long, rating string, updated_at timestamp"))


def detect_slides_stream(frames: DataFrame) -> DataFrame:
    """(lecture_id, span_index, slide_id, start_s): spans of detect_slides as they are accepted, from a stream of frames.

    A lecture's state is its deck; frames of a batch are taken in time order, and batches must come in order.
    A span ends where the next one of its lecture starts.
    """
    import pickle

    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    from coursemill.operators.slides import Deck

    names = sorted(c for c in frames.columns if c[0] == "h" and c[1:].isdigit())

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        deck = pickle.loads(state.get[0]) if state.exists else Deck(len(names))  # written by this job alone
        known = len(deck.spans)
        rows = pd.concat(list(batches)).sort_values("t_s", kind="stable")
        slides = rows[rows.is_slide]
        deck.feed(slides.t_s.to_numpy(float), slides[names].to_numpy("int64"))
        state.update((pickle.dumps(deck),))
        out = [(key[0], i, slide, start) for i, (slide, start) in enumerate(deck.spans) if i >= known]
        yield pd.DataFrame(out, columns=["lecture_id", "span_index", "slide_id", "start_s"])

    kind = dict(frames.dtypes)["lecture_id"]
    rows = frames.select("lecture_id", "t_s", "is_slide", *names)
    return rows.groupBy("lecture_id").applyInPandasWithState(step, f"lecture_id {kind}, span_index int, slide_id int, start_s double", "deck binary", "append", GroupStateTimeout.NoTimeout)


def sample_per_key_stream(frames: DataFrame, keys: list[str], limit: int = 6, gap_s: float = 10.0) -> DataFrame:
    """sample_per_key of a stream: how many frames of each key are kept and when the last one was.

    A group with state costs far more than its rows, so it is all keys of one value of the first (a lecture), and its state
    has an entry for each. The other keys go through the group as JSON.
    """
    import pickle

    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    first, rest = keys[0], keys[1:]
    options = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = pickle.loads(state.get[0]) if state.exists else {}  # written by this job alone
        rows = pd.concat(list(batches))
        t_s, frames_, others = rows.t_s.to_numpy(float), rows.frame.to_numpy(), rows._rest.to_numpy()
        out = []
        for i in np.lexsort((frames_, t_s)):
            kept, last = seen.get(others[i], (0, float("-inf")))
            if kept < limit and t_s[i] - last >= gap_s:
                seen[others[i]] = kept + 1, float(t_s[i])
                out.append((key[0], others[i], t_s[i], frames_[i]))
        if out:
            state.update((pickle.dumps(seen),))
        yield pd.DataFrame(out, columns=[first, "_rest", "t_s", "frame"])

    types = dict(frames.dtypes)
    other = F.to_json(F.struct(*rest), options) if rest else F.lit("{}")
    groups = frames.select(first, other.alias("_rest"), "t_s", "frame").groupBy(first)
    kept = groups.applyInPandasWithState(step, f"{first} {types[first]}, _rest string, t_s double, frame long", "seen binary", "append", GroupStateTimeout.NoTimeout)
    back = F.from_json("_rest", ", ".join(f"{k} {types[k]}" for k in rest), options) if rest else None
    return kept.select(first, *(back[k].alias(k) for k in rest), "t_s", "frame")
