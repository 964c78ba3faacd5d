"""Streams with state: one batch or many give the answer of the batch form; what is late, missing or repeated."""

import pytest
from pyspark.sql import functions as F

from lorekeep.operators.commerce import confirm_proposals, idempotent_apply
from lorekeep.streaming.processors import answers_stream, apply_once_stream, confirm_stream, first_token_stream
from lorekeep.streaming.routes import observed, requests_stream, routed
from lorekeep.streaming.run import drain, in_batches
from lorekeep.streaming.telemetry import counters_stream, turn_outcomes_stream, turn_summary_stream


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def timed(df):
    return df.withColumn("at", F.to_timestamp("at"))


@pytest.mark.parametrize("batches", [1, 3])
def test_confirmations(spark, batches):
    proposals = spark.createDataFrame([("s", p, 10 + p, "2024-01-01 00:10:00", p != 2) for p in (1, 2, 3)], "site_id string, id long, subject long, expires_at string, accepted boolean")
    proposals = proposals.withColumn("expires_at", F.to_timestamp("expires_at"))
    tried = [(n, p, 10 + p - (n % 5 == 0), f"2024-01-01 00:{n // 2:02d}:00") for n, p in enumerate([1, 2, 1, 2, 3, 3, 1, 9, 2, 3, 1, 1, 2, 2, 3, 3, 3, 2, 1, 1, 2, 3, 1, 2])]
    confirms = timed(spark.createDataFrame([("s", n, p, who, at) for n, p, who, at in tried], "site_id string, confirm_id long, proposal_id long, subject long, at string"))
    got = drain(confirm_stream(in_batches(confirms, F.floor(F.col("confirm_id") * batches / 24), batches), proposals), keyed=True)
    assert rows(got) == rows(confirm_proposals(proposals, confirms))


@pytest.mark.parametrize("batches", [1, 4])
def test_repeats_get_the_first_answer(spark, batches):
    made = [(n, n % 3, [None, "", "a", "b", "a"][n % 5], f"outcome {n}", f"2024-01-01 00:{n:02d}:00") for n in range(40)]
    requests = timed(spark.createDataFrame(made, "request_id long, owner long, key string, outcome string, at string"))
    out = drain(apply_once_stream(in_batches(requests, F.floor(F.col("request_id") * batches / 40), batches), 86_400), keyed=True)
    replies, errors = idempotent_apply(requests, ["at", "request_id"])
    assert rows(out.filter("error IS NULL").drop("error")) == rows(replies)
    assert rows(out.filter("error IS NOT NULL").select("request_id", "error")) == rows(errors)


def test_an_outcome_is_forgotten_after_its_time(spark):
    made = [(0, "outcome 0", "2024-01-01 00:00:00"), (1, "outcome 1", "2024-01-01 00:30:00"), (2, "outcome 2", "2024-01-09 00:00:00"), (3, "outcome 3", "2024-01-09 00:01:00")]
    requests = timed(spark.createDataFrame([(n, 1, "k", o, at) for n, o, at in made], "request_id long, owner long, key string, outcome string, at string"))
    out = drain(apply_once_stream(in_batches(requests, F.col("request_id"), 4), 3600), keyed=True)
    assert [(r["outcome"], r["replayed"]) for r in out.orderBy("request_id").collect()] == [("outcome 0", False), ("outcome 0", True), ("outcome 2", False), ("outcome 2", True)]


def test_answers_from_shuffled_pieces(spark):
    events = [("t1", "start", 0, ""), ("t1", "delta", 1, "a"), ("t1", "delta", 2, "b"), ("t1", "done", 3, "")]
    events += [("t2", "start", 0, ""), ("t2", "delta", 1, "x"), ("t2", "delta", 2, "y")]  # never done
    events += [("t3", "start", 0, ""), ("t3", "delta", 2, "q"), ("t3", "done", 3, "")]  # a piece is missing
    events += [("t4", "start", 0, ""), ("t4", "done", 1, "")]  # nothing said
    frame = timed(spark.createDataFrame([(*e, "2024-01-01 00:00:00") for e in events], "turn_id string, type string, seq long, text string, at string"))
    end = timed(spark.createDataFrame([("clock", "tick", 0, "", "2024-02-01 00:00:00")], "turn_id string, type string, seq long, text string, at string"))
    for deal in (F.lit(0), F.col("seq") % 3, F.lit(2) - F.least("seq", F.lit(2))):
        got = drain(answers_stream(in_batches(frame, deal, 3, end)), keyed=True)
        assert rows(got) == [("t1", "ab"), ("t2", "xy"), ("t3", "q")]


def test_first_token_is_told_once(spark):
    events = [("t1", "start", "2024-01-01 00:00:00"), ("t1", "delta", "2024-01-01 00:00:02"), ("t1", "delta", "2024-01-01 00:00:03"), ("t2", "start", "2024-01-01 00:00:00")]
    frame = timed(spark.createDataFrame([(*e, n) for n, e in enumerate(events)], "turn_id string, type string, at string, n int"))
    for deal in (F.lit(0), F.col("n")):
        assert rows(drain(first_token_stream(in_batches(frame, deal, 4).drop("n")), keyed=True)) == [("t1", 2000)]


def test_outcomes_of_turns_that_end_and_that_do_not(spark):
    starts = timed(spark.createDataFrame([(n, "streamed" if n < 3 else "buffered", "2024-01-01 00:00:00") for n in range(5)], "turn_id long, mode string, at string"))
    dones = timed(spark.createDataFrame([(0, "yes", True, "2024-01-01 00:00:09"), (1, "none", True, "2024-01-01 00:00:09"), (3, "yes", False, "2024-01-01 00:00:09")], "turn_id long, answer string, grounded boolean, at string"))
    late = F.to_timestamp(F.lit("2024-03-01"))
    feed = lambda df: in_batches(df, F.col("turn_id") % 2, 2, df.limit(1).withColumns({"turn_id": F.lit(-1).cast("long"), "at": late}))
    out = drain(turn_outcomes_stream(feed(starts), feed(dones), "none")).filter("turn_id >= 0")
    assert rows(out.select("turn_id", "outcome")) == [(0, "grounded"), (1, "no_answer"), (2, "abandoned"), (3, "ungrounded"), (4, "failed")]


def test_summary_of_turns_from_their_events(spark):
    events = [(n, "m", r, 2 * (n % 2), n, n == 1, n < 3, f"2024-01-01 0{n}:00:0{r}") for n in range(4) for r in range(n + 1)]
    frame = timed(spark.createDataFrame(events, "turn_id long, mode string, round int, sources int, history_turns int, persisted boolean, grounded boolean, at string"))
    end = frame.limit(1).withColumns({"mode": F.lit("clock"), "at": F.to_timestamp(F.lit("2024-03-01"))})
    out = drain(turn_summary_stream(in_batches(frame, F.col("round") % 2, 2, end), late="1 day")).filter("mode = 'm'").first().asDict()
    assert (out["turns"], out["mean_rounds"], out["max_rounds"], out["mean_sources"], out["persisted_share"], out["grounded_rate"]) == (4, 1.5, 3, 1.0, 0.25, 0.75)


def test_one_pass_counts_and_sends(spark, tmp_path):
    made = [({"conversationId": "c-1", "message": "hi"},), ({"message": " "},), ({"message": "x" * 50},), ({"message": "x", "debug": "1"},), ({"conversationId": "a b", "message": "x"},), (None,), ({"message": "ok"},)]
    raw = spark.createDataFrame([(n, *m) for n, m in enumerate(made)], "n int, fields map<string,string>")
    out = str(tmp_path / "out")
    requests_stream(in_batches(raw, F.col("n") % 2, 2), 20, out, str(tmp_path / "state")).awaitTermination()
    assert [r["n"] for r in routed(spark, out, "accepted").orderBy("n").collect()] == [0, 6] and routed(spark, out, "rejected").count() == 5
    assert dict(rows(observed(spark, out))) == {"accepted": 2, "conversation id": 1, "empty message": 2, "message too long": 1, "unknown field": 1}


def test_counters_of_one_pass(spark):
    """Two metrics, a null label, windows that close one after the other, and a last one that stays open."""
    rows = spark.createDataFrame(
        [(0, 1, "a", 2), (0, 1, None, 5), (0, 30, "a", 1), (1, 1, "b", 0), (1, 70, "a", 4), (2, 10_000, "a", 9)], "batch int, minute int, kind string, n int"
    ).withColumn("at", F.timestamp_seconds(F.col("minute") * 60))
    stream = in_batches(rows, F.col("batch"), 3)
    series = [("all", F.lit(True), {"kind": F.col("kind")}, F.col("n")), ("large", F.col("n") > 3, {}, F.lit(1))]
    out = drain(counters_stream(stream, series, window="1 hour", late="2 hours"))
    got = {(int(r["s"]) // 3600, r["metric"], *r["labels"].values()): r["count"] for r in out.withColumn("s", F.unix_timestamp("window_start")).collect()}
    assert got == {(0, "all", "a"): 3, (0, "all", None): 5, (0, "all", "b"): 0, (0, "large"): 1, (1, "all", "a"): 4, (1, "large"): 1}


def test_batches_of_many_files(spark):
    """Batches are cut into equally many files, small and empty ones too, and arrive one after the other."""
    rows_ = spark.range(0, 50).select("id", F.when(F.col("id") < 40, 0).when(F.col("id") < 43, 2).otherwise(3).alias("batch"))
    out = drain(in_batches(rows_, F.col("batch"), 4, rows_.limit(1).withColumn("id", F.lit(99).cast("long")), file_rows=10), "update")
    got = {b: sorted(r["id"] for r in out.filter(F.col("batch_id") == b).collect()) for b in range(5)}
    assert got == {0: list(range(40)), 1: [], 2: [40, 41, 42], 3: list(range(43, 50)), 4: [99]}


def test_keyed_state_by_bucket(spark):
    """Keys share a call: what is known of one survives another's coming and going, and there are far fewer calls than keys."""
    from lorekeep.streaming.processors import KEY_BUCKETS, bucket

    keys = spark.range(0, 5000).select("id", F.lit("k").alias("key"))
    assert keys.select(bucket("id", "key")).distinct().count() <= KEY_BUCKETS < 5000
    made = [(n, n % 2500, "k", f"outcome {n}", f"2024-01-01 00:{n // 2500:02d}:00") for n in range(5000)]
    requests = timed(spark.createDataFrame(made, "request_id long, owner long, key string, outcome string, at string"))
    out = drain(apply_once_stream(in_batches(requests, F.floor(F.col("request_id") / 2500), 2), 86_400), keyed=True)
    assert out.filter((F.col("replayed") != (F.col("request_id") >= 2500)) | (F.col("outcome") != F.concat(F.lit("outcome "), "owner"))).count() == 0 and out.count() == 5000


def test_outcomes_of_plain_columns_are_found_a_bucket_at_a_time(spark):
    """Ties, nulls, several lives of a key and odd types, against the form that takes one row at a time."""
    from lorekeep.streaming.processors import _plain_replies

    made = []
    for n in range(400):
        owner, key = [None, 1, 2, 2**60 + 1][n % 4], "ab"[n // 4 % 2]
        request = (n // 3 if n % 7 else None, f"r{n % 5}" if n % 11 else None, [0.5, None, -1.0][n % 3], f"2024-01-0{1 + n % 3}")
        made.append((request, owner, key, 2**61 + n if n % 13 else None, f"2024-01-01 {n * 7 % 400 // 60:02d}:{n * 7 % 60 // 5 * 5:02d}:00", n // 200))
    requests = timed(spark.createDataFrame(made, "request_id struct<a:long,b:string,c:double,d:string>, owner long, key string, outcome long, at string, batch int"))
    day = F.col("request_id").withField("d", F.col("request_id.d").cast("date")).withField("a", F.coalesce("request_id.a", F.col("batch").cast("long")))
    requests = requests.withColumn("request_id", day.withField("b", F.coalesce("request_id.b", F.lit("")))).withColumn("request_id", F.col("request_id").withField("c", F.coalesce("request_id.c", F.lit(0.0))))
    again = requests.withColumn("outcome", F.struct("outcome"))  # not plain: goes the other way
    feed = lambda df: in_batches(df, F.col("batch"), 2).drop("batch")
    stream = feed(requests)
    assert _plain_replies(stream.select("*", F.unix_micros("at").alias("us"), F.lit(0).alias("_bucket")), 60) is not None
    assert _plain_replies(feed(again).select("*", F.unix_micros("at").alias("us"), F.lit(0).alias("_bucket")), 60) is None
    got = drain(apply_once_stream(stream, 1800, late="1 day"), keyed=True)
    want = drain(apply_once_stream(feed(again), 1800, late="1 day"), keyed=True)
    assert got.schema == want.withColumn("outcome", F.col("outcome.outcome")).schema
    assert rows(got) == rows(want.withColumn("outcome", F.col("outcome.outcome"))) and got.count() == 400
    assert got.filter("NOT replayed").count() > 16  # keys begin anew


def test_null_fields_of_a_request_come_first_and_come_back(spark):
    made = [((2, None), 1, "k", "x", "2024-01-01 00:00:00"), ((None, None), 1, "k", "y", "2024-01-01 00:00:00"), (None, 1, "j", None, "2024-01-01 00:00:00"), ((None, "b"), 1, "j", "z", "2024-01-01 00:00:01")]
    requests = timed(spark.createDataFrame(made, "request_id struct<a:long,b:string>, owner long, key string, outcome string, at string"))
    out = drain(apply_once_stream(in_batches(requests, F.lit(0), 1), 3600), keyed=True).select("request_id", "outcome", "replayed")
    assert rows(out) == rows(spark.createDataFrame([((2, None), "y", True), ((None, None), "y", False), (None, None, False), ((None, "b"), None, True)], out.schema))
    with pytest.raises(Exception, match="a request needs a time"):
        drain(apply_once_stream(in_batches(requests.withColumn("at", F.lit(None).cast("timestamp")), F.lit(0), 1), 3600), keyed=True)


def test_an_empty_batch_takes_few_files(spark):
    rows_ = spark.range(0, 3000).select("id", F.lit(1).alias("batch"))
    stream = in_batches(rows_, F.col("batch"), 2, file_rows=1)
    out = drain(stream, "update")
    assert out.count() == 3000 and out.filter("batch_id = 1").count() == 3000
    assert len(spark.read.parquet(f"{out.inputFiles()[0].rsplit('/out/', 1)[0]}/out/batch_id=1").inputFiles()) <= 2 * spark.sparkContext.defaultParallelism
