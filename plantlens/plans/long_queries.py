"""Queries over one single long stream, in the bucketed forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantlens import views
from plantlens.functions.cells import over_threshold
from plantlens.operators import health, long_streams as ls, scale, thresholds
from plantlens.plans.alert_queries import COLUMNS, INCIDENTS, _DATE, _FLAG, _IDN
from plantlens.plans.detect_queries import _F1, ADJ, LADDER, P, RUNS as LABEL_RUNS, SEG1, THR
from plantlens.plans.registry import query, r6

#: Rows of a bucket: small, so that the test tables have many of them.
BUCKET, MODE = 512, "bucketed"


def of_one(sql: str) -> str:
    """SQL over the many short streams, over the one long stream."""
    return sql.replace("from ev", "from one")


def threshold(spark, d):
    return thresholds.threshold_value(views.one(spark, d), "value", P, F.col("label") == 0)


def predicted(spark, d):
    return views.one(spark, d).withColumn("pred", over_threshold("value", threshold(spark, d)).cast("int"))


@query("select seq, event_id from one", "one")
def long_seq(spark, d):
    return views.one(spark, d).select("seq", "event_id")


@query(of_one(f"select segment_id, start_seq, stop_seq, start_ts, end_ts, length from ({SEG1})"), "one")
def long_segments(spark, d):
    return ls.segments(views.one(spark, d), mode=MODE, bucket=BUCKET).select("segment_id", "start_seq", "stop_seq", "start_ts", "end_ts", "length")


@query(of_one(f"with {_FLAG} select {', '.join(COLUMNS)} from ({INCIDENTS})"), "one")
def long_incidents(spark, d):
    return ls.incidents(views.one(spark, d), threshold(spark, d), "value", mode=MODE, bucket=BUCKET).select(*COLUMNS)


_PRED = f"select *, case when value > {THR} then 1 else 0 end pred from ev"


@query(of_one(f"with p as ({_PRED}) select event_id, adjusted from ({ADJ})"), "one")
def long_point_adjust(spark, d):
    return ls.point_adjust(predicted(spark, d), mode=MODE, bucket=BUCKET).select("event_id", "adjusted")


@query(of_one(f"select seq, ts, case when pred = 1 then 'onset' else 'recovery' end transition from (select *, coalesce(lag(pred) over (order by seq), 0) b from ({_PRED})) where b <> pred"), "one")
def long_transitions(spark, d):
    return ls.transitions(predicted(spark, d), mode=MODE, bucket=BUCKET).select("seq", "ts", "transition")


@query("select seq, case when label = 0 then case when rk > n - floor(n * 0.2) then 'val' else 'train' end end split from (select *, sum(1 - label) over (order by seq) rk, sum(1 - label) over () n from one)", "one")
def long_split(spark, d):
    return ls.temporal_split(views.one(spark, d), 0.2, mode=MODE, bucket=BUCKET).select("seq", "split")


@query("select seq - 29 window_id, max(label) over (order by seq rows 29 preceding) label_any, label label_last from one qualify seq >= 29", "one")
def long_window_labels(spark, d):
    return ls.window_labels(views.one(spark, d), 30, mode=MODE, bucket=BUCKET).select("window_id", "label_any", "label_last")


@query("with h as (select seq, case when seq % 7 <> 0 then value end v from one) select seq, round(coalesce(last_value(v ignore nulls) over (order by seq rows between unbounded preceding and current row), 0.0), 6) v from h", "one")
def long_ffill(spark, d):
    holed = views.one(spark, d).select("stream_id", "seq", F.when(F.col("seq") % 7 != 0, F.col("value")).alias("v"))
    return ls.ffill_zero(holed, ["v"], mode=MODE, bucket=BUCKET).select("seq", F.round("v", 6).alias("v"))


_RUNS = "select *, row_number() over (partition by run order by seq) run_length from (select *, sum(st) over (order by seq) run from (select *, case when k = lag(k) over (order by seq) then 0 else 1 end st from one))"


def runs(spark, d):
    return ls.unchanged_runs(health.long_frame(views.one(spark, d), ["k"]), mode=MODE, bucket=BUCKET)


@query(f"select seq, run_length from ({_RUNS})", "one")
def long_unchanged_runs(spark, d):
    return runs(spark, d).select("seq", "run_length")


@query(
    f"with s as ({_RUNS}), f as (select seq - run_length r, count(*) anomaly_count, min(seq) start_seq, max(seq) end_seq, min(ts) opened_at from s where run_length >= 3 group by 1), i as (select f.*, row_number() over (order by start_seq) n, l.ts closed_at from f left join one l on l.seq = f.end_seq + 1) "
    "select 'tfault-' || " + _IDN.format(n="n") + " || '-k-' || " + _DATE.format("opened_at") + " alert_id, anomaly_count, start_seq, end_seq, opened_at, closed_at, case when closed_at is null then 'OPEN' else 'CLOSED' end status from i",
    "one",
)
def long_fault_incidents(spark, d):
    made = ls.fault_incidents(health.stuck_channels(runs(spark, d), 3), views.one(spark, d).select("stream_id", "seq", "ts"), mode=MODE, bucket=BUCKET)
    return made.select("alert_id", "anomaly_count", "start_seq", "end_seq", "opened_at", "closed_at", "status")


@query(of_one(f"select round(t, 6) threshold, tp, fp, fn, round(f1, 6) f1 from ({_F1}) order by f1 desc, t limit 1"), "one")
def long_best_f1(spark, d):
    return ls.best_f1(views.one(spark, d), "value", mode=MODE, bucket=BUCKET).withColumns({"threshold": r6("threshold"), "f1": r6("f1")})


@query(of_one(LADDER), "one")
def long_protocol_ladder(spark, d):
    rows = predicted(spark, d)
    labels = ls.window_labels(rows, 5, mode=MODE, bucket=BUCKET)
    scored = rows.filter("seq >= 4").select("stream_id", (F.col("seq") - 4).alias("seq"), "pred").join(labels.withColumnRenamed("window_id", "seq"), ["stream_id", "seq"])
    made = ls.protocol_ladder(scored, mode=MODE, bucket=BUCKET)
    return made.select("protocol", "tp", "fp", "fn", "tn", *(r6(c).alias(c) for c in ("precision", "recall", "f1")))


@query(of_one(f"select seq, a::bigint attack, x::bigint detected, round(case when a = 0 then 0 else x / a end, 6) recall from (select seq, sum(label) over w a, sum(label * pred) over w x from ({_PRED}) window w as (order by seq)) where (seq + 1) % 10 = 0"), "one")
def long_running_recall(spark, d):
    return ls.running_recall(predicted(spark, d), 10, mode=MODE, bucket=BUCKET).select("seq", "attack", "detected", r6("recall").alias("recall"))


@query(of_one(f"with p as ({_PRED}) select count(*) segments, sum(h)::bigint detected, round(sum(h) / count(*), 6) segment_recall from (select max(pred) h from ({LABEL_RUNS}) where label = 1 group by run)"), "one")
def long_segment_recall(spark, d):
    return ls.segment_recall(predicted(spark, d), mode=MODE, bucket=BUCKET).withColumn("segment_recall", r6("segment_recall"))


@query("with h as (select *, case when coalesce(epoch_us(ts) - epoch_us(lag(ts) over (order by seq)) > 3600000000, true) then 1 else 0 end st from one where label = 1), r as (select *, sum(st) over (order by seq) run from h) select min(ts) start_ts, max(ts) end_ts, count(*) n from r group by run", "one")
def long_gap_segments(spark, d):
    return ls.segments_by_gap(views.one(spark, d), 3600, mode=MODE, bucket=BUCKET).drop("stream_id")


@query("select seq - 4 window_id, ['25.0', '0.0', 'none'][min(case k when 25 then 1 when 0 then 2 else 3 end) over (order by seq rows 4 preceding)] kind from one qualify seq >= 4", "one")
def long_window_kind(spark, d):
    rows = views.one(spark, d).withColumn("kind", F.col("k").cast("string"))
    return ls.window_kind(rows, "kind", ["25.0", "0.0"], 5, mode=MODE, bucket=BUCKET).drop("stream_id")


@query("select (seq - 29) // 3 window_id, first_value(ts) over (order by seq rows 29 preceding) window_start, ts window_end from one qualify seq >= 29 and (seq - 29) % 3 = 0", "one")
def long_window_bounds(spark, d):
    return ls.window_bounds(views.one(spark, d), 30, 3, mode=MODE, bucket=BUCKET).drop("stream_id")


@query("with w as (select unnest(range(10)) t, unnest(list(value) over (order by seq rows 9 preceding)) as value from one qualify seq >= 9) select t::int t, round(min(value), 6) low, round(max(value), 6) high from w group by 1", "one")
def long_mm_params(spark, d):
    return scale.fit_minmax_windows(views.one(spark, d), ["value"], 10).select(F.col("t").cast("int").alias("t"), r6("low").alias("low"), r6("high").alias("high"))


@query(
    of_one(f"with {_FLAG}, s as (")
    + _RUNS
    + of_one(f"), fi as (select min(ts) opened_at, row_number() over (order by min(seq)) open_seq from s where run_length >= 3 group by seq - run_length), a as (select opened_at, 'PROCESS_ANOMALY' category, open_seq from ({INCIDENTS}) union all select opened_at, 'TELEMETRY_FAULT', open_seq from fi) select category, open_seq::bigint open_seq, row_number() over (order by opened_at, category, open_seq) history_seq from a"),
    "one",
)
def long_alert_history(spark, d):
    one = views.one(spark, d)
    ml = ls.incidents(one, threshold(spark, d), "value", mode=MODE, bucket=BUCKET)
    faults = ls.fault_incidents(health.stuck_channels(runs(spark, d), 3), one.select("stream_id", "seq", "ts"), mode=MODE, bucket=BUCKET)
    return ls.alert_history(ml, faults, mode=MODE).select("category", F.col("open_seq").cast("long").alias("open_seq"), "history_seq")
