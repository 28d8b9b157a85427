"""Queries over channel health, incidents, alerts and modalities."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantlens import views
from plantlens.functions.cells import classify_channel, severity as severity_of
from plantlens.operators import alerts as al, fusion, health as hl, incidents as inc
from plantlens.operators.quantiles import exact_quantiles
from plantlens.plans.detect_queries import LONG_RUNS, THR, channel_runs, predicted, threshold
from plantlens.plans.registry import query, r6
from plantlens.views import CHANNELS, table

STUCK_AT = 3
WATCHED = ["FIT101", "LIT101", "AIT201", "PIT501"]
_CONT = "feature in ('FIT101', 'LIT101', 'AIT201', 'PIT501')"
STUCK = f"select stream_id, seq, ts, feature channel, pos, run_length, value from ({LONG_RUNS}) where {_CONT} and run_length >= {STUCK_AT}"
_DATE = "strftime({}, '%Y-%m-%d %H:%M:%S')"
_IDN = "case when {n} < 10000 then lpad({n}::varchar, 4, '0') else {n}::varchar end"
_FLAG = f"f as (select stream_id, seq, ts, value, case when value > {THR} then 1 else 0 end hit from ev), g as (select *, sum(case when hit = 1 and coalesce(lh, 0) = 0 then 1 else 0 end) over (partition by stream_id order by seq) open_seq, lead(ts) over (partition by stream_id order by seq) nx from (select *, lag(hit) over (partition by stream_id order by seq) lh from f))"
INCIDENTS = (
    "select stream_id, 'alert-' || " + _IDN.format(n="open_seq") + " || '-' || " + _DATE.format("min(ts)") + " alert_id, open_seq::bigint open_seq, 'PROCESS_ANOMALY' category, case when max(last) = max(seq) then 'OPEN' else 'CLOSED' end status, "
    f"case when max(value) / {THR} >= 10 then 'HIGH' when max(value) / {THR} >= 2 then 'MEDIUM' else 'LOW' end severity, max(value) anomaly_score, count(*) anomaly_count, min(seq) start_seq, max(seq) end_seq, min(ts) opened_at, max(ts) window_end, "
    "case when max(last) = max(seq) then null else arg_max(nx, seq) end closed_at from (select *, max(seq) over (partition by stream_id) last from g) where hit = 1 group by stream_id, open_seq"
)


def ml(spark, d):
    return inc.incidents(views.ev(spark, d), threshold(spark, d), "value")


def watched_runs(spark, d):
    return hl.unchanged_runs(hl.long_frame(views.li(spark, d), WATCHED))


def stuck_rows(spark, d):
    return hl.stuck_channels(watched_runs(spark, d), STUCK_AT, 5.0)


def verdicts(spark, d):
    return hl.health(watched_runs(spark, d), STUCK_AT, 5.0)


def faults(spark, d):
    return inc.fault_incidents(stuck_rows(spark, d), views.li(spark, d).select("stream_id", "seq", "ts"))


@query("select event_id, case when regexp_extract(tag, '^[A-Za-z]+') in ('FIT', 'LIT', 'AIT', 'DPIT', 'PIT') then 'continuous' when regexp_extract(tag, '^[A-Za-z]+') in ('MV', 'P', 'UV') then 'discrete' else 'unknown' end kind from (select event_id, ['FIT', 'DPIT', 'MV', 'P', 'UV', 'XX', ''][(event_id % 7)::int + 1] || (event_id % 900)::varchar tag from events)")
def classify(spark, d):
    tags = F.concat(F.get(F.array(*map(F.lit, ["FIT", "DPIT", "MV", "P", "UV", "XX", ""])), (F.col("event_id") % 7).cast("int")), (F.col("event_id") % 900).cast("string"))
    return table(spark, d, "events").select("event_id", classify_channel(tags).alias("kind"))


@query(f"select feature channel, count(*) n from ({LONG_RUNS}) where {_CONT} group by 1", "li")
def monitored(spark, d):
    return hl.long_frame(views.li(spark, d), hl.monitored(CHANNELS)).groupBy("channel").agg(F.count("*").alias("n"))


@query(f"select stream_id, feature channel, seq, run_length from ({LONG_RUNS})", "li")
def unchanged_runs(spark, d):
    return channel_runs(spark, d).select("stream_id", "channel", "seq", "run_length")


@query(f"select stream_id, channel, seq, run_length, (run_length - 1) * 5.0::double staleness_seconds, value from ({STUCK})", "li")
def stuck(spark, d):
    return stuck_rows(spark, d).select("stream_id", "channel", "seq", "run_length", "staleness_seconds", "value")


_HEALTH = f"select l.stream_id, l.seq, l.ts, l.seq + 1 n_seen, count(channel) = 0 healthy, case when count(channel) > 0 then 'TELEMETRY_FAULT' end fault_type, string_agg(channel || ' unchanged for ' || run_length || ' samples', '; ' order by pos) reason from li l left join ({STUCK}) s on s.stream_id = l.stream_id and s.seq = l.seq group by 1, 2, 3"


@query(_HEALTH, "li")
def health(spark, d):
    return verdicts(spark, d).select("stream_id", "seq", "ts", "n_seen", "healthy", "fault_type", "reason")


@query(
    "with s as (" + STUCK + """), e as (select stream_id, seq, '[' || string_agg('{"pos":' || pos || ',"feature":"' || channel || '","unchanged_samples":' || run_length || ',"staleness_seconds":' || (run_length - 1) * 5 || '.0,"last_value":' || value::double || '}', ',' order by pos) || ']' stuck, string_agg(channel || ' unchanged for ' || run_length || ' samples', '; ' order by pos) reason from s group by 1, 2)
    select l.stream_id, l.seq, '{"healthy":' || (stuck is null)::varchar || ',"n_seen":' || (l.seq + 1) || case when stuck is null then '' else ',"fault_type":"TELEMETRY_FAULT","reason":"' || reason || '"' end || ',"stuck_channels":' || coalesce(stuck, '[]') || '}' payload from li l left join e on e.stream_id = l.stream_id and e.seq = l.seq""",
    "li",
)
def health_json(spark, d):
    return hl.health_payload(verdicts(spark, d)).select("stream_id", "seq", "payload")


@query(f"select w.stream_id, w.seq, round(w.LIT101, 6) score, h.healthy, h.fault_type from li w join ({_HEALTH}) h on h.stream_id = w.stream_id and h.seq = w.seq where w.seq >= 9", "li")
def attach_health(spark, d):
    scored = views.li(spark, d).filter("seq >= 9").select("stream_id", "seq", r6("LIT101").alias("score"))
    return hl.attach_health(scored, verdicts(spark, d)).select("stream_id", "seq", "score", "healthy", "fault_type")


@query(f"select case when feature = 'MV101' then 'discrete' else 'continuous' end kind, feature channel, max(run_length) longest from ({LONG_RUNS}) where label = 0 group by 1, 2", "li")
def longest_const(spark, d):
    return hl.longest_constant_run(channel_runs(spark, d).filter("label = 0"))


COLUMNS = ["stream_id", "alert_id", "open_seq", "status", "severity", "anomaly_score", "anomaly_count", "start_seq", "end_seq", "opened_at", "window_end", "closed_at"]


@query(f"with {_FLAG} select {', '.join(COLUMNS)} from ({INCIDENTS})", "ev")
def incidents(spark, d):
    return ml(spark, d).select(*COLUMNS)


@query(f"with {_FLAG} select stream_id, open_seq::bigint open_seq, arg_max(seq, value) peak_seq, max(value) peak from g where hit = 1 group by 1, 2", "ev")
def incident_peak(spark, d):
    rows = views.ev(spark, d)
    made = inc.incidents(rows, threshold(spark, d), "value", top="seq")
    return made.select("stream_id", "open_seq", F.col("top_features").alias("peak_seq"), F.col("anomaly_score").alias("peak"))


@query(f"select event_id, case when value / ({THR} / 4) >= 10 then 'HIGH' when value / ({THR} / 4) >= 2 then 'MEDIUM' else 'LOW' end severity from ev", "ev")
def severity(spark, d):
    return views.ev(spark, d).select("event_id", severity_of("value", threshold(spark, d) / 4).alias("severity"))


@query(f"with {_FLAG} select stream_id, alert_id from ({INCIDENTS})", "ev")
def incident_ids(spark, d):
    return ml(spark, d).select("stream_id", "alert_id")


@query(f"with {_FLAG} select stream_id, alert_id, opened_at, window_end, closed_at from ({INCIDENTS})", "ev")
def incident_times(spark, d):
    return ml(spark, d).select("stream_id", "alert_id", "opened_at", "window_end", "closed_at")


_FAULTS = f"fr as (select *, sum(case when coalesce(pl = seq - 1, false) then 0 else 1 end) over (partition by stream_id, channel order by seq) r from (select *, lag(seq) over (partition by stream_id, channel order by seq) pl from ({STUCK}))), fa as (select stream_id, channel, pos, count(*) anomaly_count, min(seq) start_seq, max(seq) end_seq, min(ts) opened_at from fr group by stream_id, channel, pos, r), fi as (select fa.*, row_number() over (partition by fa.stream_id order by start_seq, pos) open_seq, l.ts closed_at from fa left join li l on l.stream_id = fa.stream_id and l.seq = fa.end_seq + 1)"


@query(f"with {_FAULTS} select stream_id, 'tfault-' || " + _IDN.format(n="open_seq") + " || '-' || channel || '-' || " + _DATE.format("opened_at") + " alert_id, channel, anomaly_count, start_seq, end_seq, opened_at, closed_at, case when closed_at is null then 'OPEN' else 'CLOSED' end status, 'MEDIUM' severity from fi", "li")
def fault_incidents(spark, d):
    return faults(spark, d).select("stream_id", "alert_id", "channel", "anomaly_count", "start_seq", "end_seq", "opened_at", "closed_at", "status", "severity")


@query(f"select healthy, count(*) n from ({_HEALTH}) group by 1", "li")
def validate_health(spark, d):
    good, bad = inc.validate_health(verdicts(spark, d), quarantine=True)
    return good.groupBy("healthy").agg(F.count("*").alias("n")).unionByName(bad.groupBy(F.lit(None).cast("boolean").alias("healthy")).agg(F.count("*").alias("n")))


@query(f"with {_FLAG}, {_FAULTS}, a as (select stream_id, opened_at, 'PROCESS_ANOMALY' category, open_seq from ({INCIDENTS}) union all select stream_id, opened_at, 'TELEMETRY_FAULT', open_seq from fi) select stream_id, category, open_seq::bigint open_seq, row_number() over (partition by stream_id order by opened_at, category, open_seq) history_seq from a", "ev li")
def alert_history(spark, d):
    made = inc.alert_history(ml(spark, d), faults(spark, d))
    return made.select("stream_id", "category", F.col("open_seq").cast("long").alias("open_seq"), "history_seq")


@query(f"with {_FLAG} select stream_id, alert_id from ({INCIDENTS}) where status = 'CLOSED' order by opened_at, stream_id, open_seq, alert_id limit 100", "ev")
def query_alerts(spark, d):
    return al.query_alerts(ml(spark, d), inc.ML, inc.CLOSED, 100).select("stream_id", "alert_id")


@query(f"with {_FLAG} select stream_id, alert_id from ({INCIDENTS}) order by opened_at desc, stream_id, open_seq desc, alert_id limit 50", "ev")
def list_alerts(spark, d):
    return al.list_alerts(ml(spark, d), "process_anomaly").select("stream_id", "alert_id")


@query(f"with {_FLAG} select stream_id, alert_id from ({INCIDENTS}) where status = 'OPEN'", "ev")
def active(spark, d):
    return al.active(ml(spark, d)).select("stream_id", "alert_id")


@query(f"with {_FLAG}, i as ({INCIDENTS}), l as (select stream_id, arg_max(value, seq) last_score, arg_max(hit, seq) last_pred from f group by 1) select l.*, count(alert_id) total_alerts, count(*) filter (status = 'OPEN') active_alerts from l left join i using (stream_id) group by all", "ev")
def status(spark, d):
    return al.status(predicted(spark, d), ml(spark, d), score="value").select("stream_id", "last_score", "last_pred", "total_alerts", "active_alerts")


@query(f"with {_FLAG} select stream_id, '[' || severity || '] anomaly ' || alert_id subject, 'severity: ' || severity || chr(10) || 'opened: ' || {_DATE.format('opened_at')} || chr(10) || 'windows: ' || anomaly_count body from ({INCIDENTS})", "ev")
def notifications(spark, d):
    return inc.notifications(inc.alert_history(ml(spark, d), faults(spark, d))).select("stream_id", "subject", "body")


_STAMP = "strftime({}, '%Y-%m-%dT%H:%M:%S.') || lpad((millisecond({}) % 1000)::varchar, 3, '0')"


@query(
    f"""with {_FLAG}, i as ({INCIDENTS}) select alert_id, '{{"stream_id":' || stream_id || ',"alert_id":"' || alert_id || '","open_seq":' || open_seq || ',"category":"PROCESS_ANOMALY","status":"' || status || '","severity":"' || severity || '","anomaly_score":' || anomaly_score || ',"anomaly_count":' || anomaly_count || ',"start_seq":' || start_seq || ',"end_seq":' || end_seq
    || ',"opened_at":"' || {_STAMP.format('opened_at', 'opened_at')} || '","window_end":"' || {_STAMP.format('window_end', 'window_end')} || '"' || case when closed_at is null then '' else ',"closed_at":"' || {_STAMP.format('closed_at', 'closed_at')} || '"' end || '}}' payload from i""",
    "ev",
)
def alert_json(spark, d):
    return inc.to_json_rows(ml(spark, d).drop("threshold", "window_start"))


@query(f"with {_FLAG} select stream_id, alert_id, open_seq, case when stream_id % 2 = 0 then 'ACKED' else status end status from ({INCIDENTS})", "ev")
def alert_upsert(spark, d):
    existing = ml(spark, d).select("stream_id", "alert_id", "open_seq", "status", F.lit(1).alias("version"))
    delta = existing.filter("stream_id % 2 = 0").withColumns({"status": F.lit("ACKED"), "version": F.lit(2), "open_seq": F.col("open_seq") + 1000})
    return al.upsert_alerts(existing, delta).select("stream_id", "alert_id", "open_seq", "status")


@query("select ts, ln, round(lq, 4) lq, o_n, round(op, 4) op from day", "day")
def align(spark, d):
    return views.day(spark, d).select("ts", "ln", F.round("lq", 4).alias("lq"), "o_n", F.round("op", 4).alias("op"))


@query("with e as (select *, date_trunc('hour', ts) interval_, (epoch_us(ts) - epoch_us(lag(ts) over (partition by date_trunc('hour', ts) order by ts, event_id))) / 1e6 gap, cast(regexp_extract(props, '([0-9]+)', 1) as int) k from events) select interval_ as interval, count(*) pkt_count, round(sum(value), 4) byte_count, round(count(*) / 3600, 6) pkt_rate, round(avg(gap), 4) mean_iat, round(stddev_pop(gap), 4) std_iat, count(distinct user_id) n_src, count(distinct event_type) n_dst, count(distinct (user_id, event_type)) n_conn, count(distinct k) n_dst_ports, count(*) filter (k in (1, 2, 3, 5, 8)) n_ics, count(*) filter (k is null or k not in (1, 2, 3, 5, 8)) n_other from e group by 1")
def interval_features(spark, d):
    events = table(spark, d, "events").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
    made = fusion.interval_features(events, port="k", ics_ports=(1, 2, 3, 5, 8))
    return made.withColumns({"byte_count": F.round("byte_count", 4), "pkt_rate": r6("pkt_rate"), "mean_iat": F.round("mean_iat", 4), "std_iat": F.round("std_iat", 4)})


_DAYS = """t as (select *, case when o_n >= (select quantile_cont(o_n, 0.9) from day) then 1 else 0 end label, case when o_n < (select quantile_cont(o_n, 0.9) from day) then 'none' when lq >= (select quantile_cont(lq, 0.5) from day) then 'exfiltration' else 'disruption' end kind from day),
    p as (select avg(lq) ml, stddev_pop(lq) + 1e-8 sl, avg(op) mo, stddev_pop(op) + 1e-8 so, quantile_cont(lq, 0.93) tl, quantile_cont(op, 0.93) tp from t where label = 0),
    b as (select 'process' branch, lq s, (lq > tl)::int pred, tl threshold, label, kind from t, p union all select 'network', op, (op > tp)::int, tp, label, kind from t, p union all select 'fused', greatest((lq - ml) / sl, (op - mo) / so), (lq > tl or op > tp)::int, null, label, kind from t, p),
    c as (select branch, s, count(*) filter (label = 1) pos, count(*) filter (label = 0) neg from b group by 1, 2),
    k as (select *, sum(pos) over w ctp, sum(neg) over w cfp, sum(pos) over (partition by branch) ap, sum(neg) over (partition by branch) an from c window w as (partition by branch order by s desc)),
    areas as (select branch, round(sum(neg * (ctp - pos) + 0.5 * pos * neg) / (max(ap) * max(an)), 6) roc_auc, round(sum(pos * ctp / (ctp + cfp)) / max(ap), 6) average_precision from k group by 1),
    n as (select branch, round(max(threshold), 4) threshold, count(*) filter (label = 1 and pred = 1) tp, count(*) filter (label = 0 and pred = 1) fp, count(*) filter (label = 1 and pred = 0) fn, count(*) filter (label = 0 and pred = 0) tn,
        round(avg(pred) filter (kind = 'exfiltration'), 6) recall_exfiltration, round(avg(pred) filter (kind = 'disruption'), 6) recall_disruption from b group by 1)"""


@query(f"with {_DAYS} select branch, threshold, tp, fp, fn, tn, round(case when tp + fp = 0 then 0 else tp / (tp + fp) end, 6) as precision, round(case when tp + fn = 0 then 0 else tp / (tp + fn) end, 6) recall, round(case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end, 6) f1, roc_auc, average_precision, recall_exfiltration, recall_disruption from n join areas using (branch)", "day")
def fusion_table(spark, d):
    """Two modalities and their fusion: areas, counts, rates at each one's threshold, and recall of each kind of attack."""
    days = views.day(spark, d)
    found = exact_quantiles(days, ["o_n", "lq"], [0.9, 0.5])
    busy = F.col("o_n") >= found["o_n"][0]
    kind = F.when(~busy, "none").when(F.col("lq") >= found["lq"][1], "exfiltration").otherwise("disruption")
    rows = days.withColumns({"label": busy.cast("int"), "kind": kind})
    made = fusion.branch_evaluation(rows, {"process": "lq", "network": "op"}, F.col("label") == 0, 93.0, kind="kind", kinds=["exfiltration", "disruption"])
    rates = ("precision", "recall", "f1", "roc_auc", "average_precision", "recall_exfiltration", "recall_disruption")
    return made.select("branch", F.round("threshold", 4).alias("threshold"), "tp", "fp", "fn", "tn", *(r6(c).alias(c) for c in rates))


@query("select e.event_id, b.n, round(b.v, 4) v from ev e asof left join evb b on e.ts >= b.ts", "ev evb")
def asof(spark, d):
    rows = views.ev(spark, d).select("event_id", "ts")
    return fusion.asof_attach(rows, views.evb(spark, d), ["n", "v"], ties=["event_id"]).select("event_id", "n", F.round("v", 4).alias("v"))

