"""Queries over scans, cleaning, profiles, splits, scalers and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantlens import views
from plantlens.functions.cells import normalise_label
from plantlens.operators import clean, frames, order, profile, scale, windows
from plantlens.plans.registry import query, r6
from plantlens.views import CHANNELS

RANGES = [("2024-01-03 00:00:00", "2024-01-05 12:00:00"), ("2024-01-10 00:00:00", "2024-01-10 23:59:59"), ("2024-01-20 06:00:00", "2024-01-22 18:00:00")]
W = 10
_RANGE_SQL = " or ".join(f"ts between timestamp '{a}' and timestamp '{b}'" for a, b in RANGES)
_LONG = ", ".join(f"('{c}', {k}, {c})" for k, c in enumerate(CHANNELS))
MELT = f"select li.*, c.feature, c.pos, c.value from li, lateral (values {_LONG}) c(feature, pos, value)"
HOLED = "select stream_id, seq, ts, label, " + ", ".join(f"case when seq % 7 = {k} then null else {c} end {c}" for k, c in enumerate(CHANNELS)) + " from li"


def holed(spark, d):
    """The long streams with a null in every seventh row of each channel."""
    return views.li(spark, d).select("stream_id", "seq", "ts", "label", *(F.when(F.col("seq") % 7 != k, F.col(c)).alias(c) for k, c in enumerate(CHANNELS)))


@query("select stream_id, seq, pos, value from (select * from (" + MELT + "))", "li")
def map_to_vector(spark, d):
    readings = F.create_map(*(x for c in reversed(CHANNELS) for x in (F.lit(c), F.col(c))))
    made = views.li(spark, d).select("stream_id", "seq", readings.alias("readings"))
    return made.select("stream_id", "seq", F.posexplode(clean.map_to_vector("readings", CHANNELS)).alias("pos", "value"))


@query("select event_id, case when replace(lower(trim(event_type)), ' ', '') like '%error%' then 1 else 0 end label from events")
def label_norm(spark, d):
    return views.table(spark, d, "events").select("event_id", normalise_label("event_type", "error").alias("label"))


@query(f"select event_id, case when {_RANGE_SQL} then 1 else 0 end label from events")
def label_ranges(spark, d):
    return clean.label_by_ranges(views.table(spark, d, "events").select("event_id", "ts"), RANGES).select("event_id", "label")


@query("select l_orderkey, l_linenumber, l_partkey, round(l_extendedprice, 6) price from lineitem order by l_orderkey, l_linenumber, l_partkey, l_extendedprice limit 1000")
def source_head(spark, d):
    rows = views.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    head = order.head_of_source(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], 1000)
    return head.select("l_orderkey", "l_linenumber", "l_partkey", r6("l_extendedprice").alias("price"))


@query("select stream_id, seq, ts, label from li", "li")
def merge_order(spark, d):
    rows = views.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("stream_id"), F.col("l_shipdate").alias("ts"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag")
    parts = [rows.filter(F.col("l_returnflag") == f) for f in "NAR"]
    merged = order.merge_sources(*parts, order=["ts", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"])
    return merged.select("stream_id", "seq", "ts", (F.col("source_rank") == 2).cast("int").alias("label"))


@query(
    "with bad as (select event_id % 5 stream_id, event_id seq, case when event_id % 97 = 0 then 'value' end a, case when event_id % 89 = 0 then 'user_id' end b from events), "
    "u as (select stream_id, seq, a feature from bad where a is not null union all select stream_id, seq, b from bad where b is not null) "
    "select feature, count(*) n_bad, min(struct_pack(stream_id := stream_id, seq := seq)).stream_id stream_id, min(struct_pack(stream_id := stream_id, seq := seq)).seq seq from u group by 1"
)
def nonfinite_scan(spark, d):
    rows = views.table(spark, d, "events").select(
        (F.col("event_id") % 5).alias("stream_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 97 == 0, float("nan")).otherwise(F.col("value")).alias("value"),
        F.when(F.col("event_id") % 89 != 0, F.col("user_id").cast("double")).alias("user_id"),
    )
    return clean.nonfinite_scan(rows, ["value", "user_id"])


@query(
    "select 'event_type' feature, count(*) n, count(*) filter (event_type is null) n_null, count(try_cast(event_type as double)) n_numeric from events union all "
    "select 'k', count(*), count(*) filter (k is null), count(try_cast(k as double)) from (select case when event_id % 10 <> 0 then regexp_extract(props, '([0-9]+)', 1) end k from events)"
)
def null_profile(spark, d):
    rows = views.table(spark, d, "events").select("event_type", F.when(F.col("event_id") % 10 != 0, F.regexp_extract("props", "([0-9]+)", 1)).alias("k"))
    return clean.null_profile(rows, ["event_type", "k"])


@query("select event_id, coalesce(event_type_code, -1)::int event_type_code from (select event_id, case when event_id % 10 = 0 then null else event_type end t from events) e left join (select event_type, dense_rank() over (order by event_type) - 1 event_type_code from (select distinct event_type from events where event_id % 10 <> 0)) c on t = c.event_type")
def cat_codes(spark, d):
    rows = views.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 10 != 0, F.col("event_type")).alias("event_type"))
    return clean.encode_categories(rows, ["event_type"]).select("event_id", F.col("event_type_code").cast("int").alias("event_type_code"))


@query("select event_id, date_trunc('second', ts - interval 8 hour) ts from events")
def clock_align(spark, d):
    return clean.align_clock(views.table(spark, d, "events").select("event_id", "ts"), 8)


@query(f"with h as ({HOLED}) select stream_id, seq, " + ", ".join(f"round(coalesce(last_value({c} ignore nulls) over w, 0.0), 6) {c}" for c in CHANNELS) + " from h window w as (partition by stream_id order by seq rows between unbounded preceding and current row)", "li")
def ffill(spark, d):
    return clean.ffill_zero(holed(spark, d), CHANNELS).select("stream_id", "seq", *(r6(c).alias(c) for c in CHANNELS))


@query(f"select feature, pos::int pos, round(stddev_samp(value), 6) std from ({MELT}) group by 1, 2", "li")
def feature_std(spark, d):
    return profile.feature_std(views.li(spark, d), CHANNELS).select("feature", "pos", r6("std").alias("std"))


@query(f"select feature, round(var_samp(value), 4) variance from ({MELT}) group by feature, pos order by var_samp(value) desc, pos limit 3", "li")
def top_var(spark, d):
    return profile.top_k_variance(views.li(spark, d), CHANNELS, 3).select("feature", F.round("variance", 4).alias("variance"))


@query("select stream_id, feature, min(value) as value from (select stream_id, c.feature, c.value from li, lateral (values ('FIT101', FIT101), ('AIT201', AIT201 * 0), ('MV101', case when seq % 50 = 0 then 'nan'::double else 1.0 end)) c(feature, value)) group by 1, 2 having min(value) = max(value)", "li")
def const_feats(spark, d):
    rows = views.li(spark, d).select("stream_id", "FIT101", (F.col("AIT201") * 0).alias("AIT201"), F.when(F.col("seq") % 50 == 0, float("nan")).otherwise(1.0).alias("MV101"))
    long = profile.melted(rows, ["FIT101", "AIT201", "MV101"], ["stream_id"])
    return long.groupBy("stream_id", "feature").agg(F.min("value").alias("value"), F.max("value").alias("high")).filter("value = high and not isnan(high)").drop("high")


@query("select stream_id, seq // 5 seq, ts, label from li where seq % 5 = 0", "li")
def subsample(spark, d):
    return order.subsample(views.li(spark, d), 5).select("stream_id", "seq", "ts", "label")


SPLIT = "select *, case when label = 0 then case when rk > n - floor(n * 0.2) then 'val' else 'train' end end split from (select *, sum(1 - label) over (partition by stream_id order by seq) rk, sum(1 - label) over (partition by stream_id) n from li)"


@query(f"with s as ({SPLIT}), m as (select feature, split, value from (select s.split, c.feature, c.value from s, lateral (values {_LONG}) c(feature, pos, value))) select feature, count(distinct value) filter (split = 'train') train, count(distinct value) filter (split = 'val') val from m group by 1", "li")
def frozen_report(spark, d):
    return profile.frozen_report(scale.temporal_split(views.li(spark, d), 0.2), CHANNELS)


@query("select stream_id, seq, event_id from ev", "ev")
def seq(spark, d):
    return views.ev(spark, d).select("stream_id", "seq", "event_id")


@query("select stream_id, count(*) n, round(avg(label), 6) base_rate from ev group by 1", "ev")
def base_rate(spark, d):
    return profile.base_rate(views.ev(spark, d), ["stream_id"]).withColumn("base_rate", r6("base_rate"))


@query("with e as (select *, case when label = 1 and coalesce(lag(label) over (partition by stream_id order by seq), 0) = 0 then 1 else 0 end st from ev), a as (select stream_id, count(*) n, avg(label) share, sum(st)::bigint segments from e group by 1) select stream_id, n, round(share, 6) share, segments, 2 features, case when share = 0 then 'no positive' when share > 0.9 then 'mostly positive' when segments < 2 then 'few segments' else 'ok' end warning from a", "ev")
def label_profile(spark, d):
    return profile.label_profile(views.ev(spark, d), 2).withColumn("share", r6("share"))


@query("with a as (select sum(c - 1)::bigint dup_rows, sum(case when c > 1 then nrm else 0 end) / sum(nrm) s from (select count(*) c, count(*) filter (label = 0) nrm from li group by AIT201, PIT501, MV101)), b as (select sum(c - 1)::bigint dup_times from (select count(*) c from li group by ts)) select dup_rows, dup_times, round(s, 6) dup_normal_share from a, b", "li")
def dup_profile(spark, d):
    return profile.duplicate_profile(views.li(spark, d), ["AIT201", "PIT501", "MV101"]).withColumn("dup_normal_share", r6("dup_normal_share"))


@query("select stream_id, seq, ts, label from li where seq >= 100 and seq < 110", "li")
def slice(spark, d):  # noqa: A001
    return order.slice_seq(views.li(spark, d), 100, 110).select("stream_id", "seq", "ts", "label")


@query("select event_type, count(*) n from events group by 1")
def value_counts(spark, d):
    return profile.value_counts(views.table(spark, d, "events"), "event_type")


@query(f"select stream_id, seq, split from ({SPLIT})", "li")
def split(spark, d):
    return scale.temporal_split(views.li(spark, d), 0.2).select("stream_id", "seq", "split")


_ANY = "select stream_id, seq - 9 window_id, max(label) over (partition by stream_id order by seq rows 9 preceding) label_any, label label_last from li qualify seq >= 9"


@query(f"with w as ({_ANY}), z as (select *, sum(1 - label_any) over (partition by stream_id order by window_id) rk, sum(1 - label_any) over (partition by stream_id) n from w) select stream_id, window_id, case when label_any = 0 then case when rk > n - floor(n * 0.2) then 'val' else 'train' end end split from z", "li")
def split_windows(spark, d):
    made = windows.window_labels(views.li(spark, d), W).withColumn("seq", F.col("window_id"))
    return scale.temporal_split(made, 0.2, label="label_any").select("stream_id", "window_id", "split")


def _train(spark, d):
    return views.li(spark, d).filter("label = 0")


_STD = f"select feature, pos, avg(value) mean, stddev_pop(value) std, case when stddev_pop(value) = 0 then 1.0 else stddev_pop(value) end as scale from ({MELT}) where label = 0 group by 1, 2"


@query(f"select feature, pos::int pos, round(mean, 6) mean, round(std, 6) std, round(scale, 6) as scale from ({_STD})", "li")
def std_params(spark, d):
    return scale.fit_standard(_train(spark, d), CHANNELS).select("feature", "pos", *(r6(c).alias(c) for c in ("mean", "std", "scale")))


@query(f"select stream_id, seq, m.feature, round((value - mean) / scale, 6) z from ({MELT}) m join ({_STD}) p on m.feature = p.feature", "li")
def std_apply(spark, d):
    made = scale.apply_standard(views.li(spark, d), scale.fit_standard(_train(spark, d), CHANNELS))
    return profile.melted(made, CHANNELS, ["stream_id", "seq"]).select("stream_id", "seq", "feature", r6("value").alias("z"))


_LISTS = ", ".join(f"list({c}) over w {c}" for c in [*CHANNELS, "label"])
_WIN = "select stream_id, seq - {w} + 1 window_id, unnest(range({w})) t, " + ", ".join(f"unnest({c}) {c}" for c in [*CHANNELS, "label"]) + f" from (select stream_id, seq, {_LISTS} from li window w as (partition by stream_id order by seq rows " + "{w} - 1 preceding)) where seq >= {w} - 1"
_MM = "select t, c.feature, c.pos, min(c.value) low, max(c.value) high from (" + _WIN.format(w=W) + f") w, lateral (values {_LONG}) c(feature, pos, value) group by 1, 2, 3"


@query(f"select t::int t, feature, pos::int pos, round(low, 6) low, round(high, 6) high, round(case when low = high then 1.0 else 1 / (high - low) end, 6) as scale from ({_MM})", "li")
def mm_params(spark, d):
    made = scale.fit_minmax_windows(views.li(spark, d), CHANNELS, W)
    return made.select(F.col("t").cast("int").alias("t"), "feature", "pos", *(r6(c).alias(c) for c in ("low", "high", "scale")))


def _scaled(spark, d):
    li = views.li(spark, d)
    flat = windows.flatten_window(windows.sliding_windows(li, CHANNELS, W))
    made = scale.apply_minmax(flat, scale.fit_minmax_windows(li, CHANNELS, W))
    return made.select("stream_id", "window_id", F.posexplode("flat").alias("i", "v"))


@query("with w as (" + _WIN.format(w=W) + f"), p as ({_MM}), v as (select stream_id, window_id, (w.t * 5 + c.pos)::int i, (c.value - low) * case when low = high then 1.0 else 1 / (high - low) end v from w, lateral (values {_LONG}) c(feature, pos, value), p where p.t = w.t and p.feature = c.feature) select stream_id, i, count(*) n, round(min(v), 6) low, round(max(v), 6) high, round(avg(v), 6) mean from v group by 1, 2", "li")
def mm_apply(spark, d):
    """All windows of all streams, scaled; summed up by stream and place in the window."""
    made = _scaled(spark, d).groupBy("stream_id", "i").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"))
    return made.select("stream_id", "i", "n", *(r6(c).alias(c) for c in ("low", "high", "mean")))


@query()
def mm_apply_all(spark, d):
    """All windows of all streams, flattened and scaled."""
    return _scaled(spark, d).withColumn("v", r6("v"))


@query("with s as (" + f"select stream_id, seq, feature, m.pos, (value - mean) / scale z from ({MELT}) m join ({_STD}) p using (feature)" + f"), b as (select s.feature, min(z::float::double) low, max(z::float::double) high from s group by 1) select stream_id, seq, feature, round((z::float::double - low) / (high - low), 4) v from s join b using (feature)", "li")
def preprocess(spark, d):
    """Standard scaling, the cast to float between the scalers, then min-max on windows of one sample: the whole chain as one plan."""
    li = views.li(spark, d)
    standard = scale.fit_standard(li.filter("label = 0"), CHANNELS)
    minmax = scale.fit_minmax_windows(scale.apply_standard(li, standard, "float"), CHANNELS, 1)
    made = windows.preprocess(li, CHANNELS, standard, minmax, 1)
    names = F.array(*map(F.lit, CHANNELS))
    return made.select("stream_id", F.col("window_id").alias("seq"), F.posexplode("flat").alias("i", "v")).select("stream_id", "seq", F.get(names, "i").alias("feature"), F.round("v", 4).alias("v"))


_Z = f"zl as (select stream_id, seq, label, " + ", ".join(f"(max(z) filter (feature = '{c}'))::float::double {c}" for c in CHANNELS) + f" from (select stream_id, seq, label, feature, (value - mean) / scale z from ({MELT}) m join ({_STD}) p using (feature)) group by 1, 2, 3)"
_ZWIN = _WIN.format(w=W).replace("from li window", "from zl window")


@query(f"with {_Z}, w as ({_ZWIN}), p as (select t, c.feature, min(c.value) low, max(c.value) high from w, lateral (values {_LONG}) c(feature, pos, value) group by 1, 2), v as (select stream_id, (w.t * 5 + c.pos)::int i, (c.value - low) * case when low = high then 1.0 else 1 / (high - low) end v from w, lateral (values {_LONG}) c(feature, pos, value), p where p.t = w.t and p.feature = c.feature) select stream_id, i, count(*) n, round(min(v), 4) low, round(max(v), 4) high, round(avg(v), 4) mean from v group by 1, 2", "li")
def preprocess_windows(spark, d):
    """The whole chain on all windows of ten samples: standard scaling, float between the scalers, windows, min-max; summed up by stream and place in the window."""
    li = views.li(spark, d)
    standard = scale.fit_standard(li.filter("label = 0"), CHANNELS)
    minmax = scale.fit_minmax_windows(scale.apply_standard(li, standard, "float"), CHANNELS, W)
    made = windows.preprocess(li, CHANNELS, standard, minmax, W).select("stream_id", F.posexplode("flat").alias("i", "v"))
    return made.groupBy("stream_id", "i").agg(F.count("*").alias("n"), *(F.round(f("v"), 4).alias(n) for n, f in (("low", F.min), ("high", F.max), ("mean", F.avg))))


@query("select event_id, round((value - m) / (s + 1e-8), 6) z from ev, (select avg(value) m, stddev_pop(value) s from ev where label = 0)", "ev")
def zscore(spark, d):
    return scale.zscore(views.ev(spark, d), "value", F.col("label") == 0).select("event_id", r6("z").alias("z"))


_LAGGED = "select stream_id, seq, split, " + ", ".join(f"abs({c} - lag({c}) over (partition by stream_id order by seq)) {c}" for c in CHANNELS) + f" from ({SPLIT})"
_ROBUST = "select " + ", ".join(f"quantile_cont({c}, 0.5) m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) + 1e-2 i_{c}" for c in CHANNELS) + " from e where split = 'train' and seq > 0"


def lagged(spark, d):
    """Deviation of each channel from a forecast (its row before)."""
    rows = scale.temporal_split(views.li(spark, d), 0.2)
    w = order.by_stream()
    return rows.select("stream_id", "seq", "split", *(F.abs(F.col(c) - F.lag(c).over(w)).alias(c) for c in CHANNELS)).filter("seq > 0")


@query(f"with e as ({_LAGGED}), p as ({_ROBUST}) select stream_id, seq, " + ", ".join(f"round(abs({c} - m_{c}) / i_{c}, 6) {c}" for c in CHANNELS) + " from e, p where seq > 0", "li")
def robust(spark, d):
    rows = lagged(spark, d)
    return scale.robust_scale(rows, CHANNELS, rows.filter("split = 'train'")).select("stream_id", "seq", *(r6(c).alias(c) for c in CHANNELS))


@query(f"with e as ({_LAGGED}), p as ({_ROBUST}) select stream_id, seq, round(greatest(" + ", ".join(f"abs({c} - m_{c}) / i_{c}" for c in CHANNELS) + "), 6) score from e, p where seq > 0", "li")
def forecast_score(spark, d):
    rows = lagged(spark, d)
    return scale.robust_scale(rows, CHANNELS, rows.filter("split = 'train'")).select("stream_id", "seq", r6(F.greatest(*CHANNELS)).alias("score"))


@query("with w as (" + _WIN.format(w=W) + ") select stream_id, (window_id // 3)::bigint window_id, (t)::int t, FIT101, LIT101, label from w where window_id % 3 = 0", "li")
def sliding(spark, d):
    made = windows.sliding_windows(views.li(spark, d), ["FIT101", "LIT101"], W, 3)
    each = made.select("stream_id", "window_id", F.posexplode(F.arrays_zip("values", "labels")).alias("t", "x"))
    return each.select("stream_id", "window_id", "t", F.col("x.values")[0].alias("FIT101"), F.col("x.values")[1].alias("LIT101"), F.col("x.labels").alias("label"))


@query(f"select stream_id, window_id, label_any from ({_ANY})", "li")
def label_any(spark, d):
    return windows.window_labels(views.li(spark, d), W).select("stream_id", "window_id", "label_any")


@query(f"select stream_id, window_id, label_last from ({_ANY})", "li")
def label_last(spark, d):
    return windows.window_labels(views.li(spark, d), W).select("stream_id", "window_id", "label_last")


@query(f"select sum(label_any)::bigint n_any, sum(label_last)::bigint n_last, sum(label_any - label_last)::bigint inflation from ({_ANY})", "li")
def label_inflation(spark, d):
    return windows.label_inflation(views.li(spark, d), W)


@query("select stream_id, seq - 4 window_id, ['error', 'purchase', 'click', 'none'][min(case event_type when 'error' then 1 when 'purchase' then 2 when 'click' then 3 else 4 end) over (partition by stream_id order by seq rows 4 preceding)] kind from ev qualify seq >= 4", "ev")
def window_kind(spark, d):
    return windows.window_kind(views.ev(spark, d), "event_type", ["error", "purchase", "click"], 5)


@query("select stream_id, seq - 9 window_id, first_value(ts) over (partition by stream_id order by seq rows 9 preceding) window_start, ts window_end from li qualify seq >= 9", "li")
def window_bounds(spark, d):
    return windows.window_bounds(views.li(spark, d), W)


@query("with w as (" + _WIN.format(w=W) + f") select stream_id, window_id, (t * 5 + c.pos)::int i, c.value v from w, lateral (values {_LONG}) c(feature, pos, value) where window_id % 10 = 0", "li")
def flatten(spark, d):
    made = windows.flatten_window(windows.sliding_windows(views.li(spark, d), CHANNELS, W, 10))
    return made.select("stream_id", (F.col("window_id") * 10).alias("window_id"), F.posexplode("flat").alias("i", "v"))


@query("select stream_id, seq, round(avg(LIT101) over w, 4) history_mean, first_value(LIT101) over w history_first, LIT101 target from li window w as (partition by stream_id order by seq rows between 9 preceding and 1 preceding) qualify seq >= 9", "li")
def hist_target(spark, d):
    return windows.history_target(views.li(spark, d), "LIT101", W).withColumn("history_mean", F.round("history_mean", 4))


_HELD = f"a as (select * from (select stream_id, seq, {_LISTS} from li window w as (partition by stream_id order by seq rows {W} - 1 preceding)) where seq >= {W} - 1 and (seq - {W} + 1) % 10 = 0)"
_HISTORY = " union all ".join(f"select stream_id, seq, '{c}' feature, unnest(range({W} - 1)) t, unnest({c}[1:{W} - 1]) as value, {c}[{W}] target from a" for c in CHANNELS)


@query(f"with {_HELD} select stream_id, ((seq - {W} + 1) // 10)::bigint window_id, t::int t, feature, value, target from ({_HISTORY})", "li")
def history_targets(spark, d):
    """History and target of all features, from windows that adjoin (stride 10), cut inside tasks."""
    made = windows.history_targets(frames.sliding_windows(views.li(spark, d), CHANNELS, W, 10))
    cells = made.select("stream_id", "window_id", F.posexplode("history").alias("t", "row"), "target")
    entries = F.array(*(F.struct(F.lit(c).alias("feature"), F.col("row")[k].alias("value"), F.col("target")[k].alias("target")) for k, c in enumerate(CHANNELS)))
    return cells.select("stream_id", "window_id", "t", F.inline(entries))


_KEPT = "n as (select *, lag(seq, 4) over w first_seq, row_number() over w - 5 place, sum(value) over (partition by stream_id order by seq rows 4 preceding) total, first_value(ts) over (partition by stream_id order by seq rows 4 preceding) window_start from ev where label = 0 window w as (partition by stream_id order by seq))"


@query(f"with {_KEPT} select stream_id, first_seq::bigint window_id, window_start, ts window_end, round(total, 4) total from n where seq - first_seq = 4", "ev")
def gap_windows(spark, d):
    """Windows of five samples of what is left without samples of label 1: none goes across a removed sample."""
    return _summed_windows(frames.sliding_windows(views.ev(spark, d).filter("label = 0"), ["value"], 5))


@query(f"with {_KEPT} select stream_id, place::bigint window_id, window_start, ts window_end, round(total, 4) total from n where place >= 0", "ev")
def straddling_windows(spark, d):
    """The same with windows across removed samples."""
    return _summed_windows(frames.sliding_windows(views.ev(spark, d).filter("label = 0"), ["value"], 5, contiguous=False))


@query("select (seq - 29)::bigint window_id, first_value(ts) over w window_start, ts window_end, round(sum(value) over w, 4) total from one window w as (order by seq rows 29 preceding) qualify seq >= 29", "one")
def long_windows(spark, d):
    """All windows of thirty samples of all events as one stream, as arrays cut in buckets."""
    return _summed_windows(frames.sliding_windows(views.one(spark, d), ["value"], 30, bucket=5000)).drop("stream_id")


def _summed_windows(made):
    total = F.aggregate(F.flatten("values"), F.lit(0.0), lambda s, x: s + x)
    return made.select("stream_id", "window_id", "window_start", "window_end", F.round(total, 4).alias("total"))
