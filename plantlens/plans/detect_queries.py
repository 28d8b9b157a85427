"""Queries over segments, scores, thresholds and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantlens import views
from plantlens.functions.cells import over_threshold
from plantlens.operators import long_streams, metrics, scores, segments as seg, thresholds, windows
from plantlens.plans.registry import query, r6
from plantlens.views import CHANNELS, table

P = 90.0
THR = "(select quantile_cont(value, 0.9) from ev where label = 0)"
THR_K = "(select quantile_cont(k, 0.9) from ev where label = 0)"
SEG = "select stream_id, run, min(seq) start_seq, max(seq) + 1 stop_seq, min(ts) start_ts, max(ts) end_ts, count(*) length, row_number() over (partition by stream_id order by min(seq)) - 1 segment_id from (select *, sum(st) over (partition by stream_id order by seq) run from (select *, case when label = coalesce(lag(label) over (partition by stream_id order by seq), -1) then 0 else 1 end st from ev)) where label = {l} group by 1, 2"
SEG1, SEG0 = SEG.format(l=1), SEG.format(l=0)
PRED = f"select *, case when value > {THR} then 1 else 0 end pred, case when k > {THR_K} then 1 else 0 end pred_k from ev"
RUNS = "select *, sum(st) over (partition by stream_id order by seq) run from (select *, case when label = coalesce(lag(label) over (partition by stream_id order by seq), -1) then 0 else 1 end st from p)"
ADJ = f"select *, case when label = 1 then max(pred) over (partition by stream_id, run) else pred end adjusted from ({RUNS})"
PRF = "case when tp + fp = 0 then 0 else tp / (tp + fp) end, 6) as precision, round(case when tp + fn = 0 then 0 else tp / (tp + fn) end, 6) recall, round(case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end, 6) f1"
CONF = "count(*) filter ({t} = 1 and {p} = 1) tp, count(*) filter ({t} = 0 and {p} = 1) fp, count(*) filter ({t} = 1 and {p} = 0) fn, count(*) filter ({t} = 0 and {p} = 0) tn"


def threshold(spark, d, column="value"):
    return thresholds.threshold_value(views.ev(spark, d), column, P, F.col("label") == 0)


def predicted(spark, d):
    made = views.ev(spark, d)
    return made.withColumn("pred", over_threshold("value", threshold(spark, d)).cast("int"))


@query(f"select stream_id, segment_id, start_seq, stop_seq, start_ts, end_ts, length from ({SEG1})", "ev")
def segments(spark, d):
    return seg.segments(views.ev(spark, d)).select("stream_id", "segment_id", "start_seq", "stop_seq", "start_ts", "end_ts", "length")


@query(f"select stream_id, start_seq, stop_seq, length from ({SEG1}) qualify row_number() over (partition by stream_id order by length desc, start_seq) = 1", "ev")
def longest_segment(spark, d):
    return seg.longest_segment(seg.segments(views.ev(spark, d)))


@query(f"select stream_id, start_seq, stop_seq from ({SEG0}) where length >= 10 qualify row_number() over (partition by stream_id order by start_seq) = 1", "ev")
def first_normal(spark, d):
    return seg.first_normal_range(views.ev(spark, d), 10)


@query(f"select g.stream_id, segment_id, count(*) n, min(seq) first_seq from ({SEG1}) g join ev e on e.stream_id = g.stream_id and e.seq >= greatest(start_seq - 9, 0) and e.seq < stop_seq group by 1, 2", "ev")
def segment_warmup(spark, d):
    ev = views.ev(spark, d)
    rows = seg.segment_rows(ev, seg.with_warmup(seg.segments(ev), 9))
    return rows.groupBy("stream_id", "segment_id").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@query(f"select stream_id, greatest((start_seq + stop_seq) // 2 - 5, 0) window_seq from ({SEG1}) qualify row_number() over (partition by stream_id order by length desc, start_seq) = 1", "ev")
def centre_window(spark, d):
    return seg.centre_window(seg.segments(views.ev(spark, d)), 10)


@query("with h as (select *, case when coalesce(epoch_us(ts) - epoch_us(lag(ts) over (partition by stream_id order by seq)) > 21600000000, true) then 1 else 0 end st from ev where label = 1), r as (select *, sum(st) over (partition by stream_id order by seq) run from h) select stream_id, min(ts) start_ts, max(ts) end_ts, count(*) n from r group by stream_id, run", "ev")
def gap_segments(spark, d):
    return seg.segments_by_gap(views.ev(spark, d), 6 * 3600)


_PEAKS = f"select g.stream_id, segment_id, start_seq, stop_seq, max(value) peak, first(e.seq order by value desc, e.seq) peak_seq from ({SEG1}) g join ev e on e.stream_id = g.stream_id and e.seq >= start_seq and e.seq < least(stop_seq, start_seq + 3) group by all"


@query(f"select stream_id, segment_id, round(peak, 6) peak, peak_seq, row_number() over (partition by stream_id order by peak desc, start_seq) rank from ({_PEAKS})", "ev")
def segment_rank(spark, d):
    ev = views.ev(spark, d)
    return seg.rank_segments(ev, seg.segments(ev), 3, score="value").select("stream_id", "segment_id", r6("peak").alias("peak"), "peak_seq", "rank")


@query(f"select stream_id, segment_id, start_seq, stop_seq, round(peak, 6) peak, peak_seq from ({_PEAKS}) qualify row_number() over (partition by stream_id order by peak desc, start_seq) = 1", "ev")
def best_segment(spark, d):
    ev = views.ev(spark, d)
    return seg.best_segment(ev, seg.segments(ev), 3, score="value").withColumn("peak", r6("peak"))


@query("with h as (select *, case when label = 1 and coalesce(lag(label) over (order by seq), 0) = 0 then 1 else 0 end st from one), r as (select *, sum(st) over (order by seq) - 1 segment_id from h), g as (select segment_id, min(seq) start_seq, max(seq) + 1 stop_seq from r where label = 1 group by 1) select segment_id, count(*) n, min(seq) first_seq, round(max(value), 6) peak, first(seq order by value desc, seq) peak_seq from g join one on seq >= greatest(start_seq - 29, 0) and seq < stop_seq group by 1", "one")
def long_segment_warmup(spark, d):
    """Segments of all events as one stream, with the 29 rows before them."""
    one = views.one(spark, d)
    rows = seg.segment_rows(one, seg.with_warmup(long_streams.segments(one, mode="bucketed"), 29))
    return rows.groupBy("segment_id").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), r6(F.max("value")).alias("peak"), F.min_by("seq", F.struct(-F.col("value"), F.col("seq"))).alias("peak_seq"))


_MEANS = "m as (select label l, pos, avg(x) a from (select label, generate_subscripts(embedding, 1) pos, unnest(embedding)::double x from embeddings) group by 1, 2), g as (select pos, avg(x) a from (select generate_subscripts(embedding, 1) pos, unnest(embedding)::double x from embeddings) group by 1), t as (select vec_id, label, generate_subscripts(embedding, 1) pos, unnest(embedding)::double x from embeddings), e as (select vec_id, t.pos, 0.5 * (m.a - x) * (m.a - x) + 0.5 * (g.a - x) * (g.a - x) err, (m.a - x) * (m.a - x) one from t join m on m.l = t.label and m.pos = t.pos join g on g.pos = t.pos)"


def reconstructed(spark, d):
    """Vectors with two reconstructions: the mean vector of their label and that of all."""
    emb = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    each = emb.select("label", F.posexplode("x").alias("pos", "v"))

    def mean(by):
        packed = each.groupBy(*by, "pos").agg(F.avg("v").alias("a")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "a"))).alias("s"))
        return packed.select(*by, F.transform("s", lambda s: s["a"]).alias("m"))

    own = mean(["label"]).withColumnRenamed("m", "x1")
    return emb.join(own, "label").crossJoin(F.broadcast(mean([]).withColumnRenamed("m", "x2")))


@query(f"with {_MEANS} select vec_id, round(avg(err), 6) score from e group by 1")
def dual_score(spark, d):
    return reconstructed(spark, d).select("vec_id", r6(scores.dual_score("x1", "x2", "x")).alias("score"))


@query(f"with {_MEANS} select vec_id, (pos - 1)::int pos, round(err, 6) error from e")
def feature_errors(spark, d):
    return reconstructed(spark, d).select("vec_id", F.posexplode(scores.feature_errors("x1", "x2", "x")).alias("pos", "error")).withColumn("error", r6("error"))


@query(f"with {_MEANS} select vec_id, (row_number() over w)::int as place, round(err, 6) error from e window w as (partition by vec_id order by err desc, pos) qualify row_number() over w <= 5")
def top_features(spark, d):
    made = reconstructed(spark, d).select("vec_id", scores.feature_errors("x1", "x2", "x").alias("errors"))
    top = made.select("vec_id", F.posexplode(scores.top_features("errors", None, 5)).alias("place", "f"))
    return top.select("vec_id", (F.col("place") + 1).alias("place"), r6("f.error").alias("error"))


@query(f"with {_MEANS} select vec_id, round(avg(one), 6) error from e group by 1")
def recon_error(spark, d):
    return reconstructed(spark, d).select("vec_id", r6(scores.recon_error("x", "x1")).alias("error"))


@query(f"select event_id, pred from ({PRED})", "ev")
def decide(spark, d):
    return predicted(spark, d).select("event_id", "pred")


@query("select event_id, round(0.7 * value + 0.3 * k, 6) score from ev", "ev")
def blend(spark, d):
    return views.ev(spark, d).select("event_id", r6(scores.blend("value", "k", 0.7, 0.3)).alias("score"))


_COS = "a as (select vec_id, list_transform(embedding, lambda x: x::double) v from embeddings), c as (select a.vec_id src, b.vec_id dst, list_cosine_similarity(a.v, b.v) c from a join a b on a.vec_id <> b.vec_id), g as (select * from c qualify row_number() over (partition by src order by c desc, dst) <= 5), w as (select src, dst, c, exp(c) / sum(exp(c)) over (partition by src) w from g)"


def graph(spark, d):
    return scores.topk_cosine_graph(table(spark, d, "embeddings"), 5)


@query(f"with {_COS} select src, dst, round(c, 6) cosine, round(w, 6) weight from w")
def cosine_topk(spark, d):
    """The graph of all vectors."""
    return graph(spark, d).select("src", "dst", r6("cosine").alias("cosine"), r6("weight").alias("weight"))


@query(f"with {_COS} select src, round(sum(w * label), 6) aggregate from w join embeddings e on e.vec_id = dst group by 1")
def neighbour_agg(spark, d):
    """Over the graph of all vectors."""
    return scores.aggregate_neighbours(graph(spark, d), table(spark, d, "embeddings"), "vec_id", "label").withColumn("aggregate", r6("aggregate"))


@query("select event_id, round(((value - m1) / (s1 + 1e-8) + (k - m2) / (s2 + 1e-8)) / 2, 6) score from ev, (select avg(value) m1, stddev_pop(value) s1, avg(k) m2, stddev_pop(k) s2 from ev)", "ev")
def ensemble(spark, d):
    return scores.ensemble(views.ev(spark, d).select("event_id", "value", "k"), ["value", "k"]).select("event_id", r6("score").alias("score"))


@query("select event_id, round(greatest((value - m1) / (s1 + 1e-8), (k - m2) / (s2 + 1e-8)), 6) score from ev, (select avg(value) m1, stddev_pop(value) s1, avg(k) m2, stddev_pop(k) s2 from ev where label = 0)", "ev")
def fuse_max(spark, d):
    return scores.fuse_max(views.ev(spark, d), "value", "k", F.col("label") == 0).select("event_id", r6("score").alias("score"))


@query(f"select event_id, greatest(pred, pred_k) pred from ({PRED})", "ev")
def fuse_or(spark, d):
    rows = views.ev(spark, d)
    a, b = over_threshold("value", threshold(spark, d)), over_threshold("k", threshold(spark, d, "k"))
    return rows.select("event_id", scores.fuse_or(a, b).alias("pred"))


@query(f"select round({THR}, 6) threshold", "ev")
def pct_threshold(spark, d):
    return spark.createDataFrame([(threshold(spark, d),)], "threshold double").select(r6("threshold").alias("threshold"))


_GRID = "grid as (select distinct t from (select unnest(quantile_cont(value, [" + ", ".join(repr(0.5 + (0.9995 - 0.5) * k / 199) for k in range(200)) + "])) t from ev))"
_F1 = f"with p as (select *, 0 pred from ev), r as ({RUNS}), s as (select max(value) v, count(*) n from r where label = 1 group by stream_id, run), {_GRID}, c as (select t, coalesce((select sum(n) from s where v > t), 0) tp, (select count(*) from ev where label = 0 and value > t) fp, (select count(*) from ev where label = 1) al from grid) select t, tp::bigint tp, fp, (al - tp)::bigint fn, 2 * tp / (2 * tp + fp + al - tp) f1 from c"


@query(f"select round(t, 6) threshold, tp, fp, fn, round(f1, 6) f1 from ({_F1}) order by f1 desc, t limit 1", "ev")
def best_f1(spark, d):
    best = thresholds.best_f1(views.ev(spark, d), "value")
    return best.select(r6("threshold").alias("threshold"), "tp", "fp", "fn", r6("f1").alias("f1"))


@query(f"with p as ({PRED}), f as (select {CONF.format(t='label', p='adjusted')} from ({ADJ})), c as (select * from ({_F1}) order by f1 desc, t limit 1) select 'best_f1' as mode, round(c.t, 6) threshold, c.tp tp, c.fp fp, c.fn fn, round(c.tp / (c.tp + c.fp), 6) as precision, round(c.tp / (c.tp + c.fn), 6) recall, round(c.f1, 6) f1, round(2 * f.tp / (2 * f.tp + f.fp + f.fn), 6) f1_fixed from c, f union all select 'fixed', round({THR}, 6), f.tp, f.fp, f.fn, round(f.tp / (f.tp + f.fp), 6), round(f.tp / (f.tp + f.fn), 6), round(2 * f.tp / (2 * f.tp + f.fp + f.fn), 6), round(2 * f.tp / (2 * f.tp + f.fp + f.fn), 6) from f", "ev")
def evaluate(spark, d):
    """Both threshold modes: point-adjusted counts, precision, recall and F1 at the best threshold of the grid and at the fixed percentile."""
    ev = views.ev(spark, d)
    both = [thresholds.evaluate(ev, "value", mode, P) for mode in ("best_f1", "fixed")]
    return both[0].unionByName(both[1]).select("mode", "tp", "fp", "fn", *(r6(c).alias(c) for c in ("threshold", "precision", "recall", "f1", "f1_fixed")))


def channel_runs(spark, d):
    from plantlens.operators import health

    long = health.long_frame(views.li(spark, d), CHANNELS)
    return health.unchanged_runs(long)


LONG_RUNS = "select *, row_number() over (partition by stream_id, feature, run order by seq) run_length from (select *, sum(st) over (partition by stream_id, feature order by seq) run from (select *, case when value = lag(value) over (partition by stream_id, feature order by seq) then 0 else 1 end st from (select li.stream_id, li.seq, li.ts, li.label, c.feature, c.pos, c.value from li, lateral (values " + ", ".join(f"('{c}', {k}, {c})" for k, c in enumerate(CHANNELS)) + ") c(feature, pos, value))))"


@query(f"with r as ({LONG_RUNS}) select t.t::int threshold, count(distinct feature) filter (run_length >= t) triggered, count(*) filter (run_length >= t) fp, round(count(*) filter (run_length >= t) / count(*), 6) fp_rate from r, (values (2), (3), (4), (5), (8)) t(t) where label = 0 group by 1", "li")
def fp_sweep(spark, d):
    return thresholds.fp_sweep(channel_runs(spark, d).filter("label = 0"), [2, 3, 4, 5, 8]).withColumn("fp_rate", r6("fp_rate"))


@query(f"select {CONF.format(t='label', p='pred')} from ({PRED})", "ev")
def confusion(spark, d):
    return metrics.confusion(predicted(spark, d))


@query(f"select event_type, tp, fp, fn, tn, round({PRF} from (select event_type, {CONF.format(t='label', p='pred')} from ({PRED}) group by 1)", "ev")
def prf(spark, d):
    made = metrics.prf(predicted(spark, d), by=["event_type"])
    return made.select("event_type", "tp", "fp", "fn", "tn", *(r6(c).alias(c) for c in ("precision", "recall", "f1")))


@query(f"select stream_id, round(case when fp + tn = 0 then 0 else fp / (fp + tn) end, 6) fpr from (select stream_id, {CONF.format(t='label', p='pred')} from ({PRED}) group by 1)", "ev")
def fpr(spark, d):
    return metrics.prf(predicted(spark, d), by=["stream_id"]).select("stream_id", r6("fpr").alias("fpr"))


@query(f"with p as ({PRED}) select event_id, adjusted from ({ADJ})", "ev")
def point_adjust(spark, d):
    return metrics.point_adjust(predicted(spark, d)).select("event_id", "adjusted")


@query(f"select tp, fp, fn, tn, round({PRF} from (select {CONF.format(t='label', p='pred')} from (select label, case when value > 100 then 1 else 0 end pred from ev))", "ev")
def score_metrics(spark, d):
    made = metrics.score_metrics(views.ev(spark, d), "value", 100.0)
    return made.select("tp", "fp", "fn", "tn", *(r6(c).alias(c) for c in ("precision", "recall", "f1")))


_CURVE = "c as (select value, count(*) filter (label = 1) pos, count(*) filter (label = 0) neg from ev group by 1), s as (select *, sum(pos) over w tp, sum(neg) over w fp, sum(pos) over () ap, sum(neg) over () an from c window w as (order by value desc rows unbounded preceding))"


@query(f"with {_CURVE} select round(sum(neg * (tp - pos) + 0.5 * pos * neg) / (max(ap)::double * max(an)), 6) roc_auc from s", "ev")
def roc_auc(spark, d):
    return metrics.auc(views.ev(spark, d), "value").select(r6("roc_auc").alias("roc_auc"))


@query(f"with {_CURVE} select round(sum(pos * tp / (tp + fp)) / max(ap), 6) average_precision from s", "ev")
def avg_precision(spark, d):
    return metrics.auc(views.ev(spark, d), "value").select(r6("average_precision").alias("average_precision"))


@query(f"with {_CURVE} select value threshold, round(fp / an, 6) fpr, round(tp / ap, 6) tpr from s", "ev")
def roc_curve(spark, d):
    return metrics.roc_curve(views.ev(spark, d), "value").select("threshold", r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


@query(f"with {_CURVE} select value threshold, round(tp / (tp + fp), 6) as precision, round(tp / ap, 6) recall from s", "ev")
def pr_curve(spark, d):
    return metrics.pr_curve(views.ev(spark, d), "value").select("threshold", r6("precision").alias("precision"), r6("recall").alias("recall"))


@query(f"with k as (select distinct event_type kind from events union all select 'unseen') select kind, round(avg(pred), 6) recall, count(pred) n from k left join ({PRED}) on event_type = kind group by 1", "ev")
def recall_by_kind(spark, d):
    kinds = table(spark, d, "events").select(F.col("event_type").alias("kind")).distinct().union(spark.range(1).select(F.lit("unseen")))
    return metrics.recall_by_kind(predicted(spark, d).withColumnRenamed("event_type", "kind"), kinds).withColumn("recall", r6("recall"))


_LADDER = f"p0 as (select stream_id, seq - 4 seq, max(label) over (partition by stream_id order by seq rows 4 preceding) label_any, label label_last, case when value > {THR} then 1 else 0 end pred from ev qualify seq >= 4)"


def _rung(name: str, truth: str, column: str) -> str:
    p = f"p as (select stream_id, seq, {truth} label, pred from p0)"
    return f"(with {p} select '{name}' protocol, tp, fp, fn, tn, round({PRF} from (select {CONF.format(t='label', p=column)} from ({ADJ})))"


LADDER = f"with {_LADDER} " + " union all ".join([_rung("any_adjusted", "label_any", "adjusted"), _rung("last_adjusted", "label_last", "adjusted"), _rung("last_pointwise", "label_last", "pred")])


@query(LADDER, "ev")
def protocol_ladder(spark, d):
    rows = predicted(spark, d)
    labels = windows.window_labels(rows, 5)
    scored = rows.filter("seq >= 4").select("stream_id", (F.col("seq") - 4).alias("seq"), "pred").join(labels.withColumnRenamed("window_id", "seq"), ["stream_id", "seq"])
    made = metrics.protocol_ladder(scored)
    return made.select("protocol", "tp", "fp", "fn", "tn", *(r6(c).alias(c) for c in ("precision", "recall", "f1")))


_HALF = "case when day(ts) <= 15 then 'first' else 'second' end"
_RESULTS = f"select model, dataset, tp / (tp + fp) p, 2 * tp / (2 * tp + fp + fn) f from (select 'value' model, {_HALF} dataset, {CONF.format(t='label', p='pred')} from ({PRED}) group by 2 union all select 'k', {_HALF}, {CONF.format(t='label', p='pred_k')} from ({PRED}) group by 2)"


def results(spark, d):
    """Precision and F1 of two models (value, k) on two datasets (halves of a month)."""
    rows = predicted(spark, d).withColumn("pred_k", over_threshold("k", threshold(spark, d, "k")).cast("int"))
    rows = rows.withColumn("dataset", F.when(F.dayofmonth("ts") <= 15, "first").otherwise("second"))
    parts = [metrics.prf(rows, "label", pred, by=["dataset"]).select(F.lit(model).alias("model"), "dataset", "precision", "f1") for model, pred in (("value", "pred"), ("k", "pred_k"))]
    return parts[0].unionByName(parts[1])


@query(f"select model, dataset, round(f, 6) f1 from ({_RESULTS}) order by f desc, model", "ev")
def leaderboard(spark, d):
    return metrics.leaderboard(results(spark, d), "f1").select("model", "dataset", r6("f1").alias("f1"))


@query(f"select model, round(max(f) filter (dataset = 'first'), 6) as first, round(max(f) filter (dataset = 'second'), 6) as second from ({_RESULTS}) group by 1", "ev")
def compare_pivot(spark, d):
    return metrics.compare(results(spark, d), ["first", "second"], "f1").select("model", r6("first").alias("first"), r6("second").alias("second"))


@query(f"select model, round(avg(f), 3) mean, round(stddev_samp(f), 3) std from ({_RESULTS}) group by 1", "ev")
def robustness(spark, d):
    return metrics.robustness(results(spark, d), "f1")


@query(f"select total, tp + fp anomalous, tp + fn attack, tp detected, fp false_positives, round(tp / (tp + fn), 6) recall, round(fp / (fp + tn), 6) fpr from (select count(*) total, {CONF.format(t='label', p='pred')} from ({PRED}))", "ev")
def run_summary(spark, d):
    return metrics.run_summary(predicted(spark, d)).withColumns({c: r6(c) for c in ("recall", "fpr")})


@query(f"select stream_id, seq, a::bigint attack, x::bigint detected, round(case when a = 0 then 0 else x / a end, 6) recall from (select stream_id, seq, sum(label) over w a, sum(label * pred) over w x from ({PRED}) window w as (partition by stream_id order by seq)) where (seq + 1) % 10 = 0", "ev")
def running_recall(spark, d):
    return metrics.running_recall(predicted(spark, d), 10).withColumn("recall", r6("recall"))


@query(f"select stream_id, seq, ts, case when pred = 1 then 'onset' else 'recovery' end transition from (select *, coalesce(lag(pred) over (partition by stream_id order by seq), 0) b from ({PRED})) where b <> pred", "ev")
def transitions(spark, d):
    return metrics.transitions(predicted(spark, d))


@query(f"with p as ({PRED}) select count(*) segments, sum(h)::bigint detected, round(sum(h) / count(*), 6) segment_recall from (select max(pred) h from ({RUNS}) where label = 1 group by stream_id, run)", "ev")
def segment_recall(spark, d):
    return metrics.segment_recall(predicted(spark, d)).withColumn("segment_recall", r6("segment_recall"))
