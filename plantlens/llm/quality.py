"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each document gets a severity: the largest of its rule measures, each divided by the rule's scale. A document
is rejected if its severity exceeds its stratum's cutoff, which is a common factor on all scales. The cutoffs
come from labelled documents of good quality, held out from any fitting (nothing else here is fitted): going
from the most lenient factor to stricter ones, a factor is certified as long as the exact binomial test
rejects "more than `risk` of the stratum's good documents are lost" (fixed-sequence testing, so the steps of
a stratum need no correction; the level is divided by the number of strata). Any certified factor may then be
used; the one with the best difference of labelled junk and good documents rejected is taken, the most
lenient one on ties. In strata with too few labels for any certificate only the base rules reject, as no other
stratum's labels can bound the loss there.

Nulls are empty texts or, as a stratum, one of its own; empty texts have no words; texts of any length are
measured whole; rows are judged one by one, so repeated rows and ties get equal verdicts; empty tables give
empty results; labels that repeat a document count once, as junk if any of them says so. Input columns whose
names clash with the measures are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantlens.llm.common import settle, small

#: Characters that part words.
BREAKS = r"[\x20\x09-\x0D]"
#: Rules: measure and the scale that a factor of 1 stands for.
SCALES = {"symbol_share": 0.05, "shout_share": 0.25, "upper_share": 0.30, "dup_line_share": 0.45, "repeat_share": 0.45}
#: Factors tried, from lenient to strict.
FACTORS = (4.0, 3.0, 2.0, 1.75, 1.5, 1.4, 1.3, 1.2, 1.1, 1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)
#: Good documents of a stratum that may be lost, and the chance that any stratum's certificate is wrong.
RISK, ERROR = 0.02, 0.05
#: The base rule's bounds.
LEAST_WORDS, REPEAT_PERCENT = 50, 50

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, body) -> Column:
    """Bind a value once and use it many times in an expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Number of words in a 3-word window that occurs twice or more among `words`."""

    def covered(hashes: Column) -> Column:
        def starts(order: Column) -> Column:
            same = lambda e, k: F.coalesce((F.get(order, k - 1)["h"] == e["h"]) | (F.get(order, k + 1)["h"] == e["h"]), (F.get(order, k + 1)["h"] == e["h"]), F.lit(False))
            return F.array_sort(F.transform(F.filter(order, same), lambda e: e["at"]))

        ordered = F.array_sort(F.transform(hashes, lambda h, at: F.struct(h.alias("h"), at.alias("at"))))
        gain = lambda acc, at: F.struct(at.alias("last"), (acc["n"] + F.least(F.lit(3), at - acc["last"])).alias("n"))
        total = F.aggregate(let(ordered, starts), F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), gain, lambda acc: acc["n"])
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(total)

    def windows(w: Column) -> Column:
        hashed = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda k: F.xxhash64(F.get(w, k), F.get(w, k + 1), F.get(w, k + 2)))
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(hashed, covered))

    return let(words, windows)


def measure(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """The columns `keep`, the counts of MEASURES and the shares of SCALES, one row per input row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    marks = F.regexp_replace("_text", r"[^#*$%&|<>!\p{Lu}]+", "")
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    made = df.select(*keep, text.alias("_text")).select(
        *keep,
        let(F.filter(F.split("_text", BREAKS + "+"), lambda x: x != ""), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r"))).alias("_w"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"[^\x20\x09-\x0D]+", ""))).cast("long").alias("word_chars"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))).alias("_l"),
        marks.alias("_marks"),
    )
    made = made.select(
        *keep,
        F.col("_w.n").cast("long").alias("n_words"),
        "word_chars",
        F.length(F.regexp_replace("_marks", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_marks", "[^!]+", "")).alias("_shouts"),
        F.length(F.regexp_replace("_marks", r"[^\p{Lu}]+", "")).alias("_uppers"),
        (F.col("_l.n") - F.col("_l.d")).cast("long").alias("n_dup_lines"),
        F.col("_l.n").alias("_lines"),
        F.col("_w.r").cast("long").alias("n_repeat_words"),
    )
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return made.select(
        *keep,
        *MEASURES,
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("_shouts", "n_words").alias("shout_share"),
        share("_uppers", "word_chars").alias("upper_share"),
        share("n_dup_lines", "_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def severity() -> Column:
    return F.greatest(*(F.col(rule) / F.lit(scale) for rule, scale in SCALES.items()))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed term by term from logarithms; 1 where k is not below the mean."""
    import math

    odds = math.log(p / (1 - p))
    step = lambda acc, i: F.struct(
        (acc["t"] + F.log((n - i) / (i + 1)) + odds).alias("t"), (acc["s"] + F.exp(acc["t"])).alias("s")
    )
    start = F.struct((n * math.log(1 - p)).alias("t"), F.lit(0.0).alias("s"))
    total = F.aggregate(F.sequence(F.lit(0), k.cast("int")), start, step, lambda acc: acc["s"])
    return F.when(k < n * p, total).otherwise(F.lit(1.0))


def calibrate(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum_col: str = "lang", label_col: str = "quality", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Cutoffs from measured documents and labels (1 good, 0 junk).

    Returns stratum, n_good, n_junk, cutoff (null: no factor could be certified), a row for each stratum with labels.
    """
    known = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_good"))
    judged = measured.filter(~base_failed()).select(F.col(id_col).alias("_id"), F.col(stratum_col).cast("string").alias("stratum"), severity().alias("_v"))
    seen = judged.join(known, "_id").select("stratum", "_v", (F.col("_good") == 1).alias("_good"))
    counts = [F.count_if(F.col("_good")).alias("n_good"), F.count_if(~F.col("_good")).alias("n_junk")]
    for k, factor in enumerate(FACTORS):
        over = F.col("_v") > factor
        counts += [F.count_if(over & F.col("_good")).alias(f"good_{k}"), F.count_if(over & ~F.col("_good")).alias(f"junk_{k}")]
    cells = settle(seen.groupBy("stratum").agg(*counts))
    strata = max(1, cells.count())
    tried = F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f"good_{k}").alias("good"), F.col(f"junk_{k}").alias("junk")) for k, f in enumerate(FACTORS)))
    grid = cells.select("stratum", "n_good", "n_junk", F.inline(tried))
    ok = (F.col("n_good") > 0) & (binomial_tail(F.col("n_good"), F.col("good"), risk) <= error / strata)
    so_far = Window.partitionBy("stratum").orderBy(F.desc("factor"))
    grid = grid.withColumn("certified", F.min(ok).over(so_far))
    gain = F.col("junk") / F.greatest("n_junk", F.lit(1)) - F.col("good") / F.greatest("n_good", F.lit(1))
    best = F.max(F.when(F.col("certified"), F.struct(gain, F.col("factor"))))
    return grid.groupBy("stratum", "n_good", "n_junk").agg(best["factor"].alias("cutoff"))


def judge(measured: DataFrame, cutoffs: DataFrame, stratum_col: str = "lang") -> DataFrame:
    """Add base_failed and kept. The cutoffs, one row for each stratum, are broadcast if their counted size is small."""
    own = settle(cutoffs.filter(F.col("cutoff").isNotNull()).select(F.col("stratum").alias("_stratum"), F.col("cutoff").alias("_own")))
    found = measured.join(small(own, own.count(), 256), F.col(stratum_col).cast("string").eqNullSafe(F.col("_stratum")), "left")
    failed = base_failed()
    return found.withColumns({"base_failed": failed, "kept": ~failed & ~F.coalesce(severity() > F.col("_own"), F.lit(False))}).drop("_stratum", "_own")


#: DuckDB SQL of the whole operator over `documents` and `labels`; also used by the pipeline's tests.
ORACLE = f"""
with d as (
  select doc_id, lang, coalesce(text, '') as t,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ln
  from documents),
u as (select doc_id, w, unnest(range(1, len(w) - 1)) as pos from d where len(w) >= 3),
g as (select doc_id, pos, count(*) over (partition by doc_id, w[pos], w[pos + 1], w[pos + 2]) as n from u),
s as (select doc_id, pos, lag(pos) over (partition by doc_id order by pos) as prev from g where n > 1),
r as (select doc_id, sum(least(3, coalesce(pos - prev, 3))) as n from s group by 1),
m as (
  select d.doc_id, lang, len(w) as n_words,
         length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) as word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as n_symbols,
         length(regexp_replace(t, '[^!]+', '', 'g')) as shouts,
         length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) as uppers,
         len(ln) - len(list_distinct(ln)) as n_dup_lines, len(ln) as n_lines,
         coalesce(r.n, 0)::bigint as n_repeat_words
  from d left join r using (doc_id)),
f as (
  select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words as base_failed,
         greatest(n_symbols / greatest(word_chars, 1) / {SCALES["symbol_share"]}::double,
                  shouts / greatest(n_words, 1) / {SCALES["shout_share"]}::double,
                  uppers / greatest(word_chars, 1) / {SCALES["upper_share"]}::double,
                  n_dup_lines / greatest(n_lines, 1) / {SCALES["dup_line_share"]}::double,
                  n_repeat_words / greatest(n_words, 1) / {SCALES["repeat_share"]}::double) as v
  from m),
l as (select doc_id, min(quality) = 1 as good from labels where quality is not null group by 1),
seen as (select lang, v, good from f join l using (doc_id) where not base_failed),
st as (select lang, count(*) filter (good) as n_good, count(*) filter (not good) as n_junk from seen group by 1),
fs as (select unnest([{", ".join(f"{x}::double" for x in FACTORS)}]) as factor),
c as (
  select st.*, factor, (select count(*) from st) as strata,
         (select count(*) from seen where good and v > factor and seen.lang is not distinct from st.lang) as good,
         (select count(*) from seen where not good and v > factor and seen.lang is not distinct from st.lang) as junk
  from st cross join fs),
p as (
  select *, n_good > 0 and good < n_good * {RISK}::double and (
    select sum(exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln({RISK}::double) + (n_good - i) * ln(1 - {RISK}::double)))
    from range(0, good + 1) q(i)) <= {ERROR}::double / strata as ok
  from c),
k as (select *, bool_and(ok) over (partition by lang order by factor desc) as certified from p),
b as (
  select lang, first(factor order by junk / greatest(n_junk, 1) - good / greatest(n_good, 1) desc, factor desc) as cutoff
  from k where certified group by 1)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
       n_dup_lines::bigint as n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not coalesce(v > (select max(cutoff) from b where b.lang is not distinct from f.lang), false) as kept
from f
"""
