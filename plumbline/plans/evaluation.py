"""Queries that compare and calibrate systems: paired tables, selective curves, bootstraps, maps of the top probability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.catalog import query
from plumbline.functions import vectors as V
from plumbline.operators import calibrate as C
from plumbline.operators import predict as P
from plumbline.operators import resample as R
from plumbline.operators.predict import rounded
from plumbline.plans.corpus import UNIT
from plumbline.plans.decisions import PRED_SQL, WILSON, predictions, scored, sql
from plumbline.sources.readouts import READOUTS_SQL, readouts

#: The readouts without a temperature, scored as PRED_SQL scores those with one.
RAW = PRED_SQL + """,
rcum AS (SELECT *, sum(p) OVER (PARTITION BY item_id ORDER BY opt) AS cum FROM mean),
rscored AS (SELECT item_id, type, k, label, family, grp, max(p) AS conf, (arg_max(opt, (p, -opt)))::INT AS top, ((arg_max(opt, (p, -opt))) = label)::INT AS hit, least(floor(max(p) * 10), 9)::INT AS bin,
  -ln(greatest(max(CASE WHEN opt = label THEN p END), 1e-300)) AS nll, sum(power(p - CASE WHEN opt = label THEN 1 ELSE 0 END, 2)) AS brier FROM rcum GROUP BY item_id, type, k, label, family, grp)"""
SYSTEMS = RAW + ", sys AS (SELECT 'temperature' AS system, item_id, family, grp, conf, top, hit, bin, nll, brier FROM scored UNION ALL SELECT 'raw', item_id, family, grp, conf, top, hit, bin, nll, brier FROM rscored)"


def raw_predictions(spark, d) -> DataFrame:
    return P.rotation_mean(P.raw(readouts(spark, d)))


def systems(spark, d) -> DataFrame:
    """The items as two systems scored them. Rows of one system are rows of a table with a column for its name."""
    named = lambda rows, name: rows.select(F.lit(name).alias("system"), "item_id", "family", "grp", "conf", "top", "hit", "bin", "nll", "brier")
    return named(scored(spark, d), "temperature").unionByName(named(P.scored(raw_predictions(spark, d)), "raw"))


@query("paired_items", sql(RAW, "SELECT a.item_id, round(a.nll - b.nll, 6) AS nll, a.hit - b.hit AS hit FROM scored a JOIN rscored b USING (item_id)"))
def paired_items(spark, d):
    """Differences of two systems on the items that both answered."""
    a, b = scored(spark, d).select("item_id", "nll", "hit"), P.scored(raw_predictions(spark, d)).select("item_id", F.col("nll").alias("l"), F.col("hit").alias("h"))
    return a.join(b, "item_id").select("item_id", rounded(F.col("nll") - F.col("l")).alias("nll"), (F.col("hit") - F.col("h")).alias("hit"))


@query("dump_equivalence", sql(RAW, "SELECT coalesce(a.type, b.type) AS type, count(*) AS n, count(*) FILTER (a.item_id IS NULL OR b.item_id IS NULL) AS alone, round(max(abs(a.p - b.p)), 6) AS apart FROM pred a FULL JOIN (SELECT * FROM mean WHERE item_id % 11 <> 0) b ON a.item_id = b.item_id AND a.opt = b.opt GROUP BY 1"))
def dump_equivalence(spark, d):
    """Two tables of probabilities: rows that one of them lacks, and the largest difference of the others."""
    long = lambda rows, p: P.long(rows, ["item_id", "type"], "p", "opt", 15).withColumnsRenamed({"p": p, "type": f"type_{p}"})
    a, b = long(predictions(spark, d), "x"), long(raw_predictions(spark, d).where("item_id % 11 <> 0"), "y")
    both = a.join(b, ["item_id", "opt"], "full")
    return both.groupBy(F.coalesce("type_x", "type_y").alias("type")).agg(F.count("*").alias("n"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("alone"), rounded(F.max(F.abs(F.col("x") - F.col("y")))).alias("apart"))


MEANS = "count(*) AS n, round(avg(hit), 6) AS accuracy, round(avg(nll), 6) AS log_loss, round(avg(brier), 6) AS brier"


def means(frame, *by):
    return frame.groupBy(*by).agg(F.count("*").alias("n"), *[rounded(F.avg(c)).alias(n) for c, n in (("hit", "accuracy"), ("nll", "log_loss"), ("brier", "brier"))])


@query("compare_table", sql(SYSTEMS + f", m AS (SELECT system, family, {MEANS} FROM sys GROUP BY system, family)", "SELECT a.system, a.family, a.n, a.accuracy, a.log_loss, a.brier, round(a.accuracy - b.accuracy, 6) AS accuracy_diff, round(a.log_loss - b.log_loss, 6) AS log_loss_diff FROM m a JOIN m b ON a.family = b.family AND b.system = 'raw'"))
def compare_table(spark, d):
    """Metrics of each system and family, and their differences to the baseline's. The means are a short table."""
    rows = means(systems(spark, d), "system", "family")
    base = rows.where("system = 'raw'").select("family", F.col("accuracy").alias("a"), F.col("log_loss").alias("l"))
    return rows.join(base, "family").select("system", "family", "n", "accuracy", "log_loss", "brier", rounded(F.col("accuracy") - F.col("a")).alias("accuracy_diff"), rounded(F.col("log_loss") - F.col("l")).alias("log_loss_diff"))


@query("reliability_by_system", sql(SYSTEMS, "SELECT system, bin, count(*) AS n, round(avg(conf), 6) AS conf, round(avg(hit), 6) AS accuracy FROM sys GROUP BY system, bin"))
def reliability_by_system(spark, d):
    return systems(spark, d).groupBy("system", "bin").agg(F.count("*").alias("n"), rounded(F.avg("conf")).alias("conf"), rounded(F.avg("hit")).alias("accuracy"))


@query("cross_check_metrics", sql(SYSTEMS + f", m AS (SELECT system, family, {MEANS} FROM sys GROUP BY system, family), w AS (SELECT system, sum(n * accuracy) / sum(n) AS accuracy FROM m GROUP BY system), v AS (SELECT system, avg(hit) AS accuracy FROM sys GROUP BY system)", "SELECT system, abs(w.accuracy - v.accuracy) <= 1e-6 AS agrees FROM w JOIN v USING (system)"))
def cross_check_metrics(spark, d):
    """Accuracies by system, recomputed from those by family: whether they agree."""
    rows = systems(spark, d).persist()
    by_family = means(rows, "system", "family").groupBy("system").agg((F.sum(F.col("n") * F.col("accuracy")) / F.sum("n")).alias("w"))
    return by_family.join(rows.groupBy("system").agg(F.avg("hit").alias("v")), "system").select("system", (F.abs(F.col("w") - F.col("v")) <= 1e-6).alias("agrees"))


GRID = "unnest(range(0, 1000)) AS t"


@query("selective_curve", sql(PRED_SQL + f", c AS (SELECT least(999, ceil(conf * 1000) - 1)::INT AS last, hit FROM scored), g AS (SELECT {GRID})", "SELECT t::INT AS step, count(*) AS kept, round(avg(hit), 6) AS accuracy FROM g JOIN c ON c.last >= t GROUP BY t HAVING count(*) >= 20"))
def selective_curve(spark, d):
    """Accuracy of the answers with confidence above each thousandth, where 20 or more are left: counts by thousandth, then running sums."""
    last = F.least(F.lit(999), (F.ceil(F.col("conf") * 1000) - 1).cast("int"))
    counted = scored(spark, d).groupBy(last.alias("last")).agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))
    steps = spark.range(1000).select(F.col("id").cast("int").alias("last")).join(counted, "last", "left").na.fill(0)
    down = Window.orderBy(F.desc("last"))  # a thousand rows at most
    out = steps.select(F.col("last").alias("step"), F.sum("n").over(down).alias("kept"), F.sum("hits").over(down).alias("right"))
    return out.where("kept >= 20").select("step", "kept", rounded(F.col("right") / F.col("kept")).alias("accuracy"))


@query("threshold_choice", sql(PRED_SQL + ", g AS (SELECT t / 20 AS t FROM (SELECT unnest(range(0, 20)) AS t)), k AS (SELECT family, t, count(*) AS n, avg(hit) AS s FROM scored, g WHERE conf > t GROUP BY family, t)", f"SELECT family, round(min(t), 6) AS threshold FROM k WHERE {WILSON.format(op='-')} >= 0.3 GROUP BY family"))
def threshold_choice(spark, d):
    """The lowest threshold at which the lower bound of accuracy reaches a target, by family."""
    rows = scored(spark, d).select("family", "conf", "hit").withColumn("t", F.explode(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: i / 20))).where("conf > t")
    counted = rows.groupBy("family", "t").agg(F.sum("hit").alias("hits"), F.count("*").alias("n"))
    low, _ = V.wilson(F.col("hits"), F.col("n"))
    return counted.where(low >= 0.3).groupBy("family").agg(rounded(F.min("t")).alias("threshold"))


GOLD = "CASE WHEN opt = label THEN 0.7 ELSE 0.3 / (k - 1) END"
BENCH = PRED_SQL + f""",
gold AS (SELECT item_id, type, k, label, family, opt, p, {GOLD} AS g FROM pred),
bi AS (SELECT item_id, type, label, family, sum(power(p - g, 2)) AS brier, sum(CASE WHEN g > 0 THEN g * ln(g / greatest(least(p, 1.0), 1e-12)) ELSE 0 END) AS kl, max(p) AS conf, (arg_max(opt, (p, -opt)))::INT AS top, sum(opt * p) AS ev, sum(opt * g) AS gev FROM gold GROUP BY ALL),
bs AS (SELECT *, CASE WHEN type = 'score' THEN (round_even(ev, 0) = label)::INT ELSE (top = label)::INT END AS hit, CASE WHEN type = 'score' THEN abs(ev - gev) END AS mae, least(floor(conf * 10), 9)::INT AS bin FROM bi)"""


def bench(spark, d):
    """Items against soft gold: 0.7 on the label, the rest shared. An ordinal answer is its expected level, rounded half to even."""
    gold = F.transform("p", lambda _, i: F.when(i == F.col("label"), 0.7).otherwise(0.3 / (F.col("k") - 1)))
    rows = predictions(spark, d).withColumn("g", gold)
    kl = V.array_sum(F.zip_with("g", "p", lambda g, p: F.when(g > 0, g * F.log(g / F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-12)))).otherwise(0.0)))
    brier = V.array_sum(F.zip_with("g", "p", lambda g, p: (p - g) * (p - g)))
    level = lambda x: V.array_sum(F.transform(x, lambda v, i: v * i))
    hit = F.when(F.col("type") == "score", (F.rint(level("p")) == F.col("label")).cast("int")).otherwise((V.top(F.col("p")) == F.col("label")).cast("int"))
    return rows.select("item_id", "type", "family", brier.alias("brier"), kl.alias("kl"), F.array_max("p").alias("conf"), hit.alias("hit"), F.when(F.col("type") == "score", F.abs(level("p") - level("g"))).alias("mae"))


@query("bench_metrics", sql(BENCH + ", e AS (SELECT family, sum(x) / sum(n) AS ece FROM (SELECT family, bin, abs(sum(conf) - sum(hit)) AS x, count(*) AS n FROM bs GROUP BY family, bin) GROUP BY family)", "SELECT family, count(*) AS n, round(avg(hit), 6) AS accuracy, round(avg(brier), 6) AS brier, round(avg(kl), 6) AS kl, round(any_value(ece), 6) AS ece, round(avg(mae), 6) AS score_mae FROM bs JOIN e USING (family) GROUP BY family"))
def bench_metrics(spark, d):
    bins = bench(spark, d).groupBy("family", V.bin10(F.col("conf")).alias("bin")).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("hit", "brier", "kl", "conf", "mae")], F.count("mae").alias("scores"))
    out = bins.groupBy("family").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in ("hit", "brier", "kl", "mae", "scores")], F.sum(F.abs(F.col("conf") - F.col("hit"))).alias("gap"))
    return out.select("family", "n", *[rounded(F.col(c) / F.col("n")).alias(a) for c, a in (("hit", "accuracy"), ("brier", "brier"), ("kl", "kl"), ("gap", "ece"))], rounded(F.col("mae") / F.nullif("scores", F.lit(0))).alias("score_mae"))


@query("bench_by_type", sql(BENCH, "SELECT family, type, count(*) AS n, round(avg(hit), 6) AS accuracy FROM bs GROUP BY family, type"))
def bench_by_type(spark, d):
    return bench(spark, d).groupBy("family", "type").agg(F.count("*").alias("n"), rounded(F.avg("hit")).alias("accuracy"))


@query("metrics_fit_subset", sql(PRED_SQL, "SELECT family, count(*) FILTER (item_id % 4 = 0) AS over, round(avg(hit) FILTER (item_id % 4 <> 0), 6) AS accuracy, round(avg(nll) FILTER (item_id % 4 <> 0), 6) AS log_loss FROM scored GROUP BY family"))
def metrics_fit_subset(spark, d):
    """Items whose text is over the context are counted, and left out of the metrics."""
    rows = scored(spark, d).withColumn("over", F.col("item_id") % 4 == 0)
    within = lambda c: rounded(F.avg(F.when(~F.col("over"), F.col(c))))
    return rows.groupBy("family").agg(F.count_if("over").alias("over"), within("hit").alias("accuracy"), within("nll").alias("log_loss"))


@query("temperature_slope", sql(READOUTS_SQL + ", l AS (SELECT *, ln(greatest(p, 1e-12)) AS lp FROM mean), q AS (SELECT *, exp(0.5 * lp) / sum(exp(0.5 * lp)) OVER (PARTITION BY item_id) AS q FROM l), s AS (SELECT item_id, type, sum(q * lp) - max(CASE WHEN opt = label THEN lp END) AS slope FROM q GROUP BY item_id, type)", "SELECT type, round(avg(slope), 6) AS slope FROM s GROUP BY type"))
def temperature_slope(spark, d):
    """Slope of the loss in 1/T, at T = 2: it grows with 1/T, and the best T is where it is 0."""
    logs = V.clipped_log(F.col("p"))
    rows = raw_predictions(spark, d).withColumn("l", logs).withColumn("q", V.softmax(F.transform("l", lambda v: v / 2)))
    return rows.groupBy("type").agg(rounded(F.avg(V.dot(F.col("q"), F.col("l")) - V.pick(F.col("l"), F.col("label")))).alias("slope"))


BIAS = [0.1 * ((s % 3) - 1) for s in range(10)]
HEAD = READOUTS_SQL + f""",
hu AS (SELECT *, 0.8 * z - 0.3 * zc + [{', '.join(map(str, BIAS))}][s + 1] AS u FROM slots),
hp AS (SELECT *, exp(u) / sum(exp(u)) OVER (PARTITION BY item_id, rot) AS p FROM hu)"""


@query("head_mean_loss", sql(HEAD, "SELECT type, round(sum(-ln(p) / n) / count(DISTINCT item_id), 6) AS loss FROM hp WHERE opt = label GROUP BY type"))
def head_mean_loss(spark, d):
    """Mean loss by type; a readout weighs as one of its item's rotations."""
    rows = C.head_losses(readouts(spark, d), 0.8, 0.3, BIAS).withColumn("w", 1 / F.col("n"))
    return rows.groupBy("type").agg(rounded(F.sum(F.col("w") * F.col("loss")) / F.sum("w")).alias("loss"))


@query("head_gradient", sql(HEAD + ", er AS (SELECT *, p - CASE WHEN opt = label THEN 1 ELSE 0 END AS err FROM hp), m AS (SELECT type, count(DISTINCT (item_id, rot)) AS m FROM er GROUP BY type), g AS (SELECT type, 'scale' AS parameter, sum(err * z) AS g FROM er GROUP BY type UNION ALL SELECT type, 'content_free', -sum(err * zc) FROM er GROUP BY type UNION ALL SELECT type, 'bias' || s, sum(err) FROM er GROUP BY type, s)", "SELECT type, parameter, round(g / m, 6) AS gradient FROM g JOIN m USING (type)"))
def head_gradient(spark, d):
    return C.head_gradient(readouts(spark, d), 0.8, 0.3, BIAS, ["type"]).withColumn("gradient", rounded("gradient"))


SECOND = "SELECT item_id, conf, (SELECT max(p) FROM pred q WHERE q.item_id = s.item_id AND q.opt <> s.top) AS second, top FROM scored s"


def remap_sql(confidence: str) -> str:
    body = f"t AS ({SECOND}), c AS (SELECT t.*, least(greatest({confidence}, second / greatest(1 - conf + second, 1e-12)), 1 - 1e-6) AS c FROM t)"
    return sql(PRED_SQL + ", " + body, "SELECT pred.item_id, opt::INT AS opt, round(CASE WHEN opt = top THEN c ELSE p * (1 - c) / greatest(1 - conf, 1e-12) END, 6) AS p FROM pred JOIN c USING (item_id)")


def remapped(spark, d, confidence) -> DataFrame:
    rows = predictions(spark, d)
    return P.long(rows.withColumn("p", C.with_top(F.col("p"), confidence(F.array_max("p")))), ["item_id"], at="opt")


@query("top_remap", remap_sql("0.9 * conf"))
def top_remap(spark, d):
    return remapped(spark, d, lambda c: 0.9 * c)


@query("platt_apply", remap_sql("1 / (1 + exp(-(0.7 * ln(least(greatest(conf, 1e-6), 1 - 1e-6) / (1 - least(greatest(conf, 1e-6), 1 - 1e-6))) - 0.2)))"))
def platt_apply(spark, d):
    return remapped(spark, d, lambda c: C.platt(c, 0.7, -0.2))


HIST = "hist AS (SELECT b.bin, (coalesce(sum(hit), 0) + 1) / (count(hit) + 2) AS share FROM (SELECT unnest(range(10)) AS bin) b LEFT JOIN scored s ON s.bin = b.bin GROUP BY b.bin)"


@query("hist_fit", sql(PRED_SQL + ", " + HIST, "SELECT bin::INT AS bin, round(share, 6) AS share FROM hist"))
def hist_fit(spark, d):
    return C.histogram(scored(spark, d)).select("bin", rounded("share").alias("share"))


@query("hist_apply", sql(PRED_SQL + ", " + HIST, "SELECT item_id, round(share, 6) AS conf FROM scored JOIN hist USING (bin)"))
def hist_apply(spark, d):
    """The confidence that the histogram gives; ten rows are broadcast."""
    rows = scored(spark, d)
    return rows.select("item_id", "bin").join(F.broadcast(C.histogram(rows)), "bin").select("item_id", rounded("share").alias("conf"))


@query("tdis_apply", sql(READOUTS_SQL + ", f AS (SELECT item_id, opt, stddev_pop(p) AS sd FROM probs GROUP BY item_id, opt), d AS (SELECT item_id, avg(sd) AS d FROM f GROUP BY item_id), t AS (SELECT mean.item_id, opt, ln(greatest(least(p, 1.0), 1e-12)) * exp(-(0.4 + 2 * d)) AS u FROM mean JOIN d USING (item_id))", "SELECT item_id, opt::INT AS opt, round(exp(u) / sum(exp(u)) OVER (PARTITION BY item_id), 6) AS p FROM t"))
def tdis_apply(spark, d):
    """A temperature that grows with how much the rotations disagree: the mean over options of their spread."""
    rows = P.raw(readouts(spark, d))
    spread = rows.select("item_id", F.posexplode(V.rotate_back(F.col("p"), F.col("rot"))).alias("opt", "v")).groupBy("item_id", "opt").agg(F.stddev_pop("v").alias("sd")).groupBy("item_id").agg(F.avg("sd").alias("d"))
    found = P.rotation_mean(rows).join(spread, "item_id").withColumn("p", V.temperature(F.col("p"), F.exp(0.4 + 2 * F.col("d"))))
    return P.long(found, ["item_id"], at="opt")


@query("theta_clamp", sql(READOUTS_SQL, "SELECT DISTINCT item_id, round(least(greatest(e[1] * 30, 0.05), 20.0), 6) AS scale, round(least(greatest(e[2] * 5, 0.0), 2.0), 6) AS content_free FROM slots"))
def theta_clamp(spark, d):
    rows = readouts(spark, d).select("item_id", "h").dropDuplicates(["item_id"])
    return rows.select("item_id", rounded(C.clamp(F.element_at("h", 1) * 30, C.SCALE)).alias("scale"), rounded(C.clamp(F.element_at("h", 2) * 5, C.CONTENT_FREE)).alias("content_free"))


TRIED = "tried AS (SELECT family, type, avg(nll) AS loss, CASE type WHEN 'choice' THEN 3 WHEN 'bool' THEN 1 ELSE 2 END AS parameters FROM scored GROUP BY family, type)"


@query("protocol_choice", sql(PRED_SQL + ", " + TRIED, "SELECT family, arg_min(type, (parameters, loss)) AS chosen FROM tried t WHERE loss <= (SELECT min(loss) FROM tried u WHERE u.family = t.family) + 0.002 GROUP BY family"))
def protocol_choice(spark, d):
    """Of the candidates within 0.002 of the least loss, the one with the fewest parameters."""
    kind = F.col("type")
    tried = scored(spark, d).groupBy("family", "type").agg(F.avg("nll").alias("loss")).withColumn("parameters", F.when(kind == "choice", 3).when(kind == "bool", 1).otherwise(2))
    close = tried.withColumn("least", F.min("loss").over(Window.partitionBy("family"))).where(F.col("loss") <= F.col("least") + C.TIE)
    return close.groupBy("family").agg(F.min_by("type", F.struct("parameters", "loss")).alias("chosen"))


@query("fit_verdict", sql(RAW, "SELECT a.family, CASE WHEN avg(a.nll) < avg(b.nll) - 1e-6 THEN 'fitted' ELSE 'identity' END AS verdict FROM scored a JOIN rscored b USING (item_id) GROUP BY a.family"))
def fit_verdict(spark, d):
    """A fit that doesn't lower the loss is replaced by the identity."""
    loss = systems(spark, d).groupBy("family").agg(*[F.avg(F.when(F.col("system") == s, F.col("nll"))).alias(s) for s in ("temperature", "raw")])
    return loss.select("family", F.when(F.col("temperature") < F.col("raw") - 1e-6, "fitted").otherwise("identity").alias("verdict"))


@query("noninferiority_verdict", sql(SYSTEMS + ", v AS (SELECT family, avg(hit) FILTER (system = 'temperature') - avg(hit) FILTER (system = 'raw') AS accuracy, avg(brier) FILTER (system = 'temperature') - avg(brier) FILTER (system = 'raw') AS brier FROM sys GROUP BY family)", "SELECT family, accuracy > -0.01 AND brier < 0.01 AS passes FROM v"))
def noninferiority_verdict(spark, d):
    """Accuracy no worse by a hundredth, and Brier score neither."""
    of = lambda c, s: F.avg(F.when(F.col("system") == s, F.col(c)))
    rows = systems(spark, d).groupBy("family").agg((of("hit", "temperature") - of("hit", "raw")).alias("accuracy"), (of("brier", "temperature") - of("brier", "raw")).alias("brier"))
    return rows.select("family", ((F.col("accuracy") > -0.01) & (F.col("brier") < 0.01)).alias("passes"))


@query("probe_repeatability", sql(READOUTS_SQL, "SELECT type, round(max(p) FILTER (s = 0) , 6) AS highest, round(max(abs(p - q)), 6) AS apart FROM (SELECT type, s, p, first_value(p) OVER (PARTITION BY item_id, s ORDER BY rot) AS q FROM probs) GROUP BY type"))
def probe_repeatability(spark, d):
    """The largest difference of a slot's probability from that of the first rotation."""
    rows = P.raw(readouts(spark, d))
    first = rows.where("rot = 0").select("item_id", F.col("p").alias("q"))
    apart = F.array_max(F.zip_with("p", "q", lambda a, b: F.abs(a - b)))
    return rows.join(first, "item_id").groupBy("type").agg(rounded(F.max(F.element_at("p", 1))).alias("highest"), rounded(F.max(apart)).alias("apart"))


@query("probe_irrelevant", sql(RAW + ", o AS (SELECT item_id, type, p, row_number() OVER (PARTITION BY item_id ORDER BY p DESC, opt) AS r, opt FROM mean), two AS (SELECT item_id, type, max(opt) FILTER (r = 1) AS a, max(opt) FILTER (r = 2) AS b FROM o GROUP BY ALL), ratio AS (SELECT two.item_id, two.type, ln(max(mean.p) FILTER (mean.opt = a) / max(mean.p) FILTER (mean.opt = b)) AS x, ln(max(pred.p) FILTER (mean.opt = a) / max(pred.p) FILTER (mean.opt = b)) AS y FROM two JOIN mean USING (item_id) JOIN pred ON pred.item_id = mean.item_id AND pred.opt = mean.opt GROUP BY ALL)", "SELECT type, round(avg(abs(x - y)), 6) AS shift FROM ratio WHERE isfinite(x) AND isfinite(y) GROUP BY type"))
def probe_irrelevant(spark, d):
    """How far the log-odds of the two leading options move between two tables, on the mean of what is finite."""
    a, b = raw_predictions(spark, d), predictions(spark, d).select("item_id", F.col("p").alias("q"))
    order = F.array_sort(F.transform("p", lambda v, i: F.struct((-v).alias("m"), i.alias("i"))))
    rows = a.join(b, "item_id").withColumn("order", order)
    odds = lambda c: F.log(V.pick(F.col(c), F.element_at("order", 1)["i"]) / V.pick(F.col(c), F.element_at("order", 2)["i"]))
    shift = F.abs(odds("p") - odds("q"))
    return rows.withColumn("shift", shift).where("shift IS NOT NULL AND shift < double('Infinity')").groupBy("type").agg(rounded(F.avg("shift")).alias("shift"))


BOUNDS = "[" + ", ".join(repr(b) for b in R.BOUNDS) + "]"


def draws_sql(rows: str, by: str, resamples: int, measures: str) -> str:
    keys = f"{by}, " if by else ""
    return f"st AS (SELECT grp, {keys}count(*) AS n, sum(hit) AS hit, sum(nll) AS nll FROM {rows} GROUP BY ALL), w AS (SELECT *, len(list_filter({BOUNDS}, lambda b: u >= b)) AS w FROM (SELECT st.*, r, {UNIT.format("r || ':' || grp")} AS u FROM st, (SELECT unnest(range({resamples})) AS r))), dr AS (SELECT r, {keys}{measures} FROM w WHERE w > 0 GROUP BY ALL)"


ACCURACY = "sum(w * hit) / sum(w * n) AS accuracy"
ENDS = "round(quantile_cont(accuracy, 0.025), 6) AS low, round(quantile_cont(accuracy, 0.975), 6) AS high"


def bootstrap(rows: DataFrame, resamples: int, by: list[str] | None = None, key: str = "grp") -> DataFrame:
    found = R.draws(rows, key, ["hit", "nll"], by, resamples)
    return found.withColumn("accuracy", F.col("hit") / F.col("n")).withColumn("loss", F.col("nll") / F.col("n"))


def ends(values: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    return R.interval(values, column, by).withColumns({c: rounded(c) for c in ("low", "high")})


@query("group_bootstrap", sql(PRED_SQL + ", " + draws_sql("scored", "", 200, ACCURACY), f"SELECT {ENDS} FROM dr"))
def group_bootstrap(spark, d):
    """95 % interval of accuracy when whole groups are drawn."""
    return ends(bootstrap(scored(spark, d), 200), "accuracy")


@query("bootstrap_metrics", sql(PRED_SQL + ", it AS (SELECT item_id AS grp, hit, nll FROM scored), " + draws_sql("it", "", 50, ACCURACY), f"SELECT {ENDS} FROM dr"))
def bootstrap_metrics(spark, d):
    """The same with items drawn one by one."""
    return ends(bootstrap(scored(spark, d).withColumn("grp", F.col("item_id")), 50), "accuracy")


@query("stratified_bootstrap", sql(PRED_SQL + ", fam AS (SELECT family || '/' || grp AS grp, family, hit, nll FROM scored), " + draws_sql("fam", "family", 100, ACCURACY), f"SELECT family, {ENDS} FROM dr GROUP BY family"))
def stratified_bootstrap(spark, d):
    """Groups are drawn within their family."""
    rows = scored(spark, d).withColumn("grp", F.concat_ws("/", "family", F.col("grp").cast("string")))
    return ends(bootstrap(rows, 100, ["family"]), "accuracy", ["family"])


@query("multi_system_bootstrap", sql(SYSTEMS + ", " + draws_sql("sys", "system", 100, ACCURACY), f"SELECT system, {ENDS} FROM dr GROUP BY system"))
def multi_system_bootstrap(spark, d):
    """All systems with the same draws."""
    return ends(bootstrap(systems(spark, d), 100, ["system"]), "accuracy", ["system"])


@query("paired_bootstrap", sql(SYSTEMS + ", " + draws_sql("sys", "system", 100, "sum(w * nll) / sum(w * n) AS loss") + ", pr AS (SELECT r, max(loss) FILTER (system = 'temperature') - max(loss) FILTER (system = 'raw') AS x FROM dr GROUP BY r), rk AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () AS n FROM pr)", "SELECT round(max(x) FILTER (i = floor(0.025 * (n - 1))), 6) AS low, round(max(x) FILTER (i = floor(0.975 * (n - 1))), 6) AS high FROM rk"))
def paired_bootstrap(spark, d):
    """Difference of two systems' losses with common draws; the ends are order statistics, not interpolated."""
    found = bootstrap(systems(spark, d), 100, ["system"])
    apart = found.groupBy("resample").agg((F.max(F.when(F.col("system") == "temperature", F.col("loss"))) - F.max(F.when(F.col("system") == "raw", F.col("loss")))).alias("x"))
    ordered = apart.agg(F.array_sort(F.collect_list("x")).alias("x"))  # a value for each resample
    at = lambda q: rounded(F.element_at("x", (F.floor(q * (F.size("x") - 1)) + 1).cast("int")))
    return ordered.select(at(0.025).alias("low"), at(0.975).alias("high"))


@query("interval_from_draws", sql(PRED_SQL + ", " + draws_sql("scored", "", 100, "sum(w * nll) / sum(w * n) AS loss"), "SELECT count(*) AS draws, round(quantile_cont(loss, 0.025), 6) AS low, round(quantile_cont(loss, 0.975), 6) AS high FROM dr"))
def interval_from_draws(spark, d):
    found = bootstrap(scored(spark, d), 100)
    return ends(found, "loss").join(F.broadcast(found.agg(F.count("*").alias("draws"))))
