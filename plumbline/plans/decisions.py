"""Queries over readouts: probabilities, predictions, metrics, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.catalog import query
from plumbline.functions import vectors as V
from plumbline.operators import metrics as M
from plumbline.operators import predict as P
from plumbline.sources.readouts import ITEMS_SQL, READOUTS_SQL, items, readouts

TEMPERATURES = {"choice": 3.461, "bool": 7.491, "score": 6.538}
BIAS = [((s * 3) % 7 - 3) / 10 for s in range(26)]
WEIGHTS = [[((k * 7 + i * 3) % 11 - 5) / 100 for i in range(64)] for k in range(10)]
SLOT = ["item_id", "rot"]

T_SQL = "CASE type WHEN 'choice' THEN 3.461 WHEN 'bool' THEN 7.491 ELSE 6.538 END"
PRED_SQL = (
    READOUTS_SQL
    + f""",
tl AS (SELECT *, ln(greatest(least(p, 1.0), 1e-12)) / ({T_SQL}) AS lp FROM mean),
te AS (SELECT *, exp(lp - max(lp) OVER (PARTITION BY item_id)) AS ex FROM tl),
pred AS (SELECT item_id, type, k, label, family, grp, n, opt, ex / sum(ex) OVER (PARTITION BY item_id) AS p FROM te),
cums AS (SELECT *, sum(p) OVER (PARTITION BY item_id ORDER BY opt) AS cum FROM pred),
item AS (SELECT item_id, type, k, label, family, grp, n, max(p) AS conf, (arg_max(opt, (p, -opt)))::INT AS top,
  -ln(greatest(max(CASE WHEN opt = label THEN p END), 1e-300)) AS nll, sum(power(p - CASE WHEN opt = label THEN 1 ELSE 0 END, 2)) AS brier,
  CASE WHEN type = 'score' THEN sum(CASE WHEN opt < k - 1 THEN power(cum - CASE WHEN opt >= label THEN 1 ELSE 0 END, 2) ELSE 0 END) END AS rps
  FROM cums GROUP BY item_id, type, k, label, family, grp, n),
scored AS (SELECT *, (top = label)::INT AS hit, least(floor(conf * 10), 9)::INT AS bin FROM item)"""
)


def sql(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.apply_temperature(P.rotation_mean(P.raw(readouts(spark, sf_dir))), TEMPERATURES)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.scored(predictions(spark, sf_dir))


@query("n_rotations", sql(ITEMS_SQL, "SELECT item_id, type, n FROM items"))
def n_rotations(spark, d):
    return items(spark, d).select("item_id", "type", "n")


@query("rotation_plan", sql(READOUTS_SQL, "SELECT item_id, rot FROM rots"))
def rotation_plan(spark, d):
    return readouts(spark, d).select("item_id", "rot")


@query("rotation_perm", sql(READOUTS_SQL, "SELECT item_id, rot, s::INT AS slot, opt::INT AS opt, ((label - rot + k) % k)::INT AS label_slot FROM slots"))
def rotation_perm(spark, d):
    rows = readouts(spark, d)
    return rows.select(*SLOT, "k", "label", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("slot")).select(*SLOT, "slot", ((F.col("slot") + F.col("rot")) % F.col("k")).alias("opt"), ((F.col("label") - F.col("rot") + F.col("k")) % F.col("k")).alias("label_slot"))


@query("softmax_readout", sql(READOUTS_SQL, "SELECT item_id, rot, s::INT AS slot, round(p, 6) AS p FROM probs"))
def softmax_readout(spark, d):
    return P.long(P.raw(readouts(spark, d)), SLOT)


@query("raw_probs", sql(READOUTS_SQL, "SELECT item_id, rot, s::INT AS slot, round(exp(z - zc) / sum(exp(z - zc)) OVER (PARTITION BY item_id, rot), 6) AS p FROM slots"))
def raw_probs(spark, d):
    return P.long(P.raw(readouts(spark, d), content_free=True), SLOT)


@query("h1_probs", sql(READOUTS_SQL, "SELECT item_id, rot, s::INT AS slot, round(exp(u) / sum(exp(u)) OVER (PARTITION BY item_id, rot), 6) AS p FROM (SELECT *, 0.6 * z - 0.3 * zc + ((s * 3) % 7 - 3) / 10.0 AS u FROM slots)"))
def h1_probs(spark, d):
    return P.long(P.linear_head(readouts(spark, d), 0.6, 0.3, BIAS), SLOT)


@query("h2_probs", sql(READOUTS_SQL, "SELECT item_id, rot, s::INT AS slot, round(exp(u) / sum(exp(u)) OVER (PARTITION BY item_id, rot), 6) AS p FROM (SELECT *, 0.6 * (z + list_sum(list_transform(range(64), lambda i: e[i + 1] * ((s * 7 + i * 3) % 11 - 5) / 100.0))) - 0.3 * zc + ((s * 3) % 7 - 3) / 10.0 AS u FROM slots)"))
def h2_probs(spark, d):
    return P.long(P.linear_head(readouts(spark, d), 0.6, 0.3, BIAS, WEIGHTS), SLOT)


@query("probe_probs", sql(READOUTS_SQL, "SELECT item_id, rot, s::INT AS slot, round(1.0 / k, 6) AS p FROM slots"))
def probe_probs(spark, d):
    return P.long(P.raw(readouts(spark, d).withColumn("z", F.transform("z", lambda _: F.lit(0.0)))), SLOT)


@query("rotation_mean", sql(READOUTS_SQL, "SELECT item_id, opt::INT AS opt, round(p, 6) AS p FROM mean"))
def rotation_mean(spark, d):
    return P.long(P.rotation_mean(P.raw(readouts(spark, d))), ["item_id"], at="opt")


@query("temperature_apply", sql(PRED_SQL, "SELECT item_id, opt::INT AS opt, round(p, 6) AS p FROM pred"))
def temperature_apply(spark, d):
    return P.long(predictions(spark, d), ["item_id"], at="opt")


@query("top_option", sql(PRED_SQL, "SELECT item_id, top, round(conf, 6) AS conf FROM item"))
def top_option(spark, d):
    return scored(spark, d).select("item_id", "top", P.rounded("conf").alias("conf"))


@query("rotation_tops", sql(READOUTS_SQL, "SELECT item_id, rot, ((arg_max(s, (p, -s)) + rot) % any_value(k))::INT AS top FROM probs GROUP BY item_id, rot"))
def rotation_tops(spark, d):
    return P.raw(readouts(spark, d)).select(*SLOT, ((V.top(F.col("p")) + F.col("rot")) % F.col("k")).alias("top"))


@query("rotation_spread", sql(READOUTS_SQL + ", tops AS (SELECT item_id, arg_max(opt, (p, -opt)) AS top FROM mean GROUP BY item_id)", "SELECT item_id, round(max(p) - min(p), 6) AS spread FROM probs JOIN tops USING (item_id) WHERE opt = top GROUP BY item_id"))
def rotation_spread(spark, d):
    slots = P.raw(readouts(spark, d))
    tops = P.rotation_mean(slots).select("item_id", V.top(F.col("p")).alias("top"))
    at = F.element_at(V.rotate_back(F.col("p"), F.col("rot")), F.col("top") + 1)
    return slots.join(tops, "item_id").groupBy("item_id").agg(P.rounded(F.max(at) - F.min(at)).alias("spread"))


@query("rotation_disagreement", sql(READOUTS_SQL, "SELECT item_id, round(avg(d), 6) AS disagreement FROM (SELECT item_id, rot, 0.5 * sum(abs(q.p - m.p)) AS d FROM probs q JOIN mean m USING (item_id, opt) GROUP BY item_id, rot) GROUP BY item_id"))
def rotation_disagreement(spark, d):
    slots = P.raw(readouts(spark, d))
    mean = P.rotation_mean(slots).select("item_id", F.col("p").alias("mean"))
    far = V.array_sum(F.zip_with(V.rotate_back(F.col("p"), F.col("rot")), "mean", lambda a, b: F.abs(a - b))) * 0.5
    return slots.join(mean, "item_id").groupBy("item_id").agg(P.rounded(F.avg(far)).alias("disagreement"))


MASS = "SELECT item_id, k, list_sum(list_transform(e[1:k], lambda x: exp(x))) / list_sum(list_transform(e, lambda x: exp(x))) AS mass FROM items"


@query("slot_mass", sql(ITEMS_SQL, f"SELECT item_id, round(mass, 6) AS slot_mass FROM ({MASS})"))
def slot_mass(spark, d):
    return items(spark, d).select("item_id", P.rounded(V.array_sum(F.slice(V.softmax(F.col("e")), F.lit(1), F.col("k")))).alias("slot_mass"))


@query("slot_mass_p05", sql(ITEMS_SQL, f"SELECT round(avg(mass), 6) AS mean, round(quantile_cont(mass, 0.05), 6) AS p05 FROM ({MASS})"))
def slot_mass_p05(spark, d):
    mass = items(spark, d).select(V.array_sum(F.slice(V.softmax(F.col("e")), F.lit(1), F.col("k"))).alias("mass"))
    return mass.agg(P.rounded(F.avg("mass")).alias("mean"), P.rounded(F.percentile("mass", F.lit(0.05))).alias("p05"))


@query("slot_logprobs", sql(READOUTS_SQL, "SELECT item_id, rot, s::INT AS slot, round(z - ln(sum(exp(z)) OVER (PARTITION BY item_id, rot)), 6) AS logprob FROM slots"))
def slot_logprobs(spark, d):
    return P.long(readouts(spark, d).withColumn("logprob", V.log_softmax(F.col("z"))), SLOT, "logprob")


@query("softcap_logit", sql(READOUTS_SQL, "SELECT item_id, rot, s::INT AS slot, round(5.0 * tanh(z / 5.0), 6) AS z FROM slots"))
def softcap_logit(spark, d):
    return P.long(readouts(spark, d).withColumn("z", F.transform("z", lambda v: 5.0 * F.tanh(v / 5.0))), SLOT, "z")


@query("rms_norm", sql(ITEMS_SQL, "SELECT item_id, (i - 1)::INT AS slot, round(e[i] / sqrt(list_sum(list_transform(e, lambda x: x * x)) / 64 + 1e-6), 6) AS h FROM (SELECT *, unnest(range(1, 65)) AS i FROM items)"))
def rms_norm(spark, d):
    scale = F.sqrt(V.array_sum(F.transform("e", lambda x: x * x)) / F.size("e") + 1e-6)
    return P.long(items(spark, d).withColumn("s", scale).withColumn("h", F.transform("e", lambda x: x / F.col("s"))), ["item_id"], "h")


@query("score_mean", sql(PRED_SQL, "SELECT item_id, round(sum(p * (opt + 1)), 6) AS level FROM pred WHERE type = 'score' GROUP BY item_id"))
def score_mean(spark, d):
    return predictions(spark, d).where("type = 'score'").select("item_id", P.rounded(V.expected_level(F.col("p"))).alias("level"))


@query("loglinear_pool", sql(PRED_SQL, "SELECT item_id, opt::INT AS opt, round(w / sum(w) OVER (PARTITION BY item_id), 6) AS p FROM (SELECT item_id, opt, exp(0.7 * ln(greatest(m.p, 1e-12)) + 0.3 * ln(greatest(t.p, 1e-12))) AS w FROM mean m JOIN pred t USING (item_id, opt))"))
def loglinear_pool(spark, d):
    a, b = P.rotation_mean(P.raw(readouts(spark, d))), predictions(spark, d).select("item_id", F.col("p").alias("q"))
    return P.long(a.join(b, "item_id").withColumn("p", V.softmax(F.zip_with(V.clipped_log(F.col("p")), V.clipped_log(F.col("q")), lambda x, y: 0.7 * x + 0.3 * y))), ["item_id"], at="opt")


@query("mean_pool", sql(PRED_SQL, "SELECT item_id, opt::INT AS opt, round((m.p + t.p) / 2, 6) AS p FROM mean m JOIN pred t USING (item_id, opt)"))
def mean_pool(spark, d):
    a, b = P.rotation_mean(P.raw(readouts(spark, d))), predictions(spark, d).select("item_id", F.col("p").alias("q"))
    return P.long(a.join(b, "item_id").withColumn("p", F.zip_with("p", "q", lambda x, y: (x + y) / 2)), ["item_id"], at="opt")


@query("tb_apply", sql(READOUTS_SQL, "SELECT item_id, opt::INT AS opt, round(w / sum(w) OVER (PARTITION BY item_id), 6) AS p FROM (SELECT item_id, opt, exp(0.5 * ln(greatest(p, 1e-12)) + ((opt * 3) % 7 - 3) / 10.0) AS w FROM mean)"))
def tb_apply(spark, d):
    bias = F.array(*map(F.lit, BIAS))
    u = F.transform(V.clipped_log(F.col("p")), lambda v, i: 0.5 * v + F.element_at(bias, i + 1))
    return P.long(P.rotation_mean(P.raw(readouts(spark, d))).withColumn("p", V.softmax(u)), ["item_id"], at="opt")


@query("top2_options", sql(PRED_SQL, "SELECT item_id, rank::INT AS rank, opt::INT AS opt, round(p, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY p DESC, opt) AS rank FROM pred) WHERE rank <= 2"))
def top2_options(spark, d):
    ordered = F.slice(F.array_sort(F.transform("p", lambda v, i: F.struct((-v).alias("minus"), i.alias("opt")))), 1, 2)
    return predictions(spark, d).select("item_id", F.posexplode(ordered).alias("rank", "x")).select("item_id", (F.col("rank") + 1).alias("rank"), F.col("x.opt").alias("opt"), P.rounded(-F.col("x.minus")).alias("p"))


@query("rps_window", sql(PRED_SQL, "SELECT item_id, opt::INT AS opt, round(cum, 6) AS cum FROM cums WHERE type = 'score'"))
def rps_window(spark, d):
    rows = P.long(predictions(spark, d).where("type = 'score'"), ["item_id"], at="opt", digits=15)
    return rows.select("item_id", "opt", P.rounded(F.sum("p").over(Window.partitionBy("item_id").orderBy("opt"))).alias("cum"))


METRICS = "round(avg(hit), 6) AS accuracy, round(avg(nll), 6) AS log_loss, round(avg(brier), 6) AS brier"


def metrics_sql(by: str) -> str:
    group, using = (f"GROUP BY {by}", f"JOIN e USING ({by})") if by else ("", ", e")
    keys = f"{by}, " if by else ""
    return sql(PRED_SQL + f", e AS (SELECT {keys}round(sum(d) / sum(n), 6) AS ece FROM (SELECT {keys}bin, abs(sum(conf) - sum(hit)) AS d, count(*) AS n FROM scored GROUP BY {keys}bin) {group}), m AS (SELECT {keys}count(*) AS n, {METRICS}, round(avg(rps), 6) AS rps FROM scored {group})", f"SELECT {keys}n, accuracy, log_loss, brier, ece, rps FROM m {using}")


@query("metrics_overall", metrics_sql(""))
def metrics_overall(spark, d):
    return M.metrics(scored(spark, d))


@query("metrics_by_family", metrics_sql("family"))
def metrics_by_family(spark, d):
    return M.metrics(scored(spark, d), ["family"])


@query("metrics_by_type", metrics_sql("type"))
def metrics_by_type(spark, d):
    return M.metrics(scored(spark, d), ["type"])


@query("metrics_grouping_sets", sql(PRED_SQL, f"SELECT type, family, count(*) AS n, {METRICS} FROM scored GROUP BY GROUPING SETS ((type), (type, family), ())"))
def metrics_grouping_sets(spark, d):
    rows = scored(spark, d)
    return rows.groupingSets([["type"], ["type", "family"], []], "type", "family").agg(F.count("*").alias("n"), P.rounded(F.avg("hit")).alias("accuracy"), P.rounded(F.avg("nll")).alias("log_loss"), P.rounded(F.avg("brier")).alias("brier"))


@query("macro_ece", sql(PRED_SQL, "SELECT round(avg(ece), 6) AS macro_ece FROM (SELECT family, sum(d) / sum(n) AS ece FROM (SELECT family, bin, abs(sum(conf) - sum(hit)) AS d, count(*) AS n FROM scored GROUP BY family, bin) GROUP BY family)"))
def macro_ece(spark, d):
    return M.metrics(scored(spark, d), ["family"], digits=15).agg(P.rounded(F.avg("ece")).alias("macro_ece"))


WILSON = "(s + 3.841459841616 / (2 * n) {op} 1.959964 * sqrt(s * (1 - s) / n + 3.841458881296 / (4.0 * n * n))) / (1 + 3.841458881296 / n)".replace("3.841459841616", "3.841458881296")


@query("reliability", sql(PRED_SQL + ", b AS (SELECT bin, count(*) AS n, avg(hit) AS s, avg(conf) AS c FROM scored GROUP BY bin)", f"SELECT r.bin::INT AS bin, coalesce(n, 0) AS n, coalesce(round(c, 6), 0) AS conf, coalesce(round(s, 6), 0) AS accuracy, coalesce(round({WILSON.format(op='-')}, 6), 0) AS low, coalesce(round({WILSON.format(op='+')}, 6), 0) AS high FROM (SELECT unnest(range(10)) AS bin) r LEFT JOIN b USING (bin)"))
def reliability(spark, d):
    return M.reliability(scored(spark, d))


@query("wilson_interval", sql(PRED_SQL + ", b AS (SELECT family, count(*) AS n, avg(hit) AS s FROM scored GROUP BY family)", f"SELECT family, n, round({WILSON.format(op='-')}, 6) AS low, round({WILSON.format(op='+')}, 6) AS high FROM b"))
def wilson_interval(spark, d):
    low, high = V.wilson(F.col("hits"), F.col("n"))
    return scored(spark, d).groupBy("family").agg(F.sum("hit").alias("hits"), F.count("*").alias("n")).select("family", "n", P.rounded(low).alias("low"), P.rounded(high).alias("high"))


@query("risk_coverage", sql(PRED_SQL, "SELECT t::DOUBLE AS threshold, count(*) FILTER (conf > t) AS kept, round(avg(hit) FILTER (conf > t), 6) AS accuracy, round(count(*) FILTER (conf > t) / count(*), 6) AS coverage FROM scored, (VALUES (0.5), (0.6), (0.7), (0.8), (0.9), (0.95), (0.99)) v(t) GROUP BY t"))
def risk_coverage(spark, d):
    return M.risk_coverage(scored(spark, d))


@query("confusion", sql(PRED_SQL, "SELECT type, label AS gold, top AS predicted, count(*) AS n FROM scored GROUP BY ALL"))
def confusion(spark, d):
    return M.confusion(scored(spark, d))


@query("groups_per_family", sql(ITEMS_SQL, "SELECT family, count(DISTINCT grp) AS groups, count(*) AS n FROM items GROUP BY family"))
def groups_per_family(spark, d):
    return items(spark, d).groupBy("family").agg(F.countDistinct("grp").alias("groups"), F.count("*").alias("n"))


@query("leave_one_out", sql(PRED_SQL, f"SELECT f.family AS left_out, count(*) AS n, {METRICS} FROM scored s, (SELECT DISTINCT family FROM scored) f WHERE s.family <> f.family GROUP BY f.family"))
def leave_one_out(spark, d):
    """All families' sums less the one's: no cross join."""
    sums = scored(spark, d).groupBy("family").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("hit", "nll", "brier")])
    total = sums.agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "hit", "nll", "brier")])  # one row
    n = F.col("all_n") - F.col("n")
    return sums.join(F.broadcast(total)).select(F.col("family").alias("left_out"), n.alias("n"), *[P.rounded((F.col(f"all_{c}") - F.col(c)) / n).alias(name) for c, name in (("hit", "accuracy"), ("nll", "log_loss"), ("brier", "brier"))])


@query("temperature_loss_curve", sql(READOUTS_SQL + ", g AS (SELECT type, item_id, opt, label, t, ln(greatest(p, 1e-12)) / t AS u FROM mean, (VALUES (0.5), (1.0), (2.0), (4.0), (8.0)) v(t)), l AS (SELECT type, t, item_id, ln(sum(exp(u))) - max(CASE WHEN opt = label THEN u END) AS loss FROM g GROUP BY ALL)", "SELECT type, t::DOUBLE AS temperature, round(avg(loss), 6) AS loss FROM l GROUP BY type, t"))
def temperature_loss_curve(spark, d):
    rows = P.rotation_mean(P.raw(readouts(spark, d)))
    grid = rows.withColumn("temperature", F.explode(F.array(*map(F.lit, (0.5, 1.0, 2.0, 4.0, 8.0)))))
    loss = -V.pick(V.log_softmax(F.transform(V.clipped_log(F.col("p")), lambda v: v / F.col("temperature"))), F.col("label"))
    return grid.groupBy("type", "temperature").agg(P.rounded(F.avg(loss)).alias("loss"))


@query("prob_sd", sql(PRED_SQL, "SELECT type, round(max(sd), 6) AS sd FROM (SELECT type, opt, stddev_pop(p) AS sd FROM pred GROUP BY type, opt) GROUP BY type"))
def prob_sd(spark, d):
    rows = P.long(predictions(spark, d), ["type"], at="opt", digits=15)
    return rows.groupBy("type", "opt").agg(F.stddev_pop("p").alias("sd")).groupBy("type").agg(P.rounded(F.max("sd")).alias("sd"))


@query("level_weights", sql(ITEMS_SQL, "SELECT item_id, round(count(*) OVER () / ((SELECT count(DISTINCT label) FROM items WHERE type = 'score') * count(*) OVER (PARTITION BY label)), 6) AS weight FROM items WHERE type = 'score'"))
def level_weights(spark, d):
    rows = items(spark, d).where("type = 'score'").select("item_id", "label")
    levels = rows.groupBy("label").agg(F.count("*").alias("m"))
    whole = levels.agg(F.sum("m").alias("n"), F.count("*").alias("levels"))  # one row
    return rows.join(levels, "label").join(F.broadcast(whole)).select("item_id", P.rounded(F.col("n") / (F.col("levels") * F.col("m"))).alias("weight"))


@query("probe_order", sql(READOUTS_SQL + ", s AS (SELECT item_id, max(p) - min(p) AS d FROM probs WHERE opt = label AND n > 1 GROUP BY item_id), r AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM s)", "SELECT round(avg(d), 6) AS mean, round(max(CASE WHEN i = floor(0.95 * (n - 1)) THEN d END), 6) AS p95 FROM r"))
def probe_order(spark, d):
    """Mean and 95th percentile (an order statistic, not interpolated) of the spread of the right option's probability."""
    rows = P.raw(readouts(spark, d)).where("n > 1")
    at = V.pick(V.rotate_back(F.col("p"), F.col("rot")), F.col("label"))
    spread = rows.groupBy("item_id").agg((F.max(at) - F.min(at)).alias("d"))
    n = spread.agg(F.count("*").alias("n"), F.avg("d").alias("mean"))
    ranked = spread.groupBy("d").agg(F.count("*").alias("m")).withColumn("upto", F.sum("m").over(Window.orderBy("d")))
    return ranked.join(F.broadcast(n)).where(F.col("upto") > F.floor(0.95 * (F.col("n") - 1))).agg(P.rounded(F.first("mean")).alias("mean"), P.rounded(F.min("d")).alias("p95"))


@query("paired_diff", sql(PRED_SQL + ", r AS (SELECT item_id, arg_max(opt, (p, -opt)) = label AS hit, -ln(greatest(max(CASE WHEN opt = label THEN p END), 1e-300)) AS nll FROM mean GROUP BY item_id, label)", "SELECT count(*) AS n, round(avg(s.hit) - avg(r.hit::INT), 6) AS accuracy, round(avg(s.nll) - avg(r.nll), 6) AS log_loss FROM scored s JOIN r USING (item_id)"))
def paired_diff(spark, d):
    a, b = scored(spark, d), P.scored(P.rotation_mean(P.raw(readouts(spark, d))))
    both = a.select("item_id", "hit", "nll").join(b.select("item_id", F.col("hit").alias("h"), F.col("nll").alias("l")), "item_id")
    return both.agg(F.count("*").alias("n"), P.rounded(F.avg("hit") - F.avg("h")).alias("accuracy"), P.rounded(F.avg("nll") - F.avg("l")).alias("log_loss"))


@query("bootstrap_hash", sql(PRED_SQL + ", i AS (SELECT hit, row_number() OVER (ORDER BY item_id) - 1 AS pos, count(*) OVER () AS n FROM scored), d AS (SELECT r, ('0x' || substr(sha256(r || ':' || pos), 1, 8))::BIGINT % n AS pick FROM i, (SELECT unnest(range(20)) AS r))", "SELECT r::INT AS resample, round(avg(hit), 6) AS accuracy FROM d JOIN i ON pick = pos GROUP BY r"))
def bootstrap_hash(spark, d):
    """Accuracy of 20 resamples whose draws are hashes: a draw is a function of resample and position alone."""
    rows = scored(spark, d).select("item_id", "hit")
    rows = rows.withColumn("at", F.row_number().over(Window.orderBy("item_id")) - 1)
    n = rows.agg(F.count("*").alias("n"))
    draws = rows.select("at").join(F.broadcast(n)).withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(19)))).select("resample", (F.conv(F.substring(F.sha2(F.concat_ws(":", F.col("resample").cast("string"), F.col("at").cast("string")), 256), 1, 8), 16, 10).cast("long") % F.col("n")).alias("pick"))
    return draws.join(rows, F.col("pick") == F.col("at")).groupBy("resample").agg(P.rounded(F.avg("hit")).alias("accuracy"))
