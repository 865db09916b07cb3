"""Queries over texts and tables: digests, contamination, splits, samples, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.catalog import query
from plumbline.operators import text as T
from plumbline.operators.predict import rounded

NORM = "trim(regexp_replace(lower(regexp_replace({0}, '-(LRB|RRB|LSB|RSB|LCB|RCB|COLON)-', ' ', 'g')), '[^a-z0-9]+', ' ', 'g'))"
N = NORM.format("text")
UNIT = "(('0x' || substr(sha256({0}), 1, 13))::BIGINT / 4503599627370496.0)"


def table(spark, d: str, name: str):
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("norm_text", f"SELECT doc_id, sha256({N}) AS norm_sha, length({N})::INT AS n FROM documents")
def norm_text(spark, d):
    n = T.norm(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.sha2(n.cast("binary"), 256).alias("norm_sha"), F.length(n).alias("n"))


@query("text_digest", f"SELECT doc_id, CASE WHEN length({N}) >= 24 THEN substr(sha256({N}), 1, 24) END AS digest FROM documents")
def text_digest(spark, d):
    return table(spark, d, "documents").select("doc_id", T.digest(F.col("text")).alias("digest"))


@query("hash_unit", f"SELECT doc_id, {UNIT.format('doc_id::VARCHAR')} AS unit FROM documents")
def hash_unit(spark, d):
    return table(spark, d, "documents").select("doc_id", T.unit(F.col("doc_id").cast("string")).alias("unit"))


@query("fit_split", f"SELECT split, count(*) AS n FROM (SELECT CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'validation' ELSE 'test' END AS split FROM (SELECT {UNIT.format("'split:' || source")} AS u FROM documents)) GROUP BY split")
def fit_split(spark, d):
    u = T.unit(F.concat(F.lit("split:"), "source"))
    return table(spark, d, "documents").groupBy(F.when(u < 0.7, "train").when(u < 0.85, "validation").otherwise("test").alias("split")).agg(F.count("*").alias("n"))


SEG = (
    "SELECT DISTINCT {k}, substr(sha256(n), 1, 24) AS segment FROM (SELECT {k}, " + NORM.format("line") + " AS n FROM (SELECT {k}, unnest([part, regexp_extract(part, '(?s)^[^:.!?]{{1,100}}:\\s+(.+)', 1)]) AS line "
    "FROM (SELECT {k}, unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10))) AS part FROM {t}))) WHERE length(n) >= 60"
)


@query("segments", SEG.format(k="doc_id", t="documents"))
def segments(spark, d):
    return T.segments(table(spark, d, "documents"), "doc_id", "text")


@query("shingles", f"SELECT doc_id, count(DISTINCT g) AS n_shingles FROM (SELECT doc_id, CASE WHEN i <= len(w) - 7 THEN array_to_string(w[i : i + 7], ' ') END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM (SELECT doc_id, string_split({N}, ' ') AS w FROM documents))) GROUP BY doc_id")
def shingle_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.shingles(F.split(T.norm(F.col("text")), " "))).cast("long").alias("n_shingles"))


@query("contam_exact", f"SELECT d.doc_id, b.item_id FROM (SELECT doc_id, {N} AS n FROM documents) d JOIN (SELECT item_id, {N} AS n FROM benchmark) b USING (n) WHERE length(n) >= 24")
def contam_exact(spark, d):
    left = table(spark, d, "documents").select("doc_id", T.digest(F.col("text")).alias("digest")).where("digest IS NOT NULL")
    right = table(spark, d, "benchmark").select("item_id", T.digest(F.col("text")).alias("digest"))
    return left.join(right, "digest").select("doc_id", "item_id")


@query("contam_segment", f"SELECT DISTINCT doc_id FROM ({SEG.format(k='doc_id', t='documents')}) SEMI JOIN ({SEG.format(k='item_id', t='benchmark')}) USING (segment)")
def contam_segment(spark, d):
    left, right = T.segments(table(spark, d, "documents"), "doc_id", "text"), T.segments(table(spark, d, "benchmark"), "item_id", "text")
    return left.join(right.select("segment").distinct(), "segment", "left_semi").select("doc_id").distinct()


POST = "SELECT DISTINCT {k}, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT {k}, w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT {k}, string_split(" + N + ", ' ') AS w FROM {t}) WHERE len(w) >= 8)"


CLASSES = "b AS (" + POST.format(k="item_id", t="benchmark") + "), s AS (SELECT item_id, list_sort(list(g)) AS held FROM b GROUP BY item_id), c AS (SELECT DISTINCT held FROM s), df AS (SELECT g, count(*) AS n FROM (SELECT unnest(held) AS g FROM c) GROUP BY g)"


@query("contam_passage", f"WITH d AS ({POST.format(k='doc_id', t='documents')}), {CLASSES}, r AS (SELECT g FROM df WHERE n <= 3) SELECT doc_id, item_id, count(*) AS shared FROM d JOIN b USING (g) SEMI JOIN r USING (g) GROUP BY doc_id, item_id HAVING count(*) >= 5")
def contam_passage(spark, d):
    return T.shared_passages(table(spark, d, "documents"), "doc_id", table(spark, d, "benchmark"), "item_id")


@query("shingle_df", f"WITH {CLASSES} SELECT n AS held_by, count(*) AS shingles FROM df GROUP BY n")
def shingle_df(spark, d):
    """Of how many distinct texts each shingle is part: texts with the same set of shingles are one."""
    posted = T.distinct_posts(T.shingle_classes(table(spark, d, "benchmark"), "item_id"))
    return posted.groupBy("shingle").agg(F.count("*").alias("held_by")).groupBy("held_by").agg(F.count("*").alias("shingles"))


@query("dedup_in_tier", f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {N} ORDER BY {UNIT.format('doc_id::VARCHAR')}, doc_id) AS r FROM documents) WHERE r = 1")
def dedup_in_tier(spark, d):
    """The first of equal normalised texts in hash order: a minimum by group, without a window over the texts."""
    rows = table(spark, d, "documents").select(F.sha2(T.norm(F.col("text")).cast("binary"), 256).alias("key"), F.struct(T.unit(F.col("doc_id").cast("string")).alias("u"), "doc_id").alias("first"))
    return rows.groupBy("key").agg(F.min("first").alias("first")).select("first.doc_id")


RANK = f"row_number() OVER (PARTITION BY source, lang ORDER BY {UNIT.format('doc_id::VARCHAR')}, doc_id)"


@query("first_n_by_hash", f"SELECT source, lang, doc_id FROM (SELECT *, {RANK} AS r FROM documents) WHERE r <= 2")
def first_n_by_hash(spark, d):
    order = Window.partitionBy("source", "lang").orderBy("u", "doc_id")
    rows = table(spark, d, "documents").select("source", "lang", "doc_id", T.unit(F.col("doc_id").cast("string")).alias("u"))
    return rows.withColumn("r", F.row_number().over(order)).where("r <= 2").select("source", "lang", "doc_id")


@query("balanced_sample", f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {UNIT.format('doc_id::VARCHAR')}, doc_id) AS r FROM documents) ORDER BY r, lang LIMIT 60")
def balanced_sample(spark, d):
    """60 documents, dealt out over the languages in turn, in hash order."""
    order = Window.partitionBy("lang").orderBy("u", "doc_id")
    rows = table(spark, d, "documents").select("doc_id", "lang", T.unit(F.col("doc_id").cast("string")).alias("u"))
    return rows.withColumn("r", F.row_number().over(order)).where("r <= 60").orderBy("r", "lang").limit(60).select("doc_id", "lang")


@query("one_per_group", f"SELECT source, arg_min(doc_id, ({UNIT.format('doc_id::VARCHAR')}, doc_id)) AS doc_id FROM documents GROUP BY source")
def one_per_group(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.min_by("doc_id", F.struct(T.unit(F.col("doc_id").cast("string")), "doc_id")).alias("doc_id"))


@query("manifest_counts", "SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS chars, count(*) FILTER (toxic = 1) AS toxic, count(*) FILTER (toxic IS NULL) AS unlabelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source, lang")
def manifest_counts(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return rows.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum(F.col("n_chars").cast("long")).alias("chars"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic").isNull()).alias("unlabelled"))


@query("filter_too_long", "SELECT source, count(*) AS kept FROM documents WHERE length(text) <= 3000 GROUP BY source")
def filter_too_long(spark, d):
    return table(spark, d, "documents").where(F.length("text") <= 3000).groupBy("source").agg(F.count("*").alias("kept"))


@query("duplicate_ids", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM documents) GROUP BY doc_id HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return table(spark, d, "labels").select("doc_id").unionByName(table(spark, d, "documents").select("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")


@query("join_examples", "SELECT lang, count(*) AS n, avg(quality)::DOUBLE AS quality, avg(toxic)::DOUBLE AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def join_examples(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic"))


@query("digest_except", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def digest_except(spark, d):
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


@query("strip_tags", "SELECT page_id, sha256(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS stripped FROM pages")
def strip_tags(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(F.regexp_replace("html", "<[^>]+>", " ").cast("binary"), 256).alias("stripped"))


@query("json_props_extract", "SELECT event_type, count(*) AS n, sum((props->>'$.k')::INT)::BIGINT AS k FROM events GROUP BY event_type")
def json_props_extract(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("int")).alias("k"))


@query("latency_summary", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(max(CASE WHEN i = least(n - 1, floor(0.95 * n)) THEN value END), 6) AS p95, round(avg(value), 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) GROUP BY event_type")
def latency_summary(spark, d):
    """Median, the order statistic at floor(0.95 n), and mean: equal values are counted before they are ranked."""
    rows = table(spark, d, "events").where("value IS NOT NULL")
    whole = rows.groupBy("event_type").agg(F.count("*").alias("n"), F.percentile("value", F.lit(0.5)).alias("median"), F.avg("value").alias("mean"))
    counted = rows.groupBy("event_type", "value").agg(F.count("*").alias("m")).withColumn("upto", F.sum("m").over(Window.partitionBy("event_type").orderBy("value")))
    place = F.least(F.col("n") - 1, F.floor(0.95 * F.col("n")))
    p95 = counted.join(F.broadcast(whole), "event_type").where(F.col("upto") > place).groupBy("event_type").agg(F.min("value").alias("p95"))
    return whole.join(p95, "event_type").select("event_type", rounded("median").alias("median"), rounded("p95").alias("p95"), rounded("mean").alias("mean"))


@query("latency_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(rounded(F.percentile("value", F.lit(0.5))).alias("p50"), rounded(F.percentile("value", F.lit(0.95))).alias("p95"))


MARK = "chr(10) || chr(10) || 'Assistant:'"
PREFERENCE = f"""WITH t AS (SELECT conv_id, turn, role, text FROM conversations),
c AS (SELECT a.conv_id, 'Human: ' || a.text || {MARK} || ' ' || b.text AS chosen, 'Human: ' || a.text || {MARK} || ' ' || coalesce(c.text, b.text) AS rejected
  FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 LEFT JOIN t c ON a.conv_id = c.conv_id AND c.turn = a.turn + 3 WHERE a.turn = 0),
p AS (SELECT *, length(chosen) - length(regexp_replace(chosen, '(?s)^.*\\n\\nAssistant:', '')) AS after FROM c WHERE contains(chosen, {MARK})),
q AS (SELECT conv_id, trim(substr(chosen, 1, after - 12)) AS state, trim(substr(chosen, after + 1)) AS a, trim(substr(rejected, after + 1)) AS b
  FROM p WHERE starts_with(rejected, substr(chosen, 1, after - 12)))
SELECT conv_id, sha256(state) AS state, sha256(a) AS o1, sha256(b) AS o2 FROM q WHERE a <> '' AND b <> '' AND a <> b"""


@query("convert_preference", PREFERENCE)
def convert_preference(spark, d):
    """Dialogues that differ after their last `Assistant:`: the answers to the first turn, the later one rejected."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text")
    at = lambda k, name: turns.select("conv_id", (F.col("turn") - k).alias("turn"), F.col("text").alias(name))
    both = at(0, "asked").where("turn = 0").join(at(1, "first"), ["conv_id", "turn"]).join(at(3, "second"), ["conv_id", "turn"], "left")
    say = lambda x: F.concat(F.lit("Human: "), F.col("asked"), F.lit("\n\nAssistant: "), x)
    rows = both.select("conv_id", say(F.col("first")).alias("chosen"), say(F.coalesce("second", "first")).alias("rejected"))
    found = preference(rows, "conv_id")
    return found.select("conv_id", *[F.sha2(F.col(c).cast("binary"), 256).alias(c) for c in ("state", "o1", "o2")])


def preference(rows: DataFrame, key: str) -> DataFrame:
    """key, state, o1 (chosen) and o2 (rejected) of pairs of dialogues with a common beginning up to the last `Assistant:`; others go."""
    mark, chosen = "\n\nAssistant:", F.col("chosen")
    cut = F.length(F.regexp_extract(chosen, r"(?s)^(.*)\n\nAssistant:", 1))
    kept = rows.where(F.instr(chosen, mark) > 0).withColumn("cut", cut).where(F.startswith("rejected", F.substring(chosen, F.lit(1), F.col("cut"))))
    tail = lambda c: F.trim(F.substring(F.col(c), F.col("cut") + len(mark) + 1, F.length(c)))
    out = kept.select(key, F.trim(F.substring(chosen, F.lit(1), F.col("cut"))).alias("state"), tail("chosen").alias("o1"), tail("rejected").alias("o2"))
    return out.where("o1 <> '' AND o2 <> '' AND o1 <> o2")


@query("answers_last_wins", "SELECT conv_id, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, text DESC) AS r FROM conversations) WHERE r = 1")
def answers_last_wins(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.max_by("text", F.struct("turn", "text")).alias("text"))


MONTH = "date_trunc('month', l_shipdate)"


@query("month_accuracy", f"SELECT l_returnflag AS flag, count(*) AS n, round(avg(hit), 6) AS accuracy FROM (SELECT l_returnflag, (l_returnflag = top)::INT AS hit FROM lineitem JOIN (SELECT {MONTH} AS m, arg_max(l_returnflag, (c, -ascii(l_returnflag))) AS top FROM (SELECT l_shipdate, l_returnflag, count(*) OVER (PARTITION BY {MONTH}, l_returnflag) AS c FROM lineitem) GROUP BY {MONTH}) t ON {MONTH} = t.m) GROUP BY l_returnflag")
def month_accuracy(spark, d):
    """How often the commonest return flag of a month is the row's: counts per month and flag suffice."""
    rows = table(spark, d, "lineitem").groupBy(F.trunc(F.col("l_shipdate").cast("date"), "month").alias("m"), "l_returnflag").agg(F.count("*").alias("c"))
    top = rows.groupBy("m").agg(F.max_by("l_returnflag", F.struct("c", -F.ascii("l_returnflag"))).alias("top"))
    both = rows.join(top, "m")
    return both.groupBy(F.col("l_returnflag").alias("flag")).agg(F.sum("c").alias("n"), rounded(F.sum(F.when(F.col("top") == F.col("l_returnflag"), F.col("c")).otherwise(0)) / F.sum("c")).alias("accuracy"))
