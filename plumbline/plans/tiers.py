"""Queries that build and audit tiers: groups, cleaning, contamination, quotas, policies, converters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.catalog import query
from plumbline.operators import text as T
from plumbline.operators import tiers as B
from plumbline.operators.predict import rounded
from plumbline.plans.corpus import CLASSES, NORM, POST, SEG, UNIT, N, table
from plumbline.plans.texts import EXAMPLES, LINE, NEAR, PASSAGE, examples, sha

DIGEST = "CASE WHEN length({0}) >= 24 THEN substr(sha256({0}), 1, 24) END"


def digest_sql(x: str) -> str:
    return DIGEST.format(NORM.format(x))


ITEM = "it AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN source ELSE '' END AS grp, 'd' || doc_id AS id FROM ex)"


def tier_items(spark, d):
    stance = T.split_stance(F.col("state"))
    return examples(spark, d).select("*", F.when(F.col("doc_id") % 5 == 0, F.col("source")).otherwise("").alias("group"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), stance["claim"].alias("claim"), stance["evidence"].alias("evidence"), F.array("lang", "source").alias("options"))


@query("group_key", f"WITH {EXAMPLES}, {ITEM}, t AS (SELECT doc_id, text FROM documents) SELECT it.doc_id, coalesce('group:' || nullif(grp, ''), CASE WHEN format = 'stance' THEN {digest_sql('t.text')} ELSE coalesce({digest_sql('state')}, {digest_sql(PASSAGE.format('question'))}, {digest_sql('question')}) END, id) AS grp FROM it JOIN t USING (doc_id)")
def group_key(spark, d):
    return tier_items(spark, d).select("doc_id", B.group_key().alias("grp"))


KEY = f"CASE WHEN format = 'stance' THEN {NORM.format(LINE)} || chr(0) || {N} ELSE {NORM.format('state')} || chr(0) || {NORM.format('question')} || chr(0) || {NORM.format('lang')} || chr(0) || {NORM.format('source')} END"


@query("dedup_key", f"WITH {EXAMPLES}, {ITEM} SELECT it.doc_id, sha256({KEY.replace('lang)', 'it.lang)').replace('source)', 'it.source)').replace('lower(regexp_replace(lang', 'lower(regexp_replace(it.lang').replace('lower(regexp_replace(source', 'lower(regexp_replace(it.source')}) AS key FROM it JOIN (SELECT doc_id, text FROM documents) t USING (doc_id)")
def dedup_key(spark, d):
    return tier_items(spark, d).select("doc_id", sha(B.dedup_key()).alias("key"))


@query("clean_tier", f"WITH k AS (SELECT doc_id, 'd' || doc_id AS id, {N} AS key, {digest_sql('text')} AS digest FROM documents), b AS (SELECT {digest_sql('text')} AS digest FROM benchmark), m AS (SELECT *, coalesce(digest IN (SELECT digest FROM b WHERE digest IS NOT NULL), false) AS hit FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY key, hit ORDER BY {UNIT.format('id')}, id) AS place FROM m) SELECT CASE WHEN hit THEN 'overlaps an earlier tier' WHEN place > 1 THEN 'duplicate in tier' ELSE 'kept' END AS reason, count(*) AS n FROM r GROUP BY 1")
def clean_tier(spark, d):
    """Documents against the benchmark: how many go, by reason, and how many stay."""
    digest = T.digest(F.col("text"))
    items = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), sha(T.norm(F.col("text"))).alias("key"), F.array_compact(F.array(digest)).alias("digests"))
    found = B.clean(items, table(spark, d, "benchmark").select(digest.alias("digest")).where("digest IS NOT NULL"))
    return found.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


BOTH = f"seg AS (SELECT DISTINCT doc_id FROM ({SEG.format(k='doc_id', t='documents')}) SEMI JOIN ({SEG.format(k='item_id', t='benchmark')}) USING (segment)), pd AS ({POST.format(k='doc_id', t='documents')}), {CLASSES}, pas AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, item_id FROM pd JOIN b USING (g) WHERE g IN (SELECT g FROM df WHERE n <= 3) GROUP BY doc_id, item_id HAVING count(*) >= 5))"
NEAR_DOCS = NEAR.replace("WITH a AS", "na AS").replace("b AS (SELECT item_id, list_filter", "nb AS (SELECT item_id, list_filter").replace("len(a.ws)", "len(na.ws)").replace("len(b.ws)", "len(nb.ws)").replace("list_intersect(a.ws, b.ws)", "list_intersect(na.ws, nb.ws)").replace("FROM a, b ", "FROM na, nb ")


@query("strict_reasons", f"WITH {BOTH}, {NEAR_DOCS}, nea AS (SELECT DISTINCT doc_id FROM p WHERE i / (x + y - i) >= 0.6), u AS (SELECT doc_id, 0 AS o FROM seg UNION ALL SELECT doc_id, 1 FROM pas UNION ALL SELECT doc_id, 2 FROM nea) SELECT doc_id, ['{B.SENTENCE}', '{B.PASSAGE}', '{B.NEAR}'][min(o) + 1] AS reason FROM u GROUP BY doc_id")
def strict_reasons(spark, d):
    return B.strict(table(spark, d, "documents"), "doc_id", table(spark, d, "benchmark"), "item_id")


@query("contamination_report", f"WITH {BOTH}, {NEAR_DOCS}, ex AS (SELECT DISTINCT doc_id FROM documents WHERE {digest_sql('text')} IN (SELECT {digest_sql('text')} FROM benchmark)) SELECT 'text' AS check_name, (SELECT count(*) FROM ex) AS n UNION ALL SELECT 'sentence', (SELECT count(*) FROM seg) UNION ALL SELECT 'passage', (SELECT count(*) FROM pas) UNION ALL SELECT 'near', (SELECT count(DISTINCT doc_id) FROM p WHERE i / (x + y - i) >= 0.6)")
def contamination_report(spark, d):
    """Documents that share something with the benchmark, by check; checks without a finding count 0."""
    docs, others = table(spark, d, "documents"), table(spark, d, "benchmark")
    digest = T.digest(F.col("text")).alias("digest")
    found = {
        "text": docs.select("doc_id", digest).join(others.select(digest).where("digest IS NOT NULL").distinct(), "digest", "left_semi"),
        "sentence": T.segments(docs, "doc_id", "text").join(T.segments(others, "item_id", "text").select("segment").distinct(), "segment", "left_semi"),
        "passage": T.shared_passages(docs, "doc_id", others, "item_id"),
        "near": T.near_duplicates(docs, "doc_id", others, "item_id"),
    }
    rows = None
    for name, frame in found.items():
        part = frame.select(F.lit(name).alias("check_name"), "doc_id")
        rows = part if rows is None else rows.unionByName(part)
    checks = spark.createDataFrame([(x,) for x in found], "check_name string")
    return checks.join(rows.groupBy("check_name").agg(F.countDistinct("doc_id").alias("n")), "check_name", "left").na.fill(0)


@query("digest_union", f"SELECT count(*) AS n FROM (SELECT {digest_sql('text')} AS g FROM documents UNION SELECT {digest_sql('text')} FROM benchmark) WHERE g IS NOT NULL")
def digest_union(spark, d):
    both = [table(spark, d, t).select(T.digest(F.col("text")).alias("g")) for t in ("documents", "benchmark")]
    return both[0].union(both[1]).where("g IS NOT NULL").distinct().agg(F.count("*").alias("n"))


@query("digest_intersect", f"SELECT g AS digest FROM (SELECT {digest_sql('text')} AS g FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT {digest_sql('text')} FROM documents WHERE doc_id % 2 = 1) WHERE g IS NOT NULL")
def digest_intersect(spark, d):
    """Digests that the documents with even and with odd ids share."""
    rows = table(spark, d, "documents").select("doc_id", T.digest(F.col("text")).alias("digest")).where("digest IS NOT NULL")
    return rows.groupBy("digest").agg(F.min(F.col("doc_id") % 2).alias("low"), F.max(F.col("doc_id") % 2).alias("high")).where("low <> high").select("digest")


@query("shingle_merge", f"WITH x AS (SELECT 0 AS seq, item_id AS key, g FROM ({POST.format(k='item_id', t='benchmark')}) UNION ALL SELECT 1, doc_id, g FROM ({POST.format(k='doc_id', t='documents')})), s AS (SELECT seq, key, sha256(list_aggregate(list_sort(list(g)), 'string_agg', chr(10))) AS class FROM x GROUP BY seq, key) SELECT class, min(seq)::INT AS seq, arg_min(key::VARCHAR, (seq, key::VARCHAR)) AS key FROM s GROUP BY class")
def shingle_merge(spark, d):
    """One entry for each set of shingles of two indexes: the first index's key where both have it."""
    classes = [T.shingle_classes(table(spark, d, t), k).select(F.lit(i).alias("seq"), F.col(k).cast("string").alias("key"), "class") for i, (t, k) in enumerate((("benchmark", "item_id"), ("documents", "doc_id")))]
    first = classes[0].unionByName(classes[1]).groupBy("class").agg(F.min(F.struct("seq", "key")).alias("first"))
    return first.select("class", "first.seq", "first.key")


@query("eval_group", "SELECT doc_id, source || ':' || coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN lang ELSE '' END, ''), nullif(CASE WHEN doc_id % 5 = 0 THEN source ELSE '' END, ''), doc_id::VARCHAR) AS grp FROM documents")
def eval_group(spark, d):
    rows = table(spark, d, "documents").withColumn("cluster", F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise("")).withColumn("group", F.when(F.col("doc_id") % 5 == 0, F.col("source")).otherwise(""))
    return rows.select("doc_id", F.concat("source", F.lit(":"), F.coalesce(B.filled("cluster"), B.filled("group"), F.col("doc_id").cast("string"))).alias("grp"))


@query("ab_halves", "SELECT source, ('0x' || substr(sha256(source), 1, 8))::BIGINT % 2 AS half, count(*) AS n FROM documents GROUP BY source")
def ab_halves(spark, d):
    half = F.conv(F.substring(F.sha2(F.col("source").cast("binary"), 256), 1, 8), 16, 10).cast("long") % 2
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).select("source", half.alias("half"), "n")


def hashed(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", T.unit(F.col("doc_id").cast("string")).alias("u"))


TURN = f"SELECT *, row_number() OVER (PARTITION BY {{0}} ORDER BY {UNIT.format('doc_id::VARCHAR')}, doc_id) AS turn FROM documents"


@query("quota", f"SELECT lang, source, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY turn, source) AS place FROM ({TURN.format('lang, source')})) WHERE place <= 25 GROUP BY lang, source")
def quota(spark, d):
    """25 documents of each language, dealt out over the sources in turn."""
    return B.round_robin(hashed(spark, d), ["source"], ["u", "doc_id"], 25, ["lang"]).groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("limit_train", f"SELECT doc_id, source FROM ({TURN.format('source')}) ORDER BY turn, source LIMIT 80")
def limit_train(spark, d):
    return B.round_robin(hashed(spark, d), ["source"], ["u", "doc_id"], 80).select("doc_id", "source")


@query("hash_order_topk", f"SELECT doc_id FROM documents ORDER BY {UNIT.format('doc_id::VARCHAR')}, doc_id LIMIT 50")
def hash_order_topk(spark, d):
    return hashed(spark, d).orderBy("u", "doc_id").limit(50).select("doc_id")


@query("tier_order", f"SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY {UNIT.format('doc_id::VARCHAR')}, doc_id) AS place FROM documents")
def tier_order(spark, d):
    """The final order: language, source, hash; a place within the first two is what a later part needs."""
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy("u", "doc_id"))
    return hashed(spark, d).select("lang", "source", "doc_id", place.alias("place")).orderBy("lang", "source", "place")


@query("bucketize_levels", "SELECT event_type, 1 + (v >= 0.1)::INT + (v >= 0.3)::INT + (v >= 0.5)::INT + (v >= 0.7)::INT AS level, count(*) AS n FROM (SELECT event_type, value / 100 AS v FROM events WHERE value IS NOT NULL) GROUP BY ALL")
def bucketize_levels(spark, d):
    """The bounds of five bands."""
    return table(spark, d, "events").where("value IS NOT NULL").groupBy("event_type", B.banded(F.col("value") / 100, [0.1, 0.3, 0.5, 0.7]).alias("level")).agg(F.count("*").alias("n"))


@query("convert_bool", "SELECT doc_id, CASE WHEN quality = 1 THEN 'true' ELSE 'false' END AS label FROM labels WHERE quality IS NOT NULL")
def convert_bool(spark, d):
    return table(spark, d, "labels").select("doc_id", B.boolean(F.col("quality") == 1).alias("label")).where("label IS NOT NULL")


@query("convert_score", "SELECT doc_id, (least(4, n_chars // 1000) + 1)::VARCHAR AS label FROM documents WHERE text IS NOT NULL")
def convert_score(spark, d):
    level = F.least(F.lit(4), F.expr("n_chars div 1000")) + 1
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", level.cast("string").alias("label"))


NAMES = ["world", "sports", "business", "science"]


@query("convert_choice", "SELECT vec_id, ['world', 'sports', 'business', 'science'][label + 1] AS name FROM embeddings WHERE label BETWEEN 0 AND 3")
def convert_choice(spark, d):
    return B.choice(table(spark, d, "embeddings"), "label", NAMES).select("vec_id", F.col("right").alias("name"))


OPTIONS = ", ".join(f"'option {i}'" for i in range(14))


@query("sample_options_hash", f"WITH o AS (SELECT doc_id, unnest([{OPTIONS}]) AS o, 'option ' || (doc_id % 14) AS r FROM documents), h AS (SELECT doc_id, o, r, row_number() OVER (PARTITION BY doc_id, o = r ORDER BY sha256(doc_id || ':' || o)) AS k FROM o) SELECT doc_id, list_sort(list(o)) AS shown FROM h WHERE o = r OR k <= 9 GROUP BY doc_id")
def sample_options_hash(spark, d):
    options, key = F.array(*[F.lit(f"option {i}") for i in range(14)]), F.col("doc_id").cast("string")
    right = F.concat(F.lit("option "), (F.col("doc_id") % 14).cast("string"))
    return table(spark, d, "documents").select("doc_id", F.array_sort(B.sample_options(options, right, key)).alias("shown"))


#: Sources as a registry lists them: name, format, tier, licences, decision (treated as, reason, quote), whether used.
REGISTRY = [
    ("news", "general", "fit", ["mit"], None, None, None, True), ("forum", "general", "fit", ["cc-by-sa"], None, None, None, True),
    ("claims", "stance", "fit", ["cc-by-sa", "mit"], None, None, None, True), ("mixed", "general", "fit", ["unknown"], "cc-by", "see the card", "text", False),
    ("noproof", "general", "dev", ["mit"], "mit", "said so", "", True), ("empty", "general", "final", [], None, None, None, True), ("shared", "general", "fit", ["mit"], "cc-by-sa", "why", "there", True),
]
PERMISSIVE, SHARE_ALIKE = ["mit", "apache-2.0", "cc-by"], ["cc-by-sa"]


def _registry_sql() -> str:
    quote = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else "[" + ", ".join(f"'{v}'" for v in x) + "]::VARCHAR[]"
    return "reg(name, format, tier, licence, treat_as, reason, quote, use) AS (VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in REGISTRY) + ")"


ALLOWED = "CASE WHEN format = 'stance' THEN ['mit', 'apache-2.0', 'cc-by', 'cc-by-sa'] ELSE ['mit', 'apache-2.0', 'cc-by'] END"
OUTSIDE = f"list_filter(licence, lambda x: NOT list_contains({ALLOWED}, x))"
POLICY = f"{_registry_sql()}, pol AS (SELECT *, CASE WHEN len(licence) = 0 THEN 'no licence recorded' WHEN treat_as IS NULL AND len({OUTSIDE}) > 0 THEN 'not allowed: ' || array_to_string({OUTSIDE}, ', ') WHEN treat_as IS NULL THEN NULL WHEN nullif(reason, '') IS NULL OR nullif(quote, '') IS NULL THEN 'the decision names no reason or quotes no evidence' WHEN NOT list_contains({ALLOWED}, treat_as) THEN 'treated as ' || treat_as END AS why FROM reg)"


def registry(spark):
    rows = spark.createDataFrame(REGISTRY, "name string, format string, tier string, licence array<string>, treat_as string, reason string, quote string, use boolean")
    return B.fit_allowed(rows, PERMISSIVE, SHARE_ALIKE, ["stance"])


@query("licence_policy", f"WITH {POLICY} SELECT name, why IS NULL AS allowed, why FROM pol")
def licence_policy(spark, d):
    return registry(spark).select("name", "allowed", "why")


@query("policy_violations", f"WITH {POLICY} SELECT name, CASE WHEN use THEN 'fitted on without leave' ELSE 'left out without need' END AS problem FROM pol WHERE tier = 'fit' AND use <> (why IS NULL)")
def policy_violations(spark, d):
    rows = registry(spark).where((F.col("tier") == "fit") & (F.col("use") != F.col("allowed")))
    return rows.select("name", F.when(F.col("use"), "fitted on without leave").otherwise("left out without need").alias("problem"))


@query("licence_used", f"WITH {_registry_sql()} SELECT name, CASE WHEN treat_as IS NOT NULL THEN [treat_as] ELSE licence END AS licence FROM reg")
def licence_used(spark, d):
    return registry(spark).select("name", B.licence_used().alias("licence"))


RANKS = {"fit": 0, "dev": 1, "final": 2}


@query("sources_report", f"WITH {_registry_sql()} SELECT name, CASE WHEN use THEN tier ELSE 'not used' END AS tier, row_number() OVER (ORDER BY CASE tier WHEN 'fit' THEN 0 WHEN 'dev' THEN 1 ELSE 2 END, name) AS place FROM reg")
def sources_report(spark, d):
    """Sources by rank of tier and name. A registry is a short list, so one window orders it."""
    rank = F.when(F.col("tier") == "fit", 0).when(F.col("tier") == "dev", 1).otherwise(2)
    return registry(spark).select("name", F.when(F.col("use"), F.col("tier")).otherwise("not used").alias("tier"), F.row_number().over(Window.orderBy(rank, "name")).alias("place"))


SPLIT = f"CASE WHEN {UNIT.format("'split:' || doc_id")} < 0.7 THEN 'train' WHEN {UNIT.format("'split:' || doc_id")} < 0.85 THEN 'validation' ELSE 'test' END"


def split_of():
    u = T.unit(F.concat(F.lit("split:"), F.col("doc_id").cast("string")))
    return F.when(u < 0.7, "train").when(u < 0.85, "validation").otherwise("test")


@query("fitted_on", f"SELECT source, count(*) FILTER (s = 'train') AS train, count(*) FILTER (s = 'validation') AS validation FROM (SELECT source, {SPLIT} AS s FROM documents) GROUP BY source HAVING count(*) FILTER (s <> 'test') > 0")
def fitted_on(spark, d):
    rows = table(spark, d, "documents").select("source", split_of().alias("s")).groupBy("source")
    return rows.agg(F.count_if(F.col("s") == "train").alias("train"), F.count_if(F.col("s") == "validation").alias("validation")).where("train + validation > 0")


@query("tier_sources", f"SELECT s AS tier, list_sort(list(DISTINCT source)) AS sources, count(*) AS n FROM (SELECT source, {SPLIT} AS s FROM documents) GROUP BY s")
def tier_sources(spark, d):
    return table(spark, d, "documents").groupBy(split_of().alias("tier")).agg(F.array_sort(F.collect_set("source")).alias("sources"), F.count("*").alias("n"))


@query("family_two_tiers", f"SELECT family, list_sort(list(DISTINCT s)) AS tiers FROM (SELECT source || ':' || (doc_id % 40) AS family, {SPLIT} AS s FROM documents) GROUP BY family HAVING count(DISTINCT s) > 1")
def family_two_tiers(spark, d):
    rows = table(spark, d, "documents").groupBy(F.concat("source", F.lit(":"), (F.col("doc_id") % 40).cast("string")).alias("family")).agg(F.array_sort(F.collect_set(split_of())).alias("tiers"))
    return rows.where(F.size("tiers") > 1)


@query("drop_accounting", "SELECT source, CASE WHEN length(text) < 200 THEN 'too short' WHEN length(text) > 5000 THEN 'too long' ELSE 'kept' END AS reason, count(*) AS n FROM documents GROUP BY ALL")
def drop_accounting(spark, d):
    size = F.length("text")
    return table(spark, d, "documents").groupBy("source", F.when(size < 200, "too short").when(size > 5000, "too long").otherwise("kept").alias("reason")).agg(F.count("*").alias("n"))


@query("claim_doc_pairs", "WITH c AS (SELECT item_id, unnest([item_id, item_id * 3, -1]) AS doc_id FROM benchmark) SELECT item_id, c.doc_id, source, d.doc_id IS NOT NULL AS found FROM c LEFT JOIN documents d ON c.doc_id = d.doc_id")
def claim_doc_pairs(spark, d):
    """Claims with lists of document ids: one row for each, with the document where there is one."""
    claims = table(spark, d, "benchmark").select("item_id", F.explode(F.array("item_id", F.col("item_id") * 3, F.lit(-1).cast("long"))).alias("doc_id"))
    docs = table(spark, d, "documents").select("doc_id", "source", F.lit(True).alias("there"))
    return claims.join(docs, "doc_id", "left").select("item_id", "doc_id", "source", F.coalesce("there", F.lit(False)).alias("found"))


@query("label_index", "SELECT doc_id, list_position(['de', 'en', 'fr'], lang) - 1 AS label FROM documents WHERE list_contains(['de', 'en', 'fr'], lang)")
def label_index(spark, d):
    """The number of the option that a label names; labels that name none go."""
    at = F.array_position(F.array(F.lit("de"), F.lit("en"), F.lit("fr")), F.col("lang"))
    return table(spark, d, "documents").select("doc_id", (at - 1).alias("label")).where("label >= 0")


@query("external_probs", "SELECT doc_id, [p, 1 - p, 0.0::DOUBLE] AS probs FROM (SELECT doc_id, (doc_id % 7) / 8 AS p FROM documents)")
def external_probs(spark, d):
    """An answer's JSON map as a vector in the order of the options; an option that it doesn't name has 0."""
    p = (F.col("doc_id") % 7) / 8
    answer = F.format_string('{"no": %s, "yes": %s}', (1 - p).cast("string"), p.cast("string"))
    named = F.from_json(answer, "map<string,double>")
    return table(spark, d, "documents").select("doc_id", F.transform(F.array(F.lit("yes"), F.lit("no"), F.lit("other")), lambda k: F.coalesce(F.try_element_at(named, k), F.lit(0.0))).alias("probs"))


@query("head_resolution", "WITH h(format, head) AS (VALUES ('en', 'head-en'), ('fr', 'head-fr'), ('*', 'head-any')) SELECT doc_id, coalesce(a.head, b.head) AS head, coalesce(a.format, b.format) AS head_format FROM documents LEFT JOIN h a ON a.format = lang LEFT JOIN h b ON b.format = '*'")
def head_resolution(spark, d):
    """The head of an item's format, or else the one for all formats. Heads are a short list."""
    heads = spark.createDataFrame([("en", "head-en"), ("fr", "head-fr"), ("*", "head-any")], "format string, head string")
    own = heads.where("format <> '*'").select(F.col("format").alias("lang"), "head", "format")
    other = heads.where("format = '*'").select(F.col("head").alias("any"), F.col("format").alias("star"))
    return table(spark, d, "documents").select("doc_id", "lang").join(own, "lang", "left").join(F.broadcast(other), F.lit(True), "left").select("doc_id", F.coalesce("head", "any").alias("head"), F.coalesce("format", "star").alias("head_format"))


@query("transient_errors", "SELECT event_type, error IS NULL OR starts_with(error, 'HTTP 400') AS stays, count(*) AS n FROM (SELECT event_type, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'HTTP 400: no' WHEN 2 THEN 'HTTP 503' ELSE 'timeout' END AS error FROM events) GROUP BY ALL")
def transient_errors(spark, d):
    """Answers that stay, and those that are asked for again: errors other than a refusal."""
    k = F.col("event_id") % 4
    error = F.when(k == 1, "HTTP 400: no").when(k == 2, "HTTP 503").when(k == 3, "timeout")
    rows = table(spark, d, "events").select("event_type", error.alias("error"))
    return rows.groupBy("event_type", (F.col("error").isNull() | F.startswith("error", F.lit("HTTP 400"))).alias("stays")).agg(F.count("*").alias("n"))


@query("parse_kv_lines", "SELECT doc_id, lang AS value, 'lang' AS key FROM documents UNION ALL SELECT doc_id, source || ' := x', 'source' FROM documents")
def parse_kv_lines(spark, d):
    """`key := value` lines as rows; what follows the first mark is the value, and lines without one go."""
    text = F.concat(F.lit("lang := "), "lang", F.lit("\nno mark here\nsource := "), "source", F.lit(" := x"))
    pairs = F.filter(F.transform(F.split(text, "\n"), lambda x: F.split(x, " := ", 2)), lambda x: F.size(x) == 2)
    return table(spark, d, "documents").select("doc_id", F.explode(pairs).alias("x")).select("doc_id", F.col("x")[0].alias("key"), F.col("x")[1].alias("value"))


@query("default_option", "SELECT doc_id, coalesce(CASE lang WHEN 'en' THEN 'h1' WHEN 'de' THEN 'temperature' END, 'h2') AS chosen FROM documents")
def default_option(spark, d):
    known = F.create_map(F.lit("en"), F.lit("h1"), F.lit("de"), F.lit("temperature"))
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.try_element_at(known, F.col("lang")), F.lit("h2")).alias("chosen"))


@query("common_items", "SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id IN (SELECT vec_id FROM embeddings)")
def common_items(spark, d):
    """Ids that all systems answered."""
    sets = [table(spark, d, "labels").where("quality = 1").select("doc_id"), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))]
    out = table(spark, d, "documents").where("lang = 'en'").select("doc_id")
    for other in sets:
        out = out.join(other.distinct(), "doc_id", "left_semi")
    return out


@query("eval_record_filter", "SELECT type, count(*) AS n FROM (SELECT CASE vec_id % 3 WHEN 0 THEN 'choice' WHEN 1 THEN 'bool' ELSE 'score' END AS type, unnest(range(4)) AS rot FROM embeddings) WHERE type = 'bool' AND rot < 2 OR rot = 0 GROUP BY type")
def eval_record_filter(spark, d):
    """Without rotations a yes/no item keeps its records, others that of rotation 0."""
    from plumbline.sources.readouts import readouts

    return readouts(spark, d).where("rot = 0 OR type = 'bool'").groupBy("type").agg(F.count("*").alias("n"))
