"""Queries over the texts that identify items: sets of words, passages, groups, prompts, hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import query
from plumbline.operators import text as T
from plumbline.operators.predict import rounded
from plumbline.plans.corpus import NORM, N, table

WORDS = "list_filter(list_distinct(string_split({0}, ' ')), lambda x: x <> '')"
LINE = "string_split(text, chr(10))[1]"
STATE = f"'Claim: ' || {LINE} || chr(10) || chr(10) || 'Evidence: ' || text"


def sha(column):
    return F.sha2(column.cast("binary"), 256)


def first_line(column="text"):
    return F.element_at(F.split(F.col(column), "\n"), 1)


def examples(spark, d):
    """Documents as rendered items: those in English are stance items, the others general ones with their text as the question."""
    stance = F.concat(F.lit("Claim: "), first_line(), F.lit("\n\nEvidence: "), F.col("text"))
    english = F.col("lang") == "en"
    return table(spark, d, "documents").select("doc_id", "lang", "source", F.when(english, "stance").otherwise("general").alias("format"), F.when(english, stance).otherwise(first_line()).alias("state"), F.when(~english, F.col("text")).alias("question"))


EXAMPLES = f"ex AS (SELECT doc_id, lang, source, CASE WHEN lang = 'en' THEN 'stance' ELSE 'general' END AS format, CASE WHEN lang = 'en' THEN {STATE} ELSE {LINE} END AS state, CASE WHEN lang <> 'en' THEN text END AS question FROM documents)"
HEAD = r"regexp_extract(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '(?s)^(.*)\n', 1)"
PASSAGE = f"CASE WHEN length({NORM.format(HEAD)}) >= 100 THEN {HEAD} ELSE '' END"


@query("jaccard_pairs", f"WITH w AS (SELECT doc_id, {WORDS.format(N)} AS ws FROM documents) SELECT a.doc_id, round(len(list_intersect(a.ws, b.ws)) / nullif(len(list_distinct(list_concat(a.ws, b.ws))), 0), 6) AS jaccard FROM w a JOIN w b ON b.doc_id = a.doc_id + 1")
def jaccard_pairs(spark, d):
    """Word overlap of each document and the next."""
    rows = table(spark, d, "documents").select("doc_id", T.word_set(F.col("text")).alias("ws"))
    later = rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("ws").alias("other"))
    return rows.join(later, "doc_id").select("doc_id", rounded(T.jaccard(F.col("ws"), F.col("other"))).alias("jaccard"))


NEAR = f"WITH a AS (SELECT doc_id, {WORDS.format(N)} AS ws FROM documents), b AS (SELECT item_id, {WORDS.format(N)} AS ws FROM benchmark), p AS (SELECT doc_id, item_id, len(list_intersect(a.ws, b.ws)) AS i, len(a.ws) AS x, len(b.ws) AS y FROM a, b WHERE len(a.ws) >= 6 AND len(b.ws) >= 6)"


@query("contam_near", NEAR + " SELECT doc_id, item_id, round(i / (x + y - i), 6) AS jaccard FROM p WHERE i / (x + y - i) >= 0.6")
def contam_near(spark, d):
    return T.near_duplicates(table(spark, d, "documents"), "doc_id", table(spark, d, "benchmark"), "item_id").select("doc_id", "item_id", rounded("jaccard").alias("jaccard"))


@query("passage_of", f"SELECT doc_id, sha256({PASSAGE.format('text')}) AS passage FROM documents")
def passage_of(spark, d):
    return table(spark, d, "documents").select("doc_id", sha(T.passage_of(F.col("text"))).alias("passage"))


@query("split_stance", f"SELECT doc_id, sha256({LINE}) AS claim, sha256(text) AS evidence FROM documents")
def split_stance(spark, d):
    state = F.concat(F.lit("Claim: "), first_line(), F.lit("\n\nEvidence: "), F.col("text"))
    return table(spark, d, "documents").select("doc_id", T.split_stance(state).alias("x")).select("doc_id", sha(F.col("x.claim")).alias("claim"), sha(F.col("x.evidence")).alias("evidence"))


@query("identity_texts", f"SELECT doc_id, 'claim' AS name, sha256({LINE}) AS text FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 'evidence', sha256(text) FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 'state', sha256({LINE}) FROM documents WHERE lang <> 'en' UNION ALL SELECT doc_id, 'question', sha256(text) FROM documents WHERE lang <> 'en' UNION ALL SELECT doc_id, 'question_passage', sha256({PASSAGE.format('text')}) FROM documents WHERE lang <> 'en'")
def identity_texts(spark, d):
    return T.identity_texts(examples(spark, d), "doc_id").select("doc_id", "name", sha(F.col("text")).alias("text"))


@query("slug", f"SELECT doc_id, regexp_replace(regexp_replace(lower({LINE}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM documents")
def slug(spark, d):
    return table(spark, d, "documents").select("doc_id", T.slug(first_line()).alias("slug"))


@query("short_group", f"SELECT doc_id, 'prompt:' || substr(sha256({NORM.format(LINE)}), 1, 16) AS grp FROM documents")
def short_group(spark, d):
    return table(spark, d, "documents").select("doc_id", T.short_group("prompt:", first_line()).alias("grp"))


def _unwiki(x: str) -> str:
    for token, sign in T.WIKI.items():
        x = f"replace({x}, '{token}', '{sign}')"
    return f"trim(replace({x}, '_', ' '))"


TITLE = "' _' || source || '_-LRB-' || lang || '-RRB--COLON-_' || doc_id"


@query("unwiki", f"SELECT doc_id, {_unwiki(TITLE)} AS title, {NORM.format(_unwiki(TITLE))} AS page_key FROM documents")
def unwiki(spark, d):
    title = T.unwiki(F.concat(F.lit(" _"), "source", F.lit("_-LRB-"), "lang", F.lit("-RRB--COLON-_"), F.col("doc_id").cast("string")))
    return table(spark, d, "documents").select("doc_id", title.alias("title"), T.norm(title).alias("page_key"))


FNV = "lower(lpad(to_hex((list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT))::UBIGINT), 16, '0'))"


@query("fnv_hash", f"SELECT doc_id, {FNV.format("'doc-' || doc_id")} AS h FROM documents")
def fnv_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", T.fnv1a(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).alias("h"))


@query("order_unsigned", f"SELECT doc_id, rank FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS rank FROM (SELECT doc_id, source, {FNV.format("'doc-' || doc_id")} AS h FROM documents))")
def order_unsigned(spark, d):
    """Places in the order of unsigned hashes, which the order of their hexadecimal digits is, within a source."""
    from pyspark.sql import Window

    rows = table(spark, d, "documents").select("doc_id", "source", T.fnv1a(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).alias("h"))
    return rows.select("doc_id", F.row_number().over(Window.partitionBy("source").orderBy("h", "doc_id")).alias("rank"))


HEX = "hex(encode(text))"
CUT = "CASE WHEN octet_length(encode(text)) <= 200 THEN {0} WHEN substr({0}, 401, 2) NOT BETWEEN '80' AND 'BF' THEN substr({0}, 1, 400) WHEN substr({0}, 399, 2) NOT BETWEEN '80' AND 'BF' THEN substr({0}, 1, 398) WHEN substr({0}, 397, 2) NOT BETWEEN '80' AND 'BF' THEN substr({0}, 1, 396) ELSE substr({0}, 1, 394) END".format(HEX)


@query("truncate_state", f"SELECT doc_id, sha256(decode(unhex({CUT}))) AS state FROM documents")
def truncate_state(spark, d):
    return table(spark, d, "documents").select("doc_id", sha(T.truncate_utf8(F.col("text"), 200)).alias("state"))


BODY = f"'QUESTION' || chr(10) || {LINE} || chr(10) || 'OPTIONS' || chr(10) || 'A. ' || lang || chr(10) || 'B. ' || replace(text, chr(10), ' ') || chr(10) || 'C. ' || source"


def _body():
    return T.prompt_body(first_line(), F.array("lang", "text", "source"))


@query("prompt_body", f"SELECT doc_id, sha256({BODY}) AS body FROM documents")
def prompt_body(spark, d):
    return table(spark, d, "documents").select("doc_id", sha(_body()).alias("body"))


@query("prompt_text", f"SELECT doc_id, sha256('<begin>' || text || chr(10) || chr(10) || {BODY} || '<end>') AS prompt FROM documents")
def prompt_text(spark, d):
    """Prefix, state, body and suffix, put together."""
    return table(spark, d, "documents").select("doc_id", sha(F.concat(F.lit("<begin>"), "text", F.lit("\n\n"), _body(), F.lit("<end>"))).alias("prompt"))


@query("render_wording", f"SELECT doc_id, sha256(replace('Is this so? {{q}}', '{{q}}', {LINE})) AS question FROM documents")
def render_wording(spark, d):
    return table(spark, d, "documents").select("doc_id", sha(F.replace(F.lit("Is this so? {q}"), F.lit("{q}"), first_line())).alias("question"))


PLAIN = NORM.format("regexp_replace(html, '<[^>]+>', ' ', 'g')")


@query("quote_containment", f"WITH p AS (SELECT page_id, {PLAIN} AS n FROM pages), q AS (SELECT page_id, substr(n, 1, 40) AS quote FROM p) SELECT p.page_id, contains(p.n, q.quote) AS found FROM p JOIN q ON q.page_id = (p.page_id // 2) * 2")
def quote_containment(spark, d):
    """Whether a page holds the quote of the page before (or its own): a lookup join, then containment."""
    rows = table(spark, d, "pages").select("page_id", T.norm(F.regexp_replace("html", "<[^>]+>", " ")).alias("n"))
    quotes = rows.select(F.col("page_id").alias("of"), F.substring("n", 1, 40).alias("quote"))
    return rows.withColumn("of", F.expr("(page_id div 2) * 2")).join(quotes, "of").select("page_id", F.contains("n", "quote").alias("found"))


@query("page_exclusion", "SELECT user_id FROM (SELECT user_id, list(DISTINCT event_type) AS kinds FROM events GROUP BY user_id) WHERE NOT list_has_any(kinds, ['purchase', 'error'])")
def page_exclusion(spark, d):
    """Groups none of whose members is on the list of what is left out."""
    sets = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    return sets.where(~F.arrays_overlap("kinds", F.array(F.lit("purchase"), F.lit("error")))).select("user_id")
