"""Secret scans: patterns for known forms, and character Markov models for the rest; DataFrame functions alone.

Two first-order Markov models, of random strings and of ordinary identifiers, are trained from labelled samples
that rules generate: bigram counts by class, with add-one smoothing, made by a Spark query. Their difference is
a table of one log-likelihood ratio for each pair of characters, which scoring folds over a candidate: a run of
16 or more characters of the base64 alphabet. A pair of the same character never speaks for random, so that rules
and runs such as `-----` or `xxxxx`, which the samples don't hold, aren't taken for it. A candidate whose mean
ratio is above a margin, which the samples calibrate, is a span of kind `random`, unless it meets a span that a
pattern gave: those stay as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed patterns of the three known kinds, with the least length of what counts, and of which group.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
KINDS = ("assign", "access", "hex", "random")
#: Ordinary parts of identifiers; samples of the second class are put together from them.
PARTS = "get set is has on to from with for and or of in the a an new old last first next item user name file path list map key value index count size time date page text line word data node tree graph table row column type class object method function param result error status state event handler manager service client server request response message queue buffer stream reader writer parser builder factory helper util test case config option default version update delete insert select where order group join left right inner outer start end begin stop run main init load save open close read write copy move this that was were have been http https www com org html index image images static assets style script content post article section chapter verein heit keit schaft lich ung sich der die das und mit von für nicht eine einer pour avec dans plus tion ment eux que les des est une para con del los las por más cion mente ando ado able ible ation ness ing ther tion and ent".split()
SAMPLES = 4000
SPANS = "array<struct<kind:string,start:int,end:int>>"
CHARACTERS = 128


def samples(spark: SparkSession) -> DataFrame:
    """Labelled samples, from rules: random (label 1) in hexadecimal, base64 or base 36, and identifiers (label 0)."""
    n = F.col("id").cast("string")
    sha = lambda salt: F.sha2(F.concat(F.lit(salt), n), 256)
    bits = F.base64(F.unhex(sha("b")))
    length = (16 + F.conv(F.substring(sha("l"), 1, 2), 16, 10).cast("int") % 25).cast("int")
    text = F.when(F.col("id") % 3 == 0, sha("h")).when(F.col("id") % 3 == 1, bits).otherwise(F.concat(*[F.lower(F.conv(F.substring(sha("c"), 1 + 12 * k, 12), 16, 36)) for k in range(5)]))
    random = spark.range(SAMPLES).select(F.lit(1).alias("label"), F.substring(text, F.lit(1), length).alias("sample"))
    words = F.array(*map(F.lit, PARTS))
    pick = lambda k: F.element_at(words, (F.conv(F.substring(sha("w"), 1 + 4 * k, 4), 16, 10).cast("int") % len(PARTS) + 1).cast("int"))
    parts = F.array(*[pick(k) for k in range(6)])
    joined = F.when(F.col("id") % 4 == 0, F.array_join(parts, "_")).when(F.col("id") % 4 == 1, F.array_join(F.transform(parts, F.initcap), "")).when(F.col("id") % 4 == 2, F.array_join(parts, "")).otherwise(F.concat_ws("-", F.upper(F.array_join(parts, "_")), F.col("id") % 2100))
    return random.unionByName(spark.range(SAMPLES).select(F.lit(0).alias("label"), joined.alias("sample")))


def _place(a: Column, b: Column) -> Column:
    """Number of a pair of characters; those beyond ASCII count as one."""
    return F.least(F.ascii(a), F.lit(CHARACTERS - 1)) * CHARACTERS + F.least(F.ascii(b), F.lit(CHARACTERS - 1))


def mean_ratio(text: Column, table: Column) -> Column:
    """Mean of the table's log-likelihood ratios over a string's pairs of characters."""
    characters = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))  # a substring by position would pass over the text again for each
    n = F.greatest(F.size(characters) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(characters, F.lit(1), n), F.slice(characters, F.lit(2), n), lambda a, b: F.element_at(table, (_place(a, b) + 1).cast("int")))
    return F.when(F.length(text) > 1, F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / (F.length(text) - 1)).otherwise(F.lit(0.0))


def train(spark: SparkSession) -> tuple[list[float], float]:
    """The table of log-likelihood ratios of the two models, and the margin above which a string is random.

    The margin is the mean of the 99.9th percentile of the identifiers' ratios and the median of the random ones'.
    """
    known = samples(spark)
    pairs = known.select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length("sample") - 1), lambda i: _place(F.substring("sample", i, F.lit(1)), F.substring("sample", i + 1, F.lit(1))))).alias("place"))
    counts = {(r.label, r.place): r.n for r in pairs.groupBy("label", "place").agg(F.count("*").alias("n")).collect()}
    table = [0.0] * CHARACTERS**2
    for a in range(CHARACTERS):
        total = [sum(counts.get((c, a * CHARACTERS + b), 0) for b in range(CHARACTERS)) + CHARACTERS for c in (0, 1)]
        for b in range(CHARACTERS):
            one, zero = (counts.get((c, a * CHARACTERS + b), 0) + 1 for c in (1, 0))
            ratio = round(math.log(one / total[1]) - math.log(zero / total[0]), 4)
            table[a * CHARACTERS + b] = min(ratio, 0.0) if a == b else ratio
    scored = known.select("label", mean_ratio(F.col("sample"), literal(table)).alias("ratio"))
    limits = scored.groupBy("label").agg(F.percentile("ratio", F.lit(0.999)).alias("high"), F.percentile("ratio", F.lit(0.5)).alias("middle")).collect()
    by = {r.label: r for r in limits}
    return table, (by[0].high + by[1].middle) / 2


def literal(table: list[float]) -> Column:
    """The table as a literal: parsing JSON is folded before a query runs."""
    return F.from_json(F.lit(str(table)), "array<double>")


def _matches(text: Column, pattern: str, group: int, least: int, kind: str) -> Column:
    """Spans of the leftmost matches that don't overlap; those whose group is shorter than least are dropped.

    What lies between matches, and the matches, are lists of strings; their lengths add up to the positions.
    """
    whole, part, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.split(text, pattern, -1)
    rows = F.arrays_zip(whole.alias("whole"), part.alias("part"), F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(x["gap"])
        end = begin + F.length(x["whole"])
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.length(x["part"]) >= least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    found = F.aggregate(rows, start, step)["spans"]
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPANS))


def _sorted(spans: Column) -> Column:
    """By start, then in the order of the kinds."""
    order = lambda x: F.struct(x["start"], F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("k"), x["end"], x["kind"])
    return F.transform(F.array_sort(F.transform(spans, order)), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def scan(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Spans of secrets in texts.

    Returns, for each row of docs, `row` (a struct of the kept columns, all by default), base (spans that the
    patterns gave) and spans (these and the models'), each sorted by start, then kind: lists of kind, start, end
    (code points, end exclusive). Null and empty texts have none. Spans of different kinds can overlap; those of
    one kind don't, and a `random` one meets no other.
    """
    keep = docs.columns if keep is None else keep
    table, margin = train(docs.sparkSession)
    text = F.col("text")
    packed = docs.select((F.struct(*[docs[c].alias(c) for c in keep]) if keep else F.struct(F.lit(0).alias("none"))).alias("row"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    found = packed.select("row", "text", _matches(text, ASSIGN, 2, 6, "assign").alias("assign"), _matches(text, ACCESS, 0, 20, "access").alias("access"), _matches(text, HEX, 0, 24, "hex").alias("hex"), _matches(text, CANDIDATE, 0, 16, "random").alias("candidates"))
    base = F.concat("assign", "access", "hex")

    def is_random(x: Column) -> Column:
        value = F.substring(text, x["start"] + 1, x["end"] - x["start"])
        apart = ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
        return apart & (mean_ratio(value, literal(table)) > margin)

    found = found.withColumn("base", base).withColumn("more", F.when(F.size("candidates") > 0, F.filter("candidates", is_random)).otherwise(F.col("candidates")))
    return found.select("row", _sorted(F.col("base")).alias("base"), _sorted(F.concat("base", "more")).alias("spans"), "text")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each maximal run of overlapping spans replaced by a mark."""
    merged = F.aggregate(
        spans,
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda a, x: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["end"] > x["start"]), F.concat(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(a, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(a, F.lit(-1))["end"], x["end"]).alias("end"))))).otherwise(F.concat(a, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))),
    )
    out = F.aggregate(
        merged,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda s, x: F.struct(x["end"].alias("at"), F.concat(s["parts"], F.array(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark))).alias("parts")),
        lambda s: F.array_join(F.concat(s["parts"], F.array(F.substring(text, s["at"] + 1, F.length(text)))), ""),
    )
    return F.when(F.size(spans) > 0, out).otherwise(text)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Spans in the whole of documents."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("row.doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
