"""Identity texts, digests, segments, shingles, and the joins that find shared ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.vectors import bind

#: Shortest normalised text with a digest, shortest sentence with one, words of a shingle.
MIN_CHARS, SEGMENT_CHARS, SHINGLE = 24, 60, 8
#: Longest title before a colon, shortest passage; least word overlap and words of near duplicates.
TITLE_CHARS, PASSAGE_CHARS, NEAR, NEAR_WORDS = 100, 100, 0.6, 6
#: Tokens that stand for brackets and the colon.
WIKI = {"-LRB-": "(", "-RRB-": ")", "-LSB-": "[", "-RSB-": "]", "-LCB-": "{", "-RCB-": "}", "-COLON-": ":"}
#: A passage is shared if two texts have so many shingles in common that at most so many texts hold.
SHARED, COMMON = 5, 3


def norm(text: Column) -> Column:
    """Lower case; every run of anything but a-z and 0-9 is one space; none at the ends."""
    bare = F.regexp_replace(text, "-(LRB|RRB|LSB|RSB|LCB|RCB|COLON)-", " ")
    return F.trim(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", " "))


def digest(text: Column, least: int = MIN_CHARS) -> Column:
    """First 24 hexadecimal digits of the SHA-256 of the normalised text; null if that is too short."""
    n = norm(text)
    return F.when(F.length(n) >= least, F.substring(F.sha2(n.cast("binary"), 256), 1, 24))


def unit(key: Column) -> Column:
    """A hash of a string in [0, 1): 13 hexadecimal digits of its SHA-256."""
    return F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def segments(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key and digest of each sentence of a text that is long enough, once.

    Sentences end at line breaks and at white space after . ! or ?; one that begins with a short `Title: ` is taken
    without it as well.
    """
    parts = F.split(F.regexp_replace(F.col(text), r"([.!?])\s+", "$1\n"), "\n")
    titled = lambda x: F.regexp_extract(x, rf"(?s)^[^:.!?]{{1,{TITLE_CHARS}}}:\s+(.+)", 1)
    lines = docs.select(key, F.explode(F.flatten(F.transform(parts, lambda x: F.array(x, titled(x))))).alias("line"))
    return lines.select(key, digest(F.col("line"), SEGMENT_CHARS).alias("segment")).where("segment IS NOT NULL").distinct()


def word_set(text: Column) -> Column:
    """The distinct words of the normalised text."""
    return F.array_remove(F.array_distinct(F.split(norm(text), " ")), "")


def jaccard(x: Column, y: Column) -> Column:
    """Shared by all elements of two sets; 0 if both are empty."""
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)), F.lit(0.0))


def near_duplicates(docs: DataFrame, key: str, others: DataFrame, other_key: str, text: str = "text", least: float = NEAR, words: int = NEAR_WORDS) -> DataFrame:
    """Pairs whose sets of words have a Jaccard similarity of at least `least`, both of at least `words` words.

    A text that is similar to a set holds all but so few of its words that it holds one of its first few, in any
    order; with the words in the order of how many of the other side hold them these are rare. Texts too long to be
    similar to the longest of the other side go before they are exploded.
    """
    sets = lambda frame, k: frame.select(k, word_set(F.col(text)).alias("set")).where(F.size("set") >= words)
    right = sets(others, other_key).withColumnRenamed("set", "other")
    held = right.select(other_key, F.explode("other").alias("word"))
    df = held.groupBy("word").agg(F.count("*").alias("df"))
    ordered = held.join(df, "word").groupBy(other_key).agg(F.sort_array(F.collect_list(F.struct("df", "word"))).alias("rare"))
    n = F.size("rare")
    prefix = ordered.select(other_key, F.explode(F.slice("rare", F.lit(1), n - F.ceil(least * n).cast("int") + 1)).alias("x")).select(other_key, F.col("x.word").alias("word"))
    longest = right.agg(F.max(F.size("other")).alias("longest"))  # one row
    left = sets(docs, key).join(F.broadcast(longest)).where(F.size("set") * least <= F.col("longest")).drop("longest")
    pairs = left.select(key, "set", F.explode("set").alias("word")).join(prefix, "word").select(key, other_key, "set").dropDuplicates([key, other_key])
    like = jaccard(F.col("set"), F.col("other")).alias("jaccard")
    return pairs.join(right, other_key).select(key, other_key, like).where(F.col("jaccard") >= least)


def passage_of(question: Column) -> Column:
    """What stands before the last line, if it is long enough; else the empty text."""
    head = F.regexp_extract(F.regexp_replace(question, r"^\s+|\s+$", ""), r"(?s)^(.*)\n", 1)
    return F.when(F.length(norm(head)) >= PASSAGE_CHARS, head).otherwise("")


def split_stance(state: Column) -> Column:
    """claim and evidence of `Claim: ...`, blank line, `Evidence: ...`."""
    mark = "\n\nEvidence: "
    at = F.instr(state, mark)
    claim = F.when(at > 0, F.substring(state, F.lit(1), at - 1)).otherwise(state)
    evidence = F.when(at > 0, F.substring(state, at + len(mark), F.length(state))).otherwise("")
    return F.struct(F.regexp_replace(claim, "^Claim: ", "").alias("claim"), evidence.alias("evidence"))


def identity_texts(rows: DataFrame, key: str) -> DataFrame:
    """key, name and text of what identifies an item with columns format, state and question: never null."""
    stance, question = split_stance(F.col("state")), F.coalesce("question", F.lit(""))
    named = lambda **x: F.array(*[F.struct(F.lit(n).alias("name"), v.alias("text")) for n, v in x.items()])
    found = F.when(F.col("format") == "stance", named(claim=stance["claim"], evidence=stance["evidence"])).otherwise(named(state=F.col("state"), question=question, question_passage=passage_of(question)))
    return rows.select(key, F.explode(found).alias("x")).select(key, "x.name", "x.text")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def short_group(prefix: str, text: Column) -> Column:
    """A name for items that share a text."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(norm(text).cast("binary"), 256), 1, 16))


def unwiki(text: Column) -> Column:
    """Tokenised text with its brackets, colons and spaces back."""
    for token, sign in WIKI.items():
        text = F.replace(text, F.lit(token), F.lit(sign))
    return F.regexp_replace(F.translate(text, "_", " "), r"^\s+|\s+$", "")


def fnv1a(text: Column) -> Column:
    """FNV-1a of a text's bytes, 64 bits as 16 hexadecimal digits. Halves of 32 bits, as longs, keep products from overflowing."""
    low = F.lit((1 << 32) - 1).cast("long")
    octets = F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda i: F.conv(F.hex(F.substring(text.cast("binary"), i, F.lit(1))), 16, 10).cast("long"))
    begin = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))

    def step(h: Column, octet: Column) -> Column:
        lo = h["lo"].bitwiseXOR(octet)
        # The prime is 2**40 + 435.
        hi = h["hi"] * 435 + F.shiftright(lo * 435, 32) + lo * 256
        return F.struct(hi.bitwiseAND(low).alias("hi"), (lo * 435).bitwiseAND(low).alias("lo"))

    half = lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")
    folded = F.aggregate(F.when(F.octet_length(text) > 0, octets).otherwise(F.array().cast("array<bigint>")), begin, step)
    return bind(folded, lambda h: F.concat(half(h["hi"]), half(h["lo"])))


def truncate_utf8(text: Column, most: int) -> Column:
    """The longest beginning of whole characters that has at most so many bytes."""
    octets = text.cast("binary")
    inside = lambda m: F.hex(F.substring(octets, m + 1, 1)).between("80", "BF")  # noqa: E731  a character goes on there
    cut = F.when(~inside(most), most).when(~inside(most - 1), most - 1).when(~inside(most - 2), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.substring(octets, F.lit(1), cut), "UTF-8"))


def prompt_body(question: Column, options: Column) -> Column:
    """A question and its lettered options; line breaks within an option are spaces."""
    lines = F.transform(options, lambda o, i: F.concat(F.char(i + 65), F.lit(". "), F.translate(o, "\r\n", "  ")))
    return F.concat(F.lit("QUESTION\n"), question, F.lit("\nOPTIONS\n"), F.array_join(lines, "\n"))


def shingles(words: Column, n: int = SHINGLE) -> Column:
    """The distinct runs of n words."""
    def runs(w: Column) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
        return F.when(F.size(w) >= n, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))

    return bind(words, runs)


def shared_passages(docs: DataFrame, key: str, others: DataFrame, other_key: str, text: str = "text", shared: int = SHARED, common: int = COMMON) -> DataFrame:
    """Pairs of texts with at least `shared` shingles in common, of those that at most `common` distinct texts of others hold.

    Texts of others with the same set of shingles are one text (as in the reference's index), whose matches go to the
    keys of all of them; of several texts under one key the best counts. The cut comes before the join, so that no
    shingle makes more than `common` pairs for a text.
    """
    classes = shingle_classes(others, other_key, text)
    posts = distinct_posts(classes).select("class", F.xxhash64("shingle").alias("h"), "shingle")
    rare = posts.groupBy("h", "shingle").agg(F.collect_list("class").alias("held"), F.count("*").alias("n")).where(F.col("n") <= common)
    there = docs.select(key, F.explode(shingles(F.split(norm(F.col(text)), " "))).alias("shingle")).select(key, F.xxhash64("shingle").alias("h"), "shingle")
    pairs = there.join(rare, ["h", "shingle"]).select(key, F.explode("held").alias("class"))
    found = pairs.groupBy(key, "class").agg(F.count("*").alias("shared")).where(F.col("shared") >= shared)
    copies = classes.select("class", other_key).distinct()
    return found.join(copies, "class").groupBy(key, other_key).agg(F.max("shared").alias("shared"))


def shingle_classes(frame: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, shingles and class of each text that has shingles; texts with the same set of shingles have the same class."""
    rows = frame.select(key, shingles(F.split(norm(F.col(text)), " ")).alias("shingles")).where(F.size("shingles") > 0)
    return rows.withColumn("class", F.sha2(F.array_join(F.array_sort("shingles"), "\n").cast("binary"), 256))


def distinct_posts(classes: DataFrame) -> DataFrame:
    """class and shingle, once for each shingle of each class of texts."""
    return classes.groupBy("class").agg(F.any_value("shingles").alias("shingles")).select("class", F.explode("shingles").alias("shingle"))
