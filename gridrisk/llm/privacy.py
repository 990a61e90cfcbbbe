"""Personal data, and the terms around it that give it away, found and generalised by column functions.

Patterns find the protected entities: mail and network addresses, card and phone numbers. The
corpus then tells which words of their texts reveal an entity: counts of different texts give the
pointwise mutual information of term and entity, and a term that carries a stated share or more of
an entity's information is generalised wherever it stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrisk.llm.quality import bound
from gridrisk.llm.text import named_back, numbered, place
from gridrisk.session import cut_lineage

KINDS = ("email", "ip", "card", "phone", "term")
#: The stated patterns. Quantifiers are possessive where the next character could not be given back
#: anyway; Java then matches long runs without recursion.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of these has no span of the kind.
HINTS = {"email": r"@[A-Za-z0-9-]++\.", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"(?:[0-9][\x20-]?+){15}[0-9]", "phone": r"\+[0-9]"}
TAGS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}
#: A word of letters alone.
LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

#: Longs of the bits that words are sieved by, some 1 MB whatever the corpus.
SIEVE = 1 << 16
SHARE = 0.75  # of the entity's information
LEAST_LETTERS = 3

SPANS = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(value: Column) -> Column:
    """Whether the digits of the string pass the Luhn check."""
    size = F.char_length(value)
    total = F.aggregate(F.sequence(F.lit(1), size), F.lit(0), lambda a, k: a + bound(F.substr(value, size - k + 1, F.lit(1)).cast("int"), lambda x: F.when(k % 2 == 1, x).when(x > 4, 2 * x - 9).otherwise(2 * x)))
    return total % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return bound(digits(value), lambda d: F.char_length(d).between(16, 19) & luhn(d))
    if kind == "phone":
        return F.char_length(digits(value)).between(8, 15)
    return F.lit(True)


def matches(text: Column, pattern: str, kind: str, test, offset: Column | None = None) -> Column:
    """Spans of the pattern's matches that pass the test, in code points, end exclusive."""
    zero = F.struct((F.lit(0) if offset is None else offset).cast("bigint").alias("at"), F.array().cast(SPANS).alias("out"))

    def listed(found: Column, between: Column) -> Column:
        def step(acc: Column, k: Column) -> Column:
            start = acc["at"] + F.char_length(between[k])
            end = start + F.char_length(found[k])
            span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), found[k].alias("value"))
            return F.struct(end.alias("at"), F.when(test(found[k]), F.concat(acc["out"], F.array(span).cast(SPANS))).otherwise(acc["out"]).alias("out"))

        return F.when(F.size(found) > 0, F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), zero, step, lambda acc: acc["out"])).otherwise(F.array().cast(SPANS))

    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: bound(F.split(text, pattern, -1), lambda between: listed(found, between)))


def base_spans(text: Column) -> Column:
    """Spans of all kinds, by kind and then start."""
    kinds = [F.when(text.rlike(HINTS[k]), matches(text, PATTERNS[k], k, lambda v, k=k: valid(k, v))).otherwise(F.array().cast(SPANS)) for k in PATTERNS]
    return F.concat(*kinds)


def terms_of(text: Column) -> Column:
    """Hashes of the different words of letters, lower-cased."""
    found = F.filter(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0)), lambda w: F.char_length(w) >= LEAST_LETTERS)
    return F.array_distinct(F.transform(found, lambda w: F.xxhash64(F.lower(w))))


def revealing(words: DataFrame, near: DataFrame, entities: DataFrame, texts: int, share: float = SHARE) -> DataFrame:
    """(term) whose mutual information reaches the share of the information of an entity.

    `words` has one row (term) for each different word of each different text, `near` the rows
    (text_key, term) of those texts that name an entity, `entities` (text_key, entity); `texts` is
    the number of different texts. All counts are of different texts. A term must stand in few
    texts beside those of the entity, n_t <= n_et * (texts / n_e) ** (1 - share), which holds for
    an entity or a term of one text as well. Words too frequent for every entity of their text are
    left out before they meet its entities.
    """
    held = cut_lineage(entities.distinct(), "private-entities")
    sized = cut_lineage(held.join(held.groupBy("entity").agg(F.count("*").alias("n_e")), "entity"), "private-sized")
    # counted in each task first, so a task sends a row for each of its words
    counted = cut_lineage(words.groupBy("term").agg(F.count("*").alias("n_t")), "private-counts")
    reach = F.col("n_e") * F.pow(F.lit(float(texts)) / F.col("n_e"), F.lit(1 - share))
    most = sized.groupBy("text_key").agg((F.max(reach) * (1 + 1e-9)).alias("most"))
    limited = near.join(most, "text_key").join(counted, "term").where(F.col("n_t") <= F.col("most"))
    limited = cut_lineage(limited.select("text_key", "term", "n_t"), "private-near")
    pairs = limited.join(sized, "text_key").groupBy("entity", "term").agg(F.count("*").alias("n_et"), F.first("n_t").alias("n_t"), F.first("n_e").alias("n_e"))
    information = F.log2(F.lit(float(texts)) / F.col("n_e"))
    mutual = information - F.log2(F.col("n_t") / F.col("n_et"))
    return pairs.where((information > 0) & (mutual >= share * information - 1e-9)).select("term").distinct()


def sieve(terms: DataFrame) -> DataFrame:
    """(at, bits): at most SIEVE longs with a bit for each term, so a table of fixed size at most."""
    bit = F.pmod(F.col("term"), F.lit(64 * SIEVE))
    return terms.groupBy(F.floor(bit / 64).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(term, {64 * SIEVE}) % 64 as int))")).alias("bits"))


def private_spans(docs: DataFrame, text: str = "text", keep_text: bool = True, **options) -> DataFrame:
    """All rows and columns of `docs` with `_spans`: kind, start, end and value of everything found.

    Kinds come in the order email, ip, card, phone, term and each by start; positions are code
    points of the text, end exclusive. Terms are words that no other span overlaps and that reveal
    an entity of the corpus, in every text that has them. Null and empty texts have no spans;
    repeated rows get the same ones and count once; an empty table gives an empty one; other
    columns may have any names but `_spans`.
    """
    base, at = numbered(docs), place(docs, text)
    whole = F.coalesce(F.col(at), F.lit(""))
    found = base.withColumn("_rid", F.monotonically_increasing_id()).withColumn("text_key", F.xxhash64(whole)).withColumn("spans", base_spans(whole))
    staged = cut_lineage(found, "private-spans")
    texts = staged.select("text_key").distinct().count()
    # the texts that stand in several rows, with the row that speaks for them
    copied = staged.groupBy("text_key").agg(F.min("_rid").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    once = staged.join(cut_lineage(copied, "private-copies"), "text_key", "left").where(F.col("_first").isNull() | (F.col("_first") == F.col("_rid")))
    outside = F.when(F.size("spans") > 0, generalised(whole, F.col("spans"), "0")).otherwise(whole)
    words = once.select(F.explode(terms_of(outside)).alias("term"))
    near = once.where(F.size("spans") > 0).select("text_key", F.explode(terms_of(outside)).alias("term"))
    held = staged.where(F.size("spans") > 0).select("text_key", F.explode("spans").alias("x")).select("text_key", F.xxhash64("x.kind", "x.value").alias("entity"))
    terms = cut_lineage(revealing(words, near, held, texts, **options), "private-revealing")
    # words whose bit is not in the sieve are no such terms; the rest meet them exactly
    bit = F.pmod(F.col("term"), F.lit(64 * SIEVE))
    places = staged.select("_rid", F.explode(terms_of(outside)).alias("term")).withColumn("at", F.floor(bit / 64))
    passing = places.join(F.broadcast(cut_lineage(sieve(terms), "private-sieve")), "at").where(F.call_function("getbit", F.col("bits"), (bit % 64).cast("int")) == 1)
    hits = passing.select("_rid", "term").join(terms, "term").groupBy("_rid").agg(F.collect_set("term").alias("terms"))

    def free(spans: Column) -> Column:
        return F.filter(matches(whole, LETTERS, "term", lambda v: F.array_contains("terms", F.xxhash64(F.lower(v)))), lambda x: ~F.exists(spans, lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"])))

    both = F.when(F.col("terms").isNotNull(), F.concat("spans", free(F.col("spans")))).otherwise(F.col("spans"))
    return staged.join(hits, "_rid", "left").select(*named_back(docs, both.alias("_spans"), skip=() if keep_text else (text,)))


def generalised(text: Column, spans: Column, tag: str | None = None) -> Column:
    """The text with every span, overlapping ones together, replaced by `tag` or that of its kind."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).when(a["end"] != b["end"], F.when(a["end"] > b["end"], -1).otherwise(1)).otherwise(0))
    tags = F.create_map(*[F.lit(x) for pair in TAGS.items() for x in pair])
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], before, tags[s["kind"]] if tag is None else F.lit(tag))).otherwise(acc["out"]).alias("out"))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(ordered, zero, step, lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"), F.char_length(text)))))


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """`docs` with everything found generalised in `text`; `n_chars`, if there, follows the text.

    What a span hid, such as a card number run together with an address, is looked for once more.
    """
    found = private_spans(docs, **options).withColumn("text", generalised(F.col("text"), F.col("_spans")))
    found = found.withColumn("text", F.when(F.size("_spans") > 0, bound(F.col("text"), lambda text: generalised(text, base_spans(text)))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.size("_spans") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return found.drop("_spans")


def digest(docs: DataFrame) -> DataFrame:
    found = private_spans(docs.select("doc_id", "text"), keep_text=False)
    number = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("_spans", lambda s: s["kind"] != "term")
    return found.select(
        "doc_id",
        *[number(kind) for kind in PATTERNS],
        F.sha2(line(base), 256).alias("base_sha256"),
        line(F.col("_spans")).alias("spans"),
    )
