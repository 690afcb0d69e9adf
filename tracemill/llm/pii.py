"""Information-theoretic sanitisation of personal data, with DataFrame functions only.

Base spans are patterns (e-mail, IP address, card and phone numbers). Each base span is a mention of a protected entity
(its kind and text). From the co-occurrence of entities and words in whole documents,
PMI(entity, term) = log(N P(entity | term) / n(entity)) tells how much a term says about an entity. P(entity | term) is the
lower 95 % limit (Wilson) of n(entity, term) / n(term), so what a few documents say counts for little. A term that gives at
least `disclosure` of an entity's information content log(N / n(entity)), stands with it in `support` different texts at
least, and with that confidence in at least `certainty` of the texts that hold the term, reveals the entity. The last two
bounds don't move with the size of the table: at a `certainty` of 0.25 a word that stood once beside an address reveals it if
it stands nowhere else, in a table of any size. Every occurrence of a revealing term, in whatever document, becomes a span of kind `term`. Sanitising removes
base spans for a tag of their kind and generalises term spans to `[TERM]`. Words of one or two characters and numbers are no
terms.

Counts are of distinct texts; words inside of base spans aren't counted. Entities that the same texts hold are counted as
one, and pairs go at once whose term is too common among the texts with entities alone, which can't change the result:
n(term) is no smaller over all texts. So the passes over all words, one that counts and one that finds, keep only those of the
candidate terms. Patterns are possessive or anchored at run starts, so very long texts take linear time and no deep recursion.

Nulls and empty texts have no spans. A null id is an id. Repeated rows get the same spans each. Empty tables give no
rows. Further columns are not read by `find_spans` and kept by `sanitise_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import ascii_lower, few, sieve, written

#: Kinds in the order in which they are listed, and their patterns. `(?:(?<![..])|\\G)` starts a match
#: only where a run starts or the last match ended, which the leftmost match does anyway.
KINDS = ["email", "ip", "card", "phone", "term"]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that any text with a match passes.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Terms of a text that are looked for by one pattern.
PATTERN_TERMS = 200
SPAN_ARRAY = "array<struct<start:int,kind:int,end:int>>"
WORD_BREAKS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    d = F.transform(F.split(F.reverse(number), ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(F.expr("0") + x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(d, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        n = digits(m)
        return F.length(n).between(14, 19) & luhn(F.substring(n, 1, 19))
    if kind == "phone":
        return F.length(digits(m)).between(10, 15)
    return F.lit(True)


def spans_of(text: Column, kind: str) -> Column:
    """Valid matches of a kind as an array of (start, kind number, end, value) in code points."""
    pattern = PATTERNS[kind]
    # The parts between matches and the matches themselves give the places.
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    pairs = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, b: F.struct(m.alias("m"), F.length(b).alias("b")))
    kind_type = "array<struct<start:int,kind:int,end:int,value:string>>"
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(kind_type).alias("out"))

    def step(a: Column, x: Column) -> Column:
        start, end = a["at"] + x["b"], a["at"] + x["b"] + F.length(x["m"])
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), x["m"].alias("value"))
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

    placed = F.aggregate(pairs, begin, step, lambda a: a["out"])
    kept = F.filter(placed, lambda s: valid(kind, s["value"]))
    return F.when(text.rlike(NEEDS[kind]), kept).otherwise(F.array().cast(kind_type))


def shown(spans: Column) -> Column:
    """kind:start:end of each span, joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def is_term(w: Column) -> Column:
    return (F.length(w) >= 3) & ~w.rlike("^[0-9]+$")


def bare(text: Column, spans: Column) -> Column:
    """A text with its spans cut out."""
    return F.when(F.size(spans) > 0, replaced(text, spans, lambda s: F.lit(" "))).otherwise(text)


def words_of(text: Column) -> Column:
    """The distinct lower-case words of a text, perhaps with an empty one. The text is split once, even in a generator."""
    return F.array_distinct(F.split(ascii_lower(text), f"[{WORD_BREAKS}]+"))


def pieces_at(between: Column, found: Column, hit) -> Column:
    """The (start, kind, end) of the found pieces that are hits; `between` are the parts of the text around them."""
    pairs = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, b: F.struct(hit(m).alias("hit"), F.length(m).alias("m"), F.length(b).alias("b")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN_ARRAY).alias("out"))

    def step(a: Column, x: Column) -> Column:
        end = a["at"] + x["b"] + x["m"]
        span = F.struct((a["at"] + x["b"]).alias("start"), F.lit(KINDS.index("term")).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["hit"], F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    return F.aggregate(pairs, begin, step, lambda a: a["out"])


def places_of(text: Column, terms: Column) -> Column:
    """Where the terms stand in a text: an array of (start, kind, end).

    Few terms are found by a pattern of them (they hold no marks); among many, each word is looked up instead. Both give
    the same places.
    """
    word = f"[^{WORD_BREAKS}]"
    some = F.concat(F.lit(f"(?i)(?<!{word})(?:"), F.array_join(terms, "|"), F.lit(f")(?!{word})"))
    by_pattern = pieces_at(F.split(text, some, -1), F.regexp_extract_all(text, some, 0), lambda m: F.lit(True))
    by_word = pieces_at(F.split(text, word + "+", -1), F.regexp_extract_all(text, F.lit(word + "+"), 0), lambda m: F.array_contains(terms, ascii_lower(m)))
    return F.when(F.size(terms) <= PATTERN_TERMS, by_pattern).otherwise(by_word)


def lower_limit(k: Column, n: Column, z: float = 1.645) -> Column:
    """Wilson's lower limit of the share k / n; k is at most n."""
    p = F.least(k / n, F.lit(1.0))
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (p + z * z / (2 * n) - spread) / (1 + z * z / n)


def revealing_terms(base: DataFrame, texts: DataFrame, disclosure: float, support: int, certainty: float) -> tuple[DataFrame, DataFrame]:
    """(h, hits): the revealing terms of each text that holds some. base has h and entities; texts has h, text and base.

    Joins of words are shuffled at every size; only what passes a sieve of the wanted terms is.
    """
    total = float(base.select("h").distinct().count())
    held = base.where(F.size("entities") > 0).groupBy("h").agg(F.first("entities").alias("entities"))
    # Entities of the same texts are one: their number of texts and the exclusive or of those texts' hashes tell them.
    each = written(held.select("h", F.explode("entities").alias("entity")), "mentions")
    n_e = each.groupBy("entity").agg(F.count("*").alias("n_e"), F.bit_xor("h").alias("e"))
    classes = written(each.join(few(n_e), "entity").select("h", "e", "n_e").distinct(), "entity-classes")
    words = texts.where(F.size("base") > 0).groupBy("h").agg(F.first(words_of(bare(F.col("text"), F.col("base")))).alias("words"))
    words = written(words.select("h", F.explode("words").alias("term")).where(is_term(F.col("term"))), "holder-words")

    share = F.col("n_e") / F.lit(total)
    least = F.greatest(F.lit(certainty), F.pow(share, 1 - disclosure))
    # The limit is below n_et / n_t, so this bounds n_t from above, the more the more n_et is.
    most = lambda n_et: n_et / least
    common = words.groupBy("term").agg(F.count("*").alias("n"))
    loosest = classes.agg(F.max(most(F.col("n_e")))).first()[0] or 0.0
    rare = few(common.where(F.col("n") <= loosest + 1e-6).select(F.col("term").alias("_t"), "n"))
    pairs = words.join(rare, F.col("term") == F.col("_t")).join(classes, "h").where((share < 1) & (F.col("n") <= most(F.col("n_e")) + 1e-6))
    n_et = written(pairs.groupBy("e", "n_e", "term").agg(F.count("*").alias("n_et"), F.first("n").alias("n")).where((F.col("n_et") >= support) & (F.col("n") <= most(F.col("n_et")) + 1e-6)), "pairs")

    # Passes over the words of all texts. Copies count once: a word of a text with n copies is 1 / n.
    all_words = texts.select("h", F.explode(words_of(bare(F.col("text"), F.col("base")))).alias("term"))
    copies = base.groupBy("h").agg(F.count("*").alias("copies")).where("copies > 1").select(F.col("h").alias("_h"), "copies")
    candidates = written(n_et.select("term").distinct(), "candidates")
    seen = all_words.where(sieve(candidates, "term")(F.col("term"))).join(few(copies), F.col("h") == F.col("_h"), "left").select("term", (1 / F.coalesce("copies", F.lit(1))).alias("weight"))
    n_t = written(seen.groupBy("term").agg(F.round(F.sum("weight")).alias("n_t")), "term-counts")
    given = lower_limit(F.col("n_et"), F.col("n_t"))
    reveal = n_et.join(n_t, "term").where(given >= least).select("term").distinct()
    reveal = written(reveal, "revealing")
    some = all_words.where(sieve(reveal, "term")(F.col("term"))).join(reveal.hint("merge"), "term", "left_semi")
    return written(some.groupBy("h").agg(F.collect_set("term").alias("hits")), "hits")


def find_spans(docs: DataFrame, disclosure: float = 0.8, support: int = 1, certainty: float = 0.25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, h (hash of the text), base and spans (arrays of (start, kind, end)); base ones are in spans."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = F.array_sort(F.concat(*[spans_of(F.col("text"), k) for k in KINDS[:4]]))
    found = F.when(F.col("text").rlike("@|[0-9]"), found).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>"))
    # Base spans stand behind a generator, so that a pass finds them once; they are found again rather than joined to texts.
    texts = texts.select("doc_id", "h", "text", F.explode(F.array(found)).alias("base"))
    entities = F.array_distinct(F.transform("base", lambda s: F.xxhash64(s["kind"], F.lower(s["value"]))))
    base = written(texts.select("doc_id", "h", F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).alias("base"), entities.alias("entities")), "base-spans")
    hits = revealing_terms(base, texts, disclosure, support, certainty).withColumnRenamed("h", "_h").hint("merge")
    # Spans are of texts: of copies one is kept before it is moved and searched. The join is shuffled at every size.
    once = texts.groupBy("h").agg(F.first("text").alias("text"))
    terms = once.join(hits, F.col("h") == F.col("_h")).select("_h", places_of(F.col("text"), F.col("hits")).alias("terms"))
    out = base.join(terms.hint("merge"), F.col("h") == F.col("_h"), "left")
    # A term inside of a base span is no further span.
    free = F.filter("terms", lambda t: ~F.exists("base", lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"])))
    return out.select("doc_id", "h", "base", F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", free))).alias("spans"))


def replaced(text: Column, spans: Column, by) -> Column:
    """The text with each span s replaced by by(s); of spans that overlap the first stays."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        here = F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), by(s)).alias("out"))
        return F.when(s["start"] >= a["at"], here).otherwise(a)

    return F.aggregate(spans, begin, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def sanitise(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of spans that overlap the first stays."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    return replaced(text, spans, lambda s: F.get(names, s["kind"]))


def sanitise_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """docs with their texts sanitised; all columns stay."""
    spans = find_spans(docs, id_col=id_col, text_col=text_col, **limits).where(F.size("spans") > 0)
    spans = spans.groupBy(F.col("h").alias("__h")).agg(F.first("spans").alias("__spans"))
    joined = docs.join(few(spans, weight=F.size("__spans")), F.xxhash64(F.col(text_col)) == F.col("__h"), "left")
    clean = F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(sanitise(F.col(text_col), F.col("__spans")))
    return joined.select(*[clean.alias(c) if c == text_col else F.col(c) for c in docs.columns])
