"""Benchmark decontamination by a positional inverted index over the training texts.

1. One pass over the training texts stores the postings of all benchmark terms: (document, place, term).
2. Each window of consecutive item words ranks its terms by their number of postings, rarest first; a window with a
   term that no text has is dropped.
3. The lists of the rarest and the second rarest term, each less the term's offset in the window, are intersected on
   (document, start, window). What is left must have a posting for every further term at its offset, so a phrase match
   is exact. Proximity matches take starts that differ by at most a slop instead of equal ones.

Data that is broadcast or put into a plan comes from the benchmark only and is counted first; a larger benchmark goes
through shuffled joins. A document's rows are known by (id, hash of the text), so repeated rows get the same result each.

The main path looks for phrases. `find_near` gives proximity matches of the two rarest terms of a window; they are not
part of `decontaminate`, whose columns count exact hits only.

Nulls: a null text has no words and is clean; an item without words has no windows; a null item id counts as the
string `null`, a null document id is an id. Empty tables: no documents give no rows, no items give clean documents.
Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import ascii_lower, few, split_words, written

SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
#: The separators of texts that aren't lower-cased yet.
RAW_SEPARATORS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
#: Terms that may stand in a plan as a set of literals, and the term that ends every document's postings (no word holds it).
PLAN_TERMS, END = 10_000, "\x00"


def words_of(text: Column) -> Column:
    return split_words(ascii_lower(text), SEPARATORS)


def with_words(df: DataFrame, text_col: str, *keep: Column) -> DataFrame:
    """df with `words`, behind a generator so that later expressions read the array and don't split again."""
    return df.select(*keep, F.explode(F.array(words_of(F.col(text_col)))).alias("words"))


def item_windows(bench: DataFrame, length: int, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(windows, owners): w (a number) and window (array of words) of each different run of `length` item words (shorter
    items are one window), and (w, item) of the items that hold it. A window that many items share is looked for once."""
    items = with_words(bench, text_col, F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - length, F.lit(0)))
    held = items.select("item", "words", F.explode(starts).alias("k")).select("item", F.slice("words", F.col("k") + 1, F.lit(length)).alias("window"))
    held = written(held.distinct(), "item-windows")
    windows = written(held.select("window").distinct().select(F.monotonically_increasing_id().alias("w"), "window"), "windows")
    return windows, written(held.join(few(windows, weight=F.size("window")), "window").select("w", "item"), "window-owners")


def store_postings(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, p, term) of each word that is a term, and (doc_id, h, number of words, END) for each document."""
    # A text is split as it is and its words are lower-cased one by one: a generator would evaluate more than one split.
    # An empty part at the begin only shifts the places of a text; the number of words is corrected for empty ends.
    text = F.coalesce(F.col(text_col), F.lit(""))
    empty = F.when(text == "", 1).otherwise(F.substring(text, 1, 1).rlike(f"[{RAW_SEPARATORS}]").cast("int") + F.right(text, F.lit(1)).rlike(f"[{RAW_SEPARATORS}]").cast("int"))
    words = F.posexplode(F.concat(F.split(text, f"[{RAW_SEPARATORS}]+"), F.array(F.lit(END)))).alias("p", "term")
    tokens = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h"), empty.alias("empty"), words)
    tokens = tokens.select("doc_id", "h", F.when(F.col("term") == END, F.col("p") - F.col("empty")).otherwise(F.col("p")).alias("p"), ascii_lower(F.col("term")).alias("term"))
    listed = [r[0] for r in terms.limit(PLAN_TERMS + 1).collect()]
    if len(listed) <= PLAN_TERMS:
        return written(tokens.where(F.col("term").isin(END, *listed)), "postings")
    known = terms.union(terms.sparkSession.range(1).select(F.lit(END))).distinct()
    return written(tokens.join(few(known.withColumnRenamed("term", "t")), F.col("term") == F.col("t"), "left_semi"), "postings")


def ranked_terms(windows: DataFrame, postings: DataFrame) -> DataFrame:
    """(w, m, r, t, o): the r-th rarest term of a window of m words and its offset; windows that can't occur are left out."""
    seen = written(postings.where(F.col("term") != END).groupBy("term").agg(F.count("*").alias("n")), "term-counts")
    each = windows.select("w", F.size("window").alias("m"), F.posexplode("window").alias("o", "term")).join(few(seen), "term", "left")
    by = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "o")))
    ranked = each.groupBy("w", "m").agg(by.alias("by")).where(F.col("by")[0]["n"] > 0)
    return written(ranked.select("w", "m", F.posexplode("by").alias("r", "x")).select("w", "m", "r", F.col("x.term").alias("t"), F.col("x.o").alias("o")), "ranked-terms")


def listed(postings: DataFrame, ranked: DataFrame, rank: int) -> DataFrame:
    """The list of the windows' terms of a rank, each less its offset: (doc_id, h, start, w)."""
    wanted = ranked.where(F.col("r") == rank)
    terms = [r[0] for r in wanted.select("t").distinct().limit(PLAN_TERMS + 1).collect()]
    some = postings.where(F.col("term").isin(*terms)) if len(terms) <= PLAN_TERMS else postings
    return some.join(few(wanted.select("w", "t", "o")), F.col("term") == F.col("t")).select("doc_id", "h", (F.col("p") - F.col("o")).alias("start"), "w")


def same_document(d: str = "_d", h: str = "_h"):
    return F.col("doc_id").eqNullSafe(F.col(d)) & (F.col("h") == F.col(h))


def find_phrases(postings: DataFrame, ranked: DataFrame) -> DataFrame:
    """(doc_id, h, start, w, m) of each occurrence of a window."""
    kinds = few(ranked.where("r = 0").select("w", "m"))
    first = listed(postings, ranked, 0).join(kinds, "w")
    second = listed(postings, ranked, 1).select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), F.col("start").alias("_s"), F.col("w").alias("_w"))
    met = first.where("start >= 0 AND m > 1").join(second, same_document() & (F.col("start") == F.col("_s")) & (F.col("w") == F.col("_w")), "left_semi")
    met = written(met.unionByName(first.where("m = 1")).distinct(), "met")
    # The other terms at their offsets, in documents where something is left.
    rest = met.join(few(ranked.where("r > 1").select(F.col("w").alias("_w"), "t", "o")), F.col("w") == F.col("_w")).select("doc_id", "h", "start", "w", (F.col("start") + F.col("o")).alias("p"), F.col("t").alias("term"))
    left = met.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h")).distinct()
    there = postings.where(F.col("term") != END).join(few(left), same_document(), "left_semi").select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), F.col("p").alias("_p"), F.col("term").alias("_t")).distinct()
    held = rest.distinct().join(there, same_document() & (F.col("p") == F.col("_p")) & (F.col("term") == F.col("_t")), "left_semi")
    counts = held.groupBy(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), F.col("start").alias("_s"), F.col("w").alias("_w")).agg(F.countDistinct("p").alias("n"))
    whole = met.join(counts, same_document() & (F.col("start") == F.col("_s")) & (F.col("w") == F.col("_w")), "left")
    return whole.where(F.col("m") - 2 <= F.coalesce("n", F.lit(0))).select("doc_id", "h", "start", "w", "m")


def find_near(postings: DataFrame, ranked: DataFrame, slop: int) -> DataFrame:
    """(doc_id, h, start, w): places where the two rarest terms of a window stand as far apart as in it, give or take `slop` words."""
    second = listed(postings, ranked, 1).select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), F.col("start").alias("_s"), F.col("w").alias("_w"))
    # Starts are dealt in cells as wide as the slop, so that the join is on equal cells.
    width = max(1, slop)
    cells = second.withColumn("_c", F.explode(F.array(*[F.floor(F.col("_s") / width) + i for i in (-1, 0, 1)])))
    first = listed(postings, ranked, 0).withColumn("_c1", F.floor(F.col("start") / width))
    near = same_document() & (F.col("w") == F.col("_w")) & (F.col("_c1") == F.col("_c")) & (F.abs(F.col("start") - F.col("_s")) <= slop)
    return first.join(cells, near, "left_semi").select("doc_id", "h", "start", "w").distinct()


def covered(spans: Column) -> Column:
    """How many places a sorted array of (start, end) covers."""
    begin = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], a["upto"]))).alias("n"), F.greatest(a["upto"], x["end"]).alias("upto"))
    return F.aggregate(spans, begin, step, lambda a: a["n"])


def decontaminate(docs: DataFrame, bench: DataFrame, length: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document: doc_id, h (hash of the text), n_words, n_hit, items (sorted array of item ids with a window in it)."""
    windows, owners = item_windows(bench, length, item_col, item_text_col)
    postings = store_postings(docs, windows.select(F.explode("window").alias("term")).distinct(), id_col, text_col)
    found = written(find_phrases(postings, ranked_terms(windows, postings)), "phrases")
    doc = [F.col("doc_id").alias("_d"), F.col("h").alias("_h")]
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("m")).alias("end"))))
    items = found.select("doc_id", "h", "w").distinct().join(few(owners), "w").groupBy(*doc).agg(F.array_sort(F.collect_set("item")).alias("items"))
    same = F.col("_d").eqNullSafe(F.col("_d2")) & (F.col("_h") == F.col("_h2"))
    per_doc = found.groupBy(*doc).agg(spans.alias("spans")).join(items.withColumnsRenamed({"_d": "_d2", "_h": "_h2"}), same).select("_d", "_h", "spans", "items")
    all_docs = postings.where(F.col("term") == END).select("doc_id", "h", F.col("p").cast("long").alias("n_words"))
    out = all_docs.join(per_doc, same_document(), "left")
    return out.select("doc_id", "h", "n_words", F.coalesce(covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
