"""Spelling variants: words one insertion, deletion or replacement apart, by forward and backward minimal automata.

Of two words one edit apart, the shorter is cut in halves: the edit lies in one of them, so the other is shared as a prefix
or as a suffix. Words are dealt by these shared parts. A group that is too large is dealt anew, its open part cut in halves
again, until one code point is open, so every group is bounded and no pair is lost. In each task, forward groups make a
minimal acyclic automaton of their words, backward groups one of the reversed words. A state knows how many words it leads
to, so that a path gives the number of its word (a perfect hash). Each word walks its shared part exactly and completes the
rest with one error. Pairs that are found more than once count once.

Nulls and empty texts have no words. A null id is written as an empty string where words are misspelt. Repeated rows count
as often as they are there; columns other than the two that are used are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import ascii_lower, written

#: Letters of a run: ASCII and Latin-1.
LETTERS = "[A-Za-zÀ-ÿ]"
#: Rows of a group beyond which it is dealt anew, and rows that are put into one automaton if groups are smaller.
GROUP_ROWS, CHUNK_ROWS = 8192, 16384


def word_counts(docs: DataFrame, shortest: int = 5, least: int = 3, misspell: int | None = 97, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the lower-cased (A-Z only) runs of letters with `shortest` code points at least and n >= least.

    Where `misspell` divides the crc32 h of `<doc_id>:<run>`, the run loses its code point h % length first.
    """
    # Shorter runs can't become words, as nothing makes a run longer.
    runs = docs.select(F.col(doc_id).alias("_d"), F.explode(F.regexp_extract_all(F.col(text), F.lit(f"{LETTERS}{{{shortest},}}"), F.lit(0))).alias("_r"))
    word = runs.select("_d", ascii_lower(F.col("_r")).alias("word"))
    if misspell:
        h = F.crc32(F.concat(F.coalesce(F.col("_d").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
        n = F.char_length("word")
        at = (h % n).cast("int")
        cut = F.when(n > shortest, F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, n)))
        word = word.select(F.when(h % misspell == 0, cut).otherwise(F.col("word")).alias("word"))
    # The nulls are a group with a count of 0.
    return word.groupBy("word").agg(F.count("word").alias("n")).where(F.col("n") >= least)


class Automaton:
    """The minimal acyclic automaton of distinct words in ascending order; state -1 is the beginning."""

    def __init__(self, words: list[str]) -> None:
        known: dict = {}
        #: Of each state: character -> (next state, words that come before those of this edge).
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        leads: list[int] = []

        def settled(final: bool, out: dict[str, int]) -> int:
            key = (final, *out.items())
            state = known.get(key)
            if state is None:
                state = known[key] = len(leads)
                numbered, before = {}, int(final)
                for c, t in out.items():
                    numbered[c] = (t, before)
                    before += leads[t]
                self.edges.append(numbered)
                self.final.append(final)
                leads.append(before)
            return state

        path: list[list] = [[False, {}]]
        last = ""
        for word in [*words, ""]:
            same = 0
            for x, y in zip(last, word, strict=False):
                if x != y:
                    break
                same += 1
            for depth in range(len(last), same, -1):
                final, out = path.pop()
                path[-1][1][last[depth - 1]] = settled(final, out)
            path += [[False, {}] for _ in range(len(word) - same)]
            if word:
                path[-1][0] = True
            last = word
        self.begin = settled(*path[0])

    def ends(self, state: int, number: int, word: str, at: int) -> int:
        """The number of the word that is reached from a state by word[at:], -1 if there is none."""
        for c in word[at:]:
            edge = self.edges[state].get(c)
            if edge is None:
                return -1
            state, before = edge
            number += before
        return number if self.final[state] else -1

    def near(self, word: str, exact: int) -> set[int]:
        """Numbers of the words that a replaced or inserted character makes of `word`, its first `exact` ones unchanged."""
        state, number, found = self.begin, 0, set()
        for i in range(len(word) + 1):
            edges = self.edges[state]
            own = word[i] if i < len(word) else None
            if i >= exact:
                for c, (to, before) in edges.items():
                    if own is not None and c != own:
                        found.add(self.ends(to, number + before, word, i + 1))
                    found.add(self.ends(to, number + before, word, i))
            if own is not None:
                state, before = edges[own]
                number += before
        found.discard(-1)
        return found


def _chunk_pairs(rows: pd.DataFrame) -> pd.DataFrame:
    """The pairs (u, nu, v, nv) of some whole groups, u the shorter one, or the smaller of two equally long ones."""
    out: list[tuple] = []
    for backward in (False, True):
        part = rows[rows["backward"] == backward]
        counts = dict(zip(part["word"], part["n"], strict=True))
        spelt = {w[::-1]: w for w in counts} if backward else {w: w for w in counts}
        ordered = sorted(spelt)
        automaton = Automaton(ordered)
        asking = part[part["asks"]]
        # A word of several groups walks the shortest of its shared parts.
        for word, exact in asking.groupby("word", sort=False)["exact"].min().items():
            for k in automaton.near(word[::-1] if backward else word, exact):
                other = spelt[ordered[k]]
                if len(other) > len(word) or word < other:
                    out.append((word, counts[word], other, counts[other]))
                else:
                    out.append((other, counts[other], word, counts[word]))
    return pd.DataFrame(out, columns=["u", "nu", "v", "nv"])


def _task_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by group; whole groups are gathered until there are enough of them."""
    held: list[pd.DataFrame] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows < CHUNK_ROWS:
            continue
        all_ = pd.concat(held)
        # The last group may go on in the next batch.
        open_ = all_["key"] == all_["key"].iloc[-1]
        if not open_.all():
            yield _chunk_pairs(all_[~open_])
            all_ = all_[open_]
        held, rows = [all_], len(all_)
    if rows:
        yield _chunk_pairs(pd.concat(held))


def _shared_parts(words: DataFrame) -> DataFrame:
    """A row (word, n, a, b, roles) for each half that a word may share: a code points in front, b behind. Roles are lengths
    of the shorter word of a pair for which that half is one."""
    m = F.char_length("word")
    half, less = F.floor(m / 2).cast("int"), F.floor((m - 1) / 2).cast("int")
    none = F.lit(0)
    part = lambda a, b, *roles: F.struct(a.alias("a"), b.alias("b"), F.array(*roles).alias("roles"))
    odd = F.array(part(half, none, m, m - 1), part(none, m - half, m), part(none, m - 1 - less, m - 1))
    even = F.array(part(half, none, m), part(less, none, m - 1), part(none, half, m, m - 1))
    return words.select("word", "n", F.explode(F.when(m % 2 == 1, odd).otherwise(even)).alias("p")).select("word", "n", "p.*")


def _key() -> Column:
    return F.concat_ws("|", F.col("a").cast("string"), F.col("b").cast("string"), F.substring("word", F.lit(1), F.col("a")), F.substring("word", F.char_length("word") - F.col("b") + 1, F.col("b")))


def near_pairs(words: DataFrame, most: int = GROUP_ROWS) -> DataFrame:
    """(u, nu, v, nv), one row per unordered pair of words (word, n; words distinct) exactly one edit apart."""
    asks = F.array_contains("roles", F.char_length("word"))
    rows = _shared_parts(words).withColumn("key", _key())
    done = []
    while True:
        sizes = rows.groupBy("key").agg(F.count("*").alias("rows"), F.count_if(asks).alias("asking"))
        sizes = sizes.where("rows > 1 AND asking > 0")
        rows = written(rows.join(sizes, "key"), "shared-parts")
        # Where one code point is open, the alphabet bounds the group.
        large = (F.col("rows") > most) & F.exists("roles", lambda x: x - F.col("a") - F.col("b") > 1)
        done.append(rows.where(~large))
        again = rows.where(large)
        if again.limit(1).count() == 0:
            break
        again = again.select("word", "n", "a", "b", F.explode("roles").alias("l")).withColumn("o", F.col("l") - F.col("a") - F.col("b"))
        front, back = F.floor(F.col("o") / 2).cast("int"), F.ceil(F.col("o") / 2).cast("int")
        parts = F.array(F.struct((F.col("a") + front).alias("a"), F.col("b").alias("b")), F.struct(F.col("a").alias("a"), (F.col("b") + back).alias("b")))
        rows = again.select("word", "n", F.explode(parts).alias("p"), F.array("l").alias("roles")).select("word", "n", "p.*", "roles").withColumn("key", _key())
    all_ = done[0]
    for x in done[1:]:
        all_ = all_.unionByName(x)
    backward = F.col("a") == 0
    all_ = all_.select("key", "word", "n", backward.alias("backward"), F.when(backward, F.col("b")).otherwise(F.col("a")).alias("exact"), asks.alias("asks"))
    found = all_.repartition("key").sortWithinPartitions("key").mapInPandas(_task_pairs, "u string, nu long, v string, nv long")
    return found.dropDuplicates(["u", "v"])


def spelling_forms(words: DataFrame, times: int = 2) -> DataFrame:
    """Adds to (word, n): n_near, the number of words one edit apart; form, the most frequent of these (ties: the smallest),
    if it is `times` as frequent at least, else null; form_n; and root, where forms end."""
    pairs = written(near_pairs(words), "near-words")
    both = pairs.select(F.col("u").alias("word"), F.col("v").alias("other"), F.col("nv").alias("other_n")).union(pairs.select("v", "u", "nu"))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    x = words.join(near, "word", "left").withColumn("form_n", -F.col("best.less"))
    frequent = F.col("form_n") >= F.col("n") * times
    x = x.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(frequent, F.col("best.other")).alias("form"), F.when(frequent, F.col("form_n")).alias("form_n"))
    x = written(x, "forms")
    # A form is more frequent than its word, so forms never lead in circles; each round doubles the steps that are taken.
    roots = x.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        stepped = written(roots.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        roots = stepped.select("word", "root")
        if stepped.where("_moved").limit(1).count() == 0:
            break
    return x.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, shortest: int = 5, least: int = 3, misspell: int | None = 97, times: int = 2) -> DataFrame:
    """word, form, root, n, n_near and form_n of the words of all texts; see word_counts and spelling_forms."""
    words = written(word_counts(docs, shortest, least, misspell), "words")
    return spelling_forms(words, times).select("word", "form", "root", "n", "n_near", "form_n")
