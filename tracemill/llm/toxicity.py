"""Toxicity by noisy-channel deobfuscation and evidence of restored words.

A character language model (counts of character trigrams over the words of all documents) and a channel of three ways
to disguise a word: look-alike characters (leetspeak), characters set apart by spaces or marks, and repeated characters.
Only words that show one of them are decoded: their characters span a lattice (each character stands for itself or what
it looks like; a repeat may stand for a single character; separators may be dropped, and in spelt-out phrases end a
word), and a Viterbi search over pairs of characters finds the likeliest word. Numbers are no words. Marks at the end
that look like a letter are read both ways. Restored texts are scored by log odds of words and word beginnings, learned
from the labelled rows; counts cover all of them. A term needs about five different toxic texts to count, so the terms
on the driver are far fewer than the labelled rows' words.

Texts are cut into tokens a slice at a time by Arrow, so that Python looks at each different token of a slice once; what
a text holds is then counted in arrays. A token is decoded for its score only where some reading could begin a term.

Nulls and empty texts have no evidence and get the prior's low score. Very long texts, tokens and spelt-out phrases are
read whole. Repeated rows count each for itself; a repeated id takes each of its labels. Without labelled rows of both
kinds every text scores the prior. Further columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import few, give_back, tidy, written

#: What a character may stand for in a disguised word, besides itself.
LOOKS_LIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t", "|": "il"}
#: Log probabilities of the channel: a character as it is, a look-alike, one more repeat, a separator put in.
AS_IS, ALIKE, REPEAT, SEPARATOR = math.log(0.9), math.log(0.08), math.log(0.05), math.log(0.05)
#: Most frequent characters that the language model tells apart; all others count as one, OTHER. Trigrams aren't limited.
ALPHABET, OTHER = 256, "\ufffd"
#: Signs for the begin and the end of a word; texts don't use them ("$" and "^" are characters of tokens).
BEGIN, END = "\ue000", "\ue001"
#: The beginnings of words that count as terms.
BEGINNINGS = (4, 5, 6)
#: Pseudo-documents by which odds shrink to the prior, and the least log odds of a term.
SHRINK, LEAST_ODDS = 4, 2.5

WORD = re.compile(r"[^\W_]+", re.UNICODE)
NUMBER = re.compile(r"[$+]?[\d.,:;/%+-]*")
DISGUISED = re.compile(r"([^\W\d_])\1|[^\W_][.*_-]+[^\W_]", re.UNICODE)
SINGLE = rf"(?:[^\W\d_]|[{re.escape(''.join(LOOKS_LIKE))}])"
APART = re.compile(rf"""(?<![^\s"'(\[]){SINGLE}(?:[\s.*_-]+{SINGLE}){{2,}}(?=[^\w\s]*(?:\s|$))""", re.UNICODE)
RUN = re.compile(r"([^\W\d_])\1+", re.UNICODE)
GAP, INNER = re.compile(r"[\s.*_-]+"), re.compile(r"[.*_-]+")
#: Marks around a token that look like no letter, and marks that end one.
EDGES, CLOSING = ".,;:?\"'()[]*%#&", ".,;:?!\"')|*%$#&"
#: Characters of texts that are cut into tokens at once.
SLICE = 4_000_000
#: Tokens whose odds a task keeps, and runs and trigrams that a model remembers; distinct signatures that a slice keeps for a term.
KEPT, SIGNATURES = 300_000, 16
#: Decoded tokens that a Python worker keeps from task to task, and whose words a task keeps, and the longest token that is remembered.
DECODED, REMEMBERED = 50_000, 64
MARKS = " .*_-"
#: One character for all that may stand for each other, none for marks; and characters that repeat.
KIN = str.maketrans({m: "" for m in MARKS} | {x: letters[0] for sign, letters in LOOKS_LIKE.items() for x in sign + letters})
SAME = re.compile(r"(.)\1+", re.DOTALL)


class Characters:
    """Log probabilities of a character after two others, from counts.

    It is broadcast as it is, so a worker's tasks share it with what it remembers, and the worker drops it with the
    broadcast, at the next task that doesn't use it.
    """

    def __init__(self, counts: dict[str, int]):
        self.decoded: dict[tuple[str, bool], str] = {}
        self.stay: dict[tuple[str, str, str, int], int] = {}
        self.three, self.two, self.one = dict(counts), Counter(), Counter()
        for g, n in counts.items():
            self.two[g[:2]] += n
            self.one[g[2]] += n
        self.total, self.kinds, self.known = max(1, sum(self.one.values())), max(1, len(self.one)), {}

    def __call__(self, a: str, b: str, c: str) -> float:
        g = key = a + b + c
        p = self.known.get(key)
        if p is None:
            if len(self.known) > KEPT:
                self.known.clear()
            g = "".join(OTHER if x.isalpha() and x not in self.one else x for x in g)
            a, b, c = g
            low = (self.one.get(c, 0) + 0.5) / (self.total + 0.5 * self.kinds + 1)
            p = self.known[key] = math.log((self.three.get(g, 0) + 2 * low) / (self.two.get(a + b, 0) + 2))
        return p


def restore(token: str, model: Characters, apart: bool = False) -> str:
    """The likeliest word behind a token, or the likeliest words behind characters set apart by single spaces."""
    states = {(BEGIN, BEGIN): (0.0, None)}  # ways are linked backwards, so that long tokens take linear time
    known = model.known
    for ch in token:
        nxt: dict[tuple[str, str], tuple[float, tuple | None]] = {}
        gap, options = ch in MARKS, [(ch, AS_IS), *((x, ALIKE) for x in LOOKS_LIKE.get(ch, ""))]
        for key, (score, way) in states.items():
            a, b = key
            if gap:
                if key not in nxt or score + SEPARATOR > nxt[key][0]:
                    nxt[key] = (score + SEPARATOR, way)
                if apart:
                    if b != BEGIN:
                        ended = score + SEPARATOR + model(a, b, END)
                        if (BEGIN, BEGIN) not in nxt or ended > nxt[BEGIN, BEGIN][0]:
                            nxt[BEGIN, BEGIN] = (ended, (way, " "))
                    continue
            for c, cost in options:
                if c == b and (key not in nxt or score + REPEAT > nxt[key][0]):
                    nxt[key] = (score + REPEAT, way)
                p = known.get(a + b + c)
                new, to = score + cost + (model(a, b, c) if p is None else p), (b, c)
                if to not in nxt or new > nxt[to][0]:
                    nxt[to] = (new, (way, c))
        states = nxt
    way, out = max(((s + model(a, b, END), w) for (a, b), (s, w) in states.items()), key=lambda x: x[0])[1], []
    while way:
        way, c = way
        out.append(c)
    return "".join(reversed(out))


def unrepeated(token: str, model: Characters) -> str:
    """What restore() gives for a token without look-alikes and marks: how many letters of a run stay.

    No trigram spans the choices of two runs, so each run is decided by itself; as the score is linear in the number of
    letters from two on, one letter, two and all are the only candidates.
    """

    def shorter(m: re.Match) -> str:
        c, n = m[1], len(m[0])
        b = token[m.start() - 1] if m.start() else BEGIN
        d = token[m.end()] if m.end() < len(token) else END
        stay = model.stay.get((b, c, d, n))
        if stay is None:
            if len(model.stay) > KEPT:
                model.stay.clear()
            more = model(b, c, c) + model(c, c, d)
            scores = [((n - 1) * REPEAT + model(b, c, d), 1), (AS_IS + (n - 2) * REPEAT + more, 2), ((n - 1) * AS_IS + more + (n - 2) * model(c, c, c), n)]
            stay = model.stay[b, c, d, n] = max(scores, key=lambda x: x[0])[1]
        return c * stay

    return RUN.sub(shorter, token)


def decoded(token: str, model: Characters, apart: bool = False) -> list[str]:
    """The words of restore(), remembered."""
    if LOOKS_LIKE.keys().isdisjoint(token) and not any(x in token for x in MARKS):
        return WORD.findall(unrepeated(token, model))
    found = model.decoded.get((token, apart))
    if found is None:
        found = restore(token, model, apart)
        if len(model.decoded) > DECODED:
            model.decoded.clear()
        if len(token) <= REMEMBERED:
            model.decoded[token, apart] = found
    return WORD.findall(found)


def suspect(token: str) -> bool:
    """Whether a token shows a disguise: a look-alike, a repeated letter or a mark within."""
    if NUMBER.fullmatch(token):
        return False
    return not LOOKS_LIKE.keys().isdisjoint(token) or DISGUISED.search(token) is not None


def token_words(token: str, model: Characters) -> tuple[str, ...]:
    """The words of a lower-case token or run of characters set apart, restored ones besides the plain ones."""
    body = token.strip(EDGES)
    if body.isalpha():
        short = unrepeated(body, model) if RUN.search(body) else body
        return (body,) if short == body else (body, short)
    words = WORD.findall(token)
    for form in dict.fromkeys((body.rstrip(CLOSING), body)):
        if APART.fullmatch(form):
            words += decoded(GAP.sub(" ", form), model, apart=True) + decoded(GAP.sub("", form), model)
        elif suspect(form):
            words += decoded(form, model)
            pieces = INNER.split(form)
            for piece in pieces if len(pieces) > 1 else ():
                if suspect(piece):
                    words += decoded(piece, model)
    return tuple(dict.fromkeys(words))


def word_terms(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) >= k)]


def may_be_apart(words: list[str]) -> bool:
    """Whether neighbouring tokens end and begin with a single character, as in any phrase that APART finds over white space."""
    for i, b in enumerate(words[1:]):
        if len(b) == 1 or not b[1].isalnum() or b[0] in MARKS:
            a = words[i].rstrip(MARKS)
            if len(a) <= 1 or not a[-2].isalnum():
                return True
    return False


def tokens_of(text: str) -> tuple[set[str], list[str]]:
    """Distinct tokens, and runs of single characters that are set apart."""
    low = text.lower()
    words = low.split()
    tokens = set(words)
    if not may_be_apart(words):
        return tokens, []
    return tokens, runs_apart(low)


def runs_apart(low: str) -> list[str]:
    """Different runs of single characters that are no tokens."""
    runs = [x for x in dict.fromkeys(m.group() for m in APART.finditer(low)) if any(map(str.isalpha, x))]
    tokens = set(low.split()) if runs else ()
    return [x for x in runs if x not in tokens]


class Cut:
    """Texts cut into their tokens as tokens_of() does it: different tokens, and the row and token of each place.

    `apart` has the runs of single characters of the rows that hold any.
    """

    def __init__(self, texts: list[str | None]):
        low = [t.lower() if t else "" for t in texts]
        parts = pc.utf8_split_whitespace(pa.array(low, pa.large_string()))
        places = parts.flatten().dictionary_encode()
        self.tokens: list[str] = places.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.token = places.indices.to_numpy().astype("int64")
        self.row = np.repeat(np.arange(len(low)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
        if "" in self.tokens:  # what Arrow finds before and after white space at the ends of a text
            real = self.token != self.tokens.index("")
            self.token, self.row = self.token[real], self.row[real]
        self.low = low

    @property
    def repeats(self) -> np.ndarray:
        """Whether a token holds the same character twice in a row."""
        size = np.array([len(x) for x in self.tokens], "int64")
        chars = np.frombuffer("".join(self.tokens).encode("utf-32-le"), "<u4")
        of = np.repeat(np.arange(len(size)), size)
        out = np.zeros(len(size), bool)
        out[of[1:][(chars[1:] == chars[:-1]) & (of[1:] == of[:-1])]] = True
        return out

    @property
    def apart(self) -> dict[int, list[str]]:
        begins = np.array([len(b) == 1 or not b[1:2].isalnum() or b[0] in MARKS for b in self.tokens], bool)
        begin = np.flatnonzero(begins[self.token[1:]] & (self.row[1:] == self.row[:-1]))
        ends = {i: len(a) <= 1 or not a[-2].isalnum() for i in np.unique(self.token[begin]).tolist() for a in [self.tokens[i].rstrip(MARKS)]}
        rows = {r for r, i in zip(self.row[begin].tolist(), self.token[begin].tolist(), strict=True) if ends[i]}
        return {r: runs for r in sorted(rows) if (runs := runs_apart(self.low[r]))}


def slices(texts: pd.Series) -> Iterator[slice]:
    """Neighbouring rows of about SLICE characters, and single rows that are longer."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= SLICE:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs, in order, of numbers below 2**31 and 2**32."""
    pairs = np.sort(a << 32 | b)
    pairs = pairs[np.diff(pairs, prepend=-1) > 0]
    return pairs >> 32, pairs & 0xFFFFFFFF


def character_counts(docs: DataFrame, text_col: str = "text") -> dict[str, int]:
    """Trigrams of characters (with word ends) over all words of all documents: all there are over the ALPHABET."""

    def counted(texts: list[str | None]) -> pd.DataFrame:
        cut = Cut(texts)
        n = np.bincount(cut.token, minlength=len(cut.tokens))
        alpha = np.array([w.isalpha() for w in cut.tokens], bool)
        words = [BEGIN + BEGIN + w + END for w, is_word in zip(cut.tokens, alpha, strict=True) if is_word]
        size = np.array([len(w) for w in words], "int64")
        chars = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        if not words:
            return pd.DataFrame({"g": pd.Series([], dtype=object), "n": np.array([], "int64")})
        within = np.ones(len(chars), bool)  # whether a trigram begins here
        within[np.cumsum(size) - 1] = within[np.cumsum(size) - 2] = False
        at = np.flatnonzero(within)
        code = chars.astype("int64")
        found = pa.array(code[at] << 42 | code[at + 1] << 21 | code[at + 2]).dictionary_encode()
        gram = found.dictionary.to_numpy()
        sums = np.zeros(len(gram), "int64")
        np.add.at(sums, found.indices.to_numpy(), np.repeat(n[alpha], size - 2))
        three = np.stack([gram >> 42, gram >> 21 & 0x1FFFFF, gram & 0x1FFFFF], 1).astype("<u4")
        return pd.DataFrame({"g": three.view("<U3").ravel().astype(object), "n": sums})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch["text"]):
                yield counted(batch["text"].iloc[part].tolist())

    sums = docs.select(F.col(text_col).alias("text")).mapInPandas(tidy(run), "g string, n long").groupBy("g").agg(F.sum("n").alias("n"))
    sums = written(sums, "trigrams")
    often = sums.groupBy(F.substring("g", 3, 1).alias("c")).agg(F.sum("n").alias("n")).where(F.col("c") != END).orderBy(F.desc("n"), "c").limit(ALPHABET).collect()
    rare = f"[^{BEGIN}{END}" + "".join(r["c"] for r in often) + "]"
    return {r["g"]: r["n"] for r in sums.groupBy(F.regexp_replace("g", rare, OTHER).alias("g")).agg(F.sum("n").alias("n")).collect()}


def term_counts(texts: list[str | None], y: np.ndarray, model: Characters, known: dict[str, tuple[str, ...]]) -> pd.DataFrame:
    """Terms of texts with label y: how many texts of each label hold them, and signatures of those of label 1."""
    cut = Cut(texts)
    ids: dict[str, int] = {}
    of_token, size = [], np.ones(len(cut.tokens), "int64")
    for i, (token, repeats) in enumerate(zip(cut.tokens, cut.repeats.tolist(), strict=True)):
        body = token if token.isalpha() else token.strip(EDGES)
        if body.isalpha() and not (repeats and RUN.search(body)):
            of_token.append(ids.setdefault(body, len(ids)))
            continue
        words = known.get(token)
        if words is None:
            if len(known) > DECODED:
                known.clear()
            words = known[token] = token_words(token, model)
        size[i] = len(words)
        of_token.extend(ids.setdefault(w, len(ids)) for w in words)
    row, token = distinct(cut.row, cut.token)
    n = size[token]
    place = np.arange(n.sum()) + np.repeat((np.cumsum(size) - size)[token] - (np.cumsum(n) - n), n)
    spelt = [(r, ids.setdefault(w, len(ids))) for r, runs in cut.apart.items() for x in runs for w in token_words(x, model)]
    more = np.array(spelt, "int64").reshape(-1, 2)
    row, word = distinct(np.concatenate([np.repeat(row, n), more[:, 0]]), np.concatenate([np.array(of_token, "int64")[place], more[:, 1]]))
    held, words, names = [(row, word)], pa.array(list(ids), pa.large_string()), list(ids)
    size = pc.utf8_length(words).to_numpy()
    for k in BEGINNINGS:
        begins = pc.utf8_slice_codeunits(words.filter(pa.array(size >= k)), 0, k).dictionary_encode()
        begin = np.zeros(len(words), "int64")
        begin[size >= k] = len(names) + begins.indices.to_numpy()
        names += [x + "*" for x in begins.dictionary.to_numpy(zero_copy_only=False)]
        long = size[word] >= k
        held.append(distinct(row[long], begin[word[long]]))
    row, term = (np.concatenate(x) for x in zip(*held, strict=True))
    toxic = y[row] == 1
    out = pd.DataFrame({"w": pd.Series(names, dtype=object), "n0": np.bincount(term[~toxic], minlength=len(names)), "n1": np.bincount(term[toxic], minlength=len(names))})
    signs = np.full(len(names), None, object)
    if toxic.any():
        least = np.full(len(texts), 1 << 32, "int64")
        at = y[cut.row] == 1
        crc = np.zeros(len(cut.tokens), "int64")
        for i in np.unique(cut.token[at]).tolist():
            crc[i] = zlib.crc32(cut.tokens[i].encode())
        np.minimum.at(least, cut.row[at], crc[cut.token[at]])
        of, sign = distinct(term[toxic], least[row[toxic]])
        first = np.flatnonzero(np.diff(of, prepend=-1))
        for i, signed in zip(of[first].tolist(), np.split(sign, first[1:]), strict=True):
            signs[i] = signed[:SIGNATURES]
    return out.assign(s=signs)


def term_evidence(rows: DataFrame, shared: Broadcast[Characters]) -> tuple[dict[str, float], float]:
    """Log odds of the strongest terms, shrunk to the prior, and the prior log odds, from all rows (text, y).

    Near copies of one toxic text are no further evidence: a term counts as often as the texts that hold it differ in
    their signature (the least hash of their tokens), as long as those are few.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, known = shared.value, {}
        for batch in batches:
            for part in slices(batch["text"]):
                texts = batch.iloc[part]
                counts = term_counts(texts["text"].tolist(), texts["y"].to_numpy("int64"), model, known)
                yield from (counts.iloc[i : i + 20_000] for i in range(0, len(counts), 20_000))

    n0, n1 = rows.agg(F.count(F.when(F.col("y") == 0, 1)), F.count(F.when(F.col("y") == 1, 1))).first()
    if not n0 or not n1:
        return {}, -3.0
    share = n1 / (n0 + n1)
    sums = rows.mapInPandas(tidy(run), "w string, n0 long, n1 long, s array<long>").groupBy("w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.array_distinct(F.flatten(F.collect_list(F.when(F.col("n1") > 0, F.col("s"))))).alias("s"))
    differ = F.when(F.size("s") < SIGNATURES, F.least(F.col("n1"), F.size("s"))).otherwise(F.col("n1"))
    odds = F.log((differ + SHRINK * share) / (F.col("n0") + SHRINK * (1 - share))) - math.log(share / (1 - share))
    best = sums.withColumn("odds", odds).where(F.col("odds") > LEAST_ODDS).select("w", "odds").collect()
    return {r["w"]: r["odds"] for r in best}, math.log(n1 / n0)


def outline(form: str) -> str:
    """What all readings of a form share: without marks and repeats, one character for those that look alike."""
    return SAME.sub(r"\1", form.translate(KIN))


class TokenOdds:
    """Per token the log odds of the strongest term that its words give.

    The words of most tokens begin no term, and of these no disguise is decoded: a term's outline lies at the begin of
    the outline of each word that gives it, and that within the outline of the token.
    """

    def __init__(self, weights: dict[str, float], model: Characters):
        self.weights, self.model, self.known = weights, model, {}
        self.heads = {t[: BEGINNINGS[0]] for t in weights}
        self.starts, self.outlines = {SAME.sub(r"\1", h) for h in self.heads}, {outline(h) for h in self.heads}
        self.letters, self.sizes = {x[0] for x in self.starts}, sorted({len(x) for x in self.starts | self.outlines})

    def of_words(self, words) -> list[float]:
        return [max(self.weights.get(t, 0.0) for t in word_terms(w)) for w in words]

    def of_tokens(self, cut: Cut) -> np.ndarray:
        heads, k, out = self.heads, BEGINNINGS[0], np.zeros(len(cut.tokens))
        for i, (token, repeats) in enumerate(zip(cut.tokens, cut.repeats.tolist(), strict=True)):
            body = token if token.isalpha() else token.strip(EDGES)
            if not body.isalpha():
                out[i] = self(token)
            elif repeats:
                if body[0] in self.letters and self.may_begin(body):
                    out[i] = self(token, sure=True)
            elif body[:k] in heads:
                out[i] = self.of_words((body,))[0]
        return out

    def may_begin(self, body: str) -> bool:
        line = SAME.sub(r"\1", body)
        return any(line[:k] in self.starts for k in self.sizes)

    def may_hold(self, form: str) -> bool:
        line = outline(form)
        return any(line[i : i + k] in self.outlines for k in self.sizes for i in range(len(line) - k + 1))

    def __call__(self, token: str, sure: bool = False) -> float:
        best = self.known.get(token)
        if best is None:
            best = max(self.of_words(token_words(token, self.model)), default=0.0) if sure or self.may_hold(token) else 0.0
            if len(self.known) > KEPT:
                self.known.clear()
            if len(token) <= REMEMBERED:
                self.known[token] = best
        return best


def evidence(text, shared: Broadcast[Characters], weights: dict[str, float]):
    """A column: the sum over a text's distinct words of their strongest term."""
    strong = SparkSession.active().sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def summed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        odds_of = TokenOdds(strong.value, model)

        def sums(texts: list[str | None]) -> list[float]:
            cut = Cut(texts)
            odds = odds_of.of_tokens(cut)
            strongly = odds[cut.token] > 0
            found = defaultdict(list)
            for r, i in zip(*(x.tolist() for x in distinct(cut.row[strongly], cut.token[strongly])), strict=True):
                found[r].append(odds[i])
            # A spelt-out phrase is as many words as it has.
            spelt = {r: {w for x in runs if odds_of.may_hold("".join(x.split())) for w in token_words(x, model)} for r, runs in cut.apart.items()}
            return [math.fsum(found.get(r, ())) + math.fsum(odds_of.of_words(spelt.get(r, ()))) for r in range(len(texts))]

        for texts in batches:
            yield pd.Series([x for part in slices(texts) for x in sums(texts.iloc[part].tolist())], dtype="float64")
        odds_of.known.clear()
        give_back()

    return summed(text)


def fitted(points: list[tuple[float, int, int]], prior: float) -> tuple[float, float]:
    """a and b of 1 / (1 + exp(-(a x + b))) by ridge logistic regression on (x, n0, n1), with both kinds weighing the same."""
    x = np.array([p[0] for p in points], float)
    n0, n1 = (np.array([p[i] for p in points], float) for i in (1, 2))
    if not len(x) or not n0.sum() or not n1.sum():
        return 1.0, prior
    n0, n1 = n0 / n0.sum(), n1 / n1.sum()
    design, w = np.stack([x, np.ones_like(x)], 1), np.array([0.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ ((n0 + n1) * p - n1) + 1e-3 * w
        hess = (design * ((n0 + n1) * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        w = w - np.linalg.solve(hess, grad)
    return float(max(w[0], 1e-3)), float(w[1])


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Per document: doc_id, h (hash of the text), score (0 to 1) and predicted. labels: ids and labels to learn from."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    known = few(labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")))
    rows = written(texts.join(known, "doc_id").select("text", "y"), "labelled")
    model = docs.sparkSession.sparkContext.broadcast(Characters(character_counts(docs, text_col)))
    weights, prior = term_evidence(rows, model)
    found = written(texts.select("doc_id", F.xxhash64("text").alias("h"), evidence(F.col("text"), model, weights).alias("x")), "evidence")
    seen = found.join(known, "doc_id").groupBy(F.round("x", 1).alias("x")).agg(F.count(F.when(F.col("y") == 0, 1)), F.count(F.when(F.col("y") == 1, 1))).collect() if weights else []
    a, b = fitted([tuple(r) for r in seen], prior)
    s = found.withColumn("score", 1 / (1 + F.exp(-(F.col("x") * a + b))))
    return s.select("doc_id", "h", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
