"""Quality by nearest-neighbour voting in a latent semantic space.

A text's terms are its words (lower-cased, hashed to WORDS buckets), the shapes of its tokens (letter case, marks, digits),
their case with the last character, their lengths, repeats of the token before, repeats of any token, and line ends. Long
tokens are cut into consecutive pieces of PIECE characters that all give terms. Term weights use document counts over all
documents. A truncated SVD of a bounded sample of labelled texts (LABELLED, by hash, half of either label) gives the
latent space; the sample's vectors are broadcast, and every document takes exact cosine products with all of them in
blocks. The nearest NEIGHBOURS vote with their similarity.

Equal texts are one labelled text with the mean of their labels, so a large group of copies is one vote. Neighbours that
tie with the last of the nearest vote as well. Nulls and empty texts have only the term of the empty text. Very long texts
are read whole. Repeated rows count each for itself; a repeated id takes each of its labels. Without labelled rows every
text scores 0.5. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import few, written

#: Bounds of what is broadcast: labelled texts that vote, and latent dimensions.
LABELLED, DIMENSIONS = 4096, 48
NEIGHBOURS = 24
#: Buckets of hashed shapes and words, and of what a text has besides; the share of words in a vector.
SHAPES, WORDS, OTHERS, WORD_SHARE = 1024, 2048, 4, 0.5
WIDTH = SHAPES + WORDS + OTHERS
#: Tokens whose terms a task keeps; rows of a block of products; characters of a piece of a long token.
KEPT, BLOCK, PIECE = 300_000, 512, 64
LENGTHS = [f"n{n // 3}" for n in range(PIECE + 1)]
SHAPE = [(re.compile(p), s) for p, s in ((r"[^\W\d_]+", "a"), (r"\d+", "9"))]


@cache
def bucket(term: str) -> int:
    """A term's bucket; there are few such terms: lengths, cases with a last character, common shapes."""
    return zlib.crc32(term.encode("utf-8", "replace")) % SHAPES


def shape_of(token: str) -> int:
    if token.isalpha():
        return bucket("sa")
    shape = token
    for pattern, sign in SHAPE:
        shape = pattern.sub(sign, shape)
    return bucket("s" + shape) if len(shape) < 4 else zlib.crc32(("s" + shape).encode("utf-8", "replace")) % SHAPES


def token_terms(token: str) -> tuple[int, int, int, int]:
    """Buckets of a token's shape, of its case with its last character, of its length, and of its word."""
    case = "l" if token.islower() else "U" if len(token) > 1 and token.isupper() else "T" if token[0].isupper() else "l"
    word = token.lower().strip(".,;:!?\"'()")
    return shape_of(token), bucket(case + token[-1]), bucket(LENGTHS[len(token)]), SHAPES + zlib.crc32(word.encode("utf-8", "replace")) % WORDS


class Terms:
    """Texts to rows of term frequencies, square-rooted, before weighting."""

    def __init__(self):
        self.known: dict[str, tuple[int, int, int, int]] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        tokens, known = (text or "").split(), self.known
        if len(known) > KEPT:
            known.clear()
        row = np.zeros(WIDTH)
        if not tokens:
            row[SHAPES + WORDS] = 1
            return row
        same = sum(map(str.__eq__, tokens, tokens[1:]))
        if len(max(tokens, key=len)) > PIECE:
            tokens = [t[i : i + PIECE] for t in tokens for i in range(0, len(t), PIECE)]
        counts = Counter(tokens)
        for t in counts:
            if t not in known:
                known[t] = token_terms(t)
        places = np.array([known[t] for t in counts])
        row[: SHAPES + WORDS] = np.sqrt(np.bincount(places.ravel(), np.repeat(np.fromiter(counts.values(), float, len(counts)), 4), SHAPES + WORDS) / len(tokens))
        row[SHAPES : SHAPES + WORDS] *= WORD_SHARE
        row[SHAPES + WORDS + 1 :] = 1.5 * np.sqrt([same / len(tokens), 1 - len(counts) / len(tokens), min(1.0, text.count("\n") / len(tokens))])
        return row


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def document_counts(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """Of each term the number of documents with it, over all documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms, n, sums = Terms(), 0, np.zeros(WIDTH)
        for batch in batches:
            for t in batch["text"]:
                sums += terms(t) > 0
                n += 1
        yield pd.DataFrame({"t": np.arange(-1, WIDTH), "n": np.r_[n, sums].astype("int64")})

    rows = docs.select(F.col(text_col).alias("text")).mapInPandas(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(WIDTH)
    for r in rows:
        if r["t"] >= 0:
            counts[r["t"]] = r["n"]
    return counts, max((r["n"] for r in rows if r["t"] == -1), default=0)


def labelled_sample(texts: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term rows, labels (0 to 1) and weights of at most LABELLED labelled texts. texts has doc_id and text, labels doc_id and y.

    A sampled text stands for as many labelled texts as there are of its kind for each sampled one.
    """
    marked = texts.select("doc_id", F.xxhash64("text").alias("h")).join(few(labels), "doc_id")
    each = written(marked.groupBy("h").agg(F.avg("y").alias("y")).withColumn("kind", (F.col("y") >= 0.5).cast("int")), "labelled")
    kinds = {r["kind"]: r["count"] for r in each.groupBy("kind").count().collect()}
    drawn = []
    for kind, n in kinds.items():
        # A hash bound first, so that no task sends more than its share.
        bound = int(min(1.0, 0.6 * LABELLED / n) * 2**32)
        mark = F.xxhash64("h")
        some = each.where((F.col("kind") == kind) & (F.pmod(mark, F.lit(2**32)) <= bound)).orderBy(mark, "h").limit(LABELLED // 2)
        drawn.append(some.select(F.col("h").alias("_h"), "y", "kind"))
    if not drawn:
        return np.empty((0, WIDTH)), np.empty(0), np.empty(0)
    sample = written(drawn[0] if len(drawn) == 1 else drawn[0].unionByName(drawn[1]), "sample")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = Terms()
        for b in batches:
            rows = [terms(t) for t in b["text"]]
            at = [np.flatnonzero(r) for r in rows]
            yield pd.DataFrame({"h": b["h"], "y": b["y"], "kind": b["kind"], "at": at, "v": [r[i] for r, i in zip(rows, at, strict=True)]})

    chosen = texts.withColumn("h", F.xxhash64("text")).join(F.broadcast(sample), F.col("h") == F.col("_h")).groupBy("h").agg(F.first("text").alias("text"), F.first("y").alias("y"), F.first("kind").alias("kind"))
    # Rows of WIDTH numbers at most, LABELLED of them.
    rows = sorted(chosen.mapInPandas(run, "h long, y double, kind int, at array<int>, v array<double>").collect())
    x = np.zeros((len(rows), WIDTH))
    for i, r in enumerate(rows):
        x[i, r["at"]] = r["v"]
    per = Counter(r["kind"] for r in rows)
    return x, np.array([r["y"] for r in rows]), np.array([kinds[r["kind"]] / per[r["kind"]] for r in rows])


def latent_space(x: np.ndarray) -> np.ndarray:
    """The projection to the leading DIMENSIONS right singular vectors, by subspace iteration from a fixed start."""
    q = np.random.default_rng(3).normal(size=(x.shape[1], DIMENSIONS + 16))
    for _ in range(8):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    return q @ np.linalg.svd(x @ q, full_matrices=False)[2][:DIMENSIONS].T


def votes(cosine: np.ndarray, labels: np.ndarray, stands: np.ndarray) -> np.ndarray:
    """The share of label 1 among the NEIGHBOURS nearest (and those that tie with the last), weighted by similarity."""
    k = min(NEIGHBOURS, cosine.shape[1])
    last = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, cosine.shape[1] - k]
    row, col = np.nonzero(cosine >= last[:, None] - 1e-6)
    # A text outside of the latent space is as near to all, and gets the share of their labels.
    weight = (np.maximum(cosine[row, col].astype(np.float64), 0) ** 8 + 1e-9) * stands[col]
    return np.bincount(row, weight * labels[col], len(cosine)) / np.bincount(row, weight, len(cosine))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Per document: doc_id, score (0 to 1) and predicted. labels: ids and labels to learn from."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    x, y, stands = labelled_sample(texts, labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")))
    if not len(x):
        return texts.select("doc_id", F.lit(0.5).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    counts, n = document_counts(docs, text_col)
    idf = np.log((1 + n) / (1 + counts)) + 1
    project = latent_space(unit(x * idf))
    shared = docs.sparkSession.sparkContext.broadcast((idf, project, unit(unit(x * idf) @ project).astype(np.float32), y, stands))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        idf, project, vectors, labels, stands = shared.value
        terms = Terms()
        for texts in batches:
            out = []
            for i in range(0, len(texts), BLOCK):
                z = unit(unit(np.array([terms(t) for t in texts.iloc[i : i + BLOCK]]) * idf) @ project).astype(np.float32)
                out.append(votes(z @ vectors.T, labels, stands))
            yield pd.Series(np.concatenate(out) if out else [], dtype="float64")

    s = texts.select("doc_id", score(F.col("text")).alias("score"))
    return s.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
