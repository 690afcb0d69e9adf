"""Token counts by the whole-token shortcut.

The vocabulary is read once per task. Two facts are proved from it before anything is counted:

* no piece holds the space mark after another character, so no merge crosses from a word into the space before the
  next one, and a text may be cut before each run of spaces;
* no piece holds a line feed, so a word may also be cut at line feeds.

A word that is itself a vocabulary string and encodes alone as one piece counts as 1 at once; every other word is
merged by the library, once per task as long as it stays in a bounded table. If a fact doesn't hold for a vocabulary,
texts are encoded whole.

Nulls and empty texts have 0 tokens. Very long words are never kept in the table. Repeated rows count each for itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words in the table of merged words, and the longest that is kept.
TABLE_WORDS, LONGEST_KEPT = 800_000, 64
#: Texts that are looked up together.
SLICE = 500
MARK = "▁"


def whole_tokens(processor) -> set[str]:
    """Words (without their space mark) whose marked form is a vocabulary string that encodes alone as one piece."""
    found = [p[1:] for i in range(processor.get_piece_size()) if (p := processor.id_to_piece(i)).startswith(MARK) and MARK not in p[1:] and len(p) > 1]
    return {w for w, ids in zip(found, processor.encode(found), strict=True) if len(ids) == 1}


def cuts_hold(processor) -> bool:
    """Whether texts may be cut before runs of spaces and at line feeds."""
    normal = [processor.id_to_piece(i) for i in range(processor.get_piece_size()) if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i))]
    # A probe of the normaliser: marks are kept one for one, and the text is otherwise left alone.
    probe = "A  b\n Äﬁ "
    return not any(MARK in p.lstrip(MARK) or "\n" in p for p in normal) and processor.decode(processor.encode(probe)) == probe


def text_counter(processor):
    """A function from a list of texts to their numbers of tokens."""
    if not cuts_hold(processor):
        return lambda texts: [len(ids) for ids in processor.encode(texts)]
    known = dict.fromkeys(whole_tokens(processor), 1)
    table, runs = dict(known), re.compile(" ( *[^ ]*)")

    def merged(missing: list[str]) -> dict[str, int]:
        """Counts of words that are no whole tokens; those with line feeds are cut there and share their parts."""
        plain = [w for w in missing if "\n" not in w]
        found = dict(zip(plain, map(len, processor.encode(plain)), strict=True))
        broken = {w: w.split("\n") for w in missing if "\n" in w}
        first = list({p[0] for p in broken.values() if p[0]})
        after = list({x for p in broken.values() for x in p[1:]})
        # A part after a line feed has no space mark; the feed before it keeps the mark apart, as a token of its own.
        begins = dict(zip(first, map(len, processor.encode(first)), strict=True)) | {"": 1}
        goes_on = dict(zip(after, (len(ids) - 1 for ids in processor.encode(["\n" + x for x in after])), strict=True))
        return found | {w: begins[p[0]] + sum(goes_on[x] for x in p[1:]) for w, p in broken.items()}

    def count(texts: list[str]) -> list[int]:
        if len(table) > TABLE_WORDS:
            table.clear()
            table.update(known)
        words = []
        for text in texts:
            cut = text.replace(MARK, " ").split(" ") if text else []
            words.append(runs.findall(" " + text.replace(MARK, " ")) if "" in cut else cut)
        # A space alone after the cut is a mark alone, which is one token.
        new = merged(list({w for cut in words for w in cut if w and w not in table}))
        table.update((w, n) for w, n in new.items() if len(w) <= LONGEST_KEPT)
        long = {w: n for w, n in new.items() if len(w) > LONGEST_KEPT} | {"": 1}
        if len(long) == 1:
            table[""] = 1
            return [sum(map(table.__getitem__, cut)) for cut in words]
        return [sum(table[w] if w in table else long[w] for w in cut) for cut in words]

    return count


def token_count(text: Column, model: str) -> Column:
    """The number of tokens that the SentencePiece model file gives for a text column, as a long."""

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import sentencepiece

        count = text_counter(sentencepiece.SentencePieceProcessor(model_file=model))
        for texts in batches:
            texts = [t or "" for t in texts]
            counts = (n for i in range(0, len(texts), SLICE) for n in count(texts[i : i + SLICE]))
            yield pd.Series(list(counts), dtype="int64")

    return counted(text)


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""
    n = docs.select(F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), token_count(F.col(text_col), model).alias("n_tokens"))
    return n.withColumn("over_limit", F.col("n_tokens") > limit)
