"""Page-bounded chunks: paragraphs are packed greedily, long ones are cut into overlapping runs of words."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studyloom.plans.lineage import cut

#: Characters of a chunk, and of the words repeated at the start of the next.
MAX_CHARS, OVERLAP_CHARS = 1000, 150

_BREAK = re.compile(r"\n\s*\n")


def word_runs(lengths: list[int], most: int, overlap: int) -> list[tuple[int, int]]:
    """Runs [start, end) of words with these lengths, joined by single blanks: each as long as `most` allows, the next one
    starting as many whole words back as fit into `overlap` (none, if the whole run would)."""
    ends = [0]
    for n in lengths:
        ends.append(ends[-1] + n + 1)
    total, start, out = len(lengths), 0, []
    while True:
        end = bisect_right(ends, ends[start] + most + 1) - 1
        out.append((start, end))
        if end >= total:
            return out
        back = bisect_left(ends, ends[end] - 1 - overlap, start, end)
        start = end if back == start else back


def page_chunks(text: str | None, most: int, overlap: int) -> list[str]:
    """The chunks of one page. Blank pages have none. Words longer than a chunk are cut into slices, which are words then."""
    out: list[str] = []
    pending, size = [], 0
    for raw in _BREAK.split(text or ""):
        words = [w[i : i + most] for w in raw.split() for i in range(0, len(w), most)]
        if not words:
            continue
        length = len(" ".join(raw.split()))
        if length > most:
            if pending:
                out.append("\n\n".join(pending))
            pending, size = [], 0
            out += [" ".join(words[a:b]) for a, b in word_runs([len(w) for w in words], most, overlap)]
        elif pending and size + 2 + length <= most:
            pending.append(" ".join(words))
            size += 2 + length
        else:
            if pending:
                out.append("\n\n".join(pending))
            pending, size = [" ".join(words)], length
    return [*out, "\n\n".join(pending)] if pending else out


def chunk_pages(pages: DataFrame, document: str, page: str, text: str, most: int = MAX_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """document, page, position in the page, chunk_index (from 0, over the pages of a document in order), chunk_text.

    Null and blank pages give no chunks, an empty table none; repeated (document, page) rows give their chunks each. Chunks
    never cross pages. The pages of one document are numbered by counts per page, so a long document is no single group of
    texts. Other columns aren't read."""
    if most < 1 or not 0 <= overlap < most:
        raise ValueError("chunks need most >= 1 and 0 <= overlap < most")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut_page(s: pd.Series) -> pd.Series:
        return s.map(lambda t: page_chunks(t, most, overlap))

    parts = pages.select(F.col(document).alias("document"), F.col(page).alias("page"), cut_page(F.col(text)).alias("parts")).filter(F.size("parts") > 0)
    parts = cut(parts.select("document", "page", F.posexplode("parts").alias("position", "chunk_text")).withColumn("row", F.monotonically_increasing_id() - F.col("position")))
    # only the counts go through the window: a row a page, whatever its text
    counts = parts.groupBy("document", "page", "row").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("document").orderBy("page", "row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counts.withColumn("first", before).select("row", "first")
    return parts.join(first, "row").select("document", "page", "position", (F.col("first") + F.col("position")).cast("int").alias("chunk_index"), "chunk_text")


def chunk_words(texts: DataFrame, document: str, text: str, most: int, overlap: int) -> DataFrame:
    """Overlapping runs of the words of a whole text, whatever its paragraphs: document, chunk_index, chunk_text."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut_text(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[str]:
            words = [w[i : i + most] for w in (t or "").split() for i in range(0, len(w), most)]
            return [" ".join(words[a:b]) for a, b in word_runs([len(w) for w in words], most, overlap)] if words else []

        return s.map(one)

    return texts.select(F.col(document).alias("document"), F.posexplode(cut_text(F.col(text))).alias("chunk_index", "chunk_text"))


def split_pages(texts: DataFrame, document: str, text: str, marker: str) -> DataFrame:
    """The sections of each text between markers (a plain string): document, page (from 1), page_text; blank sections stay."""
    parts = F.split(F.col(text), "\\Q" + marker + "\\E")
    return texts.filter(F.col(text).isNotNull()).select(F.col(document).alias("document"), F.posexplode(parts).alias("at", "page_text")).select("document", (F.col("at") + 1).alias("page"), "page_text")
