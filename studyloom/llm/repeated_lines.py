"""Problem 2: lines repeated across the documents of one source, by compressed document bitmaps per line.

A document's number within the sorted (source, document) list is its bit. A line's bits lie in containers of 32,768 bits. Every
spelling in which a line is stored (a variant) gets containers of its own first: the sorted array of its bits while they are few,
else a bitmap. The variants of a line are united, cardinalities are exact, and lines are deleted where their own document's bit
is set."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from studyloom.functions.text import uuid_key
from studyloom.llm.canonical import two_hashes
from studyloom.llm.lookalikes import caseless
from studyloom.plans.lineage import broadcast_if_small, cut, spread

#: A container of at least so many bits is a bitmap, one of fewer a sorted array.
DENSE = 256
#: Bits of one container, as Spark's bitmap functions divide them.
BITS = 32768


_DIGITS = re.compile(r"\d+")
_LINES = "chunk_id bigint, source string, doc string, line_no int, a bigint, b bigint, variant bigint"
_LINE_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def line_key(line: str) -> str:
    """What makes two lines the same: their look without case, white space and the value of digit runs."""
    return _DIGITS.sub("0", "".join(caseless(line).split()))


def _explode_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple[int, int, int] | None] = {}
    for batch in batches:
        rows = []
        for chunk, source, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for n, line in enumerate(text.split("\n"), 1):
                if line in known:
                    h = known[line]
                else:
                    key = line_key(line)
                    h = known[line] = (*two_hashes(key), xxhash.xxh64_intdigest(line) - (1 << 63)) if key else None
                if h:
                    rows.append((chunk, source, doc, n, *h))
        if len(known) > 200_000:
            known.clear()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 7, _LINE_TYPES, strict=True)], names=[x.split()[0] for x in _LINES.split(", ")])


def lines_of(chunks: DataFrame, chunk_id: str, document_id: str, source: str, text: str) -> DataFrame:
    """Every line that isn't empty: chunk_id, source, doc, line_no, a and b (128 bits of its key), variant (64 bits of it as stored)."""
    rows = chunks.filter(F.col(text).isNotNull()).select(F.col(chunk_id).cast("bigint"), F.col(source), uuid_key(document_id), F.col(text))
    return spread(rows).mapInArrow(_explode_lines, _LINES)


_KEY = ["source", "a", "b", "n_docs", "bucket"]


def _containers(bits: DataFrame, keys: list[str]) -> DataFrame:
    """bits (keys, at; each once) as one container for each key: card, and bits (a sorted array) or bitmap by card."""
    sized = bits.withColumn("card", F.count("*").over(Window.partitionBy(*keys)))
    few = sized.filter(F.col("card") < DENSE).groupBy(*keys).agg(F.max("card").alias("card"), F.array_sort(F.collect_list("at")).alias("bits"))
    many = sized.filter(F.col("card") >= DENSE).groupBy(*keys).agg(F.max("card").alias("card"), F.expr("bitmap_construct_agg(at)").alias("bitmap"))
    return few.unionByName(many, allowMissingColumns=True)


def variants(lines: DataFrame) -> DataFrame:
    """A container for each variant of a line: of lines (source, a, b, n_docs, bucket, variant, at)."""
    keys = [*_KEY, "variant"]
    return _containers(lines.select(*keys, "at").distinct(), keys)


def united(parts: DataFrame) -> DataFrame:
    """The containers of all variants of a line united into one: an array where they are arrays of few bits in all, else a bitmap."""
    whole = Window.partitionBy(*_KEY)
    sized = parts.withColumns({"most": F.sum("card").over(whole), "maps": F.count("bitmap").over(whole)})
    small = (F.col("maps") == 0) & (F.col("most") < DENSE)
    few = sized.filter(small).groupBy(*_KEY).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("bits")))).alias("bits")).withColumn("card", F.size("bits").cast("bigint"))
    lifted = sized.filter(~small & F.col("bits").isNotNull()).select(*_KEY, F.explode("bits").alias("at")).groupBy(*_KEY).agg(F.expr("bitmap_construct_agg(at)").alias("bitmap"))
    maps = sized.filter(F.col("bitmap").isNotNull()).select(*_KEY, "bitmap").unionByName(lifted).groupBy(*_KEY).agg(F.expr("bitmap_or_agg(bitmap)").alias("bitmap"))
    return few.unionByName(maps.withColumn("card", F.expr("bitmap_count(bitmap)")), allowMissingColumns=True)


def repeated_lines(
    chunks: DataFrame, chunk_id: str = "chunk_id", document_id: str = "document_id", source: str = "source", text: str = "text", least: int = 4, share: float = 0.1
) -> DataFrame:
    """chunk_id, line_no (1-based after splitting at \\n) of every line that stands in at least `least` documents of its
    source and in at least `share` of them.

    Documents are counted by the UUID value of document_id; rows without id count for no document, but their lines are
    cases. Null source: a source of its own. Null text, empty text and lines of blanks or invisible characters only: no
    cases. Repeated chunks give repeated rows only if chunk_id repeats. Other columns, whatever their names, aren't read.
    Lines in too few rows to reach the threshold are dropped before any bitmap is built, which changes no count."""
    lines = cut(lines_of(chunks, chunk_id, document_id, source, text))
    same = lambda l, r, *ks: [F.col(f"{l}.{k}").eqNullSafe(F.col(f"{r}.{k}")) for k in ks]
    ids = chunks.filter(F.col(document_id).isNotNull()).select(F.col(source).alias("source"), uuid_key(document_id).alias("doc")).distinct()
    docs = cut(ids.repartitionByRange("source", "doc").sortWithinPartitions("source", "doc").withColumn("bit", F.monotonically_increasing_id()))
    sizes = cut(docs.groupBy("source").agg(F.count("*").alias("n_docs")))
    sizes = broadcast_if_small(sizes, sizes.count(), 200).alias("s")

    rows = lines.groupBy("source", "a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= least).alias("l")
    may = rows.join(sizes, same("l", "s", "source")[0]).filter(F.col("l.n") / F.col("s.n_docs") >= share).select("l.*", "s.n_docs")
    may = cut(may)
    may = broadcast_if_small(may, may.count(), 200).alias("m")

    hits = lines.alias("l").join(may, [F.col("l.a") == F.col("m.a"), F.col("l.b") == F.col("m.b"), *same("l", "m", "source")]).select("l.*", "m.n", "m.n_docs")
    hits = cut(hits)
    numbered = hits.filter(F.col("doc").isNotNull()).alias("h").join(docs.alias("d"), [F.col("h.doc") == F.col("d.doc"), *same("h", "d", "source")]).select("h.*", "d.bit")
    counted = cut(numbered).withColumns({"bucket": F.floor(F.col("bit") / BITS), "at": F.col("bit") % BITS})
    maps = cut(united(cut(variants(counted))))

    total = maps.groupBy("source", "a", "b", "n_docs").agg(F.sum("card").alias("documents"))
    bad = total.filter((F.col("documents") >= least) & (F.col("documents") / F.col("n_docs") >= share)).select("source", "a", "b")
    bad = cut(bad)
    n_bad = bad.count()
    kept = maps.alias("k").join(broadcast_if_small(bad, n_bad, 200).alias("x"), [F.col("k.a") == F.col("x.a"), F.col("k.b") == F.col("x.b"), *same("k", "x", "source")], "left_semi")

    # deletion: the bit of the line's own document; without a document the line itself
    own = counted.alias("h").join(kept.alias("k"), [F.col("h.a") == F.col("k.a"), F.col("h.b") == F.col("k.b"), F.col("h.bucket") == F.col("k.bucket"), *same("h", "k", "source")])
    byte = F.conv(F.hex(F.expr("substring(k.bitmap, cast(h.at div 8 + 1 as int), 1)")), 16, 10).cast("int")
    is_set = F.when(F.col("k.bitmap").isNull(), F.array_contains("k.bits", F.col("h.at"))).otherwise(byte.bitwiseAND(F.expr("shiftleft(1, cast(h.at % 8 as int))")) > 0)
    deleted = own.filter(is_set).select("h.chunk_id", "h.line_no")
    free = hits.filter(F.col("doc").isNull()).alias("h").join(broadcast_if_small(bad, n_bad, 200).alias("x"), [F.col("h.a") == F.col("x.a"), F.col("h.b") == F.col("x.b"), *same("h", "x", "source")], "left_semi")
    return deleted.unionByName(free.select("chunk_id", "line_no"))


def without_lines(chunks: DataFrame, repeated: DataFrame, chunk_id: str = "chunk_id", text: str = "text") -> DataFrame:
    """chunks with the repeated lines taken out of text; a chunk of such lines only becomes ''."""
    gone = repeated.groupBy(F.col("chunk_id").alias("_chunk")).agg(F.collect_set("line_no").alias("_gone"))
    rest = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda _, i: ~F.array_contains("_gone", i + 1)), "\n")
    joined = chunks.join(gone, F.col(chunk_id) == F.col("_chunk"), "left")
    return joined.withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(rest)).drop("_gone", "_chunk")
