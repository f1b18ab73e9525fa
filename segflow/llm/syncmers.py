"""Document fingerprints from closed syncmers; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segflow.functions.binding import let
from segflow.llm.repeats import NO_ID
from segflow.session import small_enough

#: Units of a k-mer and of its inner substrings, and anchors in a fingerprint.
GRAM, INNER, SKETCH = 3, 1, 64
#: A unit: a word with the space after it; a longer word is cut after every 16 code points.
UNIT = "[^ ]{1,16} ?| "
#: Documents of one range of ids, which are put in order together.
CELL = 4096


def anchor_hashes(text: Column, gram: int = GRAM, inner: int = INNER) -> Column:
    """32-bit hashes of the closed syncmers of a text.

    A run of ``gram`` units is chosen when the least hash of its runs of ``inner`` units is that of its first or its
    last. That depends on the run alone, so it is chosen wherever it stands. A text of fewer units is one anchor by
    itself; an empty one has none.
    """
    wide = gram - inner + 1

    def joint(own: Column, i: Column, n: int) -> Column:
        return F.get(own, i) if n == 1 else F.xxhash64(*(F.get(own, i + j) for j in range(n)))

    def of(units: Column) -> Column:
        def chosen(inners: Column) -> Column:
            edge = lambda i: F.least(F.get(inners, i), F.get(inners, i + (wide - 1)))
            within = lambda i: F.least(*(F.get(inners, i + j) for j in range(1, wide - 1))) if wide > 3 else F.get(inners, i + 1)
            places = F.filter(F.sequence(F.lit(0), F.size(units) - gram), lambda i: edge(i) <= within(i))
            return F.transform(places, lambda i: F.shiftrightunsigned(F.xxhash64(*(F.get(units, i + j) for j in range(gram))), 32))

        inners = units if inner == 1 else F.transform(F.sequence(F.lit(0), F.size(units) - inner), lambda i: joint(units, i, inner))
        short = F.when(F.size(units) > 0, F.array(F.shiftrightunsigned(F.xxhash64(units), 32))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(units) < gram, short).otherwise(let(inners, chosen))

    return let(F.transform(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), lambda u: F.xxhash64(u)), of)


def sketch(text: Column, size: int = SKETCH) -> Column:
    """The ``size`` least distinct anchors, ascending: a sample that is the same for equal sets of anchors."""
    return F.slice(F.sort_array(F.array_distinct(anchor_hashes(text))), 1, size)


def printed(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: F.lpad(F.lower(F.hex(v)), 8, "0")), "")


def likeness(a: Column, b: Column, size: int = SKETCH) -> Column:
    """Share of anchors in common (twice the common ones by the sum of both), estimated from two sketches.

    Exact when both texts have at most ``size`` anchors together; 1 for two texts without anchors.
    """

    def of(union: Column) -> Column:
        common = F.size(F.array_intersect(F.array_intersect(a, b), union)) / F.size(union)
        return F.when(F.size(union) == 0, 1.0).otherwise(2 * common / (1 + common))

    return let(F.slice(F.sort_array(F.array_union(a, b)), 1, size), of)


def with_next(rows: DataFrame, columns: list[str], cell: int = CELL) -> DataFrame:
    """``rows`` with ``next_<column>`` of the document that follows by ascending ``doc_id``; after the last the first.

    Ids are dealt in ranges of ``cell``; the first document of each range is copied to the range before, so no
    order over all rows is needed. Rows of one id follow each other by the hash of their text; a null id is last.
    """
    cells = rows.groupBy(F.floor(F.col("doc_id") / cell).alias("cell")).agg(F.min("doc_id").alias("first"))
    order = Window.partitionBy().orderBy("cell")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = cells.select("first", F.coalesce(F.lag("cell").over(order), F.max("cell").over(every)).alias("before"))
    # one row per range: broadcast when measured small, so the texts are not dealt out for it
    cells = F.broadcast(cells) if small_enough(cells) else cells
    rows = rows.join(cells, rows["doc_id"] == cells["first"], "left")
    own = F.struct(F.floor(F.col("doc_id") / cell).alias("cell"), F.lit(0).alias("copy"))
    copy = F.struct(F.col("before").alias("cell"), F.lit(1).alias("copy"))
    rows = rows.select("*", F.inline(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, copy))))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    within = Window.partitionBy("cell").orderBy("copy", "doc_id", "tie")
    rows = rows.select("*", *(F.lead(c).over(within).alias(f"next_{c}") for c in columns))
    return rows.where("copy = 0").drop("cell", "copy", "tie", "first", "before")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every document and of its edited text, and how like they are.

    The edited text has its last half replaced by the beginning of the next document. A null text is empty; a table
    of one row is its own next; an empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text.alias("text"))
    rows = with_next(rows.withColumn("own", sketch(F.col("text"))), ["text", "own"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("next_text", half))
    rows = rows.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), n.cast("long").alias("n_chars"), edited.alias("edited"), "own", "next_own")
    rows = rows.select("*", sketch(F.col("edited")).alias("other"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), printed(F.col("own")).alias("fingerprint"),
        printed(F.col("other")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
