"""Substring dedup by hashing lines and the sentences in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, small_batches

#: Pieces tile a text: a line break, or a run up to and with the marks that end a sentence. A passage that was put into
#: the middle of a line shares no whole line with other documents, but its inner sentences; so pieces end at both.
PIECE = r"\n|[^\n.!?…。！？।]+[.!?…。！？।]*|[.!?…。！？।]+"

#: Words of a unit at least; shorter sentences and lines are taken with those after them.
MIN_WORDS = 8

#: Words of a passage at least: units in a row that all occur earlier. Fewer words repeat by chance, as stock sentences do;
#: the cut sentences at the ends of a repeated passage of fifty words leave some thirty.
MIN_RUN = 30

#: Bytes of the batches of texts that a worker is given.
BATCH = 8 << 20


def units(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, h, start, end, at, n_words, d1, d2)``: a unit from each piece that has a word, with code-point offsets.

    A unit is the piece with as few of those after it as make ``min_words`` words; so a passage of short sentences has
    units as well, whatever stands before it. The last pieces of a text that do not make so many words have none. ``at``
    is the number of words before the unit, ``h`` a hash of the whole text, which tells rows of one id apart.
    ``d1, d2`` are the 128 bits of XXH3 over the unit in lower case with its white space collapsed. Offsets are those of
    the original text. Null and empty texts have no units.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession, BATCH)

    def run(batches):
        import re
        from collections import deque

        import pyarrow as pa
        import xxhash

        find, digest = re.compile(PIECE).finditer, xxhash.xxh3_128_digest
        names, types = ["id", "h", "start", "end", "at", "n_words", "d1", "d2"], [pa.int64()] * 7

        def flush(rows):
            ids, *cols = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *map(pa.array, cols, types)], names)

        def of(text):
            held, n, done = deque(), 0, 0  # pieces with words that have not begun a unit yet, and their words
            for m in find(text):
                w = m[0].lower().encode().split()
                if not w:
                    continue
                held.append((m.start(), len(w), b" ".join(w)))
                n += len(w)
                while n >= min_words:
                    d = digest(b" ".join([x for *_, x in held]) if len(held) > 1 else held[0][2])
                    start, k, _ = held.popleft()
                    yield start, m.end(), done, n, int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)
                    n -= k
                    done += k

        for b in batches:
            id_type, rows = b.column(0).type, []
            for key, h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                for u in of(text.as_py() or ""):
                    rows.append((key, h, *u))
                    if len(rows) >= 20_000:
                        yield flush(rows)
                        rows = []
            if rows:
                yield flush(rows)

    flat = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))
    return flat.mapInArrow(run, f"id {kind}, h long, start long, end long, at long, n_words long, d1 long, d2 long")


def repeated_units(
    docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, h, start, end, at, n_words, kept_id, kept_start)``: every unit that occurs earlier, and its first occurrence.

    Occurrences of a digest are ranked by document id (null last), then by text hash and offset; the first one stays. The
    first is a map-side minimum, so a passage of a third of all documents sends one row per task. What repeats is written
    before the join that marks the rest: then both sides of it are plain shuffles, and AQE splits the one with the passage.
    Equal rows count as one document: they keep or lose the same units.
    """
    u = units(docs, min_words, id_col, text_col)
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "h", "start")
    first = cut(
        u.groupBy("d1", "d2")
        .agg(F.min(rank).alias("f"), F.max(rank).alias("l"))
        .where("f <> l")
        .select("d1", "d2", F.col("f.id").alias("kept_id"), F.col("f.h").alias("kept_h"), F.col("f.start").alias("kept_start"))
    ).hint("merge")
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("h") == F.col("kept_h")) & (F.col("start") == F.col("kept_start"))
    found = u.join(first, ["d1", "d2"]).where(~same)
    return found.select("id", "h", "start", "end", "at", "n_words", "kept_id", "kept_start")


def repeated_passages(
    docs: DataFrame, min_run: int = MIN_RUN, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, h, start, end, n_words, n_units, kept_id, kept_start)``: the passages to remove, in original offsets.

    A passage is a run of repeated units that overlap or follow each other, of ``min_run`` words or more together.
    ``kept_id, kept_start``: the occurrence that stays of its first unit. A document's units are at most its sentences.
    """
    by = Window.partitionBy("id", "h").orderBy("at", "n_words")
    reached = F.max(F.col("at") + F.col("n_words")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = repeated_units(docs, min_words, id_col, text_col)
    head = F.when(F.col("at") <= F.col("_reached"), F.lit(0)).otherwise(F.lit(1))
    runs = marked.withColumn("_reached", reached).withColumn("_run", F.sum(head).over(by))
    n = F.max(F.col("at") + F.col("n_words")) - F.min("at")
    return (
        runs.groupBy("id", "h", "_run")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            n.alias("n_words"),
            F.countDistinct("at").alias("n_units"),
            F.min(F.struct("at", "kept_id", "kept_start")).alias("_first"),
        )
        .where(F.col("n_words") >= min_run)
        .select("id", "h", "start", "end", "n_words", "n_units", "_first.kept_id", "_first.kept_start")
    )


def remove_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the ``spans (id, h, start, end, …)``, and ``removed``, an array of them in original offsets.

    ``h`` is the XXH64 of the whole text (as ``units`` gives it). The structs of ``removed`` have ``start``, ``end`` and
    the further columns of ``spans``; a column ``removed`` of ``docs`` is replaced. Spans may overlap. Documents without a
    span keep their text as it is, and an empty list. A document's spans are at most its own units.
    """
    more = [c for c in spans.columns if c not in ("id", "h", "start", "end")]
    w = Window.partitionBy("id", "h").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max("end").over(w), F.lit(0))
    piece = F.when(F.col("start") > F.col("_before"), F.struct(F.col("_before").alias("a"), F.col("start").alias("b")))
    lists = (
        spans.withColumn("_before", before)
        .groupBy(F.col("id").alias("_id"), F.col("h").alias("_h"))
        .agg(
            F.sort_array(F.collect_list(F.struct("start", "end", *more))).alias("removed"),
            F.sort_array(F.collect_list(piece)).alias("_keep"),
            F.max("end").alias("_last"),
        )
    )
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("_h"))
    joined = docs.drop("removed").join(lists, same, "left").drop("_id", "_h")
    pieces = "transform(_keep, k -> substring(t, cast(k.a + 1 as int), cast(k.b - k.a as int)))"
    rest = "concat_ws('', concat(" + pieces + ", array(substring(t, cast(_last + 1 as int)))))"
    cut_out = f"if(removed is null or `{text_col}` is null, `{text_col}`, transform(array(`{text_col}`), t -> {rest})[0])"
    none = F.expr("array()").cast(lists.schema["removed"].dataType)
    out = joined.withColumn(text_col, F.expr(cut_out)).withColumn("removed", F.coalesce("removed", none))
    return out.drop("_keep", "_last")
