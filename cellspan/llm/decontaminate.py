"""Benchmark decontamination: windows of item words in documents, by a prefix-filtered set join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, cut, maybe_broadcast

#: Characters between words, words of a window and words of a shingle.
BETWEEN, WINDOW, SHINGLE = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", 10, 3

#: Passages of items are broadcast up to this many and so many bytes of words; beyond, positions of documents are shuffled.
MAX_PASSAGES, MAX_BYTES = 200_000, 64 << 20


def words(text: str) -> str:
    """SQL for the array of lower-cased words of a text column (null: no words)."""
    return f"array_remove(split(coalesce({ascii_lower(text)}, ''), r'{BETWEEN}'), '')"


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``(text_hash, start int, w array<string>, words array<string>, item_id string)``: the windows of every item.

    An item of fewer than ``window`` words is one window; one without words has none. ``words`` are those of the item.
    """
    split = items.select(F.col(id_col).cast("string").alias("item_id"), F.xxhash64(text_col).alias("text_hash"), F.expr(words(f"`{text_col}`")).alias("words"))
    starts = f"sequence(0, greatest(0, size(words) - {window}))"
    at = split.where("size(words) > 0").select("*", F.explode(F.expr(starts)).alias("start"))
    return at.select("text_hash", "start", F.expr(f"slice(words, start + 1, {window})").alias("w"), "words", "item_id")


def _shingles(df: DataFrame, array: str, size: int, *keep: str) -> DataFrame:
    """``df`` exploded into the shingles of an array of words: position ``i`` and hash ``h``."""
    # A condition in the generator and not a filter, for a filter would make Spark split the text twice.
    at = df.select(*keep, array, F.explode(F.expr(f"case when size({array}) >= {size} then sequence(0, size({array}) - {size}) end")).alias("i"))
    return at.select("*", F.xxhash64(F.lit(size), *[F.expr(f"{array}[i + {k}]") for k in range(size)]).alias("h"))


def passages(items: DataFrame, docs_words: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """``(passages, members)``: what of the items is looked for, each at its rarest shingle.

    A window is contained only as a whole, so of its shingles, in order of rarity in all of ``docs_words (w)`` and of hash, the prefix that
    a join needs is the first one. Equal windows of all items are one; neighbouring ones of a text that have their rarest
    shingle in common, and occur in the same items, are one passage ``(h, size, w, at, need, set)``: its words, the place of
    the shingle in them and the words of a window; ``h`` hashes the ``size`` words of the shingle (fewer than ``shingle`` only
    in shorter items). ``members``: ``(set, item_id)``.
    """
    every = cut(items)
    content = F.array_join("w", " ")
    named = every.where("item_id is not null").groupBy(content.alias("content"), "item_id").agg(F.lit(1).alias("one"))
    signed = named.groupBy("content").agg(
        F.sum(F.xxhash64("item_id").cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64(F.lit(7), "item_id")).alias("b"), F.count("*").alias("c")
    )
    sets = cut(signed.select("content", F.xxhash64("a", "b", "c").alias("set")))
    first = every.groupBy(content.alias("content")).agg(F.min(F.struct("text_hash", "start", "w")).alias("f"))
    distinct = cut(first.join(sets, "content", "left").select("f.*", F.size("f.w").alias("need"), F.coalesce("set", F.lit(0)).alias("set")))
    members = named.join(sets, "content").select("set", "item_id").distinct()
    sizes = [r["s"] for r in distinct.select(F.least("need", F.lit(shingle)).alias("s")).distinct().collect()]
    chosen = None
    for size in sizes:
        own = _shingles(distinct.where(f"least(need, {shingle}) = {size}"), "w", size, "text_hash", "start", "need", "set")
        wanted = own.select("h").distinct()
        counts = _shingles(docs_words, "w", size).select("h").join(maybe_broadcast(wanted, MAX_PASSAGES), "h", "left_semi").groupBy("h").agg(F.count("*").alias("c"))
        # A window one of whose shingles is in no document occurs in none.
        known = own.join(maybe_broadcast(cut(counts), MAX_PASSAGES), "h").groupBy("text_hash", "start", "need", "set").agg(
            F.count("*").alias("n"), F.min(F.struct("c", "h", "i")).alias("r"), F.first("w").alias("w")
        )
        rare = known.where(f"n = need - {size} + 1").select(
            "text_hash", "start", "need", "set", "w", F.lit(size).alias("size"), (F.col("start") + F.col("r.i")).alias("q"), F.col("r.h").alias("h")
        )
        chosen = rare if chosen is None else chosen.union(rare)
    if chosen is None:
        empty = items.sparkSession.createDataFrame([], "h long, size int, w array<string>, at int, need int, set long")
        return empty, members
    # Windows of one text with one rarest shingle; they follow one another, but for those that are another set's.
    parts = chosen.groupBy("text_hash", "q", "h", "size", "need", "set").agg(F.sort_array(F.collect_list(F.struct("start", "w"))).alias("s"))
    runs = F.expr(
        "aggregate(s, cast(array() as array<struct<start: int, end: int, w: array<string>>>), (a, x) ->"
        " case when size(a) > 0 and element_at(a, -1).end = x.start then concat(slice(a, 1, size(a) - 1), array(named_struct("
        "'start', element_at(a, -1).start, 'end', x.start + 1, 'w', concat(element_at(a, -1).w, slice(x.w, -1, 1)))))"
        " else concat(a, array(named_struct('start', x.start, 'end', x.start + 1, 'w', x.w))) end)"
    )
    out = parts.select("h", "size", "need", "set", "q", F.explode(runs).alias("p"))
    return cut(out.select("h", "size", "p.w", (F.col("q") - F.col("p.start")).alias("at"), "need", "set").distinct()), members


#: The words of a document (d, i) that lie over those of a passage (w, at); fewer where the document begins or ends.
_AROUND = "slice(d, greatest(1, i - at + 1), least(size(d), i - at + size(w)) - greatest(0, i - at))"

#: Whether they agree, by place in the passage.
_SAME = "transform(w, (x, k) -> coalesce(get(around, k - greatest(0, at - i)) = x, false))"


def occurrences(docs_words: DataFrame, wanted: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` and ``(start, end, set)``: where words of ``docs_words (w)`` agree with a passage over a window or more.

    Candidates are the places of its rarest shingle. By position and length, ``need`` words of passage and document must
    lie around it; then the words are compared, outward from the shingle.
    """
    out = None
    sizes = [r["size"] for r in wanted.select("size").distinct().collect()]
    for size in sizes:
        listed = wanted.where(f"size = {size}").drop("size")
        docs = docs_words.withColumnRenamed("w", "d")
        bound = "least(i, at) + least(size(d) - i, size(w) - at) >= need"
        n, size_of = listed.agg(F.count("*"), F.sum(F.octet_length(F.array_join("w", " ")))).first()
        columns = [*keep, "i", "at", "w", "need", "set"]
        if n <= MAX_PASSAGES and (size_of or 0) <= MAX_BYTES:
            met = _shingles(docs, "d", size, *keep).join(F.broadcast(listed), "h")
        else:
            # Too many passages: positions meet them in a shuffle without their texts, which follow by row afterwards.
            placed = _shingles(docs, "d", size, *keep).select(*keep, "i", "h").join(listed, "h")
            met = placed.join(docs, [placed[k].eqNullSafe(docs[k]) for k in keep]).select(*[placed[c] for c in columns], "d")
        # The few words around a candidate are written before they are compared: a comparison inside of the join would
        # keep Spark from compiling it, and make it copy all words of a document for each of its places.
        found = cut(met.where(bound).select(*columns, F.expr(_AROUND).alias("around")))
        agree = found.withColumn("same", F.expr(_SAME))
        before = "coalesce(nullif(array_position(reverse(slice(same, 1, at)), false), 0) - 1, at)"
        after = "coalesce(nullif(array_position(slice(same, at + 1, size(same)), false), 0) - 1, size(same) - at)"
        spans = agree.withColumns({"before": F.expr(before), "after": F.expr(after)}).where("before + after >= need")
        rows = spans.select(*keep, F.expr("cast(i - before as int)").alias("start"), F.expr("cast(i + after as int)").alias("end"), "set")
        out = rows if out is None else out.union(rows)
    return out


def contaminated_words(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """``(id, n_words, n_hit, spans array<struct<start, end>>, item_ids array<string>)`` for every document.

    A window is ``window`` consecutive words of an item, or all words of a shorter one. ``spans``: the words of the document
    inside occurrences of windows, in order, as [start, end) of word numbers; ``item_ids``: the items with a window that
    occurs, sorted as strings. Null texts have no words. An item with a null id counts for words but is not listed; items of
    one id are one item. Rows that repeat a document's id and text are judged each. No items: no words are hit. The work
    on a row grows with its words; nothing is capped.
    """
    split = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_t"))
    keyed = split.select("id", F.xxhash64("_t").alias("key"), F.expr(words("_t")).alias("w"))
    wanted, members = passages(windows(items, item_id_col, item_text_col, window), keyed.select("w"), window)
    counted = keyed.select("id", "key", F.size("w").cast("long").alias("n_words"))
    found = occurrences(keyed, wanted, ("id", "key"))
    if found is None:
        empty = ("0L as n_hit", "cast(array() as array<struct<start: int, end: int>>) as spans", "cast(array() as array<string>) as item_ids")
        return counted.selectExpr("id", "n_words", *empty)
    found = cut(found.distinct())
    # Spans of one document that touch are one; a window over its rows sees one document at a time and can spill.
    of_key = Window.partitionBy("id", "key").orderBy("start", "end")
    reached = F.max("end").over(of_key.rowsBetween(Window.unboundedPreceding, -1))
    islands = found.withColumn("opens", F.coalesce(F.col("start") > reached, F.lit(True)).cast("int"))
    islands = islands.withColumn("island", F.sum("opens").over(of_key.rowsBetween(Window.unboundedPreceding, 0)))
    whole = islands.groupBy("id", "key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = whole.groupBy("id", "key").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"), F.sum(F.col("end") - F.col("start")).alias("n_hit")
    )
    of_doc = found.select("id", "key", "set").distinct().join(members, "set").groupBy("id", "key").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    same = lambda a, b: [a["id"].eqNullSafe(b["id"]), a["key"] == b["key"]]
    hit = spans.join(of_doc, same(spans, of_doc), "left").select(spans["id"], spans["key"], "spans", "n_hit", "item_ids")
    hit = maybe_broadcast(cut(hit), 20_000)
    joined = counted.join(hit, same(counted, hit), "left")
    return joined.select(
        counted["id"], "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.expr("coalesce(spans, array()) as spans"), F.expr("coalesce(item_ids, array()) as item_ids"),
    )
