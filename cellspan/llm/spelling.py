"""Spelling variants: words one edit apart, found by two-dimensional range reporting in wavelet trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, maybe_broadcast

#: Letters of a word, the fewest code points of a word and the fewest occurrences.
LETTERS, MIN_LENGTH, MIN_COUNT = r"A-Za-zÀ-ÿ", 7, 2

#: One run in so many, told by the checksum of document and run, loses a letter.
DAMAGE = 31

#: A word's form occurs at least so many times as often.
RATIO = 10

#: Words that share the key of a half are looked at together up to this many; larger groups are keyed by more of the word.
GROUP = 16_384

#: Words, and code points, that one set of trees is built over.
CHUNK_ROWS, CHUNK_CELLS = 1 << 15, 1 << 22


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int = DAMAGE) -> DataFrame:
    """``(word)``: every run of letters in the texts, A-Z lower-cased, of ``MIN_LENGTH`` code points or more.

    A run whose checksum (unsigned CRC-32 of ``<id>:<run>`` in UTF-8) is divisible by ``damage`` loses its code point number
    checksum % length; a null id counts as empty. Null and empty texts have no runs.
    """
    found = f"regexp_extract_all({ascii_lower(f'`{text_col}`')}, r'[{LETTERS}]{{{MIN_LENGTH},}}', 0)"
    run = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(F.expr(found)).alias("run"))
    hashed = run.select("run", F.expr("crc32(cast(concat(coalesce(id, ''), ':', run) as binary))").alias("h"))
    cut_at = "cast(h % length(run) as int)"
    word = f"case when h % {damage} = 0 then concat(left(run, {cut_at}), substring(run, {cut_at} + 2)) else run end"
    return hashed.select(F.expr(word).alias("word")).where(F.length("word") >= MIN_LENGTH)


def dictionary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int = DAMAGE) -> DataFrame:
    """``(word, n long)``: the words that occur ``MIN_COUNT`` times or more in all texts."""
    return runs(docs, id_col, text_col, damage).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


def _halved(rows: DataFrame) -> DataFrame:
    """``rows`` with their zone cut in two, and the key of each half.

    A row is a word, seen as one of base length l (it has l letters or one more), and a zone [lo, hi) of edit positions. Two
    words with an edit in the zone agree in the first lo letters, and in the last l - hi ones.
    """
    zones = F.expr("array(named_struct('lo', lo, 'hi', (lo + hi) div 2), named_struct('lo', (lo + hi) div 2, 'hi', hi))")
    out = rows.withColumn("zone", F.explode(zones)).select("word", "n", "l", F.col("zone.lo").cast("int").alias("lo"), F.col("zone.hi").cast("int").alias("hi"))
    return out.withColumn("g", F.expr("xxhash64(l, lo, hi, left(word, lo), right(word, greatest(0, l - hi)))"))


def _zoned(words: DataFrame, group: int) -> DataFrame:
    """``(word, n, l, lo, hi, g)``: words one edit apart meet in exactly one group ``g`` that holds the edit in its zone.

    Groups with more than ``group`` words are halved again, until the zone is one position: then all words of a group agree
    in all but one or two letters, so that its size is bounded by the alphabet.
    """
    base = words.select("word", "n", F.explode(F.expr("array(length(word), length(word) - 1)")).alias("l"))
    rows = _halved(base.select("word", "n", "l", F.lit(0).alias("lo"), (F.col("l") + 1).alias("hi")))
    done = None
    while True:
        large = cut(rows.where("hi - lo > 1").groupBy("g").agg(F.count("*").alias("c")).where(F.col("c") > group).select("g"))
        if large.isEmpty():
            return rows if done is None else done.union(rows)
        large = maybe_broadcast(large)
        settled = rows.join(large, "g", "left_anti").select("word", "n", "l", "lo", "hi", "g")
        done = settled if done is None else done.union(settled)
        rows = _halved(cut(rows.join(large, "g", "left_semi").select("word", "n", "l", "lo", "hi")))


class WaveletTree:
    """A sequence of the numbers 0 to n - 1, each once, level by level; reports the points of many rectangles at once."""

    def __init__(self, values):
        import numpy as np

        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros = []
        for k in reversed(range(self.bits)):
            one = (values >> k) & 1 == 1
            self.zeros.append(np.concatenate(([0], np.cumsum(~one))).astype(np.int32))
            values = np.concatenate((values[~one], values[one]))

    def report(self, x0, x1, y0, y1):
        """``(q, y)``: for every rectangle q of positions [x0, x1) and values [y0, y1), the values of the points in it."""
        import numpy as np

        q = np.flatnonzero((x1 > x0) & (y1 > y0))
        a, b, v = x0[q], x1[q], np.zeros(len(q), np.int64)
        for k, zeros in zip(reversed(range(self.bits)), self.zeros):
            za, zb, n0 = zeros[a], zeros[b], zeros[-1]
            lo, hi, mid = y0[q], y1[q], v + (1 << k)
            left = (zb > za) & (lo < mid) & (hi > v)
            right = (b - zb > a - za) & (lo < mid + (1 << k)) & (hi > mid)
            a, b = np.concatenate((za[left], (a - za + n0)[right])), np.concatenate((zb[left], (b - zb + n0)[right]))
            q, v = np.concatenate((q[left], q[right])), np.concatenate((v[left], mid[right]))
        return q, v


def _ordered(letters, group, n):
    """``(order, common)``: the rows by group and letters, and how many letters each has in common with the one before it
    (-1: another group)."""
    import numpy as np

    keyed = np.concatenate((group[:, None].astype(np.uint32), letters), axis=1)
    order = np.argsort(np.ascontiguousarray(keyed).view(f"<U{keyed.shape[1]}")[:, 0], kind="stable")
    s = keyed[order]
    same = s[1:] == s[:-1]
    common = np.where(same.all(axis=1), keyed.shape[1], same.argmin(axis=1)) - 1
    return order, np.concatenate(([-1], common)) if n else np.zeros(0, np.int64)


class _Side:
    """Intervals of rows that agree in their first letters, as places among the short and among the long rows."""

    def __init__(self, letters, group, long):
        import numpy as np

        n = len(group)
        self.order, self.common = _ordered(letters, group, n)
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        flags = long[self.order]
        self.before = {True: np.concatenate(([0], np.cumsum(flags))), False: np.concatenate(([0], np.cumsum(~flags)))}
        self.rows = {True: self.order[flags], False: self.order[~flags]}

    def interval(self, rows, n_letters, long):
        import numpy as np

        starts = np.flatnonzero(self.common < n_letters)
        run = np.cumsum(self.common < n_letters)[self.place[rows]] - 1
        ends = np.append(starts[1:], len(self.order))
        return self.before[long][starts[run]], self.before[long][ends[run]]


def edits(words, group, l, lo, hi):  # noqa: E741
    """``(a, b)``: indexes of words one edit apart, in both directions, whose edit lies at a position of [lo, hi).

    ``words``: distinct, of l or l + 1 letters. For every position the words that agree with a word of l letters before it
    are an interval in forward order, those that agree after it one in reverse order; the words in both intervals are
    reported by a wavelet tree over the two ranks, one tree for the words of l letters (replacements), one for the longer
    ones (insertions). An insertion into a run of equal letters counts at its first position only.
    """
    import numpy as np

    letters = np.array(words, dtype=f"<U{l + 1}").view(np.uint32).reshape(len(words), l + 1)
    long = np.fromiter((len(w) > l for w in words), bool, len(words))
    reverse = letters[:, ::-1].copy()
    reverse[~long] = np.roll(reverse[~long], -1, axis=1)
    fore, back = _Side(letters, group, long), _Side(reverse, group, long)
    trees = {}
    for kind in (False, True):
        rank = np.empty(len(words), np.int64)
        rank[back.rows[kind]] = np.arange(len(back.rows[kind]))
        trees[kind] = WaveletTree(rank[fore.rows[kind]])
    short = np.flatnonzero(~long)
    found = []
    for p in range(lo, min(hi, l + 1)):
        for kind, after in ((True, l - p), (False, l - p - 1)):
            if after < 0 or not len(back.rows[kind]):
                continue
            x, y = fore.interval(short, p, kind), back.interval(short, after, kind)
            least = 1 if kind else 2  # a word is in its own intervals
            may = np.flatnonzero((x[1] - x[0] >= least) & (y[1] - y[0] >= least))
            q, at = trees[kind].report(x[0][may], x[1][may], y[0][may], y[1][may])
            a, b = short[may[q]], back.rows[kind][at]
            if kind:
                new = np.ones(len(a), bool) if p == 0 else letters[b, p] != letters[a, p - 1]
                found += [(a[new], b[new]), (b[new], a[new])]
            else:
                found.append((a[a != b], b[a != b]))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (list(zip(*found)) or ((), ())))


def _near_batches(rows, cells):
    def best(words, n, group, l, lo, hi):  # noqa: E741
        """For each word with near words here: their number, the largest n, and the first word that has it."""
        import numpy as np
        import pyarrow as pa

        a, b = edits(words, group, l, lo, hi)
        order = np.lexsort((np.array(words, dtype=str)[b] if len(b) else b, -n[b], a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.diff(a, prepend=-1))
        count = np.diff(np.append(first, len(a)))
        arrays = [pa.array([words[i] for i in a[first]], pa.string()), pa.array(count, pa.int64()), pa.array(n[b[first]], pa.int64()), pa.array([words[i] for i in b[first]], pa.string())]
        return pa.RecordBatch.from_arrays(arrays, ["word", "near", "top_n", "top"])

    def run(batches):
        import numpy as np

        held, zone, seen = [], None, (0, 0)  # held: whole groups of one zone, (word, n, number of the group)

        def flush(part):
            words, n, group = ([x[i] for x in part] for i in range(3))
            return best(words, np.array(n, np.int64), np.array(group) - group[0], *zone)

        number, last = 0, None
        for batch in batches:
            for word, n, l, lo, hi, g in zip(*(c.to_pylist() for c in batch.columns)):  # noqa: E741
                if (l, lo, hi, g) != last:
                    full = len(held) >= rows or len(held) * (l + 2) >= cells
                    if held and (zone != (l, lo, hi) or full):
                        if len(held) > 1:
                            yield flush(held)
                        held = []
                    elif held and seen[1] == 1:
                        held.pop()  # a group of one word has no pairs
                    zone, last, number, seen = (l, lo, hi), (l, lo, hi, g), number + 1, (0, 0)
                held.append((word, n, number))
                seen = (number, seen[1] + 1)
        if len(held) > 1:
            yield flush(held)

    return run


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """``(word, n, n_near long, top string, top_n long)`` for every row of ``words (word, n)``, whose words are distinct.

    Two words are near if they differ by one inserted, deleted or replaced code point. ``top`` is the near word of largest n,
    of equal ones the first in code-point order; a word without near ones has ``n_near`` 0 and nulls. Every near pair is
    reported once in each direction, in the one group that holds its edit.
    """
    zoned = _zoned(words, group).repartition("g").sortWithinPartitions("l", "lo", "hi", "g", "word")
    near = zoned.select("word", "n", "l", "lo", "hi", "g").mapInArrow(
        _near_batches(CHUNK_ROWS, CHUNK_CELLS), "word string, near long, top_n long, top string"
    )
    none = F.lit(None)
    own = words.select("word", "n", F.lit(0).cast("long").alias("near"), none.cast("long").alias("top_n"), none.cast("string").alias("top"))
    every = own.unionByName(near.withColumn("n", none.cast("long")))
    first = F.min(F.when(F.col("top").isNotNull(), F.struct((-F.col("top_n")).alias("less"), F.col("top").alias("top"))))
    out = every.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), first.alias("f"))
    return out.select("word", "n", "n_near", F.col("f.top").alias("top"), (-F.col("f.less")).alias("top_n"))


def group_variants(words: DataFrame, ratio: int = RATIO, group: int = GROUP) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every row of ``words (word, n)``.

    The form of a word is its most frequent near word (ties: the first in code-point order), if that occurs ``ratio`` times as
    often at least; else it is null. The root is where the forms lead to, the word itself if it has none. The number of
    occurrences grows with each form, so chains are short; they are followed in doubling steps. Empty table: no rows.
    """
    near = cut(near_words(words, group))
    formed = near.withColumn("form", F.expr(f"case when top_n >= {ratio} * n then top end"))
    ways = cut(formed.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        ahead = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = ways.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        longer = cut(longer)
        ways = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            break
    return formed.join(ways, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", F.expr("case when form is not null then top_n end").alias("form_n")
    )
