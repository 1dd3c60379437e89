"""Vector codes: parts of vectors as indexes into codebooks, trained by exact integer rounds with Exponion search."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ensure_checkpoint_dir, maybe_broadcast, remove

#: Parts of a vector, entries of a codebook, rounds of training and the factor of the integer components.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096

#: Rows of one piece of work in a task; products of larger numbers than LARGE / width are taken without 64-bit limits.
PIECE, LARGE = 8192, 1 << 62


def _integers(column, width, scale):
    """floor(scale * x) of the vectors of an Arrow column, zeros after their ends: int64, or Python integers if those are large."""
    import math

    import numpy as np

    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    offsets = column.offsets.to_numpy()
    flat = flat[offsets[0] : offsets[-1]]
    lengths = np.diff(offsets)
    at = np.repeat(np.arange(len(column)), lengths), np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], lengths)
    if len(flat) and np.abs(flat).max() * scale >= 2**50:
        numbers = [math.floor(x * scale) if abs(x) < 2**60 else int(x) * scale for x in flat.tolist()]
        out = np.zeros((len(column), width), dtype=object)
        out[at] = np.array(numbers, dtype=object)
        return out
    out = np.zeros((len(column), width), dtype=np.int64)
    out[at] = np.floor(flat * scale).astype(np.int64)
    return out


def _wide(*arrays):
    """The arrays as Python integers, if squared distances between them could pass 64 bits."""
    import numpy as np

    if any(a.dtype == object for a in arrays) or 8 * max(a.shape[-1] for a in arrays) * max(int(np.abs(a).max(initial=0)) for a in arrays) ** 2 >= LARGE:
        return tuple(a.astype(object) for a in arrays)
    return arrays


class Exponion:
    """Nearest entries of one codebook (rows of integers), searched from a previous entry.

    Every entry has the list of the others by distance. A point at squared distance d from its previous entry e can have no
    entry nearer, or as near, that is further than 2 * sqrt(d) from e, for that entry is within sqrt(d) of the point. So the
    list of e is read as far as squared distances of 4 * d, all in integers; of equal distances the lower index wins.
    """

    def __init__(self, entries):
        import numpy as np

        self.entries = entries
        (c,) = _wide(entries)
        apart = ((c[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
        index = np.arange(len(c))
        self.neighbours = [sorted((apart[e, j], j) for j in index if j != e) for e in index]

    def nearest(self, points, previous):
        """``(index, squared distance)`` of the nearest entry of every point."""
        import numpy as np

        x, c = _wide(points, self.entries)
        away = lambda rows, e: ((x[rows] - c[e]) ** 2).sum(axis=1)
        best, least = previous.astype(np.int64), np.zeros(len(x), dtype=x.dtype)
        for e in np.unique(previous):
            rows = np.flatnonzero(previous == e)
            start = away(rows, e)
            least[rows] = start
            rows = rows[np.argsort(start, kind="stable")]
            reach = 4 * np.sort(start)
            for distance, j in self.neighbours[e]:
                inside = rows[np.searchsorted(reach, distance) :]
                if not len(inside):
                    break
                d = away(inside, j)
                better = (d < least[inside]) | ((d == least[inside]) & (j < best[inside]))
                best[inside[better]], least[inside[better]] = j, d[better]
        return best, least


def _assigned(column, codes, books, scale):
    """Integer components, codes (rows x parts) and errors of a batch."""
    import numpy as np

    width = len(books) * books[0].shape[1]
    x = _integers(column, width, scale)
    old = np.frombuffer(b"".join(codes), np.uint8).reshape(len(x), len(books)) if codes else np.zeros((len(x), len(books)), np.uint8)
    new, error = np.empty(old.shape, np.uint8), np.zeros(len(x), dtype=object)
    for p, book in enumerate(books):
        part = x[:, p * book.shape[1] : (p + 1) * book.shape[1]]
        new[:, p], d = Exponion(book).nearest(part, old[:, p])
        error += d.astype(object)
    return x, new, error


def _round_batches(books, scale, first):
    """Rows with their new codes; then, for each entry of each part, number and sums of its parts in this task."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["id", "label", "v", "code", "part", "entry", "n", "sums"]
        step, schema = books[0].shape[1], None
        n = np.zeros((len(books), len(books[0])), np.int64)
        sums = np.zeros((len(books), len(books[0]), step), dtype=object)
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                b = batch.slice(at, PIECE)
                x, new, _ = _assigned(b.column(2), None if first else b.column(3).to_pylist(), books, scale)
                for p in range(len(books)):
                    for e in np.unique(new[:, p]):
                        rows = new[:, p] == e
                        n[p, e] += int(rows.sum())
                        sums[p, e] += x[rows, p * step : (p + 1) * step].sum(axis=0).astype(object)
                none = [pa.nulls(b.num_rows, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()))]
                arrays = [b.column(0), b.column(1), b.column(2), pa.array([c.tobytes() for c in new], pa.binary()), *none]
                out = pa.RecordBatch.from_arrays(arrays, names)
                schema = out.schema
                yield out
        if schema is None:
            return
        at = np.argwhere(n > 0)
        arrays = [pa.nulls(len(at), t) for t in schema.types[:4]]
        arrays += [pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(n[at[:, 0], at[:, 1]], pa.int64())]
        arrays.append(pa.array([[str(s) for s in sums[p, e]] for p, e in at], pa.list_(pa.string())))
        yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def _code_batches(books, scale, first):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                b = batch.slice(at, PIECE)
                _, new, error = _assigned(b.column(2), None if first else b.column(3).to_pylist(), books, scale)
                clipped = [min(int(e), (1 << 63) - 1) for e in error]
                arrays = [b.column(0), b.column(1), pa.array([c.tobytes().hex() for c in new], pa.string()), pa.array(clipped, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "label", "code", "error"])

    return run


def _total(frame):
    """Sums of the sums that tasks have made of one entry; they can pass 64 bits."""
    import pandas as pd

    total = [str(sum(map(int, x))) for x in zip(*frame["sums"])]
    return pd.DataFrame({"part": [frame["part"].iloc[0]], "entry": [frame["entry"].iloc[0]], "n": [frame["n"].sum()], "sums": [total]})


def _as_integers(rows):
    """Lists of integers as a matrix, in 64 bits where they fit well."""
    import numpy as np

    out = np.array(rows, dtype=object)
    return out.astype(np.int64) if all(abs(x) < 1 << 53 for row in rows for x in row) else out


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, list]:
    """``(codes, codebooks)``: ``(id, label, code string, error long, label_error long)`` for every vector kept, and the final
    codebooks, one list of entries (lists of integers) for each part.

    Vectors that are null or hold a null or non-finite component are left out. A component x is floor(scale * x); a vector is
    cut into ``parts`` equal parts (zeros after the end of shorter vectors, up to the longest one's length and a multiple of
    ``parts``). Codebooks start as the parts of the ``entries`` (at most 256) vectors of smallest id; null ids come last, vectors of one id in
    their order; if there are fewer vectors, there are fewer entries. Each round assigns every part to the nearest entry
    (exact squared distance, ties to the lower index) and replaces the entries by the floor of the mean of their parts; unused
    ones stay. The state of a round, vectors with their codes, is written to the shared folder, where the next round starts
    each search at the entry before; tasks add up their parts, so that a round sends entries x parts rows a task. Errors are
    clipped to 64 bits. An empty table gives no rows and no codebooks. Repeated rows stay.
    """
    spark = vectors.sparkSession
    v = f"`{vec_col}`"
    fine = f"{v} is not null and forall({v}, x -> coalesce(abs(cast(x as double)) < double('inf'), false))"
    kept = vectors.where(fine).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v"))
    if kept.schema["v"].dataType.simpleString() != "array<float>":
        kept = kept.withColumn("v", F.col("v").cast("array<double>"))
    kind, label, vector = (kept.schema[c].dataType.simpleString() for c in ("id", "label", "v"))
    longest = kept.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return kept.selectExpr("id", "label", "'' as code", "0L as error", "0L as label_error"), []
    width = max(1, -(-longest // parts))
    start = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    rows = [[_floor(x, scale) for x in r["v"]] + [0] * (parts * width - len(r["v"])) for r in start]
    books = [_as_integers([r[p * width : (p + 1) * width] for r in rows]) for p in range(parts)]
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/codebooks-{uuid.uuid4().hex}"
    schema = f"id {kind}, label {label}, v {vector}, code binary, part int, entry int, n long, sums array<string>"
    state = kept
    for i in range(rounds):
        state.mapInArrow(_round_batches(books, scale, i == 0), schema).write.parquet(f"{folder}/{i}")
        if i:
            remove(spark, f"{folder}/{i - 1}")
        done = spark.read.parquet(f"{folder}/{i}")
        sums = done.where("part is not null").select("part", "entry", "n", "sums")
        for r in sums.groupBy("part", "entry").applyInPandas(_total, "part int, entry int, n long, sums array<string>").collect():
            book = [list(map(int, e)) for e in books[r["part"]]]
            book[r["entry"]] = [int(s) // r["n"] for s in r["sums"]]
            books[r["part"]] = _as_integers(book)
        state = done.where("part is null").select("id", "label", "v", "code")
    codes = cut(state.mapInArrow(_code_batches(books, scale, not rounds), f"id {kind}, label {label}, code string, error long"))
    remove(spark, folder)
    whole = f"least({(1 << 63) - 1}, sum(cast(error as decimal(38,0))))"
    by_label = maybe_broadcast(codes.groupBy("label").agg(F.expr(f"cast({whole} as long)").alias("label_error")).withColumnRenamed("label", "_label"))
    out = codes.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    return out, [[list(map(int, e)) for e in b] for b in books]


def _floor(x: float, scale: int) -> int:
    import math

    return math.floor(x * scale) if abs(x) < 2**60 else int(x) * scale


def digest(books: list) -> str:
    """SHA-256 of all components of codebooks, in decimal, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
