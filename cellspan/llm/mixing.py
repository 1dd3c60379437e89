"""Mixing sources to target weights by cube-method balanced sampling."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fits_broadcast, ordinal, words

#: Documents of one flight block. Each block leaves at most two undecided, which are pooled into the next round's blocks.
BLOCK = 4096


def source_targets(sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``(source, stratum, n_docs, source_size, target double)``: ``share`` times all sizes, dealt by weight.

    ``weights`` repeat over the sources in code-point order, null last. A target stops at ``most`` times its source's
    size; the excess is dealt by weight among the others until none is above. Each round is one aggregation over the
    sources; only its sums reach the driver.
    """
    by = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    w = F.array(*[F.lit(float(x)) for x in weights])
    s = cut(ordinal(by, "source", "stratum").withColumn("w", w[(F.col("stratum") % len(weights)).cast("int")]))
    level, total = 0.0, (s.agg(F.sum("source_size")).first()[0] or 0)
    while total:
        full = F.col("source_size") * most < F.lit(level) * F.col("w")
        r = s.agg(
            F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0)),
        ).first()
        new = (share * total - most * r[0]) / r[1] if r[1] else level
        if new <= level:
            break
        level = new
    return s.withColumn("target", F.least(F.col("source_size") * float(most), F.lit(level) * F.col("w"))).drop("w")


def flight(p: list[float], size: list[float], seed: int = 0) -> list[float]:
    """Flight phase of the cube method: walk ``p`` to the faces of the unit cube, keeping sum(p) and sum(p * size).

    Three undecided units span a null space of the two constraints; a step along it, as far as the cube allows, decides
    at least one. Which way is drawn so that the expected ``p`` does not move; ``seed`` fixes the draws. At most two
    units stay undecided.
    """
    draw = random.Random(seed).random
    p = list(p)
    live = [i for i, x in enumerate(p) if 0.0 < x < 1.0]
    live.reverse()
    held = [live.pop() for _ in range(min(3, len(live)))]
    while len(held) == 3:
        i, j, k = held
        u = (size[k] - size[j], size[i] - size[k], size[j] - size[i])
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = min((1.0 - p[h]) / v if v > 0 else p[h] / -v for h, v in zip(held, u) if v)
        down = min(p[h] / v if v > 0 else (1.0 - p[h]) / -v for h, v in zip(held, u) if v)
        step = up if draw() * (up + down) < down else -down
        kept = []
        for h, v in zip(held, u):
            x = p[h] + step * v
            p[h] = 0.0 if x < 1e-9 else 1.0 if x > 1.0 - 1e-9 else x
            if 0.0 < p[h] < 1.0:
                kept.append(h)
        if len(kept) == 3:  # rounding hid the face that the step reached: take the nearest
            h = min(kept, key=lambda h: min(p[h], 1.0 - p[h]))
            p[h] = float(p[h] > 0.5)
            kept.remove(h)
        held = kept
        while len(held) < 3 and live:
            held.append(live.pop())
    return p


def land(p: list[float], size: list[float]) -> list[float]:
    """Landing phase: decide the last two units or fewer by the rounding nearest to the total size, then to the count."""
    open_ = [i for i, x in enumerate(p) if 0.0 < x < 1.0]
    if not open_:
        return p
    want, n = sum(p[i] * size[i] for i in open_), sum(p[i] for i in open_)
    best = min(
        range(1 << len(open_)),
        key=lambda m: (
            abs(sum(size[i] for b, i in enumerate(open_) if m >> b & 1) - want),
            abs(bin(m).count("1") - n),
            m,
        ),
    )
    p = list(p)
    for b, i in enumerate(open_):
        p[i] = float(best >> b & 1)
    return p


def balanced_sample(units: DataFrame, block: int = BLOCK) -> DataFrame:
    """Decide ``units (stratum long, key long, h long, size long, p double)`` by balanced sampling; returns ``p`` 0 or 1.

    ``h`` tells units of one key apart; it may be left out.

    Each stratum keeps its expected count and total size. Strata are cut into hash blocks of about ``block`` units that
    fly on their own; what stays undecided (two a block at most) is pooled, again in blocks, until a stratum's rest fits
    one block, where it flies and lands. So no group grows with the data. Units are ordered by a hash of their key.
    """

    def run(last: bool):
        def fly(pdf):
            pdf = pdf.sort_values(["_h", "key", "h", "size", "p"], kind="stable")
            p = flight(pdf["p"].tolist(), pdf["size"].astype("float64").tolist(), int(pdf["_h"].iloc[0]))
            if last:
                p = land(p, pdf["size"].astype("float64").tolist())
            return pdf.assign(p=p)[["stratum", "key", "h", "size", "p"]]

        return fly

    schema = "stratum long, key long, h long, size long, p double"
    units = units if "h" in units.columns else units.withColumn("h", F.lit(0).cast("long"))
    done, left, level = [], units.select("stratum", "key", "h", "size", "p"), 0
    counts = left.groupBy("stratum").agg(F.count("*").alias("_n"))
    while True:
        counts = cut(counts.withColumn("_blocks", F.ceil(F.col("_n") / block)))
        most = counts.agg(F.max("_blocks")).first()[0]
        small = F.broadcast(counts) if fits_broadcast(counts, 100_000) else counts
        hashed = left.withColumn("_h", F.xxhash64(F.lit(level), F.coalesce("key", F.lit(-1)), "h", "size"))
        dealt = hashed.join(small, "stratum").withColumn("_b", F.pmod("_h", F.col("_blocks")))
        flown = dealt.drop("_n", "_blocks").groupBy("stratum", "_b").applyInPandas(run((most or 1) <= 1), schema)
        if (most or 1) <= 1:
            done.append(flown)
            break
        flown = cut(flown)
        done.append(flown.where("p in (0, 1)"))
        left = flown.where("p not in (0, 1)")
        counts = left.groupBy("stratum").agg(F.count("*").alias("_n"))
        level += 1
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block: int = BLOCK,
) -> DataFrame:
    """``(doc_id, text_hash, size, source, source_size, target, copies, taken)`` for every row of ``docs``.

    A document is taken ``floor(target / source_size)`` times, and once more if the balanced sample picks it; so its
    expected share is the same throughout its source, and each source's total of words and of documents comes within a
    document or two of its target. Size is the number of words (null text: 0). Equal rows are separate units; ``text_hash`` (XXH64)
    tells rows of one id, or of none, apart. The choice depends on ids and texts only, so reruns agree. A source of size zero has target zero; an empty table gives no rows.
    """
    sized = cut(
        docs.select(
            F.col(id_col).cast("long").alias("key"),
            F.xxhash64(text_col).alias("h"),
            F.expr(f"cast(size({words(f'`{text_col}`')}) as bigint)").alias("size"),
            F.col(source_col).cast("string").alias("source"),
        )
    )
    targets = cut(
        source_targets(sized, weights, share, most)
        .withColumn("_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    )
    few = F.broadcast(targets) if fits_broadcast(targets, 100_000) else targets
    named = sized.join(few, sized["source"].eqNullSafe(few["source"])).select(
        "key", "h", "size", "stratum", (F.col("_rate") - F.floor("_rate")).alias("p")
    )
    picked = balanced_sample(named, block)
    by = targets.select("stratum", "source", "source_size", "target", "_rate")
    by = F.broadcast(by) if fits_broadcast(by, 100_000) else by
    copies = (F.floor("_rate") + F.col("p")).cast("long")
    return picked.join(by, "stratum").select(
        F.col("key").alias("doc_id"),
        F.col("h").alias("text_hash"),
        "size",
        "source",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )
