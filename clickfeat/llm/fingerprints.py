"""SimHash fingerprints of 128 bits and a search within a Hamming radius, in DataFrame functions only.

Terms are pairs of neighbouring lower-cased words (a lone word is its own term).  Each occurrence votes with a
weight of 1 to 3: one, and one more for each of its words longer than three signs.  Bit j is set if the terms whose
hash has bit j weigh more than half.  Votes of two bits share one 64-bit sum (32 bits each), so 64 sums per text
are pre-aggregated before anything is shuffled, and a text of up to 10**9 terms cannot overflow.

The search cuts a fingerprint into 8 blocks of 16 bits.  Two fingerprints at most 6 bits apart agree in at least two
blocks, so 28 tables, one per pair of blocks, with the two blocks moved to the front as a 32-bit key, find all of
them.  The join itself checks the distance, and only the first table in which a pair agrees may report it.

Neighbours in id order come from ranges of ids: bounds are a sketch's quantiles, one per range, and the first row of
a range is also sent to the range before it, so that each text is shuffled once.

Defined cases: null text is empty and has fingerprint 0; rows with a null id come first in id order; rows that repeat
an id are ordered by a hash of their text; a single row follows itself; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickfeat.llm.common import kept


RADIUS = 6
BLOCKS = 8
WHITE = "[\\x20\\x09-\\x0D]+"
RANGES_PER_PARTITION = 4
NULL_ID = -(1 << 63)


def terms(text: Column) -> Column:
    """One long per term: its hash with the weight (0 to 2, one less) in the lowest two bits."""
    words = F.filter(F.split(F.lower(text), WHITE), lambda w: w != "")

    def packed(hashed: Column, weight: Column) -> Column:
        return hashed.bitwiseAND(F.lit(~3)).bitwiseOR(weight.cast("long"))

    def heavy(word: Column) -> Column:
        return (F.length(word) > 3).cast("int")

    # zip_with pads the shifted list with one null, and a pair with a null has no next word: it is dropped.
    pairs = F.filter(
        F.zip_with(
            words,
            F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
            lambda a, b: F.when(b.isNotNull(), packed(F.xxhash64(a, b), heavy(a) + heavy(b))),
        ),
        lambda p: p.isNotNull(),
    )
    lone = F.transform(words, lambda w: packed(F.xxhash64(w), heavy(w)))
    return F.when(F.size(words) == 1, lone).otherwise(pairs)


def simhash(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys``, h1, h2: the fingerprint of each row's text; ``keys`` identify a row."""
    listed = df.select(*keys, terms(F.col(text_col)).alias("__terms"))
    some = F.when(F.size("__terms") == 0, F.array(F.lit(None).cast("long"))).otherwise(F.col("__terms"))
    each = listed.select(*keys, F.explode(some).alias("__t"))
    weight = F.col("__t").bitwiseAND(F.lit(3)) + 1
    each = each.select(
        *keys, weight.alias("__w"), F.xxhash64("__t").alias("__a"), F.xxhash64("__t", F.lit(1)).alias("__b")
    ).withColumns({"__a": F.when(F.col("__w").isNotNull(), F.col("__a")), "__b": F.when(F.col("__w").isNotNull(), F.col("__b"))})
    lanes = F.lit((1 << 32) | 1)
    votes = [
        F.sum(F.shiftrightunsigned(h, j).bitwiseAND(lanes) * F.col("__w")).alias(f"{h}{j}")
        for h in ("__a", "__b")
        for j in range(32)
    ]
    summed = each.groupBy(*keys).agg(F.sum("__w").alias("__all"), *votes)

    def assembled(h: str) -> Column:
        out = F.lit(0).cast("long")
        for j in range(32):
            for lane, bit in ((F.col(f"{h}{j}").bitwiseAND(F.lit(0xFFFFFFFF)), j), (F.shiftrightunsigned(f"{h}{j}", 32), j + 32)):
                mask = 1 << bit
                out = out.bitwiseOR(F.when(lane * 2 > F.col("__all"), F.lit(mask - (1 << 64) if bit == 63 else mask)).otherwise(F.lit(0)))
        return out

    return summed.select(*keys, assembled("__a").alias("h1"), assembled("__b").alias("h2"))


def as_text(h1: Column, h2: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(h1), 16, "0"), F.lpad(F.hex(h2), 16, "0")))


def distance(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2))


def likeness(bits: Column) -> Column:
    """Cosine similarity of the term vectors that a Hamming distance of 128 bits stands for; 0 to 1."""
    return F.when(bits == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.cos(F.lit(math.pi) * bits / 128)))


def id_bounds(df: DataFrame, key: str) -> list[int]:
    """First keys of ranges of about equal row count, ascending; one per range, whatever the table's size."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * RANGES_PER_PARTITION
    probs = [i / parts for i in range(1, parts)]
    row = df.agg(F.min(key).alias("lo"), F.percentile_approx(key, probs, max(10_000, 10 * parts)).alias("q")).first()
    return [] if row["lo"] is None else sorted({row["lo"], *row["q"]})


def with_next(df: DataFrame, key: str, tie: str, bounds: list[int], following: dict[str, str]) -> DataFrame:
    """Add columns of the next row in order of (key, tie), of the first row for the last one; also ``__range`` and
    ``__row``, which together name the row.  ``following`` maps new names to columns."""
    step = max(1, math.isqrt(len(bounds)))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*[F.lit(b[0]).cast("long") for b in blocks])
    lists = F.array(*[F.array(*[F.lit(v).cast("long") for v in b]) for b in blocks])
    block = F.size(F.filter(heads, lambda h: h <= F.col(key)))
    inside = F.size(F.filter(F.element_at(lists, block), lambda h: h <= F.col(key)))
    placed = df.withColumn("__block", block).withColumn("__range", (F.col("__block") - 1) * step + inside - 1)
    first = F.element_at(F.element_at(lists, F.col("__block")), inside) == F.col(key)
    own = F.struct(F.col("__range").alias("r"), F.lit(False).alias("guest"))
    guest = F.struct(F.pmod(F.col("__range") - 1, F.lit(len(bounds))).alias("r"), F.lit(True).alias("guest"))
    sent = placed.select(*df.columns, F.explode(F.when(first, F.array(own, guest)).otherwise(F.array(own))).alias("__to"))
    sent = sent.select(*df.columns, F.col("__to.r").alias("__range"), F.col("__to.guest").alias("__guest"))
    w = Window.partitionBy("__range").orderBy("__guest", key, tie)
    found = sent.select(
        "*", F.row_number().over(w).alias("__row"), *[F.lead(c).over(w).alias(name) for name, c in following.items()]
    )
    return found.filter(~F.col("__guest")).drop("__guest")


def within_radius(queries: DataFrame, fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs (q1, q2, h1, h2) of a query fingerprint and a fingerprint at most ``radius`` bits apart.

    Both tables have h1 and h2 and should be distinct; ``radius`` is at most 6.
    """
    if not 0 <= radius <= BLOCKS - 2:
        raise ValueError(f"two of {BLOCKS} blocks agree only within {BLOCKS - 2} bits")
    tables = [(i, j) for i in range(BLOCKS) for j in range(i + 1, BLOCKS)]

    def block(i: int) -> Column:
        return F.shiftrightunsigned("h1" if i < 4 else "h2", 16 * (3 - i % 4)).bitwiseAND(F.lit(0xFFFF))

    def permuted(df: DataFrame) -> DataFrame:
        rows = [
            F.struct(F.lit(t).alias("t"), F.shiftleft(block(i), 16).bitwiseOR(block(j)).alias("front"))
            for t, (i, j) in enumerate(tables)
        ]
        return df.select("h1", "h2", F.explode(F.array(*rows)).alias("x")).select("h1", "h2", "x.t", "x.front")

    a = permuted(queries).select(F.col("h1").alias("q1"), F.col("h2").alias("q2"), "t", "front")
    b = permuted(fingerprints)
    x1, x2 = F.col("q1").bitwiseXOR(F.col("h1")), F.col("q2").bitwiseXOR(F.col("h2"))
    agree = F.lit(0)
    for i in range(BLOCKS):
        part = F.shiftrightunsigned(x1 if i < 4 else x2, 16 * (3 - i % 4)).bitwiseAND(F.lit(0xFFFF))
        agree = agree + F.when(part == 0, 1 << i).otherwise(0)
    upto = F.element_at(F.array(*[F.lit((2 << j) - 1) for _, j in tables]), F.col("t") + 1)
    pair = F.element_at(F.array(*[F.lit(1 << i | 1 << j) for i, j in tables]), F.col("t") + 1)
    near = distance(F.col("q1"), F.col("q2"), F.col("h1"), F.col("h2")) <= radius
    # Spark sizes an exploded table as if it had one table's rows, and would broadcast 28 times as many.
    return a.hint("merge").join(b.hint("merge"), ["t", "front"]).filter(near & (agree.bitwiseAND(upto) == pair)).select("q1", "q2", "h1", "h2")


def fingerprint_edits(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", query_every: int = 50, radius: int = RADIUS
) -> DataFrame:
    """Fingerprint each text and the text whose second half is replaced by the start of the next document.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and n_within: for rows
    whose id is divisible by ``query_every`` the number of other documents within ``radius`` bits, else null.
    """
    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    ).withColumns({"k": F.coalesce("doc_id", F.lit(NULL_ID).cast("long")), "tie": F.xxhash64("text")})
    bounds = id_bounds(rows.select("k"), "k") or [0]
    paired = with_next(rows, "k", "tie", bounds, {"next_text": "text"})
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    both = paired.withColumn("edited", edited).select(
        "doc_id",
        "k",
        "tie",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "__range",
        "__row",
        F.explode(F.array(F.struct(F.lit(0).alias("kind"), "text"), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("e"),
    )
    row = ["doc_id", "k", "tie", "n_chars", "edited_sha256", "__range", "__row"]
    hashed = simhash(both.select(*row, "e.kind", "e.text"), [*row, "kind"])
    wide = hashed.groupBy(*row).agg(
        *[F.max(F.when(F.col("kind") == n, F.col(h))).alias(f"{p}{h}") for n, p in ((0, ""), (1, "e")) for h in ("h1", "h2")]
    ).drop("__range", "__row")
    done = kept(with_next(wide, "k", "tie", bounds, {"n1": "h1", "n2": "h2"}))
    counted = done.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    asks = F.col("doc_id") % query_every == 0
    found = (
        within_radius(done.filter(asks).select("h1", "h2").distinct(), counted.select("h1", "h2"), radius)
        .join(counted, ["h1", "h2"])
        .groupBy("q1", "q2")
        .agg(F.sum("n").alias("n"))
    )
    answered = done.withColumn("asks", asks).join(
        kept(found.withColumn("asks", F.lit(True))).select(F.col("q1").alias("h1"), F.col("q2").alias("h2"), "n", "asks"), ["h1", "h2", "asks"], "left"
    )
    return answered.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("h1"), F.col("h2")).alias("fingerprint"),
        as_text(F.col("eh1"), F.col("eh2")).alias("edited_fingerprint"),
        likeness(distance(F.col("h1"), F.col("h2"), F.col("eh1"), F.col("eh2"))).alias("near_edited"),
        likeness(distance(F.col("h1"), F.col("h2"), F.col("n1"), F.col("n2"))).alias("near_next"),
        (F.col("n") - 1).alias("n_within"),
    )
