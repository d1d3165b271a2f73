"""Document fingerprints by one-permutation MinHash; SQL functions only.

Each five-word shingle is hashed once. The hash picks a bin and a value; a bin keeps its least value. Empty bins
borrow from a full one that a hash of the bin's own number chooses (optimal densification), and only low-order bits
are stored, so that chance agreement has a known rate that the likeness corrects for. A text is worked on in its own
row; finding each document's neighbour in the order of ids shuffles a text once.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of a fingerprint, bits stored for each, words in a shingle.
BINS, BITS, WORDS = 128, 4, 5
#: Probes of an empty bin in the order of its hash, before all full bins are looked through.
PROBES = 6
BIN_SHIFT = 54  # a key is the bin above 54 bits of value
#: Groups of consecutive ids up to which their table (three numbers a row) is broadcast; quantiles of ids that cut groups
#: at most; numbers of groups in a block.
BROADCAST_GROUPS, QUANTILES, BLOCK_GROUPS = 200_000, 1_024, 1_000
SPACE = " \t\n\r\x0b\x0c"


def _probe(i: int, k: int) -> int:
    """The k-th bin that empty bin i looks at."""
    return int.from_bytes(hashlib.sha256(f"{i}:{k}".encode()).digest()[:4], "big") % BINS


def words(text: Column) -> Column:
    """White-space separated words; an empty array for a text without any."""
    t = F.btrim(text, F.lit(SPACE))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "\\s+"))


def bin_keys(ws: Column) -> Column:
    """Sorted keys of all shingles, repeated ones too. A text of fewer words has one shingle of all of them."""
    shingle = lambda i: F.xxhash64(F.slice(ws, i, WORDS))
    starts = F.sequence(F.lit(1), F.greatest(F.size(ws) - (WORDS - 1), F.lit(1)))
    key = lambda h: F.shiftleft(h.bitwiseAND(BINS - 1), BIN_SHIFT).bitwiseOR(F.shiftrightunsigned(h, 64 - BIN_SHIFT))
    return F.when(F.size(ws) == 0, F.array().cast("array<bigint>")).otherwise(F.sort_array(F.transform(starts, lambda i: key(shingle(i)))))


def fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: BINS values of BITS bits as hex, "" for a text without words. Null counts as empty."""
    own = [c for c in df.columns if c != out]
    # Each step is a column of its own: an expression inside a lambda would be worked out for every element.
    df = df.select(*own, words(F.coalesce(F.col(text), F.lit(""))).alias("_w"))
    df = df.select(*own, bin_keys(F.col("_w")).alias("_k"))
    first = F.filter("_k", lambda x, i: (i == 0) | (F.shiftright(x, BIN_SHIFT) != F.shiftright(F.get(F.col("_k"), i - 1), BIN_SHIFT)))
    df = df.select(*own, first.alias("_m"))
    df = df.select(*own, F.col("_m"), F.transform("_m", lambda x: F.shiftright(x, BIN_SHIFT).cast("int")).alias("_b"))
    # One letter of a string for each bin: "." where it is empty. Then borrow.
    low = F.transform("_m", lambda x: F.lower(F.hex(x.bitwiseAND((1 << BITS) - 1))))
    at = lambda i: F.get(F.col("_v"), F.array_position("_b", i).cast("int") - 1)
    probes = F.split(F.lit(",".join(str(_probe(i, k)) for i in range(BINS) for k in range(PROBES))), ",").cast("array<int>")
    last = lambda i: F.get(
        F.col("_v"),
        F.array_position("_b", F.array_min(F.transform("_b", lambda j: F.struct(F.xxhash64(i, j).alias("h"), j.alias("j"))))["j"]).cast("int") - 1,
    )
    filled = F.transform(
        F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.coalesce(at(i), *[at(F.get(probes, i * PROBES + k)) for k in range(PROBES)], last(i))
    )
    df = df.select(*own, "_b", low.alias("_v"))
    return df.select(*own, F.when(F.size("_b") == 0, "").otherwise(F.array_join(filled, "")).alias(out))


def likeness(a: Column, b: Column) -> Column:
    """Estimate of the Jaccard similarity of two texts from their fingerprints, 0 to 1.

    Two empty fingerprints are alike (1), an empty one is like no other (0). Equal values by chance, one in 2**BITS,
    are taken off.
    """
    word = 64 // BITS  # values in a long
    packed = lambda f, k: F.conv(F.substring(f, k * word + 1, word), 16, -10).cast("bigint")
    ones = int("1" * word, 16)

    def differ(k: int) -> Column:
        x = packed(a, k).bitwiseXOR(packed(b, k))
        y = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        return F.bit_count(y.bitwiseOR(F.shiftrightunsigned(y, 2)).bitwiseAND(ones))

    equal = 1 - sum((differ(k) for k in range(BINS // word)), F.lit(0)) / F.lit(float(BINS))
    chance = 1.0 / (1 << BITS)
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(F.greatest(F.lit(0.0), (equal - chance) / (1 - chance)))


def _group(id_col: Column, bounds: list[int], parts: int) -> Column:
    """Number of a group of consecutive ids: the range between two bounds and one of its ``parts`` equal widths. Bounds
    are found in two steps over short arrays. It never falls as the id grows; ids below all bounds are in the first range."""
    side = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[i : i + side] for i in range(0, len(bounds), side)]
    of = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    coarse = F.greatest(F.size(F.filter(of([r[0] for r in rows]), lambda b: b <= id_col)) - 1, F.lit(0))
    fine = F.greatest(F.size(F.filter(F.get(F.array(*map(of, rows)), coarse), lambda b: b <= id_col)) - 1, F.lit(0))
    at = coarse * side + fine
    low, high = F.get(of(bounds), at), F.get(of([*bounds[1:], bounds[-1] + 1]), at)
    share = (id_col.cast("double") - low) / F.greatest(high.cast("double") - low, F.lit(1.0))
    return at.cast("long") * parts + F.least(F.greatest(F.floor(share * parts), F.lit(0)), F.lit(parts - 1)).cast("long")


def _followers(tops: DataFrame) -> DataFrame:
    """(_g, _top, _to) of (_g, _top): the group above each, the lowest one for the highest. Groups are looked through in
    blocks of BLOCK_GROUPS numbers, and only the blocks' ends in one task."""
    inner = Window.partitionBy("_block").orderBy("_g")
    rows = tops.withColumn("_block", F.floor(F.col("_g") / BLOCK_GROUPS)).withColumn("_to", F.lead("_g").over(inner))
    firsts = rows.groupBy("_block").agg(F.min("_g").alias("_first"))
    chain = Window.orderBy("_block")
    ends = firsts.select("_block", F.lead("_first").over(chain).alias("_next"), F.min("_first").over(chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_least"))
    return rows.join(ends, "_block").select("_g", "_top", F.coalesce("_to", "_next", "_least").alias("_to"))


def with_next(df: DataFrame, id_col: str, cols: list[str], per_group: int = 400) -> DataFrame:
    """Rows with ``next_<c>`` of the row that follows in descending ``id_col``; the last one's is the first's.

    Ids (whole numbers) are dealt into groups of about ``per_group`` consecutive ones and each group is one window: first
    by approximate quantiles of all ids, at most QUANTILES, then by equal widths between two of them. The row after a
    group's last one comes along as a guest from the next group; which group that is follows from the groups' largest ids
    alone, a table ``per_group`` times shorter. Repeated ids stand in the order of ``cols``, one group for all rows of an id.
    Null ids stand at the end, by a hash of ``cols`` and then those: as many groups of hashes as of ids.
    """
    n, lo, rows_in_all = df.agg(F.count(id_col), F.min(id_col), F.count("*")).first()
    if not n and not df.head(1):
        return df.select("*", *[F.lit(None).cast(df.schema[c].dataType).alias(f"next_{c}") for c in cols])
    ranges = max(1, min(QUANTILES, n // per_group))
    cuts = df.agg(F.percentile_approx(id_col, [i / ranges for i in range(ranges)], 10 * QUANTILES)).first()[0] if n and ranges > 1 else []
    bounds = sorted({lo or 0, *(cuts or [])})
    parts = max(1, -(-n // (per_group * len(bounds))))
    # Where an id is null, a hash takes its place, in groups below all others.
    low_groups = max(1, -(-(rows_in_all - n) // per_group))
    rows = df.withColumn("_h", F.when(F.col(id_col).isNull(), F.xxhash64(*cols)))
    low = F.least(F.floor((F.col("_h") / float(1 << 64) + 0.5) * low_groups), F.lit(low_groups - 1)).cast("long") - low_groups
    rows = rows.withColumn("_g", F.coalesce(_group(F.col(id_col), bounds, parts), low)).withColumn("_place", F.struct(id_col, "_h"))
    guests = _followers(rows.groupBy("_g").agg(F.max("_place").alias("_top")))
    groups = len(bounds) * parts + low_groups
    marked = rows.join(F.broadcast(guests) if groups <= BROADCAST_GROUPS else guests, "_g")
    # The largest row of a group is the guest of the group above; the largest of all is the guest of the lowest group.
    own, guest = F.struct(F.col("_g").alias("g"), F.lit(0).alias("guest")), F.struct(F.col("_to").alias("g"), F.lit(1).alias("guest"))
    dealt = marked.select(*df.columns, "_h", F.explode(F.when(F.col("_place").eqNullSafe(F.col("_top")), F.array(own, guest)).otherwise(F.array(own))).alias("_d"))
    order = Window.partitionBy("_d.g").orderBy(F.col("_d.guest"), F.col(id_col).desc_nulls_last(), F.col("_h").desc(), *[F.col(c).asc_nulls_last() for c in cols])
    nexts = dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in cols])
    return nexts.where("_d.guest = 0").drop("_d", "_h")


def edited(text: Column, following: Column) -> Column:
    """The text whose last third of code points gives way to as many (or all) first ones of the following text."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(following, F.lit(1), third))
