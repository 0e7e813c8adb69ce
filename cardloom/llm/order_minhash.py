"""Document fingerprints by Order MinHash, in built-in expressions only.

The k-mers of a text are its runs of K pieces (a shorter text is one k-mer). Every text is cut in the same
way, by its characters alone and at any length: a piece is a run of letters up to white space, another kind
of character or one of CUT_LETTERS, a run of digits up to such a place or a 0, one sign, or one character
of a script without spaces (SINGLE). So an edit changes only the k-mers around it, in words as in text
without spaces; only a run without any such place stands or falls as a whole. The n-th occurrence of a k-mer in the text
becomes an element (k-mer, n). For each of SKETCHES orders the L smallest elements are selected,
brought back to their order in the text, and the tuple of their k-mers is hashed. Equal tuples in
two texts show k-mers that are shared and stand in the same order, so the share of equal sketches
follows the edit distance, not only the overlap.

The orders are rotations of one 64-bit hash: order j ranks an element by (hash - start_j) mod 2**w.
Each is a random order of the elements, and one sorted array per text serves all of them.

Occurrence numbers come from the sorted array as well: equal k-mers are neighbours in it, and the
number is found by steps of halving length back to the first equal one.

Null and empty texts have the empty fingerprint, which is like nothing but itself. Equal texts have
equal fingerprints. Repeated rows and ids each get their row. Very long texts are read whole; the
place of a word has 26 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

K = 3
L = 2
SKETCHES = 32
# characters that are a piece each: scripts without spaces, and pictures
SINGLE = "".join(rf"\p{{Is{x}}}" for x in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan")) + r"\p{So}"
CUT_LETTERS = "gjkqvxzGJKQVXZ"  # not frequent inside words, frequent enough in codes
# Runs of letters below U+0100 and of digits have classes of their own, and of the others the scripts are asked
# last: telling a script is a search. The possessive loops take no stack.
_PLAIN = "".join(chr(i) for i in range(256) if chr(i).isalpha() and chr(i) not in CUT_LETTERS)
_LETTERS = rf"(?:[{_PLAIN}]+|[\p{{L}}\p{{M}}&&[^{CUT_LETTERS}]&&[^{SINGLE}]]+)++"
_DIGITS = rf"(?:[123456789]+|[\p{{N}}&&[^0]&&[^{SINGLE}]]+)++"
# a piece in group 1, which white space may precede; no two choices begin alike, so their order is free
WORDS = rf"\s?+({_LETTERS}[{CUT_LETTERS}]?|[{CUT_LETTERS}]|{_DIGITS}0?|0|[^\s\p{{L}}\p{{M}}\p{{N}}]|[{SINGLE}])"
PLACE_BITS = 26
HASH_BITS = 63 - PLACE_BITS
_PLACE = (1 << PLACE_BITS) - 1
_RING = 1 << HASH_BITS
STRIDES = tuple(1 << b for b in range(PLACE_BITS - 1, -1, -1))
_LONGS = T.ArrayType(T.LongType(), containsNull=False)  # sorted without boxing, as no entry is null


def _ring(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - HASH_BITS)


def with_fingerprint(df: DataFrame, text_col: str, out: str, k: int = K) -> DataFrame:
    """``df`` with column ``out``: 8 hexadecimal digits per sketch, empty for texts without words."""
    w, s, e, n, t = f"_{out}_w", f"_{out}_s", f"_{out}_e", f"_{out}_n", f"_{out}_t"
    df = df.withColumn(w, F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORDS), F.lit(1)))
    last = F.greatest(F.size(w) - k, F.lit(0))
    word = F.col(w)
    # (hash of the k-mer, place), sorted: equal k-mers are neighbours in text order
    kmers = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.shiftleft(_ring(F.xxhash64(*[F.get(word, i + j) for j in range(k)])), PLACE_BITS).bitwiseOR(i.cast("bigint")),
    )
    df = df.withColumn(s, F.when(F.size(w) > 0, F.sort_array(kmers)).otherwise(F.array().cast(_LONGS)))
    df = df.drop(w)
    sorted_ = F.col(s)

    def steps(count: Column) -> Column:
        """The steps of a search among ``count`` entries: longer ones could never be taken."""
        all_steps = F.array(*[F.lit(b) for b in STRIDES])
        return F.slice(all_steps, F.greatest(F.lit(PLACE_BITS) - F.length(F.bin(count.cast("bigint"))) + 1, F.lit(1)).cast("int"), F.lit(PLACE_BITS))

    def same(i: Column, x: Column, back: Column) -> Column:
        return (i >= back) & (F.shiftright(F.get(sorted_, i - back), PLACE_BITS) == F.shiftright(x, PLACE_BITS))

    def occurrence(i: Column, x: Column) -> Column:
        climb = F.aggregate(F.col(t), F.lit(0), lambda r, b: F.when(same(i, x, r + b), r + b).otherwise(r))
        # most repeated k-mers occur twice, which needs no search
        return F.when(~same(i, x, F.lit(1)), 0).when(~same(i, x, F.lit(2)), 1).otherwise(climb)

    df = df.withColumn(t, steps(F.size(s)))
    elements = F.transform(
        sorted_,
        lambda x, i: F.shiftleft(_ring(F.xxhash64(F.shiftright(x, PLACE_BITS), occurrence(i, x))), PLACE_BITS).bitwiseOR(
            x.bitwiseAND(F.lit(_PLACE))
        ),
    )
    df = df.withColumn(e, F.sort_array(elements)).drop(s)
    df = df.withColumn(n, F.size(e))
    ring, total = F.col(e), F.col(n)

    def first_from(start: Column) -> Column:
        """Number of elements below the start of an order: the index of its smallest element."""
        below = lambda r, b: (r + b <= total) & (F.get(ring, r + b - 1) < start)
        return F.aggregate(F.col(t), F.lit(0), lambda r, b: F.when(below(r, b), r + b).otherwise(r))

    def sketch(start: Column) -> Column:
        at = lambda f, j: F.get(ring, F.pmod(f + j, total))
        place = lambda x: x.bitwiseAND(F.lit(_PLACE))
        # the smallest L elements as (place, hash), in text order
        tuple_ = lambda f: F.sort_array(
            F.array(*[F.struct(place(at(f, j)).alias("p"), F.shiftright(at(f, j), PLACE_BITS).alias("h")) for j in range(L)])
        )
        picked = F.transform(F.array(first_from(start)), lambda f: F.transform(tuple_(f), lambda t: t["h"]))
        return F.right(F.lpad(F.hex(F.xxhash64(F.element_at(picked, 1))), 16, "0"), F.lit(8))

    starts = F.array(*[F.lit((j * 0x9E3779B97F4A7C15 % (1 << 64) >> (64 - HASH_BITS)) << PLACE_BITS) for j in range(SKETCHES)])
    df = df.withColumn(out, F.when(total > 0, F.concat_ws("", F.transform(starts, sketch))).otherwise(F.lit("")))
    return df.drop(e, n, t)


def likeness(a: str, b: str) -> Column:
    """Estimated share of common elements of two fingerprints, 0 to 1.

    A sketch is equal if its L elements are all common and in the same order, so the L-th root of
    the share of equal sketches is returned; 1 for two empty ones, 0 if one is empty or null.
    """
    digits = F.sequence(F.lit(1), F.lit(8 * SKETCHES), F.lit(8))
    equal = F.aggregate(
        digits, F.lit(0), lambda n, i: n + F.when(F.col(a).substr(i, F.lit(8)) == F.col(b).substr(i, F.lit(8)), 1).otherwise(0)
    )
    share = F.pow(equal / F.lit(float(SKETCHES)), F.lit(1.0 / L))
    return F.when((F.col(a) == "") & (F.col(b) == ""), F.lit(1.0)).when((F.col(a) == "") | (F.col(b) == "") | F.col(b).isNull(), F.lit(0.0)).otherwise(share)


def with_next(df: DataFrame, id_col: str, columns: tuple[str, ...], blocks: int | None = None) -> DataFrame:
    """``df`` with ``next_<column>``: the values of the row with the next smaller id; after the last, the first.

    Rows are cut into blocks at quantiles of the id. The first rows of each block are also sent to
    the block before it, so the successor of every row is found inside its block: one shuffle, and no
    task holds more than a block. Of repeated ids the order is that of the columns; null ids are last.
    """
    spark = df.sparkSession
    blocks = blocks or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    stats = df.agg(
        F.percentile_approx(id_col, [i / blocks for i in range(blocks + 1)], 10 * blocks).alias("q"),
        F.max(id_col).alias("top"),
    ).first()
    cuts = sorted(set(stats["q"] or []), reverse=True)  # descending; ids that occur
    cuts = [stats["top"], *[c for c in cuts if c != stats["top"]]] if cuts else []
    name = F.col(id_col)
    bounds = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    # block b holds the ids from its cut down to above the next cut; null ids come after the last
    nulls = max(len(cuts), 1) - 1
    block = F.when(name.isNull(), nulls).otherwise(F.size(F.filter(bounds, lambda c: c >= name)) - 1)
    is_cut = F.coalesce(F.array_contains(bounds, name), F.lit(False)) if cuts else name.isNull()
    df = df.withColumn("_block", block.cast("int"))
    before = F.when(F.col("_block") > 0, F.col("_block") - 1).otherwise(F.lit(nulls))
    wraps = (F.col("_block") == 0).cast("int")
    own = F.struct(F.col("_block").alias("block"), F.lit(False).alias("ghost"), F.lit(0).alias("wrap"))
    ghost = F.struct(before.alias("block"), F.lit(True).alias("ghost"), wraps.alias("wrap"))
    if not cuts:  # only null ids: one block
        ghost = F.struct(F.lit(0).alias("block"), F.lit(True).alias("ghost"), F.lit(1).alias("wrap"))
    spread = df.withColumn("_to", F.explode(F.when(is_cut, F.array(own, ghost)).otherwise(F.array(own))))
    order = [F.col("_to.wrap"), F.desc_nulls_last(id_col), *[F.asc_nulls_first(c) for c in columns]]
    near = Window.partitionBy("_to.block").orderBy(*order)
    out = spread.withColumns({f"next_{c}": F.lead(c, 1).over(near) for c in columns})
    return out.filter(~F.col("_to.ghost")).drop("_to", "_block")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit by the next document, with their likenesses."""
    base = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    base = with_fingerprint(base, "_text", "fingerprint").withColumn("n_chars", F.char_length("_text").cast("bigint"))
    paired = with_next(base, id_col, ("_text", "fingerprint"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    head = F.col("_text").substr(F.lit(1), F.col("n_chars").cast("int") - cut)
    tail = F.coalesce(F.col("next__text").substr(F.lit(1), cut), F.lit(""))
    paired = paired.withColumn("_edited", F.concat(head, tail)).drop("_text", "next__text")
    paired = paired.withColumn("edited_sha256", F.sha2(F.col("_edited").cast("binary"), 256))
    paired = with_fingerprint(paired, "_edited", "edited_fingerprint")
    return paired.select(
        id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )
