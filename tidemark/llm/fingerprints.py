"""Document fingerprints from closed syncmers, in DataFrame operations only.

A text is read as units: four characters in a row without white space, one unit
from every place where they stand; a stretch of fewer is one unit.  A k-mer is K
units in a row, from every unit; its inner substrings are its single units.
It is a closed syncmer when the smallest hash of its units is that of its first
or last one.  Whether a k-mer is chosen depends on nothing outside it, so equal
passages have equal anchors wherever they stand, and an edit changes only the
k-mers that it touches.  A fingerprint is all anchors with their positions: about
a quarter of the units, and none is dropped.  Two texts are as alike as the
share of their anchors that match, position by position.

An edited text has the beginning of its original; up to the last white space
there units, and k-mers inside, are those of the original and are taken from it.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Units in a k-mer: 11 characters without white space, or two to three words.
K = 8
#: Documents aimed at in a block of neighbours, most blocks, and rows of a sample for each.
BLOCK_ROWS, MOST_BLOCKS, SAMPLED = 400, 1 << 16, 20


def _let(value: Column, body: object) -> Column:
    """body(value) with the value computed once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def units(text: Column) -> Column:
    """The units of a text in order: overlapping fours of characters, so none depends on where its stretch began."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?=(\S{4}|(?<!\S)\S{1,3}(?!\S)))\S"), F.lit(1))


def _hashes(text: Column) -> Column:
    return F.transform(units(text), lambda u: F.xxhash64(u))


def _chosen(h: Column, k: int, before: Column | None = None) -> Column:
    """The closed syncmers of hashes of units; `before` units stand before the first one."""

    def one(first: Column, i: Column) -> Column:
        at = [first, *(F.get(h, i + F.lit(d)) for d in range(1, k))]
        # an edge is compared until a smaller hash turns up, after two or three units as a rule; beyond the end all is null
        left = reduce(lambda x, y: x & y, (at[0] <= u for u in at[1:]))
        right = reduce(lambda x, y: x & y, (at[-1] <= u for u in at[-2::-1]))
        return F.when(left | right, F.struct((i if before is None else i + before).alias("position"), F.xxhash64(*at).alias("hash")))

    return F.filter(F.transform(h, one), lambda x: x.isNotNull())


def _or_short(many: Column, h: Column, n: Column, k: int) -> Column:
    """many for n units, k at least; else one anchor of all hashes h, or none."""
    short = F.array(F.struct(F.lit(0).alias("position"), F.xxhash64(h).alias("hash")))
    none = F.array().cast("array<struct<position:int,hash:bigint>>")
    return F.when(n >= k, many).when(n > 0, short).otherwise(none)


def anchors(text: Column, k: int = K) -> Column:
    """The closed syncmers of a text: array of (position in units, hash).

    A text of fewer units than k but not none is one anchor; null, empty and
    blank texts have none.
    """
    return _let(_hashes(text), lambda h: _or_short(_chosen(h, k), h, F.size(h), k))


def head(text: Column, n: Column) -> Column:
    """The first n characters of a text as far as their last white space, with it: no unit lies across its end."""
    return F.regexp_extract(F.substring(text, F.lit(1), n), r"(?s)^(.*\s)", 1)


def anchors_in_parts(first: Column, rest: Column, k: int = K) -> Column:
    """What anchors() has for a text from its head() and its rest, with what other_rest() needs: (anchors, units of the head, hashes of its last k - 1)."""

    def joined(a: Column, b: Column) -> Column:
        def made(last: Column, end: Column) -> Column:
            many = F.concat(_chosen(a, k), _chosen(end, k, F.size(a) - F.size(last)))
            return F.struct(_or_short(many, end, F.size(a) + F.size(b), k).alias("anchors"), F.size(a).alias("units"), last.alias("last"))

        return _let(F.slice(a, F.greatest(F.size(a) - (k - 2), F.lit(1)), F.lit(k - 1)), lambda last: _let(F.concat(last, b), lambda end: made(last, end)))

    return _let(_hashes(first), lambda a: _let(_hashes(rest), lambda b: joined(a, b)))


def other_rest(parts: Column, rest: Column, k: int = K) -> Column:
    """What anchors() has for the text with the same head() and another rest: k-mers inside the head are not made again."""

    def made(end: Column) -> Column:
        before = parts["units"] - F.size(parts["last"])
        many = F.concat(F.filter(parts["anchors"], lambda x: x["position"] <= parts["units"] - k), _chosen(end, k, before))
        return _or_short(many, end, before + F.size(end), k)

    return _let(F.concat(parts["last"], _hashes(rest)), made)


def fingerprint(found: Column) -> Column:
    """Anchors as text, in order of position: sixteen hexadecimal digits of the hash and eight of the position for each."""
    return F.lower(F.array_join(F.transform(found, lambda x: F.concat(F.lpad(F.hex(x["hash"]), 16, "0"), F.lpad(F.hex(x["position"].cast("long")), 8, "0"))), ""))


def positional_matches(a: Column, b: Column) -> Column:
    """Pairs of positions whose anchors agree, from two arrays of anchors: (position in a, position in b).

    An anchor that stands several times in a text is paired in order, its first
    place in a with its first in b and so on, so no place is in two pairs.
    Both arrays are sorted together by hash, and equal hashes are then neighbours.
    """
    side = lambda found, n: F.transform(found, lambda x: F.struct(x["hash"].alias("hash"), F.lit(n).alias("side"), x["position"].alias("position")))

    def paired(s: Column) -> Column:
        differs = lambda i: (i == 0) | (F.get(s, i - 1)["hash"] != F.get(s, i)["hash"])
        starts = F.filter(F.transform(F.sequence(F.lit(0), F.size(s)), lambda i: F.when((i == F.size(s)) | differs(i), i)), lambda i: i.isNotNull())

        def in_runs(at: Column) -> Column:
            def pairs(i: Column, j: Column) -> Column:
                run = F.slice(s, i + 1, j - i)
                mine, other = F.filter(run, lambda x: x["side"] == 0), F.filter(run, lambda x: x["side"] == 1)
                both = F.zip_with(mine, other, lambda x, y: F.struct(x["position"].alias("a"), y["position"].alias("b")))
                return F.filter(both, lambda p: p["a"].isNotNull() & p["b"].isNotNull())

            two = F.transform(at, lambda i, n: F.struct(i.alias("i"), F.get(at, n + 1).alias("j")))
            # a run of both texts begins with side 0 and ends with side 1
            two = F.filter(two, lambda r: (r["j"] - r["i"] > 1) & (F.get(s, r["i"])["side"] < F.get(s, r["j"] - 1)["side"]))
            return F.flatten(F.transform(two, lambda r: F.when(r["j"] - r["i"] == 2, F.array(F.struct(F.get(s, r["i"])["position"].alias("a"), F.get(s, r["i"] + 1)["position"].alias("b")))).otherwise(pairs(r["i"], r["j"]))))

        return _let(starts, in_runs)

    return _let(F.sort_array(F.concat(side(a, 0), side(b, 1))), paired)


def both_sides(a: Column, b: Column) -> Column:
    """The hashes of two arrays of anchors in order, the lowest bit telling the array: equal hashes of both are neighbours."""
    coded = lambda found, n: F.transform(found, lambda x: x["hash"].bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(n)))
    return F.sort_array(F.concat(coded(a, 0), coded(b, 1)))


def matches(s: Column) -> Column:
    """How many pairs positional_matches() has, from both_sides(): of each hash as many as the text that has it less often."""
    at = lambda i: F.get(s, i)
    # where the second text's stretch of a hash begins; a hash is left when one of its stretches is used up
    seams = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (at(i).bitwiseAND(F.lit(1)) == 1) & (at(i - 1) == at(i) - 1))

    def further(state: Column, d: Column) -> Column:
        left = F.filter(state["seams"], lambda i: (at(i + d) == at(i)) & (at(i - d - 1) == at(i) - 1))
        return F.struct(left.alias("seams"), (state["n"] + F.size(state["seams"])).alias("n"))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), (F.size(s) / 2).cast("int"))), F.struct(seams.alias("seams"), F.lit(0).alias("n")), further, lambda state: state["n"])


def likeness(s: Column) -> Column:
    """From both_sides(): the Jaccard similarity of two texts' anchors, each at each of its positions: those in a positional match among those of both.

    1 for two texts without anchors, 0 if only one has none.
    """
    return F.when(F.size(s) == 0, F.lit(1.0)).otherwise(_let(matches(s), lambda m: m.cast("double") / (F.size(s) - m)))


def with_next(df: DataFrame, key: str, columns: list[str], derived: dict[str, Column] | None = None) -> DataFrame:
    """The rows of df with next_<column> of the row with the next smaller key (for the smallest: of the largest).

    derived: further columns, made of the others once the rows are in the task
    of their block, so that neither the passes that place them nor the shuffle
    carry them; they have a next_<column> too.

    Rows are in order of key and, within equal keys, of a hash of the columns;
    null keys come last.  The order is cut into blocks at quantiles of a sample
    that is bounded by the number of blocks, so a key that very many rows share,
    or that is null, is many blocks; rows equal in key and columns are in one.
    Each block is sorted by itself and takes the first row of the following block
    along.  A single row is its own next; an empty table gives an empty one.
    Columns of df whose names begin with "__" are lost.
    """
    spark = df.sparkSession
    names = [c for c in df.columns if not c.startswith("__")]
    k = F.col(key).cast("long")
    place = F.struct(k.isNotNull().cast("int").alias("a"), F.coalesce(k, F.lit(0)).alias("k"), F.xxhash64(*columns).alias("t"))
    rows = df.select(*names, place.alias("__place"))
    n = df.count()
    blocks = max(1, min(MOST_BLOCKS, n // BLOCK_ROWS))
    cuts: list[tuple[int, int, int]] = []
    if blocks > 1:
        share = min(1.0, SAMPLED * blocks / n)
        own = rows.select("__place").where(F.pmod(F.xxhash64("__place"), F.lit(1 << 30)) < int(share * (1 << 30))).distinct()
        drawn = sorted(tuple(r[0]) for r in own.limit(2 * SAMPLED * blocks).collect())  # about SAMPLED a block
        cuts = sorted({drawn[i * len(drawn) // blocks] for i in range(1, blocks)}) if drawn else []
    if cuts:
        # two levels of cuts, so a row looks at about twice the square root of their number
        width = max(1, int(len(cuts) ** 0.5))
        literal = lambda xs: F.from_json(F.lit(json.dumps([dict(zip("akt", x)) for x in xs])), "array<struct<a:int,k:bigint,t:bigint>>")
        below = lambda xs: F.size(F.filter(xs, lambda c: c <= F.col("__place")))
        rows = rows.withColumn("__group", below(literal(cuts[::width])))
        fine = F.slice(literal(cuts), F.greatest((F.col("__group") - 1) * width + 1, F.lit(1)), width)
        rows = rows.withColumn("__block", F.when(F.col("__group") == 0, F.lit(0)).otherwise((F.col("__group") - 1) * width + below(fine)).cast("int"))
    else:
        rows = rows.withColumn("__block", F.lit(0))
    heads = sorted(((r["__block"], tuple(r["head"])) for r in rows.groupBy("__block").agg(F.max("__place").alias("head")).collect()), reverse=True)  # a row a block
    after = [(b, heads[(i + 1) % len(heads)][1]) for i, (b, _) in enumerate(heads)]
    firsts = spark.createDataFrame(after, "__to int, __place struct<a:int,k:bigint,t:bigint>")
    tails = rows.join(F.broadcast(firsts), "__place").dropDuplicates(["__to"])
    placed = rows.select(*names, "__place", "__block", F.lit(0).alias("__tail"))
    placed = placed.unionByName(tails.select(*names, "__place", F.col("__to").alias("__block"), F.lit(1).alias("__tail")))
    if derived:
        placed = placed.repartition("__block").withColumns(derived)
    window = Window.partitionBy("__block").orderBy("__tail", F.col("__place").desc())
    made = [*columns, *(derived or {})]
    taken = placed.select(*names, *(derived or {}), "__tail", *(F.lead(c).over(window).alias(f"next_{c}") for c in made))
    return taken.where("__tail = 0").drop("__tail")


def fingerprints_of_edits(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text of a row has its last third (rounded down, in characters)
    replaced by as many of the first characters of the row with the next smaller
    key.  Null texts count as empty; a table of one row is its own next, an empty
    one gives no rows.  Rows of equal or null keys follow each other by a hash of
    their texts.  Other columns, whatever their names, are not read.  Texts of any
    length are taken whole.
    """
    own = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    kept = head(F.col("text"), n - third)
    parts = _let(kept, lambda first: anchors_in_parts(first, F.substring(F.col("text"), F.char_length(first) + 1, n)))
    both = with_next(own, "key", ["text"], {"parts": parts})
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.coalesce(F.col("next_text"), F.lit("")), F.lit(1), third))
    out = both.select("key", n.cast("long").alias("n_chars"), edited.alias("edited"), F.char_length(kept).alias("head"), "parts", F.col("next_parts")["anchors"].alias("next_anchors"))
    changed = other_rest(F.col("parts"), F.substring(F.col("edited"), F.col("head") + 1, F.char_length("edited")))
    out = out.select("key", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("parts")["anchors"].alias("anchors"), "next_anchors", changed.alias("edited_anchors"))
    a, b, c = F.col("anchors"), F.col("edited_anchors"), F.col("next_anchors")
    out = out.select("key", "n_chars", "edited_sha256", fingerprint(a).alias("fingerprint"), fingerprint(b).alias("edited_fingerprint"), both_sides(a, b).alias("with_edited"), both_sides(a, c).alias("with_next"))
    return out.select("key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("with_edited")).alias("near_edited"), likeness(F.col("with_next")).alias("near_next"))
