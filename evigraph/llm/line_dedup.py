"""Op 10, line dedup: fuzzy lines by minhashes and SimHash, DataFrame operations only.

Lines are lower-cased, runs of other signs become one space. Equal normalised lines are one line with a first
occurrence. Of each line's words the least under HASHES different orders are taken; very common words come late in all
of them. Two lines meet under a key if all ROWS minhashes of one of the KEYS groups are equal. A SimHash of 63 bits counts
the words' hash bits, packed seven counters to a number; lines that meet are compared if at most DIFFER of its bits differ,
twice of what an edit similarity of 0.8 brings about. Two further numbers hold the parities of the words in 128 bins: a changed
word turns two of them at most, a word more or less one, so lines with more unequal bits than the edit similarity allows are
not similar and never verified; this loses no pair.
Under a key every line is first compared with the key's most frequent line; then only lines that are not connected
yet are compared with each other, so a group of thousands of near copies doesn't make all its pairs. Under a crowded key
these also need parities in 512 bins that allow for the similarity, and a pair counts under the first such key it meets under.
Under a key of more than SPLIT lines two lines are compared if they also share one of their rarest words, a fifth of the
line's and one more: similar lines share all but a fifth of their words, so one of these too. Neither loses a pair. A key that holds more
than one in HOT of the lines falls into parts of that size, and the most frequent lines of its parts meet each other.
Pairs are verified by edit similarity in words, and the first occurrence in the order of (id, place) is kept of each
connected group.

Defined results: lines of fewer than `least_words` words only fall to exact repeats (after normalising), lines without
a word always stay. A null text stays null, an empty one empty. Repeated rows of one id and text are one document. A
document that loses all its lines is left with an empty text, and `n_dropped` tells so. Columns `n_lines` and `n_dropped`
of the input are replaced, all others are kept as they are. Lines of any length are hashed whole."""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Kept
from .components import components

BITS, DIFFER = 63, 26
HASHES, ROWS, KEYS = 24, 3, 16
#: A word is common if it is more than one in COMMON of all words.
COMMON = 500
#: A key is hot if more than one in HOT of a sample of about SAMPLE lines have it; that splits keys and changes no result.
HOT, SAMPLE = 1000, 100_000
LEAST_WORDS, SIMILARITY = 5, 0.8
#: A key that more than CROWD lines meet under is crowded; its lines' finer parities are compared, in 64 bins for each of FINE
#: numbers. Lines under a key of more than SPLIT, so of more than two million pairs, meet under their rarest words.
CROWD, FINE, SPLIT = 64, 8, 2000
FINES = [f"f{j}" for j in range(FINE)]
#: Words that a counter of nine bits can count.
PIECE = 500
#: Lines, and then keys, are shuffled in so many parts one after another: the disk holds one part at a time.
PARTS = 2
#: Pairs that take their lines' words along at once; more are verified in parts one after another.
PAIRS_AT_ONCE = 750_000
#: Ids of lines that are broadcast at once, 8 bytes each.
MOST_IDS = 1_000_000


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def profiles(texts: DataFrame, common: list[str], by: list[str], carry: list[str]) -> DataFrame:
    """(*by, *carry, words, h, odd, odd2, f0 ..., keys) of (*by, *carry, norm, words); `by` names a line, `carry` are its numbers; words may be in `by`.

    Bit i of h is set if more than half of the words have it in their hash. Seven counters of nine bits share a number, so
    at most PIECE words are counted at once; adding 255 - n div 2 to a counter sets its top bit just if it is over n / 2.
    Longer lines add up their pieces bit by bit. keys are KEYS hashes, each of ROWS minhashes: an order is that of 31 bits
    of the words' hashes, seen from a point of its own; common words have its last quarter too, so they count for less,
    but lines of common words only are told apart as well."""
    mask = sum(1 << i for i in range(0, BITS, 9))
    draw = random.Random(17)
    points = [(k << 26) + draw.randrange(1 << 26) for k in draw.sample(range(32), HASHES)]
    carry = [c for c in (*carry, "words") if c not in by]
    words = texts.select(*by, *carry, F.posexplode(F.split("norm", " ")).alias("spot", "w"))
    often = F.col("w").isin(common) if common else F.lit(False)
    words = words.select(*by, *carry, "spot", F.xxhash64("w").alias("x"), often.alias("often"))
    words = words.withColumns({"s": F.when(F.col("often"), 2).otherwise(0), "t": F.when(F.col("often"), F.lit(3 << 29).cast("long")).otherwise(F.lit(0).cast("long"))})
    counts = [F.sum(F.shiftrightunsigned("x", k).bitwiseAND(F.lit(mask))).alias(f"c{k}") for k in range(9)]
    least = [F.min(F.expr(f"shiftrightunsigned((shiftrightunsigned(x, {8 * (k % 4)}) & {2**31 - 1}L) ^ {c}L, s) + t")).alias(f"m{k}") for k, c in enumerate(points)]
    odd = ["odd", "odd2"]  # the sign of x chooses between them, its next six bits the bin
    least += [F.expr(f"bit_xor(if(x {sign} 0, shiftleft(1L, cast(shiftrightunsigned(x, 57) as int) & 63), 0L))").alias(c) for c, sign in zip(odd, (">=", "<"), strict=True)]
    least += [F.expr(f"bit_xor(if(pmod(x, {FINE}) = {j}, shiftleft(1L, cast(shiftrightunsigned(x, 48) as int) & 63), 0L))").alias(c) for j, c in enumerate(FINES)]
    odd += FINES
    mins = [*(f"m{k}" for k in range(HASHES)), *odd]
    same = [F.first(c).alias(c) for c in carry]
    lift = f"(255L - words div 2) * {mask}L"
    top = " | ".join(f"shiftleft(shiftrightunsigned(c{k} + {lift}, 8) & {mask}L, {k})" for k in range(9))
    short = words.where(F.col("words") <= PIECE).groupBy(*by).agg(*counts, *least, *same).select(*by, *carry, F.expr(top).alias("h"), *mins)
    pieces = words.where(F.col("words") > PIECE).groupBy(*by, F.floor(F.col("spot") / PIECE).alias("piece")).agg(*counts, *least, *same)
    bits = [F.sum(F.shiftrightunsigned(f"c{i % 9}", 9 * (i // 9)).bitwiseAND(F.lit(511))).alias(f"b{i}") for i in range(BITS)]
    over = " | ".join(f"if(2 * b{i} > words, {1 << i}L, 0L)" for i in range(BITS))
    long = pieces.groupBy(*by).agg(*bits, *[F.min(m).alias(m) for m in mins[:HASHES]], *[F.bit_xor(c).alias(c) for c in odd], *same).select(*by, *carry, F.expr(over).alias("h"), *mins)
    chosen = [x for _ in range(KEYS * ROWS // HASHES) for x in draw.sample(range(HASHES), HASHES)]
    keys = [F.xxhash64(F.lit(i), *[f"m{k}" for k in chosen[i * ROWS : (i + 1) * ROWS]]) for i in range(KEYS)]
    return short.unionByName(long).select(*by, *carry, "h", *odd, F.array(*keys).alias("keys"))


def common_words(lines: DataFrame) -> list[str]:
    """The words, fewer than COMMON, that are each more than one in COMMON of all words of all lines."""
    total = lines.agg(F.sum("words")).first()[0] or 0
    counts = lines.select(F.explode(F.split("norm", " ")).alias("w")).groupBy("w").agg(F.count("*").alias("c"))
    return [r.w for r in counts.where(F.col("c") * COMMON > total).select("w").collect()]


def _hot(lines: DataFrame, n: int) -> DataFrame:
    """(key, parts) of keys that more than one in HOT of a sample of the lines (line_id, keys) have, which are fewer than HOT * KEYS."""
    sample = lines.where(F.pmod(F.xxhash64("line_id"), F.lit(1 + n // SAMPLE)) == 0)
    size = max(sample.count(), 1)
    hot = sample.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") * HOT > size + HOT * 20)
    return hot.select("key", F.ceil(F.col("c") * HOT / size).alias("parts"))


def _several(lines: DataFrame, hot: DataFrame, keys: Column) -> DataFrame:
    """(key, salt, line_id) of the keys that several lines have under the same salt; salt splits hot keys."""
    keys = lines.select("line_id", F.explode(keys).alias("key")).join(F.broadcast(hot), "key", "left")
    keys = keys.select("key", F.pmod(F.xxhash64("line_id"), F.coalesce("parts", F.lit(1))).cast("int").alias("salt"), "line_id")
    order = Window.partitionBy("key", "salt").orderBy("line_id")
    keys = keys.select("key", "salt", "line_id", F.lag("line_id").over(order).alias("l"), F.lead("line_id").over(order).alias("r"))
    return keys.where("l IS NOT NULL OR r IS NOT NULL").select("key", "salt", "line_id")


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the text's kept lines, and n_lines and n_dropped."""
    kept = Kept(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    mark = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    lines = docs.select(F.col(id_col).cast("long").alias("id"), mark.alias("mark"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("at", "line"))
    lines = lines.select("id", "mark", "at", normalised(F.col("line")).alias("norm")).where("norm != ''")
    count_words = F.size(F.split("norm", " ")).alias("words")
    lines = kept.keep(lines.select("id", "mark", "at", "norm", count_words, F.xxhash64("norm").alias("k1"), F.xxhash64(F.lit(1), "norm").alias("k2")), "lines")
    place = F.struct(F.col("id").isNull().alias("n"), "id", "mark", "at")
    common = common_words(lines)
    # one number holds how often a line occurs, above its count of words
    size = F.shiftleft(F.least("n", F.lit(2**30)), 32).bitwiseOR(F.col("words").cast("long")).alias("size")
    keys = F.when(F.col("words") >= least_words, F.col("keys"))  # shorter lines have none

    def named(part: int) -> DataFrame:
        """One shuffle brings equal lines together, and their words stay where they are."""
        each = lines.where(F.pmod("k1", F.lit(PARTS)) == part).groupBy("k1", "k2", "words").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.first("norm").alias("norm"))
        each = each.select("k1", "k2", "words", "n", "norm", "first.id", "first.mark", "first.at")
        names = profiles(each, common, ["k1", "k2", "words"], ["id", "mark", "at", "n"])
        line_id = (F.monotonically_increasing_id() * PARTS + part).alias("line_id")
        return kept.keep(names.select(line_id, "k1", "k2", place.alias("first"), "n", "h", "odd", "odd2", *FINES, size, keys.alias("keys")), f"named{part}")

    full = reduce(DataFrame.unionByName, [named(i) for i in range(PARTS)])
    names = kept.keep(full.drop("keys"), "names")
    hot = kept.keep(_hot(full, names.count()), "hot")
    step = KEYS // PARTS
    pairs = [kept.keep(_several(full, hot, F.slice("keys", 1 + i * step, step if i < PARTS - 1 else KEYS)), f"several{i}") for i in range(PARTS)]
    pairs = reduce(DataFrame.unionByName, pairs)
    kept.drop(*(f"named{i}" for i in range(PARTS)))
    hashed = names.select("line_id", "h", "odd", "odd2", "size")
    count = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))

    edits = lambda n, m: F.floor(F.greatest(n, m) * (1 - similarity) + 1e-9)  # noqa: E731  of words, at most

    def most_odd(to: str) -> Column:
        """Unequal parities at most: an edit beyond the unequal counts turns two."""
        n, m = count("size"), count(f"{to}_size")
        return 2 * edits(n, m) - F.abs(n - m)

    def close(to: str) -> Column:
        """A line and its other, whose columns begin with `to`, are close in their hashes, and their words' counts and parities let them be similar."""
        n, m = count("size"), count(f"{to}_size")
        differ = lambda c: F.bit_count(F.col(c).bitwiseXOR(F.col(f"{to}_{c}")))
        return (differ("h") <= DIFFER) & (F.abs(n - m) <= edits(n, m)) & (differ("odd") + differ("odd2") <= most_odd(to))

    # the keys that several lines have, and every such line against the most frequent line under its part of the key
    seen = ["h", "odd", "odd2", "size"]

    def top_of(rows: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("size"), "line_id")
        top = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.select("key", "salt", "line_id", *seen, F.first("line_id").over(top).alias("to"), *[F.first(c).over(top).alias(f"to_{c}") for c in seen])

    met = kept.keep(top_of(pairs.join(hashed, "line_id"), "key", "salt"), "met")
    tops = met.where("line_id = to AND salt > 0").select("key").distinct()  # keys in parts: their parts' tops, few, meet as well
    tops = top_of(met.where("line_id = to").join(tops, "key", "left_semi").select("key", "salt", "line_id", *seen), "key")
    star = met.unionByName(tops).where((F.col("line_id") != F.col("to")) & close("to")).select(F.greatest("line_id", "to").alias("a"), F.least("line_id", "to").alias("b"))
    star = _verified(star.distinct(), lines, names, similarity, kept, "star")
    kept.drop("star-pairs", "star-ids", "star-signs")
    tied = components(star, kept, "tied").select(F.col("node").alias("line_id"), "component")
    # lines that are not tied yet against all they meet, then different components that meet
    met = kept.keep(met.select("key", "line_id", *seen).join(tied, "line_id", "left"), "marked")
    kept.drop("met", *(f"several{i}" for i in range(PARTS)))
    crowd = kept.keep(met.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > CROWD), "crowd")
    sparse, near = met.join(crowd, "key", "left_anti"), close("to")
    named_to = lambda df, *more: df.select("key", F.col("line_id").alias("to"), *[F.col(c).alias(f"to_{c}") for c in (*seen, *more)], F.col("component").alias("of"))
    other = named_to(sparse)
    rest = sparse.where("component IS NULL").join(other, "key").where((F.col("of").isNotNull() | (F.col("line_id") < F.col("to"))) & near)
    groups = sparse.where("component IS NOT NULL")
    several = groups.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    groups = groups.join(several, "key", "left_semi")
    cross = groups.join(other, "key").where((F.col("component") < F.col("of")) & near)
    crowded = met.join(crowd, "key")
    crowded = crowded.join(crowded.groupBy("line_id").agg(F.collect_set("key").alias("crowds")), "line_id")
    crowded = kept.keep(crowded.join(names.select("line_id", *FINES), "line_id"), "crowded")
    unequal = reduce(Column.__add__, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"to_{c}"))) for c in FINES])
    apart = F.coalesce(F.col("component") != F.col("of"), F.lit(True))
    first = F.array_min(F.array_intersect("crowds", "to_crowds")) == F.col("key")
    alike = (F.col("line_id") < F.col("to")) & apart & near & (unequal <= most_odd("to")) & first
    few, many = crowded.where(F.col("c") <= SPLIT), crowded.where(F.col("c") > SPLIT)
    dense = few.join(named_to(few, "crowds", *FINES), "key").where(alike).select("line_id", "to")
    if not many.isEmpty():
        ids = _ids(many.select("line_id").distinct(), names, kept, "crowd")
        many = kept.keep(many.join(_rarest(_norms(ids, lines), edits), "line_id"), "split")
        by_word = named_to(many, "crowds", *FINES, "w").withColumnRenamed("to_w", "w")
        dense = dense.unionByName(many.join(by_word, ["key", "w"]).where(alike).select("line_id", "to"))
    rest = rest.select("line_id", "to").unionByName(cross.select("line_id", "to")).unionByName(dense)
    rest = _verified(rest.select(F.greatest("line_id", "to").alias("a"), F.least("line_id", "to").alias("b")).distinct(), lines, names, similarity, kept, "rest")
    groups = components(star.select("a", "b").unionByName(rest.select("a", "b")), kept, "groups")
    kept.drop("rest-pairs", "rest-ids", "rest-signs", "marked", "crowd", "crowd-ids", "crowded", "split")

    # the first occurrence of each group; the others, and repeats of a line, go
    best = groups.join(names.select(F.col("line_id").alias("node"), "first"), "node").groupBy("component").agg(F.min("first").alias("best"))
    winner = groups.join(best, "component").select(F.col("node").alias("line_id"), "best")
    decided = names.select("line_id", "k1", "k2", "first", "n").join(winner, "line_id", "left").where("n > 1 OR best IS NOT NULL").select("k1", "k2", F.coalesce("best", "first").alias("best"))
    decided = kept.keep(decided, "decided")
    drop = lines.select("id", "mark", "at", "k1", "k2").join(decided, ["k1", "k2"]).where(~place.eqNullSafe(F.col("best")))
    drop = kept.keep(drop.groupBy("id", "mark").agg(F.collect_set("at").alias("gone")), "drop")  # small, it lets the documents stay where they are
    kept.drop("lines", "names", "hot")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("d"), F.col(id_col).cast("long").alias("id"), mark.alias("mark")).alias("r")
    rows = rows.join(drop.alias("g"), F.col("r.id").eqNullSafe(F.col("g.id")) & (F.col("r.mark") == F.col("g.mark")), "left").select("d", "gone", F.split(F.col(f"d.{text_col}"), "\n", -1).alias("parts"))
    # the lambda's p is the split text once, not once for each line
    stay = F.transform(F.array("parts"), lambda p: F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col("gone")), lambda i: p[i]))[0]
    text = F.when(F.col("gone").isNull(), F.col(f"d.{text_col}")).otherwise(F.array_join(stay, "\n"))
    n = F.when(F.col(f"d.{text_col}").isNull(), 0).otherwise(F.size("parts")).alias("n_lines")
    return rows.select(*[text.alias(c) if c == text_col else F.col(f"d.`{c}`").alias(c) for c in own], n, F.coalesce(F.size("gone"), F.lit(0)).alias("n_dropped"))


def _ids(ids: DataFrame, names: DataFrame, kept: Kept, name: str) -> DataFrame:
    """The lines of `ids` (line_id) with their hashes and first occurrence."""
    return kept.keep(names.join(ids, "line_id", "left_semi").select("line_id", "k1", "k2", F.col("first.id").alias("of"), F.col("first.mark").alias("of_mark"), F.col("first.at").alias("of_at")), f"{name}-ids")


def _norms(ids: DataFrame, lines: DataFrame) -> DataFrame:
    """(line_id, norm) of the lines of _ids(). Only their first occurrence leaves the scan of all lines: their hashes are
    broadcast up to MOST_IDS, joined beyond it."""
    first = F.col("id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("of_mark")) & (F.col("at") == F.col("of_at"))
    return lines.join(F.broadcast(ids) if ids.count() <= MOST_IDS else ids, ["k1", "k2"]).where(first).dropDuplicates(["line_id"]).select("line_id", "norm")


def _rarest(norms: DataFrame, edits: Callable[[Column, Column], Column]) -> DataFrame:
    """(line_id, w) of each line's rarest words, one more than the edits it allows; w tells a word's occurrences in the line apart.

    Similar lines share all but that many of the longer one's words, so at least one of these, in any order that is the same for all lines."""
    words = norms.select("line_id", F.size(F.split("norm", " ")).alias("n"), F.explode(F.split("norm", " ")).alias("w"))
    words = words.groupBy("line_id", F.xxhash64("w").alias("x")).agg(F.first("n").alias("n"), F.count("*").alias("times"))
    lines = words.groupBy("x").agg(F.count("*").alias("lines"))
    each = words.join(lines, "x").select("line_id", "n", "lines", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("time"), "x")
    each = each.select("line_id", "n", "lines", F.xxhash64("x", "time").alias("w"))
    rank = F.row_number().over(Window.partitionBy("line_id").orderBy("lines", "w"))
    return each.withColumn("rank", rank).where(F.col("rank") <= edits(F.col("n"), F.col("n")) + 1).select("line_id", "w")


def _verified(pairs: DataFrame, lines: DataFrame, names: DataFrame, similarity: float, kept: Kept, name: str) -> DataFrame:
    """Pairs (a, b) of line ids whose edit similarity in words is high enough: a word is one of 2**14 signs to levenshtein().
    They are verified in parts of about PAIRS_AT_ONCE, so the disk holds the words of one part's pairs at a time."""
    pairs = kept.keep(pairs, f"{name}-pairs")
    parts = 1 + pairs.count() // PAIRS_AT_ONCE
    ids = _ids(pairs.select(F.col("a").alias("line_id")).union(pairs.select("b")).distinct(), names, kept, name)
    sign = F.decode(F.unhex(F.array_join(F.transform(F.split("norm", " "), lambda w: F.hex(F.lit(0x5000) + F.xxhash64(w).bitwiseAND(F.lit(0x3FFF).cast("long")))), "")), "UTF-16BE")
    own = _norms(ids, lines).select("line_id", sign.alias("sign"))
    own = kept.keep(own, f"{name}-signs")
    text = lambda c, s: own.select(F.col("line_id").alias(c), F.col("sign").alias(s))
    most = f"cast(floor(greatest(length(s), length(t)) * {1 - similarity} + 1e-9) as int)"

    def tied(part: int) -> DataFrame:
        here = F.pmod(F.xxhash64("a"), F.lit(parts)) == part
        both = pairs.where(here).join(text("a", "s").where(here), "a").join(text("b", "t"), "b")
        return kept.keep(both.where(F.expr(f"abs(length(s) - length(t)) <= {most} AND levenshtein(s, t, {most}) >= 0")).select("a", "b"), f"{name}-tied{part}")

    return reduce(DataFrame.unionByName, [tied(i) for i in range(parts)])
