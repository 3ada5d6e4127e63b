"""Mentions of entities and topics in tokens, as joins, filters and windows.

tokens: item, segment_id, sent (numbered through the item), i (numbered through the segment), text, start, ws, pos, tag.
spans: item, segment_id, first, last (tokens, the last one excluded), label: names that an annotator found.
vocab: key (normalised), canonical, entity_type. Vocabularies are configuration files, whose size `checked` bounds."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lex
from ..functions.text import normalized_names

#: Labels of an annotator and the types they stand for; a nationality only counts where it is reviewed.
LABELS = {"PERSON": "PERSON", "ORG": "ORG", "GPE": "LOCATION", "LOC": "LOCATION", "FAC": "LOCATION"}
REVIEWED_ONLY = ("NORP",)
#: Handles, photo credits, addresses.
HANDLE = re.compile(r"(?<![A-Za-z0-9_@.])@([A-Za-z0-9_]{1,30})")
PHOTO_CREDIT = re.compile(r"\[[^\[\]\n]*(?:/|\bvia\b|\bHandout\b|\bGetty\b|\bAP Photo\b)[^\[\]\n]*\]")
URLISH = r"(?i)://|^www\.|\.(?:com|org|net|gov|io)\b"
WORD = re.compile(r"\w+(?:\.\w+|['’](?!s\b)\w+)*|['’]s\b|[^\w\s]")
END = re.compile(r"(?<=[.!?])[\"'”’)\]]*\s+(?=[\"'“‘(\[]?[A-Z0-9@#])")
MOST_ENTRIES = 100_000
SEGMENT = ["item", "segment_id"]


def checked(vocabulary: DataFrame, most: int = MOST_ENTRIES) -> DataFrame:
    """The vocabulary, broadcast if it has at most `most` entries; a larger one is joined by shuffle."""
    return F.broadcast(vocabulary) if vocabulary.limit(most + 1).count() <= most else vocabulary


def arrow_rows(df: DataFrame, f, schema: str) -> DataFrame:
    """Rows of `df` to lists of rows by a Python function, in Arrow batches."""
    names, kinds = [x.split()[0] for x in schema.split(", ")], {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x for r in batch.to_pylist() for x in f(r)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(types)], names)

    return df.mapInArrow(run, schema)


def annotate(segments: DataFrame) -> DataFrame:
    """Tokens of segments (item, ord, segment_id, text) by a rule of words and signs, without pos; sentences end at line
    breaks and after . ! ? before a capital. An annotator with a parser gives the same columns and more."""
    kind = segments.schema["item"].dataType.simpleString().replace("bigint", "long")

    def cut(r: dict) -> list[tuple]:
        out, sent, i = [], 0, 0
        for line in re.finditer(r"[^\n]+", r["text"] or ""):
            ends = [line.start() + m.end() for m in END.finditer(line[0])] + [line.end()]
            at = line.start()
            for end in ends:
                words = list(WORD.finditer(r["text"], at, end))
                for k, w in enumerate(words):
                    capital = w[0][0].isupper() and k > 0
                    out.append((r["item"], r["segment_id"], r["ord"], sent, i, w[0], w.start(), w.end() < end and r["text"][w.end()].isspace(), "PROPN" if capital else "X" if w[0][0].isalnum() or len(w[0]) > 1 else "PUNCT", "POS" if w[0] in ("'s", "’s") else ""))
                    i += 1
                sent += bool(words)
                at = end
        return out

    got = arrow_rows(segments.select("item", "segment_id", "ord", "text"), cut, f"item {kind}, segment_id string, seg int, own int, i int, text string, start int, ws boolean, pos string, tag string")
    before = got.groupBy("item", "seg").agg((F.max("own") + 1).alias("n"))
    before = before.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("item").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return got.join(before, ["item", "seg"]).withColumn("sent", (F.col("base") + F.col("own")).cast("int")).drop("base", "own", "seg")


def zones(segments: DataFrame) -> DataFrame:
    """(item, segment_id, start, end, handle) of handles and photo credits; the latter have no handle."""
    kind = segments.schema["item"].dataType.simpleString().replace("bigint", "long")

    def find(r: dict) -> list[tuple]:
        t = r["text"] or ""
        return [(r["item"], r["segment_id"], *m.span(), m[1].casefold()) for m in HANDLE.finditer(t)] + [(r["item"], r["segment_id"], *m.span(), None) for m in PHOTO_CREDIT.finditer(t)]

    return arrow_rows(segments.select(*SEGMENT, "text"), find, f"item {kind}, segment_id string, start int, end int, handle string")


def outside(found: DataFrame, taken: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Rows whose [start, end) overlaps no zone of the same segment."""
    z = taken.select(*SEGMENT, F.col(start).alias("_s"), F.col(end).alias("_e"))
    return found.join(z, (found["item"] == z["item"]) & (found["segment_id"] == z["segment_id"]) & (F.col("_s") < found[end]) & (found[start] < F.col("_e")), "left_anti")


def trimmed(first: int, last: int, label: str, words: list[dict], base: int = 0) -> tuple[int, int] | None:
    """The span (token numbers) without articles, signs, titles, a joined "ex-", a trailing "and" or possessive; Jr and Sr come back."""
    low = lambda i: words[i - base]["text"].lower()
    sign = lambda i: words[i - base]["pos"] in ("PUNCT", "SPACE") or not words[i - base]["text"].strip()
    hyphen = lambda i: words[i - base]["text"] == "-" and not words[i - base]["ws"] and not words[i - base - 1]["ws"]
    bare = lambda i: low(i).rstrip(".")
    while first < last and (low(first) in ("the", "a") or sign(first)):
        first += 1
    if last - first > 2 and low(first) in lex.FORMER and hyphen(first + 1):
        first += 2
    while last - first > 1 and low(last - 1) in ("and", "or"):
        last -= 1
    while label == "PERSON" and first < last and bare(first) in lex.TITLES:
        first += 1
    while last > first and (sign(last - 1) or words[last - 1 - base]["tag"] == "POS"):
        last -= 1
    if label == "PERSON" and last > first and last - base < len(words) and bare(last) in lex.NAME_SUFFIXES:
        last += 1
    return (first, last) if last > first else None


def shouted_us(first: int, sentence: list[dict], words: list[dict]) -> bool:
    """N8: "US" in a sentence of which 60 % is upper case, unless after "the"."""
    long = [w["text"] for w in sentence if w["text"].isalpha() and len(w["text"]) > 1]
    before = next((w["text"].lower() for w in words if w["i"] == first - 1), "")
    return sum(x.isupper() for x in long) >= 0.6 * len(long) and (first == sentence[0]["i"] or before != "the")


def span_texts(spans: DataFrame, tokens: DataFrame, segments: DataFrame) -> DataFrame:
    """Trimmed spans with sent, start, end and text; spans that nothing is left of, or that shout, go."""
    words = tokens.groupBy(*SEGMENT).agg(F.sort_array(F.collect_list(F.struct("i", "sent", "text", "start", "ws", "pos", "tag"))).alias("words"))  # a segment is bounded by the body cap
    own = spans.groupBy(*SEGMENT).agg(F.collect_list(F.struct("first", "last", "label")).alias("spans"))
    rows = words.join(own, SEGMENT).join(segments.select(*SEGMENT, F.col("text").alias("body")), SEGMENT)
    kind = segments.schema["item"].dataType.simpleString().replace("bigint", "long")

    def cut(r: dict) -> list[tuple]:
        out, words = [], r["words"]
        for s in r["spans"]:
            t = trimmed(s["first"], s["last"], s["label"], words)
            if t is None:
                continue
            a, b = words[t[0]], words[t[1] - 1]
            text = r["body"][a["start"] : b["start"] + len(b["text"])]
            if text != "US" or not shouted_us(t[0], [w for w in words if w["sent"] == a["sent"]], words):
                out.append((r["item"], r["segment_id"], a["sent"], *t, a["start"], b["start"] + len(b["text"]), text, r["body"][max(a["start"] - 1, 0) : a["start"]], s["label"]))
        return out

    return arrow_rows(rows, cut, f"item {kind}, segment_id string, sent int, first int, last int, start int, end int, text string, ahead string, label string")


def junk(text: Column, label: Column, n_tokens: Column, surface: Column) -> Column:
    """What no name looks like."""
    single = sorted(lex.TITLES | lex.ROLE_WORDS | lex.PORTFOLIOS | lex.JARGON | lex.TECH_ACRONYMS)
    first = F.split(surface, " ")[0]
    return (
        ((n_tokens == 1) & F.regexp_replace(surface, r"\.+$", "").isin(single))
        | (label.isin("PERSON", "ORG") & F.contains(text, F.lit(",")))
        | text.rlike("[" + re.escape(lex.NAME_BREAKERS) + "\n@#]")
        | ((label == "PERSON") & first.isin(sorted(lex.TECH_ACRONYMS - lex.ROLE_WORDS)))
        | (F.length(text) < 2)
        | (F.length(text) > lex.MAX_NAME_CHARS)
        | ~text.rlike(r"\p{L}")
        | surface.isin(sorted(lex.GENERIC))
        | F.lower(text).rlike("^[ur]/")
        | text.rlike(URLISH)
    )


def tagged(ahead: Column) -> Column:
    """A hash or an at sign stands before the span."""
    return ahead.isin("#", "@")


def lowercase(text: Column) -> Column:
    """No capital anywhere."""
    return (text == F.lower(text)) & (text != F.upper(text))


def lowercase_words(tokens: DataFrame) -> DataFrame:
    """Words of more than one letter that an item writes in lower case."""
    w = F.col("text")
    return tokens.where(w.rlike(r"^\p{L}{2,}$") & (w == F.lower(w))).select("item", w.alias("word")).distinct()


def without_common_words(found: DataFrame, tokens: DataFrame, names: DataFrame) -> DataFrame:
    """Drops single capitalised words that the item writes in lower case as well, unless they are reviewed names.
    found: item, text, surface, label, first, last."""
    one = (F.col("last") - F.col("first") == 1) & ~F.col("label").isin("HANDLE", "TOPIC") & F.col("text").rlike(r"^\p{Lu}\p{Ll}+$")
    low = lowercase_words(tokens).withColumnRenamed("word", "_low")
    hit = found.where(one).join(checked(names.select(F.col("key").alias("surface"))), "surface", "left_anti").select("item", "text").distinct()
    hit = hit.withColumn("_low", F.lower("text")).join(low, ["item", "_low"], "left_semi").select("item", F.col("text").alias("_text"), F.lit(True).alias("_common"))
    got = found.join(hit, (found["item"] == hit["item"]) & (found["text"] == hit["_text"]), "left").select(found["*"], "_common")
    return got.where(~(one & F.coalesce("_common", F.lit(False)))).drop("_common")


def phrases(tokens: DataFrame, patterns: DataFrame, exact: bool = False) -> DataFrame:
    """Every place of a phrase, as (item, segment_id, sent, first, last, name). patterns: words (array), name.

    Phrases of n words meet the n-word windows of the tokens in an equi-join on their text; lower case unless `exact`."""
    sizes = [r.n for r in patterns.select(F.size("words").alias("n")).distinct().collect()] or [1]  # a handful of lengths; no pattern at all finds nothing
    w = Window.partitionBy(*SEGMENT).orderBy("i")
    rows = tokens.select(*SEGMENT, "sent", "i", (F.col("text") if exact else F.lower("text")).alias("t"))
    longest = max(sizes, default=0)
    rows = rows.select("*", *[F.lead("t", k).over(w).alias(f"t{k}") for k in range(1, longest)])
    joined = F.array_join("words", "\0")
    pats = checked(patterns.select((joined if exact else F.lower(joined)).alias("gram"), "name", F.size("words").alias("n")).distinct())
    grams = F.array(*[F.when(F.col(f"t{n - 1}").isNotNull() if n > 1 else F.lit(True), F.struct(F.lit(n).alias("n"), F.concat_ws("\0", "t", *[f"t{k}" for k in range(1, n)]).alias("gram"))) for n in sizes])
    each = rows.select(*SEGMENT, "sent", "i", F.explode(grams).alias("g")).where("g IS NOT NULL").select(*SEGMENT, "sent", "i", "g.n", "g.gram")
    return each.join(pats, ["gram", "n"]).select(*SEGMENT, "sent", F.col("i").alias("first"), (F.col("i") + F.col("n")).alias("last"), "name")


def longest_first(found: DataFrame) -> DataFrame:
    """Of overlapping spans the longest, then the first: the greedy choice, segment by segment. A span that no longer or
    earlier one overlaps is taken at once; the few others are settled inside their segment."""

    def choose(r: dict) -> list[tuple]:
        used: set[int] = set()
        out = []
        for s in sorted(r["spans"], key=lambda s: (s["first"] - s["last"], s["first"], s["name"])):
            if used.isdisjoint(range(s["first"], s["last"])):
                used.update(range(s["first"], s["last"]))
                out.append((r["item"], r["segment_id"], s["sent"], s["first"], s["last"], s["name"]))
        return out

    kind = found.schema["item"].dataType.simpleString().replace("bigint", "long")
    rows = found.groupBy(*SEGMENT).agg(F.collect_list(F.struct("sent", "first", "last", "name")).alias("spans"))
    return arrow_rows(rows, choose, f"item {kind}, segment_id string, sent int, first int, last int, name string")


def topic_mentions(tokens: DataFrame, patterns: DataFrame, occupied: DataFrame | None = None) -> DataFrame:
    """Topics by phrase, case aside; the longest wins; not where an entity stands. A phrase of one verb is none."""
    found = phrases(tokens, patterns)
    if "pos" in tokens.columns:
        verbs = tokens.where(F.col("pos").isin("VERB", "AUX")).select(*SEGMENT, F.col("i").alias("first"))
        single = found.where("last = first + 1").join(verbs, [*SEGMENT, "first"], "left_anti").select(found.columns)
        found = found.where("last > first + 1").unionByName(single)
    found = longest_first(found)
    return outside(found, occupied, "first", "last") if occupied is not None else found


def named_neighbours(tokens: DataFrame) -> DataFrame:
    """Adds `beside`: a proper noun that is no title stands next to the token."""
    w = Window.partitionBy(*SEGMENT).orderBy("i")
    proper = (F.col("pos") == "PROPN") & ~F.regexp_replace(F.lower("text"), r"\.+$", "").isin(sorted(lex.TITLES))
    rows = tokens.withColumn("_p", proper)
    return rows.withColumn("beside", F.coalesce(F.lag("_p").over(w), F.lit(False)) | F.coalesce(F.lead("_p").over(w), F.lit(False))).drop("_p")


def alias_tokens(tokens: DataFrame, words: DataFrame, occupied: DataFrame, taken: DataFrame) -> DataFrame:
    """Reviewed single words in their exact case, outside other mentions and zones, beside no other proper noun.
    words: word, label; occupied: item, segment_id, first, last; taken: zones."""
    w = Window.partitionBy(*SEGMENT).orderBy("i")
    rows = named_neighbours(tokens).withColumn("ahead", F.when(~F.lag("ws").over(w), F.lag("text").over(w)))
    rows = rows.where(~F.col("beside") & ~F.coalesce(tagged(F.col("ahead")), F.lit(False)))
    found = rows.join(checked(words.withColumnRenamed("word", "text")), "text")
    found = found.select(*SEGMENT, "sent", F.col("i").alias("first"), (F.col("i") + 1).alias("last"), "start", (F.col("start") + F.length("text")).alias("end"), "text", "label")
    return outside(outside(found, occupied, "first", "last"), taken)


def without_topic_names(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """Drops spans that are exactly a topic phrase."""
    phrase = normalized_names(F.array_join("words", " ")).alias("surface")
    return found.join(checked(patterns.select(phrase).distinct()), "surface", "left_anti").select(found.columns)


def company(name: Column) -> Column:
    """A company form without its final period."""
    return F.regexp_replace(name, r"\b(" + "|".join(lex.COMPANY_SUFFIXES) + r")\.$", "$1")


def government_body(name: str) -> str | None:
    """The portfolio of a bare "X ministry" or "ministry of X"."""
    some = "|".join(lex.BODIES)
    m = re.fullmatch(rf"(?:({some}) ministry|ministry of (?:the )?((?!foreign$)(?:{some})))", name)
    part = m and (m[1] or m[2])
    return part and lex.BODY_NAMES.get(part, part.title())


def qualified_bodies(found: DataFrame, tokens: DataFrame, places: DataFrame) -> DataFrame:
    """A bare ministry gets its country: the owner inside its name ("Qatar's ..."), else the place mention right before
    it, a possessive mark aside; without one its type becomes null. found: mentions; places: key, canonical of reviewed places."""
    place = found.where("entity_type = 'LOCATION'").select(*SEGMENT, F.col("last").alias("_next"), F.col("canonical").alias("_owner"))
    marks = tokens.where("tag = 'POS'").select(*SEGMENT, F.col("i").alias("_mark"))
    owner = place.unionByName(place.join(marks, [*(place[c] == marks[c] for c in SEGMENT), place["_next"] == marks["_mark"]]).select(place["item"], place["segment_id"], (F.col("_next") + 1).alias("_next"), "_owner"))
    body = F.udf(government_body, "string")
    inside = F.regexp_extract(F.lower("canonical"), r"^(.+?)['’]s\s+(.+)$", 1)
    rest = F.regexp_extract(F.lower("canonical"), r"^(.+?)['’]s\s+(.+)$", 2)
    own = F.when(inside != "", F.regexp_extract("canonical", r"^(.+?)['’]s\s", 1))
    open_ = (F.col("entity_type") == "ORG") & ~F.col("reviewed") & F.lower("canonical").contains("ministry")
    rows = found.where(open_).withColumn("_body", body(F.when(rest != "", rest).otherwise(F.lower("canonical")))).withColumn("_own", own)
    rows = rows.join(checked(places.select(F.col("key").alias("_key"), F.col("canonical").alias("_reviewed"))), F.lower("_own") == F.col("_key"), "left").drop("_key")
    rows = rows.join(owner.dropDuplicates([*SEGMENT, "_next"]), [*(rows[c] == owner[c] for c in SEGMENT), rows["first"] == owner["_next"]], "left").drop(owner["item"]).drop(owner["segment_id"])
    who = F.coalesce("_reviewed", "_own", "_owner")
    bare = F.col("_body").isNotNull()
    rows = rows.withColumns({"canonical": F.when(bare & who.isNotNull(), F.concat("_body", F.lit(" Ministry ("), who, F.lit(")"))).otherwise(F.col("canonical")), "entity_type": F.when(bare & who.isNull(), F.lit(None)).otherwise(F.col("entity_type"))})
    return found.where(~open_ | F.col("entity_type").isNull()).unionByName(rows.select(found.columns))


def candidates(tokens: DataFrame, spans: DataFrame, segments: DataFrame, vocab: dict[str, DataFrame], keep) -> DataFrame:  # type: ignore[no-untyped-def]
    """N2-N15 in order: (item, segment_id, sent, first, last, start, end, text, surface, label, canonical, entity_type, resolution).
    `keep` writes a table and reads it again, so a step's plan doesn't hold all steps before it several times over.
    vocab: names (key, canonical, entity_type), words (word, label), handles (key, canonical, entity_type), topics (words, name)."""
    taken = keep(zones(segments), "zones")
    none = {"canonical": F.lit(None).cast("string"), "entity_type": F.lit(None).cast("string"), "resolution": F.lit(None).cast("string")}
    named = span_texts(spans.where(F.col("label").isin(*LABELS, *REVIEWED_ONLY)), tokens, segments).withColumn("surface", normalized_names(F.col("text")))
    named = named.where(~junk(F.col("text"), F.col("label"), F.col("last") - F.col("first"), F.col("surface")) & ~tagged(F.col("ahead"))).drop("ahead")
    named = keep(named, "spans")
    low = named.where(lowercase(F.col("text"))).join(checked(vocab["names"].select(F.col("key").alias("surface"))), "surface", "left_semi").select(named.columns)
    named = outside(without_topic_names(named.where(~lowercase(F.col("text"))).unionByName(low), vocab["topics"]), taken)
    cols = [*SEGMENT, "sent", "first", "last", "start", "end", "text", "surface", "label"]
    at = tokens.select(*SEGMENT, "sent", F.col("i").alias("first"), F.col("start").alias("_start"), F.col("text").alias("_text"))
    handles = taken.where("handle IS NOT NULL").join(checked(vocab["handles"].withColumnRenamed("key", "handle")), "handle")
    handles = handles.join(at, SEGMENT).where("_start < end AND start < _start + length(_text)")
    handles = handles.groupBy(*SEGMENT, "start", "end", "handle", "canonical", "entity_type").agg(F.min("sent").alias("sent"), F.min("first").alias("first"), (F.max("first") + 1).alias("last"))
    handles = handles.select(*SEGMENT, "sent", "first", "last", "start", "end", F.concat(F.lit("@"), "handle").alias("text"), F.concat(F.lit("@"), "handle").alias("surface"), F.lit("HANDLE").alias("label"), "canonical", "entity_type", F.lit("handle").alias("resolution"))
    entities = keep(named.select(*cols).withColumns(none).unionByName(handles), "entities")
    words = alias_tokens(tokens, vocab["words"], entities, taken).withColumn("surface", normalized_names(F.col("text")))
    entities = keep(entities.unionByName(words.select(*cols).withColumns(none)), "with_words")
    topics = topic_mentions(tokens, vocab["topics"], entities)
    ends = tokens.select(*SEGMENT, (F.col("i") + 1).alias("last"), (F.col("start") + F.length("text")).alias("end"))
    topics = topics.join(at.drop("sent", "_text"), [*SEGMENT, "first"]).join(ends, [*SEGMENT, "last"]).join(segments.select(*SEGMENT, F.col("text").alias("_body")), SEGMENT)
    written = F.expr("substring(_body, _start + 1, end - _start)")
    topics = topics.select(*SEGMENT, "sent", "first", "last", F.col("_start").alias("start"), "end", written.alias("text"), normalized_names(written).alias("surface"), F.lit("TOPIC").alias("label"), F.col("name").alias("canonical"), F.lit("TOPIC").alias("entity_type"))
    topics = topics.withColumn("resolution", F.when(F.col("surface") == normalized_names(F.col("canonical")), "exact").otherwise("alias"))
    return keep(without_common_words(keep(entities.unionByName(topics), "with_topics"), tokens, vocab["names"]), "candidates")
