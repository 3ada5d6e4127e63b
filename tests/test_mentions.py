"""N1-N17 and I1-I9 on small items, through the annotator without a parser or with given tokens."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evigraph.operators import identity, mentions
from evigraph.operators.store import Scratch
from evigraph.plans.ingest import extracted, gazetteer
from evigraph.sources.config import parse_vocabulary

VOCABULARY = parse_vocabulary(
    {
        "entities": [
            {"canonical": "Elon Musk", "type": "PERSON", "handles": ["@elonmusk"]},
            {"canonical": "United Nations", "type": "ORG", "aliases": ["UN", "U.N."]},
            {"canonical": "Delhi", "type": "LOCATION"},
            {"canonical": "Acme Corp", "type": "ORG", "aliases": ["Acme"]},
        ]
    },
    {"topics": [{"name": "nuclear talks", "patterns": ["nuclear talks", "nuclear"]}, {"name": "trade", "patterns": ["trade war", "tariffs"]}]},
)


def segments(spark, *texts):
    return spark.createDataFrame([(1, i, f"s{i}", t) for i, t in enumerate(texts)], "item long, ord int, segment_id string, text string")


def named(spark, spans_of, *texts, names=()):
    """Mentions of texts whose spans (words, label) an annotator found."""
    seg = segments(spark, *texts)
    vocab = VOCABULARY.frames(spark)

    def annotator(s, v):
        tokens, _ = gazetteer(s, v)
        words = spark.createDataFrame([(mentions.WORD.findall(w), label) for w, label in spans_of], "words array<string>, name string")
        spans = mentions.phrases(tokens, words, exact=True)
        return tokens, spans.select("item", "segment_id", "first", "last", F.col("name").alias("label"))

    got, related, warnings = extracted(seg, vocab, Scratch(spark), annotator)
    return got, related, warnings


def test_whole_item(spark):
    got, related, _ = extracted(segments(spark, "Elon Musk met people in Delhi. Later Musk criticized the UN. @elonmusk posted on nuclear talks and a trade war."), VOCABULARY.frames(spark), Scratch(spark))
    rows = {(r.name, r.key, r.resolution) for r in got.collect()}
    assert rows == {("Elon Musk", "PERSON:elon musk", "exact"), ("Delhi", "LOCATION:delhi", "exact"), ("Musk", "PERSON:elon musk", "surname"), ("UN", "ORG:united nations", "alias"), ("@elonmusk", "PERSON:elon musk", "handle"), ("nuclear talks", "TOPIC:nuclear talks", "exact"), ("trade war", "TOPIC:trade", "alias")}
    pairs = {(r.source_key, r.target_key) for r in related.collect()}
    assert pairs == {("LOCATION:delhi", "PERSON:elon musk"), ("ORG:united nations", "PERSON:elon musk"), ("PERSON:elon musk", "TOPIC:nuclear talks"), ("PERSON:elon musk", "TOPIC:trade")}
    assert all(r.evidence_text for r in related.collect())


def test_filters(spark):
    text = "The Foreign Ministry spoke. Iran's Foreign Ministry spoke. Strikes hit; strikes go on. #Delhi is a tag. [Photo: Delhi/AFP] Shipoil Ltd. sails. See user@elonmusk.com or AI."
    got, _, _ = named(spark, [("Foreign Ministry", "ORG"), ("Iran", "GPE"), ("Strikes", "ORG"), ("Shipoil Ltd.", "ORG"), ("AI", "ORG"), ("The Foreign Ministry", "ORG")], text)
    assert {(r.name, r.canonical_name) for r in got.collect()} == {("Iran", "Iran"), ("Foreign Ministry", "Foreign Ministry (Iran)"), ("Shipoil Ltd", "Shipoil Ltd")}


def test_names_of_an_item(spark):
    text = "Sam Altman and Melania Trump spoke. Altman left. Donald Trump came. Trump spoke. The Ministry of Intelligence and Security (MOIS) denied it. Later MOIS agreed."
    got, _, warnings = named(spark, [("Sam Altman", "PERSON"), ("Melania Trump", "PERSON"), ("Donald Trump", "PERSON"), ("Trump", "PERSON"), ("Altman", "PERSON"), ("Ministry of Intelligence and Security", "ORG")], text)
    rows = {(r.name, r.canonical_name, r.entity_type) for r in got.collect()}
    assert {("Altman", "Sam Altman", "PERSON"), ("MOIS", "Ministry of Intelligence and Security", "ORG")} <= rows and not any(n == "Trump" for n, _, _ in rows)
    assert [r.warning for r in warnings.collect()] == ["Ambiguous surname 'Trump' left unresolved: Donald Trump, Melania Trump"]


def test_pieces(spark):
    words = lambda *ws: [{"text": w, "pos": "PUNCT" if not w[0].isalnum() else "X", "tag": "POS" if w == "'s" else "", "ws": w != "Ex" and w != "-", "i": i} for i, w in enumerate(ws)]
    assert mentions.trimmed(0, 4, "PERSON", words("the", "President", "Joe", "Biden")) == (2, 4)
    assert mentions.trimmed(0, 2, "PERSON", words("Donald", "Trump", "Jr.")) == (0, 3)
    assert mentions.trimmed(0, 3, "ORG", words("Ex", "-", "Google")) == (2, 3) and mentions.trimmed(0, 2, "ORG", words("the", ",")) is None
    assert mentions.trimmed(0, 3, "ORG", words("Acme", "'s", "and")) == (0, 1)
    shout = [{"text": w, "i": i} for i, w in enumerate("LET US BE CLEAR".split())]
    assert mentions.shouted_us(1, shout, shout) and not mentions.shouted_us(1, [{"text": "THE", "i": 0}, *shout[1:]], [{"text": "THE", "i": 0}, *shout[1:]])
    assert identity.initials_match("MOIS", "Ministry of Intelligence and Security") and not identity.initials_match("MOX", "Ministry of Intelligence")
    assert [mentions.government_body(x) for x in ("foreign ministry", "ministry of the interior", "ministry of foreign affairs", "oil company")] == ["Foreign", "Interior", "Foreign", None]
    rows = [("CEO", "ORG", 1), ("Acme/AFP", "ORG", 1), ("A, B", "PERSON", 3), ("Acme Corp", "ORG", 2), ("12", "ORG", 1), ("government", "ORG", 1), ("r/news", "ORG", 1), ("www.x.com", "ORG", 1), ("MOU Violations", "PERSON", 2)]
    df = spark.createDataFrame(rows, "t string, l string, n int")
    assert [r[0] for r in df.select(mentions.junk(F.col("t"), F.col("l"), F.col("n"), F.lower("t"))).collect()] == [True, True, True, False, True, True, True, True, True]


def test_longest_topic_wins(spark):
    seg = segments(spark, "Nuclear talks and nuclear power, talks nuclear.")
    got = mentions.topic_mentions(mentions.annotate(seg), VOCABULARY.frames(spark)["topics"]).collect()
    assert sorted((r.first, r["last"], r.name) for r in got) == [(0, 2, "nuclear talks"), (3, 4, "nuclear talks"), (7, 8, "nuclear talks")]


def test_annotator(spark):
    got = mentions.annotate(segments(spark, 'He left. "Why?" she asked\nNew line', "Second")).orderBy("sent", "i").collect()
    assert [(r.sent, r.text) for r in got] == [(0, "He"), (0, "left"), (0, "."), (1, '"'), (1, "Why"), (1, "?"), (1, '"'), (1, "she"), (1, "asked"), (2, "New"), (2, "line"), (3, "Second")]
    assert all(r.text == ('He left. "Why?" she asked\nNew line' if r.segment_id == "s0" else "Second")[r.start : r.start + len(r.text)] for r in got)


def test_vocabulary_tables(spark):
    rows = {(r.key, r.alias_key, r.alias_kind) for r in identity.reviewed_aliases(VOCABULARY.frames(spark)["entries"]).collect()}
    assert rows == {("PERSON:elon musk", "@elonmusk", "handle"), ("PERSON:elon musk", "elonmusk", "handle"), ("ORG:united nations", "un", "abbreviation"), ("ORG:united nations", "u.n.", "abbreviation"), ("ORG:acme corp", "acme", "alias")}
    bad = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("", "z")], "key string, target string")
    assert {r.key for r in identity.conflicts(bad).collect()} == {"a", ""}
    for aliases, topics in (({"entities": [{"canonical": "A", "type": "ORG", "aliases": ["x"]}, {"canonical": "B", "type": "ORG", "aliases": ["X"]}]}, {}), ({"entities": [{"canonical": "A", "type": "ORG", "aliases": [" "]}]}, {}), ({}, {"topics": [{"name": "a", "patterns": ["p"]}, {"name": "b", "patterns": ["P"]}]}), ({"entities": [{"canonical": "A", "type": "THING"}]}, {})):
        with pytest.raises(ValueError):
            parse_vocabulary(aliases, topics)
