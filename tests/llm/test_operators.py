"""Operators against brute force on small fixtures with nulls, empty and repeated rows, and clashing columns."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evigraph.llm import decontamination, jaccard_join, line_dedup, packing, repetition, sharding, substring_dedup, token_counts, toxicity, warc
from evigraph.llm.common import Kept, words
from evigraph.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, ids string"


def frame(spark, texts, **more):
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or ""), 0, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def sentence(rng, n):
    return " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) + str(rng.randrange(300)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = [sentence(rng, rng.randrange(30, 90)) for _ in range(25)]
    near = []
    for b in base[:10]:
        w = b.split()
        w[rng.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    return [*base, *near, *base[:5], None, "", "  \n ", "one two", "<|endoftext|> it's\n\n  naïve ’quoted’ 😀", "a " * 3000]


def test_packing_covers_every_token(spark, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    got = packing.pack(frame(spark, texts), path, size=256).collect()
    seen, fill = Counter(), Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert piece == bytes(r.ids) and zlib.crc32(piece) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        assert fill[r.sequence_id] == r.offset
        fill[r.sequence_id] += r.length
        seen[r.doc_id] += r.length
    assert all(seen[i] == len(x) for i, x in ids.items())
    assert all(n & (n - 1) == 0 and n <= 256 for n in fill.values())
    assert packing.pack(frame(spark, texts).limit(0), path).count() == 0


def test_token_counts_equal_the_library(spark, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rng = random.Random(2)
    odd = ["".join(rng.choices("ab'strelv 12!?\n\t é中", k=rng.randrange(700))) for _ in range(150)]
    every = texts + odd
    got = {r.doc_id: r for r in token_counts.count_tokens(frame(spark, every), path).collect()}
    for i, t in enumerate(every):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 512)


def test_repetition_counts(spark, texts):
    import re

    every = texts + ["x y\nx y\nz", "a b c d e f g h " * 4, "#$ |é é|"]
    got = {r.doc_id: r for r in repetition.judge(frame(spark, every)).collect()}
    for i, t in enumerate(every):
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        c = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        inside = {k for j in range(len(w) - 7) if c[tuple(w[j : j + 8])] > 1 for k in range(j, j + 8)}
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside))
        assert r.base_failed == (len(w) < 20 or 100 * len(inside) > 30 * len(w)) and not (r.base_failed and r.kept)


def test_shards_are_even_and_gapless(spark, texts):
    got = sharding.shard(frame(spark, texts), shards=7).collect()
    by = Counter(r.shard for r in got)
    assert len(got) == len(texts) and max(by.values()) - min(by.values()) <= 1
    for s in by:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(by[s]))
    assert all(r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) and r.size == len((texts[r.doc_id] or "").encode()) + 8 for r in got)
    assert sharding.shard(frame(spark, texts).limit(0)).count() == 0


def test_warc_round_trip(spark):
    big = "<p>" + "é" * 600 + "\r\n\r\nWARC/1.1\r\n</p>"
    rows = [(1, "http://a.example/x?y#z", big), (2, None, big), (3, "http://b.example", "short"), (4, "u", "short"), (5, "http://c.example/\r\nX: y", None), (6, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(spark, pages, with_payload=True).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    assert [got[i].response.type for i in range(1, 7)] == ["revisit", "revisit", "response", "response", "response", "response"]
    assert got[1].response.refers_to == 6 and got[1].response.payload_bytes == len(big.encode()) and got[6].response.payload == big
    assert all(r.request.record_id and r.metadata.record_id for r in got.values())


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(100, i) for i in range(101, 140)] + [(i, i + 1) for i in range(200, 240)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Kept(spark), "t").collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


def test_jaccard_join_is_exact(spark, texts):
    got = {r.doc_id: r for r in jaccard_join.near_classes(frame(spark, texts)).collect()}
    sets = {i: {tuple(words(t or "")[j : j + 5]) for j in range(max(len(words(t or "")) - 4, 1))} if words(t or "") else set() for i, t in enumerate(texts)}
    up, links = {i: i for i in sets}, Counter()

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in range(a):
            if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(a), root(b)))
                up[y] = x
    assert {i: (r.class_id, r.n_links) for i, r in got.items()} == {i: (root(i), links[i]) for i in sets}


def test_line_dedup_keeps_one(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    lines = [" ".join(rng.choices(vocabulary, k=30)) for _ in range(20)]
    docs = ["\n".join([lines[i % 20], lines[(i + 7) % 20].upper() + "!", "a b", ""]) for i in range(40)] + [None, "", "x\n\ny"]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, docs)).collect()}
    left = Counter(x.lower().rstrip("!") for r in got.values() for x in (r.text or "").split("\n") if len(x.split()) >= 5)
    assert set(left) == set(lines) and set(left.values()) == {1}
    assert got[40].text is None and got[41].text == "" and got[42].text == "x\n\ny"
    assert [r.text.split("\n").count("a b") for i, r in sorted(got.items()) if i < 40] == [1] + [0] * 39  # short lines fall to exact repeats
    clash = frame(spark, docs).selectExpr("doc_id", "text", "1 AS _id", "2 AS _mark", "3 AS gone", "4 AS d", "5 AS mark", "6 AS `a.b`")
    assert {(r.doc_id, r.text, r._id, r.gone, r.d, r["a.b"]) for r in line_dedup.dedup_lines(clash).collect()} == {(r.doc_id, r.text, 1, 3, 4, 6) for r in got.values()}
    empty = line_dedup.dedup_lines(frame(spark, docs).limit(0))
    assert empty.count() == 0 and empty.columns[-2:] == ["n_lines", "n_dropped"]
    for n in (1, 2, 5, 500, 501, 1203):
        w = rng.choices(vocabulary, k=n)
        hashes = [r.x for r in spark.createDataFrame([(x,) for x in w], "w string").select(F.xxhash64("w").alias("x")).collect()]
        row = line_dedup.profiles(spark.createDataFrame([(7, " ".join(w), n)], "line_id long, norm string, words int"), [], ["line_id"], []).collect()
        assert [(r.line_id, r.h) for r in row] == [(7, sum(1 << b for b in range(63) if 2 * sum((x >> b) & 1 for x in hashes) > n))]


def test_line_dedup_ties_fuzzy_lines(spark):
    rng = random.Random(12)
    common = ["the", "of", "and", "to", "a"]
    docs = []
    for n in (10, 20, 50, 100):
        for share in (0.1, 0.2):
            for _ in range(40):
                line = [rng.choice(common) if rng.random() < 0.4 else f"w{rng.randrange(20000)}" for _ in range(n)]
                near = list(line)
                for i in rng.sample(range(n), int(n * share)):
                    near[i] = f"x{rng.randrange(20000)}"
                docs += [" ".join(line), " ".join(near)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, docs)).collect()}
    assert all(got[i].text == docs[i] for i in range(0, len(docs), 2))  # the originals are no near copies of each other
    tied = np.array([got[i].n_dropped for i in range(1, len(docs), 2)]).reshape(4, 2, 40).mean(2)
    print(tied)
    assert (tied[:, 0] >= 0.9).all() and (tied[:, 1] >= 0.75).all() and tied.mean() >= 0.9


def test_line_dedup_verifies_few_pairs_of_a_crowded_key(spark, monkeypatch):
    rng = random.Random(23)
    base = [f"b{i}" for i in range(60)]
    docs = []
    for k in range(150):  # 18 words apart, where 12 make a near copy; every tenth has one
        line = list(base)
        for i in rng.sample(range(60), 9):
            line[i] = f"x{rng.randrange(10**6)}"
        docs.append(" ".join(line))
        if k % 10 == 0:
            docs.append(" ".join([*line[:-3], "near", "by"]))
    docs += [" ".join(f"w{rng.randrange(10**6)}" for _ in range(500)) for _ in range(160)]  # so the base's words are not common
    asked, verified = {}, line_dedup._verified

    def counted(pairs, *more):
        asked[more[-1]] = pairs.count()
        return verified(pairs, *more)

    monkeypatch.setattr(line_dedup, "_verified", counted)
    monkeypatch.setattr(line_dedup, "CROWD", 4, raising=False)
    got = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(frame(spark, docs)).collect()}
    few = asked["rest"]
    assert all(got[i] for i, d in enumerate(docs) if d.endswith("near by"))
    monkeypatch.setattr(line_dedup, "CROWD", 10**9, raising=False)  # crowded or not, the same lines fall
    assert got == {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(frame(spark, docs)).collect()} and asked["rest"] > 4 * few, (asked, few)


def test_line_dedup_splits_large_keys(spark, monkeypatch):
    rng = random.Random(29)
    base = [f"b{i}" for i in range(40)]
    docs = []
    for k in range(120):  # 16 of 40 words apart, where 8 make a near copy; every tenth has one, and words repeat
        line = [w if i % 5 else "b1" for i, w in enumerate(base)]
        for i in rng.sample(range(40), 8):
            line[i] = f"x{rng.randrange(10**6)}"
        docs.append(" ".join(line))
        if k % 10 == 0:
            docs.append(" ".join([*line[:-2], "near", "by"]))
    docs += [" ".join(f"w{rng.randrange(10**6)}" for _ in range(500)) for _ in range(100)]
    split, ids = [], line_dedup._ids
    monkeypatch.setattr(line_dedup, "_ids", lambda ids_, names, kept, name: (name == "crowd" and split.append(ids_.count())) or ids(ids_, names, kept, name))
    got = []
    for crowd, most in ((4, 10**9), (4, 8), (10**9, 10**9)):
        monkeypatch.setattr(line_dedup, "CROWD", crowd)
        monkeypatch.setattr(line_dedup, "SPLIT", most, raising=False)
        split.clear()
        got.append({r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(frame(spark, docs)).collect()})
        assert bool(split) == (crowd < most < 10**9), split  # the words of crowded lines are read again only to split a key
    assert got[0] == got[1] == got[2] and all(got[0][i] for i, d in enumerate(docs) if d.endswith("near by"))


def test_line_dedup_counts_all_words(spark, monkeypatch):
    rng = random.Random(18)
    docs = [" ".join(rng.choice([f"c{rng.randrange(300)}", f"w{rng.randrange(3000)}"]) for _ in range(12)) for _ in range(400)] + ["all equal words " + "here " * 9] * 9
    seen, profiles = [], line_dedup.profiles
    monkeypatch.setattr(line_dedup, "SAMPLE", 20)
    monkeypatch.setattr(line_dedup, "profiles", lambda texts, common, *more: seen.append(set(common)) or profiles(texts, common, *more))
    line_dedup.dedup_lines(frame(spark, docs)).count()
    count = Counter(w for d in docs for w in d.split())
    want = {w for w, c in count.items() if c * line_dedup.COMMON > sum(count.values())}
    assert len(want) > 10 and seen and all(x == want for x in seen)


def test_passages_are_found(spark):
    rng = random.Random(9)
    shared = sentence(rng, 70).split()
    docs = []
    for i in range(12):
        p = list(shared)
        if i % 3 == 1:
            p[35] = "edited"
        if i % 3 == 2:
            del p[30]
        docs.append(" ".join(sentence(rng, 60).split() + p + sentence(rng, 60).split()))
    docs += [sentence(rng, 200), None, "", docs[0]]
    got = substring_dedup.passages(frame(spark, docs)).collect()
    found = {r.doc_id for r in got} | {r.ref_doc_id for r in got}
    assert set(range(12)) | {15} <= found and 12 not in found
    assert all(r.end_word - r.start_word >= 50 and r.identity >= 0.8 for r in got)


def test_passages_whose_parts_stand_in_other_texts(spark):
    rng = random.Random(21)
    docs, pairs = [], []
    for _ in range(12):
        cut = rng.choice((2, 3))
        pieces = [sentence(rng, 66 // cut) for _ in range(cut)]
        docs += [sentence(rng, 50) + " " + p + " " + sentence(rng, 50) for p in pieces]
        pairs.append((len(docs), len(docs) + 1))
        docs += [sentence(rng, 50) + " " + " ".join(pieces) + " " + sentence(rng, 50) for _ in range(2)]
    got = substring_dedup.passages(frame(spark, docs)).collect()
    assert {tuple(sorted((r.doc_id, r.ref_doc_id))) for r in got} == set(pairs)
    rows = spark.createDataFrame([(None, docs[2]), (None, docs[2]), (7, sentence(rng, 60))], "doc_id long, text string")
    assert [r.doc_id for r in substring_dedup.passages(rows).collect()] == []


def test_passages_whose_parts_stand_apart_in_other_texts(spark):
    rng = random.Random(31)
    docs, pairs = [], []
    for k in range(12):  # the parts are edited apart, and stand in few or in many earlier texts
        pieces = [sentence(rng, 24) for _ in range(3)]
        for p in pieces:
            docs += [sentence(rng, 50) + " " + p + " " + sentence(rng, 50) for _ in range(12 if k % 2 else 1)]
        pairs.append((len(docs), len(docs) + 1))
        docs += [" ".join([sentence(rng, 50), pieces[0], sentence(rng, 4), pieces[1], sentence(rng, 4), pieces[2], sentence(rng, 50)]) for _ in range(2)]
    pieces = [sentence(rng, 40) for _ in range(2)]  # one earlier text has both parts, far from each other
    docs += [" ".join([pieces[1], sentence(rng, 200), pieces[0]]) for _ in range(12)]
    pairs.append((len(docs), len(docs) + 1))
    docs += [" ".join([sentence(rng, 50), *pieces, sentence(rng, 50)]) for _ in range(2)]
    got = substring_dedup.passages(frame(spark, docs)).collect()
    assert set(pairs) <= {tuple(sorted((r.doc_id, r.ref_doc_id))) for r in got}


def test_passages_of_words_that_repeat(spark):
    rng = random.Random(37)
    docs = [" ".join([sentence(rng, 60), *["is onhe"] * n, sentence(rng, 60)]) for n in (100, 150, 150, 120, 150, 60) * 2]
    p = sentence(rng, 60)
    docs += [" ".join([sentence(rng, 50), p, sentence(rng, 50)]), " ".join([sentence(rng, 50), p, sentence(rng, 200), p])]
    rows = substring_dedup.passages(frame(spark, docs)).collect()
    run = lambda i: {k for k, w in enumerate(docs[i].split()) if w in ("is", "onhe")}
    groups = {}
    for r in rows:
        groups.setdefault((r.doc_id, r.ref_doc_id), []).append(r)
    assert max(map(len, groups.values())) <= 4, sorted(map(len, groups.values()))
    linked = {i for pair in groups for i in pair}
    assert linked == set(range(14))
    for i in {r.doc_id for r in rows} & set(range(12)):
        assert len(run(i) - {k for r in rows if r.doc_id == i for k in range(r.start_word, r.end_word)}) <= 20
    both = next(v for k, v in groups.items() if set(k) == {12, 13})
    assert len(both) == (2 if both[0].doc_id == 13 else 1)  # each copy refers to the one that is there


def test_passages_beside_a_wide_gap(spark):
    rng = random.Random(41)
    docs = []
    for _ in range(6):
        p, q = sentence(rng, 70), sentence(rng, 70)
        docs += [" ".join([p, sentence(rng, 50), q]), " ".join([p, sentence(rng, 55), q])]
    got = substring_dedup.passages(frame(spark, docs)).collect()
    assert Counter(tuple(sorted((r.doc_id, r.ref_doc_id))) for r in got) == {(2 * i, 2 * i + 1): 2 for i in range(6)}
    assert all(r.identity >= 0.8 and 65 <= r.end_word - r.start_word <= 80 for r in got)


def test_jaccard_join_with_null_ids(spark):
    rng = random.Random(14)
    base = sentence(rng, 80).split()
    near = " ".join([*base[:40], "changed", *base[41:]])
    rows = [(None, " ".join(base)), (3, " ".join(base)), (5, " ".join(base)), (7, near), (None, sentence(rng, 60))]
    got = jaccard_join.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.class_id, r.n_links) for r in got} == {(None, 3, 3), (3, 3, 3), (5, 3, 3), (7, 3, 3), (None, None, 0)}


def test_passages_of_low_identity(spark):
    rng = random.Random(15)
    docs = []
    for n, identity in ((60, 0.9), (60, 0.85), (80, 0.85)):
        for _ in range(40):
            p = sentence(rng, n).split()
            q = list(p)
            for i in rng.sample(range(2, n - 2), round(n * (1 - identity))):
                q[i] = "edited" + str(rng.randrange(10**6))
            docs += [" ".join([sentence(rng, 70), *x, sentence(rng, 70)]) for x in (p, q)]
    got = substring_dedup.passages(frame(spark, docs)).collect()
    pairs = {tuple(sorted((r.doc_id, r.ref_doc_id))) for r in got}
    share = [np.mean([(2 * i, 2 * i + 1) in pairs for i in range(k, k + 40)]) for k in (0, 40, 80)]
    assert min(share) >= 0.9, share


def test_decontamination_finds_every_copy(spark):
    rng = random.Random(5)
    items = [sentence(rng, rng.randrange(12, 55)) + ". " + sentence(rng, 8) for _ in range(30)]
    docs, want = [], set()
    for i in range(60):
        body = sentence(rng, 120).split()
        if i % 3 == 0:
            at = rng.randrange(120)
            body[at:at] = items[i % 30].split()
            want.add((i, i % 30))
        docs.append(" ".join(body))
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(99, None), (98, "")], "item_id long, text string")
    for bound in (decontamination.SHARD_BYTES, 1500):  # in one pass and in several
        got = decontamination.search(frame(spark, [*docs, None, ""]), bench, shard_bytes=bound)
        assert {(r.doc_id, r.item_id) for r in got.where("leaked").collect()} == want


def test_decontamination_finds_short_parts(spark):
    rng = random.Random(8)
    items = [sentence(rng, 30) + ". " + sentence(rng, n) + "." for n in (1, 2, 3, 4)] + [sentence(rng, n) + ". " + sentence(rng, 30) + "." for n in (1, 2, 3, 4)]
    items += [sentence(rng, 3) + ". " + sentence(rng, 2) + "."]
    docs = [sentence(rng, 60) + " " + t + " " + sentence(rng, 60) for t in items]
    docs += [docs[i].replace(words(items[i])[-1], "other") for i in range(4)]  # the question without its answer
    docs += [" ".join([*words(items[8])[3:], sentence(rng, 20), *words(items[8])[:3]])]  # the parts apart
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontamination.search(frame(spark, docs), bench)
    assert {(r.doc_id, r.item_id) for r in got.where("leaked").collect()} == {(i, i) for i in range(len(items))}


def test_toxicity_learns(spark):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        w = [f"w{rng.randrange(60)}" for _ in range(40)]
        if bad:
            w[rng.randrange(40)] = rng.choice(["vile", "awful"])
        docs.append(" ".join(w))
        labels.append(Row(doc_id=i, toxic=int(bad)))
    frame_, marks = frame(spark, [*docs, None, ""]), spark.createDataFrame(labels)
    model = toxicity.train(frame_, marks)
    got = {r.doc_id: r for r in toxicity.score(frame_, model).collect()}
    test = [i for i in range(300) if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(302))
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in test]) > 0.95
    assert 0 <= got[300].score < 0.5 and toxicity.train(frame_, marks.limit(0)).score([["a"]])[0] < 0.5


def test_toxicity_learns_from_all_rows(spark, monkeypatch):
    rng = random.Random(26)
    texts = [" ".join([f"w{rng.randrange(60)}" for _ in range(20)] + ["vile"] * (i % 3 == 0)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, toxic int")
    docs = frame(spark, [*texts[:-1], texts[-1] + " word" * 2000])
    fits, kept = [], toxicity.Kept.keep
    monkeypatch.setattr(toxicity.Kept, "keep", lambda self, df, name: fits.append((name, kept(self, df, name))) or fits[-1][1])
    monkeypatch.setattr(toxicity.Kept, "drop", lambda self, *names: None)
    monkeypatch.setattr(toxicity, "LEAST_OF_CLASS", 10, raising=False)
    model = toxicity.train(docs, labels, rows=100, most_bytes=20_000)
    used = sum(r.n for r in dict(fits)["models"].collect())
    every = dict(fits)["labelled"]
    assert every.count() == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(400))
    assert dict(fits)["models"].count() > 1 and used == every.where("NOT fold").count()
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert np.mean([r.predicted == (i % 3 == 0) for i, r in got.items() if r.held_out]) > 0.95
