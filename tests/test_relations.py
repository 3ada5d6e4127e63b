"""The rule kernel on hand-annotated sentences: word/lemma/POS/TAG/dep/head, with {KEY:...} names over them."""

from __future__ import annotations

import pytest

from evigraph.operators import dependency as d

TYPES = {"P": "PERSON", "O": "ORG", "L": "LOCATION", "T": "TOPIC"}


def sentence(spec: str) -> tuple[str, list[dict], list[dict]]:
    """Tokens of "word|lemma|POS|TAG|dep|head" rows; a word that begins with P:, O:, L: or T: is a mention of that type, "~" joins its words."""
    tokens, mentions, text = [], [], ""
    for i, row in enumerate(spec.split()):
        word, lemma, pos, tag, dep, head, *more = row.split("|")
        kind, _, plain = word.partition(":") if word[:2] in ("P:", "O:", "L:", "T:") else ("", "", word)
        glued = plain.startswith("+")
        plain = plain.lstrip("+").replace("~", " ")
        if text and not glued:
            text += " "
        elif tokens:
            tokens[-1]["ws"] = False
        start = len(text)
        text += plain
        tokens.append({"i": i, "text": plain, "lemma": lemma or plain.lower(), "pos": pos, "tag": tag, "dep": dep, "head": int(head), "start": start, "ws": True, "ent_type": more[0] if more else ""})
        if kind:
            mentions.append({"key": f"{TYPES[kind]}:{plain.lower()}", "entity_type": TYPES[kind], "canonical": plain, "first": i, "last": i + 1, "start": start, "end": len(text)})
    return text, tokens, mentions


def found(spec: str) -> set[tuple[str, str, str]]:
    got, _ = d.relations_of(*sentence(spec))
    return {(r[4], r[0].split(":")[1], r[1].split(":")[1]) for r in got if r[4] != "mentioned_with.sentence"}


CASES = {
    "P:Ann||PROPN|NNP|nsubj|1 met|meet|VERB|VBD|ROOT|1 P:Bob||PROPN|NNP|dobj|1": {("met_with.verb", "ann", "bob")},
    "P:Ann||PROPN|NNP|nsubj|2 will||AUX|MD|aux|2 meet|meet|VERB|VB|ROOT|2 P:Bob||PROPN|NNP|dobj|2": set(),
    "P:Ann||PROPN|NNP|nsubj|3 did||AUX|VBD|aux|3 not||PART|RB|neg|3 meet|meet|VERB|VB|ROOT|3 P:Bob||PROPN|NNP|dobj|3": set(),
    "P:Ann||PROPN|NNP|nsubj|1 refused|refuse|VERB|VBD|ROOT|1 to||PART|TO|aux|3 meet|meet|VERB|VB|xcomp|1 P:Bob||PROPN|NNP|dobj|3": set(),
    "P:Ann||PROPN|NNP|nsubj|3 and||CCONJ|CC|cc|0 P:Bob||PROPN|NNP|conj|0 met|meet|VERB|VBD|ROOT|3": {("met_with.joint_subject", "ann", "bob")},
    "P:Ann||PROPN|NNP|nsubj|1 met|meet|VERB|VBD|ROOT|1 P:Bob||PROPN|NNP|dobj|1 ?||PUNCT|.|punct|1": set(),
    "P:Ann||PROPN|NNP|nsubjpass|2 was|be|AUX|VBD|auxpass|2 met|meet|VERB|VBN|ROOT|2 by||ADP|IN|agent|2 P:Bob||PROPN|NNP|pobj|3": {("met_with.passive", "ann", "bob")},
    "L:Qatar||PROPN|NNP|nsubj|1 hosted|host|VERB|VBD|ROOT|1 P:Bob||PROPN|NNP|dobj|1": {("met_with.hosted", "qatar", "bob")},
    "L:Qatar||PROPN|NNP|nsubj|1 hosts|host|VERB|VBZ|ROOT|1 O:Group||PROPN|NNP|dobj|1": set(),
    "P:Ann||PROPN|NNP|nsubj|1 held|hold|VERB|VBD|ROOT|1 talks|talk|NOUN|NNS|dobj|1 with||ADP|IN|prep|2 P:Bob||PROPN|NNP|pobj|3": {("met_with.held_talks", "ann", "bob")},
    "the||DET|DT|det|1 meeting|meeting|NOUN|NN|nsubj|6 between||ADP|IN|prep|1 P:Ann||PROPN|NNP|pobj|2 and||CCONJ|CC|cc|3 P:Bob||PROPN|NNP|conj|3 ended|end|VERB|VBD|ROOT|6": {("met_with.meeting_between", "ann", "bob")},
    "P:Ann||PROPN|NNP|poss|2 's||PART|POS|case|0 meeting|meeting|NOUN|NN|nsubj|5 with||ADP|IN|prep|2 P:Bob||PROPN|NNP|pobj|3 ended|end|VERB|VBD|ROOT|5": {("met_with.meeting_with", "ann", "bob")},
    "P:Ann||PROPN|NNP|nsubj|1 criticized|criticize|VERB|VBD|ROOT|1 L:US||PROPN|NNP|compound|3 sanctions|sanction|NOUN|NNS|dobj|1": {("criticized.object_possessor", "ann", "us")},
    "L:Oman||PROPN|NNP|nsubj|1 condemned|condemn|VERB|VBD|ROOT|1 L:Iran||PROPN|NNP|dobj|1": {("criticized.active", "oman", "iran")},
    "L:Iran||PROPN|NNP|nsubjpass|2 was|be|AUX|VBD|auxpass|2 condemned|condemn|VERB|VBN|ROOT|2 by||ADP|IN|agent|2 L:Oman||PROPN|NNP|pobj|3": {("criticized.passive", "oman", "iran")},
    "P:Ann||PROPN|NNP|nsubj|1 discussed|discuss|VERB|VBD|ROOT|1 T:trade||NOUN|NN|dobj|1": {("discussed_topic.verb", "ann", "trade")},
    "L:Iran||PROPN|NNP|nsubj|1 held|hold|VERB|VBD|ROOT|1 talks|talk|NOUN|NNS|dobj|1 on||ADP|IN|prep|2 T:trade||NOUN|NN|pobj|3": {("discussed_topic.noun", "iran", "trade")},
    "P:Ann||PROPN|NNP|nsubj|1 spoke|speak|VERB|VBD|ROOT|1 on||ADP|IN|prep|1 the||DET|DT|det|4 sidelines|sideline|NOUN|NNS|pobj|2 of||ADP|IN|prep|4 T:trade||NOUN|NN|pobj|5": set(),
    "P:Ann||PROPN|NNP|nsubj|1 is|be|AUX|VBZ|ROOT|1 the||DET|DT|det|3 CEO|ceo|NOUN|NN|attr|1 of||ADP|IN|prep|3 O:Acme||PROPN|NNP|pobj|4": {("affiliated_with.copular", "ann", "acme")},
    "P:Ann||PROPN|NNP|nsubj|1 was|be|AUX|VBD|ROOT|1 the||DET|DT|det|3 CEO|ceo|NOUN|NN|attr|1 of||ADP|IN|prep|3 O:Acme||PROPN|NNP|pobj|4": set(),
    "O:Fund||PROPN|NNP|nsubj|1 is|be|AUX|VBZ|ROOT|1 an||DET|DT|det|3 investor|investor|NOUN|NN|attr|1 in||ADP|IN|prep|3 O:Acme||PROPN|NNP|pobj|4": {("invested_in.copular", "fund", "acme")},
    "O:Acme||PROPN|NNP|nsubj|3 and||CCONJ|CC|cc|0 O:Beta||PROPN|NNP|conj|0 are|be|AUX|VBP|ROOT|3 partners|partner|NOUN|NNS|attr|3": {("partnered_with.copular", "acme", "beta")},
    "P:Ann||PROPN|NNP|nsubj|1 leads|lead|VERB|VBZ|ROOT|1 O:Acme||PROPN|NNP|dobj|1": {("affiliated_with.leads", "ann", "acme")},
    "P:Ann||PROPN|NNP|appos|0 ,||PUNCT|,|punct|0 who||PRON|WP|nsubj|3 runs|run|VERB|VBZ|relcl|0 O:Acme||PROPN|NNP|dobj|3": {("affiliated_with.runs", "ann", "acme")},
    "O:Acme||PROPN|NNP|nsubjpass|2 was|be|AUX|VBD|auxpass|2 founded|found|VERB|VBN|ROOT|2 by||ADP|IN|agent|2 P:Ann||PROPN|NNP|pobj|3": {("affiliated_with.founded", "ann", "acme")},
    "P:Ann||PROPN|NNP|nsubj|1 works|work|VERB|VBZ|ROOT|1 at||ADP|IN|prep|1 O:Acme||PROPN|NNP|pobj|2": {("affiliated_with.works_for", "ann", "acme")},
    "P:Ann||PROPN|NNP|nsubj|1 worked|work|VERB|VBD|ROOT|1 at||ADP|IN|prep|1 O:Acme||PROPN|NNP|pobj|2": set(),
    "O:Acme||PROPN|NNP|nsubj|1 agreed|agree|VERB|VBD|ROOT|1 to||PART|TO|aux|3 acquire|acquire|VERB|VB|xcomp|1 O:Beta||PROPN|NNP|dobj|3": {("acquired.verb", "acme", "beta")},
    "O:Acme||PROPN|NNP|nsubj|1 plans|plan|VERB|VBZ|ROOT|1 to||PART|TO|aux|3 acquire|acquire|VERB|VB|xcomp|1 O:Beta||PROPN|NNP|dobj|3": set(),
    "O:Beta||PROPN|NNP|nsubjpass|2 was|be|AUX|VBD|auxpass|2 bought|buy|VERB|VBN|ROOT|2 by||ADP|IN|agent|2 O:Acme||PROPN|NNP|pobj|3": {("acquired.passive", "acme", "beta")},
    "O:Acme||PROPN|NNP|poss|2 's||PART|POS|case|0 acquisition|acquisition|NOUN|NN|nsubj|5 of||ADP|IN|prep|2 O:Beta||PROPN|NNP|pobj|3 closed|close|VERB|VBD|ROOT|5": {("acquired.noun", "acme", "beta")},
    "O:Fund||PROPN|NNP|nsubj|1 invested|invest|VERB|VBD|ROOT|1 in||ADP|IN|prep|1 O:Acme||PROPN|NNP|pobj|2": {("invested_in.verb", "fund", "acme")},
    "O:Fund||PROPN|NNP|nsubj|1 took|take|VERB|VBD|ROOT|1 a||DET|DT|det|3 stake|stake|NOUN|NN|dobj|1 in||ADP|IN|prep|3 O:Acme||PROPN|NNP|pobj|4": {("invested_in.noun", "fund", "acme")},
    "O:Acme||PROPN|NNP|nsubj|1 raised|raise|VERB|VBD|ROOT|1 funding|funding|NOUN|NN|dobj|1 from||ADP|IN|prep|1 O:Fund||PROPN|NNP|pobj|3": {("invested_in.raised_from", "fund", "acme")},
    "O:Acme||PROPN|NNP|nsubj|1 raised|raise|VERB|VBD|ROOT|1 money|money|NOUN|NN|dobj|1 in||ADP|IN|prep|1 a||DET|DT|det|5 round|round|NOUN|NN|pobj|3 led|lead|VERB|VBN|acl|5 by||ADP|IN|agent|6 O:Fund||PROPN|NNP|pobj|7": {("invested_in.round_led_by", "fund", "acme")},
    "O:Fund||PROPN|NNP|nsubj|1 turned|turn|VERB|VBD|ROOT|1 down||ADP|RP|prt|1 an||DET|DT|det|4 investment|investment|NOUN|NN|dobj|1 in||ADP|IN|prep|4 O:Acme||PROPN|NNP|pobj|5": set(),
    "O:Acme||PROPN|NNP|nsubj|1 announces|announce|VERB|VBZ|ROOT|1 O:Gem||PROPN|NNP|compound|3 model|model|NOUN|NN|dobj|1": {("released.product", "acme", "gem")},
    "O:Acme||PROPN|NNP|nsubj|1 released|release|VERB|VBD|ROOT|1 O:Ship||PROPN|NNP|dobj|1": set(),
    "O:Acme||PROPN|NNP|nsubj|1 teamed|team|VERB|VBD|ROOT|1 up||ADP|RP|prt|1 with||ADP|IN|prep|1 O:Beta||PROPN|NNP|pobj|3": {("partnered_with.verb", "acme", "beta")},
    "O:Acme||PROPN|NNP|nsubj|3 and||CCONJ|CC|cc|0 O:Beta||PROPN|NNP|conj|0 partnered|partner|VERB|VBD|ROOT|3": {("partnered_with.joint_subject", "acme", "beta")},
    "O:Acme||PROPN|NNP|nsubj|1 signed|sign|VERB|VBD|ROOT|1 a||DET|DT|det|3 deal|deal|NOUN|NN|dobj|1 with||ADP|IN|prep|3 O:Beta||PROPN|NNP|pobj|4": {("partnered_with.deal", "acme", "beta")},
    "a||DET|DT|det|1 deal|deal|NOUN|NN|nsubj|6 between||ADP|IN|prep|1 O:Acme||PROPN|NNP|pobj|2 and||CCONJ|CC|cc|3 O:Beta||PROPN|NNP|conj|3 closed|close|VERB|VBD|ROOT|6": {("partnered_with.deal_between", "acme", "beta")},
    "O:Acme||PROPN|NNP|poss|2 's||PART|POS|case|0 partnership|partnership|NOUN|NN|nsubj|5 with||ADP|IN|prep|2 O:Beta||PROPN|NNP|pobj|3 grew|grow|VERB|VBD|ROOT|5": {("partnered_with.deal_with", "acme", "beta")},
    "O:Acme||PROPN|NNP|nsubjpass|2 was|be|AUX|VBD|auxpass|2 sanctioned|sanction|VERB|VBN|ROOT|2 by||ADP|IN|agent|2 L:UK||PROPN|NNP|pobj|3": {("sanctioned.passive", "uk", "acme")},
    "L:UK||PROPN|NNP|nsubj|1 sanctioned|sanction|VERB|VBD|ROOT|1 firms|firm|NOUN|NNS|dobj|1 including||ADP|VBG|prep|2 O:Acme||PROPN|NNP|pobj|3": {("sanctioned.verb", "uk", "acme")},
    "L:UK||PROPN|NNP|nsubj|1 imposed|impose|VERB|VBD|ROOT|1 sanctions|sanction|NOUN|NNS|dobj|1 on||ADP|IN|prep|2 L:Iran||PROPN|NNP|pobj|3": {("sanctioned.imposed", "uk", "iran")},
    "L:UK||PROPN|NNP|nsubj|1 lifted|lift|VERB|VBD|ROOT|1 L:EU||PROPN|NNP|compound|3 sanctions|sanction|NOUN|NNS|dobj|1 on||ADP|IN|prep|3 L:Iran||PROPN|NNP|pobj|4": set(),
    "L:Iran||PROPN|NNP|nsubj|1 is|be|AUX|VBZ|ROOT|1 under||ADP|IN|prep|1 L:US||PROPN|NNP|compound|4 sanctions|sanction|NOUN|NNS|pobj|2": {("sanctioned.noun", "us", "iran")},
    "L:Israel||PROPN|NNP|nsubj|1 bombed|bomb|VERB|VBD|ROOT|1 L:Gaza||PROPN|NNP|dobj|1": {("attacked.verb", "israel", "gaza")},
    "L:Gaza||PROPN|NNP|nsubjpass|2 was|be|AUX|VBD|auxpass|2 bombed|bomb|VERB|VBN|ROOT|2 by||ADP|IN|agent|2 L:Israel||PROPN|NNP|pobj|3": {("attacked.passive", "israel", "gaza")},
    "L:China||PROPN|NNP|nsubj|1 attacked|attack|VERB|VBD|ROOT|1 L:US||PROPN|NNP|dobj|1 over||ADP|IN|prep|1 tariffs|tariff|NOUN|NNS|pobj|3": set(),
    "L:Iran||PROPN|NNP|nsubj|1 launched|launch|VERB|VBD|ROOT|1 dozens|dozen|NOUN|NNS|dobj|1 of||ADP|IN|prep|2 strikes|strike|NOUN|NNS|pobj|3 on||ADP|IN|prep|4 L:US||PROPN|NNP|compound|7 bases|base|NOUN|NNS|pobj|5": {("attacked.launched", "iran", "us")},
    "L:Iran||PROPN|NNP|poss|2 's||PART|POS|case|0 invasion|invasion|NOUN|NN|nsubj|5 of||ADP|IN|prep|2 L:Kuwait||PROPN|NNP|pobj|3 failed|end|VERB|VBD|ROOT|5": {("attacked.noun", "iran", "kuwait")},
    "P:Ann||PROPN|NNP|nsubj|1 attacked|attack|VERB|VBD|ROOT|1 O:Acme||PROPN|NNP|dobj|1": set(),
    "P:Ann||PROPN|NNP|nsubj|1 told|tell|VERB|VBD|ROOT|1 O:Reuters||PROPN|NNP|dobj|1": {("quoted_by.tell", "ann", "reuters")},
    "P:Ann||PROPN|NNP|nsubj|1 told|tell|VERB|VBD|ROOT|1 O:IAEA||PROPN|NNP|dobj|1": set(),
    "P:Ann||PROPN|NNP|nsubj|1 told|tell|VERB|VBD|ROOT|1 O:Reuters||PROPN|NNP|dobj|1 to||PART|TO|aux|4 leave|leave|VERB|VB|xcomp|1": set(),
    "P:Ann||PROPN|NNP|nsubj|1 confirmed|confirm|VERB|VBD|ROOT|1 to||ADP|IN|prep|1 the||DET|DT|det|5 O:Reuters||PROPN|NNP|compound|5 agency|agency|NOUN|NN|pobj|2": {("quoted_by.confirm", "ann", "reuters")},
    "P:Ann||PROPN|NNP|nsubj|1 spoke|speak|VERB|VBD|ROOT|1 to||ADP|IN|prep|1 O:CNN||PROPN|NNP|pobj|2": {("quoted_by.speak", "ann", "cnn")},
    "P:Ann||PROPN|NNP|nsubj|1 said|say|VERB|VBD|ROOT|1 in||ADP|IN|prep|1 an||DET|DT|det|4 interview|interview|NOUN|NN|pobj|2 with||ADP|IN|prep|4 O:CNN||PROPN|NNP|pobj|5": {("quoted_by.say", "ann", "cnn")},
    "P:Ann||PROPN|NNP|nsubjpass|2 was|be|AUX|VBD|auxpass|2 quoted|quote|VERB|VBN|ROOT|2 by||ADP|IN|agent|2 O:BBC||PROPN|NNP|pobj|3": {("quoted_by.passive", "ann", "bbc")},
    "O:Acme||PROPN|NNP|compound|1 CEO|ceo|NOUN|NN|compound|2 P:Ann||PROPN|NNP|nsubj|3 left|leave|VERB|VBD|ROOT|3": {("affiliated_with.title", "ann", "acme")},
    "former||ADJ|JJ|amod|2 O:Acme||PROPN|NNP|compound|2 CEO|ceo|NOUN|NN|compound|3 P:Ann||PROPN|NNP|nsubj|4 left|leave|VERB|VBD|ROOT|4": set(),
    "O:Acme||PROPN|NNP|compound|1 investor|investor|NOUN|NN|compound|2 O:Fund||PROPN|NNP|nsubj|3 left|leave|VERB|VBD|ROOT|3": {("invested_in.title", "fund", "acme")},
    "O:Acme||PROPN|NNP|poss|2 's||PART|POS|case|0 P:Ann||PROPN|NNP|nsubj|3 left|leave|VERB|VBD|ROOT|3": {("affiliated_with.possessive", "ann", "acme")},
    "P:Ann||PROPN|NNP|nsubj|3 of||ADP|IN|prep|0 O:Acme||PROPN|NNP|pobj|1 left|leave|VERB|VBD|ROOT|3": {("affiliated_with.of", "ann", "acme")},
    "P:Ann||PROPN|NNP|nsubj|6 ,||PUNCT|,|punct|0 O:Acme||PROPN|NNP|poss|4 's||PART|POS|case|2 chief|chief|NOUN|NN|appos|0 ,||PUNCT|,|punct|0 left|leave|VERB|VBD|ROOT|6": {("affiliated_with.appositive", "ann", "acme")},
    "O:Fund||PROPN|NNP|nsubj|6 ,||PUNCT|,|punct|0 investor|investor|NOUN|NN|appos|0 in||ADP|IN|prep|2 O:Acme||PROPN|NNP|pobj|3 ,||PUNCT|,|punct|0 left|leave|VERB|VBD|ROOT|6": {("invested_in.appositive", "fund", "acme")},
    "O:Acme||PROPN|NNP|nsubj|6 ,||PUNCT|,|punct|0 O:Beta||PROPN|NNP|poss|4 's||PART|POS|case|2 partner|partner|NOUN|NN|appos|0 ,||PUNCT|,|punct|0 left|leave|VERB|VBD|ROOT|6": {("partnered_with.appositive", "acme", "beta")},
    "P:Ann||PROPN|NNP|nsubj|1 met|meet|VERB|VBD|ROOT|1 P:Bob||PROPN|NNP|dobj|1 to||PART|TO|aux|4 discuss|discuss|VERB|VB|advcl|1 T:trade||NOUN|NN|dobj|4": {("met_with.verb", "ann", "bob"), ("discussed_topic.verb", "ann", "trade"), ("discussed_topic.verb", "bob", "trade")},
    "O:Ministry||PROPN|NNP|nsubj|1 released|release|VERB|VBD|ROOT|1 a||DET|DT|det|3 statement|statement|NOUN|NN|dobj|1 condemning|condemn|VERB|VBG|acl|3 L:Iran||PROPN|NNP|dobj|4": {("criticized.active", "ministry", "iran")},
    "rumours|rumour|NOUN|NNS|ROOT|0 that||SCONJ|IN|mark|3 O:Acme||PROPN|NNP|nsubj|3 bought|buy|VERB|VBD|acl|0 O:Beta||PROPN|NNP|dobj|3": set(),
    "L:Oman||PROPN|NNP|nsubj|1 called|call|VERB|VBD|ROOT|1 for||ADP|IN|prep|1 L:US||PROPN|NNP|compound|4 sanctions|sanction|NOUN|NNS|pobj|2 on||ADP|IN|prep|4 L:Iran||PROPN|NNP|pobj|5": set(),
}


@pytest.mark.parametrize("spec", CASES)
def test_rules(spec):
    assert found(spec) == CASES[spec]


def test_every_rule_has_a_case():
    named = {r for want in CASES.values() for r, _, _ in want}
    assert {r.id for r in d.RULES} <= named and len(named) == 45 + 7


def test_cooccurrence_and_window():
    got, many = d.relations_of(*sentence("P:Bob||PROPN|NNP|dep|1 and||CCONJ|CC|ROOT|1 P:Ann||PROPN|NNP|dep|1 saw||VERB|VBD|dep|1 T:x||NOUN|NN|dep|1 T:y||NOUN|NN|dep|1"))
    assert {(r[0], r[1]) for r in got} == {("PERSON:ann", "PERSON:bob"), ("PERSON:bob", "TOPIC:x"), ("PERSON:bob", "TOPIC:y"), ("PERSON:ann", "TOPIC:x"), ("PERSON:ann", "TOPIC:y")} and not many
    nine = " ".join(f"P:N{i}||PROPN|NNP|dep|0" for i in range(9))
    assert d.relations_of(*sentence(nine)) == ([], 9)
    text, tokens, mentions = sentence(" ".join(["word||X|X|dep|0"] * 150 + ["P:Ann||PROPN|NNP|dep|0", "P:Bob||PROPN|NNP|dep|0"] + ["word||X|X|dep|0"] * 150))
    (r,), _ = d.relations_of(text, tokens, mentions)
    assert r[7] - r[6] <= 500 and "Ann Bob" in text[r[6] : r[7]] and text[r[6] : r[7]].strip() == text[r[6] : r[7]]


def test_relations_of_tables(spark):
    tokens, mentions, segments = [], [], []
    for sent, spec in enumerate(["P:Ann||PROPN|NNP|nsubj|1 met|meet|VERB|VBD|ROOT|1 P:Bob||PROPN|NNP|dobj|1", "P:Ann||PROPN|NNP|dep|1 saw|see|VERB|VBD|ROOT|1 P:Bob||PROPN|NNP|dep|1"]):
        text, ts, ms = sentence(spec)
        segments.append((1, f"s{sent}", text))
        tokens += [{"item": 1, "segment_id": f"s{sent}", "sent": sent, **t} for t in ts]
        mentions += [{"item": 1, "segment_id": f"s{sent}", "sent": sent, **m} for m in ms]
    t = spark.createDataFrame(tokens, "item long, segment_id string, sent int, " + d.TOKEN)
    m = spark.createDataFrame(mentions, "item long, segment_id string, sent int, " + d.MENTION)
    got = d.kept_relations(d.relations(t, m, spark.createDataFrame(segments, "item long, segment_id string, text string"))).collect()
    assert [(r.relation_type, r.directed, r.evidence_text, r.rule_id) for r in got] == [("met_with", False, "Ann met Bob", "met_with.verb")]
    assert d.relations(t.limit(0), m, spark.createDataFrame(segments, "item long, segment_id string, text string")).count() == 0
