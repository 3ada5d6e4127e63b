"""Typed relations from annotated sentences, as a table of rules over a dependency tree.

The tokens come from any annotator that gives lemma, pos, tag, dep and head; no parser is part of this engine. A rule
names its trigger and four functions of the tree: the tokens it looks at, the two ends, and a condition. Sentences are
independent, so the kernel runs over Arrow batches of whole sentences without a shuffle of its own."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations, product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lex
from ..functions.text import normalize_name

TOKEN = "i int, text string, lemma string, pos string, tag string, dep string, head int, start int, ws boolean, ent_type string"
MENTION = "key string, entity_type string, canonical string, first int, last int, start int, end int"
EVENT_PREPS = ("on", "against")
OUTSIDE_PHRASE = {"relcl", "acl", "advcl", "ccomp", "xcomp", "parataxis", "punct"}


@dataclass(eq=False)
class Mention:
    key: str
    entity_type: str
    canonical: str
    first: int
    last: int
    start: int
    end: int


class Sentence:
    """One sentence: tokens by position in the segment, children, and the mention at each token."""

    def __init__(self, tokens: list[dict], mentions: list[dict]):
        self.tok = {t["i"]: t for t in tokens}
        self.order = sorted(self.tok)
        self.kids_of: dict[int, list[int]] = {i: [] for i in self.order}
        for i in self.order:
            h = self.tok[i]["head"]
            if h != i and h in self.kids_of:
                self.kids_of[h].append(i)
        inside = [Mention(**m) for m in mentions if m["first"] in self.tok and m["last"] - 1 in self.tok]
        self.at = {i: m for m in inside for i in range(m.first, m.last)}
        self.mentions = sorted({id(m): m for m in self.at.values()}.values(), key=lambda m: m.start)

    # single tokens
    def lemma(self, t: int) -> str:
        return (self.tok[t]["lemma"] or "").lower()

    def low(self, t: int) -> str:
        return self.tok[t]["text"].lower()

    def dep(self, t: int) -> str:
        return self.tok[t]["dep"]

    def tag(self, t: int) -> str:
        return self.tok[t]["tag"]

    def pos(self, t: int) -> str:
        return self.tok[t]["pos"]

    def head(self, t: int) -> int:
        h = self.tok[t]["head"]
        return h if h in self.tok else t

    def joins(self, t: int) -> bool:
        """A hyphen without space on either side."""
        before = self.tok.get(t - 1)
        return t in self.tok and self.tok[t]["text"] == "-" and not self.tok[t]["ws"] and before is not None and not before["ws"]

    # P1, P2
    def kids(self, t: int, *deps: str) -> list[int]:
        return [c for c in self.kids_of[t] if self.dep(c) in deps]

    def prep(self, t: int, *words: str) -> list[int]:
        return [o for c in self.kids(t, "prep") if self.low(c) in words for o in self.kids(c, "pobj")]

    def agents(self, t: int) -> list[int]:
        return [o for c in self.kids(t, "agent") for o in self.kids(c, "pobj")]

    def to_infinitive(self, t: int) -> bool:
        return any(self.tag(c) == "TO" for c in self.kids(t, "aux"))

    def particle(self, t: int, word: str) -> bool:
        return any(self.low(c) == word for c in self.kids(t, "prt"))

    def subtree(self, t: int) -> list[int]:
        found, todo = [], [t]
        while todo:
            x = todo.pop()
            found.append(x)
            todo += self.kids_of[x]
        return sorted(found)

    def ancestors(self, t: int) -> Iterator[int]:
        seen = {t}
        while (t := self.head(t)) not in seen:
            seen.add(t)
            yield t

    # P3, P4
    def resolved(self, verb: int, tokens: list[int]) -> list[int]:
        """Relative pronouns of a relative clause stand for the noun it modifies."""
        if self.dep(verb) != "relcl":
            return tokens
        return [self.head(verb) if self.low(t) in lex.RELATIVE_PRONOUNS and self.tag(t) in ("WP", "WDT") else t for t in tokens]

    def passive(self, verb: int) -> list[int]:
        return self.resolved(verb, self.kids(verb, "nsubjpass"))

    def subjects(self, verb: int) -> list[int]:
        own, up, dep = self.resolved(verb, self.kids(verb, "nsubj")), self.head(verb), self.dep(verb)
        if own or up == verb:
            return own
        if dep == "xcomp":
            return [o for o in self.kids(up, "dobj") if self.pos(o) in ("PROPN", "PRON")] or self.subjects(up)
        shared = dep == "conj" or (dep == "advcl" and (self.to_infinitive(verb) or (self.tag(verb) == "VBG" and not self.kids(verb, "mark"))))
        if shared:
            return self.subjects(up)
        if dep == "acl" and self.tag(verb) == "VBD":
            return [up]
        if dep == "acl" and self.tag(verb) == "VBG" and self.dep(up) == "dobj" and self.lemma(up) in lex.STATEMENT_NOUNS:
            return self.subjects(self.head(up))
        return []

    # P5
    def ents(self, tokens: Iterable[int], *types: str) -> list[Mention]:
        found: list[Mention] = []
        for t in tokens:
            if t in self.at:
                found.append(self.at[t])
            found += self.ents([c for c in self.kids(t, "appos") if c in self.at]) + self.ents(self.kids(t, "conj"))
        return [m for m in found if not types or m.entity_type in types]

    # P6, P7
    def blocked(self, t: int) -> bool:
        tests = {
            "neg": lambda c: True,
            "aux": lambda c: self.tag(c) == "MD",
            "mark": lambda c: self.low(c) in lex.CONDITIONAL_MARKS,
            "det": lambda c: self.low(c) in lex.BLOCKING_DETERMINERS,
            "amod": lambda c: self.low(c) in lex.PLANNED_MODIFIERS or self.lemma(c) in lex.PLANNED_LEMMAS,
        }
        tests["acl"] = tests["amod"]
        return any(self.dep(c) in tests and tests[self.dep(c)](c) for c in self.kids_of[t])

    def refused(self, t: int) -> bool:
        return any((self.lemma(t), self.low(c)) in lex.PHRASAL_SUPPRESSORS for c in self.kids(t, "prt"))

    def _verdict(self, t: int, allow: frozenset[str]) -> bool | None:
        """What the link from t to its head says: suppressed, asserted, or undecided so far."""
        dep, up, inf = self.dep(t), self.head(t), self.to_infinitive(t)
        lemma = self.lemma(up)
        hearsay = self.pos(up) == "NOUN" and lemma in lex.HEARSAY_NOUNS
        if dep in ("nsubj", "nsubjpass"):
            return False if self.pos(t) != "NOUN" else True if lemma in lex.UNREALIZED_HEADS else None
        if dep == "prep":
            heads = {"for": lex.FOR_HEADS, "from": lex.FROM_HEADS}.get(self.low(t), ())
            return True if lemma in heads else None
        if dep == "acl":
            return True if hearsay or (inf and lemma not in allow) else None if inf else False
        if dep == "xcomp" or (dep == "advcl" and inf):
            governed = lemma in lex.SUPPRESSING_HEADS or (inf and lemma in lex.INFINITIVE_HEADS)
            return True if governed and lemma not in allow else None
        if dep in ("ccomp", "dobj", "pcomp", "conj"):
            if dep == "conj" and self.kids(t, "nsubj", "nsubjpass"):
                return False
            return True if (lemma in lex.SUPPRESSING_HEADS and lemma not in allow) or (dep == "ccomp" and hearsay) else None
        return None if dep == "pobj" else False

    def suppressed(self, t: int, allow: frozenset[str] = frozenset()) -> bool:
        """Negated, modal, conditional, planned, refused, denied or demanded: looked for up to eight links towards the root."""
        for _ in range(8):
            if self.blocked(t) or self.refused(t):
                return True
            if self.head(t) == t:
                return self.to_infinitive(t)
            verdict = self._verdict(t, allow)
            if verdict is not None:
                return verdict
            t = self.head(t)
        return False

    # P8
    def phrase(self, t: int) -> set[int]:
        found, todo = set(), [t]
        while todo:
            x = todo.pop()
            found.add(x)
            todo += [c for c in self.kids_of[x] if self.dep(c) not in OUTSIDE_PHRASE and (self.dep(c) != "prep" or self.low(c) in lex.INNER_TOPIC_PREPS)]
        return found

    def topics(self, tokens: Iterable[int], *alone: int) -> list[Mention]:
        region = set(alone)
        for t in tokens:
            if self.dep(t) != "prep":
                region |= self.phrase(t)
                continue
            for o in self.kids(t, "pobj"):
                if not {self.lemma(o), self.low(o)} & lex.SETTING_NOUNS:
                    region |= self.phrase(o)
        return [m for i, m in self.at.items() if i in region and m.entity_type == "TOPIC"]

    # P9-P12
    def role_orgs(self, role: int, *preps: str) -> list[Mention]:
        if any(self.low(c) in lex.FORMER for c in self.kids_of[role]):
            return []
        left = [x for c in self.kids_of[role] if c < role for x in self.subtree(c)]
        found = [self.at[x] for x in left if x in self.at] + self.ents(self.prep(role, *(preps or ("of", "at", "for"))))
        stands_for = self.lemma(role) in lex.REPRESENTATIVE_ROLES and any(m.entity_type == "LOCATION" for m in found)
        return [] if stands_for else [m for m in found if m.entity_type == "ORG"]

    def acts(self, t: int) -> bool:
        """An organisation, or a place written as an abbreviation, before an event noun names who acted."""
        m = self.at.get(t)
        if m is None or m.entity_type not in ("ORG", "LOCATION"):
            return False
        written = "".join(self.tok[i]["text"] for i in range(m.first, m.last)).replace(".", "")
        return m.entity_type == "ORG" or written.isupper()

    def is_place(self, t: int) -> bool:
        return t in self.at and self.at[t].entity_type == "LOCATION" and not self.acts(t)

    def actors(self, noun: int) -> list[int]:
        aimed = bool(self.prep(noun, *EVENT_PREPS))
        compound = [c for c in self.kids(noun, "compound") if self.acts(c) or (aimed and self.is_place(c))]
        national = [c for c in self.kids(noun, "amod") if c in self.at and self.at[c].entity_type == "LOCATION"]
        return self.kids(noun, "poss") + self.prep(noun, "by") + compound + national

    def aimed_places(self, noun: int) -> list[int]:
        return [] if self.prep(noun, *EVENT_PREPS) else [c for c in self.kids(noun, "compound") if self.is_place(c)]

    def events(self, verb: int) -> list[int]:
        objects = self.kids(verb, "dobj")
        return objects + [p for o in objects if self.lemma(o) in lex.QUANTITY_HEADS or self.pos(o) == "NUM" for p in self.prep(o, "of")]

    def sanctions(self, t: int) -> bool:
        named = lambda x: self.lemma(x) in lex.SANCTION_NOUNS or self.low(x) == "sanctions"
        return self.pos(t) in ("NOUN", "PROPN") and (named(t) or (self.lemma(t) in lex.SANCTION_HEADS and any(named(c) for c in self.kids(t, "compound"))))

    def members(self, tokens: list[int]) -> list[int]:
        return tokens + [p for t in tokens for p in self.prep(t, "including")]

    def owners_too(self, tokens: list[int]) -> list[int]:
        assets = [t for t in tokens if t not in self.at and {self.lemma(t), self.low(t).removesuffix("s")} & lex.MILITARY_ASSETS]
        return tokens + [x for t in assets for c in self.kids_of[t] if c < t for x in self.subtree(c) if self.dep(x) in ("compound", "poss") and self.acts(x)]

    def money(self, t: int) -> bool:
        return any(self.tok[x]["ent_type"] == "MONEY" or self.lemma(x) in lex.MONEY_WORDS for x in self.subtree(t))


def news(m: Mention) -> bool:
    name = normalize_name(m.canonical)
    return m.entity_type == "ORG" and (name in lex.NEWS_NAMES or bool(lex.NEWS_WORDS & set(re.split(r"[\s'’-]+", name))))


Ends = Callable[[Sentence, int, int], list[Mention]]
VERB, AUX, NOUN, ANY = ("VERB",), ("VERB", "AUX"), ("NOUN",), ()


@dataclass(frozen=True)
class Rule:
    """Where `pos` and `lemmas` match a token t that is not suppressed, every token o of `over` gives sources x targets if `when` holds."""

    id: str
    pos: tuple[str, ...]
    lemmas: frozenset[str] | None
    sources: Ends
    targets: Ends
    when: Callable[[Sentence, int, int], bool] = lambda s, t, o: True
    over: Callable[[Sentence, int], list[int]] = lambda s, t: [t]
    allow: frozenset[str] = frozenset()

    @property
    def relation(self) -> str:
        return self.id.partition(".")[0]


def subj(*types: str) -> Ends:
    return lambda s, t, o: s.ents(s.subjects(t), *types)


def by(s: Sentence, t: int, o: int) -> list[Mention]:
    return s.ents(s.agents(t))


def undergone(s: Sentence, t: int, o: int) -> list[Mention]:
    return s.ents(s.passive(t))


def obj(*preps: str) -> Ends:
    return lambda s, t, o: s.ents(s.kids(t, "dobj") + (s.prep(t, *preps) if preps else []))


def of(*preps: str) -> Ends:
    return lambda s, t, o: s.ents(s.prep(t, *preps))


def active(s: Sentence, t: int, o: int) -> bool:
    return not s.passive(t)


def passive(s: Sentence, t: int, o: int) -> bool:
    return bool(s.passive(t))


def with_each(s: Sentence, t: int, o: int) -> list[Mention]:
    """Who stands after "with", of the noun or its verb; else the subjects among each other."""
    return s.ents(s.prep(o, "with") + s.prep(t, "with")) or s.ents(s.subjects(t))


def done_by(s: Sentence, t: int, o: int) -> list[Mention]:
    return s.ents(s.actors(t))


def nouns(words: frozenset[str]) -> Callable[[Sentence, int], list[int]]:
    return lambda s, t: [o for o in s.kids(t, "dobj") if s.lemma(o) in words and not s.blocked(o)]


def criticised_actors(s: Sentence, t: int, o: int) -> list[Mention]:
    acts = [x for x in s.kids(t, "dobj") if x not in s.at or s.at[x].entity_type == "TOPIC"]
    return s.ents([a for x in acts for a in s.actors(x)])


def discussed(s: Sentence, t: int) -> list[int]:
    """Objects of a verb of discussion; for "announce" only what isn't typed otherwise."""
    found = [] if s.lemma(t) == "talk" else s.kids(t, "dobj", "nsubjpass")
    return [x for x in found if not s.sanctions(x) and s.lemma(x) not in lex.ATTACK_NOUNS] if s.lemma(t) == "announce" else found


def topic_preps(s: Sentence, t: int) -> list[int]:
    return [c for c in s.kids(t, "prep") if s.low(c) in lex.TOPIC_PREPS]


def discussers(s: Sentence, t: int, o: int) -> list[Mention]:
    who = s.subjects(t) + s.agents(t) + s.prep(t, "with") + [p for x in discussed(s, t) for p in s.prep(x, "with")]
    if s.dep(t) == "advcl" and s.to_infinitive(t) and s.lemma(s.head(t)) in lex.MEET_VERBS:
        who += s.kids(s.head(t), "dobj") + s.prep(s.head(t), "with")
    return s.ents(who)


def talkers(s: Sentence, t: int, o: int) -> list[Mention]:
    who = s.kids(t, "poss") + s.prep(t, "with", "between")
    if s.dep(t) == "dobj" and s.pos(s.head(t)) == "VERB":
        who += [p for x in s.subjects(s.head(t)) for p in ([x] if x in s.at else s.kids(x, "poss"))]
    return s.ents(who)


def roles(words: frozenset[str]) -> Callable[[Sentence, int], list[int]]:
    return lambda s, t: [] if s.tag(t) == "VBD" else [a for a in s.kids(t, "attr") if a not in s.at and s.lemma(a) in words]


def investors(s: Sentence, t: int, o: int) -> list[Mention]:
    return s.ents(s.actors(t) + (s.subjects(s.head(t)) if _staked(s, t) else []))


def invested(s: Sentence, t: int, o: int) -> list[Mention]:
    return s.ents(s.prep(t, "in", "into") + (s.prep(s.head(t), "in", "into") if _staked(s, t) else []))


def _staked(s: Sentence, t: int) -> bool:
    return s.dep(t) == "dobj" and s.pos(s.head(t)) == "VERB" and s.lemma(s.head(t)) in lex.STAKE_VERBS


def raised(s: Sentence, t: int, o: int) -> bool:
    return any(s.money(x) for x in s.kids(t, "dobj"))


def products(s: Sentence, t: int, o: int) -> list[Mention]:
    named = [x for x in s.kids(t, "dobj") + s.passive(t) if s.lemma(x) in lex.PRODUCT_NOUNS and (x not in s.at or s.at[x].entity_type == "TOPIC")]
    return s.ents([c for x in named for c in s.kids(x, "compound", "nmod", "amod") if c in s.at])


def imposed(s: Sentence, t: int) -> list[int]:
    return [n for n in s.events(t) + s.passive(t) if s.sanctions(n) and not s.blocked(n)]


def under(s: Sentence, t: int, o: int) -> list[Mention]:
    places, up = s.prep(t, *EVENT_PREPS) + s.aimed_places(t), s.head(t)
    if s.dep(t) == "pobj" and s.low(up) == "under" and s.pos(s.head(up)) in AUX:
        places = places + s.subjects(s.head(up))
    return s.ents(places)


def attacked(s: Sentence, t: int, o: int) -> list[Mention]:
    return s.ents(s.owners_too(s.prep(t, *EVENT_PREPS, *(("of",) if s.lemma(t) in lex.OF_TARGET_NOUNS else ()))))


def speakers(s: Sentence, t: int, o: int) -> list[Mention]:
    who = s.subjects(t)
    return s.ents(who) or [m for x in who if s.lemma(x) in lex.SPOKES_WORDS for m in s.role_orgs(x)]


def told(s: Sentence, t: int, o: int) -> list[Mention]:
    listeners = s.kids(t, "dobj", "dative")
    return [m for m in s.ents(listeners) + [s.at[x] for p in listeners for c in s.kids(p, "poss") for x in s.subtree(c) if x in s.at] if news(m)]


def heard(*preps: str) -> Ends:
    def run(s: Sentence, t: int, o: int) -> list[Mention]:
        listeners = s.prep(t, *preps)
        named = [s.at[c] for x in listeners if x not in s.at and s.lemma(x) in lex.OUTLET_NOUNS for c in s.kids(x, "compound") if c in s.at]
        return [m for m in s.ents(listeners) + named if news(m)]

    return run


def interviewed(s: Sentence, t: int, o: int) -> list[Mention]:
    talks = [n for n in s.prep(t, "in", "during") if s.lemma(n) in lex.INTERVIEW_NOUNS]
    return [m for m in s.ents([p for n in talks for p in s.prep(n, "with")] + [c for n in talks for c in s.kids(n, "compound", "poss")]) if news(m)]


def one(*words: str) -> frozenset[str]:
    return frozenset(words)


def order_given(s: Sentence, t: int) -> bool:
    return any(s.to_infinitive(c) for c in s.kids(t, "xcomp", "ccomp"))


#: R1-R44 in the order in which they fire at a token.
RULES = (
    Rule("met_with.passive", AUX, one("meet"), undergone, by, passive),
    Rule("met_with.passive", AUX, one("host"), lambda s, t, o: s.ents(s.passive(t), "PERSON"), by, passive),
    Rule("met_with.hosted", AUX, one("host"), subj(), lambda s, t, o: s.ents(s.kids(t, "dobj"), "PERSON"), active),
    Rule("met_with.verb", AUX, one("meet"), subj(), obj("with"), active),
    Rule("met_with.joint_subject", AUX, one("meet"), subj(), subj(), lambda s, t, o: active(s, t, o) and not obj("with")(s, t, o)),
    Rule("met_with.held_talks", AUX, lex.HOLD_VERBS, subj(), with_each, over=nouns(lex.MEET_NOUNS)),
    Rule("met_with.meeting_between", NOUN, lex.MEET_NOUNS, of("between"), of("between")),
    Rule("met_with.meeting_with", NOUN, lex.MEET_NOUNS, lambda s, t, o: s.ents(s.kids(t, "poss")), of("with")),
    Rule("criticized.passive", AUX, lex.CRITICIZE_VERBS, by, undergone, passive),
    Rule("criticized.active", AUX, lex.CRITICIZE_VERBS, subj(), obj(), active),
    Rule("criticized.object_possessor", AUX, lex.CRITICIZE_VERBS, subj(), criticised_actors, active),
    Rule("discussed_topic.verb", AUX, lex.DISCUSS_VERBS, discussers, lambda s, t, o: s.topics(discussed(s, t) + ([] if s.lemma(t) == "announce" else topic_preps(s, t)))),
    Rule("discussed_topic.noun", NOUN, lex.DISCUSS_NOUNS, talkers, lambda s, t, o: s.topics(topic_preps(s, t) + s.kids(t, "compound"), t)),
    Rule("affiliated_with.copular", ANY, one("be"), subj(), lambda s, t, o: s.role_orgs(o), over=roles(lex.ROLE_WORDS)),
    Rule("invested_in.copular", ANY, one("be"), subj(), lambda s, t, o: s.role_orgs(o, "in", "of"), over=roles(lex.INVESTOR_WORDS)),
    Rule("partnered_with.copular", ANY, one("be"), subj(), lambda s, t, o: s.role_orgs(o, "of", "to") or (s.ents(s.subjects(t)) if s.tag(o) == "NNS" else []), over=roles(one("partner"))),
    Rule("affiliated_with.leads", AUX, lex.LEAD_VERBS, subj("PERSON"), obj()),
    Rule("affiliated_with.runs", AUX, lex.PERSON_LEAD_VERBS, subj("PERSON"), obj()),
    Rule("affiliated_with.founded", AUX, lex.FOUND_VERBS, by, undergone, passive),
    Rule("affiliated_with.founded", AUX, lex.FOUND_VERBS, subj(), obj(), active),
    Rule("affiliated_with.works_for", AUX, lex.WORK_VERBS, subj("PERSON"), of("at", "for"), lambda s, t, o: s.tag(t) != "VBD"),
    Rule("acquired.passive", VERB, lex.ACQUIRE_VERBS, by, undergone, passive, allow=lex.ANNOUNCED_DEAL_HEADS),
    Rule("acquired.verb", VERB, lex.ACQUIRE_VERBS, subj(), obj(), active, allow=lex.ANNOUNCED_DEAL_HEADS),
    Rule("acquired.noun", NOUN, lex.ACQUIRE_NOUNS, done_by, of("of"), allow=lex.ANNOUNCED_DEAL_HEADS),
    Rule("invested_in.verb", VERB, lex.INVEST_VERBS, subj(), lambda s, t, o: s.ents(s.prep(t, "in", "into") + [p for x in s.kids(t, "dobj") for p in s.prep(x, "in", "into")])),
    Rule("invested_in.noun", NOUN, lex.INVEST_NOUNS, investors, invested),
    Rule("invested_in.raised_from", VERB, lex.RAISE_VERBS, of("from"), subj(), raised),
    Rule("invested_in.round_led_by", VERB, lex.RAISE_VERBS, lambda s, t, o: s.ents([a for x in s.subtree(t) if x != t and s.lemma(x) == "lead" and s.dep(x) == "acl" for a in s.agents(x)]), subj(), raised),
    Rule("released.product", VERB, lex.RELEASE_VERBS, lambda s, t, o: s.ents(s.agents(t) if s.passive(t) else s.subjects(t), "ORG"), products, lambda s, t, o: s.lemma(t) != "roll" or s.particle(t, "out")),
    Rule("partnered_with.verb", VERB, lex.PARTNER_VERBS | one("team"), subj(), of("with"), lambda s, t, o: s.lemma(t) != "team" or s.particle(t, "up")),
    Rule("partnered_with.joint_subject", VERB, lex.PARTNER_VERBS | one("team"), subj(), subj(), lambda s, t, o: (s.lemma(t) != "team" or s.particle(t, "up")) and not of("with")(s, t, o)),
    Rule("partnered_with.deal", VERB, lex.DEAL_VERBS, subj(), with_each, over=nouns(lex.DEAL_NOUNS)),
    Rule("partnered_with.deal_between", NOUN, lex.DEAL_NOUNS, of("between"), of("between")),
    Rule("partnered_with.deal_with", NOUN, lex.DEAL_NOUNS, lambda s, t, o: s.ents(s.kids(t, "poss") + [c for c in s.kids(t, "compound") if s.acts(c)]), of("with")),
    Rule("sanctioned.passive", VERB, lex.SANCTION_VERBS, by, undergone, passive),
    Rule("sanctioned.verb", VERB, lex.SANCTION_VERBS, subj(), lambda s, t, o: s.ents(s.members(s.kids(t, "dobj")) + s.prep(t, "including")), active),
    Rule(
        "sanctioned.imposed",
        VERB,
        lex.IMPOSE_VERBS,
        lambda s, t, o: s.ents(s.agents(t) + s.actors(o) if o in s.passive(t) else s.subjects(t)),
        lambda s, t, o: s.ents(s.members(s.prep(o, *EVENT_PREPS) + s.prep(t, *EVENT_PREPS)) + s.aimed_places(o)),
        over=imposed,
    ),
    Rule("sanctioned.noun", ANY, None, done_by, under, lambda s, t, o: s.sanctions(t) and s.lemma(s.head(t)) not in lex.LIFT_VERBS),
    Rule("attacked.passive", VERB, lex.ATTACK_VERBS, by, undergone, lambda s, t, o: passive(s, t, o) and not s.prep(t, "over", "for")),
    Rule("attacked.verb", VERB, lex.ATTACK_VERBS, subj(), lambda s, t, o: s.ents(s.owners_too(s.kids(t, "dobj"))), lambda s, t, o: active(s, t, o) and not s.prep(t, "over", "for")),
    Rule(
        "attacked.launched",
        VERB,
        lex.LAUNCH_VERBS,
        subj(),
        lambda s, t, o: s.ents(s.owners_too(s.prep(o, *EVENT_PREPS) + s.prep(t, *EVENT_PREPS))),
        lambda s, t, o: s.lemma(t) != "carry" or s.particle(t, "out"),
        lambda s, t: [n for n in s.events(t) if s.lemma(n) in lex.ATTACK_NOUNS and not s.blocked(n)],
    ),
    Rule("attacked.noun", NOUN, lex.ATTACK_NOUNS, done_by, attacked),
    Rule("quoted_by.passive", VERB, one("quote", "cite"), undergone, lambda s, t, o: [m for m in by(s, t, o) if news(m)], passive),
    Rule("quoted_by.tell", VERB, one("tell"), speakers, told, lambda s, t, o: active(s, t, o) and not order_given(s, t)),
    Rule("quoted_by.speak", VERB, one("speak"), speakers, heard("to", "with"), active),
    Rule("quoted_by.confirm", VERB, one("confirm"), speakers, heard("to"), active),
    Rule("quoted_by.say", VERB, one("say"), speakers, interviewed, active),
)


def _root(s: Sentence, m: Mention) -> int:
    inside = [i for i in range(m.first, m.last) if i in s.tok]
    return next((i for i in inside if s.head(i) == i or s.head(i) not in inside), m.first)


def _titles(s: Sentence) -> Iterator[tuple[str, list[Mention], list[Mention]]]:
    """An organisation up to five tokens before a name, joined by role words or a possessive."""
    people = [m for m in s.mentions if m.entity_type in ("PERSON", "ORG")]
    for org, m in product([x for x in people if x.entity_type == "ORG"], people):
        between = [i for i in range(org.last, m.first) if i in s.tok]
        if not 0 < m.first - org.last <= 5:
            continue
        before = org.first - 1 - s.joins(org.first - 1)
        former = (before in s.tok and s.low(before) in lex.FORMER) or any(s.low(c) in lex.FORMER for t in between for c in s.kids_of[t])
        if former or any((s.pos(t) == "PUNCT" and not s.joins(t)) or s.pos(t) == "VERB" or s.low(t) in lex.FORMER or t in s.at for t in between):
            continue
        words, lemmas = [t for t in between if s.tag(t) != "POS"], {s.lemma(t) for t in between}
        spoken = lambda t: s.lemma(t) in lex.ROLE_WORDS | lex.INVESTOR_WORDS or s.low(t).rstrip(".") in lex.TITLES | lex.ROLE_PREFIXES or s.joins(t)
        a, b = _root(s, org), _root(s, m)
        linked = b in set(s.ancestors(a)) or (bool(words) and all(spoken(t) for t in words))
        if linked and lemmas & lex.ROLE_WORDS:
            yield "affiliated_with.title", [m], [org]
        elif linked and lemmas & lex.INVESTOR_WORDS:
            yield "invested_in.title", [m], [org]
        elif m.entity_type == "PERSON" and len(between) == 1 and s.tag(between[0]) == "POS" and s.dep(a) == "poss" and m.first <= s.head(a) < m.last:
            yield "affiliated_with.possessive", [m], [org]


def _appositives(s: Sentence) -> Iterator[tuple[str, list[Mention], list[Mention]]]:
    """R48-R51."""
    for m in s.mentions:
        if m.entity_type not in ("PERSON", "ORG"):
            continue
        root = _root(s, m)
        if m.entity_type == "PERSON":
            yield "affiliated_with.of", [m], s.ents(s.prep(root, "of"), "ORG")
        for role in s.kids(root, "appos") + ([s.head(root)] if s.dep(root) == "appos" else []):
            word = s.lemma(role)
            if role in s.at:
                continue
            if word in lex.ROLE_WORDS and m.entity_type == "PERSON":
                yield "affiliated_with.appositive", [m], s.role_orgs(role)
            elif word in lex.INVESTOR_WORDS:
                yield "invested_in.appositive", [m], s.role_orgs(role, "in", "of")
            elif word == "partner":
                yield "partnered_with.appositive", [m], s.role_orgs(role, "of", "to")


def fired(s: Sentence) -> Iterator[tuple[str, list[Mention], list[Mention]]]:
    """(rule id, sources, targets) of all typed rules."""
    calm: dict[tuple[int, frozenset[str]], bool] = {}
    for t in s.order:
        for r in RULES:
            if (r.pos and s.pos(t) not in r.pos) or (r.lemmas is not None and s.lemma(t) not in r.lemmas) or (r.lemmas is None and not s.sanctions(t)):
                continue
            if (t, r.allow) not in calm:
                calm[t, r.allow] = not s.suppressed(t, r.allow)
            if calm[t, r.allow]:
                for o in r.over(s, t):
                    if r.when(s, t, o):
                        yield r.id, r.sources(s, t, o), r.targets(s, t, o)
    yield from _titles(s)
    yield from _appositives(s)


#: Entity types that may stand at both ends (fixed values).
ENDS = {
    "released": ({"ORG"}, {"ORG"}),
    "partnered_with": ({"ORG"}, {"ORG"}),
    **dict.fromkeys(("affiliated_with", "acquired", "invested_in", "quoted_by"), ({"PERSON", "ORG"}, {"ORG"})),
    "attacked": ({"ORG", "LOCATION"}, {"ORG", "LOCATION"}),
    "discussed_topic": ({"PERSON", "ORG", "LOCATION"}, {"TOPIC"}),
}
OTHERS = ({"PERSON", "ORG", "LOCATION"}, {"PERSON", "ORG", "LOCATION"})


def eligible(relation: str, a: Mention, b: Mention) -> bool:
    sources, targets = ENDS.get(relation, OTHERS)
    place = relation != "attacked" or "LOCATION" in (a.entity_type, b.entity_type)
    return a.key != b.key and a.entity_type in sources and b.entity_type in targets and place


def window(text: str, start: int, end: int, a: Mention, b: Mention, most: int = lex.MAX_EVIDENCE_CHARS) -> tuple[int, int]:
    """The sentence without outer white space; of a long one what surrounds both mentions evenly."""
    if end - start > most:
        low, high = min(a.start, b.start), max(a.end, b.end)
        pad = max(0, most - (high - low)) // 2
        start, end = max(start, low - pad), min(end, high + pad)
    cut = text[start:end]
    return start + len(cut) - len(cut.lstrip()) if cut.strip() else end, end - (len(cut) - len(cut.rstrip()) if cut.strip() else 0)


def asks(s: Sentence) -> bool:
    last = next((s.tok[i]["text"] for i in reversed(s.order) if s.pos(i) != "SPACE" and s.tok[i]["text"].strip() and s.tok[i]["text"] not in "\"'”’“‘»«)]"), "")
    return "?" in last


def relations_of(text: str, tokens: list[dict], mentions: list[dict]) -> tuple[list[tuple], int]:
    """(source_key, target_key, relation_type, directed, rule_id, quality_tier, start, end) of a sentence in order, and its entities if they are too many for R52."""
    s = Sentence(tokens, mentions)
    if not s.order:
        return [], 0
    last = s.tok[s.order[-1]]
    begin, end = s.tok[s.order[0]]["start"], last["start"] + len(last["text"])
    out: list[tuple] = []

    def add(rule: str, tier: str, a: Mention, b: Mention) -> None:
        relation = rule.partition(".")[0]
        if relation not in lex.DIRECTED and b.key < a.key:
            a, b = b, a
        out.append((a.key, b.key, relation, relation in lex.DIRECTED, rule, tier, *window(text, begin, end, a, b)))

    for rule, sources, targets in [] if asks(s) else fired(s):
        for a, b in product(sources, targets):
            if eligible(rule.partition(".")[0], a, b):
                add(rule, "semantic_rule", a, b)
    linked = {frozenset(x[:2]) for x in out}
    first: dict[str, Mention] = {}
    for m in s.mentions:
        first.setdefault(m.key, m)
    if len(first) > lex.MAX_SENTENCE_ENTITIES:
        return out, len(first)
    for a, b in combinations(first.values(), 2):
        if frozenset((a.key, b.key)) not in linked and {a.entity_type, b.entity_type} != {"TOPIC"}:
            add("mentioned_with.sentence", "cooccurrence", a, b)
    return out, 0


def relations(tokens: DataFrame, mentions: DataFrame, segments: DataFrame) -> DataFrame:
    """Relations of all sentences, as emitted. tokens: item, segment_id, sent (numbered through the item) and TOKEN; mentions: item, segment_id, sent and
    MENTION; segments: item, segment_id, text. A sentence with no relation but too many entities gives a row with a warning."""
    by = ["item", "segment_id", "sent"]
    names = lambda spec: [x.split()[0] for x in spec.split(", ")]
    each = tokens.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*names(TOKEN)))).alias("tokens"))
    own = mentions.groupBy(*by).agg(F.collect_list(F.struct(*names(MENTION))).alias("mentions"))
    rows = each.join(own, by).join(segments.select("item", "segment_id", "text"), ["item", "segment_id"]).select(*by, "text", "tokens", "mentions")
    schema = rows.select(*by).schema
    kinds = "source_key string, target_key string, relation_type string, directed boolean, rule_id string, quality_tier string, start int, end int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [], []
            for j, r in enumerate(batch.to_pylist()):
                got, many = relations_of(r["text"], r["tokens"], r["mentions"])
                for k, x in enumerate(got + [(None,) * 8] * bool(many)):
                    keys.append(j)
                    found.append((k, *x, r["text"][x[6] : x[7]] if x[0] else None, None if x[0] else f"Co-occurrence skipped for a sentence with {many} entities in segment {r['segment_id']}"))
            cols = list(zip(*found, strict=True)) or [[]] * 11
            types = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keys, pa.int64())) for c in range(3)] + [pa.array(c, t) for c, t in zip(cols, types, strict=True)], [*by, "ord", *names(kinds), "evidence_text", "warning"])

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return rows.mapInArrow(run, f"{head}, ord int, {kinds}, evidence_text string, warning string")


def kept_relations(found: DataFrame) -> DataFrame:
    """Co-occurrence goes where a typed rule links the pair anywhere in the item; then the first of each key."""
    from .cooccurrence import first_wins

    rows = found.where("source_key IS NOT NULL")
    pair = lambda df: df.withColumns({"a": F.least("source_key", "target_key"), "b": F.greatest("source_key", "target_key")})
    typed = pair(rows.where("quality_tier = 'semantic_rule'")).select("item", "a", "b").distinct()
    weak = pair(rows.where("quality_tier = 'cooccurrence'")).join(typed, ["item", "a", "b"], "left_anti").select(*rows.columns)
    return first_wins(rows.where("quality_tier = 'semantic_rule'").unionByName(weak), ["item", "source_key", "target_key", "relation_type"], ["sent", "ord"])
