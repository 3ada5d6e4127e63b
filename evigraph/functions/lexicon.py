"""Word lists of the relation rules and mention filters.

Fixed values: results are only right with exactly these words."""

from __future__ import annotations


def _w(text: str) -> frozenset[str]:
    return frozenset(text.split())


# Fixed values, trigger words by relation.
MEET_VERBS = _w("meet host")
HOLD_VERBS = _w("hold have conduct")
MEET_NOUNS = _w("meeting talk summit")
CRITICIZE_VERBS = _w("criticize criticise condemn denounce slam accuse blame rebuke censure decry deplore lambast lambaste castigate")
DISCUSS_VERBS = _w("discuss negotiate debate address talk warn comment speak testify announce")
DISCUSS_NOUNS = _w("talk negotiation discussion debate warning")
TOPIC_PREPS = _w("about on over regarding")
INNER_TOPIC_PREPS = _w("of about regarding")
SETTING_NOUNS = _w("sideline sidelines margin margins eve wake backdrop occasion heels")
LEAD_VERBS = _w("lead head chair")
PERSON_LEAD_VERBS = _w("run")
FOUND_VERBS = _w("found cofound co-found")
WORK_VERBS = _w("work")
ACQUIRE_VERBS = _w("acquire buy purchase")
ACQUIRE_NOUNS = _w("acquisition purchase takeover buyout")
ANNOUNCED_DEAL_HEADS = _w("agree sign deal agreement")
INVEST_VERBS = _w("invest")
INVEST_NOUNS = _w("investment stake")
STAKE_VERBS = _w("take buy acquire hold purchase make announce complete")
RAISE_VERBS = _w("raise secure")
MONEY_WORDS = _w("funding round capital money investment financing cash billion million bn m b")
RELEASE_VERBS = _w("release launch unveil announce ship debut introduce open-source roll")
PRODUCT_NOUNS = _w("model chatbot assistant app application chip processor gpu version feature tool browser product device phone service platform agent llm api sdk framework library update upgrade system weights")
PARTNER_VERBS = _w("partner collaborate")
DEAL_VERBS = _w("sign strike reach ink seal announce form enter have agree unveil")
DEAL_NOUNS = _w("partnership deal agreement collaboration alliance pact contract tie-up")
SANCTION_VERBS = _w("sanction blacklist")
SANCTION_NOUNS = _w("sanction embargo")
SANCTION_HEADS = _w("regime package programme program campaign measure designation")
IMPOSE_VERBS = _w("impose reimpose announce unleash slap levy place issue introduce adopt expand extend tighten")
LIFT_VERBS = _w("lift waive ease remove revoke suspend end relax drop scrap rescind loosen reverse")
ATTACK_VERBS = _w("attack strike bomb invade shell hack")
ATTACK_NOUNS = _w("attack strike airstrike bombing assault offensive raid invasion war bombardment counterattack cyberattack")
OF_TARGET_NOUNS = _w("invasion bombing bombardment")
LAUNCH_VERBS = _w("launch carry conduct stage mount unleash wage")
MILITARY_ASSETS = _w("base force troop asset vessel ship warship tanker embassy consulate personnel position facility installation soldier outpost drone aircraft jet submarine")
QUANTITY_HEADS = _w("dozen dozens hundreds series wave set round slew raft package number string barrage batch spate list")
QUOTE_VERBS = _w("tell speak say quote cite confirm")
OUTLET_NOUNS = _w("agency outlet network channel broadcaster newspaper daily")
SPOKES_WORDS = _w("spokesperson spokesman spokeswoman official representative")
INTERVIEW_NOUNS = _w("interview conversation podcast")
NEWS_WORDS = _w("news times post tv television radio broadcasting journal tribune herald gazette jazeera reuters bloomberg bbc cnn cnbc afp presse irna tasnim fars axios politico telegraph economist techcrunch wired verge technica media outlet")
NEWS_NAMES = frozenset({"associated press", "the associated press", "ap", "guardian", "the guardian", "press tv", "nyt", "new york times"})

# Fixed values, roles.
ROLE_WORDS = _w(
    "president chief head leader secretary general minister spokesperson spokesman spokeswoman director chairman chairwoman chair ambassador envoy commander member official ceo founder deputy"
    " representative executive governor premier chancellor commissioner negotiator adviser advisor officer delegate lawmaker senator boss coordinator rapporteur administrator cofounder cto cfo coo"
    " scientist researcher engineer employee staffer correspondent editor reporter analyst"
)
ROLE_PREFIXES = _w("co vice")
INVESTOR_WORDS = _w("investor backer shareholder")
REPRESENTATIVE_ROLES = _w("envoy ambassador representative delegate emissary")
FORMER = _w("former ex erstwhile")
TITLES = _w(
    "mr mrs ms miss dr sir dame president vice prime minister foreign defence defense finance interior secretary general gen state of the senator sen rep representative congressman congresswoman"
    " chancellor premier prince princess crown emir sheikh sultan ayatollah supreme leader ambassador envoy governor gov mayor judge justice chief commander lt col colonel lieutenant captain capt"
    " admiral adm field marshal spokesman spokeswoman spokesperson deputy former ex late chairman lord lady king queen pope"
)

# Fixed values, what keeps an event from being asserted.
SUPPRESSING_HEADS = _w(
    "plan expect set refuse deny hope want intend seek agree aim propose offer threaten decline prepare schedule try attempt promise vow pledge wish likely unlikely due reject fail consider urge ask"
    " invite need avoid refrain hesitate ready willing reluctant unwilling press push pressure encourage persuade demand postpone delay cancel claim allege"
)
INFINITIVE_HEADS = _w("have go")
HEARSAY_NOUNS = _w("rumour rumor report claim allegation speculation suggestion")
UNREALIZED_HEADS = _w("postpone delay cancel plan schedule expect propose set")
FOR_HEADS = _w("call push press appeal ask hope wait prepare plan lobby demand")
FROM_HEADS = _w("deter prevent stop refrain bar ban block keep prohibit dissuade discourage restrain abstain")
PLANNED_MODIFIERS = _w("planned proposed possible potential upcoming expected scheduled future cancelled canceled postponed attempted failed aborted abandoned rumoured rumored blocked hypothetical alleged")
PLANNED_LEMMAS = _w("plan schedule propose expect postpone cancel delay")
CONDITIONAL_MARKS = _w("if unless whether")
BLOCKING_DETERMINERS = _w("no any")
PHRASAL_SUPPRESSORS = frozenset({("turn", "down"), ("call", "off"), ("rule", "out"), ("back", "out"), ("pull", "out")})
RELATIVE_PRONOUNS = _w("who which that")
STATEMENT_NOUNS = _w("statement post message letter communique tweet video speech")

# Fixed values, names.
NAME_SUFFIXES = _w("jr sr")
SURNAME_PARTICLES = _w("de da di du van von der den ter le la bin ibn al el")
ABBREVIATION_SKIPS = _w("of and the for on in at to de du des la le")
PORTFOLIOS = _w("trade health energy economy education agriculture commerce labour labor culture transport environment industry information communications development security intelligence home")
JARGON = _w("op til ama nsfw eli5 imo imho edit tldr lol lmao fwiw afaik iirc update x twitter reddit")
TECH_ACRONYMS = _w(
    "ai agi asi llm llms api apis gpu gpus cpu cpus tpu tpus ram ip cto ceo cfo coo ddos saas ml vc vcs ipo sdk ui ux os pr faq url oss rag rlhf rl rce tos va ssd dry sota nda mou html css json hpc"
    " ev evs lng utc gmt gb tb csam vpn"
)
GENERIC = _w("state states government administration ministry department council parliament team")
BODIES = ("foreign affairs", "foreign", "defence", "defense", "interior", "finance", "energy", "health", "justice", "information", "oil", "economy", "trade", "commerce")
BODY_NAMES = {"foreign affairs": "Foreign", "defense": "Defence"}
COMPANY_SUFFIXES = ("Ltd", "Inc", "Co", "Corp", "Plc", "Pte", "Bhd", "Llc", "LLC")
NAME_BREAKERS = "()[]{}/+|"
MAX_NAME_CHARS = 80

# Relations that have a direction; all others are symmetric.
DIRECTED = _w("affiliated_with criticized discussed_topic acquired invested_in sanctioned attacked quoted_by released")
MAX_SENTENCE_ENTITIES, MAX_EVIDENCE_CHARS = 8, 500
