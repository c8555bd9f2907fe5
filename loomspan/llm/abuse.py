"""Abusive, hateful and sexual content, scored clause by clause with a weighted finite-state pattern grammar."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.grammar import BLOCKED, EDGE, OTHER, Grammar

#: A text with a score from here on, in any class, is found.
ACCEPT = 2.0
CLASSES = ("abusive", "hateful", "sexual")
#: Most labelled rows that weights are fitted on.
MAX_LABELS = 10_000

# Words for people that insult them; they count only where a rule finds a target.
_INSULT = (
    "moron idiot imbecile imbecil cretin loser bastard bitch asshole arsehole scumbag scum dumbass jackass jerk clown pig swine twat prick dick dickhead wanker cunt retard "
    "freak whore slut hack parasite maggot worm creep coward fraud liar fool nobody trash garbage filth vermin rat weasel snake pervert psycho douchebag simp halfwit nitwit dimwit "
    "vollidiot arschloch wichser hurensohn schlampe trottel depp missgeburt cretino gilipollas cabron pendejo puta basura imbecille stronzo connard connasse salope cretine abruti"
).split()
# Words that put people among animals, dirt or illness.
_LOWER = "vermin cockroach cockroaches animals parasite parasites filth subhuman subhumans disease plague plaga rats pigs scum trash savages monkeys cancer pest pests maggots dogs garbage ungeziefer parasiten".split()
# Explicit words.
_EXPLICIT = "nudes nude naked tits titties boobs porn porno horny sex sexy pussy cock dick dickpics blowjob cum orgasm nacktbilder desnuda desnudas desnudo anal milf xxx nsfw onlyfans busty topless".split()
_SWEAR = "fuck fucking fucked fucker motherfucker shit bullshit kys".split()


def _plural(words: Sequence[str]) -> list[str]:
    return [f for w in words for f in (w, w + ("es" if w.endswith(("ch", "sh", "s")) else "s"))]


# Insults that are verbs or things too: without a form of "to be" or an adjective they don't count behind "you".
_LOOSE = frozenset("hack fool trash garbage snake rat worm nobody fraud simp creep parasite clown jerk filth weasel coward swine depp".split())
_INSULT_PHRASES = ["piece of shit", "piece of crap", "piece of trash", "piece of garbage", "sack of shit", "son of a bitch", "waste of oxygen", "waste of space", "waste of air", "waste of skin", "waste of life", "waste of breath", "good for nothing", "lowlife", "lowlifes", "disgrace", "sorry excuse for a human"]
_PEOPLE = (
    "migrants immigrants refugees foreigners outsiders muslims jews christians hindus sikhs catholics protestants mormons buddhists atheists believers blacks whites asians arabs latinos mexicans africans "
    "indians pakistanis chinese japanese koreans turks poles russians ukrainians romanians albanians gays lesbians homosexuals queers bisexuals transgenders transsexuals women females girls nomads gypsies roma "
    "travellers travelers villagers peasants cripples elderly southerners northerners locals natives aborigines minorities beggars autistics "
    "auslander fluchtlinge migranten juden frauen muslime turken inmigrantes extranjeros refugiados gitanos mujeres judios negros maricones immigres etrangers refugies arabes juifs musulmans femmes мигранты беженцы иностранцы приезжие евреи женщины"
).split()
_PEOPLE_PHRASES = [
    "asylum seekers", "trans people", "transgender people", "gay people", "black people", "white people", "asian people", "jewish people", "muslim people", "foreign people", "immigrant families", "migrant families",
    "the deaf", "deaf people", "the blind", "blind people", "disabled people", "the disabled", "old people", "poor people", "homeless people", "the homeless", "the poor", "the mentally ill",
    *(f"people with {d} {n}" for d in ("that", "this", "your", "their", "a foreign", "such a") for n in ("accent", "skin", "name", "religion", "face", "kind", "disability")),
    *(f"people of {d} {n}" for d in ("that", "this", "your", "their") for n in ("kind", "sort", "color", "colour", "faith", "religion", "race")),
    "people like these", "people like them", "people like that", "people from that", "people from those", "people from there",
]

_CLASSES = {
    "YOU": ["you", "u", "ya", "y all", "yall", "thou", "you lot", "you people", "you guys", "all of you", "you two"],
    "YOUR": ["your", "ur", "yer", "his", "her", "their"],
    "BE": ["are", "re", "r", "were", "must be", "will always be", "look like", "sound like", "smell like", "is", "being", "are being", "have to be", "are nothing but", "act like"],
    "NOTNEG": ["such", "just", "nothing but", "clearly", "truly", "really", "a", "an", "the", "one", "so", "too", "absolute", "absolutely", "complete", "completely", "total", "totally", "utter", "utterly", "fucking", "bloody", "damn",
               "little", "big", "fat", "old", "ugly", "stupid", "dumb", "pathetic", "worthless", "lying", "miserable", "disgusting", "real", "true", "most", "filthy", "dirty", "lazy", "sad", "sick", "sorry", "all", "another", "actual",
               "massive", "huge", "giant", "proper", "biggest", "quite", "quite a", "like", "goddamn", "freaking", "typical", "arrogant", "ignorant", "useless", "brainless", "spineless", "talentless", "smug", "vile", "nasty", "rotten", "wretched"],
    "ADJ": ["absolute", "complete", "total", "utter", "fucking", "bloody", "damn", "fat", "ugly", "stupid", "dumb", "pathetic", "worthless", "lying", "miserable", "disgusting", "filthy", "lazy", "sorry", "goddamn", "freaking", "arrogant",
            "ignorant", "useless", "brainless", "spineless", "talentless", "smug", "vile", "nasty", "rotten", "wretched", "little", "big", "old", "sad", "sick"],
    "INS": [*_plural(_INSULT), *_INSULT_PHRASES],
    "FIRM": [*_plural([w for w in _INSULT if w not in _LOOSE]), *_INSULT_PHRASES],
    "BAD": "stupid dumb ugly pathetic worthless disgusting talentless brainless braindead useless moronic idiotic retarded vile repulsive trash garbage filth scum hideous despicable revolting contemptible subhuman insufferable".split() + ["fat and ugly", "beneath contempt"],
    "LOW": _LOWER + ["a disease", "a plague", "criminals", "rapists", "thieves", "inferior", "worthless", "kriminelle", "criminales", "ladrones", "degenerates", "invaders", "leeches", "lice", "insects", "terrorists", "apes", "a cancer", "a stain", "mongrels", "half human", "less than human", "not human", "not people"],
    "SEX": _EXPLICIT,
    "GROUP": [*_PEOPLE, *_PEOPLE_PHRASES],
    "TAIL": ["on this channel", "on this site", "on this platform", "like these", "like those", "like that", "like them", "around here", "from there", "in this country", "in this town", "in our country"],
    "HE": ["he", "she", *(f"the {w}" for w in "host guy man woman presenter narrator owner editor creator uploader speaker".split()), "the channel owner", *(f"{d} {w}" for d in ("this", "that") for w in "guy man woman host dude person channel presenter".split()), "this clown"],
    "HARM": "break kill hurt smash beat burn stab shoot strangle choke punch cut slit crush murder destroy end bury skin hang rape gut drown knife poison execute behead bash maim torture slap".split(),
    "HARMED": "dragged beaten shot hanged hung killed burned burnt stoned executed lynched whipped strangled castrated murdered hurt raped gassed tortured drowned stabbed punched slapped flogged beheaded skinned".split() + ["run over", "put down", "put against a wall", "locked away"],
    "SUFFER": "choke chokes die dies died dead burn burns drown drowns rot rots suffer suffers bleed bleeds crash crashes perish perishes starve starves".split() + ["get hit", "gets hit", "get run over", "gets run over", "fall off", "falls off", "lose a", "lose your", "get cancer", "gets cancer", "get hurt", "gets hurt", "drop dead", "drops dead", "never wake up"],
    "EXPEL": ["keep", "kick", "throw", "get", "chase", "drive", "deport", "send", "hunt", "ban", "burn", "beat", "shoot", "gas", "round up", "wipe out", "exterminate", "spit on", "lock up", "kill", "sterilize", "sterilise", "get rid of", "hang", "lynch", "cleanse", "purge", "expel", "eradicate"],
    "HARSH": ["deport", "ban", "burn", "beat", "shoot", "gas", "round up", "wipe out", "exterminate", "spit on", "lock up", "kill", "sterilize", "sterilise", "get rid of", "hang", "lynch", "purge", "expel", "eradicate", "hunt down", "hunt", "chase"],
    "AWAY": ["out", "away", "back", "off", "up", "home", "down"],
    "OUTCOME": ["kicked out", "ruin everything", "get rid of the lot of them", "get rid of them", "gassed", "deported", "never be allowed", "too stupid", "raus damit", "fuera todos", "go back to", "go home", "they are all", "bring that back", "wiped out", "do not belong", "don t belong"],
    "BANNED": ["shot", "killed", "sterilized", "sterilised", "banned", "removed", "locked up", "deported", "kicked out", "hanged", "gassed", "burned", "exterminated", "wiped out", "expelled", "silenced", "lynched", "put down", "thrown out", "driven out", "sent back"],
    "BODY": "dick cock pussy tits boobs ass nipples balls breasts body".split(),
    "THEM": "him her me you us them".split(),
    "FAMILY": "family mother mom mum father dad kids children parents wife husband face kind brain daughter son".split(),
    "WINK": list("😏🍆🍑😈🥵👅💦") + ["any day", "all night"],
    "ICAN": ["i", "we"],
    "PLUS": ["+"],
    "WILL": ["will", "ll", "am going to", "m going to", "m gonna", "am gonna", "gonna", "swear i will", "would love to", "want to", "wanna", "re going to", "are going to", "ought to", "promise to", "should"],
}
_GROUPS = "((all|these|those|the|most|every|damn|filthy|stupid)? (all|these|those|the|damn|filthy)? GROUP TAIL?)"

#: The grammar: class, weight and pattern over words (see grammar.Grammar). Each pattern is one machine; Grammar joins them all.
RULES: tuple[tuple[str, float, str], ...] = (
    # insult with a target
    ("abusive", 3, "YOU NOTNEG{0,4} FIRM"),
    ("abusive", 3, "YOU BE NOTNEG{0,4} INS"),
    ("abusive", 3, "YOU ADJ{1,4} INS"),
    ("abusive", 2.5, "YOU BE (such|just|so|too|this|really|that|all|truly|utterly|completely)* BAD"),
    ("abusive", 3, "what NOTNEG{0,4} INS (you|he|she)"),
    ("abusive", 2.5, "only NOTNEG{0,4} INS (would|could|thinks|says|believes)"),
    ("abusive", 2.5, "(get lost|shut up|cry about it|go away|go home|go to hell|piss off|fuck off|sit down|stfu|gtfo|cope|delete this|bye|die|get a life|get out) you? NOTNEG{0,4} INS"),
    ("abusive", 2.5, "# NOTNEG{0,4} (INS #)"),
    ("abusive", 3, "(your|ur) (whole|entire)? FAMILY (is|are|s)? NOTNEG{0,4} (INS|BAD)"),
    ("abusive", 2.5, "and so (are you|is (your|ur) (face|mother|family|brain))"),
    ("abusive", 3, "(your|ur) (mother|mom|mum|father|parents) (should|ought to) (have|never)"),
    ("abusive", 2.5, "imagine being (this|so|that) BAD"),
    ("abusive", 2.5, "(pathetic|disgusting|worthless|vile|miserable|wretched|despicable|repulsive) (creature|human|excuse|person|being|individual|waste|thing)"),
    ("abusive", 2.5, "(talentless|brainless|spineless) (hack|clown|loser|idiot|fool|fraud|nobody|coward|moron|hacks|clowns|losers|idiots|fools|frauds|cowards|morons)"),
    ("abusive", 2.5, "waste of (oxygen|space|air|skin|breath)"),
    ("abusive", 3, "(people|someone|somebody|anyone|creatures) (as|so) (worthless|stupid|dumb|ugly|useless|pathetic|disgusting|vile) as you"),
    ("abusive", 3, "you all? (look|smell|sound) like (something|what|a thing) (i|we|they|someone) (scraped|stepped|flushed|found under|coughed|vomited|threw)"),
    ("abusive", 2.5, "(crawl|go|slither) back (in|into|to|under) (your|the|that|whatever) (hole|cave|rock|sewer|swamp|mother)"),
    ("abusive", 2.5, "nobody (in . .{0,2}|here)? (wants|likes|needs|asked for) you (here|around|#)"),
    ("abusive", 3, "fuck (you|yourself|yourselves|off|u)"),
    ("abusive", 3, "go fuck"),
    ("abusive", 2, "(HE|whoever .{1,4}) (is|s|look like|looks like|sounds like|talks like|acts like|must be|was) NOTNEG{0,4} INS"),
    ("abusive", 2.5, "(everyone|everybody) (hates|despises|laughs at) you"),
    ("abusive", 2.5, "(i|we) (hate|despise|loathe) (you|u) (so much|with|all|people|#)"),
    ("abusive", 2.5, "halt (die|deine|doch die) (fresse|klappe|schnauze)"),
    ("abusive", 2.5, "(ta gueule|ferme (ta|la) gueule|callate|vete a la (mierda|verga)|va te faire (foutre|voir)|verpiss dich)"),
    ("abusive", 3, "(eres|sos|sois|tu es|t es|du bist|bist du|ihr seid|usted es) (so|un|una|ein|eine|einen|une|tan|si|el|la|mas|der|die|total|echt|vraiment|muy)* INS"),
    ("abusive", 2.5, "(das asco|espece (de|d) INS|sale INS)"),
    ("abusive", 3, "ты (просто|такой|такая|полный|полная)? (идиот~|урод~|дурак~|дура~|тупой~|тупая~|мразь~|ничтожество~|дебил~|скотина~|козел~|тварь~|кретин~)"),
    ("abusive", 2, "(заткнись|иди нахуй|пошел на|иди к черту|сдохни)"),
    # threats and wishes of harm
    ("abusive", 3, "ICAN (WILL|WILL (find|hunt you down|come) and?) HARM (you|YOUR|u|him|them|all of you)"),
    ("abusive", 3, "ICAN WILL (find|hunt) (you|u|him|her|them) (down|and HARM)"),
    ("abusive", 2.5, "(coming|come) (to|for|after) (you #|your (house|home|door|shop|family|place|studio|workshop|kids|children))"),
    ("abusive", 2.5, "(coming|come) (for|after) you (with|and|soon|tonight|next)"),
    ("abusive", 2.5, "watch your (back|step|mouth) (next|when|if|or|because|out)"),
    ("abusive", 2.5, "(better|#) watch your back"),
    ("abusive", 1.5, "ICAN know where (you|u|your (kids|family|mother)) (live|film|work|sleep|park|record|lives|go|goes)"),
    ("abusive", 3, "(hope|wish|pray|praying|hoping|want) that? (you|u|he|she|they|someone|somebody|(your|ur) .) (would|will|all|to|just|both|really)? (SUFFER|stabs|shoots|beats|hangs|kills)"),
    ("abusive", 3, "(burn|burns) YOUR (shop|house|home|studio|workshop|place|car) down"),
    ("abusive", 3, "(should|deserve to|deserves to|ought to|need to|needs to|must|gotta) (be|have been|get) HARMED"),
    ("abusive", 3, "(kys|kill (yourself|urself|yourselves)|go and? (die|hang yourself|drown yourself|jump off|play in (the)? traffic|choke)|drink bleach|(end|take) your own? life|jump off (a|the|that) (bridge|cliff|roof|building)|drop dead|unalive yourself)"),
    ("abusive", 3, "do (the world|us all|everyone|humanity) a (favour|favor) and (stop breathing|die|disappear|jump|vanish|end)"),
    ("abusive", 3, "stop breathing"),
    ("abusive", 3, "(nobody|no one|noone) would even? (miss|care|cry for|notice) if? you"),
    ("abusive", 2.5, "you (should|ought to) never? have (never)? been (aborted|drowned|born)"),
    ("abusive", 2.5, "you (should|deserve to|ought to) (die|suffer|rot|burn|choke|drown)"),
    ("abusive", 2.5, "down the drain #"),
    ("abusive", 3, "(your|ur) (days|hours) are numbered"),
    # demeaning a group
    ("hateful", 3, _GROUPS + " (do not|dont|don t|never|should not|shouldn t|shouldnt|must not|cannot|can t|have no|no) (deserve|belong|have any? (rights|place)|rights|be allowed|vote|breed|exist)"),
    ("hateful", 3, "EXPEL (all|up|the|these|those|every)* GROUP TAIL? AWAY"),
    ("hateful", 3, "HARSH (all|up|the|these|those|every|filthy|damn)* GROUP"),
    ("hateful", 3, "(keep|kick|throw|drive) (all|the|these|those)* GROUP TAIL"),
    ("hateful", 3, _GROUPS + " (are|is|re|sind|son|sont|was|were) (all|just|nothing but|alle|todos|todas|tous|a|an|una|une|the|like|worse than|no better than|always|only|such|literally|die|eine|really|basically){0,4} (LOW|BAD)"),
    ("hateful", 2, "they (are|re) (all|just|nothing but|a|an|the)+ LOW"),
    ("hateful", 3, "no country .{0,5} (with|because of|thanks to) " + _GROUPS),
    ("hateful", 3, _GROUPS + " (ruin|destroy|poison|infest|invade|pollute|stink|smell)"),
    ("hateful", 3, _GROUPS + " (.|#){0,10} (OUTCOME|should (all)? be BANNED)"),
    ("hateful", 3, "(i|we) (hate|despise|loathe|detest|cannot stand|can t stand) " + _GROUPS),
    ("hateful", 3, "(world|country|town|place|us) .{0,4} (without|free of|rid of) " + _GROUPS),
    ("hateful", 3, "(only good|the only good) (.) is a dead"),
    ("hateful", 2, "get rid of the lot of them"),
    ("hateful", 2, "go back to (where you came from|your own? country)"),
    ("hateful", 3, "(nigger|niggers|nigga|niggas|n1gger|n1ggers|n1gga|faggot|faggots|fagot|fagots|kike|kikes|tranny|trannies|spic|spics|chink|chinks|untermensch~|kanake~)"),
    # explicit or asking for it
    ("sexual", 3, "(send|show|flash|post|drop|gimme|give|share|sell|trade) (me|us|him|them|some|more|your|ur|those|the|all){0,3} SEX"),
    ("sexual", 3, "SEX (cam|cams|single|singles|pic|pics|photo|photos|video|videos|chat|girls|boys|date|dates|content|link|links|leak|leaks|show|near you|on my (channel|page|profile|bio|site))"),
    ("sexual", 2.5, "SEX .{0,10} (link in my? bio|click my profile|18 PLUS|18 plus|check my (bio|profile|channel)|in my bio)"),
    ("sexual", 3, "(stare|staring|stared|look|looking|gawk|gawking|ogle|drool|drooling|came|here) (only|just)? (at|for|over|to see) (her|his|their|your|those|the|them) .? SEX"),
    ("sexual", 3, "so SEX (watching|for|when|right now|thinking|looking|seeing)"),
    ("sexual", 3, "(i am|im|i m|make me|makes me|made me|get me|gets me|getting me|getting) (so|all|really|very)* (horny|hard|wet|aroused)"),
    ("sexual", 3, "(take off your clothes|take your clothes|take ur clothes|get (naked|undressed)|(strip|undress) for THEM)"),
    ("sexual", 3, "(want|need|love|like|see|imagine|picture|have|get) (you|u|her|him|them) (naked|nude|undressed|topless|in my bed|in bed|on top of me|inside me|under me)"),
    ("sexual", 3, "naked in my bed"),
    ("sexual", 3, "((wrapped|wrap them) around me|while we do it)"),
    ("sexual", 3, "(bang|screw|fuck|ride|do|smash|hit) (her|him|you|that ass|them) (all night|so hard|all night long|right (here|now)|until|raw|on (that|the|my))"),
    ("sexual", 2.5, "i would totally? let (you|him|her) .{1,8} me .{0,8} WINK"),
    ("sexual", 3, "(suck|lick|kiss|touch|grope|squeeze|fondle) (my|your|her|his|those|them) .? BODY"),
    ("sexual", 3, "sit on my face"),
    ("sexual", 3, "(want|wanna|love|like) to? (have sex|sleep|make love|hook up) with (you|her|him|me)"),
    ("sexual", 3, "(quiero (verte|tocarte|follarte|besarte)|verte desnud~|tocarte|ins bett|mit dir schlafen|schick mir? nacktbilder|nacktbilder|envoie moi? (des|tes)? (nudes|photos nues)|toute nue|coucher avec toi)"),
)
_GRAMMAR = Grammar(_CLASSES, [p for _, _, p in RULES])
# Rules that are aimed at a reader: fiction around them doesn't excuse them.
_AT_YOU = tuple(bool(re.search(r"\b(?:YOU|YOUR|you|your)\b", p)) for _, _, p in RULES)

# What governs the words behind it (or, where noted, around it), as one automaton of its own.
_REPORT, _SAID, _FICTION, _REMOVED, _NEGATED = range(5)
_MARK_CLASSES = {
    "SAYS": "said says wrote writes yelled shouted accused reported complained tells".split() + [f"told {w}" for w in ("me", "us", "him", "her", "them")],
    "OTHERS": "me him her them us people anyone someone you".split() + ["each other", "one another"],
    "SPEAK": "calling saying telling sending posting writing wishing".split(),
    "DONT": ["don t", "dont", "do not", "never", "nobody should", "no one should", "not ok to", "not okay to", "wrong to", "shouldn t", "should not", "against"],
}
_MARKERS: tuple[tuple[int, str], ...] = (
    (_REPORT, "(call|calls|called|calling) OTHERS"),
    (_REPORT, "SAYS"),
    (_REPORT, "(please|can we|could we|we should|let s|everyone) (stop|don t|dont|do not|quit|avoid)"),
    (_REPORT, "(stop|quit) SPEAK"),
    (_REPORT, "(DONT|report|reported|reporting) (this|him|the)? (call|say|tell|send|post|write|wish|be so|let anyone)"),
    (_SAID, "(said|says|wrote|writes|yelled|shouted|told (me|us|him|her|them)) #"),
    (_FICTION, "(villain|character|movie|novel|actor|actress|acting|lyrics|in the book)"),
    (_REMOVED, "(was|were|got|been) (removed|deleted|banned|reported|blocked)"),
    (_REMOVED, "now (he|she|they) (ask|asks|apologize|apologizes|apologise|apologises)"),
    (_NEGATED, "(do not|don t|dont|did not|didn t|didnt|does not|doesn t|doesnt|never|nobody|no one) (really)? (think|thinks|thought|believe|believes|mean|meant|want|wants|wanted|hope|hopes|hoped|wish|wishes|wished|saying|suggest|suggests)"),
    (_NEGATED, "(am|m|are|re|is|was) not (saying|suggesting|going to|gonna|hoping|wishing)"),
    (_NEGATED, "(will|would|could) (not|never)"),
    (_NEGATED, "(won t|wont|wouldn t|wouldnt|couldn t)"),
)
_MARKER = Grammar(_MARK_CLASSES, [p for _, p in _MARKERS])
_OF_A_REPLY = frozenset("reply replies comment comments message messages post posts account it that which who he she they".split())

_LOOKALIKE = str.maketrans("авеікмнорстухѕјһԁɡԛԝѵɑοαενικρτυχ", "abeikmhopctyxsjhdgqwvaoaeviкptux".replace("к", "k"))
_LOOKALIKE_SET = frozenset("авеікмнорстухѕјһԁɡԛԝѵɑοαενικρτυχ")
_LEET = str.maketrans("013457$@!|8", "oieastsaiib")
_FORMAT = re.compile("[​-‏‪-‮⁠-⁤﻿­͏]+")
_MARKS = re.compile("[̀-ͯ]+")
_ODD = re.compile(r"[a-z][*$@!|]+[a-z*$]|\*\w|\w\*|[a-z$@][0134578$@]|[0134578$@][a-z]|([a-z])\1\1|(?<!\w)\w[ .\-_]\w[ .\-_]\w(?!\w)")
_SPACED = re.compile(r"(?<![\w.-])(?:[a-z0-9$@][ .\-_]){2,}[a-z0-9$@](?![\w-])")
_CHUNK = re.compile(r"[a-z0-9$@!|*]+(?:'[a-z]+)?")
_HIDDEN = frozenset({*_INSULT, *_LOWER, *_EXPLICIT, *_SWEAR, "pieceofshit", *(w + "s" for w in _INSULT)})


def _skeleton(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", word)


_SKELETONS = {_skeleton(w): w for w in sorted(_HIDDEN)}
_BY_SHAPE: dict[tuple[str, str, int], str] = {(w[0], w[-1], len(w)): w for w in sorted(_HIDDEN, reverse=True)}


@lru_cache(200_000)
def _plain_word(word: str) -> str:
    """A disguised word of the lexicon as it is meant, anything else unchanged."""
    if word in _HIDDEN or word.isdigit():
        return word
    if "*" in word:
        core = word.strip("!|")
        if len(core) > 2 and core[0] != "*" and core.count("*") >= 1:
            pattern = re.compile("".join("[a-z]" if c == "*" else re.escape(c) for c in core.translate(_LEET)) + "$")
            found = _BY_SHAPE.get((core[0], core[-1], len(core))) if set(core[1:-1]) == {"*"} else None
            found = found or next((w for w in sorted(_HIDDEN) if len(w) == len(core) and pattern.match(w)), None)
            if found:
                return found
        return word
    bare = word.rstrip("!|")
    leet = bare.translate(_LEET) if re.search(r"[a-z]", bare) else bare
    for form in (leet, leet.replace("i", "l") if "1" in bare else leet):
        if form in _HIDDEN:
            return form
        if re.search(r"(.)\1\1", form):
            for keep in (r"\1", r"\1\1"):
                if (short := re.sub(r"(.)\1\1+", keep, form)) in _HIDDEN:
                    return short
            if (s := _skeleton(form)) in _SKELETONS:
                return _SKELETONS[s]
    return word


def _join(m: re.Match) -> str:
    letters = re.sub(r"[ .\-_]", "", m[0])
    for skip in (0, 1):  # the first letter may be an article
        for stop in (0, 1):
            found = _plain_word(letters[skip : len(letters) - stop])
            if found in _HIDDEN:
                return m[0][: 2 * skip] + found + (m[0][-2:] if stop else "")
    return m[0]


def normalise(text: str) -> str:
    """Small letters without marks, format characters, look-alike letters and the disguises of words in the lexicon."""
    low = text.lower()
    if not low.isascii():
        low = _MARKS.sub("", unicodedata.normalize("NFKD", _FORMAT.sub("", low)).replace("ß", "ss"))
        if any(c in _LOOKALIKE_SET for c in low) and re.search(r"[a-z]", low):
            low = re.sub(r"[^\W\d_]+", lambda m: m[0].translate(_LOOKALIKE) if re.search(r"[a-z]", m[0]) or set(m[0]) <= _LOOKALIKE_SET else m[0], low)
    if _ODD.search(low):
        low = _SPACED.sub(_join, low)
        low = _CHUNK.sub(lambda m: _plain_word(m[0]), low)
        low = low.replace("pieceofshit", "piece of shit")
    return low


_TOKEN = re.compile(r"\w+|[+😏🍆🍑😈🥵👅💦]|[.!?。！？।]+(?=\s)|\n|[,;:()\"“”„«»—–]|(?<=\s)-(?=\s)")
_EDGES = frozenset(".!?。！？।\n")
_SOFT = frozenset(',;:()"“”„«»—–-')
_QUOTES = frozenset(':"“”„«»')
_JOINING = frozenset("and but so because while although though yet or plus".split())
_ADVERBS = frozenset("all now then also".split())
_SUBJECTS = frozenset("i you u ya he she it we they this that these those the your my his her their our nobody there".split())
_NAMES: dict[str, int] = {}


def _symbol(word: str) -> int:
    """The grammar's symbol of a word; kept up to a bound."""
    found = _NAMES.get(word)
    if found is None:
        if len(_NAMES) > 500_000:
            _NAMES.clear()
        found = _NAMES[word] = _GRAMMAR.symbol(word)
    return found


def _sentences(text: str) -> Iterator[list[tuple[str, list[str]]]]:
    """Sentences of normalised text as clauses: (marks that open it, words). Clauses are cut at marks, and at joining words before a subject."""
    clauses: list[tuple[str, list[str]]] = [("", [])]
    tokens = _TOKEN.findall(text)
    for n, token in enumerate(tokens):
        first = token[0]
        if first in _EDGES:
            if len(clauses) > 1 or clauses[0][1]:
                yield clauses
            clauses = [("", [])]
        elif first in _SOFT:
            if clauses[-1][1]:
                clauses.append((token, []))
            else:
                clauses[-1] = (clauses[-1][0] + token, [])
        else:
            if token in _JOINING and clauses[-1][1]:
                after = tokens[n + 1 : n + 3]
                if after and (after[0] in _SUBJECTS or after[0] in _ADVERBS and after[1:] and after[1] in _SUBJECTS):
                    clauses.append((" ", []))
            clauses[-1][1].append(token)
    if len(clauses) > 1 or clauses[0][1]:
        yield clauses


def _governed(clauses: list[tuple[str, list[str]]]) -> tuple[list[int], list[int]] | None:
    """The marks transducer: for each word of a sentence the level from which it is blocked, and 0 where nothing governs it.

    Level 2 blocks a word for every rule (reports, pleas, removals and negation),
    level 1 for those that aren't aimed at the reader (fiction). The second list
    says where clauses begin. Null if no mark occurs.
    """
    starts, stream, place = [0], [], []
    for _, words in clauses:
        stream.append(EDGE)
        place.append(-1)
        for k, w in enumerate(words):
            stream.append(_MARKER.symbol(w))
            place.append(starts[-1] + k)
        starts.append(starts[-1] + len(words))
    found = _MARKER.matches([*stream, EDGE])
    if not found:
        return None
    ahead = starts[1:]  # by clause: the first word that a mark within it blocks
    whole, fiction = [False] * len(clauses), [False] * len(clauses)
    quoted_from = starts[-1]
    for at, patterns in found:
        edge = at >= len(stream) or stream[at] == EDGE
        end = place[at - 1] if edge else place[at]
        n = bisect_right(starts, end) - 1
        while not clauses[n][1]:
            n -= 1
        words = clauses[n][1]
        for kind in {_MARKERS[p][0] for p in patterns}:
            last = n + 1 == len(clauses)
            if kind in (_REPORT, _NEGATED):
                ahead[n] = min(ahead[n], end + 1)
                if kind == _REPORT and end + 1 == starts[n + 1] and not last:  # what is said follows: a quotation to the sentence's end, or a clause
                    whole[n + 1] = True
                    if any(c in _QUOTES for c in clauses[n + 1][0]):
                        quoted_from = min(quoted_from, starts[n + 1])
            elif kind == _SAID:
                whole[n] = True
                if n and len(words) <= 4:
                    whole[n - 1] = True
            elif kind == _FICTION:
                fiction[n] = True
                ahead[n] = min(ahead[n], end)
                if words[0] in ("in", "on", "from", "at") and not last:
                    whole[n + 1] = True
            else:
                whole[n] = True
                if n and ("now" in words[max(0, end - 2 - starts[n]) : end + 1 - starts[n]] or any(w in _OF_A_REPLY for w in words[max(0, end - 12 - starts[n]) : end + 1 - starts[n]])):
                    whole[n - 1] = True
    level = []
    for n, (_, words) in enumerate(clauses):
        for k in range(starts[n], starts[n + 1]):
            level.append(2 if whole[n] or k >= ahead[n] or k >= quoted_from else 1 if fiction[n] else 0)
    return level, starts


def matched_clauses(text: str | None) -> dict[tuple[int, str], dict[int, float]]:
    """Of every clause (its number in the text) and class, the rules that match and end in it."""
    if not text:
        return {}
    stream, owner, levels = [EDGE], [0], [0]
    clause = 0
    for clauses in _sentences(normalise(text)):
        words = [w for _, ws in clauses for w in ws]
        governed = _governed(clauses)
        stream += [_symbol(w) for w in words]
        for n, (_, ws) in enumerate(clauses):
            owner += [clause + n] * len(ws)
        levels += governed[0] if governed else [0] * len(words)
        clause += len(clauses)
        stream.append(EDGE)
        owner.append(clause - 1)
        levels.append(0)
    if not clause:
        return {}
    found: dict[tuple[int, str], dict[int, float]] = {}

    def add(symbols: list[int], at_you_alone: bool) -> None:
        for at, rules in _GRAMMAR.matches(symbols):
            for r in rules:
                if not at_you_alone or _AT_YOU[r]:
                    found.setdefault((owner[at], RULES[r][0]), {})[r] = RULES[r][1]

    top = max(levels)
    add([BLOCKED if lev else s for s, lev in zip(stream, levels)] if top else stream, False)
    if 1 in levels:
        add([BLOCKED if lev > 1 else s for s, lev in zip(stream, levels)], True)
    return found


def score(text: str | None, weights: Sequence[float] | None = None) -> tuple[float, float, float]:
    """The scores of a text for abuse, hate and sexual content; zeros for null and empty texts.

    A clause's score in a class is its best path (the heaviest rule that matches
    and ends in it), a text's score the sum over its clauses. ``weights``: of
    RULES, in order; theirs by default.
    """
    total = dict.fromkeys(CLASSES, 0.0)
    for (_, kind), rules in matched_clauses(text).items():
        total[kind] += max(rules.values() if weights is None else (weights[r] for r in rules))
    return tuple(total[c] for c in CLASSES)


def fit_weights(labels: Sequence[tuple[str | None, int, int, int]]) -> list[float]:
    """Weights of RULES in the light of labelled texts (text, abusive, hateful, sexual).

    A rule keeps its weight unless the texts it matches are mostly no cases: its
    smoothed precision (4 cases in 5 are supposed beforehand) lowers it in
    proportion once it is under 0.8. Labels are noisy, so one wrong label moves
    no weight. At most MAX_LABELS rows may be given.
    """
    if len(labels) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labelled rows")
    right, all_ = [0] * len(RULES), [0] * len(RULES)
    for text, *flags in labels:
        case = any(f == 1 for f in flags)
        for rule in {r for rules in matched_clauses(text).values() for r in rules}:
            all_[rule] += 1
            right[rule] += case
    return [w * min(1.0, (r + 4) / (n + 5) / 0.8) for (_, w, _), r, n in zip(RULES, right, all_)]


def score_texts(df: DataFrame, *, text: str, weights: Sequence[float] | None = None) -> DataFrame:
    """All columns of ``df`` with scores abusive, hateful, sexual, their greatest as score, and the verdict found.

    A weighted finite-state pattern grammar reads each text: a first transducer
    undoes disguises (marks, look-alike letters, digits for letters, spaced, masked
    or stretched words) and cuts sentences into clauses; a second, an automaton of
    marks, blocks the words that reports, pleas, removals, fiction and negation
    govern; its output is the input of the grammar, in which the machines for
    insults with targets, threats, demeaned groups and explicit offers or demands
    are joined in one deterministic automaton. Every clause adds the weight of
    its best path. Words alone never count, but for a few slurs. No word is
    tested beforehand: each text runs through the whole grammar.

    Null and empty texts score 0. Rows stay as they are, repeated ones too. One
    pass without shuffle; columns with the names of the results are replaced.
    ``weights``: from fit_weights.
    """

    @F.pandas_udf("abusive double, hateful double, sexual double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            yield pd.DataFrame([score(t, weights) for t in series], columns=list(CLASSES))

    names = [c for c in df.columns if c not in (*CLASSES, "score", "found")]
    out = df.select(*names, scored(F.col(text)).alias("__s")).select(*names, "__s.*")
    best = F.greatest(*(F.col(c) for c in CLASSES))
    return out.withColumn("score", best).withColumn("found", best >= ACCEPT)


def rates(scored: DataFrame, *by: str) -> DataFrame:
    """Texts, found texts and their share for each source; nulls in ``by`` make a source of their own. Counted before the shuffle."""
    counts = [F.count(F.lit(1)).alias("texts"), F.count_if("found").alias("found_texts"), *(F.count_if(F.col(c) >= ACCEPT).alias(f"{c}_texts") for c in CLASSES)]
    return scored.groupBy(*by).agg(*counts).withColumn("rate", F.col("found_texts") / F.col("texts"))
