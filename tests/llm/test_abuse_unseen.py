"""Sentences written after the grammar, without trying it: its recall and precision on them are those of the README."""

from loomspan.llm.abuse import ACCEPT, score

CASES = [
    "you absolute donkey, nobody asked for your garbage opinions", "shut your mouth you filthy pig", "what an arrogant prick you are", "he's nothing but a lying weasel", "you guys are all spineless cowards",
    "I swear I'll break your legs if you post again", "someone should put a bullet in your head", "hope your house burns down with you in it", "we're coming for you tonight", "you deserve to die alone",
    "kill yourself, loser", "go jump off a cliff", "your mother must be ashamed of such an idiot", "this presenter is a complete imbecile", "only a cretin believes this",
    "women are too stupid to drive", "muslims are a cancer", "all gypsies are thieves", "deport every one of these refugees", "gays should be locked up",
    "black people are animals", "I hate jews", "the world would be better without immigrants", "disabled people do not deserve to live", "ban all muslims from this country",
    "send me your nudes", "I want to have sex with you", "show us your boobs", "your ass looks so good I want to grab it", "hot singles near you want sex, click my profile",
    "get naked for us", "I'm so horny right now", "suck my dick", "du bist ein Arschloch", "eres un gilipollas", "ты дурак", "Die Ausländer sind alle Kriminelle", "tu es un vrai connard",
]
OTHERS = [
    "you are a genius, thank you", "this stupid screw will not come out", "I was an idiot to buy the cheap one", "my cat is a little monster", "he killed that solo", "the enemy should be shot first in level three",
    "people who say women can't weld are wrong", "she said he was a fool in the play", "don't be so hard on yourself", "I hate this glue", "you beat me to it", "do not hit the panel too hard or you will break it",
    "the refugees built this lovely boat", "muslims and christians cooked together here", "gay people are welcome in this workshop", "black paint looks better", "the jews of this town made clocks",
    "they told me to go home and rest", "you can shoot raw photos with it", "hang the picture higher", "burn the edges slightly", "the great tit is my favourite bird", "sex of the plant is visible at week six",
    "naked wires are dangerous", "my dad called me useless when I was ten", "please report anyone who writes kys", "nobody should be told to die", "the villain is a psycho, what a film",
    "bloody brilliant work you mad man", "sick beat, dude", "what a clown fish, so pretty", "rats ate my cable", "the worm gear is worn", "trash day is Monday", "you look like my brother", "are you going to cut the board?",
    "I will find you a better link", "we will burn the old wood", "come to my house and see the real thing", "I know where you can buy it",
]


def test_sentences_the_grammar_was_not_written_for():
    found = [max(score(t)) >= ACCEPT for t in CASES]
    wrong = [max(score(t)) >= ACCEPT for t in OTHERS]
    print([t for t, f in zip(CASES, found) if not f], [t for t, f in zip(OTHERS, wrong) if f])
    assert sum(found) / len(found) >= 0.75
    assert sum(found) / (sum(found) + sum(wrong)) >= 0.9
