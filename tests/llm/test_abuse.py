import pytest

from loomspan.llm.abuse import ACCEPT, normalise, rates, score, score_texts

ABUSIVE = [
    "You are such a moron, delete your channel.", "he looks like a d u m b a s s and talks like one too", "Only a scuuuumbag would say that.", "The host is a lying l0$er who never sanded anything.",
    "Everyone in Varrow knows you are a bitc​h.", "The host is a lying d*****s who never unpacked anything.", "Your whole family is trash and so are you.", "kys", "I know where you film and I will break your hands.",
    "Watch your back next time you are in Varrow.", "one more chisel video and I am coming to your house with a hammer", "I hope you choke on that crank, seriously.", "go play in traffic", "Ta gueule, espèce de crétin.",
    "Eres una basura y das asco.", "ты просто идиот и урод", "Du bist so ein Vollidiot, halt die Fresse.", "f-u-c-k you and your homemade hull", "whoever oiled this should be dragged out and beaten", "nice video!\nget lost PIECE OF SHIT.",
]
HATEFUL = [
    "the deaf do not deserve rights.", "foreigners are vеrmіn and should be kicked out.", "No country ever got better with refugees in it.", "In Varrow we used to chase old people away with dogs, bring that back.",
    "Of course it broke, villagers like these built it. Get rid of the lot of them.", "Ausländer sind alle p*******s, raus damit.", "Los inmigrantes son una plaga, fuera todos.", "I spit on believers whenever I see them in Varrow.",
    "Keep women on this channel out, they ruin everything they touch.", "we should round up nomads, they are fil7h", "Another video by villagers like these. They are all cockroaches.",
]
SEXUAL = [
    "send n.u.d.e.s please", "hot n***s cams here, click my profile 🔞", "so h0rny watching you dismantle that lathe", "take your clothes off, nobody cares about the pedal", "meet tits singles in Varrow tonight, link in my bio",
    "I want you naked in my bed tonight", "those legs, I want them wrapped around me while we do it", "ich will mit dir ins Bett, schick mir Nacktbilder", "quiero verte desnuda y tocarte toda la noche",
    "I would let you sketch me on that workbench any day 😏", "who else came here only to stare at her boobs", "the way he handles that loom makes me want to strip for him",
]
INNOCENT = [
    "holy shit that weld is clean", "That damn easel finally works!", "I am such an idiot, I left the lens cap on.", "The villain calls him scum at 3:14, great acting.", "Someone called me a moron here and the reply was removed, thanks.",
    "My uncle used to call me stupid for liking slow cooking, now he asks for help.", "Please stop calling each other losers in this thread.", "Burn it down and start again, that terrarium is trash.", "this stupid kettle ate my weekend",
    "I would kill for a chisel like that.", "you killed it with the brass finish", "dead bug under the loom at 11:52 lol", "The blue tits at the feeder stole the show.", "The cock of the weather vane is felt.",
    "Sexual dimorphism in mantises starts at 10:35, great shots.", "Visible to the naked eye from Varrow!", "Hot copper on bare skin hurts, wear gloves.", "Foreigners welcome? I would love to visit Varrow in July.",
    "Immigrants from Varrow brought glass blowing here, lovely history.", "Women built the 1981 mandolin, great segment at 10:35.", "An ass pulled the cart with the gasket, what a patient donkey.", "Retard the ignition timing by 27 degrees and it runs.",
    "He was hit by the hull, hope he recovers.", "Never shoot weather balloons at noon, it kills the contrast.", "Dumb question: does the canvas need oil?", "The Scunthorpe of kettles, I love it.", "Screw the Ardwell and use resin.", "", None,
]


@pytest.mark.parametrize("n,texts", [(0, ABUSIVE), (1, HATEFUL), (2, SEXUAL)])
def test_found(n, texts):
    assert [t for t in texts if score(t)[n] < ACCEPT] == []
    assert [t for t in texts if score(t.upper().replace("​", "​"))[n] < ACCEPT and t.isascii()] == []


def test_innocent():
    assert [t for t in INNOCENT if max(score(t)) >= ACCEPT] == []


def test_normalise():
    assert normalise("ріесе оf shіt") == "piece of shit"
    assert normalise("v4.4.1 at 10:15, a.m. b-52") == "v4.4.1 at 10:15, a.m. b-52"


def test_labels(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/comment_labels.parquet").collect()
    agree = sum((max(score(r.text_original)) >= ACCEPT) == (r.abusive + r.hateful + r.sexual > 0) for r in labels)
    assert agree / len(labels) >= 0.96  # about 2 % of the labels are wrong


def test_frames(spark):
    rows = [("a", "v", "kys", "x"), ("a", "v", "kys", "x"), ("b", "v", None, "x"), ("c", None, "hi " * 50_000 + "go fuck yourself", "x"), ("d", "w", "", "x")]
    df = spark.createDataFrame(rows, "id string, video string, text string, found string")
    out = score_texts(df, text="text")
    assert sorted((r.id, r.found) for r in out.collect()) == [("a", True), ("a", True), ("b", False), ("c", True), ("d", False)]
    got = {(r.video, r.texts, r.found_texts, r.rate) for r in rates(out, "video").collect()}
    assert got == {("v", 3, 2, 2 / 3), (None, 1, 1, 1.0), ("w", 1, 0, 0.0)}
    assert score_texts(df.limit(0), text="text").collect() == []
