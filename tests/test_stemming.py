"""Stems against the public sample words of the algorithm."""

from pyspark.sql import functions as F

from tessera.functions import stemming, text

# Words and their stems, as published with the algorithm.
PUBLISHED = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist
consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol
consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson consort consort consorted consort
consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir
conspiring conspir constable constabl constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag
knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt
knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob
knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot"""
# By the rules, one or more for each.
RULES = """caresses caress ponies poni ties tie cries cri gas gas this this gaps gap kiwis kiwi agreed agre feed feed hopping hop hoping hope hoped hope luxuriated luxuri falling fall
filing file fizzed fizz sky sky cry cri by by say say happy happi relational relat conditional condit rational ration valency valenc hesitancy hesit digitizer digit
conformably conform radically radic differently differ vilely vile analogously analog vietnamization vietnam operator oper feudalism feudal decisiveness decis hopefulness hope
callousness callous formality formal sensitivity sensit sensibility sensibl geology geolog carelessly careless hopefully hope triplicate triplic formative format formalize
formal electricity electr electrical electr goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible
defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism communism activate activ angularity angular homologous
homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controlled control roll roll generously generous general general generate generat
arsenic arsenic communication communic dying die skies sky news news innings inning proceeding proceed succeeds succeed exceeded exceed youth youth boyish boyish enjoy enjoy
enjoyed enjoy singly singl bias bias paid paid bed bed bled bled beds bed shed shed using use used use ran ran running run runs run
runner runner easily easili fairly fair national nation organization organ flies fli dies die mules mule denied deni died die owned own humbled humbl sized size meeting meet
stating state siezing siez itemization item sensational sensat traditional tradit reference refer colonizer colon plotted plot"""


def pairs(table):
    flat = table.split()
    return list(zip(flat[::2], flat[1::2], strict=True))


def test_published_words():
    known = pairs(PUBLISHED) + pairs(RULES)
    assert len(known) >= 200
    assert [(w, stemming.stem(w)) for w, _ in known] == known


def test_words_of_a_text_are_stemmed(spark):
    df = spark.createDataFrame([(1, "The knights were knitting, hopefully!"), (2, None), (3, "")], "id long, t string")
    got = [r[0] for r in df.orderBy("id").select(text.tokenize(F.col("t"), stem=True)).collect()]
    assert got == [["knight", "knit", "hope"], [], []]
