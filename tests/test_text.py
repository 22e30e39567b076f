from impactrank.functions import text as T
from impactrank.operators.index import term_frequencies
from pyspark.sql import functions as F

#: Words and their stems, a few for each step of the published rules.
PAIRS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky
relational relat conditional condit rational ration digitizer digit conformably conform radically radic differently differ vilely vile analogously analog
vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formality formal
sensitivity sensit sensibility sensibl triplicate triplic formative form formalize formal electricity electr electrical electr hopeful hope goodness good
revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac
adjustment adjust dependent depend adoption adopt communism commun activate activ angularity angular homologous homolog effective effect bowdlerize bowdler
probate probat rate rate cease ceas controll control roll roll as as is is by by toy toi yes ye syzygy syzygi 1999 1999 b b""".split()


def test_suffix_rules_on_known_words(spark):
    words, stems = PAIRS[::2], PAIRS[1::2]
    got = spark.createDataFrame(list(enumerate(words)), "n int, w string").select("n", T.stemmed(F.array("w"), "p")[0].alias("s")).orderBy("n").collect()
    assert {w: r.s for w, r in zip(words, got)} == dict(zip(words, stems))


def test_stems_by_vocabulary_count_as_those_of_each_word(spark):
    docs = spark.createDataFrame([(1, "Hopping hops hop, it's"), (2, None), (3, "relational relate RELATIONS relate")], "doc_id long, text string")
    one_by_one = docs.select("doc_id", F.explode(T.stemmed(T.tokens(F.col("text")), "p")).alias("t")).groupBy("t", "doc_id").count()
    got = sorted(map(tuple, term_frequencies(docs, stemmer="p").collect()))
    assert got == sorted(map(tuple, one_by_one.collect())) and ("hop", 1, 3) in got and ("relat", 3, 4) in got
    wanted = spark.createDataFrame([("hop",)], "term string")
    assert [tuple(r) for r in term_frequencies(docs, wanted, stemmer="p").collect()] == [("hop", 1, 3)]
