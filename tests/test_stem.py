"""Stems by a hand table from the published description, phrases, nulls and the keywords of a theme."""

from pyspark.sql import functions as F

from reportloom.functions.stem import stem
from reportloom.operators.annotate import expand_keywords

# Word and stem, by step.
STEMS = dict(pair.split(">") for pair in """
caresses>caress ponies>poni ties>tie dies>die caress>caress cats>cat flies>fli skies>sky news>news gas>ga this>thi
feed>feed agreed>agre plastered>plaster bled>bled motoring>motor sing>sing died>die spied>spi succeed>succeed
conflated>conflat troubled>troubl sized>size hopping>hop tanned>tan falling>fall hissing>hiss fizzed>fizz failing>fail
filing>file using>use owed>owe owing>owe dying>die seeing>see being>be king>king string>string
happy>happi sky>sky say>say enjoy>enjoy by>by cry>cri
relational>relat conditional>condit rational>ration valenci>valenc hesitanci>hesit digitizer>digit conformabli>conform
radicalli>radic differentli>differ vileli>vile analogousli>analog vietnamization>vietnam predication>predic operator>oper
feudalism>feudal decisiveness>decis hopefulness>hope callousness>callous formaliti>formal sensitiviti>sensit sensibiliti>sensibl
triplicate>triplic formative>form formalize>formal electriciti>electr electrical>electr hopeful>hope goodness>good
revival>reviv allowance>allow inference>infer airliner>airlin gyroscopic>gyroscop adjustable>adjust defensible>defens
irritant>irrit replacement>replac adjustment>adjust dependent>depend adoption>adopt homologou>homolog communism>commun
activate>activ angulariti>angular homologous>homolog effective>effect bowdlerize>bowdler region>region
probate>probat rate>rate cease>ceas controll>control roll>roll
generalizations>gener oscillators>oscil operationally>oper hopefully>hope biology>biolog psychology>psycholog
failure>failur failures>failur communication>commun safety>safeti staffing>staf training>train policies>polici
assessment>assess assessments>assess monitoring>monitor nurses>nurs delayed>delay delays>delay referral>referr
yes>ye year>year years>year yellow>yellow yb>yb type>type syzygy>syzygi is>is a>a
""".split())
PHRASES = {"Systemic Improvements": "systemic improv", "lack of training": "lack of train", "cross-system communication": "cross-system commun", "": "", None: None}


def stems(spark, words):
    return {r[0]: r[1] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", stem("w")).collect()}


def test_hand_table(spark):
    assert stems(spark, STEMS) == STEMS


def test_phrases_end_in_a_stem(spark):
    assert stems(spark, PHRASES) == PHRASES


def test_no_python_in_the_plan(spark):
    plan = spark.range(1).select(stem(F.lit("words")))._jdf.queryExecution().toString()
    assert "Python" not in plan and len(plan) < 200_000


def test_keywords_with_their_stems(spark):
    rows = [("F", 0, "T", 0, "delays"), ("F", 0, "T", 1, "delay"), ("F", 0, "T", 2, "poor training")]
    fw = spark.createDataFrame(rows, "framework string, theme_idx int, theme string, kw_idx int, keyword string")
    got = expand_keywords(fw, stem).orderBy("kw_idx").collect()
    assert [r.keyword for r in got] == ["delays", "delay", "poor training", "poor train"]
