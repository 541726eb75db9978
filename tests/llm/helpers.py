"""Small documents for the training-data operators, edge cases included."""

import random

WORDS = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so said what up its about into than them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through years where much your way down should because each just those people how too little state good very make world still see own work men day get here old life both between being under three never know same last another while us might great go come since against right came take used himself few house use during without place american however home small found".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + ("," if rng.random() < 0.05 else "") + (".\n" if rng.random() < 0.05 else "") for _ in range(n))


def edited_words(rng, text, share):
    return " ".join(rng.choice(WORDS) + "x" if rng.random() < share else w for w in text.split(" "))


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    docs = [(i, prose(rng, rng.randint(5, 300)), rng.choice(["en", "de"]), f"src{i % 3}") for i in range(n)]
    texts = [d[1] for d in docs]
    docs += [(n + i, edited_words(rng, texts[i], 0.01), "en", "src0") for i in range(10)] + [(n + 10 + i, texts[i], "en", "src0") for i in range(5)]
    return docs


EDGES = [(900, None, None, None), (901, "", "en", None), (902, " \n\t ", "en", "src0"), (903, "word", "en", "src1"), (904, "é́ ñ ﬁ 中文 😀 a  b\x00c", None, "src1"), (905, "long " * 30000, "en", "src2"), (905, "long " * 30000, "en", "src2"), (None, "no id here", "en", "src1")]
SCHEMA = "doc_id long, text string, lang string, source string, score double, start string, kept string, n_chars long"


def frame(spark, rows):
    """documents with extra columns whose names clash with those of results."""
    return spark.createDataFrame([(*r, 0.5, "s", "k", len(r[1] or "")) for r in rows], SCHEMA).repartition(3)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
