import random

import numpy as np
import pytest

pytest.importorskip("folioscope.llm")

from folioscope.llm.abuse import CATEGORIES, Reader, TrainRule, abuse_scores, apply, fit_on_labels, train  # noqa: E402
from folioscope.llm.codepoints import Mapper, driver_tables  # noqa: E402

PLAIN = ["The analysis of the {} reduces the {}.", "In 2003 the {} was repeated and the {} held.", "Why does the {} matter for the {}?", "See the {} and the {} in the table."]
NOUNS = "pump cable report bench sensor archive chapter valve sample index".split()
BAD = {"abusive": ["You are a complete {} and everybody knows it.", "Shut your mouth, you {}!"], "hateful": ["All {} people are vermin, throw them out.", "Send every {} back where they crawled from."]}
FILL = {"abusive": ["moron", "idiot", "imbecile", "cretin"], "hateful": ["Orsian", "Velarian", "Kelmuk"]}
FINE = ["The word “moron” was once a clinical term.", "The archive holds a letter with the insult “idiot” in it.", "The {} press called the Orsian people “vermin”."]


def corpus(n, seed):
    rng = random.Random(seed)
    texts, y = [], []
    for _ in range(n):
        s = [rng.choice(PLAIN).format(rng.choice(NOUNS), rng.choice(NOUNS)) for _ in range(rng.randrange(3, 9))]
        label = [0.0, 0.0, 0.0]
        r = rng.random()
        if r < 0.3:
            c = rng.choice(["abusive", "hateful"])
            word = rng.choice(FILL[c])
            if rng.random() < 0.3:
                word = rng.choice([" ".join(word), word.replace("i", "1"), word.replace("o", "0"), word[:2] + "*" + word[3:]])
            s.insert(rng.randrange(len(s)), rng.choice(BAD[c]).format(word))
            label[CATEGORIES.index(c)] = 1.0
        elif r < 0.4:
            s.insert(0, rng.choice(FINE).format("old"))
        if rng.random() < 0.02:
            label[0] = 1 - label[0]
        texts.append(" ".join(s))
        y.append(label)
    return texts, np.array(y)


def test_held_out_accuracy():
    reader = Reader(Mapper(driver_tables()))
    texts, y = corpus(1500, 1)
    model = train(texts, y, TrainRule(), reader)
    new, true = corpus(500, 2)
    p = apply(model, reader, new)
    for c in (0, 1):
        hit = p[:, c] >= model.threshold[c]
        t = true[:, c] > 0
        assert 2 * (hit & t).sum() / (hit.sum() + t.sum()) > 0.9
    assert not (p[:, 2] >= model.threshold[2]).any()  # a category without examples is never reported


def test_reader_undoes_disguise():
    reader = Reader(Mapper(driver_tables()))
    for a, b in (("m o r o n", "moron"), ("m0r0n", "moron"), ("MORON", "moron"), ("mоrоn", "moron"), ("moooron", "moron"), ("m​oron", "moron"), ("m.o.r.o.n", "moron")):
        assert reader.bags([f"you {a} there"]).word.tolist() == reader.bags([f"you {b} there"]).word.tolist()
    assert len(reader.bags([None, "", "  "]).word) == 0


def test_letters_late_in_long_words_count():
    reader = Reader(Mapper(driver_tables()))

    def grams(text):
        b = reader.bags([text])
        w, g = reader.grams(b, np.arange(len(b.word)), 1 << 18)
        return [sorted(g[w == k].tolist()) for k in range(len(b.word))]

    long = "bundesausbildungsgesetz"
    a, b = grams(long + "idiot"), grams(long + "plan")
    assert len(a[0]) == 1 + 28 + 27 + 26 and len(set(a[0]) - set(b[0])) > 10
    assert grams("ab") == [sorted(grams("ab cd")[0])] and len(grams("x" + "yz" * 5000)[0]) > 29_000
    assert reader.grams(reader.bags([""]), np.zeros(0, np.int64), 1 << 18)[0].tolist() == []


def test_sample_is_bounded_in_characters(spark):
    texts, y = corpus(60, 5)
    docs = spark.createDataFrame([*enumerate(texts), (99, "x" * 10_000)], "doc_id long, text string")
    lab = spark.createDataFrame([(k, k, "r", *map(int, v)) for k, v in enumerate(y)] + [(99, 99, "r", 1, 0, 0)], "label_id long, doc_id long, rater string, abusive int, hateful int, sexual int")
    small = fit_on_labels(docs, lab, TrainRule(chars=3000, buckets=1 << 12))
    whole = fit_on_labels(docs, lab, TrainRule(buckets=1 << 12))
    assert (small.score != 0).sum() < (whole.score != 0).sum() and small.buckets == 1 << 12
    none = fit_on_labels(docs, lab, TrainRule(chars=1))
    assert (none.threshold > 1).all()


def test_many_equals_bags():
    reader = Reader(Mapper(driver_tables()))
    texts, _ = corpus(60, 3)
    a, b = reader.bags(texts), reader.many([*texts], at_once=7)
    assert a.word.tolist() == b.word.tolist() and a.sentence.tolist() == b.sentence.tolist() and a.text.tolist() == b.text.tolist()


def test_operator(spark):
    texts, y = corpus(300, 4)
    docs = spark.createDataFrame([(k, t, "s", 1) for k, t in enumerate(texts)] + [(900, None, "s", 1), (901, "", None, 1)], "doc_id long, text string, source string, abusive int")
    labels = [(k, k, "r", int(v[0]), int(v[1]), int(v[2])) for k, v in enumerate(y)]
    labels += [labels[0], (5000, 1, "q", None, 0, 0), (5001, 77777, "q", 1, 1, 1)]
    lab = spark.createDataFrame(labels, "label_id long, doc_id long, rater string, abusive int, hateful int, sexual int")
    model = fit_on_labels(docs, lab)
    out = abuse_scores(docs, model, keep=["source"])
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == 302 and got[900]["hateful"] == 0.0 and not got[901]["abusive_flag"]
    none = fit_on_labels(docs, lab.where("false"))
    assert abuse_scores(docs, none).where("abusive_flag or hateful_flag or sexual_flag").count() == 0
    assert abuse_scores(docs.limit(0), model).count() == 0
