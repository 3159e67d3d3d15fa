import random

import numpy as np
import pytest

pytest.importorskip("folioscope.llm")

from folioscope.llm.codepoints import Mapper, driver_tables  # noqa: E402
from folioscope.llm.sentences import NOP, Splitter, paragraph_sentences, sentences, transducer  # noqa: E402


@pytest.fixture(scope="module")
def splitter():
    return Splitter(Mapper(driver_tables()))


def cut(splitter, text):
    _, a, b = splitter.split([text])
    return [text[x:y] for x, y in zip(a.tolist(), b.tolist())]


CASES = [
    ["Первое предложение.", "Второе в 2010 г.", "Третье и т. д.", "Конец"],
    ["Dr. Velorin and Prof. G. Seldahl came.", "They left at 5 p.m.", "The end!"],
    ["J. G. Rasvik wrote: “One thing. Another.”", "Then he left."],
    ["Am 6. August kam der Plan von Veldahl jun.", "Warum?", "Siehe S. 2 ff.", "Ende."],
    ["18. Выполнить выбор данных.", "Отзыв подписал Линадзин Б. Т.", "Рассмотрены датчики."],
    ["В 1993 г. Ветарцев показал план.", "Вышло плохо... но анализ верен."],
    ["“压力升高了。马上停机！”记录中写道。", "他问：“真的吗？”", "见图3.5。"],
    ["「圧力が上がった。」と記録にある。", "図書室の精度は…まだ不明である。"],
    ["औसत मान 66.36 कि.ग्रा. था।", "डॉ. तोरमल के अनुसार।", "क्यों?"],
    ["«ارتفع الضغط. أوقفوا المضخة!» هكذا ورد في السجل.", "يرى د. لنداس أن.", "لماذا؟"],
    ["pH was 3.5, e.g. low.", "pH is 4.", "See v2.1.11 of a.b.txt."],
]


@pytest.mark.parametrize("parts", CASES)
def test_known_boundaries(splitter, parts):
    sep = "" if parts[0][0] in "“「" else " "
    assert cut(splitter, sep.join(parts)) == parts


def test_thai_blanks(splitter):
    assert cut(splitter, "การเลือกดิน ทำไมต้องมี ผลจาก 19 ชุดแสดง 80 MPa ในดิน") == ["การเลือกดิน", "ทำไมต้องมี", "ผลจาก 19 ชุดแสดง 80 MPa ในดิน"]


def test_positions_blank_invisible_and_missing_blank(splitter):
    text = " ​ Reihen.Die Auswahl gilt.​ \nMore​"
    assert cut(splitter, text) == ["Reihen.", "Die Auswahl gilt.", "More"]


def test_unpaired_marks_do_not_swallow(splitter):
    assert cut(splitter, "He said “stop. Then he left. The end.") == ["He said “stop.", "Then he left.", "The end."]


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 7, 40])
def test_quotations_nested_to_any_depth(splitter, depth):
    marks = ["«»", "“”", "()", "[]"]
    inner = "one. Two."
    for k in range(depth - 1):
        a, b = marks[k % 4]
        inner = f"word {a}{inner}{b} Three. Four."
    parts = [f"He said «{inner}» and went on.", "Next (a (b. C) d. E) goes on.", "End."]
    assert cut(splitter, " ".join(parts)) == parts


def test_nesting_against_a_stack(splitter):
    rng = random.Random(8)
    from folioscope.llm.sentences import C_CLOSE, C_END, C_OTHER

    texts = ["".join(rng.choice("«»()a. ") for _ in range(rng.randrange(0, 30))) for _ in range(300)]
    joined = "\x00".join(texts) + "\x00"
    cps = np.array([ord(c) for c in joined])
    cls = splitter.cls[cps]
    cls[cps == 0] = C_END
    inner = set(splitter._quotes(cps, cls).tolist())
    want, stack = set(), []
    for i, k in enumerate(cls.tolist()):
        if k == C_END:
            stack = []
        elif joined[i] in "«(" and k != C_OTHER:
            want |= {i} if stack else set()
            stack.append(i)
        elif k == C_CLOSE and stack:
            stack.pop()
            want |= {i} if stack else set()
    assert inner == want


def test_prefix_scan_equals_one_run():
    fsm = transducer()
    rng = random.Random(3)
    strings = [[rng.randrange(fsm.symbols) for _ in range(rng.randrange(0, 300))] for _ in range(60)]
    sym = np.array([s for x in strings for s in x], np.uint8)
    off = np.cumsum([0, *map(len, strings)])
    state_next, out = fsm.next, fsm.out
    want = []
    for s in strings:
        q = 0
        for c in s:
            want.append(out[q, c])
            q = state_next[q, c]
    for chunk in (1, 2, 7, 64, 1000):
        assert fsm.run(sym, off, NOP, chunk).tolist() == [bool(x) for x in want]


def test_very_long_text(splitter):
    text = "Это предложение номер один. " * 20000
    _, a, b = splitter.split([text, None, "", "  "])
    assert len(a) == 20000 and b[-1] == len(text.rstrip())


def test_operator_nulls_extra_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "Aaa bbb. Ccc ddd.", 5, "x"), (2, None, 6, "y"), (3, "", 7, "z"), (1, "Aaa bbb. Ccc ddd.", 5, "x")], "k long, t string, start_pos int, text string")
    rows = sorted(map(tuple, sentences(df.drop("start_pos"), ["k"], "t").collect()))
    assert rows == [(1, 0, 8), (1, 0, 8), (1, 9, 17), (1, 9, 17)]
    assert sentences(df.limit(0), ["k"], "t").count() == 0


def test_paragraphs_join_runs(spark):
    schema = "run_id long, doc_id long, block_id string, run_ord int, kind string, text string, loaded_at string"
    rows = [(1, 9, "p-1", 0, "text", "Die Pum", "a"), (1, 9, "p-1", 0, "text", "Die Pum", "b"), (2, 9, "p-1", 1, "text", None, "a"),
            (3, 9, "p-1", 2, "text", "pe. Neu.", "a"), (4, 9, "p-1", 3, "citation", None, "a"), (5, 9, "fig-1", 0, "text", "No. A.", "a"),
            (6, 9, None, 0, "text", "X.", "a")]
    got = sorted(map(tuple, paragraph_sentences(spark.createDataFrame(rows, schema)).collect()))
    assert got == [(9, "p-1", 0, 10), (9, "p-1", 11, 15)]
