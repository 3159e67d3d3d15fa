import random
import unicodedata

import pytest

pytest.importorskip("folioscope.llm")

from folioscope.llm.codepoints import LOOK_ALIKES, Mapper, _fold_char, driver_tables, explode, rebuild  # noqa: E402
from folioscope.llm.same_look import consistent_text, look_alike_pairs  # noqa: E402

SCHEMA = "run_id long, doc_id long, text string"


@pytest.fixture(scope="module")
def mapper():
    return Mapper(driver_tables())


def test_explode_and_rebuild_round_trip():
    texts = ["", "аб", None, "𝔘x", "เก็บ"]
    flat, off = explode(texts)
    assert rebuild(flat, off) == [t or "" for t in texts]


def test_agrees_with_unicode_normalization(mapper):
    rng = random.Random(5)
    letters = [chr(c) for c in (*range(0x41, 0x7B), *range(0xC0, 0x250), *range(0x300, 0x340), *range(0x915, 0x940), 0x93C, *range(0x1E00, 0x1F00), 0x1100, 0x1161, 0x11A8)]
    texts = ["".join(rng.choice(letters) for _ in range(9)) for _ in range(2000)]
    want = [" ".join(unicodedata.normalize("NFC", "".join(map(_fold_char, t))).split()) for t in texts]
    assert mapper.consistent(texts, look_alikes=False) == want


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("Стенд", "Cтeнд", True), ("é", "é", True), ("ﬁt", "fit", True), ("ＡＢ１", "AB1", True), ("ﾃﾞｰﾀ", "データ", True), ("a​b", "ab", True),
     ("a b", "a b", True), ("⼈", "人", True), ("x", "X", False), ("é", "e", False), ("x2", "x²", False), ("1", "2", False), ("a*", "a", False), ("ё", "е", False)],
)
def test_what_looks_the_same(mapper, a, b, same):
    x, y = mapper.consistent([a, b])
    assert (x == y) is same


def test_consistent_text_keeps_nulls_and_columns(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, " ​ ", "k"), (3, "Ｘ  y ", "k")], "id long, text string, form string")
    got = {r["id"]: r["form"] for r in consistent_text(df, "text").collect()}
    assert got == {1: None, 2: "", 3: "X y"}


def test_pairs_against_brute_force(spark, mapper):
    rng = random.Random(2)
    back = {v: k for k, v in LOOK_ALIKES.items()}
    rows, k = [], 0
    for doc in range(4):
        for _ in range(12):
            base = rng.choice(["Open case", "Copy pace", "CAB", "ace"])
            t = "".join(back.get(c, c) if rng.random() < 0.3 else c for c in base)
            t = t.replace(" ", rng.choice([" ", "  ", " "])) + rng.choice(["", " ", "​"])
            rows.append((k, doc, t))
            k += 1
    rows += [rows[3], (900, 0, None), (901, 0, ""), (902, None, "CAB"), (903, 1, "  ")]
    got = {tuple(r) for r in look_alike_pairs(spark.createDataFrame(rows, SCHEMA), "doc_id", "run_id", "text").collect()}
    one = {r[0]: r for r in rows if r[1] is not None and r[2]}
    want = set()
    for a in one.values():
        for b in one.values():
            fa, fb = mapper.consistent([a[2], b[2]])
            sa, sb = mapper.squeezed([a[2], b[2]])
            if a[0] < b[0] and a[1] == b[1] and fa and fa == fb and sa != sb:
                want.add((a[0], b[0]))
    assert got == want and want


def test_empty_table(spark):
    assert look_alike_pairs(spark.createDataFrame([], SCHEMA), "doc_id", "run_id", "text").count() == 0
