import math
import random

import numpy as np

from souk.llm import langid

SF = "/root/testdata/sf0.01"


def brute_phrases(text, learned):
    """Fewest-phrase greedy parse by plain substring search."""
    n = at = 0
    while at < len(text):
        size = 1
        while at + size <= len(text) and text[at:at + size] in learned:
            size += 1
        at += max(1, size - 1)
        n += 1
    return n


def test_parse_equals_brute_force():
    rnd = random.Random(4)
    learn = {"x": "".join(rnd.choice("abc ") for _ in range(400)).strip(), "y": "".join(rnd.choice("abd ") for _ in range(300)).strip()}
    learn = {k: " ".join(v.split()) for k, v in learn.items()}
    automata = langid.Automata(learn)
    texts = [" ".join("".join(rnd.choice("abcdz ") for _ in range(rnd.randint(1, 300))).split()) or "a" for _ in range(60)]
    got = automata.entropies(texts)
    for text, row in zip(texts, got):
        for n, lang in enumerate(automata.languages):
            want = brute_phrases(text, learn[lang]) * math.log2(len(learn[lang])) / len(text)
            assert abs(row[n] - want) < 1e-9


def test_long_texts_are_parsed_in_lanes():
    learn = {"x": "abcabcabc", "y": "bcdbcd"}
    automata = langid.Automata(learn)
    text = "abcbcd" * 500
    want = [sum(brute_phrases(text[i:i + langid.LANE], learn[k]) for i in range(0, len(text), langid.LANE)) * math.log2(len(learn[k])) / len(text) for k in "xy"]
    assert np.allclose(automata.entropies([text])[0], want)


def test_scripts_with_many_letters():
    rnd = random.Random(8)

    def words(letters, n):
        return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 6))) for _ in range(n))
    han, kana, hangul = [chr(0x4E00 + 7 * i) for i in range(600)], [chr(0x3042 + i) for i in range(60)], [chr(0xAC00 + 13 * i) for i in range(600)]
    scripts = {"zh": han, "ja": han[:200] + kana, "ko": hangul, "en": list("abcdefghijklmnopqrstuvwxyz"), "ru": [chr(0x430 + i) for i in range(32)],
               "x": [chr(0x250 + i) for i in range(60)], "y": [chr(0x561 + i) for i in range(38)], "z": [chr(0x10D0 + i) for i in range(33)]}
    learn = {k: words(v, 500) for k, v in scripts.items()}
    texts = {k: words(v, 40) for k, v in scripts.items()}
    automata = langid.Automata(learn)
    got = automata.entropies(list(texts.values()))
    assert [automata.languages[int(np.argmin(row))] for row in got] == list(texts)
    for text, row in zip(texts.values(), got):
        for n, lang in enumerate(automata.languages):
            assert abs(row[n] - brute_phrases(text, learn[lang]) * math.log2(len(learn[lang])) / len(text)) < 1e-9
    # letters that no language has fit none
    thai = automata.entropies([words([chr(0xE01 + i) for i in range(40)], 40)])[0]
    assert thai.min() > got.min(axis=1).max()
    # both kinds of transitions make the same moves
    for dense in (0, 1 << 40):
        assert np.allclose(langid.Automata(learn, dense).entropies(list(texts.values())), got)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.identify_all(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)


def test_a_long_document_leaves_room_for_the_others(spark):
    rnd = random.Random(2)
    rows = [(0, "de", "lang " * 20_000), *((i, "de", " ".join(f"{chr(96 + i) * 3}{c}" for c in "abcdefgh" * 20)) for i in range(1, 21))]
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    automata = langid.learn(docs)
    assert 23_000 <= automata.length["de"] <= 24_000
    got = automata.entropies([f"{chr(96 + i) * 3}a {chr(96 + i) * 3}b {chr(96 + i) * 3}c" for i in range(1, 21)])
    # each of the documents' own texts is one phrase or two
    assert (got[:, 0] * 14 / math.log2(automata.length["de"]) < 2.5).all()
    assert langid._even(["ab", "cdefgh", "i"], 9) == "ab cdef i" and langid._even(["ab", "c"], 100) == "ab c"


def test_odd_rows(spark, odd, empty):
    got = langid.identify_all(odd).collect()
    assert len(got) == odd.count()
    by_id = {r["doc_id"]: r for r in got}
    assert {by_id[i]["lang_pred"] for i in (2, 3, 6, 8)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in got)
    assert set(r["lang_pred"] for r in got) <= {"und", "en", "de", "fr"}
    assert langid.identify_all(empty).collect() == []


def test_no_labels_and_one_language(spark):
    docs = spark.createDataFrame([(i, "some text", None if i % 2 else "en") for i in range(20)], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in langid.identify_all(docs).collect()} == {("en", 1.0)}
    none = docs.withColumn("lang", docs["lang"].substr(9, 0)).filter("lang is null")
    assert {(r["lang_pred"], r["score"]) for r in langid.identify_all(none).collect()} == {("und", 0.0)}
