import random

from souk.llm import decontaminate as dec

SF = "/root/testdata/sf0.01"


def distance_to_any_part(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i] + [0] * len(text)
        for j, d in enumerate(text, 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d))
        row = new
    return min(row)


def test_equal_to_brute_force_edit_distance():
    rnd = random.Random(5)
    for _ in range(120):
        item = dec.normal("".join(rnd.choice("abcd ") for _ in range(rnd.randint(60, 90))))
        changed = list(item)
        for _ in range(rnd.randint(0, 9)):
            changed[rnd.randrange(len(changed))] = rnd.choice(["", "x", "yz", " "])
        text = dec.normal("".join(rnd.choice("abcd ") for _ in range(150)) + "".join(changed) + "".join(rnd.choice("abcd ") for _ in range(60)))
        found = dec.Matcher([(1, item)], 0.1, 32).find(text)
        best = distance_to_any_part(item, f" {text} ")
        assert bool(found) == (best <= int(0.1 * len(item)))
        if found:
            assert found[0][1] == best


def test_short_items_match_within_their_budget_as_words():
    rnd = random.Random(11)
    hits = 0
    for _ in range(300):
        item = dec.normal("".join(rnd.choice("abcd ") for _ in range(rnd.randint(8, 31))))
        changed = list(item)
        for _ in range(rnd.randint(0, 3)):
            changed[rnd.randrange(len(changed))] = rnd.choice(["", "x", "yz", " "])
        text = dec.normal("q " + "".join(changed) + rnd.choice([" ", ""]) + "".join(rnd.choice("abcd ") for _ in range(20)))
        found = dec.Matcher([(1, item)], 0.1, 32).find(text)
        best = distance_to_any_part(f" {item} ", f" {text} ")
        assert bool(found) == (best <= int(0.1 * len(item))), (item, text)
        if found:
            hits += 1
            assert found[0][1] == best
    assert 0 < hits < 300
    m = dec.Matcher([(1, "the cat"), (2, ""), (3, None), (4, "...")], 0.1, 32)
    assert [f[:2] for f in m.find("see the cat run")] == [(0, 0)]
    assert m.find("the cats") == [] and m.find("") == [] and [f[0] for f in m.find("the cat")] == [0]


def test_spans_are_code_points_of_the_text(spark):
    item = "Alpha beta gamma delta, epsilon zeta eta theta iota kappa lambda"
    text = "É intro.  ALPHA  beta gamma—delta epsilon zeta eta theta iota kappa lambda! tail"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = dec.leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert (row["item_id"], row["distance"]) == (7, 0)
    assert text[row["start"]:row["end"]] == "ALPHA  beta gamma—delta epsilon zeta eta theta iota kappa lambda"


def test_spans_where_lower_case_is_longer(spark):
    item = "the quick brown fox jumps over the lazy dog again"
    text = "\u0130" * 8 + " \u0130stanbul " + item + " end"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = dec.leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert row["distance"] == 0 and text[row["start"]:row["end"]] == item


def test_every_planted_item_is_found_and_clean_documents_stay(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = {r["item_id"]: r["text"] for r in items.collect()}
    rows = docs.collect()
    planted = {(r["doc_id"], i) for r in rows for i, t in texts.items() if t in (r["text"] or "")}
    for chars in (4_000_000, 2_000):  # one block, several blocks
        got = {(r["doc_id"], r["item_id"]) for r in dec.leaks(docs, items, block_chars=chars).collect()}
        assert planted <= got and len(got - planted) <= 0.05 * len(got)
        kept = {r["doc_id"] for r in dec.clean(docs, items, block_chars=chars).collect()}
        assert kept == {r["doc_id"] for r in rows} - {d for d, _ in got}


def test_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "One small text with password abcdef0123456789abcd"), (2, None), (3, "")], "item_id long, text string")
    found = dec.leaks(odd, items).collect()
    assert sorted(r["doc_id"] for r in found) == [1, 1, 9]
    kept = dec.clean(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3
    assert dec.leaks(empty, items).collect() == [] and dec.clean(empty, items).collect() == []
    none = spark.createDataFrame([], "item_id long, text string")
    assert dec.leaks(odd, none).collect() == [] and dec.clean(odd, none).count() == odd.count()
