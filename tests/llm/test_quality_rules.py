import re
from collections import Counter

from souk.llm import quality_rules as rules

SF = "/root/testdata/sf0.01"


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    tri = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def measured(rows):
    return {(r["doc_id"]): (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows}


def test_measures_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = measured(rules.judge(docs).collect())
    assert got == {r["doc_id"]: brute(r["text"]) for r in docs.collect()}


def test_odd_texts(spark, odd, empty):
    got = rules.judge(odd).collect()
    assert len(got) == odd.count()
    assert measured(got) == {r["doc_id"]: brute(r["text"]) for r in odd.collect()}
    assert all(not r["kept"] for r in got if r["base_failed"])
    assert rules.judge(empty).collect() == []


def test_windows_overlap_and_repeat(spark):
    texts = ["a b c a b c", "a a a a", "a b c x a b c y b c x", "a b", "a b c", "l\nl\n\nl \nl"]
    docs = spark.createDataFrame([(i, t, "x", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    assert measured(rules.measures(docs).collect()) == {i: brute(t) for i, t in enumerate(texts)}


def test_limits_follow_the_cell_and_fall_back(spark):
    clean = [(i, " ".join(f"word{j}n{i}" for j in range(60)), "en", "big") for i in range(30)]
    junk = [(100 + i, " ".join(f"word{j}n{i}###" for j in range(60)), "en", "big") for i in range(3)]
    other = [(200, " ".join(f"word{j}$$$" for j in range(60)), "en", "small"), (201, " ".join(f"word{j}" for j in range(60)), None, None)]
    docs = spark.createDataFrame(clean + junk + other, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in rules.judge(docs, least=10).collect()}
    assert all(kept[i] for i in range(30)) and kept[201]
    assert not any(kept[i] for i in (100, 101, 102, 200))


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = rules.judge(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_held_out_verdicts_follow_the_quality_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = rules.judge(docs).filter("not base_failed").join(labels, "doc_id").collect()
    assert sum(r["kept"] == bool(r["quality"]) for r in rows) >= 0.97 * len(rows)
