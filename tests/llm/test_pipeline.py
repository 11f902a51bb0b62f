import hashlib

import corpus_pipeline as pipeline
import public_tokenizers

import __spark_entry__ as entry
from souk.llm import bpe, decontaminate, secrets, toxicity
from tests_llm_brute import brute_classes, brute_fingerprint

SF = "/root/testdata/sf0.001"


def test_registered():
    names = entry.queries()
    assert names["pipeline"] is pipeline.run
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))
    assert [s for s, _ in pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "secret_scan", "byte_bpe"]


def test_whole_pipeline_against_brute_force(spark):
    docs, labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    score = toxicity.scorer(toxicity.learn(docs, labels, 3, 1))
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect() if score(r["text"] or "") < pipeline.TOXIC_AT)
    label = brute_classes([brute_fingerprint(t) for _, t in rows], 4)
    rows = [r for i, r in enumerate(rows) if label[i] == i]
    matcher = decontaminate.Matcher([(r["item_id"], r["text"]) for r in items.collect()], 0.1, 32)
    rows = [(d, t) for d, t in rows if not matcher.find(decontaminate.normal(t or ""))]
    model = secrets.learn(spark.createDataFrame(rows, "doc_id long, text string"))
    encoding = bpe.load_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    want = {}
    for d, t in rows:
        t = secrets.redact_text(t or "", secrets.all_spans(t or "", model))
        ids = encoding.encode_ordinary(t)
        want[d] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pipeline.run(spark, SF).collect()}
    assert got == want


def test_stages_keep_the_columns(spark, odd, tmp_path):
    for name, rows in (("labels", [(1, 1, 0)]), ("benchmark", [(1, "x")])):
        schema = "doc_id long, quality int, toxic int" if name == "labels" else "item_id long, text string"
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = odd
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == odd.columns
    assert pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
