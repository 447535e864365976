"""The pipeline's run against the operators' brute-force versions, stage by stage."""

import random

import pytest

import corpus_pipeline
from pairwright.llm import sentencepiece
from test_ops import plain_base, plain_clusters, plain_contamination, plain_fertility, say


@pytest.fixture()
def folder(spark, tmp_path):
    rng = random.Random(21)
    passage = say(rng, 14)
    lines = [say(rng, 12) for _ in range(4)]
    texts = {k: "\n".join(say(rng, 15) for _ in range(8)) for k in range(150)}
    texts[150] = texts[3]
    texts[4] = say(rng, 150)
    texts[151] = texts[4].replace(texts[4].split()[50], "other", 1)
    texts[152] = texts[5] + "\n" + passage + "\n" + say(rng, 40)
    texts[153] = say(rng, 60) + "\n" + "\n".join(lines) + "\n" + say(rng, 61)
    texts[154] = say(rng, 62) + "\n" + "\n".join(lines) + "\n" + say(rng, 63)
    texts[155] = say(rng, 10)
    texts[156] = "again and again " * 60
    texts[157] = None
    docs = [(k, t, "en", "s", len(t or "")) for k, t in texts.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, say(rng, 20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), texts, passage


def test_run(spark, folder):
    path, texts, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        if name != "encoding":
            assert docs.columns == columns
        docs = corpus_pipeline.staged(docs, "test")
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    rejected = plain_fertility(list(texts.items()), "en")
    good = {d for d, t in texts.items() if not plain_base(t)[5] and not rejected[d][2]}
    assert set(seen["quality rules"]) == good
    assert {155, 156, 157}.isdisjoint(good)
    lines = seen["line dedup"]
    assert set(lines) == good
    assert lines[3]["text"] == texts[3]
    assert lines[150]["text"] == ""
    assert len(lines[154]["text"].split("\n")) == 2
    assert all(r["n_chars"] == len(r["text"]) for r in lines.values())
    groups = plain_clusters([(d, r["text"]) for d, r in lines.items()], 5, 80)
    assert set(seen["near-dedup"]) == {d for d, (_, c) in groups.items() if c == d}
    assert 4 in seen["near-dedup"] and 151 not in seen["near-dedup"]
    held = plain_contamination([(d, r["text"]) for d, r in seen["near-dedup"].items()], [(1, passage)])
    assert set(seen["decontamination"]) == {d for d, x in held.items() if x[2] == 0}
    assert 152 not in seen["decontamination"]
    assert set(seen["encoding"]) == set(seen["decontamination"])
    assert all(r["round_trip"] for r in seen["encoding"].values())
    import sentencepiece as public

    sp = public.SentencePieceProcessor(model_proto=sentencepiece.unigram_model(sentencepiece.read_model(sentencepiece.MODEL_PATH)))
    for d, r in seen["encoding"].items():
        want = sp.encode(seen["decontamination"][d]["text"])
        # Pieces of one total score may stand in another order.
        assert sorted(r["token_ids"]) == sorted(want) and sp.decode(r["token_ids"]) == sp.decode(want)
    whole = corpus_pipeline.run(spark, path)
    assert {r["doc_id"]: r["token_ids"] for r in whole.collect()} == {d: r["token_ids"] for d, r in seen["encoding"].items()}
