"""Every stage of the pipeline and all in a row on planted rows."""

import hashlib
import random

import corpus_pipeline
from ondol.llm import bpe

random.seed(11)
WORDS = [f"word{i}" for i in range(60)]


def prose(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


def test_planted(spark, tmp_path):
    from tokenizers import Tokenizer

    text, item, after = prose(90), prose(30), prose(20)
    rows = [(i, prose(20) + (" vileword" if i % 4 == 0 else "")) for i in range(100, 200)]
    rows += [(0, after + " vileword"), (1, text), (2, text), (3, " ".join(["new", *text.split()[1:-1], "end"])), (4, prose(40) + " " + item + " " + prose(20)), (5, None), (None, prose(30)), (8, after)]
    names = "doc_id long, text string, source string"
    docs = spark.createDataFrame([(*r, "s") for r in rows], names)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(100, 200)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    gone = {"toxicity": {0, *range(100, 200, 4)}, "line_dedup": {2}, "ngram_jaccard": {3}, "decontaminate": {4}}
    left = dict(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.write_out(stage(spark, docs, str(tmp_path)), "test-stage")
        left = {i: t for i, t in left.items() if i not in gone[name]}
        assert docs.columns == ["doc_id", "text", "source"]
        got = docs.collect()
        assert len(got) == len(left) and {r.doc_id: r.text for r in got} == left, name
    tok = Tokenizer.from_file(bpe.vocabulary_path())
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in left.items()}
    want = {(i, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for i, x in ids.items()}
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(found) == len(want) and {(r.doc_id, r.n_tokens, r.ids_sha256) for r in found} == want
