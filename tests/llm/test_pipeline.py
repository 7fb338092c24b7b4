"""The pipeline's stages one after another on a small corpus, against plain computations on what each was given."""

import random
import re
import zlib

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_stages(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_operators import plain_components

    draw = random.Random(8)
    words = ["".join(draw.choice("aeioustrnl") for _ in range(draw.randint(2, 7))) for _ in range(400)]
    rows, labels = [], []
    for i in range(150):
        bad = i % 5 == 2
        text = " ".join(draw.choice(words) + ("$$$" if bad else "") for _ in range(draw.randint(30, 60)))
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(200 + i, rows[i][1].replace(" ", "\n", 3), "en", "s0", 1) for i in range(0, 10)]
    rows += [(300 + i, rows[i][1] + " tail", "en", "s1", 1) for i in range(10, 20)] + [(400, None, "en", None, 0), (401, "", None, "s2", 0)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        seen.append(docs.collect())
    good = {r["doc_id"] for r in seen[0]}
    clean = {i for i, q, _ in labels if q and zlib.crc32(str(i).encode()) % 5 == 0}
    assert clean <= good and not {i for i in range(150) if i % 5 == 2} & good
    first = {}
    for r in sorted(seen[0], key=lambda r: r["doc_id"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), r["doc_id"])
    assert sorted(r["doc_id"] for r in seen[1]) == sorted(first.values())
    assert sorted(r["doc_id"] for r in seen[2]) == sorted({c for _, _, c in plain_components([(r["doc_id"], r["text"]) for r in seen[1]])})
    before = {r["doc_id"]: r["text"] for r in seen[2]}
    assert all((before[r["doc_id"]] or "").startswith(r["text"][:20]) for r in seen[3])
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = sorted((r["doc_id"], plain.encode(r["text"], add_special_tokens=False).ids) for r in seen[3])
    assert sorted((r["doc_id"], list(r["ids"])) for r in seen[4]) == expected


def test_mixed_texts_are_whole(spark):
    import corpus_pipeline
    from framelake.llm import mixing

    draw = random.Random(2)
    rows = [(i, "\n ".join("w%d" % draw.randrange(90) for _ in range(draw.randint(1, 300))), "en", f"s{i % 4}", 7) for i in range(60)]
    rows += [(100 + i, "only  one " * 20 * (i + 1), "en", f"t{i}", 7) for i in range(6)]  # sources of one document
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    given = {r[0]: r for r in rows}
    out = [tuple(r) for r in corpus_pipeline.mixed_sources(spark, docs, "").collect()]
    assert out and all(r == given[r[0]] for r in out)
    times = {i: sum(r[0] == i for r in out) for i in given}
    for r in mixing.mix(docs)[1].collect():
        assert times[r["doc_id"]] == (2 * r["taken"] + r["size"]) // (2 * r["size"])
