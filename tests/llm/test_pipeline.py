"""The pipeline against brute force on a small corpus."""

import random
from collections import defaultdict

import corpus_pipeline
from codeweir.llm.mixing import Mix
from tests.llm.test_operators import brute_links, brute_mix


def test_pipeline_decisions(spark, tmp_path):
    rng = random.Random(12)
    vocab = [f"term{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(240):
        w = rng.choices(vocab, k=rng.randint(20, 80))
        if i % 8 == 0:
            w[3:3] = ["foulword", "foulwords"]
        rows.append([i, " ".join(w), "en", f"src{i % 20}", 0])
        labels.append((i, int(i % 5 > 0), int(i % 8 == 0)))
    for i in range(240, 260):  # exact copies but for spaces, then near copies
        text = rows[(i - 240) * 3 + 1][1]
        rows.append([i, text.replace(" ", "  ", 1) if i < 250 else text + " tail", "en", "src1", 0])
    spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf, before, seen = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, sf)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        ids = [r["doc_id"] for r in after.select("doc_id").collect()]
        assert name == "packing" or len(ids) == len(set(ids))
        seen.append(set(ids))
        if name != "packing":
            assert after.columns == before.columns
            before = after
    texts = {r[0]: r[1] for r in rows}
    toxic = {i for i, t in texts.items() if "foulword" in t}
    assert seen[0] == set(texts) - toxic
    first = {}
    for i in sorted(seen[0]):
        first.setdefault(" ".join(texts[i].split()), i)
    assert seen[1] == set(first.values())
    links = brute_links([(i, texts[i]) for i in sorted(seen[1])], 5, 80)
    assert seen[2] == {i for i, c in links.items() if i == c}
    groups = defaultdict(int)
    for i in seen[3]:
        groups[i] += 1
    assert seen[3] < seen[2] and seen[4] == seen[3]
    assert seen[3] == brute_mix(spark, [(i, texts[i], rows[i][2], rows[i][3]) for i in sorted(seen[2])], Mix())
    assert corpus_pipeline.ORACLE_SQL is None
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()} == seen[4]
