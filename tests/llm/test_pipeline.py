import hashlib
from collections import Counter

import corpus_pipeline

from .conftest import edge_rows
from .test_exact_and_near import brute_components, shingles


def staged(spark, docs, folder):
    out = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage{i}")
        docs = spark.read.parquet(f"{folder}/stage{i}")
        out.append(docs)
    return out


def test_stages_take_effect(spark, copies, tmp_path):
    folder = f"file://{tmp_path}"
    rows = [(i, t + (" you scoundrel" if i % 6 == 0 else ""), "en", f"s{i % 3}", len(t)) for i, t in copies.items()]
    rows += [(1000 + i, f"filler number {i} with words {i * 7}" + (" scoundrel" if i % 6 == 0 else ""), "en", "s0", 9) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int("scoundrel" in r[1])) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    clean, exact, near, mixed, coded = staged(spark, df, folder)
    texts = {r[0]: r[1] for r in rows}
    kept = {r.doc_id for r in clean.collect()}
    assert kept == {i for i, t in texts.items() if "scoundrel" not in t}
    last = {}
    for i in sorted(kept):
        last[texts[i]] = i
    assert {r.doc_id for r in exact.collect()} == set(last.values())
    part = brute_components({i: shingles(texts[i], 5) for i in last.values()})
    assert {r.doc_id for r in near.collect()} == {i for i in part if part[i] == i}
    assert all(f.columns == df.columns for f in (clean, exact, near, mixed))
    times = Counter(r.doc_id for r in mixed.collect())
    assert set(times) <= set(part) and max(times.values()) == 2
    got = coded.collect()
    assert Counter(r.doc_id for r in got) == times
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in got)
    final = corpus_pipeline.run(spark, folder)
    assert Counter(r.doc_id for r in final.collect()) == times


def test_stages_at_the_edges(spark, docs, no_docs, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert len(edge_rows()) == docs.count()
    for name, df in (("edges", docs), ("none", no_docs)):
        folder = tmp_path / name
        folder.mkdir()
        spark.read.parquet(f"{tmp_path}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
        kept = staged(spark, df, str(folder))
        assert all(f.columns == df.columns for f in kept[:-1])
        assert (kept[-1].count() > 0) == (name == "edges")
