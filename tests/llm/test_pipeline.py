"""The pipeline, stage by stage, against plain versions."""

from collections import Counter

import corpus_pipeline as P
from test_operators import bag, key, plain_components, rows_of, token_list

from vellum.llm import langid, mix, shards
from vellum.llm.queries import ORACLE_SQL, QUERIES


def overlaps(doc, item):
    """Whether 10 of 12 words in line are the same, laid side by side."""
    width = min(12, len(item))
    return len(item) >= 8 and any(
        sum(doc[p + k] == item[q + k] for k in range(width)) >= width - width // 6 for q in range(len(item) - width + 1) for p in range(len(doc) - width + 1)
    )


def test_stages(spark, odd, empty, tmp_path):
    folder = str(tmp_path)
    odd.write.parquet(f"{folder}/documents.parquet")
    item = next(t for d, t in rows_of(odd) if d == 119)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in P.STAGES:
        before, out = rows_of(docs), stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        got = rows_of(after)
        if name != "sharding":
            assert after.columns == docs.columns
        if name == "language_id":
            kept = {r["text"] for r in langid.predict(docs, langid.fit(docs)).filter("not rejected").collect()}
            assert bag(got) == bag((d, t) for d, t in before if t in kept) and None not in kept
        elif name == "near_dedup":
            groups = {c for _, n, c in plain_components(before, 80) if n}
            assert len(got) == len(groups) and {d for d, _ in got} == groups
        elif name == "decontamination":
            assert bag(got) == bag((d, t) for d, t in before if not overlaps(token_list(t), token_list(item))) and len(got) == len(before) - 1
        elif name == "mixing":
            times = Counter()
            for r in mix.mix(docs).collect():
                times[r["doc_id"]] += r["copies"]
            assert Counter(d for d, _ in got) == +times and set(got) <= set(before)
            sizes = {d: len((t or "").split()) for d, t in before}
            assert abs(sum(sizes[d] for d, _ in got) - 1.5 * sum(sizes.values())) <= max(sizes.values())
        else:
            assert bag(got) == bag(before)
            assert {c for c in after.columns if c.lower() == "shard"} == {"shard"}
            where = {r["doc_id"]: r["shard"] for r in shards.assign(docs).collect()}
            assert all(r["shard"] == where[r["doc_id"]] for r in after.collect())
        docs = after
    assert P.run(spark, folder).count() == docs.count()


def test_empty(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_registered():
    import __spark_entry__ as e

    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(e.queries()) and set(ORACLE_SQL) <= set(e.oracle_sql())
    assert key(None) > key(5)
