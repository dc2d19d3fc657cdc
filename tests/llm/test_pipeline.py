import re
from collections import Counter, defaultdict

import corpus_pipeline
from orderlines.llm.length_packing import BUDGET
from orderlines.llm.quality_rules import _examine
from orderlines.llm.queries import QUERIES
from tests.llm import test_length_packing, test_line_dedup, test_quality_rules, test_simhash, test_source_mix
from tests.llm.conftest import TABLES

WORD = r"[^\x20\x09-\x0D]+"


def words(text):
    return len(re.findall(WORD, text or ""))


def run_stages(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, TABLES).cache()
        yield docs


def test_names_and_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash", "source_mix", "packing"]


def test_every_stage_by_brute_force(spark, table):
    docs = {r["doc_id"]: r for r in table.collect()}
    good, cut, single, mixed, packed = [df.collect() for df in run_stages(spark, table)]

    passed = {k for k, r in docs.items() if not test_quality_rules.brute(r["text"])[5]}
    limits = {k for k in passed if not _examine([docs[k]["text"].encode()])[6][0]}
    assert {r["doc_id"]: r for r in good} == {k: docs[k] for k in passed - limits}

    wanted = test_line_dedup.brute([(r["doc_id"], r["text"]) for r in good])
    left = {k: text.decode() for k, (text, _, gone) in wanted.items() if not gone or words(text.decode())}
    assert {r["doc_id"]: r["text"] for r in cut} == left and all(r["n_chars"] == len(r["text"]) for r in cut)

    rows = [(r["doc_id"], r["text"]) for r in cut]
    first = {group for _, group in test_simhash.brute_groups(rows)}
    assert sorted(r["doc_id"] for r in single) == sorted(first)

    sizes, taken, longest = defaultdict(int), Counter(), Counter()
    for r in single:
        sizes[r["source"]] += words(r["text"])
        longest[r["source"]] = max(longest[r["source"]], words(r["text"]))
    for r in mixed:
        taken[r["source"]] += words(r["text"])
    assert set(map(tuple, mixed)) <= set(map(tuple, single)) and max(Counter(r["doc_id"] for r in mixed).values()) <= 3
    for source, target in test_source_mix.brute_targets(sizes).items():
        assert abs(taken[source] - target) <= longest[source]

    assert Counter((r["doc_id"], r["length"]) for r in packed) == Counter((r["doc_id"], words(r["text"])) for r in mixed)
    test_length_packing.check(packed, BUDGET)


def test_run_is_the_registered_query(spark):
    key = lambda r: (r["doc_id"], r["batch"], r["slot"])
    one = sorted(map(key, corpus_pipeline.run(spark, TABLES).collect()))
    assert one == sorted(map(key, QUERIES["pipeline"](spark, TABLES).collect())) and len(one) > 50


def test_clean_documents_stay(spark, documents):
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    frames = list(run_stages(spark, documents([(i, text(i)) for i in range(30)])))
    assert [df.count() for df in frames[:3]] == [30, 30, 30]


def test_nulls_copies_hot_groups_and_nothing(spark, documents):
    long = " ".join(f"v{j}" for j in range(30000))
    body = " ".join(f"u{j}" for j in range(50))
    rows = [(1, None), (2, ""), (3, "short"), (None, body, None), (4, long), (5, long), (6, "junk " * 500)]
    rows += [(10 + i, body, "hot") for i in range(200)] + [(7, " ".join(f"t{j}" for j in range(60)), "q")] * 2
    frames = list(run_stages(spark, documents(rows)))
    for df in frames[:-1]:
        assert df.columns == documents([]).columns
    assert sorted(r["doc_id"] for r in frames[2].collect()) == [4, 7, 10]
    assert frames[-1].count() > 0
    assert [df.count() for df in run_stages(spark, documents([]))] == [0] * 5


def test_texts_go_to_python_once_and_in_small_batches(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F

    from orderlines.llm import texts

    spark.conf.unset(texts.BATCH_SETTING)
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a b c d "), 500).alias("text"))
    for bound in ("64m", "1k"):
        spark.conf.set(texts.BATCH_SETTING, bound)
        judged = corpus_pipeline.quality_rules_stage(spark, docs, "")
        assert spark.conf.get(texts.BATCH_SETTING) == ("1k" if bound == "1k" else str(texts.SENT_BYTES))
        assert texts.TEXT_BYTES not in judged._jdf.queryExecution().analyzed().toString()
        assert judged.dtypes == docs.dtypes
    spark.conf.set(texts.BATCH_SETTING, "64m")
    texts.small_batches(spark)
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").collect()
    assert max(r["n"] for r in sizes) <= texts.SENT_BYTES + 100_000
    spark.conf.unset(texts.BATCH_SETTING)
