import zlib

import numpy as np

from orderlines.llm.quality_classifier import FEATURES, discriminant, features, learn, score_quality, text_features
from orderlines.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    scored = QUERIES["op4_quality_classifier"](spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    assert len(scored) == 1000 and scored.score.between(0, 1).all()
    assert (scored.predicted == (scored.score >= 0.3)).all()
    assert (scored.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in scored.doc_id]).all()
    held = scored[scored.held_out].merge(labels, on="doc_id")
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.95


def test_labels_of_held_out_rows_teach_nothing(documents, spark):
    rows = [(i, f"word{i} text of a kind {i % 7}" * (1 + i % 5)) for i in range(60)]
    table = text_features(documents(rows))
    labels = [(i, i % 2) for i in range(60)]
    other = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels]
    one, two = (learn(table, spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, other))
    assert np.allclose(one.means, two.means) and one.log_odds == two.log_odds


def test_densities_by_brute_force():
    rng = np.random.default_rng(0)
    x = {0: rng.normal(0, 1, (50, len(FEATURES))), 1: rng.normal(1, 2, (80, len(FEATURES)))}
    model = discriminant({k: (len(v), v.sum(axis=0), v.T @ v) for k, v in x.items()})
    point = rng.normal(0, 1, len(FEATURES))
    logs = []
    for mean, factor in zip(model.means, model.factors):
        covariance = factor @ factor.T
        away = point - mean
        logs.append(-0.5 * (away @ np.linalg.inv(covariance) @ away + np.linalg.slogdet(covariance)[1]))
    from orderlines.llm.quality_classifier import TEMPER

    expected = 1 / (1 + np.exp(-(TEMPER * (logs[1] - logs[0]) + model.log_odds)))
    assert np.allclose(model.score(point[None])[0], expected)


def test_missing_classes_null_and_empty_texts(documents, spark):
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x " * 20000), (5, "!!!")]
    table = text_features(documents(rows, score="old"), keep=("doc_id", "score"))
    for labels in ([], [(3, 1)], [(3, 0), (5, 0)], [(3, None), (None, 1)]):
        model = learn(table, spark.createDataFrame(labels, "doc_id long, quality int"))
        found = score_quality(table, model, keep=("doc_id", "score")).collect()
        assert len(found) == 6 and all(0 <= r["score"] <= 1 for r in found)
        assert len({r["score"] for r in found if r["doc_id"] == 3}) == 1
    empty = text_features(documents([]))
    assert score_quality(empty, learn(empty, spark.createDataFrame([], "doc_id long, quality int"))).count() == 0
    assert all(np.isfinite(features(t)).all() for t in (None, b"", b"A", b"!" * 1000, "é".encode()))


def plain_features(text):
    """The sixteen statistics from characters, words and lines, one by one."""
    import math
    import re
    import statistics

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    is_in = lambda allowed: sum(c in allowed for c in text)
    upper, lower = (sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text))
    digits, symbols, stops = is_in("0123456789"), is_in("#*$%&|<>=+@^~_{}[]\\/"), is_in(".,;:!?")
    wide = sum(ord(c) >= 128 for c in text)
    blank = is_in(" \t\n\v\f\r")
    letters, seen = upper + lower + wide, len(text) - blank
    sizes = [len(w.encode()) for w in words]
    n = len(words)

    def logit(part, whole):
        share = (part + 0.5) / (whole + 1)
        return math.log(share / (1 - share)) if share < 1 else 20.0

    return [
        math.log(1 + n), math.log(1 + len(lines)),
        math.log(1 + statistics.mean(sizes)) if n else 0.0, math.log(1 + statistics.pstdev(sizes)) if n else 0.0,
        logit(upper, letters), logit(digits, seen), logit(symbols, seen), logit(stops, seen), logit(wide, letters),
        math.sqrt(len(set(words)) / n) if n else 1.0, len(set(lines)) / len(lines) if lines else 1.0,
        logit(max((words.count(w) for w in set(words)), default=0), n),
        len(set(zip(words, words[1:]))) / (n - 1) if n > 1 else 1.0,
        math.log(1 + n / len(lines)) if lines else 0.0,
        logit(text.count("."), stops), logit(text.count("!"), seen),
    ]


def test_query_by_brute_force(spark):
    """Features, moments, shrinkage and densities anew, with inverses in place of factors."""
    from orderlines.llm.quality_classifier import TEMPER, TO_POOLED, TO_SPHERE
    from tests.llm.conftest import TABLES

    docs = spark.read.parquet(f"{TABLES}/documents.parquet").collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{TABLES}/labels.parquet").collect()}
    x = {r["doc_id"]: np.array(plain_features(r["text"])) for r in docs}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 0 for k in x}
    groups = [np.array([x[k] for k in x if labels.get(k) == label and not held[k]]) for label in (0, 1)]
    assert min(map(len, groups)) > 3
    share = [(len(g) + 1) / (sum(map(len, groups)) + 2) for g in groups]
    scatters = [np.cov(g.T, bias=True) for g in groups]
    pooled = share[0] * scatters[0] + share[1] * scatters[1]
    pooled = (1 - TO_SPHERE) * pooled + TO_SPHERE * (np.trace(pooled) / len(FEATURES) + 1e-6) * np.eye(len(FEATURES))
    shrunk = [(1 - TO_POOLED) * s + TO_POOLED * pooled for s in scatters]

    def density(value, label):
        away = value - groups[label].mean(axis=0)
        return -0.5 * (away @ np.linalg.inv(shrunk[label]) @ away + np.linalg.slogdet(shrunk[label])[1])

    odds = np.log(share[1] / share[0])
    expected = {k: 1 / (1 + np.exp(-np.clip(TEMPER * (density(v, 1) - density(v, 0)) + odds, -500, 500))) for k, v in x.items()}
    found = {r["doc_id"]: r for r in QUERIES["op4_quality_classifier"](spark, TABLES).collect()}
    assert set(found) == set(expected)
    for k, r in found.items():
        assert abs(r["score"] - expected[k]) < 1e-6 and r["held_out"] == held[k] and r["predicted"] == int(r["score"] >= 0.3)
