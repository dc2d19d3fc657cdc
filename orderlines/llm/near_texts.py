"""Near copies by the Jaccard similarity of their five-word shingles, as links between SimHash fingerprints.

The similar pairs come from the exact join of ``shingle_join``, so none is missed; texts with the same
shingles (other case, spaces or repeats) are linked with one of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlines.functions.storage import marked, materialize, settle
from orderlines.llm.shingle_join import (
    SHINGLE_WORDS,
    SIMILARITY,
    linked_sets,
    shingle_counts,
    signed_sets,
    texts_by_hash,
)
from orderlines.llm.simhash import fingerprint
from orderlines.llm.texts import map_texts


def near_links(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY, text: str = "text") -> DataFrame:
    """Links (a, b) between the fingerprints of texts whose similarity is at least ``similarity``, a fraction.

    Every component of the similar texts is connected by links; not every pair of it is one. Texts are told apart by
    hash. Null texts and texts without words have no links; an empty table gives an empty result.
    """
    mark = marked(docs.sparkSession)
    counts = shingle_counts(docs, text, SHINGLE_WORDS)
    signed = materialize(signed_sets(docs, counts, text, (), SHINGLE_WORDS, similarity), "signed-texts")
    pairs, _ = linked_sets(signed, docs, text, SHINGLE_WORDS, similarity)
    texts = signed.where("n_shingles > 0").select("set_id", "text_hash").distinct()
    first = materialize(texts.groupBy("set_id").agg(F.min("text_hash").alias("first_text")), "first-texts")
    of_set = [first.select(F.col("set_id").alias(side), F.col("first_text").alias(f"{side}_text")) for side in ("first", "second")]
    apart = pairs.join(of_set[0], "first").join(of_set[1], "second").select("first_text", "second_text")
    inside = texts.join(first, "set_id").where("text_hash != first_text").select("first_text", F.col("text_hash").alias("second_text"))
    links = materialize(apart.unionByName(inside), "text-links")

    ends = links.select(F.col("first_text").alias("text_hash")).unionByName(links.select(F.col("second_text").alias("text_hash")))
    wanted = materialize(ends.distinct(), "linked-texts")
    found = texts_by_hash(docs, text, wanted)
    prints = map_texts(
        found, lambda values: [np.array([fingerprint(v) for v in values], np.uint64).view(np.int64)], "fingerprint long", "text", ("text_hash",)
    )
    prints = materialize(prints, "linked-fingerprints")
    of_text = [prints.select(F.col("text_hash").alias(f"{side}_text"), F.col("fingerprint").alias(name)) for side, name in (("first", "a"), ("second", "b"))]
    between = links.join(of_text[0], "first_text").join(of_text[1], "second_text").select("a", "b")
    # The links are small; what they were found with need not lie beside the tables of the next step.
    return settle(between, "near-links", mark)
