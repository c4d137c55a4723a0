"""How op5's words are counted."""

from collections import Counter

from pyspark.sql import functions as F

from pagemill.llm import maxent


def test_words_are_asked_for_once(spark, monkeypatch, tmp_path):
    """Counts of all words and the answers to blocks came from two passes over all texts."""
    plain, log = maxent.X.over_blocks, str(tmp_path / "asked")

    def noted(packed, work, schema):
        asks = isinstance(schema, str)

        def own(batch_id, *more):
            if asks:
                with open(log, "a") as f:
                    f.write(f"{batch_id}\n")
            yield from work(batch_id, *more)

        return plain(packed, own, schema)

    monkeypatch.setattr(maxent.X, "over_blocks", noted)
    docs = spark.range(0, 40, 1, 2).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a b b"), F.col("id"), F.lit("c " * 50)).alias("text"))
    _, known, scored = maxent.fitted(docs, train=F.col("doc_id") < 30, rounds=1, block_bytes=500)
    assert known["number"].sum() == 30 * 54 and known["types"].sum() == 33
    asked = Counter(open(log).read().split())
    assert len(asked) > 8 and set(asked.values()) == {1}
    got = {r.doc_id: r for r in scored.collect()}
    assert [(got[k].n_tokens, got[k].n_known, got[k].train_tokens) for k in (0, 29, 30)] == [(55, 55, 30 * 55), (55, 55, 30 * 55), (55, 54, 30 * 55)]
