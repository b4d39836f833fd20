"""The quality classifier: held-out accuracy on made texts, Gumbel top-k, edge cases."""

import random

import numpy as np

from pyspark.sql import functions as F

from docmarket.llm import importance as I


def corpus(spark, n=1500, labelled=0.6):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghi") for _ in range(rng.randrange(2, 8))) for _ in range(2000)]
    docs, labels, truth = [], [], {}
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        kind = rng.choices(["clean", "junk", "shout", "toxic"], [8, 1, 1, 2])[0]
        if kind == "junk":
            text = [w + rng.choice(["###", "$$$", "&&&"]) for w in text]
        elif kind == "shout":
            text = [w.upper() + "!!" for w in text]
        elif kind == "toxic":
            for w in rng.sample(["zzidiot", "zzmoron", "zzclown", "zzloser"], 2):
                text.insert(rng.randrange(len(text)), w)
        truth[i] = kind
        docs.append((i, " ".join(text)))
        if rng.random() < labelled:
            labels.append((i, int(kind not in ("junk", "shout")), int(kind == "toxic")))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), truth, {x[0] for x in labels}


def test_held_out_accuracy(spark):
    docs, labels, truth, seen = corpus(spark)
    rows = I.classify(docs.repartition(3), I.train_classifier(docs, labels)).collect()
    right = [r["__kept"] == (truth[r["doc_id"]] == "clean") for r in rows if r["doc_id"] not in seen]
    clean = [r["__kept"] for r in rows if truth[r["doc_id"]] == "clean"]
    assert np.mean(right) > 0.97 and np.mean(clean) > 0.99
    again = I.classify(docs, I.train_classifier(docs, labels)).collect()
    assert {(r["doc_id"], r["__kept"]) for r in rows} == {(r["doc_id"], r["__kept"]) for r in again}


def test_counts_cover_all_texts(spark):
    docs, labels, _, _ = corpus(spark, 200)
    few = I.label_sample(labels, 1000)
    counted = I.count_ngrams(docs.join(F.broadcast(few), docs["doc_id"] == few["__id"], "left"), np.zeros(0, np.uint64), "text")
    total = counted.filter(F.col("bucket") < (1 << I.WORD_BITS)).agg(F.sum("n")).first()[0]
    assert total == docs.select(F.sum(F.size(F.split("text", " ")))).first()[0]


def test_top_k_takes_the_best_and_noise_follows_the_weights(spark):
    rows = spark.range(20_000).select(F.col("id"), F.when(F.col("id") % 2 == 0, -1.0).otherwise(1.0).alias("__low"), F.lit(-5.0).alias("__toxic"))
    keys = rows.select("id", I.gumbel_key(F.col("id"), 0.0, 1.0).alias("key")).orderBy("key").limit(1000).collect()
    even = sum(r["id"] % 2 == 0 for r in keys) / 1000
    assert abs(even - np.exp(1) / (np.exp(1) + np.exp(-1))) < 0.05  # odds of e**2 for log weights 1 and -1
    sharp = rows.select("id", I.gumbel_key(F.col("id"), 0.0, 0.01).alias("key")).orderBy("key").limit(1000).collect()
    assert all(r["id"] % 2 == 0 for r in sharp)


def test_edges(spark):
    docs, labels, _, _ = corpus(spark, 150)
    odd = spark.createDataFrame([(None, None), (None, ""), (10**6, " \n"), (10**6 + 1, "w " * 50_000), (10**6 + 1, "w " * 50_000)], "doc_id bigint, text string")
    docs = docs.union(odd).withColumns({c: F.lit("clash") for c in ("id", "key", "n", "size", "word")})
    labels = labels.union(labels).union(spark.createDataFrame([(None, 0, 1), (3, None, None)], labels.schema))
    rows = I.classify(docs, I.train_classifier(docs, labels)).collect()
    assert len(rows) == 155 and all(r["__kept"] for r in rows if r["doc_id"] is None or r["doc_id"] == 10**6)
    assert all(r["__kept"] for r in I.classify(docs, I.train_classifier(docs, labels.limit(0))).collect())
    assert I.classify(docs.limit(0), I.train_classifier(docs.limit(0), labels)).count() == 0


def test_columns_called_like_the_weights_are_replaced(spark):
    docs, labels, _, _ = corpus(spark, 150)
    clash = docs.withColumns({c: F.lit("clash") for c in ("__low", "__toxic", "__kept")})
    classifier = I.train_classifier(clash, labels)
    want = {(r["doc_id"], r["__low"], r["__kept"]) for r in I.classify(docs, classifier).collect()}
    assert {(r["doc_id"], r["__low"], r["__kept"]) for r in I.classify(clash, classifier).collect()} == want
