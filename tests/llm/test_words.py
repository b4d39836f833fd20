"""Word hashes: built collisions of polynomials modulo powers of two, and the arithmetic itself."""

import random

import numpy as np
import pyarrow as pa

from docmarket.llm import decontamination, importance, jaccard_join, token_files
from docmarket.llm.words import NOT_ALNUM, WHITESPACE, _BASE, _PRIME, _powers, _times, span_hashes, word_hashes


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


PAIR = thue_morse(1024)


def test_products_and_powers():
    rng = random.Random(1)
    p = int(_PRIME)
    numbers = [0, 1, p - 1, p - 2, 2**31, 2**31 - 1, 2**60] + [rng.randrange(p) for _ in range(500)]
    a, b = (np.array(x, np.uint64) for x in zip(*[(x, y) for x in numbers for y in numbers[:60]]))
    assert _times(a, b).tolist() == [int(x) * int(y) % p for x, y in zip(a, b)]
    power, inverse = _powers(1 << 16)
    assert all(int(power[i]) == pow(_BASE, i, p) and int(power[i]) * int(inverse[i]) % p == 1 for i in (0, 1, 2, 1000, 65535))


def test_a_hash_depends_on_the_bytes_alone():
    rng = random.Random(2)
    words = ["".join(rng.choice("abéz") for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    hashes, rows = word_hashes(pa.array([" ".join(words), "", None, words[0], " ".join(reversed(words))]), WHITESPACE)
    assert rows.tolist() == [0, 3000, 3000, 3000, 3001, 6001]
    seen = {}
    for word, h in zip([*words, words[0], *reversed(words)], hashes.tolist()):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    long = np.frombuffer(b"\xff" * 3_000_000, np.uint8)
    assert len({int(h) for h in span_hashes(long, np.array([0, 1, 0]), np.array([2_999_999, 3_000_000, 3_000_000]))}) == 2


def test_thue_morse_words_differ():
    for n in (64, 1024, 4096):
        a, b = thue_morse(n)
        for table in (WHITESPACE, NOT_ALNUM):
            hashes, _ = word_hashes(pa.array([f"{a} {b}"]), table)
            assert hashes[0] != hashes[1]


def test_thue_morse_words_in_the_operators(spark):
    import public_tokenizers

    a, b = PAIR
    docs = spark.createDataFrame([(1, a), (2, b), (3, f"{a} tail"), (4, f"{b} tail")], "doc_id bigint, text string").coalesce(1)
    out = {r["doc_id"]: r for r in jaccard_join.jaccard_components(docs).collect()}
    assert all(out[i]["component_id"] == i and out[i]["n_links"] == 0 for i in (1, 2, 3, 4))
    items = spark.createDataFrame([("x", a)], "item_id string, text string")
    found = {r["doc_id"]: list(r["items"]) for r in decontamination.find_leaks(docs, items).collect()}
    assert found == {1: ["x"], 2: [], 3: ["x"], 4: []}
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = token_files.WordEncoder(path)
    ids, bounds = encoder.encode(pa.array([a, b, a]), None)
    own = [encoder.tokenizer.encode(x, add_special_tokens=False).ids for x in (a, b, a)]
    assert [ids[x:y].tolist() for x, y in zip(bounds, bounds[1:])] == own and own[0] != own[1]
    words, _, _ = importance.ngrams(pa.array([f"{a} {b}"]))
    assert len(set(words.tolist())) == 2


def test_encoder_forgets_the_oldest(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(token_files, "KNOWN", 200)
    encoder = token_files.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(3)
    pool = ["".join(rng.choice("abcdefé,.") for _ in range(rng.randint(1, 9))) for _ in range(900)]
    for _ in range(60):
        texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(5)]
        ids, bounds = encoder.encode(pa.array(texts), 1)
        assert [ids[x:y].tolist() for x, y in zip(bounds, bounds[1:])] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in texts]
        assert len(encoder.hashes) <= 200 and (np.diff(encoder.hashes.astype(object)) > 0).all()


def test_batches_of_texts_are_bounded(spark):
    from docmarket.llm.words import small_batches

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        small_batches(spark, 1 << 16)
        small_batches(spark, 1 << 20)  # the smaller one stays
        assert spark.conf.get(name) == "65536b"
        sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)
        docs = spark.range(64, numPartitions=1).selectExpr("repeat('x', 10000) AS text")
        assert max(r["n"] for r in docs.mapInArrow(sizes, "n bigint").collect()) <= 8
    finally:
        spark.conf.set(name, before)
