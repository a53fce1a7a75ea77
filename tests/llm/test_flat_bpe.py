"""BPE against the tokenizers library."""

import hashlib
import random
import time

import pytest
import public_tokenizers
from tokenizers import Tokenizer

from aiscope.llm import flatbpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id string, text string, _text int"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def model():
    return flatbpe.Model.parse(open(PATH, "rb").read())


def wanted(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))


def made_up():
    rng = random.Random(1)
    points = [chr(c) for c in (*range(32, 127), 9, 10, 13, 0x85, 0xA0, 0xE9, 0x4E2D, 0x1F600, 0x2028, 0x3000, 0x660, 0x300, 0x1D7D8, 0x180E, 0x200B, 0xFEFF, 0)]
    texts = ["".join(rng.choices(points, k=rng.randrange(60))) for _ in range(800)]
    texts += ["".join(rng.choices(["<|endoftext|>", " ", "a", "aa", "  ", "\n", "<|", "'s", "é"], k=rng.randrange(12))) for _ in range(400)]
    texts += ["a" * n for n in (1, 2, 3, 4, 5, 7, 33, 511, 512, 513, 5000)] + ["".join(rng.choices("aAbB", k=700)) for _ in range(5)]
    return texts + [None, "", "", " ", "word " * 30_000, "x" * 70_000, "x" * 70_000, "é" * 3000]


def test_query(spark, sf, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = queries.QUERIES["op12_flat_bpe"](spark, sf).collect()
    assert len(found) == len(texts)
    for r in found:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == wanted(library, texts[r.doc_id])


def test_made_up_texts(spark, library):
    """Nulls, empty and long texts, repeated rows and null ids, special tokens in texts, white space and numbers of many kinds."""
    rows = [(None if k % 7 == 0 else str(k % 900), t, 1) for k, t in enumerate(made_up())]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = sorted((r.doc_id or "", r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in flatbpe.encode_digests(frame, PATH).collect())
    assert found == sorted((i or "", *wanted(library, t)) for i, t, _ in rows)
    again = {(r.doc_id, r.text) for r in flatbpe.decode(flatbpe.encode(frame, PATH), PATH).collect()}
    assert again == {(i, t or "") for i, t, _ in rows}
    assert flatbpe.encode_digests(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_merges_in_rounds_by_heap_and_one_by_one(model, library):
    words = [t.encode() for t in {"".join(random.Random(k).choices("aeint hsABé", k=random.Random(k).randrange(1, 80))) for k in range(400)}]
    pairs = dict(zip(zip((model.keys >> 32).tolist(), (model.keys & 0xFFFFFFFF).tolist()), zip(model.ranks.tolist(), model.made.tolist())))
    one = [x.tolist() for x in flatbpe.merge_words(words, model)]
    assert one == [flatbpe.merge_long(w, pairs, model).tolist() for w in words]
    model.at_once = False
    try:
        assert one == [x.tolist() for x in flatbpe.merge_words(words, model)]
    finally:
        model.at_once = True


def test_a_word_of_a_megabyte(model):
    encoder = flatbpe.Encoder(model)
    word = "".join(random.Random(2).choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000)).encode()
    began = time.perf_counter()
    encoder.encode(flatbpe.np.frombuffer(word, dtype=flatbpe.np.uint8), flatbpe.np.array([0, len(word)]))
    assert time.perf_counter() - began < 40


def test_files_that_are_not_supported():
    with pytest.raises(ValueError):
        flatbpe.Model.parse(open(public_tokenizers.path("word_bpe_49k.json"), "rb").read())
