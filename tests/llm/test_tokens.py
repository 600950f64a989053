import os
import random

import pytest
from pyspark.sql import functions as F

from foliant.llm.tokens import TOKENIZER_DIR, EditableEncoding, encode_corpus, encoder, vocabulary_path

pytestmark = pytest.mark.skipif(not os.path.isdir(TOKENIZER_DIR), reason="no public tokenizers here")
ALPHABET = "aaabcdeéß 日本กขค​ \n\t'sthe0123<|endoftext|>\U0001f600"


def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_equals_the_library():
    rng, want, enc = random.Random(5), reference(), encoder(vocabulary_path())
    texts = ["", "a" * 3000, "<|endoftext|> x", "der Größe " * 40] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 90))) for _ in range(1500)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(120)) for _ in range(300)]
    assert all(enc.encode(t) == want(t) for t in texts)


def test_edits_and_appends_equal_encoding_anew():
    rng, enc = random.Random(6), encoder(vocabulary_path())
    held = EditableEncoding(enc)
    for _ in range(400):
        a = rng.randint(0, len(held.text))
        b = min(len(held.text), a + rng.choice([0, 0, 1, 5, 30]))
        held.replace(a, b, "".join(rng.choice(ALPHABET) for _ in range(rng.choice([0, 1, 4, 25]))))
        assert held.ids == enc.encode(held.text)
    held.append(" the end")
    assert held.ids == enc.encode(held.text)


def test_edit_encodes_near_text_only():
    enc = encoder(vocabulary_path())
    held = EditableEncoding(enc, "The sample follows the membrane. " * 2000)
    before = held.encoded_chars
    held.replace(30000, 30003, "new")
    assert held.encoded_chars - before < 200


def test_table(spark):
    rows = [(1, "the sample", 9), (2, "", 9), (3, None, 9), (None, "x", 9), (1, "the sample", 9), (4, "z9é" * 30000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = {(r.doc_id, len(r.ids)) for r in encode_corpus(docs).collect()}
    assert {(1, 2), (2, 0), (3, 0), (None, 1)} <= got
    assert encode_corpus(docs).count() == 6
    assert encode_corpus(docs).schema["ids"].dataType.simpleString() == "array<int>"
    assert encode_corpus(docs.where(F.lit(False))).count() == 0
