import random

import pytest

P = pytest.importorskip("public_tokenizers")

from fleetlake.llm.word_bpe import encoder  # noqa: E402


def test_quick_encoder_gives_the_ids_of_tokenizers():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    encode = encoder(open(path, encoding="utf-8").read())
    rng = random.Random(5)
    marks = list("abcdefghijklmnopqrstuvwxyzABCXYZ'''..,,!?-_#*$%&|<>[](){}\"/\\0123456789   \n\n\t\r") + ["é", "ß", "Ü", "ñ", "œ", "漢", "é", " ", "\0", "Σ", "İ", "<|endoftext|>", "'re", "'ll", " the ", " don't", "ing", "😀", "١"]
    texts = ["", " ", "\n"] + ["".join(rng.choice(marks[: rng.choice([26, 60, 80, 200])]) for _ in range(rng.randrange(1, 120))) for _ in range(6000)]
    for text, ids in zip(texts, encode(texts)):
        want = plain.encode(text, add_special_tokens=False).ids
        assert list(memoryview(ids).cast("I")) == want, repr(text)


def test_other_kinds_of_files_are_encoded_by_tokenizers():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    ids = encoder(open(path, encoding="utf-8").read())(["Hello, world", ""])
    assert [list(memoryview(x).cast("I")) for x in ids] == [plain.encode("Hello, world", add_special_tokens=False).ids, []]
