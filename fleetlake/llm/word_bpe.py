"""A quick encoder for tokenizer files of one kind: lower-cased words, byte-level
BPE with an end-of-word suffix.

``tiktoken`` merges the same vocabulary several times faster than
``tokenizers`` does.  It knows no end-of-word suffix, so the suffix becomes the
byte 0 behind every word, whose merge with a word's last byte comes first.
Texts with characters outside plain Latin letters, digits and ASCII marks, or
with a special token's string, go to ``tokenizers``.  Tests hold both against
each other.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable

#: What the tokenizer file says when this encoder applies.
SUFFIX = "</w>"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "\0"
#: Within these characters every word that is not letters is a digit, a contraction or a run of ASCII marks.
OTHER = re.compile("[^\n -~À-ÖØ-öø-ÿ]|<\\|")
NOT_LETTERS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[0-9]|[!-/:-@\[-`{-~]+")


def _byte_of() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(model: str) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to their ids, as little-endian unsigned 32-bit
    integers, for the tokenizer file with the text ``model``."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_str(model)

    def by_tokenizers(texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in whole.encode_batch_fast(texts, add_special_tokens=False)]

    spec = json.loads(model)
    bpe, splits = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    if (bpe.get("end_of_word_suffix") != SUFFIX or [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])] != NORMALIZERS
            or splits[0].get("pattern", {}).get("Regex") != WORDS or any(not t["content"].startswith("<|") for t in spec["added_tokens"])):
        return by_tokenizers

    import tiktoken

    byte_of, special = _byte_of(), {t["content"] for t in spec["added_tokens"]}
    ranks = {}
    for token, rank in bpe["vocab"].items():
        if token not in special:
            stem = token.removesuffix(SUFFIX)
            ranks[bytes(byte_of[c] for c in stem) + (END.encode() if token != stem else b"")] = rank
    ranks[END.encode()] = len(bpe["vocab"]) + len(special)  # stands for itself in no text; needed as the start of a merge
    quick = tiktoken.Encoding("words", pat_str=rf"[^{END}\s]+{END}", mergeable_ranks=ranks, special_tokens={})

    def encode(texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = []
        for text in texts:
            if OTHER.search(text):
                out.append(None)
                continue
            marked = NOT_LETTERS.sub(rf"{END}\g<0>{END}", text.lower()).replace(" ", END + " ").replace("\n", END + "\n") + END
            out.append(array("I", quick.encode_ordinary(marked)).tobytes())
        rest = iter(by_tokenizers([t for t, ids in zip(texts, out) if ids is None]))
        return [next(rest) if ids is None else ids for ids in out]

    return encode
