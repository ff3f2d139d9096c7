"""Token ids of a lower-casing word tokenizer, fast for Latin texts.

The tokenizer splits at white space and between letters, digits and other characters, and ends
each word with a marker. For texts of ASCII and Latin letters without apostrophes those borders
are found by one pattern, the marker is written as a zero byte, and a byte-pair encoder with the
same vocabulary encodes the words that were not met before in one call. Any other text goes through the
tokenizer itself.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# ASCII but zero and apostrophe, and Latin letters that are one character in either case.
PLAIN = r"[^\x01-\x26\x28-\x7fÀ-ÖØ-öø-įı-ňŊ-ǯǱ-ȳ]"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


WORDS = re.compile(rb"[a-z\x80-\xff]+|[0-9]|[^a-z0-9\x80-\xff\s]+")


def lowered(text: str) -> bytes:
    return text.lower().encode()


class WordTokens:
    """``batch(texts)`` yields an array of ids for each text; null counts as empty.

    Ids of words are kept for up to ``most`` words, then dropped and gathered anew.
    """

    def __init__(self, path: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.plain = re.compile(PLAIN)
        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        alphabet, ranks = byte_alphabet(), {}
        for token, number in vocabulary.items():
            body = token.removesuffix("</w>")
            if all(c in alphabet for c in body) and body and not token.startswith("<|"):
                ranks[bytes(alphabet[c] for c in body) + b"\0" * (body != token)] = number
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[number for token, number in ranks.items() if token[-1:] == b"\0" and token != b"\0"]] = True
        self.known: dict[bytes, bytes] = {}
        self.most = most
        self.fast = tiktoken.Encoding("word", pat_str="[^\\x00]+\\x00", mergeable_ranks=ranks, special_tokens={})

    def latin(self, text: str) -> np.ndarray:
        words, known = WORDS.findall(lowered(text)), self.known
        try:
            return np.frombuffer(b"".join([known[w] for w in words]), "<u2")
        except KeyError:
            pass
        if len(known) > self.most:
            known.clear()
        new = [w for w in set(words) if w not in known]
        ids = self.fast.encode_to_numpy((b"\0".join(new) + b"\0").decode(), disallowed_special=()).astype("<u2")
        ends = np.flatnonzero(self.ends[ids]) + 1
        data, start = ids.tobytes(), 0
        for word, end in zip(new, (2 * ends).tolist(), strict=True):
            known[word], start = data[start:end], end
        return np.frombuffer(b"".join([known[w] for w in words]), "<u2")

    def one(self, text: str) -> np.ndarray:
        if self.plain.search(text) is None and "<|" not in text:
            return self.latin(text)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def batch(self, texts: pa.Array):
        for text in pc.fill_null(texts, ""):
            yield self.one(text.as_py())
