"""Ids of the lower-cased word vocabulary, through a memo of words and the tokenizers library."""

from __future__ import annotations

import os
import re

import numpy as np

from ionweave.llm.caching import Memo
from ionweave.llm.common import resident

#: In texts of these characters, lower-casing and composition act on each character by itself, and ``PIECES`` cuts
#: lower-cased text as the vocabulary's own pattern does. Signs that count as letters or numbers are left out.
PLAIN = re.compile("[\\x09-\\x0d\\x20-\\x7e\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-\xff\u2010-\u2027\u2030-\u205e]*")
PIECES = re.compile("[a-z\xdf-\xf6\xf8-\xff]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\\s0-9a-z\xdf-\xf6\xf8-\xff]+")
SLICE = 2_000_000
#: Unknown words that the library reads as one text.
JOINED = 1_000


class WordIds:
    """``word_bpe`` ids as little-endian unsigned 32-bit bytes. A text of plain characters is looked up word by word;
    any other, and any with a special token's string, goes to the library whole."""

    def __init__(self, path: str, memo: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.memo = Memo(self._words, memo)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of each of many words: they are read as one text, which is cut after each word's last id."""
        out: list[bytes] = []
        for at in range(0, len(words), JOINED):
            some = words[at : at + JOINED]
            ids = self._whole(" ".join(some))
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) == len(some):
                raw = ids.tobytes()
                out += [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
            else:
                out += [self._whole(w).tobytes() for w in some]
        return out

    def encode_all(self, texts: list[str]):
        at = 0
        while at < len(texts):
            cut, total = [], 0
            while at < len(texts) and (not cut or total + len(texts[at]) <= SLICE):
                t = texts[at]
                total += len(t)
                cut.append(PIECES.findall(t.lower()) if PLAIN.fullmatch(t) and "<|" not in t else t)
                at += 1
            ids = self.memo.ready(set().union(*(c for c in cut if isinstance(c, list))))
            for c in cut:
                yield b"".join(map(ids.__getitem__, c)) if isinstance(c, list) else self._whole(c).tobytes()


def loaded(path: str, memo: int = 300_000) -> WordIds:
    return resident(("words", path, memo), lambda: WordIds(path, memo))
