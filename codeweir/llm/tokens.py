"""Byte-level BPE ids of whole texts.

Ids are the same as those of the tokenizers library for the same vocabulary. The
pre-tokeniser's pattern looks ahead at the end of white space, and gives up on runs of very
many such characters; texts it gives up on are cut at long runs, where the pattern
cuts them too.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np

END_OF_TEXT = "<|endoftext|>"
#: White space (as Unicode has it) of runs at which a text may be cut, and their least length.
LONG_RUN = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class TextEncoder:
    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        if len(ranks) >= 1 << 16:
            raise ValueError(f"ids are kept in 16 bits, and {vocabulary} has {len(ranks)}")
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: len(ranks)})

    def _ids(self, text: str) -> np.ndarray:
        return self.bpe.encode_to_numpy(text, allowed_special="all").astype(np.uint16)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 16-bit numbers."""
        try:
            return self._ids(text).tobytes()
        except ValueError:
            return self._cut(text).tobytes()

    def _cut(self, text: str) -> np.ndarray:
        """A long run is one piece, but for its last character if a word follows."""
        out, at = [], 0
        for run in LONG_RUN.finditer(text):
            end = run.end()
            if end < len(text) and not text.startswith(END_OF_TEXT, end):
                end -= 1
            out.append(self._ids(text[at : run.start()]))
            out.append(np.array(self.bpe._encode_single_piece(text[run.start() : end]), np.uint16))
            at = end
        return np.concatenate([*out, self._ids(text[at:])])


_encoders: dict[tuple[int, str], TextEncoder] = {}


def encoder(vocabulary: str) -> TextEncoder:
    """One encoder a worker process and vocabulary."""
    key = (os.getpid(), vocabulary)
    if key not in _encoders:
        _encoders[key] = TextEncoder(vocabulary)
    return _encoders[key]
