"""Public byte-level BPE vocabularies, loaded once for each Python worker. The vocabulary's path is a parameter."""

from __future__ import annotations

import base64

from packmill.llm.common import cached

#: Ranks as lines "base64 rank".
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published splitting rule of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoding(path: str = VOCABULARY, pattern: str = PATTERN):
    """The tokenizer of a ranks file. Special tokens are none: their strings in a text are ordinary text."""

    def make():
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    return cached(f"bpe {path} {pattern}", make)
