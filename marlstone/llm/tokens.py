"""Token ids of texts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

#: Beyond these letters, two regular-expression engines may class characters by different Unicode versions.
_RARE = re.compile("[^\x00-ɏ]")
_SPECIAL = "<|endoftext|>"


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def encoder(json_file: str, ranks_file: str | None, plain: bool = False):
    """A function from a text to its ids as a uint32 array: what the JSON file's tokenizer gives. plain: special tokens' strings are ordinary text.

    With the same vocabulary as ranks, plain texts go through the faster of two
    libraries; texts with rare characters or a special token's string go through
    the tokenizer itself. Tests hold the two against each other.
    """
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(json_file)
    exact.encode_special_tokens = plain

    def slow(text: str) -> np.ndarray:
        return np.array(exact.encode(text, add_special_tokens=False).ids, dtype="<u4")

    if ranks_file is None:
        return slow
    import public_tokenizers
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def fast(text: str) -> np.ndarray:
        if _RARE.search(text) or (_SPECIAL in text and not plain):
            return slow(text)
        return np.array(quick.encode_ordinary(text), dtype="<u4")

    return fast
