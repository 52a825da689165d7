"""Byte-level BPE ids of whole texts, from the rank file of a public vocabulary."""

from __future__ import annotations

import base64

RANKS = "byte_bpe_50k.tiktoken"
END_OF_TEXT = 50_256    # fixed value: the id that the vocabulary keeps for the end of a text
ADDED = {"<|endoftext|>": END_OF_TEXT}   # fixed value: the added tokens of the vocabulary's JSON file


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS)


def encoder(path: str, added: dict[str, int] | None = None):
    """``encode(text) -> ids``, to be loaded once per task.

    Control strings inside a text are ordinary text, but for those of ``added``: with ``ADDED``, ids are those that the JSON
    file gives, which cuts a text at its added tokens and encodes what is between them on its own.
    """
    import re

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                              special_tokens={}).encode_ordinary
    if not added:
        return plain
    cuts = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")

    def encode(text: str) -> list[int]:
        first, *rest = cuts.split(text)
        ids = plain(first)
        for token, after in zip(rest[::2], rest[1::2]):
            ids.append(added[token])
            ids += plain(after)
        return ids

    return encode
