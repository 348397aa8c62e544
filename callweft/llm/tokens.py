"""The tokenizer of packing and token counts: the byte-level BPE of 50,257 ids.

Ids are those that the ``byte_bpe_50k.json`` file gives as it is loaded, its special token ``SPECIAL`` in a text
included (one id). They are made from the same vocabulary in its rank form, which the tiktoken library encodes
several times faster; the tests compare the ids.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the string of the vocabulary's special token, whose id follows those of the ranks.
SPECIAL = "<|endoftext|>"
#: White space as the vocabulary's pattern knows it. The pattern looks back over a whole run of it, which exhausts the
#: matcher's stack near a million characters, so longer runs than this are cut out before.
BLANK_RUN = 100_000
BLANK_RUNS = re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{BLANK_RUN},}}")


@lru_cache(maxsize=8)
def encoder(name: str = VOCABULARY, pattern: str | None = None):
    """The encoder of a vocabulary file of the public_tokenizers package (or of a path), with its pattern or another."""
    import os

    import public_tokenizers
    import tiktoken

    path = name if os.path.sep in name else public_tokenizers.path(name)
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})


def encode_ordinary(text: str, name: str = VOCABULARY) -> list[int]:
    """Ids of a text without special tokens.

    Of a run of white space all but the last character (all, at the end of the text) is one piece of the pattern, and
    pieces begin before and after it; so a very long run is merged as one piece of its own, with the same ids.
    """
    if len(text) < BLANK_RUN:
        return encoder(name).encode_ordinary(text)
    out: list[int] = []
    at = 0
    for run in BLANK_RUNS.finditer(text):
        stop = run.end() - (run.end() < len(text))
        out += encoder(name).encode_ordinary(text[at : run.start()])
        out += encoder(name, "(?s:.+)").encode_ordinary(text[run.start() : stop])
        at = stop
    return out + encoder(name).encode_ordinary(text[at:])


def encode(text: str | None, name: str = VOCABULARY) -> list[int]:
    """Ids of a text; a null text has none."""
    if not text:
        return []
    if SPECIAL not in text:
        return encode_ordinary(text, name)
    special = encoder(name).encode_single_token(SPECIAL)
    first, *rest = (encode_ordinary(part, name) for part in text.split(SPECIAL))
    for ids in rest:
        first += [special, *ids]
    return first
