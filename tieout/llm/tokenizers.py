"""Loading a byte-level BPE vocabulary inside tasks. The file's path is a parameter."""

from __future__ import annotations

#: Where the vocabulary of a public tokenizer lies by default.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that cuts a text before its merges, as published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load(path: str = VOCABULARY, pattern: str = PATTERN):
    """(encoding, bytes of each token id), once per Python worker: task functions are
    shipped by value, so the copy is kept on the library's module."""
    import base64

    import numpy as np
    import tiktoken

    kept = tiktoken.__dict__.setdefault("_tieout_encodings", {})
    if (path, pattern) not in kept:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            size[rank] = len(token)
        kept[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size
    return kept[path, pattern]


#: Where the pattern always parts, whatever stands around: no piece goes on from a letter to a digit, a sign or
#: white space, or from a digit to anything else (white space stands at the front of a piece only).
BORDER = (r"(?<=\p{L})(?=[\p{N} \n!-&(-/:-@\[-`{-~、。，！？「」])|(?<=\p{N})(?=[\p{L} \n!-/:-@\[-`{-~、。，！？「」])")


def encode(encoding, text: str, span: int = 1 << 20):
    """Token ids of a whole text. Special strings are ordinary text. A text beyond
    ``span`` code points is cut at the last certain border before it, or, where there
    is none, at the next one after it: the whole text's pieces part there as well, and
    a piece's tokens do not depend on its neighbours."""
    if len(text) <= span:
        return encoding.encode_ordinary(text)
    import regex

    border = regex.compile(BORDER)
    out, at = [], 0
    while at < len(text):
        to = len(text)
        if at + span < to:
            back, cut = 1 << 10, None
            while cut is None and back < 2 * span:  # further and further back from the end of the span
                first = max(at + 1, at + span - back)
                cut = max((m.start() for m in border.finditer(text, first, at + span + 1)), default=None)
                back *= 8
            if cut is None:
                after = border.search(text, at + span)
                cut = after.start() if after else to
            to = cut
        out += encoding.encode_ordinary(text[at:to])
        at = to
    return out
