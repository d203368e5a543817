"""Token ids of a byte-level BPE vocabulary file of the ``tokenizers`` library, at corpus speed.

Texts are split at single spaces between non-space characters. The vocabulary's pattern never
joins what lies on both sides of such a space (the space goes to the part that follows), so each
part has its ids for itself and they are kept in a table. Parts that the table lacks go through
the same vocabulary in ``tiktoken``, whose merges are the file's. A text that holds one of the
file's special tokens, and every text if a probe finds a difference, goes through ``tokenizers``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np

_SAFE = re.compile(r"(?<=\S) (?=\S)")
_UNSAFE = re.compile(r"\s\s|^\s|\s$")
#: Fixed value: the split pattern of this kind of vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PROBES = ("It's 12:30 -  ok\n\n\tEnd ", "naïve Ünïcode  　x y 漢字かな😀!", "a\r\nb   c 's 'S I'll 100%")
MOST_KEPT = 400_000


def _bytes_of() -> dict[str, int]:
    """The printable stand-in of each byte in such files: printable bytes are themselves, the others follow from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_bpe(path: str) -> Callable[[], Callable[[list[str]], list[bytes]]]:
    """An encoder factory for a vocabulary file that every executor has at ``path``."""

    def make() -> Callable[[list[str]], list[bytes]]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        stand_in = _bytes_of()
        ranks = {bytes(stand_in[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        full = Tokenizer.from_file(path)
        has_special = re.compile("|".join(map(re.escape, special))).search if special else lambda _: None

        def slow(text: str) -> bytes:
            return np.array(full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

        class Table(dict):
            def __missing__(self, part: str) -> bytes:
                if len(self) >= MOST_KEPT:
                    self.clear()
                ids = self[part] = np.array(fast.encode_ordinary(part), "<u4").tobytes()
                return ids

        table = Table()

        def one(text: str) -> bytes:
            if has_special(text):
                return slow(text)
            # '\s\s' anywhere means that a part could begin or end with white space: split with care.
            parts = _SAFE.split(text) if _UNSAFE.search(text) else text.split(" ")
            first = table[parts[0]] if parts[0] else b""
            return first + b"".join([table[" " + p] for p in parts[1:]])

        if any(one(p) != slow(p) for p in PROBES):
            return lambda texts: [slow(t) for t in texts]
        return lambda texts: [one(t) for t in texts]

    return make
