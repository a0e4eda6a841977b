"""Token ids of whole texts, by a public tokenizer file, with a bounded memory of chunks seen before.

The tokenizer splits a text before it merges, and no piece it splits off holds white space after other characters.
So a text may be cut wherever white space follows something else; each chunk's ids are computed once and kept.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np

# Chunks kept per generation (of two) and process: some two hundred bytes each.
KEPT = 600_000
# Unknown chunks encoded as one text.
TOGETHER = 200

_CHUNKS = re.compile(r"\s*\S+|\s+")
# Where a cut before a single space would fall inside white space.
_SPACES = re.compile(r"\s ")
# What may not be told from the line end between chunks.
_LINE_ENDS = re.compile(r"[\r\n]")
# White space to Python but not to the tokenizer.
_CONTROLS = re.compile("[\x1c-\x1f]")


class Encoder:
    """Ids as little-endian unsigned 32-bit numbers, one bytes object per text."""

    def __init__(self, path: str, literal: bool = False):
        """`literal`: the strings of special tokens in a text are ordinary text."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line_end = line_end[0] if len(line_end) == 1 else None
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encoded(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _encoded_chunks(self, chunks: list[str]) -> list[bytes]:
        """Chunks without line ends are encoded many at a time, a line end between them; its id parts them again.

        A group that has not one such id per gap (a tokenizer may join it with what stands before) is encoded chunk by chunk.
        """
        out: dict[str, bytes] = {}
        alone = [c for c in chunks if not c or _LINE_ENDS.search(c)] if self.line_end is not None else chunks
        if len(alone) < len(chunks):
            apart = set(alone)
            together = [c for c in chunks if c not in apart]
            groups = [together[i : i + TOGETHER] for i in range(0, len(together), TOGETHER)]
            found = self.tokenizer.encode_batch_fast(["\n".join(g) for g in groups], add_special_tokens=False)
            for group, x in zip(groups, found, strict=True):
                ids = np.array(x.ids, dtype="<u4")
                gaps = np.flatnonzero(ids == self.line_end)
                if len(gaps) != len(group) - 1:
                    alone += group
                    continue
                raw = ids.tobytes()
                begins = [0, *(4 * gaps + 4).tolist()]
                ends = [*(4 * gaps).tolist(), len(raw)]
                out.update(zip(group, [raw[a:b] for a, b in zip(begins, ends, strict=True)], strict=True))
        out.update(zip(alone, self._encoded(alone), strict=True))
        return [out[c] for c in chunks]

    def _learn(self, chunks: set[str]) -> None:
        if len(self.new) + len(chunks) > KEPT:
            self.old, self.new = self.new, {}
        again = {c: self.old[c] for c in chunks if c in self.old}
        self.new.update(again)
        rest = [c for c in chunks if c not in again]
        self.new.update(zip(rest, self._encoded_chunks(rest), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = []
        cut: list[list[str] | None] = []
        for text in texts:
            if _CONTROLS.search(text):
                cut.append(None)
            elif _SPACES.search(text):
                cut.append(_CHUNKS.findall(text))
            else:
                first, *others = text.split(" ")
                cut.append([first, *[" " + x for x in others]])
        for text, chunks in zip(texts, cut, strict=True):
            if chunks is None:
                out.append(self._encoded([text])[0])
                continue
            fresh = set(chunks).difference(self.new)
            if fresh:
                self._learn(fresh)
            try:
                out.append(b"".join(map(self.new.__getitem__, chunks)))
            except KeyError:  # the generation changed within this text
                self._learn(set(chunks))
                out.append(b"".join(map(self.new.__getitem__, chunks)))
        return out


@cache
def encoder(path: str, literal: bool = False) -> Encoder:
    """One per process; its memory of chunks lives on between tasks."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path, literal)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
