"""Token ids of whole texts with a public byte-level tokenizer."""

from __future__ import annotations

import json
import re
from array import array


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The printable characters byte-level vocabularies write bytes with: themselves, or 256 and up in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


#: White space as the pattern knows it, in runs too long for its engine's stack.
_LONG_BLANK = re.compile("([\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,})")


class TextTokenizer:
    """Ids as little-endian unsigned 32-bit bytes.

    ``path`` is the JSON file of a byte-level BPE tokenizer whose ids follow the order of its merges.
    Its vocabulary is run by ``tiktoken``, which gives the same ids at a fifth of the time. ``markers`` get the ids behind the
    vocabulary, and its own special strings are then ordinary text.
    """

    def __init__(self, path: str, markers: tuple[str, ...] = ()):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of, special = _byte_of(), {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in special}
        ranks = {bytes(map(byte_of.__getitem__, k)): v for k, v in vocab.items()}
        self.first_marker = max(*ranks.values(), *special.values(), 0) + 1
        if markers:
            special = {m: self.first_marker + k for k, m in enumerate(markers)}
        self.special, self.size = special, self.first_marker + len(markers)
        self.bpe = tiktoken.Encoding(
            "texts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
        )
        self._cut = re.compile("(" + ("|".join(map(re.escape, special)) or "(?!)") + ")")
        #: The bytes of each id.
        self.bytes_of = [b""] * self.size
        for data, k in [*ranks.items(), *((s.encode(), k) for s, k in special.items())]:
            self.bytes_of[k] = data

    def encode(self, text: str) -> bytes:
        try:
            return self._encode(text)
        except ValueError:
            parts = self._cut.split(text)
            return b"".join(self._encode(p) if k % 2 else self._encode_blank_runs(p) for k, p in enumerate(parts))

    def _encode(self, text: str) -> bytes:
        return self.bpe.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()

    def _encode_blank_runs(self, text: str) -> bytes:
        """The same ids by parts, of a text without special strings: a run of white space is one group but for its last
        character, which goes to what follows, or all of it at the end of the text."""
        parts, out = _LONG_BLANK.split(text), []
        for k in range(1, len(parts), 2):
            run, last = parts[k], parts[k + 1] == "" and k + 2 == len(parts)
            out.append(self._encode(parts[k - 1]))
            out.append(array("I", self.bpe._encode_single_piece(run if last else run[:-1])).tobytes())
            parts[k + 1] = parts[k + 1] if last else run[-1] + parts[k + 1]
        return b"".join([*out, self._encode(parts[-1])])


_LOADED: dict[tuple, TextTokenizer] = {}


def tokenizer(path: str, markers: tuple[str, ...] = ()) -> TextTokenizer:
    """One per Python worker."""
    if (path, markers) not in _LOADED:
        _LOADED[path, markers] = TextTokenizer(path, markers)
    return _LOADED[path, markers]
