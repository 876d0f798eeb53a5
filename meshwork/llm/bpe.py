"""Byte-level BPE: exact ids at several MB per second and core.

``Codec`` gives what the tokenizers library gives for a byte-level BPE file
with ``add_special_tokens=False``: added tokens found in a text become their
ids, everything between them is split by the file's pattern and merged.
The merges run in tiktoken over ranks taken from the same file.  Texts with a
character outside Latin scripts go to the tokenizers library itself, so that
no difference in Unicode tables between the two libraries can show.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

VOCABULARY = "byte_bpe_50k.json"

#: Fixed value: the pattern that byte-level BPE files of this kind split by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_OTHER_SCRIPTS = re.compile("[^\x00-ɏ]")


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in such files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, plain_specials: bool = False):
        """``plain_specials``: added tokens' strings in a text are ordinary text."""
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        if plain_specials:
            self.library.encode_special_tokens = True
        added = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        alphabet = _byte_alphabet()
        self.token_bytes: list[bytes] = [b""] * self.library.get_vocab_size()
        for token, i in self.library.get_vocab(with_added_tokens=True).items():
            self.token_bytes[i] = token.encode() if token in added else bytes(alphabet[c] for c in token)
        ranks = {b: i for i, b in enumerate(self.token_bytes) if self.library.id_to_token(i) not in added}
        self._merge = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.specials = {} if plain_specials else added
        self._cut = re.compile("|".join(map(re.escape, self.specials)) or r"(?!)")

    def _ordinary(self, text: str) -> list[int]:
        if _OTHER_SCRIPTS.search(text):
            return self.library.encode(text, add_special_tokens=False).ids
        return self._merge(text)

    def encode(self, text: str) -> np.ndarray:
        """Ids as unsigned 32-bit integers."""
        ids: list[int] = []
        at = 0
        for found in self._cut.finditer(text):
            ids += self._ordinary(text[at : found.start()]) if found.start() > at else []
            ids.append(self.specials[found.group()])
            at = found.end()
        ids += self._ordinary(text[at:]) if at < len(text) else []
        return np.array(ids, dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text; broken sequences become U+FFFD."""
        raw = b"".join(map(self.token_bytes.__getitem__, ids.tolist()))
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode(errors="replace").encode()


@lru_cache(maxsize=4)
def codec(path: str, plain_specials: bool = False) -> Codec:
    """One codec a worker process, whichever tasks it runs."""
    return Codec(path, plain_specials)
