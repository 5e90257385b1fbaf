"""Vocabulary files of public tokenizers, loaded once per Python worker.

``ByteBpe`` reads a byte-level BPE file (the ``tokenizers`` JSON layout) and
knows its split pattern, token bytes and merges. ``PieceBpe`` reads a
``sentencepiece`` BPE model with byte fallback. A vocabulary is a file of fixed
size; paths are parameters and must be readable on every executor.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array

#: Remembered pieces of a worker's cache, in each of two generations.
CACHE_PIECES = 250_000
#: Longer pieces are encoded each time they occur.
CACHE_CHARS = 64

_SPACE_RUN = re.compile(r"\s ")

# The split pattern of byte-level BPE and its contractions.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = frozenset(["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"])

#: Below this code point all Unicode versions in use agree on the classes.
SETTLED = "՘"
# one character of each class that the pattern tells apart
LETTER, NUMBER, SPACE, OTHER = "x", "1", "\x0b", ";"


def default_path(name: str) -> str:
    """Place of an installed public vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path(name)


def byte_characters() -> dict[str, int]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the
    others for the code points from 256 on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


class ByteBpe:
    """A byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        import regex
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
        self.path = path
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        alphabet = byte_characters()
        self.ids = {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items()
                    if all(c in alphabet for c in token)}
        self.size = max([*model["vocab"].values(), *[t["id"] for t in spec.get("added_tokens", [])]]) + 1
        self.bytes = [b""] * self.size
        for token, i in self.ids.items():
            self.bytes[i] = token
        self.merges = []                                # (left id, right id, merged id), best rank first
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            left, right = (bytes(alphabet[c] for c in x) for x in (left, right))
            self.merges.append((self.ids[left], self.ids[right], self.ids[left + right]))
        self._findall = regex.compile(PATTERN).findall
        self._shadow: dict[int, str] = {}               # differing characters -> one of the library's class
        self._known: set[str] = set()

    @functools.cached_property
    def tokenizer(self):
        """The library's own tokenizer; special strings are ordinary text."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        t = Tokenizer.from_file(self.path)
        t.encode_special_tokens = True
        t.no_truncation()
        t.no_padding()
        return t

    def _learn(self, chars: set[str]) -> None:
        """Compares the class of new characters with the library's."""
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        tests = ((LETTER, LETTER), (NUMBER, NUMBER), (OTHER, OTHER))

        def kind(pieces):
            return next((stand for stand, lead in tests if len(pieces(lead)) == 1), SPACE)

        for ch in chars - self._known:
            theirs = kind(lambda lead: cut(lead + ch))
            if theirs != kind(lambda lead: self._findall(lead + ch)):
                self._shadow[ord(ch)] = theirs
            self._known.add(ch)

    def split(self, text: str) -> list[str]:
        """Pieces that are encoded on their own, as the library cuts them."""
        if text.isascii() or max(text) < SETTLED:
            return self._findall(text)
        self._learn({c for c in set(text) if c >= SETTLED})
        if not self._shadow:
            return self._findall(text)
        pieces, at = [], 0
        for p in self._findall(text.translate(self._shadow)):
            pieces.append(text[at:at + len(p)])
            at += len(p)
        return pieces


class Cache(dict):
    """piece -> value, made on demand. Bounded: when a generation is full it
    becomes the old one, and pieces still in use move on from there."""

    def __init__(self, make, limit: int = CACHE_PIECES):
        self.make, self.limit, self.old = make, limit, {}

    def put(self, piece, value):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[piece] = value

    def __missing__(self, piece):
        value = self.old.get(piece)
        if value is None:
            value = self.make(piece)
            if len(piece) > CACHE_CHARS:
                return value
        self.put(piece, value)
        return value

    def absent(self, pieces) -> list:
        """Pieces that have to be made, each once; those of the old generation
        move on."""
        out, old = [], self.old
        for p in set(pieces):
            if p not in self:
                if p in old:
                    self[p] = old[p]
                else:
                    out.append(p)
        return out


def words(text: str) -> list[str] | None:
    """Words ``w`` with ``text = " " + w + " " + w ...`` for a text behind one
    added space, or None if white space precedes a space: then a run may be one
    piece, and words can't be encoded on their own."""
    return None if _SPACE_RUN.search(text) or text[:1] == " " else text.split(" ")


class _Encoder:
    """Ids of texts behind one added space, as int32 bytes; empty where the
    tokens' bytes are not the text's. ``bytes``: the bytes of every token."""

    bytes: list[bytes]

    def _ids(self, text: str) -> list[int]:
        """Ids of a text that starts with the added space."""
        raise NotImplementedError

    def _together(self, word: str) -> bool:
        """Whether a word may be encoded in one text with others."""
        raise NotImplementedError

    def _ids_together(self, text: str) -> list[int]:
        return self._ids(text)

    @functools.cached_property
    def sizes(self):
        import numpy as np
        return np.array([len(t) for t in self.bytes], np.int64)

    def text(self, text: str) -> bytes:
        ids = self._ids(text)
        if b"".join(map(self.bytes.__getitem__, ids)) != text.encode():
            return b""
        return array("i", ids).tobytes()

    def many(self, some: list[str]) -> list[bytes]:
        """Ids of words, each behind its own space, from one call where words
        don't touch each other."""
        import numpy as np
        easy = [w for w in some if self._together(w)]
        found = {}
        if easy:
            whole = " " + " ".join(easy)
            ids = np.array(self._ids_together(whole), np.int32)
            if b"".join(map(self.bytes.__getitem__, ids.tolist())) == whole.encode():
                ends = np.cumsum(self.sizes[ids])
                stops = np.cumsum([len(w.encode()) + 1 for w in easy])
                cut = np.searchsorted(ends, stops)
                if (ends[cut] == stops).all():
                    packed, cut = ids.tobytes(), (4 * (cut + 1)).tolist()
                    found = dict(zip(easy, map(packed.__getitem__, map(slice, [0, *cut], cut))))
        return [found[w] if w in found else self.text(" " + w) for w in some]


class ByteEncoder(_Encoder):
    """Byte-level vocabulary, special strings plain. Words of settled
    characters are merged by ``tiktoken`` from the same vocabulary (its ranks
    are the merges' order, which is checked), all others by the library."""

    def __init__(self, path: str):
        import tiktoken
        self.vocab = v = ByteBpe(path)
        self.bytes = v.bytes
        made = [t for _, _, t in v.merges]
        self._merge = None
        if all(a < b for a, b in zip(made, made[1:])) and all(len(v.bytes[i]) == 1 for i in range(256)):
            self._merge = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=v.ids, special_tokens={}).encode_ordinary

    def _ids(self, text):
        return self.vocab.tokenizer.encode(text, add_special_tokens=False).ids

    def _together(self, word):
        return self._merge is not None and word != "" and max(word) < SETTLED and not word[-1].isspace()

    def _ids_together(self, text):
        return self._merge(text)


class PieceEncoder(_Encoder):
    """``sentencepiece`` BPE model that puts a space before the text. No piece
    of such a model holds a space behind another character, so no merge crosses
    from a word to the space behind it (checked when the model is loaded)."""

    MARK = "▁"

    def __init__(self, path: str):
        import sentencepiece
        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        if any(self.MARK in p.lstrip(self.MARK) for p in pieces):
            raise ValueError(f"{path}: pieces with a space behind another character")
        byte = re.compile(r"<0x([0-9A-F]{2})>")
        self.bytes = [bytes([int(byte.fullmatch(p)[1], 16)]) if model.is_byte(i) and byte.fullmatch(p)
                      else p.replace(self.MARK, " ").encode() for i, p in enumerate(pieces)]
        self._space = [model.piece_to_id(self.MARK)]

    def _ids(self, text):
        return self.model.encode(text[1:], num_threads=1) if len(text) > 1 else self._space

    def _together(self, word):
        return word != "" and self.MARK not in word


class TextEncoder:
    """Ids of whole texts by several encoders. Most texts are joined from
    their words' ids, which are remembered; words not seen before are encoded
    together."""

    TOGETHER = 4096

    def __init__(self, *encoders: _Encoder):
        self.encoders = encoders
        self._word = Cache(lambda w: tuple(e.text(" " + w) for e in encoders))

    def encode(self, texts: list[str]) -> list[tuple[bytes, ...]]:
        """Per text the int32 ids of every encoder (behind one added space):
        empty where its tokens' bytes differ from the text's or it is empty."""
        split = [words(t) if t else None for t in texts]
        new = self._word.absent(w for ws in split if ws for w in ws)
        for start in range(0, len(new), self.TOGETHER):
            some = [w for w in new[start:start + self.TOGETHER] if len(w) <= CACHE_CHARS]
            for w, ids in zip(some, zip(*(e.many(some) for e in self.encoders))):
                self._word.put(w, ids)
        out = []
        for text, ws in zip(texts, split):
            if ws is None:
                out.append(tuple(e.text(" " + text) if text else b"" for e in self.encoders))
            else:
                parts = list(map(self._word.__getitem__, ws))
                out.append(tuple(b"".join(p) if all(p) else b"" for p in zip(*parts)))
        return out


@functools.lru_cache(maxsize=4)
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


@functools.lru_cache(maxsize=4)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)
