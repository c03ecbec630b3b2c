"""Token ids of whole texts by a tokenizers file, with a bounded cache of the ids of space-separated chunks."""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

from . import caches

#: Ids of twice this many chunks at most are kept by a worker: those used since the last turn, and before it.
CACHE_CHUNKS = 700_000
#: New plain chunks are encoded so many at once, and told apart again.
JOINED_CHUNKS = 128
#: Texts are encoded in groups of about this many characters.
GROUP_CHARS = 2_000_000

_encoders: dict[int, "ChunkEncoder"] = {}
caches.register("tokens", _encoders.clear)
#: A chunk: one space or line feed, and what follows up to the next.
_CHUNK = re.compile(r"[ \n]?[^ \n]+|[ \n]")
#: A plain chunk: Latin letters, then marks. In every supported layout it is a word and a run of marks.
_PLAIN = re.compile(r"([ \n]?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+)([.,!?;:]*)\Z")
_KEPT = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: The byte-level alphabet: bytes that print are themselves, the others follow from U+0100 on.
_ALPHABET = {b: chr(b) for b in _KEPT} | {b: chr(0x100 + n) for n, b in enumerate(b for b in range(256) if b not in set(_KEPT))}
#: White space to Python's split, but characters of words to a tokenizer.
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
#: Longer runs of white space are one token of a byte-level pattern, so chunks would cut it.
_LONG_SPACE = re.compile(r"\s\s(?:\s|\Z)")


def tokenizer_spec(file: str) -> str:
    with open(file, encoding="utf-8") as f:
        return f.read()


class ChunkEncoder:
    """Encodes texts as little-endian unsigned 32-bit ids, equal to encoding each whole text at once.

    Both supported layouts break a text before each single space or line feed: byte-level BPE (GPT-2 pattern, a space
    leads the next token) and word BPE (white space dropped). A text is cut there, each distinct chunk is encoded
    once, and the chunks' ids are joined. Texts with longer runs of white space, and files of any other layout, are
    encoded whole.
    """

    def __init__(self, spec: str, limit: int = CACHE_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        said = json.loads(spec)
        pre = said.get("pre_tokenizer") or {}
        steps = [x.get("type") for x in pre.get("pretokenizers", [])]
        self.leads = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not said.get("normalizer")
        self.drops = steps == ["Split", "ByteLevel"] and pre["pretokenizers"][0].get("behavior") == "Removed" and bool(pre["pretokenizers"][0].get("invert"))
        self.size = self.tokenizer.get_vocab_size()
        self.limit = limit
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        if self.leads or self.drops:
            from tokenizers.pre_tokenizers import CharDelimiterSplit

            # The file's model alone, for words that are split and written in the byte alphabet already.
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = CharDelimiterSplit(" ")
            if hasattr(self.model.model, "_resize_cache"):
                self.model.model._resize_cache(0)  # the words it sees are new ones
            suffix = said["model"].get("end_of_word_suffix") or ""
            vocab = self.tokenizer.get_vocab()
            self.token_chars = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
            for token, i in vocab.items():
                self.token_chars[i] = len(token.removesuffix(suffix) if suffix else token)

    def _ids(self, texts: list[str]) -> list[bytes]:
        batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        out = [array("I", e.ids) for e in batch(texts, add_special_tokens=False)]
        if sys.byteorder == "big":
            for a in out:
                a.byteswap()
        return [a.tobytes() for a in out]

    def _words(self, m: re.Match) -> str:
        """A plain chunk's words in the byte alphabet, parted by spaces."""
        lead, word, marks = m.groups()
        if self.drops:
            word, lead = word.lower(), ""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_ALPHABET)
        if lead == " ":
            word = _ALPHABET[32] + word
        elif lead:
            word = f"{_ALPHABET[10]} {word}"
        return f"{word} {marks}" if marks else word

    def _plain_ids(self, words: list[str]) -> list[bytes]:
        """The ids of each chunk, encoded many at once: the tokens' lengths tell the chunks apart."""
        batch = getattr(self.model, "encode_batch_fast", self.model.encode_batch)
        groups = [words[i : i + JOINED_CHUNKS] for i in range(0, len(words), JOINED_CHUNKS)]
        out: list[bytes] = []
        for group, e in zip(groups, batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            ends = np.searchsorted(np.cumsum(self.token_chars[ids]), np.cumsum([len(w) - w.count(" ") for w in group]), side="right")
            data, a = ids.tobytes(), 0
            for b in (4 * ends).tolist():
                out.append(data[a:b])
                a = b
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if not (self.leads or self.drops):
            return self._ids(texts)
        if self.leads:
            parts: list[list[str] | None] = [None if _LONG_SPACE.search(t) else _CHUNK.findall(t) for t in texts]
        else:
            parts = [_CHUNK.findall(t) if _SEPARATORS.search(t) else t.split() for t in texts]
        if len(self.cache) > self.limit:
            self.old, self.cache = self.cache, {}
        cache, old = self.cache, self.old
        seen: set[str] = set()
        for p in parts:
            if p is not None:
                seen.update(p)
        plain: list[str] = []
        words: list[str] = []
        other: list[str] = []
        match, space = _PLAIN.match, _ALPHABET[32]
        for x in seen:
            if x in cache:
                continue
            if x in old:
                cache[x] = old[x]
            elif self.leads and x[0] == " " and (w := x[1:]).isascii() and w.isalpha():  # what _words gives, without its steps
                plain.append(x)
                words.append(space + w)
            elif self.drops and x.isascii() and x.isalpha():
                plain.append(x)
                words.append(x.lower())
            elif m := match(x):
                plain.append(x)
                words.append(self._words(m))
            else:
                other.append(x)
        cache.update(zip(plain, self._plain_ids(words), strict=True))
        cache.update(zip(other, self._ids(other), strict=True))
        alone = [i for i, p in enumerate(parts) if p is None]
        whole = dict(zip(alone, self._ids([texts[i] for i in alone]), strict=True)) if alone else {}
        get = cache.__getitem__
        return [whole[i] if p is None else b"".join(map(get, p)) for i, p in enumerate(parts)]


def encoder(spec: str) -> ChunkEncoder:
    """One encoder per worker and file."""
    caches.claim("tokens")
    key = hash(spec)
    if key not in _encoders:
        _encoders[key] = ChunkEncoder(spec)
    return _encoders[key]


def encoded(spec: str, texts: Iterable[str | None], end_id: int) -> Iterator[bytes]:
    """The ids of each text (null: empty) with the end id, in order, a bounded group of texts at a time."""
    enc, tail = encoder(spec), int(end_id).to_bytes(4, "little")
    group: list[str] = []
    chars = 0
    for t in texts:
        group.append(t if isinstance(t, str) else "")
        chars += len(group[-1])
        if chars >= GROUP_CHARS:
            for b in enc.encode(group):
                yield b + tail
            group, chars = [], 0
    for b in enc.encode(group):
        yield b + tail
