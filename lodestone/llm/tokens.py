"""Token ids by a public tokenizer, encoded a word at a time with a bounded memory of words.

A byte-level BPE tokenizer splits a text before a single space or line feed that stands between two
characters that aren't white space, whatever surrounds it. So a text is cut there, the tokenizers
library encodes each distinct piece once, and the ids of a text are those of its pieces in turn.
Stretches with adjacent white space go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np

TOKENIZER = "byte_bpe_50k.json"
_ADJACENT = re.compile(r"\s\s")
_SEGMENT = 200_000
#: Beyond so many words or characters only the first _KEPT words, the frequent ones, are remembered.
_WORDS, _KEPT, _CHARACTERS, _GROUP = 600_000, 200_000, 16_000_000, 1_000_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def segments(text: str, size: int = _SEGMENT) -> Iterator[str]:
    """The text in parts that are encoded alike alone and together."""
    begin = 0
    while len(text) - begin > size:
        cut = text.find(" ", begin + size)
        while 0 < cut < len(text) - 1 and (text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if cut <= begin or cut >= len(text) - 1:
            break
        yield text[begin:cut]
        begin = cut
    yield text[begin:]


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for
    themselves, the others for the characters from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return {b: chr(b if b in own else next(others)) for b in range(256)}


_LETTERS = _byte_letters()
_MARKS = ".,;:!?"


class _Index(dict):
    """Numbers keys as they are first asked for, and lists the new ones."""

    def __init__(self, known=()):
        super().__init__(known)
        self.new: list = []

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


#: Letters below this character are letters in all versions of Unicode: a word of them is one pre-token.
_AGREED = "\u0530"


def cuts_at_spaces(path: str) -> bool:
    """Whether a tokenizer file is of the kind whose texts can be cut: byte-level pieces as they stand,
    with no normaliser, no space put before a text, and a plain model of merges."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    pre, model = found.get("pre_tokenizer") or {}, found["model"]
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    merges = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    return found.get("normalizer") is None and bool(plain) and merges


class Encoder:
    """Encodes texts to uint32 arrays; special tokens' strings in a text are ordinary text. With a
    tokenizer of another kind than cuts_at_spaces() tells, the library encodes each text whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.by_words = cuts_at_spaces(path)
        self.library.encode_special_tokens = True
        self.model = self.library.model
        if self.by_words:
            self.line, self.marks = self._pre_token("\n"), {m: self._pre_token(m) for m in _MARKS}
        self.index = _Index()
        self.characters = self.used = 0
        self.flat = np.empty(1 << 18, np.uint32)
        self.starts, self.lengths = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)

    @property
    def size(self) -> int:
        return self.library.get_vocab_size()

    def forget(self) -> None:
        kept = list(islice(self.index.items(), _KEPT))
        self.characters = sum(len(k) for k, _ in kept)
        if self.characters > _CHARACTERS // 2:
            kept, self.characters = [], 0
        self.index = _Index(kept)
        k = len(kept)
        self.used = int(self.starts[k - 1] + self.lengths[k - 1]) if k else 0

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _pre_token(self, text: str) -> list[int]:
        """Ids of one pre-token, by the library's model itself."""
        return [t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(_LETTERS))]

    def _ids(self, pieces: list) -> list[list[int]]:
        out, rest = [], []
        tokenize, marks, space = self.model.tokenize, self.marks, _LETTERS[32]
        for piece in pieces:
            if type(piece) is tuple:
                before, word = "", piece[0]
            elif piece[:1] == "\n":
                before, word = "\n", piece[1:]
            else:
                before, word = " ", piece
            mark = marks.get(word[-1:])
            core = word if mark is None else word[:-1]
            if core.isalpha() and (core.isascii() or max(core) < _AGREED):
                letters = core if core.isascii() else core.encode().decode("latin-1").translate(_LETTERS)
                ids = [t.id for t in tokenize(space + letters if before == " " else letters)]
                if before == "\n":
                    ids = self.line + ids
                out.append(ids if mark is None else ids + mark)
            else:
                rest.append((len(out), before + word))
                out.append([])
        for i in range(0, len(rest), 1024):
            part = rest[i : i + 1024]
            for (at, _), ids in zip(part, self._whole([t for _, t in part])):
                out[at] = ids
        return out

    def _learn(self) -> None:
        new, self.index.new = self.index.new, []
        if not new:
            return
        found = self._ids(new)
        k, sizes = len(self.index) - len(new), [len(x) for x in found]
        total = sum(sizes)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while len(self.index) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.empty_like(x)]) for x in (self.starts, self.lengths))
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), np.uint32, total)
        self.lengths[k : k + len(new)] = sizes
        self.starts[k : k + len(new)] = self.used + np.cumsum(sizes) - sizes
        self.used += total
        self.characters += sum(map(len, new))

    def _gather(self, at: np.ndarray) -> np.ndarray:
        n = self.lengths[at]
        total = int(n.sum())
        return self.flat[np.repeat(self.starts[at] - (np.cumsum(n) - n), n) + np.arange(total)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_words:
            return [np.array(ids, np.uint32) for ids in self._whole(texts)]
        if len(self.index) > _WORDS or self.characters > _CHARACTERS:
            self.forget()
        number, jobs = self.index.__getitem__, []
        for owner, text in enumerate(texts):
            for part in segments(text) if text else ():
                if _ADJACENT.search(part):
                    jobs.append((owner, part))
                    continue
                pieces: list = part.replace("\n", " \n").split(" ")
                pieces[0] = (pieces[0],)
                jobs.append((owner, np.fromiter(map(number, pieces), np.int64, len(pieces))))
        self._learn()
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for owner, job in jobs:
            if type(job) is str:
                ids = np.array(self._whole([job])[0], np.uint32)
            else:
                ids = self._gather(job)
            out[owner].append(ids)
        empty = np.empty(0, np.uint32)
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else empty for x in out]

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """One array for each text, a bounded group of texts at a time; null counts as empty."""
        group, held = [], 0
        for text in texts:
            group.append(text or "")
            held += len(group[-1])
            if held > _GROUP or len(group) >= 256:
                yield from self.encode(group)
                group, held = [], 0
        yield from self.encode(group)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and path."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
