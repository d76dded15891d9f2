"""Whole-text byte-level BPE ids through the tokenizers library, one distinct chunk at a time.

A byte-level pre-tokenizer of the usual pattern (optional space and letters, or digits, or other signs;
runs of white space) never lets a token cross a single space, or a single line feed, that stands between
two visible characters. Texts are cut there, each distinct chunk is given to the library once for as long
as the worker remembers it (a memo that is full stays at hand while the next one fills), and the ids are put together again. Anything irregular (double spaces, tabs,
edges) is cut more coarsely and given to the library as it stands; a text that holds an added token's
string goes to it whole. So does every text where the file's own settings are others than these: no
normalizer, no truncation, a byte-level pre-tokenizer with that pattern and no space put in front, and a
plain BPE model. Ids are kept as little-endian unsigned 32-bit bytes.
"""

from __future__ import annotations

import re
from functools import lru_cache

from tokenizers import Tokenizer, models, pre_tokenizers

REMEMBERED = 150_000
REGULAR_SPACE = re.compile(r"(?<=\S)(?= \S)")
#: ASCII signs that the pattern takes as one run after letters; an apostrophe may begin a pre-token of its own.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for 256 and on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def cuts_at_spaces(library: Tokenizer) -> bool:
    """Whether a tokenizer's settings are those for which texts may be cut."""
    before, model = library.pre_tokenizer, library.model
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    plain = isinstance(model, models.BPE) and not any(getattr(model, k) for k in odd)
    regular = isinstance(before, pre_tokenizers.ByteLevel) and before.use_regex and not before.add_prefix_space
    return plain and regular and library.normalizer is None and library.truncation is None and library.padding is None


def regular(text: str) -> bool:
    """Whether white space is single spaces and line feeds between visible characters alone."""
    one_line = text.replace("\n", " ")
    if one_line.isprintable():  # of all white space only the space is printable
        return "  " not in one_line and one_line[0] != " " and one_line[-1] != " "
    return text.split() == one_line.split(" ")


class ChunkedBpe:
    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.cuts = cuts_at_spaces(self.library)
        self.model = self.library.model
        self.letters = _byte_letters()
        self.space = self.letters[32]
        self.packed = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size())]
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.spaced: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}
        self.older_spaced: dict[str, bytes] = {}
        self.older_plain: dict[str, bytes] = {}
        self.line_feed = self._library("\n")

    def _library(self, text: str) -> bytes:
        packed = self.packed
        return b"".join([packed[i] for i in self.library.encode(text, add_special_tokens=False).ids])

    def _word(self, word: str, space: str) -> bytes:
        """One pre-token of letters, given to the library's model in its byte-level letters."""
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(self.space + shown if space else shown)])

    def _chunk(self, chunk: str, space: str) -> bytes:
        if chunk.isalpha():
            return self._word(chunk, space)
        stem = chunk.rstrip(SIGNS)
        if stem.isalpha():  # letters, then signs: two pre-tokens
            return self._known(stem, space) + self._known(chunk[len(stem) :], "")
        return self._word(chunk, "") if not stem and not space else self._library(space + chunk)

    def _known(self, chunk: str, space: str) -> bytes:
        memo, older = (self.spaced, self.older_spaced) if space else (self.plain, self.older_plain)
        got = memo.get(chunk)
        if got is None:
            got = older.get(chunk)
            if got is None:
                got = self._chunk(chunk, space)
            if len(chunk) <= 64:
                self._remember(chunk, space, got)
        return got

    def _remember(self, chunk: str, space: str, got: bytes) -> None:
        """What is met again while a memo fills stays known when the next one is begun."""
        if space:
            if len(self.spaced) >= REMEMBERED:
                self.older_spaced, self.spaced = self.spaced, {}
            self.spaced[chunk] = got
        else:
            if len(self.plain) >= REMEMBERED:
                self.older_plain, self.plain = self.plain, {}
            self.plain[chunk] = got

    def _missed(self, word: str) -> bytes:
        """``_known(word, " ")`` of a word that wasn't known when its line was begun, the usual kind first."""
        if not word.isalpha() or len(word) > 64 or len(self.spaced) >= REMEMBERED:
            return self._known(word, " ")
        got = self.older_spaced.get(word)
        if got is None:
            shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            packed = self.packed
            got = b"".join([packed[t.id] for t in self.model.tokenize(self.space + shown)])
        self.spaced[word] = got
        return got

    def forget(self) -> None:
        """Give back the memory of remembered chunks; a worker may go on to other stages."""
        self.spaced, self.plain, self.older_spaced, self.older_plain = {}, {}, {}, {}

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.cuts or any(a in text for a in self.added):
            return self._library(text)
        if not regular(text):
            return b"".join([self._known(c, "") for c in REGULAR_SPACE.split(text)])
        get, known, out = self.spaced.get, self._known, []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(self.line_feed)
            head, *rest = line.split(" ")
            out.append(known(head, ""))
            got = list(map(get, rest))
            if None in got:
                got = [self._missed(w) if g is None else g for g, w in zip(got, rest)]
                get = self.spaced.get
            out += got
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkedBpe:
    """One encoder for each worker process and file."""
    return ChunkedBpe(path)
