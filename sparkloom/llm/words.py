"""Token ids of whole texts, word by word, with the tokenizers library.

Most of that library's time goes into its splitting of text, little into the
model.  A blank between two visible characters always ends a token of the
vocabularies used here, so a text is cut there.  A word of plain letters, digits
and marks, or several with one line break between them (see ``_PLAIN``), falls into runs of one class, and the library's model
gives the ids of each run; any other word, with an apostrophe, white space,
another script or a special string, is encoded by the library as it stands.
Known words are kept, twice ``KNOWN`` of at most ``LONG`` characters and those of
one call, whatever the number of texts; those not met for long go first.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

KNOWN, LONG = 250_000, 64
_BLANK = re.compile(r"(?<=\S) (?=\S)")
_NO_SPACE = "\x1c\x1d\x1e\x1f"  # white space for Python alone
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = r"!-&(-/:-@\[-`{-~"
_PLAIN = re.compile(f"[{_LETTERS}0-9{_MARKS}]+(?:\n[{_LETTERS}0-9{_MARKS}]+)*")
_RUNS = re.compile(f"[{_LETTERS}]+|[0-9]+|[{_MARKS}]+")
_RUNS_OF_WORDS = re.compile(f"[{_LETTERS}]+|[0-9]|[{_MARKS}]+")


@lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@lru_cache(maxsize=1)
def _byte_letters() -> dict[int, int]:
    """The letter that a byte-level vocabulary writes for each byte: itself if visible, else the next from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: 256 + k for k, b in enumerate(hidden)}


class Words:
    """An encoder of texts for a byte-level vocabulary, or for one of lower-case words with word ends."""

    def __init__(self, path: str):
        self.tok = load(path)
        self.word_ends = bool(json.loads(self.tok.to_str())["model"].get("end_of_word_suffix"))
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.line = self.whole("\n")
        self.known: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        """Ids of a text as the library gives them."""
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _run(self, run: str) -> bytes:
        found = self.runs.get(run)
        if found is None:
            if run.isascii():
                written = run.replace(" ", "Ġ")
            else:
                written = run.encode().decode("latin-1").translate(_byte_letters())
            found = self.runs[run] = array("I", [t.id for t in self.tok.model.tokenize(written)]).tobytes()
        return found

    def _word(self, word: str) -> bytes:
        """Ids of a word with the blank before it."""
        if len(word) <= LONG and word.isascii():
            before = "" if self.word_ends else " "
            if word.isalpha():
                return self._run(before + (word.lower() if before == "" else word))
            if word[-1] in ".,;:!?" and word[:-1].isalpha():
                return self._run(before + (word[:-1].lower() if before == "" else word[:-1])) + self._run(word[-1])
        if len(word) > LONG or not _PLAIN.fullmatch(word) or "|" in word and any(s in word for s in self.special):
            return self.whole(" " + word)
        if self.word_ends:
            return b"".join(map(self._run, _RUNS_OF_WORDS.findall(word.lower())))
        out = []
        for line in word.split("\n"):
            first, *others = _RUNS.findall(line)
            out += [self.line if out else b"", self._run(first if out else " " + first), *map(self._run, others)]
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as native 32-bit numbers (little-endian on the machines Spark runs on)."""
        if len(self.known) > KNOWN:
            self.known, self.earlier = {}, self.known
        if len(self.runs) > KNOWN:
            self.runs = {}
        known, earlier = self.known, self.earlier
        out = []
        for text in texts:
            first, words = self._cut(text)
            ids = list(map(known.get, words))
            for k in [k for k, x in enumerate(ids) if x is None]:
                w = words[k]
                found = known.get(w)
                if found is None:
                    found = earlier.get(w)
                    if found is None:
                        found = self._word(w)
                    if len(w) <= LONG:
                        known[w] = found
                ids[k] = found
            out.append((self.whole(first) if first else b"") + b"".join(ids))
        return out

    def _cut(self, text: str) -> tuple[str, list[str]]:
        """What stands before the first cut, and the words after it, without their blank."""
        words = text.split()
        if self.word_ends:
            if not any(c in text for c in _NO_SPACE):
                return "", words
        elif sum(map(len, words)) + (gaps := text.count(" ") + text.count("\n")) == len(text) and gaps == len(words) - 1:
            first, *words = text.split(" ")  # all white space is single blanks and line breaks inside the text
            return first, words
        first, *words = _BLANK.split(text)
        return first, words


@lru_cache(maxsize=2)
def words_of(path: str) -> Words:
    """The encoder of a worker process, with what it knows from earlier tasks."""
    return Words(path)
