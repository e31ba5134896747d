"""Fast token ids from the tokenizers library: a word's ids are looked up once a worker.

BPE never merges across a pre-token, and both pre-tokenizers used here always cut between
a word and a following single space or line end. So a text's ids are its words' ids in a row.
A text's words are looked up once; those not known yet are noted on the way, go to the library
in batches and are put in afterwards. Texts with any other white space go to the library whole.
Of a vocabulary that drops white space, an unknown word is cut into its pre-tokens here, and only
pre-tokens not known yet go to the vocabulary's BPE, many in one call.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from itertools import islice
from unicodedata import is_normalized

import numpy as np

#: Entries of a worker's cache; it is emptied when full, which costs time only. Words that go to the library at once.
CHUNKS, AT_ONCE = 1_000_000, 512

#: Python takes these for white space, the library does not.
ODD = ("\x1c", "\x1d", "\x1e", "\x1f")

#: Letters that the library leaves as they stand, old enough to be letters in any release of Unicode; marks but the apostrophe, which begins pre-tokens with letters.
LETTERS = "".join(c for c in map(chr, range(ord("a"), 0x530)) if c.isalpha() and c == c.lower() and is_normalized("NFC", c))
MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")

#: Words that PIECE cuts as CUTS does; of these, one of letters alone is a single pre-token.
SAFE, PIECE = re.compile(f"[{LETTERS}0-9{re.escape(MARKS)}]*"), re.compile(f"[{LETTERS}]+|[0-9]|[{re.escape(MARKS)}]+")

#: The normalizer and pre-tokenizer for which that holds.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
CUTS = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}


class Noted(dict):
    """Ids by word. A word that is not there is noted and stands as None."""

    def __init__(self) -> None:
        self.missed: list[str] = []

    def __missing__(self, word: str) -> None:
        self.missed.append(word)


class WordIds:
    """Ids of whole texts as little-endian numbers of ``width`` bytes.

    ``spaced``: the vocabulary marks a leading space (byte-level BPE); else white space is
    dropped and letters are lowered (word-end BPE). ``plain_specials``: the strings of the
    vocabulary's special tokens are ordinary text; else, as the library has it, they are
    these tokens wherever a text holds them.
    """

    def __init__(self, path: str, spaced: bool, plain_specials: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        # their strings in a text may be ids of their own, across words: such texts go to the library whole
        self.specials = [] if plain_specials else [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = {t[0] for t in self.specials}  # quick to rule out; a letter may be of either case
        self.marks |= {m.upper() for m in self.marks}
        self.spaced = spaced
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.first = Noted()  # words as they stand
        self.later = Noted()  # words behind a space, if that is part of a token
        self.bare = None if spaced else self._bare()  # for words already cut into pre-tokens

    def _bare(self):  # noqa: ANN202
        """The vocabulary's BPE over what spaces part, if PIECE cuts words as the vocabulary does and its tokens tell where a pre-token ends; else None."""
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        normalizer, cuts = ({} if part is None else json.loads(part.__getstate__()) for part in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer))
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        levels = cuts.get("pretokenizers", [])
        if normalizer != NORMALIZER or not suffix or len(levels) != 2 or levels[0] != CUTS or levels[1] | {"trim_offsets": True} != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}:
            return None
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocabulary.values(), default=-1) + 1, bool)  # whether a token ends its pre-token
        self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        bare = Tokenizer(self.tokenizer.model)
        bare.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        return bare

    def pack(self, ids: list[int]) -> bytes:
        return np.asarray(ids, dtype=f"<u{self.width}").tobytes()

    def whole(self, texts: list[str]) -> list[bytes]:
        """By the library, as they stand."""
        kind = "H" if self.width == 2 else "I"
        out = [array(kind, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return out if sys.byteorder == "little" else [np.frombuffer(x, f">u{self.width}").astype(f"<u{self.width}").tobytes() for x in out]

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """Of pre-tokens, in one call; by the library as they stand if the vocabulary lacks an end for some."""
        ids = np.array(self.bare.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, dtype=f"<u{self.width}")
        ends = ((np.flatnonzero(self.last[ids]) + 1) * self.width).tolist()
        if len(ends) != len(pieces):
            return self.whole(pieces)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def cut(self, words: set[str], known: Noted) -> list[str]:
        """Puts the ids of the words that PIECE can cut in ``known``, and those of their pre-tokens; returns the others."""
        others = [] if SAFE.fullmatch("".join(words)) else [word for word in words if not SAFE.fullmatch(word)]
        words = words.difference(others)
        new = set(filter(str.isalpha, words))
        several = {}
        for word in words - new:
            head = word.rstrip(MARKS)
            several[word] = (head, word[len(head) :]) if head.isalpha() else PIECE.findall(word)
        new.update([piece for found in several.values() for piece in found if piece not in known])
        rest = iter(new)
        while some := list(islice(rest, AT_ONCE)):
            known.update(zip(some, self.pieces(some), strict=True))
        known.update((word, b"".join([known[piece] for piece in found])) for word, found in several.items())
        return others

    def learn(self, words: set[str], lead: str, known: Noted) -> None:
        """Puts the ids of the words, behind ``lead``, in ``known``."""
        rest = iter(words if self.bare is None else self.cut(words, known))
        while some := list(islice(rest, AT_ONCE)):
            known.update(zip(some, self.whole([lead + word for word in some]), strict=True))

    def fill(self, flat: list[bytes | None], known: Noted, lead: str) -> None:
        """Learns the words that ``known`` noted, and puts their ids in place of each None, in order."""
        self.learn(set(known.missed), lead, known)
        at = -1
        for word in known.missed:
            at = flat.index(None, at + 1)
            flat[at] = known[word]
        known.missed.clear()

    def room(self) -> None:
        """Empties the cache if it is full."""
        if len(self.first) + len(self.later) > CHUNKS:
            self.first.clear()
            self.later.clear()

    def special(self, text: str) -> bool:
        """Whether a special token's string may be in the text, whatever the case of its letters."""
        return any(mark in text for mark in self.marks) and any(t in text.lower() for t in self.specials)

    def plain(self, text: str) -> list[str] | None:
        """Words whose ids in a row are the text's, for a vocabulary that drops white space; None if only the library can tell."""
        if any(c in text for c in ODD) or self.special(text):
            return None
        if "\u03a3" not in text and is_normalized("NFC", text):
            text = text.lower()  # as the library would, letter by letter; fewer words to learn
        return text.split()

    def lines(self, text: str) -> list[list[str]] | None:
        """Words by line, for a vocabulary that marks spaces; None unless single spaces and line ends are the only white space."""
        if self.special(text):
            return None
        out = []
        lines = text.split("\n")
        if not lines[-1] and len(lines) > 1:
            lines.pop()
            end = [[""]]
        else:
            end = []
        for line in lines:
            if not line or line[0] == " " or line[-1] == " " or "  " in line or not line.isprintable():
                return None
            out.append(line.split(" "))
        return out + end

    def encode(self, texts: list[str]) -> list[bytes]:
        return self._encode_lines(texts) if self.spaced else self._encode_plain(texts)

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        self.room()
        flat: list[bytes | None] = []
        ends, alone, get = [], [], self.first.__getitem__
        for k, text in enumerate(texts):
            words = self.plain(text)
            if words is None:
                alone.append(k)
            else:
                flat.extend(map(get, words))
            ends.append(len(flat))
        self.fill(flat, self.first, "")
        return self._joined(flat, ends, alone, texts)

    def _encode_lines(self, texts: list[str]) -> list[bytes]:
        self.room()
        if "\n" not in self.first:
            self.first[""] = b""
            self.learn({"\n"}, "", self.first)
        new_line, first, get = self.first["\n"], self.first, self.later.__getitem__
        flat: list[bytes | str | None] = []
        ends, alone, spots = [], [], []
        for k, text in enumerate(texts):
            lines = self.lines(text) if text else []
            if lines is None:
                alone.append(k)
            for i, line in enumerate(lines or ()):
                if i:
                    flat.append(new_line)
                ids = first[line[0]]
                if ids is None:
                    spots.append(len(flat))
                    ids = line[0]  # until it is known, so that the others stay the only None
                flat.append(ids)
                if len(line) > 1:
                    flat.extend(map(get, islice(line, 1, None)))
            ends.append(len(flat))
        self.learn(set(first.missed), "", first)
        first.missed.clear()
        for spot in spots:
            flat[spot] = first[flat[spot]]
        self.fill(flat, self.later, " ")
        return self._joined(flat, ends, alone, texts)

    def _joined(self, flat: list[bytes], ends: list[int], alone: list[int], texts: list[str]) -> list[bytes]:
        """Each text's ids: its run of ``flat``, or by the library if it stands alone."""
        out = [b"".join(flat[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
        for k, ids in zip(alone, self.whole([texts[k] for k in alone]), strict=True):
            out[k] = ids
        return out


_KEPT: dict[tuple[str, bool, bool], WordIds] = {}


def word_ids(path: str, spaced: bool, plain_specials: bool = False) -> WordIds:
    """One per worker process and vocabulary."""
    key = (path, spaced, plain_specials)
    if key not in _KEPT:
        _KEPT[key] = WordIds(*key)
    return _KEPT[key]
