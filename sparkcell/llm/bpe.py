"""A BPE vocabulary with word ends, compiled to a counting transducer.

The machine reads characters. BPE itself is finite-state: the last token of what a prefix of a word
encodes to is the one suffix t of it that is a token and that the last token before t stands beside
unmerged. So all that counts of a prefix is, for each place from which a token may still be under
way, the last token up to that place and how many tokens have come since. A State is that (with the
kind of word it is in), and each of its transitions is annotated with the tokens that it emits: the
difference of two prefixes' counts within a word, and what the word's end adds where it ends.
Contractions, numbers and runs of other characters are states and transitions of the same machine.
States and transitions are compiled when first met and kept, up to STATES of them, so that a
worker's memory is bounded however many words a corpus has.

A chunk of text, cut anywhere, is a state map: from the state before it to the state after it and the
tokens emitted. White space leads from every state to the start state, so a map is a constant but for
the text up to its first white space (`head`). Maps compose associatively; chunks are mapped apart
and joined by a parallel prefix scan.

Characters outside ALPHABET (whose normal form or lower case may depend on their neighbours),
pieces that may hold a special string and pieces of more than LONG characters are single symbols,
whose tokens the vocabulary's own library counts: same result.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import groupby

import numpy as np

#: Compiled words (about 200 bytes each) and states (about 700) that a worker keeps.
WORDS_KEPT, STATES = 1_000_000, 250_000
#: Characters of a piece that the machine reads, at most.
LONG = 512
#: Characters in a chunk.
CHUNK = 1 << 16


def _alphabet() -> tuple[str, str, str]:
    """Letters, numbers and all characters of the compiled alphabet, as class bodies. All lie below
    U+0180 or are common punctuation, so each is its own canonical form and takes no part in
    composing; those that lower case makes longer are left out."""
    letters, numbers, rest = [], [], []
    for c in map(chr, [*range(0x21, 0x7F), *range(0xA1, 0x180), 0x2013, 0x2014, 0x2018, 0x2019, 0x201C, 0x201D, 0x20AC]):
        kind = unicodedata.category(c)
        if len(c.lower()) != 1 or not unicodedata.is_normalized("NFC", c) or kind == "Cf":
            continue
        (letters if kind[0] == "L" else numbers if kind[0] == "N" else rest).append(re.escape(c))
    return "".join(letters), "".join(numbers), "".join(rest)


_LETTERS, _NUMBERS, _REST = _alphabet()
#: Texts whose words are found without the library.
PLAIN = re.compile(f"[{_LETTERS}{_NUMBERS}{_REST} \t\n\r\f\v]*")
#: The vocabulary's word rule, with its character classes over the alphabet.
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")
#: Separators that str.split() knows and the vocabulary does not.
ODD_SPACE = re.compile("[\x1c-\x1f]")
SPACE = re.compile(r"\s")
LONG_PIECE = re.compile(rf"\S{{{LONG + 1}}}")


def stretches(text: str) -> list[tuple[bool, str]]:
    """The text as stretches between white space that the machine reads (True), and pieces (or a whole
    text with separators that the vocabulary does not know) for the library."""
    if ODD_SPACE.search(text):
        return [(False, text)]
    if "<|" not in text and PLAIN.fullmatch(text) and not LONG_PIECE.search(text):
        return [(True, text)]
    fits = lambda piece: len(piece) <= LONG and "<|" not in piece and bool(PLAIN.fullmatch(piece))
    return [part for plain, pieces in groupby(text.split(), fits) for part in ([(True, " ".join(pieces))] if plain else [(False, x) for x in pieces])]


def _bytes_to_chars() -> list[str]:
    """The byte alphabet of byte-level vocabularies. Printable Latin-1 bytes stand for themselves,
    the others for the characters from U+0100 on."""
    out, n = [], 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(256 + n))
            n += 1
    return out


class Vocabulary:
    """Words compiled to their token ids (little-endian, 16 bits each)."""

    def __init__(self, path: str) -> None:
        model = json.loads(open(path, encoding="utf-8").read())["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.model = model
        self.path, self.lib, self.words = path, None, {}
        self.inner = np.array([vocab[c] for c in _bytes_to_chars()], np.int64)
        self.last = np.array([vocab[c + end] for c in _bytes_to_chars()], np.int64)
        pairs = np.array([(vocab[a] << 16 | vocab[b], k, vocab[a + b]) for k, (a, b) in enumerate(model["merges"])] or [(-1, 0, 0)], np.int64)
        pairs = pairs[np.argsort(pairs[:, 0])]
        self.pair, self.none = np.append(pairs[:, 0], 1 << 40), len(vocab)
        self.rank, self.made = np.append(pairs[:, 1], self.none), np.append(pairs[:, 2], 0)

    def library(self, text: str) -> bytes:
        if self.lib is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.lib = Tokenizer.from_file(self.path)
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def cut(self, text: str) -> list[str]:
        """The keys of a text's words, in order. A piece for the library is one key, after a space."""
        if "<|" not in text and PLAIN.fullmatch(text):
            return WORDS.findall(text.lower())
        out = []
        for plain, part in stretches(text):
            out += WORDS.findall(part.lower()) if plain else [" " + part]
        return out

    def compile(self, keys: Iterable[str]) -> None:
        """Afterwards each key's ids are in self.words."""
        keys = set(keys)
        if len(self.words) > WORDS_KEPT:
            self.words.clear()
        by_size: dict[int, list[tuple[bytes, str]]] = {}
        for key in keys.difference(self.words):
            if key[0] == " " or len(key) > LONG:
                self.words[key] = self.library(key.removeprefix(" "))
            else:
                raw = key.encode()
                by_size.setdefault(len(raw), []).append((raw, key))
        for size, words in by_size.items():
            step = max(1, (1 << 19) // size)
            for k in range(0, len(words), step):
                self._merge(size, words[k : k + step])

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << 16 | right
        at = np.searchsorted(self.pair, key)
        found = self.pair[at] == key
        return np.where(found, self.rank[at], self.none), self.made[at]

    def _merge(self, size: int, words: list[tuple[bytes, str]]) -> None:
        """Merge pairs of all words, which have `size` bytes each: in each round, each word's pair
        of least rank, the leftmost of equals, until no word has a pair with a rank."""
        raw = np.frombuffer(b"".join(w for w, _ in words), np.uint8).reshape(-1, size)
        ids = self.inner[raw]
        ids[:, -1] = self.last[raw[:, -1]]
        n = np.full(len(ids), size)
        rank = np.full(ids.shape, self.none, np.int64)
        made = np.zeros(ids.shape, np.int64)
        if size > 1:
            rank[:, :-1], made[:, :-1] = self._ranks(ids[:, :-1], ids[:, 1:])
        rows, columns = np.arange(len(ids)), np.arange(size)
        while len(rows):
            at = rank[rows].argmin(1)
            on = rank[rows, at] < self.none
            rows, at = rows[on], at[on]
            if not len(rows):
                break
            new = made[rows, at]
            source = np.minimum(columns + (columns > at[:, None]), size - 1) + rows[:, None] * size
            for a in (ids, rank, made):
                a[rows] = a.ravel()[source]
            n[rows] -= 1
            ids[rows, at] = new
            rank[rows, n[rows] - 1] = self.none
            rank[rows, at] = self.none
            inner = at + 1 < n[rows]
            r, c = rows[inner], at[inner]
            rank[r, c], made[r, c] = self._ranks(ids[r, c], ids[r, c + 1])
            r, c = rows[at > 0], at[at > 0] - 1
            rank[r, c], made[r, c] = self._ranks(ids[r, c], ids[r, c + 1])
        short, flat = n.tolist(), ids.astype("<u2").tobytes()
        for k, (_, key) in enumerate(words):
            self.words[key] = flat[2 * size * k : 2 * (size * k + short[k])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts, 16 bits each."""
        return [b"".join(found) for found in self.found([self.cut(t) for t in texts])]

    def found(self, cuts: list[list[str]]) -> list[list[bytes]]:
        """The ids of each key; new keys are compiled first. One look-up a word, unless it is new."""
        out = [[*map(self.words.get, c)] for c in cuts]
        holes = [k for k, ids in enumerate(out) if None in ids]
        if holes:
            self.compile(key for k in holes for key, ids in zip(cuts[k], out[k]) if ids is None)
            for k in holes:
                out[k] = [self.words[key] if ids is None else ids for key, ids in zip(cuts[k], out[k])]
        return out


class Merges:
    """What the machine is compiled from: tokens as strings of byte characters, and their merges."""

    def __init__(self, model: dict) -> None:
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        chars = _bytes_to_chars()
        self.rank = {(vocab[x], vocab[y]): k for k, (x, y) in enumerate(model["merges"])}
        halves = {vocab[x + y]: (vocab[x], vocab[y], k) for k, (x, y) in reversed([*enumerate(model["merges"])])}
        made = {vocab[c + e] for c in chars for e in ("", end)} | halves.keys()
        text = {i: t for t, i in vocab.items() if i in made}
        self.inner = {t: i for i, t in text.items() if not t.endswith(end)}
        self.ends = {t[: -len(end)]: i for i, t in text.items() if t.endswith(end)}
        self.begun = {t[:k] for t in self.inner for k in range(len(t))} | {t[:k] for t in self.ends for k in range(len(t) + 1)}
        self.halves, self.spines, self.beside_known = halves, {}, {}

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The token and its halves on one side, down to one byte, each with the rank of the merge
        that ends it (of the token itself: none)."""
        if (token, side) not in self.spines:
            out, rank, x = [], 1 << 40, token
            while True:
                out.append((x, rank))
                if x not in self.halves:
                    break
                rank, x = self.halves[x][2], self.halves[x][side]
            self.spines[token, side] = out
        return self.spines[token, side]

    def beside(self, left: int, right: int) -> bool:
        """Whether two tokens stand side by side unmerged: no pair across their border comes to be
        merged before one of the two is used up. Of equal merges the leftmost comes first."""
        known = self.beside_known.get((left, right))
        if known is None:
            known = True
            for x, x_rank in self.spine(left, 1):
                for y, y_rank in self.spine(right, 0):
                    rank = self.rank.get((x, y))
                    if rank is not None and rank < x_rank and rank <= y_rank:
                        known = False
            self.beside_known[left, right] = known
        return known


#: Kinds of words that a state is in: none, letters, other characters, an apostrophe at a word's
#: begin, and that with a letter that may become a contraction.
START, LETTERS, OTHERS, QUOTE = "", "L", "O", "'"
#: What completes a contraction.
CONTRACTIONS = {"'": "stmd", "'r": "e", "'v": "e", "'l": "l"}


class State(dict):
    """Transitions: character -> (state, tokens emitted); compiled when first asked for.

    `begun` is the longest end of the word's text with which a token may begin, and `places` has, for
    each such end of k bytes, (k, last token before it, tokens since)."""

    __slots__ = ("machine", "kind", "begun", "places", "end")

    def __init__(self, machine: "Transducer", kind: str, begun: str, places: tuple) -> None:
        self.machine, self.kind, self.begun, self.places, self.end = machine, kind, begun, places, None

    def __missing__(self, char: str) -> tuple["State", int]:
        self[char] = found = self.machine.transition(self, char)
        return found


@dataclass(frozen=True)
class StateMap:
    """What a chunk does to a state: it reads `head` from it; then, if `after` is there, emits
    `emitted` and ends in `after`, whatever the state was."""

    head: str
    emitted: int = 0
    after: State | None = None

    def of(self, state: State) -> tuple[State, int]:
        state, n = state.machine.read(self.head, state)
        return (state, n) if self.after is None else (self.after, n + self.emitted)

    def then(self, other: "StateMap") -> "StateMap":
        if self.after is None:
            return StateMap(self.head + other.head, other.emitted, other.after)
        state, n = other.of(self.after)
        return StateMap(self.head, self.emitted + n, state)


class Transducer:
    """Token counts of texts by one vocabulary."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self.merges = Merges(self.vocabulary.model)
        self.bytes = dict(zip(range(256), _bytes_to_chars()))
        self.letters, self.numbers = set(re.findall(f"[{_LETTERS}]", "".join(map(chr, range(0x2100))))), set(re.findall(f"[{_NUMBERS}]", "".join(map(chr, range(0x2100)))))
        self.clear()

    def clear(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = self._state(START, "", ((0, -1, 0),))

    def _state(self, kind: str, begun: str, places: tuple) -> State:
        key = (kind, begun, places)
        if key not in self.states:
            self.states[key] = State(self, *key)
        return self.states[key]

    def _grown(self, state: State, char: str, kind: str) -> tuple[State, int]:
        """The state after one more character of the word, and how many tokens more that is."""
        begun, places, total, m = state.begun, state.places, 0, self.merges
        for byte in char.encode():
            begun += self.bytes[byte]
            for k, last, since in places:
                token = m.inner.get(begun[len(begun) - k - 1 :])
                if token is not None and (last < 0 or m.beside(last, token)):
                    break
            more = 1 - since
            places = (*((k + 1, x, n + more) for k, x, n in places if begun[len(begun) - k - 1 :] in m.begun), (0, token, 0))
            begun = begun[len(begun) - places[0][0] :]
            total += more
        return self._state(kind, begun, places), total

    def _end(self, state: State) -> tuple[int, int, int]:
        """The last token of a word that ends in a state, its bytes, and the tokens since before it."""
        if state.end is None:
            for k, last, since in state.places:
                token = self.merges.ends.get(state.begun[len(state.begun) - k :]) if k else None
                if token is not None and (last < 0 or self.merges.beside(last, token)):
                    state.end = token, k, since
        return state.end

    def _closed(self, state: State) -> int:
        """Tokens that a word's end adds."""
        return 0 if state.kind == START else 1 - self._end(state)[2]

    def _word(self, text: str) -> int:
        state, n = self.start, 0
        for c in text:
            state, more = self._grown(state, c, LETTERS)
            n += more
        return n + self._closed(state)

    def bound(self) -> None:
        if len(self.states) > STATES:
            self.clear()
            self.merges.beside_known.clear()

    def transition(self, state: State, char: str) -> tuple[State, int]:
        """The state that a character leads to and the tokens emitted on the way."""
        kind = state.kind
        if kind.startswith(QUOTE) and char in CONTRACTIONS[kind]:
            return self.start, self._word(kind + char) - (self._word_begun(kind) if kind == QUOTE else 0)
        if kind == QUOTE and kind + char in CONTRACTIONS:  # emits nothing until it is known what it is
            return self._state(kind + char, "", ((0, -1, 0),)), -self._word_begun(kind)
        if len(kind) == 2:  # no contraction: the apostrophe was a word, the letter begins one
            (word, n), quote = self._grown(self.start, kind[1], LETTERS), self._word(QUOTE)
            after, more = word[char]
            return after, quote + n + more
        if char.isspace():
            return self.start, self._closed(state)
        if char in self.numbers:
            return self.start, self._closed(state) + self._word(char)
        to = LETTERS if char in self.letters else OTHERS
        if kind == to or kind == QUOTE and to == OTHERS:
            return self._grown(state, char, to)
        after, n = self._grown(self.start, char, QUOTE if char == QUOTE else to)
        return after, self._closed(state) + n

    def _word_begun(self, text: str) -> int:
        return self._grown(self.start, text, QUOTE)[1]

    def read(self, text: str, state: State) -> tuple[State, int]:
        total = 0
        for c in text:
            state, n = state[c]
            total += n
        return state, total

    def mapped(self, chunk: str) -> StateMap:
        """A chunk's state map."""
        space = SPACE.search(chunk)
        if not space:
            return StateMap(chunk)
        after, n = self.read(chunk[space.end() :], self.start)
        return StateMap(chunk[: space.end()], n, after)

    def scan(self, maps: list[StateMap]) -> list[StateMap]:
        """Prefix compositions: of neighbours first, then of the pairs, in a logarithm of steps each
        of which may run side by side."""
        if len(maps) < 2:
            return maps
        pairs = self.scan([maps[k].then(maps[k + 1]) for k in range(0, len(maps) - 1, 2)])
        return [maps[0], *(pairs[k // 2] if k % 2 else pairs[k // 2 - 1].then(maps[k]) for k in range(1, len(maps)))]

    def one(self, text: str, size: int = CHUNK) -> int:
        total = 0
        for plain, part in stretches(text):
            if not plain:
                total += len(self.vocabulary.library(part)) // 2
                continue
            part = part.lower() + " "
            if len(part) <= size:
                total += self.read(part, self.start)[1]
            else:
                total += self.scan([self.mapped(part[k : k + size]) for k in range(0, len(part), size)])[-1].of(self.start)[1]
        return total

    def count(self, texts: list[str], size: int = CHUNK) -> list[int]:
        self.bound()
        return [self.one(t, size) for t in texts]


_loaded: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The compiled vocabulary of this worker process; it is kept from task to task."""
    if path not in _loaded:
        _loaded[path] = Transducer(path)
    return _loaded[path]
