"""Cutting texts for byte-level tokenizers, with a bounded memory of what was seen.

Tokenizers of this kind never merge across the matches of a split pattern, and a space
that follows a visible character always starts a match.  So a text may be cut before each
such space; each distinct piece of a batch is encoded once, and the pieces' ids are
gathered side by side.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Marks that the split pattern takes together when they follow a word; an apostrophe may start a match of its own.
STOPS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
WHITE = regex.compile(r"[\s\x1c-\x1f\x85]")
#: Longer words aren't remembered.
LONGEST = 48


class Remembered:
    """Values by word; the older half of them is forgotten when there are too many."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def values(self, words: list[str], make: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The values of distinct words; those of words that aren't remembered are made together."""
        values = list(map(self.new.get, words))
        missing = [i for i, v in enumerate(values) if v is None]
        if not missing:
            return values
        lost = [words[i] for i in missing]
        found = list(map(self.old.get, lost))
        made = iter(make([w for w, v in zip(lost, found, strict=True) if v is None]))
        found = [next(made) if v is None else v for v in found]
        for i, v in zip(missing, found, strict=True):
            values[i] = v
        if len(self.new) + len(lost) > self.most:
            self.old, self.new = self.new, {}
        self.new.update(islice(zip(lost, found, strict=True), self.most))
        for w in lost:
            if len(w) > LONGEST:
                self.new.pop(w, None)
        return values


def plain(stem: str) -> bool:
    """Whether a word is of letters only, of scripts that all Unicode versions agree on."""
    return stem.isalpha() and (stem.isascii() or max(stem) < "\u0500")


def plain_words(stems: pa.Array) -> np.ndarray:
    """:func:`plain` for each of an array of large strings."""
    _, offsets, data = stems.buffers()
    at = np.frombuffer(offsets, np.int64)[stems.offset : stems.offset + len(stems) + 1]
    if not len(stems) or data is None:
        return np.zeros(len(stems), bool)
    # From U+0500 on, characters start with a byte of 0xD4 or more.
    far = np.concatenate(([0], np.cumsum(np.frombuffer(data, np.uint8)[at[0] : at[-1]] >= 0xD4)))
    return pc.utf8_is_alpha(stems).to_numpy(zero_copy_only=False) & (np.diff(far[at - at[0]]) == 0)


def last_bytes(strings: pa.Array) -> np.ndarray:
    """The last byte of each of an array of large strings; a space for an empty one."""
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    out = np.full(len(strings), 32, np.uint8)
    some = np.flatnonzero(at[1:] > at[:-1])
    if len(some):
        out[some] = np.frombuffer(data, np.uint8)[at[1:][some] - 1]
    return out


def listed(strings: pa.Array) -> list[str]:
    """The strings of a null-free array, in one go."""
    return strings.to_numpy(zero_copy_only=False).tolist()


_SPACES = np.array([chr(b).isspace() for b in range(128)] + [False] * 128)


class PieceEncoder:
    """Encodes batches of texts; a subclass gives :meth:`_encoded` and :meth:`_whole`."""

    def __init__(self, remembered: int):
        self.known = Remembered(remembered)

    def _encoded(self, words: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each word, a match of the split pattern."""
        raise NotImplementedError

    def _whole(self, text: str) -> list[str]:
        """The words of any text, by the split pattern itself."""
        raise NotImplementedError

    def _part(self, part: str, space: str) -> list[str]:
        """A part without white space, after a given space or none: letters and plain marks by rule, all else by the pattern."""
        stem = part.rstrip(STOPS)
        if plain(stem):
            return [space + stem, part[len(stem) :]] if len(stem) < len(part) else [space + stem]
        return self._whole(space + part)

    def _piece(self, piece: str) -> list[str]:
        """What follows a space, up to the next one."""
        first, line, rest = piece.partition("\n")
        if line and first and rest and not WHITE.search(first) and not WHITE.search(rest):
            return [*self._part(first, " "), "\n", *self._part(rest, "")]
        return self._part(piece, " ")

    def encode(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of null-free large strings in a row, each text's followed by ``end``, and each text's number of ids.

        A text where a space follows other white space isn't cut.
        """
        lists = pc.split_pattern(texts, " ")
        flat, at = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        at = at - at[0]
        coded = flat.dictionary_encode()
        codes, names = coded.indices.to_numpy(), coded.dictionary
        heads = at[:-1]
        first = flat.take(pa.array(heads))
        del lists, flat
        # A cut is unsafe behind white space.
        ends = last_bytes(names)
        joins = _SPACES[ends]
        for i in np.flatnonzero(ends >= 128).tolist():
            joins[i] = names[i].as_py()[-1].isspace()
        bad = joins[codes] if len(codes) else np.zeros(0, bool)
        bad[at[1:] - 1] = False
        bad[heads] &= pc.greater(pc.binary_length(first), 0).to_numpy(zero_copy_only=False)
        sums = np.concatenate(([0], np.cumsum(bad)))
        unsafe = sums[at[1:]] > sums[at[:-1]]
        used = np.ones(len(codes), bool)
        used[heads] = False
        for i in np.flatnonzero(unsafe):
            used[at[i] : at[i + 1]] = False
        wanted = np.bincount(codes[used], minlength=len(names)) > 0
        # Most pieces are a word of letters, with marks behind it or without, or two of them with a line break between.
        lines = pc.split_pattern(names, "\n")
        two = np.flatnonzero(wanted & (pc.list_value_length(lines).to_numpy(zero_copy_only=False) == 2))
        parts = pa.concat_arrays([names, lines.take(pa.array(two)).flatten()])
        stems = pc.ascii_rtrim(parts, characters=STOPS)
        tail = (pc.binary_length(parts).to_numpy(zero_copy_only=False) - pc.binary_length(stems).to_numpy(zero_copy_only=False)).astype(np.int64)
        good, last = plain_words(stems), last_bytes(parts)
        one = np.flatnonzero(wanted & good[: len(names)])
        halves = len(names) + 2 * np.flatnonzero(good[len(names) :: 2] & good[len(names) + 1 :: 2])
        two = two[(halves - len(names)) >> 1]
        spaced = stems.take(pa.array(np.concatenate([one, halves]))).dictionary_encode()
        bare = stems.take(pa.array(halves + 1)).dictionary_encode()
        words = listed(pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), spaced.dictionary, pa.scalar("", pa.large_string()))) + listed(bare.dictionary)
        numbers = dict(zip(words, range(len(words)), strict=True))
        number = numbers.setdefault
        tail_of = np.array([number(chr(b), len(numbers)) if chr(b) in STOPS else 0 for b in range(256)], np.int64)
        line = number("\n", len(numbers))

        def marks(at: np.ndarray) -> np.ndarray:
            """The numbers of what follows these parts' stems."""
            out = tail_of[last[at]]
            many = np.flatnonzero(tail[at] > 1)
            out[many] = [number(part[-n:], len(numbers)) for part, n in zip(listed(parts.take(pa.array(at[many]))), tail[at[many]].tolist(), strict=True)]
            return out

        spaced, bare = spaced.indices.to_numpy(), bare.indices.to_numpy() + np.int64(len(spaced.dictionary))
        ones = np.stack([spaced[: len(one)], marks(one)], axis=1)
        twos = np.stack([spaced[len(one) :], marks(halves), np.full(len(halves), line), bare, marks(halves + 1)], axis=1)
        has_one = np.stack([np.ones(len(one), bool), tail[one] > 0], axis=1)
        has_two = np.ones(twos.shape, bool)
        has_two[:, 1], has_two[:, 4] = tail[halves] > 0, tail[halves + 1] > 0
        rows = np.concatenate([one, two])
        simple = np.zeros(len(names), bool)
        simple[rows] = True
        spelt = np.concatenate([ones[has_one], twos[has_two]]).astype(np.int64)
        sizes = np.concatenate([has_one.sum(axis=1), has_two.sum(axis=1)])
        # All other pieces, nothing, and the texts' first pieces follow.
        others = np.flatnonzero(wanted & ~simple)
        place = np.full(len(names), len(rows) + len(others), np.int64)
        place[rows], place[others] = np.arange(len(rows)), len(rows) + np.arange(len(others))
        more, more_sizes = [], []
        for piece in listed(names.take(pa.array(others))):
            found = self._piece(piece)
            more.extend([number(w, len(numbers)) for w in found])
            more_sizes.append(len(found))
        more_sizes.append(0)
        codes = np.where(used, place[codes], len(rows) + len(others)) if len(codes) else codes
        for i, head in enumerate(first.to_pylist()):
            codes[heads[i]] = len(rows) + len(more_sizes)
            found = self._whole(texts[i].as_py()) if unsafe[i] else self._part(head, "") if head and not WHITE.search(head) else self._whole(head)
            more.extend([number(w, len(numbers)) for w in found])
            more_sizes.append(len(found))
        values = self.known.values(list(numbers), self._encoded)
        lengths = np.fromiter(map(len, values), np.int64, len(values)) >> 2
        pieces, starts = gather(lengths, np.frombuffer(b"".join(values), np.uint32), np.concatenate([spelt, np.array(more, np.int64)]))
        stops = np.concatenate([[0], np.cumsum(sizes), len(spelt) + np.cumsum(more_sizes)]).astype(np.int64)
        # The end of a text is a piece more.
        lengths = np.append(np.diff(starts[stops]), len(end) >> 2)
        ids, total = gather(lengths, np.concatenate([pieces, np.frombuffer(end, np.uint32)]), np.insert(codes, at[1:], len(lengths) - 1))
        ends = total[at[1:] + np.arange(1, len(texts) + 1)]
        return ids, np.diff(ends, prepend=0)


def gather(lengths: list[int] | np.ndarray, values: np.ndarray, sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of entries side by side: entry i has lengths[i] of ``values``; and where each of ``sequence`` starts in the result, with its end."""
    length = np.asarray(lengths, np.int64)
    start = np.cumsum(length) - length
    n = length[sequence]
    total = np.concatenate(([0], np.cumsum(n)))
    return values[np.repeat(start[sequence] - total[:-1], n) + np.arange(total[-1])], total
