"""Token ids in grammar-compressed shard files (Re-Pair), with random access.

Texts are dealt by ranges of their key, ordered within a range and encoded; each task cuts its ids into shards of
a bounded number of ids. In a shard the most frequent pairs of neighbouring symbols are replaced by new symbols,
round after round (2,560 new symbols each), until a round saves less than a hundredth of the sequence or no pair stands
in 8 places. A file holds the rules, the number of ids each rule stands for,
the remaining sequence and sums of its lengths at intervals, so that any stretch of ids is decoded without the rest.

Files go into the shared folder, each under a name of its own; a table of the shards of tasks that count says which
are valid. Ids are numbered over all shards by sums of the shards' totals, never by moving ids.

Defined results: a null text is encoded like an empty one, to the end id alone; repeated keys keep a row each, in
the order of their texts' checksums; an empty table gives no shard and an empty result. Keys are integers; rows
without a key come first and keep a null key. Other columns are not looked at.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.llm.common import eight, file_system, kept, shared_folder, slim, tidy, with_blocks

MAGIC = b"KWRP0001"
#: Ids of a shard; some 150 MB of working arrays.
SHARD_IDS = 2_000_000
#: New symbols in a round, least count of a pair, and the least share of symbols that a round must save. There is no bound on rounds, on rules in all or on a rule's length.
RULES, LEAST, GAIN = 2560, 8, 0.01
#: Symbols between two stored sums of lengths.
STRIDE = 1024
#: Shards that a task reads, on average; a small one takes a tenth of a second.
READ = 8


# --- ids -------------------------------------------------------------------------------------------------------


#: Characters by which byte-level vocabularies write bytes: printable ones of Latin-1 stand for themselves, the others for the code points from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_WRITTEN = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}


class Apart(Exception):
    """A text isn't words that blanks and line ends part one by one."""


class Pieces(dict):
    """Ids of pieces, as bytes, with ``lead`` in front; found by the library once and remembered: when there are BOUND of them they become the older half, and those of it that are met again come back. Marks after a letter or digit are tokens of their own, so that the piece before them is looked up alone; a piece of letters alone is one word to the pre-tokenizer and goes to the library's model at once."""

    BOUND = 700_000
    #: No apostrophe: some letters after it belong to it.
    MARKS = ".,;:!?)]}\"#*$%&|<>/-"

    def __init__(self, library, kind: np.dtype, lead: str):
        super().__init__()
        self.library, self.model, self.lead, self.older = library, library.model, lead, {}
        self.code = {2: "H", 4: "I"}[kind.itemsize]

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            if piece[:1] == "\n" and piece.split() == [piece[1:]]:  # a line's first piece, after the line's end
                ids = self.line + self.marks[piece[1:]]
                self[piece] = ids
                return ids
            if piece.split() != [piece]:
                raise Apart
            core = piece.rstrip(self.MARKS)
            if core != piece and core and (core[-1].isalpha() or "0" <= core[-1] <= "9"):
                ids = self[core] + self.marks[piece[len(core) :]]
            elif piece.isalpha():
                ids = array(self.code, [t.id for t in self.model.tokenize(_written(self.lead + piece))]).tobytes()
            else:
                ids = array(self.code, self.library.encode(self.lead + piece, add_special_tokens=False).ids).tobytes()
        if len(self) >= self.BOUND:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


def _written(text: str) -> str:
    return text.replace(" ", _WRITTEN[32]) if text.isascii() else text.encode().decode("latin-1").translate(_WRITTEN)


class Words:
    """Ids of the words of many texts at once. A word's fifteen bytes at most, its length and whether it is bare are two numbers, which a table of slots finds without a Python object for each; words are compared by all of their bytes, never by a hash alone. Longer ones, of which there are few, stand in a dict. The library is asked once for a word; when there are BOUND of them, those that were met again stay, at most half."""

    BOUND, SLOT_BITS, LONGEST = 700_000, 21, 15
    #: The second number of a word that stands in no slot.
    _LONG = np.uint64((1 << 64) - 1)

    def __init__(self, made, kind: np.dtype):
        """made: gives the ids of words, by whether no blank is before them, and their number for each, -1 if it isn't a word."""
        self.made, self.kind = made, kind
        self.slots = np.full(1 << self.SLOT_BITS, -1, np.int32)
        self.long: dict[tuple[bytes, bool], int] = {}
        self.size, self.stored = 0, 0
        #: Of each word: its two numbers, where its ids stand, their number (-1: not a word), and whether it was met again.
        self.a, self.b = np.empty(1 << 16, np.uint64), np.empty(1 << 16, np.uint64)
        self.at, self.n, self.used = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int32), np.zeros(1 << 16, bool)
        self.ids = np.empty(1 << 18, kind)

    def _slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (a ^ (b * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
            return (((x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - self.SLOT_BITS)).view(np.int64)

    def _grown(self, name: str, size: int) -> None:
        have = getattr(self, name)
        if size > len(have):
            more = np.zeros(max(size, len(have) * 3 // 2), have.dtype)
            more[: len(have)] = have
            setattr(self, name, more)

    def _add(self, words: list[bytes], bare: list[bool], a, b) -> None:
        size = self.size + len(words)
        for name in ("a", "b", "at", "n", "used"):
            self._grown(name, size)
        new = slice(self.size, size)
        ids, n = self.made(words, bare)
        self.a[new], self.b[new], self.used[new], self.n[new] = a, b, False, n
        ends = np.cumsum(np.maximum(n, 0))
        self.at[new] = self.stored + ends - np.maximum(n, 0)
        self._grown("ids", self.stored + len(ids))
        self.ids[self.stored : self.stored + len(ids)] = ids
        self.stored += len(ids)
        self.size = size

    def _shrink(self) -> None:
        """Forgets words that weren't met again."""
        stay = np.flatnonzero(self.used[: self.size] & (self.b[: self.size] != self._LONG))[: self.BOUND // 2]
        n = np.maximum(self.n[stay], 0)
        ends = np.cumsum(n)
        self.ids = self.ids[np.repeat(self.at[stay] - (ends - n), n) + np.arange(int(n.sum()))]
        self.a, self.b, self.n, self.at = self.a[stay], self.b[stay], self.n[stay], ends - n
        self.used = np.zeros(len(stay), bool)
        self.size, self.stored = len(stay), len(self.ids)
        self.long.clear()
        self.slots.fill(-1)
        left, slot = np.arange(self.size, dtype=np.int32), self._slot(self.a, self.b)
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            lost = self.slots[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & (len(self.slots) - 1)

    def find(self, data: bytes, starts: np.ndarray, ends: np.ndarray, bare: np.ndarray) -> np.ndarray:
        """Numbers of words at places of ``data``, by which ``n``, ``at`` and ``ids`` have their ids until the next call."""
        if self.size > self.BOUND:
            self._shrink()
        before, sizes = self.size, ends - starts
        short = sizes <= self.LONGEST
        some = np.flatnonzero(sizes > 8)
        a, b = eight(data, starts, sizes), (sizes | (bare.astype(np.int64) << 7)).view(np.uint64) << np.uint64(56)
        b[some] |= eight(data, starts[some] + 8, sizes[some] - 8)
        out = np.full(len(starts), -1, np.int32)
        left = np.flatnonzero(short)
        slot = self._slot(a[left], b[left])
        while len(left):
            free = self.slots[slot] < 0
            if free.any():
                # Each free slot goes to one of the words that look there, the others then meet it.
                want, who = slot[free], left[free]
                self.slots[want] = who
                won = self.slots[want] == who
                want, who = want[won], who[won]
                self.slots[want] = self.size + np.arange(len(who))
                self._add([data[x:y] for x, y in zip(starts[who].tolist(), ends[who].tolist(), strict=True)], bare[who].tolist(), a[who], b[who])
            here = self.slots[slot]
            same = (self.a[here] == a[left]) & (self.b[here] == b[left])
            out[left[same]] = here[same]
            left, slot = left[~same], (slot[~same] + 1) & (len(self.slots) - 1)
        some = np.flatnonzero(~short)
        if len(some):
            words = [(data[x:y], z) for x, y, z in zip(starts[some].tolist(), ends[some].tolist(), bare[some].tolist(), strict=True)]
            new = [w for w in dict.fromkeys(words) if w not in self.long]
            self.long.update(zip(new, range(self.size, self.size + len(new)), strict=True))
            self._add([w for w, _ in new], [z for _, z in new], 0, self._LONG)
            out[some] = [self.long[w] for w in words]
        self.used[out[out < before]] = True
        return out


def _flags(chosen: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chosen.encode())] = True
    return out


class Encoder:
    """Ids of texts by a byte-level BPE of the tokenizers library. Its pre-tokenizer never joins what a single blank or line end parts from what stands before it, so that texts are cut there and the pieces' ids put together. The library takes added tokens out of a text first, whatever is beside them; a text that holds one goes to it whole."""

    #: Bytes of texts that are encoded at once.
    CHUNK = 1 << 20
    _cut = re.compile(r"(?<=\S)([ \n])(?=\S)")
    _parts, _marks, _plain = bytes(x in b" \n" for x in range(256)), _flags(Pieces.MARKS), _flags("".join(chr(x) for x in range(128) if chr(x).isalnum()))

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self._added = [t.content for t in library.get_added_tokens_decoder().values()]
        self.library = library
        self.kind = np.dtype("<u2" if library.get_vocab_size() <= 1 << 16 else "<u4")
        self.led, self.bare = Pieces(library, self.kind, " "), Pieces(library, self.kind, "")
        self.led.marks = self.bare.marks = self.bare
        self._line_ids = library.encode("\n", add_special_tokens=False).ids
        self.line = self.led.line = self.bare.line = np.array(self._line_ids, self.kind).tobytes()
        self.words = Words(self._made, self.kind)

    def _lines(self, text: str) -> list[list[str]]:
        parts = self._cut.split(text)
        lines = [[parts[0]]]
        for by, piece in zip(parts[1::2], parts[2::2], strict=True):
            if by == "\n":
                lines.append([piece])
            else:
                lines[-1].append(piece)
        return lines

    def _ids(self, pieces: Pieces, piece: str) -> bytes:
        """Ids of a piece that may hold white space; such a one is the library's alone and isn't remembered."""
        try:
            return pieces[piece]
        except Apart:
            return array(pieces.code, self.library.encode(pieces.lead + piece, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(x in text for x in self._added):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        led, bare = self.led.__getitem__, self.bare
        if "\n\n" not in text and "  " not in text:
            first, *rest = text.replace("\n", " \n").split(" ")
            try:
                return bare[first] + b"".join(map(led, rest))
            except Apart:  # other white space, or some at an end
                pass
        return self.line.join([self._ids(bare, x[0]) + b"".join([self._ids(self.led, y) for y in x[1:]]) for x in self._lines(text)])

    def _made(self, words: list[bytes], bare: list[bool]) -> tuple[list[int], list[int]]:
        """Ids of words and of line ends, one after the other, and their number for each word: -1 where it is empty or holds other white space."""
        ids, n, tokens, whole = [], [], self.led.model.tokenize, self.library.encode
        for word, alone in zip(words, bare, strict=True):
            if word.isalpha():  # of a to z alone
                found = [t.id for t in tokens(word.decode() if alone else _WRITTEN[32] + word.decode())]
            elif (piece := word.decode()).isalpha():
                found = [t.id for t in tokens(_written(piece if alone else " " + piece))]
            elif piece.split() == [piece]:
                found = whole(piece if alone else " " + piece, add_special_tokens=False).ids
            elif piece == "\n":
                found = self._line_ids
            else:
                n.append(-1)
                continue
            ids += found
            n.append(len(found))
        return ids, n

    def many(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each text. Texts of words that single blanks and line ends part are encoded together, the others one by one."""
        out: list[bytes] = []
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end] or b"") <= self.CHUNK):
                size += len(texts[end] or b"")
                end += 1
            held = [t or b"" for t in texts[start:end]]
            found = self._together(held) if size <= self.CHUNK else [None]
            out += [self(t.decode()) if x is None else x for t, x in zip(held, found, strict=True)]
            start = end
        return out

    def _together(self, texts: list[bytes]) -> list[bytes | None]:
        data = b"".join((b"\n", b"\n".join(texts), b"\n", bytes(16)))
        codes = np.frombuffer(data, np.uint8)
        by = np.flatnonzero(np.frombuffer(data[:-16].translate(self._parts), bool))
        starts, ends = by[:-1] + 1, by[1:]
        first = np.searchsorted(starts, np.cumsum([1, *[len(t) + 1 for t in texts[:-1]]]))  # of each text's pieces
        # Marks after a letter or digit are words of their own. Of pieces with more than 16 of them, and where another byte is before them, nothing is parted.
        core, left = ends.copy(), np.flatnonzero(self._marks[codes[ends - 1]])
        for _ in range(16):
            core[left] -= 1
            left = left[self._marks[codes[core[left] - 1]]]
            if not len(left):
                break
        core[left] = starts[left]
        core = np.where((core > starts) & self._plain[codes[core - 1]], core, ends)
        line = codes[starts - 1] == 10
        line[first] = False  # before a text's first piece stands nothing
        bare, marked = line.copy(), core < ends
        bare[first] = True
        count = 1 + line.astype(np.int64) + marked
        begin = np.cumsum(count) - count
        place = begin + line
        n = int(count.sum())
        lows, highs, alone = np.empty(n, np.int64), np.empty(n, np.int64), np.ones(n, bool)
        lows[place], highs[place], alone[place] = starts, core, bare
        lows[begin[line]], highs[begin[line]] = starts[line] - 1, starts[line]
        lows[place[marked] + 1], highs[place[marked] + 1] = core[marked], ends[marked]
        words = self.words
        found = words.find(data, lows, highs, alone)
        n = words.n[found]
        apart = np.logical_or.reduceat(n < 0, begin[first])
        n = np.maximum(n, 0)
        sums = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))
        ids = words.ids[np.repeat(words.at[found] - sums[:-1], n) + np.arange(sums[-1])].tobytes()
        bounds = (sums[np.append(begin[first], len(lows))] * self.kind.itemsize).tolist()
        added = [x.encode() for x in self._added if x.encode() in data]
        return [None if z or any(x in t for x in added) else ids[x:y] for x, y, z, t in zip(bounds[:-1], bounds[1:], apart.tolist(), texts, strict=True)]


# --- grammar ---------------------------------------------------------------------------------------------------


def _frequent(keys: np.ndarray, bucket: np.ndarray, rules: int, least: int) -> tuple:
    """(keys at places, the places, the keys in order, starts of equal ones, their counts, a count): all pairs with that count or more stand in them, and those are ``rules`` pairs or all with the least count. A pair stands no more often than its bucket, so that only places of full buckets are ordered."""
    held = np.bincount(bucket, minlength=1 << 20)
    fuller = np.cumsum(np.bincount(held)[::-1])[::-1]  # buckets that hold so many or more
    wanted = 2 * rules
    while True:
        limit = max(least, int(np.searchsorted(-fuller, -wanted, "right")) - 1)
        at = np.flatnonzero((held >= limit)[bucket])
        some = keys[at]
        ordered = np.sort(some)
        heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(at) else at
        count = np.diff(np.append(heads, len(ordered)))
        if limit == least or np.count_nonzero(count >= limit) >= rules:
            return some, at, ordered, heads, count, limit
        wanted *= 2


def compress(ids: np.ndarray, rules: int = RULES, least: int = LEAST, gain: float = GAIN) -> tuple[np.ndarray, np.ndarray, list[int], int]:
    """(sequence, pairs, first symbol of each round, first new symbol). Within a round a place where several chosen pairs overlap goes to the more frequent, and of equal ones to the first."""
    base = int(ids.max()) + 1 if len(ids) else 1
    sequence, pairs, starts, top = ids.astype(np.uint32), [], [], base
    while len(sequence) >= 2 * least:
        keys = sequence[:-1].astype(np.uint64)
        keys <<= np.uint64(32)
        keys |= sequence[1:]
        with np.errstate(over="ignore"):
            bucket = keys * np.uint64(0x9E3779B97F4A7C15)
        bucket >>= np.uint64(44)
        bucket = bucket.view(np.int64)
        some, at, ordered, heads, count, limit = _frequent(keys, bucket, rules, least)
        good = np.flatnonzero(count >= limit)
        if not len(good):
            break
        with np.errstate(over="ignore"):
            tie = ordered[heads[good]] * np.uint64(0xD6E8FEB86659FD93)
        best = good[np.lexsort((tie, -count[good]))[:rules]]  # equal counts in no order, so that chains of neighbours don't form
        chosen = ordered[heads[best]]  # from the most frequent pair to the least
        # Of chosen pairs that share a bucket, the most frequent is looked up; another one waits for the next round.
        with np.errstate(over="ignore"):
            slot = ((chosen * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        rank_of = np.full(1 << 20, -1, np.int32)
        rank_of[slot[::-1]] = np.arange(len(chosen) - 1, -1, -1)
        rank = rank_of[bucket[at]]
        found = (rank >= 0) & (chosen[rank] == some)
        ranks = np.full(len(keys) + 2, rules, np.int32)
        at = at[found]
        ranks[at + 1] = rank[found]
        takes = []
        for _ in range(3):  # places that the first choice left free are chosen among again
            here, left = ranks[at + 1], ranks[at]
            good = (here <= left) & (here <= ranks[at + 2])
            # In a run of one symbol every second place is taken: not those at an odd distance from the run's first.
            again = np.flatnonzero(here == left)
            if len(again):
                first = np.maximum.accumulate(np.where(np.concatenate(([True], np.diff(at[again]) != 1)), np.arange(len(again)), 0))
                good[again[(np.arange(len(again)) - first) & 1 == 0]] = False
            if not good.any():
                break
            some = at[good]
            takes.append((some, here[good]))
            for k in (0, 1, 2):
                ranks[some + k] = rules
            at = at[ranks[at + 1] < rules]
        take, here = (np.concatenate(x) for x in zip(*takes, strict=True))
        order = np.argsort(take)
        take, here = take[order], here[order]
        used = np.bincount(here, minlength=len(best))
        number = np.full(len(best), -1, np.int64)
        good = np.flatnonzero(used >= 3)
        number[good] = top + np.arange(len(good))
        symbol = number[here]
        take, symbol = take[symbol >= 0], symbol[symbol >= 0]
        if len(take) < gain * len(sequence):
            break
        pair = chosen[good]
        pairs.append(np.stack([(pair >> np.uint64(32)).astype(np.uint32), (pair & np.uint64(0xFFFFFFFF)).astype(np.uint32)], 1))
        starts.append(top)
        top += len(good)
        sequence[take] = symbol
        stay = np.ones(len(sequence), bool)
        stay[take + 1] = False
        sequence = sequence[stay]
    return sequence, np.concatenate(pairs) if pairs else np.empty((0, 2), np.uint32), starts, base


def expand(sequence: np.ndarray, pairs: np.ndarray, starts: list[int], base: int) -> np.ndarray:
    """The ids of a sequence: rounds are undone from the last to the first."""
    for start in reversed(starts):
        new = sequence >= start
        at = np.flatnonzero(new)
        if not len(at):
            continue
        places = at + np.arange(len(at))
        out = np.repeat(sequence, np.where(new, 2, 1))
        pair = pairs[sequence[at] - base]
        out[places], out[places + 1] = pair[:, 0], pair[:, 1]
        sequence = out
    return sequence


def lengths(pairs: np.ndarray, starts: list[int], base: int) -> np.ndarray:
    """How many ids each rule stands for."""
    out = np.ones(len(pairs), np.int64)
    for start, end in zip(starts, [*starts[1:], base + len(pairs)][: len(starts)], strict=True):
        both = pairs[start - base : end - base].astype(np.int64)
        out[start - base : end - base] = np.where(both >= base, out[np.maximum(both - base, 0)], 1).sum(1)
    return out


def _split(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower two bytes of symbols, and each bit above them that some symbol needs as a plane of bits."""
    flat = symbols.reshape(-1).astype(np.uint32)
    high = flat >> 16
    planes = [np.packbits((high >> k) & 1 == 1) for k in range(int(high.max(initial=0)).bit_length())]
    return (flat & 0xFFFF).astype("<u2"), np.concatenate(planes) if planes else np.empty(0, np.uint8)


def _joined(low: np.ndarray, planes: np.ndarray) -> np.ndarray:
    out = low.astype(np.uint32)
    for k, plane in enumerate(planes.reshape(-1, -(-len(low) // 8)) if len(planes) else ()):
        out |= np.unpackbits(plane, count=len(low)).astype(np.uint32) << np.uint32(16 + k)
    return out


class Shard:
    """A file's content. ``ids(start, n)`` decodes a stretch of ids and touches no symbol outside of it but those of its first interval."""

    def __init__(self, keys, ends, sequence, pairs, rule_lengths, sums, starts, base, valid=None):
        self.valid = np.ones(len(keys), bool) if valid is None else valid  # whether a document has a key
        self.keys, self.ends, self.sequence, self.pairs, self.rule_lengths, self.sums, self.starts, self.base = keys, ends, sequence, pairs, rule_lengths, sums, starts, base

    @classmethod
    def of(cls, keys: np.ndarray, ends: np.ndarray, ids: np.ndarray, valid: np.ndarray | None = None, **options) -> Shard:
        sequence, pairs, starts, base = compress(ids, **options)
        shard = cls(keys, ends, sequence, pairs, lengths(pairs, starts, base), None, starts, base, valid)
        shard.sums = np.concatenate(([0], np.cumsum(shard._symbol_lengths(sequence))))[::STRIDE].astype(np.int64)
        return shard

    def _symbol_lengths(self, symbols: np.ndarray) -> np.ndarray:
        at = symbols.astype(np.int64) - self.base
        return np.where(at >= 0, self.rule_lengths[np.maximum(at, 0)] if len(self.rule_lengths) else 1, 1)

    def all_ids(self) -> np.ndarray:
        """All ids; rules are undone once, and each symbol's ids then taken from there. Where that would be longer than the ids themselves, the sequence is undone round by round."""
        total = int(self.ends[-1]) if len(self.ends) else 0
        if int(self.rule_lengths.sum()) > total:
            return expand(self.sequence, self.pairs, self.starts, self.base)
        rules = expand(np.arange(self.base, self.base + len(self.pairs), dtype=np.uint32), self.pairs, self.starts, self.base)
        n = np.concatenate((np.ones(self.base, np.int64), self.rule_lengths))
        at, n = (np.cumsum(n) - n)[self.sequence], n[self.sequence]
        places = np.repeat(at - (np.cumsum(n) - n), n)
        places += np.arange(len(places))
        return np.concatenate((np.arange(self.base, dtype=np.uint32), rules))[places]

    def ids(self, start: int, n: int) -> np.ndarray:
        if n <= 0:
            return np.empty(0, np.uint32)
        interval = int(np.searchsorted(self.sums, start, "right")) - 1
        last = int(np.searchsorted(self.sums, start + n, "left"))
        symbols = self.sequence[interval * STRIDE : last * STRIDE]
        ends = self.sums[interval] + np.cumsum(self._symbol_lengths(symbols))
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, start + n, "left"))
        first = int(ends[a - 1]) if a else int(self.sums[interval])
        return expand(symbols[a : b + 1], self.pairs, self.starts, self.base)[start - first : start - first + n]

    def document(self, i: int) -> np.ndarray:
        start = int(self.ends[i - 1]) if i else 0
        return self.ids(start, int(self.ends[i]) - start)

    def to_bytes(self) -> bytes:
        (pairs, pairs_high), (sequence, sequence_high) = _split(self.pairs), _split(self.sequence)
        parts = [("keys", self.keys, "<i8"), ("valid", np.packbits(self.valid), "u1"), ("ends", self.ends, "<i8"), ("pairs", pairs, "<u2"), ("pairs_high", pairs_high, "u1"), ("rule_lengths", self.rule_lengths, np.min_scalar_type(int(self.rule_lengths.max(initial=0))).str), ("sums", self.sums, "<i8"), ("sequence", sequence, "<u2"), ("sequence_high", sequence_high, "u1")]
        blobs = [np.ascontiguousarray(x, kind).tobytes() for _, x, kind in parts]
        head = json.dumps({"base": self.base, "starts": self.starts, "parts": [[name, kind, len(b)] for (name, _, kind), b in zip(parts, blobs, strict=True)]}).encode()
        body = struct.pack("<I", len(head)) + head + b"".join(blobs)
        return MAGIC + body + struct.pack("<I", zlib.crc32(body))

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        if data[:8] != MAGIC or zlib.crc32(memoryview(data)[8:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("not a shard file, or a damaged one")
        (size,) = struct.unpack("<I", data[8:12])
        head, at, found = json.loads(data[12 : 12 + size]), 12 + size, {}
        for name, kind, n in head["parts"]:
            found[name] = np.frombuffer(data, kind, n // np.dtype(kind).itemsize, at)
            at += n
        return cls(found["keys"], found["ends"], _joined(found["sequence"], found["sequence_high"]), _joined(found["pairs"], found["pairs_high"]).reshape(-1, 2), found["rule_lengths"].astype(np.int64), found["sums"], head["starts"], head["base"], np.unpackbits(found["valid"], count=len(found["keys"])).astype(bool))


# --- tables ----------------------------------------------------------------------------------------------------

_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 0, folder: str | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes all texts' ids in ascending order of the key; returns the table of shards: part, number, shard (address), n_docs, n_ids, n_bytes, start (ids of all shards before)."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, (system, root) = _encoder(tokenizer), file_system(folder)
        system.create_dir(root, recursive=True)
        part, end = TaskContext.get().partitionId(), np.array([end_id], encoder.kind).tobytes()
        keys, ids, size, done = [], [], 0, []

        def flush():
            nonlocal keys, ids, size
            counts = np.array([len(x) for x in ids], np.int64) // encoder.kind.itemsize
            shard = Shard.of(np.array([k or 0 for k in keys], np.int64), np.cumsum(counts), np.frombuffer(b"".join(ids), encoder.kind), np.array([k is not None for k in keys]))
            ids, data = [], shard.to_bytes()
            address = f"{folder}/{uuid.uuid4().hex}.ids"
            path = f"{root}/{address.rsplit('/', 1)[1]}"
            with system.open_output_stream(path + ".part", compression=None) as out:
                out.write(data)
            system.move(path + ".part", path)
            done.append((part, len(done), address, len(keys), int(counts.sum()), len(data)))
            keys, size = [], 0

        for batch in slim(batches):
            for k, x in zip(batch.column(0).to_pylist(), encoder.many(batch.column(1).cast(pa.binary()).to_pylist()), strict=True):
                keys.append(k)
                ids.append(x + end)
                size += len(ids[-1]) // encoder.kind.itemsize
                if size >= shard_ids:
                    flush()
        if keys:
            flush()
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(kinds)], names=["part", "number", "shard", "n_docs", "n_ids", "n_bytes"])

    columns = [F.col(key).cast("bigint").alias("_k"), F.col(text).alias("_t"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("_c")]
    # Rows that are equal in all are parted by their place in the files, so that no range has to hold them together.
    rows = with_blocks(docs, columns, row_id="_r").select("_k", "_t", "_c", "_r")
    rows = rows.repartitionByRange("_k", "_c", "_r").sortWithinPartitions("_k", "_c", "_r").select("_k", "_t")
    shards = kept(rows.mapInArrow(tidy(run), "part int, number int, shard string, n_docs bigint, n_ids bigint, n_bytes bigint"), "shards")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("_n")).select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    started = shards.withColumn("_within", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(parts, "part")
    return started.select("part", "number", "shard", "n_docs", "n_ids", "n_bytes", (F.col("_before") + F.col("_within")).alias("start"))


def read(spark: SparkSession, shards: DataFrame, key: str = "doc_id", ids: bool = True) -> DataFrame:
    """A row for each document of the table of shards: key, start, n_tokens, ids_crc32 and, where asked for, its ids."""
    fields = [(key, pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int32()))] if ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for address, start, told in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, path = file_system(address)
                with system.open_input_stream(path, compression=None) as source:
                    shard = Shard.from_bytes(source.read())
                every = shard.all_ids().astype("<u4")
                if len(every) != told:
                    raise ValueError(f"{address}: {len(every)} ids, not {told}")
                starts = np.concatenate(([0], shard.ends[:-1]))
                data = memoryview(every).cast("B")
                sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), shard.ends.tolist(), strict=True)]
                columns = [pa.array(shard.keys, mask=~shard.valid), pa.array(starts + start), pa.array(shard.ends - starts), pa.array(sums, pa.int64())]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate((starts[:1], shard.ends)).astype(np.int32)), pa.array(every.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=[n for n, _ in fields])

    n = shards.count()
    listed = shards.select("shard", "start", "n_ids").repartition(max(1, min(10_000, n, max(spark.sparkContext.defaultParallelism, -(-n // READ)))), "shard")
    return listed.mapInArrow(tidy(run), f"`{key}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * ids)
