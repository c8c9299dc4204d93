"""SentencePiece (BPE) encoding and decoding by vectorised merge rounds.

A text becomes a dummy prefix and its words with spaces as U+2581. No piece holds U+2581 after another character, nor a
character that isn't in the vocabulary, so a text falls into chunks that no merge crosses: runs of U+2581 with what
follows them, cut at line breaks. The distinct chunks of a block lie in one flat array of symbols. Each round finds the
pair of least rank in every chunk (a segmented minimum), merges its occurrences from the left, and closes the gaps, until
no chunk has a pair. Symbols that are in no piece become byte pieces.

The library merges the best pair again and again, the leftmost first. A round may merge all occurrences of a pair at once
only if no pair that a merge makes is better than the one at hand; PieceTable marks the pieces for which that doesn't
hold, and of their pairs a round merges the leftmost alone.

Null and empty texts have no ids, and decode to an empty text. Rows are encoded one by one: repeated rows, null ids and
an empty table are nothing special.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .runtime import map_text

SPACE = "▁"
CHUNK = re.compile(f"\n[^{SPACE}\n]*|{SPACE}+[^{SPACE}\n]*")
#: Distinct chunks that a Python worker remembers as recent, and as many again that were before those.
REMEMBER = 100_000
NONE = np.int64(1 << 40)


class PieceTable:
    """The vocabulary as arrays: ranks of pairs, the bytes of every piece, the byte pieces."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        lib = SentencePieceProcessor(model_file=model_file)
        n = lib.get_piece_size()
        pieces = [lib.id_to_piece(i) for i in range(n)]
        self.control = {i for i in range(n) if lib.is_control(i)}
        self.unknown = lib.unk_id()
        byte = {i: int(pieces[i][3:5], 16) for i in range(n) if lib.is_byte(i)}
        normal = {p: i for i, p in enumerate(pieces) if i not in self.control and i not in byte and i != self.unknown}
        self.of_byte = np.full(256, self.unknown, np.int64)
        for i, b in byte.items():
            self.of_byte[b] = i
        self.byte_fallback = len(byte) == 256
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in normal):
            raise ValueError("pieces that cross words or lines aren't supported")
        # The order of merges: a higher score first; equal scores are one rank.
        scores = {i: lib.get_score(i) for i in normal.values()}
        rank_of = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        rank = {p: rank_of[scores[i]] for p, i in normal.items()}
        keys, merged, ranks, alone = [], [], [], set()
        for p, i in normal.items():
            for cut in range(1, len(p)):
                a, b = p[:cut], p[cut:]
                if a in normal and b in normal:
                    keys.append(normal[a] * n + normal[b])
                    merged.append(i)
                    ranks.append(rank[p])
                    alone.update(normal[x] for x in (a, b) if len(x) > 1 and rank[x] >= rank[p])
        self.n = n
        self._index(np.array(keys, np.int64), np.array(merged, np.int64), np.array(ranks, np.int64))
        self.alone = np.zeros(n + 1, bool)
        self.alone[list(alone)] = True
        self.of_char = -1 - np.arange(0x110000)  # what is in no piece: -1 - code point
        for p, i in normal.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.bytes = [bytes([byte[i]]) if i in byte else b"" if i in self.control else b" \xe2\x81\x87 " if i == self.unknown else pieces[i].replace(SPACE, " ").encode() for i in range(n)]
        self.surface, self.decimal = Strings(self.bytes), Strings([b"%d," % i for i in range(n)])

    def _index(self, keys: np.ndarray, merged: np.ndarray, ranks: np.ndarray) -> None:
        """An open-addressed table of the pairs: about a fifth of its slots are in use."""
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.slots, self.merged, self.ranks = np.full(1 << self.bits, -1), np.full(1 << self.bits, -1), np.full(1 << self.bits, NONE)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.slots[at] == -1
            chosen, winner = np.unique(at[free], return_index=True)
            put = left[np.flatnonzero(free)[winner]]
            self.slots[chosen], self.merged[chosen], self.ranks[chosen] = keys[put], merged[put], ranks[put]
            rest = self.slots[at] != keys[left]
            left, at = left[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if there is no such piece) and merged piece of each pair; a negative symbol is in no piece."""
        key = np.where((left >= 0) & (right >= 0), left * self.n + right, -2)
        at = self._slot(key)
        got = self.slots[at]
        look = np.flatnonzero((got != key) & (got != -1))
        while len(look):
            at[look] = (at[look] + 1) & ((1 << self.bits) - 1)
            got = self.slots[at[look]]
            look = look[(got != key[look]) & (got != -1)]
        found = self.slots[at] == key
        return np.where(found, self.ranks[at], NONE), np.where(found, self.merged[at], -1)

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks (none of them empty), and where each chunk's begin and end.

        Symbols are piece ids, or -1 - code point for what is in no piece.
        """
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        symbol = self.of_char[np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)]
        word = np.repeat(np.arange(len(chunks)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, merged = self.pairs(symbol, np.append(symbol[1:], -1))
        rank[np.append(word[1:] != word[:-1], True)] = NONE
        while len(symbol):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(first, len(word)))
            best = np.repeat(np.minimum.reduceat(rank, first), size)
            live = best != NONE
            if not live.all():
                done.append((word[~live], symbol[~live]))
                symbol, word, rank, best, merged = symbol[live], word[live], rank[live], best[live], merged[live]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == best)
            at = at[self._leftmost(at, word[at], merged[at])]
            symbol[at] = merged[at]
            stay = np.ones(len(symbol), bool)
            stay[at + 1] = False
            at = (np.cumsum(stay) - 1)[at]
            symbol, word, rank, merged = symbol[stay], word[stay], rank[stay], merged[stay]
            # Only the pairs that a merge touches have changed.
            touched = np.zeros(len(symbol), bool)
            touched[at] = touched[at[at > 0] - 1] = True
            left = np.flatnonzero(touched)
            right = np.minimum(left + 1, len(symbol) - 1)
            new_rank, merged[left] = self.pairs(symbol[left], symbol[right])
            rank[left] = np.where((right == left) | (word[left] != word[right]), NONE, new_rank)
        words = np.concatenate([w for w, _ in done]) if done else np.zeros(0, np.int64)
        symbols = np.concatenate([s for _, s in done]) if done else words
        order = np.argsort(words, kind="stable")
        symbols, words = symbols[order], words[order]
        if (symbols < 0).any():
            spelt = [self._fallback(-1 - x) for x in symbols[symbols < 0].tolist()]
            times = np.ones(len(symbols), np.int64)
            times[symbols < 0] = list(map(len, spelt))
            odd = np.repeat(symbols < 0, times)
            symbols, words = np.repeat(symbols, times), np.repeat(words, times)
            symbols[odd] = [x for ids in spelt for x in ids]
        return symbols, np.searchsorted(words, np.arange(len(chunks) + 1))

    def _leftmost(self, at: np.ndarray, word: np.ndarray, merged: np.ndarray) -> np.ndarray:
        """Which of the matches (positions at, rising) this round merges: every other one of a run that overlaps, and
        only the first of a word where the round may merge just one; words may have several pieces of equal rank."""
        new = np.append(True, (at[1:] != at[:-1] + 1) | (word[1:] != word[:-1]))
        starts = np.flatnonzero(new)
        within = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
        take = within % 2 == 0
        head = np.append(True, word[1:] != word[:-1])
        heads = np.flatnonzero(head)
        sizes = np.diff(np.append(heads, len(at)))
        single = np.logical_or.reduceat(self.alone[merged], heads) | (np.minimum.reduceat(merged, heads) != np.maximum.reduceat(merged, heads))
        return take & (head | ~np.repeat(single, sizes))

    def _fallback(self, code: int) -> tuple[int, ...]:
        return tuple(self.of_byte[list(chr(code).encode("utf-8", "surrogatepass"))].tolist()) if self.byte_fallback else (self.unknown,)

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids, with the space that the dummy prefix left in front."""
        return b"".join(map(self.bytes.__getitem__, ids))


class Strings:
    """Byte strings in one array, to put many sequences of them together at once."""

    def __init__(self, strings: list[bytes]):
        self.flat, self.size = np.frombuffer(b"".join(strings), np.uint8), np.array(list(map(len, strings)), np.int64)
        self.start = np.cumsum(self.size) - self.size

    def cut(self, ids: np.ndarray, bounds: np.ndarray, kind: type) -> list:
        """For each pair of neighbours in bounds the strings of the ids between them, joined."""
        size = self.size[ids]
        ends = np.append(0, np.cumsum(size))
        joined = self.flat[np.repeat(self.start[ids] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        at = ends[bounds].tolist()
        joined = joined.decode("ascii") if kind is str else joined
        return [joined[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


class Codec:
    """Encodes texts through the chunks it remembers; a chunk is held as its ids and what they decode to.

    recent fills up to REMEMBER chunks and then becomes older, from which a chunk that comes again moves back; so what is
    remembered has a bound, and frequent chunks stay.
    """

    def __init__(self, model_file: str):
        self.table = PieceTable(model_file)
        self.recent: dict[str, tuple[str, bytes]] = {}
        self.older: dict[str, tuple[str, bytes]] = {}

    def chunks(self, text: str) -> list[str]:
        """The keys of a text's chunks: one that a line break begins is its own key; of others the first U+2581 is left out."""
        if not text:
            return []
        if "  " not in text and SPACE not in text and text[0] != " ":
            return text.replace("\n", " \n").split(" ")
        return [x[1:] if x[0] == SPACE else x for x in CHUNK.findall(SPACE + text.replace(" ", SPACE))]

    def encode(self, texts: list[str]) -> list[list[tuple[str, bytes]]]:
        """For each text its chunks as (ids with a comma after each, decoded bytes)."""
        cut = list(map(self.chunks, texts))
        if len(self.recent) > REMEMBER:
            self.older, self.recent = self.recent, {}
        recent, older = self.recent, self.older
        fresh = []
        for key in set().union(*cut).difference(recent):
            if (known := older.get(key)) is not None:
                recent[key] = known
            else:
                fresh.append(key)
        for start in range(0, len(fresh), 50_000):
            part = fresh[start : start + 50_000]
            ids, bounds = self.table.encode_chunks([x if x[:1] == "\n" else SPACE + x for x in part])
            recent.update(zip(part, zip(self.table.decimal.cut(ids, bounds, str), self.table.surface.cut(ids, bounds, bytes), strict=True), strict=True))
        return [list(map(recent.__getitem__, keys)) for keys in cut]


#: What encode_documents can return, by name.
OUTPUTS = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}


def encode_documents(docs: DataFrame, model_file: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), outputs: tuple[str, ...] = ("n_tokens", "ids")) -> DataFrame:
    """keep columns, and of each whole text the outputs named: its ids, their number, what the ids decode to, digests."""
    made = T.StructType([T.StructField(c, OUTPUTS[c]) for c in outputs])

    def work():
        codec = Codec(model_file)

        def block(texts: list[bytes | None]) -> dict:
            got: dict[str, list] = {c: [] for c in outputs}
            for parts in codec.encode([(x or b"").decode("utf-8", "replace") for x in texts]):
                ids = "".join([p[0] for p in parts])[:-1]
                if "decoded" in got or "decoded_sha256" in got:
                    decoded = b"".join([p[1] for p in parts]).removeprefix(b" ").decode("utf-8", "replace")
                for c in outputs:
                    if c == "n_tokens":
                        got[c].append(ids.count(",") + 1 if ids else 0)
                    elif c == "ids":
                        got[c].append(np.array(ids.split(",") if ids else [], np.int32))
                    elif c == "decoded":
                        got[c].append(decoded)
                    else:
                        got[c].append(hashlib.sha256((ids if c == "ids_sha256" else decoded).encode()).hexdigest())
            return got

        return block

    return map_text(docs, text, list(keep), made, work)


def decode_ids(table: PieceTable, ids: list[int]) -> str:
    """What the library's decode(ids) gives for the ids of a text: the dummy prefix goes."""
    return table.decode(ids).removeprefix(b" ").decode("utf-8", "replace")
