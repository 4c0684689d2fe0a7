"""BPE with word ends: a streaming encoder of bounded lookahead and an incremental decoder.

Both work from a public vocabulary file in the tokenizers library's JSON form, whose path is a parameter.
"""

from __future__ import annotations

import codecs
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pastframe.llm.common import with_text_columns
from pastframe.llm.unicode_tables import ADDED_IN_16, LOWER_SINCE_16, MARKS_SINCE_10, as_set

#: Words up to this length are looked up whole; longer ones go through the transducer piece by piece.
SHORT = 48
CHUNK = 1 << 16


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else the next one from U+0100."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Ids, merge ranks and the lookahead that makes a prefix of the tokens final."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.end: str = model.get("end_of_word_suffix") or ""
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): r for r, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.pieces = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.symbols = byte_symbols()
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int | None:
        """How many symbols at the end of a prefix further text can change; None if the merge list allows no bound.

        The tokens of a prefix and of the whole text first differ at the prefix's end. The difference moves left only by
        a merge whose right part was at stake, that is, has the left part of the merge before it on its left edge, and
        only in the order of ranks. So the bound is the heaviest chain of merges of rising rank, each weighing the
        length of its left part. It holds if every part is made before the merge that uses it.
        """
        made = {a + b: (a, b) for a, b in self.ranks}
        rank = {a + b: r for (a, b), r in self.ranks.items()}
        if len(made) != len(self.ranks) or any(rank.get(x, -1) >= r for (a, b), r in self.ranks.items() for x in (a, b)):
            return None
        size = lambda s: len(s) - (len(self.end) if self.end and s.endswith(self.end) else 0)
        best: dict[str, int] = {}
        most = 0
        for a, b in self.ranks:  # in the order of rank
            reach, y = 0, b
            while True:
                reach = max(reach, best.get(y, 0))
                if y not in made:
                    break
                y = made[y][0]
            best[a] = max(best.get(a, 0), size(a) + reach)
            most = max(most, best[a])
        return most

    def merge(self, symbols: list[str]) -> list[str]:
        """Merge the pair of lowest rank, leftmost first, until none is left."""
        n = len(symbols)
        if n <= SHORT:
            return self._merge_short(list(symbols))
        sym, after, before = list(symbols), [*range(1, n), -1], [*range(-1, n - 1)]
        ranks = self.ranks
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get((sym[i], sym[i + 1]))) is not None]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            j = after[i] if sym[i] else -1
            if j < 0 or ranks.get((sym[i], sym[j])) != r:
                continue
            sym[i] += sym[j]
            sym[j] = ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if (q := ranks.get((sym[i], sym[after[i]]))) is not None:
                    heappush(heap, (q, i))
            if before[i] >= 0 and (q := ranks.get((sym[before[i]], sym[i]))) is not None:
                heappush(heap, (q, before[i]))
        return [s for s in sym if s]

    def _merge_short(self, sym: list[str]) -> list[str]:
        """The same by scanning, which is quicker for a few symbols."""
        rank, none = self.ranks.get, len(self.ranks)
        open_ = [rank(p, none) for p in zip(sym, sym[1:], strict=False)]
        while open_:
            r = min(open_)
            if r == none:
                break
            i = open_.index(r)
            sym[i : i + 2] = [sym[i] + sym[i + 1]]
            del open_[i]
            if i:
                open_[i - 1] = rank((sym[i - 1], sym[i]), none)
            if i < len(open_):
                open_[i] = rank((sym[i], sym[i + 1]), none)
        return sym


class Transducer:
    """Encodes one word fed in pieces; tokens come out once no further input can change them."""

    def __init__(self, vocab: Vocabulary):
        self.v, self.held = vocab, []
        longest = max(map(len, vocab.ids))
        self.room = None if vocab.lookahead is None else 2 * (vocab.lookahead + longest)

    def feed(self, symbols: Iterable[str]) -> Iterator[str]:
        """More symbols of the word, none of them its last. Holds a constant number of symbols."""
        for s in symbols:
            self.held.append(s)
            if self.room and len(self.held) >= 2 * self.room:
                yield from self._settle()

    def finish(self) -> Iterator[str]:
        """The word ends with what was fed."""
        if self.held:
            self.held[-1] += self.v.end
            yield from self.v.merge(self.held)
            self.held = []

    def _settle(self) -> Iterator[str]:
        final, at = len(self.held) - 1 - self.v.lookahead, 0  # the last symbol may yet take the word's end
        for token in self.v.merge(self.held[:-1]):
            if at + len(token) > final:
                break
            at += len(token)
            yield token
        del self.held[:at]


#: Contractions, letters, single digits, other signs.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


def late_code_points() -> str:
    """Letters and digits of the regex module that unicodedata does not know yet and that are signs to the library, as a set's inside."""
    known = regex.compile(r"[\p{L}\p{N}]")
    kept = {c for a, b in ADDED_IN_16 for c in range(a, b + 1)}
    new = [c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn" and c not in kept and known.match(chr(c))]
    starts = [c for c, b in zip(new, [-2, *new], strict=False) if c != b + 1]
    ends = [c for c, b in zip(new, [*new[1:], -2], strict=False) if c + 1 != b]
    return as_set(zip(starts, ends, strict=True))


class Encoder:
    """Whole texts to ids: special tokens, NFC, lower case, words, merges; each step over bounded pieces."""

    def __init__(self, vocab: Vocabulary, most_cached: int = 300_000):
        self.v, self.cache, self.most = vocab, {}, most_cached
        self.word = regex.compile(WORD)
        late = late_code_points() or "\\U0010ffff"  # those are signs; texts that hold one take the slower pattern
        self.late = re.compile(f"[{late}{''.join(map(chr, LOWER_SINCE_16))}]")
        self.inert = re.compile(f"([{as_set(MARKS_SINCE_10)}])")
        self.late_word = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{late}]]+|[\p{{N}}--[{late}]]|(?:[^\s\p{{L}}\p{{N}}]|[{late}])+", regex.V1)
        self.breaks = regex.compile(r"[ \n\t\r]")
        self.marks = regex.compile("|".join(map(regex.escape, sorted(vocab.special, key=len, reverse=True)))) if vocab.special else None

    def pieces(self, text: str) -> Iterator[str]:
        """The text cut behind white space, where neither normal form nor words reach across."""
        begin = 0
        while len(text) - begin > CHUNK:
            m = self.breaks.search(text, begin + CHUNK)
            if not m:
                break
            yield text[begin : m.end()]
            begin = m.end()
        yield text[begin:]

    def _word(self, word: str) -> list[int]:
        ids = self.v.ids
        raw = [self.v.symbols[b] for b in word.encode("utf-8", "replace")]
        if len(word) <= SHORT:
            raw[-1] += self.v.end
            return [ids[s] for s in self.v.merge(raw) if s in ids]
        t = Transducer(self.v)
        return [ids[s] for s in (*t.feed(raw), *t.finish()) if s in ids]

    def _composed(self, piece: str) -> str:
        """The piece in NFC; marks that the library's tables lack stand by themselves, the parts between them are normalised."""
        return "".join(x if i % 2 else unicodedata.normalize("NFC", x) for i, x in enumerate(self.inert.split(piece)))

    def _plain(self, text: str, out: list[int]) -> None:
        cache = self.cache
        for piece in self.pieces(text):
            word = self.word
            if not piece.isascii():
                piece = self._composed(piece).replace("Σ", "σ")  # lower case goes by code point: no final sigma
                if self.late.search(piece):
                    word, piece = self.late_word, piece.translate(LOWER_SINCE_16)
            for w in word.findall(piece.lower()):
                got = cache.get(w)
                if got is None:
                    got = self._word(w)
                    if len(w) <= SHORT:
                        if len(cache) >= self.most:
                            cache.clear()
                        cache[w] = got
                out += got

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        begin = 0
        for m in self.marks.finditer(text) if self.marks else ():
            self._plain(text[begin : m.start()], out)
            out.append(self.v.special[m[0]])
            begin = m.end()
        self._plain(text[begin:] if begin else text, out)
        return out


class Decoder:
    """Ids to text, one at a time: bytes in, text out as soon as it is whole; the state is at most one character.

    joined=True gives the vocabulary's pieces with a space between, as a file without a decoder of its own asks for;
    joined=False turns the pieces back into bytes and word ends into spaces.
    """

    def __init__(self, vocab: Vocabulary, joined: bool = True):
        self.first = True
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        if joined:
            self.bytes = {i: s.encode() for i, s in vocab.pieces.items()}
        else:
            of = {s: b for b, s in enumerate(vocab.symbols)}
            special = set(vocab.special.values())
            cut = lambda s: (s.removesuffix(vocab.end), b" ") if vocab.end and s.endswith(vocab.end) else (s, b"")
            self.bytes = {i: s.encode() if i in special else bytes(of[c] for c in cut(s)[0]) + cut(s)[1] for i, s in vocab.pieces.items()}
        self.joined = joined

    def feed(self, ids: Iterable[int]) -> str:
        """The text that these ids complete; unknown ids are left out."""
        known = list(filter(None, map(self.bytes.get, ids)))
        if not known:
            return ""
        lead = b" " if self.joined and not self.first else b""
        self.first = False
        return self.state.decode(lead + (b" " if self.joined else b"").join(known))

    def finish(self) -> str:
        self.first = True
        return self.state.decode(b"", True)


def decode_all(decoder: Decoder, ids: list[int]) -> str:
    return "".join([*(decoder.feed(ids[i : i + CHUNK]) for i in range(0, len(ids), CHUNK)), decoder.finish()])


@lru_cache(maxsize=2)
def engine(vocab_path: str, joined: bool) -> tuple[Encoder, Decoder]:
    """One for each Python worker, which keeps it from task to task."""
    v = Vocabulary(vocab_path)
    return Encoder(v), Decoder(v, joined)


def encode_decode(df: DataFrame, vocab_path: str, text_col: str = "text", ids_out: str = "ids", decoded_out: str = "decoded", joined: bool = True) -> DataFrame:
    """df with the ids of each whole text and the text that they decode to; null text counts as empty: no ids, "".

    Columns of these names are replaced, others pass through. vocab_path must be readable on every executor. Very long texts
    are encoded whole, token by token; rows repeated whole are each encoded; an empty table gives no rows.
    """

    def made(texts: list[str], state: tuple[Encoder, Decoder]) -> list[pa.Array]:
        ids = [state[0].encode(t) for t in texts]
        return [pa.array(ids, pa.list_(pa.int32())), pa.array([decode_all(state[1], x) for x in ids], pa.string())]

    return with_text_columns(df, text_col, [(ids_out, "array<int>", pa.list_(pa.int32())), (decoded_out, "string", pa.string())], made, lambda: engine(vocab_path, joined))
