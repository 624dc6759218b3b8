"""SentencePiece merge-type (BPE) encoding by backtracking over longest matches.

A text is cut before white space, between whose pieces no merge of such a model can pass, and at
characters outside the vocabulary, which merge with nothing and fall back to bytes. Each rest is
encoded left to right: an Aho-Corasick automaton gives all pieces that match; the longest at the
position is tried first, and stays if merging the text of the two adjacent tokens again gives those
two tokens: at their common edge no part of the left one meets a part of the right one, in the order
of merging, with which it would join first. Otherwise a shorter one is tried; a position that no token leaves is marked in a
bitfield of failed positions, and the token before it is taken back. As merging splits every prefix
in one way only, a failed position need never be tried again, and the result is the library's.

Runs of white space, whose pieces all have one score, merge last, leftmost pair first; that is done
as stated. Decoding is the library's decode.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import dropped_by_others, tidy

SPACE = "▁"
#: Cached encodings of cut pieces, and of pair checks, in a worker; the caches only save time.
CACHE, PAIRS = 500_000, 60_000
#: Text of a result batch.
OUT_CHARS = 4 << 20


class Encoder:
    def __init__(self, model_path: str, cache: int = CACHE):
        self.cache_size = cache
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = sp.get_piece_size()
        self.ids, self.rank, self.byte_ids = {}, {}, {}
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece], self.rank[piece] = i, -sp.get_score(i)
        if len(self.byte_ids) < 256 or any(SPACE in p.lstrip(SPACE) or p[:2] == SPACE * 2 and p.strip(SPACE) for p in self.ids):
            raise ValueError("this encoder needs a merge model with byte fallback and no piece over several words")
        self.known = {c for p in self.ids for c in p}
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # the generation before; what is met again moves on
        self.packed: dict[str, bytes] = {}
        self.automaton = ahocorasick.Automaton()
        self.halves: dict[str, tuple[str, str]] = {}
        self.edges: dict[tuple[str, int], list[tuple[str, float, float]]] = {}
        for piece in self.ids:
            if piece.strip(SPACE) and self.merged(piece, self.halves) == [piece]:  # others can't be left by merging
                self.automaton.add_word(piece, len(piece))
        self.automaton.add_word(SPACE, 1)
        self.automaton.make_automaton()
        line = "" if "\n" in self.known else "\n"
        self.cut = re.compile((line + "|" if line else "") + f"{SPACE}+[^{SPACE}{line}]*|[^{SPACE}{line}]+").findall

    def merged(self, text: str, halves: dict[str, tuple[str, str]] | None = None) -> list[str]:
        """The tokens of a short text by the definition: join the best pair, leftmost first, until none is left.

        The last pair joined, if that gives the whole text, is noted in halves.
        """
        parts = list(text)
        while len(parts) > 1:
            best = min((self.rank.get(a + b, np.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == np.inf:
                break
            i = best[1]
            if halves is not None and len(parts) == 2:
                halves[text] = (parts[0], parts[1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether merging both tokens' text again gives the two tokens."""
        key = (left, right)
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._fits(left, right)
        return known

    def edge(self, token: str, side: int) -> list[tuple[str, float, float]]:
        """The parts of a token that stand at its left (0) or right (1) edge while it is merged.

        Each with the ranks at which it is made and used up. Empty if a part is ranked behind the
        token that it is merged into, as ranks are then no order of time.
        """
        if (known := self.edges.get((token, side))) is None:
            known, until = [], np.inf
            while True:
                made = self.rank.get(token, np.inf) if len(token) > 1 else -np.inf
                if made >= until:
                    known = []
                    break
                known.append((token, made, until))
                if len(token) == 1:
                    break
                both = self.halves.get(token)
                if both is None or any(len(x) > 1 and self.rank[x] >= made for x in both):
                    known = []
                    break
                token, until = both[side], made
            self.edges[(known[0][0] if known else token, side)] = known
        return known

    def _fits(self, left: str, right: str) -> bool:
        ends, starts = self.edge(left, 1), self.edge(right, 0)
        if not ends or not starts:
            return self.merged(left + right) == [left, right]
        rank = self.rank
        for a, a_made, a_used in ends:
            for b, b_made, b_used in starts:
                # Pairs of one rank are joined leftmost first.
                if (r := rank.get(a + b)) is not None and r < a_used and r <= b_used and a_made <= b_used and b_made < a_used:
                    return False
        return True

    def backtracked(self, text: str) -> list[str]:
        """Tokens of a text of known characters with no run of SPACE beyond one."""
        n = len(text)
        ends: list[list[int]] = [[] for _ in range(n)]
        for end, length in self.automaton.iter(text):
            ends[end - length + 1].append(end + 1)  # shorter matches come first
        failed = bytearray(n + 1)
        taken: list[str] = []
        path: list[tuple[int, int]] = []
        at, k, last, fits = 0, len(ends[0]) - 1, "", self.fits
        while at < n:
            here = ends[at]
            while k >= 0:
                end = here[k]
                if not failed[end]:
                    token = text[at:end]
                    if not at or fits(last, token):
                        break
                k -= 1
            if k >= 0:
                taken.append(token)
                path.append((at, k))
                last, at = token, end
                k = len(ends[at]) - 1 if at < n else 0
            else:
                failed[at] = 1
                at, k = path.pop()
                taken.pop()
                last = taken[-1] if taken else ""
        return taken

    def spaces(self, n: int) -> list[str]:
        """Tokens of a run of SPACE alone: all pairs rank equally, so the leftmost is joined first."""
        length = [1] * n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ready = [(self.rank[SPACE * 2], i) for i in range(n - 1)] if SPACE * 2 in self.rank else []
        while ready:
            rank, i = heapq.heappop(ready)
            j = after[i] if length[i] else n
            if j >= n or self.rank.get(SPACE * (length[i] + length[j])) != rank:
                continue
            length[i], length[j] = length[i] + length[j], 0
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := self.rank.get(SPACE * (length[i] + length[after[i]]))) is not None:
                    heapq.heappush(ready, (r, i))
            if (b := before[i]) >= 0 and (r := self.rank.get(SPACE * (length[b] + length[i]))) is not None:
                heapq.heappush(ready, (r, b))
        return [SPACE * x for x in length if x]

    def _packed(self, token: str) -> bytes:
        """A token's id, or those of its bytes, as little-endian integers."""
        known = self.ids.get(token)
        ids = [known] if known is not None else [self.byte_ids[b] for b in token.encode("utf-8", "surrogatepass")]
        out = self.packed[token] = b"".join(i.to_bytes(4, "little") for i in ids)
        return out

    def _tokens(self, word: str) -> list[str]:
        """Tokens of a piece of text without a run of SPACE; characters outside the vocabulary stand alone."""
        if self.known.issuperset(word):
            return self.backtracked(word)
        out: list[str] = []
        start = 0
        for i, c in enumerate(word):
            if c not in self.known:
                out += self.backtracked(word[start:i]) if i > start else []
                out.append(c)
                start = i + 1
        return out + (self.backtracked(word[start:]) if len(word) > start else [])

    def _fresh(self, cut: str) -> bytes:
        """The packed ids of a piece of text that self.cut gave."""
        out = self.older.get(cut)
        if out is None:
            if cut[:2] != SPACE * 2:
                tokens = self._tokens(cut) if cut != SPACE else [SPACE]
            else:
                run = len(cut) - len(cut.lstrip(SPACE))
                tokens = self._tokens(cut[run - 1 :]) if run < len(cut) else [SPACE]
                # The last SPACE of the run belongs to the others unless the word took it.
                tokens = self.spaces(run) + tokens[1:] if tokens[0] == SPACE else self.spaces(run - 1) + tokens
            known = self.packed
            out = b"".join([known.get(t) or self._packed(t) for t in tokens])
        if len(cut) <= 64:
            if len(self.cache) >= self.cache_size:
                self.older, self.cache = self.cache, {}
            self.cache[cut] = out
        return out

    def encode(self, text: str, bos: bool = True, eos: bool = True) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        get, fresh = self.cache.get, self._fresh
        # An empty text gets no dummy space before it.
        cuts = self.cut((SPACE + text.replace(" ", SPACE)) if text else "")
        out = b"".join([get(c) or fresh(c) for c in cuts])
        return (self.bos.to_bytes(4, "little") if bos else b"") + out + (self.eos.to_bytes(4, "little") if eos else b"")

    def decode(self, packed: bytes) -> str:
        return self.library.decode(np.frombuffer(packed, "<u4").tolist())


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(model_path: str, cache: int = CACHE) -> Encoder:
    """The encoder of a model, which a worker keeps with its caches as long as it only encodes."""
    if (model_path, cache) not in _encoders:
        _encoders[model_path, cache] = Encoder(model_path, cache)
        dropped_by_others(forget_encoders)
    return _encoders[model_path, cache]


def forget_encoders() -> None:
    _encoders.clear()


def _encoded(model_path: str, bos: bool, eos: bool, with_text: bool, cache: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_path, cache)
        names = ["id", "ids", *(["decoded"] if with_text else [])]
        for batch in batches:
            ids, texts, start, size = [], [], 0, 0
            for i, text in enumerate(batch.column(1)):
                packed = own.encode(text.as_py() or "", bos, eos)
                ids.append(packed)
                if with_text:
                    texts.append(own.decode(packed))
                size += len(packed)
                if size >= OUT_CHARS or i == len(batch) - 1:
                    columns = [batch.column(0).slice(start, i + 1 - start), pa.array(ids, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns + ([pa.array(texts, pa.string())] if with_text else []), names=names)
                    ids, texts, start, size = [], [], i + 1, 0

    return tidy(run, forget_encoders)


def encoded(
    docs: DataFrame,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    bos: bool = True,
    eos: bool = True,
    with_text: bool = True,
    cache: int = CACHE,
) -> DataFrame:
    """One row per row of docs: its id, ids (packed little-endian unsigned 32-bit integers) and decoded text.

    model_path names a sentencepiece merge model that every executor can open. cache is how many pieces of
    text a worker remembers, twice over, at some 270 bytes each; it changes time, not results. Null texts count as
    empty, an empty text has only the begin and end ids; nothing is cut, so very long texts give
    very long rows; repeated rows give equal rows and an empty table an empty result. Other columns
    are ignored.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    schema = f"id {kind}, ids binary" + (", decoded string" if with_text else "")
    return own.mapInArrow(_encoded(model_path, bos, eos, with_text, cache), schema).withColumnRenamed("id", id_col)


def unpacked(packed: bytes) -> list[int]:
    """The ids of a packed value as a list."""
    return np.frombuffer(packed, "<u4").tolist()
