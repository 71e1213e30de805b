"""SentencePiece encoding and decoding by suffix-array matching.

A batch's distinct words (a run of spaces and what follows it up to the next
space; no piece reaches over that edge) are concatenated and indexed by a
suffix array. Every piece of the vocabulary is binary-searched for the range of
suffixes that start with it, which gives all its occurrences; the occurrences
are the edges of a graph over text positions. Sorted by end position they are
relaxed: the model merges pairs by score, and the pieces of a text under such
merges are those where every adjacent pair would stay apart on its own, so a
position is reached by the one edge whose piece stays apart from the piece that
reached its start. Characters outside the vocabulary are edges of their own and
become byte pieces.

Defined cases: null text is empty and has no ids; white space is kept as it is,
and one space is put before a text that is not empty; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabulon.llm.shared import with_text
from tabulon.llm.tokens import Memo

_SPACED = re.compile(" *[^ ]+| +")
_ODD = re.compile("^ |  | $|▁")
#: Characters of distinct words that are indexed at once, and pairs of pieces whose verdict a worker keeps.
INDEX_CHARS, PAIRS = 400_000, 1_000_000


def suffix_array(codes: np.ndarray, depth: int):
    """Positions sorted by the ``depth`` characters (at least) that follow, by prefix doubling."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1
    width = 1
    while True:
        ahead = np.zeros_like(rank)
        if width < len(rank):
            ahead[:-width] = rank[width:]
        if width >= depth or len(rank) < 2:
            return np.argsort(rank, kind="stable")
        key = rank * (int(rank.max()) + 1) + ahead
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64) + 1
        width *= 2


class Pieces(Memo):
    """A worker's model: pieces, their matching, and the ids of words seen."""

    words_kept, chars_kept = 700_000, 8_000_000

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.n = n
        self.text = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.rank = {self.text[i]: (-sp.get_score(i), i) for i in plain}
        self.byte = {int(self.text[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.longest = max(len(self.text[i]) for i in plain)
        order = sorted(plain, key=lambda i: len(self.text[i]))
        self.pieces = np.array(order, np.int64)
        self.sizes = np.array([len(self.text[i]) for i in order], np.int64)
        self.codes = np.zeros((len(order), self.longest), np.int64)
        for k, i in enumerate(order):
            self.codes[k, :self.sizes[k]] = [ord(c) for c in self.text[i]]
        self.apart: dict[int, bool] = {}
        self.spaced = True
        self.clear()

    def _words(self, text: str):
        if not text:
            return []
        if _ODD.search(text):
            return _SPACED.findall(" " + text.replace("▁", " "))
        return [" " + w for w in text.split(" ")]

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether merging the two pieces' text from single characters ends in just these two pieces."""
        left = len(self.text[a])
        s = list(self.text[a] + self.text[b])
        rank = self.rank
        while True:
            best, at = None, -1
            for k in range(len(s) - 1):
                r = rank.get(s[k] + s[k + 1])
                if r is not None and (best is None or r[0] < best):
                    best, at = r[0], k
            if best is None:
                return len(s) == 2 and len(s[0]) == left
            s[at:at + 2] = [s[at] + s[at + 1]]
            length = 0
            for x in s:
                length += len(x)
                if length >= left:
                    break
            if length != left:
                return False

    def _verdicts(self, codes):
        known = self.apart
        if len(known) > PAIRS:
            known.clear()
        each, back = np.unique(codes, return_inverse=True)
        out = np.empty(len(each), bool)
        for k, c in enumerate(each.tolist()):
            v = known.get(c)
            if v is None:
                v = known[c] = self._stay_apart(c // (self.n + 1), c % (self.n + 1))
            out[k] = v
        return out[back]

    def edges(self, codes):
        """(start, piece, size) of every occurrence of every piece in the text."""
        order = suffix_array(codes, self.longest)
        n, width = len(codes), self.longest
        padded = np.r_[codes, np.zeros(width, np.int64)]
        lo, hi = np.zeros(len(self.pieces), np.int64), np.full(len(self.pieces), n)
        for char in range(width):  # narrow each piece's range of suffixes character by character
            live = np.flatnonzero((self.sizes > char) & (lo < hi))
            if not len(live):
                break
            want = self.codes[live, char]
            for side in (0, 1):
                a, b = lo[live].copy(), hi[live].copy()
                while True:
                    go = a < b
                    if not go.any():
                        break
                    mid = (a + b) // 2
                    c = padded[order[np.minimum(mid, n - 1)] + char]
                    right = (c <= want) if side else (c < want)
                    a, b = np.where(go & right, mid + 1, a), np.where(go & ~right, mid, b)
                if side == 0:
                    low = a
                else:
                    hi[live] = a
            lo[live] = low
        count = np.maximum(hi - lo, 0)
        total = np.cumsum(count)
        which = np.repeat(np.arange(len(count)), count)
        start = order[np.arange(len(which)) - (total - count)[which] + lo[which]]
        return start, self.pieces[which], self.sizes[which]

    def ids_of(self, words):
        held, parts, size = [], [], 0
        for w in words:
            held.append(w)
            size += len(w)
            if size >= INDEX_CHARS:
                parts.append(self._encode(held))
                held, size = [], 0
        if held:
            parts.append(self._encode(held))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint32))

    def _encode(self, words):
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        text = "\0".join(words).replace(" ", "▁") + "\0"
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        starts = np.cumsum(lengths + 1) - lengths - 1
        owner = np.repeat(np.arange(len(words)), lengths + 1)
        ends = starts + lengths
        codes[ends] = -1  # a mark between words that no piece holds
        start, piece, size = self.edges(codes)
        covered = np.zeros(len(codes), bool)
        covered[start[size == 1]] = True
        covered[ends] = True
        lone = np.flatnonzero(~covered)
        start, piece, size = np.r_[start, lone], np.r_[piece, np.full(len(lone), self.n)], np.r_[size, np.ones(len(lone), np.int64)]
        offset = start - starts[owner[start]] + size  # end position within the word: the order of relaxation
        by = np.lexsort((size, offset))
        start, piece, size, offset = start[by], piece[by], size[by], offset[by]
        reach = np.full(len(codes) + 1, -1, np.int64)  # piece that ends at a position
        back = np.zeros(len(codes) + 1, np.int64)
        cut = np.searchsorted(offset, np.arange(1, int(offset.max()) + 2 if len(offset) else 1))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            s, t, n = start[a:b], piece[a:b], size[a:b]
            before = reach[s]
            head = s == starts[owner[s]]
            ok = head | (before >= 0)
            test = np.flatnonzero(ok & ~head & (before != self.n) & (t != self.n))
            ok[test] = self._verdicts(before[test] * (self.n + 1) + t[test])
            s, t, n = s[ok], t[ok], n[ok]
            reach[s + n], back[s + n] = t, n
        # walk back from the words' ends, all words at once
        at, todo, out_word, out_pos, out_piece = ends.copy(), np.flatnonzero(lengths > 0), [], [], []
        while len(todo):
            p = reach[at[todo]]
            at[todo] -= back[at[todo]]
            out_word.append(todo)
            out_pos.append(at[todo])
            out_piece.append(p)
            todo = todo[at[todo] > starts[todo]]
        word, pos, ids = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_word, out_pos, out_piece))
        by = np.lexsort((pos, word))
        word, pos, ids = word[by], pos[by], ids[by]
        lone = np.flatnonzero(ids == self.n)
        if len(lone):
            spelled = [[self.byte.get(x, self.unknown) for x in chr(c).encode("utf-8", "replace")] for c in codes[pos[lone]].tolist()]
            times = np.ones(len(ids), np.int64)
            times[lone] = [len(x) for x in spelled]
            word, ids = np.repeat(word, times), np.repeat(ids, times)
            ids[ids == self.n] = [x for y in spelled for x in y]
        return np.bincount(word, minlength=len(words)), ids.astype(np.uint32)

    def decode_all(self, sizes, ids) -> list[str]:
        """Texts of many id lists; distinct ids are spelled once."""
        each, back = np.unique(ids, return_inverse=True)
        if not len(each):
            return [""] * len(sizes)
        value = {i: bytes([b]) for b, i in self.byte.items()}
        spelled = np.array([value.get(i) or self.text[i].replace("▁", " ").encode() for i in each.tolist()], object)
        parts, out, at = spelled[back].tolist(), [], 0
        for n in sizes.tolist():
            text = b"".join(parts[at:at + n]).decode("utf-8", "replace")
            out.append(text[1:] if text.startswith(" ") else text)
            at += n
        return out


_models: dict = {}


def model(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def _slices(batches, characters=2_000_000):
    for b in batches:
        texts, k = b.column("text").to_pylist(), 0
        while k < len(texts):
            j, held = k, 0
            while j < len(texts) and (j == k or held < characters):
                held += len(texts[j])
                j += 1
            yield b.slice(k, j - k), texts[k:j]
            k = j


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of every document."""
    def go(batches):
        m = model(path)
        for b, texts in _slices(batches):
            sizes, ids = m.encode(texts)
            lists = np.split(ids.astype(np.int32), np.cumsum(sizes)[:-1])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return with_text(docs, id_col, text_col).mapInArrow(go, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every list of ids; a null list is empty."""
    def go(batches):
        m = model(path)
        for b in batches:
            lists = [x or [] for x in b.column("ids").to_pylist()]
            sizes = np.array([len(x) for x in lists], np.int64)
            texts = m.decode_all(sizes, np.array([i for x in lists for i in x], np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(go, "doc_id long, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32, text_crc32 of the text decoded from the ids, and whether it is the document's text."""
    def go(batches):
        m = model(path)
        for b, texts in _slices(batches):
            sizes, ids = m.encode(texts)
            raw, ends = ids.astype("<u4"), np.cumsum(sizes)
            back = m.decode_all(sizes, ids.astype(np.int64))
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id").cast(pa.int64()), "n_ids": pa.array(sizes, pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(raw[e - n:e].tobytes()) for e, n in zip(ends, sizes, strict=True)], pa.int64()),
                "text_crc32": pa.array([zlib.crc32(t.encode()) for t in back], pa.int64()),
                "round_trip": pa.array([x == y for x, y in zip(back, texts, strict=True)], pa.bool_())})

    return with_text(docs, id_col, text_col).mapInArrow(go, "doc_id long, n_ids long, ids_crc32 long, text_crc32 long, round_trip boolean")
