"""Token ids of whole texts with a public tokenizer file, each distinct word encoded once.

Both tokenizers cut a text into words before they merge, so the ids of a text
are those of its words in order. A worker keeps the ids of words it has seen
(a bounded store) and hands only new words to the tokenizers library.
"""

from __future__ import annotations

import re
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tabulon.llm.shared import runs, text_buffers, worker_stores

#: Words that a worker keeps ids of, and their characters; beyond, it starts anew.
WORDS, CHARS = 2_000_000, 24_000_000

_memo: dict = {}
worker_stores.append(_memo)
_SPACES = re.compile(r"\s\s")
_LONE_SPACE = re.compile(r"(?<=\S)(?= \S)")


def _near_spaces(text: str) -> bool:
    """Whether white space may stand beside white space (then a text is cut at lone spaces only), or a NUL occurs."""
    if "\0" in text:
        return True
    if not text.isascii():
        return _SPACES.search(text) is not None
    if any(c in text for c in "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"):
        return _SPACES.search(text) is not None
    return "  " in text or " \n" in text or "\n " in text or "\n\n" in text


#: The cut into words of a tokenizer file that the light route below stands for: letters go by runs, and so do signs.
_RUNS = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_FORMS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
# Letters that stay one letter each under NFC and lower case (Latin, Cyrillic, kana, ideographs), with ASCII signs before and
# after; no apostrophe, as the cut knows endings by it.
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f\u0410-\u044f\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fff]+")
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# Bytes in the form that words are kept in: white space of the files' cut as spaces, and A-Z in lower case.
_SPACED = np.arange(256, dtype=np.uint8)
_SPACED[[9, 10, 13]] = 32
_LOWER = _SPACED.copy()
_LOWER[65:91] += 32


def _light(path: str):
    """(tokenizer, whether a token ends a word) that cuts at spaces only, for words that are runs of letters; None if the file
    cuts words otherwise."""
    import json

    from tokenizers import Tokenizer, pre_tokenizers

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, cut, form = file["model"], file.get("pre_tokenizer") or {}, file.get("normalizer") or {}
    suffix = model.get("end_of_word_suffix")
    if cut.get("pretokenizers") != [_RUNS, _BYTES] or form.get("normalizers") != _FORMS or model.get("type") != "BPE" or not suffix:
        return None
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    tok.normalizer = None  # such words are put in lower case before, and NFC leaves them as they are
    tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    last = np.zeros(max(model["vocab"].values()) + 1, bool)
    last[[k for t, k in model["vocab"].items() if t.endswith(suffix)]] = True
    return tok, last


class Memo:
    """ids of words; spaced: a word's leading space belongs to it (byte-level BPE), else white space is dropped."""

    words_kept, chars_kept = WORDS, CHARS
    light = None

    def __init__(self, path: str, spaced: bool):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # such strings in a text are ordinary text
        self.spaced = spaced
        self.light = None if spaced else _light(path)
        # new words go to the tokenizer many at once, with a mark between them that is a word and one id of its own
        self.mark = "\n" if spaced else "~"
        self.mark_id = self.tok.encode(self.mark, add_special_tokens=False).ids
        self.clear()

    def clear(self):
        self.at: dict[str, int] = {}
        self.chars = self.used = 0
        self.flat, self.start, self.size = np.empty(1 << 20, np.uint32), np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)
        if self.light:
            self._keep([""], np.zeros(1, np.int64), np.zeros(0, np.uint32))

    def ids_of(self, words):
        """(ids per word, all ids) of new words."""
        plain = [len(self.mark_id) == 1 and self.mark not in w and not w[-1].isspace() and not w[:2].isspace() for w in words]
        together = [w for w, p in zip(words, plain, strict=True) if p]
        glue = self.mark if self.spaced else f" {self.mark} "
        parts = [glue.join(together[k:k + 2000]) for k in range(0, len(together), 2000)]
        sizes, flat = [], []
        for e in self.tok.encode_batch_fast(parts, add_special_tokens=False):
            ids = np.array(e.ids, np.uint32)
            at = np.flatnonzero(ids == self.mark_id[0])
            sizes.append(np.diff(np.r_[-1, at, len(ids)]) - 1)
            flat.append(np.delete(ids, at))
        if len(together) == len(words):
            return np.concatenate(sizes), np.concatenate(flat)
        alone = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(
            [w for w, p in zip(words, plain, strict=True) if not p], add_special_tokens=False)]
        n = np.concatenate([*sizes, np.zeros(0, np.int64)])
        flat = np.concatenate([*flat, np.zeros(0, np.uint32)])
        lists = iter(np.split(flat, np.cumsum(n)[:-1]) if len(n) else ())
        rest = iter(alone)
        each = [next(lists) if p else next(rest) for p in plain]
        return np.fromiter(map(len, each), np.int64, len(each)), np.concatenate(each)

    def _keep(self, words, sizes, ids):
        n, total = len(self.at), len(ids)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while n + len(words) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.size))
        self.flat[self.used:self.used + total] = ids
        self.start[n:n + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.size[n:n + len(words)] = sizes
        self.used += total
        self.at.update(zip(words, range(n, n + len(words)), strict=True))
        self.chars += sum(map(len, words))

    def _runs_of_letters(self, words):
        """(ids per word, all ids) of words that are runs of letters, or None where the tokens do not tell their ends."""
        tok, last = self.light
        parts = [" ".join(words[k:k + 200]).lower() for k in range(0, len(words), 200)]
        flat = np.concatenate([np.array(e.ids, np.uint32) for e in tok.encode_batch_fast(parts, add_special_tokens=False)])
        at = np.flatnonzero(last[flat])
        return (np.diff(np.r_[-1, at]), flat) if len(at) == len(words) and at[-1] == len(flat) - 1 else None

    def _learn(self, words):
        for k in range(0, len(words), 50_000):
            part = words[k:k + 50_000]
            if self.light is None:
                self._keep(part, *self.ids_of(part))
                continue
            trimmed = pc.utf8_trim(pa.array(part, pa.string()), _SIGNS)
            simple = pc.match_substring_regex(trimmed, f"^{_LETTERS.pattern}$").to_numpy(zero_copy_only=False).tolist()
            cores = trimmed.to_numpy(zero_copy_only=False).tolist()
            letters = [c for c in dict.fromkeys(compress(cores, simple)) if c not in self.at]
            found = self._runs_of_letters(letters) if letters else None
            if found:
                self._keep(letters, *found)
            signed = [(w, w.partition(c)) for w, c, s in zip(part, cores, simple, strict=True) if s and len(c) < len(w)]
            hard = [w for w, s in zip(part, simple, strict=True) if not s] + ([] if found else letters)
            hard += [p for _, (lead, _, tail) in signed for p in (lead, tail)]
            hard = [w for w in dict.fromkeys(hard) if w not in self.at]
            if hard:
                self._keep(hard, *self.ids_of(hard))
            if signed:  # a word of three pieces, the outer ones perhaps empty
                code = np.fromiter(map(self.at.__getitem__, chain.from_iterable(p for _, p in signed)), np.int64, 3 * len(signed))
                self._keep([w for w, _ in signed], self.size[code].reshape(-1, 3).sum(1), self._gather(code)[1])

    def _gather(self, code):
        """(running total of sizes, ids) of words by their number."""
        size = self.size[code]
        total = np.cumsum(size)
        n = int(total[-1]) if len(total) else 0
        return total, self.flat[np.repeat(self.start[code] - (total - size), size) + np.arange(n)]

    def _words(self, text: str):
        if not self.spaced:
            if text.isascii() and not any(c in text for c in "\x0b\x0c\x1c\x1d\x1e\x1f"):
                return text.lower().split()
            for c in "\n\r\t":
                text = text.replace(c, " ")
            return [w for w in text.split(" ") if w]
        if _near_spaces(text):
            return [w for w in _LONE_SPACE.split(text) if w]
        words = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        return words if words[0] and words[-1] else [w for w in words if w]

    def encode(self, texts):
        """(ids per text, all ids) of a list of texts."""
        if self.light:
            return self.encode_column(pa.array(texts, pa.string()))
        lists = [self._words(t) for t in texts]
        words = list(chain.from_iterable(lists))
        if len(self.at) > self.words_kept or self.chars > self.chars_kept:
            self.clear()
        code = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(code < 0).tolist()
        if new:
            self._learn(list(dict.fromkeys(words[k] for k in new)))
            code[new] = np.fromiter(map(self.at.__getitem__, (words[k] for k in new)), np.int64, len(new))
        total, ids = self._gather(code)
        ends = np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))
        upto = np.r_[0, total][ends]
        return np.diff(np.r_[0, upto]), ids


    def encode_column(self, column):
        """(ids per text, all ids) of an Arrow column, by the light route: Arrow cuts and counts words, only distinct ones are
        looked up. When the store is full, the words of these texts stay."""
        offsets, raw = text_buffers(column)
        data = _LOWER[raw]
        # marks that NFC joins to letters (U+0300 to U+036F): it may join them to small ones only, so those texts keep their case
        marked = np.flatnonzero((raw == 0xCC) | (raw == 0xCD))
        for k in np.unique(np.searchsorted(offsets, marked, side="right") - 1).tolist():
            data[offsets[k]:offsets[k + 1]] = _SPACED[raw[offsets[k]:offsets[k + 1]]]
        texts = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        code = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        if len(self.at) > self.words_kept or self.chars > self.chars_kept:
            held = np.flatnonzero(code > 0)  # 0 is the empty word
            sizes, ids = self.size[code[held]], self._gather(code[held])[1]
            self.clear()
            self._keep([words[k] for k in held.tolist()], sizes, ids)
            code = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(code < 0)
        if len(new):
            unseen = [words[k] for k in new.tolist()]
            self._learn(unseen)
            code[new] = np.fromiter(map(self.at.__getitem__, unseen), np.int64, len(new))
        total, ids = self._gather(code[coded.indices.to_numpy()])
        upto = np.r_[0, total][lists.offsets.to_numpy()]
        return np.diff(upto), ids


def memo(path: str, spaced: bool) -> Memo:
    """The worker's own store for a tokenizer file."""
    if (path, spaced) not in _memo:
        _memo[path, spaced] = Memo(path, spaced)
    return _memo[path, spaced]


def with_end(sizes, ids, end: int):
    """The ids with an end id after each text's, and the sizes with it."""
    out = np.empty(len(ids) + len(sizes), np.uint32)
    last = np.cumsum(sizes + 1) - 1
    body = np.ones(len(out), bool)
    body[last] = False
    out[last], out[body] = end, ids
    return sizes + 1, out


def encoded(batches, path: str, spaced: bool, end: int, characters: int = 2_000_000, remembered: int = WORDS):
    """Yield (batch slice, sizes, ids) with end ids, a bounded number of characters at a time; about ``remembered`` words of
    twelve characters are kept."""
    store = memo(path, spaced)
    store.words_kept, store.chars_kept = remembered, CHARS // WORDS * remembered
    for b in batches:
        if store.light:
            for i, j in runs(text_buffers(b.column("text"))[0], characters):
                yield b.slice(i, j - i), *with_end(*store.encode_column(b.column("text").slice(i, j - i)), end)
            continue
        texts = b.column("text").to_pylist()
        k = 0
        while k < len(texts):
            j, held = k, 0
            while j < len(texts) and (j == k or held + len(texts[j] or "") <= characters):
                held += len(texts[j] or "")
                j += 1
            sizes, ids = store.encode([t or "" for t in texts[k:j]])
            yield b.slice(k, j - k), *with_end(sizes, ids, end)
            k = j
