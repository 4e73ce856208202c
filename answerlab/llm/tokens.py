"""Token ids of whole texts, one word at a time.

The tokenizers meant here never join bytes across white space: the ids of a text
are those of its words in order. So a slice of texts is cut into words, its
distinct words are encoded once, and the ids are put together by array indexing.

Words of letters below U+0250, with ASCII marks behind them, go to the model in
lower case: they need no normalising or splitting, which take most of a
tokenizer's time; the marks are one piece, encoded on its own. Every other word
takes the tokenizer's whole way. That both ways agree is tried on sample words
first; else all words take the whole way.
Nothing is remembered between slices, so memory is bounded by one slice.
"""

from __future__ import annotations

import itertools
import os
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from answerlab.llm import words as W

#: Bytes of text that one slice holds.
_SLICE = 4 << 20

#: Words of one call to the model.
_CALL = 100

#: Letters below U+0250 whose lower case is one character.
_LETTERS = "^[A-Za-zªµºÀ-ÖØ-öø-įı-ɏ]+$"


def _byte_alphabet() -> dict[int, str]:
    """Byte-level vocabularies write each byte as one printable character:
    printable Latin-1 bytes as themselves, the others from U+0100 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class _Pool:
    """Ids of segments, one behind another."""

    def __init__(self):
        self.ids, self.sizes = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]  # segment 0 is empty
        self.count = 1

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        at = self.count
        self.ids.append(ids.astype(np.uint32))
        self.sizes.append(sizes.astype(np.int64))
        self.count += len(sizes)
        return at

    def gather(self, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments in this order, and where each begins."""
        sizes = np.concatenate(self.sizes)
        begin = np.cumsum(sizes) - sizes
        lens = sizes[segments]
        total = np.concatenate(([0], np.cumsum(lens)))
        take = np.repeat(begin[segments] - total[:-1], lens)
        take += np.arange(total[-1])
        return np.concatenate(self.ids)[take], total


class WordEncoder:
    """``plain_specials``: strings of special tokens inside texts are plain text;
    else they become the special tokens, as the tokenizer does when it is loaded."""

    def __init__(self, path: str, plain_specials: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = plain_specials
        self.bare = Tokenizer(self.tok.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.alphabet = _byte_alphabet()
        self.ends = np.zeros(self.tok.get_vocab_size() + 1, dtype=bool)
        suffix = getattr(self.tok.model, "end_of_word_suffix", None)
        if suffix:
            self.ends[[i for t, i in self.tok.get_vocab().items() if t.endswith(suffix)]] = True
        sample = ["straße", "été", "naïve", "the", "zu", "œuvre", "ñandú"]
        ids, sizes = self._lower(sample)
        self.short = bool(suffix) and [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [
            e.ids[:-1] for e in self.tok.encode_batch([w.capitalize() + "*" for w in sample], add_special_tokens=False)]

    def _whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes

    def _lower(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of lower-case letters, many to a call; the ids that end a word tell them apart."""
        shown = words if "".join(words).isascii() else [
            w if w.isascii() else w.encode().decode("latin-1").translate(self.alphabet) for w in words]
        calls = [" ".join(shown[i:i + _CALL]) for i in range(0, len(shown), _CALL)]
        got = [e.ids for e in self.bare.encode_batch_fast(calls, add_special_tokens=False)]
        ids = np.fromiter(itertools.chain.from_iterable(got), np.uint32, sum(map(len, got)))
        return ids, np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0)

    def _slice(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, first = W.spans(data, at)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(at) - 1, np.int64)
        gap = np.zeros(256, dtype=bool)
        gap[list(W.WORD_GAPS)] = True
        offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
        column = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[~gap[data]])).dictionary_encode()
        words, codes = column.dictionary, column.indices.to_numpy()
        stem = pc.utf8_rtrim(words, characters=string.punctuation)
        short = pc.match_substring_regex(stem, _LETTERS).to_numpy(zero_copy_only=False) & self.short
        pool, one, two = _Pool(), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        if short.any():
            lower = pc.utf8_lower(stem.filter(pa.array(short))).dictionary_encode()
            one[short] = pool.add(*self._lower(lower.dictionary.to_pylist())) + lower.indices.to_numpy()
            marked = short & (pc.binary_length(words).to_numpy() > pc.binary_length(stem).to_numpy())
            if marked.any():
                pick = pa.array(marked)
                tail = pc.replace_substring_regex(words.filter(pick), "^.*?([!-/:-@\\[-`{-~]*)$", "\\1").dictionary_encode()
                two[marked] = pool.add(*self._whole(tail.dictionary.to_pylist())) + tail.indices.to_numpy()
        if not short.all():
            one[~short] = pool.add(*self._whole(words.filter(pa.array(~short)).to_pylist())) + np.arange((~short).sum())
        segments = np.empty(2 * len(codes), np.int64)
        segments[::2], segments[1::2] = one[codes], two[codes]
        ids, total = pool.gather(segments)
        return ids, np.diff(total[2 * first])

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """Ids (uint32) of every text; null is empty."""
        data, at = W.text_bytes(column)
        out: list[np.ndarray] = []
        i = 0
        while i < len(at) - 1:
            j = max(i + 1, int(np.searchsorted(at, at[i] + _SLICE, side="right")) - 1)
            ids, counts = self._slice(data[at[i]:at[j]], at[i:j + 1] - at[i])
            out += np.split(ids, np.cumsum(counts)[:-1])
            i = j
        return out
