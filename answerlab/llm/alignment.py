"""Cross-tokenizer alignment by whitespace-token anchors.

Every text is tokenised whole by two tokenizers: A, a byte-level BPE, and B, a
piece BPE. Both token rows spell the same bytes (else the text has no tokens
here), so tokens are compared by the byte offsets at which they end.

An *anchor* is a byte offset at which a token of A and one of B both end (this is
verified on the offsets) and the next token of both begins with a space. Anchors
cut a document into windows of a few tokens of each side. What happens inside a
window, its groups and links, depends on its token ids alone, so windows are
memoised by their id tuples: most windows are words that came before.

* Groups: the offsets inside a window where tokens of both sides end cut it.
* Links: the ends of both sides together cut a window into stretches; each lies
  in one token of A and one of B, and each overlapping pair has just one.

Corpus counts (in how many documents an id pair is linked) are exact. Texts are
dealt to chunks of bounded bytes in the scan. A chunk is written with the
distinct pairs it holds (and in how many of its documents each), and per
document the places of its pairs in that list with their numbers of links. Counts
are summed over chunks in Spark; then every chunk asks for its distinct pairs
only, once each, and meets the answers in one bounded task. So a pair that
nearly all documents hold is one row for each chunk, not for each document.

Defined results: null or empty texts, and texts that a tokenizer does not spell
out (such as U+2581 as a character, which B reads as a space), have zeros and
''; special-token strings inside texts are plain text; repeated rows are
documents each; null ids stay; an empty table gives no rows; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlab.llm import words as W
from answerlab.llm.common import own_names, stored
from answerlab.llm.tokens import _byte_alphabet
from answerlab.session import ship_package

_CHUNK = 8 << 20       # bytes of text in a chunk
_CALL = 2 << 20        # bytes of text tokenised at a time
_MEMO = 1 << 18        # windows remembered at most
_PAIR = 32             # bits of an id in a packed pair

#: Pre-tokens of byte-level BPE. A fixed, published pattern; \p classes as the tokenizer has them.
_PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Lead bytes from here on are characters from U+0240 on, which libraries may class by different versions of Unicode.
_OTHER = 0xC9

_SAMPLE = ["The cat's  mat, they'll\n\n see 3 naïve été\t!? ", " ñandú «Straße» 12x\x00\x7f\u00a0\u0085 end   \n"]


def _merge_engine(tokenizer, path: str):
    """The same vocabulary for the faster of the installed libraries: ids of
    plain byte-level BPE rise in the order of its merges, so ids are ranks. None
    if the file is of another kind, or the two differ on a sample."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, before = whole["model"], whole["pre_tokenizer"] or {}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
    plain = (model.get("type") == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
             and whole["normalizer"] is None and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix")))
    made = [model["vocab"].get("".join(m), -1) for m in merges]
    back = {c: b for b, c in _byte_alphabet().items()}
    if not plain or made != sorted(made) or min(made, default=0) < 0 or len(model["vocab"]) != len(set(made)) + 256:
        return None
    ranks = {bytes(back[c] for c in token): i for token, i in model["vocab"].items()
             if all(c in back for c in token)}
    if len(ranks) != len(model["vocab"]):
        return None
    engine = tiktoken.Encoding("byte-level", pat_str=_PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
    same = [engine.encode_ordinary(t) for t in _SAMPLE] == [tokenizer.encode(t, add_special_tokens=False).ids for t in _SAMPLE]
    return engine if same else None


class Tokenizers:
    """Ids of whole texts by both tokenizers, and for each id its bytes' number
    and whether it begins with a space."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.fast = _merge_engine(self.a, path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        back = {c: b for b, c in _byte_alphabet().items()}
        vocabulary = self.a.get_vocab()
        spelled = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            spelled[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.table_a = self._table(spelled)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.table_b = self._table([bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) and self.b.is_byte(i)
                                    else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])

        ids = [str(i) for i in range(max(len(spelled), len(pieces)))]
        self.shown = np.array([[mark + i for i in ids] for mark in (",", "|", ";", "\n")], dtype=object)

    @staticmethod
    def _table(spelled: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(all bytes, where each id begins, number of bytes, begins with a space)."""
        size = np.array([len(x) for x in spelled], np.int64)
        return np.frombuffer(b"".join(spelled), np.uint8), np.cumsum(size) - size, size, np.array([x[:1] == b" " for x in spelled])

    def encode(self, texts: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """(ids, tokens of each text) of A and of B."""
        spaced = [" " + t for t in texts]
        slow = [i for i, t in enumerate(spaced) if self.fast is None or not t.isascii() and max(t) >= chr((_OTHER & 0x1F) << 6)]
        whole = dict(zip(slow, self.a.encode_batch_fast([spaced[i] for i in slow], add_special_tokens=False))) if slow else {}
        a = [whole[i].ids if i in whole else self.fast.encode_ordinary(t) for i, t in enumerate(spaced)]
        b = self.b.encode(texts, num_threads=1)
        return tuple((np.fromiter(itertools.chain.from_iterable(x), np.int64), np.fromiter(map(len, x), np.int64, len(x))) for x in (a, b))


def _spelled(table: tuple, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(joined bytes, end of each token in them)."""
    data, begin, size, _ = table
    ends = np.cumsum(size[ids])
    take = np.repeat(begin[ids] - (ends - size[ids]), size[ids])
    take += np.arange(len(take))
    return data[take], ends


def _same(joined: np.ndarray, at: np.ndarray, wanted: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Which texts' joined bytes are the wanted ones (both with offsets)."""
    fits = np.diff(at) == np.diff(where)
    for i in np.flatnonzero(fits):
        fits[i] = np.array_equal(joined[at[i]:at[i + 1]], wanted[where[i]:where[i + 1]])
    return fits


def _marks(ends: np.ndarray) -> np.ndarray:
    """Which byte offsets are ends."""
    out = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, bool)
    out[ends] = True
    return out


def _shared(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in both rows of ends of the offsets that stand in both."""
    return np.flatnonzero(_marks(two)[one]), np.flatnonzero(_marks(one)[two])


def _tokens_at(offsets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each byte end, the first token that ends there or behind it."""
    mark = _marks(ends)
    return (np.cumsum(mark) - mark)[offsets]


class Aligner:
    """Aligns whole texts, and remembers windows by their id tuples."""

    def __init__(self, tokenizers: Tokenizers):
        self.tok = tokenizers
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.texts: list[str] = []
        self.groups, self.fan, self.flat = (np.zeros(0, np.int64) for _ in range(3))

    def _learn(self, keys: list[bytes]) -> None:
        """Align new windows side by side. A key is the number of A's ids, then
        the ids of both sides."""
        data = np.frombuffer(b"".join(keys), np.uint32).astype(np.int64)
        size = np.array([len(k) // 4 for k in keys], np.int64)
        begin = np.cumsum(size) - size
        window = np.repeat(np.arange(len(keys)), size)
        place, cut = np.arange(len(data)) - begin[window], data[begin][window]
        in_a, in_b = (place > 0) & (place <= cut), place > cut
        a, b = data[in_a], data[in_b]
        ends_a, ends_b = np.cumsum(self.tok.table_a[2][a]), np.cumsum(self.tok.table_b[2][b])
        mark = _marks(ends_a) | _marks(ends_b)
        ends, shared = np.flatnonzero(mark), ends_a[_shared(ends_a, ends_b)[0]]
        of = _tokens_at(ends, ends_a)
        self.flat = np.concatenate([self.flat, a[of] << _PAIR | b[_tokens_at(ends, ends_b)]])
        self.fan = np.concatenate([self.fan, np.bincount(window[in_a][of], minlength=len(keys))])
        self.groups = np.concatenate([self.groups, np.bincount(window[in_a][_tokens_at(shared, ends_a)], minlength=len(keys))])
        # groups as text: tokens by group and side, each behind the mark that parts it from the one before
        row = np.concatenate([2 * _tokens_at(ends_a, shared), 2 * _tokens_at(ends_b, shared) + 1])
        order = np.argsort(row, kind="stable")
        row, owner = row[order], np.concatenate([window[in_a], window[in_b]])[order]
        mark = np.where(np.diff(owner, prepend=-1) > 0, 3, np.where(np.diff(row // 2, prepend=-1) > 0, 2, np.diff(row, prepend=0)))
        shown = self.tok.shown[mark, np.concatenate([a, b])[order]]
        self.texts += "".join(shown.tolist()).split("\n")[1:]
        self.known.update(zip(keys, range(len(self.known), len(self.known) + len(keys))))

    def align(self, texts: list[str]) -> list[tuple[int, int, int, str, np.ndarray, np.ndarray]]:
        """For each text: tokens of A, of B, groups, hash of the groups, distinct
        linked pairs (ascending) and the number of links of each."""
        if len(self.texts) > _MEMO:
            self._forget()
        (a, n_a), (b, n_b) = self.tok.encode(texts)
        wanted, where = W.text_bytes(pa.array([" " + t for t in texts], pa.large_string()))
        (joined_a, ends_a), (joined_b, ends_b) = _spelled(self.tok.table_a, a), _spelled(self.tok.table_b, b)
        from_a, from_b = np.concatenate(([0], np.cumsum(n_a))), np.concatenate(([0], np.cumsum(n_b)))
        bytes_a, bytes_b = (np.concatenate(([0], e))[f] for e, f in ((ends_a, from_a), (ends_b, from_b)))
        good = _same(joined_a, bytes_a, wanted, where) & _same(joined_b, bytes_b, wanted, where) & (np.diff(where) > 1)
        # tokens of the texts that stay; then both rows spell the same bytes, with the same ends of texts
        keep_a, keep_b = np.repeat(good, n_a), np.repeat(good, n_b)
        a, b, n_a, n_b = a[keep_a], b[keep_b], n_a * good, n_b * good
        ends_a, ends_b = np.cumsum(self.tok.table_a[2][a]), np.cumsum(self.tok.table_b[2][b])
        at_a, at_b = _shared(ends_a, ends_b)
        next_a, next_b = np.append(self.tok.table_a[3][a][1:], True), np.append(self.tok.table_b[3][b][1:], True)
        last = np.zeros(len(a) + 1, bool)
        last[np.cumsum(n_a)[n_a > 0] - 1] = True  # a text's end is an anchor
        anchor = (next_a[at_a] & next_b[at_b]) | last[at_a]
        cut_a, cut_b = at_a[anchor] + 1, at_b[anchor] + 1
        each_a, each_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
        # one key for each window: number of A's ids, then both sides' ids
        size = each_a + each_b + 1
        begin = np.cumsum(size) - size
        keys = np.empty(int(size.sum()), np.uint32)
        keys[begin] = each_a
        keys[np.repeat(begin + 1 - (cut_a - each_a), each_a) + np.arange(len(a))] = a
        keys[np.repeat(begin + 1 + each_a - (cut_b - each_b), each_b) + np.arange(len(b))] = b
        offsets = np.append(begin, len(keys)).astype(np.int64) * 4
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(keys)]).dictionary_encode()
        codes = column.indices.to_numpy()
        distinct = column.dictionary.to_pylist()
        new = [k for k in distinct if k not in self.known]
        if new:
            self._learn(new)
        number = np.array([self.known[k] for k in distinct], np.int64)
        strings, groups, fan, flat = [self.texts[k] for k in number.tolist()], self.groups[number], self.fan[number], self.flat
        from_ = (np.cumsum(self.fan) - self.fan)[number]
        bounds = np.concatenate(([0], np.searchsorted(cut_a, np.cumsum(n_a), side="right")))
        out = []
        for i in range(len(texts)):
            if not good[i]:
                out.append((0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)))
                continue
            own = codes[bounds[i]:bounds[i + 1]]
            seen, times = np.unique(own, return_counts=True)
            take = np.repeat(from_[seen] - (np.cumsum(fan[seen]) - fan[seen]), fan[seen])
            take += np.arange(len(take))
            pairs, back = np.unique(flat[take], return_inverse=True)
            many = np.bincount(back, weights=np.repeat(times, fan[seen]), minlength=len(pairs)).astype(np.int64)
            text = ";".join([strings[c] for c in own.tolist()])
            out.append((int(n_a[i]), int(n_b[i]), int(groups[own].sum()), hashlib.sha256(text.encode()).hexdigest(), pairs, many))
        return out


_CHUNK_ROW = "chunk long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places binary, many binary, pairs binary, held binary"


def _chunks(path_a: str, path_b: str):
    """One row per document; the first row of a chunk also has the chunk's
    distinct pairs and in how many of its documents each is linked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = Aligner(Tokenizers(path_a, path_b)), TaskContext.get().partitionId() << 32
        for batch in batches:
            column = batch.column("text")
            _, at = W.text_bytes(column)
            i = 0
            while i < len(batch):
                j = max(i + 1, int(np.searchsorted(at, at[i] + _CHUNK, side="right")) - 1)
                found, k = [], i
                while k < j:
                    stop = min(j, max(k + 1, int(np.searchsorted(at, at[k] + _CALL, side="right")) - 1))
                    found += aligner.align([t or "" for t in column.slice(k, stop - k).to_pylist()])
                    k = stop
                n_a, n_b, groups, sha, pairs, many = (list(x) for x in zip(*found))
                distinct, places, held = np.unique(np.concatenate(pairs), return_inverse=True, return_counts=True)
                cuts = np.cumsum([len(p) for p in pairs])[:-1]
                first = [True] + [False] * (j - i - 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array([number] * (j - i), pa.int64()), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()),
                     pa.array(groups, pa.int64()), pa.array([int(m.sum()) for m in many], pa.int64()), pa.array(sha, pa.string()),
                     pa.array([p.astype(np.uint32).tobytes() for p in np.split(places, cuts)], pa.binary()),
                     pa.array([m.astype(np.uint32).tobytes() for m in many], pa.binary()),
                     pa.array([distinct.tobytes() if f else None for f in first], pa.binary()),
                     pa.array([held.astype(np.int64).tobytes() if f else None for f in first], pa.binary())],
                    ["doc_id", "chunk", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "many", "pairs", "held"])
                number += 1
                i = j
    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each pair of each chunk."""
    for batch in batches:
        for chunk, pairs, held in zip(*(batch.column(c).to_pylist() for c in ("chunk", "pairs", "held"))):
            ids = np.frombuffer(pairs, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), chunk)), pa.array(ids), pa.array(np.frombuffer(held, np.int64))],
                                             ["chunk", "pair", "held"])


def _measured(names: list[str]):
    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        """Documents of one chunk with the counts of their links."""
        pairs, count, best = (answers.column(c).to_numpy() for c in ("pair", "n", "best"))
        order = np.argsort(pairs)
        count, best = count[order], best[order].astype(np.int64)
        total, top = [], []
        for places, many in zip(docs.column("places").to_pylist(), docs.column("many").to_pylist()):
            at, times = np.frombuffer(places, np.uint32), np.frombuffer(many, np.uint32).astype(np.int64)
            total.append(int((count[at] * times).sum()))
            top.append(int((best[at] * times).sum()))
        out = {c: docs.column(c) for c in names}
        return pa.table(out | {"n_best": pa.array(top, pa.int64()), "count_sum": pa.array(total, pa.int64())})
    return run


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``
    of every document."""
    ship_package(docs.sparkSession)
    own = own_names(docs, {"doc_id": id_col, "text": text_col}).withColumn("text", F.col("text").cast("string"))
    kind = own.schema["doc_id"].dataType.simpleString()
    rows = stored(own.mapInArrow(_chunks(path_a, path_b), f"doc_id {kind}, {_CHUNK_ROW}"), "alignments")
    asked = (rows.where("pairs is not null").select("chunk", "pairs", "held")
             .mapInArrow(_unpacked, "chunk long, pair long, held long"))
    counts = asked.groupBy("pair").agg(F.sum("held").alias("n"))
    most = counts.groupBy(F.shiftright("pair", _PAIR).alias("_a")).agg(F.max("n").alias("_most"))
    judged = (counts.join(most, F.shiftright("pair", _PAIR) == F.col("_a"))
              .select("pair", "n", (F.col("n") == F.col("_most")).alias("best")))
    answers = asked.select("chunk", "pair").join(judged, "pair")
    plain = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    out = (rows.select(*plain, "chunk", "places", "many").groupBy("chunk").cogroup(answers.groupBy("chunk"))
           .applyInArrow(_measured(plain), f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                         "n_best long, count_sum long"))
    return out.select(F.col("doc_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def links(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The alignment table of the corpus: ``a_id, b_id, docs`` of every linked id pair."""
    ship_package(docs.sparkSession)
    own = own_names(docs, {"doc_id": id_col, "text": text_col}).withColumn("text", F.col("text").cast("string"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return (own.mapInArrow(_chunks(path_a, path_b), f"doc_id {kind}, {_CHUNK_ROW}").where("pairs is not null").select("chunk", "pairs", "held")
            .mapInArrow(_unpacked, "chunk long, pair long, held long").groupBy("pair").agg(F.sum("held").alias("docs"))
            .select(F.shiftright("pair", _PAIR).cast("int").alias("a_id"), F.col("pair").bitwiseAND((1 << _PAIR) - 1).cast("int").alias("b_id"), "docs"))
