"""Chat formatting by token-level assembly.

Every turn is encoded on its own, in segments: role and content go through the
tokenizer, the marks around them are reserved ids behind its vocabulary:

    HEAD role SEP content END        "### " role ": " content " </turn>\\n"

Control strings inside roles and contents are escaped reversibly, so that text
cannot pass for a mark in the string form either: ``\\`` becomes ``\\\\``, and a
backslash is put into ``###`` and ``</turn>`` behind their first character, in
roles before each ``:`` too (the first bare one ends the role). The
loss mask is the prefix sum of +1 where an assistant's content begins and -1
where it ends; marks and roles are never under it.

Encoding, the costly part, runs where the rows lie. Then rows are shuffled by
conversation and sorted by turn, and read as a stream, so a conversation of any
length needs the memory of one batch only. (A digest over one conversation is
one task's work by nature; it only decodes and hashes.)

Defined results: null or empty text is an empty content, null role an empty
role; rows are ordered by turn (null first), role, text, so ties and repeated
rows stay, each as a turn; a null conversation id is a conversation of its own;
an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlab.llm.common import own_names
from answerlab.session import ship_package

# Fixed values of the template: reserved ids behind the vocabulary's size, and what they stand for.
HEAD, SEP, END = 0, 1, 2
MARKS = ("### ", ": ", " </turn>\n")
TRAINED_ROLE = "assistant"

_SEGMENTS = "conv_id {0}, turn {1}, role string, text string, ids binary, loss binary"


def escape(text: str) -> str:
    return re.sub(r"#(?=##)", r"#\\", text.replace("\\", "\\\\")).replace("</turn>", "<\\/turn>")


def escape_role(role: str) -> str:
    return escape(role).replace(":", "\\:")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


#: Characters that one call to the tokenizer takes (a longer text is one call).
_CALL = 1 << 20


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t, t.get_vocab_size(with_added_tokens=True)


def _slices(sizes: list[int]) -> Iterator[slice]:
    """Consecutive rows of about ``_CALL`` characters together."""
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        held += n
        if held >= _CALL:
            yield slice(begin, i + 1)
            begin, held = i + 1, 0
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, size = _tokenizer(path)
        for batch in batches:
            roles = [escape_role(x or "") for x in batch.column("role").to_pylist()]
            texts = [escape(x or "") for x in batch.column("text").to_pylist()]
            trained = [x == TRAINED_ROLE for x in batch.column("role").to_pylist()]
            known = {x: e.ids for x, e in zip(dict.fromkeys(roles), tok.encode_batch(list(dict.fromkeys(roles)), add_special_tokens=False))}
            ids, loss = [], []
            for part in _slices([len(x) for x in texts]):
                contents = tok.encode_batch_fast(texts[part], add_special_tokens=False)
                for role, yes, content in zip(roles[part], trained[part], contents):
                    head, body = [size + HEAD, *known[role], size + SEP], content.ids
                    turn = np.array([*head, *body, size + END], dtype="<i4")
                    delta = np.zeros(len(turn), dtype=np.int8)
                    if yes and body:
                        delta[len(head)] += 1
                        delta[-1] -= 1
                    ids.append(turn.tobytes())
                    loss.append(np.cumsum(delta, dtype=np.int8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), batch.column("role"), batch.column("text"),
                                              pa.array(ids, pa.binary()), pa.array(loss, pa.binary())],
                                             ["conv_id", "turn", "role", "text", "ids", "loss"])
    return run


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the turns and prefix-sum the tokens of each conversation over a
    sorted stream of rows."""
    last, turn_no, start = object(), 0, 0
    for batch in batches:
        convs, sizes = batch.column("conv_id").to_pylist(), [len(x) // 4 for x in batch.column("ids").to_pylist()]
        nos, starts = [], []
        for conv, n in zip(convs, sizes):
            if conv != last:
                last, turn_no, start = conv, 0, 0
            nos.append(turn_no)
            starts.append(start)
            turn_no, start = turn_no + 1, start + n
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(nos, pa.int64()), pa.array(starts, pa.int64()),
                                          batch.column("ids"), batch.column("loss")], ["conv_id", "turn_no", "start", "ids", "loss"])


def format_chats(convs: DataFrame, tokenizer_path: str, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: ``conv_id, turn_no`` (from 0), ``start`` (tokens of the
    conversation before it), ``ids`` (little-endian int32) and ``loss`` (one
    byte per token, 1 under the loss). A conversation's rows are consecutive and
    in order in one partition."""
    ship_package(convs.sparkSession)
    own = own_names(convs, {"conv_id": conv_col, "turn": turn_col, "role": role_col, "text": text_col})
    kinds = [own.schema[c].dataType.simpleString() for c in ("conv_id", "turn")]
    encoded = own.mapInArrow(_encode(tokenizer_path), _SEGMENTS.format(*kinds))
    ordered = encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return (ordered.select("conv_id", "ids", "loss")
            .mapInArrow(_place, f"conv_id {kinds[0]}, turn_no long, start long, ids binary, loss binary"))


def _read_back(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, size = _tokenizer(path)
        state: list = []  # conv, turns, digest, loss chars, loss digest, formatted chars

        def row(s):
            return {"conv_id": s[0], "n_turns": s[1], "turns_sha256": s[2].hexdigest(), "loss_chars": s[3],
                    "loss_sha256": s[4].hexdigest(), "formatted_chars": s[5]}

        schema = None
        for batch in batches:
            schema = pa.schema([batch.schema.field("conv_id"), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                                ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
            done, convs = [], batch.column("conv_id").to_pylist()
            packed, masks = batch.column("ids"), batch.column("loss")
            for part in _slices([x.as_buffer().size for x in masks]):
                parts = []
                for ids, loss in zip(packed[part].to_pylist(), masks[part].to_pylist()):
                    ids, loss = np.frombuffer(ids, "<i4"), np.frombuffer(loss, np.int8)
                    cuts = np.flatnonzero(ids >= size)  # HEAD, SEP, END in this order
                    if (ids[cuts] - size).tolist() != [HEAD, SEP, END] or cuts[0] != 0 or cuts[2] != len(ids) - 1:
                        raise ValueError("a turn's marks are not in place")
                    parts += [ids[1:cuts[1]].tolist(), ids[cuts[1] + 1:cuts[2]].tolist(), ids[loss > 0].tolist()]
                said = tok.decode_batch(parts, skip_special_tokens=False)
                for i, conv in enumerate(convs[part]):
                    if not state or conv != state[0]:
                        if state:
                            done.append(row(state))
                        state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    role, text, learnt = said[3 * i:3 * i + 3]
                    state[1] += 1
                    state[2].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                    state[3] += len(unescape(learnt))
                    state[4].update(unescape(learnt).encode())
                    state[5] += len(role) + len(text) + sum(map(len, MARKS))
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if state:
            yield pa.RecordBatch.from_pylist([row(state)], schema)
    return run


def read_back(formatted: DataFrame, tokenizer_path: str) -> DataFrame:
    """Digest of every conversation, from the ids and masks of
    :func:`format_chats` alone."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(_read_back(tokenizer_path), f"conv_id {kind}, n_turns long, turns_sha256 string, "
                                "loss_chars long, loss_sha256 string, formatted_chars long")


def formatted_text(formatted: DataFrame, tokenizer_path: str) -> DataFrame:
    """``conv_id, turn_no, formatted``: the string form of every turn."""
    def run(batches):
        tok, size = _tokenizer(tokenizer_path)
        for batch in batches:
            texts = []
            for ids in batch.column("ids").to_pylist():
                ids = np.frombuffer(ids, "<i4")
                cuts = np.flatnonzero(ids >= size)
                role, text = tok.decode_batch([ids[1:cuts[1]].tolist(), ids[cuts[1] + 1:cuts[2]].tolist()], skip_special_tokens=False)
                texts.append(f"{MARKS[HEAD]}{role}{MARKS[SEP]}{text}{MARKS[END]}")
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn_no"), pa.array(texts, pa.string())],
                                             ["conv_id", "turn_no", "formatted"])
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(run, f"conv_id {kind}, turn_no long, formatted string")


def with_probe(convs: DataFrame) -> DataFrame:
    """``convs`` (conv_id, turn, role, text) and conversation -7: a user and an
    assistant turn whose text is made of the template's control strings."""
    said = r"\### Assistant: </turn> ok"
    rows = F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"),
                              F.lit(role).alias("role"), F.lit(said).alias("text")) for i, role in enumerate(("user", "assistant"))])
    probe = convs.sparkSession.range(1).select(F.inline(rows))
    return convs.select("conv_id", "turn", "role", "text").unionByName(probe)
