"""Chat formatting by tokens: turns with control ids between separately encoded texts, and their loss mask.

A turn is control, text, control (a role without a form of its own is written out in one more pair).
Texts are encoded alone, so no id spans a text's border; control strings are reserved ids after the
vocabulary.  Where a text holds a control string, with any number of backslashes after its first
character, one more backslash is put there; reading takes one away, so any text comes back.  Segment
lengths add up to offsets, and the loss mask is the ranges of the assistants' texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.textbytes import id_array, ids_of

#: Opening and closing control strings of the roles; any other role is written between the last two pairs.
FORMS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("[SYS]", "[/SYS]")}
ROLE, TEXT = ("[ROLE]", "[/ROLE]"), ("[TEXT]", "[/TEXT]")
CONTROLS = [x for pair in (*FORMS.values(), ROLE, TEXT) for x in pair]
LOSS_ROLE = "assistant"

_RESTS = "|".join(re.escape(x[1:]) for x in CONTROLS)
_ESCAPE = re.compile(rf"([<\[])(\\*)({_RESTS})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)({_RESTS})")
_SPLIT = re.compile("|".join(map(re.escape, CONTROLS)))


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def segments(role: str, text: str) -> list[tuple[str, bool]]:
    """(string, is control) parts of a turn; the text is the last but one."""
    if role in FORMS:
        left, right = FORMS[role]
        return [(left, True), (escape(text), False), (right, True)]
    return [(ROLE[0], True), (escape(role), False), (ROLE[1], True), (TEXT[0], True), (escape(text), False), (TEXT[1], True)]


def parsed(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted string."""
    marks = [(m.group(), m.start(), m.end()) for m in _SPLIT.finditer(formatted)]
    role = None
    opening = {left: name for name, (left, _) in FORMS.items()}
    for (left, _, start), (_, end, _) in zip(marks[::2], marks[1::2]):
        text = unescape(formatted[start:end])
        if left == ROLE[0]:
            role = text
        else:
            yield opening[left] if left in opening else role, text


def tokenizer_of(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are text
    return tokenizer


def format_turns(turns: DataFrame, tokenizer_path: str, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn: conv_id, turn, role, formatted, ids (32-bit little-endian), and loss_from, loss_to.

    The ids from loss_from to loss_to are under the loss mask.  Null roles and texts are empty; a null
    conv_id is a conversation of its own, a null turn comes first.  Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(tokenizer_path)
        reserved = {x: tokenizer.get_vocab_size() + k for k, x in enumerate(CONTROLS)}
        for batch in batches:
            roles, texts = (["" if x is None else x for x in batch.column(c).to_pylist()] for c in (2, 3))
            parts = [segments(r, t) for r, t in zip(roles, texts)]
            plain = [s for turn in parts for s, control in turn if not control]
            encoded = iter(tokenizer.encode_batch(plain, add_special_tokens=False))
            ids, low, high = [], [], []
            for r, turn_parts in zip(roles, parts):
                line = [[reserved[s]] if control else next(encoded).ids for s, control in turn_parts]
                ends = np.cumsum([len(x) for x in line])
                ids.append(np.array([x for part in line for x in part], "<i4").tobytes())
                low.append(int(ends[-3]) if r == LOSS_ROLE else 0)
                high.append(int(ends[-2]) if r == LOSS_ROLE else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(roles, pa.string()), pa.array(["".join(s for s, _ in x) for x in parts], pa.string()), pa.array(ids, pa.binary()), pa.array(low, pa.int64()), pa.array(high, pa.int64())],
                ["conv_id", "turn", "role", "formatted", "ids", "loss_from", "loss_to"],
            )

    rows = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "conv_id long, turn long, role string, formatted string, ids binary, loss_from long, loss_to long")


def digests(formatted: DataFrame, tokenizer_path: str) -> DataFrame:
    """What each conversation says when it is read back from its formatted turns.

    Turns come in order of turn, then formatted text; a conversation streams through its task, so its
    length is not bounded by memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(tokenizer_path)
        now, state, out = object(), None, []

        def closed() -> list:
            return [now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

        def emit() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([id_array(np.array(columns[0], np.int64)), *(pa.array(list(c), t) for c, t in zip(columns[1:], kinds))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            ids, low, high = batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist()
            masked = iter(tokenizer.decode_batch([np.frombuffer(ids[k].as_buffer(), "<i4")[low[k] : high[k]].tolist() for k in range(batch.num_rows) if high[k] > low[k]], skip_special_tokens=False))
            for k, (conv, formatted) in enumerate(zip(ids_of(batch.column(0)).tolist(), batch.column(1).to_pylist())):
                if conv != now:
                    if state:
                        out.append(closed())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parsed(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if high[k] > low[k]:
                    text = unescape(next(masked))
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(formatted)
            yield emit()
            out = []
        if state:
            out.append(closed())
            yield emit()

    ordered = formatted.select("conv_id", "formatted", "ids", "loss_from", "loss_to", "turn").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted").drop("turn")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
