"""Chat formatting by token-level assembly.

Each role and text is encoded on its own, as ordinary text; reserved ids beyond the
vocabulary are spliced in between: TURN role TEXT text END. So no text can make a control
token. The loss mask is a prefix sum over +1 at the first token of an assistant's text and
-1 at its END. Control strings that occur in roles or texts are escaped as well (a
backslash after their first character, backslashes doubled), so that the rendered string
stays unambiguous too; unescaping gives the text back.

Output is one row for each turn, with the tokens' offset in the conversation: a long
conversation is never one row, and a partition is streamed in the order of its turns.

Edge cases: null role and null text are empty; rows without conv_id are one conversation;
equal turns of a conversation are all kept, ordered by role and text; null turns come
first; other columns are not read; an empty table gives an empty result. The tokenizer's
file is a parameter and must be at the same path on all executors.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Ranks of a byte-level BPE; any text is encoded and decoded without loss.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Template strings; each has a reserved id.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# Control strings of common chat templates, escaped wherever they occur in content.
CONTROL = (
    TURN, TEXT, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>",
    "<|eot_id|>", "<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<s>", "</s>", "<unk>", "<pad>", "[INST]",
    "[/INST]", "<<SYS>>", "<</SYS>>",
)
_ESCAPE = re.compile("|".join(map(re.escape, (*CONTROL, "\\"))))
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


class Encoder:
    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.base = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        n = max(ranks.values()) + 1
        self.turn, self.text, self.end = n, n + 1, n + 2
        self.control = {self.turn: TURN, self.text: TEXT, self.end: END}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.base.encode_ordinary_batch(texts, num_threads=1)

    def decode(self, ids: list[int]) -> str:
        return self.base.decode_bytes(ids).decode()


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def assemble(e: Encoder, role: list[int], text: list[int], loss: bool) -> tuple[np.ndarray, np.ndarray]:
    """(ids, loss mask) of one turn."""
    ids = np.array([e.turn, *role, e.text, *text, e.end], np.int32)
    step = np.zeros(len(ids), np.int8)
    if loss:
        step[len(role) + 2] += 1
        step[-1] -= 1
    return ids, np.cumsum(step, dtype=np.int8).astype(bool)


def format_turns(conversations: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(conv_id, turn, start, ids, loss), sorted by conversation and turn within each partition.

    start: tokens of the conversation before this turn.
    """
    conv, turn = (conversations.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, current, start, any_yet = encoder(tokenizer), None, 0, False
        for b in batches:
            roles = [x or "" for x in b.column(2).to_pylist()]
            texts = [x or "" for x in b.column(3).to_pylist()]
            role_ids, text_ids = e.encode(list(map(escape, roles))), e.encode(list(map(escape, texts)))
            starts, ids, loss = [], [], []
            for c, role, r, t in zip(b.column(0).to_pylist(), roles, role_ids, text_ids):
                if not any_yet or c != current:
                    current, start, any_yet = c, 0, True
                i, m = assemble(e, r, t, role == LOSS_ROLE)
                starts.append(start)
                ids.append(i)
                loss.append(m)
                start += len(i)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(starts, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(loss, pa.list_(pa.bool_()))],
                ["conv_id", "turn", "start", "ids", "loss"],
            )

    return (
        conversations.select("conv_id", "turn", "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .mapInArrow(run, f"conv_id {conv}, turn {turn}, start bigint, ids array<int>, loss array<boolean>")
    )


def read_back(e: Encoder, ids: np.ndarray, loss: np.ndarray) -> tuple[str, str, str, str]:
    """(role, text, text under the mask, rendered string) of one turn, from its tokens alone."""
    if ids[0] != e.turn or ids[-1] != e.end:
        raise ValueError("not a turn")
    cut = int(np.flatnonzero(ids == e.text)[0])
    role, text = e.decode(ids[1:cut].tolist()), e.decode(ids[cut + 1 : -1].tolist())
    masked = e.decode(ids[loss].tolist()) if loss.any() else ""
    return unescape(role), unescape(text), unescape(masked), f"{TURN}{role}{TEXT}{text}{END}"


def digest(turns: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row for each conversation, from the output of format_turns, in bounded memory."""
    conv = turns.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, state = encoder(tokenizer), None

        def row(s):
            return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]

        kind = None
        for b in batches:
            kind, done = b.schema.field(0).type, []
            for c, ids, loss in zip(b.column(0), b.column(1), b.column(2)):
                c = c.as_py()
                if state is None or c != state[0]:
                    if state is not None:
                        done.append(row(state))
                    state = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, masked, shown = read_back(
                    e, ids.values.to_numpy(), loss.values.to_numpy(zero_copy_only=False)
                )
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(masked)
                state[4].update(masked.encode())
                state[5] += len(shown)
            if done:
                yield _batch(done, kind, names)
        if state is not None:
            yield _batch([row(state)], kind, names)

    return turns.select("conv_id", "ids", "loss").mapInArrow(
        run, f"conv_id {conv}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )


def _batch(rows: list[tuple], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
