"""Chat formatting with a loss mask aligned to token offsets."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The control strings of the template. A turn is START role MIDDLE text STOP.
START, MIDDLE, STOP = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
VOCABULARY = "byte_bpe_50k.json"

_OPENING = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<(\\*)\\\|")

FORMATTED = ("conv struct<id:{id}>, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>")


def escape(text: str) -> str:
    """No control string can occur in the result: a backslash is put between ``<`` and ``|``, one more where some are there."""
    return _OPENING.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _tokenizer(path: str):
    from tokenizers import Tokenizer, processors

    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_special_tokens([START, MIDDLE, STOP])   # never part of another token, so texts are encoded on their own
    tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
    return tokenizer


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the span (code points) of the text of each turn."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = START + escape(role) + MIDDLE, escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, STOP)
        at = spans[-1][1] + len(STOP)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out = []
    for turn in formatted.split(START)[1:]:
        role, _, rest = turn.partition(MIDDLE)
        out.append((unescape(role), unescape(rest[:-len(STOP)])))
    return out


def align(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens lie in one of the sorted spans, by binary search over the sorted token offsets."""
    mask = np.zeros(len(starts), bool)
    for begin, stop in spans:
        if begin < stop:
            mask[np.searchsorted(ends, begin, "right"):np.searchsorted(starts, stop, "left")] = True
    return mask


def masked_text(formatted: str, starts, ends, loss) -> str:
    """All characters of the masked tokens, each once, as they stand in the formatted text."""
    pieces, at = [], 0
    for begin, stop in zip(np.asarray(starts)[loss].tolist(), np.asarray(ends)[loss].tolist()):
        begin = max(begin, at)   # tokens that hold parts of one character share its offsets
        if stop > begin:
            pieces.append(formatted[begin:stop])
            at = stop
    return "".join(pieces)


def learned_text(formatted: str, starts, ends, loss) -> str:
    """The original text under the mask: each turn is unescaped on its own, as a ``<`` that ends one and a ``\\|`` that begins the
    next are no escape."""
    starts, ends, loss = np.asarray(starts), np.asarray(ends), np.asarray(loss, bool)
    # Turns begin at a control string, which no masked token touches; each is read from its own tokens.
    edges = np.searchsorted(starts, [m.start() for m in re.finditer(re.escape(START), formatted)]).tolist()
    turns = zip(edges, [*edges[1:], len(starts)])
    return "".join(unescape(masked_text(formatted, starts[i:j], ends[i:j], loss[i:j])) for i, j in turns if loss[i:j].any())


def format_chats(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", learn: tuple[str, ...] = ("assistant",), vocabulary: str | None = None) -> DataFrame:
    """One row per conversation: (id, formatted, ids, starts, ends, loss).

    A conversation is rendered whole and encoded once; ``starts`` and ``ends`` are the code-point offsets of its tokens and
    ``loss`` marks those inside texts of the roles to learn. Control strings are single ids that no other token crosses.

    Turns are in order of ``turn_col``, nulls first, ties by role and text; repeated rows are repeated turns. A null role or
    text is empty, and an empty text adds no loss. Rows with a null id form one conversation. Extra columns are ignored; an
    empty table gives an empty result. Rows are sorted by conversation, and a task holds one conversation at a time, which
    is the size of a row that it returns.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(vocabulary)

        def finish(ready: list) -> pa.RecordBatch:
            rendered = [render(turns) for _, turns in ready]
            rows = []
            for (_, turns), (text, spans), code in zip(ready, rendered, tokenizer.encode_batch([r[0] for r in rendered], add_special_tokens=False)):
                offsets = np.array(code.offsets, np.int32).reshape(-1, 2)
                loss = align(offsets[:, 0], offsets[:, 1], [s for s, (role, _) in zip(spans, turns) if role in learn])
                rows.append((text, code.ids, offsets[:, 0], offsets[:, 1], loss))
            conv = pa.StructArray.from_arrays([pa.array([c[0] for c in ready], id_arrow)], names=["id"])
            kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_()))
            return pa.RecordBatch.from_arrays([conv, *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]],
                                              names=["conv", "formatted", "ids", "starts", "ends", "loss"])

        ready, current, turns, size, id_arrow = [], None, [], 0, None
        for batch in batches:
            id_arrow = batch.schema.field(0).type
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                if current is None or current[0] != conv:
                    if current is not None:
                        ready.append((current[0], turns))
                        if size > 1 << 18 or len(ready) >= 256:
                            yield finish(ready)
                            ready, size = [], 0
                    current, turns = (conv,), []
                turns.append((role or "", text or ""))
                size += len(turns[-1][1])
        if current is not None:
            ready.append((current[0], turns))
            yield finish(ready)

    sorted_turns = (df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{turn_col}`").alias("turn"),
                              F.col(f"`{role_col}`").cast("string").alias("role"), F.col(f"`{text_col}`").cast("string").alias("text"))
                    .repartition("id").sortWithinPartitions("id", "turn", "role", "text"))
    return sorted_turns.mapInArrow(run, FORMATTED.format(id=id_type)).select("conv.id", "formatted", "ids", "starts", "ends", "loss")


def digests(chats: DataFrame, id_name: str) -> DataFrame:
    """What a reader gets back from formatted conversations: turns, and the text under the loss mask."""
    id_type = chats.schema["id"].dataType.simpleString()
    schema = f"c struct<id:{id_type}>, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                text, starts, ends, loss = (batch.column(c)[k] for c in (1, 2, 3, 4))
                text = text.as_py()
                turns = parse(text)
                under = learned_text(text, starts.values.to_numpy(), ends.values.to_numpy(), loss.values.to_numpy(zero_copy_only=False))
                rows.append((len(turns), sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(under),
                             sha256(under.encode()).hexdigest(), len(text)))
            conv = pa.StructArray.from_arrays([batch.column(0)], names=["id"])
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([conv, *[pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]],
                                             names=["c", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return chats.select("id", "formatted", "starts", "ends", "loss").mapInArrow(run, schema).select(
        F.col("c.id").alias(id_name), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
