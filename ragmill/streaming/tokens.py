"""Decoding byte tokens that are cut by the edges of streamed chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ragmill.functions.text import decode_bytes_text

#: A byte token that may still grow, and whole tokens before it.
CUT = re.compile(r"<(?:0(?:x[0-9A-Fa-f]{0,2})?)?\Z")
TOKEN = re.compile(r"<0x([0-9A-Fa-f]{2})>\Z")
OUTPUT = "stream_id string, seq bigint, text string"
STATE = "held string"


def unfinished(text: str) -> int:
    """Where a character begins at the end of ``text`` that a later chunk may complete.

    A cut token is held, and of the whole tokens before it at most three: those that begin a character of more bytes
    than have come. Text that ends in anything else is finished.
    """
    cut = CUT.search(text)
    stop = cut.start() if cut else len(text)
    begin, seen = stop, 0
    while seen < 3 and (token := TOKEN.search(text, max(begin - 6, 0), begin)):
        begin, seen = token.start(), seen + 1
        byte = int(token[1], 16)
        if byte >= 0xC0:
            wanted = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
            return begin if wanted > seen else stop
        if byte < 0x80:
            break
    return stop


def push(held: str, chunk: str) -> tuple[str, str]:
    """(decoded, held): what is complete, and the beginning of a character at the end."""
    text = held + chunk
    at = unfinished(text)
    return decode_bytes_text(text[:at]), text[at:]


def decode_stream(chunks: DataFrame, expire_ms: int | None = None) -> DataFrame:
    """Chunks (stream_id, seq, chunk, last) of a stream, decoded in order.

    One model answer is one key: its chunks depend on each other and arrive in order. Only answers with an unfinished
    character have a state; it goes with the last chunk. A continuous job sets ``expire_ms`` to give up on answers
    that never end: what was held then comes out with no ``seq``. A run that stops at the end of its input must not
    set it, as a waiting timeout keeps it going.
    """

    def decode(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (held,) = state.get if state.exists else ("",)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], None, decode_bytes_text(held))], columns=["stream_id", "seq", "text"])
            return
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for seq, chunk, last in zip(rows["seq"], rows["chunk"], rows["last"]):
            text, held = push(held, chunk or "")
            if last:
                text, held = text + decode_bytes_text(held), ""
            out.append((key[0], int(seq), text))
        if held:
            state.update((held,))
            if expire_ms:
                state.setTimeoutDuration(expire_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["stream_id", "seq", "text"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if expire_ms else GroupStateTimeout.NoTimeout
    return chunks.groupBy("stream_id").applyInPandasWithState(
        decode, outputStructType=OUTPUT, stateStructType=STATE, outputMode="append", timeoutConf=timeout
    )
