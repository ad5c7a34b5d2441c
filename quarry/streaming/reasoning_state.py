"""The state of X1: one response's place, flag, lengths and early tokens.

Spark also starts a stateful processor in a process that does not get the
shipped package, so this module is pickled by value and imports nothing of the
library.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

HEAD_SCHEMA = "next_seq long, flag boolean, thinking_len long, final_len long, n_early long"
#: Time for which the place in a response is kept after its last token.
KEEP_MS = 7 * 86_400_000
#: Early tokens that are read together, besides as many as the batch has tokens.
READ_AT_ONCE = 64


def rows_of(response_id, ready: dict[int, str], flag: bool, n_think: int, n_final: int, tags: tuple[str, str]) -> pd.DataFrame:
    """What each of the ordered chunks adds to either part, the running lengths
    and the flag after it, given those before the first: W3's columns. Plain
    loops: a response has few tokens in a batch."""
    thinking, final, n_thinking, n_finals, flags = [], [], [], [], []
    for chunk in ready.values():
        sides = chunk.replace(tags[0], "").split(tags[1])
        inside = flag or tags[0] in chunk
        think, last = (sides[0], sides[1]) if len(sides) > 1 else (sides[0], "") if inside else ("", sides[0])
        flag = inside and len(sides) == 1
        n_think, n_final = n_think + len(think), n_final + len(last)
        for column, value in zip((thinking, final, n_thinking, n_finals, flags), (think, last, n_think, n_final, flag)):
            column.append(value)
    return pd.DataFrame({"response_id": response_id, "seq": list(ready), "thinking_delta": thinking, "final_delta": final,
                         "thinking_len": n_thinking, "final_len": n_finals, "is_thinking": flags})


class Reasoning(StatefulProcessor):
    def __init__(self, idle_ms: int | None, tags: tuple[str, str]):
        self.idle_ms, self.tags = idle_ms, tags

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = KEEP_MS if self.idle_ms else None
        self.head = handle.getValueState("head", HEAD_SCHEMA, ttl)
        self.early = handle.getMapState("early", "seq long", "chunk string", ttl)

    def _take(self, seq: int) -> str:
        chunk = self.early.getValue((seq,))[0]
        self.early.removeKey((seq,))
        return chunk

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        following, flag, n_think, n_final, n_early = self.head.get() or (0, False, 0, 0, 0)
        new: dict[int, str] = {}
        for pdf in rows:
            pdf = pdf[pdf.seq >= following]
            new.update(zip(pdf.seq.tolist(), pdf.chunk.fillna("").tolist()))
        ready: dict[int, str] = {}
        # a call to the state is a round trip: early tokens that are few beside the batch are read in one
        known = {s[0]: c[0] for s, c in self.early.iterator()} if 0 < n_early <= len(new) + READ_AT_ONCE else None
        is_early = known.__contains__ if known is not None else lambda seq: self.early.containsKey((seq,))
        taken = []
        while True:
            waits = n_early > 0 and is_early(following)
            if not waits and following not in new:
                break
            waiting = None
            if waits:
                n_early -= 1
                waiting = self._take(following) if known is None else known.pop(following)
                taken.append(following)
            ready[following] = new.pop(following, waiting)
            following += 1
        if known is not None and taken:
            if n_early:
                for seq in taken:
                    self.early.removeKey((seq,))
            else:
                self.early.clear()
        for seq, chunk in new.items():
            n_early += n_early == 0 or not is_early(seq)
            self.early.updateValue((seq,), (chunk,))
        if ready:
            out = rows_of(key[0], ready, flag, n_think, n_final, self.tags)
            n_think, n_final, flag = (out[c].iloc[-1].item() for c in ("thinking_len", "final_len", "is_thinking"))
        self.head.update((following, flag, n_think, n_final, n_early))
        if self.idle_ms:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        if ready:
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        following, flag, n_think, n_final, n_early = self.head.get() or (0, False, 0, 0, 0)
        if n_early:
            waiting = dict(sorted((s[0], c[0]) for s, c in self.early.iterator()))
            out = rows_of(key[0], waiting, flag, n_think, n_final, self.tags)
            last = out.iloc[-1]
            self.early.clear()
            self.head.update((int(last.seq) + 1, bool(last.is_thinking), int(last.thinking_len), int(last.final_len), 0))
            yield out

    def close(self) -> None:
        pass
