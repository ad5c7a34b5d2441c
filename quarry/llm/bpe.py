"""BPE encoding and decoding with word-end symbols.

The corpus is encoded batch by batch in the tasks that scan it; nothing is
shuffled. Inside a task the distinct words of a batch are encoded together:
the symbols of all of them lie in one flat array, the pairs that can merge are
found by binary search over the sorted pair keys, and each round merges the
lowest-ranked pair of every word at once.

What is broadcast is the tokenizer: its size is that of the vocabulary file
and does not depend on the corpus.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quarry.llm.common import slices, texts

_NO_RANK = np.iinfo(np.int32).max
#: Words encoded together, words remembered by a task, and bytes of text per
#: output batch: memory bounds only, results do not depend on them.
WORDS_AT_ONCE = 50_000
WORDS_KEPT = 300_000
BATCH_BYTES = 8 << 20

_SPACE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_ODD_SPACE = regex.compile(r"[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level BPE:
    printable Latin-1 bytes stand for themselves, the others are numbered from
    256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordBpe:
    """A byte-level BPE with word ends, read from a ``tokenizers`` JSON file.

    Normalisation is NFC, white space to one space, lower case; a word is a
    match of the file's split pattern.
    """

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.breaks = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        size = 1 + max(chain(vocab.values(), self.special.values()))
        self.token = np.full(size, "", dtype=object)
        for text, i in chain(vocab.items(), self.special.items()):
            self.token[i] = text
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.final = np.array([vocab[s + end] for s in symbols], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys = key[order]
        self.ranks = order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)[order]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair and the symbol that it becomes."""
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NO_RANK), self.merged[at]

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Token ids of each (normalised, non-empty) word, all words at once."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        sym = self.inner[flat]
        last = np.cumsum(size) - 1
        sym[last] = self.final[flat[last]]
        word = np.repeat(np.arange(len(raw)), size)
        rank = np.full(len(sym), _NO_RANK, np.int32)
        into = np.zeros(len(sym), np.int32)
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside], into[inside] = self._rank(sym[inside], sym[inside + 1])
        done_sym, done_word = [], []
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            length = np.diff(np.r_[first, len(sym)])
            lowest = np.repeat(np.minimum.reduceat(rank, first), length)
            live = lowest < _NO_RANK
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, rank, into, lowest = (x[live] for x in (sym, word, rank, into, lowest))
                if not len(sym):
                    break
            pick = rank == lowest
            # of overlapping equal pairs ("aaa") every second one merges, from the left
            if (pick[1:] & pick[:-1]).any():
                at = np.arange(len(pick))
                run = at - np.maximum.accumulate(np.where(pick, -1, at))
                pick &= run % 2 == 1
            chosen = np.flatnonzero(pick)
            sym[chosen] = into[chosen]
            gone = np.zeros(len(sym), bool)
            gone[chosen + 1] = True
            at = chosen - np.cumsum(gone)[chosen]
            sym, word, rank, into = (x[~gone] for x in (sym, word, rank, into))
            again = np.unique(np.r_[at, at[at > 0] - 1])
            ends = (again == len(sym) - 1) | (word[again] != word[np.minimum(again + 1, len(sym) - 1)])
            rank[again[ends]] = _NO_RANK
            again = again[~ends]
            rank[again], into[again] = self._rank(sym[again], sym[again + 1])
        if not done_sym:
            return []
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return np.split(sym[order], np.cumsum(np.bincount(word, minlength=len(raw)))[:-1])

    def split_words(self, chunk: str) -> list[str]:
        """The normalised words of a chunk without white space."""
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
        return self.words.findall(chunk.lower())

    def decode(self, ids) -> str:
        """Token texts joined by one space, special tokens included."""
        return " ".join(self.token[ids].tolist())


class Encoder:
    """Encodes texts, remembering the chunks (words between white space) seen."""

    def __init__(self, model: WordBpe):
        self.model = model
        self.known: dict[str, bytes] = {}

    def _learn(self, chunks: set[str]) -> None:
        new = [c for c in chunks if c not in self.known]
        if len(self.known) + len(new) > WORDS_KEPT:
            self.known = {c: self.known[c] for c in chunks if c in self.known}
        split = [self.model.split_words(c) for c in new]
        words = list(dict.fromkeys(chain.from_iterable(split)))
        ids: dict[str, bytes] = {}
        for i in range(0, len(words), WORDS_AT_ONCE):
            part = words[i : i + WORDS_AT_ONCE]
            ids.update(zip(part, (x.tobytes() for x in self.model.encode_words(part))))
        self.known.update((c, b"".join([ids[w] for w in ws])) for c, ws in zip(new, split))

    def _chunks(self, text: str) -> list[str | int]:
        """Words between white space; a special token's id where one stands."""
        space = (lambda s: s.split()) if not _ODD_SPACE.search(text) else (lambda s: [x for x in _SPACE.split(s) if x])
        if self.model.breaks is None or not any(s in text for s in self.model.special):
            return space(text)
        out: list[str | int] = []
        for part in self.model.breaks.split(text):
            out += [self.model.special[part]] if part in self.model.special else space(part)
        return out

    def encode(self, batch: list[str]) -> list[bytes]:
        """Token ids of each text as little-endian 32-bit integers."""
        chunks = [self._chunks(t) for t in batch]
        self._learn({c for doc in chunks for c in doc if isinstance(c, str)})
        known = self.known
        return [
            b"".join([known[c] if isinstance(c, str) else c.to_bytes(4, "little") for c in doc])
            if any(isinstance(c, int) for c in doc)
            else b"".join([known[c] for c in doc])
            for doc in chunks
        ]


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` (array of int) and ``decoded`` (the ids' token texts
    joined by one space) of every document, as the ``tokenizers`` library gives
    them without added special tokens.

    NULL and empty texts, and texts of white space, give an empty array and an
    empty string. Repeated rows and ids (also NULL) keep one row each.
    """
    src = texts(docs, id_col, text_col)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = src.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(WordBpe(spec.value))
        for whole in batches:
            for batch in slices(whole, BATCH_BYTES):
                coded = encoder.encode(batch.column(1).to_pylist())
                ids = [np.frombuffer(b, "<i4") for b in coded]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(coded), "<i4"), pa.int32())),
                        pa.array([encoder.model.decode(x) for x in ids], pa.string()),
                    ],
                    names=["doc_id", "ids", "decoded"],
                )

    return src.mapInArrow(run, "doc_id long, ids array<int>, decoded string")
