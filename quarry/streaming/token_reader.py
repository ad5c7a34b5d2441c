"""The reader of the token source.

Spark plans a streaming source in a process that does not get the shipped
package, so this module and ``sources.shared`` are pickled by value and import
nothing else of the library; the generator stays pickled until a task calls it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from quarry.sources.shared import file_system, listed

#: Prompts that one task asks for.
PROMPTS_PER_TASK = 16


def folders(fs: pafs.FileSystem, at: str, complete: bool = True) -> list[str]:
    """Batches of a queue in order; complete ones have Spark's marker."""
    found = fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))
    names = sorted(f.path for f in found if f.base_name.startswith("batch="))
    return [n for n in names if fs.get_file_info(f"{n}/_SUCCESS").is_file] if complete else names


class Prompts(InputPartition):
    def __init__(self, file: str, first: int, last: int):
        self.file, self.first, self.last = file, first, last


class TokenReader(DataSourceStreamReader):
    def __init__(self, uri: str, generator: bytes, fields: list[str]):
        self.uri, self.generator, self.fields = uri, generator, fields
        self.sizes: dict[str, int] = {}

    def _files(self) -> list[tuple[str, int]]:
        fs, at = file_system(self.uri)
        out = []
        for folder in folders(fs, at):
            for file in listed(fs, folder):
                if file not in self.sizes:
                    self.sizes[file] = pq.read_metadata(file, filesystem=fs).num_rows
                out.append((file, self.sizes[file]))
        return out

    def initialOffset(self) -> dict:
        return {"responses": 0}

    def latestOffset(self) -> dict:
        return {"responses": sum(n for _, n in self._files())}

    def partitions(self, start: dict, end: dict) -> list[Prompts]:
        out, at = [], 0
        for file, n in self._files():
            lo, hi = max(0, start["responses"] - at), min(n, end["responses"] - at)
            out += [Prompts(file, a, min(a + PROMPTS_PER_TASK, hi)) for a in range(lo, hi, PROMPTS_PER_TASK)]
            at += n
        return out

    def read(self, partition: Prompts) -> Iterator[tuple]:
        from quarry.operators.generate import token_pieces  # tasks have the package

        fs, _ = file_system(self.uri)
        rows = pq.read_table(partition.file, filesystem=fs).slice(partition.first, partition.last - partition.first).to_pylist()
        call = pickle.loads(self.generator)()
        for r in sorted(rows, key=lambda r: r["model"]):  # one switch per model
            try:
                for seq, piece in enumerate(token_pieces(call, r["user"], r["system"], r["purpose"], {f: r[f] for f in self.fields})):
                    yield r["response_id"], seq, piece
            except Exception:
                continue  # the pieces given stay; the response ends here

    def commit(self, end: dict) -> None:
        pass


def source_of(kind: str, uri: str, generator: bytes, fields: list[str]) -> type[DataSource]:
    """The data source named ``kind`` over a queue of prompts."""
    class Tokens(DataSource):
        @classmethod
        def name(cls) -> str:
            return kind

        def schema(self) -> str:
            return "response_id long, seq long, chunk string"

        def streamReader(self, schema) -> TokenReader:
            return TokenReader(uri, generator, fields)

    return Tokens
