"""Record files: round trip, order, offsets and damage."""

import glob
import random
import struct
import tempfile

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import records
from tests.llm.helpers import prose

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, file string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [2]


def texts():
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(1, 80)) + rng.choice(["", " ", "  x", "\n y", "\n\n z "])) for i in range(100)]
    rows += [(200, None), (201, ""), (202, " "), (203, "  a  b "), (204, "x<|endoftext|> y"), (5, rows[5][1]), (5, "other"), (None, "no id"),
             (None, None), (-4, "first"), (205, "word " * 30_000)]
    return rows


def test_round_trip(spark, library, monkeypatch):
    monkeypatch.setattr(records, "FILE_BYTES", 4000)
    rows = texts()
    path = tempfile.mkdtemp(prefix="quarry-rec-")
    records.write_records(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(7), path, PATH, end_id=2)
    got = sorted((r.start, str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in records.read_records(spark, path).collect())
    assert sorted((d, i) for _, d, i in got) == sorted((str(d), ids_of(library, t)) for d, t in rows)
    assert [s for s, _, _ in got] == np.cumsum([0, *[len(i) for _, _, i in got]])[:-1].tolist()
    order = [-1e9 if d == "None" else int(d) for _, d, _ in got]
    assert order == sorted(order)
    mixed = [(r.start, str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in records.shuffled_read(spark, path, 3).collect()]
    assert sorted(mixed) == got and mixed != got
    file = sorted(glob.glob(f"{path}/data/*.rec"))[0]
    data = bytearray(open(file, "rb").read())
    data[20] ^= 1
    open(file, "wb").write(data)
    with pytest.raises(Exception, match="damaged"):
        records.read_records(spark, path).collect()


def test_no_rows(spark):
    path = tempfile.mkdtemp(prefix="quarry-rec-")
    assert records.write_records(spark.createDataFrame([], SCHEMA), path, PATH, 2).count() == 0
    assert records.read_records(spark, path).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\x1c\x85\xa0ab1.,'s!é"), st.characters(exclude_categories=["Cs", "Cn", "Co"])), max_size=40))
def test_chunks_are_tokenised_as_the_whole_text(library, text):
    coded = CODER.encode(pa.array([text]), 2)
    assert np.frombuffer(coded[0], CODER.kind).tolist() == ids_of(library, text)


CODER = records.ChunkTokenizer(open(PATH, encoding="utf-8").read())


def test_frame():
    data = records.frame(7, struct.pack("<3H", 1, 2, 65535), False)
    doc_id, ids = records.unframe(data)
    assert doc_id == 7 and ids.tolist() == [1, 2, 65535]
    assert records.unframe(records.frame(None, struct.pack("<I", 1 << 20), True))[0] is None
    for i in range(len(data)):
        with pytest.raises(ValueError):
            records.unframe(data[:i] + bytes([data[i] ^ 4]) + data[i + 1 :])
