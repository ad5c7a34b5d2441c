"""Small invented texts for the tests."""

import random
import tempfile
import zlib

WORDS = "ka lo mi tu re sa no fi ge da pu vo ri te mo la su ne bi go".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices(WORDS, k=rng.randint(1, 4))) for _ in range(n))


def edited(rng: random.Random, text: str, times: int) -> str:
    words = text.split()
    for _ in range(times):
        words[rng.randrange(len(words))] = prose(rng, 1)
    return " ".join(words)


def odd_documents(spark):
    """A folder with a table ``documents`` of NULLs, empty texts, repeated rows
    and ids whose checksums choose every way that the queries treat rows."""
    rng = random.Random(3)
    crc = lambda i: zlib.crc32(str(i).encode())
    tenth = [i for i in range(3000) if crc(i) % 10 == 0][:8]
    texts = [None, "", " \n", "one", "a b", "x\ny z\n" * 9, prose(rng, 60), "é " * 40]
    rows = [(i, t, "en", "s", 1) for i, t in zip(tenth, texts)] + [(5000 + i, t, None, None if i % 2 else "t", None) for i, t in enumerate(texts)]
    rows += [(None, prose(rng, 20), "en", "s", 2), (None, None, None, None, None), rows[3], rows[3]]
    path = tempfile.mkdtemp(prefix="quarry-test-", dir="/tmp")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    df.write.parquet(f"{path}/documents.parquet")
    return path, rows
