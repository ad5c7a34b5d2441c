"""Chunking, Python string semantics, paths, globs and the file-tree source."""

import fnmatch
import os
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from quarry import constants as K
from quarry.functions import paths as P
from quarry.functions import text as TX
from quarry.operators import scan as SC
from quarry.operators.chunking import chunk_text
from quarry.sources.files import read_tree

TRICKY = ["", "a", "  a b \n", " x ", "a\r\nb\rc\n", "x\n\n", "\x1cy\x1d", "a b\u0085c",
          "\tfoo  \t", "line1\nline2  \n  line3\t\n"]


def test_chunk_fixtures(spark):
    df = spark.createDataFrame([(1, "0123456789"), (2, "a" * 100), (3, "")], "id int, t string")
    got = {}
    got[1] = [r.text for r in chunk_text(df.where("id = 1"), "t", ["id"], 6, 2).orderBy("chunk_index").collect()]
    got[2] = chunk_text(df.where("id = 2"), "t", ["id"], 100, 20).count()
    got[3] = chunk_text(df.where("id = 3"), "t", ["id"]).count()
    assert got == {1: ["012345", "456789", "89"], 2: 2, 3: 0}


def test_chunk_matches_python_loop(spark):
    texts = ["x" * n for n in (1, 799, 800, 801, 1000, 1001, 2500)] + ["héllo wörld " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    rows = chunk_text(df, "t", ["id"]).collect()
    got = {}
    for r in rows:
        got.setdefault(r.id, {})[r.chunk_index] = r.text
    for i, t in enumerate(texts):
        expect, start = [], 0
        while start < len(t):
            expect.append(t[start:start + K.CHUNK_SIZE])
            start += K.CHUNK_SIZE - K.CHUNK_OVERLAP
        assert [got[i][j] for j in range(len(expect))] == expect


def test_strip_splitlines_blank_match_python(spark):
    df = spark.createDataFrame([(s,) for s in TRICKY], "s string")
    rows = df.select("s", TX.py_strip(F.col("s")).alias("st"), TX.py_rstrip(F.col("s")).alias("rs"),
                     TX.splitlines(F.col("s")).alias("sl"), TX.is_blank(F.col("s")).alias("bl")).collect()
    for r in rows:
        assert r.st == r.s.strip()
        assert r.rs == r.s.rstrip()
        assert list(r.sl) == r.s.splitlines()
        assert r.bl == (not r.s.strip())


def test_path_facts_match_pathlib(spark):
    paths = ["a/b/c.py", "a/.bashrc", "x.tar.gz", "dir/file.", "noext", "a/b/..", "src/Main.PHP"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    rows = df.select("path", P.name(F.col("path")).alias("n"), P.suffix(F.col("path")).alias("s"),
                     P.stem(F.col("path")).alias("st")).collect()
    for r in rows:
        pp = PurePosixPath(r.path)
        assert (r.n, r.s, r.st) == (pp.name, pp.suffix, pp.stem), r.path


def test_sort_by_parts_differs_from_string_order(spark):
    df = spark.createDataFrame([("r", "a-b/f"), ("r", "a/f")], "source string, path string")
    from quarry.operators.corpus import sort_paths
    got = {r.path: (r.part_rank, r.string_rank) for r in sort_paths(df).collect()}
    assert got == {"a/f": (1, 2), "a-b/f": (2, 1)}


def test_ignore_patterns_match_fnmatch(spark):
    lines = ["# comment", "", "  *.kt ", "build*", "*/gen/?.py", "docs/", "[!a]x.md"]
    files = ["a.kt", "src/a.kt", "build/x.py", "buildx", "s/gen/a.py", "s/gen/ab.py", "docs/x.md",
             "bx.md", "ax.md", "keep.py"]
    pats = SC.ignore_patterns(spark, spark.createDataFrame([(x,) for x in lines], "line string"))
    kept = {r.path for r in SC.drop_ignored(spark.createDataFrame([(f,) for f in files], "path string"),
                                             pats).collect()}
    globs = [x.strip() for x in lines if x.strip() and not x.strip().startswith("#")]

    def ignored(p):
        name = p.split("/")[-1]
        return any(fnmatch.fnmatch(p, g) or fnmatch.fnmatch(name, g) or fnmatch.fnmatch(p + "/", g)
                   for g in globs)
    assert kept == {f for f in files if not ignored(f)}


def test_read_tree_scan_and_decode(spark, tmpdir_fresh):
    root = tmpdir_fresh
    layout = {"src/a.py": b"print(1)\r\nprint(2)\r", "src/B.PY": b"x = '\xff'\n", "node_modules/m.js": b"1",
              "docs/readme.md": b"# hi\n", "data.bin": b"\x00\x01", "vendor/v.py": b"v"}
    for rel, data in layout.items():
        os.makedirs(os.path.join(root, os.path.dirname(rel)), exist_ok=True)
        with open(os.path.join(root, rel), "wb") as fh:
            fh.write(data)
    files = SC.scan_index_files(read_tree(spark, root))
    got = {r.path: r.content for r in files.collect()}
    assert set(got) == {"src/a.py", "src/B.PY", "docs/readme.md"}
    assert got["src/a.py"] == "print(1)\nprint(2)\n"
    assert got["src/B.PY"] == "x = '�'\n"


def test_empty_tree_has_no_chunks(spark, tmpdir_fresh):
    from quarry.plans.indexing import build_index
    os.makedirs(os.path.join(tmpdir_fresh, "empty"), exist_ok=True)
    idx = build_index(read_tree(spark, os.path.join(tmpdir_fresh, "empty")))
    assert idx.count() == 0


def test_suppress_lines(spark):
    df = spark.createDataFrame([("a = 1\nb = eval(x)  # tool-ignore-sec\nc",)], "content string")
    assert SC.suppress_lines(df).first().content == "a = 1\nc"
    slashes = spark.createDataFrame([("x();\ny(); // tool-ignore-sec\n//ignore-sec  \n// ignore-sec not",)], "content string")
    assert SC.suppress_lines(slashes).first().content == "x();\n// ignore-sec not"


def test_per_root_ignore_files(spark, tmpdir_fresh):
    for root, pats in {"r1": "*.kt\n# c\n", "r2": "gen/*\n"}.items():
        os.makedirs(os.path.join(tmpdir_fresh, root), exist_ok=True)
        with open(os.path.join(tmpdir_fresh, root, ".gitignore"), "w") as fh:
            fh.write(pats)
    lines = SC.read_ignore_files(spark, [os.path.join(tmpdir_fresh, r, ".gitignore") for r in ("r1", "r2")])
    pats = SC.ignore_patterns(spark, lines, keep=["root"])
    files = spark.createDataFrame([("r1", "a.kt"), ("r1", "gen/x.py"), ("r2", "a.kt"), ("r2", "gen/x.py")],
                                  "root string, path string")
    kept = {(r.root, r.path) for r in SC.drop_ignored(files, pats, root_col="root").collect()}
    assert kept == {("r1", "gen/x.py"), ("r2", "a.kt")}


def test_global_pattern_list_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(SC, "MAX_GLOBAL_PATTERNS", 2)
    files = spark.createDataFrame([(f"a/f{i}.py",) for i in range(9)], "path string")
    lines = spark.createDataFrame([(f"f{i}.py",) for i in range(7)], "line string")
    kept = SC.drop_ignored(files, SC.ignore_patterns(spark, lines))
    assert sorted(r.path for r in kept.collect()) == ["a/f7.py", "a/f8.py"]


def test_brackets_as_fnmatch():
    import fnmatch
    import re
    names = ["a[x.py", "x.py", "ax.py", "a-x", "a]x", "a!x", "b\\x", "a^x", "abx", "[x.py", "a&&x", "f3.js", "f8.js", "", "a\nb"]
    globs = ["[x.py", "*[x.py", "a[]x]x", "a[!]]x", "a[!a-b]x", "a[z-a]x", "a[-]x", "[a-c]?x", "a[^]x", "*[\\]x", "a[&~]*x", "f[0-3].js", "[", "[]", "[!]",
             "a[]-]x", "a[a-b-c]x", "*", "a?b", "[[]x.py", "a[b[c]x", "+.(x)"]
    for g in globs:
        for n in names:
            assert (re.search(SC.glob_regex(g).replace(r"\z", r"\Z"), n) is not None) == fnmatch.fnmatchcase(n, g), (g, n)


def test_bracket_patterns_in_spark(spark):
    files = spark.createDataFrame([(p,) for p in ("r/[x.py", "r/x.py", "r/f5.js", "r/f8.js", "r/a]x")], "path string")
    lines = spark.createDataFrame([("[x.py",), ("f[!0-7].js",), ("a[]]x",)], "line string")
    kept = SC.drop_ignored(files, SC.ignore_patterns(spark, lines))
    assert sorted(r.path for r in kept.collect()) == ["r/f5.js", "r/x.py"]


def test_missing_ignore_file_has_no_lines(spark, tmpdir_fresh):
    assert SC.read_ignore_files(spark, [os.path.join(tmpdir_fresh, "nope", ".gitignore")]).count() == 0


def _ignored(path, globs):
    return any(fnmatch.fnmatchcase(n, g) for g in globs for n in (path, path.split("/")[-1], path + "/"))


@pytest.mark.parametrize("most", [200_000, 2])
def test_pattern_index_equals_fnmatch(spark, monkeypatch, most):
    """Texts, prefixes, suffixes and the rest, as sets and as a join."""
    import random
    monkeypatch.setattr(SC, "MAX_GLOBAL_PATTERNS", most)
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("ab.é'\\\\", k=rng.randint(1, 3)))
    files = sorted({"/".join(word() for _ in range(rng.randint(1, 3))) for _ in range(300)})
    for _ in range(3):
        globs = [rng.choice(["{}", "*{}", "{}*", "*{}*", "{}/", "*/{}", "{}/*", "?{}", "[ab]{}", "{}/{}"]).format(word(), word()) for _ in range(12)]
        pats = SC.ignore_patterns(spark, spark.createDataFrame([(g,) for g in globs], "line string"))
        kept = {r.path for r in SC.drop_ignored(spark.createDataFrame([(f,) for f in files], "path string"), pats).collect()}
        clean = [g.strip() for g in globs]
        assert kept == {f for f in files if not _ignored(f, clean)} and 0 < len(kept) < len(files)


def test_a_hundred_thousand_patterns_are_looked_up(spark):
    """No alternation is left to scan: the filters are sets."""
    lines = spark.range(100_000).selectExpr("concat(case id % 3 when 0 then '*.x' when 1 then 'gen/' else 'f' end, id, case id % 3 when 1 then '/*' else '' end) as line")
    files = spark.createDataFrame([("a/b.x3",), ("a/b.x4",), ("gen/1/q.py",), ("gen/2/q.py",), ("s/f5",), ("s/f6",)], "path string")
    kept = SC.drop_ignored(files, SC.ignore_patterns(spark, lines))
    plan = kept._jdf.queryExecution().optimizedPlan()
    assert sorted(r.path for r in kept.collect()) == ["a/b.x4", "gen/2/q.py", "s/f6"]
    assert "RLIKE" not in plan.toString()


def _tree(root, layout):
    for rel, data in layout.items():
        os.makedirs(os.path.join(root, os.path.dirname(rel)), exist_ok=True)
        with open(os.path.join(root, rel), "wb") as f:
            f.write(data)


def test_pruned_listing_opens_no_ignored_folder(spark, tmpdir_fresh):
    from quarry.sources.listing import list_tree, read_pruned_tree
    _tree(tmpdir_fresh, {"src/a.py": b"x\r\ny", "src/deep/er/b.PY": b"\xff", "top.md": b"t", "src/empty.py": b"", "data.bin": b"\x00",
                         "node_modules/m.js": b"1", "src/vendor/v.py": b"v", "gen/out/g.py": b"g", "gen/keep.txt": b"k", "docs/d.md": b"d"})
    os.symlink(tmpdir_fresh, os.path.join(tmpdir_fresh, "node_modules", "loop"))  # a listing of it would never end
    os.symlink("nowhere", os.path.join(tmpdir_fresh, "src", "gone.py"))
    pats = SC.ignore_patterns(spark, spark.createDataFrame([("gen/out/*",), ("docs/",), ("*.bin",)], "line string"))
    files, folders = list_tree(spark, tmpdir_fresh, patterns=pats)
    assert {r.path for r in folders.collect()} == {"", "src", "src/deep", "src/deep/er", "gen", "docs"}
    assert {r.path for r in files.collect()} == {"src/a.py", "src/deep/er/b.PY", "top.md", "src/empty.py", "data.bin", "gen/keep.txt", "docs/d.md"}
    # the same rows as the whole listing, without what is ignored, and with the empty file
    rows = lambda df: {r.path: (r.mtime, r.content, r.n_bytes, r.source) for r in df.collect()}
    os.remove(os.path.join(tmpdir_fresh, "node_modules", "loop"))
    whole = rows(SC.scan_index_files(read_tree(spark, tmpdir_fresh)))
    pruned = rows(SC.scan_index_files(read_pruned_tree(spark, tmpdir_fresh)))
    assert pruned.pop("src/empty.py")[1:3] == ("", 0) and pruned == whole and "src/a.py" in whole
    assert rows(read_pruned_tree(spark, os.path.join(tmpdir_fresh, "src", "deep", "er"), extensions=[".md"])) == {}


def test_progress_rises_while_embedding(spark, tmpdir_fresh):
    """Counts come before the job has ended."""
    import time

    from pyspark.sql import functions as F

    from quarry.functions.embed import model_embedder
    from quarry.operators.progress import EmbedProgress, count_chunks
    from quarry.plans.indexing import build_index
    from quarry.sinks.index_store import IndexStore

    def load():
        def embed(texts):
            time.sleep(0.3)
            return [[1.0] for _ in texts]
        return embed

    files = spark.range(64).select(F.format_string("r/f%d.py", "id").alias("path"), F.lit(1.0).alias("mtime"), F.lit("text").alias("content")).repartition(64, "path")
    told, store = [], IndexStore(spark, os.path.join(tmpdir_fresh, "s"))
    total = count_chunks(files)
    with EmbedProgress(spark, total, lambda n, of: told.append((n, of, store.exists())), model_embedder(load), every=0.05) as p:
        store.save(build_index(files, embed=p.embed))
    assert total == 64 and told[-1][:2] == (64, 64) and all(of == 64 for _, of, _ in told)
    counts = [n for n, _, _ in told]
    assert counts == sorted(set(counts)) and sum(not there for _, _, there in told) >= 2
    assert store.load().where("embedding = array(1.0f)").count() == 64
