import glob
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagewright.llm import tokens
from pagewright.session import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
ROWS = [(5, "Hello there, world!"), (3, None), (9, ""), (3, "three again"), (3, "three again"), (None, "no id"),
        (1, "  two  spaces\n\nlines \t and <|endoftext|> ends "), (2, "naïve 日本語 🎉"), (7, "x " * 50_000), (8, "! ! !")]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "p") for d, t in rows], "doc_id long, text string, start int, part string")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_round_trip(spark, plain):
    folder = scratch_path(spark, "test-tokens")
    manifest = tokens.write_tokens(frame(spark, ROWS).repartition(4), folder, PATH)
    got = sorted(tokens.read_tokens(manifest, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 3, 3, 5, 7, 8, 9]
    want = sorted((repr(d), len(plain(t)) + 1, crc(plain(t) + [0])) for d, t in ROWS)
    assert sorted((repr(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == want
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    # the files themselves: flat ids, global offsets
    root = folder.removeprefix("file:")
    flat = np.concatenate([np.fromfile(f, "<u2") for f in sorted(glob.glob(f"{root}/*.bin"))])
    offsets = np.unique(np.concatenate([np.fromfile(f, "<u8") for f in sorted(glob.glob(f"{root}/*.idx"))]))
    assert len(flat) == start and offsets.tolist() == [r["start"] for r in got] + [start]
    assert not glob.glob(f"{root}/*.draft")


def test_empty_table(spark):
    folder = scratch_path(spark, "test-none")
    manifest = tokens.write_tokens(frame(spark, ROWS).limit(0), folder, PATH)
    assert tokens.read_tokens(manifest, folder).count() == 0
    assert tokens.scan_tokens(spark, folder, 50_256).count() == 0


def test_encoder_equals_library(plain):
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "\r", "\t", "a", "the", "don't", "'s", "!", "...", "é", " ", "　", "23", "\x1c", "🎉", "<|endoftext|>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 20))) for _ in range(3_000)]
    encoder = tokens.Encoder(PATH)
    for text, found in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(found, encoder.dtype).tolist() == plain(text)


@pytest.mark.parametrize("block", [1, 3, 64, 1 << 20])
@pytest.mark.parametrize("tail", [[], [4, 5], [9] * 200])
def test_separator_scan(spark, tmp_path, block, tail):
    rng = random.Random(block + len(tail))
    docs = [[rng.randint(1, 60_000) for _ in range(rng.choice([0, 1, 2, 90]))] for _ in range(40)]
    flat = [x for d in docs for x in (*[i if i != 50_256 else 1 for i in d], 50_256)] + tail
    cut = sorted(rng.sample(range(len(flat)), 3))
    for n, (a, b) in enumerate(zip([0, *cut], [*cut, len(flat)])):
        np.array(flat[a:b], "<u2").tofile(tmp_path / f"f{n}.bin")
    (tmp_path / "f1b.bin").write_bytes(b"")
    got = sorted(map(tuple, tokens.scan_tokens(spark, str(tmp_path), 50_256, block_ids=block).collect()))
    want, start = [], 0
    for n, d in enumerate(docs):
        want.append((n, start, len(d) + 1, True))
        start += len(d) + 1
    if tail:
        want.append((len(docs), start, len(tail), False))
    assert got == want


def test_counts_of_documents(spark, plain):
    folder = scratch_path(spark, "test-flat")
    manifest = tokens.write_tokens(frame(spark, ROWS).repartition(3), folder, PATH, end_id=50_256, ordered=False)
    found = tokens.document_numbers(manifest, folder).join(tokens.scan_tokens(spark, folder, 50_256, block_ids=5_000), "doc_no")
    assert sorted((repr(r["doc_id"]), r["n_tokens"]) for r in found.collect()) == sorted(
        (repr(d), len(plain(t)) + 1) for d, t in ROWS)


def test_special_strings_as_the_library_gives_them(spark):
    library = Tokenizer.from_file(PATH)
    rows = ROWS + [(20, "a <|endoftext|> b"), (21, "<|endoftext|>"), (22, "word<|endoftext|>word " * 50)]
    folder = scratch_path(spark, "test-special")
    got = tokens.read_tokens(tokens.write_tokens(frame(spark, rows), folder, PATH, special=True), folder).collect()
    ids = lambda t: library.encode(t or "", add_special_tokens=False).ids + [0]
    assert sorted((repr(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(
        (repr(d), len(ids(t)), crc(ids(t))) for d, t in rows)
    assert 50_256 in ids("a <|endoftext|> b")
