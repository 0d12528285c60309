"""Token files: round trip against the tokenizer itself, and the perfect hash by itself."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from parlance.llm import token_files  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows):
    from tokenizers import Tokenizer

    tokenizer, out, start = Tokenizer.from_file(PATH), [], 0
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip(spark):
    texts = ["Hello, World's  end", None, "", " \t\n", "naïve \x0b café\x0cÉÉ 12x", "a" * 5000, "tail <|endoftext|> x", "word " * 3000, "日本 語 x"]
    rows = [(i * 7 - 3, t) for i, t in enumerate(texts * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash")).repartition(5)
    got = token_files.stored_tokens(spark, docs, PATH, keys_per_index=10)
    assert sorted(map(tuple, got.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == expected(rows)


def test_repeated_and_null_ids(spark):
    rows = [(None, "x"), (None, "x"), (4, "a b"), (4, "c"), (4, "c")] + [(9, "same")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = token_files.stored_tokens(spark, docs, PATH, keys_per_index=5).collect()
    assert len({(r.doc_id, r.copy) for r in got}) == len(rows)
    assert sorted(r.n_tokens for r in got) == sorted(n for _, _, n, _ in expected(rows))
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == list(np.cumsum([0] + [r.n_tokens for r in ordered])[:-1])
    assert [r.doc_id for r in ordered] == [None, None, 4, 4, 4] + [9] * 40


def test_absent_keys_and_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"w{i}") for i in range(50)], "doc_id long, text string")
    definition, wide = token_files.tokenizer_definition(PATH)
    folder = str(tmp_path)
    manifest = token_files.write_shards(docs, definition, folder, 2, wide)
    token_files.write_index(token_files.placed(manifest), folder, 1)
    keys = spark.createDataFrame([(i, 0) for i in range(25, 90)], "doc_id long, copy long")
    found = token_files.resolved(keys, folder, 1)
    assert sorted(r.doc_id for r in found.collect()) == list(range(25, 50))
    ids = token_files.read_tokens(found, folder, wide, with_ids=True).collect()
    assert all(list(r.ids)[-1] == 2 and len(r.ids) == r.n_tokens for r in ids)
    assert token_files.stored_tokens(spark, docs.limit(0), PATH).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    table = token_files.PerfectHash.build(keys)
    assert sorted(table.slots(keys)) == list(range(len(keys)))


def test_equal_hashes_are_told_apart_by_their_marks():
    place = np.array([5, 5, 5, 9], dtype=np.uint64)
    mark = np.array([1, 2, 3, 4], dtype=np.uint64)
    values = {n: np.arange(4) for n in token_files.INDEX_FIELDS}
    index = token_files.IndexFile(token_files.pack_index(place, mark, values))
    slot = index.find(place, mark)
    assert sorted(slot) == [0, 1, 2, 3] and list(index.arrays["start"][slot]) == [0, 1, 2, 3]
    assert list(index.find(np.array([5], dtype=np.uint64), np.array([7], dtype=np.uint64))) == [-1]


def test_encoding_matches_whole_text():
    column = pa.array(["It's  a\ttest", None, "x" * 300 + " y", ""])
    definition, _ = token_files.tokenizer_definition(PATH)
    ids, sizes = token_files.encode_column(definition, column)
    assert list(sizes) == [n - 1 for _, _, n, _ in expected(list(enumerate(column.to_pylist())))]


def test_letters_and_signs_are_put_together_as_the_tokenizer_parts_them():
    from tokenizers import Tokenizer

    definition, _ = token_files.tokenizer_definition(PATH)
    tokenizer = Tokenizer.from_file(PATH)
    letters = [chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x100))] + ["İ", "ſ", "Ω", "ǅ", "é", "́", "ß", "1", "'", "-", "_", "\x00", "中"]
    words = [a + b + c for a in letters for b in ("", "É", "s") for c in ("", ",", ".!?", "'s", ":x", "́", "́.")]
    words += ["...", "###", "$100", "don't.", "l'École!", "a,b", "ÀÈ", "x" * 3000, "<|endoftext|>.", "Ærø;;"]
    for _ in range(2):  # once encoded, once remembered
        ids, sizes = token_files.encode_column(definition, pa.array([" ".join(words[i::7]) for i in range(7)] + [None, ""]))
        want = [tokenizer.encode(" ".join(words[i::7]), add_special_tokens=False).ids for i in range(7)]
        assert sizes.tolist() == [*map(len, want), 0, 0] and ids.tolist() == sum(want, [])


def test_forgetting_changes_nothing(monkeypatch):
    definition, _ = token_files.tokenizer_definition(PATH)
    texts = pa.array([f"word{chr(97 + i % 26)}{chr(97 + i % 25)}, Tail{chr(97 + i % 7)}. {i}" for i in range(400)])
    want = token_files.encode_column(definition, texts)
    token_files._encoder(definition).forget()
    monkeypatch.setattr(token_files, "REMEMBERED", 50)
    for at in range(0, 400, 40):
        ids, sizes = token_files.encode_column(definition, texts.slice(at, 40))
        first = int(want[1][:at].sum())
        assert (sizes == want[1][at : at + 40]).all() and (ids == want[0][first : first + int(sizes.sum())]).all()
