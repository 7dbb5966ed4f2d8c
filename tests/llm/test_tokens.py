"""Token files against the library itself, and the coder's round trip."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomlake.llm import token_files
from loomlake.llm.token_coder import BLOCK, decode, encode
from loomlake.llm.token_files import Ids, read_index, read_pieces, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, part string, id int, block string"


def expected(rows):
    """(id, start, n_tokens, ids_crc32) by the library alone."""
    library = Tokenizer.from_file(PATH)
    out, start = [], 0
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def written(spark, tmp_path, rows):
    frame = spark.createDataFrame([(k, t, "x", 1, "y") for k, t in rows], SCHEMA)
    write_tokens(frame.repartition(3), f"file://{tmp_path}/tokens", PATH)
    return f"file://{tmp_path}/tokens"


def test_index_equals_library(spark, tmp_path):
    rng = random.Random(5)
    alphabet = "abcdefghij  \n\té漢𝕏'’0123.,<|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(300))) for _ in range(60)]
    texts += [None, "", " ", "a<|endoftext|>b", "<|endoftext|>", "<|endoftext", " it's we'll  \n\n x", "same", "word " * 9000]
    rows = list(enumerate(texts, 10))
    path = written(spark, tmp_path, rows)
    assert sorted(tuple(r) for r in read_index(spark, path).collect()) == sorted(expected(rows))


def test_null_and_repeated_ids(spark, tmp_path):
    rows = [(None, "one two"), (None, "three"), (7, "same text"), (7, "same text"), (7, "other"), (-3, "minus")]
    got = [tuple(r) for r in read_index(spark, written(spark, tmp_path, rows)).collect()]
    want = expected(rows)
    assert sorted((r[0] is None, r[0] or 0, *r[2:]) for r in got) == sorted((r[0] is None, r[0] or 0, *r[2:]) for r in want)
    by_start = sorted(got, key=lambda r: r[1])
    assert [r[1] for r in by_start] == np.cumsum([0, *(r[2] for r in by_start)]).tolist()[:-1]
    assert [r[0] for r in by_start] == [None, None, -3, 7, 7, 7]


def test_empty_table(spark, tmp_path):
    path = written(spark, tmp_path, [])
    assert read_index(spark, path).count() == 0 and read_pieces(spark, path).count() == 0


def test_very_long_text(spark, tmp_path):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeéü") for _ in range(rng.randrange(1, 9))) for _ in range(500)]
    rows = [(1, "short"), (2, " ".join(rng.choice(words) for _ in range(600_000))), (3, "after")]
    assert sorted(tuple(r) for r in read_index(spark, written(spark, tmp_path, rows)).collect()) == expected(rows)


def test_pieces_hold_the_ids(spark, tmp_path):
    rows = [(1, "a b c"), (2, "d<|endoftext|>")]
    got = {r["id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in read_pieces(spark, written(spark, tmp_path, rows)).collect()}
    library = Tokenizer.from_file(PATH)
    assert got == {k: library.encode(t, add_special_tokens=False).ids + [0] for k, t in rows}


def test_coder_round_trip():
    rng = np.random.default_rng(3)
    blocks = [rng.integers(0, 1 << 16, BLOCK), np.zeros(BLOCK, np.int64), np.zeros(0, np.int64), np.array([65535]), rng.integers(0, 9, 700), np.tile(np.arange(50), 80), np.full(BLOCK, 65535)]
    blocks += [rng.integers(0, 1 << 16, n) for n in range(1, 40)]
    coded = encode(blocks)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(decode(coded), blocks, strict=True))
    # Blocks stand alone: any of them is read without the others.
    assert (decode([coded[4]])[0] == blocks[4]).all()
    # What contexts predict is cheap, and random ids cost little more than their 16 bits.
    assert len(coded[1]) < 250 and len(coded[5]) < 0.2 * 2 * len(blocks[5])
    assert len(coded[0]) < 1.1 * 2 * BLOCK


def test_coder_refuses():
    with pytest.raises(ValueError):
        encode([np.array([1 << 16])])
    with pytest.raises(ValueError):
        encode([np.array([-1])])
    with pytest.raises(ValueError):
        encode([np.zeros(BLOCK + 1, np.int64)])
    (good,) = encode([np.arange(900)])
    for bad in (b"", good[:20], good[:-2], b"X" + good[1:], good[:40] + bytes([good[40] ^ 1]) + good[41:]):
        with pytest.raises(ValueError):
            decode([bad])


def test_workers_keep_their_encoder(spark, tmp_path):
    """Tasks after the first take the words over that their worker has met."""
    written(spark, tmp_path, [(1, "some words")])

    def kept(batches):
        import pyarrow as pa

        from loomlake.llm import token_files

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(token_files._encoders)] * batch.num_rows, pa.int64())], names=["id"])

    counts = spark.range(0, 64, 1, 16).mapInArrow(kept, "id long").collect()
    assert max(r["id"] for r in counts) > 0


def test_a_block_learns_from_all_of_it():
    """Phrases that stand far apart are known again; blocks of a few thousand ids met most of them anew."""
    rng = np.random.default_rng(8)
    phrases = rng.integers(0, 1 << 16, (400, 40))
    ids = phrases[rng.integers(0, 400, 5000)].ravel()
    size = min(BLOCK, len(ids))
    coded = encode([ids[a : a + size] for a in range(0, len(ids), size)])
    assert (np.concatenate(decode(coded)) == ids).all()
    assert sum(map(len, coded)) < 2 * len(ids) / 5


def test_coder_sizes():
    rng = np.random.default_rng(4)
    sizes = [1, 2, 63, 64, 65, 575, 576, 577, 4671, 4672, 4673, 37439, 37440, 37441, 50001, 37440 + 4096 * 64 + 1, 400_003]
    blocks = [np.minimum(rng.geometric(0.01, n), 65535) for n in sizes]
    assert all(len(a) == len(b) and (a == b).all() for a, b in zip(decode(encode(blocks)), blocks, strict=True))


def test_damage_gives_no_wrong_ids():
    """A bit that nothing reads may flip (the last byte of deflated states is padded); any other is a ValueError."""
    rng = np.random.default_rng(6)
    ids = np.minimum(rng.geometric(0.02, 9000), 65535)
    (good,) = encode([ids])
    refused = 0
    places = [*range(40), *rng.integers(40, len(good), 60).tolist()]
    for at in places:
        try:
            assert (decode([good[:at] + bytes([good[at] ^ 1 << int(rng.integers(8))]) + good[at + 1 :]])[0] == ids).all()
        except ValueError:
            refused += 1
    assert refused >= len(places) - 1


def test_pre_tokens_are_the_library_s():
    """White space of all kinds, contractions, marks, and words too long for the table, in one batch."""
    rng = random.Random(11)
    alphabet = "aszé漢tlrevmd''''   \n\t\u00a0\u3000019²½,.<|!😀𝕏\u0301\0\x1c\x85\u200b"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(25))) for _ in range(3000)]
    texts += ["", "", "x" * 5000, "word" * 4, "word" * 4 + "s", " " * 40, "a<|endoftext|>b", "'s'll''s 're\n've"] * 2
    library, ids_of = Tokenizer.from_file(PATH), Ids(PATH, 7)
    for _ in range(2):  # new words, then known ones
        ids, ends = ids_of.of([t.encode() for t in texts])
        got = [ids[a:b].tolist() for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
        assert got == [library.encode(t, add_special_tokens=False).ids + [7] for t in texts]


def test_long_texts_are_cut_between_pre_tokens(monkeypatch):
    monkeypatch.setattr(token_files, "_AT_ONCE", 8)
    rng = random.Random(12)
    library, ids_of = Tokenizer.from_file(PATH), Ids(PATH, 0)
    assert len(list(token_files._cuts(b"some words " * 9))) > 5
    for _ in range(500):
        text = "".join(rng.choice("abé漢s'll   \n\n\t.,1\u00a0") for _ in range(80))
        ids, ends = ids_of.of([text.encode()])
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids + [0] and ends.tolist() == [len(ids)]
