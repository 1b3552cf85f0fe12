"""Word-wise encoding, packing and token files against whole-text encoding."""

import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import packing, token_files
from plumbline.llm.tokens import vocabulary_path, words
from tests.llm.fixtures import ROWS, frame

ENCODER = words(vocabulary_path())


def whole(text):
    return ENCODER.tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" .,'aZéÉßſ\x1c\x85 <|>0"))))
def test_words_give_the_ids_of_the_text(text):
    assert np.frombuffer(ENCODER.encode(text.encode()), "<u4").tolist() == whole(text)


def test_special_strings_and_the_fixture():
    for _, text in [*ROWS, (0, "It's DON'T <|endoftext|>x<|startoftext|> 12ab3 ΣΣ")]:
        assert np.frombuffer(ENCODER.encode((text or "").encode()), "<u4").tolist() == whole(text)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_packing(rows, got, length):
    expected = Counter()
    for d, t in rows:
        ids = [*whole(t), packing.END]
        for n, at in enumerate(range(0, len(ids), length)):
            expected[(d, n, at, len(ids[at : at + length]), crc(ids[at : at + length]))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return len(sequences), -(-sum(r["length"] for r in got) // length)


def test_packing_keeps_every_piece_and_fills_sequences(spark):
    got = packing.pack(frame(spark)).collect()
    used, least = check_packing(ROWS, got, 4096)
    assert used <= least + 1


def test_packing_over_several_rounds(spark, monkeypatch):
    got = packing.pack(frame(spark).repartition(12), length=200).collect()
    used, least = check_packing(ROWS, got, 200)
    assert used <= 1.05 * least + 1


def test_best_fit_takes_the_tightest_bin():
    bins = packing.best_fit([[6, [("a",)]], [5, [("b",)]], [4, [("c",)]], [5, [("d",)]]], 10)
    assert sorted(sorted(p[0] for p in pieces) for _, pieces in bins) == [["a", "c"], ["b", "d"]]


def test_token_files_round_trip(spark, tmp_path, monkeypatch):
    manifest = token_files.write_token_files(frame(spark), str(tmp_path / "tokens"))
    got = sorted((r.asDict() for r in token_files.read_token_files(manifest).collect()), key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in ROWS), key=lambda d: (d is not None, d))
    expected = Counter((d, len(whole(t)) + 1, crc([*whole(t), token_files.END])) for d, t in ROWS)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == expected


def test_single_ids_without_decoding(tmp_path):
    rng = np.random.default_rng(1)
    ids = np.concatenate((rng.integers(0, 300, 3000), rng.integers(0, 2**32, 500))).astype(np.uint32)
    path = tmp_path / "x.dac"
    path.write_bytes(token_files.to_bytes([5, None], np.array([3000, 3500]), ids))
    with open(path, "rb") as handle:
        opened = token_files.TokenFile(handle)
        assert opened.levels == 4 and (opened.ids() == ids).all()
        assert [opened[i] for i in range(0, 3500, 7)] == ids[::7].tolist()
        assert [(d, s, len(x)) for d, s, x in opened.documents()] == [(5, 0, 3000), (None, 3000, 500)]


def test_empty_tables(spark, tmp_path):
    assert packing.pack(frame(spark, [])).count() == 0
    manifest = token_files.write_token_files(frame(spark, []), str(tmp_path / "none"))
    assert token_files.read_token_files(manifest).count() == 0
