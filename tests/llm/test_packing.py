import numpy as np
import pytest
from tokenizers import Tokenizer

from purlin.llm import vectors
from purlin.llm.packing import Encoder, pack
from purlin.llm.queries import tokenizer_path

ODD = ["", "  a\tb\x1cc\x85d e  \n\n x", "<|endoftext|> hi<|startoftext|>it's I'LL don't", "İstanbul ǅ ﬁ é é x", "a" * 5000, "日本語 12345 !!??", "Straße \U0001f600", "ÀÉÎ. ÇA? ßẞ µ ªº café:;!!"]


def reference_ids(text):
    return Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids


def test_chunkwise_encoding_equals_whole_texts():
    encode = Encoder(tokenizer_path(), limit=5)
    assert encode.by_chunk
    for text in ODD * 2:
        assert np.frombuffer(encode(text), encode.kind).tolist() == reference_ids(text)


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    encode = Encoder(path)
    assert not encode.by_chunk
    text = "Two  words\n and more"
    assert np.frombuffer(encode(text), encode.kind).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def check(rows, pieces, size):
    by, seq = {}, {}
    for p in pieces:
        by.setdefault(p.doc_id, []).append(p)
        seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for i, text in rows:
        ids, at = reference_ids(text) + [2], 0
        for p in sorted(by[i], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert np.frombuffer(p.ids, "<u4").tolist() == ids[at : at + p.length]
            at += p.length
        assert at == len(ids)
    for parts in seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size
    assert sorted(seq) == list(range(len(seq)))
    assert all(sum(n for _, n in parts) == size for s, parts in seq.items() if s != max(seq))


@pytest.mark.parametrize("size", [4096, 64])
def test_round_trip_and_no_padding(docs_of, size):
    rows = [(i, t) for i, t in enumerate(ODD + [None] + ["some words here " * k for k in range(1, 60)] + ["copy of a text"] * 30)]
    pieces = pack(docs_of(rows), tokenizer_path(), size=size).collect()
    check(rows, pieces, size)


def test_empty_table_and_carried_columns(docs_of):
    assert pack(docs_of([]), tokenizer_path()).collect() == []
    got = pack(docs_of([(1, "a b"), (1, "a b")]), tokenizer_path(), carry=["score", "lang"])
    assert got.columns[:3] == ["doc_id", "score", "lang"] and got.count() == 2


def test_hilbert_neighbours_are_adjacent_cells():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        side = 1 << bits
        grid = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = vectors.hilbert_keys((grid / (side - 1) - 0.5) * 8, bits=bits)
        assert sorted(keys.tolist()) == list(range(side**dims))
        assert np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1).max() == 1


def test_alike_documents_are_neighbours(docs_of):
    rows = [(i, " ".join(f"{'red' if i % 2 else 'blue'}{(i * 7 + k) % 40}" for k in range(80))) for i in range(40)]
    pieces = sorted(pack(docs_of(rows), tokenizer_path(), size=64).collect(), key=lambda p: (p.sequence_id, p.offset))
    order = list(dict.fromkeys(p.doc_id % 2 for p in pieces)), [p.doc_id % 2 for p in pieces]
    changes = sum(a != b for a, b in zip(order[1], order[1][1:], strict=False))
    assert changes < len(rows) / 2


def test_null_ids_and_clashing_names(docs_of):
    pieces = pack(docs_of([(None, "a b"), (None, None), (1, "c")]), tokenizer_path(), carry=["kept"]).collect()
    assert sorted((r.doc_id is None, r.doc_tokens) for r in pieces) == [(False, 2), (True, 1), (True, 3)] and all(r.kept for r in pieces)
    with pytest.raises(ValueError):
        pack(docs_of([(1, "c")]).withColumnRenamed("kept", "ids"), tokenizer_path(), carry=["ids"])
