import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from shroudline.llm import packing

from .conftest import CLASH, ODD

pytest.importorskip("public_tokenizers")


def tokenizer():
    return packing._runs(None).whole


def want(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 2]


def test_runs_give_the_library_s_ids():
    rng = random.Random(4)
    parts = ["a", "Bc", " ", "\n", "\t", "É", "ß", "é", "́", "1", "23", ".", "!!", "'s", "'", "don't", "<|endoftext|>", "<", "漢", "🙂", "\xa0", "ΣΑΣ", "İ", "$$$", "µ", "ﬁ", "\x1c", "àÀ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    got = packing.encode(pa.array(texts))
    for t, ids in zip(texts, got):
        assert ids.tolist() == want(t), repr(t)


def check(rows, ids_of):
    """Every id lies in one piece; sequences are gapless, of 4096 ids at most, and have no padding but for none at all."""
    pieces, sequences = {}, {}
    for doc_id, start, length, crc, total, sequence, offset, window, *_ in rows:
        assert length > 0
        ids = ids_of(doc_id)
        assert total == len(ids) and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
        pieces.setdefault(doc_id, []).append((start, length))
        sequences.setdefault(sequence, []).append((offset, length, window))
    for doc_id, got in pieces.items():
        at = 0
        for start, length in sorted(got):
            assert start == at
            at += length
        assert at == len(ids_of(doc_id))
    for got in sequences.values():
        at = 0
        for offset, length, window in sorted(got):
            assert offset == at
            at += length
        assert at == window <= 4096 and window & (window - 1) == 0


@pytest.mark.parametrize("sizes", [[1], [4096], [5000, 3, 700], [1] * 900, [4095, 4097, 2048, 1], list(range(1, 300)), [100_000, 7]])
def test_packer(sizes):
    docs = {k: np.arange(n, dtype="<u4") + k for k, n in enumerate(sizes)}
    packer, rows = packing.Packer(1 << 40), []
    for k, ids in docs.items():
        packer.add(k, ids)
        if k % 50 == 49:
            packer.pack(final=False)
            rows += packer.take()
    packer.pack(final=True)
    rows += packer.take()
    assert set(r[0] for r in rows) == set(docs)
    check(rows, lambda k: docs[k].tolist())
    groups = {}
    for *_, length, _, _, _, _, window, group in ((r[0], r[2], r[3], r[4], r[5], r[6], r[7], r[8]) for r in rows):
        groups[group] = groups.get(group, 0) + length
    assert max(groups.values()) <= packing.GROUP_TOKENS


def test_table(spark, make_docs):
    rng = random.Random(3)
    texts = [*ODD, *[" ".join(rng.choice(("House", "river,", "walk!!", "größe", "12")) for _ in range(rng.randint(1, 900))) for _ in range(40)]]
    docs = make_docs(texts, CLASH).repartition(3)
    rows = [tuple(r) for r in packing.pack(docs).collect()]
    ids = {i + 1: want(t) for i, t in enumerate(texts)}
    assert {r[0] for r in rows} == set(ids)
    check(rows, ids.__getitem__)
    assert packing.pack(docs.limit(0)).count() == 0
    assert [r["length"] for r in packing.pack(make_docs([(None, None)])).collect()] == [1]
