from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from gaugeworks.llm import packing as p
from tests.llm import odd

public_tokenizers = pytest.importorskip("public_tokenizers")
FILES = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def check_windows(lengths, windows, tiers):
    seen: dict[int, list] = {}
    for w in windows:
        size = sum(x.length for x in w)
        assert size & (size - 1) == 0 and size <= tiers[-1]
        for x in w:
            seen.setdefault(x.doc, []).append((x.start, x.length))
    for doc, n in enumerate(lengths):
        at = 0
        for start, length in sorted(seen[doc]):
            assert start == at and length > 0
            at += length
        assert at == n


@pytest.mark.parametrize("tiers", [p.TIERS, (64,), (16, 1024)])
@pytest.mark.parametrize("n", [1, 2, 50, 700])
def test_each_token_once_and_no_padding(tiers, n):
    rng = random.Random(n)
    lengths = [max(1, int(rng.lognormvariate(5, 1.5))) for _ in range(n)]
    windows, left = p.pack(lengths, tiers)
    assert sum(x.length for x in left) < tiers[-1] and all(sum(x.length for x in w) in tiers for w in windows)
    check_windows(lengths, windows + p.powers_of_two(left), tiers)
    assert sorted(map(tuple, p.in_step_order(windows)), key=str) == sorted(map(tuple, windows), key=str)
    assert p.pack([], tiers) == ([], [])


def test_step_groups_cost_nearly_the_same():
    rng = random.Random(3)
    windows, _ = p.pack([rng.randint(10, 900) for _ in range(3000)])
    top = [sum(x.length**2 for x in w) for w in p.in_step_order(windows) if sum(x.length for x in w) == 1024]
    groups = [sum(top[k : k + 8]) for k in range(0, len(top) - 7, 8)]
    assert len(groups) > 100 and max(groups) < 1.25 * min(groups)


def test_what_a_tokeniser_remembers_is_bounded(monkeypatch):
    monkeypatch.setattr(p, "REMEMBERED", 5000)
    units = p.UnitIds(lambda u: [ord(c) for c in u], "")
    for i in range(1000):
        assert units[f"unit{i % 300}"] == np.array([ord(c) for c in f"unit{i % 300}"], "<u4").tobytes()
        assert units["x" * 100] and len(units) < 25 and "x" * 100 not in units


def test_ids_are_the_tokenizers_own():
    from tokenizers import Tokenizer

    exact, encode = Tokenizer.from_file(FILES[0]), p.tokeniser(*FILES)
    texts = ["a  b", " a b ", "a \n b", "\n a\n\nb ", "it 's don't", "x  y 　z", "<|endoftext|> a", "a <|endoftext|>b", " ", "  ", "a\t b", "é à  ", "tab\tx y", "a\x1c b \x85 c", "1 2  3.", odd.LONG[:5000]]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == exact.encode(text, add_special_tokens=False).ids


def checked(rows, texts, step_tokens=p.STEP_TOKENS):
    """Holds pieces against the tokenizers library; returns window sizes by group."""
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(FILES[0])
    sequences: dict[int, list] = {}
    whole: dict = {}
    groups: dict[int, dict[int, int]] = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
        whole.setdefault(r["doc_id"], []).append(r)
        groups.setdefault(r["step_group"], {})[r["sequence_id"]] = r["tier"]
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert {r["tier"] for r in pieces} == {at} and at & (at - 1) == 0 and len({r["step_group"] for r in pieces}) == 1
    for tiers in groups.values():
        assert len(set(tiers.values())) == 1 and sum(tiers.values()) <= max(step_tokens, *tiers.values())
    for i, copies in texts.items():
        # rows of one id: as many of each text as there are
        ids = [exact.encode(t or "", add_special_tokens=False).ids + [0] for t in copies]
        pieces = whole[i]
        assert sum(r["length"] for r in pieces) == sum(map(len, ids))
        if len(copies) == 1:
            at = 0
            for r in sorted(pieces, key=lambda r: r["start"]):
                want = np.array(ids[0][at : at + r["length"]], "<u4").tobytes()
                assert r["start"] == at and r["doc_tokens"] == len(ids[0])
                assert (bytes(r["ids"]) == want) if "ids" in r else r["ids_crc32"] == zlib.crc32(want)
                at += r["length"]
    assert set(whole) == set(texts)
    return groups


def test_documents(spark):
    texts: dict = {}
    for i, t in odd.TEXTS:
        texts.setdefault(i, []).append(t)
    checked([r.asDict() for r in p.pack_documents(odd.documents(spark), *FILES).collect()], texts)
    assert p.pack_documents(odd.empty(spark), *FILES).count() == 0
    with pytest.raises(ValueError, match="powers of two"):
        p.pack_documents(odd.empty(spark), *FILES, tiers=(100,))


def test_query(spark, tmp_path):
    """Every column of op10 against the tokenizers library, over odd rows in many small files and batches."""
    from gaugeworks.llm.entries import op10_packing

    rng = random.Random(7)
    texts = {i: [" ".join(rng.choices(["alpha", "be", "c,", "Delta\n", "é😀"], k=rng.choice([3, 40, 200, 900])))] for i in range(1000, 1240)}
    texts |= {i: [t] for i, t in odd.TEXTS if i not in (None, 6)}
    odd.documents(spark, [(i, t) for i, ts in texts.items() for t in ts]).repartition(12).write.parquet(f"{tmp_path}/documents.parquet")
    conf = {"spark.sql.files.maxPartitionBytes": "16k", "spark.sql.files.openCostInBytes": "1", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = [r.asDict() for r in op10_packing(spark, str(tmp_path)).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    groups = checked(rows, texts)
    sizes = [t for tiers in groups.values() for t in tiers.values()]
    assert sum(t < 128 for t in sizes) <= 7
    # at most one group of a size isn't full
    short = [next(iter(tiers.values())) for tiers in groups.values() if sum(tiers.values()) < p.STEP_TOKENS]
    assert len(short) == len(set(short))
    assert set(rows[0]) >= {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
