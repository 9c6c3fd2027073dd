"""Token alignment against both libraries and a plain pairing of byte ranges."""

from __future__ import annotations

import hashlib
from collections import Counter
from functools import partial

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from gaugeworks.llm import entries, token_alignment
from gaugeworks.llm.common import read_table
from tests.llm import odd

SF_DIR = "/root/testdata/sf0.001"
RANKS, MODEL, JSON = (public_tokenizers.path(f) for f in ("byte_bpe_50k.tiktoken", "piece_bpe_32k.model", "byte_bpe_50k.json"))
FIRST, SECOND = partial(token_alignment.byte_level, RANKS, public_tokenizers.PATTERN), partial(token_alignment.pieces, MODEL)
TEXTS = [
    "one word", "  two  spaces  ", "tab\tand\nnewline\r\n", "<|endoftext|> as plain <s> text </s> <unk> <0x41>", "é à ü 你好 😀 done", "▁ mark ▁▁ inside", "trailing ", " leading", " ", "\n", "x" * 5000,
    "supercalifragilistic antidisestablishment", "a  b   c    d", "1234567 89.5e-3 $%^", "“quoted” — dash…", "don't can't I'll", "\x00\x01 control \x7f", "word with nbsp", "ab" * 700 + " cd " + "é" * 300, "mixed line　wide",
]


@pytest.fixture(scope="module")
def libraries():
    exact = Tokenizer.from_file(JSON)
    exact.encode_special_tokens = True
    # the bytes of a byte-level entry, from the library's own alphabet: printable characters stand for themselves
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    alphabet = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    assert set(alphabet) == set(ByteLevel.alphabet())
    return exact, alphabet, sentencepiece.SentencePieceProcessor(model_file=MODEL)


def tokens(text, libraries):
    exact, alphabet, model = libraries
    if not text:
        return [], []
    a = [(i, bytes(alphabet[c] for c in exact.id_to_token(i))) for i in exact.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in model.encode(text):
        piece = model.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") and len(piece) == 6 else piece.replace("▁", " ").encode()))
    source = (" " + text).encode()
    return (a, b) if b"".join(t for _, t in a) == source == b"".join(t for _, t in b) else ([], [])


def ends(found):
    out, at = [], 0
    for _, t in found:
        at += len(t)
        out.append(at)
    return out


def brute(texts, libraries):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each text of a corpus."""
    documents = []
    for text in texts:
        a, b = tokens(text, libraries)
        shared = sorted(set(ends(a)) & set(ends(b)))
        groups, low = [], 0
        for high in shared:
            part = [[i for (i, _), e in zip(found, ends(found)) if low < e <= high] for found in (a, b)]
            groups.append(part)
            low = high
        documents.append((len(a), len(b), groups, Counter((x, y) for p, q in groups for x in p for y in q)))
    counts = Counter(pair for *_, links in documents for pair in links)
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(n, most.get(x, 0))
    out = []
    for n_a, n_b, groups, links in documents:
        spelt = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)
        best = sum(n for pair, n in links.items() if counts[pair] == most[pair[0]])
        out.append((n_a, n_b, len(groups), sum(links.values()), best, sum(n * counts[p] for p, n in links.items()), hashlib.sha256(spelt.encode()).hexdigest() if n_a else ""))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_against_the_libraries(spark, libraries):
    texts = [*TEXTS, *TEXTS[:3], None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in token_alignment.link_scores(docs, FIRST, SECOND).collect()}
    assert [found[i] for i in range(len(texts))] == brute(texts, libraries)
    assert sum(n == 0 for n, *_ in found.values()) == 3  # the null, the empty one and the one with a mark of its own


def test_query(spark, libraries):
    rows = read_table(spark, SF_DIR, "documents").select("doc_id", "text").collect()
    found = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in entries.op12_token_alignment(spark, SF_DIR).collect()}
    assert found == {r["doc_id"]: t for r, t in zip(rows, brute([r["text"] for r in rows], libraries))}


def test_small_chunks_and_a_short_memory(libraries, monkeypatch):
    """What is remembered and how documents are put together changes nothing; links of large groups are counted by id."""
    aligner = token_alignment.Aligner(FIRST(), SECOND())
    whole = aligner.align(TEXTS)
    monkeypatch.setattr(token_alignment, "REMEMBERED", 0)
    monkeypatch.setattr(token_alignment, "MANY", 2)
    other = token_alignment.Aligner(FIRST(), SECOND())
    single = [other.align([t])[0] for t in TEXTS for _ in range(2)][::2]
    for x, y in zip(whole, single):
        assert x[:5] == y[:5] and x[5].tolist() == y[5].tolist() and x[6].tolist() == y[6].tolist()


def test_windows_are_remembered_by_ids():
    aligner = token_alignment.Aligner(FIRST(), SECOND())
    aligner.align(["alpha beta gamma"])
    n = len(aligner._texts)
    aligner.align(["gamma alpha beta beta"])
    assert len(aligner._texts) == n == 3


def test_unit_by_unit_is_the_whole(libraries):
    exact, _, model = libraries
    first, second, apart = FIRST(), SECOND(), 0
    assert first.apart and second.apart
    for text in [*TEXTS, "one two. Three\nfour five", "é à ü", "a\n\nb c"]:
        spelt = [" " + u for u in text.split(" ")] if token_alignment.lone_spaces_only(text) else [" " + text]
        apart += len(spelt) > 1
        for vocabulary, ids in ((first, exact.encode(" " + text, add_special_tokens=False).ids), (second, model.encode(text))):
            assert [i for part in vocabulary.encode(spelt) for i in part] == ids
    assert apart >= 8 and not any(map(token_alignment.lone_spaces_only, ("a  b", " a", "a ", "a \n b", "\na", "a\tb", "a\u2581b", "a\u00a0b")))


def test_odd_rows(spark, libraries):
    docs = odd.documents(spark)
    out = token_alignment.link_scores(docs, FIRST, SECOND)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = [r for r in out.collect()]
    assert sorted((r["doc_id"] for r in rows), key=lambda i: (i is None, i)) == odd.ALL_IDS
    long = [r for r in rows if r["doc_id"] == 5][0]
    assert long["n_links"] >= long["n_groups"] > 80_000
    assert token_alignment.link_scores(odd.empty(spark), FIRST, SECOND).count() == 0
    nothing = token_alignment.link_scores(docs.where("doc_id IN (1, 2)"), FIRST, SECOND).collect()
    assert [tuple(r[c] for c in COLUMNS) for r in nothing] == [(0, 0, 0, 0, 0, 0, "")] * 2
