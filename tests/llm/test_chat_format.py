from __future__ import annotations

import random

import pytest

from gaugeworks.llm import entries
from gaugeworks.llm.chat_format import rotate_perspectives
from tests.duck import assert_same, views

SCHEMA = "conv_id long, turn long, role string, text string, part int, participant string, masks int, turns string, heads int, t int, rank int, opening string"
LONG = "very long " * 100_000
TURNS = [
    (1, 0, "system", "Be kind."), (1, 1, "ann", "Hi <|end|> é"), (1, 2, "bob b", "Yo 😀"), (1, 2, "bob b", "Yo 😀"), (1, 2, "bob_b", "one"), (1, 600, "ann", None), (2, 0, None, "who"), (2, None, "cy", ""),
    (None, 0, "dee", "x"), (None, 7000, "dee", "y"), (3, 0, "system", "alone"), (4, 5, "a|<>%", LONG), (4, 4, "b", LONG), (4, 9, "unknown", LONG), (4, 9, None, LONG),
]


def name(role):
    return "".join(f"%{ord(c):02X}" if c in "%|<> \t\n\x0b\x0c\r" else c for c in role)


def brute(turns, per_row=None):
    keyed = sorted(turns, key=lambda t: ((t[0] is None, t[0] or 0), (t[1] is not None, t[1] or 0), (t[2] is not None, t[2] or ""), t[3] or ""))
    out = []
    for conv in {t[0] for t in turns}:
        own = [t for t in keyed if t[0] == conv]
        heads = ["<|user|>\n" if r is None else f"<|{name(r)}|>\n" if r == "system" else f"<|user name={name(r)}|>\n" for _, _, r, _ in own]
        bodies = [(x or "").replace("<|", "<\\|") + "<|end|>\n" for *_, x in own]
        opening = next((h + b for h, b, t in zip(heads, bodies, own) if t[2] == "system"), "")
        for who in {t[2] for t in own} - {None, "system"}:
            size = per_row or len(own)
            for part in range(-(-len(own) // size)):
                text, masks = opening if part else "", []
                here = range(part * size, min(len(own), (part + 1) * size))
                for k in here:
                    text += "<|assistant|>\n" if own[k][2] == who else heads[k]
                    begin = len(text)
                    text += bodies[k]
                    if own[k][2] == who:
                        masks.append((begin, len(text) - 1))
                out.append((conv, who, part, here[0], len(here), text, masks, sum(b - a for a, b in masks)))
    return sorted(out, key=str)


@pytest.mark.parametrize("per_row", [None, 1, 2, 3])
def test_against_brute_force(spark, per_row):
    turns = spark.createDataFrame([(*t, 9, "z", 9, "q", 1, 2, 3, "o") for t in TURNS], SCHEMA)
    rows = rotate_perspectives(turns, turns_per_row=per_row).collect()
    found = [(r["conv_id"], r["participant"], r["part"], r["first_turn"], r["n_turns"], r["text"], [tuple(m) for m in r["masks"]], r["n_masked"]) for r in rows]
    assert sorted(found, key=str) == brute(TURNS, per_row)
    assert rotate_perspectives(turns.limit(0), turns_per_row=per_row).count() == 0


@pytest.mark.parametrize("per_row", [1, 2, 3, 7])
def test_parts_are_the_whole(spark, per_row):
    """Put together, parts give exactly the rendering and the masks of the whole dialogue."""
    turns = spark.createDataFrame([(*t, 9, "z", 9, "q", 1, 2, 3, "o") for t in TURNS], SCHEMA)
    whole = {(r["conv_id"], r["participant"]): (r["text"], [tuple(m) for m in r["masks"]]) for r in rotate_perspectives(turns).collect()}
    parts = {}
    for r in sorted(rotate_perspectives(turns, turns_per_row=per_row).collect(), key=lambda r: r["part"]):
        text, masks = parts.get((r["conv_id"], r["participant"]), ("", []))
        assert r["text_start"] == len(text)
        moved = r["text_start"] - r["opening_chars"]
        parts[r["conv_id"], r["participant"]] = (text + r["text"][r["opening_chars"] :], masks + [(m["start"] + moved, m["end"] + moved) for m in r["masks"]])
    assert parts == whole


def test_long_conversations(spark, tmp_path):
    """Sparse, repeated and null turn numbers, and a conversation of 1,300 turns: whole by default, in parts of 512 in the query."""
    rng = random.Random(3)
    turns = [(1, rng.choice([None, 5, i * 1000]), rng.choice(["ann", "bob", "system", None]), f"said {i}") for i in range(1300)] + [(2, 1000 * i, "ann", f"x{i}") for i in range(6)]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    whole = rotate_perspectives(table).collect()
    assert sorted((r["conv_id"], r["participant"], r["n_turns"]) for r in whole) == [(1, "ann", 1300), (1, "bob", 1300), (2, "ann", 6)]
    table.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    parts = entries.op9_chat_format(spark, str(tmp_path)).toPandas()
    assert sorted(parts.loc[parts["participant"] == "ann", "first_turn"]) == [0, 0, 512, 1024]
    assert_same(parts, views(str(tmp_path)).sql(entries.ORACLE_SQL["op9_chat_format"]).df())
