import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from gatelight.llm import tokens
from gatelight.llm.tokens import ChunkedTokenizer

PIECES = [
    "the", "Don't", "it's", "WE'LL", "''s", "x'y", "naïve", "ÉCOLE", "straße", "Σίσυφος", "ΟΔΟΣ", "İstanbul", "日本語", "é", "́",
    " ", "  ", "\n", "\n\n", " \n ", "\t", "\x1c", "\x1f", "\x85", " ", " ", "　", "\x0b", "\x0c", "\r\n", "12", "3.14", "²", "½", "٣",
    "***", "&&&", "%%%", "...", "…", "“q”", "a_b", "<|endoftext|>", "<|startoftext|>", "!", "--", "–", "🙂", "a", "A", "×", "÷", "ª", "ǅ", "ẞ", "\u0000",
]


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunks_give_the_ids_of_the_whole_text(name, spaced):
    own = ChunkedTokenizer(public_tokenizers.path(name), spaced)
    rng = random.Random(7)
    texts = ["", " ", "a" * 70_000] + ["".join(rng.choices(PIECES, k=rng.randint(1, 14))) for _ in range(4000)]
    whole = own.tokenizer.encode_batch(texts, add_special_tokens=False)
    for text, mine, theirs in zip(texts, own.encode(texts), whole):
        assert np.frombuffer(mine, "<u4").tolist() == theirs.ids, repr(text[:200])


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_units_give_the_ids_of_the_whole_text(monkeypatch, name, spaced):
    own = tokens.ChunkedTokenizer(public_tokenizers.path(name), spaced)
    rng = random.Random(8)
    pieces = [*PIECES, *" " * 60, "\u2003", "\u00a0", "\u3000", "«", "’", "a word", " of sixteen bytes", " antidisestablishment"]
    texts = ["", None, " ", "\n", " a", "a ", *("".join(rng.choices(pieces, k=rng.randint(0, 40))) for _ in range(6000)), "b" * 70_000, "", None]
    monkeypatch.setattr(tokens, "MAX_IDS", 9000)
    monkeypatch.setattr("gatelight.llm.text.PART_BYTES", 20_000)
    whole = [x.ids for x in own.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for column in (pa.array(texts), pa.chunked_array([texts[:7], texts[7:]])):
        ids, bounds = own.encode_column(column, 7)
        assert len(bounds) == len(texts) + 1
        for text, a, b, theirs in zip(texts, bounds, bounds[1:], whole):
            assert ids[a:b].tolist() == [*theirs, 7], repr(text)
    assert tokens.binary(ids, bounds).to_pylist()[2] == ids[bounds[2] : bounds[3]].tobytes()
    assert own.encode_column(pa.array([], pa.string()), 7)[1].tolist() == [0]


def test_tables_of_bytes_and_words_behind_a_space():
    raw = np.frombuffer("a Ünder—\n\x85!".encode(), "u1")
    for table in (tokens._CLASS, tokens._SPACES, tokens._BREAKS, tokens._ODD):
        found = tokens._looked_up(table, raw)
        assert found.dtype == table.dtype and found.flags.writeable and (found == table[raw]).all()
    own = ChunkedTokenizer(public_tokenizers.path("byte_bpe_50k.json"), True)
    for unit in (" word", " Zyxwvu", " ", "a", " école", "\nword", " a1", "  two"):
        assert own._unit_ids(unit.encode()) == own.tokenizer.encode(unit, add_special_tokens=False).ids, unit
