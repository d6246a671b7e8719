"""Token ids where hashes of pieces collide."""

import numpy as np
import pyarrow as pa
import pytest


def thue_morse(n: int) -> str:
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_colliding_pieces_keep_their_own_ids(name):
    from tokenizers import Tokenizer

    from quire.llm.arrays import text_buffer
    from quire.llm.queries import tokenizer_path
    from quire.llm.tokens import Pieces

    one = thue_morse(2048)
    other = one.translate(str.maketrans("ab", "ba"))
    texts = [f"x {one} y", f"x {other} y", f"{other} {one}", "plain words stand here", None, ""]
    path = tokenizer_path(name)
    pieces, plain = Pieces(path), Tokenizer.from_file(path)
    for rows in (texts, texts[::-1], texts[:1], texts[1:2]):
        ids, first = pieces.encode(*text_buffer(pa.array(rows)))
        for i, t in enumerate(rows):
            assert ids[first[i] : first[i + 1]].tolist() == plain.encode(t or "", add_special_tokens=False).ids


def test_forced_collision(monkeypatch):
    from tokenizers import Tokenizer

    from quire.llm import tokens
    from quire.llm.arrays import text_buffer
    from quire.llm.queries import tokenizer_path

    monkeypatch.setattr(tokens, "range_hash", lambda prefix, start, end: (end - start).astype(np.uint64) % np.uint64(3))
    path = tokenizer_path("byte_bpe_50k.json")
    pieces, plain = tokens.Pieces(path), Tokenizer.from_file(path)
    for rows in (["one two six ten", "ten six two one", "a bb ccc dddd"], ["longer words collide with shorter ones", "ones"]):
        ids, first = pieces.encode(*text_buffer(pa.array(rows)))
        for i, t in enumerate(rows):
            assert ids[first[i] : first[i + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids
