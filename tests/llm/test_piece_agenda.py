"""The agenda's ids are the result; the library only checks them."""

import pytest

from pixelloom.llm import piece_codec
from pixelloom.llm.queries import PIECES


def test_a_wrong_agenda_fails(monkeypatch):
    memo = piece_codec.WordMemo(PIECES, 10)
    monkeypatch.setattr(memo.agenda, "encode", lambda chars: [5])
    with pytest.raises(ValueError, match="house"):
        memo.learn({"house"})


def test_ids_are_the_agendas():
    memo = piece_codec.WordMemo(PIECES, 10)
    memo.learn({"house", "▁▁x", "▁"})
    assert all(memo[w] == b"".join(i.to_bytes(4, "little") for i in memo.agenda.encode(w if w[0] == "▁" else "▁" + w)) for w in memo)
