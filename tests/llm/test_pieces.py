"""The table of pairs of pieces."""

import random
from pathlib import Path

import numpy as np
from sentencepiece import SentencePieceProcessor

from tidemark.llm import pieces


def test_new_pairs_go_into_the_table_without_sorting_it_again(monkeypatch):
    proto = Path(pieces.default_model()).read_bytes()
    model, library, rng = pieces.Pieces(proto), SentencePieceProcessor(model_proto=proto), random.Random(5)
    sort, sorts = np.argsort, []
    monkeypatch.setattr(np, "argsort", lambda a, *more, **named: (sorts.append(len(a)), sort(a, *more, **named))[1])
    for n in (300, 300, 300):
        texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(1, 14))) for _ in range(20)) for _ in range(n)]
        known = len(model.pairs)
        assert [x.tolist() for x in model.encode(texts)] == library.encode(texts)
        assert len(model.pairs) > known and (np.diff(model.pairs) > 0).all()
        assert len(model.together) == len(model.pairs) and model.together.dtype == bool
    asked = model.pairs[::37]
    size = len(model.text)
    assert model.together[::37].tolist() == [model._stay_apart(int(k) // size, int(k) % size) for k in asked]
    assert sorts == []
