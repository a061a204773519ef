"""Token ids: texts cut here against the library on whole texts."""

import random

import pytest

from webloom.llm.encoding import _DROPS, _KEEPS, Encoder, vocabulary_path


@pytest.mark.parametrize("name, drops_space", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_cut_texts_against_the_library(name, drops_space):
    """Texts are cut where the kind of character changes as the pattern cuts them, and plain words come back whole from one call of the library."""
    rng = random.Random(3)
    near = " \n\n  \t\r\x0b'sdlveABc.,!?12345é×-"
    texts = ["".join(rng.choice(near[:k]) for _ in range(rng.randint(0, 60))) for k in (8, 20, len(near)) for _ in range(500)]
    texts += ["", " ", "  ", "\n", "\n\n", "\n\n\n", "a\n\n", "\n\na", " a", "a ", "a\n\nb", "a\n\n\nb", "a b\n\nc d\n", "It's 12,5 % of it. \"So...\"", "中文 a", "x\0y z", "<|endoftext|>"]
    e = Encoder(vocabulary_path(name), drops_space)
    assert [x.tobytes() for x in e.encode(texts)] == e._whole(texts)
    pattern = _DROPS if drops_space else _KEEPS
    for t in ("Some words, 12 numbers; and (more).\n\nA second line", " a b\nc ", "Été 3x4"):
        assert [x for x in e._cut(t) if x] == pattern.findall(t.lower() if drops_space else t)
    words = [x + y + "qz" for x in "abcdefghij" for y in "abcdefghij"]
    pieces = words if drops_space else [f" {w}" for w in words]
    want, calls, whole = e._whole(pieces), [], e._whole
    e._whole = lambda t: calls.append(len(t)) or whole(t)
    assert e._pieces(pieces) == want and sum(calls) == 0 and e.mark_id is not None
