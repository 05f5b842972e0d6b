"""Chunks of the byte-level ids: the library's ids, and few of them to learn."""

import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from turnloom.llm import byteids  # noqa: E402
from turnloom.llm.byteids import ByteIds  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_of_any_string_are_the_librarys():
    rng = random.Random(3)
    parts = list("ab Z09é÷×ßñ´`'\"._-,!?*$%&|<>[]{}~^\\/\t\n\r\x0b\x1c\x85\xa0́  　²½中😀ŁĀ") + ["don't", " we'll", "x's", "  ", "\n\n", " word", "é", "A1b2"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(4000)] + ["", " ", "end ", "<|endoftext|> a."]
    library = Tokenizer.from_file(PATH)
    got = ByteIds(PATH).encode(texts)
    assert [np.frombuffer(x, np.uint32).tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_word_is_learnt_once_whatever_follows_it():
    b = ByteIds(PATH)
    b.encode([f"a wordy{tail} a" for tail in (".", ",", "!", "***", "$$$", ")", "-", "")])
    assert [c for c in b._known if c.startswith(" wordy")] == [" wordy"]


def test_the_memory_of_a_worker_is_bounded():
    b = ByteIds(PATH)
    for start in range(0, 320_000, 20_000):
        b.learn(f" w{x}" for x in range(start, start + 20_000))
    assert len(b._known) <= 260_000


def test_a_full_memory_keeps_the_chunks_at_hand(monkeypatch):
    monkeypatch.setattr(byteids, "MEMORY", 50)
    b, library = ByteIds(PATH), Tokenizer.from_file(PATH)
    b.learn([f" old{x}" for x in range(40)] + [" the", " of"])
    learnt = []
    monkeypatch.setattr(b, "_plain", lambda text, plain=b._plain: learnt.extend(text.split("\n")) or plain(text))
    text = " the new" + "".join(f" n{x}" for x in range(30)) + " of"
    ids = np.frombuffer(b.encode([text])[0], np.uint32).tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert " n3" in learnt and " the" not in learnt and " of" not in learnt
    assert " the" in b._known and " old3" not in b._known and len(b._known) <= 50
