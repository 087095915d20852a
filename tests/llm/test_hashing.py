import numpy as np

from playtrace.llm import hashing
from playtrace.llm.hashing import Batch, window_hashes


def test_words_are_runs_outside_ascii_white_space():
    text = "a\x0bb\xa0c  é\x1cf\n\td".encode()
    starts, ends = hashing.word_spans(np.frombuffer(text, np.uint8))
    assert [text[a:b] for a, b in zip(starts, ends)] == text.split()


def test_equal_words_have_equal_hashes_anywhere(monkeypatch):
    words = [f"w{i % 97}".encode() for i in range(5000)]
    whole = Batch([b" ".join(words)]).words
    monkeypatch.setattr(hashing, "CHUNK", 300)
    pieces = Batch([b"  ".join(words)]).words
    assert (whole == pieces).all()
    assert len(set(whole.tolist())) == 97


def test_windows_do_not_cross_texts():
    batch = Batch([b"a b c", None, b"a b", b"x a b c"])
    at = batch.window_starts(3)
    assert at.tolist() == [0, 5, 6]
    hashes = window_hashes(batch.words, 3)[at]
    assert hashes[0] == hashes[2] != hashes[1]
