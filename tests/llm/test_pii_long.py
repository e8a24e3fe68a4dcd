"""Personal data in very long texts, and digits of every script."""

import time
import unicodedata

import pytest

from daybefore.llm import pii

N = 200_000


@pytest.mark.parametrize("text", [" " * N + "(at)", "x (at)" + " " * N + "[dot] y", "a" * N + " " + "a" * N + "@", "a" * N + "! " + "b" * N + "@c.de", "a@" * (N // 2), "( " * (N // 2) + "(at)",
                                  "1 " * (N // 2) + "(at)", "+1" + "(" * N + " [at] ", "one " * (N // 4) + "(at)", "a at " * (N // 5) + "b dot c", "1." * (N // 2), "\t" * N + "a @ b.c"],
                         ids=range(12))
def test_time_is_linear(text):
    pii.find("é (at) x")  # tables are made once
    began = time.time()
    pii.find(text)
    assert time.time() - began < 1.5
    began = time.time()
    pii.find(text[:N // 10])


def test_blanks_around_brackets_belong_to_the_disguise():
    for text in ("jane  [at]  example [dot] com", "jane(at) (at)example.com", "a b  (at)c(dot)de"):
        plain = pii.rewrite(text).text
        assert plain in ("jane@example.com", "jane@@example.com", "a b@c.de")


def test_digits_of_every_script():
    zeros = [c for c in range(0x110000) if unicodedata.decimal(chr(c), None) == 0 and c > 127]
    assert len(zeros) > 50
    for zero in zeros:
        text = "call +" + "".join(chr(zero + d) for d in (1, 2, 3, 4, 5, 6, 7, 8, 9, 0))
        assert pii.find(text)[1]["phone"] == [(5, 16)], hex(zero)
