"""Mojibake with attached marks: a word and the marks around or inside it in one token."""

import math

import pytest

from spanforge.llm import mojibake as M


@pytest.mark.parametrize("true, wrong", [("cp1252", "mac_roman"), ("cp1252", "cp437"), ("mac_roman", "cp1252"), ("cp1252", "cp852")])
def test_marks_of_a_damaged_word(true, wrong):
    text = "la première année «l’été» où personne ne répond"
    d = M.Decoder({w: math.log(1 / 500) for w in "l été la première année où personne ne répond".split()})
    table = M.sloppy(wrong)
    hit, restored, _, whole = d.decode("".join(table[b] for b in text.encode(true)))
    assert hit and restored == text and whole, restored
    assert not d.decode(text)[0]
