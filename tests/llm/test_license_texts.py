"""Whole license texts: regions, every mandatory word, and excerpts that give way."""

import random
import re

import pytest

from segue.llm import license_scan

SCAN = license_scan.Scanner(license_scan.BASE, license_scan.TEMPLATES).scan


def spelled(text, rng, optional=True):
    """A template as a text: optional regions in or out, replaceable ones filled with other words."""
    text = re.sub(r"\{\{(\d+)[^}]*\}\}", lambda m: " ".join(f"name{k}" for k in range(rng.randrange(1, int(m[1]) + 1))), text)
    return re.sub(r"\[\[(.*?)\]\]", lambda m: m[1] if optional else " ", text, flags=re.S)


@pytest.mark.parametrize("label,text", license_scan.WHOLE)
def test_whole_texts_need_every_word(label, text):
    rng = random.Random(label)
    for optional in (True, False):
        whole = "Copyright 2024 someone\n\n" + spelled(text, rng, optional) + "\n\nmore"
        found = SCAN(whole.encode())
        assert label in found["labels"].split(",") and found["score"] == 1.0 and "excerpt" not in found["labels"]
    fixed = re.sub(r"\{\{.*?\}\}|\[\[.*?\]\]", " \0 ", text, flags=re.S).split()
    places = [k for k, w in enumerate(fixed) if re.search("[A-Za-z]", w)]
    for k in rng.sample(places, 25) + places[-3:]:
        changed = " ".join("zebra" if k == i else "x" if w == "\0" and "Neither" in fixed[max(i - 4, 0):i] else w for i, w in enumerate(fixed))
        assert SCAN(changed.replace("\0", " ").encode())["score"] < 1.0, fixed[k]


def test_excerpts_are_weaker_and_give_way():
    opening = spelled(license_scan._MIT, random.Random(1))
    found = SCAN(opening.encode())
    assert (found["labels"], found["score"]) == ("mit-excerpt", 0.8)
    whole = SCAN((opening + " " + spelled(license_scan._AS_IS, random.Random(2))).encode())
    assert (whole["labels"], whole["score"]) == ("mit", 1.0)
    assert SCAN(spelled(license_scan._BSD, random.Random(1)).encode())["labels"] == "bsd-excerpt"
    three = dict(license_scan.WHOLE)["bsd-3-clause"]
    assert SCAN(spelled(three, random.Random(3)).encode())["labels"] == "bsd-3-clause"


def test_twin_patterns_agree_with_the_automata():
    from segue.llm.queries import _license_regex

    rng = random.Random(5)
    for label, _, text in license_scan.TEMPLATES:
        automaton, pattern = license_scan.TokenAutomaton(text), re.compile(_license_regex(text) + " ")
        for k in range(6):
            words = re.sub("[^0-9a-z]+", " ", spelled(text, rng, k % 2 == 0).lower()).split()
            if k > 3:
                words[rng.randrange(len(words))] = "zebra"
            line = " " + " ".join(words) + " "
            starts = license_scan.Scanner._places(line.encode(), automaton.lead)
            accepted = any(automaton.shortest([w.encode() for w in words], at) is not None for at in starts)
            assert accepted == bool(pattern.search(line)), (label, k)
