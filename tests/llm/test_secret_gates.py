"""What the novelty search looks at: letters alone, digits alone, both sides of a sensitive word."""

import random
import string

import pytest

from citeweave.llm import secrets


def found(text):
    return [text[a:b] for kind, a, b in secrets.scan(text) if kind == "novel"]


@pytest.mark.parametrize("token", ["qZrVxKmWcTtYbLhPsDfG", "8305176294418273", "q8Zr1VxK2mWc9TtYb4Lh7PsD"])
def test_tokens_on_both_sides(token):
    assert found(f"the client sends Authorization: Bearer {token} and goes on") == [token]
    assert found(f"then {token} is what the bearer shows") == [token]
    assert secrets.redact(f"then {token} is what the bearer shows") == "then <secret:novel> is what the bearer shows"
    near, far = "." * secrets.NEAR, "." * (secrets.NEAR + 1)
    assert found(f"{token}{near}bearer") == [token] and found(f"{token}{far}bearer") == []
    assert found(f"bearer{near}{token}") == [token] and found(f"bearer{far}{token}") == []


def test_parts_of_tokens_around_a_sensitive_word():
    assert found("q8Zr1VxK2mWc9TtYb4Lh7PsD_secret_Wn3Xg5Jd7Fk2Hs9Pq4Lz") == ["q8Zr1VxK2mWc9TtYb4Lh7PsD_", "_Wn3Xg5Jd7Fk2Hs9Pq4Lz"]
    assert found("secret q8Zr1VxK2mWc9TtYb4Lh7PsD bearer") == ["q8Zr1VxK2mWc9TtYb4Lh7PsD"]


def test_words_are_spared():
    for word in ("ConcurrentModificationException", "Verantwortungsbewusstsein", "ACKNOWLEDGEMENTS", "/Users/John/Documents/", "incomprehensibilities", "----------------"):
        assert secrets.worded(word) and found(f"the private {word} of the authorization") == []


def test_random_letters_are_seldom_words():
    draw = random.Random(5)
    tokens = ["".join(draw.choices(string.ascii_letters, k=20)) for _ in range(2000)]
    assert sum(found(f"send the bearer {t} on") == [t] for t in tokens) > 1960
