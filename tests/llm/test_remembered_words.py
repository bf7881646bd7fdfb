"""Words are cut and merged as seldom as memory allows, and texts worked on together have the ids that each has alone."""

from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import packing

_TEXTS = st.lists(
    st.one_of(st.text(st.characters(max_codepoint=0x17F), max_size=20), st.text(st.sampled_from("aÉ1_' \x01\x1c\x1f\x85\xad́。<|>　'st\n퟿"), max_size=12), st.sampled_from(["", " ", "<|endoftext|>", "don't, DON'T"])), max_size=8
)


def test_words_that_keep_coming_are_merged_once(monkeypatch):
    monkeypatch.setattr(packing.Ids, "LIMIT", 40_000)
    ids, calls = packing.Ids(), Counter()
    merge = ids.merge

    def counted(word):
        calls[word] += 1
        return merge(word)

    ids.merge = counted
    for i in range(300):
        rare = "".join(chr(97 + int(d)) for d in str(i)) + "q"
        ids.of(f"Often, often met {rare}x {rare}y, {rare}z.")
    # Far more is met than may be remembered: what is rare goes, and only that.
    assert calls["often"] == calls["met"] == 1 and len(calls) > 900
    assert ids.size <= 40_000
    ids.of("aqx")
    assert calls["aqx"] == 2


@settings(max_examples=200, deadline=None)
@given(_TEXTS)
def test_texts_together_have_the_ids_of_each(texts):
    ids = packing.ids_of()
    want = [[*ids.whole.encode(t, add_special_tokens=False).ids, packing.END_ID] for t in texts]
    for limit in (packing.Ids.LIMIT, 0):
        ids.LIMIT = limit
        got, ends = ids.of_all(texts)
        assert [part.tolist() for part in np.split(got, ends)[: len(texts)]] == want and len(got) == sum(map(len, want))
    del ids.LIMIT


def test_a_vocabulary_of_other_rules_is_left_to_the_tokenizer():
    ids = packing.Ids()
    texts = ["Hello, World! it's 42", "", "ein Größerer　Text 😀", "a\x1cb"]
    known = ids.of_all(texts)
    ids.known = False
    assert all(np.array_equal(a, b) for a, b in zip(known, ids.of_all(texts), strict=True))


def test_no_texts():
    ids, ends = packing.ids_of().of_all([])
    assert len(ids) == len(ends) == 0


def test_plain_letters_lower_one_by_one_and_stay_composed():
    import re
    import unicodedata

    plain = [c for c in map(chr, range(0x110000)) if not re.search(packing._ODD, c)]
    assert len(plain) == 94 + 62 + 127
    assert all(len(c.lower()) == 1 and c.lower() in plain and unicodedata.normalize("NFC", c) == c for c in plain)
    assert all(ord(c) < 128 or c.isalpha() for c in plain)
