"""What the contracts of single queries fix, on small inputs."""

import numpy as np
import public_tokenizers

from papyrine.llm import bpe, language, nearest


def test_numbers_are_no_letters():
    model = language.Identifier({"de": b"der die das und", "en": b"the and of to"})
    for text in (None, "", "12 34", "\u00bd", "\u00b2", "\u2460\u2461", "\u2167", "_ - \u00bd\u00b2 \u2167"):
        assert not language.has_letter(text)
        assert model(text)[0] == language.UNDECIDED
    for text in ("a", "\u00bda", "\u65e5", "\u00e9", "\u00aa 12"):
        assert language.has_letter(text)
    assert language.words("Ab\u00bdC x\u00b2 \u65e5\u672c 3d \u2167") == ["ab", "c", "x", "\u65e5\u672c", "d"]


def test_cosines_are_those_of_the_given_vectors():
    rng = np.random.default_rng(3)
    given = rng.standard_normal((400, 16)) * 10.0 ** rng.integers(-3, 4, (400, 1))
    given[7], given[8] = given[6], 2.0 * given[6]  # equal cosines, ties to the smaller id
    ids = np.arange(400)
    index = nearest.Index(ids, given)
    for q in (0, 6, 50):
        want = (given * given[q]).sum(1) / (np.sqrt((given * given).sum(1)) * np.sqrt((given[q] * given[q]).sum()))
        found, score = index.search(given[q], q, 5)
        assert score.tolist() == want[found].tolist()
        assert found.tolist() == sorted(found.tolist(), key=lambda i: (-want[i], i))
    assert index.search(given[6], 6, 2)[0].tolist() == [7, 8]
    huge = nearest.Index(ids[:3], np.array([[1e300, 1e300], [1e-300, 1e-300], [1e300, -1e300]]))
    assert np.allclose(huge.search(np.array([1e300, 1e300]), 0, 2)[1], [1, 0])


def test_many_words_just_short_of_long_are_encoded_in_bounded_statements():
    coder = bpe.Coder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = np.random.default_rng(4)
    words = {"".join(rng.choice(list("abcdefghij"), 190)) for _ in range(120)}
    assert coder.database.execute("SELECT current_setting('temp_directory')").fetchone()[0] in ("", None)
    coder.learn(words)
    assert all(np.array_equal(np.frombuffer(coder.known[w], np.int32), coder._by_heap(w.encode())) for w in words)
