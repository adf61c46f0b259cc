"""Nothing is left out for its length or rarity: long pieces and words, garbled runs in long tokens, rare pairs, other scripts, long tokens."""

import numpy as np
import pytest

from quirel.llm import garbled, language, unicode_form


def test_all_lower_case_pieces_are_used():
    vocab = language.pieces()
    assert max(map(len, vocab)) > 9
    long = next(p[1:] for p in vocab if p[0] == "_" and len(p) > 10)
    table = language.PieceTable(vocab)
    prob = np.vstack([np.full((len(vocab), 1), 1e-6), np.zeros((1, 1)), np.full((1, 1), 1e-7)])
    # The piece itself is one of the segmentations.
    assert language.forward(language.lattice([long], table), prob)[0, -1, 0] >= 1e-6


def test_long_words_are_scored_to_their_end():
    words = language.units(["short", "a" * 100 + "b" * 100])
    assert "".join(words[1:]) == "a" * 100 + "b" * 100 and max(map(len, words)) <= language.UNIT
    m = language.Model(["x", "y"], language.PieceTable({"_a": 0, "a": 1, "b": 2}), np.array([[0.5, 0.1], [0.5, 0.1], [0.1, 0.5], [0, 0], [1e-7, 1e-7]]))
    paths, _, _, sizes = language.decode(m, [words[1:]])
    assert paths[0][0] == 0 and paths[0][-1] == 1 and sizes.sum() == 200


@pytest.fixture(scope="module")
def scores(spark):
    clean = ["Le théâtre à côté du château a été fermé après la soirée.", "Вчера вечером старый театр был закрыт до весны.", "Το παλιό θέατρο έκλεισε μέχρι την άνοιξη."] * 20
    return garbled.PairScores(*garbled.pair_scores(spark.createDataFrame([(t,) for t in clean], "t string"), "t"))


def test_garbled_run_across_the_end_of_a_stretch(scores):
    for k in range(390, 402):
        bad = "a" * k + "Ã©" + "b" * 20
        assert garbled.repair_text(bad, scores, {})[0] == "a" * k + "é" + "b" * 20


def test_other_scripts(scores):
    for t in ("Вчера вечером театр закрыт", "Το παλιό θέατρο έκλεισε"):
        for read in ("cp1252", "mac_roman"):
            bad = "".join(bytes([b]).decode(read, "ignore") or chr(b) for b in t.encode())
            assert garbled.repair_text(bad, scores, {})[0] == t
        assert garbled.repair_text(t, scores, {})[2] == 0
    assert garbled.repair_text("ESPAÑ” Î”", scores, {})[2] == 0


def test_pairs_of_characters_outside_the_alphabet_count_as_one(spark):
    df = spark.createDataFrame([("".join(chr(0x4E00 + i) for i in range(3000)),), ("été",)], "t string")
    pairs, n = garbled.pair_scores(df, "t")
    assert len(pairs) < 20 and n.sum() == 3001 + 4
    assert len(garbled.alphabet()) ** 2 < 1_000_000


def test_runs_only(scores):
    """A one-byte mapping leaves characters alone that stand in probable pairs."""
    inside: set[int] = set()
    assert garbled.one_byte_fixes("thŽ‰tre", scores, inside) == {}


def test_long_tokens_are_taken_by_stretches(spark):
    text = "漢字" * 500 + "ｆｕｌｌ" + "é" * 300
    df = spark.createDataFrame([(1, text), (1, text), (2, "ok")], "id int, t string")
    got = unicode_form.normalize_forms(df, ["id"], "t").collect()
    assert [r["text_form"] for r in got if r["id"] == 1] == ["漢字" * 500 + "full" + "é" * 300] * 2 and len(got) == 3
    assert [r["id"] for r in unicode_form.form_cases(df, ["id"], "t").collect()] == [1]
