import random

from voxloom.functions.text import edit_distance, word_error_rate


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_edit_distance_against_the_table_of_distances():
    rng = random.Random(1)
    for n in range(400):
        a, b = ([rng.randint(0, n % 7) for _ in range(rng.randint(0, 90))] for _ in range(2))
        assert edit_distance(a, b) == plain(a, b)
    assert edit_distance(list("kitten"), list("sitting")) == 3


def test_word_error_rate():
    assert word_error_rate("the cat, SAT", "The cat sat!") == 0.0
    assert word_error_rate("a b c d", "a x c") == 0.5
    assert word_error_rate("", "") == 0.0 and word_error_rate("...", "a") == 1.0 and word_error_rate("a", "") == 1.0
