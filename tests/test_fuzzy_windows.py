import random

import numpy as np

from claimloom.functions import fuzzy


def plain_best(hay, needle):
    n, end = len(needle), len(hay)
    like = lambda s, e: 100.0 * (1 - fuzzy.edit_distance(needle, hay[s:e]) / max(n, e - s))
    step = max(1, n // 4)
    score, start = max((like(s, s + n), -s) for s in range(0, end - n + 1, step))
    start = -start
    near, other = max((like(s, s + n), -s) for s in range(max(0, start - step), min(end - n, start + step) + 1))
    if near > score:
        score, start = near, -other
    stop = start + n
    for e in (stop - 12, stop - 8, stop - 4, stop + 4, stop + 8, stop + 12):
        if start < e <= end and (other := like(start, e)) > score:
            score, stop = other, e
    return start, stop, score


def test_windows_are_compared_at_once_with_the_same_results():
    random.seed(6)
    for size in (1, 2, 5, 27, 62, 63, 64, 80):
        for letters in ("ab", "abcdé ", "a😀\ud800bc"):
            for _ in range(12):
                hay = "".join(random.choices(letters, k=random.randrange(size, size * 4 + 30)))
                needle = "".join(random.choices(letters + "z", k=size))
                assert fuzzy.best_window(hay, needle) == plain_best(hay, needle)
    hay = np.frombuffer("kitten sitting".encode("utf-32-le"), np.uint32)
    assert fuzzy.window_distances(hay, "sittin", np.array([0, 7])).tolist() == [fuzzy.edit_distance("sittin", x) for x in ("kitten", "sittin")]
