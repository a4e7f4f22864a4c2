import json
import random

import pytest

from claimloom.functions import jsontext as J
from claimloom.functions import fuzzy as Z


@pytest.mark.parametrize("text,want", [
    ('{"a": 1}', {"a": 1}), ('x ```json\n{"a": [1, 2]}\n``` y', {"a": [1, 2]}), ('Sure: {"a": "}{"} done {', {"a": "}{"}), ("[1, 2] tail", [1, 2]), ("nothing", None), (None, None), ('{"a": 1', None), ('{"q": "say \\"hi\\""}!', {"q": 'say "hi"'}),
])
def test_extract(text, want):
    assert (lambda s: s and json.loads(s))(J.extract(text)) == want


@pytest.mark.parametrize("text,want", [
    ('{"facts": [{"a": 1}, {"a": 2}, {"a": 3', {"facts": [{"a": 1}, {"a": 2}]}), ('{"facts": [{"a": 1}], "u": [', {"facts": [{"a": 1}]}), ('{"a": "cut of', None), ('{"a": 1}', {"a": 1}), ("", None),
])
def test_salvage(text, want):
    assert (lambda s: s and json.loads(s))(J.salvage(text)) == want


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_distances_equal_the_plain_tables():
    rng = random.Random(3)
    for _ in range(400):
        a, b = ("".join(rng.choice("abcd é") for _ in range(rng.randint(0, 90))) for _ in range(2))
        assert Z.edit_distance(a, b) == distance(a, b) and Z.common_subsequence(a, b) == subsequence(a, b)


def test_places_of_quotes():
    page = "Income  from “Food – drink” rose.\nThe net-\nwork grew by 12% in the north, as planned."
    assert page[slice(*Z.locate(page, 'income from "food - drink"')[:2])] == "Income  from “Food – drink”"
    assert page[slice(*Z.locate(page, "THE NETWORK grew")[:2])] == "The net-\nwork grew"
    start, end, score, exact = Z.locate(page, "network grewe by 12% in teh north")
    assert 82 <= score < 100 and not exact and "12% in the nor" in page[start:end]
    assert Z.locate(page, "nothing of the kind here at all") is None and Z.locate("", "x") is None and Z.locate(page, " ") is None
    assert Z.locate_cell(page, "jjj qqq zzz | grew by 12% in", "12%")[3] and Z.locate_cell(page, "one cell", "x") is None
