"""Leaks planted in documents are found, short quotes and shared sentences are not."""

import random

from lodestitch.llm import leakage as L

WORDS = [f"word{k}" for k in range(500)]


def item(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def found(docs, items):
    index = L.build_index(items)
    return {(d, f[0]) for d, t in docs for f in L._scan_text(t, index)}


def test_planted():
    rnd = random.Random(5)
    items = [(k, item(rnd, 60) + ". Return the answer as a list of at most twelve of the files that you have opened along the way to it.") for k in range(20)]
    text = lambda k, a, n: " ".join(items[k][1].split()[a : a + n])
    altered = text(3, 5, 30).split()
    for p in (4, 13, 22):
        altered[p] = "other"
    lined = "\n".join(f"> {text(4, a, 6)}" for a in range(0, 36, 6))
    docs = [
        (0, f"before {text(0, 10, 20)} after"), (1, f"before {text(1, 10, 19)} other {text(1, 30, 9)}"), (2, text(2, 3, 25).upper().replace(" ", " , \n")),
        (3, " ".join(altered)), (4, lined), (5, f"{text(5, 0, 12)} x y z {text(5, 30, 12)}"),
        (6, "Return the answer as a list of at most twelve of the files that you have opened along the way to it."), (7, ""), (8, text(8, 0, 25) + " " + text(9, 0, 25)),
        (9, text(9, 2, 22).replace("word", "wo-rd")), (10, "\u00a0".join(text(10, 0, 22).split())), (11, " ".join(rnd.choice(WORDS) for _ in range(2000))),
    ]
    assert found(docs, items) == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (8, 8), (8, 9), (9, 9), (10, 10)}


def test_frames_and_blocks(spark, monkeypatch):
    rnd = random.Random(7)
    items = [(k, item(rnd, 40) + ". the shared sentence of all items has a lot more than twenty words in it so that it would be found if it were not shared at all.") for k in range(6)]
    docs = [(k, t, None) for k, t in enumerate([items[0][1], items[3][1][:200], None, "", items[5][1] + items[5][1]])]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    i = spark.createDataFrame([*items, (99, None)], "item_id long, text string")
    want = {(0, 0), (1, 3), (4, 5)}
    get = lambda: {(r.doc_id, r.item_id) for r in L.leaked_passages(spark, d, i).collect()}
    assert get() == want
    monkeypatch.setattr(L, "BLOCK_WORDS", 90)
    assert get() == want
    assert L.leaked_passages(spark, d, i.limit(0)).count() == 0
    assert L.leaked_passages(spark, d.limit(0), i).count() == 0


def test_short_lines_behind_markers():
    rnd = random.Random(6)
    items = [(k, item(rnd, 60)) for k in range(4)]
    words = [t.split() for _, t in items]
    four = lambda k, mark: "\n".join(f"{mark(n)}{' '.join(words[k][a : a + 4])}" for n, a in enumerate(range(0, 40, 4)))
    nine = words[3][:45]
    for p in range(4, 45, 9):
        nine[p] = "other"
    docs = [
        (0, four(0, lambda n: f"{n + 1}. ")), (1, four(1, lambda n: f"[{n + 1}] ")), (2, four(2, lambda n: f"{'abcdefghij'[n]}) ")),
        (3, "\n".join("Q: " + " ".join(nine[a : a + 9]) for a in range(0, 45, 9))),
    ]
    assert found(docs, items) == {(k, k) for k in range(4)}


def test_passages_of_both_scans_in_one_coordinate_system():
    rnd = random.Random(8)
    items = [(1, item(rnd, 70))]
    words = items[0][1].split()
    # one passage in plain running text, another in short marked lines, and lines of three words only
    lined = "\n".join(f"{n + 1}. {' '.join(words[a : a + 3])}" for n, a in enumerate(range(40, 64, 3)))
    text = f"start here {' '.join(words[:25])} and then\n{lined}\nend"
    index = L.build_index(items)
    got = L._scan_text(text, index)
    own = L.normal_words(text)
    assert len(got) == 2 and own[got[0][1] : got[0][2] + 1] == words[:25]
    assert own[got[1][1]] == words[40] and own[got[1][2]] == words[63]
    left, n, gone = L.without_words(text, [f[1:] for f in got])
    assert left == "start here  and then\n1. \nend" and n == len(own) and gone == sum(b - a + 1 for _, a, b in got)


def test_cleaned(spark, monkeypatch):
    rnd = random.Random(9)
    items = [(k, item(rnd, 40)) for k in range(5)]
    rest = [f"other{k}" for k in range(100)]
    docs = [(0, f"{' '.join(rest)} {items[0][1]} tail", 1), (1, items[1][1], 1), (2, " ".join(rest), 1), (3, None, 1), (4, "", 1),
            (5, f"{items[2][1]} {' '.join(rest)} {items[3][1]}", 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, n_words int")
    i = spark.createDataFrame(items, "item_id long, text string")
    for size in (L.BLOCK_WORDS, 90):
        monkeypatch.setattr(L, "BLOCK_WORDS", size)
        got = {r.doc_id: r for r in L.without_leaks(spark, d, i).collect()}
        assert set(got) == {0, 1, 5}
        assert got[1].removed and got[1].text is None
        assert got[0].text == f"{' '.join(rest)}  tail" and got[0].n_removed == 40
        assert got[5].text.split() == rest and got[5].n_words == 180
    assert L.without_leaks(spark, d.limit(0), i).count() == 0
    assert L.without_leaks(spark, d, i.limit(0)).count() == 0
