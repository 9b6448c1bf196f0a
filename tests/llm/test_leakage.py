import random

from bibspark.llm import leakage

WORDS = [a + b + c for a in ("ba", "ko", "ri", "tu", "ze") for b in ("lan", "mor", "pid", "sug") for c in ("ta", "vik", "nor", "el")]


def passage(rng, n=30):
    return [rng.choice(WORDS) for _ in range(n)]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_length_is_the_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(300):
        a, b = [rng.choice("abcde") for _ in range(rng.randrange(1, 20))], [rng.choice("abcdef") for _ in range(rng.randrange(30))]
        assert leakage.common_length(leakage.Item._masks(a), len(a), b) == lcs(a, b)


def test_found_in_all_disguises(spark):
    rng = random.Random(5)
    items = [(i, " ".join(passage(rng)).capitalize() + ".", "x") for i in range(40)] + [(90, None, "x"), (91, "", "x"), (92, "   ", "x")]
    texts = {i: t for i, t, _ in items}
    words = lambda i: texts[i].split()
    hidden = {
        1: texts[1].upper(),
        2: "Hi all,\n" + "\n".join("> " + " ".join(words(2)[k : k + 4]) for k in range(0, 30, 4)) + "\nthanks",
        3: "<p>" + "</b> ".join(f"<b>{w}" for w in words(3)) + "</p>",
        4: " ".join(w if k % 9 else w[:2] + "x" + w[2:] for k, w in enumerate(words(4), 1)),
        5: "... " + " ".join(words(5)[12:]) + " ...",
        6: " ".join(w + (" (that bit stumped me)" if k == 14 else "") for k, w in enumerate(words(6))),
        7: " ".join(w[:3] + "-\n" + w[3:] if k % 5 == 0 else w for k, w in enumerate(words(7))),
        8: texts[8].replace("a", "а").replace(" ", " ").replace("&", "&amp;"),
        9: "[quote=x]" + texts[9] + "[/quote] agreed",
    }
    docs = [(100 + i, "Some post. " + t + " Bye.", None) for i, t in hidden.items()]
    docs += [(200, " ".join(passage(rng, 200)), None), (201, None, None), (202, "", None), (203, " ".join(words(10)[:8]), None), (204, texts[11] + " " + "filler " * 100_000, None), (205, texts[12] + "\n\n" + texts[13], None)]
    docs += [docs[0]]
    d, q = spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string, doc_id string")
    want = {(i, 100 + i) for i in hidden} | {(11, 204), (12, 205), (13, 205)}
    assert {(r["item_id"], r["doc_id"]) for r in leakage.leaks(d, q).collect()} == want
    assert {(r["item_id"], r["doc_id"]) for r in leakage.leaks(d, q, max_index_words=200).collect()} >= want  # dealt into several indexes
    assert leakage.leaks(d.limit(0), q).count() == leakage.leaks(d, q.limit(0)).count() == 0


def test_one_pattern_is_no_case():
    rng = random.Random(9)
    pattern = "when the {} bridge opened tolls on {} fell by {} percent while {} {} doubled and the {} guild paid".split()
    def fill():
        return " ".join(rng.choice(WORDS) + rng.choice(WORDS) if w == "{}" else w for w in pattern)
    items = [(i, fill() + " " + fill()) for i in range(60)]
    index = leakage.LeakIndex(items)
    assert [index.matches(fill() + " " + fill()) for _ in range(20)] == [[]] * 20
    assert [i for i, _ in index.matches(items[7][1])] == [7]


def test_parts_do_not_change_matches(spark):
    from bibspark.llm import leakage

    # Words of every item's pattern tell nothing, however few of the items an index holds.
    pattern = "please read the passage below and answer which river crosses the old town named"
    items = [(k, f"{pattern} {' '.join(f'place{chr(97 + k)}{chr(97 + j)}xq' for j in range(6))}") for k in range(20)]
    docs = [(100 + k, t) for k, (_, t) in enumerate(items)] + [(500, f"{pattern} nowhere at all in this land")]
    i, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    found = lambda most: {(r["item_id"], r["doc_id"]) for r in leakage.leaks(d, i, max_index_words=most).collect()}
    assert found(10_000) == found(40) == {(k, 100 + k) for k in range(20)}


def test_documents_and_passages_are_removed(spark):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in ("bran", "cor", "del", "fum", "gri") for b in ("tle", "vex", "mond", "pash", "wick", "zun")]
    items = [(k, " ".join(rng.choice(words) for _ in range(24))) for k in range(5)]
    whole = items[2][1].split()
    docs = [
        (1, "Before it all. " + items[0][1].upper() + " After it all.", "x"), (2, "nothing here at all", "x"), (3, None, "x"), (4, "", None),
        (5, "One: <b>" + items[1][1] + "</b> two: " + " ".join(whole[:8] + ["(sic)"] + whole[8:]) + " three.", "x"), (2, "nothing here at all", "y"),
    ]
    d, i = spark.createDataFrame(docs, "doc_id long, text string, held string"), spark.createDataFrame(items, "item_id long, text string")
    left = leakage.without_leaking_documents(d, i).collect()
    assert sorted((r["doc_id"], r["text"], r["held"]) for r in left if r["held"]) == [(2, "nothing here at all", "x"), (2, "nothing here at all", "y"), (3, None, "x")] and len(left) == 4
    got = {r["doc_id"]: (r["text"], r["removed"]) for r in leakage.without_leaking_passages(d, i).collect()}
    assert got[1] == ("Before it all.  After it all.", len(items[0][1])) and got[2] == ("nothing here at all", 0) and got[3] == (None, 0) and got[4] == ("", 0)
    assert got[5][0].startswith("One:") and got[5][0].endswith("three.") and " two: " in got[5][0] and got[5][1] >= len(items[1][1]) + len(items[2][1])
    assert leakage.leaks(leakage.without_leaking_passages(d, i), i).count() == 0 and leakage.without_leaking_passages(d.limit(0), i).count() == 0
