from bibspark.llm import spam

POSTS = [
    "I measured the rack on Monday and it was loose, so the fan made a noise. Has anyone tried to fix it with string?",
    "My neighbour says that the oven is fine if you only use it on weekends. I would not touch the dough before you check it.",
    "Thanks, that fixed the tyre at once! It was the chain and not the hub, as you said. Where did you find the part?",
]
LOG = "Here is the log.\n" + "\n".join(f"2025-03-1{k % 10} 05:4{k % 10}:12 ERROR fand[{k}]: read failed at {k} ms" for k in range(20))
LIST = "What I packed for the weekend:\n" + "\n".join(f"- {k} x part{chr(97 + k % 26)}" for k in range(12)) + "\nDid I forget anything, or is that too much to carry?"
VERSE = "Oh crank, my crank, why did you leave? Oh crank, my crank, I still believe.\nThe wheel is cold, the wheel is gone, oh crank, my crank, we carry on."
REFERENCES = "\n".join(f"[{k}] A page about the rim that explains how the hub was built: http://site{k}.example/rim. I would start with the second chapter." for k in range(6))
CODE = "for x in range(5):\n    if rack.ready():\n        fan.start()\n    else:\n        raise ValueError('fan is not set')\nfor y in range(9):\n    rack.stop()\n    fan.close()\nreturn rack == fan"
SPAM = {
    "links": "\n".join(f"http://shop{k}.test/cheap-pills-{k}" for k in range(30)),
    "anchors": "".join(f'<li><a href="http://s{k}.test/x">buy pills</a></li>' for k in range(30)),
    "tags": " ".join(f"#{w}{k}" for k in range(15) for w in ("pills", "casino", "loans")),
    "words": "Great post, thank you for sharing!\n\n" + " ".join(["casino pills", "cheap loans", "pills casino", "loans cheap"] * 20),
    "list": ", ".join(["cheap watches", "watches replica", "replica pills", "cheap replica"] * 15),
}


def test_own_text():
    assert spam.own_text("[quote]a[quote]b[/quote]c[/quote]\nmine\n-- \nsig").split() == ["mine"]
    assert spam.own_text("X wrote:\n> a\n&gt; b\nmine").split() == ["mine"]
    assert spam.own_text("<blockquote>a</blockquote>mine\n____\nCheers,\nme").split() == ["mine"]
    assert spam.own_text("") == "" and spam.features("> only\n> quoted") is None and spam.features(None) is None and spam.features("--") is None


def test_flagged(spark):
    rows, k = [], 0
    for lang in ("en", "EN-us", None, "xx"):
        for i in range(60):
            k += 1
            rows.append((k, " ".join(POSTS[(i + j) % 3] for j in range(1 + i % 3)) + f" It took me {i} days to see why.", lang, "x"))
    fine = {"log": LOG, "list": LIST, "verse": VERSE, "references": REFERENCES, "code": CODE, "quoting": "[quote]" + SPAM["links"] + "[/quote]\nWhy does the filter let this through, and who can stop it?", "tiny": "Thanks!", "null": None, "empty": "", "blank": " \n"}
    for n, text in enumerate(fine.values()):
        rows.append((1000 + n, text, "en", "x"))
    for n, text in enumerate(SPAM.values()):
        rows += [(2000 + n, text, "en", "x"), (3000 + n, text, None, "x"), (4000 + n, POSTS[0] + "\n" + "> quoted\n" + text * 20, "de", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, language string")
    got = {r["doc_id"]: r["kind"] for r in spam.spam_posts(df).collect()}
    assert set(got) == {r[0] for r in rows if r[0] >= 2000}
    assert got[2000] == "links" and got[2002] == "tags" and got[2003] == "keywords"
    assert spam.spam_posts(df.limit(0)).count() == 0


def test_any_length_and_any_language(spark):
    """Short spam is found, short replies are not; a sentence has no greatest length; a language of few posts is measured like others."""
    posts = [(k, " ".join(POSTS[(k + j) % 3] for j in range(1 + k % 3)) + f" It took me {k} days to see why.", "en", "x") for k in range(120)]
    short = {"three": "http://a.test/pills http://b.test/casino http://c.test/loans cheap pills", "buy": "buy shoes " * 5}
    replies = ["Thanks!", "+1", "ok cool", "lol", "Same here.", "See http://rack.example/manual", "no idea, sorry", "me too me too", "What about the hub?"]
    posts += [(1000 + k, t, "en", "x") for k, t in enumerate(short.values())] + [(2000 + k, t, "en", "x") for k, t in enumerate(replies)]
    long = "My neighbour says that " + "the oven is fine and the dough is good and we wait for it, " * 12 + "so I did not touch it."
    posts += [(3000, long, "en", "x"), (3001, long, "de", "x"), (3002, SPAM["links"], "fr", "x"), (3003, SPAM["list"], "es", "x"), (3004, POSTS[0], "fr", "x")]
    got = {r["doc_id"] for r in spam.spam_posts(spark.createDataFrame(posts, "doc_id long, text string, lang string, language string")).collect()}
    assert got == {1000, 1001, 3002, 3003}
    assert spam.features(long)[-1] == 0 and list(spam.sentences("a b. The cat sat on it! v2.0 Is this not so? no. End here")) == ["The cat sat on it", "Is this not so"]


def test_distance_decides(spark):
    """Posts that point in a spam-directed direction are not flagged where their distance is not an outlier's."""
    posts = [(k, POSTS[k % 3] + f" It took me {k} days to see why.", "en", "x") for k in range(90)] + [(1000 + k, t, "en", "x") for k, t in enumerate(SPAM.values())]
    df = spark.createDataFrame(posts, "doc_id long, text string, lang string, language string")
    near, far = ({r["doc_id"] for r in spam.spam_posts(df, cut_distance=c).collect()} for c in (6.0, 1000.0))
    assert len(near) == len(SPAM) and not far


def test_languages(spark):
    df = spark.createDataFrame([("EN",), ("en-US",), (" de",), ("english",), ("fr_FR",), (None,), ("",), ("zz",)], "l string")
    assert [r[0] for r in df.select(spam.language(df["l"])).collect()] == ["en", "en", "de", None, "fr", None, None, None]
