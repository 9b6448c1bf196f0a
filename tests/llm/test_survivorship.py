import random

from bibspark.llm import survivorship as s

R = "id long, dblp_key string, record_type string, doi string, year int, venue string, key string, group_id int"


def brute(records, links):
    rank = {t: k for k, t in enumerate(s.TYPE_ORDER)}
    out = {}
    for g in sorted({g for k, g in links if k is not None and g is not None}):
        keys = {k for k, gg in links if gg == g}
        rows = [r for r in records if r[1] in keys]
        if not rows:
            continue
        def kind(r):
            t, v, k = (r[2] or "").strip().lower(), (r[5] or "").lower(), r[1].lower()
            if t == "data":
                return "artifact"
            if t in ("book", "phdthesis", "mastersthesis"):
                return "monograph"
            if k.startswith("journals/corr/") or "preprint" in v or v == "corr":
                return "preprint"
            return {"article": "journal", "inproceedings": "conference"}.get(t, "other")

        doi = lambda r: bool(r[3]) and "doi.org/10.1234/" in r[3].lower() and not r[3].endswith("/")
        year = lambda r: r[4] is not None and 1900 <= r[4] <= 2026
        venue = lambda r: bool(r[5]) and r[5].strip().lower() not in ("", "tba", "?", "-", "(no venue)", "unknown")
        rows.sort(key=lambda r: (rank[kind(r)], not doi(r), -(r[4] if year(r) else -1), r[1].lower(), r[0]))
        pick = lambda ok: next((r[0] for r in rows if ok(r)), None)
        out[g] = (pick(lambda r: True), pick(doi), pick(year), pick(venue))
    return out


def test_against_brute_force(spark):
    rng = random.Random(7)
    records = [
        (
            i, rng.choice(["journals/corr/", "journals/x/", "conf/y/"]) + f"K{i}", rng.choice(["article", " Article", "INPROCEEDINGS", "book", "data", "www", None, ""]),
            rng.choice([None, "", "n/a", "https://doi.org/10.", "HTTPS://DOI.org/10.1234/x", "http://dx.doi.org/10.1234/y", "https://doi.org/10.1234/"]),
            rng.choice([None, 0, 1899, 1900, 2026, 2027, 9999, 2001, 2001]), rng.choice([None, "", "TBA", "?", "-", "(no venue)", "Unknown", "CoRR", "Tide Preprints", "J. Maps"]), "clash", 1,
        )
        for i in range(300)
    ]
    links = [(records[rng.randrange(300)][1], rng.randrange(60)) for _ in range(250)]
    links += rng.choices(links, k=40) + [("gone", 99), (None, 3), ("gone", None)]
    got = s.survivors(spark.createDataFrame(records, R), spark.createDataFrame(links, "key string, group_id int"))
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == brute(records, links)


def test_empty(spark):
    assert s.survivors(spark.createDataFrame([], R), spark.createDataFrame([], "key string, group_id int")).count() == 0
