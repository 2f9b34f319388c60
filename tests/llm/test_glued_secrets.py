"""Random keys that / _ or - glue to words are found by their parts."""

import random
import string

from paperstrata.llm import secrets

BEFORE = ["", "the-quick-brown-fox-and-the-lazy-dog-", "static/assets/images/profile/pictures/", "some_long_name_of_a_variable_in_code_"]


def test_glued_keys(spark):
    rng = random.Random(11)
    key = lambda: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40))
    words = ["static", "assets", "images", "profile", "pictures", "the", "quick", "brown", "fox", "lazy", "dog", "report"]
    rows, places = [], {}
    for i in range(400):
        front, k = f"Some prose {'-'.join(rng.choices(words, k=9))} ü🌳 https://x.org/", key()
        before = BEFORE[i % 4]
        rows.append((i, f"{front} {before}{k} and more."))
        at = len(front) + 1 + len(before)
        places[i] = (at, at + 40, at - len(before))
    got = {r["doc_id"]: [s for s in r["spans"] if s["kind"] == "random"] for r in secrets.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    for kind in range(4):
        ids = range(kind, 400, 4)
        found = [i for i in ids if any(s["start"] <= places[i][0] and s["end"] >= places[i][1] for s in got[i])]
        assert len(found) >= 95, (BEFORE[kind], len(found))
    for i, spans in got.items():
        assert all(places[i][2] <= s["start"] for s in spans), i  # words alone are no secret
        assert not any(a is not b and a["start"] <= b["start"] and b["end"] <= a["end"] for a in spans for b in spans)
