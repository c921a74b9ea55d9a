import pytest

from skein.llm import residue
from skein.llm.residue_rules import kind_of

BAD = [
    "{{title}}", "# {{ title }}\n\n**Context**: ${context}\n\n**Content**: <%= content %>", "# Real title\n\n**Context**: The cache is slow when two workers race.\n\n**Content**: [INSERT CONTENT HERE]",
    "User: [à compléter : author]\n\nAssistant: <your impact here>", "Lorem ipsum dolor sit amet consectetur.\n\nCommodo labore magna minim veniam.", "test test test", "- This is placeholder copy for the record body. asdf asdf asdf qwer qwer",
    "404 | Not Found\nReturn home", "<h1>HTTP/1.1 503 Service Unavailable</h1><hr> Please try again later.", "No existe la página solicitada (error 404)", "Your session ran out. Sign in once more.",
    "<noscript>This app needs JavaScript. Please enable it and reload.</noscript>", "Home\nImport\nHelp\n\nCette vue ne fonctionne pas sans scripts.", "The\nviewer hit an unexpected error and had to stop. Request id: f9f9", "此页面需要开启脚本才能显示。",
    "- test test test test test test test test test", 'status=504 message="gateway timeout" If the problem persists, contact the administrator.', "Menu  Search\n<h1>Error\n410 - Gone</h1><hr>\nReturn home",
    "**Content**: undefined", "Dear team,\n\n{{owner}}\n\nStatus: <your date here>",
]
GOOD = [
    'The viewer told people "This page needs JavaScript. Turn scripts on", so we added a server-rendered fallback.', "We assert that no {% if date %}{{ date }}{% endif %} marker survives the export. Nobody reads it any more.",
    "If the API returns 404 Not Found, the client waits and tries again.", "Our layout test prints \"Lorem ipsum dolor sit amet.\" forty times to force a wrap.\n\nKeep the cache small.", "The convention is one retry budget per worker.",
    "# Document the error envelope\n\n**Context**: We keep the error page in Go.\n\n**Content**: The server error is logged once and then dropped by the client.", "abc1234 fix: Split the session cache by tenant",
]


def ids(spark, texts):
    df = spark.createDataFrame([(i, t, "p", "k") for i, t in enumerate(texts)], "doc_id bigint, text string, place string, label string")
    return df, {r.doc_id for r in residue.marked(df).where("residue").collect()}


def test_cases(spark):
    texts = BAD + GOOD + [None, "", " \n", "​"]
    df, got = ids(spark, texts)
    assert [texts[i] for i in sorted(set(range(len(BAD))) ^ got)] == []
    assert residue.clean_corpus(df).count() == len(GOOD) + 4


def test_label_spreads_to_near_copies(spark):
    filler = " ".join(["Lorem ipsum dolor sit amet consectetur adipiscing elit sed magna aliqua enim minim veniam nostrud."] * 1 + [f"Commodo labore {w} pulvinar tellus ligula." for w in "esse velit cillum fugiat nulla mollit anim".split()])
    near = filler.replace("veniam nostrud.", "veniam nostrud. Zorkly")
    _, got = ids(spark, [filler, near, "The cache keeps its size because every caller retries once."])
    assert got == {0, 1}


@pytest.mark.parametrize("length", [9, 14, 30, 90])
def test_links_follow_brute_force(spark, length):
    """Short fields too, whose SimHashes lie far apart although one word at the end differs, and fields that repeat themselves."""
    import random

    rng = random.Random(4)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(length)] for _ in range(6)]
    copies = []
    for b in base:
        for n in range(5):
            c = list(b)
            c[rng.choice([0, -1, rng.randrange(length)])] = rng.choice(words)
            copies.append(" ".join(c * (4 if n == 4 else 1)))
    codes = residue.simhashes([c.split(" ") for c in copies])
    rows = [(i - 2**40, codes[i], c, "filler" if i % 5 == 0 else "other") for i, c in enumerate(copies)]
    fields = spark.createDataFrame([(n, "body", label, n, h, w) for n, h, w, label in rows], residue.FIELDS)
    got = {r.node + 2**40 for r in residue.spread_labels(fields).collect()}
    want, grew = {i for i in range(len(copies)) if i % 5 == 0}, True
    while grew:
        new = {j for i in want for j in range(len(copies)) if j not in want and residue.jaccard(copies[i], copies[j]) >= residue.SIMILAR}
        grew, want = bool(new), want | new
    assert got == want


def test_units():
    assert kind_of("Return home") == "chrome" and kind_of("x" * 5000) == "other" and kind_of("") == "chrome"
    assert kind_of("%OWNER%") == "placeholder" and kind_of("100% of the rows and 5% more") == "other"


def test_length_does_not_change_the_kind():
    units = {"asdf qwer ": "filler", "{{a}} {{b}} ": "placeholder", "sample text, dummy content, ": "filler", "error 404 not found, ": "error", "please enable javascript, turn on scripts, ": "script", "page could not be found, access denied, ": "error"}
    for unit, kind in units.items():
        for n in (100, 200, 1_000):
            assert kind_of((unit * n)[: n // len(unit) * len(unit)].strip(" ,")) == kind, (unit, n)
    varied = "; ".join(f"{i} access denied; server could not be reached; sign in again; an unexpected error" for i in "abcdefgh")
    assert len(varied) > 600 and kind_of(varied) == "error"
    assert kind_of("The page you asked for could not be found on this server, so please look again at the address that was typed into it") == "error"
    assert kind_of("The cache keeps one entry for every tenant and drops it once the budget is spent, " * 1 + "and the page could not be found in a test of the old viewer, which is why the team wrote the new store with a longer plan for its rows") == "other"
